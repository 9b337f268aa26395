"""Plain restatements of the contracts, for tables small enough to loop over."""

import hashlib
import re
from collections import Counter

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def licenses(docs):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    out = []
    for doc_id, text in docs:
        words = ALNUM.findall((text or "").translate(LOWER))
        hits = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in hits]
        out.append((doc_id, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))))
    return out


def repeats(docs, window=35):
    words = [BLANK.findall(t or "") for _, t in docs]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(docs, words, strict=True):
        gone = {i + j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(window)}
        out.append((doc_id, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def tokens(docs, path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    out = []
    for doc_id, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        out.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))))
    return out


def quality(docs):
    out = []
    for doc_id, text in docs:
        text = text or ""
        words = BLANK.findall(text)
        seen, doubled = set(), 0
        for line in text.split("\n"):
            if BLANK.search(line):
                doubled += line in seen
                seen.add(line)
        three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        twice = Counter(three)
        again = len({i + j for i, t in enumerate(three) if twice[t] > 1 for j in range(3)})
        out.append((doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), doubled, again, len(words) < 50 or 100 * again > 50 * len(words)))
    return out


def secrets(docs):
    kinds = [
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
        ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
    ]
    out = []
    for doc_id, text in docs:
        spans = [(m.start(), i, m.end(), k) for i, (k, p, g, n) in enumerate(kinds) for m in p.finditer(text or "") if len(m[g]) >= n]
        count = Counter(k for *_, k in spans)
        out.append((doc_id, count["assign"], count["access"], count["hex"], sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)))))
    return out


def groups(docs, k=2, per_cent=80):
    sets = []
    for _, text in docs:
        w = BLANK.findall((text or "").translate(LOWER))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= per_cent * max(len(a), len(b)) and docs[i][0] is not None and docs[j][0] is not None:
                both = len(a & b)
                if 100 * both >= per_cent * (len(a) + len(b) - both):
                    root[find(i)] = find(j)
    low = {}
    for i, (doc_id, _) in enumerate(docs):
        r = find(i)
        low[r] = doc_id if low.get(r) is None else min(low[r], doc_id)
    return [(d, len(s), low[find(i)], d is None or d == low[find(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))]


def leaks(docs, items, span=10):
    windows = {}
    for item, text in items:
        w = ALNUM.findall((text or "").translate(LOWER))
        n = min(len(w), span)
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(n, {}).setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w = ALNUM.findall((text or "").translate(LOWER))
        hit, names = set(), set()
        for n, known in windows.items():
            for i in range(len(w) - n + 1):
                if (found := known.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    names |= found
        named = sorted(str(x) for x in names if x is not None)
        out.append((doc_id, len(w), len(hit), len(named), sha(",".join(named)), bool(hit)))
    return out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def lines(docs, most=2, least=30):
    every = [(d, r, i, x) for r, (d, t) in enumerate(docs) for i, x in enumerate((t or "").split("\n")) if len(x) >= least and BLANK.search(x)]
    texts = sorted({x for *_, x in every})
    root = {x: x for x in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    bags = [Counter(x) for x in texts]
    for i, a in enumerate(texts):
        for j in range(i):
            b = texts[j]
            if abs(len(a) - len(b)) <= most and sum((bags[i] - bags[j]).values()) <= most and sum((bags[j] - bags[i]).values()) <= most and distance(a, b) <= most:
                root[find(a)] = find(b)
    seen, lost = set(), Counter()
    gone = set()
    for d, r, i, x in sorted(every, key=lambda e: (e[0] is not None, e[0] or 0, e[1], e[2])):
        key = find(x)
        if key in seen:
            lost[r] += 1
            gone.add((r, i))
        seen.add(key)
    return [(d, lost[r], sha("\n".join(x for i, x in enumerate((t or "").split("\n")) if (r, i) not in gone))) for r, (d, t) in enumerate(docs)]


def every_line(docs, most=2, edits_from=15):
    """Line by line: a line goes if a chain of links leads to an earlier one, whatever its length."""
    every = sorted(((d is not None, d or 0, r, i, x) for r, (d, t) in enumerate(docs) for i, x in enumerate((t or "").split("\n")) if BLANK.search(x)))
    linked = lambda a, b: a == b or min(len(a), len(b)) >= edits_from and distance(a, b) <= most
    gone = set()
    for n, (*_, row, at, line) in enumerate(every):
        reached, fresh = {line}, [line]
        while fresh:
            a = fresh.pop()
            more = {e[-1] for e in every if e[-1] not in reached and linked(a, e[-1])}
            reached |= more
            fresh += more
        if any(e[-1] in reached for e in every[:n]):
            gone.add((row, at))
    return [(d, sum(g[0] == r for g in gone), sha("\n".join(x for i, x in enumerate((t or "").split("\n")) if (r, i) not in gone))) for r, (d, t) in enumerate(docs)]


def license_labels(docs, templates, share=0.8, apart=3, stretch=1.5):
    """Labels, best share and number of spans, diagonal by diagonal."""
    out = []
    for doc_id, text in docs:
        words = ALNUM.findall((text or "").translate(LOWER))
        found = []
        for _, label, base, k, t in templates:
            votes = {}
            for p in range(len(t) - k + 1):
                for i in range(len(words) - k + 1):
                    if words[i : i + k] == t[p : p + k]:
                        votes.setdefault(i - p, set()).add(p)
            runs = []
            for d in sorted(votes):
                if runs and not base and d - runs[-1][-1] <= apart:
                    runs[-1].append(d)
                else:
                    runs.append([d])
            for run in runs:
                held = len({p + j for d in run for p in votes[d] for j in range(k)}) / len(t)
                first, past = min(d + min(votes[d]) for d in run), max(d + max(votes[d]) + k for d in run)
                if held == 1 if base else held >= share and past - first <= stretch * len(t):
                    found.append((label, held))
        out.append((doc_id, ",".join(sorted({x for x, _ in found})), max((h for _, h in found), default=0.0), len(found)))
    return out


def line_breaks_a_rule(line):
    import regex

    from folioscope.llm import quality

    words = BLANK.findall(line)
    n = len(words)
    if not n:
        return False
    marks, apart = len(re.findall(r"[#*$%&|<>]", line)), len(re.findall(r"[\x20\x09-\x0D][|>»·•/][\x20\x09-\x0D]", line))
    return (
        (apart >= 3 and 6 * apart >= n)
        or (marks >= 3 and 4 * marks > n)
        or (n >= 4 and 3 * (line.count("!") + line.count("?")) > n)
        or (n >= 20 and not set(line) & set(".!?:;…。！？"))
        or (n >= 4 and bool(regex.search(r"\p{Lu}", line)) and not regex.search(r"\p{Ll}", line))
        or (n >= 20 and 3 * len(set(words)) < n)
        or (n <= 20 and bool(re.search(quality.BOILERPLATE, line)))
    )


def cleaned(docs):
    """(doc_id, kept, lines with a word, failing lines, lost words, clean text)."""
    out = []
    for (doc_id, text), base in zip(docs, quality(docs), strict=True):
        lines = (text or "").split("\n")
        bad = [line_breaks_a_rule(x) for x in lines]
        lost = sum(len(BLANK.findall(x)) for x, b in zip(lines, bad, strict=True) if b)
        left = "\n".join(x for x, b in zip(lines, bad, strict=True) if not b)
        out.append((doc_id, not base[-1] and 100 * lost <= 50 * base[1], sum(bool(BLANK.search(x)) for x in lines), sum(bad), lost, left))
    return out


def chats(messages, schemas):
    """Conversation by conversation: counts and the order of the messages by (turn, role)."""
    import json

    from folioscope.llm import chat

    out = []
    for conv in {m[0] for m in messages}:
        mine = sorted((m for m in messages if m[0] == conv), key=lambda m: (m[1] is not None, m[1] or 0))
        shown = [(m, *chat._message(m[2] or "", m[3] or "", schemas)) for m in mine]
        shown.sort(key=lambda x: (x[0][1] is not None, x[0][1] or 0, x[1]))
        calls = [(n, x[0], c) for n, x in enumerate(shown) for c in x[2]]
        behind, linked, orphans, closed = {}, 0, 0, set()
        for n, (m, _, _, answers) in enumerate(shown):
            if answers is None:
                continue
            when = lambda t: (t is not None, t or 0)
            mates = [(k, c) for k, (at, cm, c) in enumerate(calls) if c["id"] == answers]
            before = [(k, c) for k, c in mates if when(calls[k][1][1]) < when(m[1])]
            if not mates:
                orphans += 1
                continue
            k = before[-1][0] if before else mates[0][0]
            same = [i for i, (at, cm, c) in enumerate(calls) if c["id"] == answers and shown[at][1] == shown[calls[k][0]][1] and cm[1] == calls[k][1][1] and c["at"] == calls[k][2]["at"]]
            closed |= set(same)
            linked += 1
            behind[n] = (calls[k][0], calls[k][2]["at"])
        order = sorted(range(len(shown)), key=lambda n: ((shown[(o := behind[n][0] if n in behind else n)][0][1] is not None, shown[o][0][1] or 0), shown[o][1], n in behind, behind[n][1] if n in behind else 0, shown[n][0][1] or 0, shown[n][1]))
        out.append((conv, len(shown), len(calls), sum(not c["valid"] for *_, c in calls), linked, orphans, len(calls) - len(closed), "[" + ",".join(shown[n][1] for n in order) + "]"))
        json.loads(out[-1][-1])
    return out


def resampled(docs, good_ids, share, buckets, seed):
    """Log ratios by counting each n-gram's bucket one by one, and the ids of the largest scores."""
    import math

    import numpy as np
    import xxhash

    from folioscope.llm import common

    def bucket(gram):
        one = np.array([xxhash.xxh3_64_intdigest(w.encode()) for w in gram], np.uint64)
        return int((common.mixed(one) if len(gram) == 1 else common.grams(one, len(gram)))[0] % np.uint64(buckets))

    bags = []
    for _, text in docs:
        w = BLANK.findall((text or "").translate(LOWER))
        bags.append([bucket((x,)) for x in w] + [bucket(p) for p in zip(w, w[1:], strict=False)])
    raw, aim = Counter(b for bag in bags for b in bag), Counter(b for (d, _), bag in zip(docs, bags, strict=True) if d in good_ids for b in bag)
    n_raw, n_aim = sum(raw.values()) + buckets, sum(aim.values()) + buckets
    out = []
    for (doc_id, _), bag in zip(docs, bags, strict=True):
        ratio = sum(math.log((aim[b] + 1) / n_aim) - math.log((raw[b] + 1) / n_raw) for b in bag)
        seeded = common.mixed(np.array([seed + 1], np.uint64))
        noise = common.mixed(np.array([-(1 << 62) if doc_id is None else doc_id], np.int64).astype(np.uint64) + seeded)
        uniform = (float(noise[0] >> np.uint64(11)) + 0.5) / 2.0**53
        out.append((doc_id, len(bag), ratio, ratio - math.log(-math.log(uniform))))
    edge = sorted((x[3] for x in out), reverse=True)[: round(share * len(out))]
    return out, edge
