"""Inline relations for operators that the driver's prose leaves empty: dialogue, records, scores."""

from __future__ import annotations

from folioscope.functions.lexicons import WATCH_PHRASES

_CALM = "She set the bread on the table. He counted the jars near the door. The lamp was low and the road lay dark."

#: manuscript_id, chapter, ord, raw
CHAPTERS = [
    ("m1", "chapter-01.md", 1, "# Chapter 1: The Door\n\n<!-- words: 900 -->\n\n“Who is there?” Mary asked. “Only me,” said John. “Come in, then.”\n\nShe stood. She watched. She waited. She left.\n\n" + _CALM),
    ("m1", "chapter-02.md", 2, "# Chapter 2: The Road\n\n\"I don't know,\" said Mary. \"Perhaps we shall see.\" John said, \"Very well.\"\n\nThe stone was cold — very cold -- and the the road went on. It was like a wolf in winter.\n\nNot a road, but a river. Love is always a silence."),
    ("m1", "chapter-03.md", 3, "# Chapter 3: The Jar\n\nIt was late. It was like a wolf in winter. Mary walked quickly and quietly home.\n\n***\n\n“We can't stay,” said Mary. “Why not?” asked John.\n\nThe store-room was shut, the storeroom was cold. Nothing is ever lost."),
    ("m1", "chapter-05.md", 4, "# Chapter 4: The Well\n\n> An old saying\n\nJohn looked down. The water was still...  Mary had gone (to the well.\n\n***\n\nThe family was okay; the Miryam of old, the Mariam of now. Time is everything."),
    ("m2", "chapter-01.md", 1, "# Chapter 1: Start\n\nAnna saw the window. Anna heard the lamp. \"Fine.\" said Anna. \"Fine,\" said Paul.\n\nAnna had the knife. The hand was steady."),
    ("m2", "chapter-02.md", 2, "# Chapter 2: End\n\nPaul had the lamp. Anna felt the stone… and left, which meant the end.\n\n---\n\nThe road was long. “Go,” said Anna."),
]

TIMELINE = [
    (1, "# chronology"), (2, 'event id=birth day=-3287 label="birth"'), (3, "event id=feast day=0"), (4, "event id=trip day=14 label=trip"),
    (5, "age person=Mary at=birth years=9 src=ch1"), (6, "age person=Mary at=feast years=19 src=ch2"), (7, "age person=John at=trip years=30 src=ch2"), (8, "age person=John at=nowhere years=31 src=ch3"),
    (9, "span from=feast to=trip stated=2w src=ch1"), (10, "span from=feast to=trip stated=3d src=ch4"), (11, "span from=trip to=feast stated=14d src=ch4"), (12, "span from=feast to=lost stated=1d src=ch5"),
    (13, "once id=wedding at=feast src=ch1"), (14, "once id=wedding at=trip src=ch3"), (15, "once id=burial at=trip src=ch3"), (16, "bogus line here"),
]

TEXTURE = [(1, 'texture id=t1 term="bread" kind=food src=book1'), (2, 'texture id=t2 term="lamp" kind=object'), (3, 'texture id=t3 term="harp" kind=music src=book2'), (4, 'texture id=t1 term="stone" kind=object src=book3'), (5, 'texture id=t4 term="road" kind=unheard src=book4')]
MOTIFS = [(1, 'motif id=m1 term="wolf in winter"'), (2, 'motif id=m2 term="dark"')]
REPORTS = [("m1", 1, "meta  chapter=1  structure=chronological  hook=image"), ("m1", 2, "meta  chapter=2  structure=chronological  hook=question"), ("m1", 4, "meta  chapter=4  structure=frame  hook=image"), ("m2", 1, "meta  chapter=1  structure=frame  hook=dialogue")]
LEXICON = [("mary", "perhaps"), ("mary", "okay"), ("JOHN", "very"), ("paul", "fine"), ("ghost", "boo")]
EVIDENCE = [
    (1, "r1", "1", "5", "good", "yes"), (2, "r1", "1", "4", "again", "1"), (3, "r2", "1", "2", "slow", "no"), (4, "r3", "2", "9", "bad rating", "true"),
    (5, "r3", "2", "3", "ok", "true"), (6, "r4", "x", "3", "bad chapter", ""), (7, "", "2", "3", "no reader", ""), (8, "r5", "3", "4", "fine", "TRUE"), (9, "r6", "3", "4", "", "1"),
]
#: book, iteration, dimension, weight, score
SCORES = [(b, i, d, w, s) for b, i, scores in [("b1", 1, [8.5, 9.0, 9.0, 9.2, 8.9, 9.1, 8.8, 9.0, 9.3, 8.7]), ("b1", 2, [8.9, 9.1, 9.2, 9.0, 9.0, 9.1, 9.0, 9.2, 9.3, 9.1]), ("b2", 1, [7.9, 8.4, 9.0, 8.0, 8.8, 8.1, 8.2, 8.0, 9.0, 8.0]), ("b2", 2, [8.8, 8.3, 9.0, 8.0, 8.8, 8.1, 8.2, 8.0, 9.0, 8.0])] for d, w, s in zip(["originality", "theme", "characters", "prose", "pacing", "emotion", "cohesion", "market", "voice", "ending"], [1.1, 1.0, 1.2, 1.0, 1.0, 1.1, 0.9, 0.8, 1.1, 0.8], scores, strict=True)]
#: chapter, floor
FLOORS = [("b1", 1, 8.5), ("b1", 2, 8.5), ("b1", 3, 8.5), ("b1", 4, 8.5), ("b1", 5, 8.5), ("b1", 6, 8.5), ("b2", 1, 8.5), ("b2", 2, 9.2), ("b2", 3, 8.6), ("b2", 4, 9.4), ("b2", 5, 8.5), ("b2", 6, 9.0)]
#: project, seq, event_type, note, expected_phase, block, approved
STATE = [("p1", 1, "chapter-drafted", "one", "draft", "chapters", False), ("p1", 2, "phase-advance", "go", "draft", "pipeline", False), ("p1", 3, "phase-advance", "go", "draft", "pipeline", True), ("p1", 4, "chapter-drafted", "late", "draft", "chapters", False), ("p1", 5, "note-added", "", "review", "notes", False), ("p1", 6, "chapter-drafted", "x", "review", "secrets", False), ("p1", 7, "unknown", "x", "review", "notes", False)]
#: character, fact, kind, ord
FACTS = [("Mary", "letter", "learned", 2), ("Mary", "letter", "used", 3), ("John", "letter", "used", 1), ("John", "letter", "learned", 4), ("Anna", "key", "used", 2)]
#: entity, field, ord, value
ENTITIES = [("Mary", "place", 1, "town"), ("Mary", "place", 2, "town"), ("Mary", "place", 3, "sea"), ("John", "place", 1, "sea"), ("John", "age", 1, "30"), ("John", "age", 4, "31")]

_NAMES = ["originality", "theme", "characters", "prose", "pacing", "emotion", "cohesion", "market", "voice", "ending"]
#: Two published boards with weights of their own; their averages are published, too.
_OWN = [1.2, 1.1, 1.2, 1.0, 0.8, 1.0, 0.8, 0.7, 1.0, 1.2]
_BOARDS = [("aquarius", 4, [9.3, 9.4, 9.3, 9.2, 9.0, 9.3, 8.9, 8.5, 9.1, 9.2]), ("protocol", 2, [8.9, 9.1, 9.0, 9.0, 8.7, 9.0, 9.0, 8.7, 9.0, 9.0]), ("protocol", 3, [9.0, 9.1, 9.1, 9.1, 9.0, 9.1, 9.0, 8.9, 9.0, 9.0])]
SCORES += [(b, i, n, w, s) for b, i, scores in _BOARDS for n, w, s in zip(_NAMES, _OWN, scores, strict=True)]
#: book, iteration, evidenced, audit, viability
DOSSIERS = [("b1", 1, 9, "", 8.0), ("b1", 2, 10, "", 9.5), ("b2", 1, 10, "MAJOR REWRITE", 9.95), ("aquarius", 4, 10, "", 8.6), ("protocol", 3, 10, "MAJOR REWRITE", 6.5)]
#: book, pacing, anchors, casual, quote, plot, emotional, pitch, closeness, anchor
VIABILITY = [("parable", 8.0, 3, 8.0, 5.0, 1.0, 2.0, "yes", "partial", "strong"), ("thriller", 9.5, 4, 9.5, 4.0, 5.0, 4.0, "yes", "yes", ""), ("essay", 6.0, 0, 5.0, 1.0, 0.0, 1.0, "no", "no", "none"), ("saga", 7.0, 2, 7.5, 3.0, 3.0, 3.0, "partial", "yes", "")]
#: book, engagement, originality, theme, vocabulary, rereading, identity, framework
LEGACIES = [("parable", "aspiration", 7.0, 7.5, 5.0, 4.0, 10.0, 0.0), ("dune", "default", 9.5, 9.5, 10.0, 9.0, 7.0, 0.0), ("habits", "prescriptive", 7.0, 7.0, 7.0, 4.0, 5.0, 10.0), ("epic", "default", 8.0, 8.5, 8.0, 8.0, 8.0, 0.0)]
PANELS = [("b1", 9.4), ("b2", 8.0), ("b3", 7.5)]
GATES = [("b1", "proof", 7.9), ("b1", "score", 8.5), ("b2", "proof", 8.8)]
FLAGS = [("dash", 1, "critic"), ("dash", 2, "casual"), ("dash", 3, "hostile"), ("dash", 3, "devourer"), ("echo", 1, "casual"), ("echo", 1, "devoted"), ("pace", 2, "critic"), ("pace", 4, "critic"), ("lore", 1, "devoted"), ("voice", 1, "critic"), ("voice", 1, "hostile"), ("end", 9, "critic"), ("end", 9, "hostile"), ("end", 9, "casual")]
#: book, chapter, genre, lowest, casual
EVALUATIONS = [("b1", 1, "literary", 8.6, 8.5), ("b1", 2, "literary", 8.6, 8.4), ("b1", 3, "literary", 7.5, 9.0), ("b1", 4, "literary", 7.4, 9.0), ("b2", 1, "thriller", 7.0, 5.0), ("b2", 2, "thriller", 6.9, 9.0), ("b3", 1, "verse", 9.0, 9.0)]
#: book, chapter, genre, lowest, patterns, extensions, dashes, casual
MEASURES = [("b1", 1, "literary", 7.5, 3, 3, 3, "keep reading"), ("b1", 2, "literary", 7.4, 4, 4, 4, "put down"), ("b2", 1, "thriller", 7.2, 8, 6, 9, "keep reading"), ("b3", 1, "first_draft", 6.5, 15, 10, 20, "keep reading")]
#: book, genre, chapter, pattern, instances, words
PATTERNS = [("b1", "literary", 1, 11, 1, 4000), ("b1", "literary", 1, 3, 2, 2000), ("b1", "literary", 1, 4, 9, 2000), ("b1", "literary", 2, 4, 0, 2000), ("b2", "prescriptive", 1, 11, 5, 2000), ("b2", "prescriptive", 1, 2, 5, 2000)]
SCANS = [("b1", "literary", 0, True), ("b2", "literary", 4, False), ("b3", "commercial", 0, True), ("b4", "commercial", 12, False), ("b5", "prescriptive", 12, True), ("b6", "memoir", 5, False), ("b7", "prescriptive", 0, False)]
#: book, chapter, genre, extensions, words, prose
PROSES = [("b1", 1, "literary", 3, 9000, 8.8), ("b1", 2, "literary", 2, 2000, 8.8), ("b1", 3, "literary", 4, 9000, 7.0), ("b2", 1, "commercial", 6, 8000, 8.1), ("b3", 1, "prescriptive", 9, 20000, 8.2)]
SUPPLEMENTS = [("b1", "H1", 2), ("b1", "H2", 0), ("b2", "H1", 1), ("b2", "H3", 1), ("b2", "H3", 4), ("b3", "H1", 1), ("b3", "H2", 1), ("b3", "H4", 1), ("b3", "H7", 1)]
#: book, chapter, level, mood
TENSIONS = [("b1", i + 1, v, m) for i, (v, m) in enumerate([(3, 1), (3, 1), (3, -1), (4, 1), (2, -1), (4, 1), (5, -1), (5, 1), (4, -1), (2, 1)])] + [("b2", 1, 2, 1), ("b2", 2, 2, 1), ("b2", 3, 1, 1)]
KNOWN = [("Mary", "eyes", "grey"), ("Mary", "age", "19"), ("Mary", "hair", "dark"), ("John", "eyes", "blue"), ("John", "scar", "left")]
FRESH = [("Mary", "eyes", "grey"), ("Mary", "age", "20"), ("Mary", "hair", "fair"), ("Anna", "eyes", "green"), ("John", "scar", "right")]
#: Values that the text still holds.
ALIVE = [("Mary", "age", "20"), ("Mary", "hair", "dark"), ("Mary", "hair", "fair"), ("John", "scar", "left")]
PATCHES = [("Mary", "eyes", "keep_original", None), ("Mary", "age", "update", "20"), ("Mary", "fire", "add", "knows"), ("John", "eyes", "add", "green"), ("Anna", "eyes", "create", "green"), ("Paul", "age", "update", "30"), ("John", "scar", "erase", None)]
MOVES = [("Mary", 1, "town", False), ("Mary", 2, "sea", True), ("Mary", 3, "hill", False), ("John", 1, "sea", False), ("John", 3, None, False), ("John", 5, "town", None)]
SETUPS = [("gun", 1, True), ("key", 2, True), ("map", 3, False)]
PAYOFFS = [("gun", 9), ("key", 1)]
#: entity, ord, speaks
MENTIONS = [("Mary", 1, True), ("Mary", 4, True), ("Paul", 2, False), ("Paul", 3, False), ("Guard", 2, True), ("Dog", 3, False), ("John", 2, True)]
TRACKED = [(1,), (2,), (3,)]
ORDERED = [("b1", i) for i in range(1, 8)] + [("b2", 1), ("b2", 2)]
REVISED = [("b1", 1), ("b1", 5), ("b2", 2)]
IDEAS = [("sea", 8.5, 9.0, 8.2, 9.1, 8.4, 8.8), ("hill", 9.5, 7.0, 9.0, 9.9, 9.5, 9.0), ("town", 8.1, 8.3, 8.9, 8.2, 8.0, 9.0)]
#: book, genre, chapter, hook, pull
HOOKS = [("b1", "thriller", 1, 8, 9), ("b1", "thriller", 2, 9, 9), ("b1", "thriller", 3, 7, 8), ("b2", "literary", 1, 7, 6), ("b2", "literary", 2, 6, 5), ("b2", "literary", 3, 7, 6)]
TARGETS = [("m1", "chapter-01.md", 40), ("m1", "chapter-02.md", 90), ("m2", "chapter-01.md", 20)]
BOOKS = [("b1", "thriller", 90000, 6.5, 800), ("b2", "literary", 70000, 8.0, 900), ("b3", "memoir", 61000, 7.0, 500)]
TURNS = [("b1", 1, 22000), ("b1", 2, 46000), ("b1", 3, 68000), ("b2", 1, 30000)]
SAMPLES = [("b1", "voice-breaking")] * 3 + [("b1", "plain")] * 6 + [("b1", "irrelevant-thought")] * 2 + [("b2", "plain")] * 2

WATCHED, DISCOVERED = [(p,) for p in WATCH_PHRASES], [("In Silence",), ("the cold stone",), ("moment",), ("My Own",), ("thought",)]
#: Tags in every order, and names that are more than plain letters.
TAGS = [
    ("m4", "chapter-01.md", 1, "“We go now,” said Mary. “The house is mine.”\n\n\"I see,\" John said. \"So be it.\"\n\nMary said, “Leave it.”\n\nJohn asked: \"Why?\""),
    ("m4", "chapter-02.md", 2, "“Not yet,” McKay said.\n\n“Soon,” said O’Brien.\n\n\"Never,\" Jean-Luc murmured, \"never again.\"\n\n“Perhaps,” whispered Zoë.\n\n“Hm.” The rain fell.\n\n“A” said Paul.\n\n“Yes!”... protested Anna."),
]
_DISTINCT = "“Where did you leave the keys that I gave you, and why?” asked Mary.\n\n“No,” said John.\n\n"
_SAME = "“Fine then.” said Mary.\n\n“Fine now.” said John.\n\n"
#: Voices that differ early and no longer late, a pair that always collides, and one that leaves.
VOICES = [("m5", f"chapter-{i:02}.md", i, "# Chapter\n\n" + (_DISTINCT if i < 4 else _SAME) * 3 + ("“I stay here tonight.” said Devon.\n\n" * 5 if i < 3 else "")) for i in range(1, 8)]
VOICES += [("m6", f"chapter-{i:02}.md", i, "\"I will go now.\" said Mary.\n\n\"I will go now.\" said John.\n\n" * 4) for i in range(1, 3)]

GATE_TOKENS = [("g1", "lint"), ("g1", "macro"), ("g2", "lint"), ("g2", "proof"), ("g3", "bogus"), ("g4", "lint"), ("g4", "dynamic_range:0.01"), ("g4", "wordcount"), ("g5", "epub"), ("g6", "proof"), ("g6", "lint")]
OUTCOMES = [("g1", "lint", "pass"), ("g1", "macro", "fail"), ("g2", "lint", "fail"), ("g2", "proof", "pass"), ("g3", "bogus", "pass"), ("g4", "lint", "fail"), ("g4", "dynamic_range", "error"), ("g4", "wordcount", "pass"), ("g6", "proof", "fail"), ("g6", "lint", "pass")]
PENDING, LANGUAGES = [("g6", "outline.md"), ("g6", "BOOK.md")], [("g4", "pt-BR"), ("g1", "en-GB")]
#: book, name, raw
EVALUATION_REPORTS = [(b, f"eval-chapter-{i}.md", f"# Report\n**Overall Floor:** {v} | **Overall Average:** 9.1\n") for b, vs in (("flat", [8.5] * 6), ("lively", [8.5, 9.2, 8.6, 9.4, 8.5, 9.0]), ("short", [8.5, 8.5])) for i, v in enumerate(vs, 1)]
EVALUATION_REPORTS += [("short", "eval-chapter-3.md", "no headline"), ("short", "notes.md", "**Floor:** 7.0")]
#: project, seq, event_type, note, expected_phase, approved
EVENTS = [
    ("p1", 1, "chapter-draft", "one", "draft", False), ("p1", 2, "phase-advance", "go", "draft", False), ("p1", 3, "phase-advance", "go", "draft", True), ("p1", 4, "chapter-draft", "late", "draft", False), ("p1", 5, "decision", " ", "review", False),
    ("p1", 6, "chapter-draft", "x", "review", False), ("p1", 7, "unheard-of", "x", "review", False), ("p1", 8, "human-pass", "read", "", True), ("p1", 9, "phase-advance", "again", "draft", True), ("p1", 10, "adoption", "old text", "review", None),
    ("p2", 1, "config-update", "first", "plan", False), ("p2", 2, "evaluation-update", "scores", "", False), ("p2", 3, "entity-update", "who", "", False),
]
#: project, seq, path, val
SETS = [("p1", 1, "chapters.completed", "1"), ("p1", 3, "phase.current", "review"), ("p1", 4, "chapters.completed", "2"), ("p1", 6, "secrets.key", "x"), ("p1", 8, "human_pass.status", "done"), ("p1", 9, "phase.current", "publish"), ("p1", 10, "project.title", "Old"), ("p1", 10, "chapters.completed", "9"), ("p2", 1, "runtime.model", "m"), ("p2", 2, "quality_gate.passed", "3"), ("p2", 3, "chapters.completed", "4")]
PROJECTS = [("p1", "draft"), ("p2", "")]
STATE_LINES = [("p1", "phase.current", "draft", 2), ("p1", "title", "The Jar", 1), ("p1", "book.title", "Other", 9), ("p1", "chapters.completed", "7", 12), ("p1", "chapters.meta.completed", "6", 14)]
WANTED_KEYS = [("p1", "title"), ("p1", "book.title"), ("p1", "completed"), ("p1", "chapters.meta.completed"), ("p1", "current"), ("p1", "nothing")]
OVERRIDES = [("em_dash_per_1k", "3.5"), ("adverb_per_1k", "many"), ("colour", "red"), ("min_chapter_words", "150"), ("echo_window_words", "4.5")]
#: profile, key, rate
MEASURED = [("", "em_dash_per_1k", 2.0), ("", "adverb_per_1k", 50.0), ("", "filter_word_per_1k", 4.0), ("", "not_x_but_y_per_10k", 1.0), *(("commercial", k, 50.0) for k in ("em_dash_per_1k", "adverb_per_1k", "filter_word_per_1k", "not_x_but_y_per_10k"))]
EXPECTED, LISTED = [("BOOK.md",), ("OUTLINE.md",), ("chapter-01.md",), ("STYLE.md",), ("PLAN.md",)], [("BOOK.md", "title"), ("OUTLINE.md", "*(fill in the outline)*"), ("STYLE.md", " "), ("PLAN.md", "<!-- TEMPLATE -->")]
MANIFEST = [("b1", "c1", "chapter-01.xhtml"), ("b1", "c2", "chapter-02.xhtml"), ("b2", "c1", "a.xhtml")]
SPINE, ARCHIVE = [("b1", "c1"), ("b1", "c3"), ("b2", "c1")], [("b1", "chapter-01.xhtml"), ("b2", "a.xhtml"), ("b2", "style.css")]
PHASES = [("plan", "draft"), ("draft", "review"), ("review", "publish"), ("publish", None)]
GATED = [("p1", "draft", True, False), ("p2", "draft", False, False), ("p3", "publish", True, False), ("p4", "plan", False, True)]
WANTED_AGENTS = [("book_writer",), ("Book Writer",), ("Story Bible",), ("nobody",)]
AGENTS = [(1, "book_writer", "Writer", "Claude Opus"), (2, "editor", "Story Bible", "gpt-5"), (3, "critic", "Book  Writer", "Gemini"), (4, "reader", "Reader", "kimi-k2")]
FLAWED = [("m7", "chapter-01.md", 1, "# One\n\nShe she went home and  sat down.\n\nIt was was\nwas late, don’t don’t."), ("m7", "chapter-02.md", 2, "The cafÃ© was shut\x02 tight.\nNothing more. And  so  on."), ("m7", "chapter-03.md", 3, "Clean.")]
