"""State events of long logs and of streams against a plain loop."""

import json
import random

from folioscope.functions import lexicons as lx
from folioscope.operators import relations
from folioscope.streaming import state

PHASES = ["plan", "draft", "review", "publish"]


def log(seed, project, many):
    dice = random.Random(seed)
    types = ["phase-advance"] * 3 + ["chapter-draft", "decision", "human-pass", "unknown"]
    events, sets = [], []
    for i in range(many):
        kind = dice.choice(types)
        events.append((project, i * 3 + 1, kind, dice.choice(["n", "n", "n", " ", None]), dice.choice([*PHASES, "", None, "elsewhere"]), dice.choice([True, True, False, None])))
        if kind == "phase-advance":
            sets.append((project, i * 3 + 1, "phase.current", dice.choice(PHASES)))
        elif dice.random() < 0.5:
            sets.append((project, i * 3 + 1, dice.choice(["chapters.completed", "decisions", "secrets.key", "human_pass.status"]), str(i)))
    return events, sets


def loop(events, sets, start):
    phase, out = dict(start), set()
    for project, seq, kind, note, expected, approved in sorted(events, key=lambda e: (e[0], e[1])):
        mine = [(p, v) for q, s, p, v in sets if (q, s) == (project, seq)]
        now = phase.get(project) or ""
        if not (note or "").strip() or kind not in lx.EVENT_BLOCKS:
            code = "schema-validation"
        elif any(p.split(".")[0] not in lx.EVENT_BLOCKS[kind] for p, _ in mine):
            code = "allowlist-violation"
        elif kind in lx.APPROVED_EVENTS and not approved:
            code = "human-gate-required"
        elif expected and now and expected != now:
            code = "stale-phase"
        else:
            code = "ok"
            phase[project] = next((v for p, v in mine if p == "phase.current"), now)
        out.add((project, seq, code, phase.get(project) or ""))
    return out


EVENTS, SETS = "project string, seq long, event_type string, note string, expected_phase string, approved boolean", "project string, seq long, path string, val string"


def test_ten_thousand_events_of_one_project(spark):
    events, sets = log(1, "long", 10_000)
    for name, many in (("short", 3), ("late", 700)):
        e, s = log(len(name), name, many)
        events, sets = events + e, sets + s
    by_event = {}
    for row in sets:
        by_event.setdefault(row[:2], []).append(row)
    start = [("long", "plan"), ("short", None), ("late", ""), ("idle", "draft")]
    found = relations.run("state_events", state_events=spark.createDataFrame(events, EVENTS), state_sets=spark.createDataFrame(sets, SETS), projects=spark.createDataFrame(start, "project string, phase string"))
    rows = [tuple(r) for r in found.select("project", "seq", "code", "phase_after").collect()]
    wanted = set()
    for project in ("long", "short", "late"):
        mine = [e for e in events if e[0] == project]
        phase = dict(start).get(project)
        for at in range(0, len(mine), 500):  # the loop looks sets up by scanning, so in small parts
            part = mine[at : at + 500]
            done = loop(part, [r for e in part for r in by_event.get(e[:2], [])], {project: phase})
            wanted |= done
            phase = max(done, key=lambda r: r[1])[3]
    assert set(rows) == wanted and len(rows) == len(events)
    assert {c for _, _, c, _ in rows} == {"ok", "stale-phase", "schema-validation", "allowlist-violation", "human-gate-required"}


def test_stream_keeps_phases_between_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = tmp_path / "in"
    folder.mkdir()
    start = [("a", "plan"), ("b", None)]
    events, sets = [], []
    for name in ("a", "b", "c"):
        e, s = log(ord(name), name, 40)
        events, sets = events + e, sets + s
    try:
        for batch in range(3):
            with open(folder / f"{batch}.json", "w") as file:
                for project, seq, kind, note, expected, approved in events:
                    if (seq - 1) // 3 % 40 // 14 == batch:
                        mine = [{"path": p, "val": v} for q, s, p, v in sets if (q, s) == (project, seq)]
                        file.write(json.dumps({"project": project, "seq": seq, "event_type": kind, "note": note, "expected_phase": expected, "approved": approved, "sets": mine or None}) + "\n")
            stream = spark.readStream.schema(state.EVENT).json(str(folder))
            query = state.event_stream(stream, str(tmp_path / "out"), str(tmp_path / "check"), spark.createDataFrame(start, "project string, phase string"))
            query.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    rows = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("project", "seq", "code", "phase_after").collect()]
    assert set(rows) == loop(events, sets, start) and len(rows) == len(events)
