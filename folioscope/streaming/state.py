"""State events as they arrive: the phase of each project is kept between batches, codes are those of the batch plan."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from folioscope.functions import lexicons as lx

#: Columns of the events: what they set is a list, as it arrives in one record.
EVENT = "project string, seq long, event_type string, note string, expected_phase string, approved boolean, sets array<struct<path:string,val:string>>"
CODED = "project string, seq long, code string, phase_after string"


def coded(events: DataFrame, blocks: dict[str, list[str]] | None = None, approved: list[str] | None = None) -> DataFrame:
    """Events with the code that their own contents give them and the phase that they set."""
    allowed = F.from_json(F.lit(pd.Series(blocks or lx.EVENT_BLOCKS).to_json()), "map<string,array<string>>")[F.col("event_type")]
    written = F.transform(F.coalesce("sets", F.array().cast("array<struct<path:string,val:string>>")), lambda s: F.regexp_extract(s["path"], "^([^.]*)", 1))
    code = F.when((F.trim(F.coalesce("note", F.lit(""))) == "") | allowed.isNull(), "schema-validation").when(F.exists(written, lambda b: ~F.array_contains(allowed, b)), "allowlist-violation")
    code = code.when(F.col("event_type").isin(approved or lx.APPROVED_EVENTS) & ~F.coalesce("approved", F.lit(False)), "human-gate-required").otherwise("ok")
    phase = F.array_max(F.transform(F.filter("sets", lambda s: s["path"] == "phase.current"), lambda s: s["val"]))
    return events.select("project", "seq", code.alias("code"), F.coalesce("expected_phase", F.lit("")).alias("expected_phase"), phase.alias("next_phase"))


class _Walk(StatefulProcessor):
    """Holds one string a project: its phase."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.phase = handle.getValueState("phase", "phase string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        self.phase.update((initialState["phase"].iloc[0] or "",))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        phase = self.phase.get()[0] if self.phase.exists() else ""
        out = []
        for row in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples(index=False):
            stale = row.code == "ok" and row.expected_phase != "" and phase != "" and row.expected_phase != phase
            if row.code == "ok" and not stale and row.next_phase is not None and not pd.isna(row.next_phase):
                phase = row.next_phase
            out.append((key[0], row.seq, "stale-phase" if stale else row.code, phase))
        self.phase.update((phase,))
        yield pd.DataFrame(out, columns=["project", "seq", "code", "phase_after"])

    def close(self) -> None:
        pass


def event_stream(events: DataFrame, out: str, checkpoint: str, projects: DataFrame | None = None) -> StreamingQuery:
    """Codes of arriving events, written to ``out`` as Parquet; needs the RocksDB state store.

    ``projects`` (project, phase) tells phases at the start; others begin with none, which meets any expectation.  Events of one
    batch are taken by number; an event that arrives in a later batch than its successors meets the phase that these left, as
    a log that is written in order of arrival does.
    """
    start = projects.select("project", F.coalesce("phase", F.lit("")).alias("phase")).groupBy("project") if projects is not None else None
    done = coded(events).groupBy("project").transformWithStateInPandas(_Walk(), CODED, "Append", "None", initialState=start)
    return done.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
