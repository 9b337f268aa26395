"""Places inside groups of any size, without a window that orders a whole group in one task."""

from __future__ import annotations

from folioscope.functions.dialect import Dialect

#: Rows that are ranked together, where a group's order is spread evenly.
PART_ROWS = 2000


def ranked(d: Dialect, rel: str, group: str, order: str, tie: str) -> str:
    """Rows of ``rel`` with ``place`` (1 for the least ``order`` of its group) and ``n`` (rows of the group).

    A group's range of a whole ``order`` is cut into even parts (``stretch``), as many as its size asks for: rows are numbered
    within their stretch and the parts' sizes are summed up, so that no task orders a whole group. A null ``order`` stands first.
    """
    ends = f"(SELECT {group} AS e_of, min({order}) AS lo, max({order}) AS hi, count(*) AS n FROM {rel} e0 GROUP BY {group})"
    parted = f"(SELECT r0.*, e.n, coalesce(CAST(floor((r0.{order} - e.lo) * ceil(e.n / {PART_ROWS}.0) / (e.hi - e.lo + 1)) AS BIGINT), -1) AS stretch FROM {rel} r0 JOIN {ends} e ON e.e_of IS NOT DISTINCT FROM r0.{group})"
    sizes = f"(SELECT {group} AS s_of, stretch AS s_part, count(*) AS k FROM {parted} p0 GROUP BY {group}, stretch)"
    bases = f"(SELECT s_of, s_part, CAST(sum(k) OVER (PARTITION BY s_of ORDER BY s_part ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - k AS base FROM {sizes} s0)"
    return f"(SELECT p.*, b.base + row_number() OVER (PARTITION BY p.{group}, p.stretch ORDER BY p.{order}, p.{tie}) AS place FROM {parted} p JOIN {bases} b ON b.s_of IS NOT DISTINCT FROM p.{group} AND b.s_part = p.stretch)"
