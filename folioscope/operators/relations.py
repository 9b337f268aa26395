"""Any plan over the caller's own relations in place of its inline rows or the driver's tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from folioscope.functions.dialect import Dialect
from folioscope.operators.lint import over_frames
from folioscope.plans import catalogue, registry


def asked(name: str) -> dict[str, str]:
    """The relations that a plan can be given, with their columns; driver's tables are named without columns."""
    d = Dialect(True)
    sql = catalogue.BUILDERS[name](d)
    return d.asked | {t: "" for t in registry.TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", sql)}


def run(name: str, **frames: DataFrame) -> DataFrame:
    """The plan ``name`` over ``frames``, by the names that :func:`asked` gives; what is not given keeps its inline rows.

    Relations need the columns that :func:`asked` tells, others are ignored.  A name that the plan does not know
    raises a KeyError, as a mistyped one would leave the inline rows in place.
    """
    known = asked(name)
    if wrong := sorted(set(frames) - set(known)):
        raise KeyError(f"{name} knows no relation {', '.join(wrong)}; it takes {', '.join(known)}")
    if missing := [t for t, columns in known.items() if not columns and t not in frames]:
        raise KeyError(f"{name} reads {', '.join(missing)}; give them")
    sql = catalogue.BUILDERS[name](Dialect(True, {n: f"{n}_to_check" for n in frames}))
    for t in (t for t, columns in known.items() if not columns):
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {t}_to_check", sql)
    return over_frames(sql, **frames)
