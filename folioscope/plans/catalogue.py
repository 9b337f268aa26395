"""All registered queries of the engine and their DuckDB counterparts."""

from __future__ import annotations

from folioscope.plans import audits, cast, checks, contain, library, lint, packs, phrases, places, prose, scoring, voices  # noqa: F401  (each registers its plans)
from folioscope.plans.registry import BUILDERS, COVERS, ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "fingerprint_delta"
