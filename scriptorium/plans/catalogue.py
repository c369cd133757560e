"""All queries of the engine's own operators."""

from __future__ import annotations

from . import changes, extras, files, mining, relational, saving, search

_PARTS = (search.C, relational.C, mining.C, changes.C, saving.C, files.C, extras.C)
QUERIES = {name: f for part in _PARTS for name, f in part.queries.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.oracles.items()} | extras.relational_oracles
