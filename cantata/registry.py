"""Every query of the library by name, with its DuckDB equivalent."""

from __future__ import annotations

from cantata.plans import albums, catalogue, listening, matching, mixing, ordering, ranking, resolution, signals, upkeep

_PARTS = [catalogue.registry, listening.registry, ranking.registry, ordering.registry, albums.registry, resolution.registry, mixing.registry, upkeep.registry, matching.registry, signals.registry]

QUERIES: dict = {name: f for part in _PARTS for name, f in part.queries.items()}
ORACLES: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.oracles.items()}
