"""All registered queries."""

from orbitframe.plans import (
    behaviour_queries, catalog_queries, conjunction_queries, dossier_queries, orbit_queries,
    proximity_queries, source_queries, text_queries, watch_queries)
from orbitframe.plans.query import Query


def registry() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for module in (behaviour_queries, catalog_queries, conjunction_queries, dossier_queries,
                   orbit_queries, proximity_queries, source_queries, text_queries, watch_queries):
        repeated = found.keys() & module.QUERIES.keys()
        if repeated:
            raise ValueError(f"registered twice: {sorted(repeated)}")
        found.update(module.QUERIES)
    return found
