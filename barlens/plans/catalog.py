"""Registry of every query: ``QUERIES[id](spark, sf_dir) -> DataFrame`` and ``ORACLE[id]`` (DuckDB SQL)."""

from __future__ import annotations

from barlens.plans import (
    analytics_oracle, analytics_queries, core_oracle, core_queries, feature_oracle, feature_queries, pipeline_oracle,
    pipeline_queries,
)

QUERIES: dict = {}
ORACLE: dict = {}

for _qmod, _omod in ((core_queries, core_oracle), (feature_queries, feature_oracle),
                     (analytics_queries, analytics_oracle), (pipeline_queries, pipeline_oracle)):
    QUERIES.update(_qmod.QUERIES)
    ORACLE.update(_omod.ORACLE)
