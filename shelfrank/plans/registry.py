"""Named queries over the driver's tables, with the SQL each is compared to."""

from __future__ import annotations

from shelfrank.plans import event_queries, metric_queries, model_queries, profile_queries, split_queries

FLAGSHIP = "segment_popularity_topn"
_PARTS = (profile_queries, split_queries, model_queries, metric_queries, event_queries)
QUERIES: dict = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES: dict = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
