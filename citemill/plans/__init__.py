"""Queries of the library, by section of the inventory."""

from citemill.plans import analytics_queries, join_queries, merge_queries, metric_queries, scoring_queries, search_queries, source_queries, text_queries, view_queries  # noqa: F401
