"""All registered queries of the library itself."""

from . import activity_queries, answer_queries, coverage_queries, ingest_queries, listing_queries, ranking_queries, raw_table_queries, retrieval_queries, scope_queries, table_queries

_PARTS = (activity_queries, retrieval_queries, ranking_queries, ingest_queries, answer_queries, coverage_queries, listing_queries, table_queries, raw_table_queries, scope_queries)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
FLAGSHIP = "i15_search"
