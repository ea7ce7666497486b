"""Every query of the retrieval engine by name, with the SQL that checks it."""

from folioquery.plans import answer_queries, ingest_queries, retrieval_queries, store_queries, text_queries

MODULES = (retrieval_queries, text_queries, answer_queries, store_queries, ingest_queries)
QUERIES: dict = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL: dict = {name: sql for module in MODULES for name, sql in module.SQL.items()}
