"""All registered queries of the choice operators, with their SQL."""

from wayfare.plans import choice_queries, component_queries, composite_queries, draw_queries, guard_queries, mode_queries, table_queries

_PARTS = (choice_queries, table_queries, component_queries, composite_queries, draw_queries, mode_queries, guard_queries)
QUERIES: dict = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
