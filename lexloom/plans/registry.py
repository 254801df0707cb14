"""All queries of the library by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "p1_quality_score"

PAIRS_SQL = """p AS (SELECT a.conv_id AS issue, a.turn AS turn, a.conv_id * 1000 + a.turn AS pair_id, a.text AS mk, b.text AS sq
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


def query(sql: str | None = None, pairs: bool = False):
    """Register a function (spark, sf_dir) under its name. With pairs=True the SQL gets the table p of aligned pairs."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = (f"WITH {PAIRS_SQL} {sql}" if not sql.lstrip().startswith(",") else f"WITH {PAIRS_SQL}{sql}") if pairs else sql
        return f

    return add


from lexloom.plans import audit, chronology, corpus, evaluation, tables  # noqa: E402,F401  (they register their queries)
