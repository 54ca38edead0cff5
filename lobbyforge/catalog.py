"""The catalogue of queries: an operator's query and the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .sources.boards import BOARDS_SQL, Boards

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *, ctes: str = BOARDS_SQL, stored: bool = False, merged: bool = False):
    """Registers ``f(boards)`` as a query; ``sql`` follows the views' common table expressions.

    SQL that begins with a comma adds expressions of its own.  ``stored``: the query reads
    the pass's tables as they were written.  ``merged``: it is registered once more as
    ``name_merged`` over the groups of the archetype merge, which SQL cannot express.
    """

    def register(f: Callable[[Boards], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Boards(spark, sf_dir, stored=stored))
        if merged:
            QUERIES[f"{name}_merged"] = lambda spark, sf_dir: f(Boards(spark, sf_dir, stored=True, merged=True))
        if sql is not None:
            ORACLES[name] = f"WITH {ctes}\n{sql}"
        return f

    return register
