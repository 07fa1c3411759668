"""Queries by name, each with its SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import fixtures, vocabulary

Query = Callable[[fixtures.Corpus], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Common table expressions that SQL may use, in order.
SHARED = {
    "segments": fixtures.segments_sql(),
    "segments_long": fixtures.LONG_SQL,
    "emotions": fixtures.emotions_sql(),
    "emotions_long": fixtures.emotions_sql("segments_long").replace("emotions as", "emotions_long as", 1),
    "frames": fixtures.FRAMES_SQL,
    "vocab": f"vocab as ({vocabulary.pack_sql()}), grams as ({vocabulary.grams_sql()})",
}


def query(name: str, sql: str | None = None, uses: str = "") -> Callable[[Query], Query]:
    """Registers a query; ``uses`` names the shared expressions that precede its SQL, which may go on with its own."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            body, head = sql.strip(), "with "
            shared = ", ".join(SHARED[x] for x in uses.split())
            if body[:15].lower() == "with recursive ":
                body, head = "with " + body[15:], "with recursive "
            if body[:5].lower() == "with ":
                body = (f", {body[5:]}" if shared else head + body[5:])
            SQL[name] = (f"{head}{shared} " if shared else "") + body
        return f

    return register


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query as a callable of session and folder."""
    return {name: lambda spark, sf_dir, f=f: f(fixtures.Corpus(spark, sf_dir)) for name, f in QUERIES.items()}
