"""Query catalogue: name -> (Spark builder, optional DuckDB oracle SQL).

Each builder takes ``(spark, sf_dir)`` and returns a DataFrame that reads the
given tables in full. Oracle SQL runs on DuckDB over the same parquet files
(views named after the tables) and must produce the same column names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    name: str
    build: Builder
    oracle: str | None
    group: str


REGISTRY: dict[str, Entry] = {}


def query(name: str, oracle: str | None = None, group: str = ""):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, oracle, group)
        return fn
    return deco


def load_all() -> dict[str, Entry]:
    # Importing the modules registers their queries.
    from pagewise.plans import (  # noqa: F401
        q_admission,
        q_endpoints,
        q_pages,
        q_quality,
        q_rich,
        q_scoring,
        q_streams,
        q_terms,
        q_text,
        q_usage,
    )
    return REGISTRY
