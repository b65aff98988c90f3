"""Registry of the engine's queries: name -> callable, and name -> oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .session import ship
from .sources.tables import table, with_views

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
_COVERS: dict[str, str] = {}


class Tables:
    """t("name") reads a table or domain view of one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def query(covers: str, oracle: str | None = None):
    """Register f(t: Tables) under its own name, with the operators it covers and the SQL that gives the same rows."""

    def register(f):
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(ship(spark), sf_dir))
        _COVERS[f.__name__] = covers
        if oracle is not None:
            _ORACLES[f.__name__] = with_views(oracle)
        return f

    return register


def _load() -> None:
    from .plans import folds, connectors, evidence, ingest, layout, listing, matching, pages, payloads, profiles, relations, scoring, skills, sources, texts, timelines, tracker  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def covers() -> dict[str, str]:
    _load()
    return dict(_COVERS)
