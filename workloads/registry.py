"""The query registry and the comparison rules shared by all queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationcast.session import use_utc
from workloads.tables import Tables

Run = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    run: Run
    sql: str | None


REGISTRY: dict[str, Query] = {}


def publish(df: DataFrame) -> DataFrame:
    """Doubles to four places (shifted off exact ties), times without zone, whole numbers as bigint."""
    columns = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c + F.lit(1e-9), 4)
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, T.IntegralType):
            c = c.cast("bigint")
        columns.append(c.alias(f.name))
    return df.select(columns)


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Run]:
    def register(build: Callable[[Tables], DataFrame]) -> Run:
        @wraps(build)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return publish(build(Tables(use_utc(spark), sf_dir)))
        assert name not in REGISTRY, name
        REGISTRY[name] = Query(run, sql)
        return run
    return register
