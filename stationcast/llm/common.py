"""What the operators share on the Spark side: written intermediates, bounded filters of keys, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationcast.session import materialize, remove, scratch_path

__all__ = ["KeyFilter", "components", "digest_bucket", "drop_table", "key_filter", "materialize", "may_contain",
           "null_table", "sample_ids", "scratch_path", "table"]

#: Bits of one row that bitmap_construct_agg makes.
_ROW_BITS = 32768
MOST_FILTER_BITS = 1 << 27


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def null_table(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


class KeyFilter:
    """A bounded set filter: never misses a member, may let others pass. One hashed bit per key."""

    def __init__(self, bits: int, packed: bytes):
        self.mask = np.uint64(bits - 1)
        self.packed = np.frombuffer(packed, dtype=np.uint8)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = _spread(keys.astype(np.int64, copy=False).view(np.uint64)) & self.mask
        return (self.packed[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 != 0


def _spread(h: np.ndarray) -> np.ndarray:
    return h ^ (h >> np.uint64(27))


def key_filter(keys: DataFrame, count: int) -> KeyFilter:
    """The filter of a one-column table of longs with about ``count`` rows: 16 bits a key up to 2^27 bits (16 MB).

    Beyond 2^27 bits more other keys pass, which costs time and changes no result. Nulls are no members.
    """
    bits = min(MOST_FILTER_BITS, max(_ROW_BITS, 1 << (16 * max(count, 1) - 1).bit_length()))
    key = F.col(keys.columns[0])
    at = key.bitwiseXOR(F.shiftrightunsigned(key, 27)).bitwiseAND(F.lit(bits - 1))
    rows = (keys.where(key.isNotNull()).select(at.alias("at"))
            .groupBy(F.floor(F.col("at") / _ROW_BITS).cast("int").alias("row"))
            .agg(F.expr(f"bitmap_construct_agg(at % {_ROW_BITS})").alias("bitmap")).collect())
    packed = np.zeros(bits // 8, dtype=np.uint8)
    for r in rows:
        packed[r["row"] * _ROW_BITS // 8:][:len(r["bitmap"])] = np.frombuffer(bytes(r["bitmap"]), dtype=np.uint8)
    return KeyFilter(bits, packed.tobytes())


def may_contain(spark: SparkSession, keys: KeyFilter, column: str):
    """A boolean column: may this long be a member? Only the key travels to Python."""
    shared = spark.sparkContext.broadcast(keys)

    @F.pandas_udf("boolean")
    def test(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            known = s.notna().to_numpy()
            yield pd.Series(known & shared.value(s.fillna(0).astype("int64").to_numpy()))
    return test(F.col(column))


def drop_table(spark: SparkSession, path: str) -> None:
    remove(spark, path)


def digest_bucket(column: str, n: int):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def sample_ids(labels: DataFrame, held_out, most: int, seed: int) -> DataFrame:
    """At most ``most`` labelled rows that are not held out, by the order of a hash of their id.

    ``labels`` has doc_id and label; rows without either are left out. The sample is a fixed number of rows, so it
    can be broadcast.
    """
    order = F.xxhash64(F.col("doc_id"), F.lit(seed))
    return (labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out)
            .withColumn("order", order).orderBy("order", "label").limit(most).drop("order"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph, as (node, root): the smallest node that is reachable.

    ``edges`` has long columns a and b; nodes without an edge to another node are not listed. Large-star and
    small-star rounds (each joins the edges with the smallest neighbour of each node) run until the edges are stars:
    every node has one smaller neighbour or is one, about log(nodes) rounds. Every round is written to the shared folder, so lost executors cost one round.
    """
    spark = edges.sparkSession
    now = (edges.where("a <> b and a is not null and b is not null")
           .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    path = scratch_path(spark, "star")
    now = materialize(now, path)
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select(
            F.col("a").alias("u"), F.least("a", "least").alias("m"))
        large = (both.join(least, both["a"] == least["u"]).where("b > a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b"))
        # After a large star every edge leads down: small star joins each node's lower neighbours to the smallest.
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = (large.join(low, large["a"] == low["u"])
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
                 .union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        after = scratch_path(spark, "star")
        small = materialize(small, after)
        # Edges lead down, so a node with two of them, or one that leads on from a root, shows that this is no star yet.
        left = (small.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("root"))
                .union(small.select("b", F.lit(0), F.lit(1))).groupBy("node")
                .agg(F.sum("down").alias("down"), F.max("root").alias("root")).where("down + root > 1"))
        done = left.agg(F.count("*")).first()[0] == 0
        drop_table(spark, path)
        now, path = small, after
        if done:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

