"""Mixing sources to target weights: whole repeats of every document plus one hash-seeded Bernoulli copy.

The words of all documents are shared among the sources by weight. A source's target stops at ``most`` times its own
size, and what is above is shared again by weight until no target is above its stop; that is min(most * size,
weight * level) with the level at which the targets add up to all words. A source's rate is target / size, and each of
its documents is emitted floor(rate) times and once more with probability rate - floor(rate), decided by a hash of a
seed and doc_id. ``SEEDS`` such draws are added up per source, and each source takes the one that comes nearest to its
target (ties: the first): the words of few or long documents would else miss it by chance. No document is taken more
than ``most`` times, and a rerun or another partitioning gives the same mix.

Sources are ordered by code point, null last (null is a source of its own), and the weights repeat in that order.
A null or empty text has size 0 and is emitted as its source's rate says; a source without words has target 0, rate
0 and is left out. Rows without a doc_id are decided by their text. Equal rows are decided alike. Empty tables give
empty results. Other columns pass through; those named size, source_size, target or copies are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationcast.llm import text as X
from stationcast.llm.common import materialize, table

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = 11
#: Draws a source chooses from.
SEEDS = 16
#: Sources are broadcast while their table is at most this many bytes in memory.
MOST_BROADCAST = 32 << 20
#: Beyond that a source with at least one in so many rows is hot. There are at most so many of them.
HOT = 1000
_NEW = ("size", "source_size", "target", "copies")


def draw(seed: int, which: Column, key: Column) -> Column:
    """A uniform number in [0, 1) that only the seed, the number of the draw and the row's key decide."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}."), which.cast("string"), F.lit(":"), key).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def _key() -> Column:
    text = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), text))


def _rate() -> Column:
    return F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)


def ranked(sources: DataFrame) -> DataFrame:
    """Written sources (source, size, ...) with their rank by code point from 0, null last.

    A range sort numbers the rows of each partition, and the partitions' row counts, one number each, do the rest.
    """
    in_order = sources.orderBy(F.col("source").asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id())
    in_order = materialize(in_order)
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = in_order.groupBy(part.alias("part")).count().orderBy("part").collect()
    before, starts = 0, []
    for r in counts:
        starts += [F.lit(r["part"]), F.lit(before)]
        before += r["count"]
    if not starts:
        return in_order.withColumn("rank", F.lit(0).cast("long")).drop("_at")
    return in_order.withColumn("rank", F.create_map(*starts)[part] + place).drop("_at")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, size, target) of one row per source with its size and number of rows.

    The level rises from the even share: each round stops the sources below it and shares the rest again, one
    aggregate over the sources per round, in whole numbers. Rounds end when no further source stops.
    """
    if not weights or min(weights) <= 0 or most < 1:
        raise ValueError("weights are above 0 and repeats at least 1")
    turn = F.pmod(F.col("rank"), F.lit(len(weights)))
    weighted = materialize(ranked(sources).withColumn("weight", F.array(*map(F.lit, weights))[turn.cast("int")]))
    level, stopped = None, -1
    while True:
        stops = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= F.col("size") * most
        now = weighted.agg(
            F.coalesce(F.sum("size"), F.lit(0)).alias("words"), F.count_if(stops).alias("stopped"),
            F.coalesce(F.sum(F.when(stops, F.col("size"))), F.lit(0)).alias("full"),
            F.coalesce(F.sum(F.when(~stops, F.col("weight"))), F.lit(0)).alias("open")).first()
        if now["stopped"] == stopped or now["open"] == 0:
            break
        stopped = now["stopped"]
        level = (now["words"] - most * now["full"]) / now["open"]
    cap = (F.col("size") * most).cast("double")
    return weighted.withColumn("target", cap if level is None else F.least(cap, F.col("weight") * F.lit(level)))


def _with_targets(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Adds what ``found`` has per source. Few sources are broadcast; of many, only the hot ones."""
    new = [c for c in found.columns if c not in ("source", "n_rows")]
    found = found.select(F.coalesce("source", F.lit("")).alias("_source"), F.col("source").isNull().alias("_none"),
                         "n_rows", F.struct(*new).alias("_found"))
    docs = docs.withColumn("_source", F.coalesce("source", F.lit(""))).withColumn("_none", F.col("source").isNull())
    on, long_ = ["_source", "_none"], F.sum(F.octet_length("_source") + 128).alias("bytes")
    size = found.agg(long_, F.sum("n_rows").alias("n_rows")).first()
    columns = [*(c for c in docs.columns if c not in on), "_found.*"]
    if (size["bytes"] or 0) <= MOST_BROADCAST:
        return docs.join(F.broadcast(found.drop("n_rows")), on).select(*columns)
    hot = F.col("n_rows") * HOT >= F.lit(size["n_rows"])
    few = found.where(hot).drop("n_rows")
    if (few.agg(long_).first()["bytes"] or 0) <= MOST_BROADCAST:
        few = F.broadcast(few)
    marked = docs.join(few, on, "left")
    rest = marked.where("_found is null").drop("_found").join(found.where(~hot).drop("n_rows"), on)
    return marked.where("_found is not null").unionByName(rest).select(*columns)


def _drawn(sizes: DataFrame, found: DataFrame, seed: int) -> DataFrame:
    """``found`` with the number of the draw each source takes; ``sizes`` has (source, size, key)."""
    rows = _with_targets(sizes, found.select("source", "n_rows", F.col("size").alias("source_size"), "target"))
    extra = [F.sum(F.when(draw(seed, F.lit(k), F.col("key")) < _rate() - F.floor(_rate()), F.col("size")).otherwise(0))
             for k in range(SEEDS)]
    # The sums are of whole numbers, so every order of adding gives the same ones.
    sums = rows.groupBy("source", "source_size", "target").agg(
        F.count(F.lit(1)).alias("n_rows"), F.array(*extra).alias("extra"))
    missed = F.transform("extra", lambda e, k: F.struct(
        F.abs(F.floor(_rate()) * F.col("source_size") + e - F.col("target")).alias("by"), k.alias("which")))
    return sums.select("source", "source_size", "target", "n_rows", F.array_min(missed)["which"].alias("which"))


def rated(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """The rows with their size, their source's size and target, and the number of copies the mix takes."""
    docs = docs.drop(*_NEW)
    sized = docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(X.WORD)), F.lit(0)).cast("long"))
    sizes = materialize(sized.select("source", "size", _key().alias("key")))
    # Sizes per source are added up before they are shuffled.
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n_rows"))
    plan = materialize(_drawn(sizes, targets(per_source, weights, most), seed))
    extra = draw(seed, F.col("which"), _key()) < _rate() - F.floor(_rate())
    return _with_targets(sized, plan).withColumn("copies", F.floor(_rate()) + extra.cast("long")).drop("which")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """The mix itself: each document as often as it is taken, numbered by ``copy`` from 1."""
    columns = [c for c in docs.columns if c != "copy"]
    taken = rated(docs.select(*columns), weights, most, seed).where("copies > 0")
    return taken.select(*columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rated(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP11_SQL = f"""
WITH d AS (SELECT doc_id, source, text,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY source),
w AS (SELECT source, size, list_extract([{', '.join(map(str, WEIGHTS))}],
    CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} AS INT) + 1) AS weight FROM s),
stops AS (SELECT *, sum(size) OVER () AS words, sum(weight) OVER () AS all_weights,
    row_number() OVER by_level AS k,
    coalesce(sum(size) OVER (by_level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
    coalesce(sum(weight) OVER (by_level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_before
  FROM w WINDOW by_level AS (ORDER BY CAST({MOST_REPEATS} * size AS DOUBLE) / weight, source NULLS LAST)),
levels AS (SELECT *, CAST(words - {MOST_REPEATS} * full_before AS DOUBLE) / (all_weights - weight_before) AS level FROM stops),
-- The first source in the order of its stop that stays below it fixes the level.
level AS (SELECT level FROM levels WHERE weight * level < {MOST_REPEATS} * size ORDER BY k LIMIT 1),
t AS (SELECT source, size AS source_size, least(CAST({MOST_REPEATS} * size AS DOUBLE),
    coalesce(weight * (SELECT level FROM level), CAST({MOST_REPEATS} * size AS DOUBLE))) AS target FROM w),
r AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    coalesce(CAST(doc_id AS VARCHAR), 'text ' || md5(coalesce(text, ''))) AS key
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
draws AS (SELECT doc_id, size, source, source_size, target, rate, which, rate - floor(rate) >
    CAST('0x' || substr(md5('{SEED}.' || which || ':' || key), 1, 13) AS BIGINT) / 4503599627370496.0 AS extra
  FROM r, range({SEEDS}) AS k(which)),
missed AS (SELECT source, which,
    abs(floor(rate) * source_size + sum(CASE WHEN extra THEN size ELSE 0 END) - target) AS missed_by
  FROM draws GROUP BY source, which, rate, source_size, target),
chosen AS (SELECT source, arg_min(which, (missed_by, which)) AS which FROM missed GROUP BY source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN extra THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM draws JOIN chosen ON draws.source IS NOT DISTINCT FROM chosen.source AND draws.which = chosen.which"""
