"""Near-duplicate vectors by NN-descent.

Vectors are compared within equal labels (and equal length). Equal vectors are one class with a multiplicity. The
neighbour graph starts from blocks of vectors with like sign codes (several tables of random hyperplanes, sorted, cut
into blocks of ``BLOCK``). Each round joins every list, forward and reverse, with the vectors and compares its members
with one another: neighbours of neighbours. Lists keep the ``K`` best; every pair at or above the threshold is kept as an
edge whatever the list says. Lists of more than ``CHUNK`` members are dealt to chunks, so no group is large.

A list is saturated when all it can hold are edges. Such lists are enlarged to their whole component: neighbours of the
own component take no place among the ``K`` best outside it, which every list holds besides the ``K`` best of all. At
the end, blocks of vectors meet in tiles inside each component and all links are counted exactly. Vectors of different
components are linked only if the search missed that; the audit measures it: ``AUDITED`` vectors of each size class of
components (single vectors are one), chosen by a hash, are compared with all vectors. Rounds, each with new sign-code
tables, go on until in every class at least ``RECALL`` of the vectors with links have all of them inside their component. Where
that does not hold after ``ROUNDS``, all vectors of a label meet in tiles and every missed link between components is found.

Null or zero vectors, vectors with a null or non-finite component and vectors with a null label link with nothing. Rows
that repeat a vec_id are vectors of their own that share a component. A null vec_id has no component and is no link.
Empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stationcast.llm import text as X
from stationcast.llm.common import components, materialize, table

THRESHOLD = 0.93
K = 10
TABLES, BLOCK, CHUNK, TILE = 12, 64, 48, 1024
#: Tables that are shuffled at a time: each sends all vectors.
AT_ONCE = 3
AUDITED, RECALL, ROUNDS = 1000, 0.999, 6
SEED = 11


def _vectors(batch: pa.RecordBatch, column: str = "vec") -> np.ndarray:
    """A list column whose rows have equal lengths as a matrix."""
    v = batch.column(column)
    flat = v.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(v), -1)


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, label, dim, vec): the rows that can link, as unit vectors of doubles."""
    vec = F.transform("embedding", lambda x: x.cast("double"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
                       vec.alias("raw"))
    sound = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("raw").isNotNull()).where(sound)
    # Scaled by the largest component first, so that squares neither overflow nor vanish.
    rows = rows.withColumn("top", F.aggregate("raw", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))).where("top > 0")
    rows = rows.withColumn("vec", F.transform("raw", lambda x: x / F.col("top")))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)))
    return rows.select("vec_id", "label", F.size("raw").alias("dim"),
                       F.transform("vec", lambda x: x / F.col("norm")).alias("vec"))


def _codes(table_no: int, dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, table_no, dim]).normal(size=(dim, 31))


def _coded(vectors: DataFrame, number: int, tables: range = range(TABLES)) -> DataFrame:
    """Each vector once per table of a round, with its sign code there."""
    def run(batches):
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                v = _vectors(part)
                for t in tables:
                    bits = (v @ _codes(number * TABLES + t, int(dim)) > 0) @ (1 << np.arange(30, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id"), part.column("comp"), part.column("label"), part.column("dim"),
                         part.column("vec"), pa.array(np.full(len(v), t, np.int32)), pa.array(bits)],
                        names=["id", "comp", "label", "dim", "vec", "t", "code"])
    return vectors.select("id", "comp", "label", "dim", "vec").mapInArrow(
        run, "id long, comp long, label string, dim int, vec array<double>, t int, code long")


def _compare(ids: np.ndarray, comp: np.ndarray, v: np.ndarray, best: int):
    """Pairs of a small group: each member's best others, its best others of other components, and all pairs of
    different components at the threshold. (id, nbr, sim)."""
    s = v @ v.T
    np.fill_diagonal(s, -2)
    n = len(ids)
    take = min(best, n - 1)
    if take <= 0:
        return None
    other = comp[:, None] != comp[None, :]
    keep = (s >= THRESHOLD) & other
    for sims in (s, np.where(other, s, -2)):
        top = np.argpartition(-sims, take - 1, axis=1)[:, :take]
        keep[np.arange(n)[:, None], top] |= np.take_along_axis(sims, top, axis=1) > -2
    keep &= ids[:, None] != ids[None, :]
    i, j = np.nonzero(keep)
    return ids[i], ids[j], s[i, j]


def _runs(batches, key: str):
    """Streams (ids, components, vectors) per run of equal keys in sorted rows."""
    held = None
    for batch in batches:
        part = (*(np.asarray(batch.column(c)) for c in (key, "id", "comp")), batch.column("vec"))
        if held is not None:
            part = (*(np.concatenate([h, p]) for h, p in zip(held[:3], part[:3])), pa.concat_arrays([held[3], part[3]]))
        keys, ids, comp, vecs = part
        starts = [*X.group_starts(keys), len(keys)]
        for lo, hi in zip(starts[:-2], starts[1:-1]):
            yield ids[lo:hi], comp[lo:hi], vecs.slice(lo, hi - lo)
        at = starts[-2] if len(keys) else 0
        held = (keys[at:], ids[at:], comp[at:], vecs.slice(at))
    if held is not None and len(held[0]):
        yield held[1:]


def _as_matrix(vecs: pa.Array) -> np.ndarray:
    return vecs.flatten().to_numpy(zero_copy_only=False).reshape(len(vecs), -1)


_EDGES = "id long, nbr long, sim double"


def _batch(found: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["id", "nbr", "sim"])


def _compared(groups, best: int):
    found, rows = [], 0
    for ids, comp, vecs in groups:
        pairs = _compare(ids, comp, _as_matrix(vecs), best)
        if pairs is not None:
            found.append(pairs)
            rows += len(pairs[0])
            if rows > 50_000:
                yield _batch(found)
                found, rows = [], 0
    if found:
        yield _batch(found)


def first_graph(vectors: DataFrame, number: int = 0, tables: range = range(TABLES)) -> DataFrame:
    """Neighbours out of blocks of like sign codes, by the tables of a round or some of them."""
    def run(batches):
        def blocks():
            for batch in batches:
                key = np.asarray(batch.column("group"))
                ids, comp, vecs = np.asarray(batch.column("id")), np.asarray(batch.column("comp")), batch.column("vec")
                starts = [*X.group_starts(key), len(key)]
                for lo, hi in zip(starts, starts[1:]):
                    for a in range(lo, hi, BLOCK // 2):
                        b = min(a + BLOCK, hi)
                        yield ids[a:b], comp[a:b], vecs.slice(a, b - a)
                        if b == hi:
                            break
        yield from _compared(blocks(), K)
    coded = _coded(vectors, number, tables).withColumn("group", F.xxhash64("t", "label", "dim"))
    return coded.repartitionByRange("group", "code", "id").sortWithinPartitions("group", "code", "id").select(
        "group", "id", "comp", "vec").mapInArrow(run, _EDGES)


def _best(edges: DataFrame, placed: DataFrame) -> DataFrame:
    """The K best neighbours per vector, and the K best outside its component; ranking is pruned in each task before
    the shuffle."""
    comp = placed.select("id", "comp")
    pairs = (edges.groupBy("id", "nbr").agg(F.max("sim").alias("sim")).join(comp, "id")
             .join(comp.select(F.col("id").alias("nbr"), F.col("comp").alias("there")), "nbr"))
    pairs = materialize(pairs.select("id", "nbr", "sim", (F.col("comp") != F.col("there")).alias("other")))

    def first(rows: DataFrame) -> DataFrame:
        return rows.withColumn("r", F.expr("row_number() over (partition by id order by sim desc, nbr)")).where(
            f"r <= {K}").select("id", "nbr", "sim")
    return first(pairs).union(first(pairs.where("other"))).distinct()


def round_of(graph: DataFrame, vectors: DataFrame, number: int) -> DataFrame:
    """Compares the members of every list, forward and reverse, with one another."""
    lists = graph.select(F.col("id").alias("u"), F.col("nbr").alias("v")).union(
        graph.select(F.col("nbr").alias("u"), F.col("id").alias("v"))).union(
        graph.select(F.col("id").alias("u"), F.col("id").alias("v"))).distinct()
    sizes = lists.groupBy("u").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    key = F.xxhash64("u", F.pmod(F.xxhash64("v", F.lit(number)), F.col("chunks")))
    dealt = (lists.join(sizes, "u").select(key.alias("list"), F.col("v").alias("id"))
             .join(vectors.select("id", "comp", "vec"), "id").repartition("list").sortWithinPartitions("list"))

    def run(batches):
        yield from _compared(_runs(batches, "list"), K)
    return dealt.select("list", "id", "comp", "vec").mapInArrow(run, _EDGES)


def _sound(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("sim") >= THRESHOLD).select(
        F.least("id", "nbr").alias("a"), F.greatest("id", "nbr").alias("b")).distinct()


def audit(placed: DataFrame) -> float:
    """Some vectors of each size class of components, compared with all others: the least share, over the classes, of those
    with links that have all of them inside their component."""
    sizes = placed.groupBy("comp").agg(F.floor(F.log2(F.count("*"))).alias("class"))
    asked = (placed.join(sizes, "comp").withColumn("r", F.row_number().over(
        Window.partitionBy("class").orderBy(F.xxhash64("id", F.lit(SEED)), "id"))).where(F.col("r") <= AUDITED)
        .select("id", "label", "dim", "comp", "vec", "class").collect())
    queries: dict = {}
    for q in asked:
        queries.setdefault((q["label"], q["dim"]), []).append((q["id"], q["comp"], q["vec"]))
    queries = {k: tuple(np.array(c) for c in zip(*v)) for k, v in queries.items()}
    shared = placed.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        for batch in batches:
            key = list(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist()))
            ids, comp = np.asarray(batch.column("id")), np.asarray(batch.column("comp"))
            for k in set(key) & set(shared.value):
                at = np.array([i for i, x in enumerate(key) if x == k])
                v = _as_matrix(batch.column("vec").take(pa.array(at)))
                q, q_comp, q_vec = shared.value[k]
                # A few rows at a time, so that memory does not grow with batches.
                for lo in range(0, len(at), 512):
                    part = at[lo:lo + 512]
                    near = (v[lo:lo + 512] @ q_vec.T >= THRESHOLD) & (ids[part][:, None] != q)
                    out = (near & (comp[part][:, None] != q_comp)).sum(axis=0)
                    links = near.sum(axis=0)
                    hit = links > 0
                    yield pa.RecordBatch.from_arrays([pa.array(q[hit]), pa.array(links[hit]), pa.array(out[hit])],
                                                     names=["id", "links", "out"])
    found = placed.select("id", "label", "dim", "comp", "vec").mapInArrow(run, "id long, links long, out long")
    missed = {r["id"]: r["out"] for r in found.groupBy("id").agg(F.sum("out").alias("out")).collect()}
    shares = []
    for c in {q["class"] for q in asked}:
        linked = [missed[q["id"]] == 0 for q in asked if q["class"] == c and q["id"] in missed]
        shares += [sum(linked) / len(linked)] if linked else []
    return min(shares, default=1.0)


def across(placed: DataFrame) -> DataFrame:
    """Links between components, out of tiles of all vectors with equal labels: one (a, b) per tile and pair of components."""
    sizes = placed.groupBy("label", "dim").agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks"))
    dealt = placed.join(sizes, ["label", "dim"]).withColumn("place", F.pmod(F.xxhash64("id", F.lit(SEED)), F.col("blocks")).cast("int"))
    each = F.sequence(F.lit(0), F.col("blocks") - 1)
    # A vector of block p meets all blocks: in tile (i, j) with i <= j it stands on the left, the right or both.
    rows = dealt.withColumn("k", F.explode(each)).select(
        F.xxhash64("label", "dim", F.least("place", "k"), F.greatest("place", "k")).alias("tile"),
        "id", "comp", (F.col("place") <= F.col("k")).alias("left"), (F.col("place") >= F.col("k")).alias("right"), "vec")

    def run(batches):
        def emit(t, ids, comp, left, right, vecs):
            v = _as_matrix(vecs)
            a, b = np.nonzero(v[left] @ v[right].T >= THRESHOLD)
            x, y, cx, cy = ids[left][a], ids[right][b], comp[left][a], comp[right][b]
            at = np.flatnonzero(cx != cy)
            pairs = np.unique(np.stack([np.minimum(cx, cy)[at], np.maximum(cx, cy)[at]]), axis=1, return_index=True)[1]
            return pa.RecordBatch.from_arrays([pa.array(x[at][pairs]), pa.array(y[at][pairs])], names=["a", "b"])
        names = ("tile", "id", "comp", "left", "right")
        held = None
        for batch in batches:
            part = [*(batch.column(c).to_numpy(zero_copy_only=False) for c in names), batch.column("vec")]
            if held is not None:
                part = [*(np.concatenate(x) for x in zip(held[:-1], part[:-1])), pa.concat_arrays([held[-1], part[-1]])]
            starts = [*X.group_starts(part[0]), len(part[0])]
            cut = [[*(c[lo:hi] for c in part[:-1]), part[-1].slice(lo, hi - lo)] for lo, hi in zip(starts, starts[1:])]
            for x in cut[:-1]:
                yield emit(*x)
            held = cut[-1] if cut else held
        if held is not None:
            yield emit(*held)
    return rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "a long, b long").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _inside(vectors: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, links): other rows linked with each vector of a component, counted over all tiles of the component."""
    members = vectors.join(roots.withColumnRenamed("node", "id"), "id")
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks"))
    members = members.join(sizes, "root").withColumn("place", F.pmod(F.xxhash64("id"), F.col("blocks")))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = members.select("root", "id", "copies", "vec", F.lit(1).alias("side"), F.col("place").alias("i"), every.alias("j")).union(
        members.select("root", "id", "copies", "vec", F.lit(2).alias("side"), every.alias("i"), F.col("place").alias("j")))
    tiles = rows.withColumn("tile", F.xxhash64("root", F.col("i").cast("long"), F.col("j").cast("long")))

    def run(batches):
        def emit(part):
            left = part["side"] == 1
            v = _as_matrix(part["vec"])
            near = v[left] @ v[~left].T >= THRESHOLD
            near &= part["id"][left][:, None] != part["id"][~left][None, :]
            return pa.RecordBatch.from_arrays(
                [pa.array(part["id"][left]), pa.array(near @ part["copies"][~left])], names=["id", "links"])
        names = ("tile", "id", "copies", "side")
        held = None
        for batch in batches:
            part = {c: np.asarray(batch.column(c)) for c in names} | {"vec": batch.column("vec")}
            if held is not None:
                part = {c: np.concatenate([held[c], part[c]]) for c in names} | {
                    "vec": pa.concat_arrays([held["vec"], part["vec"]])}
            starts = [*X.group_starts(part["tile"]), len(part["tile"])]
            cut = [({c: part[c][lo:hi] for c in names} | {"vec": part["vec"].slice(lo, hi - lo)})
                   for lo, hi in zip(starts, starts[1:])]
            for x in cut[:-1]:
                yield emit(x)
            held = cut[-1] if cut else held
        if held is not None:
            yield emit(held)
    return (tiles.repartition("tile").sortWithinPartitions("tile").select("tile", "id", "copies", "side", "vec")
            .mapInArrow(run, "id long, links long").groupBy("id").agg(F.sum("links").alias("links")))


def near_duplicates(rows: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of (vec_id, embedding, label)."""
    good = materialize(usable(rows))
    classes = good.groupBy("label", "dim", "vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    # Two classes with one id (rows that repeat a vec_id) stay apart by their own number.
    vectors = materialize(classes.withColumn("rep", F.col("id")).withColumn(
        "id", F.xxhash64("label", "dim", F.transform("vec", lambda x: x.cast("string")))))
    def place(roots: DataFrame) -> DataFrame:
        return materialize(vectors.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn(
            "comp", F.coalesce("root", "id")).drop("root"))
    placed = vectors.withColumn("comp", F.col("id"))
    graph, links, whole = None, None, False
    for number in range(ROUNDS):
        # Few tables at a time: all of them at once hold every vector TABLES times in the executors' sorts.
        parts = [materialize(first_graph(placed, number, range(t, min(t + AT_ONCE, TABLES)))) for t in range(0, TABLES, AT_ONCE)]
        parts += [] if graph is None else [materialize(round_of(graph, placed, number))]
        found = reduce(DataFrame.union, parts)
        links = _sound(found) if links is None else links.union(_sound(found))
        roots = components(links)
        placed = place(roots)
        whole = number > 0 and audit(placed) >= RECALL
        if whole:
            break
        graph = materialize(_best(found if graph is None else graph.union(found), placed))
    if not whole:
        roots = components(links.union(across(placed)))
    inside = _inside(vectors, roots)
    marks = (vectors.select("id", "label", "dim", "vec", "rep", "copies").join(inside, "id", "left")
             .join(roots.withColumnRenamed("node", "id"), "id", "left")
             .withColumn("comp", F.coalesce("root", "id")))
    marks = materialize(marks.select("label", "dim", "vec", "rep", "comp", (
        F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    least = marks.groupBy("comp").agg(F.min("rep").alias("component"))
    per = marks.join(least, "comp").select("label", "dim", "vec", "n_links", "component")
    linked = (good.join(per, ["label", "dim", "vec"]).groupBy("vec_id").agg(
        F.max("n_links").alias("n_links"), F.min("component").alias("component")))
    out = rows.select(F.col("vec_id").cast("long").alias("vec_id")).join(linked, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


OP2_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[64]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
near AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE array_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach AS (SELECT x, x AS y FROM near UNION SELECT reach.x, near.y FROM reach JOIN near ON reach.y = near.x),
roots AS (SELECT x, min(y) AS root FROM reach GROUP BY x),
counts AS (SELECT x, count(*) AS n FROM near GROUP BY x)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(root, vec_id) AS component_id,
  coalesce(root, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN counts ON counts.x = vec_id LEFT JOIN roots ON roots.x = vec_id"""
