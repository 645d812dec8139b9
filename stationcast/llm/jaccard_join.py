"""N-gram Jaccard join: documents whose sets of word shingles overlap in at least 80 of 100.

A document is the set of its distinct 5-word shingles (A-Z lower-cased; fewer words: all of them as one), kept as a
sorted array of 64-bit hashes. Two documents link when 100 * |A n B| >= 80 * |A u B|. The steps:

1. Equal sets (128-bit digest and size) are one class; its smallest doc_id stands for it.
2. Every class lists its prefix: the n - ceil(0.8 n) + 1 first shingles in an order that puts shingles of one document
   first and frequent ones last. Linked sets share a prefix shingle, whatever the order is; those of one document
   take their places in the prefix and need no partner.
3. Per prefix shingle all members are compared with the smallest one, and links become components. This takes
   one candidate per row, also where thousands of documents share a shingle.
4. Where a shingle still joins several components, the members outside the first one's component meet all members
   in tiles: blocks of at most ``BLOCK`` rows, split by size band in large groups. In every tile, sizes and the bit
   counts of hashed parity bitmaps bound the overlap from above before a pair leaves it.
5. Survivors are decided by intersecting the sorted arrays. Pairs inside one component are not compared again,
   so the result is the components (with at least one true path of links), not the list of all links.

Rows with a null text, without words or without doc_id have an empty set or no component and link with nothing. Rows
that repeat a doc_id are one node: a link of any of them counts, copies of any of its texts included. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationcast.llm import text as X
from stationcast.llm.common import KeyFilter, components, key_filter, materialize, table

SHINGLE = 5
#: The link condition, 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Shingles whose frequency is counted: hashes in the lowest 30 of 100, which is where nearly all prefixes lie.
COUNTED = np.uint64(int(0.3 * 2**64))
#: A shingle in more documents than this is frequent; the least count grows so that at most MOST_FREQUENT are.
FREQUENT, MOST_FREQUENT = 64, 1 << 22
BLOCK = 1024
MOST_BITS = 4096
#: Rows of an Arrow batch while texts are read.
BATCH_ROWS = 2048

SIGNATURE = "doc_id long, n long, d1 long, d2 long, bitmap binary"


def _needed(n: np.ndarray | int):
    """ceil(0.8 n): the least overlap of a set of n with any linked set."""
    return (PERCENT * n + 99) // 100


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Per row of a text column, its number and its sorted distinct shingle hashes."""
    for lo, hi in X.slices(texts):
        w = X.words(texts.slice(lo, hi - lo), lower=True)
        h = w.hashes()
        grams, at = X.ngrams(h, w.first, SHINGLE)
        cuts = np.searchsorted(at, w.first)
        for d in range(hi - lo):
            a, b = w.first[d], w.first[d + 1]
            if b - a >= SHINGLE:
                s = np.sort(grams[cuts[d]:cuts[d + 1]])
                yield lo + d, s[X.group_starts(s)]
            elif b > a:
                # The words' hashes folded in order, apart from the 5-grams by the number of words.
                fold = np.uint64(b - a)
                for x in h[a:b]:
                    fold = X.mix(np.array([fold], np.uint64) ^ x)[0]
                yield lo + d, np.array([fold], dtype=np.uint64)
            else:
                yield lo + d, np.zeros(0, dtype=np.uint64)


def parity_bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    """Bit b is the parity of the number of elements hashed to b: two bitmaps differ in at most |A xor B| bits."""
    counts = np.bincount((X.mix(s) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8))


def bitmap_bits(n: int) -> int:
    """Once to twice the set's size: unrelated sets then differ in about half of n bits or more, linked ones in 2n/9."""
    return min(MOST_BITS, max(64, 1 << (max(n, 1) - 1).bit_length()))


def fold(bitmap: np.ndarray, bits: int) -> np.ndarray:
    """A parity bitmap for fewer bits: the halves' exclusive or, as elements keep their low hash bits."""
    while len(bitmap) * 8 > bits:
        half = len(bitmap) // 2
        bitmap = bitmap[:half] ^ bitmap[half:]
    return bitmap


def overlap_bound(na: int, a: bytes, nb: int, b: bytes) -> int:
    """An upper bound of |A n B| by the bits in which the two parity bitmaps differ."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    bits = 8 * min(len(x), len(y))
    return (na + nb - int(np.bitwise_count(fold(x, bits) ^ fold(y, bits)).sum())) // 2


def linked(overlap: int, na: int, nb: int) -> bool:
    return 100 * overlap >= PERCENT * (na + nb - overlap)


def _rows(batches, schema: str, make, keys: KeyFilter | None = None):
    """Runs ``make(doc_id, set)`` over the documents of Arrow batches and yields the rows it returns as batches."""
    for batch in batches:
        ids = batch.column(0)
        texts = X.as_texts(batch.column(1))
        known = np.asarray(ids.is_valid())
        numbers = ids.fill_null(0).to_numpy(zero_copy_only=False)
        if keys is not None:
            known &= keys(numbers)
            at = np.flatnonzero(known)
            numbers, texts, known = numbers[at], X.as_texts(texts.take(pa.array(at))), known[at]
        yield from make(numbers, known, texts)


def _signatures(batches):
    for batch in batches:
        ids, texts = batch.column(0), X.as_texts(batch.column(1))
        n, d1, d2 = (np.zeros(len(texts), dtype=np.int64) for _ in range(3))
        bitmaps: list[bytes | None] = [None] * len(texts)
        with np.errstate(over="ignore"):
            for i, s in shingle_sets(texts):
                n[i] = len(s)
                bitmaps[i] = parity_bitmap(s, bitmap_bits(len(s))).tobytes() if len(s) else None
                d1[i:i + 1] = np.array([s.sum(dtype=np.uint64)]).view(np.int64)
                d2[i:i + 1] = np.array([X.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)]).view(np.int64)
        yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(n), pa.array(d1), pa.array(d2),
                                          pa.array(bitmaps, pa.binary())], names=["doc_id", "n", "d1", "d2", "bitmap"])


def signatures(docs: DataFrame) -> DataFrame:
    """Per row of (doc_id, text): the size of its shingle set, a 128-bit digest of the set, and its bitmap."""
    return docs.mapInArrow(_signatures, SIGNATURE)


def _flat(found: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    values, sizes = np.concatenate([s for *_, s in found]), [len(s) for *_, s in found]
    ids, n = (np.repeat(np.array([f[k] for f in found], dtype=np.int64), sizes) for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(X.signed(values)), pa.array(ids), pa.array(n)], names=["token", "id", "n"])


def _counted_shingles(docs: DataFrame, reps: KeyFilter) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(reps)

    def make(numbers, known, texts):
        for i, s in shingle_sets(texts):
            if known[i]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(X.signed(s[:np.searchsorted(s, COUNTED)]))], names=["token"])

    def run(batches):
        held, rows = [], 0
        for small in _rows(batches, "", make, shared.value):
            held.append(small)
            rows += small.num_rows
            if rows > 100_000:
                yield from _combined(held)
                held, rows = [], 0
        yield from _combined(held)
    return docs.mapInArrow(run, "token long")


def _combined(held: list[pa.RecordBatch]):
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def prefix(s: np.ndarray, frequent: np.ndarray, again: KeyFilter | None = None) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 elements in the order (counted once, counted more often, not counted, frequent; hash).

    ``frequent`` is sorted; ``again`` may hold every counted element that is not known to be in one document only. The
    order looks at the element alone, so it is the same in all sets.
    """
    take = len(s) - _needed(len(s)) + 1
    rank = np.zeros(len(s), dtype=np.int8)
    if again is not None:
        counted = np.searchsorted(s, COUNTED)
        rank[:counted] = again(X.signed(s[:counted]))
        rank[counted:] = 2
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        rank[frequent[at] == s] = 3
    return s[np.argsort(rank, kind="stable")[:take]]


def _prefixes(docs: DataFrame, reps: KeyFilter, frequent: np.ndarray, again: KeyFilter) -> DataFrame:
    """(token, id, n) of all prefix shingles, with the size of their set, but those counted once: they are in no other document."""
    shared = docs.sparkSession.sparkContext.broadcast((reps, frequent, again))

    def run(batches):
        keys, often, repeated = shared.value

        def make(numbers, known, texts):
            found, size = [], 0
            for i, s in shingle_sets(texts):
                if known[i] and len(s):
                    first = prefix(s, often, repeated)
                    found.append((numbers[i], len(s), first[(first >= COUNTED) | repeated(X.signed(first))]))
                    size += len(found[-1][2])
                    if size > 100_000:
                        yield _flat(found)
                        found, size = [], 0
            if found:
                yield _flat(found)
        yield from _rows(batches, "", make, keys)
    return docs.mapInArrow(run, "token long, id long, n long")


def _sets(docs: DataFrame, wanted: KeyFilter) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        def make(numbers, known, texts):
            rows, size = ([], [], []), 0

            def batch():
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                    rows, (pa.int64(), pa.int64(), pa.binary()))], names=["id", "n", "hashes"])
            for i, s in shingle_sets(texts):
                if known[i] and len(s):
                    for c, v in zip(rows, (numbers[i], len(s), s.tobytes())):
                        c.append(v)
                    size += s.nbytes
                    if size > 4 << 20:
                        yield batch()
                        rows, size = ([], [], []), 0
            if rows[0]:
                yield batch()
        yield from _rows(batches, "", make, shared.value)
    return docs.mapInArrow(run, "id long, n long, hashes binary")


def _test_pairs(pairs: DataFrame, sets: DataFrame, column: str, keep) -> DataFrame:
    """Joins both sides' ``column`` to (a, b) and keeps the pairs for which ``keep(na, x, nb, y)`` holds.

    A pair may come more than once where several rows share an id."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col(column).alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col(column).alias("y"))

    def run(batches):
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            x, y = batch.column("x"), batch.column("y")
            good = np.fromiter((keep(int(na[i]), x[i].as_buffer(), int(nb[i]), y[i].as_buffer())
                                for i in range(len(na))), dtype=bool, count=len(na))
            at = pa.array(np.flatnonzero(good))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)],
                                             names=["a", "b"])
    return (pairs.join(left, "a").join(right, "b")
            .where(F.expr(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)"))
            .select("a", "na", "x", "b", "nb", "y").mapInArrow(run, "a long, b long"))


def _bound_allows(na, x, nb, y) -> bool:
    return linked(overlap_bound(na, x, nb, y), na, nb)


def _intersects(na, x, nb, y) -> bool:
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return linked(int((b[at] == a).sum()), len(a), len(b))


def verified(pairs: DataFrame, bitmaps: DataFrame, docs: DataFrame) -> DataFrame:
    """The candidate pairs that link: first by bitmaps, then by the sorted arrays of the texts still in question."""
    left = materialize(_test_pairs(pairs, bitmaps, "bitmap", _bound_allows))
    ids = left.select(F.col("a").alias("id")).union(left.select("b"))
    sets = materialize(_sets(docs, key_filter(ids, ids.count())), batch_rows=BATCH_ROWS)
    return materialize(_test_pairs(left, sets, "hashes", _intersects))


def _like(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)


def _apart(bitmaps: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Per pair of rows the number of bits in which their bitmaps differ, both at the width of the narrower one."""
    width = np.array([len(b) for b in bitmaps])
    least = np.minimum(width[i], width[j])
    out = np.zeros(len(i), dtype=np.int64)
    for w in np.unique(least):
        at = np.flatnonzero(least == w)
        rows, place = np.unique(np.concatenate([i[at], j[at]]), return_inverse=True)
        flat = np.stack([fold(np.frombuffer(bitmaps[r], np.uint8), 8 * int(w)) for r in rows]).view(np.uint64)
        step = max(1, (8 << 20) // int(w))
        for lo in range(0, len(at), step):
            x, y = place[lo:min(lo + step, len(at))], place[len(at) + lo:len(at) + min(lo + step, len(at))]
            out[at[lo:lo + step]] = np.bitwise_count(flat[x] ^ flat[y]).sum(axis=1, dtype=np.int64)
    return out


def _tile_pairs(run: dict[str, np.ndarray | list]) -> Iterator[np.ndarray]:
    """Pairs of many tiles: left rows with the rows of their tile in other components, by size and then by bitmaps."""
    n, comp, ids = run["n"], run["comp"], run["id"]
    starts = X.group_starts(run["tile"])
    lengths = np.diff(np.append(starts, len(run["tile"])))
    left = np.flatnonzero(run["side"] & 1)
    at = np.searchsorted(starts, left, side="right") - 1
    total = np.cumsum(lengths[at])
    lo = 0
    while lo < len(left):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + 1_000_000, side="right")))
        size = lengths[at[lo:hi]]
        i = np.repeat(left[lo:hi], size)
        j = np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[at[lo:hi]], size)
        # Where both rows are left ones, the pair comes once.
        ok = ((run["side"][j] & 2 != 0) & (comp[i] != comp[j]) & _like(n[i], n[j])
              & ((run["side"][j] & 1 == 0) | (ids[i] < ids[j])))
        i, j = i[ok], j[ok]
        if len(i):
            most = (n[i] + n[j] - _apart(run["bitmap"], i, j)) // 2
            ok = 100 * most >= PERCENT * (n[i] + n[j] - most)
            x, y = ids[i[ok]], ids[j[ok]]
            yield np.stack([np.minimum(x, y), np.maximum(x, y)])
        lo = hi


def _pairs(found: list[np.ndarray]) -> pa.RecordBatch:
    a, b = np.unique(np.concatenate(found, axis=1), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _tiles(batches):
    """Streams rows sorted by tile; a tile may go on in the next batch, and holds at most about 2 * BLOCK rows."""
    names = ("tile", "side", "id", "comp", "n")
    held: dict | None = None

    def emit(run):
        found, rows = [], 0
        for pairs in _tile_pairs(run):
            found.append(pairs)
            rows += pairs.shape[1]
            if rows > 500_000:
                yield _pairs(found)
                found, rows = [], 0
        if rows:
            yield _pairs(found)
    for batch in batches:
        part = {c: np.asarray(batch.column(c)) for c in names} | {"bitmap": batch.column("bitmap").to_pylist()}
        if held is not None:
            part = {c: np.concatenate([held[c], part[c]]) for c in names} | {"bitmap": held["bitmap"] + part["bitmap"]}
        last = int(np.searchsorted(part["tile"], part["tile"][-1])) if len(part["tile"]) else 0
        if last:
            yield from emit({c: v[:last] for c, v in part.items()})
        held = {c: v[last:] for c, v in part.items()}
    if held is not None and len(held["tile"]):
        yield from emit(held)


def tile_candidates(rows: DataFrame, bitmaps: DataFrame, roots: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) across components, from (token, id, leader) rows and (node, root) so far."""
    placed = materialize(
        rows.join(roots.withColumnRenamed("node", "id"), "id", "left")
        .select("token", "id", F.coalesce("root", "id").alias("comp")))
    per = placed.groupBy("token", "comp").agg(F.count("*").alias("m"), F.min("id").alias("least"))
    # One component: nothing is left to find. Otherwise the first component's members are the right side only.
    tokens = (per.groupBy("token").agg(F.sum("m").alias("m"), F.min_by("comp", "least").alias("lead"),
                                       F.min_by("m", "least").alias("of_lead"), F.count("*").alias("comps"))
              .where("comps > 1").select("token", "m", "lead", (F.col("m") - F.col("of_lead")).alias("s"),
                                         (F.col("m") > BLOCK).alias("large")))
    mixed = placed.join(tokens, "token").join(bitmaps, "id")
    mixed = mixed.withColumn("other", F.col("comp") != F.col("lead"))
    small = mixed.where("not large").select(
        F.col("token").alias("tile"), F.when(F.col("other"), 3).otherwise(2).alias("side"), "id", "comp", "n", "bitmap")
    # Large groups: bands of sizes by factor 1.25 = 100/80, so that linked sets are in the same or the next band.
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / PERCENT))).cast("int")
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    large = mixed.where("large").select(
        "token", "id", "comp", "n", "bitmap", "other", band.alias("band"),
        F.ceil(F.col("s") / BLOCK).cast("int").alias("left_blocks"),
        F.ceil(F.col("m") / BLOCK).cast("int").alias("right_blocks"), place.alias("place"))
    lefts = large.where("other").select(
        "*", F.lit(1).alias("side"), F.col("band").alias("b"), (F.col("place") % F.col("left_blocks")).alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("right_blocks") - 1)).alias("j"))
    rights = large.select("*", F.lit(2).alias("side"), F.explode(F.array(
        F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("b")).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("left_blocks") - 1)).alias("i"),
        (F.col("place") % F.col("right_blocks")).alias("j"))
    tile = F.xxhash64("token", "b", F.col("i").cast("long"), F.col("j").cast("long"))
    dealt = small.union(lefts.select(tile, "side", "id", "comp", "n", "bitmap")).union(
        rights.select(tile, "side", "id", "comp", "n", "bitmap"))
    return (dealt.repartition("tile").sortWithinPartitions("tile")
            .mapInArrow(_tiles, "a long, b long").distinct())


def _same_document(nodes: DataFrame) -> DataFrame:
    """Edges between the classes that hold texts of one repeated doc_id."""
    some = nodes.where("n > 0 and doc_id is not null").select("doc_id", "node")
    several = (some.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("most"))
               .where("b < most").select("doc_id", "b"))
    return some.join(several, "doc_id").where("node <> b").select(F.col("node").alias("a"), "b").distinct()


def join_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = materialize(signatures(docs), batch_rows=BATCH_ROWS)
    classes = materialize(marks.where("n > 0 and doc_id is not null").groupBy("d1", "d2", "n").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    size = classes.agg(F.count("*").alias("reps"), F.coalesce(F.sum("n"), F.lit(0)).alias("shingles")).first()
    reps = key_filter(classes.select("rep"), size["reps"])
    # Counts above total / MOST_FREQUENT are at most MOST_FREQUENT, which bounds what is collected and broadcast.
    least = max(FREQUENT, -(-size["shingles"] // MOST_FREQUENT))
    counts = materialize(_counted_shingles(docs, reps).groupBy("token").count().where("count > 1"),
                         batch_rows=BATCH_ROWS)
    often = counts.where(F.col("count") > least).select("token").toArrow().column("token").to_numpy()
    rows = _prefixes(docs, reps, np.sort(often.astype(np.int64).view(np.uint64)),
                     key_filter(counts.select("token"), counts.count()))
    groups = (rows.groupBy("token").agg(F.min("id").alias("leader"), F.min_by("n", "id").alias("leader_n"),
                                        F.max("id").alias("last"))
              .where("leader < last").select("token", "leader", "leader_n"))
    shared = materialize(rows.join(groups, "token"), batch_rows=BATCH_ROWS)
    bitmaps = marks.where("n > 0").select(F.col("doc_id").alias("id"), "n", "bitmap")
    # Only sets of like size are candidates, which is known here without their bitmaps. Where a leader's id has several
    # texts, those left out here are in other components and meet in the tiles.
    like = f"id <> leader and 100 * least(n, leader_n) >= {PERCENT} * greatest(n, leader_n)"
    first = verified(shared.where(like).select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), bitmaps, docs)
    second = verified(tile_candidates(shared, bitmaps, components(first)), bitmaps, docs)
    copies = classes.where("copies > 1").select("d1", "d2", "n", "rep")
    nodes = marks.drop("bitmap").join(copies, ["d1", "d2", "n"], "left").withColumn("node", F.coalesce("rep", "doc_id"))
    roots = components(first.union(second).union(_same_document(nodes)))
    return (nodes.join(roots, "node", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "node")).alias("component_id")))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP6_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
shingles AS (SELECT DISTINCT doc_id, md5(s) AS s FROM (
  SELECT doc_id, array_to_string(words[i:i + 4], ' ') AS s
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)
  UNION ALL SELECT doc_id, 'short ' || array_to_string(words, ' ') FROM w WHERE len(words) BETWEEN 1 AND 4)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM shingles a JOIN shingles b USING (s)
  WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
near AS (SELECT x, y FROM links JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * common >= 80 * (p.n + q.n - common)),
reach AS (SELECT x, x AS y FROM near UNION SELECT reach.x, near.y FROM reach JOIN near ON reach.y = near.x),
roots AS (SELECT x, min(y) AS root FROM reach GROUP BY x)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(root, w.doc_id) AS component_id
FROM w LEFT JOIN sizes USING (doc_id) LEFT JOIN roots ON roots.x = w.doc_id"""
