"""Removal of repeated passages by a compacted de Bruijn graph over word windows.

Edges of the graph are windows of 20 consecutive words, nodes the 19 words that two windows share. Words under a window that also starts earlier (smaller doc_id, or earlier in the same document)
are removed. The steps:

1. Every window has an anchor, the smallest hash of its 8-word grams. Equal windows have equal anchors, so only
   windows whose anchor occurs at two places or more can repeat. Anchors are counted over all documents.
2. Windows with such an anchor become edges: counted, with their first place in the corpus and a sum over all
   places that moves in a known way when every place moves by one word.
3. Compaction: an edge continues the path of the edge at the preceding place when both have as many occurrences and the
   sums fit, that is, when every occurrence of the one is followed by the other. What remains of a nonbranching
   path is its head with a length.
4. All windows of the texts are joined with the heads. Each occurrence of a head is an occurrence of the whole path, and
   all but the first lose the path's words. A second hash is compared with that of the first place: an edge of
   unlike windows with one hash has other counts than its neighbours, so it is a path of its own and fails here.

Places are (doc_id, word number), so the source coordinates decide what comes first. Rows with a null or empty text
have no words. Rows with a null doc_id, and rows that repeat a doc_id with another text than the one of the smallest
hash, take no part and keep their words; rows equal in doc_id and text are one document. Empty tables give empty
results. Other columns pass through; those named n_words or n_removed are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationcast.llm import text as X
from stationcast.llm.common import KeyFilter, key_filter, materialize, may_contain, table

WINDOW = 20
GRAM = 8
_SPAN = WINDOW - GRAM + 1
#: The sum over an edge's places p is that of R^p modulo the prime P.
P = (1 << 31) - 1
R = 48271
#: Documents that lose words are broadcast by id up to this number (8 bytes each), else tested by a filter of 16 MB.
MOST_BROADCAST = 1_000_000
#: Batches of emitted rows.
_ROWS = 200_000


def _grams_and_anchors(w: X.Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word position the hash of its gram; the positions where a window starts, and those windows' anchors."""
    total = len(h)
    grams, at = X.ngrams(h, w.first, GRAM)
    g = np.full(total, np.uint64(2**64 - 1))
    g[at] = grams
    left = np.repeat(w.first[1:], np.diff(w.first)) - np.arange(total)
    starts = np.flatnonzero(left >= WINDOW)
    if len(starts) == 0:
        return g, starts, np.zeros(0, np.uint64)
    # The least of 13 by doubling: of 2, of 4, of 8, then two overlapping eights.
    low = g
    for reach in (1, 2, 4):
        low = np.minimum(low[:-reach], low[reach:])
    return g, starts, np.minimum(low[starts], low[starts + _SPAN - 8])


def _anchor_rows(texts: pa.Array, known: np.ndarray) -> Iterator[np.ndarray]:
    """Each anchor once per run of windows that share it, and once more for grams that recur within one window or
    from one window to the next."""
    for lo, hi in X.slices(texts):
        w = X.words(texts.slice(lo, hi - lo))
        h = w.hashes()
        g, starts, anchors = _grams_and_anchors(w, h)
        if len(starts) == 0:
            continue
        doc = w.doc
        ok = known[lo + doc[starts]]
        new = np.ones(len(starts), dtype=bool)
        new[1:] = (anchors[1:] != anchors[:-1]) | (doc[starts[1:]] != doc[starts[:-1]])
        yield anchors[new & ok]
        again = np.zeros(len(g), dtype=bool)
        # Up to _SPAN: a run of windows goes on where a gram comes back that many words later.
        for d in range(1, _SPAN + 1):
            again[:-d] |= (g[:-d] == g[d:]) & (doc[:-d] == doc[d:])
        again &= known[lo + doc]
        if again.any():
            yield g[again]


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    ids = batch.column("doc_id")
    known = np.asarray(ids.is_valid()) & np.asarray(batch.column("active").fill_null(False))
    return ids.fill_null(0).to_numpy(zero_copy_only=False), known, X.as_texts(batch.column("text"))


def _anchors(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            _, known, texts = _columns(batch)
            for found in _anchor_rows(texts, known):
                for lo in range(0, len(found), _ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(X.signed(found[lo:lo + _ROWS]))], names=["anchor"])
    return docs.mapInArrow(run, "anchor long")


#: Steps of the low table of powers; the high one has one entry per so many places.
_LOW = 1 << 15


def _power_steps(step: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.int64)
    for i in range(1, n):
        out[i] = out[i - 1] * step % P
    return out


class _Powers:
    """R^(place) modulo P, from place = doc part * base + pos: two small tables in place of one as long as a text."""

    def __init__(self, base: int):
        self.base = base
        self.low = _power_steps(R, _LOW)
        self.high = np.ones(1, dtype=np.int64)

    def __call__(self, ids: np.ndarray, pos: np.ndarray) -> np.ndarray:
        if len(pos) == 0:
            return np.zeros(0, dtype=np.int64)
        high = int(pos.max()) // _LOW
        if high >= len(self.high):
            self.high = _power_steps(pow(R, _LOW, P), high + 1)
        starts = X.group_starts(ids)
        of_doc = np.array([pow(R, (int(i) * self.base) % (P - 1), P) for i in ids[starts]], dtype=np.int64)
        of_doc = np.repeat(of_doc, np.diff(np.append(starts, len(ids))))
        return of_doc * (self.low[pos % _LOW] * self.high[pos // _LOW] % P) % P


def _windows(docs: DataFrame, anchors: KeyFilter, base: int | None = None, heads: KeyFilter | None = None) -> DataFrame:
    """Rows (h, doc_id, pos) of windows whose anchor may be repeated; with ``base`` also ``g``, the power of their place;
    with ``heads`` only hashes that it may contain, and each with a second hash c of the window and the document's key."""
    shared = docs.sparkSession.sparkContext.broadcast((anchors, heads))
    names = ["h", "doc_id", "pos", *(("g",) if base is not None else ()), *(("c", "key") if heads is not None else ())]

    def run(batches):
        wanted, starting = shared.value
        powers = None if base is None else _Powers(base)
        for batch in batches:
            ids, known, texts = _columns(batch)
            keys = np.asarray(batch.column("key").fill_null(0))
            for lo, hi in X.slices(texts):
                w = X.words(texts.slice(lo, hi - lo))
                h = w.hashes()
                _, starts, least = _grams_and_anchors(w, h)
                if len(starts) == 0:
                    continue
                doc = w.doc
                ok = known[lo + doc[starts]] & wanted(X.signed(least))
                windows, at = X.ngrams(h, w.first, WINDOW)
                if starting is not None:
                    ok &= starting(X.signed(windows))
                at, d = at[ok], doc[at[ok]]
                pos = at - w.first[d]
                found = [X.signed(windows[ok]), ids[lo + d], pos.astype(np.int32)]
                if powers is not None:
                    found.append(powers(ids[lo + d], pos))
                if starting is not None and len(at):
                    found += [X.signed(X.ngrams(w.hashes(1), w.first, WINDOW, 1)[0][ok]), keys[lo + d]]
                for a in range(0, len(at), _ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(c[a:a + _ROWS]) for c in found], names=names)
    return docs.mapInArrow(run, ", ".join(f"{c} {'int' if c == 'pos' else 'long'}" for c in names))


def _follows(way: str) -> str:
    """Whether the edge of the neighbouring place has its occurrences one word before (lag) or after (lead)."""
    def near(c: str) -> str:
        return f"{way}({c}) over (partition by doc order by first)"
    first, then = (near("g"), "g") if way == "lag" else ("g", near("g"))
    step = "+ 1" if way == "lag" else "- 1"
    return f"{near('copies')} = copies and {near('first')} {step} = first and ({first}) * {R} % {P} = {then}"


def repeated_paths(docs: DataFrame) -> tuple[DataFrame, KeyFilter, tuple]:
    """Heads of repeated nonbranching paths: (h, first, windows); the anchors' filter; how places are made."""
    found = _anchors(docs).groupBy("anchor").count().where("count > 1").select("anchor")
    found = materialize(found)
    anchors = key_filter(found, found.count())
    stats = docs.where("active").agg(
        F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"),
        F.coalesce(F.max(F.octet_length("text")), F.lit(0)).alias("longest")).first()
    lo, hi = stats["lo"] or 0, stats["hi"] or 0
    base = 1 << (stats["longest"] // 2 + 2).bit_length()
    kind = "long" if (hi - lo + 2) * base < 2**63 else "decimal(38,0)"

    def place(doc_id, pos):
        return ((doc_id.cast(kind) - F.lit(lo).cast(kind)) * F.lit(base).cast(kind) + pos.cast(kind)).cast(kind)
    edges = (_windows(docs, anchors, base)
             .select("h", place(F.col("doc_id"), F.col("pos")).alias("place"), "g")
             .groupBy("h").agg(F.count("*").alias("copies"), F.min("place").alias("first"), F.sum("g").alias("g"))
             .where("copies > 1").withColumn("g", F.col("g") % P)
             .withColumn("doc", F.expr(f"first div {base}") if kind == "long" else F.floor(F.col("first") / F.lit(base))))
    # Each place is the first of one edge at most, so neighbours on a path are neighbours in their first document.
    ends = edges.selectExpr(
        "h", "copies", "first", "doc",
        f"coalesce({_follows('lag')}, false) as on", f"coalesce({_follows('lead')}, false) as more")
    # Heads and tails alternate along the places of one document; a path of one window is both.
    heads = materialize(ends.where("not (on and more)").withColumn("tail", F.expr(
        "case when not more then first else lead(first) over (partition by doc order by first) end"))
        .where("not on").select("h", "first", (F.col("tail") - F.col("first") + 1).cast("int").alias("windows")))
    return heads, anchors, (place, base)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, key, spans): per document the word spans [start, end) to remove. ``docs`` as from :func:`prepared`."""
    heads, anchors, (place, _) = repeated_paths(docs)
    at = materialize(_windows(docs, anchors, heads=key_filter(heads.select("h"), heads.count()))
                     .withColumn("place", place(F.col("doc_id"), F.col("pos"))).join(heads, "h"))
    # The second hash of the first place decides whether another place has the same words.
    source = at.where("place = first").groupBy("h").agg(F.min("c").alias("c0"))
    spans = (at.where("place <> first").join(source, "h").where("c = c0")
             .select("doc_id", "key", F.struct(F.col("pos").alias("a"), (F.col("pos") + F.col("windows")
                                               + (WINDOW - 1)).alias("b")).alias("span")))
    # One row per document, whose spans are fewer than its words.
    return materialize(spans.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("span")).alias("spans")))


def prepared(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text, active): which row stands for a repeated doc_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    twins = (docs.select("doc_id", "key").where("doc_id is not null").groupBy("doc_id")
             .agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most").select("doc_id", "least"))
    twins = materialize(twins)
    if twins.count() == 0:
        return docs.withColumn("active", F.col("doc_id").isNotNull())
    return docs.join(twins, "doc_id", "left").select(
        "doc_id", "key", "text", (F.col("doc_id").isNotNull() & F.coalesce(F.col("key") == F.col("least"), F.lit(True))
                                  ).alias("active"))


def _cut(batches, touch: bool):
    for batch in batches:
        names = batch.schema.names
        column = batch.column("text")
        texts = X.as_texts(column)
        spans = batch.column("_dedup_spans").to_pylist()
        kept, n_words, n_removed = [], [], []
        for i, found in enumerate(spans):
            words = texts[i].as_buffer().to_pybytes().split()
            n = len(words)
            if not found and not touch:
                kept.append(column[i].as_py())
                n_words.append(n)
                n_removed.append(0)
                continue
            if found:
                keep = np.ones(n, dtype=bool)
                for s in found:
                    keep[s["a"]:s["b"]] = False
                words = [words[j] for j in np.flatnonzero(keep)]
            kept.append(b" ".join(words).decode())
            n_words.append(n)
            n_removed.append(n - len(words))
        columns = [batch.column(c) for c in names if c not in ("text", "_dedup_spans", "n_words", "n_removed")]
        others = [c for c in names if c not in ("text", "_dedup_spans", "n_words", "n_removed")]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())],
            names=[*others, "text", "n_words", "n_removed"])


def remove_repeats(docs: DataFrame, touch: bool = True) -> DataFrame:
    """The rows with ``text`` cut down to the kept words, joined by one space, and n_words and n_removed.

    Without ``touch`` a text that loses no word stays as it is, white space and null included.
    """
    spark = docs.sparkSession
    spans = repeated_spans(prepared(docs))
    keys = spans.select(F.col("doc_id").alias("_dedup_id")).distinct()
    docs = docs.drop("n_words", "n_removed").withColumn("_dedup_id", F.col("doc_id").cast("long"))
    count = keys.count()
    if count <= MOST_BROADCAST:
        # A join in the JVM: no second Python worker beside the one that cuts.
        marked = docs.join(F.broadcast(keys.withColumn("_dedup_in", F.lit(True))), "_dedup_id", "left")
        marked = marked.withColumn("_dedup_hit", F.col("_dedup_in").isNotNull()).drop("_dedup_in")
    else:
        marked = docs.withColumn("_dedup_hit", may_contain(spark, key_filter(keys, count), "_dedup_id"))
    # Only documents that may lose words travel to their spans.
    spans = spans.select(F.col("doc_id").alias("_dedup_id"), F.col("key").alias("_dedup_key"),
                         F.col("spans").alias("_dedup_spans"))
    some = (marked.where("_dedup_hit").withColumn("_dedup_key", F.xxhash64("text"))
            .join(spans, ["_dedup_id", "_dedup_key"], "left").drop("_dedup_key"))
    rest = marked.where("not _dedup_hit").withColumn(
        "_dedup_spans", F.lit(None).cast("array<struct<a:int,b:int>>"))
    both = some.unionByName(rest).drop("_dedup_hit", "_dedup_id")
    fields = [f for f in both.schema if f.name not in ("text", "_dedup_spans")]
    schema = T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()),
                           T.StructField("n_removed", T.LongType())])
    return both.mapInArrow(lambda batches: _cut(batches, touch), schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP9_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(words[i:i + {WINDOW - 1}], ' ')) AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) >= {WINDOW})),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM windows),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, {WINDOW})) AS i FROM ranked WHERE k > 1),
lost AS (SELECT doc_id, list(i) AS places FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_filter(words, lambda x, k: NOT list_contains(coalesce(places, []), k)), ' '))
    AS kept_sha256
FROM w LEFT JOIN lost USING (doc_id)"""
