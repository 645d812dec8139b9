"""Toxicity: a lexicon trie read through a Levenshtein automaton, and context windows around every match.

The lexicon is learned: whole words and word beginnings (stems) that are far more frequent in documents labelled toxic.
Its entries form a trie. The automaton that accepts all words within one edit of a long enough entry is run over
the trie at the same time as over a word; its states are sets of (trie node, edits so far), made when first needed.
Each distinct word is matched once per task: not at all, exactly, by its stem, or misspelled.

Every match is then seen in its context: inside quotation marks of its line, or with a word of reporting shortly
before, it counts as quoted. Counts of quoted and unquoted matches by kind are the features of a logistic regression with
a prior that already expects unquoted exact matches to matter most.

Learning uses at most ``MOST_DOCUMENTS`` labelled rows of each class that are not held out, in the order of a hash of
their id; one half of them gives the lexicon, the other the weights, so weights see words as new texts would. Every
text is scored whole. Null and empty texts score as texts without a match. Rows with null or repeated ids are
scored each for itself. Without labelled rows the lexicon is empty and the prior decides.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationcast.llm import text as X
from stationcast.llm.common import digest_bucket, materialize, sample_ids, table

MOST_DOCUMENTS, MOST_ENTRIES = 4000, 5000
#: An entry is at least this many times as frequent in toxic documents, and its log likelihood ratio exceeds the
#: logarithm of the number of words that were tested by this much.
LEAST_RATIO, LEAST_GAIN = 20.0, 5.0
STEMS = (4, 5, 6, 7)
FUZZY_LENGTH = 5
CONTEXT_CHARS, SEED = 60, 13
KINDS = ("exact", "stem", "fuzzy")
#: Words that report what others said (fixed values).
REPORTING = {"said", "says", "called", "calls", "quoted", "quote", "wrote", "writes", "term", "word", "dit", "mot",
             "dijo", "palabra", "sagte", "wort", "nannte"}
_WORDS = re.compile(r"[^\W\d_]+")
#: A word with one digit or sign in place of a letter, or between two (fixed signs); longer mixtures are codes, not words.
_SIGN = re.compile(r"[0-9@$!*+|#](?=[^\W\d_])")
_MIXED = re.compile(r"(?<![\w@$!*+|#])[^\W\d_]+[0-9@$!*+|#][^\W\d_]+(?![\w@$*+|#])")
_MARKS = re.compile("[\"“”«»„\n]")
#: Prior of the weights: intercept, then per kind (any unquoted, log count unquoted, log count quoted).
PRIOR = np.array([-3.0, 3.0, 1.0, 0.3, 3.0, 1.0, 0.3, 2.0, 0.7, 0.2])


class Lexicon:
    """Trie of words and stems with a deterministic automaton for words within one edit, made state by state."""

    def __init__(self, words: list[str], stems: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[bool] = [False]
        self.words, self.stems = set(words), set(stems)
        for w in words:
            node = 0
            for c in w:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(False)
                node = self.children[node][c]
            self.ends[node] = len(w) >= FUZZY_LENGTH or self.ends[node]
        self.start = self._closed({(0, 0)})
        self.arcs: dict[frozenset, dict[str, frozenset]] = {}
        self.found: dict[str, int] = {}

    def _closed(self, states: set[tuple[int, int]]) -> frozenset:
        """With the places reached by leaving out a letter of the entry."""
        out = set(states)
        for node, edits in states:
            if edits == 0:
                out.update((child, 1) for child in self.children[node].values())
        return frozenset(out)

    def _step(self, states: frozenset, c: str) -> frozenset:
        arcs = self.arcs.setdefault(states, {})
        after = arcs.get(c)
        if after is None:
            reached: set[tuple[int, int]] = set()
            for node, edits in states:
                child = self.children[node].get(c)
                if child is not None:
                    reached.add((child, edits))
                if edits == 0:
                    reached.add((node, 1))
                    reached.update((x, 1) for x in self.children[node].values())
            after = arcs[c] = self._closed(reached)
        return after

    def misspelled(self, word: str) -> bool:
        if len(word) < FUZZY_LENGTH - 1:
            return False
        states = self.start
        for c in word:
            states = self._step(states, c)
            if not states:
                return False
        return any(self.ends[node] for node, _ in states)

    def kind(self, word: str) -> int:
        """0: no entry; 1: exact; 2: begins with a stem; 3: misspelled."""
        k = self.found.get(word)
        if k is None:
            if word in self.words:
                k = 1
            elif any(word[:n] in self.stems for n in STEMS):
                k = 2
            else:
                k = 3 if self.misspelled(word) else 0
            if len(self.found) > 400_000:
                self.found.clear()
            if len(self.arcs) > 50_000:
                self.arcs.clear()
            self.found[word] = k
        return k

    def __getstate__(self):
        return {**self.__dict__, "arcs": {}, "found": {}}


def quotations(text: str) -> tuple[list[int], list[int]]:
    """Where quotations begin and end: each odd mark of a line with the next one of the line."""
    begin, end, opened = [], [], -1
    for m in _MARKS.finditer(text):
        if m.group() == "\n":
            opened = -1
        elif opened < 0:
            opened = m.start()
        else:
            begin.append(opened)
            end.append(m.start())
            opened = -1
    return begin, end


def quoted(text: str, a: int, b: int, spans: tuple[list[int], list[int]]) -> bool:
    """Whether text[a:b] stands in one of the text's quotations, or closely follows a word of reporting."""
    begin, end = spans
    at = bisect_left(begin, a) - 1
    if at >= 0 and end[at] >= b:
        return True
    before = text[max(0, a - CONTEXT_CHARS):a].rpartition("\n")[2]
    return any(w in REPORTING for w in _WORDS.findall(before.lower())[-4:])


def counts(lexicon: Lexicon, text: str) -> np.ndarray:
    """Unquoted and quoted matches of each kind: 6 numbers."""
    out = np.zeros(6)
    low = text.lower()
    kinds = {w: k for w in set(_WORDS.findall(low)) if (k := lexicon.kind(w))}
    # Where no part of such a word is an entry, the automaton reads it whole: the sign is one edit.
    mixed = [m for m in _MIXED.finditer(low) if lexicon.kind(m.group()) == 3
             and kinds.keys().isdisjoint(_WORDS.findall(m.group()))] if _SIGN.search(low) else []
    if kinds or mixed:
        # Lower-casing may move offsets in rare scripts; contexts are then read from the lower-cased text.
        where = text if len(text) == len(low) else low
        spans = quotations(where)
        for m in _WORDS.finditer(low):
            k = kinds.get(m.group())
            if k:
                out[2 * (k - 1) + quoted(where, *m.span(), spans)] += 1
        for m in mixed:
            out[4 + quoted(where, *m.span(), spans)] += 1
    return out


def features(found: np.ndarray) -> np.ndarray:
    """Rows of :func:`counts` as regression features with a leading one."""
    plain, cited = found[:, 0::2], found[:, 1::2]
    per = np.stack([plain > 0, np.log1p(plain), np.log1p(cited)], axis=2).reshape(len(found), -1)
    return np.concatenate([np.ones((len(found), 1)), per], axis=1)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Logistic regression around the prior by damped Newton steps."""
    w = PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * (w - PRIOR)
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step / max(1.0, np.abs(step).max())
    return w


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Words and stems out of (text, label), counted by Spark; at most MOST_ENTRIES of each.

    What is counted are the different words before an entry, not its documents: copies of one document add nothing.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"))
    pairs = (sample.select("label", words.alias("ws"))
             .select("label", F.explode(F.array_distinct(F.transform("ws", lambda w, i: F.struct(
                 w.alias("w"), F.coalesce(F.get("ws", i - 1), F.lit("")).alias("before"))))).alias("x"))
             .select("label", "x.w", "x.before").distinct())
    pairs = materialize(pairs)
    total = {r["label"]: r["count"] for r in pairs.groupBy("label").count().collect()}
    share = (total.get(1, 0) + 1) / (sum(total.values()) + 2)
    least = LEAST_GAIN + float(np.log1p(pairs.select("w").distinct().count()))

    def strong(rows: DataFrame) -> DataFrame:
        """Entries whose contexts are toxic far beyond the share of toxic contexts, by the likelihood ratio."""
        both = rows.groupBy("w").agg(F.sum("label").alias("bad"), F.sum(F.lit(1) - F.col("label")).alias("good"))
        bad, good, n = F.col("bad"), F.col("good"), F.col("bad") + F.col("good")
        gain = bad * F.log(bad / (n * share)) + F.when(good > 0, good * F.log(good / (n * (1 - share)))).otherwise(0.0)
        return (both.where("bad > 0").where(gain >= least)
                .where(bad * (1 - share) >= LEAST_RATIO * share * good).orderBy(F.desc("bad"), "w"))
    stems = pairs.select("label", "w", "before", F.explode(F.array(*map(F.lit, STEMS))).alias("n")).where(
        F.length("w") > F.col("n")).select("label", F.substring("w", F.lit(1), F.col("n")).alias("w"),
                                          F.col("w").alias("whole"), "before")
    forms = stems.where("label = 1").groupBy("w").agg(F.countDistinct("whole").alias("forms")).where("forms >= 3")
    top = strong(pairs).limit(MOST_ENTRIES).collect()
    begin = strong(stems.join(forms, "w")).limit(MOST_ENTRIES).collect()
    return Lexicon([r["w"] for r in top], [r["w"] for r in begin])


def _scan(docs: DataFrame, lexicon: Lexicon, finish, keep: list[str], schema: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = X.as_texts(batch.column("text"))
            for lo, hi in X.slices(texts):
                found = np.array([counts(shared.value, t) for t in texts.slice(lo, hi - lo).to_pylist()])
                names, columns = finish(found)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in keep), *columns],
                                                 names=[*keep, *names])
    return docs.select(*keep, "text").mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, held_out: Column) -> tuple[Lexicon, np.ndarray]:
    """Lexicon and weights from (doc_id, text) and (doc_id, label)."""
    taken = sample_ids(labels.where("label = 1"), held_out, MOST_DOCUMENTS, SEED).union(
        sample_ids(labels.where("label = 0"), held_out, MOST_DOCUMENTS, SEED))
    # At most 2 * MOST_DOCUMENTS ids are broadcast, so the texts are not shuffled.
    sample = materialize(docs.where(F.col("text").isNotNull()).join(F.broadcast(taken), "doc_id").select(
        "text", F.col("label").cast("int").alias("label"), (F.crc32(F.col("doc_id").cast("string").cast("binary")) / 3 % 2)
        .cast("int").alias("half")))
    lexicon = learn_lexicon(sample.where("half = 0"))
    rows = _scan(sample.where("half = 1"), lexicon, lambda found: (
        [f"c{k}" for k in range(6)], [pa.array(found[:, k]) for k in range(6)]), ["label"],
        "label int, " + ", ".join(f"c{k} double" for k in range(6))).toArrow()
    found = np.stack([rows.column(f"c{k}").to_numpy() for k in range(6)], axis=1)
    y = rows.column("label").to_numpy().astype(float)
    return lexicon, fit(features(found), y) if len(y) else PRIOR.copy()


def score(docs: DataFrame, lexicon: Lexicon, weights: np.ndarray) -> DataFrame:
    """(doc_id, score, and the matches by kind, unquoted and quoted) per row of (doc_id, text)."""
    names = [f"n_{k}{q}" for k in KINDS for q in ("", "_quoted")]

    def finish(found: np.ndarray):
        p = 1 / (1 + np.exp(-np.clip(features(found) @ weights, -30, 30)))
        return ["score", *names], [pa.array(p), *(pa.array(found[:, k].astype(np.int64)) for k in range(6))]
    return _scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), lexicon, finish, ["doc_id"],
                 "doc_id long, score double, " + ", ".join(f"{n} long" for n in names))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = digest_bucket("doc_id", 3) == 1
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    scored = score(docs, *train(docs, labels, held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"),
                         *(c for c in scored.columns if c not in ("doc_id", "score")))
