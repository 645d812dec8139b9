"""Language identification by cross-parsing.

A suffix automaton is built for each language from labelled text. A text is parsed with it into phrases, each the
longest match from where the last one ended; words carry a mark at both ends and are parsed one by one, so
phrases do not cross words and each distinct word is parsed once per task. A phrase counts the
logarithms of the characters learned and of the alphabet, so that languages with samples of different length
compare: the sum estimates the cross entropy, and the language with the least wins.

Learning uses a bounded sample: per language the first ``MOST_DOCUMENTS`` labelled documents in the order of a hash of
their id, each read whole; their different words, in order of appearance, up to ``LEARNED_CHARS``. A language with
few labelled words has the sample that it has and changes nothing for the others. Every text is scored whole. Null texts and texts
without a letter are ``und`` with score 0; so is every text where nothing is labelled. Ties go to the first language
by name. Rows with null or repeated ids are scored each for itself.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationcast.llm import text as X
from stationcast.llm.common import digest_bucket, table

MOST_DOCUMENTS, LEARNED_CHARS = 120, 30_000
MOST_WORDS, FEW_WORDS = 500_000, 8
SEED = 5
_letters = re.compile(r"[^\W\d_]+").findall


class SuffixAutomaton:
    """All substrings of a text: transitions of the online construction, state 0 is the start."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            new = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    split = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = link[new] = split
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = split
                        p = link[p]
            last = new


class ArcTable:
    """The arcs of an automaton, as state * (characters + 1) + character number in ascending order, and their ends.
    Number 0 is any other character and has no arc. Its length is the number of states."""

    def __init__(self, machine: SuffixAutomaton, alphabet: dict[str, int]):
        keys = np.fromiter((s * (len(alphabet) + 1) + alphabet[c] for s, arcs in enumerate(machine.next) for c in arcs),
                           dtype=np.int64)
        ends = np.fromiter((t for arcs in machine.next for t in arcs.values()), dtype=np.int32)
        order = np.argsort(keys)
        self.keys, self.ends, self.states = keys[order], ends[order], len(machine.next)

    def __len__(self) -> int:
        return self.states


def marked(words: list[str]) -> str:
    return "".join(f" {w} " for w in words)


class Parser:
    """The learned languages: counts the phrases of words in all of them at once, step by step over many words."""

    def __init__(self, samples: dict[str, str]):
        self.names = sorted(samples)
        alphabet = {c: i for i, c in enumerate(sorted(set("".join(samples.values()))), 1)}
        self.codes = alphabet
        # Lists of arcs, so a model grows with its sample and not with the alphabet of all languages.
        self.width = len(alphabet) + 1
        self.tables = [ArcTable(SuffixAutomaton(samples[k]), alphabet) for k in self.names]
        self.steps: list[dict[int, int]] = []
        # What a phrase tells: a place of the sample and the character that ends it; against a sample of full length.
        self.weights = (np.log([len(samples[k]) + 1.0 for k in self.names]) + np.log(len(alphabet) + 1)) / (
            np.log(LEARNED_CHARS + 1.0) + np.log(len(alphabet) + 1))
        self.clear()

    def clear(self) -> None:
        self.index: defaultdict[str, int] = defaultdict(count().__next__)
        self.phrases = np.zeros((0, len(self.names)), dtype=np.int32)

    def parse(self, words: list[str]) -> np.ndarray:
        """Phrases of each word (with its end marks) per language."""
        text = marked(words)
        get = self.codes.get
        flat = np.fromiter((get(c, 0) for c in text), dtype=np.int64, count=len(text))
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
        order = np.argsort(-sizes, kind="stable")
        start = (np.cumsum(sizes) - sizes)[order]
        longest_first = sizes[order]
        # How many words are still being read at each step; the last few go on alone, character by character.
        live = len(words) - np.searchsorted(longest_first[::-1], np.arange(longest_first[0] if len(words) else 0), "right")
        together = int(np.searchsorted(-live, -FEW_WORDS))
        out = np.zeros((len(words), len(self.names)), dtype=np.int32)
        for k, arcs in enumerate(self.tables):
            keys, ends = arcs.keys, arcs.ends
            first = np.full(self.width, -1, dtype=np.int32)
            n = int(np.searchsorted(keys, self.width))
            first[keys[:n]] = ends[:n]
            state = np.zeros(len(words), dtype=np.int32)
            phrases = np.zeros(len(words), dtype=np.int32)
            for step in range(together):
                n = live[step]
                c = flat[start[:n] + step]
                wanted = state[:n].astype(np.int64) * self.width + c
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                ended = keys[at] != wanted
                # The phrase ends before a character that cannot follow; the next one begins with it.
                phrases[:n] += ended & (state[:n] > 0)
                again = first[c]
                phrases[:n] += ended & (again < 0)
                state[:n] = np.where(ended, np.maximum(again, 0), ends[at])
            for w in range(int(live[together]) if together < len(live) else 0):
                rest = flat[start[w] + together:start[w] + longest_first[w]].tolist()
                state[w], more = self._alone(k, int(state[w]), rest)
                phrases[w] += more
            out[order, k] = phrases + (state > 0)
        return out

    def _alone(self, k: int, state: int, codes: list[int]) -> tuple[int, int]:
        """The state after these characters, and the phrases that end on the way."""
        if not self.steps:
            self.steps = [dict(zip(t.keys.tolist(), t.ends.tolist())) for t in self.tables]
        to, width, phrases = self.steps[k].get, self.width, 0
        for c in codes:
            after = to(state * width + c)
            if after is None:
                after = to(c, 0)
                phrases += (state > 0) + (after == 0)
            state = after
        return state, phrases

    def __getstate__(self):
        return {**self.__dict__, "steps": []}

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self.index) > MOST_WORDS:
            self.clear()
        index, before = self.index, len(self.index)
        rows = np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=len(words))
        if len(index) > before:
            new = list(islice(reversed(index), len(index) - before))[::-1]
            self.phrases = np.concatenate([self.phrases, self.parse(new)])
        return rows

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        words: list[str] = []
        ends = [0]
        for t in texts:
            words += _letters(t.lower())
            ends.append(len(words))
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not self.names or not words:
            return names, scores
        sums = np.zeros((len(words) + 1, len(self.names)), dtype=np.int64)
        rows = self.rows(words)
        np.cumsum(self.phrases[rows], axis=0, out=sums[1:])
        total = (sums[np.array(ends[1:])] - sums[np.array(ends[:-1])]) * self.weights
        for i, t in enumerate(texts):
            # Signs that count as word characters without being letters are no text.
            if ends[i] < ends[i + 1] and any(map(str.isalpha, "".join(words[ends[i]:ends[i + 1]]))):
                names[i] = self.names[int(total[i].argmin())]
                weight = np.exp(-(total[i] - total[i].min()).astype(float))
                scores[i] = weight.max() / weight.sum()
        return names, scores


def learn(docs: DataFrame, held_out: Column) -> Parser:
    """Parser of the languages in the rows (doc_id, text, lang) that are not held out."""
    rows = docs.where(~F.coalesce(held_out, F.lit(True)) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select("lang", F.xxhash64("doc_id", F.lit(SEED)).alias("o"), "text")
    # Hashes are ranked without their texts, in each task before the shuffle; the texts of the chosen are fetched after.
    chosen = rows.select("lang", "o").withColumn("r", F.expr("row_number() over (partition by lang order by o)")).where(
        F.col("r") <= MOST_DOCUMENTS).select("lang", "o").distinct()
    # At most MOST_DOCUMENTS short rows per language are broadcast. Rows of one id share a hash, hence the second rank.
    first = rows.join(F.broadcast(chosen), ["lang", "o"], "left_semi").withColumn(
        "r", F.expr("row_number() over (partition by lang order by o, text)")).where(
        F.col("r") <= MOST_DOCUMENTS).orderBy("lang", "r")
    words: defaultdict[str, dict[str, None]] = defaultdict(dict)
    chars: defaultdict[str, int] = defaultdict(int)
    # Text by text; phrases lie within words, so a word that comes again teaches nothing.
    for r in first.toLocalIterator():
        k = r["lang"]
        for w in _letters(r["text"].lower()) if chars[k] < LEARNED_CHARS else ():
            if w not in words[k] and chars[k] < LEARNED_CHARS:
                words[k][w] = None
                chars[k] += len(w) + 2
    return Parser({k: marked(list(ws))[:LEARNED_CHARS] for k, ws in words.items() if ws})


def identify(docs: DataFrame, parser: Parser) -> DataFrame:
    """(doc_id, lang_pred, score) per row of (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(parser)

    def run(batches) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = X.as_texts(batch.column("text"))
            for lo, hi in X.slices(texts):
                names, scores = model.predict(texts.slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(names, pa.string()), pa.array(scores)],
                    names=["doc_id", "lang_pred", "score"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, lang_pred string, score double")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = digest_bucket("doc_id", 4) == 2
    return identify(docs, learn(docs, held_out)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
