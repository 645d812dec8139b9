"""Runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from stationcast.llm import periodic_runs as P

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_runs(words, min_length=6, exponent=4):
    found = {}
    n = len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            # Smaller periods come first: a stretch that is already there has a smaller one.
            if length >= 2 * q and (i, length) not in found:
                found[i, length] = q
            i = j
    return sorted((s, length, q) for (s, length), q in found.items() if length >= max(min_length, exponent * q))


def brute_loop(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n and doc_id is not None:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def brute_row(doc_id, text):
    words = brute_loop(doc_id, text)
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in sorted(runs, key=lambda r: (r[0], r[2])))
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return {"doc_id": doc_id, "n_runs": len(runs), "start": best[0], "length": best[1], "period": best[2],
            "exponent_milli": None if not runs else 1000 * best[1] // best[2],
            "runs_sha256": hashlib.sha256(lines.encode()).hexdigest(),
            "collapsed_sha256": hashlib.sha256(kept.encode()).hexdigest()}


def keyed(words):
    return np.array([10**6, *words, 10**6 + 1], dtype=np.uint64)


@pytest.mark.parametrize("exponent,min_length", [(4, 6), (2, 2), (3, 4)])
def test_runs_of_random_words(exponent, min_length):
    rng = random.Random(exponent)
    for _ in range(700):
        words = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(0, 40))]
        if rng.random() < 0.5:
            unit = [rng.randrange(3) for _ in range(rng.randrange(1, 6))]
            words += unit * rng.randrange(2, 7) + words[:3]
        got = P.find_runs(keyed(words), min_length, exponent)
        assert [tuple(r - np.array([1, 0, 0])) for r in got.tolist()] == brute_runs(words, min_length, exponent), words


def test_long_runs_stay_cheap():
    words = [0] * 100_000 + list(range(1, 50)) * 2000
    got = P.find_runs(keyed(words))
    assert got.tolist() == [[1, 100_000, 1], [100_001, 98_000, 49]]


TEXTS = ["", None, " \t\n", "one", "a a a a a a", "a a a a a", "x " + "b c " * 5 + "b y", "é ü " * 9, "    " * 4,
         "la la la la la la so la la la la la la la", ("one two three " * 5 + "four ") * 5]


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(13)
    texts = TEXTS + [" ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 120))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "z " * 8), (3, "z " * 8), (3, "z " * 8)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r.asDict().items()) for r in P.op13(spark, str(tmp_path)).collect()), key=str)
    assert sum(1 for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 10 == 0) > 10
    assert got == sorted((tuple(brute_row(*r).items()) for r in rows), key=str)


def test_clashing_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b " * 6, "x", 5)], "doc_id long, text string, runs string, n_words int")
    row = P.collapse_runs(docs).first()
    assert row["collapsed"] == "a b" and row["n_words"] == 12 and [tuple(r) for r in row["runs"]] == [(0, 12, 2)]
    assert P.collapse_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        P.collapse_runs(docs, min_exponent=1)
