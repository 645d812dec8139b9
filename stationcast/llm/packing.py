"""Sum-of-squares online packing of tokenized documents into sequences.

Each task packs its own partition as the documents come. Windows have as many token places as a sequence; a level array
counts the open windows by how full they are. A document goes to the level (or a new window) that leaves the
least sum of squared counts, so that no level piles up and every size finds a fitting partner. Documents longer than a
window fill whole sequences first; only their rest is placed.

When the partition ends, the windows still open are laid end to end and cut into full sequences, and the last part into
sequences of powers of two, which need no padding. So every sequence is full or a power of two long. State per task is
the open windows: under one window's length of ids for each open one.

Null texts are empty; an empty document is its end token alone. Rows with null or repeated ids are packed each for
itself. Empty tables give no pieces. Only doc_id and text are read; other columns do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationcast.llm import text as X
from stationcast.llm.common import table
from stationcast.llm.tokens import WordBpe

LENGTH = 4096
END_ID = 2
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long")
#: Sequence numbers of one task.
_PER_TASK = 1 << 36
_tokenizers: dict[str, WordBpe] = {}

#: Piece of a document: its id, where it starts there, the document's length, its ids.
Piece = tuple[int, int, int, np.ndarray]


class SumOfSquares:
    def __init__(self, length: int):
        self.length = length
        self.counts = np.zeros(length + 1, dtype=np.int64)
        self.open: dict[int, list[list[Piece]]] = {}

    def level_for(self, n: int) -> int:
        """The level (0: a new window) from which n more tokens give the least sum of squared counts."""
        levels = np.flatnonzero(self.counts[:self.length - n + 1])
        levels = np.append(levels, 0)
        after = levels + n
        cost = np.where(levels > 0, 1 - 2 * self.counts[levels], 0)
        cost += np.where(after < self.length, 2 * self.counts[after] + 1, 0)
        # Ties go to the fullest window.
        return int(levels[np.flatnonzero(cost == cost.min())].max())

    def place(self, piece: Piece) -> list[Piece] | None:
        """Puts a piece of at most one window; returns the window if that filled it."""
        level = self.level_for(len(piece[3]))
        window: list[Piece] = []
        if level:
            window = self.open[level].pop()
            self.counts[level] -= 1
        window.append(piece)
        level += len(piece[3])
        if level == self.length:
            return window
        self.open.setdefault(level, []).append(window)
        self.counts[level] += 1
        return None

    def rest(self) -> Iterator[list[Piece]]:
        """The open windows end to end, cut to full sequences and powers of two."""
        pieces = [p for level in sorted(self.open, reverse=True) for w in self.open[level] for p in w]
        left = sum(len(p[3]) for p in pieces)
        at = 0
        while left:
            room = size = self.length if left >= self.length else 1 << (left.bit_length() - 1)
            window: list[Piece] = []
            while room:
                doc, start, total, ids = pieces[at]
                window.append((doc, start, total, ids[:room]))
                if len(ids) > room:
                    pieces[at] = (doc, start + room, total, ids[room:])
                else:
                    at += 1
                room -= len(window[-1][3])
            left -= size
            yield window


def _documents(batches, path: str) -> Iterator[tuple[int | None, np.ndarray]]:
    if path not in _tokenizers:
        _tokenizers[path] = WordBpe(path)
    end = np.array([END_ID], dtype=np.uint32)
    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), X.as_texts(batch.column("text"))
        for lo, hi in X.slices(texts, 1 << 20):
            for doc, t in zip(ids[lo:hi], _tokenizers[path].texts(texts.slice(lo, hi - lo).to_pylist())):
                yield doc, np.concatenate([t, end])


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """One row per piece of (doc_id, text); ``with_ids`` adds its token ids as little-endian 32-bit numbers."""
    def run(batches):
        packer, sequence = SumOfSquares(length), TaskContext.get().partitionId() * _PER_TASK
        rows: list[tuple] = []

        def emit():
            columns = [pa.array(c, pa.int64()) for c in zip(*(r[:7] for r in rows))]
            if with_ids:
                columns.append(pa.array([r[7] for r in rows], pa.binary()))
            names = [f.split()[0] for f in schema.split(", ")]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        def close(window: list[Piece]) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, total, ids in window:
                raw = ids.astype("<u4").tobytes()
                rows.append((doc, start, len(ids), zlib.crc32(raw), total, sequence, offset, raw if with_ids else None))
                offset += len(ids)
            sequence += 1
        for doc, ids in _documents(batches, tokenizer):
            total = len(ids)
            whole = total - total % length
            for start in range(0, whole, length):
                close([(doc, start, total, ids[start:start + length])])
            if whole < total:
                full = packer.place((doc, whole, total, ids[whole:].copy()))
                if full:
                    close(full)
            if len(rows) >= 5000:
                yield emit()
        for window in packer.rest():
            close(window)
        if rows:
            yield emit()
    schema = SCHEMA + (", ids binary" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
