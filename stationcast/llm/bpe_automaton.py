"""Byte-level BPE as a deterministic automaton.

Compilation starts with one state whose arcs are the 256 bytes, all leading back to it. Each merge (l, r) is one gadget,
applied in merge order: the state that l leads to is copied without its arc r (a hole), l leads to the copy, and
wherever l and then r could be read the joined token becomes an arc to where r led. So every merge makes at most one
state, and all arcs of one label lead to one state (``after``). A state is kept as the holes of its right spine up to the time
each part was used up, and an arc is closed by a hole on its left spine in the same way: all arcs but those exist.

That automaton reads tokens. Over bytes it is determinised: a byte state holds the token that ends here and every (state,
trie place) of a token still being read. Of a state only the tokens below the trie place still matter: where they are few,
states that leave the same of them open are taken as one, and what leaves none open is dropped, so that made-up words need
few byte states of their own. Each prefix of a word is spelled by one path only, so a byte state has one last
token at most. Its transitions are entered in a table when they are first asked for (``MOST_STATES`` at most; then
the table starts anew, with the same results). A word is encoded by one transition per byte, never going back; its tokens are
then read off the last tokens from the end. Decoding emits arc labels: the bytes of each token. Texts are split
into words as the tokenizer file says; the special token's text is its own token.

Null texts are empty and have no tokens. Rows are encoded each for itself, whatever their ids.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from itertools import accumulate
from operator import getitem

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stationcast.llm import text as X
from stationcast.llm.common import table
from stationcast.llm.tokens import LETTERS, NUMBERS, byte_letters

#: The split of the tokenizer file's byte-level step (fixed value), with the letters and numbers that usual texts can have.
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+"
#: Texts with other characters are split by the library, whose Unicode tables decide.
_UNUSUAL = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e\xa0-ɏ]")
MOST_WORDS, MOST_STATES, MOST_MOVES = 600_000, 150_000, 500_000
#: States at a trie place with more tokens below stay apart.
FEW_TOKENS = 16
_NEVER = 1 << 60


class ByteState(dict):
    """A row of the transition table: the next state by byte, entered when it is first asked for."""

    __slots__ = ("machine", "last", "reading")

    def __init__(self, machine: TokenAutomaton, last: int, reading: tuple[int, ...]):
        super().__init__()
        self.machine, self.last, self.reading = machine, last, reading

    def __missing__(self, c: int) -> ByteState:
        state = self[c] = self.machine.enter(self.reading, c)
        return state


class TokenAutomaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        letters = byte_letters()
        self.label = {i: bytes(letters[c] for c in s) for s, i in vocab.items() if all(c in letters for c in s)}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        self.holes: dict[int, dict[int, int]] = {}
        #: The state that each token's arcs lead to; states are numbered as gadgets make them.
        self.after = {i: 0 for i, b in self.label.items() if len(b) == 1}
        states, unread = 1, set()
        for time, (l, r) in enumerate(merges):
            a, b, joined = vocab[l], vocab[r], vocab[l + r]
            # The gadget needs a path l, r at this moment; without one the joined token can never be read.
            if joined in self.made or a in unread or b in unread or not self._open(a, b):
                if joined not in self.made:
                    unread.add(joined)
                continue
            self.holes.setdefault(a, {})[b] = time
            self.parts[joined], self.made[joined] = (a, b), time
            self.after[joined] = self.after[b]
            self.after[a], states = states, states + 1
        #: Tokens that end alike lead to one state, for which one of them stands.
        self.stands = {state: token for token, state in self.after.items()}
        #: A word's start is read as if after a state of its own, which has all arcs.
        self.stands[states] = None
        self.size = {token: len(self.label[token]) for token in self.after}
        self.child: dict[int, int] = {}
        self.ends: list[int] = [-1]
        for token in self.after:
            node = 0
            for c in self.label[token]:
                key = node << 8 | c
                node = self.child.get(key, 0)
                if not node:
                    node = self.child[key] = len(self.ends)
                    self.ends.append(-1)
            self.ends[node] = token
        #: The tokens below each trie place: none, a few, or (None) more than that.
        self.below: list[tuple[int, ...] | None] = [()] * len(self.ends)
        for key, node in reversed(self.child.items()):
            here, more = self.below[key >> 8], self.below[node]
            if here is not None:
                few = None if more is None else here + more + ((self.ends[node],) if self.ends[node] >= 0 else ())
                self.below[key >> 8] = few if few is None or len(few) <= FEW_TOKENS else None
        #: A token being read is one number: its state above its trie place.
        self.bits = len(self.ends).bit_length()
        self.begun = {token: state << self.bits for token, state in self.after.items()}
        self.first = states << self.bits
        self.states: dict[tuple, ByteState] = {}
        self.moves: dict[int, tuple[int, int]] = {}
        self.alike: dict[tuple[int, ...], int] = {}
        self._clear()

    def _open(self, state: int, arc: int) -> bool:
        """Whether the state after a token still has an arc: no hole on the two spines was made in time."""
        x, used = state, _NEVER
        while True:
            at = self.holes.get(x)
            if at:
                y, until = arc, _NEVER
                while True:
                    time = at.get(y)
                    # The left neighbour's merge comes first among equal ones.
                    if time is not None and time < used and time <= until:
                        return False
                    if y not in self.parts:
                        break
                    until, y = self.made[y], self.parts[y][0]
            if x not in self.parts:
                return True
            used, x = self.made[x], self.parts[x][1]

    def _clear(self) -> None:
        """The table with the start only: nothing read, every token may begin."""
        for state in self.states.values():
            state.clear()
        for kept in (self.states, self.moves, self.alike):
            kept.clear()
        self.start = self._state(-1, (self.first,))

    def _state(self, last: int, reading: tuple[int, ...]) -> ByteState:
        state = self.states.get((last, reading))
        if state is None:
            if len(self.states) >= MOST_STATES:
                # A word that is being read goes on from here; its earlier states stay as long as it needs them.
                self._clear()
            state = self.states[last, reading] = ByteState(self, last, reading)
        return state

    def _move(self, reading: int, c: int) -> tuple[int, int]:
        """A token being read on the byte ``c``: what is being read then (0: nothing), and the token that ends (or -1)."""
        above = reading >> self.bits
        node = self.child.get((reading - (above << self.bits)) << 8 | c)
        if node is None:
            return 0, -1
        left, token, below = self.stands[above], self.ends[node], self.below[node]
        after = above << self.bits | node
        if below is not None:
            # The state matters for the tokens below only: those that leave the same ones open are one.
            still = below if left is None else tuple(t for t in below if self._open(left, t))
            after = self.alike.setdefault((node, *still), after) if still else 0
        return after, token if token >= 0 and (left is None or self._open(left, token)) else -1

    def enter(self, reading: tuple[int, ...], c: int) -> ByteState:
        """The byte state that follows tokens being read on the byte ``c``."""
        last, after, moves = -1, [], self.moves
        for r in reading:
            move = moves.get(r << 8 | c)
            if move is None:
                if len(moves) >= MOST_MOVES:
                    moves.clear()
                move = moves[r << 8 | c] = self._move(r, c)
            if move[0]:
                after.append(move[0])
            # One path only spells what was read, so the first token that is open is the one.
            if move[1] >= 0 > last:
                last = move[1]
        if last >= 0:
            after.append(self.begun[last])
        return self._state(last, tuple(after))

    def encode(self, word: bytes) -> list[int]:
        """The tokens of one word: a transition per byte, then the last token of each prefix that a token begins after."""
        path = list(accumulate(word, getitem, initial=self.start))
        out: list[int] = []
        i, size = len(word), self.size
        while i:
            token = path[i].last
            if token < 0:
                raise ValueError(f"no tokens spell {word!r}")
            out.append(token)
            i -= size[token]
        out.reverse()
        return out

    def decode(self, ids: list[int], special: dict[int, bytes]) -> bytes:
        label = self.label
        try:
            return b"".join(map(label.__getitem__, ids))
        except KeyError:
            return b"".join(label[i] if i in label else special[i] for i in ids)


class KeptWords(dict):
    """What ``find`` says of a word, kept in two halves: words of the older half that are not met again go first."""

    def __init__(self, find: Callable[[str], tuple[str, bytes]]):
        super().__init__()
        self.find, self.older = find, {}

    def __missing__(self, w: str) -> tuple[str, bytes]:
        if len(self) >= MOST_WORDS // 2:
            self.older = dict(self)
            self.clear()
        found = self[w] = self.older.pop(w, None) or self.find(w)
        return found


class ByteBpe:
    """A tokenizer file's byte-level BPE: words are split, encoded by the automaton, and kept by word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = TokenAutomaton(model["vocab"], merges)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = {i: s.encode() for s, i in self.special.items()}
        self.numbers = {i: str(i) for i in self.automaton.label}
        self.library = Tokenizer.from_file(path)
        self.split = re.compile(SPLIT).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")"
                              ).split if self.special else (lambda t: [t])
        self.kept = KeptWords(self.word)

    def words(self, text: str) -> list[bytes] | list[str]:
        if not _UNUSUAL.search(text):
            return self.split(text)
        letters = byte_letters()
        return [bytes(letters[c] for c in w).decode("utf-8", "surrogateescape")
                for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def word(self, w: str) -> tuple[str, bytes]:
        """The ids of a word's tokens as text, and the bytes their labels spell."""
        ids = self.automaton.encode(w.encode("utf-8", "surrogateescape"))
        return ",".join(map(self.numbers.__getitem__, ids)), self.automaton.decode(ids, self.labels)

    def encoded(self, text: str) -> tuple[int, str, bytes]:
        """How many tokens a text has, their ids as text, and the bytes their labels spell."""
        parts: list[tuple[str, bytes]] = []
        for piece in self.cut(text):
            if piece in self.special:
                i = self.special[piece]
                parts.append((str(i), self.labels[i]))
            elif piece:
                parts += map(self.kept.__getitem__, self.words(piece))
        if not parts:
            return 0, "", b""
        words, labels = zip(*parts)
        ids = ",".join(words)
        return ids.count(",") + 1, ids, b"".join(labels)


_models: dict[str, ByteBpe] = {}
SCHEMA = "n_tokens long, ids string, decoded string"


def encode_texts(docs: DataFrame, tokenizer: str, digests: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids as decimal numbers joined by commas; ``digests``: their SHA-256 instead."""
    def shown(raw: bytes) -> str:
        return hashlib.sha256(raw).hexdigest() if digests else raw.decode()

    def run(batches) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _models:
            _models[tokenizer] = ByteBpe(tokenizer)
        model = _models[tokenizer]
        for batch in batches:
            texts = X.as_texts(batch.column("text"))
            for lo, hi in X.slices(texts):
                rows = []
                for t in texts.slice(lo, hi - lo).to_pylist():
                    n, ids, raw = model.encoded(t)
                    rows.append((n, shown(ids.encode()), shown(raw.decode("utf-8", "replace").encode())))
                n, ids, decoded = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(ids, pa.string()),
                     pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + SCHEMA)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), digests=True)
    return found.select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))
