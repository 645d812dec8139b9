"""Secret scans: fixed patterns, and a character convolutional network over every other long candidate.

``base_spans`` are the matches of three fixed patterns. Every other run of at least 16 token characters is a candidate. A
small convolutional network in numpy reads each candidate with its surrounding characters and gives a score; candidates
whose calibrated score reaches the threshold are added as ``learned`` spans. Base spans always stay; what they leave of a
run is a candidate where it is long enough. A candidate longer than the network's window is read in windows every
``STEP`` characters and, besides, part by part between its signs; it scores as the highest of them.

The network is fitted on findings: base spans (positive) and other candidates (unlabelled, taken as negative though
some are secrets that no pattern catches). Every distinct finding of all documents takes part. Half of each kind are read with
the context blanked, so that the characters themselves must tell. Half of the findings fit the weights, the others calibrate
the score (logistic scaling). The fit deals its half to chunks of about ``CHUNK``; in each of ``EPOCHS`` passes every chunk
goes on from the common weights by gradient steps over all its findings, the rarer kind repeated to the number of
the other, and the common weights become the mean over the chunks. Where a kind has fewer than ``LEAST`` findings for
every chunk, its findings go to several chunks. The threshold is the highest that still finds
``RECALL`` of the held-out positives without their context, as a secret without a keyword stands. Candidates
never raise it, since those with high scores may be such secrets. A candidate's score is the greater of those with and
without its context. ``recall`` and ``flagged`` of the network are the shares of held-out positives and candidates at
the threshold. Without two different findings of each kind nothing is learned and no span is added.

Offsets are code points, ends exclusive. Null texts are empty; rows with null or repeated ids are scanned each for
itself. Empty tables give empty results.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationcast.llm import text as X
from stationcast.llm.common import materialize, table
from stationcast.operators.quantiles import value_at_rank

KINDS = ("assign", "access", "hex", "learned")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-][A-Za-z0-9+/_.=-]{15,}")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CHUNK, LEAST, EPOCHS = 4096, 64, 12
RECALL = 0.95
#: Characters read: before the candidate, of itself, after it; windows of longer candidates start so far apart.
BEFORE, BODY, AFTER, STEP = 16, 48, 8, 16
LENGTH = BEFORE + BODY + AFTER
#: Parts of long candidates: between signs that divide paths, chains and names.
_PARTS = [re.compile(f"[A-Za-z0-9{signs}]{{16,}}") for signs in ("", "+/", "_-")]
WIDTH, FILTERS = 5, 16

Span = tuple[int, int, int]


def _alphabet() -> np.ndarray:
    """Character classes by code: kinds of letters and digits, and each common sign for itself."""
    table = np.full(256, 19, dtype=np.uint8)
    for k, chars in enumerate(("abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "0123456789",
                               " \t", "\n\r", "\"'", "=", ":", "/", "+", "-", "_", ".", "@", ",;", "()[]{}<>"), 1):
        table[[ord(c) for c in chars]] = k
    table[0] = 0
    return table


_CLASSES = _alphabet()
N_CLASSES = 20


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the fixed patterns, by start and then by kind."""
    spans: list[Span] = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        spans += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], s[2]))


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Long runs of token characters outside base spans; a run is cut where a base span lies in it."""
    found, at = [], 0
    for a, b, _ in [*base, (len(text), len(text), 0)]:
        if a - at >= 16:
            found += [m.span() for m in _CANDIDATE.finditer(text, at, a)]
        at = max(at, b)
    return found


def window(text: str, a: int, b: int) -> bytes:
    """At most BODY characters text[a:b] with what stands beside them, as Latin-1 codes, zero where there are none."""
    parts = (text[max(0, a - BEFORE):a].rjust(BEFORE, "\0"), text[a:b].ljust(BODY, "\0"),
             text[b:b + AFTER].ljust(AFTER, "\0"))
    return "".join(parts).encode("latin-1", "replace")


def windows(text: str, a: int, b: int) -> list[bytes]:
    """What the network reads of the candidate text[a:b]: all of it, in windows that overlap where it is long."""
    if b - a <= BODY:
        return [window(text, a, b)]
    places = [(p, p + BODY) for p in range(a, b - BODY, STEP)] + [(b - BODY, b)]
    for pattern in _PARTS:
        places += [m.span() for m in pattern.finditer(text, a, b) if m.end() - m.start() <= BODY]
    return [window(text, p, q) for p, q in dict.fromkeys(places)]


def bare(w: bytes) -> bytes:
    """A window with its context blanked."""
    return bytes(BEFORE) + w[BEFORE:LENGTH - AFTER] + bytes(AFTER)


def _one_hot(windows: list[bytes]) -> np.ndarray:
    codes = _CLASSES[np.frombuffer(b"".join(windows), dtype=np.uint8).reshape(len(windows), LENGTH)]
    return np.eye(N_CLASSES, dtype=np.float32)[codes]


@dataclass
class Network:
    """One convolution over one-hot characters, maximum and mean over all places, a logistic output."""

    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    offset: float
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 2.0
    recall: float = 0.0
    flagged: float = 0.0
    #: How many findings the last pass fitted the weights to (those in several chunks as often) and how many calibrate.
    fitted: int = 0
    held: int = 0

    @staticmethod
    def start(rng: np.random.Generator) -> Network:
        return Network(rng.normal(0, 0.2, (WIDTH * N_CLASSES, FILTERS)).astype(np.float32),
                       np.zeros(FILTERS, np.float32), rng.normal(0, 0.2, 2 * FILTERS).astype(np.float32), 0.0)

    def _patches(self, x: np.ndarray) -> np.ndarray:
        steps = LENGTH - WIDTH + 1
        return np.concatenate([x[:, k:k + steps] for k in range(WIDTH)], axis=2)

    def forward(self, x: np.ndarray):
        patches = self._patches(x)
        act = np.maximum(patches @ self.kernel + self.bias, 0)
        top = act.argmax(axis=1)
        feats = np.concatenate([act.max(axis=1), act.mean(axis=1)], axis=1)
        return patches, act, top, feats, feats @ self.out + self.offset

    def flat(self) -> np.ndarray:
        """All weights as one array of doubles."""
        return np.concatenate([self.kernel.ravel(), self.bias, self.out, [self.offset]]).astype(np.float64)

    @staticmethod
    def of(flat: np.ndarray) -> Network:
        kernel, bias, out, offset = np.split(flat.astype(np.float32), np.cumsum(
            [WIDTH * N_CLASSES * FILTERS, FILTERS, 2 * FILTERS]))
        return Network(kernel.reshape(-1, FILTERS), bias, out, float(offset[0]))

    def epoch(self, windows: list[bytes], y: np.ndarray, rng: np.random.Generator, rate: float = 0.05) -> None:
        """Gradient steps over all windows, those of the rarer label as often as the others."""
        sides = [rng.permutation(np.flatnonzero(y == k)) for k in (0, 1)]
        most = max(map(len, sides))
        order = rng.permutation(np.concatenate([np.resize(s, most) for s in sides if len(s)]))
        for lo in range(0, len(order), 64):
            at = order[lo:lo + 64]
            patches, act, top, feats, z = self.forward(_one_hot([windows[i] for i in at]))
            d = (1 / (1 + np.exp(-z)) - y[at]) / len(at)
            d_out = feats.T @ d
            d_feats = np.outer(d, self.out)
            d_act = np.repeat(d_feats[:, None, FILTERS:] / act.shape[1], act.shape[1], axis=1)
            rows = np.arange(len(at))[:, None]
            d_act[rows, top, np.arange(FILTERS)[None, :]] += d_feats[:, :FILTERS]
            d_act *= act > 0
            flat = d_act.reshape(-1, FILTERS)
            self.kernel -= rate * (patches.reshape(len(flat), -1).T @ flat)
            self.bias -= rate * flat.sum(axis=0)
            self.out -= rate * d_out
            self.offset -= rate * float(d.sum())

    def calibrated(self, windows: list[bytes]) -> np.ndarray:
        out = []
        for lo in range(0, len(windows), 512):
            z = self.forward(_one_hot(windows[lo:lo + 512]))[-1]
            out.append(1 / (1 + np.exp(-(self.scale * z.astype(np.float64) + self.shift).clip(-700, 700))))
        return np.concatenate(out) if out else np.zeros(0)

    def score(self, windows: list[bytes]) -> np.ndarray:
        """The greater score of each window with and without its context."""
        # Many windows hold the same characters in other contexts.
        alone = [bare(w) for w in windows]
        distinct = list(dict.fromkeys(alone))
        of = dict(zip(distinct, self.calibrated(distinct)))
        return np.maximum(self.calibrated(windows), np.array([of[w] for w in alone], dtype=np.float64))


def _findings(batches):
    """Windows of base spans (label 1) and of other candidates (label 0), with a hash that orders them."""
    for batch in batches:
        rows: list[tuple[bytes, int]] = []
        for t in X.as_texts(batch.column("text")).to_pylist():
            base = base_spans(t)
            values = sorted({_value(t, s) for s in base})
            rows += [(w, 1) for a, b in values for w in windows(t, a, b)]
            rows += [(w, 0) for a, b in candidates(t, base) for w in windows(t, a, b)]
        if rows:
            w, y = zip(*set(rows))
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(y, pa.int32())], names=["w", "label"])


def _value(text: str, span: Span) -> tuple[int, int]:
    """The secret itself: an assignment's right side, else the whole span."""
    a, b, kind = span
    return _ASSIGN.match(text, a).span(2) if kind == 0 else (a, b)


def _pass(net: Network, seed: int, number: int):
    """A pass over one chunk: the weights after it, and the number of findings."""
    def run(found: pa.Table) -> pa.Table:
        found = found.sort_by([("o", "ascending"), ("w", "ascending"), ("label", "ascending")])
        y = found.column("label").to_numpy().astype(np.float32)
        # Every other window is read without its context.
        alone = found.column("o").to_numpy() & 1
        read = [bare(w) if k else w for w, k in zip(found.column("w").to_pylist(), alone)]
        mine = Network.of(net.flat())
        mine.epoch(read, y, np.random.default_rng([seed, number, found.column("chunk")[0].as_py()]))
        return pa.table({"n": pa.array([len(y)]), "weights": pa.array([mine.flat()], pa.list_(pa.float64()))})
    return run


def _raw_scores(batches, net: Network):
    """Per held-out finding the raw scores: as the fit would read it, with its context and without."""
    for batch in batches:
        read, y, o = batch.column("w").to_pylist(), batch.column("label"), batch.column("o").to_numpy()
        for lo in range(0, len(read), 512):
            part = read[lo:lo + 512]
            full, alone = (net.forward(_one_hot(w))[-1].astype(np.float64) for w in (part, [bare(w) for w in part]))
            yield pa.RecordBatch.from_arrays(
                [y.slice(lo, len(part)), pa.array(np.where(o[lo:lo + 512] & 1, alone, full)), pa.array(full), pa.array(alone)],
                names=["label", "z", "full", "alone"])


def _calibrate(net: Network, scores: DataFrame) -> None:
    """Logistic scaling of the raw score by Newton steps, with a small ridge; each step is one sum over all scores."""
    w = np.array([1.0, 0.0])
    for _ in range(25):
        z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("z") * float(w[0]) + float(w[1])))
        p = 1 / (1 + F.exp(-z))
        miss, curve = p - F.col("label"), p * (1 - p)
        r = scores.agg(*(F.sum(x) for x in (miss * F.col("z"), miss, curve * F.col("z") * F.col("z"), curve * F.col("z"),
                                            curve))).first()
        step = np.linalg.solve(np.array([[r[2], r[3]], [r[3], r[4]]]) + 1e-2 * np.eye(2), np.array(r[:2]) + 1e-2 * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    net.scale, net.shift = float(w[0]), float(w[1])


def train(docs: DataFrame, seed: int = 7) -> Network | None:
    """The fitted network, or None where the documents do not hold two different findings of each kind."""
    found = materialize(docs.select("text").mapInArrow(_findings, "w binary, label int").distinct()
                        .withColumn("o", F.xxhash64("w", F.lit(seed))))
    # The first bit of the hash that divides a kind holds the half out of the fit.
    bits = range(8, 40)

    def bit(b: int):
        return F.shiftright("o", b).bitwiseAND(1)
    counts = {r["label"]: r for r in found.groupBy("label").agg(F.count("*").alias("n"), *(
        F.sum(bit(b)).alias(f"b{b}") for b in bits)).collect()}
    by = {k: next((b for b in bits if 0 < r[f"b{b}"] < r["n"]), None) for k, r in counts.items()}
    if by.get(0) is None or by.get(1) is None:
        return None
    out = {k: counts[k][f"b{by[k]}"] for k in (0, 1)}
    fit = {k: counts[k]["n"] - out[k] for k in (0, 1)}
    held = F.when(F.col("label") == 1, bit(by[1])).otherwise(bit(by[0])) == 1
    chunks = -(-sum(fit.values()) // CHUNK)
    copies = [min(chunks, -(-LEAST * chunks // fit[k])) for k in (0, 1)]
    dealt = found.where(~held).withColumn("j", F.explode(F.sequence(F.lit(0), F.when(
        F.col("label") == 1, copies[1]).otherwise(copies[0]) - 1)))
    dealt = materialize(dealt.select("w", "label", "o", F.pmod(F.shiftright("o", 40) + F.col("j"), F.lit(chunks)).alias("chunk")))
    net = Network.start(np.random.default_rng(seed))
    for number in range(EPOCHS):
        # A fixed number of partitions: there is much arithmetic in few bytes.
        fitted = dealt.repartition(chunks, "chunk").groupBy("chunk").applyInArrow(
            _pass(net, seed, number), "n long, weights array<double>")
        mean = (fitted.select("n", F.posexplode("weights").alias("i", "w")).groupBy("i")
                .agg(F.sum(F.col("n") * F.col("w")).alias("w"), F.sum("n").alias("n")).collect())
        net = Network.of(np.array([r["w"] / r["n"] for r in sorted(mean)]))
    net.fitted, net.held = mean[0]["n"], sum(out.values())
    scores = materialize(found.where(held).mapInArrow(
        lambda batches: _raw_scores(batches, net), "label int, z double, full double, alone double"))
    _calibrate(net, scores)
    scores = scores.select("label", (F.col("alone") * net.scale + net.shift).alias("alone"),
                           (F.col("full") * net.scale + net.shift).alias("full"))
    least = value_at_rank(scores.where("label = 1"), "alone", int(np.floor((1 - RECALL) * out[1])), out[1])
    net.threshold = float(1 / (1 + np.exp(-np.float64(least).clip(-700, 700))))
    row = scores.agg(F.count_if((F.col("label") == 1) & (F.col("alone") >= least)),
                     F.count_if((F.col("label") == 0) & (F.greatest("alone", "full") >= least))).first()
    net.recall, net.flagged = row[0] / out[1], row[1] / out[0]
    return net


def _highest(net: Network | None, asked: list[list[bytes]]) -> list[float]:
    """Per candidate the highest score of its windows; the same characters in the same context are scored once."""
    if net is None or not asked:
        return []
    distinct = list(dict.fromkeys(w for ws in asked for w in ws))
    scores = dict(zip(distinct, net.score(distinct).tolist()))
    return [max(scores[w] for w in ws) for ws in asked]


def scan(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, spans) per row of (doc_id, text): an array of (start, end, kind), base and learned."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = X.as_texts(batch.column("text"))
            for lo, hi in X.slices(texts):
                found, asked, where = [], [], []
                for i, t in enumerate(texts.slice(lo, hi - lo).to_pylist()):
                    base = base_spans(t)
                    found.append(base)
                    if model is not None:
                        for a, b in candidates(t, base):
                            asked.append(windows(t, a, b))
                            where.append((i, a, b))
                for (i, a, b), p in zip(where, _highest(model, asked)):
                    if p >= model.threshold:
                        found[i].append((a, b, 3))
                spans = [[{"start": a, "end": b, "kind": KINDS[k]} for a, b, k in sorted(s, key=lambda s: (s[0], s[2]))]
                         for s in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(spans, pa.list_(pa.struct(
                        [("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])))],
                    names=["doc_id", "spans"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, spans array<struct<start:long,end:long,kind:string>>")


def redact(docs: DataFrame, net: Network | None, mark: str = "[SECRET]") -> DataFrame:
    """The rows with every span of ``text`` replaced by a mark; overlapping spans become one."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    schema = docs.schema

    def run(batches):
        model = shared.value
        for batch in batches:
            out = []
            for t in batch.column("text").to_pylist():
                if t is None:
                    out.append(None)
                    continue
                spans = [(a, b) for a, b, _ in base_spans(t)]
                if model is not None:
                    asked = candidates(t, [(a, b, 0) for a, b in spans])
                    scores = _highest(model, [windows(t, a, b) for a, b in asked])
                    spans += [s for s, p in zip(asked, scores) if p >= model.threshold]
                if spans:
                    parts, at = [], 0
                    for a, b in sorted(spans):
                        if a >= at:
                            parts += [t[at:a], mark]
                        at = max(at, b)
                    t = "".join(parts) + t[at:]
                out.append(t)
            k = batch.schema.names.index("text")
            yield batch.set_column(k, "text", pa.array(out, pa.string()))
    return docs.mapInArrow(run, schema)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, train(docs))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != KINDS[-1])
    return found.select("doc_id", *(count(k) for k in KINDS[:-1]), F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"), count(KINDS[-1]))
