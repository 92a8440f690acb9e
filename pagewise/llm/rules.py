"""Quality rules: counted limits, then a hashed n-gram logistic regression.

Features of a text are its words, pairs of neighbouring words and runs of
``CHAR_N`` characters, hashed into ``2**BITS`` slots; each of the three kinds
has the share of its occurrences as value, so a whole text of any length is
read in one pass and in bounded pieces. The weights are fitted by iterative
parameter mixing over labelled rows: in every round each part of them takes
stochastic gradient steps from the common weights, which are then averaged. The
margin is calibrated to a probability on labelled rows that the weights have not
seen (Platt scaling), and Arrow batches are scored against fixed thresholds.

Batches are cut into slices of about ``SLICE_BYTES`` (a longer text is a slice
of its own); everything inside a slice is array work.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewise.llm.common import is_held_out
from pagewise.session import cut_lineage

BITS = 18
CHAR_N = 4
SCALE = 16.0  # of the feature values; sets what one unit of RIDGE means
RIDGE = 1e-3  # share that the weights lose in an epoch
PARTS = 16  # of the training rows, by a hash of the id; one round returns PARTS weight vectors
ROUNDS = 6
EPOCHS = 3  # over a part, in one round
RATE = 0.5
MAX_ROWS = 10_000  # labelled rows that the model is fitted on, chosen by a hash of the id where there are more
CALIBRATION = (5, 0)  # rows of this remainder calibrate, the others give the weights
SLICE_BYTES = 1 << 20
SEED = 29

# fixed values: limits of the counted rules and thresholds of the probability
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
KEEP_FROM = 0.3
GOOD_FROM = 0.7

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_CHAR = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    """Slot of each 64-bit value."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xA0761D6478BD642F)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def _codes(values: np.ndarray) -> np.ndarray:
    """Small codes of 64-bit values, equal for equal values."""
    return pa.array(values).dictionary_encode().indices.to_numpy().astype(np.int64)


def _binary(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1,
                                 [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


@dataclass
class Slice:
    """Words, lines and characters of some texts, laid end to end."""
    data: np.ndarray  # bytes
    bounds: np.ndarray  # of the texts in data

    def __post_init__(self) -> None:
        self.n = len(self.bounds) - 1
        blank = _BLANK[self.data]
        first = np.zeros(len(self.data) + 1, bool)
        first[self.bounds] = True
        inside = ~blank
        before = np.empty(len(blank), bool)
        before[:1] = True
        before[1:] = blank[:-1]
        starts = np.flatnonzero(inside & (before | first[:-1]))
        self.word_doc = np.searchsorted(self.bounds, starts, "right") - 1
        self._inside = np.concatenate([[0], np.cumsum(inside)])  # non-blank bytes before each place
        if len(starts):
            encoded = _binary(np.append(self._inside[starts], self._inside[-1]), self.data[inside]).dictionary_encode()
            self.word = encoded.indices.to_numpy().astype(np.int64)
            self.words = encoded.dictionary
        else:
            self.word, self.words = np.zeros(0, np.int64), pa.array([], pa.large_binary())

    def _per_text(self, flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]

    def counts(self) -> dict[str, np.ndarray]:
        data = self.data
        return {"n_words": np.bincount(self.word_doc, minlength=self.n),
                "word_chars": self._per_text(_CHAR[data] & ~_BLANK[data]),
                "n_symbols": self._per_text(_SYMBOL[data]),
                "n_dup_lines": self._repeated_lines(),
                "n_repeat_words": self._repeated_words()}

    def _repeated_lines(self) -> np.ndarray:
        new = self.data == 10
        breaks = np.flatnonzero(new)
        starts = np.union1d(self.bounds[:-1], breaks + 1)
        starts = starts[starts < len(self.data)]  # lines after the last byte have no word
        ends = np.append(starts[1:], len(self.data))
        worded = self._inside[ends] > self._inside[starts]
        doc = np.searchsorted(self.bounds, starts, "right") - 1
        place = starts - np.concatenate([[0], np.cumsum(new)])[starts]
        if not len(starts):
            return np.zeros(self.n, np.int64)
        text = _binary(np.append(place, len(self.data) - len(breaks)), self.data[~new])
        line = text.dictionary_encode().indices.to_numpy().astype(np.int64)
        lines = np.bincount(doc[worded], minlength=self.n)
        different = np.unique(doc[worded] << 32 | line[worded]) >> 32
        return lines - np.bincount(different, minlength=self.n)

    def _repeated_words(self) -> np.ndarray:
        """Words in windows of ``WINDOW`` words that their text holds twice or
        more. Windows are compared by codes of pairs, of pairs of pairs and so
        on, which are equal only for equal words."""
        out = np.zeros(self.n, np.int64)
        code, width = self.word, 1
        if len(code) < WINDOW:
            return out
        while width < WINDOW:
            code = _codes(code[:-width] << 32 | code[width:])
            width *= 2
        doc = self.word_doc
        whole = doc[:len(code)] == doc[WINDOW - 1:]
        often = np.bincount(code[whole], minlength=1) > 1
        at = np.flatnonzero(whole)
        at = at[often[code[at]]]
        own = _codes(doc[at] << 32 | code[at])
        at = at[(np.bincount(own, minlength=1) > 1)[own]]
        change = np.zeros(len(doc) + 1, np.int64)
        change[at] += 1
        change[at + WINDOW] -= 1
        return out + np.bincount(doc[np.cumsum(change)[:-1] > 0], minlength=self.n)

    def hashed(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(text, slot)`` of every occurrence, for each kind of feature in bounded pieces."""
        crc = np.fromiter((zlib.crc32(w) for w in self.words.to_pylist()), np.uint64, len(self.words))
        h = crc[self.word] if len(self.word) else np.zeros(0, np.uint64)
        yield self.word_doc, _mix((h + np.uint64(1)) * _MULTIPLIERS[0])
        pair = np.flatnonzero(self.word_doc[:-1] == self.word_doc[1:])
        yield self.word_doc[pair], _mix((h[pair] + np.uint64(2)) * _MULTIPLIERS[1] + h[pair + 1] * _MULTIPLIERS[2])
        yield self._chars()

    def _chars(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(_CHAR[self.data])
        if len(at) < CHAR_N:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        doc = np.repeat(np.arange(self.n), self._per_text(_CHAR[self.data]))
        value = self.data[at].astype(np.uint64)
        size = np.diff(np.append(at, len(self.data)))
        for k in (1, 2, 3):
            more = np.flatnonzero(size > k)
            value[more] |= self.data[at[more] + k].astype(np.uint64) << np.uint64(8 * k)
        h = np.uint64(SEED) + np.zeros(len(at) - CHAR_N + 1, np.uint64)
        for k in range(CHAR_N):
            h += value[k:len(value) - CHAR_N + 1 + k] * _MULTIPLIERS[k]
        whole = doc[:len(h)] == doc[CHAR_N - 1:]
        return doc[:len(h)][whole], _mix(h[whole])

    def margins(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        for doc, slot in self.hashed():
            out += (SCALE * np.bincount(doc, weights[slot], self.n)) / np.maximum(1, np.bincount(doc, minlength=self.n))
        return out

    def vectors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(text, slot, value)`` of all features, ordered by text and slot."""
        keys, values = [], []
        for doc, slot in self.hashed():
            keys.append(doc << BITS | slot)
            values.append(SCALE / np.maximum(1, np.bincount(doc, minlength=self.n))[doc])
        key, place = np.unique(np.concatenate(keys), return_inverse=True)
        return key >> BITS, key & ((1 << BITS) - 1), np.bincount(place, np.concatenate(values), len(key))


def slices(texts: pa.Array, slice_bytes: int = SLICE_BYTES) -> Iterator[Slice]:
    """The texts of a string column in order; nulls are empty texts."""
    column = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + slice_bytes, "right")) - 1)
        yield Slice(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
        a = b


@dataclass
class Model:
    """``probability = sigmoid(slope * margin + shift)``; without weights the
    share of label 1 among the labelled rows."""
    prior: float
    weights: np.ndarray | None = None
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, margins: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(margins), self.prior)
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margins + self.shift, -700, 700)))

    def margins(self, piece: Slice) -> np.ndarray:
        return np.zeros(piece.n) if self.weights is None else piece.margins(self.weights)


def labelled(docs: DataFrame, labels: DataFrame, trainable: Column | None = None, id_col: str = "doc_id",
             text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> DataFrame:
    """``id, text, label`` of about ``max_rows`` labelled ids at most, one row for each."""
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    marks = marks.where(F.col("id").isNotNull() & F.col("label").isin(0, 1))
    marks = marks.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
    n = marks.count()
    if n > max_rows:
        marks = marks.where(F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(1 << 20)) < (1 << 20) * max_rows // n)
    rows = docs if trainable is None else docs.where(trainable)
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # the marks are a sample of at most about max_rows narrow rows: a proven bound for the broadcast
    return rows.join(F.broadcast(marks.select("id", "label")), "id").groupBy("id").agg(
        F.min("text").alias("text"), F.min("label").alias("label"))


def _features(rows: DataFrame) -> DataFrame:
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a = 0
            for s in slices(b["text"]):
                doc, slot, value = s.vectors()
                ends = pa.array(np.searchsorted(doc, np.arange(s.n + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b["part"].slice(a, s.n), b["place"].slice(a, s.n), b["calibrates"].slice(a, s.n),
                     b["label"].slice(a, s.n), pa.ListArray.from_arrays(ends, pa.array(slot.astype(np.int32))),
                     pa.ListArray.from_arrays(ends, pa.array(value))],
                    ["part", "place", "calibrates", "label", "slots", "shares"])
                a += s.n
    place = F.xxhash64(F.lit(SEED + 1), "id")
    rows = rows.select(F.pmod(place, F.lit(PARTS)).cast("int").alias("part"), place.alias("place"),
                       is_held_out(F.col("id"), *CALIBRATION).alias("calibrates"), "label", "text")
    rows = rows.repartition(PARTS, "part").sortWithinPartitions("part", "place")
    return rows.mapInArrow(describe, "part int, place long, calibrates boolean, label int, slots array<int>, "
                                     "shares array<double>")


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """``(part, [(slots, shares, label)])``; the rows of a part are in one file."""
    part, rows = None, []
    for b in batches:
        slots, shares = b["slots"], b["shares"]
        bounds, slot, share = slots.offsets.to_numpy(), slots.values.to_numpy(), shares.values.to_numpy()
        for i, (p, label) in enumerate(zip(b["part"].to_pylist(), b["label"].to_pylist(), strict=True)):
            if p != part:
                if rows:
                    yield part, rows
                part, rows = p, []
            rows.append((slot[bounds[i]:bounds[i + 1]], share[bounds[i]:bounds[i + 1]], label))
    if rows:
        yield part, rows


def steps(rows: list, weights: np.ndarray, bias: float, rate: float) -> tuple[np.ndarray, float]:
    """Weights after ``EPOCHS`` passes of gradient steps; a step is never longer
    than the one that would bring the margin of its row to rest."""
    w = weights.copy()
    squares = [float(x @ x) + 1.0 for _, x, _ in rows]
    for _ in range(EPOCHS):
        for (slot, x, label), square in zip(rows, squares, strict=True):
            margin = float(w[slot] @ x) + bias
            step = min(rate, 4.0 / square) * (label - 1.0 / (1.0 + np.exp(-min(max(margin, -50.0), 50.0))))
            w[slot] += step * x
            bias += step
        w *= 1.0 - RIDGE
    return w, bias


def train(rows: DataFrame) -> tuple[np.ndarray, float]:
    """Weights and bias from a stored table of ``_features``."""
    weights, bias = np.zeros(1 << BITS), 0.0
    for k in range(ROUNDS):
        def run(batches: Iterator[pa.RecordBatch], weights=weights, bias=bias,
                rate=RATE / (1 + k)) -> Iterator[pa.RecordBatch]:
            for part, examples in _examples(batches):
                w, c = steps(examples, weights, bias, rate)
                yield pa.RecordBatch.from_pydict({"part": [part], "n": [len(examples)], "bias": [c],
                                                  "weights": [w.astype(np.float32).tobytes()]})
        mixed = rows.mapInArrow(run, "part long, n long, bias double, weights binary").collect()  # PARTS rows
        mixed.sort(key=lambda r: r["part"])
        n = sum(r["n"] for r in mixed)
        weights = sum(np.frombuffer(r["weights"], np.float32).astype(float) * (r["n"] / n) for r in mixed)
        bias = sum(r["bias"] * r["n"] for r in mixed) / n
    return weights, bias


def platt(margins: np.ndarray, labels: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and shift of the logistic curve through ``(margin, label)``, by Newton steps."""
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    at = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ at, -50, 50)))
        gradient = x.T @ (p - labels) + ridge * (at - [1.0, 0.0])
        curvature = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
        step = np.linalg.solve(curvature, gradient)
        at = at - step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
    return float(at[0]), float(at[1])


def fit(docs: DataFrame, labels: DataFrame, trainable: Column | None = None, id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """Learn from the labelled rows where ``trainable`` (over ``id_col``) holds.

    One row for each labelled id is used: the least text of those that repeat;
    ids that are null or carry both labels, and labels other than 0 and 1, are
    not. With fewer than two rows of either label the model is the share of
    label 1 (0.5 without any row); where the rows kept for calibration hold one
    label only, the probability is that of the uncalibrated regression.
    """
    rows = cut_lineage(_features(labelled(docs, labels, trainable, id_col, text_col, label_col, max_rows)), "ngrams",
                       partition_by=("part",))
    seen = {(r["calibrates"], r["label"]): r["n"] for r in
            rows.groupBy("calibrates", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    of = [sum(seen.get((c, k), 0) for c in (False, True)) for k in (0, 1)]
    prior = (of[1] + 0.5) / (sum(of) + 1)
    if min(seen.get((False, k), 0) for k in (0, 1)) < 2:
        return Model(prior)
    weights, bias = train(rows.where("NOT calibrates"))
    if min(seen.get((True, k), 0) for k in (0, 1)) < 2:
        return Model(prior, weights, 1.0, bias)

    @F.arrow_udf("double")
    def margin(slots: pa.Array, shares: pa.Array) -> pa.Array:
        bounds = slots.offsets.to_numpy()
        total = np.concatenate([[0.0], np.cumsum(weights[slots.values.to_numpy()] * shares.values.to_numpy())])
        return pa.array(total[bounds[1:]] - total[bounds[:-1]] + bias)

    # a fifth of at most about max_rows pairs of numbers
    scored = rows.where("calibrates").select("place", "label", margin("slots", "shares").alias("margin")).collect()
    scored.sort()
    slope, shift = platt(np.array([r["margin"] for r in scored]), np.array([r["label"] for r in scored], float))
    return Model(prior, weights, slope, slope * bias + shift) if slope > 0 else Model(prior, weights, 1.0, bias)


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          keep_from: float = KEEP_FROM, good_from: float = GOOD_FROM) -> DataFrame:
    """``id_col``, the five counts of ``COUNTS``, ``base_failed``, ``probability``
    of label 1, ``verdict`` ('good', 'fair' or 'poor' by the two thresholds) and
    ``kept`` (neither ``base_failed`` nor 'poor') of every row.

    Defined results: null and empty texts have no words and fail the base rules;
    repeated rows stay and get equal results; rows with a null id are judged;
    other columns are not read; an empty table gives an empty result. Lines and
    windows of equal count are all found, in texts of any length.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a = 0
            for s in slices(b["text"]):
                counts = s.counts()
                p = model.probability(model.margins(s))
                failed = (counts["n_words"] < MIN_WORDS) | (
                    100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])
                verdict = np.where(p >= good_from, "good", np.where(p >= keep_from, "fair", "poor"))
                yield pa.RecordBatch.from_arrays(
                    [b["id"].slice(a, s.n), *[pa.array(counts[c].astype(np.int64)) for c in COUNTS], pa.array(failed),
                     pa.array(p), pa.array(verdict.tolist(), pa.string()), pa.array(~failed & (p >= keep_from))],
                    [id_col, *COUNTS, "base_failed", "probability", "verdict", "kept"])
                a += s.n
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, {', '.join(c + ' long' for c in COUNTS)}, base_failed boolean, "
                                "probability double, verdict string, kept boolean")
