"""Language identification by a linear-chain conditional random field.

Words (runs of letters, lower-cased) are the positions, languages the labels.
A word's score for a label is the sum of learned weights of its hashed
features: prefixes and suffixes of one to three letters, letter bigrams and
trigrams, its entry in the lexicon of words seen repeatedly in training (or the
fact that it has none) and its length. Learned transition weights join
neighbouring words. Forward-backward gives every word its label marginals, so
the words of a code-switched text are labelled one by one; a text's language is
the label with the largest expected share of its words, and the score is that
share.

Training uses a bounded sample: of each label at most about ``sample_docs``
documents of at most ``SAMPLE_CHARS`` characters, chosen by a hash of the id,
and ``SAMPLE_WORDS`` words of them. Spans of different labels are strung
together to sequences, so that transitions are learned from switched text.
Scoring reads whole texts.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_DOCS = 250
SAMPLE_CHARS = 20_000
SAMPLE_WORDS = 12_000
MAX_LABELS = 400
FEATURE_BITS = 16
LEXICON_COUNT = 3
SEQUENCE_WORDS = 32
EPOCHS = 10
CACHE_WORDS = 300_000  # words whose scores a Python worker remembers
CELLS = 500_000  # words that one forward-backward sweep covers
UNKNOWN = "und"
MIN_SHARE = 0.35  # below this share of words in one language, a text is rejected

_LETTERS = re.compile(r"[^\W\d_]+")


def letter_words(text: str | None) -> list[str]:
    """Lower-cased letter runs; empty if no character is a letter."""
    found = _LETTERS.findall(text.lower()) if text else []
    return found if any(c.isalpha() for w in found for c in w) else []


def _bucket(*codes: np.ndarray) -> np.ndarray:
    h = np.full(codes[0].shape, len(codes), np.uint32)
    for c in codes:
        h = (h ^ c) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return h & np.uint32((1 << FEATURE_BITS) - 1)


def features(words: list[str], lexicon: frozenset[str] | set[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature buckets of (non-empty) words: arrays with a row for each letter of
    the marked words (bigrams and trigrams, which at the marks are one- and
    two-letter affixes; ``1 << FEATURE_BITS`` where a gram would leave its word)
    and with a row for each word (three-letter affixes, lexicon entry, length);
    and the marked words' starts."""
    code = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "replace"), np.uint32)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(size)
    starts = ends - size
    room = np.repeat(ends, size) - np.arange(len(code))  # letters up to the end of the word
    far = np.r_[code, np.zeros(3, np.uint32)]
    grams = []
    for n in (2, 3):
        ids = _bucket(*[far[k:k + len(code)] for k in range(n)])
        grams.append(np.where(room >= n, ids, np.uint32(1 << FEATURE_BITS)))
    last = np.maximum(ends - 4, starts)
    per_word = [_bucket(*[far[at + k] for k in range(4)]) for at in (starts, last)]
    per_word.append(np.array([zlib.crc32(w.encode("utf-8", "replace")) if w in lexicon else 1 for w in words],
                             np.uint32) & np.uint32((1 << FEATURE_BITS) - 1))
    per_word.append(_bucket(np.minimum(size, 14).astype(np.uint32)))
    return grams + per_word, starts


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # (features + an unused row of zeros) x labels
    moves: np.ndarray  # from label x to label
    lexicon: frozenset[str] = field(default_factory=frozenset)

    def word_scores(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.labels)), np.float32)
        (two, three, *rest), starts = features(words, self.lexicon)
        out = np.add.reduceat(self.weights[two] + self.weights[three], starts, axis=0)
        for ids in rest:
            out += self.weights[ids]
        return out


def marginals(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, keep: bool = True) -> np.ndarray:
    """Forward-backward over sequences sorted by falling length.

    ``scores``: time x sequence x label, padded. Returns the label marginals in
    the same shape (0 in the padding), or their sums over time if not ``keep``.
    """
    steps, count, k = scores.shape
    live = np.searchsorted(-lengths, -np.arange(steps), side="left")  # sequences longer than t
    emit = np.exp(scores - scores.max(axis=2, keepdims=True))
    move = np.exp(moves - moves.max()).astype(emit.dtype)
    alpha = np.empty_like(emit)
    a = emit[0] / emit[0].sum(axis=1, keepdims=True)
    alpha[0] = a
    for t in range(1, steps):
        n = live[t]
        a = (a[:n] @ move) * emit[t, :n]
        a /= a.sum(axis=1, keepdims=True)
        alpha[t, :n] = a
    out = np.zeros((steps, count, k) if keep else (count, k), np.float64)
    beta = np.ones((count, k), emit.dtype)
    for t in range(steps - 1, -1, -1):
        n = live[t]
        if t + 1 < steps and live[t + 1]:
            m = live[t + 1]
            b = (beta[:m] * emit[t + 1, :m]) @ move.T
            beta[:m] = b / b.sum(axis=1, keepdims=True)
        post = alpha[t, :n] * beta[:n]
        post /= post.sum(axis=1, keepdims=True)
        if keep:
            out[t, :n] = post
        else:
            out[:n] += post
    return out


def train(samples: dict[str, list[str]], epochs: int = EPOCHS, seed: int = 7) -> Crf:
    """``samples``: words of each label, in order. AdaGrad on the conditional
    log-likelihood of switched sequences."""
    labels = sorted(samples)
    if not labels:
        return Crf([], np.zeros(((1 << FEATURE_BITS) + 1, 0), np.float32), np.zeros((0, 0), np.float32))
    counts: dict[str, int] = {}
    for ws in samples.values():
        for w in ws:
            counts[w] = counts.get(w, 0) + 1
    lexicon = frozenset(w for w, n in counts.items() if n >= LEXICON_COUNT)
    rng = np.random.default_rng(seed)
    spans: list[tuple[int, list[str]]] = []
    for k, lab in enumerate(labels):
        ws, i = samples[lab], 0
        while i < len(ws):
            step = int(rng.integers(4, 17))
            spans.append((k, ws[i:i + step]))
            i += step
    # spans mostly stay with their label, as in running text, and switch now and then
    rng.shuffle(spans)
    spans.sort(key=lambda s: (s[0] + 0.9 * rng.random()) if rng.random() < 0.7 else len(labels) * rng.random())
    flat = [(w, k) for k, ws in spans for w in ws]
    vocab = {w: i for i, w in enumerate(counts)}
    (two, three, *rest), starts = features(list(vocab), lexicon)
    letters = np.repeat(np.arange(len(vocab)), np.diff(np.r_[starts, len(two)]))
    flat_ids = np.concatenate([two, three, *rest])
    owner = np.concatenate([letters, letters] + [np.arange(len(vocab))] * len(rest))
    real = flat_ids < (1 << FEATURE_BITS)
    by_word = np.argsort(owner[real], kind="stable")
    ids = np.split(flat_ids[real][by_word], np.cumsum(np.bincount(owner[real], minlength=len(vocab)))[:-1])
    count = max(1, len(flat) // SEQUENCE_WORDS)
    size = min(SEQUENCE_WORDS, len(flat))
    word = np.array([vocab[w] for w, _ in flat[:count * size]]).reshape(count, size)
    gold = np.array([k for _, k in flat[:count * size]]).reshape(count, size)
    kinds = len(labels)
    weights = np.zeros(((1 << FEATURE_BITS) + 1, kinds))
    moves = np.zeros((kinds, kinds))
    w2, m2 = np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)
    eye = np.eye(kinds)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(count), max(1, count // 64)):
            x, y = word[part].T, gold[part].T  # time x sequence
            used, place = np.unique(x, return_inverse=True)
            feats = [ids[u] for u in used]
            at = np.concatenate(feats)
            sizes = np.array([len(f) for f in feats])
            own = np.add.reduceat(weights[at], np.r_[0, np.cumsum(sizes)[:-1]], axis=0)
            scores = own[place.reshape(x.shape)]
            post = marginals(scores, np.full(x.shape[1], len(x)), moves)
            error = eye[y] - post
            per_word = np.zeros((len(used), kinds))
            for k in range(kinds):
                per_word[:, k] = np.bincount(place.ravel(), error[..., k].ravel(), len(used))
            rep = np.repeat(per_word, sizes, axis=0)
            rows, where = np.unique(at, return_inverse=True)
            grad = np.stack([np.bincount(where, rep[:, k], len(rows)) for k in range(kinds)], axis=1)
            grad -= 1e-3 * weights[rows]
            w2[rows] += grad * grad
            weights[rows] += 0.15 * grad / np.sqrt(w2[rows])
            # pairs of labels: observed less expected under neighbouring marginals tied by the moves
            seen = np.einsum("tbi,tbj->ij", eye[y[:-1]], eye[y[1:]])
            joint = post[:-1, :, :, None] * np.exp(moves)[None, None] * post[1:, :, None, :]
            joint /= joint.sum(axis=(2, 3), keepdims=True)
            gap = (seen - joint.sum(axis=(0, 1))) / len(part)
            m2 += gap * gap
            moves += 0.05 * gap / np.sqrt(m2)
    return Crf(labels, weights.astype(np.float32), moves.astype(np.float32), lexicon)


def identify(model: Crf, texts: list[str | None], cache: dict[str, int], scores: list[np.ndarray]
             ) -> tuple[list[str], np.ndarray]:
    """Language and share of each text. ``cache`` and ``scores`` remember words."""
    if len(cache) > CACHE_WORDS:
        cache.clear()
        scores.clear()
    fresh: list[str] = []
    seqs: list[np.ndarray] = []
    for text in texts:
        found = letter_words(text) if model.labels else []
        ids = list(map(cache.get, found))
        if None in ids:
            for k, w in enumerate(found):
                if ids[k] is None:
                    ids[k] = cache.get(w)
                    if ids[k] is None:
                        ids[k] = cache[w] = len(cache)
                        fresh.append(w)
        seqs.append(np.array(ids, np.int32))
    scores.append(model.word_scores(fresh))
    if len(scores) > 1:
        scores[:] = [np.concatenate(scores)]
    table = scores[0]
    names, share = [UNKNOWN] * len(texts), np.zeros(len(texts))
    order = sorted((i for i in range(len(texts)) if len(seqs[i])), key=lambda i: -len(seqs[i]))
    at = 0
    while at < len(order):
        longest = len(seqs[order[at]])
        part = order[at:at + max(1, CELLS // longest)]
        at += len(part)
        lengths = np.array([len(seqs[i]) for i in part])
        ids = np.zeros((longest, len(part)), np.int32)
        for c, i in enumerate(part):
            ids[:lengths[c], c] = seqs[i]
        sums = marginals(table[ids], lengths, model.moves, keep=False) / lengths[:, None]
        best = sums.argmax(axis=1)
        for c, i in enumerate(part):
            names[i] = model.labels[best[c]]
            share[i] = min(1.0, float(sums[c, best[c]]))
    return names, share


def fit(docs: DataFrame, trainable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        sample_docs: int = SAMPLE_DOCS, seed: int = 11) -> Crf:
    """Train on a hash sample of the rows where ``trainable`` holds and neither
    text nor label is null; no such row gives a model without labels."""
    rows = docs.where(trainable & F.col(lang_col).isNotNull())
    counts = rows.groupBy(F.col(lang_col).cast("string").alias("lang")).count().limit(MAX_LABELS + 1).collect()
    if len(counts) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    if not counts:
        return train({})
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, sample_docs / r["count"]))).otherwise(share)
    drawn = (rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"),
                         F.xxhash64(F.lit(seed), F.col(id_col)).alias("h"))
             .where(F.pmod("h", F.lit(1 << 31)) < share * (1 << 31))
             .where(F.length("text").between(1, SAMPLE_CHARS)).orderBy("h", "text")
             .limit(2 * sample_docs * len(counts)).collect())
    samples: dict[str, list[str]] = {r["lang"]: [] for r in counts}
    for r in drawn:
        if len(samples[r["lang"]]) < SAMPLE_WORDS:
            samples[r["lang"]] += letter_words(r["text"])
    return train({k: ws[:SAMPLE_WORDS] for k, ws in samples.items() if ws})


def language(model: Crf, text: Column) -> Column:
    """``struct<lang_pred, score>`` of a text column."""
    memory: tuple[dict[str, int], list[np.ndarray]] = ({}, [])

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def label(texts: pa.Array) -> pa.Array:
        names, share = [], []
        for at in range(0, len(texts), 2000):
            n, s = identify(model, texts.slice(at, 2000).to_pylist(), *memory)
            names += n
            share.append(s)
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(np.concatenate(share) if share else [], pa.float64())],
            names=["lang_pred", "score"])
    return label(text.cast("string"))


def predict(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred``, ``score`` for every row.

    Defined results: a null text, or one without a letter, is ``und`` with
    score 0; so is every text if nothing could be learned. Equal texts get equal
    results; repeated rows stay; other columns are not read; an empty table
    gives an empty result. Ties go to the label that sorts first.
    """
    rows = docs.select(F.col(id_col), language(model, F.col(text_col)).alias("found"))
    return rows.select(id_col, "found.lang_pred", "found.score")


def keep_identified(docs: DataFrame, model: Crf, min_share: float = MIN_SHARE) -> DataFrame:
    """``docs`` without the rows whose language is ``und`` or has less than
    ``min_share`` of the words."""
    rows = docs.select("*", language(model, docs["text"]).alias("_found_language"))
    found = F.col("_found_language")
    return rows.where((found["lang_pred"] != UNKNOWN) & (found["score"] >= min_share)).drop("_found_language")
