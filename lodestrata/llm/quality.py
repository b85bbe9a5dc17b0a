"""Quality rules: exact base counts, then a calibrated n-gram classifier.

The classifier is a logistic regression over hashed word unigrams, word bigrams and character 3- and
4-grams (each family averaged over the document), fitted on labelled rows and calibrated on held-out
ones; documents are scored in Arrow batches against a fixed threshold.

Defined results: null and empty texts have no word and fail the base rules; a corpus without labels
of both classes gets no classifier, and the base rules alone decide; of repeated labels, and of
repeated texts, of one id the smallest holds; words of any length and texts of any length are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import WordCache, map_text

#: Labelled rows used for fitting at most, the ones with the smallest hashes (documented bound).
SAMPLE_ROWS = 3000
#: A document is kept if its calibrated probability of being good is at least this.
KEEP_FROM = 0.5
MIN_WORDS = 50
BITS = 16
SIZE = 1 << BITS
FAMILIES = 4  # unigrams, bigrams, character 3-grams and 4-grams

SYMBOLS = b"#*$%&|<>"
_SPACES = " \t\n\r\x0b\f"
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_SHIFT = np.uint64(64 - BITS)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def hashes(words: list[bytes], cache: WordCache) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def repeated_words(h: np.ndarray) -> int:
    """Words in 3-word windows that occur at least twice."""
    n = len(h)
    if n < 4:
        return 0
    windows = (h[:-2] * _A + h[1:-1]) * _B + h[2:]
    windows ^= windows >> np.uint64(29)
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def base_counts(text: str, cache: WordCache) -> tuple[tuple[int, int, int, int, int], np.ndarray, bytes]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), word hashes, bytes."""
    data = text.encode()
    words = data.split()
    h = hashes(words, cache)
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    seen, again = set(), 0
    if b"\n" in data:
        for line in data.split(b"\n"):
            if line in seen:
                again += 1
            elif line and not line.isspace():
                seen.add(line)
    return (len(words), chars, symbols, again, repeated_words(h)), h, data


def _slots(h: np.ndarray) -> np.ndarray:
    return ((h * _C) >> _SHIFT).astype(np.int64)


def families(h: np.ndarray, data: bytes) -> list[np.ndarray]:
    """Table slots of each family's features, one per occurrence."""
    b = np.frombuffer(data.translate(_LOWER), np.uint8).astype(np.uint64)
    out = [_slots(h), _slots((h[:-1] * _A + h[1:]) * _B)] if len(h) else [np.zeros(0, np.int64)] * 2
    for n, salt in ((3, _A), (4, _B)):
        grams = np.zeros(max(0, len(b) - n + 1), np.uint64)
        for i in range(n):
            grams = grams * np.uint64(257) + b[i : len(b) - n + 1 + i] if len(b) >= n else grams
        grams *= salt
        grams ^= grams >> np.uint64(31)
        out.append(_slots(grams))
    return out


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # families x slots
    bias: float
    slope: float
    shift: float

    def logit(self, h: np.ndarray, data: bytes) -> float:
        return self.bias + sum(float(self.weights[k][slots].mean()) for k, slots in enumerate(families(h, data)) if len(slots))

    def probability(self, h: np.ndarray, data: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.logit(h, data) + self.shift, -30, 30))))


def fit(rows: list[tuple[str, int]], rounds: int = 50, rate: float = 0.01) -> Model | None:
    """Full-batch Adam on four fifths of the rows, Platt scaling on the rest."""
    y = np.array([r[1] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return None
    cache = WordCache(word_hash)
    docs, slots, values = [], [], []
    for i, (text, _) in enumerate(rows):
        data = text.encode()
        for k, s in enumerate(families(hashes(data.split(), cache), data)):
            if len(s):
                u, n = np.unique(s, return_counts=True)
                docs.append(np.full(len(u), i, np.int32))
                slots.append((u + k * SIZE).astype(np.int32))
                values.append((n / len(s)).astype(np.float32))
    if not docs:
        return None
    doc, slot, value = map(np.concatenate, (docs, slots, values))
    fitted = np.arange(len(y)) % 5 != 4
    if len({*y[fitted]}) < 2 or len({*y[~fitted]}) < 2:
        fitted[:] = True
    good = y[fitted].mean()
    weight = np.where(y > 0, 0.5 / good, 0.5 / (1 - good)) * fitted
    # features are shares, so frequent ones are scaled up to make one step size do for all
    scale = 1 / np.sqrt(np.bincount(slot, value.astype(float) ** 2, FAMILIES * SIZE) / len(y) + 1e-9)
    x = value * scale[slot]
    w, b = np.zeros(FAMILIES * SIZE), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = b + np.bincount(doc, x * w[slot], len(y))
        r = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / fitted.sum()
        g, gb = np.bincount(slot, x * r[doc], len(w)) + 1e-5 * w, r.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, c = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / a) / (np.sqrt(v / c) + 1e-8)
        b -= rate * (mb / a) / (np.sqrt(vb / c) + 1e-8)
    z = b + np.bincount(doc, x * w[slot], len(y))
    held = ~fitted if (~fitted).any() else fitted
    # Platt's targets keep the slope finite where the classes are apart
    pos, neg = (y[held] > 0).sum(), (y[held] == 0).sum()
    target = np.where(y[held] > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    slope, shift = 1.0, 0.0
    for _ in range(200):  # Newton steps, damped
        p = 1 / (1 + np.exp(-np.clip(slope * z[held] + shift, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-9)
        grad = np.array([((p - target) * z[held]).sum(), (p - target).sum()])
        hess = np.array([[(s * z[held] ** 2).sum() + 1e-3, (s * z[held]).sum()], [(s * z[held]).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        slope, shift = slope - 0.5 * np.clip(step[0], -1, 1), shift - 0.5 * np.clip(step[1], -1, 1)
    return Model((w * scale).astype(np.float32).reshape(FAMILIES, SIZE), float(b), float(slope), float(shift))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> list[tuple[str, int]]:
    """At most `rows` labelled texts, one for an id, by smallest hash of the id; the bound keeps the driver small."""
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("__y"))
        .orderBy(F.xxhash64("__id"), "__id").limit(rows)
    )
    picked = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), "__id")
    found = picked.where(F.col("__text").isNotNull()).groupBy("__id").agg(F.min("__text"), F.first("__y")).collect()
    found.sort(key=lambda r: (xxhash.xxh3_64_intdigest(str(r[0]).encode()), r[1]))
    return [(r[1], int(r[2] > 0)) for r in found]


def quality_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS) -> Model | None:
    return fit(labelled_sample(docs, labels, id_col, text_col, label_col, rows))


def quality_rules(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """Per document: n_words, the base counts, base_failed, kept, and the calibrated probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FAMILIES * SIZE floats: 1 MB

    def factory():
        cache, m = WordCache(word_hash), shared.value

        def work(text):
            counts, h, data = base_counts(text or "", cache)
            n, repeats = counts[0], counts[4]
            failed = n < MIN_WORDS or 100 * repeats > 50 * n
            p = m.probability(h, data) if m else 1.0
            return *counts, failed, not failed and p >= keep_from, p

        return work

    return map_text(docs, [id_col], text_col, factory, "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, p_good double")
