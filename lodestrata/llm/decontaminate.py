"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

Texts and benchmark items are compared as word sequences (lower case, without punctuation; in scripts
that are written without spaces, every character is a word).  Every item-sized window of a document is put through the CGK random walk, which turns edit distance into
Hamming distance; several samples of positions of several walks are looked up in the items' tables,
and what collides is verified by exact word-level edit distance (free ends, bit-parallel).  How many
samples are taken follows from the length of the item, the edits allowed and RECALL.  Windows
that share fewer 3-word runs with the items than an item within the distance must share are skipped
before they are embedded: the count filter loses nothing.

Defined results: null texts and items, and those without a word, match nothing; items under
EXACT_BELOW words must match without an edit, and items under `min_words` (1: none) are left out; one
row per document and item however often it occurs; repeated rows give repeated results, repeated items
one; ties between places go to the first; texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm.common import WordCache, slices

#: Edits allowed, as a part of an item's words.
EDITS = 0.2
EXACT_BELOW = 8
#: Part of the items with as many edits as are allowed that the samples of the window at their start find; its neighbours find more.
RECALL = 0.97
#: Walks, and positions in a sample.  A walk takes LEAST_SAMPLES samples, and twice as many as long as RECALL asks for it.
WALKS, POSITIONS, LEAST_SAMPLES, MOST_SAMPLES = 4, 3, 16, 4096
#: Pairs that are simulated to find the number of samples.
SIMULATED = 120
#: Words of items that are broadcast at once; larger benchmarks go through in blocks of this size.
BLOCK_WORDS = 2_000_000

# a-z, 0-9 and bytes of 0x80 and above stay; all other bytes separate words
_KEEP = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 32 for c in range(256))
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_END = np.uint64(1)


# scripts without spaces between words: Thai, Lao, Tibetan, Myanmar, Khmer, kana, Han
_UNSPACED = re.compile("([\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff])")


def words_of(text: str) -> list[bytes]:
    text = text.lower()
    if not text.isascii() and _UNSPACED.search(text):
        text = _UNSPACED.sub(r" \1 ", text)
    return text.encode().translate(_KEEP).split()


def hashes(words: list[bytes], cache: WordCache) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def runs(h: np.ndarray) -> np.ndarray:
    """Hashes of the 3-word runs."""
    x = (h[:-2] * _M1 + h[1:-1]) * _M2 + h[2:]
    return x ^ (x >> np.uint64(31))


def allowed(n: int) -> int:
    return 0 if n < EXACT_BELOW else int(EDITS * n)


def needed(n: int) -> int:
    """3-word runs that a window shares with an item of n words within the allowed edits, at least."""
    return max(1, n - 2 - 3 * allowed(n))


def embed(windows: np.ndarray, walk: int, positions: np.ndarray) -> np.ndarray:
    """CGK: one walk over each row; the symbols that it emits at the wanted (sorted) positions."""
    m, n = windows.shape
    padded = np.concatenate([windows, np.full((m, 1), _END)], axis=1)
    rng = np.random.default_rng(1000 + walk)
    turns = rng.integers(1 << 32, 1 << 63, 3 * n, dtype=np.uint64) | np.uint64(1)
    at, rows, out, k = np.zeros(m, np.int64), np.arange(m), np.empty((m, len(positions)), np.uint64), 0
    for j in range(int(positions[-1]) + 1):
        symbol = padded[rows, at]
        if positions[k] == j:
            out[:, k] = symbol
            k += 1
        at = np.minimum(at + ((symbol * turns[j]) >> np.uint64(63)).astype(np.int64), n)
    return out


def alike(n: int) -> np.ndarray:
    """Simulated pairs of an item of n words and its window with all edits allowed: part of equal
    symbols in the sampled stretch, pairs x walks."""
    rng, k = np.random.default_rng(n), allowed(n)
    items = rng.integers(2, 1 << 63, (SIMULATED, n), dtype=np.uint64)
    windows = []
    for row in items:
        cut = row.tolist()
        for at, kind in zip(rng.integers(0, n, k).tolist(), rng.integers(0, 3, k).tolist()):
            at = min(at, len(cut))
            cut[at : at + (kind > 0)] = rng.integers(2, 1 << 63, int(kind < 2), dtype=np.uint64).tolist()
        windows.append([*cut, *rng.integers(2, 1 << 63, n, dtype=np.uint64).tolist()][:n])
    both, own = np.concatenate([items, np.array(windows, np.uint64)]), np.arange(2 * n)
    found = [embed(both, walk, own) for walk in range(WALKS)]
    return np.stack([(x[:SIMULATED] == x[SIMULATED:]).mean(axis=1) for x in found], axis=1)


@lru_cache(maxsize=4096)
def samples(n: int) -> int:
    """Samples of each walk for items of n words: enough for RECALL, by simulation at a length near n."""
    if not allowed(n):
        return LEAST_SAMPLES  # equal windows agree in every sample
    step = 1 << max(0, n.bit_length() - 3)
    if n % step:
        return samples(n + step - n % step)
    hit, each = alike(n) ** POSITIONS, LEAST_SAMPLES
    while each < MOST_SAMPLES and ((1 - hit) ** each).prod(axis=1).mean() > 1 - RECALL:
        each *= 2
    return each


def sampled(n: int, walk: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that some sample of the walk needs, and for each sample where its own are among them.

    Samples lie in the first two thirds of a walk: the last part mostly repeats the end mark.
    """
    rng, each = np.random.default_rng(7919 * n + walk), samples(n)
    own = np.argsort(rng.random((each, 2 * n)), axis=1)[:, :POSITIONS] if n > 1 else np.tile(np.arange(2), (each, 1))
    wanted = np.unique(own)
    return wanted, np.searchsorted(wanted, own)


def codes(windows: np.ndarray, walk: int) -> np.ndarray:
    """rows x samples hashes of the sampled symbols."""
    wanted, own = sampled(windows.shape[1], walk)
    symbols = embed(windows, walk, wanted)
    out = np.arange(1, len(own) + 1, dtype=np.uint64)[None, :] + np.uint64(MOST_SAMPLES * walk)
    for i in range(own.shape[1]):
        out = (out ^ symbols[:, own[:, i]]) * _M1
        out ^= out >> np.uint64(29)
    return out


def edit_search(pattern: list, text: list) -> tuple[int, int]:
    """Least edits of the whole pattern against any stretch of the text, and the first end of one."""
    masks: dict = {}
    for i, x in enumerate(pattern):
        masks[x] = masks.get(x, 0) | 1 << i
    n = len(pattern)
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, best, end = full, 0, n, n, 0
    for at, x in enumerate(text, 1):
        eq = masks.get(x, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        hp = minus | ~(xh | plus) & full
        hm = plus & xh
        score += 1 if hp & top else -1 if hm & top else 0
        hp, hm = hp << 1 & full, hm << 1 & full
        plus = hm | ~(xv | hp) & full
        minus = hp & xv
        if score < best:
            best, end = score, at
    return best, end


@dataclass
class Items:
    """Searchable items: ids and word hashes, at least one each."""

    ids: list
    words: list[np.ndarray]

    @cached_property
    def _runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (3-word run, length of an item that has it), in order."""
        pairs = {(x, len(w)) for w in self.words for x in runs(w).tolist()}
        ordered = sorted(pairs)
        return np.array([x for x, _ in ordered], np.uint64), np.array([n for _, n in ordered], np.int64)

    @cached_property
    def marks(self) -> np.ndarray:
        """A bitmap over the runs' top bits, as a first test."""
        out = np.zeros(1 << 20, bool)
        out[(self._runs[0] >> np.uint64(44)).astype(np.int64)] = True
        return out

    @cached_property
    def tables(self) -> dict[int, list[tuple[np.ndarray, np.ndarray]]]:
        """For each length and walk: all items' codes in order, and the item of each."""
        of: dict[int, list[int]] = {}
        for i, w in enumerate(self.words):
            of.setdefault(len(w), []).append(i)
        out = {}
        for n, members in sorted(of.items()):
            rows = np.stack([self.words[i] for i in members])
            out[n] = []
            for walk in range(WALKS):
                found = codes(rows, walk)
                order = np.argsort(found, axis=None, kind="stable")
                out[n].append((found.ravel()[order], np.repeat(members, found.shape[1])[order]))
        return out

    @cached_property
    def _short(self) -> dict[int, np.ndarray]:
        """First words of the items that have no 3-word run, by length."""
        return {n: np.unique([w[0] for w in self.words if len(w) == n]) for n in {len(w) for w in self.words} if n < 3}

    def starts(self, h: np.ndarray):
        """(length, starts) of the windows that share enough runs with the items of that length.

        A start may lie before the text by the edits allowed, and a window may hang over its end.
        """
        for n, firsts in self._short.items():
            if len(starts := np.flatnonzero(np.isin(h[: max(0, len(h) - n + 1)], firsts))):
                yield n, starts
        r = runs(h)
        at = np.flatnonzero(self.marks[(r >> np.uint64(44)).astype(np.int64)])
        if not len(at):
            return
        known, length = self._runs
        first = np.searchsorted(known, r[at])
        count = np.searchsorted(known, r[at], side="right") - first
        place = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        at, length = np.repeat(at, count), length[place]
        for n in np.unique(length).tolist():
            k = allowed(n)
            least = max(1, needed(n) - k)  # edits may push as many runs over the window's end
            own = at[length == n]
            if len(own) < least or len(h) < n - k:
                continue
            before = np.zeros(len(r) + 1, np.int64)
            before[own + 1] = 1
            before = np.cumsum(before)
            starts = np.arange(-k, len(h) - n + k + 1)
            inside = before[np.clip(starts + n - 2, 0, len(r))] - before[np.clip(starts, 0, len(r))]
            if len(starts := starts[inside >= least]):
                yield n, starts

    def candidates(self, h: np.ndarray) -> dict[int, list[int]]:
        """item -> window starts at which a sample collides."""
        out: dict[int, list[int]] = {}
        for n, starts in self.starts(h):
            k = allowed(n)
            padded = np.concatenate([np.full(k, _END), h, np.full(k, _END)])
            view = np.lib.stride_tricks.sliding_window_view(padded, n)
            for part in np.array_split(starts, 1 + len(starts) * max(n, samples(n)) // 500_000):
                for walk, (known, item) in enumerate(self.tables[n]):
                    found = codes(view[part + k], walk)
                    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    rows, cols = np.nonzero(known[at] == found)
                    for row, first, code in zip(rows.tolist(), at[rows, cols].tolist(), found[rows, cols].tolist()):
                        while first < len(known) and int(known[first]) == code:
                            out.setdefault(int(item[first]), []).append(int(part[row]))
                            first += 1
        return out

    def search(self, text: str | None, cache: WordCache) -> list[tuple]:
        """(item id, edits, words of the item, end word) of all items found in the text."""
        if not text:
            return []
        h = hashes(words_of(text), cache)
        found: dict = {}
        for i, starts in self.candidates(h).items():
            own = self.words[i].tolist()
            k = allowed(len(own))
            best, ordered = None, np.unique(starts)
            # starts less than an item apart are verified as one stretch
            for near in np.split(ordered, np.flatnonzero(np.diff(ordered) > len(own)) + 1):
                lo = max(0, int(near[0]) - k)
                edits, end = edit_search(own, h[lo : int(near[-1]) + len(own) + k].tolist())
                if edits <= k and (best is None or edits < best[0]):
                    best = edits, lo + end
            if best and (self.ids[i] not in found or best < found[self.ids[i]][:2]):
                found[self.ids[i]] = (*best, len(own))
        return [(i, edits, n, end) for i, (edits, end, n) in sorted(found.items())]


def item_blocks(items: DataFrame, item_col: str, text_col: str, min_words: int = 1) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(ids, words) of the items, in blocks that end as soon as they have BLOCK_WORDS words.

    The items are read once, partition by partition, and the driver holds one block at a time; without
    an item there is one empty block.
    """
    rows = items.select(F.col(item_col).alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null and t is not null").distinct()
    cache, ids, words, held, blocks = WordCache(xxhash.xxh3_64_intdigest), [], [], 0, 0
    for r in rows.toLocalIterator():
        w = words_of(r["t"])
        if len(w) >= max(1, min_words):
            ids.append(r["i"])
            words.append(hashes(w, cache))
            held += len(w)
        if held >= BLOCK_WORDS:
            yield ids, words
            ids, words, held, blocks = [], [], 0, blocks + 1
    if ids or not blocks:
        yield ids, words


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_words: int = 1) -> DataFrame:
    """One row per document and benchmark item found in it: ids, edits, n_item_words, end_word."""
    source = docs.select(id_col, F.col(text_col).cast("string").alias("__text"))
    item = T.StructField("item_id", items.schema[item_col].dataType)
    schema = T.StructType([source.schema[0], item, *T.StructType.fromDDL("edits bigint, n_item_words bigint, end_word bigint").fields])
    out = None
    for block in item_blocks(items, item_col, item_text, min_words):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            from pyspark.sql.pandas.types import to_arrow_type

            known, cache = Items(*shared.value), WordCache(xxhash.xxh3_64_intdigest)
            kinds = [to_arrow_type(f.dataType) for f in schema.fields[1:]]
            for part in slices(batches):
                rows, hits = [], []
                for at, text in enumerate(part.column(1)):
                    for hit in known.search(text.as_py(), cache):
                        rows.append(at)
                        hits.append(hit)
                if rows:
                    columns = [pa.array(c, kind) for c, kind in zip(zip(*hits), kinds)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), *columns], names=schema.names)

        one = source.mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_words: int = 1) -> DataFrame:
    """The rows of `docs` in which no item is found; all columns stay."""
    out = docs
    for block in item_blocks(items, item_col, item_text, min_words):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        place = docs.columns.index(text_col)

        def run(batches, shared=shared, place=place):
            known, cache = Items(*shared.value), WordCache(xxhash.xxh3_64_intdigest)
            for part in slices(batches):
                clean = [not known.search(t.as_py(), cache) for t in part.column(place)]
                yield part.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
