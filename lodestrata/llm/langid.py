"""Language identification with spans.

Script ranges narrow the languages that a word may have; per-word scores (naive Bayes over hashed
character 1- to 4-grams) go through Viterbi with a penalty for switching, which labels spans of
mixed-language text; the language with most letters is the document's.

Defined results: null texts and texts without a letter are `und` with score 0; ties go to the
language that comes first in order; a corpus without any labelled row gives `und` everywhere;
repeated rows are labelled one by one and texts are read whole.
"""

from __future__ import annotations

import bisect
from collections import Counter
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import map_text, slices

UNKNOWN = "und"
#: Labelled rows per language used for fitting, about: rows under a hash threshold (documented bound).
ROWS_PER_LANGUAGE = 1500
#: Languages that a model may have; with more, training fails rather than leave some out.
MOST_LANGUAGES = 1000
BITS = 15
SIZE = 1 << BITS
#: Log-probability that a change of language between two words costs.
SWITCH = 12.0
#: A language takes part in a script if so large a part of its letters is of it.
SCRIPT_SHARE = 0.01
OUTSIDE = -25.0
SMOOTH = 0.5
_MIX, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - BITS)
#: Words that a labeller remembers, and their bytes.
CACHE_WORDS, CACHE_BYTES = 800_000, 1 << 25

# First code point and script of Unicode ranges, in order; "" ends a range.
SCRIPT_RANGES = [
    (0x0041, "Latin"), (0x02B0, ""), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, ""), (0x0750, "Arabic"), (0x0780, ""), (0x08A0, "Arabic"), (0x0900, "Devanagari"),
    (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"),
    (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"),
    (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1380, ""), (0x1780, "Khmer"),
    (0x1800, "Mongolian"), (0x18B0, ""), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, ""), (0x2C60, "Latin"), (0x2C80, ""),
    (0x3040, "Kana"), (0x3100, ""), (0x3130, "Hangul"), (0x3190, ""), (0x3400, "Han"), (0xA000, ""), (0xAC00, "Hangul"),
    (0xD7B0, ""), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB07, ""), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, ""),
    (0xFF21, "Latin"), (0xFF5B, ""), (0xFF66, "Kana"), (0xFFA0, ""), (0x20000, "Han"), (0x32000, ""),
]
_FIRST = [a for a, _ in SCRIPT_RANGES]
SCRIPTS = sorted({s for _, s in SCRIPT_RANGES if s}) + ["other"]
_NUMBER = {s: i for i, s in enumerate(SCRIPTS)}


def script_of(char: str) -> str:
    at = bisect.bisect_right(_FIRST, ord(char)) - 1
    return (SCRIPT_RANGES[at][1] if at >= 0 else "") or "other"


@lru_cache(maxsize=1 << 16)
def script_number(char: str) -> int:
    return _NUMBER[script_of(char)]


def script_of_letters(letters: str) -> int:
    """Number of the script that most letters of a word have; on a tie, of the one that comes first."""
    return _NUMBER["Latin"] if letters.isascii() else Counter(map(script_number, letters)).most_common(1)[0][0]


def letters_of(word: str) -> str:
    return word.lower() if word.isalpha() else "".join(c for c in word if c.isalpha()).lower()


def grams(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 to 4: table slots of the words' n-grams (ends marked), and how many each word has."""
    marked = [b"<%b>" % w.encode() for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    word = np.repeat(np.arange(len(marked)), sizes)
    out, rolled = [], np.zeros(len(data), np.uint64)
    for n in (1, 2, 3, 4):
        if n > 1:
            rolled = rolled[:-1]
        rolled = rolled * np.uint64(257) + data[n - 1 :] + np.uint64(1)
        inside = word[: len(rolled)] == word[n - 1 :]
        x = rolled[inside] * _MIX
        out.append(((x >> _SHIFT).astype(np.int64), np.maximum(sizes - n + 1, 0)))
    return out


@dataclass(frozen=True)
class Model:
    languages: list[str]
    table: np.ndarray  # slots x languages, log-probabilities
    scripts: dict[str, np.ndarray] = field(default_factory=dict)  # script -> which languages use it

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the languages for each word, and its number of letters; no letters: all zero."""
        scores, count = np.zeros((len(words), len(self.languages)), np.float32), np.zeros(len(words), np.int64)
        letters = list(map(letters_of, words))
        there = [i for i, w in enumerate(letters) if w]
        if not there:
            return scores, count
        letters = [letters[i] for i in there]
        size = np.fromiter(map(len, letters), np.int64, len(letters))
        total, number = np.zeros((len(letters), len(self.languages))), np.zeros(len(letters))
        for slots, each in grams(letters):
            ends = np.cumsum(each)
            sums = np.concatenate([np.zeros((1, len(self.languages))), np.cumsum(self.table[slots], axis=0, dtype=np.float64)])
            total += sums[ends] - sums[ends - each]
            number += each
        # the mean over n-grams times a length that grows to a bound, so that one long word cannot decide alone
        found = total / number[:, None] * np.minimum(12.0, 2.0 + size)[:, None]
        found -= found.max(axis=1, keepdims=True)
        used = self.usable[[script_of_letters(w) for w in letters]]
        scores[there], count[there] = np.where(used, np.maximum(found, OUTSIDE), OUTSIDE), size
        return scores, count

    @cached_property
    def _used(self) -> np.ndarray:
        return np.stack([self.scripts.get(s, np.ones(len(self.languages), bool)) for s in SCRIPTS])

    @cached_property
    def usable(self) -> np.ndarray:
        """Scripts x languages: which languages use a script; all of them if none does."""
        return self._used | ~self._used.any(axis=1, keepdims=True)

    @cached_property
    def _foreign(self) -> list[bool]:
        return (~self._used.any(axis=1)).tolist()

    def foreign(self, word: str) -> int:
        """Letters of a word in scripts that no language uses."""
        foreign = self._foreign
        if word.isascii() and not foreign[_NUMBER["Latin"]]:
            return 0
        return sum(foreign[script_number(c)] for c in word if c.isalpha())


def viterbi(scores: np.ndarray, switch: float) -> np.ndarray:
    """Best language of each word.  Where no stretch gains half a switch over the best single
    language, no path with a switch can beat it, and the search is skipped."""
    n, k = scores.shape
    total = scores.sum(axis=0, dtype=np.float64)
    best = int(total.argmax())
    if k == 1 or n == 0:
        return np.zeros(n, np.int64)
    ahead = np.cumsum(scores - scores[:, best : best + 1], axis=0, dtype=np.float64)
    low = np.minimum(np.minimum.accumulate(ahead, axis=0), 0)
    if (ahead - low).max() < switch / 2:
        return np.full(n, best)
    back = np.empty((n, k), np.int16)
    at = scores[0].astype(float).tolist()
    span = range(k)
    for i, row in enumerate(scores[1:].tolist(), 1):
        top = max(span, key=at.__getitem__)
        floor = at[top] - switch
        back[i] = [j if at[j] >= floor else top for j in span]
        at = [(at[j] if at[j] >= floor else floor) + row[j] for j in span]
    path = np.empty(n, np.int64)
    path[-1] = max(span, key=at.__getitem__)
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


class Labeller:
    """Labels texts, keeping the scores of the words it met last in growing arrays."""

    def __init__(self, model: Model, switch: float = SWITCH):
        self.model, self.switch = model, switch
        self._reset()

    def _reset(self):
        self.index: dict[bytes, int] = {}
        self.scores = np.zeros((1024, len(self.model.languages)), np.float32)
        self.letters = np.zeros(1024, np.int64)
        self.foreign = np.zeros(1024, np.int64)
        self.held = 0

    def _add(self, words: list[bytes]) -> None:
        at, more = len(self.index), len(words)
        while at + more > len(self.letters):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
            self.foreign = np.concatenate([self.foreign, np.zeros_like(self.foreign)])
        said = [w.decode() for w in words]
        self.scores[at : at + more], self.letters[at : at + more] = self.model.score(said)
        self.foreign[at : at + more] = list(map(self.model.foreign, said))
        self.index.update(zip(words, range(at, at + more)))
        self.held += sum(map(len, words))

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """Scores and letters of the words of a text, and its letters in scripts that no language uses."""
        words = text.encode().split()
        if len(self.index) + len(words) > CACHE_WORDS or self.held > CACHE_BYTES:
            self._reset()
        known = self.index
        if new := {w for w in words if w not in known}:
            self._add(sorted(new))
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        return self.scores[at], self.letters[at], int(self.foreign[at].sum())

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(first word, end word, language) of each span; words without letters join their neighbours."""
        if not text or not self.model.languages:
            return []
        scores, letters, _ = self.words(text)
        if not letters.sum():
            return []
        path = viterbi(scores, self.switch)
        cut = np.flatnonzero(np.diff(path)) + 1
        return [(int(a), int(b), self.model.languages[path[a]]) for a, b in zip([0, *cut], [*cut, len(path)])]

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """The language with most letters, its part of all letters, and the part in scripts that no language uses."""
        if not text or not self.model.languages:
            return UNKNOWN, 0.0, 0.0
        scores, letters, foreign = self.words(text)
        total = int(letters.sum())
        if not total:
            return UNKNOWN, 0.0, 0.0
        each = np.bincount(viterbi(scores, self.switch), letters, len(self.model.languages))
        best = int(each.argmax())
        return self.model.languages[best], float(each[best] / total), foreign / total

    def label(self, text: str | None) -> tuple[str, float]:
        return self.judge(text)[:2]


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE, id_col: str = "doc_id") -> Model:
    """Counts n-grams on the executors; what reaches the driver is bounded by languages x slots."""
    rows = labelled.select(F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l"), F.pmod(F.xxhash64(id_col), F.lit(1_000_003)).alias("h")).where("l is not null and t is not null")
    share = {r["l"]: min(1.0, rows_per_language / r["n"]) for r in rows.groupBy("l").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(share) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not share:
        return Model([], np.zeros((SIZE, 0)))
    languages = sorted(share)
    bound = F.create_map(*[F.lit(x) for k in languages for x in (k, int(share[k] * 1_000_003) + 1)])
    sample = rows.where(F.col("h") < bound[F.col("l")]).select("t", "l")

    def count(batches):
        import pyarrow as pa

        table = np.zeros((len(languages), SIZE), np.int64)
        used = np.zeros((len(languages), len(SCRIPTS)), np.int64)
        at = {k: i for i, k in enumerate(languages)}
        words = [Counter() for _ in languages]

        def flush():
            for k, counter in enumerate(words):
                known, chars = Counter(), Counter()
                for word, n in counter.items():
                    if letters := letters_of(word):
                        known[letters] += n
                        for c in letters:
                            chars[c] += n
                for c, n in chars.items():
                    used[k, script_number(c)] += n
                if known:
                    weight = np.fromiter(known.values(), np.int64, len(known))
                    for slots, each in grams(list(known)):
                        table[k] += np.bincount(slots, np.repeat(weight, each), SIZE).astype(np.int64)
                counter.clear()

        for part in slices(batches):
            for text, lang in zip(part.column(0), part.column(1)):
                words[at[lang.as_py()]].update(text.as_py().split())
            if sum(map(len, words)) > 100_000:
                flush()
        flush()
        k, s = np.nonzero(table)
        i, j = np.nonzero(used)
        yield pa.RecordBatch.from_pydict({"k": pa.array(np.concatenate([k, i]), pa.int32()), "s": pa.array(np.concatenate([s, j + SIZE]), pa.int32()), "n": pa.array(np.concatenate([table[k, s], used[i, j]]), pa.int64())})

    table = np.full((SIZE, len(languages)), SMOOTH)
    used = np.zeros((len(SCRIPTS), len(languages)))
    for r in sample.mapInArrow(count, "k int, s int, n bigint").groupBy("k", "s").agg(F.sum("n").alias("n")).toLocalIterator():
        if r["s"] < SIZE:
            table[r["s"], r["k"]] += r["n"]
        else:
            used[r["s"] - SIZE, r["k"]] += r["n"]
    share_of = used / np.maximum(used.sum(axis=0), 1)
    return Model(languages, np.log(table / table.sum(axis=0)).astype(np.float32), {s: share_of[i] >= SCRIPT_SHARE for i, s in enumerate(SCRIPTS)})


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learning_rows(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    return docs.where(F.col(lang_col).isNotNull() & ~held_out(id_col))


def identify(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """The columns `keep`, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SIZE x languages floats

    def factory():
        return Labeller(shared.value, switch).label

    return map_text(docs, keep, text_col, factory, "lang_pred string, score double")


def known_language(docs: DataFrame, model: Model, least: float, text_col: str = "text", switch: float = SWITCH, strange: float = 0.5) -> DataFrame:
    """The rows of `docs` whose language is known and has at least the part `least` of the letters,
    and which have at most the part `strange` of their letters in scripts that no language uses.

    A model without languages knows none; then only rows without a letter go.
    """
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        labeller = Labeller(shared.value, switch)

        def stays(text: str | None) -> bool:
            if not labeller.model.languages:
                return bool(text and letters_of(text))
            lang, score, foreign = labeller.judge(text)
            return lang != UNKNOWN and score >= least and foreign <= strange

        for part in slices(batches):
            yield part.filter(pa.array([stays(x.as_py()) for x in part.column(place)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def language_spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """id, spans: array of struct(first word, end word, lang)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def factory():
        labeller = Labeller(shared.value, switch)
        return lambda text: ([{"first_word": a, "end_word": b, "lang": c} for a, b, c in labeller.spans(text)],)

    return map_text(docs, [id_col], text_col, factory, "spans array<struct<first_word:bigint,end_word:bigint,lang:string>>")
