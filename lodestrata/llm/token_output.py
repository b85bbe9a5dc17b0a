"""Token-id files in ORC.

Documents are encoded in ascending id order into ORC files: integers are run-length encoded in
stripes, every stripe has row indexes, and document ids have a Bloom filter, so readers take stripes
in parallel and skip those that cannot hold a wanted id.

Columns of a file: doc_id, part (number of the file in id order), at (ids of the same file before the
row), n_tokens, ids (with the end id).  A row's start is thus its `at` and the lengths of the files
before; no reader sorts or windows rows.

Defined results: null and empty texts are one end id; names of special tokens in a text are these
tokens, as in the library; rows with equal ids stay apart, in the order in which they are read, and
are dealt to as many files as any other rows; null ids come first; an empty table writes files
without rows and reads back as no rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm.common import shared_dir, slices

END_ID = 1
STRIPE_BYTES = 64 << 20
ROW_STRIDE = 1000
BLOOM_FALSE_POSITIVES = 0.01
#: Input bytes of a file, about, where that makes more files than the session has shuffle partitions.
FILE_BYTES = 128 << 20
#: Text bytes that a task encodes at once (one longer text goes alone), and units that it remembers.
SLICE_BYTES, CACHE_WORDS = 4 << 20, 1_200_000
#: New runs of letters that go to the library in one string.
JOINED = 1000

_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


#: Letters that stay one letter each in normal form and lower case: those below U+0250 but U+0130.
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+"


class WordEncoder:
    """The tokenizers library's ids, computed once for each word.

    The tokenizer splits at white space before anything can merge across it, so the ids of a text
    are those of its words in turn.  It also splits a run of letters from the punctuation that ends a
    word, so these are units of their own; any other word is one unit.  A batch is cut into words and
    units, each distinct unit is looked up once, and new ones go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        self.tokenizer = Tokenizer.from_file(path)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        #: Which ids end a run of letters, in vocabularies that mark these.
        self.ends = np.array([suffix is not None and self.tokenizer.id_to_token(i).endswith(suffix) for i in range(self.tokenizer.get_vocab_size())])
        #: Two generations of known units: what is met again moves to the young one and stays.
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<i4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, runs: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Ids of runs of letters.  Several go to the library as one text; as each gives one id with the
        end mark at least, they are told apart by it wherever there are as many marks as runs."""
        parts = [runs[i : i + JOINED] for i in range(0, len(runs), JOINED)]
        for part, ids in zip(parts, self._library([b" ".join(p).decode() for p in parts])):
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part) and cuts[-1] == len(ids):
                packed, cuts = ids.tobytes(), (4 * cuts).tolist()
                yield from zip(part, [packed[a:b] for a, b in zip([0, *cuts], cuts)])
            else:
                yield from self._each(part)

    def _each(self, units: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        yield from zip(units, [x.tobytes() for x in self._library([u.decode() for u in units])])

    def _ids(self, units: pa.Array) -> list[bytes]:
        """Little-endian 32-bit ids of each unit of a binary array."""
        if len(self.young) > CACHE_WORDS // 2:
            self.old, self.young = self.young, {}
        listed = _listed(units)
        found = list(map(self.young.get, listed))
        if None in found:
            missing = [i for i, x in enumerate(found) if x is None]
            again = [listed[i] for i in missing]
            letters = _letter_runs(units.take(pa.array(missing))).to_pylist()
            known = [self.old.get(u) for u in again]
            self.young.update((u, x) for u, x in zip(again, known) if x is not None)
            self.young.update(self._letters([u for u, x, ok in zip(again, known, letters) if x is None and ok]))
            self.young.update(self._each([u for u, x, ok in zip(again, known, letters) if x is None and not ok]))
            for i, u in zip(missing, again):
                found[i] = self.young[u]
        return found

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(bounds, ids): the ids of text i, and the end id behind them, are ids[bounds[i]:bounds[i + 1]]."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.values.cast(pa.string()).dictionary_encode()
        word, bounds = coded.indices.to_numpy(), split.offsets.to_numpy()
        unit = _units(coded.dictionary).dictionary_encode()
        each = self._ids(unit.dictionary)
        size, pool = np.fromiter(map(len, each), np.int64, len(each)) // 4, np.frombuffer(b"".join(each), "<i4")
        # a word's ids are those of its two units; the last word stands behind each text
        ends, pool = _gather(np.cumsum(size) - size, size, pool, unit.indices.to_numpy())
        ends, end = np.concatenate([[0], ends])[::2], [] if end_id is None else [end_id]
        first, size, pool = ends, np.append(np.diff(ends), len(end)), np.append(pool, np.array(end, "<i4"))
        ends, ids = _gather(first, size, pool, np.insert(word, bounds[1:], len(first) - 1))
        return np.concatenate([[0], ends])[bounds + np.arange(len(bounds))], ids


def _gather(first: np.ndarray, size: np.ndarray, pool: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of the pool that are wanted, one behind the other, and the end of each."""
    n = size[wanted]
    ends = np.cumsum(n)
    return ends, pool[np.repeat(first[wanted] - ends + n, n) + np.arange(n.sum())]


def _letter_runs(units: pa.Array) -> pa.Array:
    return pc.match_substring_regex(units.cast(pa.string()), f"^{_LETTERS}$")


def _units(words: pa.Array) -> pa.Array:
    """Two units for each word: a run of letters, in lower case, and what stands behind it; or the word and nothing."""
    heads = pc.ascii_rtrim(words, _PUNCTUATION)
    plain = _letter_runs(heads)
    words = pc.if_else(plain, pc.ascii_lower(words), words)
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int32, len(words) + 1, 4 * words.offset) if len(words) else np.zeros(1, np.int32)
    size = pc.if_else(plain, pc.binary_length(heads), pc.binary_length(words)).to_numpy(zero_copy_only=False)
    cuts = np.append(np.stack([at[:-1], at[:-1] + size], axis=1).ravel(), at[-1:]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), 2 * len(words), [None, pa.py_buffer(cuts), data if data is not None else pa.py_buffer(b"")])


def _listed(words: pa.Array) -> list[bytes]:
    """The words, which hold no space, as Python objects."""
    if not len(words):
        return []
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), b" ")[0].as_py().split(b" ")


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about `most` bytes of a text column; a longer text is a slice of its own."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def files_for(docs: DataFrame) -> int:
    """Files to write: the session's shuffle partitions, more where the optimizer's estimate asks for it."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(least, -(-size // FILE_BYTES)) if size < 1 << 60 else least  # beyond: the optimizer does not know


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # the place in the source splits ranges of equal ids
    ordered = source.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(files_for(source), "doc_id", "place").sortWithinPartitions("doc_id", "place").drop("place")
    long = T.LongType()
    schema = T.StructType([source.schema[0], T.StructField("part", T.IntegerType()), T.StructField("at", long), T.StructField("n_tokens", long), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches):
        e, part, before = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        for rows in by_bytes(batches, 1):
            bounds, ids = e.encode(rows.column(1), end_id)
            listed = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)).cast(pa.list_(pa.field("element", pa.int32(), False)))
            at = pa.array(before + bounds[:-1])
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.full(rows.num_rows, part, np.int32)), at, pa.array(np.diff(bounds)), listed], names=schema.names)
            before += len(ids)

    (
        ordered.mapInArrow(run, schema).write.mode("overwrite")
        .option("compression", "zstd").option("orc.create.index", "true").option("orc.row.index.stride", ROW_STRIDE).option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", BLOOM_FALSE_POSITIVES)
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str, doc_ids: list | None = None) -> DataFrame:
    """The files' rows; with ids, only theirs, and stripes are skipped by their statistics and filters."""
    df = spark.read.orc(path)
    return df if doc_ids is None else df.where(F.col("doc_id").isin(doc_ids))


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """From the files, per document: doc_id, start, n_tokens, ids_crc32.

    What lies before a file is summed over the files, one row each.
    """
    rows = read_token_files(spark, path).select("doc_id", "part", "at", "ids")
    kept = T.StructType([*rows.schema.fields[:3], T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches):
        for part in slices(batches):
            ids = part.column(3)
            values, at = memoryview(ids.values.to_numpy()).cast("B"), ids.offsets.to_numpy()  # as they lie: 32 bits, little-endian
            sums = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())], names=kept.names)

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = read_token_files(spark, path).groupBy("part").agg(F.max(F.col("at") + F.col("n_tokens")).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.mapInArrow(run, kept).join(files, "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_read(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens"
    write_token_files(docs, path, tokenizer_path, id_col, text_col)
    return token_digest(spark, path)
