"""Near-duplicates by banded MinHash with sequential Bayesian verification.

1. A document is a set of word shingles.  Equal sets collapse to one representative first, so exact
   copies, however many, are one node from here on.
2. Representatives with an equal band of their signatures share a bucket.  Each bucket first links
   its members to its smallest one only; buckets that this leaves in one component are done.
3. In the others, members of different components meet block by block.  A pair is compared on batches
   of its signatures, in the first band that it shares, and dropped once the posterior probability
   that its similarity reaches the threshold is under `miss`.  Texts move only for members of surviving
   pairs, which are then verified on the full sets, unless links found before have joined them.  A block
   returns a spanning forest of its links, so what leaves it grows with its members, not with their pairs.
4. Components come from large-star and small-star rounds.  No step holds a bucket, a component or a
   list of pairs in one task: what a group has in common (its head, its size) is aggregated with
   map-side combining and joined back to its members over key and salt, so a hot group is dealt to
   SALTS tasks, each of which the adaptive planner may split further.

Defined results: null and empty texts have no shingle and are linked with nothing; a text with fewer
words than a shingle is one shingle; rows with equal ids are one node (their sets are all compared
under that id); a null id has a null component, takes part in no link and is kept; the smallest id of
a component is its class and the row that is kept, so ties cannot arise; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm.common import WordCache, map_text, saved, shared_dir, slices

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))


@dataclass(frozen=True)
class Params:
    """Similarity `percent`/100 on shingles of `shingle` words; `miss` bounds what bands and pruning lose."""

    shingle: int = 5
    percent: int = 80
    rows: int = 4
    miss: float = 1e-6
    batch: int = 16
    seed: int = 7

    @property
    def threshold(self) -> float:
        return self.percent / 100

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log(1 - self.threshold**self.rows))

    @property
    def size(self) -> int:
        return self.rows * self.bands

    @cached_property
    def factors(self) -> np.ndarray:
        return np.random.default_rng(self.seed).integers(1 << 32, 1 << 63, self.size, dtype=np.uint64) | np.uint64(1)

    @cached_property
    def least(self) -> list[tuple[int, int]]:
        """(hashes compared, equal ones needed to go on) after each batch.  With a uniform prior the
        posterior P(J >= t | m of n) is P(Binomial(n + 1, t) <= m)."""
        out, t = [], self.threshold
        for n in [*range(self.batch, self.size, self.batch), self.size]:
            p, m = (1 - t) ** (n + 1), 0
            total = p
            while total < self.miss:
                m += 1
                p *= (n + 2 - m) / m * t / (1 - t)
                total += p
            out.append((n, m))
        return out


def shingle_set(text: str, k: int, cache: WordCache) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = text.encode().lower().split()
    n = min(k, len(words))
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out ^ h[i : len(words) - n + 1 + i]) * _M1
        out ^= out >> np.uint64(32)
    out *= _M2
    return np.unique(out ^ (out >> np.uint64(29)))


def signature(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(least, np.multiply.outer(shingles[at : at + 1024], factors).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def word_cache() -> WordCache:
    return WordCache(xxhash.xxh3_64_intdigest)


def signatures(docs: DataFrame, id_col: str, text_col: str, p: Params) -> DataFrame:
    """id, text_key (of the text), n_shingles, set_key (null without shingles), sig: little-endian 32-bit minima."""
    factors = p.factors

    def factory():
        cache = word_cache()

        def work(text):
            s = shingle_set(text, p.shingle, cache) if text else ()
            return (len(s), xxhash.xxh3_128_digest(s.tobytes()), signature(s, factors).tobytes()) if len(s) else (0, None, None)

        return work

    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    return map_text(source, ["id", "text_key"], "text", factory, "n_shingles bigint, set_key binary, sig binary")


def _matrix(column, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, size)


def alike(left: np.ndarray, right: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of equal-length signature matrices: which survive all batches, and their equal hashes."""
    rows, equal, at = np.arange(len(left)), np.zeros(len(left), np.int32), 0
    for n, need in p.least:
        equal = equal + (left[rows, at:n] == right[rows, at:n]).sum(axis=1, dtype=np.int32)
        stay = equal >= need
        rows, equal, at = rows[stay], equal[stay], n
    return rows, equal


# ------------------------------------------------------------------ hot groups

#: Parts into which the members of a group are dealt (bits of a bigint).
SALTS = 64


def salted(rows: DataFrame, member: str) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64(member), F.lit(SALTS)).cast("int"))


def salts_seen() -> Column:
    """An aggregate: the salts of a group's members, as a bitmap."""
    return F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts")


def spread(groups: DataFrame) -> DataFrame:
    """One row for each salt that a group's members have, so no more rows than members."""
    there = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda x: F.getbit("salts", x) == 1)
    return groups.withColumn("salt", F.explode(there)).drop("salts")


# ------------------------------------------------------------------ connected components


def _is_stars(edges: DataFrame) -> bool:
    many = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    return not many and not edges.select("u").join(edges.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count()


def components(edges: DataFrame, folder: str, tag: str) -> DataFrame:
    """(u, v) with v the smallest node of u's component, for every node that is not the smallest.

    Alternating large-star and small-star rounds; each round's edges are a table in the shared folder.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    edges, step = saved(edges, folder, f"{tag}-0"), 0
    while not _is_stars(edges):
        step += 1
        both = salted(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "v")
        larger = F.col("v") > F.col("u")  # only these move, so only their salts are wanted
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.bit_or(F.when(larger, F.expr("shiftleft(1L, salt)")).otherwise(F.lit(0).cast("long"))).alias("salts"))
        large = both.where(larger).join(spread(least), ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = salted(large, "v")
        least = spread(large.groupBy("u").agg(F.min("v").alias("m"), salts_seen()))
        small = large.join(least, ["u", "salt"]).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = saved(small, folder, f"{tag}-{step}")
    return edges


# ------------------------------------------------------------------ candidates and verification

#: Texts on one side of a block and their shingles, about, and texts that are verified against one
#: other text at once.
BLOCK, BLOCK_SHINGLES, GROUP = 256, 1 << 20, 64


def _buckets(reps: DataFrame, folder: str, p: Params) -> DataFrame:
    """band, key, salt, rep, n_shingles, head (its smallest member) and size of the buckets with at least two members."""
    width = 4 * p.rows
    keys = F.array(*[F.struct(F.lit(i).alias("band"), F.xxhash64(F.lit(i), F.expr(f"substring(sig, {i * width + 1}, {width})")).alias("key")) for i in range(p.bands)])
    bands = salted(reps.select("rep", "n_shingles", F.explode(keys).alias("k")).select("rep", "n_shingles", "k.*"), "rep")
    shared = bands.groupBy("band", "key").agg(F.min("rep").alias("head"), F.max("rep").alias("last"), F.count("*").alias("size"), salts_seen()).where("head <> last").drop("last")
    return saved(bands.join(spread(shared), ["band", "key", "salt"]).select("band", "key", "salt", "rep", "n_shingles", "head", "size"), folder, "buckets")


def _dealt(buckets: DataFrame) -> DataFrame:
    """(a, b, g): every partner a of a head b once, in groups that have GROUP texts and BLOCK_SHINGLES shingles at most but for
    chance and for single texts: by the number and the shingles of all different partners of b, in whatever buckets, half of
    that is what a group has on average."""
    pairs = salted(buckets.where("rep <> head").groupBy(F.col("rep").alias("a"), F.col("head").alias("b")).agg(F.max("n_shingles").alias("s")), "a")
    groups = F.greatest(F.ceil(2 * F.count("*") / GROUP), F.ceil(2 * F.sum("s") / BLOCK_SHINGLES)).alias("groups")
    return pairs.join(spread(pairs.groupBy("b").agg(groups, salts_seen())), ["b", "salt"]).select("a", "b", F.pmod(F.xxhash64("a", "b"), F.col("groups")).alias("g"))


def _star_links(buckets: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """Links (u, v) between members and the smallest ones of their buckets.

    Each group of a head's partners holds the head once; so the head of a hot bucket, or of many small ones, is in
    many small groups.
    """
    kind = buckets.schema["rep"].dataType.simpleString()
    dealt = _dealt(buckets)
    left = dealt.join(texts.withColumnRenamed("id", "a"), "a").select("b", "g", "a", "text", "sig")
    right = dealt.select("b", "g").distinct().join(texts.withColumnRenamed("id", "b"), "b").select(F.col("b").alias("head"), F.col("g").alias("part"), F.col("text").alias("head_text"), F.col("sig").alias("head_sig"))

    def run(members: pa.Table, heads: pa.Table) -> pa.Table:
        cache, sig, hits = word_cache(), _matrix(members.column("sig"), p.size), []
        for text, own in zip(heads.column("head_text"), _matrix(heads.column("head_sig"), p.size)):
            head = shingle_set(text.as_py(), p.shingle, cache)
            rows, _ = alike(sig, np.broadcast_to(own, sig.shape), p)
            hits += [x for x in rows.tolist() if reaches(head, shingle_set(members.column("text")[x].as_py(), p.shingle, cache), p.percent)]
        return members.select(["a", "b"]).take(pa.array(sorted(set(hits)), pa.int64())).rename_columns(["u", "v"])

    return left.groupBy("b", "g").cogroup(right.groupBy("head", "part")).applyInArrow(run, f"u {kind}, v {kind}")


def _open_buckets(buckets: DataFrame, stars: DataFrame) -> DataFrame:
    """band, key, salt, rep, comp of the buckets whose members are in several components.

    Of buckets with equal members only the one of the first band stays.
    """
    on = ["band", "key"]
    placed = buckets.join(stars.select(F.col("u").alias("rep"), F.col("v").alias("comp")), "rep", "left").select(*on, "salt", "rep", F.coalesce("comp", "rep").alias("comp"))
    several = (
        placed.groupBy(on).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("same"), salts_seen()).where("lo <> hi")
        .groupBy("n", "same").agg(F.min(F.struct(*on, "salts")).alias("first")).select("first.*")
    )
    return placed.join(spread(several), [*on, "salt"])


def survivors(x: int, label: np.ndarray, right: np.ndarray, sig: np.ndarray, band: int, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """The right rows that row x may be linked to, and their equal hashes: not of its component, not
    pruned by their signatures, and without an earlier band in common, as such pairs meet there."""
    y = right[label[right] != label[x]]
    rows, equal = alike(np.broadcast_to(sig[x], (len(y), p.size)), sig[y], p)
    y, earlier = y[rows], band * p.rows
    if earlier:
        y, equal = (z[~(sig[y, :earlier] == sig[x, :earlier]).reshape(len(y), band, p.rows).all(axis=2).any(axis=1)] for z in (y, equal))
    return y, equal


def involved(comp: np.ndarray, right: np.ndarray, sig: np.ndarray, band: int, p: Params) -> np.ndarray:
    """Which rows of a block are in a surviving pair."""
    label, out = np.unique(comp, return_inverse=True)[1], np.zeros(len(comp), bool)
    other = np.flatnonzero(right)
    for x in np.flatnonzero(~right).tolist():
        y, _ = survivors(x, label, other, sig, band, p)
        out[x] = len(y) > 0
        out[y] = True
    return out


def join_block(comp: np.ndarray, right: np.ndarray, sig: np.ndarray, texts: list[str], band: int, p: Params) -> list[tuple[int, int]]:
    """A spanning forest of the verified links between the left and the right side of a block."""
    left, right = np.flatnonzero(~right), np.flatnonzero(right)
    label, sets, cache = np.unique(comp, return_inverse=True)[1], {}, word_cache()

    def shingles(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shingle_set(texts[i], p.shingle, cache)
        return sets[i]

    out = []
    for x in left.tolist():
        y, equal = survivors(x, label, right, sig, band, p)
        for z in y[np.argsort(-equal, kind="stable")].tolist():
            if label[x] != label[z] and reaches(shingles(x), shingles(z), p.percent):
                out.append((x, z))
                label[label == label[z]] = label[x]
    return out


def reaches(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least percent / 100."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= percent * (len(both) - same)


def _block_links(opened: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """Links (u, v) between components of the open buckets.

    The members of a bucket's largest component need no comparison among themselves, so only the
    others are dealt against all, in blocks of about BLOCK by BLOCK.
    """
    on, kind = ["band", "key"], opened.schema["rep"].dataType.simpleString()
    opened = opened.join(texts.groupBy(F.col("id").alias("rep")).agg(F.max("n_shingles").alias("n_shingles")), "rep")
    sizes = opened.groupBy(*on, "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"), salts_seen())
    totals = sizes.groupBy(on).agg(F.max(F.struct("n", "comp", "s")).alias("m"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.bit_or("salts").alias("salts"))
    cut = lambda n, s: F.greatest(F.ceil(n / BLOCK), F.ceil(s / BLOCK_SHINGLES))
    counts = totals.select(*on, "salts", F.col("m.comp").alias("main"), cut(F.col("m.n"), F.col("m.s")).alias("cm"), cut(F.col("n") - F.col("m.n"), F.col("s") - F.col("m.s")).alias("co"))
    rows = opened.join(spread(counts), [*on, "salt"]).withColumn("is_main", F.col("comp") == F.col("main"))
    rows = rows.withColumn("c", F.pmod(F.xxhash64("rep", "key"), F.when(F.col("is_main"), F.col("cm")).otherwise(F.col("co"))))
    cell = lambda i, j, side: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"), F.lit(side).alias("right"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    as_main = F.transform(F.sequence(zero, F.col("co") - one), lambda x: cell(x, F.col("c"), True))
    as_left = F.transform(F.filter(F.sequence(zero, F.col("cm") + F.col("co") - one), lambda x: (x < F.col("cm")) | (x - F.col("cm") >= F.col("c"))), lambda x: cell(F.col("c"), x, False))
    as_right = F.transform(F.sequence(zero, F.col("c")), lambda x: cell(x, F.col("cm") + F.col("c"), True))
    cells = F.when(F.col("is_main"), as_main).otherwise(F.concat(as_left, as_right))
    place = [*on, "i", "j", "right", "rep", "comp"]
    signed = rows.select(*on, "rep", "comp", cells.alias("cells")).join(texts.select(F.col("id").alias("rep"), "sig").distinct(), "rep")
    blocks = signed.select(*on, "rep", "comp", "sig", F.explode("cells").alias("cell")).select(*on, "cell.*", "rep", "comp", "sig")

    def sides(block: pa.Table) -> tuple:
        return block.column("comp").to_numpy(), np.array(block.column("right").to_pylist(), bool), _matrix(block.column("sig"), p.size), block.column("band")[0].as_py()

    def prune(block: pa.Table) -> pa.Table:
        comp, right, sig, band = sides(block)
        return block.filter(pa.array(involved(comp, right, sig, band, p))).select(place)

    def verify(block: pa.Table) -> pa.Table:
        comp, right, sig, band = sides(block)
        links, rep = join_block(comp, right, sig, block.column("text").to_pylist(), band, p), block.column("rep")
        return pa.table({"u": rep.take(pa.array([x for x, _ in links], pa.int64())), "v": rep.take(pa.array([y for _, y in links], pa.int64()))})

    kept = T.StructType([blocks.schema[name] for name in place])
    pairs = blocks.groupBy(*on, "i", "j").applyInArrow(prune, kept).distinct()
    full = pairs.join(texts.select(F.col("id").alias("rep"), "sig", "text"), "rep")
    return full.groupBy(*on, "i", "j").applyInArrow(verify, f"u {kind}, v {kind}")


def near_duplicates(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: id, n_shingles, component_id (smallest id reachable), kept (id is that one)."""
    spark, p = docs.sparkSession, params
    folder = shared_dir(spark)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = saved(signatures(source, "id", "text", p), folder, "signatures")
    linkable = salted(signed.where(F.col("set_key").isNotNull() & F.col("id").isNotNull()), "id")
    reps = saved(linkable.groupBy("set_key").agg(F.min(F.struct("id", "text_key")).alias("r"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), salts_seen()).select("set_key", F.col("r.id").alias("rep"), "r.text_key", "n_shingles", "sig", "salts"), folder, "sets")
    # ids that repeat with other texts: the id is one node, so its sets meet in the smallest of their representatives
    repeated = linkable.groupBy("id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).where("lo <> hi").select("id")
    moved = linkable.select("id", "set_key").join(repeated, "id").join(reps.select("set_key", "rep"), "set_key")
    tied = moved.where("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    buckets = _buckets(reps, folder, p)
    # the texts of bucket members, one for each set: the documents are shuffled this once
    wanted = reps.join(buckets.select("rep").distinct(), "rep").select(F.col("rep").alias("id"), "text_key", "n_shingles", "sig")
    texts = saved(source.withColumn("text_key", F.xxhash64("text")).join(wanted, ["id", "text_key"]).dropDuplicates(["id", "text_key"]).drop("text_key"), folder, "texts")
    stars = components(_star_links(buckets, texts, p).union(tied), folder, "first")
    opened = saved(_open_buckets(buckets, stars), folder, "open")
    if not opened.isEmpty():
        stars = components(stars.union(_block_links(opened, texts, p)), folder, "all")
    sets = reps.select("set_key", "rep", "salts").join(stars.select(F.col("u").alias("rep"), F.col("v").alias("comp")), "rep", "left").select("set_key", "salts", F.coalesce("comp", "rep").alias("comp"))
    linked = linkable.select("id", "n_shingles", "set_key", "salt").join(spread(sets), ["set_key", "salt"]).select("id", "n_shingles", "comp")
    alone = signed.where(F.col("set_key").isNull() | F.col("id").isNull()).select("id", "n_shingles", F.col("id").alias("comp"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_shingles", F.col("comp").alias("component_id"), (F.col("id").isNull() | (F.col("id") == F.col("comp"))).alias("kept"))


def deduplicate(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose id is the smallest of its component; of equal rows of one id and text one stays."""
    found = near_duplicates(docs, params, id_col, text_col)
    gone = found.where("not kept").select(F.col(id_col).alias("__gone")).distinct()
    kept = docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
    again = found.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__again")).agg(F.count("*").alias("__n")).where("__n > 1").select("__again")
    if again.isEmpty():
        return kept
    on = kept[id_col] == again["__again"]
    return kept.join(again, on, "left_anti").unionByName(kept.join(again, on, "left_semi").dropDuplicates([id_col, text_col]))
