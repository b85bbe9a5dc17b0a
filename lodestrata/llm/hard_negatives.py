"""Hard negatives by an exact nearest-neighbour join over a Voronoi partition.

A score is an inner product of quantised vectors.  Rows get one more coordinate, sqrt(M^2 - |row|^2) with
M the longest row, and anchors get 0 there: then a greater score is a smaller distance, and distances obey
the triangle inequality.

1. Pivots are picked from a bounded sample, farthest first; every row and every anchor belongs to the cell
   of its nearest pivot.
2. Anchors search the rows of their own cell first.  The k-th score found, or the end of a window that
   is not full yet, bounds how far an anchor still has to look.
3. Each cell keeps the greatest (distance to the pivot + bound) of its anchors, and the smallest distance
   that they can use.  A row is copied to those cells only in which these leave room for it, by its own
   distance to the pivot of the cell.  No copy that could be in a result is left out.
4. A cell is joined in blocks of about BLOCK_BYTES of rows by GROUP anchors, so hot cells are many tasks; a
   block returns its best `k` rows for each window of an anchor, and these are merged.

The same search finds the positives (rows of the anchor's label, one window without bounds) and the
negatives (rows of other labels, one window of scores for each positive).

Defined results: rows with a null id, label, vector or component, or one that is not finite, take no part;
of several rows with one id the one with the smallest label, then vector, does; ties go to the smaller id;
shorter vectors are filled up with zeros; empty vectors score 0; anchors without a positive or a fitting negative
have no row; an empty table gives no rows.  Components over 2^31 once scaled, and scores over 63 bits, are errors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import saved, shared_dir

#: Anchors of a block, bytes of its rows and of its scores, and copies of rows that a task holds at once.
GROUP, BLOCK_BYTES, SCORE_BYTES, COPIES = 1024, 1 << 20, 8 << 20, 20_000
#: Buckets of labels with bounds of their own.
LABELS = 64
_LEAST, _MOST = -(1 << 62), 1 << 62


@dataclass(frozen=True)
class Params:
    """`low` and `high` percent of a positive's score bound its negatives; anchors of a cell, about; pivots at most,
    and the rows (and bytes) of the sample from which they are picked."""

    scale: int = 256
    positives: int = 5
    negatives: int = 5
    low: int = 80
    high: int = 100
    cell_anchors: int = 128
    most_pivots: int = 1024
    sample_rows: int = 4096
    sample_bytes: int = 32 << 20


# ------------------------------------------------------------------ vectors


def matrix(column, width: int) -> np.ndarray:
    """Binary vectors as rows, filled up with zeros."""
    found = column.to_pylist()
    if all(len(v) == 4 * width for v in found):
        return np.frombuffer(b"".join(found), "<i4").reshape(len(found), width).astype(np.int64)
    out = np.zeros((len(found), width), np.int64)
    for row, v in zip(out, found):
        row[: len(v) // 4] = np.frombuffer(v, "<i4")
    return out


def scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products; through floating point only where that is exact."""
    most = int(np.abs(left).max(initial=0)) * int(np.abs(right).max(initial=0)) * left.shape[1]
    if most < 1 << 53:
        return (left.astype(np.float64) @ right.T.astype(np.float64)).astype(np.int64)
    if most >= 1 << 63:
        raise OverflowError("an inner product may need more than 63 bits")
    return left @ right.T


def quantised(rows: DataFrame, scale: int) -> DataFrame:
    """id, label, anchor, v (little-endian 32-bit components) and norm of the rows that take part."""

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            lengths, values = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            odd = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            keep = np.flatnonzero(odd[ends] == odd[ends - lengths])
            whole = np.floor(scale * np.where(np.isfinite(values), values, 0))
            if len(whole) and np.abs(whole).max() >= 1 << 31:
                raise OverflowError("a component needs more than 32 bits")
            kept = [whole[ends[i] - lengths[i] : ends[i]] for i in keep.tolist()]
            v, norm = pa.array([x.astype("<i4").tobytes() for x in kept], pa.binary()), np.array([math.sqrt(x @ x) for x in kept])
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(pa.array(keep)) for i in range(3)], v, pa.array(norm, pa.float64())], names=["id", "label", "anchor", "v", "norm"])

    return rows.where("id is not null and label is not null and v is not null").mapInArrow(run, "id bigint, label bigint, anchor boolean, v binary, norm double")


def one_row_an_id(rows: DataFrame, folder: str) -> DataFrame:
    if rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return rows
    return saved(rows.groupBy("id").agg(F.min(F.struct("label", "v", "anchor", "norm")).alias("r")).select("id", "r.label", "r.anchor", "r.v", "r.norm"), folder, "single")


# ------------------------------------------------------------------ cells


@dataclass(frozen=True)
class Cells:
    """Pivots with their last coordinate, and the longest row."""

    pivots: np.ndarray
    last: np.ndarray
    longest: float

    @property
    def slack(self) -> float:
        """More than rounding can move a distance."""
        return 1e-5 * (1 + self.longest)

    def distances(self, v: np.ndarray, norm: np.ndarray, anchors: bool) -> np.ndarray:
        inner = v.astype(np.float64) @ self.pivots.T
        if anchors:
            return np.sqrt(np.maximum(0, (norm**2 + self.longest**2)[:, None] - 2 * inner))
        own = np.sqrt(np.maximum(0, self.longest**2 - norm**2))
        return np.sqrt(np.maximum(0, 2 * self.longest**2 - 2 * (inner + own[:, None] * self.last)))


def pick_cells(rows: DataFrame, n: int, width: int, longest: float, p: Params) -> Cells:
    """Up to n pivots, farthest first, from the rows with the smallest hashes of their ids."""
    most = max(1, min(4 * n, p.sample_rows, p.sample_bytes // (4 * max(1, width))))
    found = rows.select("v", "norm", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(most).collect()
    v = matrix(pa.array([r["v"] for r in found], pa.binary()), width).astype(np.float64)
    last = np.sqrt(np.maximum(0, longest**2 - np.array([r["norm"] for r in found]) ** 2))
    full, chosen = np.column_stack([v, last]), [0]
    nearest = ((full - full[0]) ** 2).sum(axis=1)
    while len(chosen) < n and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((full - full[chosen[-1]]) ** 2).sum(axis=1))
    return Cells(v[chosen], last[chosen], longest)


def place(rows: DataFrame, cells, width: int, anchors: bool) -> DataFrame:
    """The rows with their cell, and their distance to its pivot."""

    def run(batches):
        own = cells.value
        for batch in batches:
            away = own.distances(matrix(batch.column("v"), width), batch.column("norm").to_numpy(), anchors)
            cell = away.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(away[np.arange(len(cell)), cell])], names=[*batch.schema.names, "cell", "away"])

    return rows.select("id", "label", "v", "norm").mapInArrow(run, "id bigint, label bigint, v binary, norm double, cell int, away double")


# ------------------------------------------------------------------ search


def bounds(queries: DataFrame, cells: Cells, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each cell and bucket of labels the greatest distance from the pivot at which a row may be wanted, and for each
    cell the smallest.  `queries` have lo and hi, arrays of the scores that are still of use."""
    square = F.pow("norm", F.lit(2)) + F.lit(cells.longest**2)
    far = F.sqrt(F.greatest(F.lit(0.0), square - 2.0 * F.array_min("lo")))
    near = F.sqrt(F.greatest(F.lit(0.0), square - 2.0 * F.array_max("hi")))
    bucket = F.pmod("label", F.lit(LABELS)) if same else F.lit(0)
    found = queries.where("size(lo) > 0").groupBy("cell", bucket.alias("bucket")).agg(F.max(F.col("away") + far).alias("reach"), F.min(near - F.col("away")).alias("near")).collect()  # a row a cell and bucket
    reach, least = np.full((len(cells.pivots), LABELS if same else 1), -np.inf), np.full(len(cells.pivots), np.inf)
    for r in found:
        reach[r["cell"], r["bucket"]] = r["reach"]
        least[r["cell"]] = min(least[r["cell"]], r["near"])
    return reach, least


def route(rows: DataFrame, cells, width: int, limits, counted: bool) -> DataFrame:
    """A copy of a row for every cell but its own whose anchors may want it; or, `counted`, the number of them by cell."""

    def run(batches):
        own, (reach, near) = cells.value, limits.value
        labels = reach.shape[1]
        for batch in batches:
            for at in range(0, batch.num_rows, step := max(1, COPIES // len(own.pivots))):
                part = batch.slice(at, step)
                away = own.distances(matrix(part.column("v"), width), part.column("norm").to_numpy(), False)
                bucket = part.column("label").to_numpy() % labels
                wanted = (away - own.slack <= reach.T[bucket]) & (away + own.slack >= near)
                wanted[np.arange(len(away)), part.column("cell").to_numpy()] = False
                if counted:
                    n = wanted.sum(axis=0)
                    to = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(n[to], pa.int64())], names=["cell", "n"])
                else:
                    row, to = np.nonzero(wanted)
                    copied = part.select(["id", "label", "v"]).take(pa.array(row)) if len(row) else part.select(["id", "label", "v"]).slice(0, 0)
                    yield pa.RecordBatch.from_arrays([*copied.columns, pa.array(to, pa.int32())], names=["id", "label", "v", "cell"])

    return rows.mapInArrow(run, "cell int, n bigint" if counted else "id bigint, label bigint, v binary, cell int")


def best(score: np.ndarray, lo: list[int], hi: list[int], k: int) -> list[np.ndarray]:
    """For each window of scores the positions of its k greatest, the first of equal ones."""
    found = np.flatnonzero((score >= min(lo)) & (score <= max(hi)))
    if len(lo) == 1 and len(found) > 4 * k:  # only the first k are wanted
        found = found[score[found] >= np.partition(score[found], -k)[-k]]
    found = found[np.argsort(-score[found], kind="stable")]
    down = -score[found]
    return [found[a : min(a + k, b)] for a, b in ((np.searchsorted(down, -h, "left"), np.searchsorted(down, -x, "right")) for x, h in zip(lo, hi))]


def search_block(rows: pa.Table, queries: pa.Table, width: int, same: bool, k: int) -> pa.Table:
    """anchor, window, id and score: the best k rows of each window of each anchor."""
    out: list[tuple[int, int, int, int]] = []
    if rows.num_rows and queries.num_rows:
        ids = rows.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, labels, v = ids[order], rows.column("label").to_numpy()[order], matrix(rows.column("v"), width)[order]
        q, own, names = matrix(queries.column("q"), width), queries.column("label").to_numpy(), queries.column("anchor").to_numpy()
        lows, highs = queries.column("lo").to_pylist(), queries.column("hi").to_pylist()
        step = max(1, SCORE_BYTES // (8 * len(ids)))
        for at in range(0, len(q), step):
            for i, score in enumerate(scores(q[at : at + step], v), at):
                if lows[i]:
                    fits = np.flatnonzero(((labels == own[i]) == same) & (ids != names[i]))
                    for window, hits in enumerate(best(score[fits], lows[i], highs[i], k)):
                        out += [(names[i], window, ids[x], score[x]) for x in fits[hits].tolist()]
    columns = list(zip(*out)) or [[], [], [], []]
    return pa.table([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["anchor", "window", "id", "score"])


def join_cells(rows: DataFrame, sizes: DataFrame, queries: DataFrame, width: int, same: bool, k: int) -> DataFrame:
    """What the rows (id, label, v, cell) of each cell hold for its anchors.  `sizes`: rows by cell."""
    block_rows, spark = max(64, BLOCK_BYTES // (4 * max(1, width))), rows.sparkSession
    anchors = {r["cell"]: r["n"] for r in queries.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a cell
    parts = [(r["cell"], math.ceil(r["n"] / block_rows), math.ceil(anchors[r["cell"]] / GROUP)) for r in sizes.collect() if r["n"] and r["cell"] in anchors]
    cut = F.broadcast(spark.createDataFrame(parts, "cell int, blocks int, groups int"))
    left = rows.join(cut, "cell").select("id", "label", "v", "cell", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"))
    right = queries.join(cut, "cell").select(F.col("id").alias("anchor"), "label", F.col("v").alias("q"), "lo", "hi", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("id"), F.col("groups")).cast("int").alias("part"))
    return left.groupBy("cell", "block", "part").cogroup(right.groupBy("cell", "block", "part")).applyInArrow(lambda a, b: search_block(a, b, width, same, k), "anchor bigint, window int, id bigint, score bigint")


def first_of(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of each window, with their rank."""
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(rows: DataFrame, queries: DataFrame, cells: Cells, shared, width: int, same: bool, k: int, folder: str, name: str) -> DataFrame:
    """anchor, window, id, score and rank of the best k rows in each window [lo, hi] of each anchor."""
    own = join_cells(rows.select("id", "label", "v", "cell"), rows.groupBy("cell").agg(F.count("*").alias("n")), queries, width, same, k)
    if len(cells.pivots) == 1:
        return saved(first_of(own, k), folder, name)
    own = saved(first_of(own, k).drop("rank"), folder, f"{name}-own")
    full = own.groupBy("anchor", "window").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
    floors = full.groupBy(F.col("anchor").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("window", "least"))).alias("floors"))  # an entry a window
    raised = F.transform("lo", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("floors", i), x)))
    queries = saved(queries.join(floors, "id", "left").withColumn("lo", raised).drop("floors"), folder, f"{name}-queries")
    limits = rows.sparkSession.sparkContext.broadcast(bounds(queries, cells, same))
    sizes = route(rows, shared, width, limits, True).groupBy("cell").agg(F.sum("n").alias("n"))
    far = join_cells(route(rows, shared, width, limits, False), sizes, queries, width, same, k)
    return saved(first_of(own.unionByName(far), k), folder, name)


def mine(rows: DataFrame, is_anchor: Column, label: Column, p: Params = Params(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for the rows that are anchors.

    Anchors are the queries, meant to be a small part of the rows; `label` gives a row's label, an integer.
    """
    spark, folder = rows.sparkSession, shared_dir(rows.sparkSession)
    source = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    vectors = one_row_an_id(saved(quantised(source, p.scale), folder, "vectors"), folder)
    found = vectors.agg(F.count_if("anchor").alias("anchors"), F.max("norm").alias("longest"), F.max(F.octet_length("v")).alias("bytes")).first()
    out = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not found["anchors"]:
        return spark.createDataFrame([], out)
    width = found["bytes"] // 4
    cells = pick_cells(vectors, min(p.most_pivots, math.ceil(found["anchors"] / p.cell_anchors)), width, found["longest"], p)
    shared = spark.sparkContext.broadcast(cells)
    placed = saved(place(vectors, shared, width, False), folder, "placed")
    anchors = saved(place(vectors.where("anchor"), shared, width, True), folder, "anchors")
    wide = anchors.withColumns({"lo": F.array(F.lit(_LEAST)), "hi": F.array(F.lit(_MOST))})
    positives = search(placed, wide, cells, shared, width, True, p.positives, folder, "positives")
    # a score under 0 has no window, and scores fall with the rank, so a window's place is its rank
    window = F.struct("rank", F.expr(f"({p.low} * score + 99) div 100").alias("lo"), F.expr(f"{p.high} * score div 100").alias("hi"))
    windows = positives.where("score >= 0").groupBy(F.col("anchor").alias("id")).agg(F.sort_array(F.collect_list(window)).alias("w"))  # one for each positive
    narrow = anchors.join(windows, "id").withColumns({"lo": F.col("w.lo"), "hi": F.col("w.hi")}).drop("w")
    negatives = search(placed, narrow, cells, shared, width, False, p.negatives, folder, "negatives")
    of = positives.select("anchor", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return negatives.join(of, ["anchor", "window"]).select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
