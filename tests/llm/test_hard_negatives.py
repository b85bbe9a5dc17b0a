"""Hard negatives against all pairs, with one and with many cells, and odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import hard_negatives
from lodestrata.llm.common import table

FIELDS = "vec_id long, embedding array<float>, label int"
SMALL = hard_negatives.Params(cell_anchors=2)


def plain(rows, every, p=SMALL):
    known = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(p.scale * float(np.float32(x))) for x in v]
            known[i] = min(known.get(i, (label, q)), (label, q), key=lambda r: (r[0], [x.to_bytes(4, "little", signed=True) for x in r[1]]))
    out = []
    for a, (own, q) in known.items():
        if a % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(q, v)), i, label == own) for i, (label, v) in known.items() if i != a)
            for s, positive, _ in [r for r in scored if r[2]][: p.positives]:
                fits = [(i, -t) for t, i, same in scored if not same and p.low * -s <= 100 * -t <= p.high * -s][: p.negatives]
                out += [(a, positive, rank, i, -s, t) for rank, (i, t) in enumerate(fits, 1)]
    return sorted(out)


def got(rows, every, p=SMALL):
    return sorted(map(tuple, hard_negatives.mine(rows, F.col("vec_id") % every == 0, F.col("label"), p).collect()))


def clustered(rnd, n, dims=8, centres=12, spread=0.05):
    middle = [[rnd.gauss(0, 0.4) for _ in range(dims)] for _ in range(centres)]
    return [(i, [x + rnd.gauss(0, spread) for x in rnd.choice(middle)], rnd.randrange(3)) for i in range(n)]


def test_on_embeddings(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    assert got(rows, 5) == plain([(r["vec_id"], r["embedding"], r["label"]) for r in rows.collect()], 5)


@pytest.mark.parametrize("seed", range(3))
def test_many_cells_blocks_and_groups(spark, monkeypatch, seed):
    """Clusters, one vector with a third of the rows, and ties; anchors dealt to several groups, rows to several blocks."""
    monkeypatch.setattr(hard_negatives, "GROUP", 3)
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 1)
    rnd = random.Random(seed)
    rows = clustered(rnd, 400)
    rows += [(1000 + i, rows[7][1], rnd.randrange(2)) for i in range(200)]
    assert got(spark.createDataFrame(rows, FIELDS).repartition(3), 11) == plain(rows, 11)


def test_copies_go_only_where_they_may_be_wanted(spark):
    """In tight clusters nearly all copies are spared, and the result is whole."""
    rnd = random.Random(4)
    rows = [(i, [x / math.hypot(*v) for x in v], label) for i, v, label in clustered(rnd, 1500, dims=24, spread=0.01)]
    spans, seen = hard_negatives.route, []

    def counting(*args):
        out = spans(*args)
        if args[-1]:
            seen.append(out.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        return out

    hard_negatives.route = counting
    try:
        assert got(spark.createDataFrame(rows, FIELDS), 40, hard_negatives.Params(cell_anchors=3)) == plain(rows, 40)
    finally:
        hard_negatives.route = spans
    assert seen and max(seen) < 1500  # a join without bounds would make 12 copies a row


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (None, [1.0, 1.0], 1), (1, None, 1), (2, [1.0, None], 1), (3, [nan, 1.0], 1), (4, [inf, 0.0], 0), (5, [1.0, 1.0], None), (6, [], 1), (7, [1.0], 1), (8, [0.9, 0.5, 3.0], 2), (9, [0.9, 0.5], 1)]
    rows += [(10, [0.9, 0.4], 0), (10, [0.9, 0.4], 0), (10, [0.1, 0.4], 2), (11, [0.0, 0.0], 1), (12, [-1.0, -1.0], 1), (13, [0.9, 0.4], 0)]
    assert got(spark.createDataFrame(rows, FIELDS), 1) == plain(rows, 1)
    for none in ([], [(1, [1.0], 1)], [(100, None, 1)], [(100, [1.0], 1)], [(100, [], 1), (1, [], 1), (2, [], 2)]):
        assert got(spark.createDataFrame(none, FIELDS), 100) == plain(none, 100)


def test_clashing_and_extra_columns(spark):
    rows = [(i, [math.sin(i), math.cos(i)], i % 3) for i in range(40)]
    df = spark.createDataFrame(rows, FIELDS).withColumns({c: F.lit("x") for c in ("id", "v", "anchor", "cell", "norm", "rank")})
    assert got(df, 4) == plain(rows, 4)


def test_scores_are_exact():
    rnd = np.random.default_rng(1)
    for most in (100, 1 << 26, 1 << 30):
        a, b = rnd.integers(-most, most, (5, 7)), rnd.integers(-most, most, (6, 7))
        if 7 * most**2 < 1 << 63:
            assert hard_negatives.scores(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
    with pytest.raises(OverflowError):
        hard_negatives.scores(np.full((1, 9), 1 << 31), np.full((1, 9), 1 << 31))
