"""The mix against a plain version, its schedule, and odd tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from lodestrata.llm import mixing
from lodestrata.llm.common import table


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_targets(sizes, weights=(1, 2, 3), epochs=3):
    """source -> target, by capping and sharing again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, total, capped = {s: weights[i % len(weights)] for i, s in enumerate(names)}, sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(epochs * sizes[s] for s in capped)
        share = {s: Fraction(rest * weight[s], sum(weight[x] for x in free)) for s in free}
        above = {s for s in free if share[s] > epochs * sizes[s]}
        if not above:
            return {s: float(share.get(s, epochs * sizes[s])) for s in names}
        capped |= above


def plain(rows):
    """Sorted (doc_id, size, source_size, target, taken)."""
    sizes, streams = Counter(), defaultdict(list)
    for i, text, source in rows:
        n = len(words(text))
        sizes[source] += n
        h = hashlib.md5(f"mix:{'' if i is None else i}:{text or ''}".encode()).hexdigest()[: mixing.DIGITS]
        streams[source].append((h, i is not None, i or 0, n))
    target, out = plain_targets(sizes), []
    for source, stream in streams.items():
        want, start = int(target[source] + 0.5), 0
        for _, known, i, n in sorted(stream):
            taken = sum(max(0, min(want, p * sizes[source] + start + n) - p * sizes[source] - start) for p in range(3))
            out.append((i if known else None, n, sizes[source], target[source], taken))
            start += n
    return sorted(out, key=str)


def got(df):
    assert df.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    return sorted(map(tuple, df.collect()), key=str)


def check(found, wanted):
    assert [r[:3] + r[4:] for r in found] == [r[:3] + r[4:] for r in wanted]
    assert [r[3] for r in found] == pytest.approx([r[3] for r in wanted], rel=1e-12)


FIELDS = "doc_id long, text string, source string"


def test_mix_of_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = got(mixing.mix(docs))
    check(found, plain([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]))
    assert found == got(mixing.mix(docs.repartition(7)))  # reruns agree, however the rows are dealt
    assert all(r[4] <= 3 * r[1] for r in found)


def test_hot_and_tiny_sources(spark, monkeypatch):
    """A source with most rows, sources that are capped, a null source, sources without a word; several buckets and levels."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    monkeypatch.setattr(mixing, "LEVEL", 3)
    rnd = random.Random(3)
    name = lambda: rnd.choice(["hot"] * 12 + ["b", "a", "é", "z", "\U0001f600", None])
    rows = [(i, " ".join(["w"] * rnd.choice([0, 1, 3, 40])), name()) for i in range(400)] + [(1000, "one", "tiny"), (1001, "", "none"), (1002, "w " * 5000, "long")]
    docs = spark.createDataFrame(rows, FIELDS)
    found = got(mixing.mix(docs, mixing.Params(block_words=8)))
    check(found, plain(rows))
    assert {r[0]: r[4] for r in found}[1000] == 3


def test_slots_follow_the_targets_everywhere(spark):
    spans = spark.createDataFrame([(1, 0, 100), (2, 100, 101), (3, 101, 400), (4, 400, 1024)], "position long, lo long, hi long")
    rows = sorted(map(tuple, mixing.slots(spans, 10).collect()))
    assert [r[0] for r in rows] == list(range(1024))
    seen = Counter()
    for slot, position, block in rows:
        assert block == seen[position]
        seen[position] += 1
    assert seen == {1: 100, 2: 1, 3: 299, 4: 624}
    for run in (32, 128):  # any aligned run holds each source in its share
        for at in range(0, 1024, run):
            held = Counter(r[1] for r in rows[at : at + run])
            assert all(abs(held[s] - n * run / 1024) <= 1 for s, n in seen.items())


def test_plan_covers_each_stream_once_a_pass(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    streamed, mixed = mixing.plan(docs, mixing.Params(block_words=64))
    size = {r["doc_id"]: r["size"] for r in streamed.collect()}
    spans, blocks = defaultdict(list), Counter()
    for r in mixed.collect():
        spans[r["doc_id"], r["pass"]].append((r["from_word"], r["words_taken"]))
        blocks[r["position"], r["block"]] += r["words_taken"]
    for (i, _), found in spans.items():
        at = min(found)[0]
        for begin, n in sorted(found):
            assert begin == at and n > 0
            at += n
        assert at <= size[i]
    lengths = defaultdict(set)
    for (source, _), n in blocks.items():
        lengths[source].add(n)
    assert all(max(n) - min(n) <= 1 for n in lengths.values())


def test_mixed_texts_are_the_words(spark):
    docs = spark.createDataFrame([(i, " ".join(f"d{i}w{j}" for j in range(30)), "ab"[i % 2]) for i in range(20)], FIELDS)
    p = mixing.Params(block_words=16)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs, p).collect()}
    found = Counter()
    for r in mixing.mixed_texts(docs, p).collect():
        w = words(r["text"])
        assert w == [f"d{r['doc_id']}w{j}" for j in range(r["from_word"], r["from_word"] + len(w))]
        found[r["doc_id"]] += len(w)
    assert {i: n for i, n in taken.items() if n} == found


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, None, None)],
        [(1, "", "a"), (2, None, "b")],
        [(None, "a b", "x"), (None, "a b", "x"), (None, "c", None), (5, "d e f", None), (5, "d e f", None), (5, "x", "x")],
        [(1, "w" * 100_000, "a"), (2, "w " * 200_000, "a"), (3, "w", "b")],
    ],
)
def test_odd_rows(spark, rows):
    check(got(mixing.mix(spark.createDataFrame(rows, FIELDS))), plain(rows))


def test_columns_that_clash(spark):
    rows = [(1, "a b c", "x", 1, "k"), (2, "a", "y", 2, "l")]
    docs = spark.createDataFrame(rows, FIELDS + ", size long, skey string").withColumnRenamed("text", "bucket").withColumnRenamed("source", "pass")
    check(got(mixing.mix(docs, text_col="bucket", source_col="pass")), plain([r[:3] for r in rows]))


def test_other_weights_and_passes(spark):
    rows = [(i, "w " * (10 + i), "abcd"[i % 4]) for i in range(40)]
    found = got(mixing.mix(spark.createDataFrame(rows, FIELDS), mixing.Params(weights=(5, 1), epochs=2)))
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(words(text))
    wanted = plain_targets(sizes, (5, 1), 2)
    taken = Counter()
    for i, *_, n in found:
        taken["abcd"[i % 4]] += n
    assert {s: round(x) for s, x in wanted.items()} == taken and all(r[4] <= 2 * r[1] for r in found)
