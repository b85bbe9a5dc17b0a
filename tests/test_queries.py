import duckdb
import pytest

import __spark_entry__ as entry
from lodestrata.plans import corpus, corpus_deltas, corpus_scans

QUERIES, ORACLES = corpus.QUERIES | corpus_scans.QUERIES | corpus_deltas.QUERIES, corpus.ORACLES | corpus_scans.ORACLES | corpus_deltas.ORACLES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(values, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr(tuple(v[i] for i in order)) for v in values)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    if name not in ORACLES:
        assert got
        return
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns) and got == rows_of(found.fetchall(), names)


def test_entry(spark):
    assert tuple(entry.entry(spark).first()) == (183, 10, 29432)
    assert QUERIES.keys() <= entry.queries().keys() and entry.oracle_sql().keys() <= entry.queries().keys()


def test_sha512_agrees_with_hashlib(spark, sf_dir):
    import hashlib

    got = {r["object_key"]: r["hash"] for r in corpus.content_hash_sha512(spark, sf_dir).collect()}
    for r in corpus.listing(spark, sf_dir).collect():
        assert got[r["object_key"]] == hashlib.sha512(r["content"].encode()).hexdigest()


def test_bodies_are_read_only_where_needed(spark, sf_dir):
    plan = corpus.listing(spark, sf_dir).select("bucket", "object_key")._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema") :]
    assert "text" not in schema
    plan = corpus.listing(spark, sf_dir).where("object_key like 'src1%' and bucket = 'en'")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan
