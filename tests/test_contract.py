"""Driver contract: entry, every query that SQL can express has an oracle, which agrees at sf0.001."""

import duckdb

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "pages", "benchmark", "embeddings", "labels", "conversations", "events"]


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["source_url", "pos", "word", "definition", "context_sentence"]
    assert df.count() > 0


def test_every_query_has_oracle():
    from lexmine.plans.queries import REGISTRY

    # operators of the optional subpackage that SQL cannot express have brute-force tests instead
    assert set(REGISTRY) <= set(E.oracle_sql()) <= set(E.queries())


def _canon(v):
    if hasattr(v, "isoformat"):
        return v.isoformat() if not hasattr(v, "tzinfo") or v.tzinfo is None else v.replace(tzinfo=None).isoformat()
    return repr(v)


def test_every_query_matches_oracle_small(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    bad = []
    for name in E.oracle_sql():
        s = E.queries()[name](spark, SF)
        rel = con.sql(E.oracle_sql()[name])
        cols = sorted(s.columns)
        if cols != sorted(rel.columns):
            bad.append((name, "columns"))
            continue
        si = [s.columns.index(c) for c in cols]
        di = [rel.columns.index(c) for c in cols]
        got = sorted(tuple(_canon(r[i]) for i in si) for r in s.collect())
        want = sorted(tuple(_canon(r[i]) for i in di) for r in rel.fetchall())
        if got != want:
            bad.append((name, len(got), len(want)))
    assert not bad
