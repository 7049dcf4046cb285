"""Every registered query with a SQL twin against DuckDB, on the smallest tables; cheap ones of many rows on larger ones too."""
import math
import os

import pytest

from cohortvox.plans import registry

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
LARGER = ["r01_r10_facts", "r14_r17_validated_sentences", "r20_final_pass", "r26_misplaced_terms", "v04_term_top2", "v05_t02_dense_top3", "d01_region_stats"]


def plain(v):
    if isinstance(v, float) or hasattr(v, "as_tuple"):
        return "nan" if math.isnan(v) else float(v)
    return v


def ordered(rows):
    """Rows by their exact values, then by their numbers to a few digits."""
    return sorted(rows, key=lambda r: ([str(v) for v in r if not isinstance(v, float)], [round(v, 2) for v in r if isinstance(v, float)]))


def equal(a, b):
    return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6) if isinstance(a, float) and isinstance(b, float) else a == b


@pytest.fixture(scope="module")
def ducks():
    duckdb = pytest.importorskip("duckdb")
    out = {}
    for sf in ("sf0.001", "sf0.01"):
        if not os.path.isdir(f"{DATA}/{sf}"):
            pytest.skip("no test data")
        out[sf] = duckdb.connect()
        for t in TABLES:
            out[sf].execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{sf}/{t}.parquet')")
    return out


@pytest.mark.parametrize("name, sf", [(n, "sf0.001") for n in sorted(registry.oracle_sql())] + [(n, "sf0.01") for n in LARGER])
def test_query_equals_sql(spark, ducks, name, sf):
    df = registry.queries()[name](spark, f"{DATA}/{sf}")
    cols = sorted(df.columns)
    got = ordered([[plain(r[c]) for c in cols] for r in df.collect()])
    rel = ducks[sf].execute(registry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = ordered([[plain(dict(zip(names, r, strict=True))[c]) for c in cols] for r in rel.fetchall()])
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert all(map(equal, g, w)), (g, w)
