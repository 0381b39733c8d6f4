"""Every registered query with SQL must give the rows of that SQL on the small tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import norm


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


# Queries that run several fits over text take minutes each; tools/check.py and MAILTRIAGE_ALL=1 run them too.
COSTLY = {
    "m8b_category_fit", "m9_ridge_score", "m11_out_of_fold", "m12_nested_search", "m13_embedding_classifier", "m15_corpus_scoring", "l5_threshold_and_argmax",
    "m18b_top_coefficients", "m19_ablation", "m20_refit_reproduces", "m21_self_training", "s12_training_matrix", "r1_stream_scoring", "m17_weight_sweep", "m16c_version_rows",
}
NAMES = [n for n in sorted(entry.oracle_sql()) if os.environ.get("MAILTRIAGE_ALL") or n not in COSTLY]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = [tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()]
    key = lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "quality" in df.columns
