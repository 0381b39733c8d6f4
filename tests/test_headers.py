import datetime as dt

from pyspark.sql import functions as F

from mailtriage.constants import HEADER_COLS
from mailtriage.functions import headers as H


def test_map_folding_repeats_and_noise(spark):
    raw = "\tlost\nTo: a@x,\n  b@x \n\tc@x\nReceived: one\nnoise line\nX-A:v\nreceived: two\n\nTo: body@x"
    m = spark.createDataFrame([(raw,), ("",), (None,)], "t string").select(H.header_map("t").alias("m")).collect()
    assert m[0].m == {"to": "a@x, b@x c@x", "received": "onetwo", "x-a": "v"}
    assert m[1].m == {} and m[2].m == {}


def test_dates(spark):
    cases = {
        "Mon, 14 May 2001 16:39:00 -0700 (PDT)": dt.datetime(2001, 5, 14, 16, 39),
        "3 Jan 99 7:05 +0000": dt.datetime(1999, 1, 3, 7, 5),
        "2024-03-01T08:30:15+02:00": dt.datetime(2024, 3, 1, 8, 30, 15),
        "2024-03-01": dt.datetime(2024, 3, 1), "31 Feb 2001 10:00:00": None, "12 Foo 2001 10:00:00": None, "soon": None, "": None, None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select(H.local_datetime("t").alias("d"))
    assert [r.d for r in df.collect()] == list(cases.values())


def test_time_features_and_defaults(spark):
    df = spark.createDataFrame([("2024-03-02T18:00:00",), ("2024-03-01T17:59:00",), (None,)], "t string")
    rows = df.select(*[c.alias(n) for n, c in H.time_features(H.local_datetime("t")).items()]).collect()
    assert (round(rows[0].hour_sin, 6), rows[0].is_weekend, rows[0].is_business_hours) == (-1.0, 1, 0)
    assert (rows[1].is_weekend, rows[1].is_business_hours) == (0, 1)
    assert tuple(rows[2]) == (0.0, 0.0, 0, 1)


def test_senders(spark):
    df = spark.createDataFrame([('"Ann B" <ann@x.com>',), ("<no-reply@x.com>",), ("mailer_daemon@x",), ("billing@x",)], "t string")
    n, a = H.sender_name_and_address("t")
    got = [tuple(r) for r in df.select(n.alias("n"), a.alias("a"), H.sender_automated("t").alias("f")).collect()]
    assert got == [("Ann B", "ann@x.com", 0), ("no-reply@x.com", "no-reply@x.com", 1), ("mailer_daemon@x", "mailer_daemon@x", 1), ("billing@x", "billing@x", 0)]


def test_both_entry_points_agree(spark, sf):
    from mailtriage.plans.parsing import p17, p27

    assert sorted(map(tuple, p17(spark, sf).collect())) == sorted(map(tuple, p27(spark, sf).select("msg_id", *HEADER_COLS).collect()))


def test_null_fields(spark):
    df = spark.createDataFrame([(None,)], "t string")
    r = df.select(*H.header_features("t", "t", "t", "t", F.lit(None).cast("boolean"), "t", H.local_datetime("t"))).first()
    assert tuple(r) == (0, 0, 0, 0, 0, 0.0, 0.0, 0, 1)
