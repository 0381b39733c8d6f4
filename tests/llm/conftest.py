import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977} and more\tof it" for i in range(40_000))
# Nulls, empty and blank texts, repeated rows and ids, ties, one very long text.
ODD = [
    (None, None, None, None), (1, "", "en", "src0"), (2, " \t\n", "en", "src0"), (3, "alpha beta gamma delta", "en", "src1"), (3, "alpha beta gamma delta", "en", "src1"),
    (4, "alpha  beta\tgamma\ndelta", "fr", None), (5, "alpha beta gamma delta ", None, "src7"), (6, LONG, "en", "src0"), (7, LONG, "de", "src12"), (8, "ALPHA beta gamma delta", "es", "other"),
    (None, "alpha beta gamma delta", "en", "src1"), (9, "été à la plage, ça va? 😀", "fr", "src3"), (10, "one", "en", "src0"), (11, "one", "en", "src0"), (11, "two words", "en", "src0"),
]
CLASHING = ["score", "size", "shard", "slot", "fp", "sha", "kept", "tokens", "budget", "data", "lang_pred", "spans", "rules", "length", "weight", "node"]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows, with further columns named like those that operators make."""
    df = spark.createDataFrame(ODD, "doc_id bigint, text string, lang string, source string").repartition(3)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING}).withColumn("n_chars", F.length("text"))


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


def texts(rows=ODD):
    return [(i, t or "") for i, t, *_ in rows]
