"""Pipelines that are saved in one process and applied in another."""

import os
import subprocess
import sys

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from mailtriage.models import features as FT, linear as LM
from mailtriage.models.pipeline import FeatureRow, LinearScores, triage_pipeline
from mailtriage.operators.vocab import char_spec, word_spec
from mailtriage.plans.saved import given_model
from mailtriage.session import work_path
from mailtriage.sources import tables as V

ELSEWHERE = """
import sys
from pyspark.ml import PipelineModel
from mailtriage.session import build_session
spark = build_session(2, "elsewhere")
rows = PipelineModel.load(sys.argv[1]).transform(spark.read.parquet(sys.argv[2])).select("msg_id", "kind_probability", "kind_label", "given_score").collect()
for r in rows:
    print("ROW", r.msg_id, *[repr(x) for x in r.kind_probability], r.kind_label, r.given_score)
"""


def models(spark, sf):
    mail = V.mail(spark, sf).limit(60)
    texts = FT.message_features(V.parsed_mail(spark, sf), ["msg_id"]).limit(60)
    fm = FT.fit_features(texts, FT.FeatureSpec([word_spec(40, 2, ("the",)), char_spec(30, 2)], None, ("text_len_log", "n_recipients")))
    rng = np.random.default_rng(2)
    return mail, fm, LM.LinearModel(["a", "b", "c"], rng.normal(size=(3, fm.dim)), rng.normal(size=3))


def test_another_process_gives_the_same_scores(spark, sf):
    mail, fm, lm = models(spark, sf)
    path, data = work_path(spark, "pipeline"), work_path(spark, "mail")
    mail.write.parquet(data)
    saved = triage_pipeline("message", ["msg_id"], {"kind": (fm, lm), "given": given_model()}, ["given"])
    saved.write().save(path)
    want = {r.msg_id: r for r in saved.transform(spark.read.parquet(data)).collect()}
    out = subprocess.run([sys.executable, "-c", ELSEWHERE, path, data], capture_output=True, text=True, timeout=200, env={**os.environ, "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))})
    got = [line.split()[1:] for line in out.stdout.splitlines() if line.startswith("ROW")]
    assert len(got) == len(want) == 60, out.stderr[-2000:]
    for msg_id, *p, label, score in got:
        r = want[int(msg_id)]
        assert [float(x) for x in p] == r.kind_probability and label == r.kind_label and float(score) == r.given_score
        assert r.given_score == 0.25 + 0.5 * (r.msg_id % 4 == 0) + 0.125 * (r.msg_id % 7 == 0)


def test_stages_hold_what_was_fitted(spark, sf):
    _, fm, lm = models(spark, sf)
    back = FeatureRow.of(fm).fitted()
    assert back.names() == fm.names() and back.blocks == fm.blocks and back.means == fm.means and [t.idf for t in back.texts] == [t.idf for t in fm.texts]
    linear = LinearScores.of(lm, "x").fitted()
    assert linear.classes == lm.classes and np.array_equal(linear.coefficients, lm.coefficients)
    path = work_path(spark, "empty-pipeline")
    PipelineModel([FeatureRow.of(fm)]).write().save(path)
    none = spark.createDataFrame([], "clean string, text_len_log double, n_recipients int")
    assert PipelineModel.load(path).transform(none).count() == 0
    odd = spark.createDataFrame([(None, 1.0, 2), ("", 0.0, 0)], none.schema)
    assert all(len(r["indices"]) == len(r["values"]) for r in PipelineModel.load(path).transform(odd).select("indices", F.col("values")).collect())
