"""Queries over saved and reloaded pipelines."""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from mailtriage import constants as K
from mailtriage.models import features as FT, linear as LM
from mailtriage.models.pipeline import triage_pipeline
from mailtriage.operators.vocab import word_spec
from mailtriage.plans.modelling import gold, holds, messages
from mailtriage.plans.registry import query
from mailtriage.plans.textfeatures import STOP_WORDS
from mailtriage.session import work_path
from mailtriage.sources import tables as V
from mailtriage.streaming import streams as R

# A model whose scores SQL gives exactly.
GIVEN_COLUMNS, GIVEN_WEIGHTS, GIVEN_INTERCEPT = ("is_reply_or_forward", "sender_automated"), (0.5, 0.125), 0.25


def given_model():
    spec = FT.FeatureSpec([], None, GIVEN_COLUMNS)
    return FT.FeatureModel(spec, [], {c: 0.0 for c in GIVEN_COLUMNS}, {c: 1.0 for c in GIVEN_COLUMNS}), LM.LinearModel(["given"], np.array([GIVEN_WEIGHTS]), np.array([GIVEN_INTERCEPT]))


@query("x2_saved_pipeline", """SELECT doc_id AS msg_id, 0.25::DOUBLE + CASE WHEN doc_id % 4 = 0 THEN 0.5::DOUBLE ELSE 0::DOUBLE END + CASE WHEN doc_id % 7 = 0 THEN 0.125::DOUBLE ELSE 0::DOUBLE END AS given_score,
  1 AS same_score, 1 AS same_label FROM documents""")
def x2(spark, sf):
    """A fitted spam model and a given one, saved, loaded and applied to a stream; scores as before they were saved."""
    g = gold(spark, sf)
    fm = FT.fit_features(g, FT.FeatureSpec([word_spec(500, 2, STOP_WORDS)], None, K.CATEGORY_NUMERIC))
    lm = LM.fit_model(g, fm, "is_spam", 1.0, [0, 1])
    path = work_path(spark, "saved-pipeline")
    triage_pipeline("message", ["msg_id"], {"spam": (fm, lm), "given": given_model()}, ["given"]).write().save(path)
    mail = R.read_table_stream(spark, sf, "documents").selectExpr(*V.MAIL)
    scored = PipelineModel.load(path).transform(mail).select("msg_id", "spam_probability", "spam_label", "given_score")
    out = R.run_to_table(scored, "saved-scores")
    before = fm.transform(messages(spark, sf)).select("msg_id", F.get(lm.probabilities(), F.lit(1)).alias("p"))
    both = out.join(before, "msg_id", "left")
    return both.select(
        "msg_id", "given_score", holds(F.abs(F.get("spam_probability", F.lit(1)) - F.col("p")) < 1e-12).alias("same_score"), holds((F.col("spam_label") == "1") == (F.col("p") > 0.5)).alias("same_label"))
