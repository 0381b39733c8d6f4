"""The given tables, and the mail, gold, correction and version views derived from them.

Each view is a list of SQL expressions that mean the same in Spark and in ANSI SQL, so the checks
can build the same view from the same table without this package.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# `mail`: one raw message per document, with folded recipients, Cc, bulk markers, automated
# senders, replies and sender-local dates. The weekday is always "Mon" and must not be trusted.
MAIL = [
    "doc_id AS msg_id",
    "concat('user', cast(doc_id % 50 AS string), '/', source, '/', cast(doc_id AS string), '.') AS file",
    """concat(
      'From: ', CASE WHEN doc_id % 7 = 0 THEN 'no-reply' ELSE concat('user', cast(doc_id % 50 AS string)) END,
      '@', source, '.example.com', chr(10),
      'To: a', cast(doc_id % 11 AS string), '@example.com',
      CASE WHEN doc_id % 3 = 0 THEN concat(',', chr(10), ' b@example.com') ELSE '' END, chr(10),
      CASE WHEN doc_id % 5 = 0 THEN concat('Cc: c@example.com', chr(10)) ELSE '' END,
      CASE WHEN doc_id % 13 = 0 THEN concat('List-Unsubscribe: <mailto:u@example.com>', chr(10),
                                            'Precedence: bulk', chr(10)) ELSE '' END,
      'Date: Mon, ', cast(1 + doc_id % 28 AS string), ' May 2001 ',
      lpad(cast(doc_id % 24 AS string), 2, '0'), ':', lpad(cast(doc_id % 60 AS string), 2, '0'),
      ':00 -0700 (PDT)', chr(10),
      'Subject: ', CASE WHEN doc_id % 4 = 0 THEN 'Re: ' ELSE '' END,
      substring(replace(text, chr(10), ' '), 1, 60), chr(10), chr(10), text) AS message""",
]

# Folder of a document: the twenty sources stand for real folder names, some mapped to a weak
# label, some skipped, some unknown.
FOLDER = """CASE source
  WHEN 'src0' THEN 'inbox' WHEN 'src1' THEN 'sent_items' WHEN 'src2' THEN 'personal'
  WHEN 'src3' THEN 'family' WHEN 'src4' THEN 'newsletters' WHEN 'src5' THEN 'lists'
  WHEN 'src6' THEN 'all_documents' WHEN 'src7' THEN 'deleted_items' WHEN 'src8' THEN 'trash'
  WHEN 'src9' THEN 'calendar' WHEN 'src10' THEN 'legal' WHEN 'src11' THEN 'friends'
  WHEN 'src12' THEN 'forums' WHEN 'src13' THEN 'ski trips' WHEN 'src14' THEN 'recipes'
  ELSE source END"""

# `scored`: a confidence, predicted label and spam probability for every document. They stand for
# stored model output; the model queries compute real ones.
SCORED = [
    "doc_id", "text", "source", "n_chars",
    "CASE WHEN n_chars % 10 < 5 THEN 'Work' WHEN n_chars % 10 < 8 THEN 'Personal' ELSE 'Other' END AS predicted",
    "round(cast(0.34 AS double) + (n_chars * 7 % 661) / cast(1000 AS double), 4) AS confidence",
    "round((n_chars * 13 % 1000) / cast(1000 AS double), 4) AS spam_conf",
    "round((n_chars * 3 % 2001 - 1000) / cast(1000 AS double), 4) AS compound",
]

# `gold`: labelled documents with a true and a predicted label, on top of `scored`.
GOLD_TRUE = "CASE WHEN toxic = 1 THEN 'Other' WHEN quality = 1 THEN 'Work' ELSE 'Personal' END"

# `feedback`: every event as one delivered correction.
FEEDBACK = [
    "event_id", "user_id", "ts AS created_at", "value", "event_type",
    "concat('m', regexp_extract(props, '[0-9]+', 0)) AS message_id",
    "CASE event_type WHEN 'purchase' THEN 'spam' WHEN 'signup' THEN 'priority' ELSE 'category' END AS model",
    """CASE event_type
        WHEN 'purchase' THEN CASE WHEN value < 10 THEN 'spam' ELSE 'ham' END
        WHEN 'signup' THEN CASE WHEN value < 5 THEN 'low' WHEN value < 20 THEN 'medium' ELSE 'high' END
        WHEN 'error' THEN CASE WHEN value < 20 THEN 'Other' ELSE 'Receipts' END
        WHEN 'click' THEN 'Personal' ELSE 'Work' END AS corrected_label""",
    """CASE event_type
        WHEN 'purchase' THEN CASE WHEN value < 15 THEN 'spam' ELSE 'ham' END
        WHEN 'signup' THEN CASE WHEN value < 8 THEN 'low' WHEN value < 18 THEN 'medium' ELSE 'high' END
        WHEN 'error' THEN 'Other' WHEN 'click' THEN CASE WHEN value < 12 THEN 'Personal' ELSE 'Work' END
        ELSE 'Work' END AS predicted_label""",
]

# `attempts`: every event as one retrain attempt of a (user, model). The event id is the version:
# it is unique and grows with time.
ATTEMPTS = [
    "user_id", "event_id AS version",
    # Some attempts are older than the corrections of their key, some newer.
    "CASE WHEN event_id % 3 = 0 THEN ts - INTERVAL '1' DAY ELSE ts + INTERVAL '1' DAY END AS created_at",
    "CASE event_type WHEN 'purchase' THEN 'spam' WHEN 'signup' THEN 'priority' ELSE 'category' END AS model",
    "CASE WHEN cast(regexp_extract(props, '[0-9]+', 0) AS int) % 4 = 0 THEN 0 ELSE 1 END AS passed",
    "cast(cast(regexp_extract(props, '[0-9]+', 0) AS int) % 7 AS bigint) AS correction_count",
]

# `mailbox`: every event as one classified message in a user's mailbox.
MAILBOX = [
    "event_id AS msg_id", "user_id", "ts AS received_at", "value",
    "CASE event_type WHEN 'click' THEN 'Personal' WHEN 'error' THEN 'Other' ELSE 'Work' END AS category",
    "CASE WHEN value < 10 THEN 'low' WHEN value < 30 THEN 'medium' ELSE 'high' END AS bucket",
    "CASE WHEN cast(regexp_extract(props, '[0-9]+', 0) AS int) % 3 = 0 THEN 1 ELSE 0 END AS unread",
    "CASE WHEN cast(regexp_extract(props, '[0-9]+', 0) AS int) % 5 = 0 THEN 1 ELSE 0 END AS archived",
]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_text(spark: SparkSession, sf_dir: str, name: str, key: str, spread: bool = False) -> DataFrame:
    """A text table for work that is heavy per row.

    With ``spread`` a scan of fewer splits than cores is dealt over the cores first, which the given
    files of one row group need; it costs a shuffle of the text and is off unless a caller asks.
    """
    df = load(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, key) if spread and df.rdd.getNumPartitions() < cores else df


def mail(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """One message per document; with ``only`` those whose id is in its column ``msg_id``."""
    docs = load_text(spark, sf_dir, "documents", "doc_id", spread=True)
    return (docs if only is None else docs.join(only, F.col("doc_id") == F.col("msg_id"), "left_semi")).selectExpr(*MAIL)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").selectExpr(*SCORED)


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = load(spark, sf_dir, "labels").selectExpr("doc_id", f"{GOLD_TRUE} AS true_label", "quality", "toxic")
    return labels.join(scored(spark, sf_dir), "doc_id")


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").selectExpr(*FEEDBACK)


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").selectExpr(*ATTEMPTS)


def mailbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").selectExpr(*MAILBOX)


def parsed_mail(spark: SparkSession, sf_dir: str, max_chars: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """Messages with header map, subject and body; the body is whole unless a limit is given. ``only`` as for ``mail``."""
    from mailtriage.functions.headers import header_map
    from mailtriage.functions.text import body_of, subject_of

    return mail(spark, sf_dir, only).select(
        "msg_id", "file", header_map("message").alias("headers"),
        subject_of("message").alias("subject"), body_of("message", max_chars).alias("body"),
    )


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", "text", F.expr(FOLDER).alias("folder"))
