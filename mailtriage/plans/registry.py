"""Registry of queries; each may carry the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mailtriage.sources import tables as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def _view(name, exprs, table):
    return f"{name} AS (SELECT {', '.join(exprs)} FROM {table})"


# Common table expressions for the checking SQL.
MAIL = _view("mail", V.MAIL, "documents")
SCORED = _view("scored", V.SCORED, "documents")
GOLD = SCORED + f""", gold AS (SELECT s.*, l.quality, l.toxic, {V.GOLD_TRUE} AS true_label
  FROM labels l JOIN scored s ON s.doc_id = l.doc_id)"""
FEEDBACK = _view("feedback", V.FEEDBACK, "events")
ATTEMPTS = _view("attempts", V.ATTEMPTS, "events")
MAILBOX = _view("mailbox", V.MAILBOX, "events")
FOLDERS = f"folders AS (SELECT doc_id, text, {V.FOLDER} AS folder FROM documents)"
# Last correction per (user, message, model).
CURRENT = FEEDBACK + """, current AS (SELECT * FROM feedback
  QUALIFY row_number() OVER (PARTITION BY user_id, message_id, model ORDER BY created_at DESC, event_id DESC) = 1)"""
PARSED = MAIL + """, parsed AS (SELECT msg_id, file, message,
    split_part(message, chr(10) || chr(10), 1) AS head,
    trim(substring(message, strpos(message, chr(10) || chr(10)) + 2), ' ' || chr(9) || chr(10) || chr(13)) AS body
  FROM mail), fields AS (SELECT msg_id, file, message, head, body,
    regexp_replace(head, '\\r?\\n[ \\t]+', ' ', 'g') AS unfolded FROM parsed),
  hdr AS (SELECT msg_id, file, message, body,
    trim(regexp_extract(unfolded, '(?im)^subject:[ \\t]?(.*)$', 1)) AS subject,
    regexp_extract(unfolded, '(?im)^from:[ \\t]?(.*)$', 1) AS h_from,
    regexp_extract(unfolded, '(?im)^to:[ \\t]?(.*)$', 1) AS h_to,
    regexp_extract(unfolded, '(?im)^cc:[ \\t]?(.*)$', 1) AS h_cc,
    regexp_extract(unfolded, '(?im)^date:[ \\t]?(.*)$', 1) AS h_date,
    regexp_extract(unfolded, '(?im)^precedence:[ \\t]?(.*)$', 1) AS h_precedence,
    CASE WHEN regexp_matches(unfolded, '(?im)^list-unsubscribe:') THEN 1 ELSE 0 END AS h_unsub,
    len(string_split(unfolded, chr(10))) AS n_fields
  FROM fields)"""


def clean_sql(expr: str, routing: tuple[str, ...] = ()) -> str:
    """The cleaning rule as SQL."""
    out = f"lower({expr})"
    out = f"regexp_replace({out}, 'http\\S+|www\\.\\S+', ' url ', 'g')"
    out = f"regexp_replace({out}, '\\S+@\\S+', ' email ', 'g')"
    out = f"regexp_replace({out}, '\\b\\d[\\d\\s\\-().]{{6,}}\\d\\b', ' phone ', 'g')"
    out = f"regexp_replace({out}, '[^a-z\\s]', ' ', 'g')"
    if routing:
        out = f"regexp_replace({out}, '\\b({'|'.join(routing)})\\b', ' ', 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


def count_sql(expr: str, words) -> str:
    """Number of whole-word hits; accented letters are made plain so that word edges agree."""
    plain = f"regexp_replace({expr}, '[À-ɏ]', 'x', 'g')"
    return f"cast(len(regexp_extract_all({plain}, '(?i)\\b({'|'.join(words)})\\b')) AS INTEGER)"


def flag_sql(expr: str, words) -> str:
    plain = f"regexp_replace({expr}, '[À-ɏ]', 'x', 'g')"
    return f"CASE WHEN regexp_matches({plain}, '(?i)\\b({'|'.join(words)})\\b') THEN 1 ELSE 0 END"
