"""Queries for parsing, cleaning and feature columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailtriage import constants as K
from mailtriage.functions import headers as H, links as L, mime as M, text as T
from mailtriage.functions.style import keyword_features, style_features
from mailtriage.plans.registry import MAIL, PARSED, clean_sql, count_sql, flag_sql, query
from mailtriage.sources import tables as V


@query("p1_clean_text", f"SELECT doc_id, {clean_sql('text')} AS clean FROM documents")
def p1(spark, sf):
    return V.load_text(spark, sf, "documents", "doc_id", spread=True).select("doc_id", T.clean_text("text").alias("clean"))


@query("p2_clean_text_strip_routing",
       f"SELECT doc_id, {clean_sql('text', K.ROUTING_WORDS)} AS clean FROM documents")
def p2(spark, sf):
    return V.load_text(spark, sf, "documents", "doc_id", spread=True).select("doc_id", T.clean_text("text", strip_routing=True).alias("clean"))


@query("p3_split_message", f"WITH {PARSED} SELECT msg_id, head, body FROM parsed")
def p3(spark, sf):
    return V.mail(spark, sf).select("msg_id", T.header_block("message").alias("head"), T.body_of("message").alias("body"))


@query("p4_subject", f"WITH {PARSED} SELECT msg_id, subject FROM hdr")
def p4(spark, sf):
    return V.mail(spark, sf).select("msg_id", T.subject_of("message").alias("subject"))


@query("p5_body_truncation", f"""WITH {PARSED} SELECT msg_id, substring(body, 1, 3000) AS body_parse,
  substring(body, 1, 800) AS body_sample, substring(body, 1, 700) AS body_priority,
  substring(replace(body, chr(10), ' '), 1, 500) AS body_sheet FROM hdr""")
def p5(spark, sf):
    m = V.mail(spark, sf).select("msg_id", T.body_of("message").alias("body"))
    return m.select(
        "msg_id", T.truncate(F.col("body"), 3000).alias("body_parse"), T.truncate(F.col("body"), 800).alias("body_sample"),
        T.truncate(F.col("body"), 700).alias("body_priority"), T.snippet("body", 500).alias("body_sheet"),
    )


@query("p6_header_map", f"""WITH {PARSED} SELECT msg_id, n_fields::INTEGER AS n_fields, h_from, h_to, h_cc, h_date,
  subject, h_precedence, h_unsub FROM hdr""")
def p6(spark, sf):
    m = V.mail(spark, sf).select("msg_id", H.header_map("message").alias("h"))
    return m.select(
        "msg_id", F.size("h").alias("n_fields"), *[H.field("h", n).alias(f"h_{n}") for n in ("from", "to", "cc", "date")],
        T.strip(H.field("h", "subject")).alias("subject"), H.field("h", "precedence").alias("h_precedence"),
        F.map_contains_key("h", "list-unsubscribe").cast("int").alias("h_unsub"),
    )


@query("p7_address_count", f"""WITH {PARSED} SELECT msg_id,
  len(regexp_extract_all(h_to || ' ; ' || h_cc, '[\\w.\\-+]+@[\\w.\\-]+'))::INTEGER AS n_recipients FROM hdr""")
def p7(spark, sf):
    m = V.mail(spark, sf).select("msg_id", H.header_map("message").alias("h"))
    return m.select("msg_id", (H.address_count(H.field("h", "to")) + H.address_count(H.field("h", "cc"))).alias("n_recipients"))


AUTO = "(?i)^(" + "|".join(K.AUTOMATED_SENDER) + ")"


@query("p8_p9_sender", f"""WITH {PARSED}, s AS (SELECT msg_id, regexp_extract(h_from, '([\\w.\\-+]+)@[\\w.\\-]+', 1) AS local_part
  FROM hdr) SELECT msg_id, local_part, CASE WHEN regexp_matches(local_part, '{AUTO}') THEN 1 ELSE 0 END AS automated FROM s""")
def p8(spark, sf):
    m = V.mail(spark, sf).select("msg_id", H.header_map("message").alias("h"))
    sender = H.field("h", "from")
    return m.select("msg_id", H.sender_local_part(sender).alias("local_part"), H.sender_automated(sender).alias("automated"))


@query("p10_p11_reply_and_bulk", f"""WITH {PARSED} SELECT msg_id,
  CASE WHEN regexp_matches(subject, '(?i)^\\s*(re|fw|fwd)\\s*:') THEN 1 ELSE 0 END AS is_reply_or_forward,
  h_unsub AS has_list_unsubscribe, CASE WHEN lower(h_precedence) IN ('bulk', 'list') THEN 1 ELSE 0 END AS has_precedence_bulk
  FROM hdr""")
def p10(spark, sf):
    m = V.mail(spark, sf).select("msg_id", H.header_map("message").alias("h"))
    return m.select(
        "msg_id", H.is_reply_or_forward(H.field("h", "subject")).alias("is_reply_or_forward"),
        F.map_contains_key("h", "list-unsubscribe").cast("int").alias("has_list_unsubscribe"),
        H.precedence_bulk(H.field("h", "precedence")).alias("has_precedence_bulk"),
    )


@query("p12_local_datetime", """SELECT doc_id AS msg_id, make_timestamp(2001, 5, 1 + doc_id % 28, doc_id % 24, doc_id % 60, 0)
  AS sent_at FROM documents""")
def p12(spark, sf):
    m = V.mail(spark, sf).select("msg_id", H.header_map("message").alias("h"))
    return m.select("msg_id", H.local_datetime(H.field("h", "date")).alias("sent_at"))


@query("p13_time_features", """SELECT event_id,
  round(sin(2 * pi() * (hour(ts) + minute(ts) / 60.0) / 24), 6) AS hour_sin,
  round(cos(2 * pi() * (hour(ts) + minute(ts) / 60.0) / 24), 6) AS hour_cos,
  CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend,
  CASE WHEN isodow(ts) < 6 AND hour(ts) BETWEEN 8 AND 17 THEN 1 ELSE 0 END AS is_business_hours FROM events""")
def p13(spark, sf):
    cols = H.time_features(F.col("ts"))
    return V.load(spark, sf, "events").select(
        "event_id", *[F.round(c, 6).alias(n) if n.startswith("hour") else c.alias(n) for n, c in cols.items()]
    )


@query("p14_folder", f"WITH {MAIL} SELECT msg_id, lower(trim(split_part(file, '/', 2))) AS folder FROM mail")
def p14(spark, sf):
    return V.mail(spark, sf).select("msg_id", T.folder_of("file").alias("folder"))


STYLE_SQL = f"""SELECT doc_id, round(ln(1 + length(full_text)), 6) AS text_len_log,
  round(cast(length(full_text) - length(replace(full_text, '!', '')) AS DOUBLE) / greatest(length(full_text), 1) * 1000, 6)
    AS excl_density,
  least(len(regexp_extract_all(regexp_replace(full_text, '[À-ɏ]', 'x', 'g'), '\\b[A-Z]{{3,}}\\b')), 10)::INTEGER AS caps_word_count,
  {flag_sql('substring(text, 1, 100)', K.INFORMAL_GREETING)} AS informal_greeting,
  {flag_sql('substring(text, 1, 100)', K.FORMAL_GREETING)} AS formal_greeting,
  {flag_sql('full_text', K.FAMILY_WORDS)} AS family_words,
  {flag_sql('right(text, 200)', K.FORMAL_CLOSING)} AS formal_closing,
  {flag_sql('right(text, 200)', K.INFORMAL_CLOSING)} AS informal_closing,
  least(length(full_text) - length(replace(full_text, '?', '')), 5)::INTEGER AS question_count
  FROM (SELECT doc_id, text, source || ' ' || text AS full_text FROM documents)"""


@query("p15_style_features", STYLE_SQL)
def p15(spark, sf):
    d = V.load_text(spark, sf, "documents", "doc_id", spread=True).select("doc_id", *style_features("source", "text"))
    return d.withColumns({c: F.round(c, 6) for c in ("text_len_log", "excl_density")})


KEYWORD_SQL = f"""SELECT doc_id, {count_sql('full_text', K.HIGH_WORDS)} AS kw_high,
  {count_sql('full_text', K.MEDIUM_WORDS)} AS kw_med, {count_sql('full_text', K.LOW_WORDS)} AS kw_low,
  (length(source) - length(replace(source, '!', '')))::INTEGER AS excl_subj
  FROM (SELECT doc_id, source, source || ' ' || text AS full_text FROM documents)"""


@query("p16_keyword_features", KEYWORD_SQL)
def p16(spark, sf):
    return V.load_text(spark, sf, "documents", "doc_id", spread=True).select("doc_id", *keyword_features("source", "text"))


HEADER_SQL = f"""SELECT msg_id,
  len(regexp_extract_all(h_to || ' ; ' || h_cc, '[\\w.\\-+]+@[\\w.\\-]+'))::INTEGER AS n_recipients,
  CASE WHEN regexp_matches(subject, '(?i)^\\s*(re|fw|fwd)\\s*:') THEN 1 ELSE 0 END AS is_reply_or_forward,
  CASE WHEN regexp_matches(regexp_extract(h_from, '([\\w.\\-+]+)@[\\w.\\-]+', 1), '{AUTO}') THEN 1 ELSE 0 END AS sender_automated,
  h_unsub AS has_list_unsubscribe, CASE WHEN lower(h_precedence) IN ('bulk', 'list') THEN 1 ELSE 0 END AS has_precedence_bulk,
  round(sin(2 * pi() * (hour(sent) + minute(sent) / 60.0) / 24), 6) AS hour_sin,
  round(cos(2 * pi() * (hour(sent) + minute(sent) / 60.0) / 24), 6) AS hour_cos,
  CASE WHEN isodow(sent) >= 6 THEN 1 ELSE 0 END AS is_weekend,
  CASE WHEN isodow(sent) < 6 AND hour(sent) BETWEEN 8 AND 17 THEN 1 ELSE 0 END AS is_business_hours
  FROM (SELECT *, make_timestamp(2001, 5, regexp_extract(h_date, ', (\\d+) May', 1)::BIGINT,
    regexp_extract(h_date, '(\\d+):(\\d+):', 1)::BIGINT, regexp_extract(h_date, '(\\d+):(\\d+):', 2)::BIGINT, 0) AS sent FROM hdr)"""


def rounded(df, names=("hour_sin", "hour_cos")):
    return df.withColumns({c: F.round(c, 6) for c in names})


@query("p17_header_feature_row", f"WITH {PARSED} {HEADER_SQL}")
def p17(spark, sf):
    return rounded(V.parsed_mail(spark, sf).select("msg_id", *H.header_features_from_map("headers")))


@query("p18_join_text", f"WITH {PARSED} SELECT msg_id, {clean_sql('subject || chr(32) || body')} AS clean FROM hdr")
def p18(spark, sf):
    return V.parsed_mail(spark, sf).select("msg_id", T.clean_text(T.join_text("subject", "body")).alias("clean"))


HTML_SQL = """trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace({0},
  '(?is)<style.*?</style>', ' ', 'g'), '(?is)<script.*?</script>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '),
  '[\\s\\x{{a0}}]+', ' ', 'g'))"""


@query("p19_html_to_text", f"SELECT page_id, {HTML_SQL.format('html')} AS body FROM pages")
def p19(spark, sf):
    return V.load_text(spark, sf, "pages", "page_id", spread=True).select("page_id", M.html_to_text("html").alias("body"))


def base64url(c):
    return F.rtrim(F.translate(F.base64(F.encode(c, "UTF-8")), "+/=\r\n", "-_"))


@query("p20_base64url_decode", "SELECT doc_id, text AS decoded FROM documents")
def p20(spark, sf):
    d = V.load_text(spark, sf, "documents", "doc_id", spread=True).select("doc_id", base64url(F.col("text")).alias("data"))
    return d.select("doc_id", M.decode_base64url(F.col("data")).alias("decoded"))


def provider_messages(spark, sf):
    """Documents as exported provider messages: one JSON string each, with a nested MIME tree.

    Every third has only HTML, deep inside the tree; the others have a plain part beside it. In every seventh
    all of that lies seven levels further down, as in a message forwarded again and again.
    """
    d = V.load_text(spark, sf, "documents", "doc_id", spread=True)
    html = F.concat(F.lit("<p>"), F.replace(F.col("text"), F.lit("<"), F.lit("")), F.lit("&nbsp;<b>end</b></p>"))

    def part(kind, data):
        return F.struct(F.lit(kind).alias("mimeType"), F.struct(base64url(data).alias("data")).alias("body"))

    html_only = F.to_json(F.array(F.struct(
        F.lit("multipart/related").alias("mimeType"), F.array(part("text/html", html)).alias("parts"))))
    both = F.to_json(F.array(part("text/plain", F.col("text")), part("text/html", html)))
    parts = F.when(F.col("doc_id") % 3 == 0, html_only).otherwise(both)
    forwarded = parts
    for _ in range(7):
        forwarded = F.concat(F.lit('[{"mimeType":"message/rfc822","parts":'), forwarded, F.lit("}]"))
    header_list = F.to_json(F.array(
        F.struct(F.lit("From").alias("name"), F.concat(F.lit('"Sender '), F.col("source"), F.lit('" <'), F.col("source"),
                                                       F.lit("@example.com>")).alias("value")),
        F.struct(F.lit("SUBJECT").alias("name"), F.concat(F.lit("Note "), F.col("doc_id").cast("string")).alias("value")),
        F.struct(F.lit("To").alias("name"), F.lit("me@example.com").alias("value")),
        F.struct(F.lit("Date").alias("name"),
                 F.concat(F.lit("Tue, "), ((F.col("doc_id") % 28) + 1).cast("string"), F.lit(" Mar 2024 07:05:00 +0000")).alias("value")),
    ))
    return d.select(F.concat(
        F.lit('{"id":"'), F.col("doc_id").cast("string"), F.lit('","labelIds":['),
        F.when(F.col("doc_id") % 2 == 0, F.lit('"INBOX","UNREAD"')).otherwise(F.lit('"INBOX"')),
        F.lit('],"payload":{"mimeType":"multipart/mixed","headers":'), header_list, F.lit(',"parts":'),
        F.when(F.col("doc_id") % 7 == 0, forwarded).otherwise(parts), F.lit("}}"),
    ).alias("raw"))


@query("s7_p21_p22_provider_ingest", f"""SELECT cast(doc_id AS VARCHAR) AS id, 'Note ' || doc_id AS subject,
  'Sender ' || source AS from_name, source || '@example.com' AS from_addr, 'me@example.com' AS to_addr,
  make_timestamp(2024, 3, 1 + doc_id % 28, 7, 5, 0) AS sent_at, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS unread,
  0 AS list_unsubscribe, CASE WHEN doc_id % 3 = 0 THEN
    {HTML_SQL.format("'<p>' || replace(text, '<', '') || '&nbsp;<b>end</b></p>'")} ELSE text END AS body,
  '<p>' || replace(text, '<', '') || '&nbsp;<b>end</b></p>' AS body_html FROM documents""")
def s7(spark, sf):
    from mailtriage.sources.readers import parse_provider_messages

    m = parse_provider_messages(provider_messages(spark, sf), "raw")
    return m.select(
        "id", "subject", "from_name", "from_addr", "to_addr", "sent_at", F.col("unread").cast("int").alias("unread"),
        F.col("list_unsubscribe").cast("int").alias("list_unsubscribe"), "body", "body_html",
    )


@query("p22_sender_name", f"""WITH {PARSED} SELECT msg_id, regexp_extract(h_from, '@(.*)$', 1) AS name,
  regexp_extract(h_from, '^[^ ]+', 0) AS address FROM hdr""")
def p22(spark, sf):
    m = V.mail(spark, sf).select("msg_id", H.header_map("message").alias("h"))
    sender = H.field("h", "from")
    shown = F.concat(F.lit('"'), F.regexp_extract(sender, "@(.*)$", 1), F.lit('" <'), sender, F.lit(">"))
    name, address = H.sender_name_and_address(shown)
    return m.select("msg_id", name.alias("name"), address.alias("address"))


LINK_RE = L.LINK.replace("'", "''")
LABEL_SQL = """CASE WHEN length(b) > 36 THEN substring(b, 1, 35) || '…' WHEN q THEN b || '…' ELSE b END"""
LINKS_CTE = f"""found AS (SELECT page_id, body, regexp_extract_all(body, '{LINK_RE}') AS hrefs FROM
    (SELECT page_id, url || ' see (' || url || '). ' || html AS body FROM pages)),
  links AS (SELECT page_id, pos, href FROM (SELECT page_id, unnest(hrefs) AS href, unnest(range(len(hrefs))) AS pos FROM found)),
  labelled AS (SELECT page_id, pos, href, {LABEL_SQL} AS label FROM (SELECT *,
    regexp_replace(lower(regexp_extract(href, '^https?://([^/?#:]+)', 1)), '^www\\.', '') ||
    regexp_replace(regexp_extract(href, '^https?://[^/?#:]+(?::\\d+)?([^?#]*)', 1), '/+$', '') AS b,
    regexp_matches(href, '\\?[^#]') OR regexp_matches(href, '#.') AS q FROM links))"""


def page_text(spark, sf):
    return V.load_text(spark, sf, "pages", "page_id", spread=True).select(
        "page_id", F.concat(F.col("url"), F.lit(" see ("), F.col("url"), F.lit("). "), F.col("html")).alias("body"))


@query("p23_link_labels", f"WITH {LINKS_CTE} SELECT page_id, pos::INTEGER AS pos, href, label FROM labelled")
def p23(spark, sf):
    found = page_text(spark, sf).select("page_id", F.posexplode(L.extract_links("body")).alias("pos", "href"))
    return found.select("page_id", "pos", "href", L.short_label(F.col("href")).alias("label"))


@query("p24_short_links", f"""WITH {LINKS_CTE}, pieces AS (SELECT page_id, unnest(p) AS piece, unnest(range(len(p))) AS pos
    FROM (SELECT page_id, string_split_regex(body, '{LINK_RE}') AS p FROM found))
  SELECT p.page_id, string_agg(piece || coalesce(label, ''), '' ORDER BY p.pos) AS body
  FROM pieces p LEFT JOIN labelled l ON l.page_id = p.page_id AND l.pos = p.pos GROUP BY p.page_id""")
def p24(spark, sf):
    return page_text(spark, sf).select("page_id", L.with_short_links("body").alias("body"))


@query("p25_tidy_text", """SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(body, '\\r\\n?', chr(10), 'g'),
  '(?m)[ \\t]+$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS tidy
  FROM (SELECT doc_id, replace(text, '. ', '.  ' || chr(13) || chr(10) || chr(10) || ' ' || chr(10) || chr(10)) AS body FROM documents)""")
def p25(spark, sf):
    d = V.load_text(spark, sf, "documents", "doc_id", spread=True).select(
        "doc_id", F.replace(F.col("text"), F.lit(". "), F.lit(".  \r\n\n \n\n")).alias("body"))
    return d.select("doc_id", T.tidy_plain_text("body").alias("tidy"))


@query("p26_snippet", "SELECT doc_id, substring(replace(text, chr(10), ' '), 1, 500) AS snippet FROM documents")
def p26(spark, sf):
    return V.load_text(spark, sf, "documents", "doc_id", spread=True).select("doc_id", T.snippet("text", 500).alias("snippet"))


@query("p27_two_entry_points", f"WITH {PARSED} {HEADER_SQL}")
def p27(spark, sf):
    """Structured fields instead of the raw block; must give the rows of p17."""
    f = V.parsed_mail(spark, sf).select(
        "msg_id", "subject", *[H.field("headers", n).alias(n) for n in ("to", "cc", "from", "precedence", "date")],
        F.map_contains_key("headers", "list-unsubscribe").alias("unsub"),
    )
    return rounded(f.select("msg_id", *H.header_features(
        "subject", "to", "cc", "from", F.col("unsub"), "precedence", H.local_datetime("date"))))


@query("x1_x2_feature_frame", f"""SELECT s.*, k.* EXCLUDE (doc_id) FROM ({STYLE_SQL}) s JOIN ({KEYWORD_SQL}) k ON s.doc_id = k.doc_id""")
def x1(spark, sf):
    """Row functions as columns of one projection; nothing leaves the JVM."""
    d = V.load_text(spark, sf, "documents", "doc_id", spread=True).select(
        "doc_id", *style_features("source", "text"), *keyword_features("source", "text"))
    return d.withColumns({c: F.round(c, 6) for c in ("text_len_log", "excl_density")})
