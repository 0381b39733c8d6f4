"""Provider messages: nested MIME trees, base64url bodies, HTML to text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from mailtriage.functions.text import strip, text_or_empty

HEADERS = "array<struct<name:string,value:string>>"


def decode_base64url(c: Column) -> Column:
    return F.decode(F.unbase64(F.translate(c, "-_", "+/")), "UTF-8")


def html_to_text(c) -> Column:
    out = text_or_empty(c)
    out = F.regexp_replace(out, r"(?is)<style.*?</style>", " ")
    out = F.regexp_replace(out, r"(?is)<script.*?</script>", " ")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    out = F.replace(out, F.lit("&nbsp;"), F.lit(" "))
    return strip(F.regexp_replace(out, r"(?U)\s+", " "))


def _part(path: Column, part: Column) -> Column:
    return F.struct(path.cast("array<int>").alias("path"), part.alias("part"))


def _found(p: Column) -> Column:
    return F.struct(p["path"].alias("path"), F.try_variant_get(p["part"], "$.mimeType", "string").alias("mimeType"), F.try_variant_get(p["part"], "$.body.data", "string").alias("data"))


def flatten_parts(payload: Column, raw: Column) -> Column:
    """All parts of the tree of a payload (``variant``) in document order, as ``(path, mimeType, data)``, at any depth.

    The tree is taken apart level by level: the parts of a level are listed and their children are the next. It
    ends where no part is left; no tree is deeper than its JSON text has opening brackets. In the order of their
    paths parts stand as in the document.
    """
    none = F.array().cast("array<struct<path:array<int>,mimeType:string,data:string>>")
    levels = F.sequence(F.lit(0), F.length(raw) - F.length(F.replace(raw, F.lit("["), F.lit(""))))

    def children(p):
        parts = F.coalesce(F.try_variant_get(p["part"], "$.parts", "array<variant>"), F.array().cast("array<variant>"))
        return F.transform(parts, lambda c, i: _part(F.concat(p["path"], F.array(i)), c))

    def step(s, _):
        return F.struct(F.concat(s["found"], F.transform(s["open"], _found)).alias("found"), F.flatten(F.transform(s["open"], children)).alias("open"))

    first = F.struct(none.alias("found"), F.array(_part(F.array(), payload)).alias("open"))
    return F.array_sort(F.aggregate(levels, first, step)["found"])


def select_bodies(parts: Column) -> tuple[Column, Column]:
    """Text for classification and HTML for display: first plain part with data, else stripped HTML."""
    def first(kind):
        hits = F.filter(parts, lambda p: (p["mimeType"] == kind) & (F.coalesce(p["data"], F.lit("")) != ""))
        return decode_base64url(F.get(hits, F.lit(0))["data"])

    html = first("text/html")
    return F.coalesce(first("text/plain"), html_to_text(html), F.lit("")), html


def named_header(headers: Column, name: str) -> Column:
    hits = F.filter(headers, lambda h: F.lower(h["name"]) == name.lower())
    return F.coalesce(F.get(hits, F.lit(0))["value"], F.lit(""))
