"""Header fields and header features as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from mailtriage.constants import AUTOMATED_SENDER, HEADER_COLS, REPLY_PREFIXES
from mailtriage.functions.text import header_block, let, strip, text_or_empty

# Patterns below are fixed values.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
FIELD = r"^([A-Za-z][A-Za-z0-9\-]*):\s?(.*)"
ADDRESS = r"(?U)[\w.\-+]+@[\w.\-]+"
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def header_map(message) -> Column:
    """Lower-case field name to value, with folded lines joined.

    A repeated name keeps both values, joined without a separator. Lines that are neither a field
    nor a continuation are ignored.
    """
    lines = F.split(header_block(message), LINE_BREAK)
    kept = F.filter(lines, lambda x: x.rlike(FIELD) | x.rlike(r"^[ \t]"))
    # A continuation is marked, the lines are joined, and the mark together with the line end
    # before it becomes a blank; what remains between line ends is one field each.
    marked = F.transform(
        kept, lambda x: F.when(x.rlike(r"^[ \t]"), F.concat(F.lit("\x01"), strip(x))).otherwise(x)
    )
    unfolded = F.replace(F.array_join(marked, "\n"), F.lit("\n\x01"), F.lit(" "))
    fields = F.filter(F.split(unfolded, "\n"), lambda x: x.rlike(FIELD))
    pairs = F.transform(
        fields,
        lambda x: F.struct(
            F.lower(F.regexp_extract(x, FIELD, 1)).alias("name"),
            F.regexp_extract(x, FIELD, 2).alias("value"),
        ),
    )

    def fold(entries):
        names = F.array_distinct(F.transform(entries, lambda e: e["name"]))
        return F.map_from_arrays(
            names,
            F.transform(
                names,
                lambda n: F.array_join(
                    F.transform(F.filter(entries, lambda e: e["name"] == n), lambda e: e["value"]), ""
                ),
            ),
        )

    return let(pairs, fold)


def field(headers, name: str) -> Column:
    headers = F.col(headers) if isinstance(headers, str) else headers
    return F.coalesce(F.try_element_at(headers, F.lit(name)), F.lit(""))


def address_count(c) -> Column:
    return F.regexp_count(text_or_empty(c), F.lit(ADDRESS))


def sender_local_part(c) -> Column:
    return F.regexp_extract(text_or_empty(c), r"(?U)([\w.\-+]+)@[\w.\-]+", 1)


def sender_automated(c) -> Column:
    return sender_local_part(c).rlike("(?i)^(" + "|".join(AUTOMATED_SENDER) + ")").cast("int")


def is_reply_or_forward(c) -> Column:
    return text_or_empty(c).rlike(r"(?i)^\s*(" + "|".join(REPLY_PREFIXES) + r")\s*:").cast("int")


def precedence_bulk(c) -> Column:
    return F.lower(text_or_empty(c)).isin("bulk", "list").cast("int")


def local_datetime(c) -> Column:
    """Sender-local time of an RFC 2822 date, or of an ISO date; null where neither fits.

    The weekday and the offset are not used: the clock reading itself is what features need.
    """
    c = text_or_empty(c)
    rfc = r"(\d{1,2})[\s\-]+([A-Za-z]{3})[A-Za-z]*[\s\-]+(\d{2,4})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?"
    iso = r"^\s*(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2}))?)?"

    def number(pattern, group):
        return F.regexp_extract(c, pattern, group).try_cast("int")

    year = number(rfc, 3)
    year = F.when(year < 69, year + 2000).when(year < 100, year + 1900).otherwise(year)
    month_at = F.position(F.lower(F.regexp_extract(c, rfc, 2)), F.lit(MONTHS))
    month = F.when((month_at % 3) == 1, ((month_at + 2) / 3).cast("int"))
    rfc_ts = F.try_make_timestamp_ntz(
        year, month, number(rfc, 1), number(rfc, 4), number(rfc, 5),
        F.coalesce(number(rfc, 6), F.lit(0)),
    )
    iso_ts = F.try_make_timestamp_ntz(
        number(iso, 1), number(iso, 2), number(iso, 3), F.coalesce(number(iso, 4), F.lit(0)),
        F.coalesce(number(iso, 5), F.lit(0)), F.coalesce(number(iso, 6), F.lit(0)),
    )
    return F.coalesce(F.when(c.rlike(rfc), rfc_ts), F.when(c.rlike(iso), iso_ts))


def time_features(ts: Column) -> dict[str, Column]:
    """Cyclic hour, weekend and business hours; neutral values where the time is missing."""
    angle = (F.hour(ts) + F.minute(ts) / 60.0) * (2 * math.pi / 24)
    weekday = F.weekday(ts)
    business = (weekday < 5) & (F.hour(ts) >= 8) & (F.hour(ts) < 18)
    return {
        "hour_sin": F.coalesce(F.sin(angle), F.lit(0.0)),
        "hour_cos": F.coalesce(F.cos(angle), F.lit(0.0)),
        "is_weekend": F.coalesce((weekday >= 5).cast("int"), F.lit(0)),
        "is_business_hours": F.coalesce(business.cast("int"), F.lit(1)),
    }


def header_features(subject, to, cc, sender, has_unsubscribe: Column, precedence, sent_at: Column):
    """The nine header features from structured fields; ``sent_at`` is a timestamp column."""
    cols = {
        "n_recipients": address_count(to) + address_count(cc),
        "is_reply_or_forward": is_reply_or_forward(subject),
        "sender_automated": sender_automated(sender),
        "has_list_unsubscribe": F.coalesce(has_unsubscribe.cast("int"), F.lit(0)),
        "has_precedence_bulk": precedence_bulk(precedence),
        **time_features(sent_at),
    }
    return [cols[name].alias(name) for name in HEADER_COLS]


def header_features_from_map(headers, subject=None):
    """The same features from a parsed header map, so both entry points share one rule."""
    h = F.col(headers) if isinstance(headers, str) else headers
    return header_features(
        field(h, "subject") if subject is None else subject,
        field(h, "to"), field(h, "cc"), field(h, "from"),
        F.map_contains_key(h, "list-unsubscribe"), field(h, "precedence"),
        local_datetime(field(h, "date")),
    )


def sender_name_and_address(c) -> tuple[Column, Column]:
    """Display name and address of a ``Name <address>`` field; the whole field where it has none."""
    c = text_or_empty(c)
    pattern = r"^(.*?)\s*<([^>]+)>$"
    found = c.rlike(pattern)
    address = F.regexp_extract(c, pattern, 2)
    name = strip(F.regexp_replace(F.regexp_extract(c, pattern, 1), r'^"|"$', ""))
    shown = F.when(name != "", name).otherwise(address)
    return F.when(found, shown).otherwise(c), F.when(found, address).otherwise(c)
