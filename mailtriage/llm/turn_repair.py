"""Repair of damaged conversations: the cheapest edits that make the turns alternate, found by alignment.

Turns that remain must have role initials of the form ``(s?(ua)+)?``. Keep costs 0, Rerole (to user or assistant) 1,
Delete 2, Insert (an empty user or assistant turn) 5; a blank or repeated turn can only be deleted, and a truncated one
that is not deleted costs 5 more.

1. Faults are columns: blank (no word), duplicate (role and text seen earlier, by a window), truncated (the last
   character that is no ASCII white space is not one of ``.!?``); the first that holds counts.
2. A conversation's turns become a code, two characters a turn: initial and fault. Only codes go to Python.
3. The code is aligned to the target string of each feasible length (Wagner-Fischer). Cell (i, r) is the cost of turning
   rows i.. into the last r roles of ``..uaua``; targets of all lengths end alike, so a longer target adds columns and
   repeats none. A leading ``s`` is a kept turn with only deletions before it.
4. The cheapest cost so far is the incumbent (at first: delete all). Ukkonen's band leaves out cells off the diagonal by
   more than it allows, at 2 a row and 5 a role; lengths whose least cost exceeds it are not tried.
5. Of every length that reaches the least cost the edits are traced from the front, the ASCII-least letter first where
   several keep the cost; the least of these audits wins. Since costs run to the end, the first letter decides.
6. The edits go back to the JVM, where roles and texts are put together.

The unit of work is a conversation: one task holds its turns, and the table of its alignment has a column per target
length, turns by roles; both are bounded by the longest conversation, not by their number.

Defined cases: null roles and texts are one space. Turns go by turn (nulls first), then role, then text. A role whose
initial is none of s, u, a (empty ones too) cannot be kept. Conversations with null ids are one conversation. One whose
rows are all gone has zeros, an empty audit and the digest of nothing. Empty input gives no rows; other columns are not read.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from mailtriage.session import ship

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NEVER = 1 << 40
ROLES = {"u": "user", "a": "assistant"}
# ASCII white space.
BLANKS = " \t\n\x0b\x0c\r"

_EDITS = "cost long, audit string, edits array<struct<row:int,role:string>>"


def _columns(code: str):
    """Per row: what it costs to keep it as u, as a, as s."""
    initial, fault = np.array(list(code[::2]), "U1"), np.array(list(code[1::2]), "U1")
    extra = np.where(fault == "t", TRUNCATED, np.where((fault == "b") | (fault == "d"), NEVER, 0)).astype(np.int64)
    return {c: extra + (np.where(initial == c, KEEP, REROLE) if c != "s" else np.where(initial == c, KEEP, NEVER)) for c in "uas"}


def _next_column(before: np.ndarray | None, use: np.ndarray, r: int, limit: int) -> np.ndarray:
    """Costs of rows i.. against r roles from those against r - 1; beyond the band of ``limit`` they are NEVER."""
    n = len(use)
    left = np.arange(n, -1, -1)
    cost = np.full(n + 1, NEVER, np.int64)
    if before is None:
        cost = DELETE * left
    else:
        # Rows left over are deleted, roles left over inserted: what lies off the diagonal has at least this cost.
        lo, hi = max(0, n - r - limit // DELETE), min(n, n - r + limit // INSERT)
        if lo <= hi:
            base = before[lo:hi + 1] + INSERT
            upto = min(hi, n - 1)
            np.minimum(base[:upto - lo + 1], before[lo + 1:upto + 2] + use[lo:upto + 1], out=base[:upto - lo + 1])
            # A deletion leads from i to i + 1 at the same r.
            rising = (base - DELETE * left[lo:hi + 1])[::-1]
            cost[lo:hi + 1] = np.minimum.accumulate(rising)[::-1] + DELETE * left[lo:hi + 1]
    return np.minimum(cost, NEVER)


def _trace(table: list[np.ndarray], use: dict[str, np.ndarray], r: int, from_row: int) -> list[tuple[str, int, str | None]]:
    """Edits from row ``from_row`` on against the last r roles: of those that keep the cost the ASCII-least letter."""
    out, i, n = [], from_row, len(use["u"])
    while i < n or r:
        cost, role = table[r][i], "ua"[r % 2]
        if i < n and table[r][i + 1] + DELETE == cost:
            out.append(("D", i, None))
            i += 1
        elif r and table[r - 1][i] + INSERT == cost:
            out.append(("I", -1, ROLES[role]))
            r -= 1
        else:
            kept = use[role][i] % TRUNCATED == KEEP
            out.append(("K", i, None) if kept else ("R", i, ROLES[role]))
            i, r = i + 1, r - 1
    return out


def repair(code: str) -> tuple[int, list[tuple[str, int, str | None]]]:
    """Cost and edits (letter, row or -1, new role or null) of a conversation's code."""
    n = len(code) // 2
    use = _columns(code)
    table = [_next_column(None, use["u"], 0, 0)]
    best, ends = int(table[0][0]), [("", 0)]
    # The least cost of all rows before a kept s.
    heads = use["s"] + DELETE * np.arange(n)
    heads_at = np.flatnonzero(heads < NEVER)
    r = 0
    while INSERT * max(0, r + 1 - n) <= best:
        r += 1
        # Position r from the end is a where r is odd.
        table.append(_next_column(table[-1], use["ua"[r % 2]], r, best))
        if r % 2:
            continue
        for head, cost in (("", table[r][0]), ("s", (heads[heads_at] + table[r][heads_at + 1]).min(initial=NEVER))):
            if cost < best:
                best, ends = int(cost), []
            if cost == best and cost < NEVER:
                ends.append((head, r))
    found = []
    for head, r in ends:
        if head:
            for at in heads_at[heads[heads_at] + table[r][heads_at + 1] == best].tolist():
                found.append([("D", i, None) for i in range(at)] + [("K", at, None)] + _trace(table, use, r, at + 1))
        else:
            found.append(_trace(table, use, r, 0))
    return best, min(found, key=lambda edits: "".join(e[0] for e in edits))


def _align(codes: pd.Series) -> pd.DataFrame:
    # Short conversations share few codes.
    known = {c: repair(c) for c in codes.unique()}
    rows = [known[c] for c in codes]
    return pd.DataFrame({
        "cost": [c for c, _ in rows], "audit": ["".join(e[0] for e in edits) for _, edits in rows],
        "edits": [[{"row": i, "role": role} for letter, i, role in edits if letter != "D"] for _, edits in rows]})


def damaged(rows: DataFrame) -> DataFrame:
    """The query's damage: ``gone``, ``copies`` and changed role and text, by crc32 of ``conv_id:turn``."""
    space = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind == 0).alias("gone"), F.when(kind == 3, 2).otherwise(1).alias("copies"))


def _count(turns: Column, fault: str) -> Column:
    return F.size(F.filter(turns, lambda t: t["fault"] == fault)).cast("bigint")


def repaired(rows: DataFrame) -> DataFrame:
    """One row per conv_id of ``rows`` (conv_id, turn, role, text, gone, copies): faults, cost, audit, repaired turns.

    ``gone`` marks rows that only name their conversation; ``copies`` is how often a row stands in it.
    """
    ship(rows.sparkSession)
    rows = rows.select("conv_id", "turn", "gone", F.explode(F.array_repeat(F.struct("role", "text"), F.col("copies").cast("int"))).alias("t"))
    rows = rows.select("conv_id", "turn", "gone", F.coalesce("t.role", F.lit(" ")).alias("role"), F.coalesce("t.text", F.lit(" ")).alias("text"))
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    # All windows and the grouping use one exchange by conv_id.
    seen = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy("turn")) > 1
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("gone", *order))
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    fault = F.when(last == "", "b").when(F.col("seen"), "d").when(~last.isin(".", "!", "?"), "t").otherwise("-")
    rows = rows.repartition("conv_id").withColumn("seen", seen).withColumn("at", at)
    turn = F.struct("at", "role", "text", F.rpad(F.substring("role", 1, 1), 1, " ").alias("initial"), fault.alias("fault"))
    whole = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.when(~F.col("gone"), turn))).alias("turns"),
        F.max(F.when(~F.col("gone"), F.col("turn"))).alias("high"), F.min(F.when(~F.col("gone"), F.col("turn"))).alias("low"),
        F.size(F.collect_set(F.when(~F.col("gone"), F.col("turn")))).alias("distinct"))
    initials = F.array_join(F.transform("turns", lambda t: t["initial"]), "")
    pairs = F.when(F.size("turns") > 1, F.sequence(F.lit(1), F.size("turns") - 1)).otherwise(F.array().cast("array<int>"))
    whole = whole.withColumn("initials", initials)
    whole = whole.select(
        "conv_id", "turns", F.coalesce(F.col("high") - F.col("low") + 1 - F.col("distinct"), F.lit(0)).cast("bigint").alias("gaps"),
        _count(F.col("turns"), "b").alias("blank"), _count(F.col("turns"), "d").alias("duplicate"), _count(F.col("turns"), "t").alias("truncated"),
        F.size(F.filter(pairs, lambda i: ~F.concat(F.get("turns", i - 1)["initial"], F.get("turns", i)["initial"]).isin("su", "ua", "au"))).cast("bigint").alias("illegal"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["initial"], t["fault"])), "").alias("code"))
    align = F.pandas_udf(_align, _EDITS)
    whole = whole.withColumn("found", align("code"))
    turns = F.transform("found.edits", lambda e: F.struct(
        F.coalesce(e["role"], F.get("turns", e["row"])["role"]).alias("role"), F.when(e["row"] < 0, "").otherwise(F.get("turns", e["row"])["text"]).alias("text")))
    return whole.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "found.cost", "found.audit", turns.alias("repaired"))


def with_digest(found: DataFrame) -> DataFrame:
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return found.withColumn("repaired_sha256", F.sha2(lines, 256)).drop("repaired")
