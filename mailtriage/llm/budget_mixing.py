"""Mixing to target weights: hierarchical budgets over domain, language and source.

1. Tokens per leaf (domain, lang, source) are counted over all documents; a leaf can give its tokens
   times the allowed epochs, a node what its leaves can give.
2. The budget goes down the tree level by level. Among siblings it is split by weight; a child that can
   give less than its share gives all it has, and what it lacks is split among the siblings that can
   still give, by weight. Only if all siblings are exhausted does the parent itself fall short, and then
   its own siblings make up for it. One window per level does this in closed form: with siblings in the
   order of capacity / weight the exhausted ones come first.
3. Every leaf takes its budget as a prefix of seeded epochs: each epoch is an order of its documents by a
   hash of seed, epoch and id. Whole epochs are taken as such; of the last one the prefix is found from
   token sums of hash buckets, so that only one bucket per leaf is ranked, whatever the leaf's size.

Defined cases: null text has no tokens; null lang or source is a leaf value of its own, written as an empty
name; null ids hash as the empty string; rows that tie in the order are taken in the order of the id. Of a
group of rows equal in id, bucket ties are ranked one after the other, in no fixed order. Documents without
tokens are kept when any part of their leaf is. Empty input gives no rows. Other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mailtriage.llm.common import WORD, text_of
from mailtriage.session import materialize

SEED = 20_240_601
BUCKET_DIGITS = 3
LEVELS = ["domain", "lang", "source"]


def tokens_of(column: str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("bigint")


def split_budget(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Budgets of children: ``nodes`` has the parent's columns and ``budget``, the child's name, ``weight`` (a positive integer) and ``cap``.

    Whole tokens: what is left after exhausted children is split by the running sum of weights, rounded down,
    so that shares add up to the budget exactly and never pass a child's capacity.
    """
    by_need = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), name)
    before, onward = by_need.rowsBetween(Window.unboundedPreceding, -1), by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rest = F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    nodes = nodes.withColumn("__full", F.col("cap") * F.sum("weight").over(onward) <= rest * F.col("weight"))
    whole = Window.partitionBy(*parent)
    nodes = nodes.withColumn("__rest", F.col("budget") - F.sum(F.when(F.col("__full"), F.col("cap")).otherwise(0)).over(whole))
    open_weight = F.when(F.col("__full"), 0).otherwise(F.col("weight"))
    nodes = nodes.withColumn("__sum", F.sum(open_weight).over(whole)).withColumn("__upto", F.sum(open_weight).over(by_need.rowsBetween(Window.unboundedPreceding, 0)))
    upto = F.expr("__rest * __upto div nullif(__sum, 0)") - F.expr("__rest * (__upto - weight) div nullif(__sum, 0)")
    return nodes.withColumn("share", F.when(F.col("__full"), F.col("cap")).otherwise(upto)).drop("__full", "__rest", "__sum", "__upto")


def leaf_budgets(leaves: DataFrame, weights: DataFrame, budget_num: int, budget_den: int, max_epochs: int) -> DataFrame:
    """One row per leaf: its tokens and its budget. ``weights`` has node (the path, joined by "/") and weight; a node without one weighs 1.

    The whole budget is ``budget_num / budget_den`` of all tokens, and no more than the leaves can give.
    """
    path = lambda n: F.concat_ws("/", *LEVELS[:n])
    out = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    whole = Window.partitionBy(F.lit(1))
    out = out.withColumn("budget", F.least(F.expr(f"sum(tokens) over () * {budget_num} div {budget_den}"), F.sum("cap").over(whole)))
    for n in range(1, len(LEVELS) + 1):
        children = out.groupBy(*LEVELS[:n]).agg(F.sum("cap").alias("cap"), F.first("budget").alias("budget"))
        children = children.withColumn("node", path(n)).join(weights, "node", "left").withColumn("weight", F.coalesce("weight", F.lit(1)).cast("bigint"))
        shares = split_budget(children, LEVELS[:n - 1] or [F.lit(1)], LEVELS[n - 1]).select(*LEVELS[:n], "share")
        out = out.drop("budget").join(shares.withColumnRenamed("share", "budget"), LEVELS[:n])
    return out.select(*LEVELS, F.col("tokens").alias("leaf_tokens"), "budget")


def _order(epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def mix(docs: DataFrame, domain: Column, weights: DataFrame, budget_num: int, budget_den: int = 100, max_epochs: int = 1, seed: int = SEED) -> DataFrame:
    """``docs`` with domain, tokens, epochs (whole ones taken), last_tokens (taken in the last, partial epoch) and selected_tokens."""
    keys = {"__domain": F.coalesce(domain, F.lit("")), "__lang": F.coalesce("lang", F.lit("")), "__source": F.coalesce("source", F.lit(""))}
    leaf = list(keys)
    keyed = docs.withColumns({**keys, "__tokens": tokens_of()})
    sums = keyed.groupBy(*leaf).agg(F.sum("__tokens").alias("tokens")).toDF(*LEVELS, "tokens")
    budgets = leaf_budgets(materialize(sums, "mix-leaves"), weights, budget_num, budget_den, max_epochs)
    whole = F.when(F.col("leaf_tokens") > 0, F.expr("budget div leaf_tokens")).otherwise(0)
    budgets = budgets.select(*LEVELS, whole.alias("epochs"), (F.col("budget") - F.col("leaf_tokens") * whole).alias("rest"))
    budgets = materialize(budgets.toDF(*leaf, "__epochs", "__rest"), "mix-budgets")

    def placed(per_leaf):
        # One row per leaf: domains, languages and sources, never documents. Spark checks the size before it broadcasts.
        return keyed.join(per_leaf, leaf).withColumn("__key", _order(F.col("__epochs"), seed)).withColumn("__bucket", F.substring("__key", 1, BUCKET_DIGITS))

    per_bucket = placed(budgets).groupBy(*leaf, "__rest", "__bucket").agg(F.sum("__tokens").alias("__within"))
    running = Window.partitionBy(*leaf).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    below = per_bucket.withColumn("__below", F.coalesce(F.sum("__within").over(running), F.lit(0)))
    # The bucket of each leaf in which its budget ends; a leaf without a partial epoch has none.
    end = below.filter((F.col("__rest") > F.col("__below")) & (F.col("__rest") <= F.col("__below") + F.col("__within")))
    end = budgets.join(end.select(*leaf, F.col("__bucket").alias("__end"), "__below"), leaf, "left")
    dealt = placed(materialize(end, "mix-ends"))
    cut = F.coalesce(F.col("__bucket") == F.col("__end"), F.lit(False))
    clear = dealt.filter(~cut).withColumn("__last", F.when(F.col("__bucket") < F.col("__end"), F.col("__tokens")).otherwise(0))
    # Only the one bucket per leaf in which the budget ends is ranked.
    before = Window.partitionBy(*leaf, "__bucket").orderBy("__key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    prefix = F.coalesce(F.sum("__tokens").over(before), F.lit(0))
    ends = dealt.filter(cut).withColumn("__last", F.greatest(F.lit(0), F.least(F.col("__tokens"), F.col("__rest") - F.col("__below") - prefix)))
    out = clear.unionByName(ends)
    results = {"domain": F.col("__domain"), "tokens": F.col("__tokens"), "epochs": F.col("__epochs"), "last_tokens": F.col("__last"), "selected_tokens": F.col("__tokens") * F.col("__epochs") + F.col("__last")}
    return out.withColumns(results).drop(*leaf, "__tokens", "__epochs", "__rest", "__key", "__bucket", "__end", "__below", "__last")
