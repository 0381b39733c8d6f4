"""Reply trees to conversations: root-to-leaf paths by iterative self-joins, ranked by score, one formatted text per path.

Input: one row per message: tree_id, message_id, parent_id, role, text, score.

1. Links. A jump table holds each message's ancestor 1, 2, 4, .. messages up; each table is the self-join of the one
   before, and only messages deep enough are in it, so a chain of n messages takes log2(n) joins of falling size. A jump
   carries the sum of scores over the messages it passes.
2. Rank. Messages without replies are leaves. From each leaf the tables are walked from the longest jump down: that gives
   the depth and the total score of its path without listing the path. Of each tree the ``best`` paths stay, by mean
   score (highest first), then depth (longest first), then leaf id.
3. List. The walk is done again for chosen leaves, and now every message of a path is kept: messages known so far, joined
   with the jump tables from the longest down, give each ancestor exactly once. Only ids move until here.
4. Format. Texts join their places, offsets are running sums along a path, and a path's turns are joined in order.

All of it is column expressions; no Python runs on executors.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Inside roles and texts ``<|`` becomes ``<||``, so no control string
can stand there, and a line end inside a role becomes ``<|nl|>``. ``mask`` has, per turn, the code points where the turn and
its text start and where the text ends, and whether it counts for the loss (assistant turns).

Defined cases: null texts, roles are empty, null scores 0. A parent that is not in the tree, or whose id is not smaller than the
message's own, is none: the message is a root, so there are no cycles (ids are given in order of time). Of rows equal in
tree and message id the one with the highest score stays, then the smallest parent id (none first), role and text. A null tree id is one tree; null
message ids are no one's parent and roots of their own, one per tree. Empty input gives no rows. A path's text must fit into one row, as its
output is one; trees themselves may be of any size, they are never collected. ``messages`` is read twice: give a table,
not a long computation. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from mailtriage.llm.common import text_of
from mailtriage.session import materialize

START, END, LINE = "<|im_start|>", "<|im_end|>\n", "<|nl|>"
TURNS_OF_LOSS = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def unescaped(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def chains(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Rows of each ``tree`` as a tree without branches: in ``order`` (nulls first), each the reply to the one before."""
    at = F.row_number().over(Window.partitionBy(tree).orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    numbered = rows.select(F.col(tree).alias("tree_id"), at.cast("bigint").alias("message_id"), "role", "text")
    return numbered.select("tree_id", "message_id", (F.col("message_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def _same(left: DataFrame, right: DataFrame, *pairs: tuple[str, str]) -> Column:
    return reduce(lambda a, b: a & b, [left[x].eqNullSafe(right[y]) if x.endswith("tree") else left[x] == right[y] for x, y in pairs])


def jump_tables(links: DataFrame) -> list[DataFrame]:
    """tree, node, up, passed: the ancestor 2^k messages up and the scores of the messages from the parent up to it."""
    tables = []
    step = materialize(links.filter("parent is not null").select("tree", "node", F.col("parent").alias("up"), F.col("parent_score").alias("passed")), "trees-jumps")
    while not step.isEmpty():
        tables.append(step)
        further = step.select(F.col("tree").alias("next_tree"), F.col("node").alias("next"), F.col("up").alias("next_up"), F.col("passed").alias("next_passed"))
        step = materialize(step.join(further, _same(step, further, ("tree", "next_tree"), ("up", "next"))).select(
            "tree", "node", F.col("next_up").alias("up"), (F.col("passed") + F.col("next_passed")).alias("passed")), "trees-jumps")
    return tables


def ranked_leaves(links: DataFrame, tables: list[DataFrame], best: int) -> DataFrame:
    """tree, leaf, depth, path_score, branch_rank: the ``best`` paths of each tree."""
    replied = links.filter("parent is not null").select(F.col("tree").alias("p_tree"), F.col("parent").alias("p_node")).distinct()
    leaves = links.join(replied, _same(links, replied, ("tree", "p_tree"), ("node", "p_node")), "left_anti")
    walk = leaves.select("tree", F.col("node").alias("leaf"), F.col("node").alias("at"), F.lit(1).cast("bigint").alias("depth"), F.col("score").alias("total"))
    for k in reversed(range(len(tables))):
        jump = tables[k].select(F.col("tree").alias("j_tree"), "node", "up", "passed")
        walk = walk.join(jump, _same(walk, jump, ("tree", "j_tree"), ("at", "node")), "left").select(
            "tree", "leaf", F.coalesce("up", "at").alias("at"), (F.col("depth") + F.when(F.col("up").isNull(), 0).otherwise(1 << k)).alias("depth"),
            (F.col("total") + F.coalesce("passed", F.lit(0.0))).alias("total"))
    scored = walk.select("tree", "leaf", "depth", (F.col("total") / F.col("depth")).alias("path_score"))
    # Spark limits groups before the exchange, so a tree of many leaves sends ``best`` rows a task.
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("path_score"), F.desc("depth"), F.asc_nulls_first("leaf")))
    return scored.withColumn("branch_rank", rank).filter(F.col("branch_rank") <= best)


def path_members(chosen: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """tree, leaf, branch_rank, place, node: every message of the chosen paths, places from 1 at the root."""
    members = chosen.select("tree", "leaf", "branch_rank", F.col("depth").alias("place"), F.col("leaf").alias("node"))
    for k in reversed(range(len(tables))):
        jump = tables[k].select(F.col("tree").alias("j_tree"), F.col("node").alias("j_node"), "up")
        further = members.join(jump, _same(members, jump, ("tree", "j_tree"), ("node", "j_node")))
        members = materialize(members.union(further.select("tree", "leaf", "branch_rank", F.col("place") - (1 << k), F.col("up"))), "trees-members")
    return members


def formatted(messages: DataFrame, best: int = 1) -> DataFrame:
    """tree_id, leaf_id, branch_rank, path_score, n_turns, formatted, mask: the ``best`` paths of each tree as conversations."""
    rows = messages.select(
        F.col("tree_id").alias("tree"), F.col("message_id").alias("node"), F.col("parent_id").alias("parent"), text_of("role").alias("role"),
        text_of("text").alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    # Of rows with one id, links take the parent of the row that gives the text below.
    first = F.min(F.struct((-F.col("score")).alias("least"), "parent")).alias("r")
    ids = rows.groupBy("tree", "node").agg(first).select("tree", "node", "r.parent", (-F.col("r.least")).alias("score"))
    ids = materialize(ids, "trees-ids")
    owners = ids.select(F.col("tree").alias("o_tree"), F.col("node").alias("o_node"), F.col("score").alias("parent_score"))
    links = ids.join(owners, _same(ids, owners, ("tree", "o_tree"), ("parent", "o_node")) & (F.col("parent") < F.col("node")), "left")
    links = materialize(links.select("tree", "node", "score", F.col("o_node").alias("parent"), "parent_score"), "trees-links")
    tables = jump_tables(links)
    chosen = materialize(ranked_leaves(links, tables, best), "trees-chosen")
    members = path_members(chosen, tables)
    texts = rows.select(F.col("tree").alias("t_tree"), F.col("node").alias("t_node"), "role", "text", "score", "parent")
    path = ["tree", "leaf", "branch_rank"]
    turns = members.join(texts, members["tree"].eqNullSafe(texts["t_tree"]) & members["node"].eqNullSafe(texts["t_node"]))
    place = F.row_number().over(Window.partitionBy(*path, "place").orderBy(F.desc("score"), F.asc_nulls_first("parent"), "role", "text"))
    turns = turns.repartition(*path).withColumn("of_place", place).filter("of_place = 1")
    turns = turns.select(*path, "place", (F.col("role") == TURNS_OF_LOSS).alias("loss"), escaped(F.col("text")).alias("body"), F.concat(
        F.lit(START), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit(LINE)), F.lit("\n")).alias("head"))
    size = F.length("head") + F.length("body") + len(END)
    before = F.sum(size).over(Window.partitionBy(*path).orderBy("place")) - size
    turns = turns.withColumn("start", before)
    turn = F.struct("place", "head", "body", "loss", "start")
    whole = turns.groupBy(*path).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    mask = F.transform("turns", lambda t: F.struct(
        t["start"].alias("start"), (t["start"] + F.length(t["head"])).alias("text_start"), (t["start"] + F.length(t["head"]) + F.length(t["body"])).alias("text_end"), t["loss"].alias("loss")))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    scores = chosen.select(F.col("tree").alias("c_tree"), F.col("leaf").alias("c_leaf"), "path_score")
    whole = whole.join(scores, whole["tree"].eqNullSafe(scores["c_tree"]) & whole["leaf"].eqNullSafe(scores["c_leaf"]))
    return whole.select(F.col("tree").alias("tree_id"), F.col("leaf").alias("leaf_id"), "branch_rank", "path_score", F.size("turns").cast("bigint").alias("n_turns"), text.alias("formatted"), mask.alias("mask"))


def read_turns(text: Column) -> Column:
    """The turns of a formatted text, (role, text) each, as they were before formatting."""
    parts = F.filter(F.split(text, r"<\|im_end\|>\n"), lambda p: p != "")

    def turn(p):
        head = F.substring_index(p, "\n", 1)
        role = F.replace(F.substring(head, F.lit(len(START) + 1), F.length(head)), F.lit(LINE), F.lit("\n"))
        return F.struct(unescaped(role).alias("role"), unescaped(F.substring(p, F.length(head) + 2, F.length(p))).alias("text"))

    return F.transform(parts, turn)


def read_loss(text: Column, mask: Column) -> Column:
    """The texts under the loss mask, unescaped, in order. Each turn is cut from its own part, so reading is linear."""
    parts = F.filter(F.split(text, r"(?<=<\|im_end\|>\n)"), lambda p: p != "")
    cut = F.zip_with(parts, mask, lambda p, m: F.when(m["loss"], F.substring(p, (m["text_start"] - m["start"]).cast("int") + 1, (m["text_end"] - m["text_start"]).cast("int"))))
    return F.transform(F.filter(cut, lambda t: t.isNotNull()), unescaped)


def with_digests(found: DataFrame) -> DataFrame:
    """tree_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the formatted texts."""
    read = found.select("tree_id", "formatted", read_turns(F.col("formatted")).alias("turns"), F.array_join(read_loss(F.col("formatted"), F.col("mask")), "").alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "tree_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"))
