"""Chat formatting: reply trees become conversations, one for each of a tree's best root-to-leaf paths.

All column expressions.  A turn is ``<|role|>text<|end|>``; in roles and texts each of ``< [ | \\`` is followed by a ``\\``, so that
no control string such as ``<|end|>``, ``</s>`` or ``[INST]`` survives inside one, and dropping that ``\\`` gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracesieve.session import written

OPEN, CLOSE, END = "<|", "|>", "<|end|>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[|\\])", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[|\\])\\", "$1")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escaped(role), F.lit(CLOSE), escaped(text), F.lit(END))


def _jumps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables of each node's ancestor 1, 2, 4 ... steps up, each a self-join of the one before, and per node its path from the root.

    The last table, ``tree, node, depth, total``, has only nodes whose path begins at a root: those on a loop are left out.
    """
    most = nodes.count()
    now = written(nodes.select("tree", "node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total")), "chat-jumps")
    tables, ended = [], now.where("up is null")
    now = now.where("up is not null")
    while not now.isEmpty() and 1 << len(tables) < 2 * most:
        # Nodes that have come to their root are done; the others add what the node at the end of their jump has so far.
        tables.append(now.select("tree", "node", "up"))
        above = ended.unionByName(now).select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("total").alias("total2"))
        joined = now.join(above, ["tree", "up"])
        made = written(joined.select("tree", "node", F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth"), (F.col("total") + F.col("total2")).alias("total")), "chat-jumps")
        ended, now = ended.unionByName(made.where("up is null")), made.where("up is not null")
    return tables, ended.select("tree", "node", "depth", "total")


def best_paths(messages: DataFrame, best: int | None = None) -> DataFrame:
    """Messages of each tree's ``best`` root-to-leaf paths (all, if none is given): ``tree, leaf, branch, at`` and the message.

    ``messages`` has ``tree`` and ``node`` (text keys), ``parent``, ``score``, ``role`` and ``text``.  A path's score is the mean of its
    messages'; ``branch`` ranks a tree's paths by it, ties to the lesser leaf key.  ``at`` counts up from the root.
    A parent that is not in the tree makes a root; nodes on a loop are on no path; null scores count as 0.  Rows of one tree and node are
    one message: the one with the least parent (none before any), then score, role and text.  Rows without a tree or a node are on no path.
    An empty table has no paths; other columns are not read.
    """
    told = messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"), "role", "text").where("tree is not null and node is not null")
    nodes = told.groupBy("tree", "node").agg(F.min(F.struct("parent", "score", "role", "text")).alias("m")).select("tree", "node", "m.*")
    own = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("found"))
    nodes = written(nodes.join(own, ["tree", "parent"], "left").withColumn("parent", F.when(F.col("found"), F.col("parent"))).drop("found"), "chat-nodes")
    tables, paths = _jumps(nodes)
    replied = nodes.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    leaves = paths.join(replied, ["tree", "node"], "left_anti").withColumn("score", F.col("total") / F.col("depth"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "node"))
    leaves = leaves.withColumn("branch", rank)
    if best is not None:
        leaves = leaves.where(F.col("branch") <= best)
    steps = leaves.select("tree", F.col("node").alias("leaf"), "branch", "depth", "node", F.lit(0).cast("long").alias("down"))
    for k, table in reversed(list(enumerate(tables))):
        # Each message stays, and its ancestor 2^k steps up joins it.  Far ancestors come first, so that a path's rows become
        # many only in the last joins: all joins together make about twice the rows of the result.
        both = F.array(F.struct("node", "down"), F.struct(F.col("up").alias("node"), (F.col("down") + (1 << k)).alias("down")))
        joined = steps.join(table, ["tree", "node"], "left")
        steps = joined.select("tree", "leaf", "branch", "depth", F.explode(F.filter(both, lambda s: s["node"].isNotNull())).alias("s")).select("tree", "leaf", "branch", "depth", "s.*")
    placed = steps.select("tree", "leaf", "branch", "node", (F.col("depth") - 1 - F.col("down")).alias("at"))
    return placed.join(nodes.select("tree", "node", "role", "text"), ["tree", "node"])


def conversations(paths: DataFrame) -> DataFrame:
    """One row for each path: ``tree, leaf, branch, formatted`` and ``loss``, the spans ``start, end`` (code points of ``formatted``,
    the end exclusive) of its assistant texts.

    A conversation is one row, so its turns meet in one task; that is the bound of the format, not of the trees.
    """
    turn = paths.select("tree", "leaf", "branch", "at", "role", rendered(F.col("role"), F.col("text")).alias("turn"), F.length(escaped(F.col("role"))).alias("named"))
    size = F.length("turn").cast("long")
    whole = Window.partitionBy("tree", "leaf", "branch").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(size).over(whole), F.lit(0))
    first = before + F.col("named") + len(OPEN + CLOSE)
    last = before + size - len(END)
    spans = turn.select("tree", "leaf", "branch", "at", "turn", F.when(F.col("role") == "assistant", F.struct(first.alias("start"), last.alias("end"))).alias("span"))
    turns = spans.groupBy("tree", "leaf", "branch").agg(F.array_sort(F.collect_list(F.struct("at", "turn", "span"))).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: t["turn"]), "")
    loss = F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull())
    return turns.select("tree", "leaf", "branch", text.alias("formatted"), loss.alias("loss"))


def read_back(formatted: Column, loss: Column) -> tuple[Column, Column]:
    """The turns ``role, text`` of a formatted conversation, and the text under its loss spans, unescaped."""
    pieces = F.split(formatted, r"<\|end\|>")

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, CLOSE, 1)
        role = F.substring(head, F.lit(len(OPEN) + 1), F.length(head))
        text = F.substring(piece, F.length(head) + len(CLOSE) + 1, F.length(piece))
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

    turns = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)
    under = F.transform(loss, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return turns, F.array_join(under, "")


def linear_messages(rows: DataFrame) -> DataFrame:
    """Messages of conversations without branches (``conv_id, turn, role, text``): each row replies to the one before by ``turn``.

    Rows of one ``turn`` follow by role, then text; repeated rows stay; a null turn comes first; null roles and texts are empty;
    rows without a ``conv_id`` are one conversation without one.  Other columns are not read.
    """
    read = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    tree = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-")).alias("tree")
    numbered = read.withColumn("n", n)
    return numbered.select(tree, F.col("n").cast("string").alias("node"), F.when(F.col("n") > 1, (F.col("n") - 1).cast("string")).alias("parent"), F.lit(0.0).alias("score"), "role", "text")
