"""Merkle manifest of a dataset: a digest for every row, one tree of digests for each group, and one over the groups.

Nodes of a level stand in a row and every ``fanout`` consecutive ones have a parent.  A node finds the others of its run by equijoins of
the level with itself on computed places: a sibling ``s`` slots on stands at ``place - slot + (slot + s) % fanout``.  With each node's
siblings beside it, the rows in slot zero emit the parents, the next level.  Nodes are 32 bytes and two numbers; texts are read once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracesieve.session import written

FANOUT = 3
#: The columns of ``documents`` in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that one plan joins on the way down.
PLANNED = 3

_PATH = "array<struct<before: binary, after: binary>>"


def _none() -> Column:
    return F.unhex(F.lit(""))


def digest(text: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def hex_text(digests: Column) -> Column:
    """Digests in a row, each as 64 lowercase hex digits."""
    return F.lower(F.hex(digests))


def record(values: list[Column]) -> Column:
    """What a row's digest is taken of: each value ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add ``_part`` and ``_at``, the row's place from 0 in the whole order: a range shuffle, and one count for each range.

    The rows are written where they were sorted, so places stay as they are whatever is lost later.  ``order`` should tell rows
    apart, or equal ones meet in one range.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    kept = written(ranged, name).withColumn("_part", F.shiftright("_id", 33))
    counts = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))  # a row for each range
    placed = kept.join(F.broadcast(starts), "_part")
    return placed.withColumn("_at", F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id", "_start")


@dataclass(frozen=True)
class Trees:
    """Trees built side by side.  ``steps[k]`` has level ``k`` of those that are larger there (``tree, idx, hash, before, after`` and the
    columns given), ``tops`` the last node of each (``tree, hash, height`` and, of a single leaf, the columns given)."""

    steps: list[DataFrame]
    tops: DataFrame
    fanout: int


def build(leaves: DataFrame, fanout: int = FANOUT) -> Trees:
    """Build all trees of ``tree, idx, size, hash`` (``idx`` counts a tree's ``size`` leaves from 0) and columns that stay with the leaves."""
    if fanout < 2:
        raise ValueError("a run has two nodes at least")
    extra = [c for c in leaves.columns if c not in ("tree", "idx", "size", "hash")]
    most = leaves.agg(F.max("size")).first()[0] or 0
    nodes, steps, tops = leaves, [], []
    while True:
        ended = nodes.where("size = 1").select("tree", "hash", F.lit(len(steps)).alias("height"), *[F.col(c) if c in nodes.columns else F.lit(None).cast(leaves.schema[c].dataType).alias(c) for c in extra])
        tops.append(ended)
        if most <= 1:
            break
        step = written(_beside(nodes.where("size > 1"), fanout), "merkle-level")
        steps.append(step)
        run = F.concat("hash", "after")  # slot zero has nothing before it
        nodes = step.where(F.col("idx") % fanout == 0).select(
            "tree", F.expr(f"idx div {fanout}").alias("idx"), F.expr(f"(size + {fanout - 1}) div {fanout}").alias("size"), digest(hex_text(run)).alias("hash")
        )
        most = -(-most // fanout)
    return Trees(steps, reduce(DataFrame.unionByName, tops), fanout)


def _beside(nodes: DataFrame, fanout: int) -> DataFrame:
    """Every node with the digests of its run's others: those ``before`` and ``after`` it, left to right."""
    slot, own = F.col("idx") % fanout, nodes
    for s in range(1, fanout):
        other = nodes.select("tree", F.col("idx").alias(f"_i{s}"), F.col("hash").alias(f"_h{s}"))
        own = own.withColumn(f"_i{s}", F.col("idx") - slot + (slot + s) % fanout).join(other, ["tree", f"_i{s}"], "left")
    before, after = _none(), _none()
    for k in range(fanout):
        there = {j: F.coalesce(F.col(f"_h{(j - k) % fanout}"), _none()) for j in range(fanout) if j != k}
        before = F.when(slot == k, F.concat(_none(), *[there[j] for j in range(k)])).otherwise(before)
        after = F.when(slot == k, F.concat(_none(), *[there[j] for j in range(k + 1, fanout)])).otherwise(after)
    return own.select(*nodes.columns, before.alias("before"), after.alias("after"))


def paths(trees: Trees, above: DataFrame) -> DataFrame:
    """Every leaf's way up, ``path`` (siblings level by level): ``tree, idx, hash, path``, the leaves' columns and those of ``above``.

    ``above`` has ``tree``, ``path`` (what follows a tree's last node) and other columns.  Ways grow downward, from a level to the one
    below, so that all levels together join half as many rows again as there are leaves.
    """
    carried = [c for c in above.columns if c not in ("tree", "path")]
    kept = [c for c in trees.tops.columns if c not in ("tree", "hash", "height")]
    tops = written(trees.tops.join(above, "tree"), "merkle-tops").withColumn("idx", F.lit(0).cast("long"))
    own = F.array(F.struct("before", "after")).cast(_PATH)
    now = None
    for k in range(len(trees.steps), -1, -1):
        shape = ["tree", "idx", *(["hash", *kept] if k == 0 else []), "path", *carried]
        level = tops.where(F.col("height") == k).select(shape)
        if now is not None:
            over = now.select("tree", F.col("idx").alias("_up"), F.col("path").alias("_path"), *carried)
            joined = trees.steps[k].withColumn("_up", F.expr(f"idx div {trees.fanout}")).join(over, ["tree", "_up"])
            level = level.unionByName(joined.withColumn("path", F.concat(own, "_path")).select(shape))
        # Written every few levels, so that no plan holds more of them, however high the trees are.
        now = written(level, "merkle-paths") if k and k % PLANNED == 0 else level
    return now


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings lead to."""
    return F.aggregate(path, leaf, lambda h, s: digest(hex_text(F.concat(s["before"], h, s["after"]))))


def siblings(path: Column) -> Column:
    """All siblings on a way as hex text, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: hex_text(F.concat(s["before"], s["after"]))), "")


def tampered(docs: DataFrame) -> Column:
    """The text of a row with its line feeds deleted where two divides the checksum of its key, else as it is."""
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def leaves_of(docs: DataFrame, changed: Column | None = None, group: str = "source", key: str = "doc_id", fields=FIELDS) -> DataFrame:
    """The rows as leaves: ``tree, idx, size, hash, key, changed`` (the digest with ``changed`` in place of ``text``, null if equal).

    A tree is named by the place of its first leaf in the order of group, key and digest, so trees are ordered as their groups are.
    """
    values = [F.col(c) for c in fields]
    leaf = digest(record(values))
    other = F.lit(None).cast("binary")
    if changed is not None:
        swapped = [changed if c == "text" else F.col(c) for c in fields]
        other = F.when(~changed.eqNullSafe(F.col("text")), digest(record(swapped)))
    read = docs.select(F.col(group).cast("string").alias("group"), F.col(key).cast("long").alias("key"), leaf.alias("hash"), other.alias("changed"))
    # Repeated rows have equal digests; a number that tells them apart lets ranges part them.
    told = written(read.withColumn("copy", F.monotonically_increasing_id()), "merkle-leaves")
    placed = numbered(told, ["group", "key", "hash", "copy"], "merkle-order")
    # One row for each range and group in it: no group's rows meet, however many there are.
    spans = placed.groupBy("_part", "group").agg(F.min("_at").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("group")
    spans = spans.select(F.col("_part").alias("_p"), F.col("group").alias("_g"), F.min("first").over(whole).alias("tree"), F.sum("n").over(whole).alias("size"))
    joined = placed.join(spans, (F.col("_part") == F.col("_p")) & F.col("group").eqNullSafe(F.col("_g")))
    return joined.select("tree", (F.col("_at") - F.col("tree")).alias("idx"), "size", "hash", "key", "changed")


def manifest(docs: DataFrame, changed: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """Every row of ``docs`` with its proof: ``key, hash, changed, subroot, root`` (digests as bytes) and ``path``, the siblings up to the root.

    Each ``source`` is a tree of its rows by ``doc_id``, nulls first, and the sources' last nodes, nulls first and then by bytes, are a
    tree again.  Rows of one ``doc_id`` follow by digest, so copies stand side by side and the tree is the same in any input order.
    Null columns are digested as such; an empty or very long text is like any other; other columns are not read.  No rows give none.
    """
    trees = build(leaves_of(docs, changed), fanout)
    # The trees' tops, in the order of their groups, are the leaves of the last tree.
    tops = numbered(trees.tops.select(F.col("tree").alias("own"), "hash"), ["own"], "merkle-tops")
    size = tops.count()
    if not size:
        return docs.sparkSession.createDataFrame([], f"key long, hash binary, changed binary, subroot binary, root binary, path {_PATH}")
    top = build(tops.select(F.lit(0).cast("long").alias("tree"), F.col("_at").alias("idx"), F.lit(size).cast("long").alias("size"), "hash", "own"), fanout)
    root = top.tops.first()["hash"]  # one digest
    end = docs.sparkSession.range(1).select(F.col("id").alias("tree"), F.array().cast(_PATH).alias("path"))
    ways = written(paths(top, end).select(F.col("own").alias("tree"), F.col("hash").alias("subroot"), "path"), "merkle-roots")
    return paths(trees, ways).select("key", "hash", "changed", "subroot", F.lit(root).alias("root"), "path")


def verified(docs: DataFrame) -> DataFrame:
    """Every document's digest, its group's and the dataset's root, its proof, and whether what ``tampered`` makes of it still leads to the root."""
    found = manifest(docs, tampered(docs))
    again = folded(F.coalesce("changed", "hash"), F.col("path"))
    made = found.select("key", "hash", "subroot", "root", "path", again.alias("again"))
    return made.select(
        F.col("key").alias("doc_id"), hex_text(F.col("hash")).alias("leaf"), hex_text(F.col("subroot")).alias("subroot"), hex_text(F.col("root")).alias("root"),
        F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), hex_text(F.col("again")).alias("folded_root"), (F.col("again") == F.col("root")).alias("verified"),
    )
