"""A Merkle manifest of a dataset: a tree over each group's rows, a tree over the groups, and every row's proof.

The rows of a group stand in a dense order.  At level l the first row of a node's stretch of
``fanout ** l`` rows holds its digest, so the siblings of a node stand at fixed offsets: lag and lead columns
by multiples of that stretch fetch them, masked by the node's slot among its siblings and by the length of
the last run.  First rows of first children hash the parents, and every row looks back to the
last first row for the siblings of its own ancestor.

Stretches of ``fanout ** STEPS`` rows are windows of their own, so a group of any size is spread over
many tasks; their roots are the rows of a next, as much shorter round.  Positions come from a range sort:
the number within a sorted partition plus the rows of the partitions before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinisieve.sources.scratch import written

#: Levels within one window; a window has ``fanout ** STEPS`` rows.
STEPS = 10
#: The columns of a document that its leaf covers, in order.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(*inputs: Column) -> Column:
    return F.sha2(F.concat(*inputs), 256)


def leaf_digest(values: list[Column]) -> Column:
    """The digest of a row: each value as ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return sha(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts])


def group_key(group: Column) -> Column:
    """A text that is never null and sorts null first, then by UTF-8 bytes."""
    return F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group.cast("string")))


def positioned(df: DataFrame, order: list[Column]) -> DataFrame:
    """Add ``index``, the dense position of a row in its group ``g``, and ``total``, the rows of the group.

    ``order`` with the group must be a key, or ties put to chance; a unique last column lets equal rows spread over tasks.
    """
    spread = df.repartitionByRange(F.col("g"), *order).sortWithinPartitions(F.col("g"), *order)
    placed = written(spread.withColumn("at", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("at", 33))
    counts = placed.groupBy("g", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("g")
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("g", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
                           F.sum("n").over(group).alias("total"))
    return placed.join(starts, ["g", "part"]).withColumn("index", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def climbed(nodes: DataFrame, fanout: int, steps: int) -> DataFrame:
    """``steps`` levels up: add ``block``, ``path`` (left and right siblings of each level) and, on the first row of a block, ``top``.

    ``nodes`` has g, index, total and digest.  A level where a group is down to one node adds nothing.
    All levels are one statement over windows of one order, so rows are shuffled and sorted once.
    """
    size, order = fanout ** steps, "PARTITION BY g, block ORDER BY index"
    query = f"SELECT *, index DIV {size} AS block, index % {size} AS slot, digest AS top FROM {{nodes}}"
    for level in range(steps):
        stretch, offsets = fanout ** level, range(1, fanout)
        first, own = f"slot % {stretch} = 0 AND total > {stretch}", f"slot DIV {stretch} % {fanout}"
        near = [f"lag(top, {k * stretch}) OVER ({order}) AS lag{k}, lead(top, {k * stretch}) OVER ({order}) AS lead{k}" for k in offsets]
        left = [f"CASE WHEN {own} >= {k} THEN lag{k} ELSE '' END" for k in reversed(offsets)]
        right = [f"CASE WHEN {own} + {k} < {fanout} THEN coalesce(lead{k}, '') ELSE '' END" for k in offsets]
        drop = ", ".join(f"lag{k}, lead{k}" for k in offsets)
        query = f"""
            SELECT * EXCEPT (top, beside_left, beside_right),
                   last(beside_left, true) OVER ({order} ROWS UNBOUNDED PRECEDING) AS left{level},
                   last(beside_right, true) OVER ({order} ROWS UNBOUNDED PRECEDING) AS right{level},
                   CASE WHEN slot % {stretch * fanout} > 0 THEN NULL
                        WHEN total > {stretch} THEN sha2(concat(top, beside_right), 256) ELSE top END AS top
            FROM (SELECT * EXCEPT ({drop}), CASE WHEN {first} THEN concat({", ".join(left)}) END AS beside_left,
                         CASE WHEN {first} THEN concat({", ".join(right)}) END AS beside_right
                  FROM (SELECT *, {", ".join(near)} FROM ({query})))"""
    levels = [f"CASE WHEN total > {fanout ** i} THEN struct(left{i} AS left, right{i} AS right) END" for i in range(steps)]
    spent = ", ".join(f"left{i}, right{i}" for i in range(steps))
    return nodes.sparkSession.sql(
        f"SELECT * EXCEPT (slot, {spent}), array_compact(array({', '.join(levels)})) AS path FROM ({query})", nodes=nodes)


def trees(nodes: DataFrame, fanout: int, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with their whole ``path``, (g, root) of every group) of positioned rows with a ``digest``.

    ``most`` is the size of the largest group, if it is known.
    """
    if most is None:
        most = nodes.agg(F.max("total")).first()[0] or 0
    if most <= 1:
        empty = F.array().cast("array<struct<left:string,right:string>>")
        return nodes.withColumn("path", empty), nodes.select("g", F.col("digest").alias("root"))
    steps = STEPS
    while fanout ** (steps - 1) >= most:  # no level that no group has
        steps -= 1
    # The windows are read twice: for the blocks' roots, and for the rows' paths.
    here, size = written(climbed(nodes, fanout, steps)), fanout ** steps
    blocks = here.where("top IS NOT NULL").select(
        "g", F.col("block").alias("index"), F.ceil(F.col("total") / size).alias("total"), F.col("top").alias("digest"))
    above, roots = trees(blocks, fanout, -(-most // size))
    rest = above.select("g", F.col("index").alias("block"), F.col("path").alias("rest"))
    joined = here.drop("top").join(rest, ["g", "block"]).withColumn("path", F.concat("path", "rest"))
    return joined.drop("block", "rest"), roots


def proof_digest(path: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to with these siblings."""
    return F.aggregate(path, leaf, lambda at, p: sha(p["left"], at, p["right"]))


def manifest(df: DataFrame, group: str = "lang", order: str = "doc_id", columns: tuple[str, ...] = LEAF_COLUMNS,
             tampered: dict[str, Column] | None = None, fanout: int = 2) -> DataFrame:
    """(order column, leaf, tampered_leaf, subroot, root, path) of every row.

    A leaf covers ``columns``; a group's leaves ascend by the order column, null last, equal ones by their leaf.
    ``fanout`` consecutive nodes have one parent, the last run may be shorter; a lone node is the
    group's subroot.  Subroots by group (null first, then UTF-8 bytewise) form the tree of the root in
    the same way.  ``path`` has the left and right siblings, level by level to the root.
    ``tampered`` replaces columns for ``tampered_leaf``.  Rows equal in all columns have equal leaves and
    stand in places of their own, in any order; null and empty texts differ.  Other columns are not looked at, whatever
    their names.  An empty table gives an empty table.
    """
    values = {c: F.col(f"`{c}`") for c in columns}
    changed = values | (tampered or {})
    leaves = written(df.select(
        group_key(F.col(f"`{group}`")).alias("g"), F.col(f"`{order}`").alias("id"), leaf_digest([*values.values()]).alias("digest"),
        leaf_digest([*changed.values()]).alias("tampered"), F.monotonically_increasing_id().alias("row")))
    rows, subroots = trees(positioned(leaves, [F.col("id").asc_nulls_last(), F.col("digest"), F.col("row")]), fanout)
    # The tree of the groups is a group by itself, ordered by the groups' keys.
    tops = written(subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("root").alias("digest")))
    groups, roots = trees(positioned(tops, [F.col("name")]), fanout)
    above = groups.join(roots, "g").select(F.col("name").alias("g"), F.col("digest").alias("subroot"), "root", F.col("path").alias("rest"))
    found = rows.join(above, "g")
    return found.select(F.col("id").alias(order), F.col("digest").alias("leaf"), F.col("tampered").alias("tampered_leaf"),
                        "subroot", "root", F.concat("path", "rest").alias("path"))
