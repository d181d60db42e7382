"""Fixity audits of web archives with Merkle trees.

The records of an archive file stand at byte offsets.  A leaf hashes, in order, the digests of the
records that begin in one range of ``RANGE`` bytes; a node hashes up to ``FANOUT`` ordered children,
file by file and then over files, up to one root.  Two replicas with equal roots are equal.  Else the trees are
walked down together: only the children of nodes that differ are compared, and only the records of
leaves that differ are looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinisieve.sources.scratch import written

RANGE = 1 << 20
FANOUT = 16
PER_FILE = 1024


def warc_records(pages: DataFrame, per_file: int = PER_FILE, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """(record_id, file, offset, n_bytes, digest, twin) of each page as a WARC response record.

    Pages with ids from n * per_file on share file n, in the order of their ids; a null id is in file
    -1.  Null urls and bodies count as empty.  Repeated records of one id are ordered by digest and
    numbered from 0 in ``twin``.  A file of very many repeated ids is one sort of its digests, not of its bodies.
    """
    url, body = F.coalesce(F.col(f"`{url_col}`"), F.lit("")), F.coalesce(F.col(f"`{body_col}`"), F.lit(""))
    page = F.col(f"`{id_col}`").cast("bigint")
    record = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))
    hashed = pages.select(page.alias("record_id"), F.coalesce(F.floor(page / per_file), F.lit(-1)).cast("bigint").alias("file"),
                          F.octet_length(record).cast("bigint").alias("n_bytes"), F.sha2(record, 256).alias("digest"))
    in_file = Window.partitionBy("file").orderBy("record_id", "digest")
    offset = F.sum("n_bytes").over(in_file.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_bytes")
    twin = F.row_number().over(Window.partitionBy("file", "record_id").orderBy("digest")) - 1
    return hashed.select("record_id", "file", offset.alias("offset"), "n_bytes", "digest", twin.cast("int").alias("twin"))


@dataclass
class Tree:
    """Records with their leaf number ``leaf``, and the levels from leaves (file, node, digest) to the root."""

    records: DataFrame
    levels: list[DataFrame]

    def root(self) -> str | None:
        found = self.levels[-1].first()
        return found["digest"] if found else None


def _parent(order: Column) -> Column:
    """The hash of ordered children."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col("digest")))), lambda x: x["digest"]), ""), 256)


def build(records: DataFrame, depth: tuple[int, int] | None = None, span: int = RANGE, fanout: int = FANOUT) -> Tree:
    """The tree of (record_id, file, offset, n_bytes, digest, twin).

    ``depth`` sets the numbers of levels within files and over files, so that two trees can be compared level by level; by
    default they follow from the highest range and file.  Every level is written, so that the audit
    reads what it needs again.  A node is one group of at most ``fanout`` rows; a leaf has the records that begin in ``span`` bytes.
    """
    records = written(records.withColumn("leaf", F.floor(F.col("offset") / span)))
    inside, over = depth or depth_of(records, fanout)
    level = records.groupBy("file", F.col("leaf").alias("node")).agg(
        _parent(F.struct("offset", "record_id", "twin").alias("order")).alias("digest"))
    levels = [written(level)]
    for _ in range(inside):
        level = levels[-1].groupBy("file", F.floor(F.col("node") / fanout).alias("node")).agg(_parent(F.col("node")).alias("digest"))
        levels.append(written(level))
    for _ in range(over):
        level = levels[-1].groupBy(F.floor(F.col("file") / fanout).alias("file"), "node").agg(_parent(F.col("file")).alias("digest"))
        levels.append(written(level))
    top = levels[-1].groupBy(F.lit(0).cast("bigint").alias("file"), F.lit(0).cast("bigint").alias("node")).agg(_parent(F.col("file")).alias("digest"))
    levels.append(written(top))
    return Tree(records, levels)


def depth_of(records: DataFrame, fanout: int = FANOUT) -> tuple[int, int]:
    """Levels until a file is one node, and until at most ``fanout`` + 1 nodes of files are left for the root."""
    most = records.agg(F.max("leaf").alias("leaf"), F.max("file").alias("file")).first()
    inside, over = 0, 0
    while (most["leaf"] or 0) // fanout ** inside:
        inside += 1
    while (most["file"] or 0) // fanout ** over >= fanout:
        over += 1
    return inside, over


def damaged_leaves(ours: Tree, theirs: Tree, fanout: int = FANOUT, depth: tuple[int, int] = (0, 0)) -> DataFrame:
    """(file, leaf) of the leaves that differ, found from the root down."""
    inside, over = depth
    suspects = None
    for i in range(len(ours.levels) - 1, -1, -1):
        mine, other = ours.levels[i], theirs.levels[i].withColumnRenamed("digest", "theirs")
        if suspects is not None:
            up = [F.lit(0).cast("bigint").alias("pf"), F.lit(0).cast("bigint").alias("pn")] if i == len(ours.levels) - 2 else \
                [F.floor(F.col("file") / fanout).alias("pf"), F.col("node").alias("pn")] if i >= inside else \
                [F.col("file").alias("pf"), F.floor(F.col("node") / fanout).alias("pn")]
            wanted = suspects.select(F.col("file").alias("pf"), F.col("node").alias("pn"))
            mine, other = (x.select("*", *up).join(wanted, ["pf", "pn"], "left_semi").drop("pf", "pn") for x in (mine, other))
        suspects = written(mine.join(other, ["file", "node"], "full").where("NOT (digest <=> theirs)").select("file", "node"))
        if suspects.isEmpty():
            break
    return suspects.select("file", F.col("node").alias("leaf"))


def audit(ours: DataFrame, theirs: DataFrame, span: int = RANGE, fanout: int = FANOUT) -> DataFrame:
    """(record_id, twin, file, offset, n_bytes, digest, state) of every record of two replicas, ours where there are both.

    ``state`` is ``intact``, ``changed`` (another digest), ``missing`` (theirs lacks it) or ``extra``.  A
    record that only moved because others before it changed in size is intact.  Only records in leaves
    that differ are compared.  Two empty tables give an empty table.
    """
    one = build(ours, None, span, fanout)
    high = one.records.select("leaf", "file").union(theirs.select(F.floor(F.col("offset") / span), "file"))
    depth = depth_of(high, fanout)
    if depth != depth_of(one.records, fanout):
        one = build(ours, depth, span, fanout)
    two = build(theirs, depth, span, fanout)
    leaves = damaged_leaves(one, two, fanout, depth)
    a, b = (t.records.join(leaves, ["file", "leaf"], "left_semi") for t in (one, two))
    key = ["file", "record_id", "twin"]
    both = a.alias("a").join(b.alias("b"), F.expr(" AND ".join(f"a.{c} <=> b.{c}" for c in key)), "full")
    state = (F.when(F.col("b.file").isNull(), "missing").when(F.col("a.file").isNull(), "extra")
             .when(F.col("a.digest") != F.col("b.digest"), "changed").otherwise("intact"))
    columns = ["record_id", "twin", "file", "offset", "n_bytes", "digest"]
    looked = both.select(*[F.when(F.col("a.file").isNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in columns], state.alias("state"))
    rest = one.records.join(leaves, ["file", "leaf"], "left_anti").select(*columns, F.lit("intact").alias("state"))
    return rest.unionByName(looked)
