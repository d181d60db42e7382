"""Document fingerprints: bottom-k sketches of the hashes of word shingles.

A sketch is the sorted array of the k smallest distinct hashes of a document's shingles.  Sketches of
parts merge into the sketch of the whole, and two sketches estimate how alike their texts are.
Everything is built-in array functions within a row; only ``merge_sketches`` and
``with_next`` move data.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinisieve.llm.common import BLANKS, LAST_ID, fresh

K = 128
WIDTH = 5
_SPAN = 2.0 ** 64


def with_sketch(df: DataFrame, text: Column, into: str, k: int = K, width: int = WIDTH) -> DataFrame:
    """Add the sketch of a text as array<bigint>.

    Shingles are ``width`` neighbouring words; a shorter text is one shingle, a text that is null or
    has no word has an empty sketch.  Equal texts have equal sketches.  A column of that name is replaced.
    """
    columns = [F.col(f"`{c}`") for c in df.columns if c.lower() != into.lower()]
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    # Each step is a column of its own and used more than once, so that Spark works it out once per row.
    name = fresh(df, "words")
    hashed = df.select(*columns, F.transform(words, lambda w: F.xxhash64(w)).alias(name))
    w = F.col(name)
    rolled = F.transform(F.sequence(F.lit(0), F.size(w) - width),
                         lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(width)]))
    shingles = F.when(F.size(w) >= width, rolled).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
    return hashed.select(*columns, F.slice(F.sort_array(F.array_distinct(shingles)), 1, k).alias(into))


def merge_sketches(df: DataFrame, keys: list[str], column: str, k: int = K) -> DataFrame:
    """One sketch per key: the k smallest distinct hashes of all its parts' sketches.

    Hashes are made distinct and ranked per part of a key first, so that a key with most of the rows
    is merged in steps of bounded size.
    """
    part = F.pmod(F.xxhash64(column), F.lit(64))
    def merged(by: list[str], rows: DataFrame) -> DataFrame:
        hashes = rows.select(*by, F.explode_outer(column).alias("_h")).groupBy(*by, "_h").agg(F.lit(1).alias("_one"))
        ranked = hashes.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("_h").asc_nulls_last())))
        kept = F.sort_array(F.collect_list(F.when(F.col("_r") <= k, F.col("_h"))))
        return ranked.where(F.col("_r") <= k).groupBy(*by).agg(kept.alias(column))
    return merged(keys, merged([*keys, "_part"], df.withColumn("_part", part)))


def _smallest(a: Column, b: Column, k: int) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all; 1 for two empty sketches."""
    joint = _smallest(a, b, k)
    common = F.size(F.array_intersect(joint, F.array_intersect(a, b)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(common / F.size(joint))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact for sketches that are not full."""
    reach = (F.element_at(a, F.lit(k)).cast("double") + F.lit(_SPAN / 2)) / F.lit(_SPAN)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / reach)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    joint = _smallest(a, b, k)
    common = F.size(F.array_intersect(joint, F.array_intersect(a, b))) / F.size(joint)
    estimate = common * distinct_shingles(joint, k) / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), estimate))


def _bounds(ids: DataFrame, ranges: int) -> list[int]:
    """Ids at which ranges of about equally many rows begin; at most ``ranges`` numbers, and an id of many ranges as often."""
    found = ids.agg(F.min("place").alias("least"), F.percentile_approx(
        "place", [i / ranges for i in range(ranges)], F.lit(100 * ranges)).alias("cuts")).first()
    cuts = sorted(found["cuts"] or [])
    return cuts if not cuts or cuts[0] == found["least"] else [found["least"], *cuts]


def _range_of(place: Column, tie: Column, bounds: list[int]) -> Column:
    """The number of the range that holds an id, by bisection; rows of an id of many ranges are dealt to them by the order of their hashes."""
    array = F.array(*[F.lit(b).cast("bigint") for b in bounds])
    start = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        return F.when(at["high"] - at["low"] <= 1, at).when(
            F.get(array, middle) <= place, F.struct(middle.alias("low"), at["high"].alias("high"))).otherwise(
            F.struct(at["low"].alias("low"), middle.alias("high")))
    last = F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1)), start, halve, lambda at: at["low"])
    times = Counter(bounds)
    if len(times) == len(bounds):
        return last
    before = F.get(F.array(*[F.lit(times[b] - 1) for b in bounds]), last)
    share = F.floor((tie / F.lit(2.0**64) + 0.5) * (before + 1)).cast("int")
    return F.when(F.get(array, last) == place, last - before + F.least(share, before)).otherwise(last)


def with_next(docs: DataFrame, id_col: str, columns: list[str], per_range: int = 1024) -> DataFrame:
    """Add ``next_<c>`` for each column: its value in the row that follows by ascending id.

    The row after the last is the first one.  Null ids come last; rows of one id are ordered by the hash of
    the first of ``columns``, then by ``columns``.  Rows are dealt into ranges of ids of about equal size, at most ten for each shuffle partition; those of an
    id that fills several ranges, such as null, are dealt to them by their hashes, and only rows alike in both share one for sure.  The first rows of
    each range also visit the last range before it that has rows, so every row meets its follower without a sort in one task.
    """
    spark = docs.sparkSession
    place = F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(LAST_ID))
    ids = docs.select(place.alias("place"))
    rows = ids.count()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(ids, max(1, min(rows // per_range, 10 * partitions))) or [0]
    placed = docs.select(F.col(f"`{id_col}`").alias("_id"), place.alias("_place"), *[F.col(f"`{c}`") for c in columns])
    placed = placed.withColumn("_tie", F.xxhash64(F.col(f"`{columns[0]}`")))
    placed = placed.withColumn("_range", _range_of(F.col("_place"), F.col("_tie"), bounds))
    # A bound is an estimate, worked out in doubles, so it need not be an id; a range may even be empty.
    found = {r[0]: r[1] for r in placed.groupBy("_range").agg(F.min(F.struct("_place", "_tie"))).collect()}
    held = sorted(found)
    visits = {r: held[i - 1] for i, r in enumerate(held)}
    least, least_tie = (F.array(*[F.lit(found[i][n] if i in found else None).cast("bigint") for i in range(len(bounds))]) for n in (0, 1))
    earlier = F.array(*[F.lit(visits.get(i)).cast("int") for i in range(len(bounds))])
    here = F.struct(F.col("_range").alias("range"), F.lit(0).alias("guest"))
    before = F.struct(F.get(earlier, F.col("_range")).alias("range"), F.lit(1).alias("guest"))
    first = (F.get(least, F.col("_range")) == F.col("_place")) & (F.get(least_tie, F.col("_range")) == F.col("_tie"))
    seats = F.when(first, F.array(here, before)).otherwise(F.array(here))
    seated = placed.select("*", F.explode(seats).alias("_seat")).drop("_range")
    order = Window.partitionBy("_seat.range").orderBy("_seat.guest", "_place", "_tie", *[F.col(f"`{c}`") for c in columns])
    followed = seated.select("_id", "_seat", *columns, *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return followed.where("_seat.guest = 0").select(F.col("_id").alias(id_col), *columns, *[f"next_{c}" for c in columns])


def edited_fingerprints(docs: DataFrame, k: int = K, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text beside an edit of it: its last quarter gives way to the start of the next document.

    Returns id, n_chars, edited, fingerprint, edited_fingerprint and next_fingerprint.  Null texts
    count as empty; a table of one row is its own next.  Repeated ids are ordered by their texts.
    Other columns are not looked at, whatever their names.  An empty table gives an empty table.
    """
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    sketched = with_sketch(base, F.col("text"), "fingerprint", k, width)
    paired = with_next(sketched, "id", ["text", "fingerprint"])
    length = F.char_length("text")
    quarter = F.floor(length / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), length - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    paired = paired.select("id", length.cast("bigint").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    return with_sketch(paired, F.col("edited"), "edited_fingerprint", k, width).withColumnRenamed("id", id_col)
