"""Mixing sources to target weights, by prefix sums over hash-random orders.

Every document gets a random key from a hash of its id.  Within its source it falls into one of so
many equal ranges of keys that a range holds about ``PER_RANGE`` documents, or fewer if they have over
``WORDS_PER_RANGE`` words; ranges are summed up, their sums accumulated per source, and documents accumulated within their range.  So each document
knows how many words stand before it in its source, and a source is cut at the exact word where its
budget ends, after as many whole epochs as the budget holds.  A hot source is many ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinisieve.llm.common import WORD
from clinisieve.sources.scratch import written

PER_RANGE = 2048
WORDS_PER_RANGE = 1 << 21
_KEY_BITS = 60


def word_count(text: Column) -> Column:
    """Words of a text; 0 if it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Add ``number``, ``weight`` and ``target`` to (source, source_size, n), one row per source.

    Sources are numbered by code point, null last, and take the weights in turn.  ``share`` times all
    words is dealt by weight; no source gets over ``most`` times its words, and what it cannot take
    is dealt to the others.  With sources by ascending limit per weight, the level of a source is what
    the limits before it leave for each unit of weight from there on; the first level within its own
    source's limit holds, and as later ones are lower, it is the highest of those.  ``share`` may not exceed ``most``.  Only this table of one
    row per source is ordered as a whole.
    """
    if not 0 <= share <= most:
        raise ValueError("the share must lie between 0 and the most that a source can give")
    ranked = sources.withColumn("number", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("number") - 1, F.lit(len(weights))) + 1)
    limited = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    limited = limited.withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", "number")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levelled = limited.withColumn("level", level)
    levelled = levelled.withColumn("level", F.coalesce(
        F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything), F.max("ratio").over(everything)))
    return levelled.select("source", "source_size", "n", "number", "weight",
                           F.least(F.col("level") * F.col("weight"), F.col("cap")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix",
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", rows: bool = False) -> DataFrame:
    """(id, size, source_size, target, taken) of every row, and with ``rows`` the row itself as struct ``row``.

    ``size`` is the number of words, 0 for null or empty texts; a null source is a source of its own;
    rows with a null id are keyed by their texts.  ``taken`` is the words that the mix takes: size for each whole epoch,
    plus what the last, partial one reaches.  The words taken of a source sum up to its target,
    rounded down.  The order within a source hangs on ids, for null ids on texts, and the seed alone, ties are ordered by the
    texts' hash, and rows alike in both are interchangeable; so reruns agree.  Other columns are not
    looked at, whatever their names.  An empty table gives an empty table.
    """
    text = F.col(f"`{text_col}`")
    size = word_count(text)
    # Any number of ids may be null.  Rows without words take none wherever they stand, so their keys may be any.
    instead = F.concat(F.lit(":"), F.when(size > 0, F.xxhash64(text)).otherwise(F.monotonically_increasing_id()).cast("string"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), instead)), 256)
    key = F.conv(F.substring(digest, 1, _KEY_BITS // 4), 16, 10).cast("bigint")
    base = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), size.alias("size"),
        key.alias("key"), F.xxhash64(text).alias("tie"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if rows else []))
    base = written(base)
    sources = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    targets = written(source_targets(sources, weights, share, most).withColumnRenamed("source", "name"))
    ranges = F.greatest(F.ceil(F.col("n") / PER_RANGE), F.ceil(F.col("source_size") / WORDS_PER_RANGE))
    in_range = F.floor(F.col("key") / F.lit(float(1 << _KEY_BITS)) * ranges)
    ranged = base.join(targets, F.col("source").eqNullSafe(F.col("name"))).withColumn("range", in_range)
    sums = ranged.groupBy("number", "range").agg(F.sum("size").alias("range_size"))
    before = Window.partitionBy("number").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("number", "range", F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("number", "range").orderBy("key", "id", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.col("offset") + F.sum("size").over(inside) - F.col("size")
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    placed = ranged.join(offsets, ["number", "range"]).withColumn("start", start).withColumn("epochs", epochs)
    rest = budget - F.col("epochs") * F.col("source_size")
    taken = F.col("epochs") * F.col("size") + F.least(F.greatest(rest - F.col("start"), F.lit(0)), F.col("size"))
    return placed.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("bigint").alias("taken"),
                         *(["row"] if rows else []))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself, with the columns of ``docs``: a row once for each whole epoch that takes it.

    A row that the cut falls into comes once more with its first words only (text and, if there is
    one, ``n_chars``).  Rows without words are in no epoch's budget; they stay with the whole epochs, at least once if
    their source takes anything.
    """
    text_col = options.get("text_col", "text")
    found = mix(docs, rows=True, **options)
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(
        F.when(F.col("target") > 0, F.greatest(F.lit(1), F.floor(F.col("target") / F.col("source_size")))).otherwise(0)).cast("int")
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0).cast("int")
    copies = F.concat(F.array_repeat(F.lit(-1), whole), F.when(part > 0, F.array(part)).otherwise(F.array()))
    dealt = found.select("row", F.explode(copies).alias("cut"))
    words = F.split(F.col(f"row.`{text_col}`"), "(?<=[^\\x20\\x09-\\x0D])(?=[\\x20\\x09-\\x0D])", F.col("cut") + 1)
    head = F.when(F.col("cut") < 0, F.col(f"row.`{text_col}`")).otherwise(F.array_join(F.slice(words, 1, F.greatest(F.col("cut"), F.lit(1))), ""))
    cut = dealt.select("row", "cut", head.alias("head"))
    changed = [F.col("head").alias(c) if c == text_col else
               F.when(F.col("cut") < 0, F.col("row.n_chars")).otherwise(F.char_length("head")).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else
               F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return cut.select(*changed)
