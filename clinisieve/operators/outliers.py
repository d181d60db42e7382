"""Multivariate outliers with an isolation forest, trained and scored as Spark jobs.

The forest (Liu, Ting, Zhou: Isolation Forest, 2008) isolates rows by random splits; rows that
need few splits are outliers.  Each tree sees at most 256 rows, so a tree is trained in one small
task whatever the size of the data; scoring and the cut go over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinisieve.findings import ANOMALY, COLUMNS, finding_columns, source_text
from clinisieve.operators.features import FEATURES, evidence_list
from clinisieve.operators.joins import lookup_join
from clinisieve.operators.quantiles import exact_quantiles, grouped_quantile
from clinisieve.operators.rules import ROW_INDEX
from clinisieve.sources.scratch import written

# The model's parameters.
TREES, SAMPLE, SEED, CONTAMINATION, MIN_ROWS = 100, 256, 42, 0.05, 10
EULER = 0.5772156649015329
OVERSAMPLE = 4
COPIES_AT_ONCE = 1 << 16
#: Trees of a study that one task grows, and rows of a study that one task scores, on average.
BAND, PART = 10, 1 << 17

ROW_HASH = "_row_hash"
TREE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, length double"


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Expected path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    big = 2.0 * (np.log(np.maximum(n - 1.0, 1.0)) + EULER) - 2.0 * (n - 1.0) / np.maximum(n, 1.0)
    return np.where(n > 2, big, np.where(n == 2, 1.0, 0.0))


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit integers evenly (splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _salts() -> np.ndarray:
    """A number per tree, which its ranks of the rows hang on."""
    return _mix(np.arange(1, TREES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(SEED))


def imputed(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    """Each column with its nulls replaced by its median, or by 0 where it has no value at all."""
    medians = exact_quantiles(df, columns, 0.5)
    return {c: F.coalesce(F.col(c), F.lit(float(medians[c] if medians[c] is not None else 0.0)))
            for c in columns}


def _smallest(ranks: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` smallest ranks."""
    return np.argpartition(ranks, most)[:most] if len(ranks) > most else np.arange(len(ranks))


def _sample(df: DataFrame, columns: list[str], rows: int, sample: int = SAMPLE) -> DataFrame:
    """(tree, rank, features): per tree a few hundred rows chosen by hash.

    Equal rows are counted first, and the n-th of them has a hash of its values and n.  For each tree the rows with the smallest hashes are
    its sample, of which a batch gives ``sample`` at most.  The choice depends on the values of the features and the seed only: not on
    positions, which may repeat or lack, nor on the partitioning.
    """
    share = 1.0 if rows <= OVERSAMPLE * sample else OVERSAMPLE * sample / rows
    limit = np.uint64(min(share * 2.0 ** 64, 2.0 ** 64 - 2.0 ** 12))
    salts = _salts()

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes = batch[ROW_HASH].to_numpy().astype(np.int64).view(np.uint64)
            values, copies = batch[columns].to_numpy(dtype=float), batch["_copies"].to_numpy()
            ends = np.cumsum(copies)
            for start in range(0, int(ends[-1]) if len(ends) else 0, COPIES_AT_ONCE):
                number = np.arange(start, min(start + COPIES_AT_ONCE, int(ends[-1])))
                at = np.searchsorted(ends, number, side="right")
                nth = (number - (ends - copies)[at]).astype(np.uint64)
                own = _mix(hashes[at] + _mix(nth + np.uint64(1)))
                for tree, salt in enumerate(salts):
                    ranks = _mix(own ^ salt)
                    chosen = np.flatnonzero(ranks <= limit)
                    chosen = chosen[_smallest(ranks[chosen], sample)]
                    if len(chosen):
                        out = pd.DataFrame(values[at[chosen]], columns=columns)
                        out.insert(0, "tree", np.int32(tree))
                        out.insert(1, "rank", ranks[chosen].view(np.int64))
                        yield out

    schema = "tree int, rank bigint, " + ", ".join(f"`{c}` double" for c in columns)
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
    return counted.select(F.xxhash64(*columns).alias(ROW_HASH), *columns, "_copies").mapInPandas(candidates, schema)


def _grow(sample: np.ndarray, random: np.random.Generator) -> list[tuple]:
    """Split rows at random until they are alone, equal, or as deep as an average search."""
    deepest = int(np.ceil(np.log2(max(len(sample), 2))))
    nodes: list[list] = []
    waiting = [(np.arange(len(sample)), 0, -1, "")]
    while waiting:
        rows, depth, parent, side = waiting.pop()
        at = len(nodes)
        if parent >= 0:
            nodes[parent][3 if side == "left" else 4] = at
        low, high = sample[rows].min(axis=0), sample[rows].max(axis=0)
        open_columns = np.flatnonzero(high > low)
        if depth >= deepest or len(rows) <= 1 or len(open_columns) == 0:
            nodes.append([at, -1, 0.0, -1, -1, depth + float(average_path(len(rows)))])
            continue
        column = int(random.choice(open_columns))
        threshold = float(random.uniform(low[column], high[column]))
        nodes.append([at, column, threshold, -1, -1, 0.0])
        goes_left = sample[rows, column] <= threshold
        waiting.append((rows[~goes_left], depth + 1, at, "right"))
        waiting.append((rows[goes_left], depth + 1, at, "left"))
    return nodes


def train(df: DataFrame, columns: list[str], rows: int) -> pd.DataFrame:
    """The forest as a node table; at most 100 trees of 511 nodes reach the driver."""
    def one_tree(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        # Ranks were unsigned; the smallest 256 in that order are the sample.
        order = np.argsort(pdf["rank"].to_numpy().view(np.uint64), kind="stable")[:SAMPLE]
        nodes = _grow(pdf[columns].to_numpy(dtype=float)[order], np.random.default_rng([SEED, tree]))
        return pd.DataFrame([(tree, *n) for n in nodes],
                            columns=["tree", "node", "feature", "threshold", "left", "right", "length"])

    return (_sample(df, columns, rows).groupBy("tree").applyInPandas(one_tree, TREE_SCHEMA)
            .orderBy("tree", "node").toPandas())


def forest_score(forest: pd.DataFrame, rows: int, spark: SparkSession):
    """A function of the feature columns: near -1 for outliers, around -0.5 for ordinary rows."""
    trees = [
        (t["feature"].to_numpy(), t["threshold"].to_numpy(), t["left"].to_numpy(),
         t["right"].to_numpy(), t["length"].to_numpy())
        for _, t in forest.groupby("tree")]
    shared = spark.sparkContext.broadcast(trees)
    usual = float(average_path(min(rows, SAMPLE)))

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for series in parts:
            x = np.column_stack([s.to_numpy(dtype=float) for s in series])
            yield pd.Series(_scores(x, shared.value, usual))

    return score


def _scores(x: np.ndarray, trees: list[tuple[np.ndarray, ...]], usual: float) -> np.ndarray:
    """The scores of rows in a forest of (feature, threshold, left, right, length) per tree."""
    total = np.zeros(len(x))
    for feature, threshold, left, right, length in trees:
        node = np.zeros(len(x), dtype=np.int64)
        inner = np.arange(len(x)) if feature[0] >= 0 else np.arange(0)
        while len(inner):
            here = node[inner]
            goes_left = x[inner, feature[here]] <= threshold[here]
            node[inner] = np.where(goes_left, left[here], right[here])
            inner = inner[feature[node[inner]] >= 0]
        total += length[node]
    return -np.exp2(-(total / len(trees)) / usual)


def detect_outliers(df: DataFrame, contamination: float = CONTAMINATION) -> DataFrame:
    """Add ``score``, and ``anomaly``: 1 where the score is under the given quantile, else 0.

    ``df`` went through ``apply_ranges``; it is read several times, so it should be a stored table.
    Positions are not looked at.  Fewer than ten rows, or no feature, give 0
    throughout.  The scores are written to the shared folder and read from there.
    """
    columns = [f"{c}_num" for c in FEATURES if f"{c}_num" in df.columns]
    if not columns:
        return df.withColumn("anomaly", F.lit(0))
    rows = df.count()
    if rows < MIN_ROWS:
        return df.withColumn("anomaly", F.lit(0))
    inputs = imputed(df, columns)
    model = df.select(*[e.alias(c) for c, e in inputs.items()])
    forest = train(model, columns, rows)
    score = forest_score(forest, rows, df.sparkSession)
    scored = written(df.withColumn("score", score(*inputs.values())))
    cut = exact_quantiles(scored, ["score"], contamination)["score"]
    return scored.withColumn("anomaly", (F.col("score") < F.lit(cut)).cast("int"))


# --- many studies at once ---------------------------------------------------------------------------

STUDY = "_study"
_TREES = "feature array<int>, threshold array<double>, left array<int>, right array<int>, length array<double>"


def study_key(scope: tuple[str, ...]) -> Column:
    """A text per study that is never null."""
    return F.to_json(F.struct(*scope))


def _study_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """(study, a median per column): null where a study has no value."""
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in columns]))
    long = df.select(STUDY, values.alias("x")).select(STUDY, "x.name", "x.value")
    medians = grouped_quantile(long, [STUDY, "name"], "value", 0.5, "median")
    return medians.groupBy(STUDY).agg(*[F.max(F.when(F.col("name") == c, F.col("median"))).alias(f"_median_{c}") for c in columns])


def _study_samples(df: DataFrame, columns: list[str]) -> DataFrame:
    """(study, band, hash, features): the rows that some tree of a band may sample, each once per band.

    The choice is that of a study by itself; rows of other studies do not matter.
    """
    salts = _salts().reshape(-1, BAND)

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes = batch[ROW_HASH].to_numpy().astype(np.int64).view(np.uint64)
            share = np.minimum(1.0, OVERSAMPLE * SAMPLE / batch["_rows"].to_numpy(dtype=float))
            limits = np.minimum(share * 2.0 ** 64, 2.0 ** 64 - 2.0 ** 12).astype(np.uint64)
            copies = batch["_copies"].to_numpy()
            ends = np.cumsum(copies)
            for start in range(0, int(ends[-1]) if len(ends) else 0, COPIES_AT_ONCE):
                number = np.arange(start, min(start + COPIES_AT_ONCE, int(ends[-1])))
                at = np.searchsorted(ends, number, side="right")
                own = _mix(hashes[at] + _mix((number - (ends - copies)[at]).astype(np.uint64) + np.uint64(1)))
                for band, band_salts in enumerate(salts):
                    chosen = np.flatnonzero((_mix(own[:, None] ^ band_salts) <= limits[at][:, None]).any(axis=1))
                    out = batch[[STUDY, *columns]].iloc[at[chosen]].reset_index(drop=True)
                    out.insert(1, "band", np.int32(band))
                    out.insert(2, "own", own[chosen].view(np.int64))
                    yield out

    schema = f"{STUDY} string, band int, own bigint, " + ", ".join(f"`{c}` double" for c in columns)
    counted = df.groupBy(STUDY, "_rows", *columns).agg(F.count(F.lit(1)).alias("_copies"))
    return counted.select(STUDY, "_rows", F.xxhash64(*columns).alias(ROW_HASH), *columns, "_copies").mapInPandas(candidates, schema)


def study_forests(df: DataFrame, columns: list[str]) -> DataFrame:
    """(study, tree, arrays of its nodes), a row per tree, grown in one task per study and band of trees."""
    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own, values = pdf["own"].to_numpy().view(np.uint64), pdf[columns].to_numpy(dtype=float)
        salts, out = _salts(), []
        for tree in range(int(key[1]) * BAND, (int(key[1]) + 1) * BAND):
            ranks = _mix(own ^ salts[tree])
            nearest = _smallest(ranks, SAMPLE)
            nodes = _grow(values[nearest[np.argsort(ranks[nearest], kind="stable")]], np.random.default_rng([SEED, tree]))
            out.append((key[0], tree, *(list(c) for c in list(zip(*nodes, strict=True))[1:])))
        return pd.DataFrame(out, columns=[STUDY, "tree", "feature", "threshold", "left", "right", "length"])

    return _study_samples(df, columns).groupBy(STUDY, "band").applyInPandas(grow, f"{STUDY} string, tree int, {_TREES}")


def _study_scores(df: DataFrame, forests: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``score``; a large study is split into parts, each of which gets the study's forest."""
    def score(rows: pa.Table, trees: pa.Table) -> pa.Table:
        if rows.num_rows and trees.num_rows:
            arrays = [[np.asarray(v) for v in trees.column(f"own_{c}").to_pylist()] for c in ("feature", "threshold", "left", "right", "length")]
            x = np.column_stack([rows.column(c).to_numpy() for c in columns])
            usual = float(average_path(min(rows.column("_rows")[0].as_py(), SAMPLE)))
            # In the order of the trees, so that sums of equal rows do not differ between parts.
            order = np.argsort(trees.column("tree").to_numpy(), kind="stable")
            scores = pa.array(_scores(x, [tuple(a[i] for a in arrays) for i in order], usual), pa.float64())
        else:
            scores = pa.nulls(rows.num_rows, pa.float64())
        return rows.append_column("score", scores)

    parts = F.ceil(F.col("_rows") / F.lit(PART)).cast("int")
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), parts).cast("int")
    left = df.withColumn("_part", place)
    studies = df.groupBy(STUDY).agg(F.first(parts).alias("parts")).withColumnRenamed(STUDY, "study")
    right = lookup_join(forests.select(F.col(STUDY).alias("study"), "tree", *[
        F.col(c).alias(f"own_{c}") for c in ("feature", "threshold", "left", "right", "length")]), studies, ["study"], "inner")
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    schema = T.StructType([*left.schema.fields, T.StructField("score", T.DoubleType())])
    return left.groupBy(STUDY, "_part").cogroup(right.groupBy("study", "part")).applyInArrow(score, schema).drop("_part")


def detect_study_outliers(df: DataFrame, scope: tuple[str, ...], contamination: float = CONTAMINATION) -> DataFrame:
    """As :func:`detect_outliers`, for each study that ``scope`` names by itself: its own medians, forest and cut.

    Every step is one job over all studies.  A study's forest is rows of a table that its rows are
    joined to in parts of bounded size, so neither many studies nor a very large one gathers in one place.
    Null study columns are a study too.
    """
    columns = [f"{c}_num" for c in FEATURES if f"{c}_num" in df.columns]
    if not columns:
        return df.withColumn("anomaly", F.lit(0))
    keyed = df.withColumn(STUDY, study_key(scope))
    sizes = keyed.groupBy(STUDY).agg(F.count(F.lit(1)).alias("_rows"))
    known = lookup_join(lookup_join(keyed, sizes, [STUDY], "inner"), _study_medians(keyed, columns), [STUDY], "left")
    inputs = [f"_input_{c}" for c in columns]
    filled = [F.coalesce(F.col(c), F.col(f"_median_{c}"), F.lit(0.0)).alias(i) for c, i in zip(columns, inputs, strict=True)]
    stored = written(known.select(*df.columns, STUDY, "_rows", *filled))
    forests = written(study_forests(stored.where(F.col("_rows") >= MIN_ROWS), inputs))
    scored = written(_study_scores(stored, forests, inputs))
    cuts = grouped_quantile(scored, [STUDY], "score", contamination, "_cut")
    flagged = lookup_join(scored, cuts, [STUDY], "left")
    return flagged.select(*df.columns, "score", F.coalesce(F.col("score") < F.col("_cut"), F.lit(False)).cast("int").alias("anomaly"))


def outlier_findings(flagged: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """One LOW finding per outlier, naming the features of its row."""
    usubjid = source_text(F.col("USUBJID")) if "USUBJID" in flagged.columns else F.lit("")
    outliers = flagged.filter("anomaly = 1").withColumn("_evidence", evidence_list(flagged))
    message = "Statistical outlier detected by IsolationForest."
    return outliers.select(*scope, *finding_columns(
        finding_type=ANOMALY, rule_id="ANOMALY_001", severity="LOW", domain="GENERAL",
        field="multivariate",
        message=F.when(F.col("_evidence") == "", F.lit(message)).otherwise(
            F.concat(F.lit(f"{message} (found: "), F.col("_evidence"), F.lit(")"))),
        row_index=F.col(ROW_INDEX) if ROW_INDEX in flagged.columns else F.lit(None), usubjid=usubjid, evidence=F.col("_evidence"),
    )).select(*scope, *COLUMNS)
