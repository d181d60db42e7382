from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clinisieve.operators import features, outliers
from clinisieve.operators.quantiles import exact_quantiles, grouped_quantile
from clinisieve.plans import pipeline
from clinisieve.sources.scratch import written


def test_feature_frame(table):
    frames = {
        "DM": table("USUBJID AGE", [("S1", "30"), ("S2", "40"), ("S1", "31"), (None, "5"), (" S1", "x")]),
        "VS": table("USUBJID VSTESTCD VSORRES VSDTC", [
            ("S1", "SYSBP", "120", "2024-02-01"), ("S1", "SYSBP", "130", "UNK"), ("S1", "DIABP", "80", "2024-1-1"),
            ("S1", " SYSBP", "999", "2024-01-31"), ("S2", "SYSBP", "120,5", None), (None, "SYSBP", "1", "2000-01-01")]),
        "EX": table("USUBJID EXDOSE", [("S1", "100"), ("S1", "200"), ("S2", "high")]),
        "LB": table("USUBJID LBTESTCD LBORRES", [("S1", "ALT", "42"), ("S2", "CREAT", "1")]),
        "EG": table("USUBJID EGTESTCD EGORRES", [("S1", "QTCF", "410"), ("S1", "QT", "400"), ("S1", "HR", "72")]),
        "QS": table("USUBJID QSSTRESN", [("S1", "1"), ("S1", "3")]),
        "PR": table("USUBJID", [("S1",), ("S1",), ("S1",)]),
    }
    got = {r.row_index: tuple(r)[1:] for r in features.feature_frame(frames).collect()}
    full = (125.0, "2024-02-01", 150.0, 42.0, 405.0, 2.0, 3.0)
    # As texts "2024-01-31" is before "2024-02-01"; the unpadded date and UNK come later.
    full = (125.0, "2024-01-31", *full[2:])
    none = (None, None, None, None, None, None, 0.0)
    assert got == {0: ("S1", 30.0, *full), 1: ("S2", 40.0, *none), 2: ("S1", 31.0, *full), 3: (None, 5.0, *none),
                   4: (" S1", None, *none)}


def test_missing_domains_leave_required_features_null(table):
    frame = features.feature_frame({"DM": table("USUBJID AGE", [("S1", "30")])})
    assert set(frame.columns) == {"row_index", "USUBJID", "AGE", "SYSBP", "VSDTC", "DOSE"}
    assert frame.select("SYSBP", "DOSE", "VSDTC").first() == (None, None, None)


def test_ranges_are_inclusive_and_null_is_invalid(table):
    df = table("AGE SYSBP DOSE VSDTC", [
        ("17", "89", "0", "x"), ("18", "90", "-1", None), ("120", "180", "50", "x"), ("121", "181", "0.001", "x"),
        (None, "abc", None, "x")])
    flags = features.apply_ranges(df).orderBy("row_index").select("AGE_valid", "SYSBP_valid", "DOSE_valid", "date_valid")
    assert [tuple(r) for r in flags.collect()] == [(0, 0, 0, 1), (1, 1, 0, 0), (1, 1, 1, 1), (0, 0, 1, 1), (0, 0, 0, 1)]


def test_the_flat_file_of_the_fixtures(table):
    rows = [("45", "125.7", "2025-01-01", "100.0"), ("150", "90.0", "2025-01-15", "0.0"), ("38", None, "2025-02-26", "100.0"),
            ("55", "122.8", "2025-04-16", None), ("27", "250.0", "2025-05-14", "150.0")]
    found = pipeline.validate_generic(table("AGE SYSBP VSDTC DOSE", rows), outliers=False).collect()
    assert sorted((r.rule_id, r.row_index, r.evidence) for r in found) == [
        ("GENERIC_AGE_001", 1, "150"), ("GENERIC_DOSE_001", 1, "0.0"), ("GENERIC_DOSE_001", 3, ""),
        ("GENERIC_SYSBP_001", 2, ""), ("GENERIC_SYSBP_001", 4, "250.0")]
    assert {r.message for r in found if r.evidence == "150"} == {"AGE failed validation rule. (found: '150')"}


def test_spelling_depends_on_the_whole_column(table):
    vs = table("USUBJID VSTESTCD VSORRES", [("S1", "SYSBP", "200")])
    for ages, expected in ((["150", "30"], "150"), (["150", None], "150.0")):
        dm = table("USUBJID AGE", [(f"S{i}", a) for i, a in enumerate(ages)])
        found = features.range_findings(features.flagged_features({"DM": dm, "VS": vs}))
        assert [r.evidence for r in found.filter("rule_id = 'GENERIC_AGE_001' AND row_index = 0").collect()] == [expected]


def test_quantiles_are_exact_beyond_the_small_case(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(50, 10, 6000), np.full(3000, 42.0)])
    df = spark.createDataFrame([(float(a), None if i % 3 == 0 else float(i)) for i, a in enumerate(values)],
                               "a double, b double").repartition(4)
    b = [float(i) for i in range(len(values)) if i % 3]
    for q in (0.05, 0.5, 0.99):
        got = exact_quantiles(df, ["a", "b"], q, small=0, accuracy=100)
        assert got["a"] == pytest.approx(np.percentile(values, 100 * q), abs=1e-12)
        assert got["b"] == pytest.approx(np.percentile(b, 100 * q), abs=1e-9)
    assert exact_quantiles(df.withColumn("n", F.lit(None).cast("double")), ["n"], 0.5) == {"n": None}


def test_grouped_quantiles_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [("big", float(x)) for x in rng.normal(0, 1, 5000)] + [("big", 1.0)] * 2000 + [
        ("small", float(x)) for x in range(7)] + [("one", 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(4)
    for q in (0.01, 0.5, 0.99):
        got = {r.k: r.p for r in grouped_quantile(df, ["k"], "x", q, "p", accuracy=100).collect()}
        for k in ("big", "small", "one"):
            assert got[k] == pytest.approx(np.percentile([x for g, x in rows if g == k], 100 * q), abs=1e-12)
        assert "none" not in got


# --- outliers -------------------------------------------------------------------------------------

def cohort(spark, n, planted=()):
    rows = [(i, float(40 + i % 5), float(120 + i % 4), 100.0) for i in range(n)]
    for i, values in planted:
        rows[i] = (i, *values)
    return features.apply_ranges(spark.createDataFrame(rows, "row_index bigint, AGE double, SYSBP double, DOSE double"))


def flags(df):
    return [r.anomaly for r in outliers.detect_outliers(df).orderBy("row_index").collect()]


def test_few_rows_or_no_features_give_no_outliers(spark):
    assert flags(cohort(spark, 9, [(0, (400.0, 900.0, -500.0))])) == [0] * 9
    plain = spark.createDataFrame([(i, "A") for i in range(15)], "row_index bigint, CONDITION string")
    assert flags(features.apply_ranges(plain)) == [0] * 15


def test_an_extreme_row_is_found_whatever_the_partitioning(spark):
    df = cohort(spark, 30, [(5, (400.0, 900.0, -500.0))])
    first, again = flags(df), flags(df.repartition(7))
    assert first == again and first[5] == 1 and len(first) == 30


def test_missing_values_are_replaced_not_dropped(spark):
    df = cohort(spark, 15, [(3, (None, 121.0, 100.0))])
    assert len(flags(df)) == 15
    frame = spark.createDataFrame([(1.0, None), (3.0, None), (None, None)], "a double, b double")
    filled = outliers.imputed(frame, ["a", "b"])
    assert [tuple(r) for r in frame.select(*[e.alias(c) for c, e in filled.items()]).collect()] == [
        (1.0, 0.0), (3.0, 0.0), (2.0, 0.0)]


@pytest.mark.parametrize("positions", ["row_index", "row_index % 3", "CAST(NULL AS BIGINT)", None])
def test_flags_do_not_hang_on_positions(spark, positions):
    """Repeated, null and missing positions, repeated rows, and any partitioning give the flags of numbered rows."""
    rng = np.random.default_rng(5)
    rows = [(i, float(a), float(b), 50.0) for i, (a, b) in enumerate(rng.normal((45, 125), (15, 12), (700, 2)))]
    rows += [(700 + i, 45.0, 125.0, 50.0) for i in range(1300)]  # most rows are alike
    given = spark.createDataFrame(rows, "row_index bigint, AGE double, SYSBP double, DOSE double")
    def run(df):
        out = outliers.detect_outliers(written(features.apply_ranges(df)))
        return sorted((r.AGE_num, r.SYSBP_num, r.anomaly) for r in out.collect())
    other = given.drop("row_index") if positions is None else given.withColumn("row_index", F.expr(positions))
    assert run(given) == run(other.repartition(9))


def test_a_tree_gets_a_bounded_sample(spark):
    given = spark.range(0, 30_000, 1, 6).select((F.col("id") % 2).cast("double").alias("a"))
    per_tree = outliers._sample(given, ["a"], 30_000).groupBy("tree").count().collect()
    assert len(per_tree) == outliers.TREES and all(outliers.SAMPLE <= r["count"] <= 4 * 256 + 300 for r in per_tree)


def test_each_study_of_a_job_has_its_own_outliers(spark):
    rng = np.random.default_rng(6)
    rows = [(i, f"ST{i % 3}", f"S{i // 3}", str(round(float(rng.normal(40 + 100 * (i % 3 == 1), 3)), 1))) for i in range(180)]
    rows[17] = (17, "ST2", "S5", "90")
    dm = spark.createDataFrame([(i, s, u, "M", a, "2020-01-01") for i, s, u, a in rows],
                               "row_index bigint, STUDYID string, USUBJID string, SEX string, AGE string, RFSTDTC string")
    found = pipeline.validate_job({"DM": dm}, ("STUDYID",)).filter("rule_id = 'ANOMALY_001'").collect()
    per_study = Counter(r.STUDYID for r in found)
    alone = {s: {r.row_index for r in pipeline.validate_all({"DM": dm.filter(F.col("STUDYID") == s)}).filter("rule_id = 'ANOMALY_001'").collect()} for s in per_study}
    assert set(per_study) == {"ST0", "ST1", "ST2"} and {s: {r.row_index for r in found if r.STUDYID == s} for s in per_study} == alone
    assert 17 in alone["ST2"]


def _studies(spark, sizes, seed=11):
    """Rows of many studies, each with one far-off subject at its end."""
    rng = np.random.default_rng(seed)
    rows = []
    for study, n in sizes.items():
        for i in range(n):
            far = 5000.0 if i == n - 1 else 0.0
            rows.append((len(rows), study, float(rng.normal(45, 15)) if i % 7 else None, float(rng.normal(125, 12)) + far, float(rng.choice([0, 50, 100]))))
    return written(features.apply_ranges(spark.createDataFrame(rows, "row_index bigint, STUDYID string, AGE double, SYSBP double, DOSE double").repartition(3)))


def test_grouped_forests_equal_a_forest_per_study(spark, monkeypatch):
    monkeypatch.setattr(outliers, "PART", 150)  # the large study is scored in several parts
    df = _studies(spark, {"A": 700, "B": 9, None: 40, "D": 10, "E": 1})
    found = outliers.detect_study_outliers(df, ("STUDYID",))
    assert found.columns == [*df.columns, "score", "anomaly"]
    rows = found.collect()
    assert len(rows) == 760
    for study in ("A", "B", None, "D", "E"):
        own = outliers.detect_outliers(written(df.where(F.col("STUDYID").eqNullSafe(F.lit(study)))))
        assert {r.row_index for r in own.where("anomaly = 1").collect()} == {r.row_index for r in rows if r.STUDYID == study and r.anomaly}
    assert {r.STUDYID for r in rows if r.anomaly} == {"A", None, "D"}


def test_studies_without_values_and_without_rows(spark):
    df = features.apply_ranges(spark.createDataFrame([(i, f"S{i % 2}", None, None) for i in range(40)], "row_index bigint, STUDYID string, AGE double, SYSBP double"))
    assert {r.anomaly for r in outliers.detect_study_outliers(df, ("STUDYID",)).collect()} == {0}
    assert outliers.detect_study_outliers(df.where("false"), ("STUDYID",)).collect() == []
    assert outliers.detect_study_outliers(df.drop("AGE", "AGE_num", "SYSBP", "SYSBP_num"), ("STUDYID",)).where("anomaly = 1").isEmpty()


def test_the_number_of_jobs_does_not_depend_on_the_studies(spark):
    def jobs(studies):
        df = _studies(spark, {f"S{i}": 12 for i in range(studies)})
        spark.sparkContext.setJobGroup(f"studies-{studies}", "")
        try:
            outliers.detect_study_outliers(df, ("STUDYID",)).count()
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"studies-{studies}"))
    assert abs(jobs(2) - jobs(40)) <= 2  # stages that adaptive execution may or may not merge


def test_precision_recall_and_share_on_a_planted_cohort(spark):
    """300 subjects, three features, 5 % planted outliers: about 90 % precision and recall."""
    rng = np.random.default_rng(7)
    rows = [(i, float(rng.normal(45, 15)), float(rng.normal(125, 12)), float(rng.choice([0, 50, 100, 150])))
            for i in range(300)]
    planted = set(rng.choice(300, 15, replace=False).tolist())
    for i in planted:
        rows[i] = (i, float(rng.choice([-20, 150, 200])), float(rng.choice([20, 260, 300])), float(rng.choice([900, 2000])))
    df = written(features.apply_ranges(
        spark.createDataFrame(rows, "row_index bigint, AGE double, SYSBP double, DOSE double")))
    found = {r.row_index for r in outliers.detect_outliers(df).filter("anomaly = 1").collect()}
    assert len(found) == 15  # ceil(0.05 * 299)
    assert len(found & planted) >= 14


def test_outlier_findings(spark):
    df = spark.createDataFrame([(0, "S1", 400, 900.5, None, 1), (1, "S2", 40, 120.0, 1.0, 0)],
                               "row_index bigint, USUBJID string, AGE int, SYSBP double, DOSE double, anomaly int")
    found = outliers.outlier_findings(features.with_texts(df)).collect()
    assert [(r.rule_id, r.severity, r.usubjid, r.evidence, r.message) for r in found] == [
        ("ANOMALY_001", "LOW", "S1", "AGE=400, SYSBP=900.5",
         "Statistical outlier detected by IsolationForest. (found: AGE=400, SYSBP=900.5)")]


def test_the_forest_is_a_forest():
    """Every sample row ends in exactly one leaf, and leaves are no deeper than an average search."""
    rng = np.random.default_rng(3)
    sample = rng.normal(size=(256, 3))
    nodes = outliers._grow(sample, np.random.default_rng([42, 0]))
    assert len(nodes) <= 511
    for row in sample:
        at, depth = 0, 0
        while nodes[at][1] >= 0:
            at, depth = (nodes[at][3] if row[nodes[at][1]] <= nodes[at][2] else nodes[at][4]), depth + 1
        assert depth <= 8 and nodes[at][5] >= depth
