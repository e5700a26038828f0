"""C5 dialect traps (FIXTURES 3.1), I2 parsing (3.2), C7/C8, L1/L3."""

from pyspark.sql import functions as F

from evalspark.functions.labels import DIALECTS, extract_label, normalize_label
from evalspark.operators import labels as L

# raw -> (distribution, eval, results, repair, conservative); 'error' = invalid in results
TRAPS = [
    ("full", "full", "full", "full", "full", "full"),
    ("P", "partial", "rejected", "partial", "partial", "partial"),
    ("r", "rejected", "rejected", "rejected", "rejected", "rejected"),
    ("approve", "approve", "rejected", "full", "full", "full"),
    ("denied", "denied", "rejected", "error", "rejected", "rejected"),
    ("incomplete", "incomplete", "rejected", "full", "partial", "incomplete"),
    ("not allowed", "not allowed", "rejected", "full", "full", "not allowed"),
    ("access denied", "access denied", "rejected", "error", "partial", "access denied"),
    ("approve competitor analysis, reject budget change", "approve competitor analysis, reject budget change",
     "rejected", "full", "partial", "approve competitor analysis, reject budget change"),
    ("summary_only", "summary_only", "rejected", "error", "partial", "partial"),
    (None, None, "rejected", "error", "rejected", "rejected"),
    ("", None, "rejected", "error", "rejected", "rejected"),
    ("disapprove", "disapprove", "rejected", "full", "full", "disapprove"),
    ("   ", "", "rejected", "error", "partial", "   "),
]


def _apply(spark, values, dialect):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, raw string")
    out = df.select("i", normalize_label("raw", dialect).alias("n")).orderBy("i").collect()
    return [r["n"] for r in out]


def test_dialect_traps(spark):
    raws = [t[0] for t in TRAPS]
    for k, dialect in enumerate(DIALECTS):
        got = _apply(spark, raws, dialect)
        for raw, g, row in zip(raws, got, TRAPS):
            want = row[k + 1]
            if dialect == "results" and want == "error":
                assert g not in ("full", "partial", "rejected"), (dialect, raw, g)
            else:
                assert g == want, (dialect, raw, g, want)


def test_canonical_labels_are_fixed_points(spark):
    for dialect in DIALECTS:
        assert _apply(spark, ["full", "partial", "rejected"], dialect) == ["full", "partial", "rejected"]


def test_extract_label(spark):
    cases = [("Rejected: partial access only", "rejected"), ("partially", "partial"), ("Fully granted", "full"),
             ("no idea", "rejected"), (None, None)]
    df = spark.createDataFrame(cases, "t string, want string")
    for r in df.select(extract_label("t").alias("got"), "want").collect():
        assert r["got"] == r["want"]


def test_change_log_and_dry_run(spark):
    df = spark.createDataFrame([("p",), ("p",), ("full",), (None,), ("deny",)], "expected_response string")
    log = {(r["original"], r["normalized"]): r["n"] for r in L.label_change_log(df).collect()}
    assert log == {("p", "partial"): 2, (None, "rejected"): 1, ("deny", "rejected"): 1}
    dry = L.label_dry_run(df).collect()[0]
    assert (dry["n_rows"], dry["n_changed"], dry["n_distinct_changes"]) == (5, 4, 3)


def test_label_distribution_counts_all_rows(spark):
    df = spark.createDataFrame([("full",), ("P",), ("",), (None,), ("weird",)], "expected_response string")
    rows = {r["label"]: r for r in L.label_distribution(df).collect()}
    assert set(rows) == {"full", "partial", "weird"}
    assert rows["full"]["n_total"] == 5 and rows["full"]["n_labelled"] == 3
    assert rows["full"]["pct"] == 20.0 and rows["full"]["bar"] == "█" * 10


def test_split_label_stats_raw_and_empty(spark):
    df = spark.createDataFrame([("a", "full"), ("a", "p"), ("a", "rejected")], "split string, expected_response string")
    r = L.split_label_stats(df).collect()[0]
    assert (r["total"], r["full"], r["partial"], r["rejected"]) == (3, 1, 0, 1)


def test_invalid_policy_raise(spark):
    import pytest
    df = spark.createDataFrame([("full",), ("bogus",)], "t string")
    with pytest.raises(L.InvalidLabelError):
        L.apply_invalid_policy(df, "t", "raise")
    fixed = [r["t"] for r in L.apply_invalid_policy(df, "t", "default_rejected").collect()]
    assert sorted(fixed) == ["full", "rejected"]


def test_strip_matches_python_whitespace(spark):
    raws = [" Full　", " p\x85", "\x1cr "]
    got = _apply(spark, raws, "repair")
    assert got == ["full", "partial", "rejected"]
    assert [x.lower().strip() for x in raws] == ["full", "p", "r"]


def test_key_error_policy(spark):
    import pytest
    from evalspark.operators import labels as L
    df = spark.createDataFrame([("full",), ("odd",), ("odd",)], "y string")
    with pytest.raises(KeyError, match="odd"):
        L.apply_invalid_policy(df, "y", "key_error")
    assert L.apply_invalid_policy(df.where("y = 'full'"), "y", "key_error").count() == 1
