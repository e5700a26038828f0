"""Golden metrics: the 22 published confusion matrices reproduce the published
accuracy / macro F1 / weighted F1 / macro P / macro R to 4 decimals."""

from pyspark.sql import functions as F

from evalspark.functions.labels import CLASSES
from evalspark.operators import metrics as M

# (rows = truth full/partial/rejected; cols = prediction) -> (acc, f1_macro, f1_weighted, p_macro, r_macro)
GOLDEN = [
    ([[2862, 934, 146], [576, 2767, 410], [48, 390, 3351]], (0.7820, 0.7823, 0.7824, 0.7850, 0.7826)),
    ([[0, 2, 0], [2, 585, 356], [1, 517, 610]], (0.5765, 0.3847, 0.5770, 0.3871, 0.3870)),
    ([[0, 4, 20], [6, 1351, 2408], [3, 1938, 4883]], (0.5874, 0.3579, 0.5801, 0.3594, 0.3581)),
    ([[2910, 940, 92], [682, 2709, 362], [82, 469, 3238]], (0.7712, 0.7727, 0.7729, 0.7756, 0.7715)),
    ([[0, 13, 11], [0, 2557, 1208], [1, 4119, 2704]], (0.4957, 0.3308, 0.4971, 0.3572, 0.3585)),
    ([[0, 2, 0], [0, 746, 197], [0, 757, 371]], (0.5388, 0.3490, 0.5153, 0.3830, 0.3733)),
    ([[2739, 949, 254], [580, 2576, 597], [59, 320, 3410]], (0.7598, 0.7579, 0.7580, 0.7604, 0.7604)),
    ([[0, 1, 1], [1, 751, 191], [0, 788, 340]], (0.5263, 0.3382, 0.4981, 0.3756, 0.3659)),
    ([[0, 18, 6], [14, 2800, 951], [9, 4579, 2236]], (0.4745, 0.3160, 0.4650, 0.3596, 0.3571)),
    ([[0, 1, 1], [2, 533, 408], [3, 460, 665]], (0.5779, 0.3848, 0.5790, 0.3851, 0.3849)),
    ([[0, 4, 20], [13, 1022, 2730], [12, 1447, 5365]], (0.6018, 0.3486, 0.5781, 0.3581, 0.3525)),
    ([[2782, 1023, 137], [548, 2808, 397], [60, 421, 3308]], (0.7748, 0.7758, 0.7758, 0.7807, 0.7757)),
    ([[0, 9, 15], [0, 1847, 1918], [0, 2854, 3970]], (0.5481, 0.3532, 0.5558, 0.3549, 0.3574)),
    ([[0, 2, 0], [0, 673, 270], [0, 618, 510]], (0.5707, 0.3789, 0.5647, 0.3914, 0.3886)),
    ([[1497, 3, 2], [1, 664, 278], [3, 617, 508]], (0.7470, 0.7079, 0.7439, 0.7197, 0.7171)),
    ([[3144, 5, 23], [13, 1291, 2461], [23, 1854, 4947]], (0.6818, 0.6858, 0.6745, 0.6881, 0.6863)),
    ([[3047, 684, 211], [1015, 2178, 560], [94, 309, 3386]], (0.7498, 0.7446, 0.7451, 0.7448, 0.7490)),
    ([[0, 2, 0], [0, 666, 277], [3, 615, 510]], (0.5673, 0.3770, 0.5620, 0.3890, 0.3861)),
    ([[0, 4, 20], [13, 1306, 2446], [26, 1843, 4955]], (0.5899, 0.3577, 0.5813, 0.3606, 0.3577)),
    ([[2829, 810, 303], [852, 2110, 791], [68, 202, 3519]], (0.7365, 0.7290, 0.7295, 0.7311, 0.7362)),
    ([[0, 0, 24], [0, 240, 3525], [2, 275, 6547]], (0.6395, 0.2953, 0.5374, 0.3715, 0.3411)),
    ([[0, 1, 1], [0, 249, 694], [0, 172, 956]], (0.5813, 0.3510, 0.5403, 0.3897, 0.3705)),
]


def _expanded(spark):
    """Every matrix as individual (run, truth, prediction) rows."""
    cells = [(k, CLASSES[t], CLASSES[p], n) for k, (m, _) in enumerate(GOLDEN)
             for t in range(3) for p in range(3) for n in [m[t][p]] if n]
    df = spark.createDataFrame(cells, "run int, truth string, prediction string, n int")
    return df.select("run", "truth", "prediction", F.explode(F.array_repeat(F.lit(1), F.col("n"))).alias("_"))


def test_golden_matrices(spark):
    rows = {r["run"]: r for r in M.summary_metrics(_expanded(spark), by=["run"]).collect()}
    for k, (_, want) in enumerate(GOLDEN):
        r = rows[k]
        got = (r["accuracy"], r["f1_macro"], r["f1_weighted"], r["precision_macro"], r["recall_macro"])
        for g, w in zip(got, want):
            assert abs(g - w) < 6e-5, (k, got, want)


def test_confusion_matrix_round_trip(spark):
    cm = M.confusion_matrix(_expanded(spark), by=["run"]).collect()
    got = {(r["run"], r["truth"], r["prediction"]): r["n"] for r in cm}
    for k, (m, _) in enumerate(GOLDEN):
        for t in range(3):
            for p in range(3):
                assert got[(k, CLASSES[t], CLASSES[p])] == m[t][p]
    present = M.confusion_matrix(_expanded(spark).filter("run = 21"), labels="present").collect()
    assert len(present) == 9  # run 21 has a prediction 'full' (2) so all classes are present
    shrunk = M.confusion_matrix(_expanded(spark).filter("run = 1 AND truth <> 'full' AND prediction <> 'full'"),
                                labels="present").collect()
    assert len(shrunk) == 4


def test_report_rows_and_zero_division(spark):
    df = spark.createDataFrame([("full", "full"), ("partial", "full")], "truth string, prediction string")
    rep = {r["label"]: r for r in M.classification_report(df).collect()}
    assert set(rep) == {"full", "partial", "rejected", "accuracy", "macro avg", "weighted avg"}
    assert rep["rejected"]["precision"] == 0.0 and rep["rejected"]["support"] == 0
    assert rep["accuracy"]["f1"] == 0.5
    s = M.summary_metrics(df).collect()[0]
    # macro over present classes (full, partial), as f1_score without labels=
    assert abs(s["f1_macro"] - (2 / 3 + 0) / 2) < 1e-6


def test_paired_comparison(spark):
    a = spark.createDataFrame([(1, "full", "full"), (2, "partial", "full"), (3, "rejected", "rejected")],
                              "id int, truth string, prediction string")
    b = spark.createDataFrame([(1, "partial"), (2, "full"), (3, "rejected")], "id int, prediction string")
    r = M.paired_comparison(a, b).collect()[0]
    assert r["n"] == 3 and r["a_only_correct"] == 1 and r["b_only_correct"] == 0


def test_prompt_format_buckets(spark):
    rows = [(i, f, c) for i in range(20) for f, c in (("with_system", True), ("without_system", i % 10 != 0))]
    df = spark.createDataFrame(rows, "id int, format string, correct boolean")
    r = M.prompt_format_comparison(df).collect()[0]
    assert r["drop_without_system"] == 0.1 and r["dependency"] == "MODERATE"
