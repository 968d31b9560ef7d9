"""Known results, as literal values."""

import pytest
from pyspark.sql import functions as F

from scoreloom.functions.stats import benjamini_hochberg, significant
from scoreloom.operators import resampling, verify

# A family of twelve p-values, their q-values, and p-values of 5000 permutations with their counts.
FAMILY = [
    (0.0008709092010055, 0.010450910412066), (0.0266650807633984, 0.1228603358844324), (0.0307150839711081, 0.1228603358844324), (0.0460449626795332, 0.12624347348558546),
    (0.0526014472856606, 0.12624347348558546), (0.3445295979336989, 0.47042457129621157), (0.359483695206541, 0.47042457129621157), (0.3813516794449209, 0.47042457129621157),
    (0.3903692885019628, 0.47042457129621157), (0.4116158015361447, 0.47042457129621157), (0.4312225236881939, 0.47042457129621157), (0.607888962456079, 0.607888962456079),
]
COUNTS = [(0.0001999600079984, 0), (0.1667666466706658, 833), (0.7160567886422715, 3580), (0.3059388122375525, 1529), (0.2351529694061187, 1175)]
DIFFERENCES = "N1:0.26619881;N2:0.23308344;N3:0.26521032;N4:0.20007476;N5:0.29300701;N6:0.20265199"


def test_family_of_twelve(spark):
    df = spark.createDataFrame([(i, "f", p, q) for i, (p, q) in enumerate(FAMILY)], "i int, f string, p double, want double")
    got = benjamini_hochberg(df, "p", "f", order="i", q="q").withColumn("yes", significant("q", 0.05)).collect()
    assert all(r["q"] == pytest.approx(r["want"], abs=1e-10) for r in got)
    assert [r["i"] for r in got if r["yes"]] == [0]


def test_counts_behind_p(spark):
    df = spark.createDataFrame(COUNTS, "p double, want int")
    assert [r[0] for r in df.select(verify.count_of_p(F.col("p"), 5000)).collect()] == [c for _, c in COUNTS]


def test_donor_differences(spark):
    df = spark.createDataFrame([("a", DIFFERENCES)], "k string, s string").select("k", F.explode(F.split("s", ";")).alias("x"))
    df = df.select("k", F.split("x", ":")[1].cast("double").alias("d"))
    assert resampling.sign_flip(df, "d", "k").first()["p_value"] == 0.03125
