"""Building operators on small fixtures: nulls, odd values and rules against what they must give."""

import math

import pytest
from pyspark.sql import functions as F

from quernel.operators import build, stats


def column(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_weight_rules(spark):
    assert build.weight_rules(" a:b=2, default=0.5 ,,c:d:e=3") == (0.5, [("a", "b", 2.0), ("c", "d:e", 3.0)])
    for bad in ("a=2", "a:b", "default"):
        with pytest.raises(ValueError):
            build.weight_rules(bad)
    df = spark.createDataFrame([("x", None), ("y", "x")], "a string, b string")
    assert [r[0] for r in df.select(build.rule_weight("a:x=2,b:x=3,b:=5")).collect()] == [10.0, 3.0]


def test_clamped(spark):
    for given, want in (("3", 3.0), ("-1", 1.0), ("9", 4.0), ("x", 2.0), (None, 2.0), ("nan", 2.0), ("inf", 2.0)):
        assert column(spark, build.clamped(F.lit(given), 1, 4, 2)) == want
    assert column(spark, build.clamped(F.lit("x"), 0, 1, None)) is None


def test_image_warnings(spark):
    n = lambda x: F.lit(x).cast("double")
    assert column(spark, build.image_warnings(n(100), n(900), n(20), n(3))) == ["short_side", "exposure", "contrast"]
    assert column(spark, build.image_warnings(n(0), n(100), n(None), n(None))) == []


@pytest.mark.parametrize(("wins", "losses"), [(0, 0), (1, 0), (3, 3), (2, 9), (400, 350), (3000, 2800)])
def test_mcnemar_column_is_the_exact_one(spark, wins, losses):
    assert math.isclose(column(spark, build.mcnemar_p(F.lit(wins), F.lit(losses))), stats.mcnemar_exact(wins, losses), rel_tol=1e-7)


def test_canonical_record(spark):
    rows = [("canonical form", "CC", True), ("canonical form", "  ", False), ("canonical form", "\\chemfig{C}", False), ("ssml canonical", "CC", False), ("other", "CC", False), (None, "CC", False), ("canonical", None, False)]
    df = spark.createDataFrame(rows, "p string, a string, want boolean").withColumn("got", build.canonical_record("p", "a", "canonical", "ssml", "\\chemfig"))
    assert all(r["got"] == r["want"] for r in df.collect())


def test_review_problems(spark):
    rows = [("1", "s", "yes", "pass"), ("2", " ", "yes", "pass"), ("3", "s", "maybe", "pass"), ("4", "s", "1", None), ("5", "s", "TRUE", "PASS "), ("5", "s", "true", "pass"), (None, "s", "yes", "pass")]
    df = spark.createDataFrame(rows, "id string, s string, ok string, r string")
    got = sorted((r["id"] or "", r["problem"]) for r in build.review_problems(df, ["id", "s"], "ok", ["r"], "id").collect())
    assert got == [("", "id is required"), ("2", "s is required"), ("3", "ok must be yes"), ("4", "r must be pass"), ("5", "duplicate id"), ("5", "duplicate id")]


def test_constant_violations(spark):
    df = spark.createDataFrame([("a", "b"), ("a", None)], "x string, y string")
    assert [tuple(r) for r in build.constant_violations(df, {"x": "a", "y": "b"}).collect()] == [("y", 1)]
    assert build.constant_violations(df.limit(0), {"x": "a"}).count() == 0


def test_guard_pairs_have_the_sides_of_earlier_ones(spark):
    a = spark.createDataFrame([(1, "t", 5), (1, "w", 4), (1, "v", 3), (1, "u", 2), (2, "w", 1)], "id long, canonical string, n int")
    picks = spark.createDataFrame([(1, "t", "w", "v"), (2, "w", "w", "w")], "id long, selected string, light string, policy string")
    truth = spark.createDataFrame([(1, "t"), (2, "t")], "id long, truth string")
    got = sorted(tuple(r) for r in build.typed_pairs(a, truth, picks, [F.col("n").desc()], 3).collect())
    assert got == [(1, "oracle_positive_vs_chem_light", "t", "w"), (1, "oracle_positive_vs_hard_negative", "t", "u"), (1, "oracle_positive_vs_reward_policy", "t", "v")]


def test_latest_checkpoint(spark):
    df = spark.createDataFrame([("p", "a/checkpoint-9"), ("p", "a/checkpoint-10"), ("p", "a/checkpoint-x"), ("q", "b/last"), ("p", None)], "phase string, path string")
    assert [tuple(r) for r in build.latest_checkpoint(df, "phase", "path").collect()] == [("p", 10, "a/checkpoint-10")]


def test_hard_replay_keeps_first_and_caps(spark):
    df = spark.createDataFrame([(i, f"k{i % 10}", f"t{i % 10}", "s", "hard" if i % 2 else "easy", None) for i in range(30)], "at long, k string, t string, s string, d string, w string")
    out = build.hard_replay(df, df.where("k = 'k1'"), df.where("k = 'k0'"), "k", "t", "s", "d", "w", {"s": 4}, "at", 1).collect()
    base = [r for r in out if r["policy"].startswith("base_")]
    assert len({r["k"] for r in base}) == 4 and all(r["at"] < 10 and r["k"] != "k0" for r in out)
    assert all(sum(x["k"] == r["k"] for x in base) == (3 if r["d"] == "hard" else 1) for r in base)
    auto = [(r["k"], r["policy"]) for r in out if r["policy"].startswith("auto_")]
    assert auto == [("k1", "auto_hard:repeat_8")] * 8


def test_repeats_are_held_by_sources(spark):
    rows = [("real_world", "clean", 4), ("real_world", "handwritten", 8), ("molgrapher_synthetic", "clean", 2), ("molgrapher_synthetic", "scan", 3), ("uspto", "scan", 2), ("uob", "scan", 1), ("other", "scan", 6), ("other", None, 1)]
    df = spark.createDataFrame(rows, "s string, d string, want int")
    assert df.where(build.base_times("s", "d") != F.col("want")).count() == 0
