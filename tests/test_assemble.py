"""Builds and reports put together: what must fail, what must be mended, and rules on odd values."""

import pytest
from pyspark.sql import functions as F

from quernel.operators import assemble
from quernel.sources import readers, sinks


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_small_rules(spark):
    assert [one(spark, assemble.paper_group(F.lit(x))) for x in ("a_b_12_figure_3", "a_figure_3", "a_1_figure_2_3_figure_4", "plain", "_figure_")] == ["a_b", "a", "a_1_figure_2", "plain", ""]
    assert [one(spark, assemble.ladder(F.lit(a), F.lit(b))) for a, b in ((6, 0), (0, 45), (3, 0), (2, 24), (2, 12), (2, 11), (None, None))] == ["hard", "hard", "medium_hard", "medium", "medium", "easy", "easy"]
    assert [one(spark, assemble.single_structure(F.lit(x))) for x in ("a", "a -> b", "a + b", "a+b", "\\chemfig{}\\chemfig{}", None)] == [True, False, False, True, False, True]
    assert assemble.run_specs(["a=x/y=z", " b =q"]) == {"a": "x/y=z", "b": "q"}
    for bad in (["a"], ["=x"], ["a=x", "a=y"]):
        with pytest.raises(ValueError):
            assemble.run_specs(bad)


@pytest.mark.parametrize("n", [0, 1, 2, 7, 30])
@pytest.mark.parametrize("share", [0.0, 0.5, 1 - 1e-12, 1.0])
def test_no_side_is_empty(spark, n, share):
    out = assemble.train_dev(spark.range(n).withColumnRenamed("id", "k"), "k", share, 3).collect()
    sides = {s: sorted(r["k"] for r in out if r["split"] == s) for s in ("train", "dev")}
    assert len(out) == n
    if share == 1.0:
        assert not sides["dev"]
    elif n > 1:
        assert sides["train"] and sides["dev"]
    if share == 0.0 and n:
        assert sides["train"] == [0]
    if share == 1 - 1e-12 and n > 1:
        assert sides["dev"] == list(range(n - max(1, n // 5), n))


def test_reviews_are_checked(spark):
    kind = "id long, role string, reviewer string, decision string, reason string, at int"
    good = [(1, "a", "x", "pass", "ok", 1), (1, "b", "y", "pass", None, 1), (2, "a", "x", "pass", "ok", 1), (2, "b", "y", "reject", "leakage", 2), (3, "a", "x", "pass", "", 1), (2, "adjudicator", "z", "uncertain", "other", 3), (4, "a", "x", "reject", "ok", 1), (4, "a", "x", "pass", "ok", 2), (4, "b", "y", "pass", "ok", 1)]
    out = assemble.adjudicated(spark.range(1, 6), spark.createDataFrame(good, kind), ["a", "b"]).orderBy("id").collect()
    assert [(r["final"], r["status"]) for r in out] == [("pass", "agreed"), ("uncertain", "adjudicated"), ("pending", "pending"), ("pass", "agreed"), ("pending", "pending")]
    for bad, message in (((1, "a", "x", "maybe", "ok", 1), "unknown decision"), ((1, "a", "x", "pass", "why", 1), "unknown reason"), ((1, "a", " ", "pass", "ok", 1), "no reviewer")):
        with pytest.raises(Exception, match=message):
            assemble.adjudicated(spark.range(3), spark.createDataFrame([bad], kind), ["a", "b"]).collect()


def test_evidence_needs_its_parts(spark):
    a = spark.range(1).withColumnRenamed("id", "n")
    r = assemble.evidence({"a": a}, {"b": None, "c": a.limit(0), "d": a}).first()
    assert (r["a"], r["b"], r["c"], r["d"], r["absent"]) == ('{"n":0}', None, None, '{"n":0}', ["b", "c"])
    for parts in (({"a": a.limit(0)}, {}), ({"a": a.union(a)}, {}), ({"a": a}, {"b": a.union(a)})):
        with pytest.raises(Exception, match="must have one row"):
            assemble.evidence(*parts).collect()


def test_merged_runs_of_samples_without_any(spark):
    kind = "id string, prediction string, candidates array<struct<prediction: string, canonical: string>>"
    x = spark.createDataFrame([("1", "p", [("p", "P"), ("q", None)]), ("2", "r", None), (None, "s", [])], kind)
    y = spark.createDataFrame([("1", "t", [("p", "P")]), ("3", "u", [("v", "V")])], kind)
    labels = spark.createDataFrame([("1",), ("9",)], "id string")
    rows = {r["id"]: r for r in assemble.merged_runs({"x": x, "y": y}, labels, "y").collect()}
    assert set(rows) == {"1", "9"} and rows["1"]["prediction"] == "t" and (rows["1"]["n_candidates"], rows["1"]["n_keys"], rows["1"]["n_runs"]) == (3, 1, 2)
    assert (rows["9"]["prediction"], rows["9"]["n_candidates"], rows["9"]["n_runs"]) == ("", 0, 0)
    rows = {r["id"]: r for r in assemble.merged_runs({"x": x, "y": y}, labels, unlabelled=True, most=1).collect()}
    assert set(rows) == {"1", "2", "3", "9"} and rows["1"]["n_candidates"] == 2 and rows["2"]["n_candidates"] == 0 and rows["3"]["prediction"] == "u"


def test_probe_without_a_second_dose(spark):
    runs = spark.createDataFrame([("00", 0.5, 0.9), ("00", 0.6, 0.8), ("10", 0.7, 0.9), ("01", 0.7, 0.7), ("11", 0.9, 0.5)], "condition string, exact double, valid double")
    dose = spark.createDataFrame([(0.95, 0.85)], "exact double, valid double")
    r = assemble.probe_winner(runs, dose.limit(0), 0.05, 0.01).first()
    assert (r["core_winner"], r["winner"], r["validity_floor"]) == ("10", "10", 0.75)
    r = assemble.probe_winner(runs, dose, 0.05, 0.01).first()
    assert (r["winner"], r["exact"], r["seed_range"]) == ("dose2", 0.95, None)
    assert assemble.probe_winner(runs, dose, 0.05, 0.3).first()["winner"] == "10"


def test_annotations_and_two_columns(spark, tmp_path):
    for split in ("Train", "val", "test", "x/val999", "validation", "vals"):
        (tmp_path / split).mkdir(parents=True)
        (tmp_path / split / "x.json").write_text('{"n":\n 3}')
    got = readers.annotations(spark, str(tmp_path), spark.createDataFrame([], "n int").schema)
    assert sorted((r["n"], r["split"]) for r in got.collect()) == [(3, "test"), (3, "train"), (3, "train"), (3, "unknown"), (3, "val"), (3, "val")]
    (tmp_path / "t.tsv").write_text("a\tb\nc\t\n")
    assert sorted(tuple(r) for r in readers.two_columns(spark, str(tmp_path / "t.tsv")).collect()) == [("a", "b"), ("c", None)]
    sinks.write_partitioned(spark.range(20).selectExpr("id", "id % 3 as b"), str(tmp_path / "p"), "b")
    assert sorted(x.name for x in (tmp_path / "p").iterdir() if x.is_dir()) == ["b=0", "b=1", "b=2"] and spark.read.parquet(str(tmp_path / "p")).count() == 20


def test_all_choices_of_a_sample_shuffle_no_more_than_one(spark):
    from quernel.operators import choose
    from quernel.plans import choices
    from quernel.plans.base import Tables

    aggs = choose.aggregates(choices._cands(Tables(spark, "/root/testdata/sf0.001")))
    picks = choices._picked(aggs)
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert shuffles(picks) == shuffles(choose.current(aggs))
    got = {r["id"]: (r["selected"], r["light"]) for r in picks.collect()}
    selected, light = ({r["id"]: r["canonical"] for r in df.collect()} for df in (choose.current(aggs), choices._light(aggs)))
    assert got == {i: (k, light[i]) for i, k in selected.items()} and set(light) == set(got)
