"""Invariants of operators on small inline tables."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from quernel.functions import draws, keys, numbers, text
from quernel.operators import candidates as cand
from quernel.operators import choose, export, graph, learn, measure, paired, qc, rank, relate, route, sample, shape, stats


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def one(spark, column, schema="x string", row=("",)):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first()[0]


def test_edit_similarity_of_nothing_is_one(spark):
    assert one(spark, text.edit_similarity(F.lit(""), F.lit(""))) == 1.0
    assert one(spark, text.edit_similarity(F.lit(None), F.lit("ab"))) == 0.0
    assert one(spark, text.edit_similarity(F.lit("käse"), F.lit("kase"))) == 0.75


def test_strict_key_refuses_fragments(spark):
    assert one(spark, text.strict_key(F.lit(" C C O "))) == "CCO"
    assert one(spark, text.strict_key(F.lit("CCO.Cl"))) is None
    assert one(spark, text.strict_key(F.lit("  "))) is None


@pytest.mark.parametrize(("t", "ok"), [("CC.O", False), ("C(C", False), ("CC(C)O", True), ("", False)])
def test_lexical_valid(spark, t, ok):
    assert one(spark, text.lexical_valid(F.lit(t))) is ok


def test_tokens_fall_back_to_characters(spark):
    assert one(spark, text.tokens(F.lit("BrC"))) == ["Br", "C"]
    assert one(spark, text.tokens(F.lit("C C"))) == ["C", " ", "C"]
    assert one(spark, text.tokens(F.lit("NaCl[nH]%12"))) == ["Na", "Cl", "[nH]", "%12"]
    assert one(spark, text.tokens(F.lit("ClSi[nH]%12"))) == ["Cl", "Si", "[nH]", "%12"]
    assert one(spark, text.tokens(F.lit("CH"))) == ["C", "H"]


def test_bag_overlap_counts_repeats(spark):
    a, b = F.array(*map(F.lit, "aab")), F.array(*map(F.lit, "abbb"))
    assert one(spark, text.bag_overlap(a, b)) == 2


def test_clean_prediction(spark):
    for given, want in (("assistant\nCCO\nuser", "CCO"), (" OCR: CCO ", "CCO"), ("assistant: CC", ": CC"), ("user\nAssistant:\u2003", ""), ("OCR: user", "user"), ("User: draw\r\nCC\x0bN", "N"), ("a b", "a b"), ("user", ""), (None, ""), ("draw it", "it")):
        assert one(spark, text.clean_prediction(F.lit(given), "draw")) == want, given
    assert one(spark, text.clean_prediction(F.lit("draw it"))) == "draw it"


def test_structure_penalty(spark):
    for given, want in (("", 1000), (None, 1000), (" \u00a0", 1000), ("C1CC1", 0), ("C1CC", 3), ("C%12CC", 6), ("C%12C2C%12", 3), ("C (C", 6), ("[C", 4), ("User", 8), ("C" * 272, 1), ("C" * 5000, 50), ("C0", 3)):
        assert one(spark, text.structure_penalty(F.lit(given))) == want, given


def test_lexical_issues(spark):
    for given, want in (("", ["empty", "unsupported_character"]), ("C C", []), ("C.$(", ["multi_fragment", "unsupported_character", "unbalanced_delimiter"]), (None, ["empty", "unsupported_character"])):
        assert one(spark, text.lexical_issues(F.lit(given))) == want, given


def test_safe_double(spark):
    for raw, want in (("1.5", 1.5), ("nan", 0.0), ("inf", 0.0), ("x", 0.0), (None, 0.0)):
        assert one(spark, numbers.safe_double(F.lit(raw))) == want


def test_fold_is_stable_and_folds_cover(spark):
    df = spark.range(200).select(keys.fold(1, "id", 5).alias("f"))
    assert {r[0] for r in df.collect()} == {0, 1, 2, 3, 4}
    assert df.collect() == spark.range(200).select(keys.fold(1, "id", 5).alias("f")).collect()


def test_clean_prediction_keeps_a_long_tail(spark):
    out = text.clean_prediction(F.concat(F.lit("Assistant: "), F.repeat(F.lit("x"), 1_100_000), F.lit("end")))
    row = spark.range(1).select(F.length(out).alias("n"), F.endswith(out, F.lit("end")).alias("whole")).first()
    assert (row["n"], row["whole"]) == (1_100_005, True)  # 'Assistant' goes first, the colon stays


def test_group_holdout(spark):
    rows = [(f"p{p}", f"k{p}{k}", i) for p in range(4) for k in range(2) for i in range(2)]
    df = spark.createDataFrame(rows, "paper string, key string, i int")
    out = sample.group_holdout(df, "paper", "key", 2, 1, 2, 7).collect()
    locked = [r for r in out if r["split"] == "locked"]
    assert len(locked) == 2 and len({r["paper"] for r in locked}) == 2 and len({r["key"] for r in locked}) == 2
    held = {r["paper"] for r in locked}
    assert all(r["split"] != "train" for r in out if r["paper"] in held)
    assert len(out) == len(rows)


def test_group_holdout_finds_free_keys_behind_taken_ones(spark):
    df = spark.createDataFrame([(f"p{p:02}", f"k{k:02}") for p in range(80) for k in range(80)] + [("p00", None), ("none", None)], "paper string, key string")
    locked = sample.group_holdout(df, "paper", "key", 80, 1, 2, 7).where("split = 'locked'").collect()
    assert len({r["paper"] for r in locked}) == len({r["key"] for r in locked}) == len(locked) == 80


def test_ranks_are_those_of_the_sorted_list(spark):
    rows = [("a", v) for v in (5, 1, 1, 1, 9, 7, 7, 2, None)] + [("b", 3), ("c", None), (None, 4), (None, 6)] + [("d", v % 11) for v in range(100)]
    df = spark.createDataFrame(rows, "g string, v long")
    for how, place in ((numbers.nearest_rank, lambda n, p: F.bround((n - 1) * F.lit(p))), (numbers.floor_rank, lambda n, p: F.floor((n - 1) * F.lit(p)))):
        want = df.where("v is not null").groupBy("g").agg(F.array_sort(F.collect_list("v")).alias("s")).select("g", how("s", 0.5).alias("p50"), how("s", 0.9).alias("p90"))
        got = measure.ranks(df, "v", "g", p50=lambda n: place(n, 0.5), p90=lambda n: place(n, 0.9))
        assert got.schema == want.schema and sorted(map(str, got.collect())) == sorted([*map(str, want.collect()), "Row(g='c', p50=None, p90=None)"])
        assert "collect_list" not in got._jdf.queryExecution().toString()


def test_entity_split_override(spark):
    df = spark.createDataFrame([("a", None), ("a", "test")], "k string, given string")
    s = sample.entity_split(F.col("k"), [("train", 1.0)], F.col("given"))
    assert values(df.select(s.alias("s")), "s") == [("test",), ("train",)]


def test_ordinal_and_shards_are_complete(spark):
    d = rank.ordinal(spark.range(13).withColumnRenamed("id", "x"), "x")
    assert values(d, "x", "ord") == [(i, i) for i in range(13)]


def test_ordinal_of_more_rows_than_a_range_sample(spark):
    df = spark.range(0, 20000, 1, 5).select(F.sha2(F.col("id").cast("string"), 256).alias("h"), (F.col("id") % 2).cast("string").alias("t"), F.when(F.col("id") % 9 > 0, F.col("id")).alias("x"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so many ranges as larger rows would have
    try:
        got = rank.curriculum(df, {"0": 0}, "t", F.struct("h")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted(df.collect(), key=lambda r: (r["t"], r["h"]))
    assert [(r["place"], r["h"]) for r in sorted(got, key=lambda r: r["place"])] == [(i, r["h"]) for i, r in enumerate(want, 1)]
    assert [r["x"] for r in rank.ordinal(df.select("x"), "x").orderBy("ord").collect()] == sorted((r["x"] for r in want), key=lambda x: (x is not None, x or 0))
    assert rank.ordinal(df.where("t > 5"), "h").count() == 0


def test_near_best_earliest(spark):
    df = spark.createDataFrame([("a", 200, 0.300), ("a", 400, 0.304)], "g string, step int, score double")
    assert rank.near_best_earliest(df, "g", "score", "step", 0.005).first()["step"] == 200


@pytest.mark.parametrize(("gain", "who"), [(0.302, "baseline"), (0.307, "candidate")])
def test_winner_gate(spark, gain, who):
    df = spark.createDataFrame([(0.300, gain)], "b double, c double")
    assert stats.winner(df, "b", "c", 0.005, 0.005).first()["winner"] == who


def test_cluster_means(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 1, 1), ("b", 0, 0)], "c string, a int, b int")
    c = stats.cluster_means(df, "c")
    assert c.count() == 2 and c.agg(F.avg("delta")).first()[0] == 0.25


def test_mcnemar():
    assert stats.mcnemar_exact(0, 0) == 1.0
    assert stats.mcnemar_exact(5, 5) == 1.0
    assert math.isclose(stats.mcnemar_exact(0, 6), 2 / 64)


def test_missing_prediction_stays_in_denominators(spark):
    j = spark.createDataFrame([(1, "ab", "ab", False), (2, "ab", None, True)], "id int, t string, p string, missing boolean")
    all_rows = measure.report(measure.details(j, "t", "p"), ["id"]).where("dimension = 'all'").first()
    assert (all_rows["total"], all_rows["n_exact"], all_rows["n_missing"], all_rows["exact_rate"]) == (2, 1, 1, 0.5)


def test_literal_metric(spark):
    j = spark.createDataFrame([("C C", "CC"), ("CC", None)], "t string, p string")
    assert values(measure.literal(j, "t", "p"), "raw_exact", "normal_exact", "non_empty") == [(False, False, False), (False, True, True)]


def test_unique_by_key_fails(spark):
    with pytest.raises(Exception, match="repeated"):
        relate.unique_by_key(spark.createDataFrame([(1,), (1,)], "id int"), "id").collect()


def test_containing_matches_contains(spark):
    t = spark.createDataFrame([(1, "x a b c d e f g y"), (2, "xa b c d e f gy"), (3, "nothing"), (4, None)], "i int, t string")
    p = spark.createDataFrame([("a b c d e f g",), ("nothing",), ("",)], "p string")
    for scanned in (0, 4096):
        got = values(relate.containing(t, p, "t", "p", scanned=scanned), "i", "p")
        assert got == [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "nothing")]


@pytest.mark.parametrize("scanned", [0, 100])
def test_containing_short_passages_at_word_edges(spark, scanned):
    texts = [(1, "the book of love. And on"), (2, "xthe old book of lovely"), (3, "a bb ccc 😀é, end"), (4, ""), (5, "the\tbook of"), (6, None), (6, "the old big book of love."), (6, "the old big book of love.")]
    parts = ["the old big book of love", "big book of love", "the old book of love", "e old b", "book", "k o", "o", "😀é", "cc 😀", "f love", "x y", " ", "", "ld big book of lov", "the old big book of love. And more", "one two three four five six seven eight"]
    t = spark.createDataFrame(texts, "i int, t string")
    found = relate.containing(t, spark.createDataFrame([(p,) for p in parts], "p string"), "t", "p", scanned=scanned)
    assert values(found, "i", "p") == sorted((i, p) for i, s in texts for p in parts if s is not None and p.strip() and p in s)
    assert "CartesianProduct" not in found._jdf.queryExecution().toString()


def test_sibling_margin_with_equal_best(spark):
    df = spark.createDataFrame([(1, "a", 2, 5.0), (1, "b", 1, 5.0), (2, "a", 1, 1.0)], "id int, c string, votes int, s double")
    assert values(rank.sibling_features(df, "id", "votes", "s"), "id", "c", "margin") == [(1, "a", 0.0), (1, "b", 0.0), (2, "a", 0.0)]


def test_candidates_empty_and_null(spark):
    c = spark.createDataFrame([(1, None, 1.0, 0)], "id int, canonical string, score double, candidate_index int")
    assert cand.rerank(cand.aggregate(c)).count() == 0
    c = spark.createDataFrame([(1, "a", None, None), (1, "b", 1.0, 0)], "id int, canonical string, score double, candidate_index int")
    assert cand.rerank(cand.aggregate(c)).first()["canonical"] == "b"


def test_threshold_without_gain_changes_nothing(spark):
    df = spark.createDataFrame([("g", 1.0, -1), ("g", 2.0, -1)], "g string, s double, gain long")
    assert route.best_threshold(df, "g", "s", "gain").first()["threshold"] == float("inf")


def test_ridge_recovers_a_line(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i) for i in range(10)], "x double, y double")
    assert abs(learn.ridge(learn.gram(df, ["x"], "y"), 1, 1e-9)[0] - 2) < 1e-6


def test_reasons_sum_to_rows(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    rules = [(F.col("x").isNull(), "null"), (F.col("x") > 1, "large")]
    assert shape.with_reason(df, rules).groupBy("reason").count().agg(F.sum("count")).first()[0] == 3
    assert shape.accepted(df, rules).count() == 1


def test_parsed_box(spark):
    assert one(spark, shape.parsed_box(F.lit("[0, 0, 1, 1]"))) == [0, 0, 1, 1]
    assert one(spark, shape.parsed_box(F.lit("1,0,1,1"))) is None
    assert one(spark, shape.parsed_box(F.lit("a,b"))) is None


def test_spread_rank_and_sweep_are_as_plain_windows(spark):
    import random

    from pyspark.sql import Window as W

    from quernel.operators import rank

    r = random.Random(5)
    rows = [(i, r.choice(["a", "a", "a", "b", None]), r.choice([None, 1.5, 2.0, -3.0, float(i % 90)]), r.choice([-1, 0, 2, None])) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, g string, s double, gain long")
    h = keys.hash_order(3, "id")
    got = rank.spread_rank(df, "g", h, F.col("id"), "r", "n")
    want = df.withColumn("r", F.row_number().over(W.partitionBy("g").orderBy(h, "id"))).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("g")))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    w = W.partitionBy("g").orderBy(F.col("s").desc()).rangeBetween(W.unboundedPreceding, W.currentRow)
    plain = df.select("g", F.col("s").alias("threshold"), F.count(F.lit(1)).over(w).alias("n"), F.sum("gain").over(w).alias("x")).distinct()
    for parts in (2, 64):
        swept = rank.threshold_sweep(df, "g", "s", "gain", parts=parts)
        assert sorted(map(tuple, swept.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    assert rank.threshold_sweep(df.limit(0), "g", "s", "gain").count() == 0


def test_running_sums_over_ranges(spark):
    """As one loop in order of place, for groups and for all rows, whatever the span; null is a group."""
    import random

    r = random.Random(4)
    rows = [(run, line * r.randint(1, 3), r.choice(["a", "b", None]), r.randint(0, 3)) for run in range(3) for line in range(60)]
    rows = list({(x[0], x[1]): x for x in rows}.values())
    df = spark.createDataFrame(rows, "run int, line long, g string, v long")
    for span in (1, 7, 1 << 16):
        for group in ("g", None):
            sums, want = {}, {}
            for run, line, g, v in sorted(rows, key=lambda x: x[:2]):
                k = g if group else 0
                sums[k] = want[run, line] = sums.get(k, 0) + v
            got = rank.running(df, group, "run", "line", "v", "s", span)
            assert {(x["run"], x["line"]): x["s"] for x in got.collect()} == want and got.count() == len(rows)


@pytest.mark.parametrize("per_source,total", [(2, 5), (0, 4), (3, 0), (0, 0), (1, 100)])
def test_preference_scan_caps_in_order(spark, per_source, total):
    import random

    r = random.Random(per_source * 10 + total)
    rows = [(run, line, r.choice("ab"), r.choice(["x", None])) for run in range(2) for line in range(12)]
    df = spark.createDataFrame(rows, "run int, line long, source string, rejected string")
    kept, of, want = 0, {}, {}
    for run, line, source, rejected in rows:
        if total and kept >= total:
            status = "total_cap"
        elif per_source and of.get(source, 0) >= per_source:
            status = "source_cap"
        elif rejected is None:
            status = "no_rejected"
        else:
            status, kept = "kept", kept + 1
            of[source] = of.get(source, 0) + 1
        want[run, line] = status
    got = choose.preference_scan(df, "run", "line", "source", "rejected", per_source, total, span=5)
    assert {(x["run"], x["line"]): x["status"] for x in got.collect()} == want


def test_rejected_answers(spark):
    """The pool holds the prompt's own answers once; valid ones come first, then votes and nearness in length."""
    one = "struct<" + choose.PAIR_POOL.replace(" ", ": ").replace(",: ", ", ") + ">"
    answer = lambda prompt, p, canonical=None, raw=None, votes=None: (prompt, p, canonical, raw, votes, None, None, None)
    nothing = answer(None, None)
    rows = [
        (1, "P", "CC", answer(None, "CC", votes=3), [answer("P", " CCC "), answer("Q", "CCCC", votes=9), answer("P", "C?", votes=8)]),
        (2, "P", "CC", nothing, [answer("P", "C?"), answer(None, "?C")]),
        (3, "P", "CC", nothing, None),
        (4, "P", None, answer(None, "CC"), []),
        (5, "P", "CC", answer(None, "CC"), [answer("P", "x", canonical="CC")]),
        (6, "P", "CC", nothing, [answer("P", "CCCCC", votes=2), answer("P", "CCN", votes=2), answer("P", "CCO", votes=2)]),
    ]
    df = spark.createDataFrame(rows, f"id int, prompt string, target string, selected {one}, candidates array<{one}>")
    canonical = lambda c: F.when(~F.contains(c, F.lit("?")), c)
    got = {r["id"]: r["rejected"] for r in choose.with_rejected(df, canonical).collect()}
    assert {i: tuple(v) if v else None for i, v in got.items()} == {1: ("CCC", 3, "valid_wrong"), 2: ("C?", 0, "invalid_wrong"), 3: None, 4: None, 5: None, 6: ("CCO", 2, "valid_wrong")}
    assert {r["id"] for r in choose.with_rejected(df, canonical, allow_invalid=False).where("rejected is not null").collect()} == {1, 6}


def test_paired_runs_must_match(spark):
    kind = "id long, exact boolean, valid boolean, source string, c string"
    a = spark.createDataFrame([(1, True, True, "s", "x"), (2, False, True, None, None), (3, None, None, "s", "")], kind)
    b = spark.createDataFrame([(1, False, True, "s", "x"), (2, True, True, "s", None), (3, True, True, "s", None)], kind)
    pairs = paired.paired(a, b, "id", "exact", "valid", ["source"], "c")
    assert sorted(tuple(r) for r in pairs.collect()) == [(1, "x", 1, 0, 1, 1, "s"), (2, "2", 0, 1, 1, 1, None), (3, "3", 0, 1, 0, 1, "s")]
    r = paired.report(pairs, iterations=50).first()
    assert (r["n"], r["independent_units"], r["wins"], r["losses"], r["exact_delta"], r["mcnemar_p"]) == (3, 3, 2, 1, round(1 / 3, 6), 1.0)
    assert paired.report(pairs, clustered=True, iterations=50).first()["mcnemar_p"] is None
    assert sorted(tuple(x) for x in paired.changed(pairs).collect()) == [(1, "regression"), (2, "improvement"), (3, "improvement")]
    for other, message in ((b.where("id < 3"), "only the baseline"), (b.union(b.where("id = 1").selectExpr("9L", "exact", "valid", "source", "c")), "only the candidate"), (b.withColumn("c", F.lit("y")), "clusters differ"), (b.union(b), "repeated id")):
        with pytest.raises(Exception, match=message):
            paired.paired(a, other, "id", "exact", "valid", ["source"], "c").collect()


def test_resampling_by_array_is_as_by_join(spark):
    units = spark.createDataFrame([(i, float(i * i % 7)) for i in range(40)], "ord long, v double")
    ways = [sorted(tuple(r) for r in stats.bootstrap(units, "v", "ord", 40, 25, 3, most).collect()) for most in (0, 100)]
    assert [(i, round(m, 9)) for i, m in ways[0]] == [(i, round(m, 9)) for i, m in ways[1]] and len(ways[0]) == 25


def test_numbers_of_draws_are_those_of_sha1():
    plain = lambda seed, i: int(hashlib.sha1(f"{seed}:{i}".encode()).hexdigest()[:12], 16)
    for seed in (17, "s", "", "é", -3, "x" * 40, "x" * 60):
        for first, last in ((0, 12), (9_990, 10_011), (99_995, 100_004), (19_998, 40_003), (999_999_999, 1_000_000_001), (123_456_789_012, 123_456_789_015), (7, 7)):
            got = draws.hash_numbers(seed, first, last)
            assert len(got) == last - first and all(int(got[i]) == plain(seed, first + i) for i in {*range(0, last - first, 997), *range(min(13, last - first)), *range(max(0, last - first - 5), last - first)}), (seed, first)


def test_samples_share_the_draws(spark, monkeypatch):
    monkeypatch.setattr(stats, "LEAST_DRAWS", 10_000)  # ranges that cut iterations
    a = [(i, float(i * i % 7), None if i % 5 == 0 else float(i)) for i in range(40)]
    b = [(i, float(i % 3 - 1), 1.0) for i in range(37)]
    kind = "ord long, v double, w double"
    samples = [(spark.createDataFrame(rows, kind), "ord", len(rows), {"v": 3, "w": 4}) for rows in (a, b)]
    want = {}
    for k, rows in enumerate((a, b)):
        for c, v, seed in ((1, "v", 3), (2, "w", 4)):
            for i in range(1000):
                drawn = [rows[int(hashlib.sha1(f"{seed}:{i * len(rows) + j}".encode()).hexdigest()[:12], 16) % len(rows)][c] for j in range(len(rows))]
                drawn = [x for x in drawn if x is not None]
                want[k, v, i] = sum(drawn) / len(drawn)
    for most in (100, 38, 0):  # by arrays, by both ways, by joins
        got = {(r["sample"], r["value"], r["iteration"]): r["mean"] for r in stats.bootstraps(samples, 1000, most).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert stats.bootstraps([(samples[0][0].limit(0), "ord", 0, {"v": 3})], 10).collect() == []


def test_reports_draw_once_and_read_pairs_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    kind = "id long, cluster string, a int, b int, va int, vb int"
    rows = [(i, str(i // 3), i % 2, i % 3 // 2, 1, i % 5 // 4) for i in range(60)]
    one = spark.createDataFrame(rows, kind).mapInArrow(count, kind)
    both = paired.reports([(one, True), (spark.createDataFrame(rows[:50], kind), False)], iterations=200)
    assert both._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = [tuple(r)[1:] for r in both.orderBy("run").collect()]
    assert seen.value == 60
    alone = [tuple(paired.report(spark.createDataFrame(r, kind), c, iterations=200).first()) for r, c in ((rows, True), (rows[:50], False))]
    assert got == alone and got[0][:2] == (60, 20) and got[1][:2] == (50, 50) and got[0][-2] is None and got[1][-2] is not None


def test_image_modes_and_the_deletion_plan(spark):
    modes = spark.createDataFrame([("a", "RGB"), ("b", "P"), ("c", "I;16L"), ("d", None), ("e", "L")], "path string, mode string")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e"), (6, "gone"), (7, "b"), (8, None)], "i int, image string")
    kept, plan = shape.unwanted_images(rows, modes, "image")
    assert values(kept, "i") == [(1,), (4,), (5,)]
    assert sorted(((r["image"] or "", r["action"], r["n_rows"]) for r in plan.collect())) == [("", "missing", 1), ("b", "default_delete", 2), ("c", "default_delete", 1), ("gone", "missing", 1)]


def test_entities_close_over_chains_and_shared_keys(spark):
    """Against a plain union of sets; null and empty keys join nothing."""
    import random

    r = random.Random(9)
    rows = [(i, r.choice(["", None, f"a{r.randint(0, 30)}"]), r.choice([None, f"b{r.randint(0, 30)}"])) for i in range(60)]
    rows += [(100 + i, f"c{i}", f"c{i + 1}") for i in range(12)] + [(200 + i, f"d{i // 2}", f"e{(i + 1) // 2}") for i in range(40)] + [(300 + i, "hot", None) for i in range(30)]
    label = {i: i for i, _, _ in rows}
    changed = True
    while changed:
        changed = False
        for k in (1, 2):
            least = {}
            for x in rows:
                if x[k]:
                    least[x[k]] = min(least.get(x[k], 1 << 60), label[x[0]])
            for x in rows:
                if x[k] and least[x[k]] < label[x[0]]:
                    label[x[0]], changed = least[x[k]], True
    got = graph.entity_closure(spark.createDataFrame(rows, "row long, a string, b string"), "row", ["a", "b"])
    assert {x["row"]: x["closure"] for x in got.collect()} == label and got.count() == len(rows)
    assert graph.entity_closure(spark.createDataFrame([], "row long, a string"), "row", ["a"]).count() == 0


def test_splits_that_tear_an_entity_fail(spark):
    df = spark.createDataFrame([(1, "x", "train"), (2, "x", ""), (3, "y", " Eval ")], "row long, k string, s string")
    got = graph.checked_splits(df, "row", ["k"], "s", F.lit("train"))
    assert values(got, "row", "closure", "split") == [(1, 1, "train"), (2, 1, "train"), (3, 3, "eval")]
    with pytest.raises(Exception, match="entity of row 1 is in several splits"):
        graph.checked_splits(df, "row", ["k"], "s", F.lit("eval")).collect()


def test_export_in_one_pass(spark, tmp_path):
    """The counts of the writer are those of the files and of the report, and no entity is in two outputs."""
    import random

    r = random.Random(2)
    rows = [
        (i, r.choice(["public"] * 8 + ["manifest", "eval"]), f"id{i}", f"img{r.randint(0, 150)}", f"key{r.randint(0, 150)}" + "@" * (i % 5 == 0), r.choice("ab"), r.choice([None, "val", "test", "TRAIN", "odd"]), r.choice([None, 1, 2]), None if i % 17 else "bad")
        for i in range(160)
    ]
    df = spark.createDataFrame(rows, "row long, origin string, id string, image string, key string, source string, split string, repeat_hint int, problem string")
    plan = export.planned(df, 0.2, 5)
    assert plan.count() == 160
    sides = {}
    for x in plan.where("output in ('train', 'val', 'competition_eval', 'auxiliary_eval')").collect():
        for k in (x["image"], x["key"]):
            sides.setdefault(k, set()).add("eval" if x["output"].endswith("eval") else x["output"])
    assert all(len(s) == 1 for s in sides.values()) and {"train", "val", "eval"} == set().union(*sides.values())
    full = export.expanded(plan, export.Repeats(stereo=3))
    assert {x["n"] for x in full.where("output = 'train' and contains(key, '@')").groupBy("row").agg(F.count(F.lit(1)).alias("n")).collect()} <= {3}
    counts = export.write_export(full, str(tmp_path / "out"), "Read it.")
    files = {x["output"]: x["count"] for x in spark.read.json(str(tmp_path / "out")).groupBy("output").count().collect()}
    assert {k: v for k, v in counts.items() if v} == files == {x["output"]: x["n"] for x in export.export_report(full).groupBy("output").agg(F.sum("n").alias("n")).collect()}
    one = spark.read.json(str(tmp_path / "out")).where("output = 'val'").first()["record"]
    assert one["text_info"][0]["tag"] == "mask" and one["text_info"][1]["tag"] == "no_mask" and one["image_info"][0]["matched_text_index"] == 0


@pytest.mark.parametrize("bits", [1 << 15, 1 << 22])
def test_overlaps_lose_nothing(spark, bits):
    rows = spark.range(3000).select(F.col("id").alias("row"), F.when(F.col("id") % 11 != 0, F.concat(F.lit("k"), F.col("id") % 900)).alias("a"), F.col("id").cast("string").alias("b"))
    index = spark.range(400).select(F.lit("a").alias("kind"), F.concat(F.lit("k"), F.col("id") * 3).alias("value")).unionByName(spark.range(500).select(F.lit("b").alias("kind"), (F.col("id") * 2).cast("string").alias("value")))
    got = qc.overlaps(rows, "row", {"a": "a", "b": "b"}, index, bits)
    a, b = {f"k{i * 3}" for i in range(400)}, {str(i * 2) for i in range(500)}
    assert all(r["in_a"] == (r["a"] in a) and r["in_b"] == (r["b"] in b) for r in got.collect()) and got.count() == 3000
    assert not any(r["in_a"] or r["in_b"] for r in qc.overlaps(rows, "row", {"a": "a", "b": "b"}, index.limit(0), bits).collect())


def test_water_fills_short_strata(spark):
    import random

    r = random.Random(6)
    for target in (0, 1, 7, 40, 1000):
        sizes = [(f"s{i}", r.choice([1, 2, 3, 10, 30])) for i in range(9)]
        got = {x["s"]: x["quota"] for x in sample.water_filled(spark.createDataFrame(sizes, "s string, n long"), "s", "n", target).collect()}
        want, left = {s: 0 for s, _ in sizes}, min(target, sum(n for _, n in sizes))
        while left >= (open_ := sum(want[s] < n for s, n in sizes)) > 0:
            for s, n in sizes:
                if want[s] < n:
                    want[s], left = want[s] + 1, left - 1
        assert sum(got.values()) == min(target, sum(n for _, n in sizes)) and all(0 <= got[s] - want[s] <= 1 and got[s] <= n for s, n in sizes)


@pytest.mark.parametrize("target,per_group,least", [(5, 2, 2), (30, 3, 4), (10_000, 2, 3), (1, 1, 50)])
def test_group_holdout_is_as_taking_turns(spark, target, per_group, least):
    import hashlib
    import random

    r = random.Random(target)
    rows = [(i, f"g{r.randint(0, 25)}", f"k{r.randint(0, 40)}") for i in range(300)] + [(900, None, "k1"), (901, "g1", None)]
    groups = {}
    for _, g, k in rows:
        if g and k:
            groups.setdefault(g, set()).add(k)
    seen, locked = set(), {}
    for g in sorted(groups, key=lambda g: (hashlib.sha256(f"7|{g}".encode()).hexdigest(), g)):
        if len(seen) >= target and len(locked) >= least:
            break
        if new := [k for k in sorted(groups[g]) if k not in seen][:per_group]:
            locked[g] = new
            seen.update(new)
    got = sample.group_holdout(spark.createDataFrame(rows, "i long, g string, k string"), "g", "k", target, per_group, least, 7).collect()
    assert len(got) == len(rows)
    mine = sorted((x["g"], x["k"]) for x in got if x["split"] == "locked")
    assert mine == sorted((g, k) for g, ks in locked.items() for k in ks)
    for x in got:
        if x["split"] != "locked":
            assert x["split"] == ("excess" if x["g"] in locked or x["k"] in seen else "train")


def test_choice_gradient_is_as_by_rows(spark):
    import random

    import numpy as np

    r = random.Random(3)
    rows = [(i, j == 0 or r.random() < 0.2, 0.5 + i % 3, r.gauss(0, 1), r.choice([0.0, 500.0, 1.0])) for i in range(25) for j in range(r.randint(2, 5))]
    w, x = np.array([0.7, -1.5]), 0.4

    def plain(w):
        total, loss, slope = 0.0, 0.0, np.zeros(2)
        for i in {q[0] for q in rows}:
            mine = [q for q in rows if q[0] == i]
            f, p, g = np.array([q[3:] for q in mine]), np.array([q[1] for q in mine]), mine[0][2]
            s = f @ w
            lse = lambda v: v.max() + np.log(np.exp(v - v.max()).sum())
            one = lse(s) - lse(s[p])
            d = np.exp(s - lse(s)) - np.where(p, np.exp(s - lse(s[p])), 0)
            if (~p).any():
                lead = s[~p].max() - s[p].max()
                one += x * np.logaddexp(0, lead)
                tp, tn = p & (s == s[p].max()), ~p & (s == s[~p].max())
                d = d + x / (1 + np.exp(-lead)) * (tn / tn.sum() - tp / tp.sum())
            total, loss, slope = total + g, loss + g * one, slope + g * (d @ f)
        return loss / total, slope / total

    df = spark.createDataFrame(rows, "id int, p boolean, w double, a double, b double")
    got = learn.choice_gradient(df, "id", "p", "w", ["a", "b"], w.tolist(), x).first()
    loss, slope = plain(w)
    assert got["loss"] == pytest.approx(loss) and [got["a"], got["b"]] == pytest.approx(slope.tolist())
    fitted, losses = learn.fit_choice(df, "id", "p", "w", ["a", "b"], rounds=6, rate=1e-6)
    assert losses[-1] < losses[0] and all(b <= a for a, b in zip(losses, losses[1:])) and len(fitted) == 2


def test_margin_modes(spark):
    rows = [(1, "a", 5.0, 4.0, "b", 3.0, 0.0), (2, "a", 5.0, 4.9, "b", 3.0, 0.0), (3, "a", 3.5, 1.0, "b", 3.0, 4.0), (4, None, None, None, "b", 3.0, None), (5, "b", 3.0, None, "b", 3.0, None), (6, "a", 9.0, None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, policy string, policy_score double, second_score double, fallback string, fallback_score double, spread double")
    picks = {m: [r["selected"] for r in learn.margin_choice(df, m, 0.5).orderBy("id").collect()] for m in ("fallback", "second", "certain")}
    assert picks == {"fallback": ["a", "a", "a", "b", "b", "a"], "second": ["a", "b", "a", "b", "b", "a"], "certain": ["a", "a", "b", "b", "b", "a"]}
    with pytest.raises(ValueError):
        learn.margin_choice(df, "other", 1.0)


def test_candidates_are_dealt_by_their_number(spark, monkeypatch):
    from quernel.plans import base

    lines = spark.range(4000).select((F.col("id") % 900).alias("k"), "id")
    monkeypatch.setattr(base, "TASK_ROWS", 100)
    got = base.dealt(lines, lines.count(), "k")
    assert got.rdd.getNumPartitions() == 40 and got.select("k", F.spark_partition_id().alias("p")).distinct().count() == 900
    assert base.dealt(lines, 1600, "k") is lines
    t = base.Tables(spark, "/root/testdata/sf0.001")
    assert base.candidates(t).rdd.getNumPartitions() == -(-t.lineitem.count() // 100)
