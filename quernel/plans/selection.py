"""Candidates, fusion, preference pairs, policies, routing, statistics, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernel.functions import numbers
from quernel.operators import candidates as cand
from quernel.operators import learn, rank, route, stats
from quernel.plans.base import CANDIDATES, Tables, candidates, query, truth
from quernel.sources.sinks import new_rows, upserted

_BEST = "select * from (select *, row_number() over (partition by id order by {order}) as r from {table}) where r = 1"
_CURRENT = "votes desc, max_score desc, min_index, canonical"


def _pick(df):
    return df.select("id", "canonical", "votes", "max_score")


@query("candidate_aggregate", f"with {CANDIDATES} select id, canonical, votes, max_score, round(mean_score, 6) as mean_score, min_index, n_runs from agg")
def candidate_aggregate(spark, sf):
    a = cand.aggregate(candidates(Tables(spark, sf)), runs="run")
    return a.select("id", "canonical", "votes", "max_score", F.round("mean_score", 6).alias("mean_score"), "min_index", "n_runs")


@query("argmax_lexicographic", f"with {CANDIDATES} select id, canonical, score, candidate_index from ({_BEST.format(order='penalty, score desc, canonical, candidate_index', table='cands')})")
def argmax_lexicographic(spark, sf):
    return rank.best(candidates(Tables(spark, sf)), "id", [F.col("penalty"), F.col("score").desc(), F.col("canonical"), F.col("candidate_index")]).select("id", "canonical", "score", "candidate_index")


@query("topk_negatives", f"""with {CANDIDATES}
select id, canonical, max_score, r::int as r from (select a.*, row_number() over (partition by a.id order by votes desc, max_score desc, canonical) as r from agg a join truth using (id) where canonical <> truth) where r <= 3""")
def topk_negatives(spark, sf):
    t = Tables(spark, sf)
    wrong = cand.aggregate(candidates(t)).join(truth(t), "id").where("canonical <> truth")
    return rank.ranked(wrong, "id", [F.col("votes").desc(), F.col("max_score").desc(), F.col("canonical")], "r").where("r <= 3").select("id", "canonical", "max_score", "r")


@query("positives_then_fill", f"""with {CANDIDATES}
select id, canonical, positive from (select a.id, canonical, canonical = truth as positive, row_number() over (partition by a.id order by (canonical = truth) desc, max_score desc, canonical) as r from agg a join truth using (id)) where positive or r <= 3""")
def positives_then_fill(spark, sf):
    t = Tables(spark, sf)
    a = cand.aggregate(candidates(t)).join(truth(t), "id").withColumn("positive", F.col("canonical") == F.col("truth"))
    return rank.positives_then_fill(a, "id", "positive", [F.col("max_score").desc(), F.col("canonical")], 3).select("id", "canonical", "positive")


@query("sibling_features", f"""with {CANDIDATES},
o as (select *, votes::double / sum(votes) over (partition by id) as vote_share, row_number() over (partition by id order by max_score desc) as r from agg),
two as (select id, max(case when r = 1 then max_score end) as best, max(case when r = 2 then max_score end) as second from o group by 1)
select o.id, canonical, round(vote_share, 9) as vote_share, round(coalesce(max_score - case when max_score = best then second else best end, 0), 6) as margin, round(ln(1 + votes), 9) as log_votes from o join two using (id)""")
def sibling_features(spark, sf):
    s = rank.sibling_features(cand.aggregate(candidates(Tables(spark, sf))), "id", "votes", "max_score")
    return s.select("id", "canonical", F.round("vote_share", 9).alias("vote_share"), F.round("margin", 6).alias("margin"), F.round("log_votes", 9).alias("log_votes"))


@query("rerank_changes", f"""with {CANDIDATES},
b as ({_BEST.format(order=_CURRENT, table='agg')}), a as ({_BEST.format(order='max_score desc, votes desc, canonical', table='agg')}),
j as (select t.id, b.canonical is distinct from a.canonical as ch, coalesce(b.canonical = truth, false) as was, coalesce(a.canonical = truth, false) as now from truth t left join b on b.id = t.id left join a on a.id = t.id)
select count(*) as n, sum(ch::int)::bigint as changed, sum((not was and now)::int)::bigint as good, sum((was and not now)::int)::bigint as bad, sum(was::int)::bigint as right_before, sum(now::int)::bigint as right_after from j""")
def rerank_changes(spark, sf):
    t = Tables(spark, sf)
    a = cand.aggregate(candidates(t))
    return cand.changes(cand.rerank(a, "current"), cand.rerank(a, "score"), truth(t))


@query("pool_merge", f"""with {CANDIDATES}
select id, run, count(*) as n_candidates, count(distinct canonical) as n_keys from cands group by 1, 2""")
def pool_merge(spark, sf):
    c = candidates(Tables(spark, sf))
    pool = cand.pooled({name: c.where(F.col("run") == name).drop("run") for name in ("even", "odd")})
    return pool.groupBy("id", "run").agg(F.count(F.lit(1)).alias("n_candidates"), F.count_distinct("canonical").alias("n_keys"))


def _fusion(name: str, strategy: str, order: str, table: str = "agg", more: str = "", **options):
    @query(name, f"with {CANDIDATES}{more} select id, canonical, votes, max_score from ({_BEST.format(order=order, table=table)})")
    def run(spark, sf):
        return _pick(cand.fused(candidates(Tables(spark, sf)), strategy, **options))


_fusion("fuse_vote", "current", _CURRENT)
_fusion("fuse_score", "score", "max_score desc, votes desc, canonical")
_fusion("fuse_domain", "runs", "n_runs desc, votes desc, max_score desc, canonical")
_fusion("fuse_penalty", "penalty", "penalty, max_score desc, canonical", "x", ", x as (select agg.*, p.penalty from agg join (select id, canonical, min(penalty) as penalty from cands group by 1, 2) p using (id, canonical))")
_fusion("fuse_weighted", "weighted", "weight desc, max_score desc, canonical", "x", ", x as (select agg.*, p.weight from agg join (select id, canonical, round(sum(case run when 'even' then 1.5 else 1.0 end), 9) as weight from cands group by 1, 2) p using (id, canonical))", weights={"even": 1.5})


@query("oracle_headroom", f"""with {CANDIDATES},
s as ({_BEST.format(order=_CURRENT, table='agg')}),
h as (select c.id, max((c.canonical = truth)::int) as oracle from cands c join truth using (id) group by 1),
j as (select panel, coalesce((s.canonical = truth)::int, 0) as rgt, coalesce(oracle, 0) as oracle from truth t left join s on s.id = t.id left join h on h.id = t.id)
select panel, count(*) as n, sum(rgt)::bigint as n_right, sum(oracle)::bigint as n_oracle, round((sum(oracle) - sum(rgt))::double / count(*), 9) as headroom from j group by 1""")
def oracle_headroom(spark, sf):
    t = Tables(spark, sf)
    c, tr = candidates(t), truth(t)
    h = cand.headroom(c, cand.rerank(cand.aggregate(c), "current"), tr).join(tr.select("id", "panel"), "id")
    n = F.count(F.lit(1))
    return h.groupBy("panel").agg(n.alias("n"), F.sum("right").alias("n_right"), F.sum("oracle").alias("n_oracle"), F.round((F.sum("oracle") - F.sum("right")) / n, 9).alias("headroom"))


@query("augment_variants", f"""with {CANDIDATES},
v as (select distinct id, 'N' || substr(canonical, 2) as canonical from cands where substr(canonical, 1, 1) <> 'N'),
n as (select * from v where not exists (select 1 from cands c where c.id = v.id and c.canonical = v.canonical))
select is_variant, count(*) as n, count(distinct id) as n_samples from (select id, false as is_variant from cands union all select id, true from n) group by 1""")
def augment_variants(spark, sf):
    c = candidates(Tables(spark, sf))
    v = cand.with_variants(c, F.concat(F.lit("N"), F.substring("canonical", 2, 9)))
    return v.groupBy("is_variant").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_samples"))


_MINED = f"""{CANDIDATES},
k as (select agg.*, truth, row_number() over (partition by id order by {_CURRENT}) as vr, row_number() over (partition by id order by max_score desc, votes desc, canonical) as sr from agg join truth using (id)),
w as (select *, case when vr = 1 then 1 when sr = 1 then 2 else 3 end as priority from k where canonical <> truth),
c as (select *, row_number() over (partition by id order by priority, votes desc, max_score desc, canonical) as r from w),
mined as (select c.id, ['voted_wrong', 'scored_wrong', 'hard_negative'][priority] as pair_type, priority, p.canonical as chosen, c.canonical as rejected, c.votes, c.max_score from c join (select id, canonical from k where canonical = truth) p on p.id = c.id where r <= 4)"""


@query("mine_pairs", f"with {_MINED} select id, pair_type, priority::int as priority, chosen, rejected from mined")
def mine_pairs(spark, sf):
    t = Tables(spark, sf)
    return cand.mined_pairs(cand.aggregate(candidates(t)), truth(t), 4)


@query("pos_neg_pairs", f"""with {CANDIDATES}
select p.id, count(*) as n_pairs from (select id, canonical from agg join truth using (id) where canonical = truth) p join (select id, canonical from agg join truth using (id) where canonical <> truth) q using (id) group by 1""")
def pos_neg_pairs(spark, sf):
    t = Tables(spark, sf)
    k = cand.aggregate(candidates(t)).join(truth(t), "id")
    right, wrong = k.where("canonical = truth").select("id"), k.where("canonical <> truth").select("id")
    return right.join(wrong, "id").groupBy("id").agg(F.count(F.lit(1)).alias("n_pairs"))


@query("pair_double_join", f"""with {_MINED},
j as (select m.*, a.min_index as ci, b.min_index as ri from mined m left join agg a on a.id = m.id and a.canonical = m.chosen and a.n_runs > 1 left join agg b on b.id = m.id and b.canonical = m.rejected and b.n_runs > 1)
select case when ci is null then 'chosen_missing' when ri is null then 'rejected_missing' else 'kept' end as reason, count(*) as n from j group by 1""")
def pair_double_join(spark, sf):
    t = Tables(spark, sf)
    a = cand.aggregate(candidates(t), runs="run")
    pairs = cand.mined_pairs(a, truth(t), 4)
    two = a.where("n_runs > 1")
    j = pairs.join(two.select("id", F.col("canonical").alias("chosen"), F.col("min_index").alias("ci")), ["id", "chosen"], "left").join(two.select("id", F.col("canonical").alias("rejected"), F.col("min_index").alias("ri")), ["id", "rejected"], "left")
    return j.groupBy(F.when(F.col("ci").isNull(), "chosen_missing").when(F.col("ri").isNull(), "rejected_missing").otherwise("kept").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("merge_pairs", f"""with {_MINED},
u as (select id, pair_type, priority, chosen, rejected, 0 as source_index from mined union all select id, pair_type, priority + 1, chosen, rejected, 1 from mined where priority = 1)
select pair_type, priority::int as priority, source_index, count(*) as n from (select *, row_number() over (partition by id, chosen, rejected order by priority, source_index, pair_type) as r from u) where r = 1 group by 1, 2, 3""")
def merge_pairs(spark, sf):
    t = Tables(spark, sf)
    m = cand.mined_pairs(cand.aggregate(candidates(t)), truth(t), 4)
    again = m.where("priority = 1").withColumn("priority", F.col("priority") + 1)
    return cand.merged_pairs(m, again).groupBy("pair_type", "priority", "source_index").agg(F.count(F.lit(1)).alias("n"))


# Policies

_X = "x as (select id, canonical, votes::double as votes, max_score / 10000 as s, min_index::double as m, (canonical = truth)::int::double as y from agg join truth using (id))"


def _features(t: Tables):
    a = cand.aggregate(candidates(t)).join(truth(t), "id")
    return a.select("id", "canonical", F.col("votes").cast("double").alias("votes"), (F.col("max_score") / 10000).alias("s"), F.col("min_index").cast("double").alias("m"), (F.col("canonical") == F.col("truth")).cast("double").alias("y"))


def _gram_sql() -> str:
    names = ["votes", "s", "m"]
    parts = [f"select {i} as i, {j} as j, round(sum({a} * {b}), 2) as value from x" for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    parts += [f"select {i}, -1, round(sum({a} * y), 2) from x" for i, a in enumerate(names)]
    return f"with {CANDIDATES}, {_X} " + " union all ".join(parts)


@query("ridge_gram", _gram_sql())
def ridge_gram(spark, sf):
    g = learn.gram(_features(Tables(spark, sf)), ["votes", "s", "m"], "y")
    return g.select("i", "j", F.round("value", 2).alias("value"))


@query("ridge_weights")
def ridge_weights(spark, sf):
    w = learn.ridge(learn.gram(_features(Tables(spark, sf)), ["votes", "s", "m"], "y"), 3, 1.0)
    return spark.createDataFrame(list(enumerate(w)), "i int, weight double")


@query("policy_rank", f"""with {CANDIDATES}, {_X},
p as (select *, round(0.5 * votes + 0.3 * s - 0.01 * m, 9) as policy_score from x)
select id, canonical, policy_score from ({_BEST.format(order='policy_score desc, canonical', table='p')})""")
def policy_rank(spark, sf):
    return learn.policy_ranked(_features(Tables(spark, sf)), "id", ["votes", "s", "m"], [0.5, 0.3, -0.01], "canonical").select("id", "canonical", "policy_score")


@query("fallback_margin_select", f"""with {CANDIDATES}, {_X},
p as (select *, round(0.5 * votes + 0.3 * s - 0.01 * m, 9) as ps from x),
c as ({_BEST.format(order='ps desc, canonical', table='p')}), f as ({_BEST.format(order='votes desc, m, canonical', table='p')})
select case when c.canonical = f.canonical then 'agreement' when c.ps - f.ps >= 0.25 then 'override' else 'fallback' end as reason, count(*) as n from f join c using (id) group by 1""")
def fallback_margin_select(spark, sf):
    x = _features(Tables(spark, sf)).withColumn("policy_score", learn.policy_score(["votes", "s", "m"], [0.5, 0.3, -0.01]))
    chosen = rank.best(x, "id", [F.col("policy_score").desc(), F.col("canonical")])
    fallback = rank.best(x, "id", [F.col("votes").desc(), F.col("m"), F.col("canonical")])
    return learn.fallback_or_policy(chosen, fallback, 0.25).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("pairwise_policy")
def pairwise_policy(spark, sf):
    x = _features(Tables(spark, sf)).withColumn("positive", F.col("y") == 1)
    w = learn.fit_pairwise(learn.pair_differences(x, "id", "positive", ["votes", "s", "m"], 4), ["votes", "s", "m"])
    return spark.createDataFrame(list(enumerate(w)), "i int, weight double")


@query("head_ensemble", f"""with {CANDIDATES}
select id, canonical, round(avg(score), 6) as mean_score, count(distinct run) as n_models from cands group by 1, 2""")
def head_ensemble(spark, sf):
    e = learn.ensemble(candidates(Tables(spark, sf)), "id", "canonical", "run", "score")
    return e.select("id", "canonical", F.round("mean_score", 6).alias("mean_score"), "n_models")


@query("mlp_scoring", f"""with {CANDIDATES}, {_X}
select id, canonical, round(0.7 * greatest(0.2 * votes + 0.1 * s + 0.05, 0) - 0.4 * greatest(-0.3 * votes + 0.02 * m + 0.5, 0) + 0.1, 9) as score from x""")
def mlp_scoring(spark, sf):
    layers = [([[0.2, 0.1, 0.0], [-0.3, 0.0, 0.02]], [0.05, 0.5]), ([[0.7, -0.4]], [0.1])]
    return learn.mlp_scores(_features(Tables(spark, sf)), ["votes", "s", "m"], layers).select("id", "canonical", F.round("score", 9).alias("score"))


# Routing

_OUT = """
picks as (select * from (select c.*, row_number() over (partition by id, run order by score desc, canonical, candidate_index) as r from cands c) where r = 1),
runs as (select unnest(['even', 'odd']) as run),
outc as (select t.id, t.panel, runs.run, coalesce((p.canonical[1] = t.truth[1])::int, 0) as ok, p.score, (('0x' || substr(sha1('5:' || t.id), 1, 12))::bigint % 5)::int as fold from truth t cross join runs left join picks p on p.id = t.id and p.run = runs.run)"""


def _outcomes(t: Tables):
    from quernel.functions.keys import fold

    c = candidates(t)
    picks = rank.best(c, ["id", "run"], [F.col("score").desc(), F.col("canonical"), F.col("candidate_index")]).select("id", "run", "canonical", "score")
    every = truth(t).withColumn("run", F.explode(F.array(F.lit("even"), F.lit("odd"))))
    right = F.coalesce((F.substring("canonical", 1, 1) == F.substring("truth", 1, 1)).cast("int"), F.lit(0))
    return every.join(picks, ["id", "run"], "left").select("id", "panel", "run", right.alias("right"), "score", fold(5, "id", 5).alias("fold"))


@query("route_by_group", f"""with {CANDIDATES}, {_OUT},
g as (select panel, run, count(*) as n, sum(ok)::bigint as k from outc group by 1, 2)
select panel, case when n >= 10 then run else 'odd' end as choice, n from (select *, row_number() over (partition by panel order by k::double / n desc, run) as r from g) where r = 1""")
def route_by_group(spark, sf):
    return route.best_runs(route.group_rates(_outcomes(Tables(spark, sf)), "panel"), "panel", 10, "odd")


@query("route_cv_shrunk", f"""with {CANDIDATES}, {_OUT},
c as (select panel, fold, run, count(*) as n, sum(ok)::bigint as k from outc group by 1, 2, 3),
folds as (select distinct fold from c), gt as (select panel, run, sum(n) as gn, sum(k) as gk from c group by 1, 2),
bf as (select fold, run, sum(n) as fn, sum(k) as fk from c group by 1, 2), tt as (select run, sum(fn) as tn, sum(fk) as tk from bf group by 1),
z as (select gt.panel, folds.fold, gt.run, gn - coalesce(n, 0) as tn_, gk - coalesce(k, 0) as tk_, (tk - coalesce(fk, 0))::double / (tn - coalesce(fn, 0)) as o
  from gt cross join folds left join c on c.panel = gt.panel and c.fold = folds.fold and c.run = gt.run left join bf on bf.fold = folds.fold and bf.run = gt.run join tt on tt.run = gt.run),
s as (select *, round((tk_ + 20 * o)::double / (tn_ + 20), 9) as rate from z)
select panel, fold, case when tn_ >= 10 then run else 'odd' end as choice from (select *, row_number() over (partition by panel, fold order by rate desc, run) as r from s) where r = 1""")
def route_cv_shrunk(spark, sf):
    return route.cv_choices(_outcomes(Tables(spark, sf)), "panel", "fold", 20.0, 10, "odd")


@query("route_cv_applied")
def route_cv_applied(spark, sf):
    o = _outcomes(Tables(spark, sf))
    chosen = route.cv_choices(o, "panel", "fold", 20.0, 10, "odd")
    return route.routed(o, chosen, ["panel", "fold"], "odd").groupBy("panel").agg(F.count(F.lit(1)).alias("n"), F.sum("right").alias("n_right"))


_PAIRED = f"""{CANDIDATES}, {_OUT},
pr as (select a.id, a.panel, a.fold, coalesce(round(a.score / 100, 0), '-inf'::double) as score, (a.ok - b.ok)::bigint as gain from outc a join outc b on b.id = a.id where a.run = 'even' and b.run = 'odd')"""


def _paired(t: Tables):
    o = _outcomes(t)
    a = o.where("run = 'even'").select("id", "panel", "fold", numbers.score_or_low(F.round(F.col("score") / 100, 0)).alias("score"), F.col("right").alias("a"))
    b = o.where("run = 'odd'").select("id", F.col("right").alias("b"))
    return a.join(b, "id").select("id", "panel", "fold", "score", (F.col("a") - F.col("b")).cast("long").alias("gain"))


@query("threshold_sweep", f"""with {_PAIRED}
select distinct panel, score as threshold, count(*) over w as n_at_or_above, (sum(gain) over w)::bigint as gain from pr where score > '-inf'::double window w as (partition by panel order by score desc range between unbounded preceding and current row)""")
def threshold_sweep(spark, sf):
    return rank.threshold_sweep(_paired(Tables(spark, sf)).where(F.col("score") > float("-inf")), "panel", "score", "gain")


@query("threshold_best", f"""with {_PAIRED},
s as (select distinct panel, score as threshold, (sum(gain) over w)::bigint as gain from pr window w as (partition by panel order by score desc range between unbounded preceding and current row)),
u as (select * from s union all select distinct panel, 'inf'::double, 0::bigint from pr)
select panel, case when threshold = 'inf'::double then -1.0 when threshold = '-inf'::double then -2.0 else threshold end as threshold, gain from (select *, row_number() over (partition by panel order by gain desc, threshold desc) as r from u) where r = 1""")
def threshold_best(spark, sf):
    b = route.best_threshold(_paired(Tables(spark, sf)), "panel", "score", "gain")
    shown = F.when(F.col("threshold") == float("inf"), -1.0).when(F.col("threshold") == float("-inf"), -2.0).otherwise(F.col("threshold"))
    return b.select("panel", shown.alias("threshold"), "gain")


@query("threshold_cv", f"""with {_PAIRED},
o as (select f.i as held, pr.* from pr, (select unnest(range(5))::int as i) f where pr.fold <> f.i),
s as (select distinct held, score as threshold, (sum(gain) over w)::bigint as gain from o window w as (partition by held order by score desc range between unbounded preceding and current row)),
u as (select * from s union all select distinct held, 'inf'::double, 0::bigint from o),
c as (select * from (select *, row_number() over (partition by held order by gain desc, threshold desc) as r from u) where r = 1)
select fold, c.gain as train_gain, sum((score >= threshold)::int)::bigint as test_n, sum(case when score >= threshold then pr.gain else 0 end)::bigint as test_gain from pr join c on c.held = pr.fold group by 1, 2""")
def threshold_cv(spark, sf):
    return route.cv_threshold(_paired(Tables(spark, sf)), "fold", "score", "gain", 5).select("fold", "train_gain", "test_n", "test_gain")


@query("margin_grid", f"""with {_PAIRED}, m as (select unnest([0.0, 100.0, 300.0, 600.0])::double as margin)
select panel, margin, sum((score >= margin)::int)::bigint as n_override, sum(case when score >= margin then gain else 0 end)::bigint as net from pr cross join m group by 1, 2""")
def margin_grid(spark, sf):
    return route.margin_grid(_paired(Tables(spark, sf)), [0.0, 100.0, 300.0, 600.0], "score", F.col("gain"), "panel")


# Statistics

_AB = """
ab as (select user_id, avg(case when event_id % 2 = 0 then value end) as a, avg(case when event_id % 2 = 1 then value end) as b from events group by 1),
u as (select user_id, b - a as delta, row_number() over (order by user_id) - 1 as unit from ab where a is not null and b is not null)"""


def _units(t: Tables):
    e = t.events.groupBy("user_id").agg(F.avg(F.when(F.col("event_id") % 2 == 0, F.col("value"))).alias("a"), F.avg(F.when(F.col("event_id") % 2 == 1, F.col("value"))).alias("b")).where("a is not null and b is not null")
    return rank.ordinal(e.select("user_id", (F.col("b") - F.col("a")).alias("delta")), "user_id").withColumnRenamed("ord", "unit")


@query("cluster_means", """
select user_id, count(*) as n, round(avg(value), 9) as mean_a, round(avg(value * 0.5), 9) as mean_b, round(avg(value * 0.5) - avg(value), 9) as delta from events group by 1""")
def cluster_means(spark, sf):
    c = stats.cluster_means(Tables(spark, sf).events.select("user_id", F.col("value").alias("a"), (F.col("value") * 0.5).alias("b")), "user_id")
    return c.select("user_id", "n", *[F.round(x, 9).alias(x) for x in ("mean_a", "mean_b", "delta")])


@query("paired_bootstrap", f"""with {_AB}, n as (select count(*) as n from u),
d as (select i // n as iteration, ('0x' || substr(sha1('17:' || i), 1, 12))::bigint % n as unit from n, (select unnest(range(10000 * (select n from n))) as i)),
m as (select iteration, avg(delta) as mean from d join u using (unit) group by 1)
select round(quantile_cont(mean, 0.025), 6) as low, round(quantile_cont(mean, 0.975), 6) as high, count(*) as n from m""")
def paired_bootstrap(spark, sf):
    u = _units(Tables(spark, sf))
    return stats.interval(stats.bootstrap(u, "delta", "unit", u.count(), 10_000), 6)


@query("mcnemar_counts", f"""with {CANDIDATES}, {_OUT}, p as (select a.id, a.ok as a, b.ok as b from outc a join outc b on a.id = b.id where a.run = 'even' and b.run = 'odd')
select count(*) as n, sum((a = 1 and b = 1)::int)::bigint as "both", sum((a <> 1 and b = 1)::int)::bigint as wins, sum((a = 1 and b <> 1)::int)::bigint as losses, sum((a <> 1 and b <> 1)::int)::bigint as neither from p""")
def mcnemar_counts(spark, sf):
    o = _outcomes(Tables(spark, sf))
    p = o.where("run = 'even'").select("id", F.col("right").alias("a")).join(o.where("run = 'odd'").select("id", F.col("right").alias("b")), "id")
    return stats.discordance(p)


@query("mcnemar_exact", f"""with {CANDIDATES}, {_OUT}, p as (select a.ok as a, b.ok as b from outc a join outc b on a.id = b.id where a.run = 'even' and b.run = 'odd'),
c as (select sum((a <> 1 and b = 1)::int)::bigint as wins, sum((a = 1 and b <> 1)::int)::bigint as losses from p)
select wins, losses, round(case when wins + losses = 0 then 1.0 else least(1.0, 2 * list_sum(list_transform(range(0, least(wins, losses) + 1), lambda i: exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2.0))))) end, 9) as p from c""")
def mcnemar_exact(spark, sf):
    from quernel.operators.build import mcnemar_p

    return mcnemar_counts(spark, sf).select("wins", "losses", F.round(mcnemar_p("wins", "losses"), 9).alias("p"))


@query("factorial_effects", """
with e as (select user_id % 2 as x, extract(hour from ts) % 2 as y, value from events),
m as (select avg(case when x = 0 and y = 0 then value end) as m00, avg(case when x = 1 and y = 0 then value end) as m10, avg(case when x = 0 and y = 1 then value end) as m01, avg(case when x = 1 and y = 1 then value end) as m11 from e)
select round(m00, 6) as m00, round(m10, 6) as m10, round(m01, 6) as m01, round(m11, 6) as m11, round((m10 + m11 - m00 - m01) / 2, 6) as effect_x, round((m01 + m11 - m00 - m10) / 2, 6) as effect_y, round(m11 - m10 - m01 + m00, 6) as interaction from m""")
def factorial_effects(spark, sf):
    e = Tables(spark, sf).events.select((F.col("user_id") % 2).alias("x"), (F.hour("ts") % 2).alias("y"), "value")
    return stats.factorial(e, "x", "y", "value", 6)


@query("winner_gate", f"""with {CANDIDATES}, {_OUT}, p as (select panel, avg(case when run = 'odd' then ok end) as base, avg(case when run = 'even' then ok end) as cand from outc group by 1)
select round(avg(cand - base), 9) as gain, bool_and(cand - base >= -0.005) as holds, case when bool_and(cand - base >= -0.005) and round(avg(cand - base), 9) >= 0.005 then 'candidate' else 'baseline' end as winner from p""")
def winner_gate(spark, sf):
    o = _outcomes(Tables(spark, sf))
    p = o.groupBy("panel").agg(F.avg(F.when(F.col("run") == "odd", F.col("right"))).alias("base"), F.avg(F.when(F.col("run") == "even", F.col("right"))).alias("cand"))
    return stats.winner(p, "base", "cand", 0.005, 0.005)


@query("near_best_earliest", """
with s as (select event_type as phase, (extract(day from ts))::int as step, round(avg(value), 6) as score from events group by 1, 2)
select phase, step, score from (select *, row_number() over (partition by phase order by step) as r from (select *, max(score) over (partition by phase) as best from s) where score >= best - 1.0) where r = 1""")
def near_best_earliest(spark, sf):
    s = Tables(spark, sf).events.groupBy(F.col("event_type").alias("phase"), F.dayofmonth("ts").alias("step")).agg(F.round(F.avg("value"), 6).alias("score"))
    return rank.near_best_earliest(s, "phase", "score", "step", 1.0).select("phase", "step", "score")


@query("seed_spread", """
select event_type, round(avg(m), 6) as mean, round(coalesce(stddev_samp(m), 0), 6) as sd, count(*) as n from (select event_type, user_id % 3 as seed, avg(value) as m from events group by 1, 2) group by 1""")
def seed_spread(spark, sf):
    m = Tables(spark, sf).events.groupBy("event_type", (F.col("user_id") % 3).alias("seed")).agg(F.avg("value").alias("m"))
    return stats.seeds(m, "event_type", "m").select("event_type", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "n")


@query("upsert_status", """
select c.c_custkey, coalesce(o.o_orderstatus, c.c_mktsegment) as c_mktsegment from customer c left join (select o_custkey, min(o_orderstatus) as o_orderstatus from orders group by 1) o on o.o_custkey = c.c_custkey""")
def upsert_status(spark, sf):
    t = Tables(spark, sf)
    u = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderstatus").alias("c_mktsegment"))
    return upserted(t.customer.select("c_custkey", "c_mktsegment"), u, "c_custkey", ["c_mktsegment"])


@query("append_dedup", """
select count(*) as n from (select distinct doc_id from labels where doc_id not in (select doc_id from documents where lang = 'en'))""")
def append_dedup(spark, sf):
    t = Tables(spark, sf)
    return new_rows(t.documents.where("lang = 'en'").select("doc_id"), t.labels.union(t.labels), "doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("embedding_tanimoto", """
with b as (select vec_id, label, list_transform(embedding, lambda x: (x > 0)::int) as s from embeddings),
p as (select a.vec_id as a, b.vec_id as b, a.s as x, b.s as y from b a join b b on b.vec_id = a.vec_id + 1)
select a, b, round(list_sum(list_transform(list_zip(x, y), lambda z: least(z[1], z[2])))::double / nullif(list_sum(list_transform(list_zip(x, y), lambda z: greatest(z[1], z[2]))), 0), 9) as tanimoto from p""")
def embedding_tanimoto(spark, sf):
    v = Tables(spark, sf).embeddings
    bits = F.transform(F.sequence(F.lit(0), F.floor((F.size("embedding") - 1) / 32).cast("int")), lambda w: F.aggregate(F.slice("embedding", w * 32 + 1, 32), F.lit(0).cast("long"), lambda s, x: s * 2 + (x > 0).cast("long")))
    a = v.select(F.col("vec_id").alias("a"), bits.alias("x"))
    b = v.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), bits.alias("y"))
    return a.join(b, "a").select("a", "b", F.round(numbers.tanimoto("x", "y"), 9).alias("tanimoto"))


# Streams (extras: the windows are ours)


def _stream_folder(spark, sf):
    import uuid

    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quernel-")
    return f"{path.rstrip('/')}/stream-{uuid.uuid4().hex}"


@query("resume_upsert_stream", """
select user_id, event_id from (select *, row_number() over (partition by user_id order by event_id desc) as r from events) where r = 1""")
def resume_upsert_stream(spark, sf):
    from quernel.streaming import upsert as st

    e, folder = Tables(spark, sf).events, _stream_folder(spark, sf)
    e.select("user_id", "event_id").repartition(4, "event_id").write.parquet(f"{folder}/in")
    q = st.upsert(st.stream_of(spark, f"{folder}/in", e.select("user_id", "event_id").schema, 2), f"{folder}/out", f"{folder}/ck", "user_id", "event_id")
    q.awaitTermination()
    return st.latest(spark, f"{folder}/out")


@query("append_dedup_stream", "select distinct user_id from events")
def append_dedup_stream(spark, sf):
    from quernel.streaming import upsert as st

    e, folder = Tables(spark, sf).events.select("user_id", "ts"), _stream_folder(spark, sf)
    e.repartition(2, "user_id").write.parquet(f"{folder}/in")
    q = st.append_new(st.stream_of(spark, f"{folder}/in", e.schema), f"{folder}/out", f"{folder}/ck", "user_id", "ts", "3650 days")
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("user_id")


@query("event_windows", """
select time_bucket(interval '1 day', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2""")
def event_windows(spark, sf):
    from quernel.streaming.upsert import tumbling

    return tumbling(Tables(spark, sf).events, "ts", "1 day", "event_type").withColumn("total", F.round("total", 4))
