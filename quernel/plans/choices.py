"""Choices among candidates, and preference pairs, as a scan makes them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernel.operators import choose, rank
from quernel.plans.base import Tables, query

#: Lines of an order as candidates: some without a key, a score, an index or a penalty, some in fragments, some marked isomers.
_CANDS = """
ordered as (select *, (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice))::int as place from lineitem),
cands as (select l_orderkey as id, place,
  case when l_quantity <> 13 then l_returnflag || (l_partkey % 2)::varchar || case when l_suppkey % 4 = 0 then '.X' else '' end || case when l_partkey % 5 = 0 then '\\' else '' end end as canonical,
  l_returnflag || repeat('c', (l_partkey % 4)::int) as prediction, case when l_suppkey % 9 <> 0 then l_extendedprice / 1000 end as score,
  case when l_tax > 0 then l_linenumber % 2 end as prompt_index, case when l_discount > 0 then l_linenumber % 3 end as tta_index, case when l_linenumber <> 5 then l_linenumber end as generation_index,
  case when l_partkey % 3 <> 0 then (l_partkey % 11)::int end as penalty from ordered),
led as (select id, canonical, prediction, coalesce(penalty, 0) as penalty from (select *, row_number() over (partition by id, canonical order by coalesce(score, -1e6) desc, coalesce(prompt_index, 99), coalesce(tta_index, 99), coalesce(generation_index, 99), place) as r from cands where canonical is not null) where r = 1),
aggs as (select id, canonical, count(*) as votes, coalesce(max(score), -1e6) as max_score, coalesce(avg(score), -1e6) as mean_score, min(coalesce(prompt_index, 99)) as mp, min(coalesce(tta_index, 99)) as mt, min(coalesce(generation_index, 99)) as mg, min(place) as first_place,
  length(canonical) as heavy, (ascii(canonical) % 3) as charge, 1 + length(canonical) - length(replace(canonical, '.', '')) as fragments, replace(canonical, '\\', '') as skeleton
  from cands where canonical is not null group by 1, 2),
every as (select * from aggs join led using (id, canonical))"""

_CURRENT = "votes desc, max_score desc, penalty, length(prediction), mp, mt, mg, first_place"
_LIGHT = """
s as (select *, votes + 2.0::double * contains(canonical, '.')::int as salted, max_score - 0.02::double * heavy as score from every),
f as (select * from (select *, row_number() over (partition by id order by salted desc, score desc, charge, mp, first_place) as r from s) where r = 1),
i as (select * from (select s.*, f.votes as lead_votes, row_number() over (partition by s.id order by s.votes desc, s.score desc, s.mg, s.first_place) as r from s join f on f.id = s.id and f.skeleton = s.skeleton where contains(s.canonical, '\\')) where r = 1),
light as (select id, coalesce(i.canonical, f.canonical) as canonical from f left join i using (id) where i.votes is null or i.votes >= i.lead_votes * 0.25::double
  union all select f.id, f.canonical from f join i using (id) where i.votes < i.lead_votes * 0.25::double)"""
_SOFT = "soft as (select id, canonical from (select *, row_number() over (partition by id order by max_score + 0.5::double * votes - 0.006::double * heavy desc, charge, fragments, mp, mg, first_place) as r from every) where r = 1)"
_SHOWN = "id, canonical, votes, round(max_score, 6) as max_score, prediction"


def _place():
    from pyspark.sql import Window as W

    return F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))


def _cands(t: Tables):
    k, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    key = F.concat("l_returnflag", (k % 2).cast("string"), F.when(s % 4 == 0, ".X").otherwise(""), F.when(k % 5 == 0, "\\").otherwise(""))
    return t.lineitem.select(
        F.col("l_orderkey").alias("id"), _place().alias("place"), F.when(F.col("l_quantity") != 13, key).alias("canonical"), F.concat("l_returnflag", F.repeat(F.lit("c"), (k % 4).cast("int"))).alias("prediction"),
        F.when(s % 9 != 0, F.col("l_extendedprice") / 1000).alias("score"), F.when(F.col("l_tax") > 0, n % 2).alias("prompt_index"), F.when(F.col("l_discount") > 0, n % 3).alias("tta_index"),
        F.when(n != 5, n).alias("generation_index"), F.when(k % 3 != 0, (k % 11).cast("int")).alias("penalty"),
    )


def _shown(df):
    return df.select("id", "canonical", "votes", F.round("max_score", 6).alias("max_score"), F.col("representative.prediction").alias("prediction"))


_HEAVY, _CHARGE = F.length, lambda c: F.ascii(c) % 3


def _fragments(c: str):
    return F.length(c) - F.length(F.replace(F.col(c), F.lit("."), F.lit(""))) + 1


def _light(aggs):
    return choose.light(aggs, _HEAVY("canonical"), _CHARGE("canonical"), F.replace(F.col("canonical"), F.lit("\\"), F.lit("")))


def _picked(aggs, **orders):
    """The current and the light choice of each sample, and those by more orders, in one pass."""
    marked = choose.light_marked(aggs, _HEAVY("canonical"), _CHARGE("canonical"), F.replace(F.col("canonical"), F.lit("\\"), F.lit("")))
    return choose.picked(marked, {"selected": choose.current_order(), **orders})


def _soft(aggs):
    return choose.soft(aggs, _HEAVY("canonical"), _CHARGE("canonical"), _fragments("canonical"), count_bonus=0.5)


@query("candidate_representatives", f"with {_CANDS} select id, canonical, votes, round(max_score, 6) as max_score, round(mean_score, 9) as mean_score, mp::int as min_prompt_index, mt::int as min_tta_index, mg::int as min_generation_index, prediction, penalty from every")
def candidate_representatives(spark, sf):
    a = choose.aggregates(_cands(Tables(spark, sf)))
    r = F.col("representative")
    return a.select("id", "canonical", "votes", F.round("max_score", 6).alias("max_score"), F.round("mean_score", 9).alias("mean_score"), "min_prompt_index", "min_tta_index", "min_generation_index", r["prediction"].alias("prediction"), F.coalesce(r["penalty"], F.lit(0)).alias("penalty"))


@query("rerank_current", f"with {_CANDS} select {_SHOWN} from (select *, row_number() over (partition by id order by {_CURRENT}) as r from every) where r = 1")
def rerank_current(spark, sf):
    return _shown(choose.current(choose.aggregates(_cands(Tables(spark, sf)))))


@query("rerank_two_stage", f"with {_CANDS}, {_LIGHT} select {_SHOWN} from light join every using (id, canonical)")
def rerank_two_stage(spark, sf):
    return _shown(_light(choose.aggregates(_cands(Tables(spark, sf)))))


@query("rerank_soft", f"with {_CANDS}, {_SOFT} select {_SHOWN} from soft join every using (id, canonical)")
def rerank_soft(spark, sf):
    return _shown(_soft(choose.aggregates(_cands(Tables(spark, sf)))))


@query("rerank_hybrid", f"""with {_CANDS}, {_LIGHT}, {_SOFT},
g as (select o_orderkey as id, contains(lower(o_orderkey || ' ' || case when o_custkey % 3 = 0 then 'Chinese_Exam' when o_custkey % 7 = 0 then 'x exam_Q1 x' else 'exam' end || ' ' || o_orderpriority), 'chinese_exam')
  or contains(lower(o_orderkey || ' ' || case when o_custkey % 3 = 0 then 'Chinese_Exam' when o_custkey % 7 = 0 then 'x exam_Q1 x' else 'exam' end || ' ' || o_orderpriority), 'exam_q1') as gate from orders)
select {_SHOWN} from (select id, canonical from light join g using (id) where not gate union all select id, canonical from soft join g using (id) where gate) join every using (id, canonical)""")
def rerank_hybrid(spark, sf):
    t = Tables(spark, sf)
    kind = F.when(F.col("o_custkey") % 3 == 0, "Chinese_Exam").when(F.col("o_custkey") % 7 == 0, "x exam_Q1 x").otherwise("exam")
    gates = t.orders.select(F.col("o_orderkey").alias("id"), choose.soft_page(F.col("o_orderkey"), kind, F.col("o_orderpriority")).alias("gate"))
    return _shown(choose.hybrid(choose.aggregates(_cands(t)), gates, _light, _soft))


# Preference pairs: each order is a line of one of three runs, its lines are its candidates

_DPO = """
ordered as (select *, (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice))::int as place from lineitem),
bench as (select o_orderkey as id, o_orderpriority as source, case when o_custkey % 13 <> 0 then ['A0', 'N1', 'R2', 'A3'][o_custkey % 4 + 1] end as target from orders where o_custkey % 11 <> 0 and o_orderpriority <> '5-LOW'),
lines as (select o_orderkey as id, case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end as run_index, o_orderkey as line_no, case when o_custkey % 10 = 0 then 'P0' else 'P' || (o_custkey % 2) end as prompt, (o_custkey % 3)::int as row_votes,
  case when o_custkey % 5 <> 0 then ['A0', 'N1', 'R2', 'A3'][o_custkey % 3 + 1] else '' end as selected, case when o_custkey % 17 = 0 then 'raw' else '' end as selected_raw from orders),
pool as (
  select id, 0 as place, selected as prediction, null as given, selected_raw as raw, row_votes as votes, 999 as p, 999 as t, 999 as g from lines where selected <> '' or selected_raw <> ''
  union all
  select l.id, place, l_returnflag || (l_partkey % 6)::varchar, case when l_suppkey % 5 <> 0 then lower(l_returnflag) || (l_partkey % 6)::varchar end, l_linestatus, coalesce(case when l_tax > 0 then (l_quantity % 4)::int end, row_votes),
    coalesce(l_linenumber % 2, 999), coalesce(case when l_suppkey % 3 > 0 then l_linenumber % 3 end, 999), l_linenumber
  from ordered join lines l on l.id = l_orderkey where 'P' || (l_linenumber % 2) = l.prompt),
shaped as (select pool.*, coalesce(given, case when prediction <> '' and not prediction like '%5' then prediction end) as canonical from pool),
once as (select * from (select *, row_number() over (partition by id, prediction, coalesce(canonical, ''), raw order by place) as r from shaped) where r = 1),
chosen as (select * from (select o.*, row_number() over (partition by o.id order by (canonical is not null) desc, votes desc, abs(length(prediction) - length(target)), p, t, g, length(prediction), prediction desc, place) as q
  from once o join bench b using (id) where target is not null and prediction <> '' and canonical is distinct from target) where q = 1),
scan as (select l.id, l.run_index, l.line_no, b.source, b.target, c.prediction as rejected, c.votes, case when c.canonical is not null then 'valid_wrong' else 'invalid_wrong' end as kind, (c.prediction is not null)::int as made from lines l join bench b using (id) left join chosen c using (id)),
s1 as (select *, coalesce(sum(made) over (partition by source order by run_index, line_no rows between unbounded preceding and 1 preceding), 0) >= {per_source} as over_source from scan),
s2 as (select *, case when over_source then 0 else made end as kept from s1),
s3 as (select *, coalesce(sum(kept) over (order by run_index, line_no rows between unbounded preceding and 1 preceding), 0) >= {total} as over_all from s2)
select id, source, case when over_all then 'total_cap' when over_source then 'source_cap' when made = 1 then 'kept' when target is null then 'missing_target' else 'no_rejected' end as status,
  case when not over_all and not over_source and made = 1 then rejected end as rejected, case when not over_all and not over_source and made = 1 then votes::int end as votes, case when not over_all and not over_source and made = 1 then kind end as negative_kind from s3"""


def _rows(t: Tables):
    from pyspark.sql import Window as W

    n = F.col("l_linenumber")
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    number = (F.col("l_partkey") % 6).cast("string")
    one = F.struct(
        F.concat(F.lit("P"), (n % 2).cast("string")).alias("prompt"), F.concat("l_returnflag", number).alias("prediction"), F.when(F.col("l_suppkey") % 5 != 0, F.concat(F.lower("l_returnflag"), number)).alias("canonical_prediction"),
        F.col("l_linestatus").alias("raw_text"), F.when(F.col("l_tax") > 0, (F.col("l_quantity") % 4).cast("int")).alias("vote_count"), (n % 2).alias("prompt_index"), F.when(F.col("l_suppkey") % 3 > 0, n % 3).alias("tta_index"), n.alias("generation_index"),
    )
    placed = t.lineitem.select(F.col("l_orderkey").alias("id"), F.row_number().over(w).alias("place"), one.alias("c"))
    lists = placed.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "c"))), lambda e: e["c"]).alias("candidates"))
    c = F.col("o_custkey")
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    null = lambda kind: F.lit(None).cast(kind)
    selected = F.struct(
        null("string").alias("prompt"), F.when(c % 5 != 0, pick(("A0", "N1", "R2", "A3"), c % 3)).alias("prediction"), null("string").alias("canonical_prediction"), F.when(c % 17 == 0, " raw ").alias("raw_text"),
        (c % 3).cast("int").alias("vote_count"), null("int").alias("prompt_index"), null("int").alias("tta_index"), null("int").alias("generation_index"),
    )
    run = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    rows = t.orders.select(F.col("o_orderkey").alias("id"), run.alias("run_index"), F.col("o_orderkey").alias("line_no"), F.when(c % 10 != 0, F.concat(F.lit("P"), (c % 2).cast("string"))).alias("prompt"), selected.alias("selected"))
    bench = t.orders.where(c % 11 != 0).select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("source"), F.when(c % 13 != 0, pick(("A0", "N1", "R2", "A3"), c % 4)).alias("target"))
    return rows.join(lists, "id", "left"), bench


@query("dpo_pairs", f"with {_DPO.format(per_source=400, total=1500)}")
def dpo_pairs(spark, sf):
    rows, bench = _rows(Tables(spark, sf))
    canonical = lambda c: F.when(~F.endswith(c, F.lit("5")), c)
    found = choose.preference_pairs(rows, bench, canonical, "P0", 400, 1500, exclude=["5-LOW"])
    kept = F.when(F.col("status") == "kept", F.col("rejected"))
    return found.select("id", "source", "status", kept["prediction"].alias("rejected"), kept["vote_count"].alias("votes"), kept["negative_kind"].alias("negative_kind"))


@query("running_counts", """
select event_id, (sum((value > 50)::int) over (partition by event_type order by ts::date, event_id))::bigint as so_far, (sum(1) over (order by ts::date, event_id))::bigint as place from events""")
def running_counts(spark, sf):
    e = Tables(spark, sf).events.withColumns({"big": (F.col("value") > 50).cast("long"), "one": F.lit(1).cast("long"), "day": F.to_date("ts")})
    r = rank.running(e, "event_type", "day", "event_id", "big", "so_far", 500)
    return rank.running(r, None, "day", "event_id", "one", "place", 500).select("event_id", "so_far", "place")
