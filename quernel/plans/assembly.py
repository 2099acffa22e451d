"""Builds and reports put together: data sets with a held-out side, merged runs, oracle analysis, probes, reviews, evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernel.functions import text
from quernel.operators import assemble, choose
from quernel.operators.build import base_times
from quernel.operators.export import Repeats
from quernel.plans.base import Tables, query
from quernel.plans.choices import _CANDS, _CURRENT, _LIGHT, _cands, _picked

# One build of data sets: documents are figures of papers, of which a target may be missing

_BUILD = """
src as (select doc_id as row, case when doc_id % 3 <> 0 then 'p_' || (doc_id % 37) || '_' || (doc_id % 7) || '_figure_' || doc_id when doc_id % 2 = 0 then 'q' || (doc_id % 23) || '_figure_' || doc_id else 'lone' || (doc_id % 90) end as id,
  case when n_chars % 9 <> 0 then substr(sha1(substr(text, 1, 200)), 1, 10) end as target from documents),
w as (select *, case when regexp_matches(id, '^(.*)_[0-9]+_figure_') then regexp_extract(id, '^(.*)_[0-9]+_figure_', 1) else split_part(id, '_figure_', 1) end as paper from src where row % 4 <> 1),
dev as (select distinct target from src where row % 50 = 3 and target is not null),
free as (select * from w where target is not null and target not in (select target from dev)),
g as (select paper, list_sort(list(distinct target)) as ks, row_number() over (order by sha256('2026|' || paper), paper) as i from free group by 1),
turn as (select 0::bigint as i, []::varchar[] as seen, 0 as n, []::varchar[] as got, null::varchar as paper
  union all select x.i, list_concat(turn.seen, x.new), turn.n + (len(x.new) > 0)::int, x.new, x.paper from turn join lateral (select g.i, g.paper, list_slice(list_filter(g.ks, lambda k: not list_contains(turn.seen, k)), 1, 3) as new from g where g.i = turn.i + 1) x on true where len(turn.seen) < 30 or turn.n < 6),
pick as (select paper, unnest(got) as target from turn where len(got) > 0), taken as (select distinct paper from pick),
sp as (select f.row, f.paper, f.target, case when p.target is not null and row_number() over (partition by f.paper, f.target, p.target is null order by sha256('2026|' || '{"row":' || f.row || ',"paper":"' || f.paper || '","target":"' || f.target || '"}')) = 1 then 'locked'
    when t.paper is not null or f.target in (select target from pick) then 'excess' else 'train' end as split
  from free f left join pick p on p.paper = f.paper and p.target = f.target left join taken t on t.paper = f.paper),
held as (select target from dev union select target from sp where split = 'locked'),
pieces as (
  select row, target, 'base' as piece from src where row % 4 = 1 and target is not null and target not in (select target from held)
  union all select row, target, 'wild' from (select * from sp where split = 'train' order by sha256('2026|' || row), row limit 300)
  union all select row, target, 'variant_0' from src where row % 8 = 1 and target is not null and target not in (select target from held)
  union all select row, target, 'variant_1' from src where row % 8 = 5 and target is not null and target not in (select target from held)),
mixed as (select mixture as output, row, target, piece, sha256(seed || '|' || piece || '|' || row) as order_key from pieces join (values ('A', '21', 'base'), ('D', '22', 'base'), ('D', '22', 'wild'), ('E', '23', 'base'), ('E', '23', 'variant_0'), ('B', '24', 'base'), ('B', '24', 'wild'), ('B', '24', 'variant_0'),
    ('C', '25', 'base'), ('C', '25', 'wild'), ('C', '25', 'variant_0'), ('C', '25', 'variant_1')) as r(mixture, seed, part) on part = piece),
outp as (select output, row, piece from mixed
  union all select 'hard_replay', row, piece from (select row, piece from mixed where output = 'B' and piece <> 'variant_0' and target >= '8' order by sha256('91|' || row), row limit 60)
  union all select 'strict_eval', row, 'wild' from sp where split = 'locked'
  union all select 'symbolic_eval', row, 'wild' from w where target is null and paper in (select paper from taken))"""


def _build(t: Tables):
    n = F.col("doc_id")
    numbered = F.concat(F.lit("p_"), n % 37, F.lit("_"), n % 7, F.lit("_figure_"), n)
    name = F.when(n % 3 != 0, numbered).when(n % 2 == 0, F.concat(F.lit("q"), n % 23, F.lit("_figure_"), n)).otherwise(F.concat(F.lit("lone"), n % 90))
    src = t.documents.select(n.alias("row"), name.alias("id"), F.when(F.col("n_chars") % 9 != 0, F.substring(F.sha1(F.substring("text", 1, 200).cast("binary")), 1, 10)).alias("target"))
    base = src.where("row % 4 = 1")
    variants = base.withColumn("piece", F.when(F.col("row") % 8 == 1, "variant_0").otherwise("variant_1"))
    recipes = {"A": (("base",), 21), "D": (("base", "wild"), 22), "E": (("base", "variant_0"), 23), "B": (("base", "wild", "variant_0"), 24), "C": (("base", "wild", "variant_0", "variant_1"), 25)}
    hard = (F.col("piece") != "variant_0") & (F.col("target") >= "8")
    return assemble.dataset_build(base, src.where("row % 4 <> 1"), src.where("row % 50 = 3").select("target"), variants, recipes, ("B", hard, 60, 91), 30, 3, 6, 300, 2026)


@query("dataset_build", f"with recursive {_BUILD} select output, row, piece from outp")
def dataset_build(spark, sf):
    return _build(Tables(spark, sf))[0].select("output", "row", "piece")


@query("dataset_build_manifest", f"with recursive {_BUILD} select row, paper, case split when 'locked' then 'locked_eval' when 'train' then 'train' else 'held_back' end as split from sp")
def dataset_build_manifest(spark, sf):
    return _build(Tables(spark, sf))[1].select("row", "paper", "split")


@query("dataset_build_report", f"""with recursive {_BUILD}
select output as what, count(*) as n from outp group by 1 union all select 'symbolic_or_invalid', count(*) from w where target is null union all select 'dev_overlap', count(*) from w where target in (select target from dev)
union all select 'base_heldout', count(*) from src where row % 4 = 1 and target in (select target from held) union all select 'papers_locked', count(*) from taken""")
def dataset_build_report(spark, sf):
    return _build(Tables(spark, sf))[2]


# Small rules


@query("paper_groups", """
with x as (select o_orderkey, case o_orderkey % 4 when 0 then 'a_' || o_custkey || '_7_figure_2' when 1 then 'b' || o_custkey || '_figure_' || o_orderkey || '_figure_9' when 2 then 'c_12_figure_1_3_figure_x' else 'plain_' || o_custkey end as id from orders)
select o_orderkey, case when regexp_matches(id, '^(.*)_[0-9]+_figure_') then regexp_extract(id, '^(.*)_[0-9]+_figure_', 1) else split_part(id, '_figure_', 1) end as paper from x""")
def paper_groups(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("a_"), c, F.lit("_7_figure_2"))).when(k % 4 == 1, F.concat(F.lit("b"), c, F.lit("_figure_"), k, F.lit("_figure_9"))).when(k % 4 == 2, F.lit("c_12_figure_1_3_figure_x")).otherwise(F.concat(F.lit("plain_"), c))
    return Tables(spark, sf).orders.select("o_orderkey", assemble.paper_group(name).alias("paper"))


@query("difficulty_ladder", """
select p_partkey, case when coalesce(nullif(p_size % 8, 7), 0) >= 6 or p_size >= 45 then 'hard' when coalesce(nullif(p_size % 8, 7), 0) >= 3 or p_size >= 25 then 'medium_hard' when p_size >= 12 then 'medium' else 'easy' end as difficulty from part""")
def difficulty_ladder(spark, sf):
    return Tables(spark, sf).part.select("p_partkey", assemble.ladder(F.nullif(F.col("p_size") % 8, F.lit(7)), "p_size").alias("difficulty"))


@query("single_structures", r"""
with x as (select p_partkey, ['a', 'a -> b', 'x + y', 'x+y', '\chemfig{a}', '\chemfig{a}\chemfig{b}', 'a \rightarrow b', 'xrightarrow', 'a +b', null][p_partkey % 10 + 1] as t from part)
select p_partkey, not (contains(t, 'xrightarrow') or contains(t, '\rightarrow') or contains(t, '->') or contains(t, ' + ') or contains(t, '+ ') or contains(t, ' +') or (length(t) - length(replace(t, '\chemfig', ''))) / 8 > 1) as single from (select p_partkey, coalesce(t, '') as t from x)""")
def single_structures(spark, sf):
    names = ["a", "a -> b", "x + y", "x+y", "\\chemfig{a}", "\\chemfig{a}\\chemfig{b}", "a \\rightarrow b", "xrightarrow", "a +b", None]
    t = F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % 10 + 1).cast("int"))
    return Tables(spark, sf).part.select("p_partkey", assemble.single_structure(t).alias("single"))


@query("meta_records", """
select doc_id, case when starts_with(source, 'src1') then './' || source || '/' || doc_id else 'http://' || source end as image, '<image>Read it.' as prompt, substr(text, 1, 30) as answer, coalesce(nullif(lang, 'en'), 'unknown') as difficulty, 'molecule_structure_recognition' as task_type,
  length(substr(text, 1, 30))::int as canonical_smiles_length, contains(substr(text, 1, 30), '@') as contains_stereo from documents""")
def meta_records(spark, sf):
    image = F.when(F.startswith("source", F.lit("src1")), F.concat("source", F.lit("\\"), "doc_id")).otherwise(F.concat(F.lit("http://"), "source"))
    r = assemble.message_record(image, "Read it.", F.substring("text", 1, 30), difficulty=F.nullif("lang", F.lit("en")))
    d = Tables(spark, sf).documents.select("doc_id", r.alias("r"))
    m = F.col("r.messages")
    return d.select("doc_id", F.col("r.images")[0].alias("image"), m[0]["content"].alias("prompt"), m[1]["content"].alias("answer"), "r.meta.difficulty", "r.meta.task_type", "r.meta.canonical_smiles_length", "r.meta.contains_stereo")


@query("evaluation_labels", """
select doc_id, substr(text, 1, 12) as smiles, lang as kept_field, substr(sha256(substr(text, 1, 12)), 1, 20) as structure_id, 'eval_v1/' || coalesce(nullif(source, 'src3'), '') as image, 'legacy_development' as benchmark_role from documents where n_chars % 5 > 0 and length(trim(substr(text, 1, 12))) > 0""")
def evaluation_labels(spark, sf):
    label = F.struct(F.lit("old").alias("smiles"), F.col("lang").alias("kept_field"))
    d = Tables(spark, sf).documents.select("doc_id", label.alias("label"), F.nullif("source", F.lit("src3")).alias("image"), F.when(F.col("n_chars") % 5 > 0, F.substring("text", 1, 12)).alias("canonical"))
    r = assemble.label_record(d, "canonical", "eval_v1", "legacy_development")
    return r.select("doc_id", "label.smiles", "label.kept_field", "structure_id", "image", "benchmark_role")


@query("repeat_policy", """
select doc_id, case source when 'src0' then greatest(t, 4) when 'src1' then least(greatest(t, 2), 3) when 'src2' then least(t, 2) when 'src3' then 1 else t end as base_times,
  greatest(1, coalesce(case when doc_id % 4 = 0 then (doc_id % 6)::int end, 1), case when source = 'real_world' then 5 else 1 end, case when length(substr(text, 1, 90)) >= 80 then 2 else 1 end, case when contains(substr(text, 1, 90), '@') then 3 else 1 end) as export_times
from (select *, case lang when 'es' then 6 when 'fr' then 3 when 'de' then 2 else 1 end as t from documents)""")
def repeat_policy(spark, sf):
    clamps = {"src0": (4, None), "src1": (2, 3), "src2": (1, 2), "src3": (1, 1)}
    d = Tables(spark, sf).documents.select("doc_id", "source", "lang", F.substring("text", 1, 90).alias("key"), F.when(F.col("doc_id") % 4 == 0, (F.col("doc_id") % 6).cast("int")).alias("hint"))
    return d.select("doc_id", base_times("source", "lang", {"es": 6, "fr": 3, "de": 2}, clamps).alias("base_times"), Repeats(5, 2, 3, 80).times("source", "key", "hint").alias("export_times"))


# Splits, merges, evaluations

_SPLIT = "select {0}, case when {1} then 'train' else 'dev' end as split from {2}"


@query("train_dev_split", _SPLIT.format("o_orderkey", "('0x' || substr(sha1('5:' || o_orderkey), 1, 12))::bigint / (281474976710655.0::double) < 0.7", "orders"))
def train_dev_split(spark, sf):
    return assemble.train_dev(Tables(spark, sf).orders.select("o_orderkey"), "o_orderkey", 0.7, 5)


@query("train_dev_mended", """
select s_suppkey, case when row_number() over (order by s_suppkey) <= n - greatest(1, n // 5) then 'train' else 'dev' end as split from supplier, (select count(*) as n from supplier)""")
def train_dev_mended(spark, sf):
    """A share so near to 1 that nothing is left for dev."""
    return assemble.train_dev(Tables(spark, sf).supplier.select("s_suppkey"), "s_suppkey", 1 - 1e-12, 5)


@query("merged_runs", """
with o as (select *, row_number() over (partition by l_orderkey, l_linenumber % 2 order by l_partkey, l_suppkey, l_extendedprice) as place, case when l_linenumber % 2 = 0 then 'even' else 'odd' end as run from lineitem),
c as (select l_orderkey as id, run, place, l_returnflag || (l_partkey % 3) as prediction, case when l_partkey % 4 > 0 then l_returnflag || (l_partkey % 3) end as canonical from o where place <= 3),
p as (select l_orderkey as id, run, 'sel' || max(l_partkey) as prediction from o group by 1, 2),
m as (select id, coalesce(max(case when run = 'odd' then prediction end), max(case when run = 'even' then prediction end)) as prediction, count(*) as n_runs from p group by 1),
a as (select id, count(*) as n_candidates, count(distinct canonical) as n_keys, string_agg(run || ':' || place || ':' || prediction, ',' order by run, place) as pool from c group by 1)
select coalesce(l.id, m.id) as id, coalesce(prediction, '') as prediction, coalesce(n_candidates, 0)::int as n_candidates, coalesce(n_runs, 0) as n_runs, coalesce(n_keys, 0)::int as n_keys, coalesce(pool, '') as pool
from (select o_orderkey as id from orders where o_custkey % 3 > 0) l full join m on m.id = l.id left join a on a.id = m.id""")
def merged_runs(spark, sf):
    from pyspark.sql import Window as W

    t = Tables(spark, sf)
    w = W.partitionBy("l_orderkey", F.col("l_linenumber") % 2).orderBy("l_partkey", "l_suppkey", "l_extendedprice")
    lines = t.lineitem.withColumn("place", F.row_number().over(w)).withColumn("p", F.concat("l_returnflag", F.col("l_partkey") % 3))
    one = F.struct("place", F.col("p").alias("prediction"), F.when(F.col("l_partkey") % 4 > 0, F.col("p")).alias("canonical"))
    run = lambda odd: lines.where(F.col("l_linenumber") % 2 == odd).groupBy(F.col("l_orderkey").alias("id")).agg(F.concat(F.lit("sel"), F.max("l_partkey")).alias("prediction"), F.sort_array(F.collect_list(one)).alias("candidates"))
    labels = t.orders.where("o_custkey % 3 > 0").select(F.col("o_orderkey").alias("id"))
    m = assemble.merged_runs({"even": run(0), "odd": run(1)}, labels, "odd", unlabelled=True, most=3)
    shown = F.array_join(F.transform("candidates", lambda c: F.concat_ws(":", c["run"], c["index"], c["prediction"])), ",")
    return m.select("id", "prediction", "n_candidates", "n_runs", "n_keys", F.coalesce(shown, F.lit("")).alias("pool"))


_STATES = f"""
lab as (select o_orderkey as id, case when o_custkey % 19 > 0 then ['A', 'N', 'R'][o_custkey % 3 + 1] || (o_custkey % 2) || case when o_custkey % 4 = 0 then '.X' else '' end || case when o_custkey % 5 = 0 then '\\' else '' end end as truth, case when o_custkey % 7 > 0 then o_orderstatus end as eval_panel, o_orderpriority as source, (o_custkey % 3)::varchar as task_type, 'd' || (o_custkey % 2) as difficulty from orders),
sel as (select id, canonical from (select *, row_number() over (partition by id order by {_CURRENT}) as r from every) where r = 1 and id % 23 > 0), {_LIGHT.strip()},
hit as (select l.id, count(*) as uniq, max((e.canonical = truth)::int) as o, max((e.skeleton = replace(truth, '\\', ''))::int) as i from every e join lab l on l.id = e.id group by 1),
raw as (select id, count(*) as raw from cands group by 1),
st as (select l.*, s.id is null as missing_prediction, truth is null as missing_target, truth is not null and s.id is not null as b, coalesce(s.canonical = truth, false) as sx, coalesce(g.canonical = truth, false) as lx, coalesce(o, 0) = 1 as ox, coalesce(i, 0) = 1 as ix, coalesce(raw, 0) as raw, coalesce(uniq, 0) as uniq
  from lab l left join sel s using (id) left join light g using (id) left join hit using (id) left join raw using (id)),
v as (select *, (b and sx)::int::double as selected_exact, (b and lx)::int::double as light_exact, (b and ox)::int::double as oracle_exact, (b and ix)::int::double as oracle_nonisomeric, (b and ox and not sx)::int::double as recoverable_by_rerank, (b and not ox)::int::double as missing_from_candidates from st),
u as (select 'all' as dimension, '' as value, * from v union all select 'eval_panel', coalesce(eval_panel, 'unknown'), * from v union all select 'source', source, * from v union all select 'task_type', task_type, * from v union all select 'difficulty', difficulty, * from v)"""


@query("oracle_analysis", f"""with {_CANDS}, {_STATES}
select dimension, value, count(*) as n, round(avg(missing_prediction::int), 9) as missing_prediction, round(avg(missing_target::int), 9) as missing_target, {", ".join(f"round(avg({s}), 9) as {s}" for s in assemble.STATES[2:])},
  round(avg(case when b then raw else 0 end), 9) as mean_raw, round(avg(case when b then uniq else 0 end), 9) as mean_unique, round(avg(oracle_exact) - avg(selected_exact), 9) as headroom_over_selected, round(avg(oracle_exact) - avg(light_exact), 9) as headroom_over_light from u group by 1, 2""")
def oracle_analysis(spark, sf):
    t = Tables(spark, sf)
    c = F.col("o_custkey")
    key = F.concat(F.element_at(F.array(*map(F.lit, "ANR")), (c % 3 + 1).cast("int")), c % 2, F.when(c % 4 == 0, ".X").otherwise(""), F.when(c % 5 == 0, "\\").otherwise(""))
    labels = t.orders.select(F.col("o_orderkey").alias("id"), F.when(c % 19 > 0, key).alias("truth"), F.when(c % 7 > 0, F.col("o_orderstatus")).alias("eval_panel"), F.col("o_orderpriority").alias("source"), (c % 3).cast("string").alias("task_type"), F.concat(F.lit("d"), c % 2).alias("difficulty"))
    cands = _cands(t)
    aggs = choose.aggregates(cands)
    picks = _picked(aggs).withColumn("selected", F.when(F.col("id") % 23 > 0, F.col("selected")))
    states = assemble.oracle_states(labels, aggs, cands.groupBy("id").agg(F.count(F.lit(1)).alias("n")), picks, lambda k: F.replace(k, F.lit("\\"), F.lit("")))
    return assemble.oracle_report(states, ["eval_panel", "source", "task_type", "difficulty"])


@query("policy_evaluation", f"""with {_CANDS}, {_LIGHT.strip()},
pol as (select id, canonical from (select *, row_number() over (partition by id order by max_score desc, votes desc, mp, mg, first_place) as r from every) where r = 1),
sel as (select id, canonical from (select *, row_number() over (partition by id order by {_CURRENT}) as r from every) where r = 1),
tr as (select o_orderkey as id, ['A', 'N', 'R'][o_custkey % 3 + 1] || (o_custkey % 2) as truth from orders),
j as (select tr.truth, p.canonical as p, 'selected' as baseline, s.canonical as b from tr left join pol p using (id) left join sel s using (id) union all select tr.truth, p.canonical, 'light', l.canonical from tr left join pol p using (id) left join light l using (id))
select baseline, count(*) as n, count_if(coalesce(p = truth, false)) as policy_right, count_if(coalesce(b = truth, false)) as baseline_right, count_if(p is distinct from b) as changed,
  count_if(coalesce(p = truth, false) and not coalesce(b = truth, false)) as good, count_if(coalesce(b = truth, false) and not coalesce(p = truth, false)) as bad from j group by 1""")
def policy_evaluation(spark, sf):
    t = Tables(spark, sf)
    picks = _picked(choose.aggregates(_cands(t)), policy=[F.col("max_score").desc(), F.col("votes").desc(), F.col("min_prompt_index"), F.col("min_generation_index"), F.col("first_place")])
    truth = t.orders.select(F.col("o_orderkey").alias("id"), F.concat(F.element_at(F.array(*map(F.lit, "ANR")), (F.col("o_custkey") % 3 + 1).cast("int")), F.col("o_custkey") % 2).alias("truth"))
    return assemble.picked_against(picks, "policy", ["selected", "light"], truth)


@query("probe_winner", """
with r as (select l_suppkey % 10 as run, case when l_suppkey % 10 < 5 then '0' else '1' end || (l_suppkey % 2) as condition, avg((l_quantity > 25)::int) as exact, avg((l_discount > 0.01)::int) as valid from lineitem where l_suppkey % 11 > 0 group by 1, 2),
dose as (select avg((l_quantity > 25)::int) as exact, avg((l_discount > 0.01)::int) as valid from lineitem where l_suppkey % 11 = 0),
c as (select condition, avg(exact) as exact, min(valid) as valid, max(exact) - min(exact) as range from r group by 1),
p as (select max(case when condition = '00' then valid end) - 0.02 as floor, max(case when condition = '00' then exact end) as e00, max(case when condition = '10' then exact end) as e10, max(case when condition = '01' then exact end) as e01, max(case when condition = '11' then exact end) as e11 from c),
w as (select c.*, p.*, (e10 + e11 - e00 - e01) / 2 as f1, (e01 + e11 - e00 - e10) / 2 as f2, e11 - e10 - e01 + e00 as ia from c, p where valid >= floor order by exact desc, condition limit 1),
b as (select w.*, d.exact as de, d.valid as dv, coalesce(f2 > 0 and d.valid >= floor and d.exact > w.exact + 0.001, false) as beats from w left join dose d on true)
select condition as core_winner, case when beats then 'dose2' else condition end as winner, round(case when beats then de else exact end, 9) as exact, round(case when beats then null else range end, 9) as seed_range, round(case when beats then dv else valid end, 9) as min_valid,
  round(floor, 9) as validity_floor, round(f1, 9) as effect_first, round(f2, 9) as effect_second, round(ia, 9) as interaction from b""")
def probe_winner(spark, sf):
    s = F.col("l_suppkey")
    metrics = F.avg((F.col("l_quantity") > 25).cast("int")).alias("exact"), F.avg((F.col("l_discount") > 0.01).cast("int")).alias("valid")
    l = Tables(spark, sf).lineitem  # noqa: E741
    runs = l.where(s % 11 > 0).groupBy((s % 10).alias("run"), F.concat(F.when(s % 10 < 5, "0").otherwise("1"), (s % 2).cast("string")).alias("condition")).agg(*metrics)
    return assemble.probe_winner(runs, l.where(s % 11 == 0).agg(*metrics), 0.02, 0.001)


_DOMAINS = "d as (select 0 as part, 'spanish' as domain, doc_id, substr(text, 1, 20) as k from documents where lang = 'es' union all select 1, 'long', doc_id, substr(text, 1, 20) from documents where n_chars > 3000 union all select 2, 'rest', doc_id, substr(text, 1, 20) from documents where doc_id % 3 = 0), x as (select *, row_number() over (partition by k order by part, doc_id) as r from d where trim(k) <> '')"


def _domains(t: Tables):
    d = t.documents.withColumn("k", F.substring("text", 1, 20))
    return assemble.first_by_label({"spanish": d.where("lang = 'es'"), "long": d.where("n_chars > 3000"), "rest": d.where("doc_id % 3 = 0")}, "k", "doc_id")


@query("weak_domain_build", f"with {_DOMAINS} select doc_id, domain from x where r = 1")
def weak_domain_build(spark, sf):
    return _domains(Tables(spark, sf))[0].select("doc_id", "domain")


@query("weak_domain_stats", f"with {_DOMAINS} select domain, count_if(r = 1) as n_kept, count_if(r > 1) as n_repeated from x group by 1")
def weak_domain_stats(spark, sf):
    return _domains(Tables(spark, sf))[1]


@query("adjudication", """
with e as (select user_id % 200 as id, case event_id % 5 when 0 then 'adjudicator' when 1 then 'one' when 2 then 'one' else 'two' end as role, ['pass', 'reject', 'pass', 'uncertain', 'pending'][(event_id // 7) % 5 + 1] as decision, event_id as pos from events),
l as (select id, role, max_by(decision, pos) as d from e group by 1, 2),
p as (select s_suppkey as id, coalesce(max(case when role = 'one' then d end), 'pending') as one, coalesce(max(case when role = 'two' then d end), 'pending') as two, coalesce(max(case when role = 'adjudicator' then d end), 'pending') as adj from supplier left join l on l.id = s_suppkey group by 1)
select id, case when adj <> 'pending' then adj when one = two then one else 'pending' end as final, case when adj <> 'pending' then 'adjudicated' when one = 'pending' or two = 'pending' then 'pending' when one = two then 'agreed' else 'disagreed' end as status from p""")
def adjudication(spark, sf):
    t = Tables(spark, sf)
    n = F.col("event_id")
    role = F.when(n % 5 == 0, "adjudicator").when((n % 5).isin(1, 2), "one").otherwise("two")
    decision = F.element_at(F.array(*map(F.lit, ("pass", "reject", "pass", "uncertain", "pending"))), (F.floor(n / 7) % 5 + 1).cast("int"))
    d = t.events.select((F.col("user_id") % 200).alias("id"), role.alias("role"), F.lit("someone").alias("reviewer"), decision.alias("decision"), F.lit("ok").alias("reason"), n.alias("at"))
    return assemble.adjudicated(t.supplier.select(F.col("s_suppkey").alias("id")), d, ["one", "two"]).select("id", "final", "status")


@query("evidence_report", """
select '{"n":' || (select count(*) from documents) || '}' as dataset, '{"n_labelled":' || (select count(*) from labels) || '}' as reviews, null::varchar as private_photo, 'private_photo' as absent""")
def evidence_report(spark, sf):
    t = Tables(spark, sf)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    e = assemble.evidence({"dataset": count(t.documents, "n")}, {"reviews": count(t.labels, "n_labelled"), "private_photo": None})
    return e.withColumn("absent", F.array_join("absent", ","))


@query("trimmed_messages", r"""
with c as (select conv_id, turn, regexp_replace(chr(160) || text || chr(9), '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g') as t from conversations where role = 'assistant')
select conv_id, max(turn) as turn, max_by(t, turn) as text from c group by 1""")
def trimmed_messages(spark, sf):
    from quernel.operators.shape import message_of

    c = Tables(spark, sf).conversations.withColumn("text", F.concat(F.lit(" "), "text", F.lit("\t")))
    return message_of(c, "conv_id", "turn").select("conv_id", "turn", text.trimmed("text").alias("text"))
