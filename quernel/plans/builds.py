"""Queries that build data sets, grids and paired reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernel.operators import build, paired
from quernel.operators import candidates as cand
from quernel.plans.base import CANDIDATES, Tables, candidates, query, truth
from quernel.plans.selection import _MINED

# Mixtures: small parts are the base, large ones the wild rows, and base rows of two brands come again as variants

_HELD = "(p_partkey % 17 = 3)"
_PARTS = f"""
h as (select distinct p_name as k from part where {_HELD}),
pieces as (
  select p_partkey, p_name, case when p_size <= 25 then 'base' else 'wild' end as piece from part where not {_HELD} and p_name not in (select k from h)
  union all select p_partkey, p_name, 'variant_0' from part where p_size <= 25 and p_brand = 'Brand#2' and not {_HELD} and p_name not in (select k from h)
  union all select p_partkey, p_name, 'variant_1' from part where p_size <= 25 and p_brand = 'Brand#3' and not {_HELD} and p_name not in (select k from h)),
mixed as (
  select p_partkey, p_name, piece, mixture, sha256(seed || '|' || piece || '|' || p_partkey) as order_key from pieces, (values
    ('A', '21', 'base'), ('D', '22', 'base'), ('D', '22', 'wild'), ('E', '23', 'base'), ('E', '23', 'variant_0'), ('B', '24', 'base'), ('B', '24', 'wild'), ('B', '24', 'variant_0'),
    ('C', '25', 'base'), ('C', '25', 'wild'), ('C', '25', 'variant_0'), ('C', '25', 'variant_1')) as r(mixture, seed, part) where part = piece)"""


def _pieces(t: Tables):
    held = t.part.where(f"{_HELD} and p_name is not null").select("p_name").distinct()
    free = t.part.where(f"not {_HELD}").join(held, "p_name", "left_anti")
    variant = F.when(F.col("p_size") <= 25, F.when(F.col("p_brand") == "Brand#2", "variant_0").when(F.col("p_brand") == "Brand#3", "variant_1"))
    first = F.when(F.col("p_size") <= 25, "base").otherwise("wild")
    return free.withColumn("piece", F.explode(F.filter(F.array(first, variant), lambda x: x.isNotNull())))


def _mixtures(t: Tables):
    recipes = {"A": (["base"], 21), "D": (["base", "wild"], 22), "E": (["base", "variant_0"], 23), "B": (["base", "wild", "variant_0"], 24), "C": (["base", "wild", "variant_0", "variant_1"], 25)}
    return build.factorial_mixtures(_pieces(t), "piece", recipes, "p_partkey")


@query("factorial_mixtures", f"with {_PARTS} select mixture, p_partkey, piece, order_key from mixed")
def factorial_mixtures(spark, sf):
    return _mixtures(Tables(spark, sf)).select("mixture", "p_partkey", "piece", "order_key")


@query("mixture_hard_replay", f"""with {_PARTS}
select p_partkey, piece, order_key from (select p_partkey, piece, sha256('91|' || p_partkey) as order_key from mixed where mixture = 'B' and piece <> 'variant_0' and (p_name like '%ring%' or length(p_name) >= 12)) order by order_key, p_partkey limit 150""")
def mixture_hard_replay(spark, sf):
    b = _mixtures(Tables(spark, sf)).where("mixture = 'B' and piece <> 'variant_0'")
    hard = b.where(build.any_of(F.contains("p_name", F.lit("ring")), F.length("p_name") >= 12))
    return build.hash_capped(hard, 150, 91, "p_partkey").select("p_partkey", "piece", "order_key")


_REPLAY = """
r as (select p_partkey, p_type || '|' || p_name as k, p_name as target, p_size, ['real_world', 'molgrapher_synthetic', 'uspto', 'uob', 'other', 'uspto30k_large', null][p_partkey % 7 + 1] as s,
  ['handwritten', 'scan', 'hard', 'medium_hard', 'clean', 'strange', null][p_size % 7 + 1] as d, ['auto_photo_scan', 'auto_long_stereo', 'auto_else', '', null][p_partkey % 5 + 1] as w from part),
h as (select distinct target from r where p_partkey % 19 = 5),
b as (select * from (select *, row_number() over (partition by k order by p_partkey) as n from r where p_size <= 30 and target not in (select target from h)) where n = 1),
e as (select * from (select *, row_number() over (partition by k order by p_partkey) as n from r where p_size > 30 and target not in (select target from h)) where n = 1),
c as (select *, row_number() over (partition by s order by sha256('33|' || k), k) as place, case coalesce(d, 'unknown') when 'handwritten' then 8 when 'scan' then 6 when 'hard' then 3 when 'medium_hard' then 2 else 1 end as t from b),
f as (select p_partkey, s, 'base_' || coalesce(s, 'unknown') || '_' || coalesce(d, 'unknown') as p,
    case coalesce(s, 'unknown') when 'real_world' then greatest(t, 4) when 'molgrapher_synthetic' then least(greatest(t, 2), 3) when 'uspto' then least(t, 2) when 'uspto30k_large' then least(t, 2) when 'uob' then 1 else t end as t
  from c where place <= case s when 'uob' then 9 when 'uspto' then 14 else 1000000000 end
  union all select p_partkey, s, 'auto_' || coalesce(nullif(w, ''), d, 'unknown'), case coalesce(nullif(w, ''), d, 'unknown') when 'auto_photo_scan' then 14 when 'auto_long_stereo' then 10 else 8 end from e),
out as (select p_partkey, s, p || ':repeat_' || t as policy, i::int as repeat_index from f, lateral (select unnest(range(t)) as i))"""


def _replay(t: Tables):
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))
    p = t.part.select(
        "p_partkey", "p_size", F.concat_ws("|", "p_type", "p_name").alias("k"), F.col("p_name").alias("target"), pick(["real_world", "molgrapher_synthetic", "uspto", "uob", "other", "uspto30k_large", None], F.col("p_partkey") % 7).alias("s"),
        pick(["handwritten", "scan", "hard", "medium_hard", "clean", "strange", None], F.col("p_size") % 7).alias("d"), pick(["auto_photo_scan", "auto_long_stereo", "auto_else", "", None], F.col("p_partkey") % 5).alias("w"),
    )
    parts = p.where("p_size <= 30"), p.where("p_size > 30"), p.where("p_partkey % 19 = 5")
    return build.hard_replay(*parts, "k", "target", "s", "d", "w", {"uob": 9, "uspto": 14}, "p_partkey", 33), *parts


@query("hard_replay_build", f"with {_REPLAY} select p_partkey, policy, repeat_index from out")
def hard_replay_build(spark, sf):
    return _replay(Tables(spark, sf))[0].select("p_partkey", "policy", "repeat_index")


@query("hard_replay_report", f"""with {_REPLAY}
select 'policy' as what, policy as name, count(*) as n from out group by 2 union all select 'source', coalesce(s, 'unknown'), count(*) from out group by 2
union all select 'skipped', 'base_heldout', count(*) from r where p_size <= 30 and target in (select target from h) union all select 'skipped', 'extra_heldout', count(*) from r where p_size > 30 and target in (select target from h)""")
def hard_replay_report(spark, sf):
    built, base, extra, held = _replay(Tables(spark, sf))
    return build.replay_report(built, base, extra, held, "target", "s")


# Predicates and records


@query("canonical_records", r"""
select conv_id, turn from conversations where regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') <> '' and not starts_with(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), 'Please')
  and not contains(role, 'system') and contains(role, 'user')""")
def canonical_records(spark, sf):
    return Tables(spark, sf).conversations.where(build.canonical_record("role", "text", "user", "system", "Please")).select("conv_id", "turn")


@query("structural_hard", """
select page_id, length(url) >= 45 or contains(url, '@') or contains(url, '[') or coalesce(regexp_extract(url, '/(de|fr)/', 1), '') in ('de') as hard from pages""")
def structural_hard(spark, sf):
    difficulty = F.regexp_extract("url", "/(de|fr)/", 1)
    hard = build.any_of(F.length("url") >= 45, F.contains("url", F.lit("@")), F.contains("url", F.lit("[")), difficulty.isin("de"))
    return Tables(spark, sf).pages.select("page_id", hard.alias("hard"))


@query("length_side_filter", "select p_partkey from part where length(coalesce(p_name, '')) <= 11 and greatest(p_size, p_retailprice / 40) <= 40")
def length_side_filter(spark, sf):
    p = Tables(spark, sf).part
    return p.where((F.length(F.coalesce("p_name", F.lit(""))) <= 11) & (F.greatest(F.col("p_size").cast("double"), F.col("p_retailprice") / 40) <= 40)).select("p_partkey")


@query("source_lists", "select p_partkey from part where p_brand in ('Brand#1', 'Brand#2', 'Brand#3') and p_brand not in ('Brand#3')")
def source_lists(spark, sf):
    return build.from_sources(Tables(spark, sf).part, "p_brand", ["Brand#1", "Brand#2", "Brand#3"], ["Brand#3"]).select("p_partkey")


@query("weak_domain", """
select page_id, coalesce(case when contains(coalesce(url, ''), 'page') then 'page' end, case when contains(coalesce(url, ''), 'ref') then 'ref' end, case when contains(coalesce(html, ''), 'class') then 'class' end,
  case when contains(coalesce(html, ''), 'page') then 'page' end, case when contains(coalesce(html, ''), 'ref') then 'ref' end, '') as domain from (select page_id, url, html from pages where not contains(coalesce(url, ''), 'class'))""")
def weak_domain(spark, sf):
    return Tables(spark, sf).pages.where(~F.contains(F.coalesce("url", F.lit("")), F.lit("class"))).select("page_id", build.first_domain(["url", "html"], ["ref", "page", "class"]).alias("domain"))


@query("consent_problems", """
with r as (select l_orderkey || '-' || (l_linenumber % 5) as sample_id, case when l_partkey % 13 = 0 then ' ' else l_partkey::varchar end as structure_id, case l_suppkey % 4 when 0 then 'no' when 1 then ' YES' when 2 then '1' else 'true' end as consent,
  case when l_partkey % 7 = 0 then 'fail' else 'Pass ' end as first_review, case when l_partkey % 11 = 0 then null else 'pass' end as second_review, l_linenumber from lineitem),
n as (select sample_id as k, count(*) as n from r group by 1)
select sample_id, l_linenumber, problem from (select sample_id, l_linenumber, case when trim(structure_id) = '' then 'structure_id is required' when n > 1 then 'duplicate sample_id' when lower(trim(consent)) not in ('yes', 'true', '1') then 'consent must be yes'
  when lower(trim(first_review)) <> 'pass' then 'first_review must be pass' when lower(trim(coalesce(second_review, ''))) <> 'pass' then 'second_review must be pass' end as problem from r join n on k = sample_id) where problem is not null""")
def consent_problems(spark, sf):
    li = Tables(spark, sf).lineitem.select(
        F.concat_ws("-", "l_orderkey", F.col("l_linenumber") % 5).alias("sample_id"),
        F.when(F.col("l_partkey") % 13 == 0, " ").otherwise(F.col("l_partkey").cast("string")).alias("structure_id"),
        F.element_at(F.array(*map(F.lit, ("no", " YES", "1", "true"))), (F.col("l_suppkey") % 4 + 1).cast("int")).alias("consent"),
        F.when(F.col("l_partkey") % 7 == 0, "fail").otherwise("Pass ").alias("first_review"),
        F.when(F.col("l_partkey") % 11 != 0, "pass").alias("second_review"),
        "l_linenumber",
    )
    return build.review_problems(li, ["sample_id", "structure_id"], "consent", ["first_review", "second_review"], "sample_id").select("sample_id", "l_linenumber", "problem")


@query("bundle_constants", """
select 'o_orderpriority' as "column", sum((o_orderpriority is distinct from '1-URGENT')::int)::bigint as n from orders union all select 'o_orderstatus', sum((o_orderstatus is distinct from 'F')::int)::bigint from orders""")
def bundle_constants(spark, sf):
    return build.constant_violations(Tables(spark, sf).orders, {"o_orderpriority": "1-URGENT", "o_orderstatus": "F"})


@query("message_records", r"""
select page_id, '<image>Read it.' as prompt, url as answer, case when url like 'http%' then replace(url, '\', '/') else './' || replace(url, '\', '/') end as image, length(url)::int as answer_length, contains(url, '@') as contains_stereo from pages""")
def message_records(spark, sf):
    r = build.message_record(Tables(spark, sf).pages, "page_id", F.col("url"), "Read it.", F.col("url"))
    return r.select(F.col("meta.id").alias("page_id"), F.col("messages")[0]["content"].alias("prompt"), F.col("messages")[1]["content"].alias("answer"), F.col("images")[0].alias("image"), F.col("meta.answer_length").alias("answer_length"), F.col("meta.contains_stereo").alias("contains_stereo"))


@query("label_records", """
select doc_id as id, substr(sha256(coalesce(nullif(trim(source), ''), 'none')), 1, 20) as structure_id, 'data/' || doc_id || '.png' as image, case when n_chars > 2000 then 'large' else 'plain' end as difficulty, coalesce(lang, '') as answer, lang is not null as strict from documents""")
def label_records(spark, sf):
    from quernel.functions.keys import entity_id
    from quernel.functions.text import filled

    row = F.struct(F.col("doc_id").alias("name"), F.lit("raw").alias("state"))
    d = Tables(spark, sf).documents.withColumn("r", row)
    d = d.withColumn("r", F.col("r").withField("id", F.col("r.name")).withField("structure_id", entity_id(F.coalesce(filled("source"), F.lit("none")))).withField("image", F.concat(F.lit("data/"), F.col("doc_id"), F.lit(".png"))).withField("difficulty", F.when(F.col("n_chars") > 2000, "large").otherwise("plain")).withField("ground_truth", F.struct(F.coalesce("lang", F.lit("")).alias("answer"))).withField("strict", F.col("lang").isNotNull()).dropFields("name", "state"))
    return d.select("r.id", "r.structure_id", "r.image", "r.difficulty", "r.ground_truth.answer", "r.strict")


# Weights, settings, warnings, features


@query("rule_weights", """
select p_partkey, greatest(0.0, 1.5 * (case when p_brand = 'Brand#2' then 2.0 else 1.0 end) * (case when p_size = 7 then 0.25 else 1.0 end) * (case when p_type = 'SMALL' then -1.0 else 1.0 end))::double as weight from part""")
def rule_weights(spark, sf):
    return Tables(spark, sf).part.select("p_partkey", build.rule_weight("p_brand:Brand#2=2, default=1.5,p_size:7=0.25,,p_type:SMALL=-1").alias("weight"))


@query("clamped_settings", """
select event_id, case when try_cast(value as double) is null then 4.0 else least(4.0, greatest(1.0, try_cast(value as double))) end::double as beams, case when try_cast(props as double) is null then 256.0 else least(512.0, greatest(64.0, try_cast(props as double))) end::double as max_tokens from events""")
def clamped_settings(spark, sf):
    return Tables(spark, sf).events.select("event_id", build.clamped("value", 1, 4, 4).alias("beams"), build.clamped("props", 64, 512, 256).alias("max_tokens"))


@query("image_gate", """
with w as (select p_partkey, array_to_string(list_filter([case when p_size * 20 > 0 and p_size * 15 > 0 and least(p_size * 20, p_size * 15) < 256 then 'short_side' end, case when p_retailprice / 6 < 45 or p_retailprice / 6 > 235 then 'exposure' end,
  case when p_size < 18 then 'contrast' end], lambda x: x is not null), ',') as warnings from part)
select p_partkey, warnings, case when warnings = '' then 'pass' else 'review' end as gate from w""")
def image_gate(spark, sf):
    found = build.image_warnings(F.col("p_size") * 20, F.col("p_size") * 15, F.col("p_retailprice") / 6, F.col("p_size"))
    return Tables(spark, sf).part.select("p_partkey", F.array_join(found, ",").alias("warnings"), F.when(F.size(found) == 0, "pass").otherwise("review").alias("gate"))


def _n(pattern: str) -> str:
    return f"length(regexp_replace(t, '[^{pattern}]', '', 'g'))::double"


@query("candidate_text_features", rf"""
with s as (select page_id, regexp_replace(coalesce(url, ''), '\s+', '', 'g') as t, coalesce(nullif(html, ''), '') as c from pages),
u as (select *, list_distinct(regexp_extract_all(t, '.')) as ch, list_distinct(regexp_extract_all(t, '[0-9]')) as dg from s)
select page_id, (c <> '')::int::double as valid, length(t)::double as raw_len, length(c)::double as canonical_len, (length(t) * length(t))::double as raw_len_sq, len(ch)::double as unique_char_count, {_n('0-9')} as digit_count, len(dg)::double as ring_digit_count,
  len(list_filter(dg, lambda d: (length(t) - length(replace(t, d, ''))) % 2 = 1))::double as ring_digit_imbalance, {_n('()')} as branch_count, {_n('=#/' + chr(92) * 2)} as bond_count, {_n(chr(92) + '[' + chr(92) + ']')} as bracket_count, {_n('bcnops')} as aromatic_count,
  {_n('A-Z')} as upper_count, {_n('a-z')} as lower_count, {_n('@')} as stereo_count, {_n('.')} as dot_count, {_n('+')} as plus_count, {_n(chr(92) + '-')} as hyphen_count, length(regexp_replace(t, '[A-Za-z0-9\[\]()=.#+\-\\/:@*%$]', '', 'g'))::double as invalid_char_count from u""")
def candidate_text_features(spark, sf):
    f = build.text_features("url", "html")
    return Tables(spark, sf).pages.select("page_id", *[c for k, c in f.items() if k not in ("token_count", "token_mismatch")])


# Preference pairs and policy grids

_PICKS = f"""{CANDIDATES},
cur as (select id, canonical as selected from (select *, row_number() over (partition by id order by votes desc, max_score desc, canonical) as r from agg) where r = 1),
lig as (select id, canonical as light from (select *, row_number() over (partition by id order by mean_score desc, canonical) as r from agg) where r = 1),
pol as (select id, canonical as policy from (select *, row_number() over (partition by id order by max_score desc, canonical) as r from agg) where r = 1),
picks as (select * from cur join lig using (id) join pol using (id))"""


def _picks(aggregates):
    """The choice of each of three rules, a row a sample, in one aggregate."""
    first = lambda *order: F.min_by("canonical", F.struct(*order, F.col("canonical")))
    down = lambda c: (-F.col(c)).alias(f"down_{c}")
    return aggregates.groupBy("id").agg(first(down("votes"), down("max_score")).alias("selected"), first(down("mean_score")).alias("light"), first(down("max_score")).alias("policy"))


@query("typed_preference_pairs", f"""with {_PICKS},
w as (select a.id, a.canonical, row_number() over (partition by a.id order by max_score desc, a.canonical) as n from agg a join truth t using (id) where a.canonical <> t.truth),
p as (select w.id, canonical as rejected, case when canonical = selected then 'oracle_positive_vs_selected' when canonical = light then 'oracle_positive_vs_chem_light' when canonical = policy then 'oracle_positive_vs_reward_policy' when n <= 3 then 'oracle_positive_vs_hard_negative' end as pair_type from w join picks using (id))
select p.id, pair_type, t.truth as chosen, rejected from p join truth t using (id) join agg a on a.id = p.id and a.canonical = t.truth where pair_type is not null""")
def typed_preference_pairs(spark, sf):
    t = Tables(spark, sf)
    a = cand.aggregate(candidates(t))
    return build.typed_pairs(a, truth(t), _picks(a), [F.col("max_score").desc(), F.col("canonical")], 3)


@query("policy_grid", f"""with {_PICKS},
s as (select t.truth, selected, light, policy, a.max_score as ss, b.max_score as ls, c.max_score as ps from picks join truth t using (id) join agg a on a.id = picks.id and a.canonical = selected join agg b on b.id = picks.id and b.canonical = light join agg c on c.id = picks.id and c.canonical = policy),
g as (select *, case fallback when 'selected' then selected when 'chem_light' then light end as o, case fallback when 'selected' then ss when 'chem_light' then ls end as os from s, (select unnest(['none', 'selected', 'chem_light']) as fallback), (select unnest([0.0, 500.0, 5000.0, 20000.0])::double as margin)),
m as (select *, case when o is null or ps - os >= margin then policy else o end as made from g)
select fallback, margin, count(*) as total, round(sum((made = truth)::int) / count(*), 9) as policy_exact, round((sum((made = truth)::int) - sum((selected = truth)::int)) / count(*), 9) as gain_over_selected, round((sum((made = truth)::int) - sum((light = truth)::int)) / count(*), 9) as gain_over_light,
  sum((made <> selected and selected = truth and made <> truth)::int)::bigint as bad_changes, sum((made <> selected and made = truth and selected <> truth)::int)::bigint as good_changes from m group by 1, 2""")
def policy_grid(spark, sf):
    t = Tables(spark, sf)
    a = cand.aggregate(candidates(t))
    top = lambda key: F.max(F.when(F.col("canonical") == F.col(key), F.col("max_score"))).alias(f"{key}_score")
    s = a.join(_picks(a), "id").groupBy("id", "selected", "light", "policy").agg(top("selected"), top("light"), top("policy")).join(truth(t), "id")
    return build.policy_grid(s, ["none", "selected", "chem_light"], [0.0, 500.0, 5000.0, 20000.0])


@query("margin_by_group", """
with b(p_brand, m) as (values ('Brand#1', 10.0::double), ('Brand#2', 20.0), ('Brand#3', 99.0))
select p_partkey, p_brand, margin, p_size * margin as made from part left join b using (p_brand), (select unnest([0.0, 10.0, 20.0])::double as margin) where margin = coalesce(m, 0.0)""")
def margin_by_group(spark, sf):
    p = Tables(spark, sf).part.select("p_partkey", "p_brand", "p_size", F.explode(F.array(*map(F.lit, (0.0, 10.0, 20.0)))).alias("margin"))
    best = spark.createDataFrame([("Brand#1", 10.0), ("Brand#2", 20.0), ("Brand#3", 99.0)], "p_brand string, margin double")
    return build.margin_by_group(p, best, "p_brand", 0.0, "p_partkey").select("p_partkey", "p_brand", "margin", (F.col("p_size") * F.col("margin")).alias("made"))


# Paired reports

_RUNS = """
runs as (select l_orderkey as id, min(l_linestatus) as status, min(case when l_linenumber % 2 = 0 then (l_quantity > 25)::int end) as a, max(case when l_linenumber % 2 = 1 then (l_quantity > 25)::int end) as b,
  max((l_discount > 0.02)::int) as va, max((l_tax > 0.01)::int) as vb, min(l_returnflag) as flag from lineitem group by 1 having count(distinct l_linenumber % 2) = 2)"""


def _runs(t: Tables):
    big = (F.col("l_quantity") > 25).cast("int")
    r = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.min(F.when(F.col("l_linenumber") % 2 == 0, big)).alias("a"), F.max(F.when(F.col("l_linenumber") % 2 == 1, big)).alias("b"), F.max((F.col("l_discount") > 0.02).cast("int")).alias("va"), F.max((F.col("l_tax") > 0.01).cast("int")).alias("vb"), F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status"))
    return r.where("a is not null and b is not null")


@query("correct_by_group", f"""with {_RUNS}
select 'flag' as field, flag as value, count(*) as n, sum(a)::bigint as baseline_correct, sum(b)::bigint as candidate_correct from runs group by flag union all
select 'status', status, count(*), sum(a)::bigint, sum(b)::bigint from runs group by status""")
def correct_by_group(spark, sf):
    return build.correct_by(_runs(Tables(spark, sf)), ["flag", "status"])


def _report_sql(unit: str, clustered: bool) -> str:
    """The report on paired rows, resampled by unit, from the same rows throughout."""
    draws = lambda seed: f"(select i // n as iteration, ('0x' || substr(sha1('{seed}:' || i), 1, 12))::bigint % n as ord from n, (select unnest(range(10000 * (select n from n))) as i))"
    spread = lambda name, seed: f"""
m_{name} as (select iteration, avg({name}) as mean from {draws(seed)} join u using (ord) group by 1),
s_{name} as (select quantile_cont(mean, 0.025) as {name}_low, quantile_cont(mean, 0.975) as {name}_high, avg((mean > 0)::int) as {name}_gain from m_{name})"""  # noqa: E731
    p = "null::double" if clustered else "round(case when k = 0 then 1.0 else least(1.0, 2 * list_sum(list_transform(range(0, least(wins, losses) + 1), lambda i: exp(lgamma(k + 1) - lgamma(i + 1) - lgamma(k - i + 1) - k * ln(2.0))))) end, 9)"
    rounded = ", ".join(f"round({m}_{c}, 6) as {m}_{c}" for m in ("exact", "valid") for c in ("baseline", "candidate", "delta", "low", "high", "gain"))
    return f"""
g as (select {unit} as unit, avg(a) as a, avg(b) as b, avg(va) as va, avg(vb) as vb from pairs group by 1),
u as (select row_number() over (order by unit) - 1 as ord, *, b - a as exact, vb - va as valid from g), n as (select count(*) as n from u),{spread("exact", 17)},{spread("valid", 18)},
c as (select count(*) as n, sum((a = 0 and b = 1)::int)::bigint as wins, sum((a = 1 and b = 0)::int)::bigint as losses, sum((a = 1 and b = 1)::int)::bigint as "both", sum((a = 0 and b = 0)::int)::bigint as neither from pairs),
v as (select count(*) as independent_units, avg(a) as exact_baseline, avg(b) as exact_candidate, avg(exact) as exact_delta, avg(va) as valid_baseline, avg(vb) as valid_candidate, avg(valid) as valid_delta from u),
q as (select *, wins + losses as k from c, v, s_exact, s_valid),
report as (select n, independent_units, wins, losses, "both", neither, {rounded}, {p} as mcnemar_p, exact_low >= -0.005 and valid_delta >= -0.005 and wins >= losses as passed from q)"""


#: Both halves of an order's lines are two runs over it; orders are clustered by a supplier.
_PAIRS = """
pairs as (select l_orderkey as id, min(l_suppkey)::varchar as cluster, coalesce(max(case when l_linenumber % 2 = 0 then (l_quantity > 25)::int end), 0) as a, coalesce(max(case when l_linenumber % 2 = 1 then (l_quantity > 25)::int end), 0) as b,
  coalesce(max(case when l_linenumber % 2 = 0 then (l_discount > 0.02)::int end), 0) as va, coalesce(max(case when l_linenumber % 2 = 1 then (l_discount > 0.02)::int end), 0) as vb, min(l_returnflag) as flag, min(l_linestatus) as status from lineitem group by 1)"""
#: Two runs over suppliers, without clusters.
_SUPPLIED = """
pairs as (select l_suppkey as id, l_suppkey::varchar as cluster, (avg(case when l_linenumber % 2 = 0 then l_quantity end) > 25)::int as a, (avg(case when l_linenumber % 2 = 1 then l_quantity end) > 25)::int as b,
  (avg(case when l_linenumber % 2 = 0 then l_discount end) > 0.05)::int as va, (avg(case when l_linenumber % 2 = 1 then l_discount end) > 0.05)::int as vb from lineitem group by 1 having count(distinct l_linenumber % 2) = 2)"""


def _pairs(t: Tables):
    def side(odd: int):
        of = lambda c: F.coalesce(F.max(F.when(F.col("l_linenumber") % 2 == odd, c)), F.lit(False))
        return t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_suppkey").alias("supplier"), of(F.col("l_quantity") > 25).alias("exact"), of(F.col("l_discount") > 0.02).alias("valid"), F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status"))

    return paired.paired(side(0), side(1), "id", "exact", "valid", ["flag", "status"], "supplier")


def _supplied(t: Tables):
    there = t.lineitem.groupBy("l_suppkey").agg(F.count_distinct(F.col("l_linenumber") % 2).alias("n")).where("n = 2").select("l_suppkey")

    def side(odd: int):
        d = t.lineitem.join(there, "l_suppkey", "left_semi").where(F.col("l_linenumber") % 2 == odd)
        return d.groupBy(F.col("l_suppkey").alias("id")).agg((F.avg("l_quantity") > 25).alias("exact"), (F.avg("l_discount") > 0.05).alias("valid"))

    return paired.paired(side(0), side(1), "id", "exact", "valid")


@query("paired_report", f"with {_PAIRS}, {_report_sql('cluster', True)} select * from report")
def paired_report(spark, sf):
    return paired.report(_pairs(Tables(spark, sf)), clustered=True)


@query("paired_report_rows", f"with {_SUPPLIED}, {_report_sql('id', False)} select * from report")
def paired_report_rows(spark, sf):
    return paired.report(_supplied(Tables(spark, sf)))


@query("paired_changes", f"with {_PAIRS} select id, case when b = 1 then 'improvement' else 'regression' end as change from pairs where a <> b")
def paired_changes(spark, sf):
    return paired.changed(_pairs(Tables(spark, sf)))


@query("paired_groups", f"""with {_PAIRS}
select 'flag' as field, flag as value, count(*) as n, sum(a)::bigint as baseline_correct, sum(b)::bigint as candidate_correct from pairs group by flag union all
select 'status', status, count(*), sum(a)::bigint, sum(b)::bigint from pairs group by status""")
def paired_groups(spark, sf):
    return paired.groups(_pairs(Tables(spark, sf)), ["flag", "status"])


@query("paired_rollup", f"""
select * from (with {_PAIRS}, {_report_sql('cluster', True)} select 'orders' as baseline_run, 'clustered' as candidate_run, n, exact_delta, exact_low as ci95_low, exact_high as ci95_high, valid_delta, passed from report)
union all select * from (with {_SUPPLIED}, {_report_sql('id', False)} select 'suppliers' as baseline_run, 'rows' as candidate_run, n, exact_delta, exact_low, exact_high, valid_delta, passed from report)""")
def paired_rollup(spark, sf):
    t = Tables(spark, sf)
    both = paired.reports([(_pairs(t), True), (_supplied(t), False)])
    name = lambda *names: F.element_at(F.array(*map(F.lit, names)), F.col("run") + 1)
    kept = paired.as_json(both, baseline_run=name("orders", "suppliers"), candidate_run=name("clustered", "rows"))
    r = build.rolled_up(kept, "report", "n long, exact struct<delta: double, ci95_low: double, ci95_high: double>, valid struct<delta: double>, gate struct<passed: boolean>")
    return r.select("baseline_run", "candidate_run", "n", F.col("exact.delta").alias("exact_delta"), "exact.ci95_low", "exact.ci95_high", F.col("valid.delta").alias("valid_delta"), F.col("gate.passed").alias("passed"))


@query("over_panels", """
with p as (select l_suppkey % 5 as step, l_returnflag as panel, avg((l_quantity > 25)::int) as e, avg((l_discount > 0.02)::int) as v from lineitem group by 1, 2)
select step, count(*) as n_panels, round(avg(e), 9) as macro_exact, round(min(v), 9) as min_valid from p group by 1""")
def over_panels(spark, sf):
    p = Tables(spark, sf).lineitem.groupBy((F.col("l_suppkey") % 5).alias("step"), F.col("l_returnflag").alias("panel")).agg(F.avg((F.col("l_quantity") > 25).cast("int")).alias("e"), F.avg((F.col("l_discount") > 0.02).cast("int")).alias("v"))
    return build.over_panels(p, "step", "e", "v")


@query("latest_checkpoint", """
with p as (select o_orderpriority as phase, 'runs/' || o_orderpriority || '/' || case when o_orderkey % 3 = 0 then 'checkpoint-' || o_orderkey when o_orderkey % 3 = 1 then 'checkpoint-best' else 'old-checkpoint-' || (o_orderkey + 1000000) end as path from orders),
s as (select phase, path, try_cast(nullif(regexp_extract(path, '/checkpoint-([0-9]+)$', 1), '') as bigint) as step from p)
select phase, max(step) as step, max_by(path, step) as path from s where step is not null group by 1""")
def latest_checkpoint(spark, sf):
    k = F.col("o_orderkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("checkpoint-"), k)).when(k % 3 == 1, F.lit("checkpoint-best")).otherwise(F.concat(F.lit("old-checkpoint-"), k + 1000000))
    p = Tables(spark, sf).orders.select(F.col("o_orderpriority").alias("phase"), F.concat(F.lit("runs/"), "o_orderpriority", F.lit("/"), name).alias("path"))
    return build.latest_checkpoint(p, "phase", "path")


@query("greatest_weights", "select p_partkey, round(p_retailprice - 1200, 6) as weight from part order by abs(round(p_retailprice - 1200, 6)) desc, p_partkey limit 20")
def greatest_weights(spark, sf):
    return build.greatest_weights(Tables(spark, sf).part.select("p_partkey", F.round(F.col("p_retailprice") - 1200, 6).alias("weight")), "p_partkey", "weight")


# Records of pairs, flags


@query("sft_records", f"with {_MINED} select id, 'Order ' || id as prompt, chosen as answer, 2 as n_turns from mined")
def sft_records(spark, sf):
    t = Tables(spark, sf)
    pairs = cand.as_sft(cand.mined_pairs(cand.aggregate(candidates(t)), truth(t), 4), F.concat(F.lit("Order "), F.col("id").cast("string")))
    return pairs.select("id", F.col("messages")[0]["content"].alias("prompt"), F.col("messages")[1]["content"].alias("answer"), F.size("messages").alias("n_turns"))


@query("dpo_records", f"with {_MINED} select id, 'Order ' || id as prompt, chosen, rejected from mined")
def dpo_records(spark, sf):
    t = Tables(spark, sf)
    return cand.as_dpo(cand.mined_pairs(cand.aggregate(candidates(t)), truth(t), 4), F.concat(F.lit("Order "), F.col("id").cast("string")))


@query("text_flags", """
select o_orderkey, coalesce(lower(trim(case o_orderkey % 7 when 0 then ' TRUE ' when 1 then '1' when 2 then 'Yes' when 3 then 'on' when 4 then '0' when 5 then 'no' end)) in ('1', 'true', 'yes', 'y', 'on'), false) as flag from orders""")
def text_flags(spark, sf):
    from quernel.functions.text import as_bool

    k = F.col("o_orderkey") % 7
    raw = F.when(k == 0, " TRUE ").when(k == 1, "1").when(k == 2, "Yes").when(k == 3, "on").when(k == 4, "0").when(k == 5, "no")
    return Tables(spark, sf).orders.select("o_orderkey", F.coalesce(as_bool(raw), F.lit(False)).alias("flag"))
