"""Data sets that are built whole: exports without torn entities, panels under quality control, balanced evaluation, listwise choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernel.operators import choose, export, graph, learn, qc, sample
from quernel.plans.base import Tables, query
from quernel.plans.choices import _CANDS, _cands

# Export: documents with equal beginnings share an image, with equal ends a key

_RECORDS = """
rec as (select doc_id as row, case when doc_id % 20 = 0 then 'eval' when doc_id % 20 in (1, 2) then 'manifest' else 'public' end as origin, 'd' || doc_id as id, sha1(substr(text, 1, 60)) as image, right(text, 60) as key, source,
  ['train', ' VAL', 'test', 'else'][doc_id % 4 + 1] as split, case when doc_id % 5 = 0 then (doc_id % 3)::int end as repeat_hint, case when n_chars < 40 then 'too_short' when doc_id % 31 = 7 then 'missing_image_file' end as problem from documents),
s as (select *, case when lower(trim(split)) in ('train', 'val', 'test') then lower(trim(split)) else 'train' end as sp from rec where problem is null),
lk as (select a.row as a, b.row as b from s a join s b on a.image = b.image union select a.row, b.row from s a join s b on a.key = b.key and a.key <> ''),
rc as (select row as node, row as reach from s union select lk.b, rc.reach from rc join lk on lk.a = rc.node),
cl as (select s.*, m.closure, case when origin = 'eval' then 'competition_eval' when origin = 'manifest' and sp = 'test' then 'auxiliary_eval' end as ev from s join (select node, min(reach) as closure from rc group by 1) m on m.node = s.row),
un as (select closure, max((ev is not null)::int) as e, max((origin = 'manifest' and sp = 'val')::int) as v, max((origin = 'manifest' and sp = 'train')::int) as t, min_by(source, row) as us from cl group by 1),
fr as (select *, row_number() over (partition by us order by sha256('23|' || closure), closure) as place, count(*) over (partition by us) as n from un where e + v + t = 0),
dec as (select closure, case when place <= case when n <= 10 then (n >= 5)::int else greatest(1, round_even(n * 0.05, 0)::int) end then 'val' else 'train' end as dest from fr
  union all select closure, case when e = 1 then 'held' when v = 1 then 'val' else 'train' end from un where e + v + t > 0),
pl as (select cl.row, origin, id, image, key, source, repeat_hint, closure, coalesce(ev, dest) as output, case when ev is null and dest = 'held' then 'entity_is_evaluated' end as reason from cl join dec using (closure)
  union all select row, origin, id, image, key, source, repeat_hint, null, 'skipped', problem from rec where problem is not null)"""


def _records(t: Tables):
    n = F.col("doc_id")
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    return t.documents.select(
        n.alias("row"), F.when(n % 20 == 0, "eval").when((n % 20).isin(1, 2), "manifest").otherwise("public").alias("origin"), F.concat(F.lit("d"), n).alias("id"), F.sha1(F.substring("text", 1, 60).cast("binary")).alias("image"),
        F.right("text", F.lit(60)).alias("key"), "source", pick(["train", " VAL", "test", "else"], n % 4).alias("split"), F.when(n % 5 == 0, (n % 3).cast("int")).alias("repeat_hint"),
        F.when(F.col("n_chars") < 40, "too_short").when(n % 31 == 7, "missing_image_file").alias("problem"),
    )


@query("split_export", f"with recursive {_RECORDS} select row, closure, output, reason from pl")
def split_export(spark, sf):
    return export.planned(_records(Tables(spark, sf)), 0.05, 23).select("row", "closure", "output", "reason")


@query("export_repeats", f"""with recursive {_RECORDS},
x as (select *, case when output = 'train' then greatest(1, coalesce(repeat_hint, 1), case when source = 'src3' then 1 else 1 end, case when length(key) >= 60 then 2 else 1 end, case when contains(key, '@') then 3 else 1 end) else 1 end as t from pl)
select row, output, case when t > 1 then id || '__rep' || i else id end as id, case when t > 1 then i::int end as repeat_index from x, lateral (select unnest(range(t)) as i)""")
def export_repeats(spark, sf):
    plan = export.planned(_records(Tables(spark, sf)), 0.05, 23)
    return export.expanded(plan, export.Repeats(long_key=2, stereo=3, long_from=60)).select("row", "output", "id", "repeat_index")


@query("export_report", f"""with recursive {_RECORDS}
select output, source, reason, count(*) as n, count(distinct closure) as n_entities from pl group by 1, 2, 3""")
def export_report(spark, sf):
    return export.export_report(export.planned(_records(Tables(spark, sf)), 0.05, 23))


@query("masked_records", "select doc_id, source as image_url, lang as prompt, 'mask' as prompt_tag, substr(text, 1, 20) as answer, 'no_mask' as answer_tag, 0 as matched_text_index from documents")
def masked_records(spark, sf):
    r = export.masked_record(F.col("source"), F.col("lang"), F.substring("text", 1, 20)).alias("r")
    d = Tables(spark, sf).documents.select("doc_id", r)
    text = lambda i, c: F.col("r.text_info")[i][c]
    image = F.col("r.image_info")[0]
    return d.select("doc_id", image["image_url"].alias("image_url"), text(0, "text").alias("prompt"), text(0, "tag").alias("prompt_tag"), text(1, "text").alias("answer"), text(1, "tag").alias("answer_tag"), image["matched_text_index"].alias("matched_text_index"))


# Dependencies and splits of entities


@query("functional_dependency", """
with c as (select p_brand, p_type, min(p_partkey) as w from part where p_brand is not null group by 1, 2)
select p_brand, count(*) as n_values, min(p_type) as value, min_by(w, p_type) as witness, max(p_type) as other_value, max_by(w, p_type) as other_witness from c group by 1 having count(*) > 1""")
def functional_dependency(spark, sf):
    return graph.dependency_conflicts(Tables(spark, sf).part, "p_brand", "p_type", "p_partkey")


@query("torn_entities", f"""with recursive {_RECORDS},
w as (select closure, sp, min(row) as w from cl group by 1, 2)
select closure, string_agg(sp, ',' order by sp) as splits, string_agg(w, ',' order by sp) as witnesses from w group by 1 having count(*) > 1""")
def torn_entities(spark, sf):
    d = _records(Tables(spark, sf)).where("problem is null")
    split = F.lower(F.trim("split"))
    closed = graph.entity_closure(d, "row", ["id", "image", "key"]).withColumn("split", F.when(split.isin("train", "val", "test"), split).otherwise("train"))
    return graph.torn_entities(closed, "closure", "split", "row").select("closure", F.array_join("splits", ",").alias("splits"), F.array_join(F.transform("witnesses", lambda x: x.cast("string")), ",").alias("witnesses"))


# Quality control of panels: parts are rows of panels, lines of orders name what is trained on

_QC = r"""
r as (select p_partkey as row, p_brand as panel, case when p_partkey % 41 <> 0 then 'P' || (p_partkey % 700) end as id, case p_partkey % 9 when 0 then '' when 1 then 'x\chemfig{}' when 2 then ' C(=O)' || p_partkey || ' ' when 3 then 'a b' else 'C' || (p_partkey % 900) end as label,
  'img/' || p_name as image, p_name as image_name, p_partkey % 13 <> 0 as resolved, case when p_partkey % 17 = 0 then false when p_partkey % 19 = 0 then null else true end as openable,
  case when p_partkey % 6 > 0 then (p_size * 10)::int end as width, (p_partkey % 500)::int as height, case when p_partkey % 29 = 0 then 'other' else 'canonical_smiles' end as eval_target, case when p_partkey % 23 = 0 then null when p_partkey % 4 = 0 then 'edu_set' else 'src' end as source,
  ['photo', 'clean', 'scan_bad', '', 'chinese_exam', null][p_size % 6 + 1] as difficulty, ['page_level', 'x', null][p_size % 3 + 1] as task_type, case when p_partkey % 31 = 0 then 'fail' else 'pass' end as qc_status from part),
t as (select distinct 'id' as kind, 'P' || (l_partkey % 700) as value from lineitem where l_suppkey % 50 = 1 union select 'image_name', p_name from lineitem join part on p_partkey = l_partkey where l_suppkey % 60 = 3 union select 'label', 'C' || (l_partkey % 900) from lineitem where l_suppkey % 70 = 5),
n as (select row, panel, coalesce(id, '') as id, trim(label) as label, image, image_name, coalesce(resolved, false) as resolved, coalesce(openable, false) as openable, width, height, eval_target, source, difficulty, coalesce(task_type, '') as task_type, qc_status from r),
c as (select n.*, id <> '' as id_present, count(*) over (partition by panel, id) = 1 as unique_id_within_panel, resolved as image_path_resolved, resolved and openable as image_openable, label <> '' as label_nonempty,
  regexp_full_match(label, '[A-Za-z0-9\[\]()@+\-=#$:/\\.%,*]+') and not contains(label, '\chemfig') and not contains(label, 'ssml') and not contains(label, '\xrightarrow') and not contains(label, '\rightarrow') as label_looks_like_smiles,
  eval_target = 'canonical_smiles' as eval_target_is_canonical_smiles, coalesce(source, '') <> '' as source_present, coalesce(difficulty, '') <> '' as difficulty_present, qc_status = 'pass' as qc_status_pass_in_label,
  id not in (select value from t where kind = 'id') as no_train_id_overlap, image_name not in (select value from t where kind = 'image_name') as no_train_image_name_overlap, label not in (select value from t where kind = 'label') as no_train_smiles_overlap,
  count(*) over (partition by panel, label) > 1 as duplicate_smiles_within_panel, coalesce(width > 0 and height > 0 and least(width, height) < 96, false) as min_side_under_96 from n),
m as (select *, id_present and unique_id_within_panel and image_path_resolved and image_openable and label_nonempty and label_looks_like_smiles and eval_target_is_canonical_smiles and source_present and difficulty_present and qc_status_pass_in_label
  and no_train_id_overlap and no_train_image_name_overlap and no_train_smiles_overlap as good from c)"""


def _panels(t: Tables):
    k, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))
    label = F.when(k % 9 == 0, "").when(k % 9 == 1, "x\\chemfig{}").when(k % 9 == 2, F.concat(F.lit(" C(=O)"), k, F.lit(" "))).when(k % 9 == 3, "a b").otherwise(F.concat(F.lit("C"), k % 900))
    rows = t.part.select(
        k.alias("row"), F.col("p_brand").alias("panel"), F.when(k % 41 != 0, F.concat(F.lit("P"), k % 700)).alias("id"), label.alias("label"), F.concat(F.lit("img/"), "p_name").alias("image"), F.col("p_name").alias("image_name"), (k % 13 != 0).alias("resolved"),
        F.when(k % 17 == 0, False).when(k % 19 == 0, None).otherwise(True).alias("openable"), F.when(k % 6 > 0, size * 10).alias("width"), (k % 500).cast("int").alias("height"), F.when(k % 29 == 0, "other").otherwise("canonical_smiles").alias("eval_target"),
        F.when(k % 23 == 0, None).when(k % 4 == 0, "edu_set").otherwise("src").alias("source"), pick(["photo", "clean", "scan_bad", "", "chinese_exam", None], size % 6).alias("difficulty"), pick(["page_level", "x", None], size % 3).alias("task_type"),
        F.when(k % 31 == 0, "fail").otherwise("pass").alias("qc_status"),
    )
    lines, s = t.lineitem, F.col("l_suppkey")
    entry = lambda kind, value: (F.lit(kind).alias("kind"), value.alias("value"))
    index = lines.where(s % 50 == 1).select(*entry("id", F.concat(F.lit("P"), F.col("l_partkey") % 700)))
    index = index.unionByName(lines.where(s % 60 == 3).join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(*entry("image_name", F.col("p_name"))))
    return rows, index.unionByName(lines.where(s % 70 == 5).select(*entry("label", F.concat(F.lit("C"), F.col("l_partkey") % 900))))


@query("qc_manifest", f"""with {_QC}
select row, panel, panel || '::' || id as panel_sample_id, substr(sha1(label), 1, 12) as label_hash, {", ".join(qc.RULES + qc.WARNINGS)}, case when good then 'pass' else 'fail' end as rule_status, case when good then 'pass' else 'needs_review' end as human_review_status,
  case when not good then 'rule_failed_needs_manual_check' when task_type in ('document_embed', 'journal_fig', 'multi_grid', 'page_level') then 'region_target_clear_enough_for_eval' when contains(source, 'edu') or difficulty = 'chinese_exam' then 'edu_single_molecule_case_accepted'
    when contains(difficulty, 'photo') or contains(difficulty, 'scan') then 'visual_degradation_accepted' else 'single_target_image_label_accepted' end as human_review_reason, case when good then 'pass' else 'fail' end as qc_status from m""")
def qc_manifest(spark, sf):
    made = qc.manifest(*_panels(Tables(spark, sf)))
    return made.select("row", "panel", "panel_sample_id", "label_hash", *qc.RULES, *qc.WARNINGS, "rule_status", "human_review_status", "human_review_reason", "qc_status")


@query("qc_summary", f"""with {_QC}
select panel, count(*) as n, count_if(good) as passed, count_if(not good) as failed, count(distinct id) as unique_ids, count(*) - count(distinct id) as duplicate_ids, count(distinct label) as unique_labels, count(*) - count(distinct label) as duplicate_labels,
  min(width) filter (width > 0 and height > 0) as min_width, min(height) filter (width > 0 and height > 0) as min_height, max(width) filter (width > 0 and height > 0) as max_width, max(height) filter (width > 0 and height > 0) as max_height from m group by 1""")
def qc_summary(spark, sf):
    return qc.panel_summary(qc.manifest(*_panels(Tables(spark, sf))))


@query("qc_reasons", f"""with {_QC}
select * from ({" union all ".join([f"select panel, '{r}' as reason, count_if(not {r}) as n from m group by 1" for r in qc.RULES] + [f"select panel, '{w}', count_if({w}) from m group by 1" for w in qc.WARNINGS])}) where n > 0""")
def qc_reasons(spark, sf):
    return qc.panel_reasons(qc.manifest(*_panels(Tables(spark, sf))))


# Balanced evaluation

_FILLED = """
q0 as (select *, row_number() over (order by n, s) - 1 as i, count(*) over () as k, coalesce(sum(n) over (order by n, s rows between unbounded preceding and 1 preceding), 0) as before from h),
q1 as (select *, greatest({target} - before, 0) // (k - i) as level from q0),
q2 as (select min(i) as fi from q1 where n > level),
q as (select q1.s, q1.n, case when fi is null or q1.i < fi then q1.n else f.level + ((q1.i - fi) < greatest({target} - f.before, 0) - f.level * (f.k - fi))::int end::bigint as quota from q1 left join q2 on true left join q1 f on f.i = fi)"""


@query("water_filled_quotas", f"with h as (select source as s, count(*) as n from documents group by 1), {_FILLED.format(target=300)} select s as source, n, quota from q")
def water_filled_quotas(spark, sf):
    h = Tables(spark, sf).documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return sample.water_filled(h, "source", "n", 300)


@query("controlled_eval", f"""
with d as (select doc_id, substr(text, 1, 40) as k, source || '|' || lang as s from documents), e as (select distinct k from d where doc_id % 7 = 0),
o as (select * from (select *, row_number() over (partition by k order by doc_id) as r from d where k is not null and k not in (select k from e)) where r = 1),
h as (select s, count(*) as n from o group by 1), {_FILLED.format(target=200)},
p as (select o.*, row_number() over (partition by o.s order by sha256('7|' || k), k) as place from o)
select doc_id, image_type, difficulty from p join q on q.s = p.s and place <= quota, (values ('print_page', 'document_embed'), ('exam_page', 'chinese_exam'), ('photo_sim', 'photo'), ('scan_sim', 'scan')) as v(image_type, difficulty)""")
def controlled_eval(spark, sf):
    d = Tables(spark, sf).documents.select("doc_id", F.substring("text", 1, 40).alias("k"), F.concat_ws("|", "source", "lang").alias("s"))
    styles = {"print_page": "document_embed", "exam_page": "chinese_exam", "photo_sim": "photo", "scan_sim": "scan"}
    return sample.controlled_eval(d, d.where("doc_id % 7 = 0"), "k", "doc_id", "s", styles, 200, 7).select("doc_id", "image_type", "difficulty")


@query("group_holdout", """
with recursive d as (select doc_id, source as g, substr(sha1(text), 1, 12) as k from documents),
g as (select g, list_sort(list(distinct k)) as ks, row_number() over (order by sha256('2026|' || g), g) as i from d where k is not null group by 1),
w as (select 0::bigint as i, []::varchar[] as seen, 0 as n, []::varchar[] as got, null::varchar as g
  union all
  select x.i, list_concat(w.seen, x.new), w.n + (len(x.new) > 0)::int, x.new, x.g from w join lateral (select g.i, g.g, list_slice(list_filter(g.ks, lambda k: not list_contains(w.seen, k)), 1, 5) as new from g where g.i = w.i + 1) x on true where len(w.seen) < 60 or w.n < 3),
p as (select g, unnest(got) as k from w where len(got) > 0), t as (select distinct g from p),
m as (select d.*, row_number() over (partition by d.g, d.k order by doc_id) as r, p.k is not null as pick, t.g is not null as taken, d.k in (select k from p) as key_taken from d left join p on p.g = d.g and p.k = d.k left join t on t.g = d.g)
select g as source, case when pick and r = 1 then 'locked' when taken or key_taken then 'excess' else 'train' end as split, count(*) as n, count(distinct k) as n_keys from m group by 1, 2""")
def group_holdout(spark, sf):
    d = Tables(spark, sf).documents.select("doc_id", "source", F.substring(F.sha1("text"), 1, 12).alias("k"))
    return sample.group_holdout(d, "source", "k", 60, 5, 3, 2026).groupBy("source", "split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("k").alias("n_keys"))


# Listwise choice

_CHOICE = """
x as (select id, canonical, votes::double as votes, max_score / 50 as s, length(canonical)::double as l, (ascii(canonical) + votes) % 3 = 0 as positive, case when id % 7 = 0 then 0.0::double else 1.0 + id % 3 end as w, row_number() over (partition by id order by ((ascii(canonical) + votes) % 3 = 0) desc, votes desc, canonical) as r from every where max_score > -1e5),
z as (select id, count(*) as n, count_if(positive) as p, max(w) as w from x group by 1),
ex as (select x.* from x join z using (id) where z.p > 0 and z.n > 1 and z.w > 0 and (positive or r <= 4))"""


def _choice_rows(t: Tables):
    a = choose.aggregates(_cands(t)).where("max_score > -1e5")
    positive = (F.ascii("canonical") + F.col("votes")) % 3 == 0
    weight = F.when(F.col("id") % 7 == 0, 0.0).otherwise(1.0 + F.col("id") % 3)
    rows = a.select("id", "canonical", F.col("votes").cast("double").alias("votes"), (F.col("max_score") / 50).alias("s"), F.length("canonical").cast("double").alias("l"), positive.alias("positive"), weight.alias("w"))
    return learn.choice_examples(rows, "id", "positive", "w", [F.col("votes").desc(), F.col("canonical")], 4)


@query("choice_examples", f"with {_CANDS}, {_CHOICE} select case when p = 0 then 'no_oracle_positive' when n <= 1 then 'single_candidate' when w <= 0 then 'zero_weight' else 'accepted' end as reason, count(*) as n from z group by 1")
def choice_examples(spark, sf):
    return _choice_rows(Tables(spark, sf))[1]


@query("choice_gradient", f"""with {_CANDS}, {_CHOICE},
sc as (select *, 0.3 * votes - 0.2 * s + 0.1 * l as sc from ex),
mx as (select *, max(sc) over (partition by id) as m, max(case when positive then sc end) over (partition by id) as mp, max(case when not positive then sc end) over (partition by id) as mn, count(*) over (partition by id) as size from sc),
ee as (select *, sum(exp(sc - m)) over (partition by id) as z, sum(case when positive then exp(sc - mp) else 0 end) over (partition by id) as zp, sum((positive and sc = mp)::int) over (partition by id) as tp, sum((not positive and sc = mn)::int) over (partition by id) as tn from mx),
co as (select *, exp(sc - m) / z - case when positive then exp(sc - mp) / zp else 0 end + coalesce(0.5 / (1 + exp(mp - mn)), 0) * (coalesce((not positive and sc = mn)::int / nullif(tn, 0), 0) - (positive and sc = mp)::int / tp) as c,
  ln(z) + m - ln(zp) - mp + coalesce(0.5 * ln(1 + exp(mn - mp)), 0) as loss from ee)
select round(sum(w * loss / size) / sum(w / size), 6) as loss, round(sum(w * c * votes) / sum(w / size), 6) as votes, round(sum(w * c * s) / sum(w / size), 6) as s, round(sum(w * c * l) / sum(w / size), 6) as l from co""")
def choice_gradient(spark, sf):
    rows = _choice_rows(Tables(spark, sf))[0]
    g = learn.choice_gradient(rows, "id", "positive", "w", ["votes", "s", "l"], [0.3, -0.2, 0.1], 0.5)
    return g.select(*[F.round(c, 6).alias(c) for c in ("loss", "votes", "s", "l")])
