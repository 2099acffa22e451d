"""The queries of this subpackage, with their production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernel.llm.line_cleaning import SEPARATORS, LineRules


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quernel.llm.token_output import token_digest

    return token_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernel.llm.toxicity import toxicity_digest

    return toxicity_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernel.llm.suffix_dedup import repeats_digest

    return repeats_digest(_table(spark, sf_dir, "documents"), length=50)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernel.llm.decontaminate import contamination_digest

    return contamination_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), n=10)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernel.llm.license_scan import license_digest

    return license_digest(_table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quernel.llm.bpe import bpe_digest

    return bpe_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernel.llm.substring_dedup import repeats_digest

    return repeats_digest(_table(spark, sf_dir, "documents"), length=13)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernel.llm.jaccard_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"), n=4, percent=85)


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernel.llm.embedding_dedup import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.98)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernel.llm.language_id import language_digest

    return language_digest(_table(spark, sf_dir, "documents"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernel.llm.line_cleaning import quality_digest

    return quality_digest(_table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernel.llm.centroid_clustering import clusters_digest

    return clusters_digest(_table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernel.llm.hard_negatives import negatives_digest

    return negatives_digest(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_token_output": op1_token_output,
    "op2_toxicity": op2_toxicity,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_license_scan": op5_license_scan,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_language_id": op10_language_id,
    "op11_quality_rules": op11_quality_rules,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_hard_negatives": op13_hard_negatives,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: DuckDB SQL over whole tables. For op3 (strings of bytes) it is too slow; tokenizers and trained models are beyond SQL.
SQL: dict[str, str] = {
    "op4_decontamination": rf"""
with d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (select item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark where item_id is not null),
bl as (select item_id, ws, least(10, len(ws)) as l from b where len(ws) > 0),
bw as (select distinct item_id, l, array_to_string(ws[i:i + l - 1], ' ') as k from (select item_id, l, ws, unnest(range(1, len(ws) - l + 2)) as i from bl)),
dw as (select doc_id, l, i, array_to_string(ws[i:i + l - 1], ' ') as k from (select doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) as i from d, (select distinct l from bw) where len(ws) >= l)),
h as (select doc_id, item_id, i, bw.l from dw join bw on bw.k = dw.k and bw.l = dw.l),
n as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + l)) as p from h) group by 1),
it as (select doc_id, count(distinct item_id) as n_items, array_to_string(list_sort(list(distinct cast(item_id as varchar))), ',') as items from h group by 1)
select d.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n using (doc_id) left join it using (doc_id)""",
    "op7_substring_dedup": r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
w as (select doc_id, i, array_to_string(ws[i:i + 12], ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from d where len(ws) >= 13)),
o as (select k, min(doc_id) as owner from w group by 1 having count(distinct doc_id) > 1),
g as (select distinct doc_id, unnest(range(i, i + 13)) as p from w join o using (k) where owner < doc_id),
r as (select doc_id, count(*) as n, list(p) as ps from g group by 1)
select d.doc_id, len(ws)::bigint as n_words, coalesce(n, 0) as n_removed,
  sha256(case when n is null then array_to_string(ws, ' ') else coalesce((select string_agg(ws[j], ' ' order by j) from (select unnest(range(1, len(ws) + 1)) as j) where not list_contains(ps, j)), '') end) as kept_sha256
from d left join r using (doc_id)""",
    "op8_jaccard_join": rf"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, case when len(ws) < 4 then array_to_string(ws, ' ') else array_to_string(ws[i:i + 3], ' ') end as k from (select doc_id, ws, unnest(range(1, greatest(2, len(ws) - 2))) as i from d where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.k = b.k and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
r as (select doc_id as node, doc_id as reach from d union select l.b, r.reach from r join l on l.a = r.node),
m as (select node, min(reach) as component_id from r group by 1)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.component_id from d join m on m.node = d.doc_id left join n on n.doc_id = d.doc_id""",
    "op9_embedding_dedup": """
with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings
    where label is not null and vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
n as (select *, sqrt(list_inner_product(e, e)) as norm from v),
l as (select a.vec_id as a, b.vec_id as b from n a join n b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
c as (select vec_id as node, vec_id as reach from embeddings union select l.b, c.reach from c join l on l.a = c.node),
m as (select node, min(reach) as component_id from c group by 1)
select e.vec_id, coalesce(k.n, 0) as n_links, m.component_id, m.component_id = e.vec_id as kept from embeddings e join m on m.node = e.vec_id left join (select a, count(*) as n from l group by 1) k on k.a = e.vec_id""",
}


def _lines_sql() -> str:
    p = {k: v.replace("'", "''") for k, v in LineRules().patterns().items()}
    word = r"[^\x20\x09-\x0D]+"
    return rf"""
with d as (select doc_id, text, regexp_extract_all(coalesce(text, ''), '{word}') as ws, string_split(coalesce(text, ''), chr(10)) as ls from documents),
g as (select doc_id, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] as k from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from d where len(ws) >= 3)),
o as (select doc_id, k from g group by 1, 2 having count(*) > 1),
c as (select doc_id, count(distinct p) as n_repeat from (select g.doc_id, unnest([i, i + 1, i + 2]) as p from g join o on o.doc_id = g.doc_id and o.k = g.k) group by 1),
l as (select doc_id, line, n, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) as size, n - row_number() over (partition by doc_id, line order by n) as later,
    row_number() over (partition by doc_id, line order by n) > 1 as dup, len(regexp_extract_all(line, '{word}')) as nw
  from (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as n from d) where regexp_matches(line, '{word}')),
r as (select *, case
    when (length(line) - length(translate(line, '{SEPARATORS}', '')) >= 2 and (length(line) - length(translate(line, '{SEPARATORS}', ''))) * 4 >= nw) or (length(line) < 200 and regexp_matches(line, '{p["menu"]}')) then 1
    when nw <= 60 and regexp_matches(line, '{p["phrase"]}') then 2
    when nw >= 5 and (length(line) - length(translate(line, '!?', ''))) * 2 > nw then 3
    when 100 * (length(line) - length(translate(line, '#*$%&|<>', ''))) > 10 * length(line) then 3
    when not regexp_matches(line, '{p["end"]}') and len(regexp_extract_all(line, '{p["ends"]}')) * 60 < nw then 3
    else 0 end as rule from l),
s as (select doc_id, sum(size)::bigint as chars, count_if(dup) as dups, coalesce(sum(size) filter (rule > 0), 0)::bigint as lost, count_if(rule = 1) as r1, count_if(rule = 2) as r2, count_if(rule = 3) as r3 from r group by 1),
f as (select d.doc_id, len(ws)::bigint as n_words, coalesce(chars, 0) as word_chars, (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')))::bigint as n_symbols, coalesce(dups, 0) as n_dup_lines,
    coalesce(n_repeat, 0) as n_repeat_words, coalesce(lost, 0) as lost_chars, coalesce(r1, 0) as n_navigation, coalesce(r2, 0) as n_boilerplate, coalesce(r3, 0) as n_punctuation
  from d left join s using (doc_id) left join c using (doc_id))
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 100 * lost_chars <= 30 * word_chars as kept from f"""


_SOUND = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"


def _clusters_sql(k: int = 8, rounds: int = 10) -> str:
    assign = "select v.vec_id, v.x, min(row(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint, c.c)) as best from v, c{0} c group by v.vec_id, v.x"
    steps = [
        f"v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as x from embeddings where {_SOUND} and len(embedding) = 64)",
        f"c0 as (select row_number() over (order by h) - 1 as c, x from (select x, sha256('3:' || vec_id) as h from v order by h limit {k}))",
    ]
    for r in range(rounds):
        steps.append(f"a{r} as materialized ({assign.format(r)})")
        steps.append(
            f"m{r} as (select c, list((s - ((s % n) + n) % n) // n order by i)::bigint[] as x from (select best[2] as c, i, sum(y)::hugeint as s, count(*)::hugeint as n from (select best, unnest(x) as y, generate_subscripts(x, 1) as i from a{r}) group by 1, 2) group by c)"
        )
        steps.append(f"c{r + 1} as materialized (select o.c, coalesce(m.x, o.x) as x from c{r} o left join m{r} m on m.c = o.c)")
    steps.append(f"a as (select vec_id, best[2]::int as cluster, best[1] as distance from ({assign.format(rounds)}))")
    return f"""with {", ".join(steps)}
select vec_id, cluster, distance, (sum(distance) over (partition by cluster))::bigint as cluster_inertia, (sum(distance) over ())::bigint as inertia, sha256(array_to_string(c{rounds}.x, ',')) as centroid_sha256
from a join c{rounds} on c{rounds}.c = a.cluster"""


_NEGATIVES = f"""
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as x from embeddings where label is not null and vec_id is not null and {_SOUND}),
s as (select a.vec_id as anchor_id, a.label = e.label as same, e.vec_id as id, list_sum(list_transform(list_zip(a.x, e.x), lambda p: p[1] * p[2]))::bigint as score from e a join e on e.vec_id <> a.vec_id where a.vec_id % 100 = 0),
p as (select anchor_id, id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select anchor_id, positive_id, (row_number() over (partition by anchor_id, positive_id order by score desc, id))::int as rank, id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
qualify rank <= 5"""

SQL |= {"op11_quality_rules": _lines_sql(), "op12_centroid_clustering": _clusters_sql(), "op13_hard_negatives": _NEGATIVES}
