"""Scans, projections, filters, joins, dedup, caps, splits and mixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernel.functions import keys, text
from quernel.operators import measure, rank, relate, sample, shape
from quernel.plans.base import Tables, query


@query("curate_leak_safe_mix", r"""
with norm as (select *, sha1(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) as k from documents),
once as (select * from (select *, row_number() over (partition by k order by doc_id) as rn from norm where text is not null and n_chars >= 100) where rn = 1),
clean as (select * from once o where not exists (select 1 from benchmark b where contains(o.text, b.text))),
capped as (select *, row_number() over (partition by source order by sha256('7|' || doc_id), doc_id) as r from clean)
select coalesce(source, 'unknown') as source, coalesce(lang, 'unknown') as lang, count(*) as n from capped where r <= 40 group by 1, 2""")
def curate_leak_safe_mix(spark, sf):
    t = Tables(spark, sf)
    docs = shape.accepted(t.documents, [(F.col("text").isNull(), "empty"), (F.coalesce(F.col("n_chars") < 100, F.lit(True)), "short")])
    once = rank.best(docs.withColumn("k", F.sha1(text.collapsed("text"))), "k", [F.col("doc_id")])
    leaks = relate.containing(once.select("doc_id", "text"), t.benchmark.select(F.col("text").alias("passage")), "text", "passage").select("doc_id")
    kept = sample.capped(relate.unseen(once, leaks, "doc_id"), "source", "doc_id", 40, 7)
    return kept.groupBy(F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("lang", F.lit("unknown")).alias("lang")).agg(F.count(F.lit(1)).alias("n"))


def _message(order: str) -> str:
    return rf"""
select conv_id, turn, text from (
  select conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') as text, row_number() over (partition by conv_id order by turn {order}, text {order}) as r
  from conversations where role = 'assistant') where r = 1"""


@query("last_assistant_message", _message("desc"))
def last_assistant_message(spark, sf):
    return shape.message_of(Tables(spark, sf).conversations, "conv_id", "turn")


@query("first_assistant_message", _message("asc"))
def first_assistant_message(spark, sf):
    return shape.message_of(Tables(spark, sf).conversations, "conv_id", "turn", last=False)


@query("messages_to_sft_reshape", r"""
with u as (select conv_id, arg_min(regexp_replace(text, '^\s+|\s+$', '', 'g'), turn) as q from conversations where role = 'user' group by 1),
a as (select conv_id, arg_max(regexp_replace(text, '^\s+|\s+$', '', 'g'), turn) as x from conversations where role = 'assistant' group by 1)
select conv_id, 'conv/' || conv_id || '.png' as image, 'user' as first_role, q as first_content, 'assistant' as last_role, x as last_content, length(x) as answer_chars
from u join a using (conv_id)""")
def messages_to_sft_reshape(spark, sf):
    c = Tables(spark, sf).conversations
    q = shape.message_of(c, "conv_id", "turn", "user", last=False).select("conv_id", F.col("text").alias("q"))
    a = shape.message_of(c, "conv_id", "turn").select("conv_id", F.col("text").alias("x"))
    image = F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit(".png"))
    rows = q.join(a, "conv_id").select("conv_id", shape.as_messages(F.col("q"), F.col("x"), image, chars=F.length("x").cast("long")).alias("m"))
    return rows.select("conv_id", F.col("m.images")[0].alias("image"), F.col("m.messages")[0]["role"].alias("first_role"), F.col("m.messages")[0]["content"].alias("first_content"), F.col("m.messages")[1]["role"].alias("last_role"), F.col("m.messages")[1]["content"].alias("last_content"), F.col("m.meta.chars").alias("answer_chars"))


@query("label_coalesce", """
select event_id, coalesce(nullif(trim(props ->> '$.label'), ''), nullif(trim(event_type), ''), nullif(trim(cast(user_id as varchar)), '')) as label,
  case when nullif(trim(props ->> '$.label'), '') is not null then 'label' when nullif(trim(event_type), '') is not null then 'event_type' else 'user' end as field
from events""")
def label_coalesce(spark, sf):
    e = Tables(spark, sf).events.withColumn("label", F.get_json_object("props", "$.label")).withColumn("user", F.col("user_id").cast("string"))
    return e.select("event_id", shape.first_filled(["label", "event_type", "user"]).alias("f")).select("event_id", F.col("f.text").alias("label"), F.col("f.field").alias("field"))


@query("nested_json_path", """
select cast(props ->> '$.k' as int) as k, count(*) as n, round(sum(value), 4) as total from events group by 1""")
def nested_json_path(spark, sf):
    e = Tables(spark, sf).events
    return e.groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("length_bins", """
select case when n_chars <= 500 then 'short' when n_chars <= 2000 then 'medium' when n_chars <= 8000 then 'long' when n_chars is not null then 'huge' end as bin, lang, count(*) as n
from documents group by 1, 2""")
def length_bins(spark, sf):
    d = Tables(spark, sf).documents
    return d.groupBy(shape.binned("n_chars", [500, 2000, 8000], ["short", "medium", "long", "huge"]).alias("bin"), "lang").agg(F.count(F.lit(1)).alias("n"))


@query("bucket_rules", """
with b as (select case when p_size >= 40 and p_retailprice > 1500 then 'large_dear' when p_type like '%STEEL%' then 'steel' when p_size < 10 then 'small' end as bucket, * from part)
select bucket, count(*) as n, min(p_partkey) as first_part from b where bucket is not null group by 1""")
def bucket_rules(spark, sf):
    p = Tables(spark, sf).part
    b = shape.bucketed([((F.col("p_size") >= 40) & (F.col("p_retailprice") > 1500), "large_dear"), (F.col("p_type").contains("STEEL"), "steel"), (F.col("p_size") < 10, "small")])
    return p.withColumn("bucket", b).where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_part"))


@query("multi_bucket_explode", """
select bucket, count(*) as n, sum(n_chars)::bigint as chars from (
  select 'long' as bucket, n_chars from documents where n_chars > 3000
  union all select 'english', n_chars from documents where lang = 'en'
  union all select 'hot_source', n_chars from documents where source = 'src0') group by 1""")
def multi_bucket_explode(spark, sf):
    d = Tables(spark, sf).documents
    m = shape.multi_bucketed(d, [(F.col("n_chars") > 3000, "long"), (F.col("lang") == "en", "english"), (F.col("source") == "src0", "hot_source")])
    return m.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


_REASON = """case when text is null or text = '' then 'empty' when n_chars < 100 then 'short' when toxic = 1 then 'toxic' when quality = 0 then 'low_quality' else 'accepted' end"""


@query("reason_filter_counts", f"""
select {_REASON} as reason, count(*) as n from documents left join labels using (doc_id) group by 1""")
def reason_filter_counts(spark, sf):
    t = Tables(spark, sf)
    rules = [(F.col("text").isNull() | (F.col("text") == ""), "empty"), (F.col("n_chars") < 100, "short"), (F.col("toxic") == 1, "toxic"), (F.col("quality") == 0, "low_quality")]
    return shape.with_reason(t.documents.join(t.labels, "doc_id", "left"), rules).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("accept_skip_split", f"""
select lang, sum(case when r = 'accepted' then 1 else 0 end)::bigint as accepted, sum(case when r <> 'accepted' then 1 else 0 end)::bigint as skipped
from (select lang, {_REASON} as r from documents left join labels using (doc_id)) group by 1""")
def accept_skip_split(spark, sf):
    from quernel.sources.readers import split_by_reason

    t = Tables(spark, sf)
    rules = [(F.col("text").isNull() | (F.col("text") == ""), "empty"), (F.col("n_chars") < 100, "short"), (F.col("toxic") == 1, "toxic"), (F.col("quality") == 0, "low_quality")]
    ok, skipped = split_by_reason(t.documents.join(t.labels, "doc_id", "left"), rules)
    both = ok.select("lang", F.lit(1).alias("a"), F.lit(0).alias("s")).unionByName(skipped.select("lang", F.lit(0).alias("a"), F.lit(1).alias("s")))
    return both.groupBy("lang").agg(F.sum("a").alias("accepted"), F.sum("s").alias("skipped"))


@query("rule_matrix_qc", """
with c as (select coalesce(text <> '', false) as has_text, coalesce(n_chars >= 100, false) as long_enough, coalesce(lang in ('en','de','fr','es'), false) as known_lang,
  coalesce(quality = 1, false) as good_quality, coalesce(toxic = 0, false) as clean from documents left join labels using (doc_id))
select 'has_text' as rule, sum(case when has_text then 0 else 1 end)::bigint as n_failed from c
union all select 'long_enough', sum(case when long_enough then 0 else 1 end)::bigint from c
union all select 'known_lang', sum(case when known_lang then 0 else 1 end)::bigint from c
union all select 'good_quality', sum(case when good_quality then 0 else 1 end)::bigint from c
union all select 'clean', sum(case when clean then 0 else 1 end)::bigint from c""")
def rule_matrix_qc(spark, sf):
    t = Tables(spark, sf)
    rules = {"has_text": F.col("text") != "", "long_enough": F.col("n_chars") >= 100, "known_lang": F.col("lang").isin("en", "de", "fr", "es"), "good_quality": F.col("quality") == 1, "clean": F.col("toxic") == 0}
    return shape.failures_by_rule(shape.rule_matrix(t.documents.join(t.labels, "doc_id", "left"), rules), list(rules))


@query("source_rename_passthrough", """
select coalesce(map {'src0': 'hot', 'src1': 'first'}[source], source) as source, count(*) as n from documents group by 1""")
def source_rename_passthrough(spark, sf):
    return Tables(spark, sf).documents.groupBy(shape.renamed_source("source", {"src0": "hot", "src1": "first"}).alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query("composite_groups", """
select coalesce(nullif(trim(c_mktsegment), ''), 'unknown') || '|' || coalesce(cast(c_nationkey as varchar), 'unknown') as grp, count(*) as n from customer group by 1""")
def composite_groups(spark, sf):
    return Tables(spark, sf).customer.groupBy(shape.composite("c_mktsegment", "c_nationkey").alias("grp")).agg(F.count(F.lit(1)).alias("n"))


@query("token_bag_overlap", r"""
with p as (select a.conv_id, a.turn, string_split(regexp_replace(a.text, '\s+', ' ', 'g'), ' ') as x, string_split(regexp_replace(b.text, '\s+', ' ', 'g'), ' ') as y
  from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1),
xs as (select conv_id, turn, w, count(*) as n from (select conv_id, turn, unnest(x) as w from p) where w <> '' group by 1, 2, 3),
ys as (select conv_id, turn, w, count(*) as n from (select conv_id, turn, unnest(y) as w from p) where w <> '' group by 1, 2, 3)
select p.conv_id, p.turn, coalesce(sum(case when ys.n is not null then least(xs.n, ys.n) end), 0)::bigint as shared
from p left join xs on xs.conv_id = p.conv_id and xs.turn = p.turn left join ys on ys.conv_id = p.conv_id and ys.turn = p.turn and ys.w = xs.w group by 1, 2""")
def token_bag_overlap(spark, sf):
    c = Tables(spark, sf).conversations
    words = lambda x: F.filter(F.split(x, r"\s+"), lambda w: w != "")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("y"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", text.bag_overlap(words("text"), words("y")).cast("long").alias("shared"))


@query("edit_similarity", """
select p_partkey, case when greatest(length(p_name), length(p_brand)) = 0 then 1.0 else round(1.0 - levenshtein(p_name, p_brand)::double / greatest(length(p_name), length(p_brand)), 9) end as similarity from part""")
def edit_similarity(spark, sf):
    return Tables(spark, sf).part.select("p_partkey", F.round(text.edit_similarity("p_name", "p_brand"), 9).alias("similarity"))


@query("penalty_score", r"""
with t as (select page_id, regexp_replace(coalesce(url, ''), '^\s+|\s+$', '', 'g') as t from pages),
c as (select page_id, t, regexp_replace(t, '\s+', '', 'g') as c from t),
m as (select page_id, t, c, length(c) - length(replace(c, '(', '')) as o, length(c) - length(replace(c, ')', '')) as e, length(c) - length(replace(c, '[', '')) as p, length(c) - length(replace(c, ']', '')) as q,
  len(list_filter(range(10), lambda d: ((length(c) - length(replace(c, d::varchar, ''))) - (length(c) - length(replace(c, '%' || d, ''))) // 2) % 2 = 1)) as single,
  len(list_filter(range(100), lambda d: ((length(c) - length(replace(c, '%' || lpad(d::varchar, 2, '0'), ''))) // 3) % 2 = 1)) as double from c)
select page_id, case when t = '' then 1000 else (t <> c)::int * 2 + 4 * (abs(o - e) + abs(p - q)) + 3 * (single + double)
  + 8 * (contains(lower(t), 'smiles')::int + contains(lower(t), 'assistant')::int + contains(lower(t), 'user')::int + contains(lower(t), 'molecule')::int + contains(lower(t), 'canonical')::int + contains(lower(t), 'ocr')::int)
  + case when length(c) > 256 then least(50, (length(c) - 256) // 16) else 0 end end::int as penalty from m""")
def penalty_score(spark, sf):
    return Tables(spark, sf).pages.select("page_id", text.structure_penalty("url").alias("penalty"))


def _cut(openings: list[str]) -> str:
    """SQL: the trimmed text without each opening in turn."""
    out = r"regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')"
    steps = [f"s0 as (select conv_id, turn, {out} as s from conversations)"]
    for i, o in enumerate(openings):
        steps.append(rf"s{i + 1} as (select conv_id, turn, case when starts_with(s, '{o}') then regexp_replace(substr(s, {len(o) + 1}), '^\s+|\s+$', '', 'g') else s end as s from s{i})")
    return ", ".join(steps) + rf", l as (select conv_id, turn, list_filter(list_transform(regexp_split_to_array(s, '[\n\r\x0b\x0c]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as ls from s{len(openings)})"


@query("clean_prefixes", f"""with {_cut(['tell', 'User:tell', 'User: tell', 'user:tell', 'user: tell', 'assistant', 'Assistant', 'user', 'User', 'User:', 'user:', 'Assistant:', 'assistant:', 'OCR:'])}
select conv_id, turn, coalesce(list_filter(ls, lambda x: lower(x) not in ('assistant', 'assistant:', 'user', 'user:'))[-1], ls[-1], '') as answer from l""")
def clean_prefixes(spark, sf):
    return Tables(spark, sf).conversations.select("conv_id", "turn", text.clean_prediction("text", "tell").alias("answer"))


@query("slug_id", r"""
select page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') as slug from pages""")
def slug_id(spark, sf):
    return Tables(spark, sf).pages.select("page_id", text.slug("url").alias("slug"))


@query("url_parts", r"""
select page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) as host, lower(string_split(replace(url, '\', '/'), '/')[-1]) as base from pages""")
def url_parts(spark, sf):
    return Tables(spark, sf).pages.select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("host"), text.basename("url").alias("base"))


@query("lexical_validity", r"""
with t as (select page_id, regexp_replace(coalesce(url, ''), '\s+', '', 'g') as t from pages)
select page_id, array_to_string(list_filter([case when t = '' then 'empty' end, case when contains(t, '.') then 'multi_fragment' end,
  case when not regexp_full_match(t, '[A-Za-z0-9@+\-\[\]()=#%\\/.]+') then 'unsupported_character' end,
  case when length(replace(t, '(', '')) <> length(replace(t, ')', '')) or length(replace(t, '[', '')) <> length(replace(t, ']', '')) then 'unbalanced_delimiter' end], lambda x: x is not null), ',') as issues from t""")
def lexical_validity(spark, sf):
    return Tables(spark, sf).pages.select("page_id", F.array_join(text.lexical_issues("url"), ",").alias("issues"))


@query("hash_keys", """
select doc_id, substr(sha1(text), 1, 12) as short_sha1, substr(sha256(text), 1, 20) as entity_id from documents""")
def hash_keys(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", keys.short_sha1("text").alias("short_sha1"), keys.entity_id("text").alias("entity_id"))


@query("poly_seed", """
select p_partkey, coalesce(list_sum(list_transform(range(1, length(p_name) + 1), lambda i: i * unicode(substr(p_name, i, 1)))), 0)::bigint as seed from part""")
def poly_seed(spark, sf):
    return Tables(spark, sf).part.select("p_partkey", text.poly_seed("p_name").alias("seed"))


@query("strict_keys", r"""
select p_partkey, case when regexp_replace(p_type, '\s+', '', 'g') <> '' and not contains(regexp_replace(p_type, '\s+', '', 'g'), '.') then regexp_replace(p_type, '\s+', '', 'g') end as key from part""")
def strict_keys(spark, sf):
    return keys.distinct_mapped(Tables(spark, sf).part.select("p_partkey", "p_type"), "p_type", text.strict_key, "key").select("p_partkey", "key")


# Joins and sets


@query("label_left_prediction", """
select d.doc_id, l.toxic, l.doc_id is null as missing from documents d left join labels l on l.doc_id = d.doc_id""")
def label_left_prediction(spark, sf):
    t = Tables(spark, sf)
    return relate.labelled(t.documents.select("doc_id"), t.labels.select("doc_id", "toxic"), "doc_id")


@query("inner_labeled", "select d.doc_id, d.lang, l.quality, l.toxic from documents d join labels l using (doc_id)")
def inner_labeled(spark, sf):
    t = Tables(spark, sf)
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id")


@query("full_match_assert", """
with a as (select distinct o_custkey as id from orders where o_totalprice > 150000), b as (select c_custkey as id from customer where c_acctbal > 0)
select case when b.id is null then 'left' else 'right' end as side, count(*) as n from a full join b using (id) where a.id is null or b.id is null group by 1""")
def full_match_assert(spark, sf):
    t = Tables(spark, sf)
    return relate.id_differences(t.orders.where("o_totalprice > 150000").select(F.col("o_custkey").alias("id")), t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("id")), "id").groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query("keyed_last_wins", """
select l_orderkey, l_linenumber, l_partkey from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey desc, l_suppkey desc) as r from lineitem) where r = 1""")
def keyed_last_wins(spark, sf):
    li = Tables(spark, sf).lineitem
    return relate.last_by_key(li.select(F.struct("l_orderkey", "l_linenumber").alias("key"), "l_partkey", F.struct("l_partkey", "l_suppkey").alias("at")), "key", "at").select("key.*", "l_partkey")


@query("unique_keys_checked", "select c_custkey, c_mktsegment from customer")
def unique_keys_checked(spark, sf):
    return relate.unique_by_key(Tables(spark, sf).customer, "c_custkey").select("c_custkey", "c_mktsegment")


@query("except_ids", "select c_custkey from customer except select o_custkey from orders where o_orderpriority = '1-URGENT'")
def except_ids(spark, sf):
    t = Tables(spark, sf)
    return t.customer.select("c_custkey").distinct().join(t.orders.where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("intersect_counts", """
select count(*) as n from (select c_nationkey from customer intersect select s_nationkey from supplier)""")
def intersect_counts(spark, sf):
    t = Tables(spark, sf)
    return t.customer.select("c_nationkey").intersect(t.supplier.select("s_nationkey")).agg(F.count(F.lit(1)).alias("n"))


@query("union_mix", """
select part, count(*) as n, count(distinct id) as n_ids from (
  select 'customers' as part, c_custkey as id from customer union all select 'suppliers', s_suppkey from supplier union all select 'hot', c_custkey from customer where c_mktsegment = 'BUILDING') group by 1""")
def union_mix(spark, sf):
    t = Tables(spark, sf)
    parts = [("customers", t.customer.select(F.col("c_custkey").alias("id"))), ("suppliers", t.supplier.select(F.col("s_suppkey").alias("id"))), ("hot", t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id")))]
    out = None
    for name, df in parts:
        p = df.withColumn("part", F.lit(name))
        out = p if out is None else out.unionByName(p)
    return out.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids"))


@query("union_distinct_keys", "select count(*) as n from (select c_nationkey as k from customer union select s_nationkey from supplier union select n_nationkey from nation)")
def union_distinct_keys(spark, sf):
    t = Tables(spark, sf)
    k = t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).union(t.nation.select("n_nationkey"))
    return k.distinct().agg(F.count(F.lit(1)).alias("n"))


@query("first_union_by_id", """
select id, part, src from (select *, row_number() over (partition by id order by part, src) as r from (
  select doc_id as id, 0 as part, source as src from documents where lang = 'en' union all select doc_id, 1, source from documents union all select doc_id, 2, 'label' from labels)) where r = 1""")
def first_union_by_id(spark, sf):
    t = Tables(spark, sf)
    d = t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("src"), "lang")
    return relate.first_union([d.where("lang = 'en'").drop("lang"), d.drop("lang"), t.labels.select(F.col("doc_id").alias("id"), F.lit("label").alias("src"))], "id", "src").select("id", "part", "src")


@query("train_eval_overlap", """
with d as (select doc_id, sha1(text) as h, source from documents), e as (select sha1(text) as h from documents where lang = 'en' union all select sha1(text) from benchmark)
select 'text' as by, count(*) as n from d where h in (select h from e) union all select 'id', count(*) from d where doc_id in (select item_id from benchmark)""")
def train_eval_overlap(spark, sf):
    t = Tables(spark, sf)
    d = t.documents.select("doc_id", F.sha1("text").alias("h"))
    e = t.documents.where("lang = 'en'").select(F.sha1("text").alias("h")).union(t.benchmark.select(F.sha1("text")))
    by_text = relate.seen(d, e, "h").agg(F.count(F.lit(1)).alias("n")).select(F.lit("text").alias("by"), "n")
    by_id = relate.seen(d, t.benchmark.select(F.col("item_id").alias("doc_id")), "doc_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit("id").alias("by"), "n")
    return by_text.unionByName(by_id)


@query("overlap_by_either_id", """
select doc_id, lang from documents where doc_id in (select item_id from benchmark) or n_chars in (select item_id from benchmark)""")
def overlap_by_either_id(spark, sf):
    t = Tables(spark, sf)
    return relate.seen_by_any(t.documents.select("doc_id", "lang", "n_chars"), t.benchmark, ["doc_id", "n_chars"], "item_id").select("doc_id", "lang")


@query("containment_leak", "select d.doc_id, b.item_id from documents d join benchmark b on contains(d.text, b.text)")
def containment_leak(spark, sf):
    t = Tables(spark, sf)
    return relate.containing(t.documents.select("doc_id", "text"), t.benchmark.select("item_id", F.col("text").alias("passage")), "text", "passage").select("doc_id", "item_id")


@query("remaining_rows", "select doc_id from documents where doc_id not in (select doc_id from labels)")
def remaining_rows(spark, sf):
    t = Tables(spark, sf)
    return relate.unseen(t.documents.select("doc_id"), t.labels, "doc_id")


@query("composite_anti_join", """
select l_returnflag, count(*) as n from lineitem l where not exists (select 1 from lineitem b where b.l_quantity >= 49 and b.l_orderkey = l.l_orderkey and b.l_linenumber = l.l_linenumber) group by 1""")
def composite_anti_join(spark, sf):
    li = Tables(spark, sf).lineitem
    return relate.unseen(li, li.where("l_quantity >= 49"), ["l_orderkey", "l_linenumber"]).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("shard_merge_problems", """
with got as (select doc_id as id from documents where lang = 'en' union all select doc_id from documents where source = 'src0'), want as (select doc_id as id from labels)
select 'repeated' as problem, count(*) as n from (select id from got group by 1 having count(*) > 1)
union all select 'missing', count(*) from want where id not in (select id from got)
union all select 'extra', count(*) from (select distinct id from got) where id not in (select id from want)""")
def shard_merge_problems(spark, sf):
    t = Tables(spark, sf)
    d = t.documents
    got = d.where("lang = 'en'").select(F.col("doc_id").alias("id")).union(d.where("source = 'src0'").select("doc_id"))
    return relate.merged_shards(got, t.labels.select(F.col("doc_id").alias("id")), "id").groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("variant_cross", """
select r_name || '/' || v as variant, count(*) as n from region, (select unnest(['full', 'left', 'right']) as v), nation where n_regionkey = r_regionkey group by 1""")
def variant_cross(spark, sf):
    t = Tables(spark, sf)
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).withColumn("v", F.explode(F.array(*[F.lit(x) for x in ("full", "left", "right")])))
    return rows.groupBy(F.concat_ws("/", "r_name", "v").alias("variant")).agg(F.count(F.lit(1)).alias("n"))


@query("cross_panel_reuse", """
select sha1(text) as k, count(distinct source) as n_parts, count(*) as n_rows from documents group by 1 having count(distinct source) > 1""")
def cross_panel_reuse(spark, sf):
    return relate.reused(Tables(spark, sf).documents.select(F.sha1("text").alias("k"), "source"), "k", "source")


@query("group_policy_lookup", """
select coalesce(m.policy, 'fallback') as policy, count(*) as n from customer c left join (values ('BUILDING', 'a'), ('MACHINERY', 'b')) m(seg, policy) on m.seg = c.c_mktsegment group by 1""")
def group_policy_lookup(spark, sf):
    policy = spark.createDataFrame([("BUILDING", "a"), ("MACHINERY", "b")], "c_mktsegment string, policy string")
    return relate.with_policy(Tables(spark, sf).customer, policy, "c_mktsegment", "policy", "fallback").groupBy("policy").agg(F.count(F.lit(1)).alias("n"))


# Ranking, dedup, caps


@query("dedup_keep_first", """
select doc_id, source from (select *, row_number() over (partition by sha1(text) order by doc_id) as r from documents) where r = 1""")
def dedup_keep_first(spark, sf):
    d = Tables(spark, sf).documents.select("doc_id", "source", F.sha1("text").alias("h"))
    return rank.best(d, "h", [F.col("doc_id")]).select("doc_id", "source")


@query("cap_per_source", """
select doc_id, source from (select *, row_number() over (partition by source order by sha256('11|' || doc_id), doc_id) as r from documents) where r <= 20""")
def cap_per_source(spark, sf):
    return sample.capped(Tables(spark, sf).documents.select("doc_id", "source"), "source", "doc_id", 20, 11)


@query("quota_then_fill", """
select doc_id, source, tier from (select *, case when r <= 3 then 0 else 1 end::int as tier from (
  select *, row_number() over (partition by source order by n_chars desc, doc_id) as r from documents)) order by tier, n_chars desc, doc_id limit 100""")
def quota_then_fill(spark, sf):
    d = Tables(spark, sf).documents.select("doc_id", "source", "n_chars")
    return rank.quota_then_fill(d, "source", [F.col("n_chars").desc(), F.col("doc_id")], 3, 100).select("doc_id", "source", F.col("tier").cast("int").alias("tier"))


@query("curriculum_order", """
select doc_id, tier, row_number() over (order by tier, sha256('5|' || doc_id), doc_id) as place from (
  select doc_id, case lang when 'en' then 0 when 'de' then 1 when 'fr' then 2 else 3 end as tier from documents)""")
def curriculum_order(spark, sf):
    d = Tables(spark, sf).documents.select("doc_id", "lang")
    return rank.curriculum(d, {"en": 0, "de": 1, "fr": 2}, "lang", F.struct(keys.hash_order(5, "doc_id"), F.col("doc_id"))).select("doc_id", "tier", "place")


@query("hash_order_limit", "select doc_id, sha256('3|' || doc_id) as h from documents order by h, doc_id limit 50")
def hash_order_limit(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", keys.hash_order(3, "doc_id").alias("h")).orderBy("h", "doc_id").limit(50)


@query("strided_shards", """
select shard, count(*) as n, min(doc_id) as first_id, max(doc_id) as last_id from (select doc_id, (row_number() over (order by doc_id) - 1) % 4 as shard from documents) group by 1""")
def strided_shards(spark, sf):
    d = rank.ordinal(Tables(spark, sf).documents.select("doc_id"), "doc_id")
    return d.groupBy((F.col("ord") % 4).alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


_HASH = "('0x' || substr(sha1('{s}:' || {x}), 1, 12))::bigint"


@query("kfold_hash", f"select ({_HASH.format(s=42, x='doc_id')} % 5)::int as fold, count(*) as n, min(doc_id) as first_id from documents group by 1")
def kfold_hash(spark, sf):
    return Tables(spark, sf).documents.groupBy(keys.fold(42, "doc_id", 5).alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query("hash_fraction_split", f"select case when {_HASH.format(s=9, x='user_id')} / 281474976710655.0::double < 0.2 then 'dev' else 'train' end as split, count(*) as n, count(distinct user_id) as users from events group by 1")
def hash_fraction_split(spark, sf):
    e = Tables(spark, sf).events
    return e.groupBy(F.when(keys.fraction(9, "user_id") < 0.2, "dev").otherwise("train").alias("split")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query("entity_split", """
with x as (select doc_id, source, ('0x' || substr(sha256(text), 1, 8))::bigint / 4294967295.0::double as f from documents)
select coalesce(case when source = 'src0' then 'train' end, case when f < 0.8 then 'train' when f < 0.9 then 'val' else 'test' end) as split, count(*) as n from x group by 1""")
def entity_split(spark, sf):
    d = Tables(spark, sf).documents
    s = sample.entity_split(F.col("text"), [("train", 0.8), ("val", 0.1), ("test", 0.1)], F.when(F.col("source") == "src0", "train"))
    return d.groupBy(s.alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query("split_conflicts", """
select sha1(text) as k, count(distinct case when doc_id % 2 = 0 then 'a' else 'b' end) as n_splits from documents group by 1 having n_splits > 1""")
def split_conflicts(spark, sf):
    d = Tables(spark, sf).documents.select(F.sha1("text").alias("k"), F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("s"))
    return sample.split_conflicts(d, "k", "s")


@query("stratified_split", """
with n as (select doc_id, source, count(*) over (partition by source) as n, row_number() over (partition by source order by sha256('21|' || doc_id), doc_id) as r from documents)
select source, case when r <= (case when n < 5 then 0 else greatest(1, round_even(n * 0.1, 0)::int) end) then 'val' else 'train' end as split, count(*) as n from n group by 1, 2""")
def stratified_split(spark, sf):
    return sample.stratified_split(Tables(spark, sf).documents.select("doc_id", "source"), "source", "doc_id", 0.1, 21).groupBy("source", "split").agg(F.count(F.lit(1)).alias("n"))


@query("oversample_map", """
select lang, i as repeat_index, count(*) as n from (select lang, unnest(range(case lang when 'es' then 4 when 'fr' then 2 else 1 end)) as i from documents) group by 1, 2""")
def oversample_map(spark, sf):
    o = sample.oversampled(Tables(spark, sf).documents.select("lang"), sample.times_by_map("lang", {"es": 4, "fr": 2}))
    return o.groupBy("lang", F.col("repeat_index").cast("long").alias("repeat_index")).agg(F.count(F.lit(1)).alias("n"))


@query("phase_mixture", """
with p as (select 'all' as mixture, doc_id from documents union all select doc_id_mix, doc_id from (select 'long' as doc_id_mix, doc_id, row_number() over (order by sha256('4|' || doc_id), doc_id) as r from documents where n_chars > 2000) where r <= 100)
select mixture, count(*) as n, sum(doc_id)::bigint as ids from p group by 1""")
def phase_mixture(spark, sf):
    d = Tables(spark, sf).documents
    m = sample.mixture({"all": (d.select("doc_id"), None), "long": (d.where("n_chars > 2000").select("doc_id"), 100)}, "doc_id", 4)
    return m.groupBy("mixture").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


@query("novel_key_subset", """
select c_custkey, c_mktsegment from customer where c_nationkey not in (select s_nationkey from supplier where s_acctbal > 5000) or c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')""")
def novel_key_subset(spark, sf):
    t = Tables(spark, sf)
    c = t.customer
    new_nation = c.join(t.supplier.where("s_acctbal > 5000"), F.col("c_nationkey") == F.col("s_nationkey"), "left_anti")
    no_orders = c.join(t.orders.where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return new_nation.unionByName(no_orders).select("c_custkey", "c_mktsegment").distinct()


@query("unique_key_sample", """
select row_number() over (order by sha256('8|' || k), k)::bigint as seq, k from (select distinct p_type as k from part where length(p_type) between 3 and 40)""")
def unique_key_sample(spark, sf):
    k = Tables(spark, sf).part.select(F.col("p_type").alias("k")).distinct().where(F.length("k").between(3, 40))
    return rank.ordinal(k.withColumn("h", keys.hash_order(8, "k")), "h", "k").select((F.col("ord") + 1).alias("seq"), "k")


@query("capped_examples", """
select lang, count(*) as n, array_to_string(list_slice(list_sort(list(doc_id)), 1, 3), ',') as examples from documents group by 1""")
def capped_examples(spark, sf):
    return measure.examples(Tables(spark, sf).documents.select("lang", "doc_id"), "lang", F.col("doc_id"), 3)
