"""Aggregates, evaluation reports, profiles and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernel.functions import numbers
from quernel.operators import measure, relate, shape
from quernel.plans.base import Tables, query
from quernel.sources.sinks import pivot_counts


@query("histograms", """
select 'source' as "column", coalesce(nullif(source, ''), 'unknown') as value, count(*) as n from documents group by 2
union all select 'lang', coalesce(nullif(lang, ''), 'unknown'), count(*) from documents group by 2""")
def histograms(spark, sf):
    return measure.histogram(Tables(spark, sf).documents, "source", "lang")


@query("percent_share", """
select coalesce(o_orderpriority, 'unknown') as o_orderpriority, count(*) as n, round(100.0::double * count(*) / sum(count(*)) over (), 4) as percent from orders group by 1""")
def percent_share(spark, sf):
    return measure.shares(Tables(spark, sf).orders, "o_orderpriority")


@query("mixture_pivot", """
select o_orderpriority, sum((o_orderstatus = 'F')::int)::bigint as "F", sum((o_orderstatus = 'O')::int)::bigint as "O", sum((o_orderstatus = 'P')::int)::bigint as "P" from orders group by 1""")
def mixture_pivot(spark, sf):
    return pivot_counts(Tables(spark, sf).orders, "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("coverage", """
with j as (select d.*, l.quality, l.toxic from documents d left join labels l using (doc_id)),
c as (select count(*) as total, sum((source is not null and source <> '')::int)::bigint as source, sum((quality is not null)::int)::bigint as quality, sum((toxic is not null)::int)::bigint as toxic from j)
select 'source' as "column", source as present, total, source::double / total as coverage from c
union all select 'quality', quality, total, quality::double / total from c union all select 'toxic', toxic, total, toxic::double / total from c""")
def coverage(spark, sf):
    t = Tables(spark, sf)
    return measure.coverage(t.documents.join(t.labels, "doc_id", "left"), "source", "quality", "toxic")


@query("pct_linear", """
select o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 4) as p50, round(quantile_cont(o_totalprice, 0.95), 4) as p95 from orders group by 1""")
def pct_linear(spark, sf):
    return Tables(spark, sf).orders.groupBy("o_orderpriority").agg(F.round(F.percentile("o_totalprice", 0.5), 4).alias("p50"), F.round(F.percentile("o_totalprice", 0.95), 4).alias("p95"))


@query("pct_nearest_rank", """
select lang, s[round_even((len(s) - 1) * 0.5, 0)::int + 1] as p50, s[round_even((len(s) - 1) * 0.9, 0)::int + 1] as p90 from (select lang, list_sort(list(n_chars)) as s from documents group by 1)""")
def pct_nearest_rank(spark, sf):
    return measure.ranks(Tables(spark, sf).documents, "n_chars", "lang", p50=lambda n: F.bround((n - 1) * F.lit(0.5)), p90=lambda n: F.bround((n - 1) * F.lit(0.9)))


@query("pct_floor", """
select lang, s[floor((len(s) - 1) * 0.5)::int + 1] as p50, s[floor((len(s) - 1) * 0.9)::int + 1] as p90 from (select lang, list_sort(list(n_chars)) as s from documents group by 1)""")
def pct_floor(spark, sf):
    return measure.ranks(Tables(spark, sf).documents, "n_chars", "lang", p50=lambda n: F.floor((n - 1) * F.lit(0.5)), p90=lambda n: F.floor((n - 1) * F.lit(0.9)))


@query("profile", """
select lang, count(n_chars) as n, min(n_chars)::double as least, max(n_chars)::double as greatest, round(quantile_cont(n_chars::double, 0.5), 6) as p50, round(quantile_cont(n_chars::double, 0.9), 6) as p90,
  round(quantile_cont(n_chars::double, 0.95), 6) as p95, round(quantile_cont(n_chars::double, 0.99), 6) as p99, round(avg(n_chars), 6) as mean from documents group by 1""")
def profile(spark, sf):
    return measure.profile(Tables(spark, sf).documents, "n_chars", "lang")


@query("duplicate_stats", """
with c as (select sha1(text) as k, count(*) as n from documents group by 1)
select sum(n)::bigint as n_rows, count(*) as n_distinct, (sum(n) - count(*))::bigint as n_surplus, sum((n > 1)::int)::bigint as n_repeated, max(n) as max_repeat from c""")
def duplicate_stats(spark, sf):
    return measure.duplicates(Tables(spark, sf).documents.select(F.sha1("text").alias("k")), "k")


@query("distinct_counts", """
select source, count(distinct lang) as langs, count(distinct sha1(text)) as texts from documents group by 1""")
def distinct_counts(spark, sf):
    return Tables(spark, sf).documents.groupBy("source").agg(F.count_distinct("lang").alias("langs"), F.count_distinct(F.sha1("text")).alias("texts"))


@query("nested_histogram", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by 1, 2")
def nested_histogram(spark, sf):
    return Tables(spark, sf).orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("transition_counts", """
with a as (select l_orderkey, max((l_quantity > 25)::int) as x from lineitem where l_linenumber % 2 = 0 group by 1), b as (select l_orderkey, max((l_quantity > 25)::int) as y from lineitem where l_linenumber % 2 = 1 group by 1)
select x || '->' || y as transition, count(*) as n from a join b using (l_orderkey) group by 1""")
def transition_counts(spark, sf):
    li = Tables(spark, sf).lineitem
    side = lambda odd, name: li.where(F.col("l_linenumber") % 2 == odd).groupBy("l_orderkey").agg(F.max((F.col("l_quantity") > 25).cast("int")).alias(name))
    return measure.transitions(side(0, "x").join(side(1, "y"), "l_orderkey"), "x", "y")


@query("normalizer_stats", """
select 'l_quantity' as feature, round(avg(l_quantity), 6) as mean, round(stddev_samp(l_quantity), 6) as sd from lineitem
union all select 'l_discount', round(avg(l_discount), 6), round(stddev_samp(l_discount), 6) from lineitem""")
def normalizer_stats(spark, sf):
    return measure.normalizer(Tables(spark, sf).lineitem, "l_quantity", "l_discount")


@query("population_spread", """
select 'l_quantity' as feature, round(avg(l_quantity), 6) as mean, round(stddev_pop(l_quantity), 6) as sd from lineitem""")
def population_spread(spark, sf):
    return measure.normalizer(Tables(spark, sf).lineitem, "l_quantity", sample=False)


@query("reason_heads", "select string_split(url, ':')[1] as head, count(*) as n from pages group by 1")
def reason_heads(spark, sf):
    from quernel.functions.text import reason_head

    return Tables(spark, sf).pages.groupBy(reason_head("url").alias("head")).agg(F.count(F.lit(1)).alias("n"))


@query("multi_dim_report", """
select case when grouping(l_returnflag) = 0 then 'returnflag' when grouping(l_linestatus) = 0 then 'linestatus' else 'all' end as dimension, coalesce(l_returnflag, l_linestatus, 'all') as value,
  count(*) as total, round(sum(l_quantity), 2) as quantity, round(sum(l_discount) / count(*), 9) as mean_discount, sum((l_quantity > 25)::int)::bigint as n_large
from lineitem group by grouping sets ((), (l_returnflag), (l_linestatus))""")
def multi_dim_report(spark, sf):
    li = Tables(spark, sf).lineitem
    g = li.groupingSets([[], [F.col("l_returnflag")], [F.col("l_linestatus")]], "l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("total"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum("l_discount") / F.count(F.lit(1)), 9).alias("mean_discount"), F.sum((F.col("l_quantity") > 25).cast("long")).alias("n_large"), F.grouping("l_returnflag").alias("a"), F.grouping("l_linestatus").alias("b"))
    dimension = F.when(F.col("a") == 0, "returnflag").when(F.col("b") == 0, "linestatus").otherwise("all")
    return g.select(dimension.alias("dimension"), F.coalesce("l_returnflag", "l_linestatus", F.lit("all")).alias("value"), "total", "quantity", "mean_discount", "n_large")


#: An evaluation on the harness: a part's type is the label, its name the prediction, missing where the retail price is low.
_PAIRS = r"""
p as (select p_partkey as id, p_brand as brand, p_size % 5 as size, p_type as truth, case when p_retailprice >= 1000 then p_name end as prediction, p_retailprice < 1000 as missing from part),
w as (select *, list_filter(string_split_regex(coalesce(truth, ''), '\s+'), lambda x: x <> '') as tt, list_filter(string_split_regex(coalesce(prediction, ''), '\s+'), lambda x: x <> '') as pt from p),
d as (select id, brand, size, truth, prediction, missing, len(tt)::int as n_true, len(pt)::int as n_pred,
    coalesce(list_sum(list_transform(list_distinct(tt), lambda x: least(len(list_filter(tt, lambda y: y = x)), len(list_filter(pt, lambda y: y = x))))), 0)::int as n_both,
    coalesce(truth, '') = coalesce(prediction, '') and coalesce(prediction, '') <> '' as exact,
    case when greatest(length(coalesce(truth, '')), length(coalesce(prediction, ''))) = 0 then 1.0::double else 1.0::double - levenshtein(coalesce(truth, ''), coalesce(prediction, ''))::double / greatest(length(coalesce(truth, '')), length(coalesce(prediction, ''))) end as edit_similarity from w),
e as (select *, case when n_pred > 0 then n_both::double / n_pred else 0 end as "precision", case when n_true > 0 then n_both::double / n_true else 0 end as recall from d),
f as (select *, case when "precision" + recall > 0 then 2 * "precision" * recall / ("precision" + recall) else 0 end as token_f1 from e)"""


@query("evaluate_detail", f"""
with {_PAIRS}
select id, exact, missing, n_true, n_pred, n_both, round("precision", 9) as "precision", round(recall, 9) as recall, round(token_f1, 9) as token_f1, round(edit_similarity, 9) as edit_similarity from f""")
def evaluate_detail(spark, sf):
    d = _word_details(Tables(spark, sf))
    return d.select("id", "exact", "missing", "n_true", "n_pred", "n_both", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "token_f1", "edit_similarity")])


def _word_details(t: Tables):
    """Details with words as tokens: white space goes from neither side's bag."""
    from quernel.functions.numbers import f1, rate
    from quernel.functions.text import bag_overlap, edit_similarity

    words = lambda c: F.filter(F.split(F.coalesce(F.col(c), F.lit("")), r"\s+"), lambda w: w != "")
    p = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), (F.col("p_size") % 5).alias("size"), F.col("p_type").alias("truth"))
    made = t.part.where("p_retailprice >= 1000").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("prediction"))
    j = relate.labelled(p, made, "id").withColumn("\x01t", words("truth")).withColumn("\x01p", words("prediction"))
    j = j.withColumns({"n_true": F.size("\x01t"), "n_pred": F.size("\x01p"), "n_both": bag_overlap("\x01t", "\x01p"), "exact": (F.coalesce("truth", F.lit("")) == F.coalesce("prediction", F.lit(""))) & (F.coalesce("prediction", F.lit("")) != "")}).drop("\x01t", "\x01p")
    j = j.withColumns({"precision": rate("n_both", "n_pred"), "recall": rate("n_both", "n_true"), "edit_similarity": edit_similarity("truth", "prediction")})
    return j.withColumn("token_f1", f1("precision", "recall"))


@query("evaluate_report", f"""
with {_PAIRS},
g as (select case when grouping(brand) = 0 then 'brand' when grouping(size) = 0 then 'size' else 'all' end as dimension, coalesce(brand, size::varchar, 'all') as value, count(*) as total, sum(exact::int)::bigint as n_exact, sum(missing::int)::bigint as n_missing,
    sum(n_both)::bigint as tp, sum(n_pred)::bigint as pred, sum(n_true)::bigint as gt, round(sum(token_f1) / count(*), 9) as macro_f1, round(sum(edit_similarity) / count(*), 9) as mean_edit_similarity
  from f group by grouping sets ((), (brand), (size)))
select *, round(n_exact::double / total, 9) as exact_rate, round(case when pred > 0 then tp::double / pred else 0 end, 9) as micro_precision, round(case when gt > 0 then tp::double / gt else 0 end, 9) as micro_recall,
  round(case when tp > 0 then 2.0::double * tp / (pred + gt) else 0 end, 9) as micro_f1 from g""")
def evaluate_report(spark, sf):
    return measure.report(_word_details(Tables(spark, sf)), ["brand", "size"])


@query("evaluate_literal", r"""
select p_partkey as id, p_type = p_name as raw_exact, regexp_replace(p_type, '\s+', '', 'g') = regexp_replace(p_name, '\s+', '', 'g') as normal_exact, regexp_replace(p_name, '\s+', '', 'g') <> '' as non_empty from part""")
def evaluate_literal(spark, sf):
    p = Tables(spark, sf).part.select(F.col("p_partkey").alias("id"), "p_type", "p_name")
    return measure.literal(p, "p_type", "p_name").select("id", "raw_exact", "normal_exact", "non_empty")


@query("evaluate_minimal", """
select count(*) as total, sum((p_type = p_name)::int)::bigint as n_exact, round(avg(length(p_name)), 6) as mean_length from part""")
def evaluate_minimal(spark, sf):
    p = Tables(spark, sf).part
    return measure.literal(p, "p_type", "p_name").agg(F.count(F.lit(1)).alias("total"), F.sum(F.col("raw_exact").cast("long")).alias("n_exact"), F.round(F.avg(F.length("p_name")), 6).alias("mean_length"))


@query("report_rollup", """
select event_type as phase, strftime(ts, '%Y-%m-%d') as checkpoint, count(*) as n, round(avg(value), 6) as score from events group by 1, 2""")
def report_rollup(spark, sf):
    e = Tables(spark, sf).events
    return e.groupBy(F.col("event_type").alias("phase"), F.date_format("ts", "yyyy-MM-dd").alias("checkpoint")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("score"))


# Audits


@query("train_audit", """
with d as (select doc_id, sha1(text) as h, text, n_chars from documents), b as (select sha1(text) as h from benchmark)
select count(*) as n_rows, count(distinct h) as n_texts, (count(*) - count(distinct h))::bigint as n_surplus, sum((coalesce(text, '') = '')::int)::bigint as n_empty, sum((n_chars < 100)::int)::bigint as n_short,
  sum((h in (select h from b))::int)::bigint as n_eval_overlap from d""")
def train_audit(spark, sf):
    t = Tables(spark, sf)
    d = t.documents.select("doc_id", F.sha1("text").alias("h"), "text", "n_chars")
    b = t.benchmark.select(F.sha1("text").alias("h")).distinct().withColumn("hit", F.lit(1))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return d.join(b, "h", "left").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("h").alias("n_texts"), (F.count(F.lit(1)) - F.count_distinct("h")).alias("n_surplus"), n(F.coalesce("text", F.lit("")) == "").alias("n_empty"), n(F.col("n_chars") < 100).alias("n_short"), n(F.col("hit").isNotNull()).alias("n_eval_overlap"))


@query("eval_audit", """
select b.item_id, length(b.text) as chars, count(d.doc_id) as n_containing from benchmark b left join documents d on contains(d.text, b.text) group by 1, 2""")
def eval_audit(spark, sf):
    t = Tables(spark, sf)
    b = t.benchmark.select("item_id", F.col("text").alias("passage"))
    hits = relate.containing(t.documents.select("doc_id", "text"), b, "text", "passage").groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return b.join(hits, "item_id", "left").select("item_id", F.length("passage").cast("long").alias("chars"), F.coalesce("n", F.lit(0)).alias("n_containing"))


@query("release_blockers", """
with j as (select d.*, l.quality, l.toxic from documents d left join labels l using (doc_id)),
c as (select sum((quality is null)::int)::double / count(*) as unlabelled, sum((coalesce(toxic, 0) = 1)::int)::double / count(*) as toxic_share, (count(*) - count(distinct sha1(text)))::double / count(*) as surplus from j)
select round(unlabelled, 9) as unlabelled, round(toxic_share, 9) as toxic_share, round(surplus, 9) as surplus,
  array_to_string(list_sort(list_filter([case when unlabelled > 0.5 then 'unlabelled' end, case when toxic_share > 0.2 then 'toxic_share' end, case when surplus > 0.05 then 'surplus' end], lambda x: x is not null)), ',') as blockers,
  not (unlabelled > 0.5 or toxic_share > 0.2 or surplus > 0.05) as ready from c""")
def release_blockers(spark, sf):
    t = Tables(spark, sf)
    j = t.documents.join(t.labels, "doc_id", "left")
    n = F.count(F.lit(1))
    c = j.agg((F.sum(F.col("quality").isNull().cast("long")) / n).alias("unlabelled"), (F.sum((F.coalesce("toxic", F.lit(0)) == 1).cast("long")) / n).alias("toxic_share"), ((n - F.count_distinct(F.sha1("text"))) / n).alias("surplus"))
    out = measure.blockers(c, {"unlabelled": 0.5, "toxic_share": 0.2, "surplus": 0.05})
    return out.select(*[F.round(x, 9).alias(x) for x in ("unlabelled", "toxic_share", "surplus")], "blockers", "ready")


@query("workspace_violations", """
select 'lineitem_orphans' as violation, count(*) as n from lineitem where l_orderkey not in (select o_orderkey from orders)
union all select 'repeated_lines', count(*) from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1)
union all select 'labels_without_text', count(*) from labels where doc_id not in (select doc_id from documents)
union all select 'negative_balance', count(*) from customer where c_acctbal < 0""")
def workspace_violations(spark, sf):
    t = Tables(spark, sf)
    n = F.count(F.lit(1)).alias("n")
    parts = {
        "lineitem_orphans": t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(n),
        "repeated_lines": t.lineitem.groupBy("l_orderkey", "l_linenumber").count().where("count > 1").agg(n),
        "labels_without_text": t.labels.join(t.documents, "doc_id", "left_anti").agg(n),
        "negative_balance": t.customer.where("c_acctbal < 0").agg(n),
    }
    out = None
    for name, df in parts.items():
        p = df.select(F.lit(name).alias("violation"), "n")
        out = p if out is None else out.unionByName(p)
    return out


_MODES = ["RGB", "L", " RGBA", "P", "CMYK", "1", "I;16B", "LA", "", "HSV", "PA", "YCbCr"]


@query("image_mode_audit", f"""
with m as (select p_partkey, trim({_MODES}[p_partkey % 12 + 1]) as m from part)
select m as mode, case when m = 'RGB' then 'ok' when m in ('P', 'PA', '1', 'I', 'F') or starts_with(m, 'I;16') then 'default_delete' else 'review' end as action, count(*) as n from m group by 1, 2""")
def image_mode_audit(spark, sf):
    m = F.element_at(F.array(*[F.lit(x) for x in _MODES]), (F.col("p_partkey") % 12 + 1).cast("int"))
    return Tables(spark, sf).part.select(F.trim(m).alias("mode"), shape.image_mode_class(m).alias("action")).groupBy("mode", "action").agg(F.count(F.lit(1)).alias("n"))


@query("image_deletion_plan", f"""
with i as (select p_partkey, {_MODES}[p_partkey % 12 + 1] as m from part where p_partkey % 10 <> 3),
r as (select l_partkey, count(*) as n_rows from lineitem group by 1)
select l_partkey, case when p_partkey is null then 'missing' else 'default_delete' end as action, n_rows from r left join i on p_partkey = l_partkey where p_partkey is null or m in ('P', 'PA', '1', 'I', 'F') or starts_with(m, 'I;16')""")
def image_deletion_plan(spark, sf):
    t = Tables(spark, sf)
    m = F.element_at(F.array(*[F.lit(x) for x in _MODES]), (F.col("p_partkey") % 12 + 1).cast("int"))
    return shape.unwanted_images(t.lineitem, t.part.where("p_partkey % 10 <> 3").select(F.col("p_partkey").alias("path"), m.alias("mode")), "l_partkey")[1]


@query("pixel_boxes", """
with b as (select p_partkey, p_size, p_size / 100.0::double as x from part)
select p_partkey, greatest(0, least(round_even(x * 640, 0)::int, 640)) as x1, greatest(0, least(round_even((x + 0.3) * 640, 0)::int, 640)) as x2 from b""")
def pixel_boxes(spark, sf):
    x = F.col("p_size") / F.lit(100.0)
    box = numbers.pixel_box(F.array(x, F.lit(0.1), x + 0.3, F.lit(0.9)), F.lit(640), F.lit(480))
    return Tables(spark, sf).part.select("p_partkey", box[0].alias("x1"), box[2].alias("x2"))


@query("box_parse", """
select p_partkey, p_size > 5 as valid from part""")
def box_parse(spark, sf):
    box = shape.parsed_box(F.concat(F.lit("[5, 0, "), F.col("p_size").cast("string"), F.lit(", 10]")))
    return Tables(spark, sf).part.select("p_partkey", box.isNotNull().alias("valid"))


@query("safe_numbers", """
select event_id, coalesce(case when try_cast(props ->> '$.k' as double) is null then null else try_cast(props ->> '$.k' as double) end, 0.0::double) as k,
  greatest(least(value, 10.0::double), -50.0::double) as clamped, round(1 / (1 + exp(-greatest(least(value, 10.0::double), -50.0::double))), 9) as sigmoid from events""")
def safe_numbers(spark, sf):
    c = numbers.clamped("value", -50.0, 10.0)
    return Tables(spark, sf).events.select("event_id", numbers.safe_double(F.get_json_object("props", "$.k")).alias("k"), c.alias("clamped"), F.round(numbers.sigmoid(c), 9).alias("sigmoid"))
