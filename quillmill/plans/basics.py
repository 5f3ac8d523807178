"""Queries on filters, lookups, joins and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.functions import text as X
from quillmill.operators import rows
from quillmill.plans.catalog import query, table


@query("f1_active_listing", """
SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_acctbal > 0 AND trim(c_name) <> '' AND trim(c_mktsegment) <> ''
  AND contains(lower(concat_ws(' ', c_name, c_mktsegment)), 'build') ORDER BY c_custkey LIMIT 50""")
def f1(spark, d):
    return rows.active_listing(table(spark, d, "customer"), F.col("c_acctbal") > 0, "c_custkey", "c_name", ["c_name", "c_mktsegment"], "build", 50).select("c_custkey", "c_name", "c_mktsegment")


@query("f2_factor_lookup", """
WITH r AS (SELECT p_partkey, trim(coalesce(nullif(trim(p_name), ''), nullif(trim(p_type), ''))) AS factor FROM part WHERE p_brand = 'Brand#11'),
k AS (SELECT *, row_number() OVER (PARTITION BY lower(regexp_replace(factor, '\\s+', '', 'g')) ORDER BY p_partkey) AS rn FROM r WHERE factor IS NOT NULL)
SELECT p_partkey, substr(factor, 1, 12) AS factor FROM k WHERE rn = 1 ORDER BY p_partkey LIMIT 20""")
def f2(spark, d):
    return rows.factor_lookup(table(spark, d, "part"), "p_brand", "Brand#11", [F.col("p_name"), F.col("p_type")], [F.col("p_partkey")], 12, 20).select("p_partkey", "factor")


@query("f3_exact_lookup", """
SELECT p_partkey, p_brand, p_type FROM part WHERE replace(trim(p_brand), ' ', '') = 'Brand#12' AND replace(trim(p_type), ' ', '') = replace('PROMO', ' ', '') ORDER BY p_partkey LIMIT 1""")
def f3(spark, d):
    return rows.exact_lookup(table(spark, d, "part"), {"p_brand": " Brand #12", "p_type": "PROMO"}, [F.col("p_partkey")]).select("p_partkey", "p_brand", "p_type")


@query("f4_text_fallback", """
SELECT doc_id, coalesce(nullif(trim(source), ''), nullif(trim(lang), ''), 'none') AS origin FROM documents""")
def f4(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(X.first_filled(F.col("source"), F.col("lang")), F.lit("none")).alias("origin"))


REVIEWS = """
reviews AS (SELECT doc_id AS review_id, CASE WHEN toxic = 1 THEN 'reject' WHEN quality = 0 THEN 'needs_edit' ELSE 'approve' END AS verdict,
            doc_id % 3 <> 0 AS active FROM labels)"""


def reviews(spark, d):
    """Review rows shaped from ``labels``: a verdict and an active flag for each document."""
    return table(spark, d, "labels").select(
        F.col("doc_id").alias("review_id"),
        F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 0, "needs_edit").otherwise("approve").alias("verdict"),
        (F.col("doc_id") % 3 != 0).alias("active"),
    )


@query("f5_negative_feedback", f"""
WITH {REVIEWS} SELECT review_id, verdict, lang FROM reviews JOIN documents ON doc_id = review_id
WHERE verdict IN ('reject', 'needs_edit') AND active AND text IS NOT NULL AND lang IN ('en', 'de') ORDER BY review_id DESC LIMIT 25""")
def f5(spark, d):
    docs = table(spark, d, "documents")
    joined = reviews(spark, d).join(docs, F.col("review_id") == F.col("doc_id"))
    return rows.negative_feedback(joined, "verdict", F.col("active"), "text", [F.desc("review_id")], "lang", ["en", "de"], 25).select("review_id", "verdict", "lang")


@query("f6_coercions", r"""
SELECT event_id, TRY_CAST(CASE WHEN regexp_full_match(json_extract_string(props, '$.k'), '[+-]?[0-9]+') THEN json_extract_string(props, '$.k') END AS BIGINT) AS k,
       CASE WHEN lower(event_type) IN ('true', '1', 'yes', 'y', 'pass', 'passed') THEN true WHEN lower(event_type) IN ('false', '0', 'no', 'n', 'fail', 'failed') THEN false END AS flag,
       least(greatest(round(value, 2), 10.0), 50.0) AS clamped FROM events""")
def f6(spark, d):
    return table(spark, d, "events").select(
        "event_id", X.to_int(F.get_json_object("props", "$.k")).alias("k"), X.to_bool(F.col("event_type")).alias("flag"), X.clamp(F.round("value", 2), 10.0, 50.0).alias("clamped")
    )


@query("f7_sensitive_cue", r"""
SELECT doc_id, regexp_matches(text, '(?i)\b(age|gender|religion|married|born|thing)\b') AS cue FROM documents""")
def f7(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("text").rlike(r"(?i)\b(age|gender|religion|married|born|thing)\b").alias("cue"))


@query("f8_secret_like", r"""
SELECT doc_id, regexp_matches(text, '(?i)(\bsk-(proj-|svcacct-)?[A-Za-z0-9_-]{8,}|\b(openai[_-]?)?api[_-]?key\s*[:=])') AS secret FROM documents""")
def f8(spark, d):
    return table(spark, d, "documents").select("doc_id", X.has_secret(F.col("text")).alias("secret"))


@query("f9_payload_validation", """
SELECT doc_id, concat_ws(';', CASE WHEN NOT coalesce(lang IN ('en', 'de', 'fr'), false) THEN 'lang' END, CASE WHEN NOT coalesce(n_chars BETWEEN 100 AND 5000, false) THEN 'length' END,
       CASE WHEN NOT coalesce(length(source) <= 4, false) THEN 'source' END) AS errors FROM documents
WHERE NOT (coalesce(lang IN ('en', 'de', 'fr'), false) AND coalesce(n_chars BETWEEN 100 AND 5000, false) AND coalesce(length(source) <= 4, false))""")
def f9(spark, d):
    rules = {"lang": F.col("lang").isin("en", "de", "fr"), "length": F.col("n_chars").between(100, 5000), "source": F.length("source") <= 4}
    _, rejected = rows.validate(table(spark, d, "documents"), rules)
    return rejected.select("doc_id", F.array_join("errors", ";").alias("errors"))


@query("f10_options", """
SELECT DISTINCT trim(p_type) AS option FROM part WHERE trim(p_type) <> '' AND length(trim(p_type)) <= 60 ORDER BY option LIMIT 200""")
def f10(spark, d):
    return rows.options(table(spark, d, "part"), "p_type", 200, ["none"])


@query("f11_label_plausibility", r"""
SELECT p_partkey, CASE WHEN trim(p_name) = '' THEN 'blank' WHEN length(trim(p_name)) > 10 THEN 'too_long'
  WHEN length(regexp_replace(lower(p_name), '[^0-9a-z]', '', 'g')) < 2 THEN 'too_short' WHEN regexp_full_match(trim(p_name), '[0-9.\-() ]+') THEN 'number_only'
  WHEN regexp_matches(trim(p_name), '[.!?]$') THEN 'sentence' END AS reason FROM part""")
def f11(spark, d):
    return table(spark, d, "part").select("p_partkey", rows.plausible_label(F.col("p_name"), 10).alias("reason"))


@query("f12_merge_terms", """
WITH m AS (SELECT 0 AS s, n_nationkey AS o, n_name AS term FROM nation UNION ALL SELECT 1, r_regionkey, r_name FROM region),
k AS (SELECT *, row_number() OVER (PARTITION BY lower(replace(term, ' ', '')) ORDER BY s, o) AS rn FROM m)
SELECT term FROM k WHERE rn = 1 AND lower(replace(term, ' ', '')) NOT IN (SELECT lower(replace(r_name, ' ', '')) FROM region WHERE r_regionkey < 2)""")
def f12(spark, d):
    base = table(spark, d, "nation").select(F.col("n_name").alias("term"), F.col("n_nationkey").alias("ord"))
    added = table(spark, d, "region").select(F.col("r_name").alias("term"), F.col("r_regionkey").alias("ord"))
    return rows.merge_terms(base, added, added.filter("ord < 2")).select("term")


@query("k1_upsert_units", """
WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE upper(p_name) END AS p_name FROM part WHERE p_partkey % 2 = 0)
SELECT part.p_partkey, coalesce(nullif(n.p_name, ''), part.p_name) AS p_name, n.p_partkey IS NOT NULL AS is_active FROM part LEFT JOIN n USING (p_partkey)""")
def k1(spark, d):
    old = table(spark, d, "part").select("p_partkey", "p_name")
    new = old.filter("p_partkey % 2 = 0").withColumn("p_name", F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.upper("p_name")))
    return rows.upsert(old, new, "p_partkey", ["p_name"], deactivate="is_active")


@query("k2_upsert_institution", """
SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN s_name || ' new' ELSE s_name END AS s_name, s_nationkey FROM supplier
UNION ALL SELECT 1000000, 'added', 1""")
def k2(spark, d):
    old = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    new = old.withColumn("s_name", F.when(F.col("s_suppkey") % 5 == 0, F.concat("s_name", F.lit(" new"))).otherwise("")).withColumn("s_nationkey", F.lit(None).cast("int"))
    new = new.unionByName(spark.createDataFrame([(1000000, "added", 1)], new.schema))
    return rows.upsert(old, new, "s_suppkey", ["s_name", "s_nationkey"])


@query("k7_prune_sessions", """
SELECT event_id FROM events WHERE (SELECT max(epoch(ts)) FROM events) - epoch(ts) <= 86400 * 5 ORDER BY ts DESC, event_id DESC LIMIT 100""")
def k7(spark, d):
    e = table(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    now = e.agg(F.max("at").alias("now"))
    return rows.prune(e.crossJoin(F.broadcast(now)), F.col("now") - F.col("at"), 86400 * 5, [F.desc("ts"), F.desc("event_id")], 100).select("event_id")


SNOWFLAKE = "lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey"


@query("j1_catalogue_join", f"""
SELECT n.n_name AS major, c.c_mktsegment AS unit, l.l_returnflag AS ksa_type, count(*) AS n FROM {SNOWFLAKE} GROUP BY ALL""")
def j1(spark, d):
    t = lambda n: table(spark, d, n)
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy(F.col("n_name").alias("major"), F.col("c_mktsegment").alias("unit"), F.col("l_returnflag").alias("ksa_type")).agg(F.count("*").alias("n"))


@query("j2_factor_unit_join", """
SELECT l_orderkey, l_linenumber, c_name AS unit FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_quantity > 45""")
def j2(spark, d):
    t = lambda n: table(spark, d, n)
    return t("lineitem").filter("l_quantity > 45").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("l_orderkey", "l_linenumber", F.col("c_name").alias("unit"))


@query("j3_posting_requirements", """
WITH s AS (SELECT doc_id, lang, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?;\\n]+'), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS ss FROM documents),
e AS (SELECT doc_id, unnest(ss) AS item, generate_subscripts(ss, 1) AS pos FROM s)
SELECT e.doc_id, pos::INTEGER AS pos, substr(item, 1, 180) AS item, CASE WHEN length(substr(item, 1, 180)) > 35 THEN 0.4 ELSE 0.2 END::DOUBLE AS weight
FROM e JOIN labels USING (doc_id) WHERE quality = 1""")
def j3(spark, d):
    from quillmill.operators import documents as docs

    found = docs.requirements(table(spark, d, "documents").join(table(spark, d, "labels").filter("quality = 1"), "doc_id"), "doc_id", "text", (), most=None)
    return found.select("doc_id", "pos", "item", "weight")


@query("j4_eval_case_review", f"""
WITH {REVIEWS}, cases AS (SELECT doc_id AS source_review_id, CASE WHEN toxic = 1 THEN 'negative' ELSE 'golden' END AS case_type FROM labels WHERE doc_id % 2 = 0)
SELECT review_id, case_type, verdict FROM cases JOIN reviews ON source_review_id = review_id WHERE active""")
def j4(spark, d):
    cases = table(spark, d, "labels").filter("doc_id % 2 = 0").select(F.col("doc_id").alias("review_id"), F.when(F.col("toxic") == 1, "negative").otherwise("golden").alias("case_type"))
    return cases.join(reviews(spark, d).filter("active"), "review_id").select("review_id", "case_type", "verdict")


@query("j5_posting_listing", """
SELECT c_custkey, coalesce(n_name, '') AS institution, coalesce(k, 0) AS requirements FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3
LEFT JOIN (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def j5(spark, d):
    counts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k"))
    nation = table(spark, d, "nation").filter("n_regionkey < 3")
    return (
        table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(counts, "c_custkey", "left")
        .select("c_custkey", F.coalesce("n_name", F.lit("")).alias("institution"), F.coalesce("k", F.lit(0)).alias("requirements"))
    )


@query("j6_posting_detail", """
SELECT c_custkey, coalesce(n_name, '') AS institution, coalesce(array_to_string(list_slice(os, 1, 10), ','), '') AS attachments FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT o_custkey, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS os FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def j6(spark, d):
    ordered = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct((-F.col("o_totalprice")).alias("p"), F.col("o_orderkey").alias("k")))).alias("os"))
    return (
        table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(ordered, "c_custkey", "left")
        .select("c_custkey", F.coalesce("n_name", F.lit("")).alias("institution"), F.coalesce(F.array_join(F.transform(F.slice("os", 1, 10), lambda x: x["k"].cast("string")), ","), F.lit("")).alias("attachments"))
    )


@query("j12_evidence_semi_anti", """
SELECT c_custkey, 'official' AS state FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)
UNION ALL SELECT c_custkey, 'missing' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def j12(spark, d):
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").withColumn("state", F.lit("official")).unionByName(c.join(o, "c_custkey", "left_anti").withColumn("state", F.lit("missing")))


@query("w1_stratified_sample", f"""
WITH r AS (SELECT n.n_name AS major, l.l_returnflag AS ksa_type, l.l_orderkey, l.l_linenumber,
  row_number() OVER (PARTITION BY n.n_name, l.l_returnflag ORDER BY abs(length(c.c_name) - 26), l.l_orderkey, l.l_linenumber) AS rn, dense_rank() OVER (ORDER BY n.n_name) AS mr FROM {SNOWFLAKE})
SELECT major, ksa_type, l_orderkey, l_linenumber FROM r WHERE rn <= 3 AND mr <= 10""")
def w1(spark, d):
    from quillmill.operators import ranking

    t = lambda n: table(spark, d, n)
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    shaped = joined.select(F.col("n_name").alias("major"), F.col("l_returnflag").alias("ksa_type"), "l_orderkey", "l_linenumber", F.abs(F.length("c_name") - 26).alias("distance"))
    return ranking.stratified_sample(shaped, "major", "ksa_type", [F.col("distance"), F.col("l_orderkey"), F.col("l_linenumber")], 3, 10).select("major", "ksa_type", "l_orderkey", "l_linenumber")
