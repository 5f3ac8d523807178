"""Queries on aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.operators import aggregates as A
from quillmill.plans.catalog import query, table


def _checks(spark, d):
    """Documents as items with a map of check statuses."""
    status = lambda ok, applies: F.when(~applies, "not_applicable").when(ok, "pass").otherwise("fail")
    return table(spark, d, "documents").select("doc_id", "lang", F.create_map(
        F.lit("long"), status(F.col("n_chars") >= 500, F.lit(True)), F.lit("english_the"), status(F.col("text").contains("the"), F.col("lang") == "en"), F.lit("no_table"), status(~F.col("text").contains("|"), F.col("n_chars") > 100)).alias("statuses"))


@query("a1_check_status_pivot", """
WITH s AS (SELECT 'long' AS "check", CASE WHEN n_chars >= 500 THEN 'pass' ELSE 'fail' END AS st FROM documents
UNION ALL SELECT 'english_the', CASE WHEN lang <> 'en' THEN 'not_applicable' WHEN contains(text, 'the') THEN 'pass' ELSE 'fail' END FROM documents
UNION ALL SELECT 'no_table', CASE WHEN n_chars <= 100 THEN 'not_applicable' WHEN NOT contains(text, '|') THEN 'pass' ELSE 'fail' END FROM documents)
SELECT "check", count(*) FILTER (st = 'pass') AS passed, count(*) FILTER (st = 'fail') AS failed, count(*) FILTER (st = 'not_applicable') AS not_applicable,
       round(count(*) FILTER (st = 'fail') / greatest(1, count(*) FILTER (st <> 'not_applicable')), 4) AS failure_rate FROM s GROUP BY 1""")
def a1(spark, d):
    return A.check_counts(_checks(spark, d), "statuses")


@query("a2_issue_counts", """
WITH i AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), 'the|und|les|que|de'))) AS issue FROM documents)
SELECT issue, count(*) AS n FROM i WHERE issue IN ('the', 'und', 'que') GROUP BY 1""")
def a2(spark, d):
    return A.issue_counts(table(spark, d, "documents"), F.regexp_extract_all(F.lower("text"), F.lit("the|und|les|que|de"), F.lit(0)), ["the", "und", "que"])


@query("a3_first_row_by_code", """
SELECT p_brand, p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part) WHERE rn = 1""")
def a3(spark, d):
    return A.first_row(table(spark, d, "part"), "p_brand", ["p_partkey", "p_name"], "p_partkey")


@query("a4_surface_collisions", """
WITH s AS (SELECT p_brand, p_name, count(DISTINCT p_type) AS k FROM part GROUP BY ALL)
SELECT p_brand, count(*) FILTER (k > 1) AS collision_groups, sum(k - 1)::BIGINT AS variants FROM s GROUP BY 1""")
def a4(spark, d):
    return A.collisions(table(spark, d, "part"), ["p_brand"], F.col("p_name"), F.col("p_type"))


@query("a5_method_matrix", """
SELECT p_brand, p_type, count(*) AS total, count(*) FILTER (p_size > 20) AS ready, count(*) FILTER (NOT p_size > 20) AS failed, round(count(*) FILTER (p_size > 20) / greatest(1, count(*)), 4) AS ready_rate,
  round(avg(p_size), 2) AS average_score, count(p_name) - count(DISTINCT p_name) AS duplicates, arg_min(p_name, p_partkey) AS sample FROM part GROUP BY ALL""")
def a5(spark, d):
    return A.matrix(table(spark, d, "part"), ["p_brand", "p_type"], F.col("p_size") > 20, F.col("p_size"), F.col("p_name"), "p_partkey")


@query("a6_status_histogram", """
WITH c AS (SELECT c_nationkey, c_mktsegment AS v, count(*) AS n FROM customer GROUP BY ALL) SELECT c_nationkey, array_to_string(list(v || '=' || n::VARCHAR ORDER BY v), '; ') AS histogram FROM c GROUP BY 1""")
def a6(spark, d):
    return A.histogram(table(spark, d, "customer"), ["c_nationkey"], F.col("c_mktsegment"))


@query("a7_issue_by_method", """
WITH s AS (SELECT role, unnest(string_split(CASE WHEN length(text) > 200 THEN 'long; ' ELSE '' END || CASE WHEN contains(text, '?') THEN 'question' ELSE 'statement' END, '; ')) AS issue FROM conversations)
SELECT role, issue, count(*) AS n FROM s WHERE issue <> '' GROUP BY ALL""")
def a7(spark, d):
    issues = F.concat(F.when(F.length("text") > 200, "long; ").otherwise(""), F.when(F.col("text").contains("?"), "question").otherwise("statement"))
    return A.split_counts(table(spark, d, "conversations").withColumn("issues", issues), "role", "issues")


@query("a8_quality_gates", """
WITH r AS (SELECT round(avg(quality), 4) AS approval, round(avg(toxic), 4) AS rejection FROM labels)
SELECT approval, rejection, concat_ws(';', CASE WHEN coalesce(approval < 0.9, true) THEN 'approval_low' END, CASE WHEN coalesce(rejection < 0.05, true) THEN 'rejection_low' END) AS failures FROM r""")
def a8(spark, d):
    one = table(spark, d, "labels").agg(F.round(F.avg("quality"), 4).alias("approval"), F.round(F.avg("toxic"), 4).alias("rejection"))
    return A.gate_failures(one, {"approval_low": ("approval", 0.9), "rejection_low": ("rejection", 0.05)}).withColumn("failures", F.array_join("failures", ";"))


@query("a9_most_common", """SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, value LIMIT 3""")
def a9(spark, d):
    return A.most_common(table(spark, d, "events"), F.col("event_type"), 3)


@query("a10_sample_summary", """
WITH s AS (SELECT c_nationkey, list_sort(list_distinct(list(c_mktsegment))) AS a, list_sort(list_distinct(list(CASE WHEN c_acctbal > 0 THEN c_mktsegment END))) AS b FROM customer GROUP BY 1)
SELECT c_nationkey, array_to_string(a, ',') AS a, array_to_string(b, ',') AS b, len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS subset FROM s""")
def a10(spark, d):
    c = table(spark, d, "customer").withColumn("paid", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")))
    found = A.sample_summary(c, "c_nationkey", "c_mktsegment", "paid")
    return found.select("c_nationkey", F.array_join("a", ",").alias("a"), F.array_join("b", ",").alias("b"), "subset")


@query("a11_group_questions", """
SELECT conv_id, role, array_to_string(list(turn::VARCHAR || ':' || length(text)::VARCHAR ORDER BY turn), ' ') AS items FROM conversations GROUP BY ALL""")
def a11(spark, d):
    found = A.nested(table(spark, d, "conversations").withColumn("n", F.length("text")), ["conv_id", "role"], "turn", ["turn", "n"])
    return found.select("conv_id", "role", F.array_join(F.transform("items", lambda x: F.concat(x["turn"].cast("string"), F.lit(":"), x["n"].cast("string"))), " ").alias("items"))


@query("a12_set_realism", """
SELECT lang, source, bool_and(coalesce(n_chars > 10, false)) AS long_enough, bool_and(coalesce(NOT contains(text, '|'), false)) AS no_table, round(coalesce(avg(n_chars % 100), 0), 1) AS score FROM documents GROUP BY ALL""")
def a12(spark, d):
    return A.set_summary(table(spark, d, "documents"), ["lang", "source"], {"long_enough": F.col("n_chars") > 10, "no_table": ~F.col("text").contains("|")}, F.col("n_chars") % 100)


@query("a13_run_decisions", """
WITH r AS (SELECT source AS run, doc_id, CASE WHEN toxic = 1 AND doc_id % 7 = 0 THEN 'reject' WHEN quality = 0 AND doc_id % 5 = 0 THEN 'needs_edit' ELSE 'approve' END AS verdict, doc_id % 97 = 0 AS esc FROM labels JOIN documents USING (doc_id)),
f AS (SELECT run, bool_or(verdict = 'reject') AS rj, bool_or(verdict = 'needs_edit') AS ed, count(DISTINCT CASE WHEN verdict = 'approve' THEN doc_id END) AS ap, bool_or(esc) AS esc, count(verdict) AS n FROM r GROUP BY 1)
SELECT run, CASE WHEN rj THEN 'rejected' WHEN ed THEN 'needs_edit' WHEN ap >= 18 AND NOT esc THEN 'approved' WHEN n > 0 THEN 'reviewing' ELSE 'draft' END AS decision FROM f""")
def a13(spark, d):
    joined = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", F.col("source").alias("run")), "doc_id")
    verdict = F.when((F.col("toxic") == 1) & (F.col("doc_id") % 7 == 0), "reject").when((F.col("quality") == 0) & (F.col("doc_id") % 5 == 0), "needs_edit").otherwise("approve")
    return A.decisions(joined.withColumn("verdict", verdict), "run", "doc_id", "verdict", F.lit(18), F.col("doc_id") % 97 == 0)


@query("a14_coverage_summary", """
SELECT count(*) FILTER (l_quantity > 40) AS exact, count(*) FILTER (l_quantity BETWEEN 20 AND 40) AS unit_name_only, count(*) FILTER (l_quantity < 20) AS uncovered FROM lineitem""")
def a14(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").agg(F.count_if(q > 40).alias("exact"), F.count_if(q.between(20, 40)).alias("unit_name_only"), F.count_if(q < 20).alias("uncovered"))


@query("a15_stage_reached", """
WITH e AS (SELECT user_id, event_type, bool_and(value < 95) AS ok, min(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END) AS o FROM events GROUP BY ALL),
u AS (SELECT *, bool_and(ok) OVER (PARTITION BY user_id ORDER BY o, event_type) AS al FROM (SELECT user_id, o, bool_and(ok) AS ok, min(event_type) AS event_type FROM e GROUP BY ALL))
SELECT user_id, max(CASE WHEN al THEN o END) AS stage FROM u GROUP BY 1""")
def a15(spark, d):
    order = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).otherwise(3)
    return A.stage_reached(table(spark, d, "events").withColumn("o", order).withColumn("s", order), "user_id", "s", "o", F.col("value") < 95).select("user_id", "stage")


@query("a16_best_score_by_unit", """SELECT p_brand, round(max(CASE WHEN p_retailprice = 0 THEN 1.0 ELSE p_retailprice END), 2) AS score FROM part GROUP BY 1""")
def a16(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.round(F.max(F.when(F.col("p_retailprice") == 0, 1.0).otherwise(F.col("p_retailprice"))), 2).alias("score"))


@query("a17_reverse_index", """SELECT r_name, array_to_string(list_sort(list_distinct(list(n_name))), ',') AS "values" FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def a17(spark, d):
    joined = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return A.reverse_index(joined, "r_name", "n_name").withColumn("values", F.array_join("values", ","))


@query("a18_simulation_rollup", """
SELECT role, count(*) AS generated, count(DISTINCT text) AS "unique", count(*) FILTER (turn > 3) AS repaired, count(*) = count(DISTINCT text) AS no_duplicates FROM conversations GROUP BY 1""")
def a18(spark, d):
    return A.simulation_summary(table(spark, d, "conversations"), "role", F.col("text"), F.col("turn") > 3)
