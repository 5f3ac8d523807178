"""Queries on sources, logs and the remaining document operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.operators import documents as T
from quillmill.operators import labels as B
from quillmill.operators import layouts as Y
from quillmill.operators import ranking as R
from quillmill.sources import readers
from quillmill.streaming import reviewlog as L
from quillmill.plans.catalog import query, table
from quillmill.plans.ranks import LINES


def _micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


@query("s17_navigate", """
WITH near AS (SELECT s_suppkey, s_nationkey, 'local' AS origin FROM supplier WHERE s_acctbal > 5000),
far AS (SELECT s_suppkey, s_nationkey, 'remote' FROM supplier WHERE s_nationkey NOT IN (SELECT s_nationkey FROM near))
SELECT * FROM near UNION ALL SELECT * FROM far""")
def s17(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    classes = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"))
    return readers.navigate(classes, ["s_nationkey"], s.filter("s_acctbal > 5000"), s, "s_suppkey", "s_suppkey").select("s_suppkey", "s_nationkey", "origin")


@query("s18_search", """
WITH t AS (SELECT unnest(['red', '17', 'nvi']) AS w, unnest([0, 1, 2]) AS o),
h AS (SELECT p_partkey, o, CASE WHEN w = p_partkey::VARCHAR THEN 0.9 ELSE 0.7 END::DOUBLE AS score FROM part JOIN t ON w = p_partkey::VARCHAR OR contains(lower(p_name || ' ' || p_type), w)),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY o, score DESC) AS rn FROM h) SELECT p_partkey, score FROM r WHERE rn = 1 ORDER BY o, p_partkey LIMIT 600""")
def s18(spark, d):
    terms = spark.createDataFrame([("red", 0), ("17", 1), ("nvi", 2)], "term string, ord int")
    return readers.search(terms, "term", "ord", table(spark, d, "part"), "p_partkey", ["p_name", "p_type"], "p_partkey", most=600).select("p_partkey", "score")


@query("l1_current_reviews", """
WITH r AS (SELECT user_id, event_type, event_id, lag(event_id) OVER w AS previous, lead(event_id) OVER w IS NULL AS last FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id))
SELECT user_id, event_type, event_id, previous FROM r WHERE last""")
def l1(spark, d):
    return L.current_reviews(table(spark, d, "events"), "user_id", "event_type", "event_id").select("user_id", "event_type", "event_id", "previous")


def actions(spark, d):
    """An action log shaped from events: mostly reviews, every seventh a rollback, some with a stale expectation."""
    e = table(spark, d, "events")
    return e.select(
        F.col("user_id").cast("string").alias("run"), F.col("event_type").alias("question"), F.col("event_id").alias("event"),
        F.when(F.col("event_id") % 7 == 0, "rollback").otherwise("review").alias("action"),
        F.when(F.col("value") > 60, "approve").when(F.col("value") > 25, "needs_edit").otherwise("reject").alias("verdict"),
        F.when(F.col("event_id") % 11 == 0, F.lit(-1)).cast("long").alias("expected"),
    )


@query("l2_rollback_replay")
def l2(spark, d):
    return L.replay(actions(spark, d))


@query("l3_promote_cases", """
SELECT doc_id AS source_review_id, CASE WHEN toxic = 1 OR quality = 0 THEN 'negative' ELSE 'golden' END AS case_type FROM labels WHERE doc_id % 10 <> 0""")
def l3(spark, d):
    r = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 0, "needs_edit").otherwise("approve").alias("verdict"))
    case = F.when(F.col("verdict") == "approve", "golden").otherwise("negative")
    had = r.filter("id % 10 = 0").select(F.col("id").alias("source_review_id"), case.alias("case_type"))
    return L.promote(r, "id", "verdict", case, had)


@query("l4_request_counts", """
SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS recent FROM events""")
def l4(spark, d):
    return L.request_counts(table(spark, d, "events"), "user_id", "event_type", _micros("ts"), 3600).select("event_id", "recent")


@query("l4_admitted")
def l4b(spark, d):
    return L.admitted(table(spark, d, "events"), "user_id", "event_type", _micros("ts"), "event_id", {"click": 2}, 4, 86400)


@query("l5_live_sessions", "SELECT event_id FROM events WHERE (SELECT max(epoch_us(ts)) FROM events) - epoch_us(ts) <= 86400000000")
def l5(spark, d):
    e = table(spark, d, "events").withColumn("at", _micros("ts"))
    return L.live_sessions(e.crossJoin(F.broadcast(e.agg(F.max("at").alias("now")))), F.col("at"), F.col("now"), 86400_000_000).select("event_id")


@query("l6_queue_stats", """
SELECT count(*) FILTER (f AND r < 3) AS queued, count(*) FILTER (NOT f) AS processed, count(*) FILTER (f) AS failed, count(*) FILTER (f AND r >= 3) AS dead_letter FROM (SELECT value > 80 AS f, event_id % 5 AS r FROM events)""")
def l6(spark, d):
    tasks = table(spark, d, "events").withColumn("retries", F.col("event_id") % 5)
    return L.queue_stats(L.queue_outcome(tasks, F.col("value") > 80, "retries"))


@query("l6_drain", """
SELECT event_id, CASE WHEN k IS NULL OR k >= 4 THEN 4 ELSE k + 1 END AS attempts, CASE WHEN k IS NULL OR k >= 4 THEN 'dead_letter' ELSE 'processed' END AS outcome FROM (SELECT event_id, CASE WHEN event_id % 6 = 5 THEN NULL ELSE event_id % 6 END AS k FROM events)""")
def l6b(spark, d):
    tasks = table(spark, d, "events").withColumn("retries", F.lit(0))
    return L.drain(tasks, F.when(F.col("event_id") % 6 != 5, F.col("event_id") % 6), "retries").select("event_id", F.col("attempts").cast("long").alias("attempts"), "outcome")


@query("l9_history_ring", """
WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events),
u AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS kn FROM r WHERE rn <= 20) SELECT user_id, event_id FROM u WHERE kn = 1""")
def l9(spark, d):
    return R.newest_unique(table(spark, d, "events"), ["user_id"], F.col("event_type"), "event_id", 20).select("user_id", "event_id")


@query("t4d_small_class", rf"""WITH {LINES},
dict AS (SELECT unnest(['the', 'und', 'que']) AS alias, unnest(['english', 'german', 'romance']) AS label),
low AS (SELECT *, regexp_replace(lower(content), '[ \t\r\n\f\x0B]+', '', 'g') AS c FROM lns),
h AS (SELECT doc_id, label, floor((length(c) - length(replace(c, alias, ''))) / length(alias)) * (1.2 + CASE WHEN contains(content, ':') THEN 0.9 ELSE 0.0 END) AS s FROM low JOIN dict ON contains(c, alias)),
a AS (SELECT doc_id, label, round(sum(s)::DOUBLE, 4) AS base FROM h GROUP BY ALL), t AS (SELECT DISTINCT doc_id, label FROM low JOIN dict ON contains(content, '|') AND contains(c, alias)),
s AS (SELECT doc_id, label, round(base + CASE WHEN t.doc_id IS NULL THEN 0 ELSE 2 END, 4) AS score FROM a LEFT JOIN t USING (doc_id, label)), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS rn FROM s WHERE score >= 3)
SELECT doc_id, label, score FROM r WHERE rn <= 5""")
def t4d(spark, d):
    dictionary = spark.createDataFrame([("the", "english", True), ("und", "german", True), ("que", "romance", True)], "alias string, label string, official boolean")
    c = F.col("content")
    docs = table(spark, d, "documents")
    return T.small_classes(docs, "doc_id", "text", dictionary, c.contains(":"), c.contains("|"))


@query("t6d_catalogue_counts", r"""
WITH n AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]{5,}'))) AS name FROM benchmark), al AS (SELECT 'de' AS alias, min(name) AS name FROM n UNION ALL SELECT 'en', max(name) FROM n),
t AS (SELECT doc_id, lang, lower(regexp_replace(coalesce(text, ''), '[ \t\r\n\f\x0B]+', '', 'g')) AS t FROM documents),
c AS (SELECT doc_id, name, floor((length(t) - length(replace(t, name, ''))) / length(name))::BIGINT AS times FROM t JOIN n ON contains(t, name)),
u AS (SELECT doc_id, name, times, times::DOUBLE AS score FROM c UNION ALL SELECT doc_id, name, 0, 0.95 FROM t JOIN al ON lang = alias),
g AS (SELECT doc_id, name, max(times) AS times, max(score) AS score FROM u GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, length(name) DESC, name) AS rn FROM g)
SELECT doc_id, name, times, round(least(1.0, greatest(0.62, CASE WHEN score > 1 THEN score / 3 ELSE score END)), 4)::DOUBLE AS confidence FROM r WHERE rn <= 20""")
def t6d(spark, d):
    """Words of the benchmark as the catalogue, languages as hints."""
    names = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{5,}"), F.lit(0))).alias("name")).select(F.lower("name").alias("name")).distinct()
    ends = names.agg(F.min("name").alias("a"), F.max("name").alias("b"))
    aliases = ends.select(F.explode(F.array(F.struct(F.lit("de").alias("alias"), F.col("a").alias("target")), F.struct(F.lit("en").alias("alias"), F.col("b").alias("target")))).alias("x")).select("x.*")
    return T.catalogue_counts(table(spark, d, "documents"), "doc_id", "text", names, "name", F.array("lang"), aliases, most=20)


@query("t7d_anchor_labels", rf"""WITH {LINES},
a AS (SELECT *, lead(content) OVER (PARTITION BY doc_id ORDER BY line) AS nxt FROM lns)
SELECT doc_id, line, coalesce(nullif(trim(regexp_extract(content, '^[^|]{{1,30}}\|\s*(.*)$', 1)), ''), nxt) AS label FROM a WHERE regexp_matches(content, '^[^|]{{1,30}}\|')""")
def t7d(spark, d):
    return T.anchor_labels(table(spark, d, "documents"), "doc_id", "text", r"^[^|]{1,30}\|", r"^[^|]{1,30}\|\s*(.*)$")


LEVELS = ("Large", "Middle", "Small", "Detail")


def _shaped(spark, d, *layouts: str):
    """Part rows as documents, in one of several layouts each, by size."""
    p = table(spark, d, "part")
    said = F.array(*[F.lit(x) for x in layouts])
    name = F.replace(F.get(said, (F.col("p_size") % len(layouts)).cast("int")), F.lit("{n}"), F.col("p_name"))
    return p.select("p_partkey", F.replace(name, F.lit("{t}"), F.col("p_type")).alias("text"))


@query("t7d_header_position", """
SELECT p_partkey, 0 AS pos, CASE p_size % 5 WHEN 2 THEN p_type ELSE p_name END AS label FROM part WHERE p_size % 5 IN (0, 1, 2, 4) UNION ALL SELECT p_partkey, 1, p_type FROM part WHERE p_size % 5 IN (0, 4)""")
def t7d_header(spark, d):
    docs = _shaped(
        spark, d, "intro\nS m all : 01. {n} 02. {t} (x)\nSmall: 01. late", "Large\nMiddle\n Small\nDetail\n\n06. {t} 01. {n}\n01. a 02. b", "Large\nMiddle\nSmall\n01. {n}\n02. {n} 03. {t} 04. z",
        "Large\nSmall\nMiddle\n01. {n} 02. {t}", "Small {n} / Large, {t} |",
    )
    return Y.header_positions(docs, "p_partkey", "text", LEVELS, 2)


@query("t7d_code_pairs", """
SELECT p_partkey, 0 AS pos, p_name AS label FROM part WHERE p_size % 3 < 2 UNION ALL SELECT p_partkey, 1, p_type FROM part WHERE p_size % 3 = 0 UNION ALL SELECT p_partkey, 0, 'c' FROM part WHERE p_size % 3 = 2""")
def t7d_pairs(spark, d):
    docs = _shaped(spark, d, "01. a 02. b\n03. {n} 04. tail\n01. x 02. y 03. {t}\n", "1) a\n2) Large\n2) b\n3) {n}\n4) {t}\n", "01. a\n02. b\n03. c 04. Small\n{n}")
    return Y.code_pairs(docs, "p_partkey", "text", LEVELS, 2)


@query("t7d_vertical_blocks", """
SELECT p_partkey, 0 AS pos, p_name AS label FROM part WHERE p_size % 3 < 2 UNION ALL SELECT p_partkey, 1, p_type FROM part WHERE p_size % 3 = 0 UNION ALL SELECT p_partkey, 1, 'other' FROM part WHERE p_size % 3 = 1""")
def t7d_blocks(spark, d):
    docs = _shaped(spark, d, "00. no\nMiddle\nSmall\nDetail\n01. {n}\n02. {t}\n01. deep\n02. er\nDuties\n03. {n}", "Small\n01. {n}\n03. gap\n02. gap\nMiddle\n01. other\n01. deep", "Middle\n01. {n}")
    return Y.vertical_blocks(docs, "p_partkey", "text", LEVELS, 2, "^Duties")


@query("t8d_candidate_bundle")
def t8d(spark, d):
    dictionary = spark.createDataFrame([("the", "english", True), ("und", "german", True), ("que", "romance", True), ("of", "english", False)], "alias string, label string, official boolean")
    scored = T.dictionary_scores(table(spark, d, "documents"), "doc_id", "text", dictionary, "alias", "label", "official", F.col("content").contains(":"), F.col("content").contains("|"))
    return R.within_margin(scored, ["doc_id"], "confidence", "label", 0.62, 0.2, 3, 1)


CLASSES = [("c1", "einheit", "g"), ("c2", "keit", "g"), ("c3", "tion", "r"), ("c4", "ción", "r"), ("c5", "heit", "g")]


@query("t4d_anchor_classes")
def t4d_anchor(spark, d):
    names = spark.createDataFrame([(n, i) for i, (_, n, _) in enumerate(CLASSES)], "label string, ord int")
    return B.anchor_classes(table(spark, d, "documents"), "doc_id", "text", names, "label", "ord", r"(?i)\b(?:of|der|que)\b", ("the", "die"), r"\|")


@query("t8d_full_bundle")
def t8d_full(spark, d):
    classes = spark.createDataFrame(CLASSES, "code string, name string, family string")
    aliases = spark.createDataFrame([(n, k, True) for k, n, _ in CLASSES] + [("the", "c3", False), ("und", "c1", False)], "alias string, code string, official boolean")
    c = F.col("content")
    words = F.slice(F.split("text", r"\s+"), 1, 3)
    docs = table(spark, d, "documents")
    return B.candidate_bundle(docs, "doc_id", "text", words, F.left("text", F.lit(40)), classes, "code", "name", "family", aliases, "alias", "official", c.contains(":"), c.contains("|"), show_direct=False)


@query("t12d_method_sections", rf"""WITH {LINES},
m AS (SELECT *, CASE WHEN contains(content, ':') THEN 'colon' WHEN contains(content, '|') THEN 'table' WHEN contains(content, '@') THEN 'mail' END AS m, length(content) <= 180 AND NOT regexp_matches(content, '(?:[.·…‥]{{2,}}|\s{{3,}}|\t)\s*[0-9]{{1,4}}\s*$') AS anchor FROM lns),
t AS (SELECT *, CASE WHEN anchor AND m IS NOT NULL THEN m WHEN anchor AND regexp_matches(content, '^[0-9]') THEN '' END AS start FROM m),
s AS (SELECT *, count(start) OVER (PARTITION BY doc_id ORDER BY line) AS no FROM t),
g AS (SELECT doc_id, no, max(start) AS method, count(*) AS n, max(contains(content, 'the')::INT) + max(contains(content, 'de')::INT) + 2 * max((length(content) > 60)::INT) + least(3, len(list_distinct(flatten(list(regexp_extract_all(content, '[A-Z][a-z]+ung'))))) ) AS score FROM s WHERE no > 0 GROUP BY ALL),
o AS (SELECT doc_id, method, count(*) AS an, sum(n) AS al, count(*) FILTER (score > 0) AS gn, sum(n) FILTER (score > 0) AS gl, max(score) AS score FROM g WHERE method <> '' GROUP BY ALL),
n AS (SELECT DISTINCT doc_id, m AS method FROM m WHERE m IS NOT NULL), w AS (SELECT doc_id, count(*) AS dl FROM m GROUP BY 1),
j AS (SELECT n.doc_id, n.method, an, al, gn, gl, coalesce(score, 0) AS score, dl, count(*) FILTER (coalesce(gn, 0) > 0) OVER (PARTITION BY n.doc_id) >= least(2, count(*) OVER (PARTITION BY n.doc_id)) AS ok FROM n LEFT JOIN o ON n.doc_id = o.doc_id AND n.method = o.method JOIN w ON w.doc_id = n.doc_id),
x AS (SELECT *, CASE WHEN NOT ok OR an IS NULL THEN 'full_document' WHEN gn > 0 THEN 'document_section' ELSE 'low_signal' END AS origin FROM j)
SELECT doc_id, method, origin, CASE origin WHEN 'full_document' THEN 1 WHEN 'document_section' THEN gn ELSE an END::BIGINT AS sections, CASE origin WHEN 'full_document' THEN dl WHEN 'document_section' THEN gl ELSE al END::BIGINT AS n_lines, score::BIGINT AS score FROM x""")
def t12d(spark, d):
    c = F.col("content")
    method = F.when(c.contains(":"), "colon").when(c.contains("|"), "table").when(c.contains("@"), "mail")
    return T.method_sections(table(spark, d, "documents"), "doc_id", "text", method, [c.contains("the"), c.contains("de")], [F.length(c) > 60], "[A-Z][a-z]+ung", c.rlike("^[0-9]"))


@query("j17_near_pairs")
def j17(spark, d):
    from quillmill.operators import dedup as D

    p = table(spark, d, "part").withColumn("t", F.concat_ws(" ", "p_name", "p_type"))
    return D.repeats(p, "p_partkey", F.col("p_type"), F.col("t"), "p_partkey", 0.9).select("p_partkey", "repeated")


@query("s9_decode_pages", """
SELECT event_id AS page, 'k' AS name, json_extract_string(props, '$.k') AS value FROM events""")
def s9(spark, d):
    from pyspark.sql.types import StringType, StructField, StructType

    item = StructType([StructField("name", StringType()), StructField("value", StringType())])
    k = F.get_json_object("props", "$.k")
    as_json = F.concat(F.lit('{"totalCount": 1, "items": {"item": {"name": "k", "value": "'), k, F.lit('"}}}'))
    as_xml = F.concat(F.lit("<r><totalCount>1</totalCount><items><item><name>k</name><value>"), k, F.lit("</value></item></items></r>"))
    xml = F.col("event_id") % 2 == 0
    pages = table(spark, d, "events").select(F.col("event_id").alias("page"), F.when(xml, "text/xml").otherwise("application/json").alias("ct"), F.when(xml, as_xml).otherwise(as_json).alias("body"))
    return pages.select("page", F.explode(readers.decode_page(F.col("body"), item, F.col("ct"))).alias("r")).select("page", "r.*")


@query("s8_decode_rpc", """
SELECT event_id, CASE WHEN event_id % 5 IN (0, 1) THEN json_extract_string(props, '$.k') END AS k, CASE WHEN event_id % 5 = 4 THEN event_type END AS value,
       CASE event_id % 5 WHEN 2 THEN 'busy' WHEN 3 THEN 'unreadable response' END AS error FROM events""")
def s8(spark, d):
    """Captured bodies shaped from events: plain, server-sent, failed, unreadable, and with a bare value."""
    kind = F.col("event_id") % 5
    plain = F.concat(F.lit('{"jsonrpc": "2.0", "result": '), "props", F.lit("}"))
    sent = F.concat(F.lit('event: message\ndata: {"result": {"k": "early"}}\n\ndata: '), plain, F.lit("\ndata: [DONE]\n"))
    bare = F.concat(F.lit('{"error": null, "result": "'), "event_type", F.lit('"}'))
    body = F.when(kind == 0, plain).when(kind == 1, sent).when(kind == 2, '{"error": {"code": 1, "message": "busy"}}').when(kind == 3, "<html>").otherwise(bare)
    said = table(spark, d, "events").select("event_id", readers.decode_rpc(body).alias("r"))
    return said.select("event_id", F.get_json_object("r.result", "$.k").alias("k"), F.get_json_object("r.result", "$.value").alias("value"), "r.error")


@query("l8_one_decision", """
SELECT user_id, arg_max(event_type, event_id) AS decision, max(event_id) AS event_id, count(*) AS revision FROM events GROUP BY user_id""")
def l8(spark, d):
    return L.one_decision(table(spark, d, "events"), "user_id", F.col("event_type"), "event_id")


@query("s7_page_stop", """SELECT n_regionkey AS page, len(ns)::INTEGER AS n FROM (SELECT n_regionkey, list(n_name) AS ns FROM nation WHERE n_regionkey <> 3 GROUP BY 1) WHERE n_regionkey < 3""")
def s7(spark, d):
    pages = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("page")).agg(F.collect_list(F.when(F.col("n_regionkey") != 3, F.col("n_name"))).alias("rows"))
    return readers.until_empty(pages, "page", "rows").select("page", F.size("rows").alias("n"))


@query("k3_parent_child", """
WITH o AS (SELECT o_orderkey, sha256(o_orderkey::VARCHAR) AS id FROM orders), l AS (SELECT o.id AS parent_id, (row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey) - 1)::INTEGER AS ord, l_linenumber, l_partkey FROM o JOIN lineitem ON o_orderkey = l_orderkey)
SELECT parent_id, ord, l_linenumber, l_partkey, sha256(parent_id || '|' || ord::VARCHAR) AS id FROM l""")
def k3(spark, d):
    from quillmill.sources import writers

    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("lines"))
    orders = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "lines")
    return writers.parent_child(orders, ["o_orderkey"], {"lines": "lines"})["lines"]


@query("flagship_ranked_evidence")
def flagship_rank(spark, d):
    """Parts ranked against a text, diversified by class, then their factors by type."""
    from quillmill.plans.ranks import order, ranked_units
    from quillmill.sources.staging import stage

    # read by two passes, and of a known size from here on
    units = stage(ranked_units(spark, d), "ranked-units")
    top = R.diversified(units, "p_brand", "sim", order(), 12, R.class_cap(12, 25))
    return R.rank_factors(units.join(top.select("p_brand").distinct(), "p_brand", "left_semi"), "p_brand", "p_type", order(), 4, 40).select("p_partkey", "p_brand", "p_type", "score")
