"""Queries on ranking, top-k and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.functions import text as X
from quillmill.operators import ranking as R
from quillmill.plans.catalog import query, table

#: Character 2- to 4-grams of a compacted text, as DuckDB SQL.
GRAMS = """
  list_concat(list_concat(
    CASE WHEN length(t) >= 2 THEN list_transform(range(1, length(t)), lambda i: substr(t, i, 2)) ELSE [] END,
    CASE WHEN length(t) >= 3 THEN list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3)) ELSE [] END),
    CASE WHEN length(t) >= 4 THEN list_transform(range(1, length(t) - 2), lambda i: substr(t, i, 4)) ELSE CASE WHEN length(t) = 1 THEN [t] ELSE [] END END)"""

TFIDF = f"""
d AS (SELECT p_partkey, regexp_replace(lower(p_name), '[^0-9a-z]', '', 'g') AS t FROM part),
g AS (SELECT p_partkey, unnest({GRAMS}) AS g FROM d),
tf AS (SELECT p_partkey, g, 1 + ln(count(*)) AS tf FROM g GROUP BY ALL),
idf AS (SELECT g, ln(((SELECT count(*) FROM part) + 1) / (count(*) + 1)) + 1 AS idf FROM tf GROUP BY g),
w AS (SELECT p_partkey, g, tf * idf AS w FROM tf JOIN idf USING (g)),
nrm AS (SELECT p_partkey, sqrt(sum(w * w)) AS dn FROM w GROUP BY 1),
qd AS (SELECT regexp_replace(lower(p_name || ' ' || p_type), '[^0-9a-z]', '', 'g') AS t FROM part WHERE p_partkey = (SELECT min(p_partkey) FROM part)),
qg AS (SELECT unnest({GRAMS}) AS g FROM qd),
q AS (SELECT g, (1 + ln(count(*))) * any_value(idf) AS qw FROM qg JOIN idf USING (g) GROUP BY g),
dots AS (SELECT p_partkey, sum(w * qw) AS dot FROM w JOIN q USING (g) GROUP BY 1),
sims AS (SELECT p_partkey, coalesce(dot / (dn * (SELECT sqrt(sum(qw * qw)) FROM q)), 0.0) AS sim FROM part LEFT JOIN dots USING (p_partkey) LEFT JOIN nrm USING (p_partkey))"""

UNITS = TFIDF + """,
sc AS (SELECT p_partkey, p_brand, p_type, round(sim, 6) AS sim, p_retailprice AS src FROM sims JOIN part USING (p_partkey)),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, sim DESC, sn DESC, p_partkey) AS rank FROM (
  SELECT *, round(0.88 * sim + 0.12 * sn - CASE WHEN p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') THEN 0.0 ELSE 0.15 END, 6) AS score FROM (
    SELECT *, (src - min(src) OVER ()) / (max(src) OVER () - min(src) OVER ()) AS sn FROM sc)))"""


def _similar(spark, d, *keep):
    parts = table(spark, d, "part")
    first = parts.agg(F.min("p_partkey").alias("k"))
    asked = parts.join(F.broadcast(first), F.col("p_partkey") == F.col("k")).select(F.concat("p_name", F.lit(" "), "p_type").alias("q"))
    return R.tfidf(parts, "p_partkey", F.col("p_name"), asked, F.col("q"), keep=keep)


def ranked_units(spark, d):
    """Parts as units ranked against the first part's text; classes are brands."""
    units = _similar(spark, d, "p_brand", "p_type", "p_retailprice").withColumn("sim", F.round("sim", 6))
    return R.rank_units(units, "sim", "p_retailprice", F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13"), base=table(spark, d, "part"))


def order():
    return R.unit_order("sim", "p_partkey")


@query("x5_char_ngrams", f"""
WITH d AS (SELECT p_partkey, regexp_replace(lower(p_name), '[^0-9a-z]', '', 'g') AS t FROM part), g AS (SELECT p_partkey, unnest({GRAMS}) AS g FROM d)
SELECT g AS gram, count(*) AS n, count(DISTINCT p_partkey) AS docs FROM g GROUP BY g""")
def x5(spark, d):
    grams = table(spark, d, "part").select("p_partkey", F.explode(X.char_ngrams(F.col("p_name"))).alias("gram"))
    return grams.groupBy("gram", "p_partkey").agg(F.count("*").alias("c")).groupBy("gram").agg(F.sum("c").alias("n"), F.count("*").alias("docs"))


@query("x6_tfidf_cosine", f"WITH {TFIDF} SELECT p_partkey, round(sim, 6) AS sim FROM sims")
def x6(spark, d):
    return _similar(spark, d).select("p_partkey", F.round("sim", 6).alias("sim"))


@query("w2_rank_units", f"WITH {UNITS} SELECT p_partkey, score, rank FROM ranked WHERE rank <= 100")
def w2(spark, d):
    return R.top(ranked_units(spark, d), order(), 100).select("p_partkey", "score", F.col("rank").cast("long").alias("rank"))


@query("w3_diversified_topk", f"""WITH {UNITS},
t AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY sim < 0.02, rank) AS rn FROM ranked)
SELECT p_partkey, p_brand, tier FROM (SELECT *, CASE WHEN rn > 2 THEN 3 WHEN sim < 0.02 THEN 2 ELSE 1 END AS tier FROM t) ORDER BY tier, rank LIMIT 12""")
def w3(spark, d):
    return R.diversified(ranked_units(spark, d), "p_brand", "sim", order(), 12, R.class_cap(24, 12)).select("p_partkey", "p_brand", "tier")


@query("w4_rank_factors", f"""WITH {UNITS},
f AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY rank) = 1 AS first FROM ranked),
n AS (SELECT *, row_number() OVER (PARTITION BY p_brand, first ORDER BY rank) AS no, count(*) FILTER (first) OVER (PARTITION BY p_brand) AS kinds FROM f)
SELECT p_partkey, p_brand, p_type FROM n WHERE no <= CASE WHEN first THEN 8 ELSE greatest(0, 8 - kinds) END ORDER BY rank LIMIT 60""")
def w4(spark, d):
    return R.rank_factors(ranked_units(spark, d), "p_brand", "p_type", order(), 8, 60).select("p_partkey", "p_brand", "p_type")


@query("w5_balanced_types", """
WITH k AS (SELECT *, list_position(['PROMO', 'STANDARD', 'SMALL'], p_type) AS pl FROM part), r AS (SELECT *, coalesce(pl, 0) AS place, row_number() OVER (PARTITION BY coalesce(pl, 0) ORDER BY p_partkey) AS turn FROM k)
SELECT p_partkey, p_type FROM r ORDER BY place = 0, CASE WHEN place = 0 THEN 0 ELSE turn END, place, p_partkey LIMIT 40""")
def w5(spark, d):
    return R.balanced(table(spark, d, "part"), "p_type", "p_partkey", ["PROMO", "STANDARD", "SMALL"], 40).select("p_partkey", "p_type")


@query("w6_interleave", """
SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)::INTEGER AS turn FROM part""")
def w6(spark, d):
    return R.interleaved(table(spark, d, "part"), "p_brand", "p_brand", "p_partkey").select("p_partkey", "p_brand", "turn")


@query("w7_confidence_margin", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn, greatest(1000.0, max(p_retailprice) OVER (PARTITION BY p_brand) - 50) AS bar FROM part)
SELECT p_partkey, p_brand FROM r WHERE (p_retailprice >= bar AND rn <= 5) OR rn <= 1""")
def w7(spark, d):
    return R.within_margin(table(spark, d, "part"), ["p_brand"], "p_retailprice", "p_partkey", 1000.0, 50.0, 5, 1).select("p_partkey", "p_brand")


@query("w8_merge_candidates", """
WITH f AS (SELECT p_brand, min(p_partkey) AS position FROM part GROUP BY 1 ORDER BY 2 LIMIT 10), e AS (SELECT max(position) AS e, count(*) AS n FROM f),
r AS (SELECT part.*, position, row_number() OVER (PARTITION BY part.p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part JOIN f ON part.p_brand = f.p_brand CROSS JOIN e WHERE n < 10 OR p_partkey <= e)
SELECT position, p_partkey, p_brand FROM r WHERE rn = 1""")
def w8(spark, d):
    return R.merge_candidates(table(spark, d, "part"), "p_brand", "p_retailprice", "p_partkey", 10).select("position", "p_partkey", "p_brand")


@query("w9_recommend_postings", """
SELECT doc_id, score FROM (SELECT doc_id, (len(list_filter(['the', 'worth', 'entre', 'ung', 'ción'], lambda k: contains(lower(text), k))) + CASE WHEN source = 'src1' THEN 2.0 ELSE 0.0 END)::DOUBLE AS score, n_chars FROM documents)
ORDER BY score DESC, n_chars DESC, doc_id DESC LIMIT 40""")
def w9(spark, d):
    return R.keyword_overlap(table(spark, d, "documents"), "doc_id", F.col("text"), ["the", "worth", "entre", "ung", "ción"], F.when(F.col("source") == "src1", 2.0).otherwise(0.0), F.col("n_chars"), 40).select("doc_id", "score")


@query("w10_local_mapper", """
WITH k AS (SELECT *, string_split(lower(p_name), ' ') AS ks, lower('promo brand large steel ' || (SELECT min(p_name) FROM part)) AS q FROM part),
s AS (SELECT p_partkey, CASE WHEN contains(q, lower(p_type)) THEN 0.9 WHEN len(list_filter(ks, lambda x: contains(q, x))) > 0 THEN least(0.5 + len(list_filter(ks, lambda x: contains(q, x))) * 0.15, 0.85) ELSE 0.2 END::DOUBLE AS score FROM k)
SELECT p_partkey, round(score, 4) AS score FROM s ORDER BY score DESC, p_partkey LIMIT 30""")
def w10(spark, d):
    parts = table(spark, d, "part")
    least = parts.agg(F.lower(F.concat(F.lit("promo brand large steel "), F.min("p_name"))).alias("q"))
    return R.local_mapper(parts.crossJoin(F.broadcast(least)), F.lower("p_type"), F.split(F.lower("p_name"), " "), F.col("q"), "p_partkey", 30).select("p_partkey", "score")


@query("w11_allocate_counts", """
SELECT n_name, (17 // 25 + CASE WHEN row_number() OVER (ORDER BY n_nationkey) - 1 < 17 % 17 THEN 1 ELSE 1 END)::INTEGER AS allocated FROM nation WHERE n_nationkey < 17
UNION ALL SELECT r_name, (17 // 5 + CASE WHEN r_regionkey < 17 % 5 THEN 1 ELSE 0 END)::INTEGER FROM region""")
def w11(spark, d):
    a = R.allocate_counts(table(spark, d, "nation").select("n_name", "n_nationkey"), "n_nationkey", 17).select("n_name", "allocated")
    b = R.allocate_counts(table(spark, d, "region").select(F.col("r_name").alias("n_name"), "r_regionkey"), "r_regionkey", 17).select("n_name", "allocated")
    return a.unionByName(b)


PLAN = """
one AS (SELECT *, row_number() OVER (PARTITION BY lower(replace(n_name, ' ', '')) ORDER BY n_nationkey) AS rn FROM nation WHERE n_regionkey <> 2),
rep AS (SELECT n_nationkey, n_name, least(greatest(n_nationkey % 5, 0), 10) AS c FROM one WHERE rn = 1),
ex AS (SELECT n_nationkey, n_name, unnest(range(1, c::BIGINT + 1)) AS copy FROM rep WHERE c > 0),
slots AS (SELECT *, row_number() OVER (ORDER BY n_nationkey, copy)::INTEGER AS slot FROM ex)"""


def plan(spark, d):
    nation = table(spark, d, "nation")
    return R.expand_plan(nation.withColumn("main_count", F.col("n_nationkey") % 5), "n_name", "main_count", "n_nationkey", cap=30, enabled=F.col("n_regionkey") != 2)


@query("w12_plan_expansion", f"WITH {PLAN} SELECT slot, n_name FROM slots WHERE slot <= 30")
def w12(spark, d):
    return plan(spark, d).select("slot", "n_name")


@query("w13_batching", f"WITH {PLAN} SELECT ((slot - 1) // 5)::INTEGER AS batch, n_name, count(*) AS n FROM slots WHERE slot <= 30 GROUP BY ALL")
def w13(spark, d):
    return R.batches(plan(spark, d), "slot").groupBy("batch", "n_name").agg(F.count("*").alias("n"))


QKEY = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '\[[^\]]+\]', ' ', 'g'), '[^0-9a-z가-힣 ]+', ' ', 'g'), ' +', ' ', 'g'))"


@query("w14_newest_unique", f"""
WITH r AS (SELECT *, {QKEY} AS k, row_number() OVER (PARTITION BY role ORDER BY conv_id * 1000 + turn DESC) AS rn FROM conversations),
u AS (SELECT *, row_number() OVER (PARTITION BY role, k ORDER BY conv_id * 1000 + turn DESC) AS kn FROM r WHERE rn <= 100 AND k <> '')
SELECT conv_id, turn, role FROM u WHERE kn = 1""")
def w14(spark, d):
    conv = table(spark, d, "conversations").withColumn("ord", F.col("conv_id") * 1000 + F.col("turn"))
    return R.newest_unique(conv, ["role"], F.col("text"), "ord", 100).select("conv_id", "turn", "role")


@query("w15_nearest_first", """
SELECT p_partkey FROM (SELECT p_partkey, least(abs(p_partkey - 7), abs(p_partkey - 40)) AS far FROM part) ORDER BY CASE WHEN far = 0 THEN 0 ELSE 1 END, far, p_partkey LIMIT 8""")
def w15(spark, d):
    return R.nearest_first(table(spark, d, "part"), "p_partkey", [7, 40]).select("p_partkey")


LINES = """
ln0 AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
ln1 AS (SELECT doc_id, unnest(ls) AS content, (generate_subscripts(ls, 1) - 1)::INTEGER AS line FROM ln0),
lns AS (SELECT doc_id, line, trim(content, ' ') AS content FROM ln1 WHERE trim(content, ' ') <> '')"""


def _lines(spark, d):
    from quillmill.operators import documents

    return documents.lines(table(spark, d, "documents"), "doc_id", "text")


@query("w16_line_context", f"""WITH {LINES}
SELECT doc_id, line, max(contains(lower(content), 'the')::INT) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 8 PRECEDING AND 1 FOLLOWING) = 1 AS near_anchor,
  max(contains(lower(content), 'de ')::INT) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 1 AS near_section FROM lns""")
def w16(spark, d):
    low = F.lower("content")
    return R.line_context(_lines(spark, d), "doc_id", "line", low.contains("the"), low.contains("de ")).select("doc_id", "line", "near_anchor", "near_section")


@query("w17_context_points", f"""WITH {LINES},
p AS (SELECT *, CASE WHEN regexp_matches(content, '[0-9]') THEN 'digit' WHEN contains(content, '|') THEN 'table' END AS label,
  CASE WHEN max(contains(lower(content), 'the')::INT) OVER (PARTITION BY doc_id ORDER BY line RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) = 1 THEN 3
       WHEN max(contains(lower(content), 'de ')::INT) OVER (PARTITION BY doc_id ORDER BY line RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 1 THEN 2 ELSE 1 END AS points FROM lns)
SELECT doc_id, label, least(sum(points), 6)::BIGINT AS score, array_to_string(list_slice(list_sort(list(line)), 1, 3), ',') AS evidence FROM p WHERE label IS NOT NULL GROUP BY ALL""")
def w17(spark, d):
    low = F.lower("content")
    marked = _lines(spark, d).withColumn("label", F.when(F.col("content").rlike("[0-9]"), "digit").when(F.col("content").contains("|"), "table"))
    found = R.context_points(marked, "doc_id", "line", "label", low.contains("the"), low.contains("de "))
    return found.select("doc_id", "label", F.col("score").cast("long").alias("score"), F.array_join(F.transform("evidence", lambda x: x.cast("string")), ",").alias("evidence"))


@query("w18_split_terms", """
WITH l AS (SELECT conv_id, turn, regexp_replace(lower(regexp_replace(role, '\\s+', '', 'g')), '[-_/|(),.]', '', 'g') AS k FROM conversations),
w AS (SELECT *, lead(k, 1) OVER (PARTITION BY conv_id ORDER BY turn) AS k2, lead(k, 2) OVER (PARTITION BY conv_id ORDER BY turn) AS k3 FROM l),
s AS (SELECT conv_id, turn, 3 AS width, k || k2 || k3 AS j FROM w UNION ALL SELECT conv_id, turn, 2, k || k2 FROM w),
t AS (SELECT unnest(['user assistant', 'assistant user', 'user assistant user']) AS term),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY width DESC, term) AS rn FROM s JOIN t ON replace(term, ' ', '') = j)
SELECT conv_id, turn, width, term FROM f WHERE rn = 1""")
def w18(spark, d):
    terms = spark.createDataFrame([("user assistant",), ("assistant user",), ("user assistant user",)], "term string")
    return R.split_terms(table(spark, d, "conversations"), "conv_id", "turn", F.col("role"), terms, "term").select("conv_id", "turn", "width", "term")


@query("w19_family_expansion", """
WITH dir AS (SELECT n_nationkey AS k, n_regionkey AS g FROM nation WHERE n_nationkey = 3),
more AS (SELECT n.n_nationkey AS k, n.n_regionkey AS g FROM nation n JOIN dir ON n.n_regionkey = dir.g WHERE n.n_nationkey <> 3 AND n.n_nationkey / 25.0 >= 0.2 ORDER BY n.n_nationkey DESC LIMIT 2)
SELECT k, g FROM dir UNION ALL SELECT k, g FROM more""")
def w19(spark, d):
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("g"), (F.col("n_nationkey") / 25.0).alias("conf"))
    return R.expand_family(nation.filter("k = 3"), nation, "k", "g", "conf", 0.2).select("k", "g")


@query("w20_slot_assignment", f"""WITH {PLAN},
pool AS (SELECT n_name, list(s_suppkey ORDER BY s_suppkey) AS us FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1),
a AS (SELECT slot, s.n_name, ['interview', 'debate', 'task'][(slot - 1) % 3 + 1] AS method, us, row_number() OVER (PARTITION BY s.n_name ORDER BY slot) - 1 AS turn FROM slots s LEFT JOIN pool ON pool.n_name = s.n_name WHERE slot <= 30)
SELECT slot, n_name, method, CASE WHEN len(us) > 0 THEN us[turn % len(us) + 1] END AS unit FROM a""")
def w20(spark, d):
    pool = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("pool_name"), "s_suppkey")
    return R.assign_slots(plan(spark, d), "slot", "n_name", ["interview", "debate", "task"], pool, "pool_name", "s_suppkey", "s_suppkey").select("slot", "n_name", "method", "unit")
