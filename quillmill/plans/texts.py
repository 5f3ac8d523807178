"""Queries on text functions, documents and quality rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.functions import hangul as H
from quillmill.functions import text as X
from quillmill.functions import udfs as U
from quillmill.operators import documents as T
from quillmill.operators import elicitation as E
from quillmill.operators import labels as B
from quillmill.operators import quality as Q
from quillmill.operators import questions as K
from quillmill.operators import signals as S
from quillmill.operators import surfaces as N
from quillmill.plans.catalog import query, table
from quillmill.plans.ranks import LINES, QKEY


@query("x1_normalisers", r"""
SELECT doc_id, md5(regexp_replace(lower(regexp_replace(text, '[\s\x{00A0}\x{3000}]+', '', 'g')), '[·‧･ㆍ•∙⋅\-_/|(),.\[\]{}:;]', '', 'g')) AS n1,
 md5(regexp_replace(regexp_replace(lower(regexp_replace(text, '[\s\x{00A0}\x{3000}]+', '', 'g')), '[·‧･ㆍ•∙⋅\-_/|(),.\[\]{}:;]', '', 'g'), '[^0-9a-z가-힣]', '', 'g')) AS n2,
 md5(lower(regexp_replace(text, '[\s\x{00A0}\x{3000}·‧･ㆍ•∙⋅・\-_/|(),.]+', '', 'g'))) AS n3, md5(lower(regexp_replace(text, '[^0-9A-Za-z가-힣]+', '', 'g'))) AS n7 FROM documents""")
def x1(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(X.dedup_key(c)).alias("n1"), F.md5(X.label_key(c)).alias("n2"), F.md5(X.catalogue_key(c)).alias("n3"), F.md5(X.surface_key(c)).alias("n7"))


@query("x1_question_key", f"SELECT conv_id, turn, {QKEY} AS k FROM conversations")
def x1b(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.question_key(F.col("text")).alias("k"))


@query("x1_codes", "SELECT p_partkey, CASE WHEN length(p_size::VARCHAR) < 4 THEN lpad(p_size::VARCHAR, 4, '0') ELSE p_size::VARCHAR END AS code FROM part")
def x1c(spark, d):
    return table(spark, d, "part").select("p_partkey", X.code(F.concat(F.col("p_size").cast("string"), F.lit(".0")), 4).alias("code"))


@query("x2_tokens", r"""
SELECT conv_id, turn, len(list_filter(list_distinct(regexp_extract_all(lower(text), '[가-힣a-z0-9]{2,}')), lambda x: x NOT IN ('the', 'of'))) AS n FROM conversations""")
def x2(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(X.tokens(F.col("text"), ("the", "of"))).cast("long").alias("n"))


@query("x3_sentences", r"""
WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?;\n]+'), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS ss FROM documents)
SELECT doc_id, unnest(ss) AS sentence, generate_subscripts(ss, 1)::INTEGER AS pos FROM s""")
def x3(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("p", "sentence")).select("doc_id", "sentence", (F.col("p") + 1).alias("pos"))


@query("x4_requirements", r"""
WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?;\n]+'), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS ss FROM documents),
e AS (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1)::INTEGER AS pos FROM s),
w AS (SELECT doc_id, pos, substr(s, 1, 180) AS item, round(least(0.2 + CASE WHEN contains(substr(s, 1, 180), 'the') OR contains(substr(s, 1, 180), 'und') THEN 0.3 ELSE 0 END + CASE WHEN length(substr(s, 1, 180)) > 35 THEN 0.2 ELSE 0 END, 1.0)::DOUBLE, 4) AS weight FROM e)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, pos) AS rn FROM w) WHERE rn <= 30""".replace("SELECT * FROM (", "SELECT doc_id, pos, item, weight FROM ("))
def x4(spark, d):
    return T.requirements(table(spark, d, "documents"), "doc_id", "text", ("the", "und"))


@query("x7_sequence_ratio")
def x7(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", F.round(U.sequence_ratio("p_name", "p_type"), 6).alias("ratio"))


@query("x8_set_similarity", f"""
WITH k AS (SELECT conv_id, turn, {QKEY} AS k FROM conversations), t AS (SELECT conv_id, turn, list_distinct(list_filter(string_split(k, ' '), lambda x: length(x) >= 2)) AS t FROM k)
SELECT a.conv_id, round(CASE WHEN len(list_distinct(list_concat(a.t, b.t))) > 0 THEN len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) ELSE 0.0 END, 6) AS jaccard,
  round(CASE WHEN least(len(a.t), len(b.t)) > 0 THEN len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t)) ELSE 0.0 END, 6) AS overlap FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1""")
def x8(spark, d):
    c = table(spark, d, "conversations").withColumn("t", X.question_tokens(F.col("text")))
    a, b = c.filter("turn = 0").select("conv_id", F.col("t").alias("a")), c.filter("turn = 1").select("conv_id", F.col("t").alias("b"))
    return a.join(b, "conv_id").select("conv_id", F.round(X.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"), F.round(X.overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


@query("x9_stems")
def x9(spark, d):
    stem = U.stemmer(("ing", "tion", "er", "es", "ed"))
    return table(spark, d, "documents").select(F.explode(X.tokens(F.col("text"))).alias("w")).distinct().select("w", stem("w").alias("stem"))


@query("x10_mojibake", """
SELECT conv_id, turn, (conv_id + turn) % 3 = 0 AS broken, CASE WHEN (conv_id + turn) % 3 = 0 THEN '한국어 ' || text ELSE text END AS text FROM conversations""")
def x10(spark, d):
    """A third of the turns, with some Hangul, read in the wrong encoding, and repaired."""
    broken = (F.col("conv_id") + F.col("turn")) % 3 == 0
    misread = F.decode(F.encode(F.concat(F.lit("한국어 "), "text"), "UTF-8"), "ISO-8859-1")
    return table(spark, d, "conversations").select("conv_id", "turn", broken.alias("broken"), U.repair_mojibake(F.when(broken, misread).otherwise(F.col("text"))).alias("text"))


INTENTS = (("motive", ("the", "why"), 2), ("table", ("|",), 1), ("romance", ("que", "de", "la"), 2), ("german", ("sch", "ung"), 1))


@query("x11_intents", """
SELECT doc_id, CASE WHEN t = '' THEN 'none' WHEN contains(t, 'the')::INT + contains(t, 'why')::INT >= 2 THEN 'motive' WHEN contains(t, '|') THEN 'table' WHEN contains(t, 'que')::INT + contains(t, 'de')::INT + contains(t, 'la')::INT >= 2 THEN 'romance'
 WHEN contains(t, 'sch') OR contains(t, 'ung') THEN 'german' ELSE 'none' END AS intent FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)""")
def x11(spark, d):
    return table(spark, d, "documents").select("doc_id", X.first_match(F.lower(X.text_or_empty(F.col("text"))), INTENTS, "none").alias("intent"))


@query("x12_scenario_signature", """
SELECT doc_id, concat_ws('+', CASE WHEN contains(text, 'the') OR contains(text, 'with') THEN 'en' END, CASE WHEN contains(text, '|') THEN 'table' END, CASE WHEN contains(text, '@') THEN 'mail' END) AS signature FROM documents""")
def x12(spark, d):
    return table(spark, d, "documents").select("doc_id", X.signature(F.col("text"), (("en", ("the", "with")), ("table", ("|",)), ("mail", ("@",)))).alias("signature"))


@query("x13_ksa_type", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '지식' WHEN 1 THEN '기술' WHEN 2 THEN '태도' ELSE '' END AS kind FROM part")
def x13(spark, d):
    raw = F.when(F.col("p_size") % 4 == 0, "Knowledge").when(F.col("p_size") % 4 == 1, "skills").otherwise("")
    name = F.when(F.col("p_size") % 4 == 2, "책임감 있는 자세").otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", X.ksa_type(raw, name).alias("kind"))


@query("x14_method_alias", "SELECT event_id, CASE event_type WHEN 'view' THEN 'seen' WHEN 'click' THEN 'used' ELSE 'other' END AS method FROM events")
def x14(spark, d):
    return table(spark, d, "events").select("event_id", X.canonical(F.concat(F.upper("event_type"), F.lit(" !")), {"view": "seen", "click": "used"}, "other").alias("method"))


@query("x15_evidence_id", """
SELECT p_partkey, 'ksa_' || substr(sha256('{"brand":"' || p_brand || '","name":"' || p_name || '"}'), 1, 24) AS evidence FROM part""")
def x15(spark, d):
    return table(spark, d, "part").select("p_partkey", X.evidence_id("ksa", {"name": F.col("p_name"), "brand": F.col("p_brand")}).alias("evidence"))


@query("x16_task_surface")
def x16(spark, d):
    rewrite = U.rewriter(((r"\s+", " "), (r"^(?:the|a) ", ""), (r"(\w+)ing\b", r"\1")))
    return table(spark, d, "part").select("p_partkey", rewrite("p_name").alias("r")).select("p_partkey", "r.text", "r.rule")


PHRASES = N.Phrases(
    rules={"지식": ((r"\s*규정$", " 규정 적용·판단 기준"), (r"(분석|점검)$", "$1·판단 기준")), "기술": ((r"\s*분석$", " 검토 절차"), (r"\s*점검$", " 확인 절차"))},
    default={"지식": " 확인·판단 기준", "기술": " 수행·검증 절차", "태도": " 행동 기준", "": " 업무 기준"},
    elements={"지식": " 관련 정보 확인·판단 기준", "": " 수행·검증 절차"}, competencies={"태도": " 행동 기준", "": " 업무 기준"}, fallback={"": "업무 판단과 수행 기준"},
)
CLAUSES = ("분석하는", "찾아낼 수 있는", "다루는", "검토할 수 있는", "점검하고자 하는", "읽을 수 있는", "관리")


def _clause(of):
    """A clause on a part's name: a verb form chosen by its size, behind an object that ends in a vowel or a consonant."""
    verb = F.element_at(F.array(*[F.lit(c) for c in CLAUSES]), (F.col("p_size") % len(CLAUSES) + 1).cast("int"))
    return F.concat(of, F.when(F.col("p_size") % 2 == 0, " 문건을 ").otherwise(" 자료를 "), verb)


NOUNS = "CASE p_size % 7 WHEN 0 THEN '분석' WHEN 1 THEN '찾아내기' WHEN 2 THEN '다루기' WHEN 3 THEN '검토' WHEN 4 THEN '점검' WHEN 5 THEN '읽기' ELSE '관리' END"
PHRASED = f"p_name || CASE WHEN p_size % 2 = 0 THEN ' 문건' ELSE ' 자료' END || CASE WHEN p_size % 7 < 6 THEN ' ' WHEN p_size % 2 = 0 THEN '을 ' ELSE '를 ' END || {NOUNS}"


@query("x16_noun_phrases", f"""
SELECT p_partkey, {PHRASED} AS phrase, CASE p_size % 7 WHEN 0 THEN '하는' WHEN 1 THEN 'ㄹ 수 있는' WHEN 2 THEN '는' WHEN 3 THEN '하ㄹ 수 있는' WHEN 4 THEN '하고자 하는' WHEN 5 THEN '을 수 있는' END AS ending FROM part""")
def x16_nouns(spark, d):
    return table(spark, d, "part").select("p_partkey", H.nominaliser()(_clause(F.col("p_name"))).alias("r")).select("p_partkey", F.col("r.text").alias("phrase"), "r.ending")


@query("x16_task_objects", f"""
WITH p AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '지식' WHEN 1 THEN '기술' ELSE '태도' END AS kind, p_partkey % 11 AS r, p_size % 7 AS v, p_brand, p_type, {PHRASED} AS f FROM part)
SELECT p_partkey, CASE WHEN r < 7 THEN CASE WHEN kind = '지식' AND v IN (0, 4) THEN f || '·판단 기준' WHEN kind = '기술' AND v = 0 THEN regexp_replace(f, ' 분석$', ' 검토 절차') WHEN kind = '기술' AND v = 4 THEN regexp_replace(f, ' 점검$', ' 확인 절차')
    ELSE f || CASE kind WHEN '지식' THEN ' 확인·판단 기준' WHEN '기술' THEN ' 수행·검증 절차' ELSE ' 행동 기준' END END
  WHEN r = 7 THEN p_brand || CASE kind WHEN '지식' THEN ' 관련 정보 확인·판단 기준' ELSE ' 수행·검증 절차' END
  WHEN r = 8 THEN f || CASE kind WHEN '지식' THEN ' 확인·판단 기준' WHEN '기술' THEN ' 수행·검증 절차' ELSE ' 행동 기준' END
  WHEN r = 9 THEN p_type || CASE kind WHEN '태도' THEN ' 행동 기준' ELSE ' 업무 기준' END ELSE '업무 판단과 수행 기준' END AS surface,
 CASE WHEN r < 7 THEN 'factor_repair' WHEN r = 7 THEN 'element_name' WHEN r = 8 THEN 'competency_definition' WHEN r = 9 THEN 'competency_name' ELSE 'safe_fallback' END AS tag FROM p""")
def x16_objects(spark, d):
    """Clauses as factors; of parts by their key, some have an element, a definition or a competency only, or nothing."""
    rest = F.col("p_partkey") % 11
    kind = F.element_at(F.array(F.lit("지식"), F.lit("기술"), F.lit("태도")), (F.col("p_partkey") % 3 + 1).cast("int"))
    factor = F.when(rest < 7, F.concat(_clause(F.col("p_name")), F.lit(" ("), kind, F.lit(")")))
    found = N.task_objects(table(spark, d, "part"), factor, kind, F.when(rest == 7, F.col("p_brand")), F.when(rest == 8, _clause(F.col("p_name"))), F.when(rest == 9, F.col("p_type")), PHRASES)
    return found.select("p_partkey", "surface", "tag")


@query("x9_prefix_anchors", r"""
WITH t AS (SELECT p_partkey, list_distinct(list_filter(string_split(lower(p_name), ' '), lambda x: length(x) >= 2)) AS a, list_distinct(list_filter(string_split(lower(p_type), ' '), lambda x: length(x) >= 2)) AS b,
  regexp_replace(lower(p_name), '[^0-9a-z]', '', 'g') AS ak, regexp_replace(lower(p_type), '[^0-9a-z]', '', 'g') AS bk FROM part),
h AS (SELECT *, list_filter(a, lambda x: len(list_filter(b, lambda y: starts_with(x, y) OR starts_with(y, x))) > 0) AS hit FROM t)
SELECT p_partkey, (length(ak) >= 4 AND contains(bk, ak)) OR len(hit) >= 2 OR (len(hit) = 1 AND length(hit[1]) >= 3) AS matches FROM h""")
def x9_anchors(spark, d):
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), " "), lambda x: F.length(x) >= 2))
    return table(spark, d, "part").select("p_partkey", X.lexically_matches(words(F.col("p_name")), words(F.col("p_type")), X.surface_key(F.col("p_name")), X.surface_key(F.col("p_type"))).alias("matches"))


@query("x16_source_tag", """
SELECT p_partkey, CASE WHEN length(p_name) BETWEEN 2 AND 14 THEN p_name WHEN length(p_brand) BETWEEN 2 AND 8 THEN p_brand ELSE 'task' END AS surface,
  CASE WHEN length(p_name) BETWEEN 2 AND 14 THEN 'factor' WHEN length(p_brand) BETWEEN 2 AND 8 THEN 'element' ELSE 'fallback' END AS tag FROM part""")
def x16_tag(spark, d):
    useful = lambda c: F.length(c).between(2, 14)
    short = lambda c: F.when(F.length(c) <= 8, c)
    p = table(spark, d, "part")
    return p.select("p_partkey", X.first_useful([("factor", F.col("p_name")), ("element", short(F.col("p_brand")))], useful, ("fallback", F.lit("task"))).alias("r")).select("p_partkey", "r.*")


@query("x17_surface_issues", r"""
SELECT p_partkey, concat_ws(';', CASE WHEN length(p_name) > 12 THEN 'too_long' END, CASE WHEN regexp_matches(p_name, '^[0-9]') THEN 'leading_digit' END) AS issues FROM part""")
def x17(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(Q.surface_issues(F.col("p_name"), 12), ";").alias("issues"))


@query("x18_particles", """
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name || ' 문건을 보고 ' || p_name || ' 문건이 있다' ELSE p_name || ' 보고서를 보고 ' || p_name || ' 보고서가 있다' END AS text FROM part""")
def x18(spark, d):
    """Part names in a sentence, each replaced by the name of a paper that ends in a consonant or in a vowel."""
    name = F.col("p_name")
    said = F.concat(name, F.lit("를 보고 "), name, F.lit("가 있다"))
    return table(spark, d, "part").select("p_partkey", U.replace_with_particle(said, name, F.concat(name, F.when(F.col("p_size") % 2 == 0, " 문건").otherwise(" 보고서"))).alias("text"))


@query("x19_alias_dimension", """
WITH a AS (SELECT n_nationkey, unnest([lower(n_name), lower(substr(n_name, 1, 6)), lower(replace(n_name, '_', ' '))]) AS alias, unnest([0, 1, 1]) AS tier FROM nation),
r AS (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY tier, n_nationkey) AS rn FROM a) SELECT alias, n_nationkey FROM r WHERE rn = 1""")
def x19(spark, d):
    from quillmill.operators.rows import first_wins

    n = F.lower("n_name")
    rows = table(spark, d, "nation").select("n_nationkey", F.explode(F.array(F.struct(n.alias("alias"), F.lit(0).alias("tier")), F.struct(F.substring(n, 1, 6).alias("alias"), F.lit(1).alias("tier")), F.struct(F.replace(n, F.lit("_"), F.lit(" ")).alias("alias"), F.lit(1).alias("tier")))).alias("x")).select("n_nationkey", "x.*")
    return first_wins(rows, [F.col("alias")], [F.col("tier"), F.col("n_nationkey")]).select("alias", "n_nationkey")


@query("x20_composite_labels", r"""
WITH p AS (SELECT p_partkey, list_distinct(list_filter(list_transform(regexp_split_to_array('1) ' || p_name || ' / ' || p_type || '; ' || p_name, '\s*[,;/|\n]\s*'), lambda x: trim(regexp_replace(x, '^\s*(\(?[0-9]{1,2}[).]|[-*])\s*', ''))), lambda x: x <> '')) AS l FROM part)
SELECT p_partkey, array_to_string(list_sort(l), '+') AS labels FROM p""")
def x20(spark, d):
    cell = F.concat(F.lit("1) "), "p_name", F.lit(" / "), "p_type", F.lit("; "), "p_name")
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(X.composite_labels(cell)), "+").alias("labels"))


@query("x21_clean_markdown", r"""
WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(?i)<br\s*/?>', chr(10), 'g'), '<[^>]+>', ' ', 'g') AS t FROM a)
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(t, '[*_`~]+', '', 'g'), '[ \t\r\f\x0B]+', ' ', 'g'), '\n{2,}', chr(10), 'g'), ' |' || chr(10) || chr(13) || chr(9) || ':：•-')) AS clean FROM b""")
def x21(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.clean_markdown(F.col("text"))).alias("clean"))


@query("x22_json_slice")
def x22(spark, d):
    return table(spark, d, "events").select("event_id", U.json_slice(F.concat(F.lit("```json\nsaid: "), "props", F.lit(" end\n```"))).alias("json"))


@query("x23_hashes", "SELECT doc_id, sha256(text) AS s256, left(sha1(text), 8) AS s1, md5(text) AS m FROM documents")
def x23(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("s256"), F.substring(F.sha1("text"), 1, 8).alias("s1"), F.md5("text").alias("m"))


@query("x24_weighted_query", """
SELECT p_partkey, concat_ws(' ', rtrim(repeat('name: ' || substr(p_name, 1, 10) || ' ', 3)), rtrim(repeat('type: ' || substr(p_type, 1, 5) || ' ', 1))) AS q FROM part""")
def x24(spark, d):
    return table(spark, d, "part").select("p_partkey", X.weighted_query([("name: ", F.col("p_name"), 10, 3), ("type: ", F.col("p_type"), 5, 1), ("off: ", F.col("p_brand"), 5, 0)]).alias("q"))


@query("x25_context_text", """
SELECT c_custkey, '[name]' || chr(10) || substr(c_name, 1, 12) || CASE WHEN c_acctbal > 0 THEN chr(10) || chr(10) || '[segment]' || chr(10) || c_mktsegment ELSE '' END AS context FROM customer""")
def x25(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.context_text([("name", F.col("c_name"), 12), ("segment", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).otherwise(" "), 99)]).alias("context"))


@query("s10_page_links", """
WITH l AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS l FROM pages), e AS (SELECT page_id, unnest(l) AS href, (generate_subscripts(l, 1) - 1)::INTEGER AS pos FROM l)
SELECT page_id, href, min(pos) AS pos FROM e GROUP BY ALL""")
def s10(spark, d):
    return T.links(table(spark, d, "pages"), "page_id", F.col("html"))


@query("s11_scoped_links", """
WITH l AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav>.*?</nav>', 0), 'href="([^"]+)"', 1) AS l FROM pages), e AS (SELECT page_id, unnest(l) AS href, (generate_subscripts(l, 1) - 1)::INTEGER AS pos FROM l)
SELECT page_id, href, min(pos) AS pos FROM e GROUP BY ALL""")
def s11(spark, d):
    return T.links(table(spark, d, "pages"), "page_id", F.col("html"), within="(?s)<nav>.*?</nav>")


@query("s12_html_text", r"""
WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g') AS t FROM pages), b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)<br\s*/?>|</(p|div|li|tr|h[1-6]|table)>', chr(10), 'g'), '<[^>]+>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS t FROM b)
SELECT page_id, trim(regexp_replace(regexp_replace(t, '[ \t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ') AS txt FROM c""")
def s12(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_text(F.col("html")).alias("txt"))


@query("s13_html_title", r"""
SELECT page_id, coalesce(nullif(trim(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<h1[^>]*>([^<]*)</h1>', 1), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&')), ''),
  nullif(trim(regexp_extract(html, '(?is)<title[^>]*>([^<]*)</title>', 1)), '')) AS title FROM pages""")
def s13(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_title(F.col("html")).alias("title"))


@query("t1d_sections", rf"""WITH {LINES},
h AS (SELECT *, CASE WHEN length(content) <= 40 AND NOT contains(content, '|') THEN content END AS hd FROM lns),
f AS (SELECT *, last_value(hd IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line) AS section FROM h),
b AS (SELECT *, lower(regexp_replace(content, '[\s\x{{00A0}}\x{{3000}}:：·•\-_/()\[\]{{}}]+', '', 'g')) AS k FROM f WHERE hd IS NULL AND section IS NOT NULL)
SELECT doc_id, section, min(line) AS line, arg_min(content, line) AS content FROM b GROUP BY doc_id, section, k""")
def t1d(spark, d):
    c = F.col("content")
    return T.sections(table(spark, d, "documents"), "doc_id", "text", F.when((F.length(c) <= 40) & ~c.contains("|"), c))


@query("t2d_table_cells")
def t2d(spark, d):
    md = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("| "), "n_name", F.lit(" | "), F.col("n_nationkey").cast("string"), F.lit(" |")))), "\n").alias("rows"))
    return T.table_cells(md.select("n_regionkey", F.concat(F.lit("| name | key |\n|---|---|\n"), "rows").alias("md")), "n_regionkey", "md")


@query("t2d_table_labels", """
SELECT DISTINCT p_brand, p_name AS value FROM part WHERE length(p_name) BETWEEN 2 AND 80""")
def t2d_labels(spark, d):
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    p = table(spark, d, "part").select("p_brand", F.struct("p_partkey", "p_type", "p_name").alias("r")).groupBy("p_brand").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    # the brand's cell spans all rows, so every row but the first is one cell short
    row = lambda x, i: F.concat(F.lit("<tr>"), F.when(i == 0, cell(F.col("p_brand"))).otherwise(""), cell(x["p_type"]), cell(x["p_name"]), F.lit("</tr>"))
    html = F.concat(F.lit("<table><tr><th>Brand</th><th>Type</th><th>Detail</th></tr>"), F.array_join(F.transform("rs", row), ""), F.lit("</table>"))
    return B.table_values(p.select("p_brand", html.alias("md")), "p_brand", "md", "^Detail$", "^(Brand|Type)$").select("p_brand", "value")


@query("t3d_notice_windows", rf"""WITH {LINES},
m AS (SELECT *, contains(content, 'the') AS a, length(content) < 30 AS h, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS no FROM lns),
w AS (SELECT *, list(content) OVER x AS cs, list(h) OVER x AS hs FROM m WINDOW x AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING)),
c AS (SELECT doc_id, line, CASE WHEN list_position(hs[3:9], true) > 0 THEN cs[1:list_position(hs[3:9], true) + 1] ELSE cs END AS cs FROM w WHERE a),
s AS (SELECT doc_id, line, substr(array_to_string(cs, chr(10)), 1, 2200) AS win FROM c), k AS (SELECT *, lower(regexp_replace(win, '[\s\x{{00A0}}\x{{3000}}:：·•\-_/()\[\]{{}}]+', '', 'g')) AS k FROM s),
g AS (SELECT doc_id, min(line) AS line, arg_min(win, line) AS win FROM k GROUP BY doc_id, k), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS rn FROM g)
SELECT doc_id, line, win AS "window" FROM r WHERE rn <= 4""")
def t3d(spark, d):
    c = F.col("content")
    return T.notice_windows(table(spark, d, "documents"), "doc_id", "text", c.contains("the"), F.length(c) < 30).select("doc_id", "line", "window")


SCORES = [("the", "english", True), ("with", "english", False), ("und", "german", True), ("nicht", "german", False), ("que", "romance", True)]


@query("t5d_dictionary_scores", rf"""WITH {LINES},
dict AS (SELECT unnest(['the', 'with', 'und', 'nicht', 'que']) AS alias, unnest(['english', 'english', 'german', 'german', 'romance']) AS label, unnest([true, false, true, false, true]) AS official),
low AS (SELECT *, regexp_replace(lower(content), '[ \t\r\n\f\x0B]+', '', 'g') AS c FROM lns),
h AS (SELECT doc_id, label, official, (length(c) - length(replace(c, alias, ''))) / length(alias) AS times, CASE WHEN contains(content, ':') THEN 0.9 WHEN contains(content, '|') THEN 0.5 ELSE 0.0 END AS bonus FROM low JOIN dict ON contains(c, alias)),
b AS (SELECT doc_id, label, sum(CASE WHEN alias = lower(string_split(text, ' ')[1]) THEN 0.8 ELSE 0 END + CASE WHEN contains(regexp_replace(lower(left(text, 40)), '[ \t\r\n\f\x0B]+', '', 'g'), alias) THEN 0.6 ELSE 0 END) AS gain FROM documents, dict GROUP BY ALL),
s AS (SELECT doc_id, label, round(sum(floor(times) * (CASE WHEN official THEN 1.2 ELSE 0.9 END + bonus))::DOUBLE + any_value(gain)::DOUBLE, 4) AS score FROM h JOIN b USING (doc_id, label) GROUP BY ALL)
SELECT doc_id, label, score, round(least(1.0, greatest(0.62, score / 4.5)), 4) AS confidence FROM s""")
def t5d(spark, d):
    dictionary = spark.createDataFrame(SCORES, "alias string, label string, official boolean")
    c = F.col("content")
    opening = F.array(F.get(F.split("text", " "), F.lit(0)))
    return T.dictionary_scores(table(spark, d, "documents"), "doc_id", "text", dictionary, "alias", "label", "official", c.contains(":"), c.contains("|"), hints=opening, filename=F.left("text", F.lit(40)))


@query("t9d_absence_reason", rf"""WITH {LINES},
c AS (SELECT doc_id, line, content, contains(content, '|') AS pipe, CASE WHEN contains(content, '|') THEN list_transform(string_split(regexp_replace(content, '^\||\|$', '', 'g'), '|'), lambda x: trim(x, ' '))
  WHEN regexp_matches(content, '[:：]') THEN [trim(regexp_extract(content, '^([^:：]*?)\s*[:：]', 1), ' '), trim(regexp_extract(content, '^[^:：]*[:：]\s*(.*)$', 1, 's'), ' ')] ELSE [content] END AS cells FROM lns WHERE NOT (contains(content, '|') AND regexp_matches(content, '^[|:\- ]+$'))),
m AS (SELECT *, nullif(list_position(list_transform(cells, lambda x: regexp_matches(x, '^[A-Z][a-z]+$')), true), 0) AS place, regexp_matches(content, '(?i)none|keine') AS declared FROM c),
k AS (SELECT *, last_value(CASE WHEN pipe THEN place END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line) AS col FROM m),
v AS (SELECT *, CASE WHEN declared THEN [] WHEN place IS NOT NULL THEN cells[place + 1:] WHEN pipe AND col IS NOT NULL THEN [cells[least(col, len(cells))]] ELSE [] END AS vals FROM k),
e AS (SELECT doc_id, line, 0 AS pos, 'saw_table' AS state FROM v WHERE pipe AND regexp_matches(content, '[0-9]') UNION ALL SELECT doc_id, line, (pipe AND regexp_matches(content, '[0-9]'))::INT, 'saw_header' FROM v WHERE place IS NOT NULL
  UNION ALL SELECT doc_id, line, (pipe AND regexp_matches(content, '[0-9]'))::INT + (place IS NOT NULL)::INT, 'declared_no_mapping' FROM v WHERE declared
  UNION ALL SELECT doc_id, line, i + 2, CASE WHEN regexp_matches(x, '^[\s\-–—_./·|]*$') THEN 'blank_cell' WHEN length(x) BETWEEN 2 AND 40 AND regexp_matches(x, '[A-Za-z]') THEN 'value' ELSE 'unsound_value' END FROM (SELECT doc_id, line, unnest(vals) AS x, generate_subscripts(vals, 1) AS i FROM v)),
f AS (SELECT doc_id, state, min(line * 1000000 + pos) AS spot FROM e GROUP BY ALL), s AS (SELECT doc_id, list(state ORDER BY spot, state) AS states FROM f GROUP BY 1)
SELECT doc_id, array_to_string(coalesce(states, []), ',') AS states, CASE WHEN n_chars % 50 = 0 OR list_contains(states, 'value') THEN 'has_label' WHEN list_contains(states, 'declared_no_mapping') THEN 'declared_no_mapping' WHEN list_contains(states, 'unsound_value') THEN 'unsound_value'
 WHEN list_contains(states, 'blank_cell') THEN 'blank_cell' WHEN list_contains(states, 'saw_header') THEN 'header_without_value' WHEN list_contains(states, 'saw_table') THEN 'table_without_header' WHEN regexp_replace(coalesce(text, ''), '[ \t\r\n\f\x0B]+', '', 'g') = '' THEN 'empty_document' ELSE 'no_sign' END AS reason
FROM documents LEFT JOIN s USING (doc_id)""")
def t9d(spark, d):
    v = F.col("value")
    docs = table(spark, d, "documents")
    found = T.absence_states(docs, "doc_id", "text", "^[A-Z][a-z]+$", "[0-9]", "(?i)none|keine", F.length(v).between(2, 40) & v.rlike("[A-Za-z]"), F.col("n_chars") % 50 == 0)
    return found.select("doc_id", F.array_join("states", ",").alias("states"), "reason")


@query("t13d_contextual_labels", """
SELECT doc_id, 'mixed' AS label FROM documents WHERE (contains(lower(text), 'the') OR contains(lower(text), 'of')) AND (contains(lower(text), 'und') OR contains(lower(text), 'que'))
UNION ALL SELECT doc_id, 'tabular' FROM documents WHERE contains(text, '|')""")
def t13d(spark, d):
    return T.contextual_labels(table(spark, d, "documents"), "doc_id", F.col("text"), {"mixed": [("the", "of"), ("und", "que")], "tabular": [("|",)]})


@query("q1_quality_report", """
WITH s AS (SELECT doc_id, CASE WHEN n_chars >= 300 THEN 1 ELSE 0 END AS p1, CASE WHEN lang = 'en' THEN CASE WHEN contains(text, 'the') THEN 1 ELSE 0 END END AS p2, CASE WHEN contains(text, '|') THEN 0 ELSE 1 END AS p3 FROM documents)
SELECT doc_id, round((p1 + coalesce(p2, 0) + p3) / (2 + CASE WHEN p2 IS NULL THEN 0 ELSE 1 END), 2) AS score, p1 = 1 AND coalesce(p2, 1) = 1 AND p3 = 1 AS ready FROM s""")
def q1(spark, d):
    t = F.col("text")
    checks = {"long": (F.col("n_chars") >= 300, F.lit(True)), "the": (t.contains("the"), F.col("lang") == "en"), "no_table": (~t.contains("|"), F.lit(True))}
    return Q.quality_report(table(spark, d, "documents"), checks).select("doc_id", "score", "ready")


@query("q2_weighted_realism", """
SELECT doc_id, greatest(0, 100 - CASE WHEN n_chars >= 300 THEN 0 ELSE 40 END - CASE WHEN contains(text, 'the') THEN 0 ELSE 35 END - CASE WHEN contains(text, '.') THEN 0 ELSE 50 END)::INTEGER AS realism FROM documents""")
def q2(spark, d):
    t = F.col("text")
    return Q.weighted_realism(table(spark, d, "documents"), {"long": (F.col("n_chars") >= 300, 40), "the": (t.contains("the"), 35), "stop": (t.contains("."), 50)}).select("doc_id", F.col("realism").cast("int").alias("realism"))


WORDS_OF = K.Vocabulary(
    methods={"user": (("th",), ("the", "an")), "assistant": (("er",), ("on", "in"))},
    patterns={"scaffold": "^To", "adaptive": "th", "quantified": "[0-9]", "incident": "tion", "actor": "wh", "dilemma": "but|or", "presumed": "^Was", "prescribed": "^Is", "injection": "(?i)ignore", "vague": "^$", "assessable": "e", "generic": "zz"},
    task_methods=("assistant",), measures=(("th", "er"),), model_sources=("model",), rule_sources=("rule",),
)


def _questions(spark, d):
    """Conversations as questions: the first turn asks, later turns of the same role follow it up, the others are what is evaluated."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("ts"))
    first = F.get("ts", F.lit(0))
    side = lambda same: F.transform(F.filter(F.slice("ts", F.lit(2), F.size("ts")), lambda x: (x["role"] == first["role"]) == F.lit(same)), lambda x: x["text"])
    shaped = c.select(F.floor(F.col("conv_id") / 5).cast("string").alias("set_id"), F.col("conv_id").alias("ord"), first["role"].alias("method"), first["text"].alias("question"), side(True).alias("follow_ups"), side(False).alias("points"))
    empty = {
        "code": "'c'", "competency": "substring(question, 1, 3)", "detail": "'d'", "focus": "'the'", "evidence": "array(struct('c' as code, question as text))", "evidence_id": "'e'", "evidence_required": "true",
        "source": "if(ord % 2 = 0, 'model', 'rule')", "preserved": "true", "labels": "array(substring(question, 1, 20))", "repeated": "false", "grounded": "true",
        "conditions": "cast(null as struct<instruction:string,standardization:string,outputs:array<string>,materials:array<string>,time_plan:array<struct<phase:string,minutes:int>>,facts:array<string>,rows:array<struct<source:string,field:string,value:string>>,authority:string>)",
        "guide": "cast(null as struct<levels:array<struct<score:int,label:string,anchor:string>>,instruction:string>)",
    }
    return shaped.selectExpr("*", *[f"{e} as {n}" for n, e in empty.items()])


@query("q1_question_report")
def q1_full(spark, d):
    near = lambda a, b: F.levenshtein(a, b) < F.greatest(F.length(a), F.length(b)) * 0.18
    return K.question_report(_questions(spark, d), WORDS_OF, near).select("set_id", "ord", "score", "ready", F.array_join("issues", ",").alias("issues"))


@query("q1_set_summary")
def q1_sets(spark, d):
    near = lambda a, b: F.levenshtein(a, b) < F.greatest(F.length(a), F.length(b)) * 0.18
    questions = _questions(spark, d)
    return K.set_summary(K.question_report(questions, WORDS_OF, near), questions.select("set_id").distinct().withColumn("expected", F.lit(5)))


@query("q2_realism_checks")
def q2_full(spark, d):
    return Q.weighted_realism(_questions(spark, d), K.realism_checks(WORDS_OF)).select("ord", "realism", F.array_join("realism_issues", ",").alias("issues"))


@query("q5_material_grounding")
def q5_full(spark, d):
    docs = table(spark, d, "documents")
    held = docs.filter("text is not null").select("doc_id", F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("ref"), F.array(F.when(F.col("doc_id") % 2 == 0, "amount").otherwise("ratio")).alias("provides"), F.col("text").alias("body"), (F.col("doc_id") % 3 > 0).alias("trusted"))
    demands = {"amount": (r"[0-9]{2,}", ("amount",)), "share": (r"\|", ("amount", "ratio"))}
    return Q.material_grounding(docs, "doc_id", F.col("text"), demands, held, "doc_id", "ref", "provides", F.col("body"), F.col("trusted")).select("doc_id", "clause_no", "kind", "allowed", "reason")


@query("q3_demand_metrics", r"""
WITH m AS (SELECT conv_id, turn, contains(lower(text), 'th')::INT + contains(lower(text), 'er')::INT + contains(lower(text), 'on')::INT AS n, len(regexp_extract_all(text, '\?')) AS q FROM conversations) SELECT conv_id, turn, n::INTEGER AS n, n > 2 OR q > 2 AS overloaded FROM m""")
def q3(spark, d):
    return Q.demand_metrics(table(spark, d, "conversations"), F.col("text"), ("th", "er", "on"), 2).select("conv_id", "turn", F.size("actions").alias("n"), "overloaded")


SCENARIO = S.Scenario(
    quantified="[0-9]", incident="err|fall", artifact="(?:ing|heit|eau|tion)[.,]", actor="whsh", dilemma="; ", conflict="[|]",
    stances={"rule or case": ("ver", "ß"), "now or sure": ("ment", "ç")}, relations={"now or sure": ("ment", "ç"), "more with less": ("ss", "[(]")},
)


@query("q3_scenario_signals", """
WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
m AS (SELECT doc_id, len(list_distinct(regexp_extract_all(t, '(?:ing|heit|eau|tion)[.,]'))) AS n, regexp_matches(t, '[0-9]') AS q, regexp_matches(t, 'err|fall') AS i, contains(t, '|') AS c, contains(t, 'whsh') AS a, contains(t, '; ') AS d,
  contains(t, 'ver') AND contains(t, 'ß') AS s1, contains(t, 'ment') AND contains(t, 'ç') AS s2, contains(t, 'ss') AND contains(t, '(') AS r2 FROM t)
SELECT doc_id, q AS quantified_fact, i OR c AS incident, a OR s1 OR s2 AS actor_action, n::INTEGER AS artifact_count, d OR s1 OR s2 OR c OR r2 AS dilemma, (q AND (i OR c OR n > 0)) OR a OR s1 OR s2 OR (n >= 2 AND (i OR c)) OR r2 AS concrete_fact,
 concat_ws(',', CASE WHEN s1 THEN 'rule or case' END, CASE WHEN s2 THEN 'now or sure' END) AS stances, concat_ws(',', CASE WHEN s2 THEN 'now or sure' END, CASE WHEN r2 THEN 'more with less' END) AS relations FROM m""")
def q3_signals(spark, d):
    out = S.scenario_signals(table(spark, d, "documents"), F.col("text"), SCENARIO)
    return out.select("doc_id", "quantified_fact", "incident", "actor_action", "artifact_count", "dilemma", "concrete_fact", F.array_join("stances", ",").alias("stances"), F.array_join("relations", ",").alias("relations"))


DEMANDS = S.Demands(sentence="who|wh|qu|sch", asks="wh|qu|sch", action="ing|ment|ung", nominal="(?:th|en|ie)r? ?e", families={"look": "th|ei", "decide": "er", "tell": "on|ou", "write": "an"}, outputs={"rule": "re", "note": "le", "plan": "ing|ie", "list": ","})


@query("q3_demand_overload", r"""
WITH t AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS t FROM conversations),
s AS (SELECT *, trim(array_to_string(list_filter(regexp_extract_all(t, '[^.?!\n]+[.?!\n]?'), lambda x: regexp_matches(x, 'who|wh|qu|sch')), ' '), ' ') AS d FROM t),
a AS (SELECT *, regexp_extract_all(d, 'wh|qu|sch') AS cues, string_split_regex(d, 'wh|qu|sch') AS parts FROM s),
b AS (SELECT *, list_transform(range(1, len(cues) + 1), lambda i: [cues[i], substr(d, coalesce(list_sum(list_transform(parts[1:i], lambda x: length(x))), 0)::BIGINT + list_sum(list_transform(cues[1:i], lambda x: length(x)))::BIGINT + 1, 50)]) AS asked FROM a),
n AS (SELECT conv_id, turn, t, d, len(list_distinct(list_transform(asked, lambda x: x[1] || ':' || CASE WHEN regexp_matches(x[2], 'ing|ment|ung') THEN regexp_extract(x[2], 'ing|ment|ung') ELSE regexp_extract(x[2], '[0-9\p{L}]{2,20}') END))) AS slots,
  len(list_distinct(list_transform(regexp_extract_all(d, '(?:th|en|ie)r? ?e'), lambda x: replace(x, ' ', '')))) AS nouns, regexp_matches(d, 'th|ei')::INT + contains(d, 'er')::INT + regexp_matches(d, 'on|ou')::INT + contains(d, 'an')::INT AS f,
  contains(d, 're')::INT + contains(d, 'le')::INT + regexp_matches(d, 'ing|ie')::INT + contains(d, ',')::INT AS o FROM b)
SELECT conv_id, turn, greatest(slots, nouns)::INTEGER AS demand_slots, f::INTEGER AS demand_families, o::INTEGER AS demand_outputs, length(d)::INTEGER AS demand_length,
 (greatest(slots, nouns) >= 5 AND f >= 4) OR (length(t) >= 320 AND length(d) >= 150 AND f >= 2 AND o >= 4) AS overload_warning FROM n""")
def q3_overload(spark, d):
    out = S.demand_overload(table(spark, d, "conversations"), F.col("text"), DEMANDS)
    return out.select("conv_id", "turn", "demand_slots", "demand_families", "demand_outputs", "demand_length", "overload_warning")


MEASURES = S.Measurement(
    methods={"user": (("th", "qu"), ("en",)), "assistant": (("sch", "tion"), ("ou", "er"))}, kinds={"지식": (("the", "die", "la"), ("on", "in")), "기술": (("ver", "ment", "ing"),)},
    relations={"user": S.Relation((("sch", "wh"),), (("ung", "ing"),), 12)}, negation="[.]", asks="qu|wh|die", shallow="^in ", report="en|ti", idle=("that",),
)


@query("q4_measurement", r"""
WITH i AS (SELECT conv_id, turn, role AS m, lower(trim(coalesce(text, ''))) AS q, lower(regexp_replace(coalesce(text, ''), '\s+', '', 'g')) AS b, lower(regexp_extract(coalesce(text, ''), '[A-Za-z]{4,}')) AS f FROM conversations),
h AS (SELECT *, CASE WHEN f <> '' THEN replace(b, f, '') ELSE b END AS rest, CASE m WHEN 'user' THEN [regexp_matches(b, 'th|qu'), contains(b, 'en')] WHEN 'assistant' THEN [regexp_matches(b, 'sch|tion'), regexp_matches(b, 'ou|er')] ELSE [] END AS g,
  m = 'user' AND regexp_matches(b, '(?:sch|wh).{0,12}(?:ung|ing)(?:[^.]|$)|(?:ung|ing)(?:(?:sch|wh)|[^.].{0,11}(?:sch|wh))') AS related FROM i),
c AS (SELECT conv_id, turn, array_to_string(list_filter([
  CASE WHEN q = '' THEN 'has_question' END, CASE WHEN m NOT IN ('user', 'assistant') THEN 'has_supported_method' END, CASE WHEN f = '' THEN 'focus_visible' END,
  CASE WHEN NOT CASE turn % 3 WHEN 0 THEN regexp_matches(rest, 'the|die|la') AND regexp_matches(rest, 'on|in') WHEN 1 THEN regexp_matches(rest, 'ver|ment|ing') ELSE true END THEN 'ksa_type_operationalized' END,
  CASE WHEN NOT (related OR (len(g) > 0 AND NOT list_contains(g, false))) THEN 'observable_task' END, CASE WHEN NOT regexp_matches(q, 'qu|wh|die') THEN 'elicits_response' END, CASE WHEN length(b) < 40 THEN 'sufficient_task_detail' END,
  CASE WHEN starts_with(q, 'in ') OR (f <> '' AND len(list_filter(string_split(b, f)[2:], lambda x: starts_with(x, 'en') OR starts_with(x, 'ti'))) > 0) THEN 'not_ksa_restatement' END, CASE WHEN turn % 2 = 0 AND conv_id % 7 = 0 THEN 'evidence_linked' END], lambda x: x IS NOT NULL), ',') AS issues FROM h)
SELECT conv_id, turn, issues, issues = '' AS passed FROM c""")
def q4_measured(spark, d):
    """Turns as questions, by role as method, on their first long word as focus; every seventh conversation lacks the evidence it needs."""
    kind = F.when(F.col("turn") % 3 == 0, "지식").when(F.col("turn") % 3 == 1, "기술").otherwise("태도")
    focus, evidence = F.regexp_extract(X.text_or_empty(F.col("text")), "[A-Za-z]{4,}", 0), F.when(F.col("conv_id") % 7 > 0, F.col("conv_id").cast("string"))
    out = S.measurement(table(spark, d, "conversations"), F.col("text"), F.col("role"), focus, kind, evidence, F.col("turn") % 2 == 0, MEASURES)
    return out.select("conv_id", "turn", F.array_join("issues", ",").alias("issues"), "passed")


@query("q4_marker_groups", "SELECT doc_id, (contains(lower(text), 'the') OR contains(lower(text), 'der')) AND (contains(lower(text), 'in') OR contains(lower(text), 'en')) AS measured FROM documents")
def q4(spark, d):
    return table(spark, d, "documents").select("doc_id", Q.groups_hit(F.col("text"), [("the", "der"), ("in", "en")]).alias("measured"))


@query("q5_precision_grounding")
def q5(spark, d):
    docs = table(spark, d, "documents")
    return Q.precision_grounding(docs, "doc_id", F.col("text"), {"number": r"[0-9]{2,}", "table": r"\|"}, docs.filter("doc_id % 2 = 0"), "doc_id", F.col("text")).select("doc_id", "clause_no", "kind", "allowed")


@query("q6_alignment", r"""
WITH a AS (SELECT p_partkey, unnest(list_distinct(list_concat(string_split(p_name, ' '), [p_type]))) AS atom, regexp_extract_all(lower(p_name || ' ' || CASE WHEN p_size > 25 THEN p_type ELSE '' END), '[a-z0-9]{2,}') AS q FROM part),
h AS (SELECT p_partkey, len(list_intersect(regexp_extract_all(lower(atom), '[a-z0-9]{2,}'), q)) > 0 AS hit FROM a WHERE trim(atom) <> ''), f AS (SELECT p_partkey, count(*) AS atoms, count(*) FILTER (hit) AS elicited FROM h GROUP BY 1)
SELECT p_partkey, atoms, elicited, CASE WHEN elicited >= atoms THEN 'pass' WHEN elicited > 0 THEN 'review' ELSE 'fail' END AS alignment FROM f""")
def q6(spark, d):
    p = table(spark, d, "part").withColumn("points", F.array(F.replace("p_name", F.lit(" "), F.lit(",")), F.col("p_type")))
    return Q.alignment(p, "p_partkey", "points", F.concat_ws(" ", "p_name", F.when(F.col("p_size") > 25, F.col("p_type"))))


@query("q6_elicitation")
def q6_matrix(spark, d):
    """Conversations as items: the turns of the first speaker ask, the others' turns are what is scored."""
    kinds = E.Kinds({"cause": r"\bth", "number": "[0-9]", "place": r"\b(?:in|on)\b"}, traits="^(?:er|an)$", split=r"\s*[,;.]\s+", one=r"\bor\b", some=r"\bwh")
    return E.elicitation(_questions(spark, d).withColumn("prompts", F.concat(F.array("question"), "follow_ups")), "ord", "points", "prompts", kinds, count=None).withColumn("issues", F.array_join("issues", ","))


@query("q7_control", """
SELECT doc_id, concat_ws(';', CASE WHEN toxic = 1 THEN 'blind_hiring_safe' END, CASE WHEN quality = 0 THEN 'needs_review' END, CASE WHEN doc_id % 50 = 0 THEN 'coverage_blocker' END) AS codes,
 toxic = 1 OR quality = 0 OR doc_id % 50 = 0 AS review_required, toxic = 1 OR doc_id % 50 = 0 AS escalation_required FROM labels""")
def q7(spark, d):
    rules = [("blind_hiring_safe", F.col("toxic") == 1, True), ("needs_review", F.col("quality") == 0, False), ("coverage_blocker", F.col("doc_id") % 50 == 0, True)]
    return Q.control(table(spark, d, "labels"), rules).select("doc_id", F.array_join("trigger_codes", ";").alias("codes"), "review_required", "escalation_required")


def _audit(t, history):
    return (["long"] if len(t) > 20 else []) + (["seen"] if t in history else [])


def _repair(t, issues, attempt):
    return t[:20] if "long" in issues else f"{t[:17]} {attempt}"


@query("q8_repair_loop")
def q8(spark, d):
    p = table(spark, d, "part").withColumn("t", F.concat_ws(" ", "p_type", "p_name", "p_brand"))
    return Q.repair_loop(p, "p_brand", "t", "p_partkey", _audit, _repair)


@query("q9_evidence_locks", """
WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem), a AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 2 THEN -1 ELSE l_partkey END AS actual FROM e WHERE l_linenumber <> 3)
SELECT l_orderkey, l_linenumber, coalesce(actual = l_partkey, false) AS locked FROM e LEFT JOIN a USING (l_orderkey, l_linenumber)""")
def q9(spark, d):
    e = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    a = e.filter("l_linenumber <> 3").withColumn("l_partkey", F.when(F.col("l_linenumber") == 2, -1).otherwise(F.col("l_partkey")))
    return Q.evidence_locks(e, a, ["l_orderkey", "l_linenumber"], "l_partkey").select("l_orderkey", "l_linenumber", "locked")


@query("q10_shape_issues", r"""
SELECT conv_id, turn, concat_ws(';', CASE WHEN NOT regexp_matches(text, '[?？]\s*$') THEN 'no_question_mark' END, CASE WHEN length(text) < 20 THEN 'too_short' END, 'few_points') AS issues FROM conversations""")
def q10(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(Q.shape_issues(F.col("text"), F.array(F.lit("why?")), F.array(F.col("role"))), ";").alias("issues"))


@query("q11_register_run", """
WITH f AS (SELECT conv_id, role, min(turn) AS o FROM conversations GROUP BY ALL), c AS (SELECT conv_id, array_to_string(list(role ORDER BY o, role), ',') AS codes FROM f GROUP BY 1)
SELECT conv_id, count(*) AS question_count, array_to_string(list(sha256(text) ORDER BY turn), ',') AS hashes, any_value(codes) AS codes FROM conversations JOIN c USING (conv_id) GROUP BY 1""")
def q11(spark, d):
    out = Q.register_run(table(spark, d, "conversations"), "conv_id", "text", "role", "turn")
    return out.withColumn("hashes", F.array_join("hashes", ",")).withColumn("codes", F.array_join("codes", ","))


@query("q12_feedback_context", """
WITH e AS (SELECT lang, doc_id, substr(text, 1, 20) AS t, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) AS rn FROM labels JOIN documents USING (doc_id) WHERE toxic = 1 OR quality = 0)
SELECT lang, array_to_string(list('- ' || t ORDER BY rn), chr(10)) AS context FROM e WHERE rn <= 5 GROUP BY 1""")
def q12(spark, d):
    e = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").withColumn("verdict", F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 0, "needs_edit").otherwise("approve")).withColumn("t", F.substring("text", 1, 20))
    return Q.feedback_text(e, "lang", "verdict", "t", "doc_id")
