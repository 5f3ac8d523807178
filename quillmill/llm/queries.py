"""The registered queries of the training-data operators, with their SQL.

Each query is thin: it reads its whole table, calls its operator with
production parameters and derives the columns of its contract.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import alignment, cap_filters, decontaminate, exact_dedup, langid, line_dedup, mixing, ngram_join, pieces, sharding, suffix_tree, toxicity, whitening
from quillmill.llm._shared import held_out, small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document at a Jaccard similarity of 0.8 on five words."""
    return ngram_join.similar_documents(_table(spark, sf_dir, "documents"))


#: Exact: all pairs that share an n-gram, and classes by repeated minima.
OP1_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'),
         lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws FROM documents
), grams AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS gs FROM w
), sets AS (SELECT min(doc_id) AS rep, gs, count(*) AS copies FROM (SELECT doc_id, list_sort(gs) AS gs FROM grams) WHERE len(gs) > 0 GROUP BY gs),
flat AS (SELECT rep, hash(unnest(gs)) AS g FROM sets),
shared AS (SELECT a.rep AS a, b.rep AS b, count(*) AS inter FROM flat a JOIN flat b ON a.g = b.g AND a.rep < b.rep GROUP BY a.rep, b.rep),
pairs AS (SELECT a, b FROM shared JOIN sets sa ON sa.rep = a JOIN sets sb ON sb.rep = b WHERE inter >= 0.8 * (len(sa.gs) + len(sb.gs) - inter) - 1e-9),
sym AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(a, b) AS (SELECT a, b FROM sym UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a),
cls AS (SELECT a, least(a, min(b)) AS class_id FROM reach GROUP BY a),
deg AS (SELECT a, sum(copies)::BIGINT AS n FROM sym JOIN sets ON sets.rep = b GROUP BY a)
SELECT g.doc_id, coalesce(s.rep, g.doc_id) AS rep_id, coalesce(c.class_id, s.rep, g.doc_id) AS class_id,
       coalesce(s.copies - 1, 0) + coalesce(d.n, 0) AS n_links
FROM (SELECT doc_id, list_sort(gs) AS gs FROM grams) g LEFT JOIN sets s ON s.gs = g.gs LEFT JOIN cls c ON c.a = s.rep LEFT JOIN deg d ON d.a = s.rep
"""


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document by a mix of all sources that weigh 1, 2, 3 in turn."""
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def _long_hash(value: str, seed: str) -> str:
    """The 64-bit hash of a long as DuckDB SQL over unsigned 128-bit numbers (Spark's ``xxhash64`` of one more column)."""
    m = f"{(1 << 64) - 1}::UHUGEINT"
    # The primes of the hash.
    p1, p2, p3, p4, p5 = (f"{p}::UHUGEINT" for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def spin(x: str, r: int) -> str:
        return f"((({x} << {r}) & {m}) | ({x} >> {64 - r}))"

    word = f"(({value})::UHUGEINT * {p2} & {m})"
    mixed = f"xor(({seed} + {p5} + 8) & {m}, {spin(word, 31)} * {p1} & {m})"
    return f"(SELECT xor(c, c >> 32) FROM (SELECT xor(b, b >> 29) * {p3} & {m} AS c FROM (SELECT xor(a, a >> 33) * {p2} & {m} AS b FROM (SELECT ({spin('h', 27)} * {p1} + {p4}) & {m} AS a FROM (SELECT {mixed} AS h)))))"


def _mix_sql(block: int = 64, least_blocks: int = 256, shards: int = 8, cap: int = 3, seed: int = 11) -> str:
    """The mix in SQL, each seat a row. The hashes of the seeds 11 and 12, and the multipliers of block orders."""
    first, second = "890099540967675307::UHUGEINT", "72738756111436295::UHUGEINT"
    upto = "[" + ", ".join(f"count(*) FILTER (place <= total * {s} // {shards})" for s in range(shards + 1)) + "]"
    # words of a place in the first so many of the endless laps
    taken = [f"(words * (upto[{s + 1}] // n) + greatest(0, least(words, upto[{s + 1}] % n - lap)))" for s in range(shards + 1)]
    shard_words = ", ".join(f"coalesce(sum({b} - {a}) FILTER (n > 0 AND words > 0), 0)::BIGINT" for a, b in zip(taken, taken[1:]))
    start = "CASE WHEN s0 % blocks = 0 THEN 1 ELSE s0 % blocks END"
    return rf"""
WITH w AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
h AS (SELECT *, {_long_hash('doc_id', first)} AS h1, {_long_hash('doc_id', second)} AS h2 FROM w),
d AS (SELECT doc_id, source, size, {_long_hash('size', 'h1')} AS spread, {_long_hash('size', 'h2')} AS draw FROM h),
s AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
v AS (SELECT *, (1 + i % 3)::DOUBLE AS w, sum(n) OVER ()::BIGINT AS total FROM s),
c AS (SELECT *, row_number() OVER (ORDER BY n / w, i) AS k, (total - coalesce(sum({cap} * n) OVER (ORDER BY n / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / sum(w) OVER (ORDER BY n / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit FROM v),
f AS (SELECT min(k) FILTER (w * unit <= {cap} * n) AS k FROM c),
t AS (SELECT source, n, i, total, CASE WHEN c.k < coalesce(f.k, c.k + 1) THEN ({cap} * n)::DOUBLE ELSE w * (SELECT unit FROM c, f WHERE c.k = f.k) END AS target, greatest(1, least({block}, n // {least_blocks})) AS length FROM c, f),
b AS (SELECT *, (n + length - 1) // length AS blocks, ((i + 1) * 2654435761 + {seed} * 40503) % {1 << 20} AS s0, ((i + 1) * 40503 + {seed} * 2654435761) % {1 << 20} AS shift0 FROM t),
seats AS (SELECT i, total, row_number() OVER (ORDER BY target / (2 * j + 1) DESC, i) AS place FROM (SELECT *, unnest(range({cap} * n)) AS j FROM t WHERE target > 0)),
q AS (SELECT i, {upto} AS upto FROM seats GROUP BY i, total),
p AS (SELECT b.*, coalesce(upto, {[0] * (shards + 1)}) AS upto, CASE WHEN blocks > 0 THEN shift0 % blocks ELSE 0 END AS shift, CASE WHEN blocks > 0 THEN list_filter(range({start}, {start} + 1000), lambda x: gcd(x, blocks) = 1)[1] ELSE 1 END AS step FROM b LEFT JOIN q USING (i)),
l AS (SELECT *, CASE WHEN blocks > 0 THEN (step * (blocks - 1) + shift) % blocks ELSE 0 END AS short_rank, blocks * length - n AS lacks FROM p),
o AS (SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY CASE WHEN spread >= {1 << 63}::UHUGEINT THEN 0 ELSE 1 END, spread, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before FROM d),
e AS (SELECT o.doc_id, o.size, draw, n, target, before, blocks, length, upto, step, shift, short_rank, lacks, unnest(CASE WHEN size > 0 THEN range(before // length, (before + size - 1) // length + 1) ELSE [NULL] END) AS j FROM o JOIN l ON o.source IS NOT DISTINCT FROM l.source),
r AS (SELECT *, (step * j + shift) % blocks AS rank, greatest(before, j * length) AS low FROM e),
g AS (SELECT *, least(before + size, (j + 1) * length) - low AS words, rank * length - CASE WHEN rank > short_rank THEN lacks ELSE 0 END + low - j * length AS lap FROM r),
x AS (SELECT doc_id, size, n, target, draw, [{shard_words}] AS shard_words FROM g GROUP BY doc_id, size, n, target, draw),
y AS (SELECT *, list_sum(shard_words)::BIGINT AS taken FROM x)
SELECT doc_id, size, n AS source_size, target, taken, shard_words, CASE WHEN size > 0 THEN floor(taken / size + (draw & {(1 << 20) - 1}::UHUGEINT)::DOUBLE / {1 << 20}) ELSE 0 END::INTEGER AS copies FROM y
"""


OP2_SQL = _mix_sql()


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 contiguous shards of near equal bytes."""
    found = sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), shards=40)
    return found.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all whole documents under a suffix tree of the rows that are not held out."""
    return suffix_tree.score_documents(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document, learned from labelled rows that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = toxicity.learn(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, scorer)
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    return pieces.encode_documents(_table(spark, sf_dir, "documents"), keep=["doc_id"], digests_only=True)


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.9 or more."""
    return cap_filters.near_vectors(_table(spark, sf_dir, "embeddings"))


#: Exact: all pairs, and components by reachability.
OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND a.norm > 0 AND b.norm > 0 AND len(a.e) = len(b.e) AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
reach(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM reach r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS m FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(c.m, vec_id)) AS component_id, least(vec_id, coalesce(c.m, vec_id)) = vec_id AS kept
FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learned from rows that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    trees = langid.learn(docs, "doc_id", "text", "lang")
    return langid.identify(docs.select("doc_id", "text"), trees).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "bits")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the row that stays of each group of equal texts."""
    found = exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))
    digest = F.coalesce(F.col("part"), F.lower(F.hex("digest")))
    return found.select("doc_id", "keep_id", "group_size", "kept", digest.alias("text_sha256"))


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages without the lines that repeat on over 30 % of their host's pages."""
    return line_dedup.drop_site_lines(
        _table(spark, sf_dir, "pages"), "page_id", line_dedup.url_host(F.col("url")), line_dedup.page_lines(F.col("html")), max_ratio=0.3
    )


OP10_SQL = r"""
WITH stripped AS (
  SELECT page_id, coalesce(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
         regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
           '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g'),
           '(?i)</?(?:p|br|div|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|title|head|body|html)\b[^>]*>', chr(10), 'g'),
           '<[^>]*>', '', 'g') AS txt
  FROM pages
), cut AS (
  SELECT page_id, host, list_filter(list_transform(string_split(txt, chr(10)), lambda x: regexp_replace(x, '^[\t\x0B-\r ]+|[\t\x0B-\r ]+$', '', 'g')), lambda x: x <> '') AS ls
  FROM stripped
), n AS (SELECT host, count(*) AS total FROM cut WHERE host <> '' GROUP BY host),
c AS (SELECT host, line, count(*) AS c FROM (SELECT host, unnest(list_distinct(ls)) AS line FROM cut WHERE host <> '') GROUP BY host, line),
b AS (SELECT host, list(line) AS bad FROM c JOIN n USING (host) WHERE c > 1 AND c / total > 0.3 GROUP BY host)
SELECT page_id, host, len(ls)::BIGINT AS n_lines,
       (len(ls) - len(list_filter(ls, lambda x: NOT list_contains(coalesce(bad, []), x))))::BIGINT AS n_dropped,
       coalesce(array_to_string(list_filter(ls, lambda x: NOT list_contains(coalesce(bad, []), x)), chr(10)), '') AS text
FROM cut LEFT JOIN b USING (host)
"""


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeat ten consecutive words of a benchmark item."""
    found = decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP11_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS g
        FROM (SELECT item_id, ws, least(len(ws), 10) AS m, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT m FROM win),
grams AS (SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS g FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, sizes WHERE len(ws) >= m)),
hits AS (SELECT doc_id, i, m, item_id FROM grams JOIN win USING (m, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All finite embeddings along the first 32 components of their covariance, whitened.

    Grid values stop at 2**52 in absolute value.
    """
    most = F.lit(2.0**52)
    grid = F.transform("embedding", lambda c: F.floor(F.greatest(-most, F.least(most, c.cast("double") * 64))) + 1_000_000)
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", F.when(whitening.finite(F.col("embedding")), grid).alias("x"))
    return whitening.whitened_rows(vectors, "vec_id", "x", components=32)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers over every whole document."""
    return alignment.align_documents(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard": op1_ngram_jaccard,
        "op2_source_mixing": op2_source_mixing,
        "op3_sharding": op3_sharding,
        "op4_lm_scoring": op4_lm_scoring,
        "op5_toxicity": op5_toxicity,
        "op6_sentencepiece": op6_sentencepiece,
        "op7_embedding_dedup": op7_embedding_dedup,
        "op8_language_id": op8_language_id,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_line_dedup": op10_line_dedup,
        "op11_decontamination": op11_decontamination,
        "op12_whitening": op12_whitening,
        "op13_alignment": op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": OP1_SQL, "op2_source_mixing": OP2_SQL, "op7_embedding_dedup": OP7_SQL, "op9_exact_dedup": OP9_SQL, "op10_line_dedup": OP10_SQL, "op11_decontamination": OP11_SQL}
