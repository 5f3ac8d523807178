"""Sizes that Spark expects wrongly, or that one task would have to hold."""

import math
import random
import re
from collections import Counter
from types import SimpleNamespace

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillmill.functions import udfs
from quillmill.operators import labels, match, quality, ranking
from quillmill.plans import catalog
from quillmill.streaming import keyed


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pieces_of_texts_are_never_broadcast(spark):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["promo brand", "brand", "none", ""])], "i int, t string")
    terms = spark.createDataFrame([(t,) for t in ["brand", "promo", "rand", "x"] * 50], "term string").distinct()
    want = {(0, "brand"), (0, "promo"), (0, "rand"), (1, "brand"), (1, "rand")}
    few, many = match.holding(texts, "t", terms, "term"), match.holding(texts, "t", terms, "term", most_sent=3)
    assert {(r.i, r.term) for r in few.collect()} == {(r.i, r.term) for r in many.collect()} == want
    assert "BuildRight" in plan(few) and "BuildLeft" not in plan(few)
    assert "BroadcastHashJoin" not in plan(many)


def test_documents_and_grams_are_not_broadcast(spark):
    """Equal texts, blank ones and nulls; the plain formula is the model."""
    names = ["hot ring", "cold ring", "hot ring", "", None, "zz", "x", "ring"]
    docs = spark.createDataFrame(list(enumerate(names)), "d int, t string")
    query = spark.createDataFrame([("hot ring ring",)], "q string")

    def grams(t):
        t = re.sub("[^0-9a-z]", "", (t or "").lower())
        return Counter([t[i : i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1)] or [t] * (len(t) == 1))

    idf = {g: math.log((len(names) + 1) / (n + 1)) + 1 for g, n in Counter(g for t in names for g in set(grams(t))).items()}
    weigh = lambda t: {g: (1 + math.log(n)) * idf[g] for g, n in grams(t).items() if g in idf}
    norm = lambda w: math.sqrt(sum(x * x for x in w.values()))
    q = weigh("hot ring ring")
    want = {i: sum(w * q.get(g, 0) for g, w in weigh(t).items()) / (norm(weigh(t)) * norm(q) or 1) for i, t in enumerate(names)}
    for most in (200_000, 0):
        found = ranking.tfidf(docs, "d", F.col("t"), query, F.col("q"), most_grams=most)
        assert {r.d: round(r.sim, 9) for r in found.collect()} == {i: round(s, 9) for i, s in want.items()}
    # neither the documents nor their grams are sent anywhere, however small Spark thinks they are
    assert "BuildLeft" not in plan(ranking.tfidf(docs, "d", F.col("t"), query, F.col("q")))


@pytest.fixture(scope="module")
def many_parts(spark, tmp_path_factory):
    """Parts whose file is small for its rows: equal values are stored once."""
    path = str(tmp_path_factory.mktemp("parts"))
    spark.range(30_000).selectExpr("id AS p_partkey", "repeat('hot ring ', 5) AS p_name", "concat('Brand#', id % 25) AS p_brand", "'SMALL' AS p_type", "1 AS p_size", "900.0D AS p_retailprice").coalesce(1).write.parquet(f"{path}/part.parquet")
    return path


@pytest.mark.parametrize("name", ["w2_rank_units", "w3_diversified_topk", "w4_rank_factors", "flagship_ranked_evidence"])
def test_units_are_not_broadcast(spark, many_parts, name):
    """Parts stand once in the plan and keep their columns on the way to their similarity."""
    text = plan(catalog.queries()[name](spark, many_parts))
    assert not re.search(r"Join \[p_partkey#\d+L\], \[(?:p_partkey|__d)#", text)


def test_a_block_has_any_number_of_rows(spark):
    """More rows of one block than were once let in, half of them accepted as they are."""
    n = 24_000
    df = spark.range(n).selectExpr("id AS ord", "'b' AS block", "cast(id % (24000 div 2) AS string) AS text")
    audit = lambda t, h: ["seen"] if t in h else []
    out = quality.repair_loop(df, "block", "text", "ord", audit, lambda t, issues, k: f"{t}x")
    assert {(r.tries, r.ready): r["count"] for r in out.groupBy("tries", "ready").count().collect()} == {(0, True): n // 2, (1, True): n // 2}


def test_evidence_equals_all_pairs(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(0, 4)))
    questions = [(i, rng.choice([0, 1, 2, None]), rng.choice([word(), None, "A-" + word(), "ab ab"]), rng.choice([None, rng.randrange(30)])) for i in range(60)]
    evidence = [(i, rng.choice([0, 0, 1, 3, None]), rng.choice([word(), word(), None, "B" + word()])) for i in range(30)]
    key = lambda t: re.sub("[^0-9a-z]", "", (t or "").lower())
    want = set()
    for q, code, label, preferred in questions:
        tier = lambda e: 0 if e[0] == preferred else 1 if key(label) and key(e[2]) and (key(label) in key(e[2]) or key(e[2]) in key(label)) else 2  # noqa: E731, B023
        found = sorted((tier(e), e[0]) for e in evidence if code is not None and e[1] == code)
        want |= {(q, e, t, k + 1) for k, (t, e) in enumerate(found[:3])}
    df = match.attach_evidence(spark.createDataFrame(questions, "q int, code int, label string, pref int"), "q", "code", "label", "pref", spark.createDataFrame(evidence, "e int, ecode int, text string"), "e", "ecode", "text", "e")
    assert {(r.q, r.e, r.tier, r.place) for r in df.collect()} == want
    # no join by code alone but to the first rows of a code
    assert len(re.findall(r"Join \[code#\d+\], \[ecode#\d+\]", plan(df).split("Initial Plan")[0])) == 1


ODD = [None, "", " ", "\t\n", "-_/", ".", "a b", "A\nb", "a b", "ab", "a　b", "a·b", "a\x0bb", "a\x85b", "ΣΑΣ", "σασ", "σας", "İ", "i", "i̇", "ẞ", "ß", "[x]", "{x}:", "x;", None, "Äß"]


def test_first_texts_equal_the_sql_on_odd_ones(spark, tmp_path):
    spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = {r[0] for r in con.execute(catalog.oracle_sql()["d1_first_wins"]).fetchall()}
    assert {r.doc_id for r in catalog.queries()["d1_first_wins"](spark, str(tmp_path)).collect()} == want


def test_accented_letters_are_no_hangul(spark):
    texts = ["Äßte, enzupfsch der, die.", "한국어 Äßte".encode().decode("latin-1")]
    assert [r.t for r in spark.createDataFrame([(t,) for t in texts], "t string").select(udfs.repair_mojibake("t").alias("t")).collect()] == [texts[0], "한국어 Äßte"]


def test_lines_are_not_shuffled_and_many_names_give_the_same(spark):
    names = spark.createDataFrame([("Small one", 2), ("small", 0), ("one", 1), ("A·b", 3), ("x", 4), ("Small One two", 5)], "label string, ord int")
    lines = ["Class: SMALL ONE", "|Class|a∙B|x|", "|one|small one t|late|", "Class", "head", "mall o", "x", "none", "section", "Class small one", ""]
    df = spark.createDataFrame([(i, "\n".join(lines[i:] + lines[:i])) for i in range(len(lines))] + [(99, None)], "d int, t string")
    found = [labels.anchor_classes(df, "d", "t", names, "label", "ord", "Class", ("head",), "section", most_names=n) for n in (100, 0)]
    few, many = ({(r.d, r.label, r.score, r["rank"], r.best) for r in x.collect()} for x in found)
    assert few == many and len({x[1] for x in few}) > 4
    # cells of pipes by text and by table, and what is found by text
    assert len(re.findall(r"Exchange hashpartitioning\(d#", plan(labels.anchor_classes(df, "d", "t", names, "label", "ord", "Class", ("head",), "section")))) <= 3


def test_streams_take_rows():
    """No frame is made for a key's few rows."""
    kept, timers = [], []
    reviews = keyed.Reviews()
    reviews.pending, reviews.handle = SimpleNamespace(appendList=kept.extend), SimpleNamespace(registerTimer=timers.append)
    rows = [Row(at=5_000, event=2, action="review", verdict=None, expected=None), Row(at=3_000, event=1, action="rollback", verdict="x", expected=-1)]
    assert list(reviews.handleInputRows(("r", "q"), iter(rows), None)) == []
    assert kept == [tuple(r) for r in rows] and timers == [4]
