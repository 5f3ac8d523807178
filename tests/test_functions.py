"""Functions that need Python, sources of files, and edge values."""

import io
import zipfile
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from quillmill.functions import text as X
from quillmill.functions import udfs as U
from quillmill.operators import documents
from quillmill.sources import readers, writers


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r.y for r in df.select("i", expression(F.col("c")).alias("y")).orderBy("i").collect()]


def test_normalisers_strip_unicode_space(spark):
    values = ["A\u00a0b·C", "x\u3000y_z", "(가)나-다", None, ""]
    assert column(spark, values, X.dedup_key) == ["abc", "xyz", "가나다", "", ""]
    assert column(spark, values, X.catalogue_key) == ["abc", "xyz", "가나다", "", ""]
    assert column(spark, ["[tag] What's  NEW? 가", None], X.question_key) == ["what s new 가", ""]
    assert column(spark, [" 7.0", "123456", "x", None], lambda c: X.code(c, 4)) == ["0007", "123456", "x", ""]


def test_char_grams_of_short_texts(spark):
    assert column(spark, ["", "a", "ab", "abc"], X.char_ngrams) == [[], ["a"], ["ab"], ["ab", "bc", "abc"]]
    assert column(spark, ["ab", "ab c"], X.char_ngram_set) == [[], ["abc"]]


def test_coercions(spark):
    assert column(spark, ["12", " -3 ", "x", "1.5", None], X.to_int) == [12, -3, None, None, None]
    assert column(spark, ["Yes", "0", "maybe", None], X.to_bool) == [True, False, None, None]


def test_sequence_ratio_is_difflib(spark):
    pairs = [("abcd", "bcde"), ("", ""), (None, "x"), ("a" * 300 + "b", "b" + "a" * 300)]
    got = [r.y for r in spark.createDataFrame(pairs, "a string, b string").select(U.sequence_ratio("a", "b").alias("y")).collect()]
    assert got == [SequenceMatcher(None, a or "", b or "").ratio() for a, b in pairs]


def test_mojibake_is_repaired_only_where_it_helps(spark):
    broken = "한국어".encode().decode("latin-1")
    assert column(spark, [broken, "plain", "한국어", None], U.repair_mojibake) == ["한국어", "plain", "한국어", None]


def test_stems_and_particles(spark):
    assert column(spark, ["running", "sings", "is", None], U.stemmer(("ing", "n", "s"))) == ["ru", "sing", "is", None]
    df = spark.createDataFrame([("자료를 본다", "자료", "책"), ("책은 좋다", "책", "자료")], "t string, o string, n string")
    assert [r.y for r in df.select(U.replace_with_particle("t", "o", "n").alias("y")).collect()] == ["책을 본다", "자료는 좋다"]


def test_json_is_sliced(spark):
    assert column(spark, ['```json\n{"a": [1, "}"]} tail```', "none", '{"a": ', "x [1,2] y"], U.json_slice) == ['{"a":[1,"}"]}', None, None, "[1,2]"]


def test_ksa_types(spark):
    df = spark.createDataFrame([("Knowledge", ""), ("", "책임감 있는 자세"), ("", "데이터 분석"), ("기술", "x"), (None, None)], "r string, f string")
    assert [r.y for r in df.select(X.ksa_type(F.col("r"), F.col("f")).alias("y")).collect()] == ["지식", "태도", "기술", "기술", ""]


def test_csv_in_korean_encoding_and_with_a_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("code,name\n01,지역\n".encode("cp949"))
    (tmp_path / "b.csv").write_bytes("code,name\n02,분류\n,\n".encode("utf-8-sig"))
    rows = sorted((r.code or "", r.name) for r in readers.read_csv_any_encoding(spark, str(tmp_path), ["code", "name"]).collect())
    assert rows == [("", None), ("01", "지역"), ("02", "분류")]
    only = tmp_path / "only"
    only.mkdir()
    (only / "b.csv").write_bytes("code,name\n02,분류\n02,again\n,x\n".encode("utf-8-sig"))
    assert [(r.code, r.name) for r in readers.read_catalogue_csv(spark, str(only), ["code", "name"], ["code", "name"], ["code"]).collect()] == [("02", "분류")]


def test_archives_list_what_they_cannot_read(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for i in range(4):
            z.writestr(f"m{i}.txt", f"text {i}")
        z.writestr("m4.bin", b"\xff\xfe\x00\x81\xff")
    (tmp_path / "a.zip").write_bytes(buffer.getvalue())
    (tmp_path / "b.txt").write_text("plain", encoding="utf-8")
    rows = {(r.file.rsplit("/", 1)[1], r.member): (r.content, r.warning) for r in readers.read_archives(spark, str(tmp_path), members=5).collect()}
    assert rows[("b.txt", "")] == ("plain", None) and rows[("a.zip", "m0.txt")] == ("text 0", None) and rows[("a.zip", "m4.bin")] == (None, "not_text")
    assert {r.warning for r in readers.read_archives(spark, str(tmp_path), members=2).filter("member > 'm1.txt'").collect()} == {"too_many_members"}


def test_captured_pages_source(spark, tmp_path):
    for i, body in enumerate(["application/json\n{}", "text/xml\n<r/>"], 1):
        (tmp_path / f"page-{i}.txt").write_text(body, encoding="utf-8")
    spark.dataSource.register(readers.PagedSource)
    rows = spark.read.format("captured_pages").option("pages", 3).load(str(tmp_path)).collect()
    assert sorted((r.page, r.content_type, r.body) for r in rows) == [(1, "application/json", "{}"), (2, "text/xml", "<r/>")]


def test_page_totals_stop_reading(spark):
    pages = spark.createDataFrame([(1, ["a", "b"], "3"), (2, ["c"], "3"), (3, ["d"], "3"), (4, [], "3"), (5, ["z"], "3")], "page int, items array<string>, total string")
    assert sorted(r.page for r in readers.until_empty(pages, "page", "items").collect()) == [1, 2, 3]
    assert sorted(r.page for r in readers.until_empty(pages, "page", "items", "total").collect()) == [1, 2]


def test_reports_fill_missing_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    writers.write_csv_report(df, str(tmp_path / "r"), ["a", "b", "c"])
    assert sorted(tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "r")).na.fill("").collect()) == [("1", "", ""), ("2", "x", "")]


def test_openers_that_never_close_are_read_once(spark):
    import time

    from quillmill.operators import labels

    junk = [mark * (5_000_000 // len(mark)) for mark in ("<script ", "<table>", "<table ", "<", "<tr>")]
    pages = spark.createDataFrame([(i, "</script> </table> > " + j) for i, j in enumerate(junk)], "k int, html string")
    began = time.perf_counter()
    assert pages.select(F.max(F.length(documents.html_text(F.col("html"))))).collect()[0][0] > 4_000_000
    assert labels.table_rows(pages, "k", "html").count() == 0
    assert time.perf_counter() - began < 25
