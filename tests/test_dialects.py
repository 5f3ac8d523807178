"""The shared patterns give the same result in Spark's and DuckDB's regular expressions."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quillmill.functions import text as X

SAMPLES = ["", " ", "a\u00a0b\u3000c d", "가·나‧다･라ㆍ마•바∙사⋅아・자", "x-y_z/|(),.[]{}:;", "[tag] Q? 가 나", "sk-abcdefgh12 api_key = 1", "ÄÖÜ ß É", "\U0001f600 a\U0001f600b", "line\nbreak\ttab\r", "1) one, 2. two; (3) three/four|five"]
REPLACED = [X.LABEL_MARKS, X.CATALOGUE_MARKS, X.COVERAGE_MARKS, X.DOCUMENT_MARKS, X.GAP_MARKS, r"[^0-9A-Za-z가-힣]+", r"\[[^\]]+\]", r"[^0-9a-z가-힣 ]+", rf"[{X.SPACE}]+", r"[.!?;\n]+", r"<[^>]+>", r"\s*[,;/|\n]\s*"]
FOUND = [X.SECRET, r"^[0-9.\-() ]+$", r"[.!?]$", r"^[+-]?[0-9]+$"]


def re2(pattern: str) -> str:
    return pattern.replace("\u00a0", r"\x{00A0}").replace("\u3000", r"\x{3000}")


@pytest.mark.parametrize("pattern", REPLACED)
def test_replacement(spark, pattern):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, s string")
    got = [r.y for r in rows.select("i", F.regexp_replace("s", pattern, "~").alias("y")).orderBy("i").collect()]
    assert got == [duckdb.execute("SELECT regexp_replace(?, ?, '~', 'g')", [s, re2(pattern)]).fetchone()[0] for s in SAMPLES]


@pytest.mark.parametrize("pattern", FOUND)
def test_match(spark, pattern):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, s string")
    got = [r.y for r in rows.select("i", F.col("s").rlike(pattern).alias("y")).orderBy("i").collect()]
    assert got == [duckdb.execute("SELECT regexp_matches(?, ?)", [s, pattern]).fetchone()[0] for s in SAMPLES]


def test_hashes_and_case_agree(spark):
    rows = spark.createDataFrame([(s,) for s in SAMPLES], "s string")
    for spark_side, duck in ((F.sha2("s", 256), "sha256(?)"), (F.md5("s"), "md5(?)"), (F.sha1("s"), "sha1(?)"), (F.length("s"), "length(?)"), (F.lower("s"), "lower(?)")):
        assert [r[0] for r in rows.select(spark_side).collect()] == [duckdb.execute(f"SELECT {duck}", [s]).fetchone()[0] for s in SAMPLES]
