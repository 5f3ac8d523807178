"""Noun forms of Korean clauses by hand, and surfaces with their tags."""

import pytest
from pyspark.sql import functions as F

from quillmill.functions import hangul as H
from quillmill.operators import surfaces as N

CLAUSES = {
    "자료를 분석하는": "자료 분석", "영업기회를 찾아낼 수 있는": "영업기회 찾아내기", "문서를 다루는": "문서 다루기", "책을 읽을 수 있는": "책 읽기", "설비를 점검하고자 하는": "설비 점검", "규정을 준수하려는": "규정 준수",
    "품질을 높이려는": "품질 높이기", "값을 얻으려는": "값 얻기", "예산을  편성한": "예산 편성", "계획을 수립할": "계획 수립", "작성된": "작성", "위험을 줄이기 위한": "위험 줄이기", "안전을 확보하기 위한": "안전 확보",
    # 가을 does not end in a particle, since 가 has no final consonant
    "가을 분석하는": "가을 분석", "data를 분석하는": "data 분석", "자료를 관리": "자료를 관리", "하는": "하기", "는": "는", "사진": "사진", "": "", "plain text": "plain text",
}


@pytest.mark.parametrize("clause", CLAUSES)
def test_clauses_become_noun_phrases(clause):
    assert H.noun_phrase(clause)[0] == CLAUSES[clause]


def test_the_longest_ending_is_turned():
    assert H.noun_phrase("자료를 검토할 수 있는")[1] == "하ㄹ 수 있는" and H.noun_phrase("찾는")[1] == "는" and H.noun_phrase("관리")[1] is None


def test_particles_need_their_syllable():
    for text, left in {"기회를": "기회", "자료을": "자료을", "문건을": "문건", "문건를": "문건를", "x을": "x", "을": "을"}.items():
        assert H.OBJECT.apply(text)[0] == left


def test_final_consonants():
    assert [H.has_final_consonant(w) for w in ("문건", "보고서", "문건)", "abc", "", None)] == [True, False, True, False, False, False]


def test_batches_equal_single_texts(spark):
    texts = [*CLAUSES, None, *CLAUSES]
    out = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", H.nominaliser()("t").alias("r")).collect()
    assert {r.k: (r.r.text, r.r.ending) for r in out} == {k: H.noun_phrase(t) for k, t in enumerate(texts)}


PHRASES = N.Phrases(rules={"지식": ((r"규정$", "규정 적용"), (r"정$", "정 판단"))}, default={"지식": " 기준", "": " 업무"}, elements={"": " 절차"}, competencies={"": " 기준"}, fallback={"태도": "행동 기준", "": "업무 기준"})


def test_surfaces_and_their_tags(spark):
    rows = {
        "rule": (("세무 규정 (지식)", "지식", None, None, None), ("세무 규정 적용", "factor_repair")),
        "second rule": (("공정", "지식", None, None, None), ("공정 판단", "factor_repair")),
        "default": (("자료를 분석하는", "지식", None, None, None), ("자료 분석 기준", "factor_repair")),
        "other kind": (("자료를 분석하는", None, None, None, None), ("자료 분석 업무", "factor_repair")),
        "too long": (("가" * 90, "지식", "측정", None, None), ("측정 절차", "element_name")),
        "blank": (("  ", "지식", "", "자료를 다루는", "이름"), ("자료 다루기 기준", "competency_definition")),
        "competency": ((None, "지식", " ", None, "이름"), ("이름 기준", "competency_name")),
        "nothing": ((None, "태도", None, None, None), ("행동 기준", "safe_fallback")), "nothing at all": ((None, None, None, None, None), ("업무 기준", "safe_fallback")),
    }
    df = spark.createDataFrame([(k, *v[0]) for k, v in rows.items()], "k string, f string, kind string, e string, d string, c string")
    out = {r.k: (r.surface, r.tag) for r in N.task_objects(df, *[F.col(c) for c in ("f", "kind", "e", "d", "c")], PHRASES).collect()}
    assert out == {k: v[1] for k, v in rows.items()}
    assert "__f" not in N.task_objects(df, *[F.col(c) for c in ("f", "kind", "e", "d", "c")], PHRASES).columns
