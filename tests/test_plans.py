"""Plans: filters and columns reach the scans, no cross products, no Python where built-ins do."""

import re

import pytest

from quillmill.plans import catalog

SF = "/root/testdata/sf0.001"
#: Queries whose operator is Python by nature: sequence ratio, greedy and stateful replay, automata of names, text rules, archives.
PYTHON = re.compile(r"^(j10|j11|j17|t6d|d[56789]|x7|x9|x10|x16|x18|x22|q8|l1_review_stream|l2|l4_admitted|s2|s14)")
#: Queries that pair every row with one small table by intention: one-row totals, or a catalogue of checked size.
NESTED = re.compile(r"^(w|k7|f10|x6|l5|s7|t6d|flagship|l7)")


def plan(spark, name):
    return catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in catalog.queries() if not re.match(r"^(s[1-9]_|s1[46]|k[456]|l1_r|l4_admitted_s|l5_s|l6_q.*stream|l7|l9_r)", n)])
def test_plan(spark, name):
    text = plan(spark, name)
    if not PYTHON.match(name):
        assert not re.search("Python|Pandas|Arrow", text)
    assert "CartesianProduct" not in text
    if not NESTED.match(name):
        assert "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "j2_factor_unit_join")
    assert "GreaterThan(l_quantity,45.0)" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double>" in text.replace("\n", "")
    assert "text" not in re.search(r"ReadSchema: struct<[^>]*>", plan(spark, "a1_verdict_metrics"))[0]


def test_top_k_is_taken_without_a_global_sort(spark):
    for name in ("w3_diversified_topk", "w9_recommend_postings", "a9_most_common"):
        assert "TakeOrderedAndProject" in plan(spark, name)


def test_first_rows_are_cut_before_the_shuffle(spark):
    for name in ("d1_first_wins", "w1_stratified_sample", "x4_requirements"):
        assert plan(spark, name).count("WindowGroupLimit") == 2, name
