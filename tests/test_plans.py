"""Plans of queries over documentation pages: one pass over the pages, no joins of what it makes, no columns that nobody reads."""

import pytest

from docloom.plans import documentation

SF = "/root/testdata/sf0.001"


def _plan(spark, query):
    return documentation.QUERIES[query](spark, SF)._jdf.queryExecution().sparkPlan().toString()


#: Fields that the pass over the pages makes, by query.
ONE_PASS = {
    "rag_rows_v1": "id title level section_number breadcrumb content code_blocks tables parent_id path",
    "nodes_within": "node tag inner_node inner_tag",
    "tree_to_depth": "id parent_id depth",
    "parsed_statistics": "id title level section_number breadcrumb content mixed code_blocks tables pos parent_id path depth",
    "doc_elements": "id mixed",
    "section_statistics": "mixed code_blocks tables",
    "class_depth_stats": "depth classes",
    "page_sections": "id title level section_number breadcrumb content pos",
    "contents_joined": "id toc_title toc_level",
    "doc_code": "id code_blocks",
    "config_of_sections": "id title code_blocks",
}


@pytest.mark.parametrize("query", ONE_PASS)
def test_one_pass(spark, query):
    plan = _plan(spark, query)
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
    made = plan[plan.index("MapInArrow") :].split("\n")[0].rsplit("[", 1)[1].split("]")[0]
    assert {x.strip().split("#")[0] for x in made.split(",")} - {"p_partkey", "doc"} == set(ONE_PASS[query].split())


def test_snapshot_counts_once(spark):
    assert "Generate" not in _plan(spark, "snapshot_counts")  # the patterns are counted, and only their counts read thrice


def test_whole_sample_is_no_pass_of_its_own(spark):
    assert "Generate" not in _plan(spark, "adaptive_coverage")


def test_point_lookup_parses_one_page(spark):
    assert "EqualTo(p_partkey,7)" in _plan(spark, "point_lookup")  # the filter reaches the table, below the parser
