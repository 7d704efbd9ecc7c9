"""Registered queries against their checking SQL; all of them with PLINTH_ALL=1."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from checks import compare
from plinth.plans.registry import GIVEN

SF_DIR = "/root/testdata/sf0.001"
QUICK = [
    "normalize_headers", "parse_scalars", "infer_column_types", "choose_visual", "paginate_columns", "extract_numbers", "required_images",
    "clip_text", "normalize_tags", "select_chart_canvas", "job_state", "soak_summary", "read_requests", "upload_quota", "critique_passes",
    "read_json_assets", "read_xlsx_datasets", "publish_tables", "plan_fingerprint", "word_overlap_score", "choose_variant", "paginate_plan", "remap_pages", "ground_assets", "preflight_build", "detect_grids",
    "compile_render_ops", "default_facts",
]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for table in GIVEN:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.queries()) if os.environ.get("PLINTH_ALL") else QUICK)
def test_query_matches_sql(spark, con, name):
    verdict, _ = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF_DIR)
    assert verdict.startswith("ok" if name in entry.oracle_sql() else "unchecked"), verdict


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
