import os

import duckdb
import pytest

from cohortlake.plans import registry

DATA = "/root/testdata/sf0.001"
SOME = ["roc_auc", "youden", "collapse_images", "overlap_ledger", "roi_overlap", "bootstrap_ci", "verify_hashes", "sink_splits", "sink_predictions", "qa_package", "context_window", "heatmap_roi", "heatmap_panel", "review_select", "background_boxes", "reader_rules", "freeze_models", "freeze_complete", "paired_ci", "statistics", "run_audit", "external_record", "temperature", "leakage_pairs", "validate_scores", "locked_point", "audit_complete", "scan_case_files", "path_ladder", "best_image", "folder_series", "cache_refresh", "lock_record", "freeze_record", "freeze_compare", "drawn_lesion_boxes", "whole_manifest", "class_coverage", "patch_rules", "patch_verify", "deidentify", "scan_runs", "scan_delimited", "source_membership", "black_stripe"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    df = registry.QUERIES[name](spark, DATA)
    rel = con.sql(registry.SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    clean = lambda v: float(v) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    got = sorted([tuple(clean(r[c]) for c in cols) for r in df.collect()], key=str)
    want = sorted([tuple(clean(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall()], key=str)
    assert got == want


def test_every_sql_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)
