import pytest
from oracle import DATA, duck, rows

from surfacescan.queries import oracle_sql, queries

SOME = ["claim_files", "claiming_rule", "path_parts", "coverage_frame", "match_positions", "match_preview", "match_phases", "pattern_phases", "innermost_context", "calls_below", "summarize_findings", "summarize_coverage", "hash_manifest", "sarif_fingerprints", "quantiles", "provenance_mismatch", "dependency_closure", "pattern_findings", "broken_rules", "matches_beside_broken_rules", "proportion_packages", "export_jobs", "sarif_artifacts"]


@pytest.mark.parametrize("name", SOME)
def test_against_duckdb(spark, name):
    ours, theirs = queries()[name](spark, f"{DATA}/sf0.001").toPandas(), duck(oracle_sql()[name])
    assert sorted(ours.columns) == sorted(theirs.columns) and rows(ours) == rows(theirs)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
