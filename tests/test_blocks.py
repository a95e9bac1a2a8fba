"""Registered jobs with every group treated as large: tiny blocks, same rows as the SQL."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from cuelake.operators import ordered
from cuelake.sources import fixtures

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [
    "artifact_versions", "repetition_runs", "retimed_captions", "resegment_cues", "silent_spans", "sync_report_reset",
    "transition_audit", "resolve_segments",
])
def test_tiny_blocks(spark, monkeypatch, name):
    def tiny(df, keys, by, **kw):
        kw["rows_per_block"] = 3 if kw.get("dense") else 40
        out, order = ordered.arrange(df, keys, by, **kw)
        assert order.block
        return out, order

    monkeypatch.setattr(fixtures, "arrange", tiny)
    _, problems = compare(spark, connect(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert not problems, problems
