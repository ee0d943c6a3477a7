"""The driver contract, and a few registered queries next to their SQL."""

import re

import pytest

import __spark_entry__ as entry
import check_queries

SMALL = "/root/testdata/sf0.001"


def test_contract():
    queries, oracles = entry.queries(), entry.oracle_sql()
    own = {name for name in queries if name.startswith("q_")}
    assert {name for name in oracles if name.startswith("q_")} == own and len(own) >= 63
    assert set(oracles) <= set(queries)
    assert all(re.fullmatch(r"q_[a-z0-9_]+|op\d+_[a-z0-9_]+|pipeline", name) for name in queries)


def test_entry(spark):
    frame = entry.entry(spark)
    assert "labels_json" in frame.columns and frame.count() > 0


@pytest.mark.parametrize("name", ["q_export_labels", "q_event_dedup", "q_counter_delta", "q_label_fold", "q_stream_samples"])
def test_against_sql(spark, name):
    _, verdict = check_queries.compare(spark, SMALL, name)
    assert verdict.startswith("ok"), verdict
