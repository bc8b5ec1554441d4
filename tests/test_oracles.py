from pathlib import Path

import pytest

import __spark_entry__ as entry
import check
from hostvigil.plans import catalog

SMALL = "/root/testdata/sf0.001"
NAMES = ["security_decision", "extract_clean_text", "traffic_risk", "cooldown_dedup", "alert_lifecycle", "nb_score", "dedup_keep_first", "stratified_split", "classification_report", "weekly_report"]


def test_every_query_has_an_expected_result():
    assert not set(catalog.QUERIES) - set(entry.oracle_sql())
    assert not set(entry.oracle_sql()) - set(entry.queries())


@pytest.mark.skipif(not Path(SMALL).exists(), reason="test data not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_statement(spark, name):
    assert check.compare(spark, check.connect(SMALL), SMALL, name) == ""
