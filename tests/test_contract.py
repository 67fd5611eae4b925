"""The driver contract, and a choice of queries against their oracles (``compare.py`` runs all)."""

import pytest

import __spark_entry__ as contract
from compare import differences

SMALL = "/root/testdata/sf0.001"


def test_entry(spark):
    assert contract.entry(spark).columns == ["path", "title", "copies", "pos", "level", "outline", "text"]
    assert contract.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", ["document_properties", "headings", "links", "table_cells", "filter_ignore_rules", "sibling_position", "sync_plan", "html_links"])
def test_oracle(spark, name):
    assert differences(spark, SMALL, name) == []
