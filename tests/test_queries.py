"""Every registered query against its SQL on the smallest tables; streams and stores."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import differences
from tickframe.plans import snapshot as SN

SF = os.environ.get("TICKFRAME_SF", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", list(entry.QUERIES))
def test_query(spark, name):
    said, n, _, _ = differences(spark, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert not said and n >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_field_contract():
    names = [f for group in SN.GROUPS.values() for f in group]
    assert len(names) == len(set(names)) == 76
    assert SN.needed(["legs"]) == ["range_scale", "swing", "legs"]
    assert [f for g in SN.GROUPS.values() for f, u in g.items() if u == "points"] == ["range_scale"]
    with pytest.raises(ValueError):
        SN.needed(["astrology"])
