"""Work in Python on small rows is dealt out, though a file of them is one split."""

from skeinlake.operators import mining
from skeinlake.plans import registry

registry.load()


def test_observations_are_parsed_by_all_tasks(spark):
    parsed = registry.QUERIES["I22"](spark, "/root/testdata/sf0.001")
    assert parsed.rdd.getNumPartitions() >= 4


def test_fixed_strings_are_bared_once():
    mining._bare_of.cache_clear()
    assert [mining.is_placeholder(x) for x in (" Atomic FACT. ", "x", "buys​", "mine")] == [True, False, False, False]
    assert mining.is_placeholder("-Mine-", ("mine",)) and mining._bare_of.cache_info().misses == 2
