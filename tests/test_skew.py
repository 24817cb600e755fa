"""Lookups with hot keys, and the folder of intermediate tables."""

import pytest
from pyspark.sql import functions as F

from tamarack import session
from tamarack.operators import skew


def test_lookup_of_hot_keys(spark, monkeypatch):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 40}") for i in range(600)] + [(900, None), (901, "alone")], "i int, k string")
    right = left.where("k <> 'alone'").groupBy("k").agg(F.count("*").alias("c"), F.min("i").alias("least"))
    want = sorted((r.i, r.k, r.least) for r in left.join(right, "k").collect())
    for rows in (200_000, 0):  # the whole table is broadcast, and only the hot keys' part can be
        monkeypatch.setattr(skew, "BROADCAST_ROWS", rows)
        got = skew.lookup(left, right, ["k"], "c", hot=100)
        assert got.columns == ["k", "i", "least"] and sorted((r.i, r.k, r.least) for r in got.collect()) == want
    assert skew.lookup(left.limit(0), right.limit(0), ["k"], "c").count() == 0


def test_intermediate_tables_are_released(spark):
    kept = session.materialise(spark.range(5))
    assert kept.count() == 5 and session.release_tables() > 0 and session.release_tables() == 0
    with pytest.raises(Exception, match="(?i)exist|not found|FAILED_READ"):
        kept.selectExpr("sum(id)").collect()


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"
        getConf = lambda self: Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_folder(Session())
