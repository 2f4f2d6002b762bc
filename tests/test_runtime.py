import random
from pathlib import Path
from urllib.parse import unquote, urlparse

import pytest
from pyspark.sql import functions as F

from evalloom.runtime import broadcast_if_small, cut_lineage, join_weighted, release, shared_folder, spread


def test_no_key_of_a_weighted_join_is_lost(spark):
    big = spark.range(4000).select((F.col("id") % 40).alias("key"), "id")
    for weight in ("100", "key", "null"):
        keyed = spark.range(40).select(F.col("id").alias("key"), F.expr(f"cast({weight} as bigint)").alias("n"), (F.col("id") * 2).alias("x"))
        for total in (0, 10, 4000, 10**6):
            found = join_weighted(big, keyed, "key", "n", total, 8)
            assert sorted((r.id, r.x) for r in found.collect()) == [(i, i % 40 * 2) for i in range(4000)]


def test_any_weights_give_the_plain_join(spark):
    rng = random.Random(4)
    for _ in range(6):
        counts = [rng.choice([0, 1, 1, 1, 2, 40]) for _ in range(rng.randrange(1, 300))]
        big = spark.createDataFrame([(k, i) for k, n in enumerate(counts) for i in range(n)] or [(-1, 0)], "key long, i long")
        keyed = spark.createDataFrame(list(enumerate(counts)), "key long, n long")
        found = join_weighted(big, keyed, "key", "n", sum(counts), rng.choice([1, 4, 64]))
        assert sorted(map(tuple, found.select("key", "i", "n").collect())) == sorted(map(tuple, big.join(keyed, "key").select("key", "i", "n").collect()))


def test_tables_between_steps(spark):
    rows = cut_lineage(spark.range(10).selectExpr("id", "id % 3 as k", "array(id) as a", "cast(null as string) as s"), "k")
    assert {(r.id, r.k, r.a[0], r.s) for r in rows.collect()} == {(i, i % 3, i, None) for i in range(10)}
    assert cut_lineage(spark.range(0)).count() == 0
    files = [Path(unquote(urlparse(f).path)) for f in rows.inputFiles()]
    assert files and all(f.exists() for f in files)
    release(spark)
    assert not any(f.exists() for f in files)
    release(spark)

    class Cluster:
        sparkContext = type("Context", (), {"master": "yarn", "getConf": staticmethod(dict)})
        conf = {}  # noqa: RUF012

    with pytest.raises(RuntimeError):
        shared_folder(Cluster)


def test_broadcasts_are_bounded(spark, tmp_path):
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString() or "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    few = spark.range(5).withColumn("t", F.expr("repeat('x', 1000)"))
    assert hinted(broadcast_if_small(few)) and not hinted(broadcast_if_small(few.select("*"), max_rows=4)) and not hinted(broadcast_if_small(few.select("t"), max_bytes=4000))
    few.coalesce(1).write.parquet(str(tmp_path / "t"))
    scan = spark.read.parquet(str(tmp_path / "t"))
    assert spread(scan, min_bytes=0).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(scan) is scan
