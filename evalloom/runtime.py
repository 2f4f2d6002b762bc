"""Session, table and lineage helpers shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects; `conf` overrides them."""
    builder = SparkSession.builder.appName("evalloom")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    return builder.config(map=settings).getOrCreate()


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{directory}/{name}.parquet"))


def spread(scan: DataFrame, min_bytes: int = 1 << 20) -> DataFrame:
    """`scan`, over as many partitions as there are cores if its files give fewer: what is done to its rows would else keep the other cores waiting."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    plan = scan._jdf.queryExecution()
    if int(str(plan.optimizedPlan().stats().sizeInBytes())) < min_bytes or plan.toRdd().getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores)


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one the session names in `spark.checkpoint.dir`, which all executors share."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    # Only a session on one machine that names no folder (tests, a laptop) gets one of its own.
    global _own_folder
    _own_folder = _own_folder or tempfile.mkdtemp(prefix="evalloom-")
    return f"file://{_own_folder}"


_own_folder: str | None = None


def _own_tables(spark: SparkSession):
    """The file system and the folder of this application's intermediate tables."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/evalloom-{context.applicationId}")
    return path.getFileSystem(context._jsc.hadoopConfiguration()), path


def release(spark: SparkSession) -> None:
    """Deletes the intermediate tables made so far, for a session that runs many queries: what was not written yet of their results can't be read afterwards."""
    files, path = _own_tables(spark)
    files.delete(path, True)


def cut_lineage(df: DataFrame, *by: str) -> DataFrame:
    """Writes `df` as a table in the shared folder and reads it from there, so that a lost executor costs no recomputation of what came before.

    The table is columnar: a later step reads only the columns it uses. All tables of an application lie in one folder,
    which goes when the application ends. With `by`, rows are filed by these columns, so that a step that asks for one of
    their values reads no other rows.
    """
    spark = df.sparkSession
    files, path = _own_tables(spark)
    files.deleteOnExit(path)
    table = f"{path}/{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(table)
    return spark.read.schema(df.schema).parquet(table)


def broadcast_if_small(df: DataFrame, max_rows: int = 20_000, max_bytes: int = 64 << 20) -> DataFrame:
    """`df` with a broadcast hint when its rows, counted up to a bound, prove few and short; otherwise `df`, to be joined by shuffle. The outcome is remembered."""
    known = df.__dict__.setdefault("_evalloom_small", {})
    if max_rows not in known:
        size = F.coalesce(F.sum(F.length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))))), F.lit(0))
        rows, written = df.limit(max_rows + 1).agg(F.count("*"), size).first()
        known[max_rows] = rows <= max_rows and written <= max_bytes
    return F.broadcast(df) if known[max_rows] else df


def join_weighted(big: DataFrame, keyed: DataFrame, key: str, weight: str, total: int, share: int = 1024) -> DataFrame:
    """Inner join of `big` with `keyed`, which has one row a `key` and in `weight` about how many rows of `big` the key has.

    A key with `total / share` rows or more would overload one task, so the side of such keys is broadcast and the rows
    stay where they are; the others meet by shuffle. Where `total` is the sum of the weights at most `share` keys are
    that heavy. A count proves it; if there are more, only keys heavier than the one after the first `share` are broadcast.
    """
    limit = max(1, total // share)
    if keyed.where(F.col(weight) >= limit).limit(share + 1).count() > share:
        limit = keyed.select(weight).orderBy(F.desc(weight)).offset(share).first()[0] + 1
    heavy = F.coalesce(F.col(weight) >= limit, F.lit(False))
    return big.join(F.broadcast(keyed.where(heavy)), key).unionByName(big.join(keyed.where(~heavy), key))
