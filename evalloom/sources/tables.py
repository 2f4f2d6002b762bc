"""Evaluation tables in files of any format Spark reads and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evalloom import schemas
from evalloom.sources.contract import ContractError

SCHEMAS = {"documents": schemas.DOCUMENTS, "questions": schemas.QUESTIONS, "suites": schemas.SUITES}


def read(spark: SparkSession, path: str, table: str, format: str = "parquet", **options: str) -> DataFrame:
    """One of the evaluation tables, its columns chosen by name and cast to the schema; others are left aside."""
    wanted = spark.createDataFrame([], SCHEMAS[table]).schema
    reader = spark.read.options(**options)
    # Self-describing formats bring their own schema; text formats are read with ours.
    rows = (reader if format in ("parquet", "orc") else reader.schema(wanted)).format(format).load(path)
    if missing := [f.name for f in wanted if f.name not in rows.columns]:
        raise ContractError(f"{table} lacks the columns {', '.join(missing)}")
    return rows.select(*(rows[f.name].cast(f.dataType).alias(f.name) for f in wanted))


def write(rows: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists", **options: str) -> None:
    rows.write.format(format).mode(mode).options(**options).save(path)
