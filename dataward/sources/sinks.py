"""Writers: versioned snapshots, range-wise rollups, registers and statement files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_snapshot(df: DataFrame, root: str, version: int) -> str:
    """Write one version of a state to its own folder; a version is never written twice."""
    path = f"{root}/version={version:012d}"
    df.write.mode("errorifexists").parquet(path)
    return path


def overwrite_range(rollup: DataFrame, path: str) -> None:
    """Write whole days of the rollup, replacing all rows of the days that ``rollup`` holds.

    For one meter or some hours use ``replace_range``, which leaves all others as they are.
    """
    days = rollup.withColumn("period_date", F.to_date("period_start"))
    days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period_date").parquet(path)


def replace_range(rollup: DataFrame, path: str, component: str, tenant_id: str, meter_name: str, start, end) -> None:
    """Replace the hours in ``[start, end)`` of one meter of one tenant by ``rollup``, and nothing else.

    The days that the range touches are written to a folder beside the table first, with all their other
    rows, and then take the place of the old ones; hours without a new row end empty.
    """
    spark = rollup.sparkSession
    key = ((F.col("component") == component) & (F.col("tenant_id") == tenant_id) & (F.col("meter_name") == meter_name)
           & (F.col("period_start") >= F.lit(start).cast("timestamp_ntz")) & (F.col("period_start") < F.lit(end).cast("timestamp_ntz")))
    stored = spark.read.parquet(path)
    days = (F.col("period_date") >= F.to_date(F.lit(start))) & (F.col("period_date") <= F.to_date(F.lit(end)))
    fresh = rollup.where(key).withColumn("period_date", F.to_date("period_start"))
    staging = f"{path.rstrip('/')}-staging-{uuid.uuid4().hex}"
    # A day that loses its last row keeps a mark without a meter, so that its old files are replaced as well.
    emptied = stored.where(days).select("period_date").distinct().select(
        *[F.col(c) if c == "period_date" else F.lit(None).cast(stored.schema[c].dataType).alias(c) for c in stored.columns])
    rest = stored.where(days & ~F.coalesce(key, F.lit(False)) & F.col("meter_name").isNotNull())
    rest.unionByName(fresh.select(*stored.columns)).unionByName(emptied).write.parquet(staging)
    spark.read.schema(stored.schema).parquet(staging).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("period_date").parquet(path)


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    """The stored rollup rows, without the marks of emptied days."""
    return spark.read.parquet(path).where(F.col("meter_name").isNotNull())


def to_register_csv(df: DataFrame, path: str) -> None:
    """CSV with array, map and struct cells as JSON."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    cols = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields]
    df.select(*cols).write.option("header", True).option("quote", '"').option("escape", '"').mode("errorifexists").csv(path)


def _escape(col: Column) -> Column:
    for a, b in (("\\\\", "\\\\\\\\"), ('"', '\\\\"'), ("\n", "\\\\n"), ("\r", "\\\\r"), ("\t", "\\\\t")):
        col = F.regexp_replace(col, a, b)
    return col


def ntriples(q: DataFrame, default_graph: str = "default") -> DataFrame:
    """Statement lines; any other graph than the default one fails the write."""
    node = lambda kind, v: F.when(F.col(kind) == "iri", F.concat(F.lit("<"), v, F.lit(">"))).otherwise(F.concat(F.lit("_:"), v))
    literal = F.concat(F.lit('"'), _escape(F.col("o")), F.lit('"'), F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), "lang"))
                       .when(F.col("datatype").isNotNull(), F.concat(F.lit("^^<"), "datatype", F.lit(">"))).otherwise(""))
    line = F.concat(node("s_kind", F.col("s")), F.lit(" <"), F.col("p"), F.lit("> "), F.when(F.col("o_kind") == "literal", literal).otherwise(node("o_kind", F.col("o"))), F.lit(" ."))
    named = F.col("graph") != default_graph
    return q.select(F.when(named, F.raise_error(F.lit("only the default graph can be written as N-Triples")).cast("string")).otherwise(line).alias("value"))


def write_ntriples(q: DataFrame, path: str, default_graph: str = "default") -> None:
    ntriples(q, default_graph).write.mode("errorifexists").text(path)
