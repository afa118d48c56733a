"""Queries of this subpackage and, where SQL can say the same, their equivalent SQL text."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tablecraft.session import ensure_checkpoint_dir, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, its scan dealt over the cores where it has few splits."""
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def widened(schema: StructType, ddl: str) -> StructType:
    """The schema with further columns behind its own."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """The rows, written once as Parquet into the shared folder and read back: lineage ends there, texts stay compressed."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front until no column of ``df`` has them in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def quoted(names: list[str]) -> list[str]:
    """Column names as they can be selected, whatever letters they hold."""
    return ["`" + name.replace("`", "``") + "`" for name in names]


def map_batches(df: DataFrame, run: Callable, schema: StructType) -> DataFrame:
    """``mapInArrow`` for columns of any name: the function gets them under numbers, the schema names what it gives."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(run, schema)
