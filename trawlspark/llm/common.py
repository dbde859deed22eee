"""Helpers that the corpus operators share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlspark.plans.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where a session on one machine has none (tests) a temporary folder is made and set; on a cluster that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not where:
        held = sc._jsc.sc().getCheckpointDir()
        where = held.get() if held.isDefined() else None
    if not where:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="trawlspark-")
        sc.setCheckpointDir(where)
    elif not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(where)
    return where


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path below the shared folder that nothing has used."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def local_path(path: str) -> str:
    """A shared folder's path as the operating system has it; it must be mounted on every executor."""
    if path.startswith("file:"):
        path = path[5:]
        return "/" + path.lstrip("/")
    if "://" in path:
        raise ValueError(f"{path}: the shared folder must be mounted (file:) for this operator")
    return path


#: In a mounted folder a file takes one process (chmod, of its folder), not five: while a process starts, an executor's memory counts twice.
_RAW = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, what)
    df.write.options(**_RAW).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_STABLE = {"Project", "Filter", "Relation", "RelationV2", "LogicalRDD", "LocalRelation", "SubqueryAlias"}


def numberable(df: DataFrame) -> DataFrame:
    """df, or a written copy, whose rows monotonically_increasing_id() numbers alike in every plan.

    That holds for rows straight from files; behind a shuffle the order may depend on the columns that
    a plan needs.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = {x.group(0) for x in (re.search(r"[A-Za-z]\w*", line) for line in plan.splitlines()) if x}
    return df if nodes <= _STABLE else written(df, "numbered")


def doc_fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of doc_id as text, modulo folds; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


@contextmanager
def arrow_batches(spark: SparkSession, rows: int):
    """Within it, what is run hands Python batches of so many rows: for rows of many bytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, held)


def map_lists(df: DataFrame, make: Callable[[], Callable[..., Iterable]], schema: str) -> DataFrame:
    """Apply to each Arrow batch a function from the columns, as lists, to the output columns.

    make() runs once in each task and returns that function, so that models load once.
    """
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches):
        f = make()
        for b in batches:
            out = f(*(c.to_pylist() for c in b.columns))
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(out, arrow)], schema=arrow
            )

    return df.mapInArrow(run, schema)


def filtered(df: DataFrame, run: Callable) -> DataFrame:
    """df.mapInArrow(run) for a run that only drops rows, whatever the columns' names are."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


os.environ.setdefault("PYARROW_IGNORE_TIMEZONE", "1")
