"""Table schemas, readers and writers.

Facts are read as strings and converted by ``functions.cleaning``; schemas are never
inferred. Derived tables are written with overwrite, so a rerun replaces them.
"""

from __future__ import annotations

import atexit
import contextlib
import functools
import os
import re
import tempfile
import uuid
from collections.abc import Mapping, Sequence

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegralType, StringType, StructType

from perexpo.functions.cleaning import clean_int, to_double

SITE_SCHEMA = "site_id BIGINT, site_name STRING, lat DOUBLE, lon DOUBLE"
INCIDENT_SCHEMA = "dt STRING, tm STRING, name STRING, lat DOUBLE, lon DOUBLE, district INT"
EXPOSURE_SCHEMA = (
    "ts STRING, site_id BIGINT, site_name STRING, region STRING, lat DOUBLE, lon DOUBLE, exposure BIGINT"
)
ZONE_ATTRIBUTE_SCHEMA = "geo_id STRING, name STRING, value STRING"
ZONE_SCHEMA = "zone_id STRING, rings ARRAY<ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>>"
DECISION_SCHEMA = (
    "seq BIGINT, name STRING, lat_e5 BIGINT, lon_e5 BIGINT, status STRING, "
    "override_site_id BIGINT, override_site_name STRING, reason STRING"
)
REVIEW_SCHEMA = (
    "name STRING, lat_e5 BIGINT, lon_e5 BIGINT, incidents BIGINT, site_name STRING, "
    "site_id BIGINT, distance_miles DOUBLE, status STRING, reason STRING"
)
CROSSWALK_SCHEMA = (
    "name STRING, lat_e5 BIGINT, lon_e5 BIGINT, incidents BIGINT, site_name STRING, "
    "site_id BIGINT, match_status STRING"
)


def _struct(schema: str | StructType) -> StructType:
    return StructType.fromDDL(schema) if isinstance(schema, str) else schema


def empty(spark: SparkSession, schema: str | StructType) -> DataFrame:
    """Declared table without rows."""
    return spark.createDataFrame([], _struct(schema))


#: How a CSV file holds NULL, so that it differs from an empty text.
NULL_MARK = "\\N"
_CSV = {
    "header": True,
    "escape": '"',
    "nullValue": NULL_MARK,
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


#: Lies in a folder of CSV files none of whose values holds a line end.
_SINGLE_LINE = "_single_line"
_LINE_END = r"[\n\r]"


def _in_folder(spark: SparkSession, path: str, name: str) -> tuple:
    """A file below a path, and the file system that holds it."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path, name)
    return file, file.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _multi_line(spark: SparkSession, path: str, multi_line: bool | None) -> bool:
    if multi_line is not None:
        return multi_line
    file, files = _in_folder(spark, path, _SINGLE_LINE)
    return not files.exists(file)


def read_csv(
    spark: SparkSession, path: str, schema: str | StructType, null: str = NULL_MARK, multi_line: bool | None = None
) -> DataFrame:
    """CSV with a header row and a declared schema; a header or a value that does not fit is an error.

    Where values may hold line ends, a file is read by one task. Files without are split among
    tasks: those that ``write_csv`` found to have none, and all others on request (``multi_line=False``);
    a line that ends inside a value is an error then, because it has too few values.
    """
    return (
        spark.read.schema(_struct(schema))
        .options(**_CSV | {"nullValue": null})
        .option("enforceSchema", False)
        .option("multiLine", _multi_line(spark, path, multi_line))
        .option("mode", "FAILFAST")
        .csv(path)
    )


def read_raw(spark: SparkSession, path: str, fmt: str = "parquet", multi_line: bool | None = None) -> DataFrame:
    """Any table as text, with lower-case column names; types are decided by the caller.

    ``multi_line`` is for CSV, as in ``read_csv``.
    """
    if fmt == "csv":
        several = _multi_line(spark, path, multi_line)
        df = spark.read.options(**_CSV).option("multiLine", several).option("mode", "PERMISSIVE" if several else "FAILFAST").csv(path)
    else:
        df = spark.read.format(fmt).load(path)
    return df.select([F.col(f"`{c}`").cast("string").alias(c.lower()) for c in df.columns])


def ingest(
    raw: DataFrame,
    schema: str | StructType,
    names: Mapping[str, str] | None = None,
    optional: Sequence[str] = (),
) -> DataFrame:
    """A raw table of texts as the columns that the analysis takes, each converted once.

    ``names`` gives the raw name of a column where it differs; case does not matter. Whole
    numbers may have separators or a decimal point. Text that cannot be read is NULL, which
    ``profiling.unreadable`` counts. A column that the raw table lacks is an error, or NULL if
    it is optional.
    """
    present = {c.lower(): c for c in raw.columns}
    out = []
    for field in _struct(schema).fields:
        own = present.get((names or {}).get(field.name, field.name).lower())
        kind = field.dataType
        if own is None:
            if field.name not in optional:
                raise ValueError(f"the raw table has no column for {field.name}")
            value = F.lit(None).cast(kind)
        elif isinstance(kind, IntegralType):
            value = clean_int(F.col(f"`{own}`")).cast(kind)
        elif isinstance(kind, DoubleType):
            value = to_double(F.col(f"`{own}`"))
        else:
            value = F.col(f"`{own}`").cast(kind)
        out.append(value.alias(field.name))
    return raw.select(out)


def write_csv(df: DataFrame, path: str) -> str:
    """CSV with a header; every value comes back as it was.

    All values are quoted and quotes inside them doubled. A text that equals the mark for
    NULL is an error.
    """
    marks = [F.col(f"`{f.name}`") == NULL_MARK for f in df.schema.fields if f.dataType == StringType()]
    for name, mark in zip([f.name for f in df.schema.fields if f.dataType == StringType()], marks, strict=True):
        refused = F.raise_error(F.lit(f"a value of {name} is the mark for NULL")).cast("string")
        df = df.withColumn(name, F.when(mark, refused).otherwise(F.col(f"`{name}`")))
    ends = [F.col(f"`{f.name}`").rlike(_LINE_END) for f in df.schema.fields if f.dataType == StringType()]
    seen = Observation("csv line ends")
    broken = F.count_if(functools.reduce(Column.__or__, [F.coalesce(e, F.lit(False)) for e in ends], F.lit(False)))
    df.observe(seen, broken.alias("broken")).write.mode("overwrite").options(**_CSV).option("quoteAll", True).csv(path)
    if not seen.get.get("broken"):
        file, files = _in_folder(df.sparkSession, path, _SINGLE_LINE)
        files.create(file, True).close()
    return path


def save(df: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Replace the table at ``path`` and return it as read back."""
    df.write.mode("overwrite").format(fmt).save(path)
    return df.sparkSession.read.schema(df.schema).format(fmt).load(path)


def append(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Add rows; a repeated call adds them again. ``append_batch`` does not."""
    df.write.mode("append").format(fmt).save(path)


def save_partitioned(df: DataFrame, path: str, by: Sequence[str]) -> DataFrame:
    """Replace the table at ``path``, one folder for each value of ``by``, and return it as read back.

    Rows of a value meet in few files, but a value with many rows is dealt to as many tasks as its size asks for.
    """
    df.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).parquet(path)
    return read_partitioned(df.sparkSession, path, df.schema)


def replace_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replace those partitions of the table at ``path`` of which ``df`` has rows; the others stay.

    ``df`` may not read from ``path``. A repeated call changes nothing more.
    """
    df.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read_partitioned(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Table with partition folders; a filter on a partition column reads only the folders it needs."""
    return spark.read.schema(_struct(schema)).parquet(path)


def drop_partition(spark: SparkSession, path: str, folder: str) -> None:
    """Remove the rows of one partition, named by its folder (``column=value``)."""
    file, files = _in_folder(spark, path, folder)
    files.delete(file, True)


_BATCH_ID = re.compile(r"[A-Za-z0-9_.-]+")


def append_batch(df: DataFrame, path: str, batch_id: str, column: str = "batch_id") -> None:
    """Add the rows of a batch, or replace them if the batch is there already.

    A batch has a folder of its own, so a retry after a failure, or a corrected batch with
    fewer rows or none, never leaves rows of the first attempt behind or doubles any.
    """
    if not _BATCH_ID.fullmatch(batch_id):
        raise ValueError("a batch id is made of letters, digits, '_', '.' and '-'")
    df.drop(column).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{column}={batch_id}")


def read_batches(spark: SparkSession, path: str, schema: str | StructType, column: str = "batch_id") -> DataFrame:
    """All batches of a table with the id of their batch, or no rows if there is none yet."""
    full = StructType([f for f in _struct(schema).fields if f.name != column]).add(column, StringType())
    file, files = _in_folder(spark, path, ".")
    return spark.read.schema(full).parquet(path) if files.exists(file) else empty(spark, full)


def publish_view(df: DataFrame, name: str) -> DataFrame:
    """Session-scoped name for a result that SQL should see."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def load_decisions(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Reviewed decisions kept as a table instead of literals in a script."""
    if fmt == "csv":
        return read_csv(spark, path, DECISION_SCHEMA)
    return spark.read.schema(_struct(DECISION_SCHEMA)).format(fmt).load(path)


def _checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder of the session or of its context."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get() if found.isDefined() else None


def scratch_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables of this application, below the shared checkpoint folder.

    Only a local session without such a folder gets a temporary one of its own; on a cluster a
    machine-local folder would not be seen by the other executors. ``clear_scratch`` removes
    it, and runs by itself when the program ends.
    """
    app = f"perexpo-{spark.sparkContext.applicationId}"
    shared = _checkpoint_dir(spark)
    if shared:
        path = f"{shared.rstrip('/')}/{app}"
    elif spark.sparkContext.master.startswith("local"):
        path = os.path.join(tempfile.gettempdir(), app)
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if path not in _SCRATCH:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        _SCRATCH[path] = folder, folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        if len(_SCRATCH) == 1:
            atexit.register(_clear_all)
    return path


#: Scratch folders in use: the folder and its file system, which outlive the session.
_SCRATCH: dict[str, tuple] = {}


def clear_scratch(spark: SparkSession) -> None:
    """Remove the intermediate tables of this application; results that were not saved go with them."""
    folder, files = _SCRATCH.pop(scratch_dir(spark))
    files.delete(folder, True)


def _clear_all() -> None:
    while _SCRATCH:
        _, (folder, files) = _SCRATCH.popitem()
        with contextlib.suppress(Py4JError, OSError):  # the JVM may have gone before
            files.delete(folder, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write an intermediate that several later steps read, and continue from the files.

    Cuts the lineage, survives the loss of executors, and gives the planner the real size
    of the data, so that joins are broadcast only when the measured size allows it.
    """
    return save(df, scratch_path(df.sparkSession, name))
