"""Reading and writing stage tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.operators.ordering import with_position

# comments hold line breaks and doubled quotes
CSV_OPTIONS = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}


def read_comments(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read a stage table; ``.csv`` files need the declared ``schema``, Parquet carries its own.

    Comments hold line breaks, so a CSV file cannot be split: one task reads each file, whatever its
    size.  Convert large files once with :func:`convert_csv` and read the Parquet table from then on.
    """
    path = current_version(spark, path)
    if path.rstrip("/").endswith(".csv"):
        if schema is None:
            raise ValueError("a CSV table needs a schema")
        return spark.read.schema(schema).options(**CSV_OPTIONS).csv(path)
    table = spark.read.parquet(path)
    if schema is None:
        return table
    return table.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def convert_csv(spark: SparkSession, csv_path: str, parquet_path: str, schema: T.StructType) -> DataFrame:
    """Turn a CSV table into a Parquet table of the same rows, once, and return that.

    Malformed lines fail the conversion, and so does a Parquet table that does not hold as many rows as were read.
    """
    rows = spark.read.schema(schema).options(**CSV_OPTIONS, mode="FAILFAST").csv(csv_path)
    read = rows.agg(F.count(F.struct(*rows.columns)).alias("n")).first()["n"]  # all columns, or lines are not parsed whole
    rows.write.mode("errorifexists").parquet(parquet_path)
    table = spark.read.parquet(parquet_path)
    written = table.count()
    if written != read:
        raise OSError(f"{csv_path} has {read} rows, {parquet_path} {written}")
    return table


def _hadoop_path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    target, files = _hadoop_path(spark, path)
    return bool(files.exists(target))


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The stored table, or an empty one of the same shape before the first run."""
    if path_exists(spark, current_version(spark, path)):
        return read_comments(spark, path, schema)
    return spark.createDataFrame([], schema)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a table; an overwritten stage that has versions gets a new one."""
    if mode == "overwrite" and _numbers(df.sparkSession, path, MARK):
        rewrite_stage(df, path)
        return
    path = current_version(df.sparkSession, path)
    writer = df.write.mode(mode)
    if path.rstrip("/").endswith(".csv"):
        writer.options(header=True, quote='"', escape='"').csv(path)
    else:
        writer.parquet(path)


def with_row_id(df: DataFrame, order_by: list[str], start: int = 0) -> DataFrame:
    """Sequential ids from ``start`` in the given order, without a single-task window."""
    return with_position(df, order_by, "id", start)


# A stage that was rewritten keeps its versions beside it, in ``<path>.stage``: ``v-<n>`` holds version n, the empty
# file ``claim-<n>`` reserves the number, and the empty file ``current-<n>`` makes it the one that is read.
CLAIM, MARK, VERSION = "claim-", "current-", "v-"


def _stage_folder(path: str) -> str:
    return path.rstrip("/") + ".stage"


def _numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    folder, files = _hadoop_path(spark, _stage_folder(path))
    if not files.exists(folder):
        return []
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    return sorted(int(name[len(kind) :].split(".")[0]) for name in names if name.startswith(kind))


def _version_path(path: str, number: int) -> str:
    suffix = ".csv" if path.rstrip("/").endswith(".csv") else ""
    return f"{_stage_folder(path)}/{VERSION}{number:06d}{suffix}"


def current_version(spark: SparkSession, path: str) -> str:
    """Where the rows of a stage are: its newest marked version, or ``path`` itself if it was never rewritten."""
    marked = _numbers(spark, path, MARK)
    return _version_path(path, marked[-1]) if marked else path


def _claim(spark: SparkSession, path: str) -> int:
    """A version number of one's own; creating the file fails if another writer has it."""
    number = max([0, *_numbers(spark, path, CLAIM), *_numbers(spark, path, MARK)]) + 1
    while True:
        target, files = _hadoop_path(spark, f"{_stage_folder(path)}/{CLAIM}{number:06d}")
        if files.createNewFile(target):
            return number
        number += 1


def _mark(spark: SparkSession, path: str, number: int) -> None:
    """From here on readers get this version: one file appears, which no file system does by halves."""
    target, files = _hadoop_path(spark, f"{_stage_folder(path)}/{MARK}{number:06d}")
    files.createNewFile(target)


def _prune(spark: SparkSession, path: str, keep: int) -> None:
    """Drop what is older than the ``keep`` newest versions, the table at ``path`` itself included."""
    marked = _numbers(spark, path, MARK)
    if len(marked) < keep:
        return
    oldest = marked[-keep]
    for number in sorted({*_numbers(spark, path, CLAIM), *marked, *_numbers(spark, path, VERSION)}):
        if number < oldest:
            # the mark goes first: a version that is half deleted is never the newest anyway
            for name in (f"{_stage_folder(path)}/{MARK}{number:06d}", _version_path(path, number), f"{_stage_folder(path)}/{CLAIM}{number:06d}"):
                target, files = _hadoop_path(spark, name)
                files.delete(target, True)
    target, files = _hadoop_path(spark, path)
    if files.exists(target):
        files.delete(target, True)


def rewrite_stage(df: DataFrame, path: str, keep: int = 2) -> DataFrame:
    """Replace the table that ``df`` was read from and return the new table.

    The result becomes a version of its own, complete before an empty file makes it the current one, so
    at every moment, also after a crash at any step, :func:`read_comments` finds one whole table.  Two
    writers never share a version; the higher number wins.  The ``keep`` newest versions stay for
    readers that have begun; older ones, and what crashed writers left below them, are deleted.
    """
    if keep < 2:
        raise ValueError("the version that is being read must be kept beside the new one")
    spark = df.sparkSession
    number = _claim(spark, path)
    fresh = _version_path(path, number)
    if path.rstrip("/").endswith(".csv"):
        df.write.options(header=True, quote='"', escape='"').csv(fresh)
    else:
        df.write.parquet(fresh)
    _mark(spark, path, number)
    _prune(spark, path, keep)
    if path.rstrip("/").endswith(".csv"):
        return spark.read.schema(df.schema).options(**CSV_OPTIONS).csv(fresh)
    return spark.read.parquet(fresh)
