"""Log files as lines, and the catalog of files."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
DEFAULT_LOG_DIR = "/var/log/nginx"
PLAIN_PATTERN = r"\.log(\.\d+)?$"
COMPRESSED_PATTERN = r"\.gz$"
ERROR_MARK = "error"
# --- end of fixed values ----------------------------------------------------


def _lines(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """``value, source_file`` of every line that is not blank.

    Lines end at a newline only, as in the logs; a stray carriage return does not
    cut one. Compressed files are inflated by the reader, one task per file.
    """
    reader = spark.read.option("lineSep", "\n")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    rows = reader.text(paths).select("value", F.col("_metadata.file_name").alias("source_file"))
    return rows.where(F.col("value").rlike(r"\S"))


def is_error_file(name: Column) -> Column:
    return name.contains(ERROR_MARK)


def read_log_dir(
    spark: SparkSession, path: str, kind: str = "access", include_compressed: bool = True
) -> DataFrame:
    """Lines of the access or error logs of one folder, sub-folders left out.

    Takes ``.log``, ``.log.<digits>`` and, if wanted, ``.gz`` files; a name that
    contains ``error`` makes an error log. The name filter prunes files before they
    are read. One task inflates a ``.gz`` file; its lines are then dealt out anew, in
    parts of a useful size, so that parsing is not left to that task.
    """
    name = F.col("source_file")
    of_kind = is_error_file(name) if kind == "error" else ~is_error_file(name)
    rows = _lines(spark, path, "*.{log,log.[0-9]*}").where(name.rlike(PLAIN_PATTERN) & of_kind)
    if not include_compressed:
        return rows
    packed = _lines(spark, path, "*.gz").where(name.rlike(COMPRESSED_PATTERN) & of_kind)
    return rows.unionByName(packed.hint("rebalance"))


def read_log_file(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path)


def read_named_files(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(access lines, error lines) of the given files, told apart by name."""
    lines = _lines(spark, paths)
    error = is_error_file(F.col("source_file"))
    return lines.where(~error), lines.where(error)


def is_folder(path: str) -> bool:
    """Whether a path is a folder, as its file system says; a path that does not exist counts as one if it has no extension."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if system.exists(at):
            return system.getFileStatus(at).isDirectory()
    elif os.path.exists(path):
        return os.path.isdir(path)
    return not os.path.splitext(path.rstrip("/"))[1]


def log_location(access_path: str | None = None, error_path: str | None = None, kind: str = "access") -> str:
    """Path to read for a kind of log: its own, else the other one if that is a folder, else the default."""
    own, other = (access_path, error_path) if kind == "access" else (error_path, access_path)
    if own:
        return own
    return other if other and is_folder(other) else DEFAULT_LOG_DIR


def log_file_catalog(spark: SparkSession, path: str) -> DataFrame:
    """``name, size, extension`` of the files of a folder or of one file; contents are not read."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        name.alias("name"), "size", F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("extension")
    )
