"""Tables kept between the stages of a job, in the folder all executors share."""

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_scope: ContextVar[list[str] | None] = ContextVar("kept_tables", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, else one in the warehouse, which executors share as well."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/listforge-kept"


def _in_file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    files, target = _in_file_system(spark, path)
    return files.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system holds it."""
    files, target = _in_file_system(spark, path)
    files.delete(target, True)


def create(spark: SparkSession, path: str) -> bool:
    """Make an empty file; False if it is there already. File systems make it for one caller only."""
    files, target = _in_file_system(spark, path)
    files.mkdirs(target.getParent())
    try:
        files.create(target, False).close()
    except Py4JJavaError as e:
        if files.exists(target):
            return False
        raise OSError(f"cannot write {path}") from e
    return True


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the files in a folder, none if there is no such folder."""
    files, target = _in_file_system(spark, path)
    return [f.getPath().getName() for f in files.listStatus(target)] if files.exists(target) else []


def size_in(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a folder."""
    files, target = _in_file_system(spark, path)
    return files.getContentSummary(target).getLength()


@contextmanager
def kept_tables(spark: SparkSession) -> Iterator[None]:
    """Tables kept inside the block are removed at its end.

    For a job or a micro-batch whose sink has committed by then. Tables kept outside such a block stay until
    the folder's retention rule takes them.
    """
    paths: list[str] = []
    token = _scope.set(paths)
    try:
        yield
    finally:
        _scope.reset(token)
        for path in paths:
            remove(spark, path)


def keep(df: DataFrame, label: str = "stage", **options) -> DataFrame:
    """Write ``df`` once, with the writer's ``options``, and go on from the written table.

    This cuts the lineage, so a lost executor costs a re-read and not a re-run, and it
    pins row order and partition numbers that a second evaluation might change.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/listforge/{label}-{uuid.uuid4().hex}"
    paths = _scope.get()
    if paths is not None:
        paths.append(path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
