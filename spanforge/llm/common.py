"""Helpers shared by the training-data operators."""

import itertools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none (unit tests) a folder in the warehouse is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/spanforge-{uuid.uuid4().hex}"


#: Tables written and not yet emptied, numbered in the order of writing: (application, folder) to number.
WRITTEN: dict[tuple[str, str], int] = {}
_numbers = itertools.count()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts lineage: a lost executor costs the reading task only, never the stages before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    WRITTEN[spark.sparkContext.applicationId, path] = next(_numbers)
    return spark.read.schema(df.schema).parquet(path)


def _empty(spark: SparkSession, path: str) -> None:
    """Frees a written table's disk: an empty one takes its place."""
    spark.range(0).write.mode("overwrite").parquet(path)
    del WRITTEN[spark.sparkContext.applicationId, path]


def discard(df: DataFrame) -> None:
    """Empties a table of ``materialize`` that nothing reads any more."""
    files = {f.rpartition("/")[0] for f in df.inputFiles()}
    for path in since(df.sparkSession, 0):
        if any(f.endswith(path) for f in files):
            _empty(df.sparkSession, path)


def mark(spark: SparkSession) -> int:
    """A number for ``since``: tables written from here on have it or a larger one."""
    return next(_numbers)


def since(spark: SparkSession, before: int) -> list[str]:
    """Tables written after ``mark`` gave ``before`` that were not emptied."""
    app = spark.sparkContext.applicationId
    return [path for (a, path), n in WRITTEN.items() if a == app and n >= before]


def release(spark: SparkSession, paths: list[str], keep: DataFrame) -> None:
    """Empties the tables at ``paths``, but for those that ``keep`` reads."""
    files = {f.rpartition("/")[0] for f in keep.inputFiles()} if paths else set()
    for path in set(paths) & set(since(spark, 0)):
        if not any(f.endswith(path) for f in files):
            _empty(spark, path)


def fitting(df: DataFrame, bound: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``bound`` rows; a larger one is left to a shuffle."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def text_of(col: str | Column = "text") -> Column:
    """A text column with null read as the empty string."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def column(name: str) -> Column:
    """A column by its whole name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, so that extra input columns never clash."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span struct, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
