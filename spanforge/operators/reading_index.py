"""Reading windows kept between searches (CP6), by source, version and window.

A source's version is the digest of its chunks. A refresh compares versions, and builds the windows of
sources that are new or changed only; those of sources that are gone go. The index is a durable table, so a
refresh that fails leaves the index before it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from spanforge.operators import reading
from spanforge.sources import publishing
from spanforge.sources.durable import Durable
from spanforge.sources.tables import shared, written


@dataclass(frozen=True)
class Window:
    """Characters that a window may hold, and groups on either side of the focus."""

    characters: int = 8000
    reach: int = 1

    @property
    def name(self) -> str:
        return f"{self.characters}-{self.reach}"


def index_at(spark: SparkSession, path: str, source: StructField, window: Window) -> Durable:
    """The index of one window size at ``path``, whose sources are of the type of ``source``."""
    ints = ArrayType(IntegerType())
    fields = [StructField("version", StringType()), StructField("focus_no", IntegerType()), StructField("units", ints), StructField("status", StringType())]
    return Durable(spark, f"{path}/window-{window.name}", "source_id", StructType([StructField("source_id", source.dataType), *fields]))


def versions(units: DataFrame) -> DataFrame:
    """``source_id``, ``version``: digest of a source's units, as a tree."""
    leaf = publishing.row_digest(units.select("unit_no", "group_no", "start_at", "end_at", "unit_text"))
    return publishing.digest_tree(units.select("source_id", leaf.alias("leaf")), "source_id").select("source_id", F.col("digest").alias("version"))


def refresh(units: DataFrame, path: str, window: Window = Window()) -> tuple[Durable, DataFrame]:
    """Brings the index up to ``units`` (source_id, unit_no, group_no, start_at, end_at, unit_text).

    Returns it, and the sources whose windows were built or removed: ``source_id``, ``version`` (null for one that is gone).
    """
    spark = units.sparkSession
    index = index_at(spark, path, units.schema["source_id"], window)
    held = index.rows().select("source_id", F.col("version").alias("held")).distinct()
    now = versions(units)
    both = now.join(held, "source_id", "full_outer").where(~F.col("version").eqNullSafe(F.col("held")))
    changed = written(both.select("source_id", "version"), shared(spark))

    def merge(old: DataFrame) -> DataFrame:
        some = units.join(changed.where("version is not null").select("source_id"), "source_id", "left_semi")
        focus = some.select(F.struct("source_id", "unit_no").alias("focus_id"), "source_id", F.col("unit_no").alias("focus_no"))
        built = reading.windows(some, focus, "source_id", window.characters, window.reach)
        new = built.join(changed, "source_id").select("source_id", "version", "focus_no", "units", "status")
        return old.join(changed.select("source_id"), "source_id", "left_anti").unionByName(new)

    index.upsert(changed, merge)
    return index, changed
