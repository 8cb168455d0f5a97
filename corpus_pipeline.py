"""The corpus pipeline: from raw documents to a deduplicated, clean, weighted mix.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, in the columns of ``docs``; the
last adds the mix. ``run`` writes each stage's rows to the shared folder and reads them for the next.
A stage's rows are to be written before the next stage is called: that empties the intermediate
tables of the stages before, so that the disk holds those of one stage only.

In every stage null and empty texts are texts without words, null ids and repeated ids are told
apart by their texts, an empty table gives an empty table, and extra columns are carried along
under whatever names they have.
"""

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import decontaminate, mixing, near_dup, quality, secrets
from spanforge.llm.common import discard, fitting, free_name, mark, materialize, read, release, since, text_of

#: Rows that may be broadcast: contaminated ones, of 50 bytes each.
BROADCAST_ROWS = 500_000
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: dict[str, list[str]] = {}


def staged(stage: Stage) -> Stage:
    """Empties the tables that earlier stages left, unless ``docs`` reads them, and notes those of this one."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        release(spark, _left.pop(app, []), docs)
        before = mark(spark)
        out = stage(spark, docs, sf_dir)
        _left[app] = since(spark, before)
        return out

    return run_stage


@staged
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, rows alike alike; all of them where no label lets it learn."""
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return docs if model is None else docs.where(quality.score(text_of(), model) >= quality.THRESHOLD)


@staged
def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, of the smallest id in it; all texts without words."""
    return near_dup.keep(docs)


@staged
def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark, word for word or with other values; all if it is empty."""
    key, there, seen = (free_name(docs, n) for n in ("key", "there", "seen"))
    # rows that share an id, or have none, are told apart by their texts
    digest = F.md5(text_of().cast("binary"))
    rows = docs.select(F.struct("doc_id", digest.alias("digest")).alias(key), "text")
    bad = decontaminate.contaminated(rows, read(spark, sf_dir, "benchmark"), key=key)
    bad = materialize(bad.select(F.col(key)["doc_id"].alias(there), F.col(key)["digest"].alias(seen)).distinct(), "contaminated")
    # the texts are not shuffled where the rows to drop are few
    return docs.join(fitting(bad, BROADCAST_ROWS), (digest == F.col(seen)) & F.col("doc_id").eqNullSafe(F.col(there)), "left_anti")


@staged
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret of their texts replaced and ``n_chars`` counted anew; null texts stay null."""
    found = free_name(docs, "found")
    marked = docs.withColumn(found, secrets.find(text_of(), secrets.fit(docs)))
    spans = F.array_sort(F.concat(F.col(found)["base"], F.col(found)["more"]), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))
    marked = marked.withColumn(found, spans)
    some = F.size(found) > 0
    clean = marked.withColumn("text", F.when(some, secrets.redact(F.col("text"), F.col(found))).otherwise(F.col("text")))
    counted = clean.withColumn("n_chars", F.when(some, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return counted.select(*(f"`{c}`" for c in docs.columns))


@staged
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the number of its copies in the mix; no source is cut, none repeats more than 4 times."""
    return mixing.mixed(docs, mixing.Mix(budget=None, entropy=0.97, repeats=4.0))


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", keep_one_of_each),
    ("benchmark decontamination", drop_benchmark),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
]

#: A trained classifier and a randomness battery are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs, before = materialize(stage(spark, docs, sf_dir), f"stage{i}"), docs
        if i:
            discard(before)
    return docs
