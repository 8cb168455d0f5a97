"""Files to versioned sources, blocks and chunks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.functions import text as T
from spanforge.operators import structure
from spanforge.sources.html import blocks as html_blocks

#: Versions that are part of a source's identity.
PARSER, CHUNKER = "structural-4-html-layout-tables", "spans-1"
TYPES = {"html": "html", "htm": "html", "txt": "text", "md": "text", "markdown": "text"}


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False)


def source_id(content_hash: str | Column, origin: str | Column, limit: int) -> Column:
    """Digest of content, origin, parser, chunker and chunk limit (SC1, H23)."""
    h, o = T.col(content_hash), T.col(origin)
    return T.digest(F.concat(F.lit(f'{{"chunker": "{CHUNKER}", "hash": "'), h, F.lit(f'", "limit": {limit}, "origin": '), T.json_string(o), F.lit(f', "parser": "{PARSER}"}}')))


def files(spark: SparkSession, path: str, limit: int = 1600) -> DataFrame:
    """Originals under a path with their identity: ``source_id``, ``origin``, ``hash``, ``suffix``, ``content``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    out = raw.select(name.alias("origin"), F.sha2("content", 256).alias("hash"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("suffix"), "content", F.col("modificationTime").alias("acquired_at"))
    return out.select(source_id("hash", "origin", limit).alias("source_id"), "*")


def new_sources(originals: DataFrame, known: DataFrame) -> DataFrame:
    """Sources that are not stored yet; ingesting again adds nothing."""
    return originals.join(known.select("source_id"), "source_id", "left_anti")


def _parse(suffix: str, content: bytes) -> list[tuple[str, str]]:
    kind = TYPES.get(suffix)
    if kind is None:
        raise ValueError(f"no parser for .{suffix}")
    text = content.decode("utf-8")
    if kind == "html":
        found = html_blocks(text)
    else:
        import re

        found = []
        for part in re.split(r"\n\s*\n", text):
            if body := part.strip():
                found.append(("heading" if part.startswith("#") else "table" if part.startswith("|") else "paragraph", body))
    if not found:
        raise ValueError("no readable block")
    return found


def parsed(originals: DataFrame) -> DataFrame:
    """``source_id``, ``block_no``, ``kind``, ``text``, ``error``: blocks, or one row with the error of a source that cannot be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, suffix, content in zip(batch["source_id"], batch["suffix"], batch["content"], strict=True):
                try:
                    rows += [(i, k, kind, text, None) for k, (kind, text) in enumerate(_parse(suffix, bytes(content)))]
                except (UnicodeDecodeError, ValueError) as e:
                    rows.append((i, None, None, None, str(e)))
            out = pd.DataFrame(rows, columns=["source_id", "block_no", "kind", "text", "error"])
            yield out.astype({"block_no": "Int32"})

    return originals.select("source_id", "suffix", "content").mapInPandas(run, "source_id string, block_no int, kind string, text string, error string")


def structured(blocks: DataFrame) -> DataFrame:
    """Blocks with ids, canonical offsets and running section (WN2–WN4)."""
    b = structure.with_offsets(blocks.where("error is null"), "source_id", "block_no", "text")
    b = structure.with_section(b, "source_id", "block_no", "text", F.col("kind") == "heading")
    return structure.numbered(b, "source_id", "block_no")


def canonical_text(blocks: DataFrame) -> DataFrame:
    """``source_id``, ``text``, ``text_hash``: block texts two line feeds apart."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda x: x["text"])
    text = blocks.where("error is null").groupBy("source_id").agg(F.array_join(parts, "\n\n").alias("text"))
    return text.withColumn("text_hash", F.sha2("text", 256))


def validated(sources: DataFrame) -> DataFrame:
    """Sources whose stored text still has its hash; a changed one is an error (SC6)."""
    ok = F.sha2("text", 256) == F.col("text_hash")
    return sources.withColumn("text", F.when(ok, F.col("text")).otherwise(F.raise_error(F.concat(F.lit("source changed: "), F.col("source_id")))))


def with_validity(sources: DataFrame) -> DataFrame:
    """Sources with ``valid``: whether the stored text still has its hash (SC6); a null text or hash has not."""
    return sources.withColumn("valid", F.coalesce(F.sha2("text", 256) == F.col("text_hash"), F.lit(False)))


def open_chunk(chunks: DataFrame, source: str, chunk: str) -> DataFrame:
    """One chunk; an unknown one is an error (SC8). The predicates reach the Parquet scan."""
    found = chunks.where((F.col("source_id") == source) & (F.col("chunk_id") == chunk))
    if found.isEmpty():
        raise ValueError("unknown source or chunk")
    return found


def listed(sources: DataFrame) -> DataFrame:
    """Sources in the order of their ids (SC5)."""
    return sources.orderBy("source_id")


def passages(chunks: DataFrame, key: str = "source_id") -> DataFrame:
    """Chunks with their ``place`` in the order of the source (SC7): by number, not by the text of the id."""
    number = F.regexp_extract("chunk_id", r"(\d+)$", 1).cast("int")
    return chunks.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(number)))


def artifact(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON artifact (SC9), one object or a list of them over several lines; one that does not parse is an error."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def write_artifact(df: DataFrame, path: str) -> None:
    """Writes an artifact once (SK1): whole under the commit protocol, never over another."""
    df.write.mode("errorifexists").json(path)


def events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSONL log; lines that do not parse keep their text in ``unparsed`` (SC10)."""
    return spark.read.schema(f"{schema}, unparsed string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "unparsed").json(path)


def append_events(df: DataFrame, path: str) -> None:
    """Appends events as JSONL (SK2)."""
    df.write.mode("append").json(path)


def fetchable(urls: DataFrame, known: DataFrame, url: str = "url", size: str = "size") -> DataFrame:
    """The rules of fetching as predicates, without a network (SC13): new http(s) URLs without credentials, at most 25 MB."""
    scheme = F.expr(f"try_parse_url({url}, 'PROTOCOL')")
    ok = scheme.isin("http", "https") & F.expr(f"try_parse_url({url}, 'USERINFO')").isNull() & (F.coalesce(size, F.lit(0)) <= 25_000_000)
    return urls.where(ok).join(known.select(url), url, "left_anti")
