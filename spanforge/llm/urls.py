"""Address filter: rules by host and path, and exact membership of hosts in a list by a Bloom filter cascade.

The universe of keys is complete: every host of the corpus, each known to be listed or not. The first
level of a cascade encodes the listed keys, the second those others that the first one takes for listed,
the third the listed ones that pass the second, and so on until a level is empty. The first level that
does not hold a key tells whether it is listed, for every key of the universe and without a join.

Distinct keys are dealt to shards by hash, of ``SHARD_KEYS`` on average, and each shard builds its whole
cascade in one task: one shuffle of hashes, whatever the number of levels, and no group that grows with
the input. The filters of all shards are sent to every task if they have at most ``BROADCAST_BYTES``;
larger ones meet the addresses by shard, each dealt to ``SALTS`` tasks, so that a host that holds a third
of all pages is split.

Defined results: a null address, or one without ``://``, has an empty host and path, and no rule; its
verdict is that of the empty host, which is never listed; rows that repeat are judged one by one; an
empty table gives none; other columns are not read.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StructField, StructType

from .common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Distinct keys of a shard on average.
SHARD_KEYS = 50_000
#: Filters that may be sent to every task.
BROADCAST_BYTES = 32 * 2**20
#: Tasks that the pages of a shard are dealt to where the filters are larger.
SALTS = 16
#: Levels after which keys that are still confused are taken to have equal hashes.
MOST_LEVELS = 60


@dataclass(frozen=True)
class Rule:
    """``verdict`` of a host and its subdomains, where the path begins with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case, and path, of an address; both empty without ``://``."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def split(pages: DataFrame, *keep: str, url: str = "url") -> DataFrame:
    """``keep``, ``host`` and ``path`` of each row."""
    host, path = host_and_path(F.col(url))
    return pages.select(*keep, host.alias("host"), path.alias("path"))


def ruled(rows: DataFrame, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits as a struct (``rule``, ``verdict``), of equal ones that of the longer host; null if none fits.

    ``rules`` is a short list that is stated in the query, not a table.
    """
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    # the longest one is tested first
    for r in sorted(rules, key=lambda r: (len(r.name), len(r.host), r.verdict)):
        fits = ((rows["host"] == r.host) | rows["host"].endswith("." + r.host)) & rows["path"].startswith(r.path)
        chosen = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = h ^ np.uint64((salt + 1) * 0x9E3779B97F4A7C15 % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def places(one: np.ndarray, two: np.ndarray, level: int, k: int, bits: np.ndarray) -> list[np.ndarray]:
    """``k`` bit places of each key in a filter of ``bits`` bits; levels are independent of each other."""
    a, b = _mixed(one, level), _mixed(two, level) | np.uint64(1)
    return [((a + np.uint64(j) * b) % bits.astype(np.uint64)).astype(np.int64) for j in range(k)]


def build(one: np.ndarray, two: np.ndarray, listed: np.ndarray, hashes: int) -> list[tuple[int, np.ndarray]]:
    """Levels of one shard, each its number of bits and the packed bits; ``hashes`` for the first level, one for the others."""
    inside, outside = np.flatnonzero(listed), np.flatnonzero(~listed)
    levels: list[tuple[int, np.ndarray]] = []
    while len(inside):
        if len(levels) == MOST_LEVELS:
            raise ValueError("a listed key and another one have equal hashes")
        k = hashes if not levels else 1
        m = np.full(1, max(8, int(np.ceil(len(inside) * k / np.log(2)))))
        bits = np.zeros(int(m[0]), bool)
        for p in places(one[inside], two[inside], len(levels), k, m):
            bits[p] = True
        held = np.ones(len(outside), bool)
        for p in places(one[outside], two[outside], len(levels), k, m):
            held &= bits[p]
        levels.append((int(m[0]), np.packbits(bits)))
        inside, outside = outside[held], inside
    return levels


class Cascade:
    """Cascades of all shards, asked for many keys at once."""

    def __init__(self, shards: dict[int, tuple[list[int], list[bytes]]], hashes: int) -> None:
        self.hashes = hashes
        self.depth = max((len(m) for m, _ in shards.values()), default=0)
        width = max(shards, default=0) + 1
        self.bits = np.zeros((self.depth + 1, width), np.int64)  # 0 where a shard has no such level
        self.since = np.zeros((self.depth + 1, width), np.int64)
        parts, at = [], 0
        for shard, (sizes, packed) in shards.items():
            for level, (m, b) in enumerate(zip(sizes, packed)):
                self.bits[level, shard], self.since[level, shard] = m, 8 * at
                parts.append(b)
                at += len(b)
        self.packed = np.frombuffer(b"".join(parts), np.uint8)

    def listed(self, shard: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        out = np.zeros(len(shard), bool)
        open_ = np.arange(len(shard))
        for level in range(self.depth + 1):
            m = self.bits[level, shard[open_]]
            held = m > 0
            at = open_[held]
            inside = np.ones(len(at), bool)
            for p in places(one[at], two[at], level, self.hashes if level == 0 else 1, m[held]):
                p = p + self.since[level, shard[at]]
                inside &= (self.packed[p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1).astype(bool)
            held[held] = inside
            out[open_[~held]] = level % 2 == 1
            open_ = open_[held]
        return out


def _hashes(key: str) -> list[Column]:
    return [F.xxhash64(F.lit(1), F.col(key)).alias("one"), F.xxhash64(F.lit(2), F.col(key)).alias("two")]


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


@dataclass(frozen=True)
class Filter:
    """Written cascades of a universe: ``levels`` has ``shard``, ``bits``, ``packed`` a shard."""

    levels: DataFrame
    shards: int
    hashes: int
    size: int

    def shard(self, key: str = "host") -> Column:
        return F.pmod(F.xxhash64(F.lit(3), F.col(key)), F.lit(self.shards)).cast("int")


def cascade(keys: DataFrame, key: str = "host", listed: str = "listed", shard_keys: int = SHARD_KEYS) -> Filter:
    """The filter of distinct ``key`` with the boolean ``listed``."""
    known = materialize(keys.select(key, F.coalesce(F.col(listed), F.lit(False)).alias(listed)), "keys")
    n = known.agg(F.count("*").alias("n"), F.count_if(F.col(listed)).alias("r")).first()
    rest = max(1, n["n"] - n["r"])
    # the share of unlisted keys that the first level takes for listed, best at r / s / sqrt 2 and no worse than a half
    hashes = int(min(20, max(1, round(np.log2(rest * np.sqrt(2) / max(1, n["r"]))))))
    found = Filter(known, max(1, -(-n["n"] // shard_keys)), hashes, 0)
    schema = StructType([StructField("shard", IntegerType()), StructField("bits", ArrayType(LongType())), StructField("packed", ArrayType(BinaryType()))])

    def shard(table: pa.Table) -> pa.Table:
        levels = build(_unsigned(table.column("one").combine_chunks()), _unsigned(table.column("two").combine_chunks()), table.column("listed").to_numpy(), hashes)
        row = {"shard": table.column("shard")[0].as_py(), "bits": [m for m, _ in levels], "packed": [b.tobytes() for _, b in levels]}
        return pa.Table.from_pylist([row], pa.schema([("shard", pa.int32()), ("bits", pa.list_(pa.int64())), ("packed", pa.list_(pa.binary()))]))

    dealt = known.select(found.shard(key).alias("shard"), *_hashes(key), F.col(listed).alias("listed"))
    levels = materialize(dealt.groupBy("shard").applyInArrow(shard, schema), "levels")
    size = levels.select(F.sum(F.aggregate("packed", F.lit(0).cast("bigint"), lambda a, b: a + F.length(b) + 16)).alias("n")).first()["n"]
    return Filter(levels, found.shards, hashes, size or 0)


def member(rows: DataFrame, f: Filter, key: str = "host", name: str = "listed", bound: int = BROADCAST_BYTES) -> DataFrame:
    """``rows`` with the boolean ``name``: whether ``key``, a member of the filter's universe, is listed."""
    from pyspark.sql.pandas.types import to_arrow_schema

    inputs = rows.select(*rows.columns, f.shard(key).alias("__shard"), *(h.alias(f"__{i}") for i, h in enumerate(_hashes(key))))
    schema = StructType([*rows.schema, StructField(name, BooleanType())])
    arrow, width, hashes = to_arrow_schema(schema), len(rows.columns), f.hashes

    def told(batch: pa.RecordBatch, c: Cascade) -> pa.RecordBatch:
        shard = batch.column(width).to_numpy()
        flag = c.listed(shard, _unsigned(batch.column(width + 1)), _unsigned(batch.column(width + 2)))
        return pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(flag)], schema=arrow)

    if f.size <= bound:
        shards = {r["shard"]: (r["bits"], [bytes(b) for b in r["packed"]]) for r in f.levels.collect()}  # of a checked size
        sent = rows.sparkSession.sparkContext.broadcast(Cascade(shards, hashes))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield told(batch, sent.value)

        return inputs.mapInArrow(run, schema)

    salted = inputs.withColumn("__salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    filters = f.levels.select(F.col("shard").alias("__shard"), "bits", "packed", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    both = salted.unionByName(filters, allowMissingColumns=True)
    order = ["__shard", "__salt"]
    ready = both.repartition(*order).sortWithinPartitions(*order, F.col("bits").isNull()).drop("__salt")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: dict[int, Cascade] = {}
        for batch in batches:
            heads = np.flatnonzero(batch.column("bits").is_valid().to_numpy(zero_copy_only=False))
            for a, z in zip([0, *heads], [*heads, batch.num_rows]):
                if a in heads and z > a:  # a shard's filter stands before its rows
                    head = batch.slice(a, 1)
                    shard = head.column(width)[0].as_py()
                    current = {shard: Cascade({shard: (head.column("bits")[0].as_py(), head.column("packed")[0].as_py())}, hashes)}
                    a += 1
                if z > a:
                    yield told(batch.slice(a, z - a), next(iter(current.values())))

    return ready.mapInArrow(walk, schema)


def reputation(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every host of ``pages`` and whether it is listed: rules block more of its pages than they allow."""
    rows = split(pages)
    verdict = ruled(rows, rules)["verdict"]
    votes = F.sum(F.when(verdict == "block", 1).when(verdict == "allow", -1).otherwise(0))
    return rows.groupBy("host").agg(votes.alias("votes")).select("host", (F.col("votes") > 0).alias("listed"))


def judge(pages: DataFrame, hosts: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, key: str = "page_id", bound: int = BROADCAST_BYTES,
          shard_keys: int = SHARD_KEYS) -> DataFrame:
    """``key``, ``host``, ``path``, ``rule``, ``verdict`` and ``listed`` of each page.

    The longest rule decides; without one, whether the host is listed in ``hosts`` (``host``, ``listed``;
    every host of ``pages`` once), by default their reputation.
    """
    f = cascade(reputation(pages, rules) if hosts is None else hosts, shard_keys=shard_keys)
    rows = split(pages, key)
    found = member(rows.withColumn("rule", ruled(rows, rules)), f, bound=bound)
    verdict = F.coalesce(F.col("rule.verdict"), F.when(F.col("listed"), "block").otherwise("allow"))
    return found.select(key, "host", "path", F.col("rule.rule").alias("rule"), verdict.alias("verdict"), "listed")
