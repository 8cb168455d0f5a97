"""Near duplicates by HyperMinHash, with every link confirmed on full shingle sets.

A document's hashed shingle set is split into buckets of the hash range; a bucket's register keeps
the leading-zero count of its smallest hash and the mantissa bits after it. A small set would leave
most registers empty, and bands of empty registers say nothing; so each shingle of it counts as
``COPIES`` elements, which leaves Jaccard similarity as it is. The number of copies goes by size
class, and a set near the lower end of a class has registers of the class below as well, so that
any two sets of likeness 0.75 have registers of one class in common.

Documents of one set are one node from then on, with a key of its own in a written table, so that
rows which share an id or have none are told apart by their sets. Bands of ``ROWS`` registers are
hashed to keys; documents that share a key are a bucket. A bucket is not paired out. First each
node is compared with one other, the smallest that shares a bucket with it: a Jaccard estimate of
the registers, corrected for chance collisions and with a margin of ``SIGMAS`` deviations, then the
full sets. Confirmed links are contracted. Buckets that still hold several components are then
settled in blocks, by products of incidence matrices of shingles: of the pairs that pass, those that
would join two trees of the block are confirmed on the full sets, which lie in the block, so that it
hands on a spanning forest of links and no more rows than it has members.

A pair of likeness 0.75 shares none of 48 bands of 4 with a chance of about 1e-8.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .common import discard, fitting, free_name, mark, materialize, release, since, text_of
from .components import components

WORDS, THRESHOLD = 5, 75  # shingle length; least 100 * J
ROWS, BANDS = 4, 48
REGISTERS = ROWS * BANDS
MANTISSA = 10
SIGMAS = 5.0
#: Least sizes of the size classes, and elements that a shingle counts as in each: four a register at least.
CLASSES = np.array([1, 4, 16, 64, 256, 1024])
COPIES = np.maximum(1, -(-4 * REGISTERS // CLASSES))
#: Registers of a band that must not be empty, or its key is left out.
FULL = 3
#: Members that a task compares with each other at most: a block against a block, in strips of rows.
BLOCK, STRIP = 2048, 256
#: Hashes of full sets in a block at most, of 8 bytes each; a larger set is a block of its own.
BLOCK_HASHES = 1 << 22
#: Smallest hashes of a set that a block compares; larger sets are estimated there.
SHORT = 512
#: Columns of an incidence matrix at a time.
WIDTH = 2048
#: Rows that may be broadcast, of 100 bytes at most.
BROADCAST_ROWS = 500_000
#: A set held by more than this share of all rows is joined in portions; there are fewer such sets than the divisor.
HOT_SHARE = 10_000

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
EDGES = np.array([-(-(b << 64) // REGISTERS) for b in range(REGISTERS)], np.uint64)
SEEDS = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 2**64)) for k in range(WORDS)]
NO_ID = 2**63 - 1
#: Word hashes that a worker keeps, of some 150 bytes each.
WORDS_KEPT = 100_000


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


SALTS = _mix(np.arange(1, COPIES.max() + 1, dtype=np.uint64) * SEEDS[0])
BAND_SALT = _mix(np.arange(1, BANDS + 1, dtype=np.uint64))


class Shingler:
    """Sorted 64-bit hashes of a text's distinct shingles. Word hashes are kept between texts."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def hashes(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > WORDS_KEPT:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = len(h)
        if n < WORDS:
            return _mix(np.array([xxhash.xxh64_intdigest(h.tobytes(), seed=n)], np.uint64))
        out = h[: n - WORDS + 1] * SEEDS[0]
        for k in range(1, WORDS):
            out = _mix(out) + h[k : n - WORDS + 1 + k] * SEEDS[k]
        return np.unique(_mix(out))


def size_class(n):
    """Index of the size class of ``n`` shingles."""
    return np.searchsorted(CLASSES, n, "right") - 1


def registers(s: np.ndarray, size: int | None = None) -> np.ndarray:
    """Packed register per bucket: 1 + leading zeros and mantissa of the smallest hash in it; 0 if there is none."""
    copies = 1 if size is None else COPIES[size]
    if copies > 1:
        s = np.sort(_mix(s[:, None] ^ SALTS[None, :copies]).ravel())
    out = np.zeros(REGISTERS, np.uint16)
    at = np.searchsorted(s, EDGES)
    ends = np.append(at[1:], len(s))
    full = at < ends
    x = ((s[at[full]] - EDGES[full]).astype(np.float64) + 0.5) / (2.0**64 / REGISTERS)
    m, e = np.frexp(np.minimum(x, 1 - 1e-12))
    out[full] = 1 + (np.minimum(-e, 60).astype(np.int64) << MANTISSA) + ((m * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    return out


def collision(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Chance that a register agrees without a shared smallest hash: equal leading zeros and mantissa."""
    a, b = np.maximum(na / REGISTERS, 1e-3), np.maximum(nb / REGISTERS, 1e-3)
    total = np.zeros(np.shape(a))
    for k in range(1, 24):
        lo, hi = 2.0**-k, 2.0 ** (1 - k)
        total = total + (np.exp(-a * lo) - np.exp(-a * hi)) * (np.exp(-b * lo) - np.exp(-b * hi))
    return np.minimum(total / (1 << MANTISSA), 0.5)


def _margin(used: np.ndarray) -> np.ndarray:
    t = THRESHOLD / 100
    return t - SIGMAS * np.sqrt(t * (1 - t) / np.maximum(used, 1)) - 1e-9


def likely(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """True where the collision-corrected estimate does not rule the threshold out. ``na``, ``nb``: elements, with copies."""
    used = ((ra > 0) | (rb > 0)).sum(-1)
    same = ((ra == rb) & (ra > 0)).sum(-1)
    c = collision(na, nb)
    return (same / np.maximum(used, 1) - c) / (1 - c) >= _margin(used)


SIGNATURE = "id bigint, row bigint, n int, set binary, size int, regs binary, below binary"


def _name(s: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(s.tobytes())


def _signatures(batches):
    """``regs``: registers in the set's own class; ``below``: in the class of three quarters of its size, if that is another."""
    shingler = Shingler()
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            ns, sets, sizes, regs, belows = [], [], [], [], []
            for text in batch.column(2)[i : i + 256]:
                s = shingler.hashes(text.as_py())
                n = len(s)
                own, low = int(size_class(n)), int(size_class(-(-n * THRESHOLD // 100)))
                ns.append(n)
                sets.append(_name(s) if n else None)
                sizes.append(own)
                regs.append(registers(s, own).tobytes() if n else None)
                belows.append(registers(s, low).tobytes() if n and low != own else None)
            yield pa.RecordBatch.from_arrays([batch.column(0)[i : i + 256], batch.column(1)[i : i + 256], pa.array(ns, pa.int32()), pa.array(sets, pa.binary()), pa.array(sizes, pa.int32()), pa.array(regs, pa.binary()), pa.array(belows, pa.binary())], ["id", "row", "n", "set", "size", "regs", "below"])


def band_keys(regs: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket key of each band, and whether it holds ``FULL`` registers: one row for each set."""
    packed = np.ascontiguousarray(regs).reshape(len(regs), BANDS, ROWS).view(np.uint64)[..., 0]
    key = _mix(_mix(packed + BAND_SALT) + size.astype(np.uint64)[:, None])
    return key, (regs.reshape(len(regs), BANDS, ROWS) > 0).sum(-1) >= FULL


def _members(batches):
    """``key``, ``node`` from rows ``node``, ``size``, ``regs``, ``below``."""
    for batch in batches:
        node, size = (batch.column(c).to_numpy() for c in ("node", "size"))
        for name, step in (("regs", 0), ("below", 1)):
            held = batch.column(name)
            at = np.flatnonzero(~np.asarray(held.is_null()))
            for i in range(0, len(at), 1024):
                rows = at[i : i + 1024]
                regs = np.frombuffer(b"".join(held.take(pa.array(rows)).to_pylist()), np.uint16).reshape(-1, REGISTERS)
                key, full = band_keys(regs, size[rows] - step)
                who = np.broadcast_to(node[rows][:, None], key.shape)
                yield pa.RecordBatch.from_arrays([pa.array(key[full].view(np.int64)), pa.array(who[full])], ["key", "node"])


def _sets(batches):
    """Full sets of nodes from rows ``node``, ``set``, ``text``."""
    shingler = Shingler()
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            nodes, full = [], []
            for node, name, text in zip(*(batch.column(c)[i : i + 256] for c in range(3)), strict=True):
                s = shingler.hashes(text.as_py())
                if _name(s) == name.as_py():
                    nodes.append(node.as_py())
                    full.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(full, pa.binary())], ["node", "full"])


@F.arrow_udf(BooleanType())
def _likely(ra: pa.Array, rb: pa.Array, na: pa.Array, nb: pa.Array, size: pa.Array) -> pa.Array:
    if not len(ra):
        return pa.array([], pa.bool_())
    a, b = (np.frombuffer(b"".join(x.to_pylist()), np.uint16).reshape(-1, REGISTERS) for x in (ra, rb))
    copies = COPIES[size.to_numpy()].astype(float)
    return pa.array(likely(a, b, na.to_numpy() * copies, nb.to_numpy() * copies), pa.bool_())


def linked(a: bytes, b: bytes) -> bool:
    """Whether two full sets are as like as the threshold."""
    p, q = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * both >= THRESHOLD * (len(p) + len(q) - both)


@F.arrow_udf(BooleanType())
def _linked(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([linked(x.as_py(), y.as_py()) for x, y in zip(a, b, strict=True)], pa.bool_())


def _estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) that sizes and registers allow."""
    of = lambda x: nodes.select(F.col("node").alias(x), *(F.col(c).alias(c + x) for c in ("n", "size", "regs", "below")))
    near = pairs.join(of("a"), "a").join(of("b"), "b").where(THRESHOLD * F.greatest("na", "nb") <= 100 * F.least("na", "nb"))
    # registers of the class that both have: the larger set of two classes has those of the class below
    ra = F.when(F.col("sizea") <= F.col("sizeb"), F.col("regsa")).otherwise(F.col("belowa"))
    rb = F.when(F.col("sizeb") <= F.col("sizea"), F.col("regsb")).otherwise(F.col("belowb"))
    return near.where(_likely(ra, rb, "na", "nb", F.least("sizea", "sizeb"))).select("a", "b")


def _confirmed(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """Those of ``pairs`` that the full sets confirm."""
    of = lambda x: full.select(F.col("node").alias(x), F.col("full").alias(f"f{x}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").where(_linked("fa", "fb")).drop("fa", "fb")


class Block:
    """Rows of a bucket that a task compares: ``node``, ``component``, ``n`` and full sets of sorted hashes, whose ``SHORT`` smallest it takes in 32 bits."""

    def __init__(self, node: np.ndarray, component: np.ndarray, n: np.ndarray, full: list[bytes]) -> None:
        self.node, self.component, self.n, self.full = node, component, n, full
        short = [(np.frombuffer(s, np.uint64, min(len(s) // 8, SHORT)) >> np.uint64(32)).astype(np.uint32) for s in full]
        self.sizes = np.array([len(s) for s in short])
        self.values = np.concatenate(short)
        self.owner = np.repeat(np.arange(len(short)), self.sizes)
        again = (self.values[1:] == self.values[:-1]) & (self.owner[1:] == self.owner[:-1])
        #: hashes of a set that 32 bits do not tell apart
        self.blurred = np.bincount(self.owner[1:][again], minlength=len(short))
        self.whole = self.n <= SHORT
        self.last = np.where(self.whole, 2.0**40, self.values[np.cumsum(self.sizes) - 1])

    def overlaps(self, left: slice, right: slice) -> np.ndarray:
        """Common hashes of each row of ``left`` and each of ``right``."""
        _, column, count = np.unique(self.values, return_inverse=True, return_counts=True)
        shared = count > 1
        place = np.cumsum(shared) - 1
        held = shared[column]
        owner, column = self.owner[held], place[column[held]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        out = np.zeros((left.stop - left.start, right.stop - right.start), np.float32)
        width = int(shared.sum())
        for k in range(0, width, WIDTH):
            s, e = np.searchsorted(column, (k, k + WIDTH))
            m = np.zeros((len(self.node), min(WIDTH, width - k)), np.float32)
            m[owner[s:e], column[s:e] - k] = 1
            out += m[left] @ m[right].T
        return out

    def within(self, rows: np.ndarray) -> np.ndarray:
        """Hashes of every row (second axis) up to the last of each of ``rows``."""
        starts = np.cumsum(self.sizes) - self.sizes
        lists = (self.values[s : s + k].astype(float) for s, k in zip(starts.tolist(), self.sizes.tolist(), strict=True))
        return np.stack([np.searchsorted(v, self.last[rows], "right") for v in lists], 1).astype(np.int32)

    def passing(self, left: slice, right: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of different components that may be links, and whether whole sets said so."""
        overlaps = self.overlaps(left, right)
        large = np.flatnonzero(~self.whole)
        place = np.cumsum(~self.whole) - 1
        within = self.within(large) if len(large) else None
        y = np.arange(right.start, right.stop)[None, :]
        found = []
        for at in range(left.start, left.stop, STRIP):
            x = np.arange(at, min(at + STRIP, left.stop))[:, None]
            both = overlaps[x[:, 0] - left.start].astype(np.int64)
            ok = (self.component[x] != self.component[y]) & (THRESHOLD * np.maximum(self.n[x], self.n[y]) <= 100 * np.minimum(self.n[x], self.n[y]))
            if left.start == right.start:
                ok &= x < y
            whole = self.whole[x] & self.whole[y]
            top = both + self.blurred[x] + self.blurred[y]
            good = ok & whole & (100 * top >= THRESHOLD * (self.n[x] + self.n[y] - top))
            if within is not None:
                # of larger sets the hashes up to the lower of the two ends are a sample of the union
                i, j = np.nonzero(ok & ~whole)
                p, q = x[i, 0], y[0, j]
                cut = place[np.where(self.last[p] <= self.last[q], p, q)]
                union = within[cut, p] + within[cut, q] - both[i, j]
                good[i, j] = both[i, j] / np.maximum(union, 1) >= _margin(union)
            i, j = np.nonzero(good)
            p, q = x[i, 0], y[0, j]
            found.append((p, q, whole[i, j] & ((self.blurred[p] + self.blurred[q]) == 0)))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def links(self, left: slice, right: slice) -> tuple[np.ndarray, np.ndarray]:
        """Node keys of a spanning forest of the links, each confirmed on the full sets."""
        x, y, sure = self.passing(left, right)
        up = {c: c for c in self.component.tolist()}

        def root(c: int) -> int:
            while up[c] != c:
                up[c] = c = up[up[c]]
            return c

        keep = []
        order = np.argsort(~sure, kind="stable")
        for p, q in zip(x[order].tolist(), y[order].tolist(), strict=True):
            a, b = root(int(self.component[p])), root(int(self.component[q]))
            if a != b and linked(self.full[p], self.full[q]):
                up[max(a, b)] = min(a, b)
                keep.append((p, q))
        x, y = np.array(keep, np.int64).reshape(-1, 2).T
        a, b = self.node[x], self.node[y]
        return np.maximum(a, b), np.minimum(a, b)


def _across(batches):
    """Links between a block and a block of one bucket.

    Rows come sorted by (key, i, j, side); a group that a batch cuts off waits for the next.
    """
    names = ["key", "i", "j", "side", "node", "n", "component", "full"]
    waiting = None
    for batch in (b for part in (batches, [None]) for b in part):
        parts = [x for x in (waiting, batch) if x is not None]
        table = pa.Table.from_batches(parts).combine_chunks() if parts else None
        if table is None or not table.num_rows:
            continue
        key, i, j, side, node, n, component = (table.column(c).to_numpy() for c in names[:-1])
        cuts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
        ends = np.append(cuts[1:], len(key))
        if batch is not None:  # the last group may go on
            waiting = table.slice(cuts[-1]).to_batches()[0]
            cuts, ends = cuts[:-1], ends[:-1]
        full = table.column("full")
        found = []
        for s, e in zip(cuts.tolist(), ends.tolist(), strict=True):
            cut = e - s if i[s] == j[s] else int(np.count_nonzero(side[s:e] == 0))
            left, right = slice(0, cut), slice(0, cut) if i[s] == j[s] else slice(cut, e - s)
            if left.stop and right.stop > right.start:
                found.append(Block(node[s:e], component[s:e], n[s:e].astype(np.int64), full.slice(s, e - s).to_pylist()).links(left, right))
        if found:
            a, b = (np.concatenate(c) for c in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _gathered(labelled: DataFrame) -> DataFrame:
    """``key``, ``node``, ``n``, ``component`` of buckets of several components, those that hang together as one where a block holds them.

    Like sets meet in many buckets, and each would take their full sets anew. Buckets with members in
    common are a group; one that fits a block has the group's smallest node for its key, and each
    member once. A larger group stays in its buckets.
    """
    several = labelled.groupBy("key").agg((F.min("component") < F.max("component")).alias("several")).where("several")
    mixed = materialize(labelled.join(several.select("key"), "key"), "mixed")
    chained = components(mixed.select(F.col("node").alias("a"), F.col("first").alias("b")))
    groups = chained.select(F.col("id").alias("node"), F.col("component").alias("group"))
    sized = mixed.select("node", "n").distinct().join(groups, "node").groupBy("group").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    fits = sized.where((F.col("m") <= BLOCK) & (F.col("w") <= BLOCK_HASHES)).select("group")
    fits = groups.join(fits, "group")
    whole = materialize(mixed.join(fits, "node", "left").select(F.coalesce("group", "key").alias("key"), "node", "n", "component").distinct(), "gathered")
    for t in (mixed, chained):
        discard(t)
    return whole


def _dealt(inside: DataFrame, found: DataFrame, full: DataFrame, nodes: DataFrame) -> DataFrame:
    """Buckets of several components in pairs of blocks.

    A bucket of up to ``BLOCK`` members and ``BLOCK_HASHES`` hashes is one block. In a larger one the
    members of its largest component need no comparison with each other: only blocks of the others
    meet every block.
    """
    labelled = _gathered(inside.join(found, "node", "left").join(nodes.select("node", "n"), "node").select("key", "node", "first", "n", F.coalesce("component", "node").alias("component")))
    parts = labelled.groupBy("key", "component").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    mixed = parts.groupBy("key").agg(F.max(F.struct("m", "component", "w")).alias("most"), F.sum("m").alias("all"), F.sum("w").alias("hashes"), F.count("*").alias("parts")).where("parts > 1")
    rest = labelled.join(mixed.select("key", F.col("most.component").alias("main"), F.col("most.m").alias("m"), F.col("most.w").alias("w"), "all", "hashes"), "key")
    blocks = lambda m, w: F.ceil(F.greatest(m / BLOCK, w / BLOCK_HASHES))
    one = blocks(F.col("all"), F.col("hashes")) <= 1
    main = F.col("component") == F.col("main")
    others = F.when(one, 1).otherwise(blocks(F.col("all") - F.col("m"), F.col("hashes") - F.col("w"))).cast("int")
    mains = F.when(one, 0).otherwise(blocks(F.col("m"), F.col("w"))).cast("int")
    rest = rest.select("key", "node", "n", "component", others.alias("others"), mains.alias("mains"), (main & ~one).alias("main"))
    own = F.when(F.col("main"), F.col("others") + F.pmod(F.xxhash64("node"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("node"), F.col("others"))).cast("int")
    meets = F.when(F.col("main"), F.col("others")).otherwise(F.col("others") + F.col("mains"))
    rest = rest.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), meets - 1)))
    rest = rest.select("key", "node", "n", "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    rest = rest.join(full, "node")
    return rest.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side").select("key", "i", "j", "side", "node", "n", "component", "full")


def _decided(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``id`` (``NO_ID`` if null), ``row`` (hash of id and text), ``n``, ``group``, ``component`` (smallest id in it) and ``kept`` of each row.

    ``group`` tells components apart that have no id; it is null for texts without words.
    """
    texts = docs.select(_id(key).alias("id"), _row(key, text).alias("row"), text_of(text).alias("text"))
    signed = materialize(texts.mapInArrow(_signatures, SIGNATURE), "signatures")

    # one node for each distinct set; copies are counted away before the shuffle
    nodes = signed.where("n > 0").groupBy("set", "n", "size", "regs", "below").agg(F.min("id").alias("id"), F.min("row").alias("row"), F.count("*").alias("rows"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    # sets of one or two shingles are like no other set
    members = nodes.where("n > 2").select("node", "size", "regs", "below").mapInArrow(_members, "key bigint, node bigint")
    buckets = members.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("members"), F.bit_xor(F.xxhash64("node")).alias("who")).where("members > 1")
    # buckets of the same members are one
    buckets = materialize(buckets.groupBy("first", "members", "who").agg(F.min("key").alias("key")), "buckets")
    inside = materialize(members.join(buckets.select("key", "first"), "key").select("key", "node", "first"), "inside")
    discard(buckets)

    asked = nodes.join(inside.select("node").distinct(), "node", "left_semi").select("row", "node", "set")
    full = texts.join(fitting(asked, BROADCAST_ROWS), "row").select("node", "set", "text").mapInArrow(_sets, "node bigint, full binary")
    full = materialize(full.dropDuplicates(["node"]), "sets")

    # each node with the smallest that shares a bucket with it
    star = inside.where("node <> first").groupBy(F.col("node").alias("a")).agg(F.min("first").alias("b"))
    links = materialize(_confirmed(_estimated(star, nodes), full), "links")
    found = components(links).withColumnRenamed("id", "node")

    more = materialize(_dealt(inside, found, full, nodes).mapInArrow(_across, "a bigint, b bigint").distinct(), "more")
    if not more.isEmpty():
        links = links.unionByName(more)
        found = components(links).withColumnRenamed("id", "node")
    for t in (inside, full):
        discard(t)

    # a component goes by the smallest id of its nodes
    linked = nodes.select("node", "set", "id", "rows").join(found, "node", "left")
    least = linked.where("component is not null").groupBy("component").agg(F.min("id").alias("least"))
    of_set = linked.join(least, "component", "left").select("set", "rows", F.coalesce("least", "id").alias("component"), F.coalesce("component", "node").alias("group"))
    of_set = materialize(of_set, "of_set")
    discard(nodes)
    return _per_row(signed.select("id", "row", "n", "set"), of_set)


def _per_row(signed: DataFrame, of_set: DataFrame) -> DataFrame:
    """Rows with the component of their set. A set that very many rows hold is joined in portions, each in a task of its own."""
    most = max(1, signed.count() // HOT_SHARE)
    hot = of_set.where(F.col("rows") > most)  # fewer than HOT_SHARE
    hot = F.broadcast(hot.select(F.col("set").alias("hot"), F.ceil(F.col("rows") / most).cast("int").alias("portions")))
    rows = signed.join(hot, F.col("set") == F.col("hot"), "left")
    rows = rows.withColumn("portion", F.coalesce(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("portions")).cast("int"), F.lit(0)))
    each = F.when(F.col("rows") > most, F.ceil(F.col("rows") / most)).otherwise(1).cast("int")
    sets = of_set.select("set", "component", "group", F.explode(F.sequence(F.lit(0), each - 1)).alias("portion"))
    out = rows.join(sets, ["set", "portion"], "left")
    component = F.coalesce("component", "id")
    return out.select("id", "row", "n", "group", component.alias("component"), (F.col("id") == component).alias("kept"))


def _id(key: str) -> Column:
    return F.coalesce(F.col(key).cast("bigint"), F.lit(NO_ID))


def _row(key: str, text: str) -> Column:
    """With the id it names a row; rows alike in both are treated alike."""
    return F.xxhash64(_id(key), text_of(text))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_shingles``, ``component_id``, ``kept`` of each row.

    Texts without words have no shingles and are linked with nothing. Rows that share an id, or
    have none, are linked each by its own set; a null id is larger than any id, and a component of
    nothing but null ids has the component id null and is kept. An empty table gives no rows.
    """
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    before = mark(docs.sparkSession)
    found = materialize(_decided(docs, key, text).drop("row", "group"), "decided")
    release(docs.sparkSession, since(docs.sparkSession, before), found)
    return found.select(known("id").alias(key), F.col("n").cast("bigint").alias("n_shingles"), known("component").alias("component_id"), "kept")


def keep(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component, of its smallest id; columns as they were.

    Texts without words stay. Where several rows of a component have that id, or none has one,
    one of them stays; of rows alike in id and text any.
    """
    before = mark(docs.sparkSession)
    found = materialize(_decided(docs, key, text).select("id", "row", "group", "kept"), "decided")
    release(docs.sparkSession, since(docs.sparkSession, before), found)
    several = found.where("kept and group is not null").groupBy("group").agg(F.count("*").alias("m"), F.min("row").alias("pick")).where("m > 1")
    several = materialize(several.select("group", "pick"), "several")
    kept = found.where("kept").join(fitting(several, BROADCAST_ROWS), "group").select("id", "row", "pick").distinct()
    gone = materialize(found.where("not kept").select("id", "row").union(kept.where("row <> pick").select("id", "row")).distinct(), "gone")
    once = materialize(kept.where("row = pick").select("id", "row"), "once")
    discard(found)
    a, b = free_name(docs, "id"), free_name(docs, "row")
    same = (_id(key) == F.col(a)) & (_row(key, text) == F.col(b))
    out = docs.join(fitting(gone.toDF(a, b), BROADCAST_ROWS), same, "left_anti")
    if several.isEmpty():
        return out
    listed = fitting(once.toDF(a, b), BROADCAST_ROWS)
    one = out.join(listed, same).groupBy(a, b).agg(F.first(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias(b + "_")).select(f"{b}_.*")
    return out.join(listed, same, "left_anti").unionByName(one)
