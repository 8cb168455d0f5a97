"""Repair of damaged conversations: the cheapest edits that give a conversation its grammar.

A conversation's rows are to read ``(s?(ua)+)?`` by the initials of their roles. Edits keep a row (K,
0), give it the role user or assistant (R, 1), delete it (D, 2) or insert an empty row (I, 5); a row
that stays although its text breaks off costs 5 more. A forward Viterbi pass carries, for each of the
four states of the grammar, the least (cost, audit string); after each row the layer is closed by at
most two insertions. An audit string settles its own cost, so of two of one cost none begins the
other, and the least one of a prefix stays least whatever follows.

The pass runs over light rows without texts, and splits: a task holds a range of (conversation, turn),
so a conversation that fills many tasks is cut into pieces. A piece whose beginning lies in an earlier
task is carried from all four states at once; pieces are then chained state by state. Equal rows of a
turn travel as one with their number. Repeats are found by groups of (conversation, digest), of which
only the earliest turn is kept. The digest of the repaired rows is one SHA-256 over all of them, which
has no parallel form: texts are streamed through it in order, one row at a time.

Defined results: null roles and texts are one space, and nulls in the key of the damage too; rows of
one turn go by the MD5 of role and text; null turns come first; a null id is a conversation of its own;
repeated rows are duplicates; an empty table gives none; other columns are not read. ``gaps`` that
exceed a long are its largest value. The audit of a conversation is one value, one character a row.
"""

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from .common import materialize

#: Costs of the edits, and of a row that stays truncated.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a kept row of an initial; state after a row made or inserted as user or assistant.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
MADE = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
LEGAL = ("su", "ua", "au")
#: Rows of a piece that are walked one by one; their transitions are then chained pairwise.
STEP = 128
BLANKS = " \t\n\x0b\x0c\r"

Best = tuple[int, str] | None  # least (cost, audit) of a state, None where it is out of reach
Layer = list[Best]


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after damage: ``conv_id``, ``turn``, ``role``, ``text`` and ``copies``, 0 for a row that is dropped."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat_ws(":", known("conv_id"), known("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("fate") == 0, 0).when(F.col("fate") == 3, 2).otherwise(1).cast("bigint")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def _digest() -> Column:
    return F.when(F.col("copies") > 0, F.md5(F.concat(F.md5(F.col("role").cast("binary")), "text").cast("binary")))


def _light(rows: DataFrame) -> DataFrame:
    """A row per conversation, turn and distinct (role, text), without texts; dropped rows have no digest."""
    rest = F.rtrim(F.col("text"), F.lit(BLANKS))
    some = rows.select(
        "conv_id", "turn", "copies", _digest().alias("digest"), F.substring("role", 1, 1).alias("initial"),
        (rest == "").alias("blank"), (~F.substring(rest, -1, 1).isin(".", "!", "?")).alias("truncated"),
    )
    first = [F.first(c).alias(c) for c in ("initial", "blank", "truncated")]
    light = materialize(some.groupBy("conv_id", "turn", "digest").agg(F.sum("copies").alias("copies"), *first), "light")
    # null turns come first, so the order of turns is that of this struct
    turn = F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn").alias("turn"))
    again = light.where("digest is not null").groupBy("conv_id", "digest").agg(F.min(turn).alias("since"), F.count("*").alias("n"))
    again = again.where("n > 1").select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "since")
    met = light.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    seen = F.coalesce(turn > F.col("since"), F.lit(False))
    return materialize(met.select(*light.columns, seen.alias("seen")), "faults")


def close(layer: Layer) -> Layer:
    """Insertions that lead to a better state: to a user row, to an assistant row, to both."""
    for _ in range(2):
        for state, to in MADE.items():
            if layer[state] is not None:
                cost, audit = layer[state]
                new = (cost + INSERT, audit + "I")
                if layer[to] is None or new < layer[to]:
                    layer[to] = new
    return layer


def walk(layer: Layer, initial: str, must_go: bool, truncated: bool) -> Layer:
    """The layer after one more row."""
    out: Layer = [None if b is None else (b[0] + DELETE, b[1] + "D") for b in layer]
    if not must_go:
        extra = TRUNCATED if truncated else 0
        for state, best in enumerate(layer):
            if best is None:
                continue
            for to, cost, edit in ((KEPT.get((state, initial)), 0, "K"), (MADE[state], REROLE, "R")):
                if to is not None:
                    new = (best[0] + cost + extra, best[1] + edit)
                    if out[to] is None or new < out[to]:
                        out[to] = new
    return close(out)


def repeat(layer: Layer, n: int) -> Layer:
    """The layer after ``n`` more rows that must go: an insertion among them is never better than one after them."""
    return close([None if b is None else (b[0] + n * DELETE, b[1] + "D" * n) for b in layer]) if n else layer


def chain(one: list[Layer], two: list[Layer]) -> list[Layer]:
    """Transitions of two pieces in a row: from each state to each, by the best state between."""
    out = []
    for layer in one:
        row: Layer = [None] * 4
        for best, onward in zip(layer, two):
            for to, more in enumerate(onward) if best is not None else ():
                if more is not None:
                    cost = best[0] + more[0]
                    if row[to] is None or cost <= row[to][0]:
                        new = (cost, best[1] + more[1])
                        if row[to] is None or new < row[to]:
                            row[to] = new
        out.append(row)
    return out


def identity() -> list[Layer]:
    return [[(0, "") if i == j else None for j in range(4)] for i in range(4)]


def opened() -> list[Layer]:
    """The one layer before the first row of a conversation."""
    return [close([(0, ""), None, None, None])]


class Piece:
    """Consecutive rows of one conversation: counts, edges and transitions from ``layers``' states."""

    def __init__(self, layers: list[Layer]) -> None:
        self.done: list[tuple[int, list[Layer]]] = []  # chained blocks and the number of blocks in each, largest first
        self.layers, self.walked = layers, 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first: str | None = None
        self.last: str | None = None
        self.low: int | None = None
        self.high: int | None = None

    def add(self, turn: int | None, initial: str, blank: bool, truncated: bool, seen: bool, copies: int) -> None:
        if self.last is not None and self.last + initial not in LEGAL:
            self.illegal += 1
        self.illegal += copies - 1  # a role beside itself
        self.first, self.last = initial if self.first is None else self.first, initial
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        go = copies if blank or seen else copies - 1
        if blank:
            self.blank += go
        else:
            self.duplicate += go
        if go < copies:
            self.truncated += truncated
            self.layers = [walk(layer, initial, False, truncated) for layer in self.layers]
        self.layers = [repeat(layer, go) for layer in self.layers]
        self.walked += 1
        if self.walked == STEP:
            self._fold(1)

    def _fold(self, least: int) -> None:
        """Ends a block; blocks of like numbers are chained, so that strings are copied a logarithmic number of times."""
        self.done.append((1, self.layers))
        self.layers, self.walked = identity(), 0
        while len(self.done) > 1 and (least == 0 or self.done[-2][0] <= self.done[-1][0]):
            (m, one), (n, two) = self.done[-2:]
            self.done[-2:] = [(m + n, chain(one, two))]

    def transitions(self) -> list[Layer]:
        self._fold(0)
        return self.done[0][1]


COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
_BEST = StructType([StructField("cost", LongType()), StructField("audit", StringType())])


def _piece_schema(rows: DataFrame) -> StructType:
    return StructType(
        [
            StructField("conv_id", rows.schema["conv_id"].dataType), StructField("part", LongType()), StructField("whole", BooleanType()),
            *(StructField(c, LongType()) for c in COUNTS), StructField("first", StringType()), StructField("last", StringType()),
            StructField("low", rows.schema["turn"].dataType), StructField("high", rows.schema["turn"].dataType),
            StructField("layers", ArrayType(ArrayType(_BEST))),
        ]
    )


def _pieces(schema: pa.Schema, task: int | None = None):  # noqa: ANN202
    """Sorted light rows to pieces, one per conversation and task. Those at a task's edges may go on elsewhere."""

    def told(conv: object, piece: Piece, part: int, whole: bool) -> dict:
        layers = [[None if b is None else {"cost": b[0], "audit": b[1]} for b in layer] for layer in piece.transitions()]
        row = {"conv_id": conv, "part": part, "whole": whole, "first": piece.first, "last": piece.last, "low": piece.low, "high": piece.high, "layers": layers}
        return row | {c: getattr(piece, c) for c in COUNTS}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId() if context else task or 0
        piece, at, inside, ready = None, None, False, []
        for batch in batches:
            for conv, turn, initial, blank, truncated, seen, copies in zip(*(c.to_pylist() for c in batch.columns)):
                if piece is None or conv != at:
                    if piece is not None:
                        ready.append(told(at, piece, part, inside))
                        inside = True
                    piece, at = Piece(opened() if inside else identity()), conv
                if copies:
                    piece.add(turn, initial, blank, truncated, seen, copies)
            if len(ready) >= 1000:
                yield pa.RecordBatch.from_pylist(ready, schema)
                ready = []
        if piece is not None:
            ready.append(told(at, piece, part, False))
            yield pa.RecordBatch.from_pylist(ready, schema)

    return run


def joined(pieces: list[dict]) -> dict:
    """One conversation from its pieces in order: counts, gaps, and the cheapest way through all of them."""
    out = dict.fromkeys(COUNTS, 0)
    state, last, low, high = opened(), None, None, None
    for p in pieces:
        for c in COUNTS:
            out[c] += p[c]
        if p["first"] is not None:
            out["illegal"] += last is not None and last + p["first"] not in LEGAL
            last = p["last"]
        if p["low"] is not None:
            out["turns"] -= p["low"] == high
            low, high = p["low"] if low is None else low, p["high"]
        layers = [[None if b is None else (b["cost"], b["audit"]) for b in layer] for layer in p["layers"]]
        state = layers if len(layers) == 1 else chain(state, layers)
    cost, audit = min(b for b in (state[0][START], state[0][ASSISTANT]) if b is not None)
    gaps = 0 if low is None else min(high - low + 1 - out["turns"], 2**63 - 1)
    return {"gaps": gaps, **{c: out[c] for c in COUNTS[:-1]}, "cost": cost, "audit": audit}


RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _solved(schema: pa.Schema):  # noqa: ANN202
    """Pieces that are sorted by conversation and task to one row per conversation."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            ready = []
            for row in batch.to_pylist():
                if held and held[0]["conv_id"] != row["conv_id"]:
                    ready.append({"conv_id": held[0]["conv_id"], **joined(held)})
                    held = []
                held.append(row)
            yield pa.RecordBatch.from_pylist(ready, schema)
        if held:
            yield pa.RecordBatch.from_pylist([{"conv_id": held[0]["conv_id"], **joined(held)}], schema)

    return run


class Repaired:
    """Digest of the repaired rows of one conversation, fed with its rows in order."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.told, self.hash = audit, 0, 0, hashlib.sha256()
        self.odd = (len(audit) - audit.count("D")) % 2  # an odd number of rows begins with the system's

    def _tell(self, role: str | None, text: str) -> None:
        made = "user" if (self.told + self.odd) % 2 == 0 else "assistant"
        self.hash.update(f"{chr(10) if self.told else ''}{made if role is None else role}:{text}".encode("utf-8", "surrogatepass"))
        self.told += 1

    def _inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._tell(None, "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self._tell(role if edit == "K" else None, text)

    def digest(self) -> str:
        self._inserted()
        return self.hash.hexdigest()


def _hashed(schema: pa.Schema):  # noqa: ANN202
    """A conversation's result, then its rows in order, to the result with the digest of the repaired rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, repaired = None, None
        for batch in batches:
            ready = []
            for conv, result, role, text, copies in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "result", "role", "text", "copies"))):
                if result is not None:
                    if current is not None:
                        ready.append(current | {"repaired_sha256": repaired.digest()})
                    current, repaired = {"conv_id": conv, **result}, Repaired(result["audit"])
                else:
                    for _ in range(copies):
                        repaired.row(role, text)
            yield pa.RecordBatch.from_pylist(ready, schema)
        if current is not None:
            yield pa.RecordBatch.from_pylist([current | {"repaired_sha256": repaired.digest()}], schema)

    return run


def repair(rows: DataFrame) -> DataFrame:
    """Counts of faults, cheapest edits and digest of the repaired rows of each conversation.

    ``rows``: ``conv_id``, ``turn``, ``role``, ``text``, ``copies`` as ``damaged`` gives them. Returns ``conv_id``,
    ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``, ``repaired_sha256``.
    """
    kind, order = rows.schema["conv_id"].dataType, ["conv_id", "turn", "digest"]
    light = _light(rows)
    sorted_rows = light.repartitionByRange(*order).sortWithinPartitions(*order)
    columns = ["conv_id", "turn", "initial", "blank", "truncated", "seen", "copies"]
    schema = _piece_schema(light)
    pieces = materialize(sorted_rows.select(*columns).mapInArrow(_pieces(_arrow(schema)), schema), "pieces")

    solved_schema = StructType([StructField("conv_id", kind), *(StructField(c, LongType()) for c in RESULT), StructField("audit", StringType())])
    solve = lambda df: df.mapInArrow(_solved(_arrow(solved_schema)), solved_schema)
    # only the pieces at a task's edges can have others to be chained with
    edges = pieces.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    solved = solve(pieces.where("whole")).unionByName(solve(edges))

    result = F.struct(*RESULT, "audit")
    texts = rows.where("copies > 0").select("conv_id", "turn", _digest().alias("digest"), "role", "text", "copies", F.lit(None).cast(solved.select(result.alias("r")).schema["r"].dataType).alias("result"))
    first = solved.select("conv_id", result.alias("result"))
    both = texts.unionByName(first, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", F.col("result").isNull(), "turn", "digest")
    out_schema = StructType([*solved_schema, StructField("repaired_sha256", StringType())])
    return both.mapInArrow(_hashed(_arrow(out_schema)), out_schema)


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
