"""Repair of the turn structure of conversations by cheapest edits.

A repaired conversation's role initials are `(s?(ua)+)?`. Rows are kept, given the other role, deleted, or empty rows are
inserted. What a row allows depends on its symbol alone (role and fault), so a row is a small min-plus matrix over four states, a
run of n equal symbols is the n-th power of one, made of cached binary powers, and a stretch of rows is a product. A conversation
may hold any share of all rows: it is cut where range partitions end, every stretch gives its matrix, the products over
the stretches behind it (one matrix for each) say what the rest will cost, and then every stretch chooses its edits alone.
"""

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from gridmill.llm.numbering import part_of, range_sorted
from gridmill.sources.work import stage

SPACE = " \t\n\x0b\x0c\r"
NEVER = 1 << 60

# Costs of the edits, and states: nothing yet, after a system row, after a user row, after an assistant row.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
FILLED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # the state after an inserted or given role
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "": {}}
LAST = np.array([0, 2 * INSERT, INSERT, 0])  # what closing a conversation costs

# A symbol is a hex digit: 4 x role + fault.
ROLES, FAULTS = ("s", "u", "a", ""), ("", "truncated", "blank", "duplicate")
NAMES = {"u": "user", "a": "assistant"}


@lru_cache(maxsize=None)
def edits(symbol: str) -> list[list[tuple[str, int, int]]]:
    """Per state the edits of a row: (initial, cost, next state), in ASCII order; an insertion stays at the row."""
    role, fault = ROLES[int(symbol, 16) // 4], FAULTS[int(symbol, 16) % 4]
    extra = TRUNCATED if fault == "truncated" else 0
    found = []
    for state in range(4):
        ways = [("D", DELETE, state), ("I", INSERT, FILLED[state])]
        if fault in ("", "truncated"):
            if state in KEPT[role]:
                ways.append(("K", extra, KEPT[role][state]))
            ways.append(("R", REROLE + extra, FILLED[state]))
        found.append(ways)
    return found


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product of matrices, or of a matrix and a vector."""
    return np.minimum((a[:, :, None] + b[None]).min(axis=1), NEVER) if b.ndim == 2 else np.minimum((a + b).min(axis=1), NEVER)


@lru_cache(maxsize=None)
def power(symbol: str, k: int) -> np.ndarray:
    """The costs of 2^k equal rows, from each state (line) to each (column), insertions before a row included."""
    if k:
        return times(power(symbol, k - 1), power(symbol, k - 1))
    insert = np.full((4, 4), NEVER)
    use = np.full((4, 4), NEVER)
    for state in range(4):
        insert[state, state] = 0
        for initial, cost, then in edits(symbol)[state]:
            table = insert if initial == "I" else use
            table[state, then] = min(table[state, then], cost)
    return times(times(insert, insert), use)


def run_matrix(symbol: str, n: int) -> np.ndarray:
    made = None
    for k in range(n.bit_length()):
        if n >> k & 1:
            made = power(symbol, k) if made is None else times(made, power(symbol, k))
    return made


def runs(symbols: str) -> list[tuple[str, int]]:
    return [(s, sum(1 for _ in same)) for s, same in groupby(symbols)]


def matrix(symbols: str) -> np.ndarray:
    """The costs of a stretch of rows, run by run."""
    made = None
    for symbol, n in runs(symbols):
        step = run_matrix(symbol, n)
        made = step if made is None else times(made, step)
    return made


def chosen(symbols: str, rest: np.ndarray, state: int) -> tuple[str, int]:
    """The ASCII-least of the cheapest edits of a stretch, from a state, and the state after it.

    `rest` is what follows costs from each state. The cost of what is left of a run comes from its powers.
    """
    parts = runs(symbols)
    behind = [rest]
    for symbol, n in reversed(parts):
        behind.append(times(run_matrix(symbol, n), behind[-1]))
    if behind[-1][state] >= NEVER:
        return "", -1
    out = []
    for (symbol, n), end in zip(parts, behind[-2::-1]):
        left = [end]
        for _ in range(n):
            left.append(times(power(symbol, 0), left[-1]))
        for at in range(n, 0, -1):
            here, after = left[at], left[at - 1]
            while True:
                for initial, cost, then in edits(symbol)[state]:
                    if here[state] == cost + (here if initial == "I" else after)[then]:
                        break
                out.append(initial)
                state = then
                if initial != "I":
                    break
    return "".join(out), state


@lru_cache(maxsize=100_000)
def whole(symbols: str) -> tuple[str, int]:
    """Edits and last state of a conversation in one stretch; short ones repeat often."""
    return chosen(symbols, LAST, START)


def closing(state: int) -> str:
    return "I" * (int(LAST[state]) // INSERT)


# --- rows to stretches ----------------------------------------------------------------------------

def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows (conv, turn, role, text, gone) with planted faults, chosen by crc32(`conv:turn`) % 20; nulls are one space there.

    0 drops the row (it stays with `gone`), 1 empties its text, 2 takes `.!?` out of it, 3 repeats the row, 4 makes
    the role user. A null role or text is one space as well; a null turn stays null.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(blank(conv), F.lit(":"), blank(turn))) % 20
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), blank(role).alias("role"),
                     blank(text).alias("text"), fate.alias("fate"))
    new_text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    new_role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(True), F.when(F.col("fate") == 3, 2).otherwise(1)))
    return rows.select("conv", "turn", new_role.alias("role"), new_text.alias("text"), (F.col("fate") == 0).alias("gone"),
                       copies.alias("_copy")).drop("_copy")


def plain(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The same columns without planted faults, to repair conversations as they are."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return df.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), blank(role).alias("role"),
                     blank(text).alias("text"), F.lit(False).alias("gone"))


def _mark() -> Column:
    return F.sha2("text", 256).alias("mark")


def _flagged(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, mark, symbol) of the rows that are left.

    Of equal (conv, role, mark) the first is a pre-aggregated minimum, joined back by row number, so copies never meet.
    """
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(end == "", 2).when(F.right(end, F.lit(1)).isin(".", "!", "?"), 0).otherwise(1)
    place = lambda initial: F.left("role", F.lit(1)) == initial
    role = F.when(place("s"), 0).when(place("u"), 1).when(place("a"), 2).otherwise(3)
    narrow = stage(rows.where("NOT gone").select("conv", "turn", "role", _mark(), role.alias("_role"), fault.alias("_fault"),
                                                 F.monotonically_increasing_id().alias("_id")), "turns")
    first = F.min(F.struct(F.col("turn").isNotNull(), "turn", "_id").alias("f"))["_id"]
    firsts = narrow.groupBy("conv", "role", "mark").agg(first.alias("_id")).select("_id", F.lit(True).alias("_first"))
    fault = F.when(F.col("_first").isNull() & (F.col("_fault") != 2), 3).otherwise(F.col("_fault"))
    symbol = F.lower(F.hex((F.col("_role") * 4 + fault).cast("long")))
    return narrow.join(firsts, "_id", "left").select("conv", "turn", "role", "mark", symbol.alias("symbol"))


STRETCH = 1 << 20  # rows of a stretch at most
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
ROW = ("conv", "turn", "role", "mark")
COUNTS = ("first_turn", "last_turn", "n_turns", "blank", "duplicate", "truncated", "illegal")


def role_of(symbol: str) -> str:
    return ROLES[int(symbol, 16) // 4]


def _counts(turns: list[int | None], symbols: str) -> tuple:
    """The counts of a stretch, in the order of COUNTS; turns ascend, nulls first."""
    known = [t for t in turns if t is not None]
    distinct = sum(a != b for a, b in zip(known, known[1:])) + bool(known)
    fault = [int(s, 16) % 4 for s in symbols]
    illegal = sum((role_of(a), role_of(b)) not in LEGAL for a, b in zip(symbols, symbols[1:]))
    return (known[0] if known else None, known[-1] if known else None, distinct, fault.count(2), fault.count(3), fault.count(1), illegal)


def _stretches(conv: pa.DataType):
    """Sorted rows of a task to one row per conversation (or STRETCH rows of it): its head, symbols, counts and matrix."""
    types = [conv, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.int64()] * len(COUNTS), pa.list_(pa.int64())]
    names = [*ROW[:1], "at", *ROW[1:], "symbols", *COUNTS, "costs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        at, head, turns, symbols, made = TaskContext.get().partitionId() << 33, None, [], [], []

        def close():
            text = "".join(symbols)
            made.append((head[0], at, *head[1:], text, *_counts(turns, text), matrix(text).ravel().tolist()))

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            for conv_id, turn, role, mark, symbol in zip(*(batch.column(c).to_pylist() for c in (*ROW, "symbol"))):
                if head is None or conv_id != head[0] or len(symbols) == STRETCH:
                    if head is not None:
                        close()
                        at += 1
                    head, turns, symbols = (conv_id, turn, role, mark), [], []
                turns.append(turn)
                symbols.append(symbol)
            if len(made) >= 5_000:
                yield batch_of(made)
                made = []
        if head is not None:
            close()
        if made:
            yield batch_of(made)
    return run


def _rests(group: pa.Table) -> pa.Table:
    """What follows each stretch of a conversation costs, from each state."""
    order = np.argsort(group.column("at").to_numpy())
    costs = np.array(group.column("costs").to_pylist(), np.int64).reshape(-1, 4, 4)
    rest = np.empty((len(order), 4), np.int64)
    behind = LAST
    for i in order[::-1]:
        rest[i] = behind
        behind = times(costs[i], behind)
    return group.select(["conv", "at"]).append_column("rest", pa.array(rest.tolist(), pa.list_(pa.int64())))


def _entries(group: pa.Table) -> pa.Table:
    """The state in which each stretch of a conversation is entered, and whether it is the last."""
    order = np.argsort(group.column("at").to_numpy())
    then = group.column("then").to_pylist()
    entry, state = [0] * len(order), START
    for i in order:
        entry[i], state = state, then[i][state]
    last = [i == order[-1] for i in range(len(order))]
    return group.select(["conv", "at"]).append_column("entry", pa.array(entry, pa.int32())).append_column("last", pa.array(last))


def _paid(symbols: str, audit: str) -> int:
    """What the edits of rows (and insertions before them) cost."""
    rows = iter(symbols)
    total = 0
    for initial in audit:
        fault = FAULTS[int(next(rows), 16) % 4] if initial != "I" else ""
        total += {"D": DELETE, "I": INSERT, "K": 0, "R": REROLE}[initial] + (TRUNCATED if fault == "truncated" and initial != "D" else 0)
    return total


def _from_every_state(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        audits, thens = [], []
        for symbols, rest in zip(batch.column("symbols").to_pylist(), batch.column("rest").to_pylist()):
            ways = [chosen(symbols, np.array(rest), state) for state in range(4)]
            audits.append([a for a, _ in ways])
            thens.append([t for _, t in ways])
        yield batch.append_column("audits", pa.array(audits, pa.list_(pa.string()))).append_column(
            "then", pa.array(thens, pa.list_(pa.int32())))


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [whole(s) for s in batch.column("symbols").to_pylist()]
        yield batch.append_column("audit", pa.array([a + closing(t) for a, t in found], pa.string()))


def _with_cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paid = [_paid(s, a) for s, a in zip(batch.column("symbols").to_pylist(), batch.column("audit").to_pylist())]
        yield batch.append_column("cost", pa.array(paid, pa.int64()))


def _added(schema: T.StructType, **columns: T.DataType) -> T.StructType:
    return T.StructType([*schema, *[T.StructField(n, t) for n, t in columns.items()]])


def stretches(rows: DataFrame) -> DataFrame:
    """(conv, at, turn, role, mark, symbols, counts, audit, cost): the stretches of the conversations and their edits.

    turn, role and mark are those of the first row; `at` orders the stretches.
    """
    marked = stage(_flagged(rows).withColumn("_tie", F.monotonically_increasing_id()), "symbols")
    place = (*ROW, "symbol", "_tie")  # of equal rows the first has the smallest symbol: the others are its duplicates
    ordered = marked.repartitionByRange(*place).sortWithinPartitions(*place).drop("_tie")
    conv = ordered.schema["conv"]
    kinds = dict(at="long", turn="long", role="string", mark="string", symbols="string", **{c: "long" for c in COUNTS}, costs="array<long>")
    schema = T.StructType([conv, *T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in kinds.items()))])
    made = stage(ordered.mapInArrow(_stretches(_arrow(conv.dataType)), schema), "stretches")
    many = Window.partitionBy("conv")
    counted = stage(made.withColumn("_n", F.count(F.lit(1)).over(many)), "counted")
    single = counted.where("_n = 1").drop("_n", "costs")
    single = single.mapInArrow(_audited, _added(single.schema, audit=T.StringType()))
    cut = counted.where("_n > 1").drop("_n")
    rests = cut.select("conv", "at", "costs").groupBy("conv").applyInArrow(
        _rests, _added(cut.select("conv", "at").schema, rest=T.ArrayType(T.LongType())))
    met = cut.drop("costs").join(rests.select(F.col("conv").alias("_c"), F.col("at").alias("_a"), "rest"),
                                 F.col("conv").eqNullSafe(F.col("_c")) & (F.col("at") == F.col("_a"))).drop("_c", "_a")
    ways = stage(met.mapInArrow(_from_every_state, _added(
        met.schema, audits=T.ArrayType(T.StringType()), then=T.ArrayType(T.IntegerType()))), "ways")
    entries = ways.select("conv", "at", "then").groupBy("conv").applyInArrow(_entries, _added(
        ways.select("conv", "at").schema, entry=T.IntegerType(), last=T.BooleanType()))
    picked = ways.join(entries.select(F.col("conv").alias("_c"), F.col("at").alias("_a"), "entry", "last"),
                       F.col("conv").eqNullSafe(F.col("_c")) & (F.col("at") == F.col("_a")))
    end = F.when(F.col("last"), F.element_at(F.array(*[F.lit(closing(s)) for s in range(4)]), F.col("then")[F.col("entry")] + 1)).otherwise("")
    picked = picked.withColumn("audit", F.concat(F.col("audits")[F.col("entry")], end)).select(*single.columns)
    found = single.unionByName(picked)
    return found.mapInArrow(_with_cost, _added(found.schema, cost=T.LongType()))


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)


# --- edits to conversations -----------------------------------------------------------------------

def _merged(rows: DataFrame) -> DataFrame:
    """Rows with their texts and the stretches' edits, each conversation in one task, in order, the edits first.

    One pass reads them as a stream: a digest of a whole conversation needs its rows in order, but never holds them.
    """
    headers = stretches(rows).select("conv", "turn", "role", "mark", F.lit(0).alias("kind"), "at",
                                     F.lit(None).cast("binary").alias("text"), F.struct(F.left("symbols", F.lit(1)).alias("first"), F.right("symbols", F.lit(1)).alias("last"), *COUNTS, "audit", "cost").alias("head"))
    texts = rows.select("conv", F.when(~F.col("gone"), F.col("turn")).alias("turn"), "role", _mark(),
                        F.when(F.col("gone"), 2).otherwise(1).alias("kind"), F.lit(None).cast("long").alias("at"),
                        F.when(~F.col("gone"), F.col("text").cast("binary")).alias("text"),
                        F.lit(None).cast(headers.schema["head"].dataType).alias("head"))
    return headers.unionByName(texts).repartition("conv").sortWithinPartitions(*ROW, "kind", "at")


class _Repair:
    """The state of one conversation while its rows go by."""

    def __init__(self, conv):
        self.conv, self.state, self.edits, self.place = conv, START, iter(()), 0
        self.waiting, self.heads = [], []

    def header(self, head: dict) -> None:
        self.heads.append(head)
        self.waiting.append(iter(head["audit"]))

    def _next(self) -> str | None:
        while self.waiting:
            for initial in self.waiting[0]:
                return initial
            self.waiting.pop(0)
        return None

    def _inserted(self) -> tuple:
        self.state = FILLED[self.state]
        return "I", NAMES[ROLES[self.state - 1]], b""

    def row(self, role: str, text: bytes) -> Iterator[tuple]:
        """The insertions before a row, and what becomes of it."""
        while (initial := self._next()) == "I":
            yield self._inserted()
        if initial == "R":
            self.state = FILLED[self.state]
            yield "R", NAMES[ROLES[self.state - 1]], text
        elif initial == "K":
            self.state = KEPT[role[0]][self.state]
            yield "K", role, text
        else:
            yield "D", None, None

    def end(self) -> Iterator[tuple]:
        while self._next():
            yield self._inserted()

    def summary(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit."""
        heads = self.heads
        total = lambda name: sum(h[name] for h in heads)
        borders = list(zip(heads, heads[1:]))
        illegal = total("illegal") + sum((role_of(a["last"]), role_of(b["first"])) not in LEGAL for a, b in borders)
        known = [h for h in heads if h["n_turns"]]
        gaps = 0
        if known:
            distinct = sum(h["n_turns"] for h in known) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(known, known[1:]))
            gaps = known[-1]["last_turn"] - known[0]["first_turn"] + 1 - distinct
        return gaps, total("blank"), total("duplicate"), total("truncated"), illegal, total("cost"), "".join(h["audit"] for h in heads)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation, edit or None at its end) of every edit in order."""
    now = None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv", "role", "kind", "text", "head")]
        for conv, role, kind, text, head in zip(*columns):
            if now is None or conv != now.conv:
                if now is not None:
                    yield from ((now, e) for e in now.end())
                    yield now, None
                now = _Repair(conv)
            if kind == 0:
                now.header(head)
            elif kind == 1:
                yield from ((now, e) for e in now.row(role, text))
    if now is not None:
        yield from ((now, e) for e in now.end())
        yield now, None


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, n: int, size) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += size(row)
        if len(held) >= n or weight > 16_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def audit(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Takes (conv, turn, role, text, gone) as `damaged` and `plain` give them. A conversation's rows stand in the order of their
    turns, nulls first; rows of one turn by role and by the SHA-256 of the text, so equal rows are neighbours. The first fault
    of a row counts: blank, duplicate (role and text stand earlier), truncated. audit has the initials of the cheapest edits, the
    ASCII-least of equal ones. A conversation whose rows are all gone has zeros, an empty audit and the digest of nothing; a null conv is
    a conversation; an empty table has none. Turns must span less than 2^63.
    """
    conv = rows.schema["conv"]
    schema = T.StructType([conv, *T.StructType.fromDDL(
        "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")])
    arrow = pa.schema([(conv.name, _arrow(conv.dataType)), *[(f.name, _arrow(f.dataType)) for f in schema[1:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            seen = sha256()
            first = True
            for now, edit in _walk(batches):
                if edit is None:
                    yield (now.conv, *now.summary(), seen.hexdigest())
                    seen, first = sha256(), True
                elif edit[1] is not None:
                    seen.update((b"" if first else b"\n") + edit[1].encode() + b":" + edit[2])
                    first = False
        yield from _in_batches(found(), arrow, 5_000, lambda row: len(row[7]))

    return _merged(rows).mapInArrow(run, schema)


def repair(rows: DataFrame) -> DataFrame:
    """The repaired conversations: (conv, place, edit, role, text), place from 0 on; deleted rows are left out."""
    conv = rows.schema["conv"]
    schema = T.StructType([conv, *T.StructType.fromDDL("place long, edit string, role string, text string")])
    arrow = pa.schema([(conv.name, _arrow(conv.dataType)), *[(f.name, _arrow(f.dataType)) for f in schema[1:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for now, edit in _walk(batches):
                if edit is not None and edit[1] is not None:
                    yield now.conv, now.place, edit[0], edit[1], edit[2].decode()
                    now.place += 1
        yield from _in_batches(found(), arrow, 5_000, lambda row: len(row[4]))

    return _merged(rows).mapInArrow(run, schema)
