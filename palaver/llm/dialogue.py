"""Repair of conversations: the cheapest edits that give ``(s?(ua)+)?``, by lazy weighted determinisation.

The grammar has four states; the cheapest costs to finish a conversation from each of them, less
their least, are a vector, and the vectors are the states of a deterministic automaton that reads
the rows from last to first.  Its transitions are computed when first met and kept in a table, so
that a conversation's cost is one look-up a row.  The trace runs the other way, from the first row
on, along arcs that are tight between neighbouring vectors; the least letter of those comes first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from palaver.llm.common import checkpoint, give_back

#: Costs of the edits; a row that ends without a full stop costs one more where it stays.
DELETE, INSERT, REROLE, STAYS = 3, 2, 2, 1
#: Characters that don't count as text.
SPACES = " \t\n\x0b\f\r"
#: Rows of a shared conversation whose letters are one value at first: two to the power of this.
BLOCK_BITS = 16
#: The block of what is inserted after all rows.
TAIL = 1 << 62

# A row's symbol is a letter: 4 * its role's class (s, u, a, other) + its fault.
CLEAN, BLANK, DUPLICATE, TRUNCATED = range(4)
LETTERS = "ABCDEFGHIJKLMNOP"
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
ENDS = (START, AFTER_ASSISTANT)
NEW_ROLE = ("user", "user", "assistant", "user")


def _next(state: int) -> int:
    """Where a new user or assistant row leads: only one of the two is allowed in a state."""
    return AFTER_ASSISTANT if state == AFTER_USER else AFTER_USER


def _kept(state: int, role: int) -> int | None:
    """Where a row of this role class leads as it is."""
    if role == 0:
        return AFTER_SYSTEM if state == START else None
    if role == 1:
        return AFTER_USER if state != AFTER_USER else None
    return AFTER_ASSISTANT if role == 2 and state == AFTER_USER else None


class Repairer:
    """The automaton, grown as conversations need it."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.known: dict[tuple[int, ...], int] = {}
        self.table: list[list[tuple[int, int] | None]] = []
        self.arcs: dict[tuple[int, int, int], tuple[str, int]] = {}
        self.last = self._state(self._closed([0, 99, 99, 0]))[0]

    @staticmethod
    def _closed(costs: list[int]) -> list[int]:
        for _ in costs:
            costs = [min(c, INSERT + costs[_next(q)]) for q, c in enumerate(costs)]
        return costs

    def _state(self, costs: list[int]) -> tuple[int, int]:
        least = min(costs)
        vector = tuple(c - least for c in costs)
        if vector not in self.known:
            self.known[vector] = len(self.vectors)
            self.vectors.append(vector)
            self.table.append([None] * len(LETTERS))
        return self.known[vector], least

    def _moves(self, symbol: int, state: int) -> Iterator[tuple[str, int, int]]:
        """(letter, cost, next state) of what may be done with a row, in the letters' order."""
        role, fault = divmod(symbol, 4)
        yield "D", DELETE, state
        if fault in (CLEAN, TRUNCATED):
            more = STAYS if fault == TRUNCATED else 0
            if (to := _kept(state, role)) is not None:
                yield "K", more, to
            yield "R", more + REROLE, _next(state)

    def step(self, after: int, symbol: int) -> tuple[int, int]:
        """The vector before a row, given the vector after it, and the cost by which the least grows."""
        found = self.table[after][symbol]
        if found is None:
            costs = self.vectors[after]
            found = self._state(self._closed([min(c + costs[to] for _, c, to in self._moves(symbol, q)) for q in range(4)]))
            self.table[after][symbol] = found
        return found

    def arc(self, after: int, symbol: int, state: int) -> tuple[str, int]:
        """The least letters that are cheapest for a row in this state, insertions before it included, and the next state."""
        key = (after, symbol, state)
        if key not in self.arcs:
            before, grown = self.step(after, symbol)
            letters, costs = "", self.vectors[before]
            while True:
                # D < I < K < R
                tight = {x: to for x, c, to in self._moves(symbol, state) if c + self.vectors[after][to] == costs[state] + grown}
                if costs[state] == INSERT + costs[_next(state)]:
                    tight["I"] = _next(state)
                letter = min(tight)
                letters, state = letters + letter, tight[letter]
                if letter != "I":
                    break
            self.arcs[key] = (letters, state)
        return self.arcs[key]

    def repair(self, symbols: str) -> tuple[int, list[str]]:
        """The cost, and the letters by row; those of rows inserted at the end come last."""
        codes = [ord(c) - 65 for c in symbols]
        after, cost, vectors = self.last, 0, []
        for symbol in reversed(codes):
            vectors.append(after)
            after, grown = self.step(after, symbol)
            cost += grown
        cost += self.vectors[after][START]
        state, edits = START, []
        for symbol in codes:
            letters, state = self.arc(vectors.pop(), symbol, state)
            edits.append(letters)
        tail = ""
        while state not in ENDS:
            tail, state = tail + "I", _next(state)
        return cost, [*edits, tail]


def counts(symbols: str) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated rows, and neighbours whose initials aren't su, ua or au."""
    faults = [sum(symbols.count(LETTERS[4 * r + f]) for r in range(4)) for f in (BLANK, DUPLICATE, TRUNCATED)]
    roles = symbols.translate({ord(x): "suao"[i // 4] for i, x in enumerate(LETTERS)})
    legal = sum(map((lambda a, b: a + b in LEGAL), roles, roles[1:]))
    return *faults, max(0, len(roles) - 1) - legal


LEGAL = ("su", "ua", "au")


class Applied:
    """Rows that come out of a conversation's edits, hashed one after another; nothing else is kept of them."""

    def __init__(self) -> None:
        self.hash, self.state, self.any = hashlib.sha256(), START, False

    def _out(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.any else "") + role + ":" + text).encode())
        self.any = True

    def apply(self, letters: str, role: str = "", text: str = "") -> None:
        for letter in letters:
            if letter == "D":
                continue
            if letter == "K":
                self._out(role, text)
                self.state = _kept(self.state, "sua".index(role[0]))
            else:
                self._out(NEW_ROLE[self.state], "" if letter == "I" else text)
                self.state = _next(self.state)


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with the damage that crc32 of ``conv_id:turn`` deals out, and in ``gone`` those that it drops.

    Nulls count as one space, in the key and in what is damaged; a row that is repeated has ``times`` 2.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    deal = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return rows.select(
        "conv_id", "turn",
        F.when(deal == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(deal == 1, F.lit("")).when(deal == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (deal == 0).alias("gone"), F.when(deal == 3, 2).otherwise(1).cast("bigint").alias("times"),
    )


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal rows of a batch as one row that counts them, before anything is shuffled."""
    for batch in batches:
        keys = [c for c in batch.schema.names if c != "times"]
        found = pa.Table.from_batches([batch]).group_by(keys).aggregate([("times", "sum")])
        yield from found.select([*keys, "times_sum"]).rename_columns([*keys, "times"]).to_batches()
    give_back()


def _fault(text: Column) -> Column:
    shown = F.rtrim(text, F.lit(SPACES))
    return F.when(shown == "", BLANK).when(F.substring(shown, -1, 1).isin(".", "!", "?"), CLEAN).otherwise(TRUNCATED)


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair_conversations(rows: DataFrame) -> DataFrame:
    """A row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``rows`` has conv_id, turn (a whole number), role and text, and may have ``times`` (how often a row
    stands there) and ``gone`` (the row isn't there, but its conversation is).  Null ids are one
    conversation; rows go by turn, nulls first, then by role and text; a null role or text is one
    space; equal rows of one turn stand together.  An empty table gives no rows, a conversation whose
    rows are all gone zeros.  Other columns are not read; texts of any length are read whole.

    Rows are range-partitioned and sorted, so that conversations follow each other in a partition and
    one of very many rows is several partitions.  A conversation that lies in one partition is
    repaired as the partition is read.  Of those that several partitions share (fewer than there are
    partitions) only a letter a row is brought together, no more than the audit that they must return
    as one value; their texts are then hashed in order by a task that holds one batch of them, as a
    sha256 can only be computed in order.
    """
    spark = rows.sparkSession
    have = rows.columns
    slim = rows.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        (F.coalesce("gone", F.lit(False)) if "gone" in have else F.lit(False)).alias("gone"),
        (F.col("times").cast("bigint") if "times" in have else F.lit(1).cast("bigint")).alias("times"),
    ).withColumn("text", F.when(F.col("gone"), F.lit("")).otherwise(F.col("text")))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    merged = slim.mapInArrow(_merged, slim.schema).repartitionByRange(*order[:3], F.substring("text", 1, 32)).sortWithinPartitions(*order, "gone")
    role = F.array_position(F.array(*map(F.lit, "sua")), F.substring("role", 1, 1)).cast("int")
    placed = checkpoint(merged).select("*", (4 * F.when(role == 0, 3).otherwise(role - 1) + _fault(F.col("text"))).cast("int").alias("code"), F.monotonically_increasing_id().alias("pos"))
    edges = placed.groupBy(F.shiftright("pos", 33).alias("part")).agg(F.min(F.struct("pos", "conv_id")).alias("a"), F.max(F.struct("pos", "conv_id")).alias("b"))
    ends = edges.select("part", F.explode(F.array_distinct(F.array("a.conv_id", "b.conv_id"))).alias("c"))
    shared = [r["c"] for r in ends.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where("n > 1").collect()]  # fewer than partitions
    kind = slim.schema["conv_id"]
    result = StructType([kind, *StructType.fromDDL(RESULT).fields])
    if not shared:
        return placed.mapInArrow(_repaired(kind.name), result)
    ids = F.broadcast(spark.createDataFrame([(c,) for c in shared], StructType([StructField("c", kind.dataType)])))
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    whole = placed.join(ids, same, "left_anti").mapInArrow(_repaired(kind.name), result)
    return whole.unionByName(_repair_shared(placed.join(ids, same, "left_semi"), result))


def _repaired(name: str):
    """Repairs the conversations of a sorted partition one after another."""

    def finished(tool: Repairer, conv: object, held: list[tuple]) -> tuple:
        seen, symbols, turns = set(), [], set()
        for turn, role, text, times, code in held:
            again = (code & ~3) | DUPLICATE if code & 3 != BLANK else code
            symbols.append(LETTERS[again if (role, text) in seen else code] + LETTERS[again] * (times - 1))
            seen.add((role, text))
            turns.add(turn)
        turns.discard(None)
        every = "".join(symbols)
        cost, edits = tool.repair(every)
        out, at = Applied(), 0
        for (_, role, text, times, _), own in zip(held, symbols, strict=True):
            for letters in edits[at : at + len(own)]:
                out.apply(letters, role, text)
            at += len(own)
        out.apply(edits[-1])
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        return (conv, gaps, *counts(every), cost, "".join(edits), out.hash.hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, conv, held, begun, done = Repairer(), None, [], False, []
        schema = None
        for batch in batches:
            names = [name, *(f.split()[0] for f in RESULT.split(", "))]
            schema = pa.schema([pa.field(name, batch.schema.field("conv_id").type), *(pa.field(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in names[1:])])
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone", "times", "code")]
            for c, turn, role, text, gone, times, code in zip(*columns, strict=True):
                if not begun or c != conv:
                    if begun:
                        done.append(finished(tool, conv, held))
                    conv, held, begun = c, [], True
                if not gone:
                    if held and held[-1][0] == turn and held[-1][1:3] == (role, text):
                        held[-1] = (turn, role, text, held[-1][3] + times, code)
                    else:
                        held.append((turn, role, text, times, code))
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, d, strict=True)) for d in done], schema)
                done = []
        if begun:
            yield pa.RecordBatch.from_pylist([dict(zip(names, finished(tool, conv, held), strict=True))], schema)
        give_back()

    return run


def _repair_shared(rows: DataFrame, result: StructType) -> DataFrame:
    """The same for conversations of several partitions: their symbols are put together, then their texts hashed in order."""
    rows = checkpoint(rows.withColumn("key", F.sha2(F.concat_ws(":", F.octet_length("role"), "role", "text"), 256)))
    there = rows.where(~F.col("gone"))
    first = there.groupBy("conv_id", "key").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    again = F.when(F.col("code").bitwiseAND(3) == BLANK, F.col("code")).otherwise(F.col("code").bitwiseAND(12) + DUPLICATE)

    def letter(code: Column) -> Column:
        return F.substring(F.lit(LETTERS), code + 1, F.lit(1))

    coded = there.select("conv_id", "pos", "times", "code").join(first, "pos", "left").select(
        "conv_id", "pos", F.concat(letter(F.when(F.col("first"), F.col("code")).otherwise(again)), F.repeat(letter(again), (F.col("times") - 1).cast("int"))).alias("symbols")
    )
    blocks = coded.groupBy("conv_id", F.shiftright("pos", BLOCK_BITS).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "symbols"))).alias("s"))
    joined = blocks.select("conv_id", "block", F.array_join(F.col("s.symbols"), "").alias("symbols"))
    each = joined.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "symbols"))).alias("blocks"))
    name = result.fields[0].name
    judged_schema = StructType([result.fields[0], *StructType.fromDDL("blank long, duplicate long, truncated long, illegal long, cost long, audit string, edits array<struct<block: long, letters: string>>").fields])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Repairer()
        for batch in batches:
            for i in range(batch.num_rows):
                parts = batch.column(1)[i].as_py()
                every = "".join(p["symbols"] for p in parts)
                cost, edits = tool.repair(every)
                at, listed = 0, []
                for p in parts:
                    listed.append({"block": p["block"], "letters": " ".join(edits[at : at + len(p["symbols"])])})
                    at += len(p["symbols"])
                listed.append({"block": TAIL, "letters": edits[-1]})
                numbers = [pa.array([x], pa.int64()) for x in (*counts(every), cost)]
                kind = pa.list_(pa.struct([("block", pa.int64()), ("letters", pa.string())]))
                columns = [batch.column(0).slice(i, 1), *numbers, pa.array(["".join(edits)]), pa.array([listed], kind)]
                yield pa.RecordBatch.from_arrays(columns, names=judged_schema.names)

    found = checkpoint(each.mapInArrow(judged, judged_schema))
    # the letters of a block stand before its rows
    edits = found.select("conv_id", F.explode("edits").alias("e")).select("conv_id", "e.block", F.lit(-1).cast("bigint").alias("pos"), F.lit(None).cast("string").alias("role"), F.col("e.letters").alias("text"), F.lit(0).cast("bigint").alias("times"))
    texts = there.select("conv_id", F.shiftright("pos", BLOCK_BITS).alias("block"), "pos", "role", "text", "times")
    stream = texts.unionByName(edits).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "block", "pos")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, out, letters, begun = None, Applied(), iter(()), False

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([out.hash.hexdigest()])], names=["c", "repaired_sha256"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for c, block, _, role, text, times in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if not begun or c != conv:
                    if begun:
                        yield row()
                    conv, out, begun = c, Applied(), True
                if role is not None:
                    for _ in range(times):
                        out.apply(next(letters), role, text)
                elif block == TAIL:
                    out.apply(text)
                else:
                    letters = iter(text.split(" "))
        if begun:
            yield row()

    hashes = stream.mapInArrow(hashed, StructType([StructField("c", result.fields[0].dataType), StructField("repaired_sha256", StringType())]))
    turns = there.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n")).where("turn IS NOT NULL").groupBy("conv_id")
    gaps = turns.agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps")).withColumnRenamed("conv_id", "g")
    every = rows.select(F.col("conv_id").alias("of")).distinct()
    of = F.col("of")
    return (
        every.join(found, of.eqNullSafe(F.col("conv_id")), "left").join(hashes, of.eqNullSafe(F.col("c")), "left").join(gaps, of.eqNullSafe(F.col("g")), "left")
        .select(of.alias(name), *[F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
    )
