"""Structure repair of conversations with an audit of the edits, over whole tables.

Rows are damaged on purpose first (``damaged``), then judged and repaired (``repair``). Rows of a conversation
stand in order of turn (nulls first), role and text (code points); equal rows are one run with a
count. The first fault of a row counts: blank, duplicate (role and text seen earlier), truncated.

The edits are found by the dynamic program of ``repair_dp``. Rows are dealt by ranges of their order, so a long
conversation is cut into blocks of at most ``BLOCK_ROWS`` runs in many tasks. A block gives the best way from each
state to each state; the few blocks of a conversation are then chained. Ways within a block need
memory in proportion to the block.

The repaired text's SHA-256 can only be taken byte after byte. So at the end the rows of a conversation
pass through one task in their order, as a stream: that task holds the edits (one letter a row) and one batch.

Defined results: null role, text, and null turn or conversation id in the damage key are one space; null turns
stand first and count in no gap; a null id is a conversation of its own. Empty role: no initial, so illegal
beside any row. A conversation whose rows are all lost has zeros, an empty audit and the hash of the
empty string. An empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firnlake.llm.common import stored, table
from firnlake.llm.repair_dp import START, STATES, Block, applied, chained

BLOCK_ROWS = 4096

# What the remainder of the damage key does to a row.
DROP, EMPTY, UNEND, TWICE, AS_USER = range(5)
DAMAGE_OF = 20
ENDS = ".!?"
LEGAL = {"su", "ua", "au"}


def _spaced(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of what is left after the damage; null role and text become a space."""
    kind = F.crc32(F.concat(_spaced("conv_id"), F.lit(":"), _spaced("turn")).cast("binary")) % DAMAGE_OF
    out = rows.select("conv_id", "turn", _spaced("role").alias("role"), _spaced("text").alias("text"), kind.alias("kind")).where(F.col("kind") != DROP)
    text = F.when(F.col("kind") == EMPTY, "").when(F.col("kind") == UNEND, F.regexp_replace("text", r"[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == AS_USER, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == TWICE, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    out = out.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))
    return out.drop("copy")


def _key(column: str = "conv_id") -> Column:
    """Conversation ids as text; the null id is a key too."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


ORDER = ["turn", "role", "text"]  # Spark sorts null turns first


def _runs(rows: DataFrame) -> DataFrame:
    """Equal rows as one with a count ``n``; ``first`` where the role and text are new to the conversation."""
    runs = rows.select(_key().alias("conv"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    runs = stored(runs.groupBy("conv", *ORDER).agg(F.count(F.lit(1)).alias("n")), "repair-runs")
    marked = runs.withColumn("mark", F.md5(F.concat_ws(":", F.length("role"), "role", "text")))
    # summed in each task, then joined back: a text said in every turn is not gathered in one task
    place = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))
    earliest = marked.groupBy("conv", "mark").agg(F.count(F.lit(1)).alias("m"), F.min(place).alias("at")).where("m > 1")
    earliest = earliest.select(F.col("conv").alias("e_conv"), F.col("mark").alias("e_mark"), "at")
    earliest = stored(earliest, "repair-earliest")
    joined = marked.join(earliest, (F.col("conv") == F.col("e_conv")) & (F.col("mark") == F.col("e_mark")), "left")
    first = F.col("at").isNull() | (F.col("at.turn").eqNullSafe(F.col("turn")))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    tail = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return joined.select(
        "conv", *ORDER, "n", first.alias("first"), blank.alias("blank"), (~tail.isin(*ENDS)).alias("cut_off"), F.substring("role", 1, 1).alias("initial")
    )


BLOCK = (
    "conv string, kind int, task int, nth int, rows long, gap_first long, gap_last long, turns long, blank long, duplicate long, truncated long, "
    "illegal long, head string, tail string, ways array<struct<entry:int,state:int,cost:long,edits:string>>"
)
WAY = pa.struct([("entry", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())])
BLOCK_TYPES = [pa.string(), *[pa.int32()] * 3, *[pa.int64()] * 8, pa.string(), pa.string(), pa.list_(WAY)]
BLOCK_NAMES = [x.split()[0] for x in BLOCK.split(", ")]


class _Counts:
    """What is known of a block of one conversation while its rows pass."""

    def __init__(self, conv: str, nth: int, entries: tuple[int, ...]):
        self.conv, self.nth = conv, nth
        self.block = Block(entries)
        self.turn_first = self.turn_last = None
        self.runs = self.rows = self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.head = self.tail = None

    def add(self, turn, n: int, first: bool, blank: bool, cut_off: bool, initial: str) -> None:
        if turn is not None:
            if turn != self.turn_last:
                self.turns += 1
            self.turn_first = turn if self.turn_first is None else self.turn_first
            self.turn_last = turn
        self.head = initial if self.head is None else self.head
        if self.tail is not None and self.tail + initial not in LEGAL:
            self.illegal += 1
        self.illegal += (n - 1) if initial + initial not in LEGAL else 0
        self.tail = initial
        self.runs += 1
        self.rows += n
        if blank:
            self.blank += n
            self.block.drop(n)
            return
        self.duplicate += n - first
        if first:
            self.truncated += cut_off
            self.block.add(initial, False, cut_off)
        self.block.drop(n - first)

    def row(self, task: int) -> tuple:
        ways = [dict(zip(("entry", "state", "cost", "edits"), w, strict=True)) for w in self.block.table()]
        return (
            self.conv, 1, task, self.nth, self.rows, self.turn_first, self.turn_last, self.turns, self.blank, self.duplicate,
            self.truncated, self.illegal, self.head, self.tail, ways,
        )


def _blocks(runs: DataFrame, block_rows: int) -> DataFrame:
    """One row for each block of a conversation, numbered by task and place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        now: _Counts | None = None
        nth = 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), BLOCK_TYPES, strict=True)], names=BLOCK_NAMES)

        for batch in batches:
            done = []
            for conv, turn, n, first, blank, cut_off, initial in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now is None or now.conv != conv or now.block.rows >= block_rows:
                    same = now is None or now.conv == conv  # may go on from the task before, or does from the block before
                    if now is not None:
                        done.append(now.row(task))
                        nth += 1
                    now = _Counts(conv, nth, STATES if same else (START,))
                # a long run of equal rows goes on in blocks of its own
                while n > block_rows:
                    now.add(turn, block_rows, first, blank, cut_off, initial)
                    n, first = n - block_rows, False
                    done.append(now.row(task))
                    nth += 1
                    now = _Counts(conv, nth, STATES)
                now.add(turn, n, first, blank, cut_off, initial)
                if len(done) >= 1000:
                    yield batch_of(done)
                    done = []
            if done:
                yield batch_of(done)
        if now is not None:
            yield batch_of([now.row(task)])

    dealt = runs.repartitionByRange("conv", *ORDER).sortWithinPartitions("conv", *ORDER)
    return dealt.select("conv", "turn", "n", "first", "blank", "cut_off", "initial").mapInArrow(run, BLOCK)


RESULT = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
RESULT_TYPES = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]
RESULT_NAMES = [x.split()[0] for x in RESULT.split(", ")]


class _Repair:
    """One conversation at the end: blocks first, then the rows in order."""

    def __init__(self, conv: str):
        self.conv, self.blocks = conv, []
        self.sums = [0] * 5
        self.low = self.high = self.tail = None
        self.tables: list = []
        self.edits, self.cost, self.at = "", 0, None
        self.digest, self.some = hashlib.sha256(), False

    def block(self, b: dict) -> None:
        turns = b["turns"]
        if turns:
            self.low = b["gap_first"] if self.low is None else self.low
            turns -= b["gap_first"] == self.high
            self.high = b["gap_last"]
        illegal = b["illegal"] + (self.tail is not None and self.tail + b["head"] not in LEGAL)
        self.tail = b["tail"]
        for i, x in enumerate((turns, b["blank"], b["duplicate"], b["truncated"], illegal)):
            self.sums[i] += x
        self.tables.append([(w["entry"], w["state"], w["cost"], w["edits"]) for w in b["ways"]])

    def _write(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.some else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.some = True

    def _start(self) -> None:
        if self.at is None:
            self.cost, self.edits = chained(self.tables)
            self.tables = []
            self.at = applied(self.edits)
            next(self.at)

    def _inserted(self, initial: str) -> tuple:
        """The next edit that is for a row, with insertions before it written; or None at the end."""
        while True:
            try:
                letter, role = self.at.send(initial)
            except StopIteration:
                return None, None
            if letter != "I":
                return letter, role
            self._write(role, "")

    def rows(self, role: str, text: str, n: int) -> None:
        self._start()
        for _ in range(n):
            letter, new = self._inserted(role[:1])
            if letter != "D":
                self._write(new or role, text)

    def row(self) -> tuple:
        if self.tables:
            self._start()
        if self.at is not None:
            self._inserted("")
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.sums[0]
        return (self.conv, gaps, *self.sums[1:], self.cost, self.edits, self.digest.hexdigest())


def _repaired(convs: DataFrame, blocks: DataFrame, runs: DataFrame) -> DataFrame:
    """Results of conversations; a row of ``convs`` stands before its blocks (kind 1) and rows (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Repair | None = None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), RESULT_TYPES, strict=True)], names=RESULT_NAMES)

        for batch in batches:
            done = []
            names = batch.schema.names
            columns = [c.to_pylist() for c in batch.columns]
            for values in zip(*columns, strict=True):
                r = dict(zip(names, values, strict=True))
                if now is None or now.conv != r["conv"]:
                    if now is not None:
                        done.append(now.row())
                    now = _Repair(r["conv"])
                if r["kind"] == 1:
                    now.block(r)
                elif r["kind"] == 2:
                    now.rows(r["role"], r["text"], r["n"])
            if done:
                yield batch_of(done)
        if now is not None:
            yield batch_of([now.row()])

    rows = runs.select("conv", F.lit(2).alias("kind"), *ORDER, "n")
    every = convs.select("conv", F.lit(0).alias("kind")).unionByName(blocks, allowMissingColumns=True).unionByName(rows, allowMissingColumns=True)
    count = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = every.repartition(count, "conv").sortWithinPartitions("conv", "kind", "task", "nth", *ORDER)
    return dealt.mapInArrow(run, RESULT)


def repair(rows: DataFrame, original: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Faults, cost, audit and hash of every conversation of ``rows`` (conv_id, turn, role, text), and of ``original``."""
    runs = stored(_runs(rows), "repair-rows")
    blocks = stored(_blocks(runs, block_rows), "repair-blocks")
    convs = (rows if original is None else original).select(_key().alias("conv"), "conv_id").groupBy("conv").agg(F.first("conv_id").alias("conv_id"))
    convs = stored(convs, "repair-ids")
    found = _repaired(convs, blocks, runs)
    return found.join(convs, "conv").select("conv_id", *RESULT_NAMES[1:])


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation after the damage, repaired."""
    original = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return repair(damaged(original), original)
