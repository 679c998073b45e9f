"""Conversation structure repair by square-root checkpointed dynamic programming.

A conversation's role initials must read ``(s?(ua)+)?``. Edits of its rows: keep (cost 0),
rerole to user or assistant (2), delete (3; blank rows and duplicates must go) and insert
an empty user or assistant row anywhere (2); a truncated row that stays adds 1. Among the
cheapest sequences of edits the one whose initials (D, I, K, R) are ASCII-least is taken.

Rows are ordered and cut into blocks of about the square root of the longest conversation.

1. A block's transfer matrix holds its least cost from each state at its entry to each
   state at its exit (states: start, s, u, a). The matrices of a conversation are chained
   backwards, and the state-cost vectors at the block borders, the checkpoints, are all
   that is stored.
2. Walking forward, a block recomputes its vectors from the checkpoint at its exit and
   follows the least tight edits. For each of the four entry states the walk gives the exit
   state; chained forwards, these maps give the entry state of each block, and the walk from
   there emits the edits.

Both chains stream over one small record a block, so no task holds a conversation: neither
its rows, nor its texts. Rows equal in turn, role and text are counted before anything is
shuffled by conversation; the copies after the first one are all duplicates.

Defined results: null roles and texts count as one space; a null conv_id is a conversation
of its own; rows are ordered by turn (nulls first), role and digest of the text; a role
counts by its first letter; repeated rows are duplicates; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import materialize
from .common import GAP_CHARS

START, S, U, A = range(4)
FAR = 1 << 60
#: State after a kept initial, by state; where the next user/assistant row leads.
KEPT = {"s": (S, None, None, None), "u": (U, U, None, U), "a": (None, None, A, None)}
TURN = (U, U, A, U)
NAMES = {U: "user", A: "assistant"}
#: Least costs at the end of a conversation, inserts included.
LAST = (0, 4, 2, 0)
#: Blocks have at least so many rows.
LEAST_BLOCK = 256
FINE, TRUNCATED, MUST_GO = 0, 1, 2
BLOCK = ("conv_id long, bid long, pid int, seq int, n long, turns array<long>, roles array<string>, digests array<binary>, "
         "copies array<long>, faults array<int>, matrix array<long>, illegal long, first_turn long, last_turn long, "
         "distinct_turns long, first_role string, last_role string")


def clean(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, with one space for null roles and texts."""
    space = F.lit(" ")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))


def damage(rows: DataFrame) -> DataFrame:
    """The rows of :func:`clean` after damage by crc32(``conv_id:turn``) modulo 20."""
    def named(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn"))), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    copies = F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return clean(rows).filter(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies)).drop("col")


def faults(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row for equal rows, in two tables keyed by conv_id, turn, role and digest: the
    texts; copies and the first one's fault (blank, duplicate, truncated: at most one)."""
    keyed = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    runs = keyed.groupBy("conv_id", "turn", "role", "digest").agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"))
    bare = F.btrim("text", F.lit(GAP_CHARS))
    runs = materialize(runs.withColumn("blank", bare == "").withColumn(
        "open_end", ~F.right(bare, F.lit(1)).isin(".", "!", "?")), "conversation-rows")
    # the earliest turn of each text; joined on the whole key, which no two rows share
    ordered = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    earliest = (runs.groupBy("conv_id", "role", "digest").agg(F.min(ordered).alias("at"))
                .select("conv_id", "role", "digest", F.col("at.turn").alias("turn"), F.lit(True).alias("new")))
    repeated = F.col("new").isNull() & ~F.col("blank")
    found = runs.drop("text").alias("a").join(earliest.alias("b"), _same_row(), "left").select("a.*", repeated.alias("duplicate"))
    found = found.withColumn("truncated", F.col("open_end") & ~F.col("blank") & ~F.col("duplicate")).drop("open_end")
    return runs, materialize(found, "conversation-faults")


def _same_row() -> Column:
    """Rows ``a`` and ``b`` agree on the key of a row, nulls included."""
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("conv_id", "turn", "role", "digest")]
    return same[0] & same[1] & same[2] & same[3]


# ------------------------------------------------------------------ kernels
def closed(v: list[int]) -> list[int]:
    """Least costs with inserts allowed before what follows."""
    a, u = v[A], v[U]
    a, u = min(a, u + 2), min(u, a + 2)
    return [min(v[START], u + 2), min(v[S], u + 2), u, a]


def before_row(v: list[int], initial: str, fault: int, copies: int) -> list[int]:
    """Least costs before a row (and the copies that follow it) from those after it."""
    extra = 3 * (copies - 1)
    if fault == MUST_GO:
        return closed([x + 3 + extra for x in v])
    kept = KEPT.get(initial, (None,) * 4)
    out = []
    for q in range(4):
        best = min(v[q] + 3, v[TURN[q]] + 2 + fault)
        if kept[q] is not None:
            best = min(best, v[kept[q]] + fault)
        out.append(best + extra)
    return closed(out)


def matrix(initials, kinds, copies) -> list[int]:
    """Costs from each entry state (row) to each exit state of a block, flat."""
    columns = []
    for state in range(4):
        v = closed([0 if q == state else FAR for q in range(4)])
        for c, k, n in zip(reversed(initials), reversed(kinds), reversed(copies)):
            v = before_row(v, c, k, n)
        columns.append(v)
    return [min(columns[to][q], FAR) for q in range(4) for to in range(4)]


def vectors(exit_costs: list[int], initials, kinds, copies) -> list[list[int]]:
    """Costs before each row of a block and behind it, from those at its exit."""
    out = [list(exit_costs)]
    for c, k, n in zip(reversed(initials), reversed(kinds), reversed(copies)):
        out.append(before_row(out[-1], c, k, n))
    return out[::-1]


def walk(state: int, costs: list[list[int]], initials, kinds, copies, last: bool):
    """The ASCII-least tight edits of a block from an entry state: (letter, row, state
    after it) for each, the row being None for an insert, and the exit state."""
    out = []
    for i, (c, k, n) in enumerate(zip(initials, kinds, copies)):
        after, extra = costs[i + 1], 3 * (n - 1)
        while True:
            cost = costs[i][state]
            if cost == after[state] + 3 + extra:
                out.append(("D", i, state))
            elif cost == costs[i][TURN[state]] + 2:
                state = TURN[state]
                out.append(("I", None, state))
                continue
            else:
                kept = KEPT.get(c, (None,) * 4)[state]
                keep = kept is not None and cost == after[kept] + k + extra
                state = kept if keep else TURN[state]
                out.append(("K" if keep else "R", i, state))
            break
        out.extend([("D", i, state)] * (n - 1))
    while last and costs[-1][state]:
        state = TURN[state]
        out.append(("I", None, state))
    return out, state


# ------------------------------------------------------------------ Spark steps
def _initials(roles) -> list[str]:
    return [r[:1] for r in roles]


def blocks(runs: DataFrame, size: int) -> DataFrame:
    """The rows in order, one record for each block of at most ``size`` rows of a
    conversation, with its transfer matrix (schema ``BLOCK``)."""
    kind = F.when(F.col("blank") | F.col("duplicate"), MUST_GO).when(F.col("truncated"), TRUNCATED).otherwise(FINE)
    order = ["conv_id", "turn", "role", "digest"]
    sorted_ = (runs.select(*order, "copies", kind.alias("fault")).repartitionByRange(*order)
               .sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id()))

    def record(conv, pid, seq, rows):
        turns, roles, digests, copies, kinds = map(list, zip(*rows))
        first = _initials(roles)
        pairs = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
        known = {t for t in turns if t is not None}
        return (conv, pid << 40 | seq, pid, seq, sum(copies), turns, roles, digests, copies, kinds,
                matrix(first, kinds, copies), pairs + sum(copies) - len(copies),
                min(known, default=None), max(known, default=None), len(known), roles[0], roles[-1])

    def cut(batches):
        here, rows, seq = None, [], 0
        for batch in batches:
            out = []
            for conv, turn, role, digest, copies, fault, pid in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and (len(rows) == size or conv != here[0]):
                    out.append(record(*here, seq, rows))
                    rows, seq = [], seq + 1
                here = (conv, pid)
                rows.append((turn, role, digest, copies, fault))
            yield _batch(out, schema)
        if rows:
            yield _batch([record(*here, seq, rows)], schema)

    schema = _arrow(BLOCK)
    return sorted_.mapInArrow(cut, BLOCK)


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _stream(df: DataFrame, order: list[Column], step, ddl: str) -> DataFrame:
    """Records of each conversation in order through ``step(conv is new, record, carry)``,
    which returns the rows to emit and the carry; nothing but the carry is held."""
    schema = _arrow(ddl)

    def run(batches):
        carry, here = None, ()
        for batch in batches:
            out = []
            for record in batch.to_pylist():
                new = here != (record["conv_id"],)
                here = (record["conv_id"],)
                rows, carry = step(new, record, carry)
                out += rows
            yield _batch(out, schema)

    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order).mapInArrow(run, ddl)


def checkpoints(cut: DataFrame) -> DataFrame:
    """bid, the costs at the block's exit, those at its entry, and whether it is its
    conversation's last: the matrices chained backwards."""
    def step(new, r, carry):
        exit_costs = list(LAST) if new else carry
        m = r["matrix"]
        entry = [min(min(m[4 * q + to] + exit_costs[to] for to in range(4)), FAR) for q in range(4)]
        return [(r["conv_id"], r["bid"], exit_costs, entry, new)], entry

    small = cut.select("conv_id", "bid", "pid", "seq", "matrix")
    return _stream(small, [F.col("pid").desc(), F.col("seq").desc()], step,
                   "conv_id long, bid long, exit array<long>, entry array<long>, last boolean")


def entry_states(mapped: DataFrame) -> DataFrame:
    """bid and the state the walk enters the block in, from the exit states of each
    block (``exits``, by entry state) chained forwards."""
    def step(new, r, carry):
        state = START if new else carry
        return [(r["bid"], state)], r["exits"][state]

    small = mapped.select("conv_id", "bid", "pid", "seq", "exits")
    return _stream(small, [F.col("pid"), F.col("seq")], step, "bid long, state int")


def summaries(cut: DataFrame) -> DataFrame:
    """conv_id, gaps in its turns and illegal neighbours of roles, from the blocks."""
    def step(new, r, carry):
        turns, illegal, low, high, role = (0, 0, None, None, None) if new else carry
        turns += r["distinct_turns"]
        if r["first_turn"] is not None:
            turns -= r["first_turn"] == high
            low, high = r["first_turn"] if low is None else low, r["last_turn"]
        illegal += r["illegal"]
        if role is not None:
            illegal += role[:1] + r["first_role"][:1] not in ("su", "ua", "au")
        gaps = 0 if low is None else high - low + 1 - turns
        return [(r["conv_id"], r["pid"], r["seq"], gaps, illegal)], (turns, illegal, low, high, r["last_role"])

    small = cut.select("conv_id", "pid", "seq", "illegal", "first_turn", "last_turn", "distinct_turns", "first_role", "last_role")
    run = _stream(small, [F.col("pid"), F.col("seq")], step, "conv_id long, pid int, seq int, gaps long, illegal long")
    return run.groupBy("conv_id").agg(F.max(F.struct("pid", "seq", "gaps", "illegal")).alias("s")).select(
        "conv_id", "s.gaps", "s.illegal")


def _parts(r):
    return _initials(r["roles"]), r["faults"], r["copies"]


def edits(cut: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per block its ``audit`` letters (with pid, seq, and for its first block the cost),
    and per edit that leaves a row: conv_id, pid, seq, at, turn, role and digest of the
    original (null for inserts) and the new role."""
    points = checkpoints(cut)
    placed = cut.join(points.drop("conv_id"), "bid")
    ddl = BLOCK + ", exit array<long>, entry array<long>, last boolean, exits array<int>"
    names = [c.strip().split(" ")[0] for c in ddl.split(", ")]

    schema = _arrow(ddl)

    def exits(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                costs = vectors(r["exit"], *_parts(r))
                found = [walk(q, costs, *_parts(r), r["last"])[1] if costs[0][q] < FAR else START for q in range(4)]
                out.append(tuple(r[c] for c in names[:-1]) + (found,))
            yield _batch(out, schema)

    mapped = materialize(placed.select(*names[:-1]).mapInArrow(exits, ddl), "conversation-blocks")
    entered = mapped.join(entry_states(mapped), "bid")
    out_ddl = ("conv_id long, pid int, seq int, cost long, audit string, kept array<struct<at:int,turn:long,role:string,"
               "digest:binary,name:string>>")

    out_schema = _arrow(out_ddl)

    def emit(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                costs = vectors(r["exit"], *_parts(r))
                found, _ = walk(r["state"], costs, *_parts(r), r["last"])
                kept = []
                for letter, i, state in found:
                    if letter == "I":
                        kept.append((len(kept), None, None, None, NAMES[state]))
                    elif letter != "D":
                        name = r["roles"][i] if letter == "K" else NAMES[state]
                        kept.append((len(kept), r["turns"][i], r["roles"][i], r["digests"][i], name))
                kept = [dict(zip(("at", "turn", "role", "digest", "name"), k)) for k in kept]
                out.append((r["conv_id"], r["pid"], r["seq"], r["entry"][START], "".join(x[0] for x in found), kept))
            yield _batch(out, out_schema)

    walked = materialize(entered.select(*names[:-1], "state").mapInArrow(emit, out_ddl), "conversation-edits")
    rows = walked.select("conv_id", "pid", "seq", F.explode("kept").alias("k")).select("conv_id", "pid", "seq", "k.*")
    return walked.drop("kept"), rows


def repaired_rows(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """conv_id, pid, seq, at (the order), role and text of the repaired conversations;
    ``rows`` has the texts by conv_id, turn, role and digest."""
    a, b = kept.alias("a"), rows.select("conv_id", "turn", "role", "digest", "text").alias("b")
    old = F.col("a.digest").isNotNull()
    found = a.filter(old).join(b, _same_row())
    columns = ["a.conv_id", "pid", "seq", "at", F.col("name").alias("role")]
    return found.select(*columns, "text").unionByName(a.filter(~old).select(*columns, F.lit("").alias("text")))


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its ``role:text`` lines, joined by newlines. The hash is
    sequential, so a conversation's rows stream through one task, none of them held."""
    schema = _arrow("conv_id long, repaired_sha256 string")

    def run(batches):
        here, state = None, None
        for batch in batches:
            out = []
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text"))):
                if state is None or here != conv:
                    if state is not None:
                        out.append((here, state.hexdigest()))
                    here, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield _batch(out, schema)
        if state is not None:
            yield _batch([(here, state.hexdigest())], schema)

    order = ["conv_id", "pid", "seq", "at"]
    return repaired.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair(rows: DataFrame, size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(audits, repaired rows) of conversations as :func:`clean` gives them. Audits:
    conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit."""
    texts, runs = faults(rows)
    counts = runs.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).when(F.col("duplicate"), F.col("copies")).otherwise(F.col("copies") - 1)).alias("duplicate"),
        F.sum(F.col("truncated").cast("long")).alias("truncated"))
    if size is None:  # the square root of the longest conversation
        longest = counts.agg(F.max("rows")).first()[0] or 0
        size = max(LEAST_BLOCK, math.isqrt(longest) + 1)
    cut = materialize(blocks(runs, size), "conversation-cut")
    audits, kept = edits(cut)
    piece = F.struct("pid", "seq", "cost", "audit")
    audits = audits.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("p"))  # a row for each block
    audits = audits.select("conv_id", F.col("p")[0]["cost"].alias("cost"), F.array_join(F.col("p.audit"), "").alias("audit"))
    out = counts.drop("rows")
    for other in (summaries(cut), audits):
        other = other.withColumnRenamed("conv_id", "other_id")
        out = out.join(other, F.col("conv_id").eqNullSafe(F.col("other_id"))).drop("other_id")
    return out, repaired_rows(texts, kept)


def report(conversations: DataFrame) -> DataFrame:
    """Every conv_id of the table with the audit of its damaged rows and the digest of
    the repaired ones."""
    audits, repaired = repair(damage(conversations))
    out = clean(conversations).select("conv_id").distinct()
    for other in (audits, digests(repaired)):
        other = other.withColumnRenamed("conv_id", "other_id")
        out = out.join(other, F.col("conv_id").eqNullSafe(F.col("other_id")), "left").drop("other_id")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
