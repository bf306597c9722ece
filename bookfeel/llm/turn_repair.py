"""Cheapest repair of conversation structure by an automaton of shared suffixes.

A conversation's turns become a signature, one symbol a row: its role (``s``, ``u``,
``a``, ``o`` for another), upper case where the text is cut off, or ``X`` where the row
is blank or a duplicate and has to go. Signatures are minimised from the end: two
conversations share every node (one symbol and the node after it) of a common suffix.
The distinct signatures of the whole table are sorted by their reversed text, so a
node whose path is left never returns and the register of a task is the path in hand.
Each node gets, once for all conversations, its cost-to-go and the first edit of the
best audit for every state of the grammar ``(s?(ua)+)?``.

From a state every edit letter leads to one state only, so audits of one cost are
settled by their first letters: the least letter in ASCII order is taken.

What is defined: null roles and texts read as one space; rows of one turn go by role and
then by the digest of role and text (equal rows side by side), null turns first; a null
conversation id is a conversation; an empty table gives no rows. Other columns are not
looked at, whatever their names. A conversation is streamed through one task (a digest of
its whole text cannot be had otherwise); the task holds its signature, a byte a row, no
texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import written
from ..operators.joins import skew_join

# Costs of the edits, and what an undeleted cut-off row adds.
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
# Grammar: 0 nothing yet, 1 after the system turn, 2 after a user turn, 3 after an assistant turn.
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
FOLLOWS = (AFTER_USER, AFTER_USER, AFTER_ASSISTANT, AFTER_USER)  # state after the next user or assistant turn
WANTED = ("u", "u", "a", "u")  # and its role
ROLES = {"u": b"user", "a": b"assistant"}
FAR = 1 << 60
LEGAL = {"su", "ua", "au"}
ROWS = 4096  # rows of an output batch
TEXT_BYTES = 4 << 20


class Automaton:
    """The path of shared-suffix nodes in hand, from the end of the conversations."""

    def __init__(self):
        costs, ops = self._with_inserts([(0, ""), (FAR, ""), (FAR, ""), (0, "")])
        self.path = [("", 0, costs, ops)]  # symbol, cost shift, costs by state less the shift, edits by state
        self.steps: dict = {}
        self.nodes = 0

    @staticmethod
    def _with_inserts(base):
        best = list(base)
        for _ in range(3):  # no state is entered twice by inserts
            best = [min(base[q], (best[FOLLOWS[q]][0] + INSERT, "I")) for q in range(4)]
        return tuple(c for c, _ in best), tuple(op for _, op in best)

    def _step(self, symbol: str, after: tuple) -> tuple:
        role, extra = symbol.lower(), CUT_OFF if symbol.isupper() else 0
        base = []
        for q in range(4):
            found = [(after[q] + DELETE, "D")]
            if symbol != "X":
                found.append((after[FOLLOWS[q]] + REROLE + extra, "R"))
                if role == WANTED[q]:
                    found.append((after[FOLLOWS[q]] + extra, "K"))
                elif role == "s" and q == START:
                    found.append((after[AFTER_SYSTEM] + extra, "K"))
            base.append(min(found))
        costs, ops = self._with_inserts(base)
        least = min(costs)
        return least, tuple(c - least for c in costs), ops

    def extend(self, symbol: str) -> None:
        _, shift, after, _ = self.path[-1]
        known = self.steps.get((symbol, after))  # equal costs-to-go but for a shift: the same step
        if known is None:
            known = self.steps[symbol, after] = self._step(symbol, after)
        self.path.append((symbol, shift + known[0], known[1], known[2]))
        self.nodes += 1

    def signature(self, reverse: str, shared: int) -> tuple[int, str]:
        """Cost and audit of a signature, given reversed, that shares ``shared`` symbols with the last one."""
        del self.path[shared + 1:]
        for symbol in reverse[shared:]:
            self.extend(symbol)
        state, audit = START, []
        for symbol, _, _, ops in reversed(self.path):
            op = ops[state]
            while op == "I":
                audit.append(op)
                state = FOLLOWS[state]
                op = ops[state]
            audit.append(op)
            if op == "K" and symbol in "sS":
                state = AFTER_SYSTEM
            elif op and op != "D":
                state = FOLLOWS[state]
        _, shift, costs, _ = self.path[-1]
        return shift + costs[START], "".join(audit)


def _shared(a: str, b: str) -> int:
    """Length of the common start."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton, last = Automaton(), ""
    for batch in batches:
        found = []
        for reverse in batch.column(0).to_pylist():
            cost, audit = automaton.signature(reverse, _shared(last, reverse))
            found.append((reverse[::-1], cost, audit))
            last = reverse
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))],
                ["signature", "cost", "audit"])


def audits(signatures: DataFrame) -> DataFrame:
    """``signature, cost, audit`` of every distinct ``signature``."""
    back = signatures.select(F.reverse("signature").alias("back")).distinct()
    return back.repartitionByRange("back").sortWithinPartitions("back").mapInArrow(
        _audit, "signature string, cost long, audit string")


def _rows(turns: DataFrame, conv: str, turn: str, role: str, text: str, copies, gone) -> DataFrame:
    who, said = F.coalesce(F.col(role), F.lit(" ")), F.coalesce(F.col(text), F.lit(" "))
    return turns.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), who.alias("role"), said.alias("said"),
        (F.lit(1) if copies is None else copies).cast("long").alias("n"),
        (F.lit(False) if gone is None else gone).alias("gone"),
        F.unhex(F.md5(F.concat(F.octet_length(who), F.lit(":"), who, said))).alias("digest"))


INSIDE = r"[^\x20\x09-\x0D]"
FAULTS = "gaps long, blank long, duplicate long, truncated long, illegal long, signature string"
COUNTS = [part.split()[0] for part in FAULTS.split(", ")]


def _signatures(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows in order, first occurrences announced by a row before theirs, to one row a conversation."""
    out: list[tuple] = []

    def done():
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], kind)]
            + [pa.array([x[k] for x in out], pa.int64()) for k in range(1, 6)]
            + [pa.array([x[6] for x in out], pa.string())], ["conv", *COUNTS])

    nothing = object()
    conv, first, signature = nothing, None, bytearray()
    blanks = doubles = cuts = illegal = distinct = 0
    low = high = last = None

    def row():
        gaps = high - low + 1 - distinct if distinct else 0
        return conv, gaps, blanks, doubles, cuts, illegal, signature.decode()

    for batch in batches:
        for c, turn, role, digest, announced, n, blank, cut in zip(*(x.to_pylist() for x in batch.columns)):
            if c != conv:
                if conv is not nothing:
                    out.append(row())
                    if len(out) >= ROWS:
                        yield done()
                        out.clear()
                conv, first, signature = c, None, bytearray()
                blanks = doubles = cuts = illegal = distinct = 0
                low = high = last = None
            if announced:
                first = (turn, role, digest)
                continue
            if not n:
                continue
            if turn is not None and turn != high:
                low, high, distinct = turn if low is None else low, turn, distinct + 1
            if last is not None:
                illegal += last + role not in LEGAL
            illegal += n - 1
            last = role
            if blank:
                blanks += n
                signature += b"X" * n
                continue
            if first == (turn, role, digest):
                symbol = role if role in ("s", "u", "a") else "o"
                cuts += cut
                signature += (symbol.upper() if cut else symbol).encode()
                n -= 1
            doubles += n
            signature += b"X" * n
    if conv is not nothing:
        out.append(row())
    if out:
        yield done()


def faults(rows: DataFrame) -> DataFrame:
    """``conv``, counts of faults and signature of every conversation of ``_rows``."""
    kept = ~F.col("gone")
    small = rows.select(
        "conv", F.when(kept, F.col("turn")).alias("turn"), F.when(kept, F.substring("role", 1, 1)).alias("role"),
        F.when(kept, F.col("role")).alias("whole"), F.when(kept, F.col("digest")).alias("digest"),
        F.when(kept, F.col("n")).otherwise(0).alias("n"),
        (~F.col("said").rlike(INSIDE)).alias("blank"),
        (~F.col("said").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"))
    small = written(  # equal rows of a turn are one, so that no repeated row is shuffled twice
        small.groupBy("conv", "turn", "role", "whole", "digest").agg(
            F.sum("n").alias("n"), F.first("blank").alias("blank"), F.first("cut").alias("cut")), "turn-marks")
    names = ["conv", "turn", "role", "whole", "digest"]
    earliest = F.min(F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn")))
    firsts = small.where("n > 0 and not blank").groupBy("conv", "role", "whole", "digest").agg(
        earliest.alias("at")).withColumn("turn", F.col("at.turn"))
    both = small.select(*names, F.lit(False).alias("announced"), "n", "blank", "cut").unionByName(
        firsts.select(*names, F.lit(True).alias("announced"), F.lit(0).cast("long").alias("n"),
                      F.lit(False).alias("blank"), F.lit(False).alias("cut")))
    ordered = both.repartition("conv").sortWithinPartitions(
        "conv", F.asc_nulls_first("turn"), "whole", "digest", F.desc("announced"))
    kind = _arrow(rows, "conv")
    return ordered.select("conv", "turn", "role", "digest", "announced", "n", "blank", "cut").mapInArrow(
        lambda batches: _signatures(batches, kind), f"conv {rows.schema['conv'].dataType.simpleString()}, {FAULTS}")


def _arrow(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Edits of each conversation in order: a head ``(conv, counts, None)``, then ``(op, role, text)``."""
    audit, at, state = "", 0, START

    def inserts():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            yield "I", ROLES[WANTED[state]], b""
            at, state = at + 1, FOLLOWS[state]

    for batch in batches:
        for part in range(0, batch.num_rows, 256):  # few texts at once as Python objects
            cut = batch.slice(part, 256)
            for conv, counts, n, role, said in zip(*(x.to_pylist() for x in cut.columns)):
                if counts is not None:
                    yield from inserts()
                    audit, at, state = counts["audit"], 0, START
                    yield conv, counts, None
                    continue
                for _ in range(n):
                    yield from inserts()
                    op = audit[at]
                    at += 1
                    if op == "R":
                        yield op, ROLES[WANTED[state]], said
                    else:
                        yield op, role, said
                    if op == "K" and role[:1] == b"s":
                        state = AFTER_SYSTEM
                    elif op != "D":
                        state = FOLLOWS[state]
    yield from inserts()


def _digests(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    names = [*COUNTS[:5], "cost", "audit"]

    def done():
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], kind)]
            + [pa.array([x[1][name] for x in out], pa.string() if name == "audit" else pa.int64()) for name in names]
            + [pa.array([x[2] for x in out], pa.string())], ["conv", *names, "repaired_sha256"])

    head = sha = None
    fresh = True
    for a, b, c in _replayed(batches):
        if c is None:
            if head:
                out.append((*head, sha.hexdigest()))
                if len(out) >= ROWS:
                    yield done()
                    out.clear()
            head, sha, fresh = (a, b), hashlib.sha256(), True
        elif a != "D":
            sha.update((b"" if fresh else b"\n") + b + b":")
            sha.update(c)
            fresh = False
    if head:
        out.append((*head, sha.hexdigest()))
    if out:
        yield done()


def _turns(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    held = place = 0
    conv = None

    def done():
        kinds = (kind, pa.int64(), pa.string(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], ["conv", "place", "edit", "role", "said"])

    for a, b, c in _replayed(batches):
        if c is None:
            conv, place = a, 0
            continue
        out.append((conv, place, a, b, c))
        place, held = place + 1, held + len(c)
        if len(out) >= ROWS or held >= TEXT_BYTES:
            yield done()
            out.clear()
            held = 0
    if out:
        yield done()


class Repair:
    """Repair of ``turns``; columns are named by the caller, ``copies`` and ``gone`` are
    column expressions (rows that count several times, rows that only name their
    conversation).

    ``digests()``: one row a conversation with its faults, cost, audit and the sha256 of the
    repaired conversation. ``turns()``: the edits themselves, one row each (deleted ones as
    edit ``D``), ``place`` being their order."""

    def __init__(self, turns: DataFrame, conv="conv_id", turn="turn", role="role", text="text", copies=None, gone=None):
        rows = _rows(turns, conv, turn, role, text, copies, gone)
        marks = written(faults(rows), "turn-faults")
        known = skew_join(marks, audits(marks), "signature", "left", ["conv"])
        names = [*COUNTS[:5], "cost", "audit"]
        heads = known.select(
            "conv", F.struct(*names).alias("counts"), F.lit(None).cast("long").alias("turn"),
            F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("digest"),
            F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("said"))
        body = rows.where("not gone and n > 0")
        both = heads.unionByName(body.select("conv", F.lit(None).alias("counts"), "turn", "role", "digest", "n", "said"))
        # The order of ``faults`` again, each conversation's audit before its rows.
        self.ordered = both.repartition("conv").sortWithinPartitions(
            "conv", F.col("counts").isNull(), F.asc_nulls_first("turn"), "role", "digest",
        ).select("conv", "counts", "n", F.col("role").cast("binary").alias("role"), F.col("said").cast("binary").alias("said"))
        self.kind, self.name = _arrow(rows, "conv"), rows.schema["conv"].dataType.simpleString()

    def digests(self) -> DataFrame:
        kind = self.kind
        return self.ordered.mapInArrow(
            lambda batches: _digests(batches, kind),
            f"conv {self.name}, {FAULTS.rsplit(', ', 1)[0]}, cost long, audit string, repaired_sha256 string")

    def turns(self) -> DataFrame:
        kind = self.kind
        return self.ordered.mapInArrow(
            lambda batches: _turns(batches, kind),
            f"conv {self.name}, place long, edit string, role binary, said binary",
        ).withColumns({"role": F.col("role").cast("string"), "said": F.col("said").cast("string")})
