"""Damaged conversations: what is wrong with them, and the cheapest edits that repair their structure.

A conversation is legal when the initials of its roles read ``(s?(ua)+)?``. Each row is kept (K),
reroled to user or assistant (R), or deleted (D, required for blank and repeated rows); an empty user
or assistant row may be inserted anywhere (I). The audit is the string of edits, the cheapest one,
and of equally cheap ones the least in ASCII order.

Method: a dynamic programme over (row, state of the pattern). ``Audits`` keeps the edit strings as
linked nodes, so that strings share their prefixes; a node has ancestors at distances of powers of
two and a rolling hash of its string. Of two equally cheap strings for one state the least stays: the
length of their common prefix is found by lifting both nodes while hashes differ, and is verified by
walking both back to a shared node. An insertion stands right before the row that needs it; then no
string of a state is a prefix of another, so what is least for a part is least in the whole.

A conversation of many rows is cut into ordered pieces (``groups.with_chunks``). A piece is solved
from each of the four states and gives 16 costs and ranks; a walk over these small tables finds the
states between pieces, and each piece then writes its own part. Only the SHA-256 of a conversation's
repaired text passes over all of it in order, streaming.

Defined cases: null text or role is one space, null turns come first and leave no gaps, a null
``conv_id`` is a conversation of its own; rows of one turn are taken by role and then by text;
identical rows of a long conversation are handled as one with a count; of roles only the first letter
counts, an empty role has none; texts of any length are taken whole; other columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dugout.llm.store import kept, prepare
from dugout.operators import groups

BLANK = " \t\n\x0b\x0c\r"
ENDS = ".!?"
# states of the pattern: nothing yet, after s, after u, after a
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)  # the state after a user or assistant row
ROLE = {USER: "user", ASSISTANT: "assistant"}
AFTER = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
CLOSING = ((0, ""), (4, "II"), (2, "I"), (0, ""))  # cost and edits that end a conversation in each state
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
FOLLOWS = {"su", "ua", "au"}
PIECE = 20_000  # rows; a longer conversation is cut into pieces of about this size

MODULUS, FACTOR = (1 << 61) - 1, 0x1B873593CC9E2D51
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
SCHEMA = "conv_id bigint, " + ", ".join(f"{c} bigint" for c in (*COUNTS, "cost")) + ", audit string, repaired_sha256 string"
SUMMARY = ", piece int, first string, last string, low bigint, high bigint, turns bigint, costs array<bigint>, ranks array<int>"


class Audits:
    """Edit strings as nodes that share prefixes; node 0 is the empty string."""

    def __init__(self) -> None:
        self.letter, self.size, self.hash, self.lifts = [""], [0], [0], [[]]

    def append(self, node: int, letter: str) -> int:
        lifts, at, k = [node], node, 0
        while k < len(self.lifts[at]):  # ancestors at distances 1, 2, 4, ...
            at = self.lifts[at][k]
            lifts.append(at)
            k += 1
        self.letter.append(letter)
        self.size.append(self.size[node] + 1)
        self.hash.append((self.hash[node] * FACTOR + ord(letter)) % MODULUS)
        self.lifts.append(lifts)
        return len(self.letter) - 1

    def lifted(self, node: int, steps: int) -> int:
        k = 0
        while steps:
            if steps & 1:
                node = self.lifts[node][k]
            steps >>= 1
            k += 1
        return node

    def _verified(self, a: int, b: int) -> tuple[int, int] | None:
        """The first nodes at which two strings of one length differ, walking back to a shared node."""
        found = None
        while a != b:
            if self.letter[a] != self.letter[b]:
                found = a, b
            a, b = self.lifts[a][0], self.lifts[b][0]
        return found

    def less(self, a: int, b: int) -> bool:
        """Whether the string of ``a`` stands before that of ``b`` in ASCII order."""
        shorter = min(self.size[a], self.size[b])
        x, y = self.lifted(a, self.size[a] - shorter), self.lifted(b, self.size[b] - shorter)
        if self.hash[x] != self.hash[y]:
            k = len(self.lifts[x])
            while k:  # lift while hashes differ: the parents then have the common prefix
                k -= 1
                if k < len(self.lifts[x]):
                    up, vp = self.lifts[x][k], self.lifts[y][k]
                    if self.hash[up] != self.hash[vp]:
                        x, y = up, vp
            earlier = self._verified(self.lifts[x][0], self.lifts[y][0])
        else:
            earlier = self._verified(x, y)
            if earlier is None:
                return self.size[a] < self.size[b]
        x, y = earlier or (x, y)
        return self.letter[x] < self.letter[y]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.lifts[node][0]
        return "".join(reversed(out))


class Piece:
    """Consecutive rows of one conversation: their faults and the cheapest edits between states."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, str, bool, bool, int]] = []  # role, text, must go, cut off, copies
        self.seen: set[bytes] = set()
        self.turns: set[int] = set()
        self.count = dict.fromkeys(COUNTS, 0)
        self.first: str | None = None
        self.last: str | None = None

    def add(self, turn: int | None, role: str, text: str, copies: int, again: bool | None) -> None:
        if not copies:
            return
        if turn is not None:
            self.turns.add(turn)
        body = text.rstrip(BLANK)
        digest = hashlib.md5(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")).digest()
        blank, again, cut = not body, bool(again) or digest in self.seen, False
        self.seen.add(digest)
        if blank:
            self.count["blank"] += copies
        else:
            self.count["duplicate"] += copies - (not again)
            cut = not again and body[-1] not in ENDS
            self.count["truncated"] += cut
        letter = role[:1]
        self.count["illegal"] += (self.last is not None and self.last + letter not in FOLLOWS) + (copies - 1) * (2 * letter not in FOLLOWS)
        self.first = letter if self.first is None else self.first
        self.last = letter
        self.rows.append((role, text, blank or again, cut, copies))

    def solve(self, audits: Audits, start: int) -> dict[int, tuple[int, int]]:
        """Cost and audit node of the best edits from ``start`` to each state that can be reached."""
        best = {start: (0, 0)}

        def offer(to: dict, state: int, cost: int, node: int, letter: str) -> None:
            held = to.get(state)
            if held is None or cost < held[0]:
                to[state] = cost, audits.append(node, letter)
            elif cost == held[0]:
                new = audits.append(node, letter)
                if audits.less(new, held[1]):
                    to[state] = cost, new

        for role, _, gone, cut, copies in self.rows:
            letter = role[:1]
            for k in range(copies):
                must_go = gone or k > 0
                before = dict(best)
                if not must_go:
                    for _ in range(2):  # two insertions reach every state that insertions reach
                        for state, (cost, node) in list(before.items()):
                            offer(before, NEXT[state], cost + INSERT, node, "I")
                after: dict[int, tuple[int, int]] = {}
                for state, (cost, node) in before.items():
                    offer(after, state, cost + DELETE, node, "D")
                    if not must_go:
                        offer(after, NEXT[state], cost + REROLE + cut, node, "R")
                        if (state, letter) in AFTER:
                            offer(after, AFTER[state, letter], cost + cut, node, "K")
                best = after
        return best

    def summary(self) -> tuple[list[int], list[int]]:
        """Costs (-1: not to be reached) and ranks of audits, by state before and after."""
        costs, ranks = [-1] * 16, [-1] * 16
        for start in range(4):
            audits = Audits()
            best = self.solve(audits, start)
            for state, (cost, node) in best.items():
                costs[4 * start + state] = cost
                ranks[4 * start + state] = sum(audits.less(other, node) for _, other in best.values())
        return costs, ranks

    def written(self, start: int, end: int | None) -> tuple[int, str, list[str]]:
        """Cost, edits and repaired lines from ``start``; ``end`` None ends the conversation."""
        audits = Audits()
        best = self.solve(audits, start)
        closing = ""
        if end is None:
            state, least = None, None
            for s, (cost, node) in best.items():
                total = cost + CLOSING[s][0]
                if least is None or total < least or total == least and audits.less(node, best[state][1]):
                    state, least = s, total
            cost, closing = least, CLOSING[state][1]
        else:
            state, cost = end, best[end][0]
        audit = audits.text(best[state][1]) + closing
        return cost, audit, self._lines(audit, start)

    def _lines(self, audit: str, state: int) -> list[str]:
        rows = (row for row in self.rows for _ in range(row[4]))
        lines = []
        for edit in audit:
            role, text = ("", "") if edit == "I" else next(rows)[:2]
            if edit == "K":
                state = AFTER[state, role[:1]]
                lines.append(f"{role}:{text}")
            elif edit != "D":
                state = NEXT[state]
                lines.append(f"{ROLE[state]}:{text}")
        return lines

    def gaps(self) -> int:
        return max(self.turns) - min(self.turns) + 1 - len(self.turns) if self.turns else 0


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) after the planted damage; dropped rows have no copies."""
    clean = conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"),
                                 F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    spelled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spelled("conv_id"), F.lit(":"), spelled("turn")).cast("binary")) % 20
    return clean.withColumn("kind", kind).select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("bigint").alias("copies"))


def pieces(rows: DataFrame, most: int = PIECE) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary conversations, and those of long ones with their piece and whether role and
    text stand on an earlier row of the conversation."""
    hot = groups.find_hot(rows, ["conv_id"], most)
    if hot is None:
        return rows.select("*", F.lit(0).alias("piece"), F.lit(None).cast("boolean").alias("again")), None
    cut = groups.with_chunks(rows, hot, ["turn", "role", "text"])
    plain = cut.filter(~F.col("_hot")).select(*rows.columns, F.lit(0).alias("piece"), F.lit(None).cast("boolean").alias("again"))
    long = (cut.filter("_hot").groupBy("conv_id", F.col("_chunk").alias("piece"), "turn", "role", "text")
            .agg(F.sum("copies").alias("copies")).withColumns({"here": F.struct("turn"), "digest": F.md5("text")}))
    firsts = (long.filter("copies > 0").groupBy(F.col("conv_id").alias("f_id"), F.col("role").alias("f_role"), F.col("digest").alias("f_digest"))
              .agg(F.min("here").alias("f_here"), F.count(F.lit(1)).alias("f_n")).filter("f_n > 1"))
    joined = long.join(firsts, F.col("conv_id").eqNullSafe(F.col("f_id")) & (F.col("role") == F.col("f_role")) & (F.col("digest") == F.col("f_digest")), "left")
    return plain, joined.select(*rows.columns, "piece", F.coalesce(F.col("here") > F.col("f_here"), F.lit(False)).alias("again"))


def _sorted(rows: DataFrame) -> DataFrame:
    """Rows of a piece in one task, in order."""
    return (rows.repartition("conv_id", "piece")
            .sortWithinPartitions("conv_id", "piece", F.col("turn").asc_nulls_first(), "role", "text"))


def _pieces_of(batches: Iterator[pa.RecordBatch], more: tuple[str, ...] = ()) -> Iterator[tuple]:
    """(conv_id, piece number, Piece, further columns) from sorted rows, held one at a time."""
    key, piece, rest = None, None, ()
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "piece", "turn", "role", "text", "copies", "again", *more)]
        for conv, number, turn, role, text, copies, again, *others in zip(*columns):
            if key != (conv, number):
                if piece is not None:
                    yield *key, piece, rest
                key, piece, rest = (conv, number), Piece(), others
            piece.add(turn, role, text, copies, again)
    if piece is not None:
        yield *key, piece, rest


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == 1000:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


_RESULT = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in (*COUNTS, "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])
_SUMMARY = pa.schema([*[(c, pa.int64()) for c in ("conv_id", *COUNTS)], ("piece", pa.int32()), ("first", pa.string()), ("last", pa.string()),
                      *[(c, pa.int64()) for c in ("low", "high", "turns")], ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32()))])
_WRITTEN = pa.schema([("conv_id", pa.int64()), ("piece", pa.int32()), ("edits", pa.string()), ("lines", pa.string())])
_HASHED = pa.schema([("conv_id", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of conversations of one piece."""
    def rows():
        for conv, _, piece, _ in _pieces_of(batches):
            cost, audit, lines = piece.written(NOTHING, None)
            piece.count["gaps"] = piece.gaps()
            text = "\n".join(lines).encode("utf-8", "surrogatepass")
            yield conv, *piece.count.values(), cost, audit, hashlib.sha256(text).hexdigest()

    yield from _batches(rows(), _RESULT)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for conv, number, p, _ in _pieces_of(batches):
            ends = (min(p.turns), max(p.turns)) if p.turns else (None, None)
            yield conv, *p.count.values(), number, p.first, p.last, *ends, len(p.turns), *p.summary()

    yield from _batches(rows(), _SUMMARY)


def _walk(table: pd.DataFrame) -> pd.DataFrame:
    """States before and after each piece of one conversation, and its totals, from small tables."""
    table = table.sort_values("piece")
    to_go = [c for c, _ in CLOSING]
    steps = []
    for costs, ranks in zip(reversed(table["costs"].tolist()), reversed(table["ranks"].tolist())):
        step = [min((costs[4 * s + t] + to_go[t], ranks[4 * s + t], t) for t in range(4) if costs[4 * s + t] >= 0) for s in range(4)]
        to_go = [c for c, _, _ in step]
        steps.append([t for _, _, t in step])
    start, state = [], NOTHING
    for step in reversed(steps):
        start.append(state)
        state = step[state]
    met = [(f, m) for f, m in zip(table["first"], table["last"]) if f is not None]
    illegal = table["illegal"].sum() + sum(a[1] + b[0] not in FOLLOWS for a, b in zip(met, met[1:]))
    turns = table.dropna(subset=["low"])
    # a turn may go on in the next piece
    shared = sum(int(a == b) for a, b in zip(turns["high"].tolist(), turns["low"].tolist()[1:]))
    gaps = int(turns["high"].max() - turns["low"].min() + 1 - turns["turns"].sum() + shared) if len(turns) else 0
    out = table[["conv_id", "piece"]].copy()
    out["start"], out["end"] = start, [*start[1:], -1]
    out["gaps"], out["illegal"], out["cost"] = gaps, illegal, to_go[NOTHING]
    for c in ("blank", "duplicate", "truncated"):
        out[c] = table[c].sum()
    return out


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for conv, number, piece, (start, end) in _pieces_of(batches, ("start", "end")):
            _, audit, lines = piece.written(start, None if end < 0 else end)
            yield conv, number, audit, "\n".join(lines) if lines else None

    yield from _batches(rows(), _WRITTEN)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and hash of each long conversation from its pieces in order; texts stream past."""
    def rows():
        key, audit, digest, empty = (), [], None, True
        for batch in batches:
            for conv, edits, lines in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "edits", "lines")]):
                if key != (conv,):
                    if key:
                        yield key[0], "".join(audit), digest.hexdigest()
                    key, audit, digest, empty = (conv,), [], hashlib.sha256(), True
                audit.append(edits)
                if lines is not None:
                    digest.update(b"" if empty else b"\n")
                    digest.update(lines.encode("utf-8", "surrogatepass"))
                    empty = False
        if key:
            yield key[0], "".join(audit), digest.hexdigest()

    yield from _batches(rows(), _HASHED)


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def repaired(rows: DataFrame, most: int = PIECE) -> DataFrame:
    """A row per conversation of (conv_id, turn, role, text, copies): faults, cost, audit and hash of
    the repaired text. Conversations of more than ``most`` rows are solved in pieces."""
    prepare(rows.sparkSession)
    plain, long = pieces(rows, most)
    result = _sorted(plain).mapInArrow(_whole, SCHEMA)
    if long is None:
        return result
    long = kept(long, "long-conversations")
    summaries = _sorted(long).mapInArrow(_summaries, "conv_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + SUMMARY)
    walked = kept(summaries.groupBy("conv_id").applyInPandas(
        _walk, "conv_id bigint, piece int, start int, end int, gaps bigint, illegal bigint, cost bigint, blank bigint, duplicate bigint, truncated bigint"), "walked-pieces")
    states = walked.select(F.col("conv_id").alias("w_id"), F.col("piece").alias("w_piece"), "start", "end")
    parts = _sorted(long.join(states, _same("conv_id", "w_id") & _same("piece", "w_piece")).drop("w_id", "w_piece"))
    parts = parts.mapInArrow(_written, "conv_id bigint, piece int, edits string, lines string")
    ends = parts.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(_hashed, "conv_id bigint, audit string, repaired_sha256 string")
    totals = walked.filter(F.col("end") == -1).select(F.col("conv_id").alias("w_id"), *COUNTS, "cost")
    done = totals.join(ends, _same("w_id", "conv_id")).select("conv_id", *COUNTS, "cost", "audit", "repaired_sha256")
    return result.unionByName(done)
