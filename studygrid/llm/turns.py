"""Conversation structure repair by signature deduplication.

A conversation's rows, ordered by turn (nulls first; equal turns by the SHA-256
of role and text), become a compact string with a character for each row: its
role and its fault. Each distinct string is solved once by memoised recursion,
the edits ("audit") are joined back and replayed on the texts.

Roles must match ``(s?(ua)+)?``. Keep costs 0, Rerole to user or assistant 3,
Delete 4 (required for blank and duplicate rows), Insert of an empty user or
assistant turn 3; a truncated row that stays adds 3. Among the cheapest audits
the ASCII-least is taken.

Strings are cut into segments of ``SEGMENT`` rows where a conversation is longer
or spans tasks. A segment's solution holds, for each pair of states before and
after it, the cheapest cost and its least audit; as audits of one segment that
leave one state and end with a row each are prefix-free, the least audit of the
whole is found segment by segment. So a conversation of any length is dealt out
over tasks; only its digest, which SHA-256 makes sequential, streams through one.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Numbered, materialize, parts

#: Rows of a segment, and suffixes whose solutions a worker remembers.
SEGMENT = 192
MEMORY = 50_000

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SPACES = " \t\n\x0b\x0c\r"
ROLE = {"u": "user", "a": "assistant"}
#: Before the first row, after a system turn, after a user turn, after an assistant turn: what may follow, and the state after it.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The only role that can be inserted or given in a state.
GIVEN = ("u", "u", "a", "u")
#: What is left to insert at the end, by state.
ENDING = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))
LEGAL = {"su", "ua", "au"}


@functools.lru_cache(MEMORY)
def solve(signature: str, state: int) -> tuple:
    """``((end, cost, audit), ...)``: the cheapest, ASCII-least edits of a segment from ``state`` to each end, each ending with a row.

    Characters are s, u, a, o (another role), in capitals if truncated, and x for
    a row that must go. At most two turns are inserted before a row: by then
    every state that can be reached is.
    """
    if not signature:
        return ((state, 0, ""),)
    row, rest, best = signature[0], signature[1:], {}

    def offer(cost: int, edits: str, after: int) -> None:
        for end, more, audit in solve(rest, after):
            found = (cost + more, edits + audit)
            if end not in best or found < best[end]:
                best[end] = found

    at, role, extra = state, row.lower(), TRUNCATED if row.isupper() else 0
    for n in range(3):
        edits, cost = "I" * n, INSERT * n
        offer(cost + DELETE, edits + "D", at)
        if row != "x":
            if role in NEXT[at]:
                offer(cost + KEEP + extra, edits + "K", NEXT[at][role])
            offer(cost + REROLE + extra, edits + "R", NEXT[at][GIVEN[at]])
        at = NEXT[at][GIVEN[at]]
    return tuple((end, *found) for end, found in sorted(best.items()))


def compose(segments: list) -> tuple[int, str]:
    """Cost and audit of a whole conversation; a segment is a table state -> ((end, cost, audit), ...)."""
    costs, after = [[c for c, _ in ENDING]], [c for c, _ in ENDING]
    for moves in reversed(segments):
        after = [min((c + after[end] for end, c, _ in moves[s]), default=None) if moves[s] else None for s in range(4)]
        costs.append(after)
    state, audit = 0, []
    for moves, before, behind in zip(segments, reversed(costs[1:]), reversed(costs[:-1]), strict=True):
        least, state = min((a, end) for end, c, a in moves[state] if c + behind[end] == before[state])
        audit.append(least)
    return costs[-1][0], "".join(audit) + ENDING[state][1]


def _facts(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``(c, turn, role, text, digest, initial, blank, sym)`` of every row; nulls in role and text are one space."""
    own = Numbered(rows)
    role = F.coalesce(F.col(own.of(role_col)).cast("string"), F.lit(" "))
    text = F.coalesce(F.col(own.of(text_col)).cast("string"), F.lit(" "))
    frame = own.df.select(F.col(own.of(conv_col)).alias("c"), F.col(own.of(turn_col)).alias("turn"), role.alias("role"), text.alias("text"))
    bare, initial = F.rtrim(F.col("text"), F.lit(SPACES)), F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("o"))
    cut = ~F.substring(bare, -1, 1).isin(".", "!", "?")
    digest = F.sha2(F.concat_ws(":", F.char_length("role").cast("string"), "role", "text").cast("binary"), 256)
    return frame.select("*", digest.alias("digest"), initial.alias("initial"), (bare == "").alias("blank"), F.when(cut, F.upper(letter)).otherwise(letter).alias("sym"))


def _segments(marked: DataFrame) -> DataFrame:
    """Signatures of at most ``SEGMENT`` rows, in the order of ``(part, seq)``, with the initials at both ends."""
    kind = marked.schema["c"].dataType

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, seq, now = TaskContext.get().partitionId(), 0, None
        names, held = ["c", "part", "seq", "sig", "first", "last", "illegal"], []

        def close():
            nonlocal now, seq
            if now is not None:
                held.append((now["c"], part, seq, "".join(now["sig"]), now["first"], now["last"], now["illegal"]))
                now, seq = None, seq + 1

        def flushed(c_type):
            columns = list(zip(*held, strict=True))
            held.clear()
            types = [c_type, pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names)

        c_type = None
        for batch in batches:
            c_type = batch.column("c").type
            columns = (batch.column(x).to_pylist() for x in ("c", "n", "initial", "sym", "first"))
            for c, n, initial, sym, first in zip(*columns, strict=True):
                if now is not None and now["c"] != c:
                    close()
                for i in range(n):
                    if now is not None and len(now["sig"]) >= SEGMENT:
                        close()
                        if len(held) >= 1000:
                            yield flushed(c_type)
                    if now is None:
                        now = {"c": c, "sig": [], "first": initial, "last": initial, "illegal": 0}
                    elif now["last"] + initial not in LEGAL:
                        now["illegal"] += 1
                    now["sig"].append(sym if first and not i else "x")
                    now["last"] = initial
            if len(held) >= 1000:
                yield flushed(c_type)
        close()
        if held:
            yield flushed(c_type)

    schema = T.StructType([T.StructField("c", kind), T.StructField("part", T.IntegerType()), T.StructField("seq", T.LongType()), *(T.StructField(x, T.StringType()) for x in ("sig", "first", "last")), T.StructField("illegal", T.LongType())])
    light = marked.select("c", "turn", "digest", "n", "initial", "sym", "first")
    return light.repartitionByRange(parts(marked), "c", "turn", "digest").sortWithinPartitions("c", "turn", "digest").mapInArrow(work, schema)


def _solved(segments: DataFrame) -> DataFrame:
    """``(sig, moves)`` of each distinct signature, solved once."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        move = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
        for batch in batches:
            sigs = batch.column("sig").to_pylist()
            moves = [[{"start": s, "end": e, "cost": c, "audit": a} for s in range(4) for e, c, a in solve(sig, s)] for sig in sigs]
            yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.string()), pa.array(moves, pa.list_(move))], ["sig", "moves"])

    return segments.select("sig").distinct().mapInArrow(work, "sig string, moves array<struct<start int, end int, cost bigint, audit string>>")


def _composed(segments: DataFrame) -> DataFrame:
    """``(c, illegal, cost, audit)`` of each conversation with a row."""
    kind = segments.schema["c"].dataType

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tables: dict = {}

        def table(sig, moves):
            if sig not in tables:
                if len(tables) >= MEMORY:
                    tables.clear()
                tables[sig] = tuple(tuple((m["end"], m["cost"], m["audit"]) for m in moves if m["start"] == s) for s in range(4))
            return tables[sig]

        def row(c, some, illegal):
            return (c, illegal, *compose(some))

        def packed(rows, c_type):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (c_type, pa.int64(), pa.int64(), pa.string()), strict=True)], ["c", "illegal", "cost", "audit"])

        some, illegal, last, at, c_type = [], 0, None, None, None
        for batch in batches:
            out, c_type = [], batch.column("c").type
            for x in batch.to_pylist():
                if some and x["c"] != at:
                    out.append(row(at, some, illegal))
                    some, illegal, last = [], 0, None
                at = x["c"]
                illegal += x["illegal"] + (last is not None and last + x["first"] not in LEGAL)
                last = x["last"]
                some.append(table(x["sig"], x["moves"]))
            if out:
                yield packed(out, c_type)
        if some:
            yield packed([row(at, some, illegal)], c_type)

    schema = T.StructType([T.StructField("c", kind), T.StructField("illegal", T.LongType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())])
    dealt = segments.repartition(parts(segments), "c").sortWithinPartitions("c", "part", "seq")
    return dealt.mapInArrow(work, schema)


def _audited(facts: DataFrame) -> DataFrame:
    """``(c, gaps, blank, duplicate, truncated, illegal, cost, audit)`` of each conversation with a row."""
    # Equal rows of one turn are one row with a count, so that copies are added up before they are dealt out.
    lots = facts.groupBy("c", "turn", "digest", "initial", "blank", "sym").agg(F.count("*").alias("n"))
    seen = facts.groupBy(F.col("c").alias("c2"), F.col("digest").alias("digest2")).agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("least"))
    joined = lots.join(seen, F.col("c").eqNullSafe(F.col("c2")) & (F.col("digest") == F.col("digest2")))
    first = ~F.col("blank") & F.col("turn").eqNullSafe(F.col("least.turn"))
    marked = materialize(joined.select("c", "turn", "digest", "n", "initial", "blank", "sym", first.alias("first")), "turns")
    known = F.max("turn").cast("long") - F.min("turn").cast("long") + 1 - F.count_distinct("turn")
    counts = marked.groupBy("c").agg(
        F.coalesce(known, F.lit(0)).alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(~F.col("blank"), F.col("n") - F.col("first").cast("long")).otherwise(0)).alias("duplicate"),
        F.sum((F.col("first") & F.col("sym").rlike("^[A-Z]$")).cast("long")).alias("truncated"),
    )
    segments = materialize(_segments(marked), "segments")
    solved = _composed(segments.join(_solved(segments), "sig").select("c", "part", "seq", "sig", "first", "last", "illegal", "moves"))
    solved = solved.withColumnRenamed("c", "c2")
    return counts.join(solved, F.col("c").eqNullSafe(F.col("c2"))).drop("c2")


def audits(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``(conv, gaps, blank, duplicate, truncated, illegal, cost, audit)``.

    Each row's first fault counts: blank (nothing but white space), duplicate (role
    and text seen in an earlier row), truncated (does not end in ``.``, ``!`` or
    ``?``). ``illegal`` counts neighbours whose role initials are none of su, ua,
    au; ``gaps`` the turn numbers missing between the least and the greatest.
    Null roles and texts are one space; a null turn comes first and is no gap; a
    null conversation is one of its own. Repeated rows are duplicates. An empty
    table gives no row; very long texts are digested and trimmed in the JVM only;
    columns but the four named are ignored, whatever their names.
    """
    return _audited(_facts(rows, conv_col, turn_col, role_col, text_col)).withColumnRenamed("c", "conv")


def repaired(rows: DataFrame, found: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Replays the audits of ``found`` on ``rows``: ``(conv, position, edit, role, text)``, or ``(conv, repaired_sha256)`` of the newline-joined ``role:text``.

    Rows and audits of a conversation meet sorted, audit first, and stream; no
    conversation is held in memory. Nulls, copies, empty tables and other columns
    as in ``audits``; a conversation of which all is deleted has no row, and the
    digest of the empty string.
    """
    facts = _facts(rows, conv_col, turn_col, role_col, text_col).select("c", F.lit(1).alias("kind"), "turn", "digest", "role", "text")
    nothing = {x: F.lit(None).cast(facts.schema[x].dataType) for x in ("turn", "digest", "role")}
    heads = found.select(F.col("conv").alias("c"), F.lit(0).alias("kind"), *(x.alias(n) for n, x in nothing.items()), F.col("audit").alias("text"))
    both = facts.unionByName(heads).repartition(parts(rows), "c").sortWithinPartitions("c", "kind", "turn", "digest")

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["conv", "repaired_sha256"] if digest else ["conv", "position", "edit", "role", "text"]
        types = [pa.string()] if digest else [pa.int64(), pa.string(), pa.string(), pa.string()]
        out, c_type, now = [], None, None

        def flushed():
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [c_type, *types], strict=True)], names)

        class Replay:
            def __init__(self, c, audit):
                self.c, self.audit, self.at, self.state, self.n, self.sha = c, audit, 0, 0, 0, hashlib.sha256()

            def line(self, edit, role, text):
                if digest:
                    self.sha.update((("\n" if self.n else "") + f"{role}:{text}").encode())
                else:
                    out.append((self.c, self.n, edit, role, text))
                self.n += 1

            def given(self):
                role = GIVEN[self.state]
                self.state = NEXT[self.state][role]
                return ROLE[role]

            def inserts(self):
                while self.audit[self.at : self.at + 1] == "I":
                    self.at += 1
                    self.line("I", self.given(), "")

            def row(self, role, text):
                self.inserts()
                edit = self.audit[self.at]
                self.at += 1
                if edit == "K":
                    self.state = NEXT[self.state][role[0]]
                    self.line("K", role, text)
                elif edit == "R":
                    self.line("R", self.given(), text)

            def end(self):
                self.inserts()
                if digest:
                    out.append((self.c, self.sha.hexdigest()))

        for batch in batches:
            c_type = batch.column("c").type
            for c, kind, role, text in zip(*(batch.column(x).to_pylist() for x in ("c", "kind", "role", "text")), strict=True):
                if kind == 0:
                    if now is not None:
                        now.end()
                    now = Replay(c, text)
                elif now is not None and now.c == c:
                    now.row(role, text)
            if out:
                yield flushed()
        if now is not None:
            now.end()
        if out:
            yield flushed()

    kind = facts.schema["c"].dataType
    rest = [T.StructField("repaired_sha256", T.StringType())] if digest else [T.StructField("position", T.LongType()), *(T.StructField(x, T.StringType()) for x in ("edit", "role", "text"))]
    return both.mapInArrow(work, T.StructType([T.StructField("conv", kind), *rest]))
