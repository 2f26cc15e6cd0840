"""Best-fit packing of token sequences in bounded space.

Documents are encoded and only those longer than a sequence are cut, so that all
of a document's pieces but the first are whole sequences and need no packing.
The others stream, in the order of a hash, past a fixed number of open bins, kept
in a bitset by free space: a piece goes where the least space is left over, which
is the lowest bit from its length on. If no bin has room and all are open, the
fullest closes.

Each task packs its own share. The bins that are open at its end go to the next
round, in which fewer tasks pack what is left of many, until one task closes the
last ones; so no more bins are left half empty than one stream would leave. A
task of a later round reads at most ``FAN`` times the open bins.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cached, materialize
from .huffman import _Texts

#: Open bins of a stream; pieces a task packs in the first round; tasks whose open bins one task packs in the next.
OPEN = 1024
EACH = 250_000
FAN = 16

COLUMNS = "doc_id long, piece int, start long, length long, ids_crc32 long, key long"


def pieces(docs: DataFrame, spec_path: str, pattern: str, end_id: int, size: int = 1024, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, key)`` of every document, and ``ids`` as little-endian 32-bit integers if asked for.

    A document is the ids of its whole text (null: empty) and ``end_id``. One of
    more than ``size`` ids is cut into pieces of ``size``, of which the first may
    be shorter; all others are one piece. ``key`` is unique in a table once
    written. A very long text gives many rows of bounded size; repeated rows and
    ids give pieces of their own; an empty table gives none; columns but the two
    named are ignored.
    """
    import zlib

    with open(spec_path, encoding="utf-8") as f:
        text = f.read()
    spec, tag = docs.sparkSession.sparkContext.broadcast(text), zlib.crc32(text.encode())

    def work(batches: Iterator) -> Iterator:
        import struct

        import pyarrow as pa
        from pyspark import TaskContext

        from .pieces import in_lots

        own, key = cached(("ids", tag, pattern), lambda: _Texts(spec.value, pattern)), TaskContext.get().partitionId() << 33
        names, end = [x.split()[0] for x in COLUMNS.split(", ")], struct.pack("<I", end_id)
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * ids
        for batch in batches:
            doc_ids, at = batch.column("doc_id").to_pylist(), 0
            for lot in in_lots([x or "" for x in batch.column("text").to_pylist()]):
                rows = []
                for doc_id, coded in zip(doc_ids[at : at + len(lot)], own.encode(lot), strict=True):
                    coded = memoryview(coded + end)
                    n = len(coded) // 4
                    cuts = [0, *range(n % size or size, n + 1, size)] if n > size else [0, n]
                    for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        some = coded[4 * a : 4 * b]
                        rows.append((doc_id, piece, a, b - a, zlib.crc32(some), key) + ((bytes(some),) if ids else ()))
                        key += 1
                at += len(lot)
                for k in range(0, len(rows), 10_000):
                    columns = zip(*rows[k : k + 10_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names + ["ids"] * ids)

    frame = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return frame.mapInArrow(work, COLUMNS + ", ids binary" * ids)


class Bins:
    """At most ``most`` open bins, by free space; a bit is set where there is one. ``put`` gives back the bins that close, as lists."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.count, self.bits = size, most, 0, 0
        self.by_free: list[list] = [[] for _ in range(size + 1)]

    def _pop(self, free: int) -> list:
        found = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits ^= 1 << free
        self.count -= 1
        return found

    def put(self, item, length: int) -> list[list]:
        if not 0 <= length <= self.size:
            raise ValueError(f"a piece of {length} does not fit into {self.size}")
        closed, own, free = [], [], self.size
        if fits := self.bits >> length:
            free = length + (fits & -fits).bit_length() - 1
            own = self._pop(free)
        elif self.count == self.most:
            closed.append(self._pop((self.bits & -self.bits).bit_length() - 1))
        own.append(item)
        free -= length
        if not free:
            return [*closed, own]
        self.by_free[free].append(own)
        self.bits |= 1 << free
        self.count += 1
        return closed

    def rest(self) -> Iterator[list]:
        """All open bins, the fullest first."""
        for some in self.by_free:
            yield from some


def _packed(rest: DataFrame, size: int, most: int, turn: int, last: bool) -> DataFrame:
    """``rest`` with ``sequence_id`` and ``offset``; null where a bin is still open and this is not the last round."""
    names = [x for x in rest.columns if x != "__mix"]

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        bins, at, made, types = Bins(size, most), TaskContext.get().partitionId(), 0, None

        def placed(found: list[list], closed: bool):
            nonlocal made
            rows = []
            for own in found:
                offset = 0
                for row in own:
                    rows.append((*row, 2 * (turn << 54 | at << 32 | made) + 1 if closed else None, offset if closed else None))
                    offset += row[length]
                made += 1
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [*types, pa.int64(), pa.int64()], strict=True)], [*names, "sequence_id", "offset"])

        length = names.index("length")
        for batch in batches:
            types, done = [batch.column(x).type for x in names], []
            for row in zip(*(batch.column(x).to_pylist() for x in names), strict=True):
                done += bins.put(row, row[length])
                if len(done) >= 1000:
                    yield placed(done, True)
                    done = []
            if done:
                yield placed(done, True)
        left = list(bins.rest())
        for k in range(0, len(left), 1000):
            yield placed(left[k : k + 1000], last)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest.schema.fields if f.name != "__mix")
    return rest.mapInArrow(work, f"{fields}, sequence_id long, offset long")


def pack(found: DataFrame, size: int = 1024, most: int = OPEN, each: int = EACH) -> DataFrame:
    """``found``, written pieces as of ``pieces``, with ``sequence_id`` and ``offset``.

    Pieces stream in the order of a hash of their content, so that reruns over the
    same partitions agree and long and short ones come mixed; equal pieces are
    interchangeable. No row is an empty result. Raises for a piece that is longer
    than ``size``.
    """
    whole = found.where(F.col("length") == size).withColumns({"sequence_id": F.col("key") * 2, "offset": F.lit(0).cast("long")})
    light = [x for x in found.columns if x != "ids"]
    rest = found.where(F.col("length") != size).select(*light)
    tasks, turn, done = max(1, -(-rest.count() // each)), 0, []
    whole = whole.select(*light, "sequence_id", "offset")
    while True:
        mixed = rest.withColumn("__mix", F.xxhash64(*light))
        dealt = mixed.repartition(tasks, "__mix") if tasks > 1 else mixed.repartition(1)
        now = materialize(_packed(dealt.sortWithinPartitions("__mix", *light), size, most, turn, tasks == 1), "packed")
        done.append(now.where(F.col("sequence_id").isNotNull()))
        if tasks == 1:
            break
        rest, tasks, turn = now.where(F.col("sequence_id").isNull()).select(*light), -(-tasks // FAN), turn + 1
    for some in done:
        whole = whole.unionByName(some)
    return whole


def sequences(found: DataFrame, packed: DataFrame) -> DataFrame:
    """``(sequence_id, doc_ids, offsets, ids)`` from written pieces with their ids and where ``pack`` put them: at most a sequence's ids each."""
    placed = packed.select("key", "sequence_id", "offset").join(found.select("key", "doc_id", "ids"), "key")
    parts_of = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    rows = placed.groupBy("sequence_id").agg(parts_of.alias("x"))
    return rows.select("sequence_id", F.col("x.doc_id").alias("doc_ids"), F.col("x.offset").alias("offsets"), F.expr("aggregate(x, cast('' as binary), (a, b) -> concat(a, b.ids))").alias("ids"))
