"""Ranked lexical search over a bit-sliced impact index.

Documents are gathered in blocks, ordered by id, as the scan's tasks read them.
The index has a row for each term and block: the places of the documents that
hold the term, and for each bit of their impacts a bitmap over them, the most
significant first. An impact is what the term adds to a document's score, an
integer, so a search is exact.

A search reads the rows of the terms asked for. In each block the bitmaps of an
item's terms are spread over all places and added up by bitwise carry arithmetic,
for all documents at a time; the k highest sums are found by going down the sums'
bitmaps from the most significant, and only those leave the block. Items are
dealt in lots, of which a task holds the sums in one block.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Numbered, materialize, parts

#: Fixed value: a term. Every byte from 0x80 on is in one, so terms of characters are those of UTF-8 bytes.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents and postings of a block at most (one document alone may have more); items of a lot.
DOCS, POSTINGS = 32_768, 2_000_000
LOT = 128
#: Terms of lots, each with the items of one lot that ask for it, that are broadcast at most.
ASKED = 100_000
#: The formula's scales: of weights, of impacts and of the length norm.
WEIGHT, IMPACT, SLOPE = 1000, 1_000_000_000, 50


class Index(NamedTuple):
    """``rows(term, block, at, slices)``, ``blocks(block, ids)`` with the document ids by place, and how many bitmaps an impact has."""

    rows: DataFrame
    blocks: DataFrame
    bits: int


def _table() -> bytes:
    """Bytes of terms as they are, A-Z in lower case; all others a space."""
    own = lambda c: c >= 128 or 48 <= c <= 57 or 97 <= c <= 122
    return bytes(c if own(c) else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def _binary(pieces, offsets):
    """An Arrow binary array of the bytes of ``pieces`` cut at ``offsets``."""
    import numpy as np
    import pyarrow as pa

    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.asarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(pieces))]).cast(pa.binary())


def _totals(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms with repeats."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table, docs, terms = _table(), 0, 0
        for batch in batches:
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                if n := len((text or b"").translate(table).split()):
                    docs, terms = docs + 1, terms + n
        yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([terms])], ["docs", "terms"])

    found = docs.select("text").mapInArrow(work, "docs long, terms long").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    return found["docs"] or 0, found["terms"] or 0


def _postings(docs: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """``(block, term, data)``: for each term of a block its places, of 16 bits, and, without its weight, what it adds there, of 16 low and 8 high bits.

    A row without a term has the ids of the block's documents, of 64 bits, and a byte each that is 1 where there is none.
    """

    def work(batches: Iterator) -> Iterator:
        from collections import Counter, defaultdict
        from itertools import count

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        names, table, block = ["block", "term", "data"], _table(), TaskContext.get().partitionId() << 32

        def flush(ids, vocabulary, terms, times, lengths):
            nonlocal block
            known = np.array([x is not None for x in ids])
            numbers = np.array([x or 0 for x in ids], np.int64)
            order = np.lexsort((numbers, ~known))
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            head = numbers[order].tobytes() + (~known[order]).astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.nulls(1, pa.string()), pa.array([head], pa.binary())], names)
            sizes = np.array([len(x) for x in terms], np.int64)
            norm = np.array([100 - SLOPE + SLOPE * n * n_docs // n_terms for n in lengths], np.int64)
            term, at, tf = np.concatenate(terms).astype(np.int64), np.repeat(place, sizes), np.concatenate(times)
            adds = IMPACT * tf // (WEIGHT * tf + 20 * np.repeat(norm, sizes))
            order = np.argsort(term << 16 | at)
            term, at, adds = term[order], at[order], adds[order]
            ends = np.r_[np.flatnonzero(term[1:] != term[:-1]) + 1, len(term)]
            starts = np.r_[0, ends[:-1]]
            # Bytes of a row one plane behind the other: 2 a place, 2 of low bits, 1 of high bits.
            data, own = np.empty(5 * len(term), np.uint8), np.repeat(starts, ends - starts)
            wide, nth = np.repeat(ends - starts, ends - starts), np.arange(len(term)) - own
            for plane, (values, shift) in enumerate(((at, 0), (at, 8), (adds, 0), (adds, 8))):
                data[5 * own + plane // 2 * 2 * wide + 2 * nth + plane % 2] = values >> shift & 255
            data[5 * own + 4 * wide + nth] = adds >> 16
            spelled = pa.array(list(vocabulary), pa.binary()).cast(pa.string())
            for k in range(0, len(ends), 20_000):
                a, b = starts[k : k + 20_000], ends[k : k + 20_000]
                cut = np.r_[a, b[-1]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), block)), spelled.slice(k, len(a)), _binary(data[5 * a[0] : 5 * b[-1]], 5 * (cut - a[0]))], names)
            block += 1

        def fresh():
            return [], defaultdict(count().__next__), [], [], []

        held, size = fresh(), 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                counted = Counter((text or b"").translate(table).split())
                if not counted:
                    continue
                if held[0] and (len(held[0]) >= DOCS or size + len(counted) > POSTINGS):
                    yield from flush(*held)
                    held, size = fresh(), 0
                ids, vocabulary, terms, times, lengths = held
                ids.append(doc_id)
                terms.append(np.fromiter(map(vocabulary.__getitem__, counted), np.int32, len(counted)))
                times.append(np.fromiter(counted.values(), np.int64, len(counted)))
                lengths.append(int(times[-1].sum()))
                size += len(counted)
        if held[0]:
            yield from flush(*held)

    return docs.mapInArrow(work, "block long, term string, data binary")


def _sliced(postings: DataFrame, bits: int) -> DataFrame:
    """Rows with a weight ``w`` as ``(term, block, n, at, slices)``."""

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            raw, w = batch.column("data").to_pylist(), batch.column("w").to_numpy()
            n = np.fromiter(map(len, raw), np.int64, len(raw)) // 5
            slices: list = [None] * len(raw)
            # Terms of as many places are done together, in lots of bounded size.
            order = np.argsort(n, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(n[order])) + 1) if len(n) else ():
                width = int(n[some[0]])
                for k in range(0, len(some), step := max(1, 50_000 // width)):
                    rows = some[k : k + step]
                    data = np.frombuffer(b"".join([raw[i] for i in rows]), np.uint8).reshape(len(rows), 5 * width).astype(np.int64)
                    part = data[:, 2 * width : 4 * width : 2] | data[:, 2 * width + 1 : 4 * width : 2] << 8 | data[:, 4 * width :] << 16
                    impact = (part * w[rows, None]).astype(">u8")
                    each = np.unpackbits(impact.view(np.uint8).reshape(len(rows), width, 8), axis=2)[:, :, 64 - bits :]
                    packed = np.packbits(each.transpose(0, 2, 1).reshape(len(rows), bits * width), axis=1)
                    for i, x in zip(rows.tolist(), packed, strict=True):
                        slices[i] = x.tobytes()
            places = pa.array([x[: 2 * k] for x, k in zip(raw, n.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("term"), batch.column("block"), places, pa.array(slices, pa.binary())], ["term", "block", "at", "slices"])

    return postings.mapInArrow(work, "term string, block long, at binary, slices binary")


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of all terms of all documents, in tables of the shared folder.

    Terms are ``TERM`` in the whole text with A-Z lower-cased. Documents without
    a term (null, empty, punctuation alone) take no part; a null id is an id
    behind all others; rows that repeat are documents of their own; a very long
    text is a block of its own if it must; an empty table gives an empty index;
    other columns are ignored, whatever their names.
    """
    own = Numbered(docs)
    rows = own.df.select(F.col(own.of(id_col)).cast("long").alias("doc_id"), F.col(own.of(text_col)).cast("string").alias("text"))
    n_docs, n_terms = _totals(rows)
    postings = materialize(_postings(rows, n_docs, n_terms), "postings", "zstd")
    blocks = postings.where(F.col("term").isNull()).select("block", F.col("data").alias("ids"))
    postings = postings.where(F.col("term").isNotNull())
    holding = F.sum(F.octet_length("data").cast("long")) / 5
    weight = F.floor(F.lit(float(WEIGHT)) * F.log((2.0 * n_docs + 2) / (2 * holding + 1)))
    weights = postings.groupBy("term").agg(weight.cast("long").alias("w"))
    most = int(WEIGHT * _log((2.0 * n_docs + 2) / 3)) + 1
    bits = max(1, (most * (IMPACT // WEIGHT)).bit_length())
    sliced = _sliced(postings.join(weights, "term"), bits)
    return Index(materialize(sliced, "impacts", "zstd"), blocks, bits)


def _log(x: float) -> float:
    import math

    return math.log(max(x, 1.0))


def add(total: list[int], slices: list[int]) -> None:
    """Adds numbers given by ``slices``, bitmaps from the least significant on, to those of ``total``."""
    carry = 0
    for i, b in enumerate(slices):
        if i == len(total):
            total.append(0)
        a = total[i]
        odd = a ^ b
        total[i] = odd ^ carry
        carry = a & b | carry & odd
    i = len(slices)
    while carry:
        if i == len(total):
            total.append(0)
        total[i], carry = total[i] ^ carry, total[i] & carry
        i += 1


def highest(total: list[int], k: int) -> int:
    """The bitmap of the k greatest numbers above 0, equal ones by lower place."""
    sure, open_ = 0, functools.reduce(int.__or__, total, 0)
    if open_.bit_count() <= k:
        return open_
    for one in reversed(total):
        with_bit = open_ & one
        n = (sure | with_bit).bit_count()
        if n > k:
            open_ = with_bit
            continue
        sure |= with_bit
        open_ &= ~one
        if n == k:
            return sure
    for _ in range(k - sure.bit_count()):
        low = open_ & -open_
        sure, open_ = sure | low, open_ ^ low
    return sure


def _places(bitmap: int) -> list[int]:
    out = []
    while bitmap:
        low = bitmap & -bitmap
        out.append(low.bit_length() - 1)
        bitmap ^= low
    return out


def asked(items: DataFrame, id_col: str = "item_id", text_col: str = "text", lot: int = LOT) -> tuple[DataFrame, DataFrame, int]:
    """``(number, item_id)`` of each item that has a term, ``(lot, term, items)`` with the numbers of the items that hold it, and how many lots.

    Rows of one id are one item. The query set is numbered by one window over its
    ids, which are as many as the items.
    """
    own = Numbered(items)
    text = F.coalesce(F.col(own.of(text_col)).cast("string"), F.lit(""))
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = own.df.select(F.col(own.of(id_col)).alias("item_id"), F.explode(F.array_distinct(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0)))).alias("term")).distinct()
    terms = materialize(terms, "asked")
    numbers = materialize(terms.select("item_id").distinct().withColumn("number", F.row_number().over(Window.orderBy("item_id")) - 1), "items")
    numbered = terms.join(numbers.withColumnRenamed("item_id", "i"), F.col("item_id").eqNullSafe(F.col("i")))
    by_lot = materialize(numbered.groupBy(F.floor(F.col("number") / lot).cast("int").alias("lot"), "term").agg(F.collect_list("number").alias("items")), "by-lot")
    if by_lot.count() <= ASKED:
        by_lot = F.broadcast(by_lot)
    return numbers, by_lot, -(-numbers.count() // lot)


def search(index: Index, items: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text", lot: int = LOT) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's k highest scores above 0, equal ones by ascending document id, null last.

    An item's terms count once each. Items without a term have no row, and rows
    of one item id are one item; a null id is an id; an empty index or no item
    gives no row; other columns are ignored.
    """
    bits = index.bits
    numbers, by_lot, lots = asked(items, id_col, text_col, lot)
    rows = index.rows.join(by_lot, "term").select("lot", "block", F.lit(1).alias("kind"), "at", "slices", "items")
    every = F.explode(F.sequence(F.lit(0), F.lit(max(0, lots - 1)))).alias("lot")
    heads = index.blocks.select(every, "block", F.lit(0).alias("kind"), F.col("ids").alias("at"), F.lit(None).cast("binary").alias("slices"), F.lit(None).cast("array<int>").alias("items"))
    both = rows.unionByName(heads).repartition(parts(rows), "lot", "block").sortWithinPartitions("lot", "block", "kind")

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def best(head, sums):
            n = len(head) // 9
            ids, missing, rows = np.frombuffer(head, "<i8", n), np.frombuffer(head, np.uint8)[8 * n :], []
            for item, total in sums.items():
                places = _places(highest(total, k))
                if not places:
                    continue
                at = np.array(places)
                width = n // 8 + 1
                each = np.frombuffer(b"".join([x.to_bytes(width, "little") for x in total]), np.uint8).reshape(len(total), width)
                seen = (each[:, at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(np.int64)
                scores = (seen << np.arange(len(total))[:, None]).sum(axis=0)
                rows += [(item, None if missing[p] else int(ids[p]), int(s)) for p, s in zip(places, scores, strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["number", "doc_id", "score"])

        head, sums = None, {}
        for batch in batches:
            columns = (batch.column(x).to_pylist() for x in ("kind", "at", "slices", "items"))
            for kind, at, raw, items in zip(*columns, strict=True):
                if kind == 0:
                    if head is not None:
                        yield from best(head, sums)
                    head, sums = at, {}
                    continue
                n = len(at) // 2
                own = np.unpackbits(np.frombuffer(raw, np.uint8), count=bits * n).reshape(bits, n)
                spread = np.zeros((bits, len(head) // 9), np.uint8)
                spread[:, np.frombuffer(at, "<u2")] = own
                slices = [int.from_bytes(x.tobytes(), "little") for x in np.packbits(spread, axis=1, bitorder="little")[::-1]]
                while slices and not slices[-1]:
                    slices.pop()
                for item in items:
                    add(sums.setdefault(item, []), slices)
        if head is not None:
            yield from best(head, sums)

    found = both.mapInArrow(work, "number int, doc_id long, score long")
    order = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(numbers, "number").select("item_id", "rank", "doc_id", "score")
