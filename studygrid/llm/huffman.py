"""Token ids in Huffman-coded block files.

A table of blocks is written as Parquet, which Spark commits whole or not at all
and any store takes. A block holds whole documents in ascending id order:
``part`` and ``block`` give its place, ``start`` the ids before it in its part,
``doc_ids`` and ``counts`` its documents, ``payload`` the bits, each document
from a whole byte on, and ``marks`` the bit offset of each document and of every
``STEP``-th id in one, so that a reader decodes any part of it on its own. Codes
are canonical, of at most ``limit`` bits, made from the counts of all documents;
``codebook`` beside the blocks has each id's code length.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cached, materialize, parts

#: Ids of a run that a mark starts, and of a block; a block's runs are decoded side by side.
STEP = 128
BLOCK = 1 << 19
#: Ids that are packed at a time, so that the arrays stay in a core's cache.
PACKED = 1 << 15
#: Pieces that a worker remembers, together with their ids: the latest, up to twice as many.
MEMORY = 600_000


def code_lengths(counts, limit: int):
    """Lengths of an optimal prefix code of at most ``limit`` bits, by package-merge."""
    import numpy as np

    counts = np.asarray(counts, np.int64)
    n = len(counts)
    if n == 1:
        return np.ones(1, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} ids need codes of more than {limit} bits")
    order = np.argsort(counts, kind="stable")
    weights = counts[order]
    leaves, items = [], np.zeros(0, np.int64)
    for _ in range(limit):
        packed = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, packed])
        at = np.argsort(both, kind="stable")
        leaves.append(at < n)
        items = both[at]
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for own in reversed(leaves):
        k = int(own[:take].sum())
        lengths[:k] += 1
        take = 2 * (take - k)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


def canonical(lengths):
    """Codes in order of (length, id), as integers."""
    import numpy as np

    lengths = np.asarray(lengths, np.int64)
    order = np.argsort(lengths, kind="stable")
    top = int(lengths.max())
    size = np.int64(1) << (top - lengths[order])
    codes = np.empty(len(lengths), np.int64)
    codes[order] = (np.cumsum(size) - size) >> (top - lengths[order])
    return codes


def pack(codes, lengths, offsets, n_bytes: int) -> bytes:
    """Bits of ``codes`` at ascending bit ``offsets``, most significant first."""
    import numpy as np

    word, at = offsets >> 5, (offsets & 31).astype(np.uint64)
    wide = codes.astype(np.uint64) << (np.uint64(64) - at - lengths.astype(np.uint64))
    out = np.zeros((n_bytes + 3) // 4 + 2, np.uint64)
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
    if len(first):
        out[word[first]] += np.add.reduceat(wide >> np.uint64(32), first)
        out[word[first] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), first)
    return out.astype(">u4").tobytes()[:n_bytes]


class Decoder:
    """Decodes many runs of one payload at a time through a table of all ``limit``-bit words."""

    def __init__(self, ids, lengths):
        import numpy as np

        self.top = int(max(lengths)) if len(lengths) else 1
        order = np.lexsort((ids, lengths))
        spread = np.int64(1) << (self.top - np.asarray(lengths, np.int64)[order])
        size = 1 << self.top
        self.ids, self.lens = np.zeros(size, np.uint32), np.ones(size, np.int64)
        filled = np.repeat(np.asarray(ids)[order], spread)
        self.ids[: len(filled)] = filled
        self.lens[: len(filled)] = np.repeat(np.asarray(lengths, np.int64)[order], spread)

    def runs(self, payload: bytes, starts, counts):
        """The ids of runs of ``counts`` ids from bit ``starts`` on, one after another."""
        import numpy as np

        raw = np.frombuffer(payload + b"\0" * (12 - len(payload) % 4), ">u4").astype(np.uint64)
        words = (raw[:-1] << np.uint64(32)) | raw[1:]
        out = np.empty(int(counts.sum()), np.uint32)
        order = np.argsort(-counts, kind="stable")
        place, at, left = (np.cumsum(counts) - counts)[order], starts[order].astype(np.int64), counts[order]
        shift = np.uint64(64 - self.top)
        for step in range(int(left[0]) if len(left) else 0):
            alive = int(np.searchsorted(-left, -step, side="left"))
            at, place = at[:alive], place[:alive]
            seen = (words[at >> 5] << (at & 31).astype(np.uint64)) >> shift
            out[place + step] = self.ids[seen]
            at = at + self.lens[seen]
        return out


def _alphabet() -> str:
    """The characters that stand for bytes 0 to 255: printable ones for themselves, then U+0100 and on for the others."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = {b: chr(0x100 + i) for i, b in enumerate(x for x in range(256) if x not in set(own))}
    return "".join(rest.get(b, chr(b)) for b in range(256))


class _Texts:
    """Ids of texts, by the tokenizers library, as little-endian 32-bit strings.

    A byte-level tokenizer merges each piece on its own, so the ids of a piece
    are asked of its model once and remembered. Texts that hold the string of an
    added token, and all texts under another kind of tokenizer, are encoded whole.
    """

    def __init__(self, spec: str, pattern: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from array import array

        from tokenizers import Tokenizer

        from .pieces import Remembered, splitter

        parsed = json.loads(spec)
        before = parsed.get("pre_tokenizer") or {}
        self.tokenizer = Tokenizer.from_str(spec)
        self.added = [x["content"] for x in parsed.get("added_tokens") or []]
        self.remembered = None
        if before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not parsed.get("normalizer"):
            tokenize, alphabet = self.tokenizer.model.tokenize, _alphabet()

            def learn(new: list[str]) -> list[bytes]:
                if not new:
                    return []
                # 0xFF is in no UTF-8 text.
                spelled = b"\xff".join([x.encode() for x in new]).decode("latin-1").translate(alphabet).split(alphabet[255])
                return [array("I", [t.id for t in tokenize(x)]).tobytes() for x in spelled]

            self.remembered = Remembered(splitter(pattern), learn, MEMORY)

    def _whole(self, texts: list[str]) -> list[bytes]:
        from array import array

        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts."""
        if self.remembered is None:
            return self._whole(texts)
        marked = {i for x in self.added for i, text in enumerate(texts) if x in text}
        found = self.remembered.entries([x for i, x in enumerate(texts) if i not in marked] if marked else texts)
        out = list(map(b"".join, found))
        for i, x in zip(sorted(marked), self._whole([texts[i] for i in sorted(marked)]) if marked else (), strict=True):
            out.insert(i, x)
        return out


def encoded(docs: DataFrame, spec, pattern: str, end_id: int, wide: bool, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, ids)`` of whole texts, each ended by ``end_id``, and rows with each task's id counts in ``seen``, ``times``.

    ``ids`` holds the low bytes of all ids, then the next bytes, of two or four
    planes; a row of counts has no ids.
    """
    import zlib

    width, tag = 4 if wide else 2, zlib.crc32(spec.value.encode())

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .pieces import in_lots

        own, end, total = cached(("ids", tag, pattern), lambda: _Texts(spec.value, pattern)), np.array([end_id], "<u4").tobytes(), np.zeros(0, np.int64)
        names = ["doc_id", "ids", "seen", "times"]
        for batch in batches:
            at = 0
            for lot in in_lots([x or "" for x in batch.column("text").to_pylist()]):
                some = batch.slice(at, len(lot))
                at += len(lot)
                coded = [x + end for x in own.encode(lot)]
                flat = np.frombuffer(b"".join(coded), "<u4")
                now = np.bincount(flat, minlength=len(total))
                now[: len(total)] += total
                total = now
                planes = [b"".join([x[k::4] for k in range(width)]) for x in coded]
                n = len(planes)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(planes, pa.binary()), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.int64()))], names)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([ids], pa.list_(pa.int32())), pa.array([total[ids]], pa.list_(pa.int64()))], names)

    frame = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return frame.mapInArrow(work, "doc_id long, ids binary, seen array<int>, times array<long>")


def write_tokens(docs: DataFrame, path: str, spec_path: str, pattern: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", limit: int = 16) -> None:
    """Encode whole texts (null: empty), end each with ``end_id`` and write the files under ``path``.

    The ids are those of ``Tokenizer.from_file(spec_path)`` with its defaults and
    ``add_special_tokens=False``: the string of a special token in a text becomes
    its id. ``pattern`` is the split of a byte-level tokenizer. Ascending ids, null
    first; rows that repeat an id follow each other in the order of their ids'
    bytes. A very long text is one document of a block of its own size; an empty
    table gives files without a block; columns but the two named are ignored. Texts are tokenized once: their ids wait in the
    shared folder until all counts are known. Only the id counts, at most one for
    each vocabulary entry, reach the driver.
    """
    import numpy as np
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    with open(spec_path, encoding="utf-8") as f:
        text = f.read()
    wide = max(end_id, Tokenizer.from_str(text).get_vocab_size()) >= 1 << 16
    spec = spark.sparkContext.broadcast(text)
    held = materialize(encoded(docs, spec, pattern, end_id, wide, id_col, text_col), "ids", "zstd")
    counts = held.where(F.col("seen").isNotNull()).select(F.explode(F.arrays_zip("seen", "times")).alias("x")).groupBy(F.col("x.seen").alias("id")).agg(F.sum("x.times").alias("n"))
    counted = sorted((r["id"], r["n"]) for r in counts.collect()) or [(end_id, 1)]
    ids = np.array([x for x, _ in counted], np.int64)
    lengths = code_lengths([n for _, n in counted], max(limit, int(len(ids) - 1).bit_length()))
    spark.createDataFrame([(int(a), int(b)) for a, b in zip(ids, lengths, strict=True)], "id int, length int").coalesce(1).write.parquet(f"{path}/codebook")
    length_of, code_of = np.zeros(int(ids.max()) + 1, np.int64), np.zeros(int(ids.max()) + 1, np.int64)
    length_of[ids], code_of[ids] = lengths, canonical(lengths)
    width = 4 if wide else 2

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, block, start = TaskContext.get().partitionId(), 0, 0

        def packed(coded):
            """Counts, mark offsets and payload of a few documents."""
            counts = np.array([len(x) // width for x in coded], np.int64)
            ids = np.zeros(int(counts.sum()), np.int64)
            for k in range(width):
                plane = np.frombuffer(b"".join([x[k * n : (k + 1) * n] for x, n in zip(coded, counts.tolist(), strict=True)]), np.uint8)
                ids |= plane.astype(np.int64) << 8 * k
            lens = length_of[ids]
            cum = np.cumsum(lens)
            ends = np.cumsum(counts)
            bits = cum[ends - 1] - np.r_[0, cum[ends[:-1] - 1]]
            begin = np.r_[0, np.cumsum((bits + 7) // 8 * 8)]
            pad = begin[:-1] - (cum[ends - 1] - bits)
            offsets = cum - lens + np.repeat(pad, counts)
            runs = (counts + STEP - 1) // STEP
            nth = np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs)
            marks = offsets[np.repeat(ends - counts, runs) + STEP * nth]
            return counts, marks, pack(code_of[ids], lens, offsets, int(begin[-1]) // 8)

        def flush(doc_ids, coded):
            nonlocal block, start
            some, size, found, bits = [], 0, [], 0
            for i, x in enumerate(coded):
                some.append(x)
                size += len(x) // width
                if size >= PACKED or i == len(coded) - 1:
                    counts, marks, payload = packed(some)
                    found.append((counts, marks + bits, payload))
                    some, size, bits = [], 0, bits + 8 * len(payload)
            counts, marks = (np.concatenate([x[k] for x in found]) for k in range(2))
            row = [[part], [block], [start], [doc_ids], [counts], [marks], [b"".join([x[2] for x in found])]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], ["part", "block", "start", "doc_ids", "counts", "marks", "payload"])
            block, start = block + 1, start + int(counts.sum())
            return out

        doc_ids, coded, size = [], [], 0
        for batch in batches:
            for doc_id, one in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                doc_ids.append(doc_id)
                coded.append(one)
                size += len(one) // width
                if size >= BLOCK:
                    yield flush(doc_ids, coded)
                    doc_ids, coded, size = [], [], 0
        if doc_ids:
            yield flush(doc_ids, coded)

    dealt = held.where(F.col("ids").isNotNull()).select("doc_id", "ids").repartitionByRange(parts(docs), "doc_id").sortWithinPartitions("doc_id", "ids")
    dealt.mapInArrow(work, "part int, block int, start long, doc_ids array<long>, counts array<int>, marks array<long>, payload binary").write.parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of all documents in the files, or ``ids_crc32`` in place of ids.

    ``start`` counts the ids of all documents before. ``ids_crc32`` is the
    unsigned crc32 of the ids as little-endian unsigned 32-bit integers.
    """
    book = spark.read.parquet(f"{path}/codebook").collect()
    blocks = spark.read.parquet(f"{path}/blocks")
    known = ([r["id"] for r in book], [r["length"] for r in book])
    kind, last = ("long", "ids_crc32") if digest else ("array<int>", "ids")

    def work(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        decoder = Decoder(*map(np.array, known))
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.array(row["counts"], np.int64)
                runs = (counts + STEP - 1) // STEP
                sizes = np.full(int(runs.sum()), STEP, np.int64)
                sizes[np.cumsum(runs) - 1] = counts - (runs - 1) * STEP
                ids = decoder.runs(row["payload"], np.array(row["marks"], np.int64), sizes)
                cut = np.r_[0, np.cumsum(counts)]
                if digest:
                    raw = memoryview(ids.astype("<u4").tobytes())
                    out = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.int64())
                else:
                    out = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids.astype(np.int32)))
                n = len(counts)
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + cut[:-1]), pa.array(counts), out], ["part", "doc_id", "at", "n_tokens", last])

    rows = blocks.mapInArrow(work, f"part int, doc_id long, at long, n_tokens long, {last} {kind}")
    sizes = blocks.select("part", F.expr("aggregate(counts, 0L, (a, x) -> a + x)").alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(base, "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", last)
