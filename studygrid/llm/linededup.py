"""Line deduplication over range-partitioned line hashes.

Long enough line keys are hashed to 128 bits; (hash, document, position) rows
are range-partitioned and sorted by hash, then document descending, then
position. Each partition streams runs of equal hashes: the first document of a
run holds on to the line, the others lose it if enough documents have it. Only a
partition's first and last run can go on in a neighbour, so the rows of those
runs, at most two hashes a partition, are settled by one more small grouping. A
line that fills many partitions is thus dealt over all of them. What comes back
is one compressed keep bitmap for each document that loses lines.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Numbered, materialize, parts, release, strings

SPACE = b" \t\n\r\x0b\x0c"


def _hashed(docs: DataFrame, least_chars: int) -> DataFrame:
    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        release()
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            hashes, row, pos, count = [], [], [], []
            for i, text in enumerate(strings(batch, "text")):
                lines = text.split(b"\n")
                for k, line in enumerate(lines):
                    if len(line) >= least_chars:
                        key = line.strip(SPACE).lower()
                        if len(key) >= least_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= least_chars):
                            hashes.append(digest(key))
                            row.append(i)
                            pos.append(k)
                            count.append(len(lines))
            pair = np.frombuffer(b"".join(hashes), ">i8").astype(np.int64).reshape(-1, 2)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(pair[:, 0]), pa.array(pair[:, 1]), batch.column("id").take(at), batch.column("th").take(at), pa.array(pos, pa.int32()), pa.array(count, pa.int32())],
                ["h1", "h2", "id", "th", "pos", "n_lines"],
            )

    return docs.mapInArrow(work, "h1 long, h2 long, id long, th long, pos int, n_lines int")


def _settled(hashed: DataFrame, least_docs: int) -> DataFrame:
    """Rows that lose their line (edge false), and all rows of runs at a partition's edges (edge true)."""
    order = ["h1", "h2", F.col("id").desc(), "pos"]
    dealt = hashed.repartitionByRange(parts(hashed), *order[:3]).sortWithinPartitions(*order)
    names = ["h1", "h2", "id", "th", "pos", "n_lines"]

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def flush(x, first: bool, last: bool):
            new = np.r_[True, (x[0][1:] != x[0][:-1]) | (x[1][1:] != x[1][:-1])]
            run = np.cumsum(new) - 1
            docs = np.bincount(run, new | np.r_[True, x[2][1:] != x[2][:-1]])
            edge = np.zeros(len(new), bool)
            if first:
                edge |= run == 0
            if last:
                edge |= run == run[-1]
            out = edge | ((docs[run] >= least_docs) & (x[2] != x[2][new][run]))
            return pa.RecordBatch.from_arrays([pa.array(c[out]) for c in (*x, edge)], [*names, "edge"])

        rest, first = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            rest = now if rest is None else [np.concatenate(x) for x in zip(rest, now, strict=True)]
            if len(rest[0]) < 20_000:
                continue
            same = (rest[0] == rest[0][-1]) & (rest[1] == rest[1][-1])
            if cut := int(np.argmax(same)):
                yield flush([x[:cut] for x in rest], first, False)
                rest, first = [x[cut:] for x in rest], False
        if rest is not None:
            yield flush(rest, first, True)

    return dealt.mapInArrow(work, "h1 long, h2 long, id long, th long, pos int, n_lines int, edge boolean")


def _framed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    own = Numbered(docs)
    text, id_ = F.col(own.of(text_col)).cast("string"), F.col(own.of(id_col))
    # The text's hash keeps rows apart that repeat an id with another text.
    return own.df.where(id_.isNotNull()).select(id_.cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """``(id, th, n_lines, n_dropped, keep)`` of the documents that lose lines.

    ``th`` is xxhash64 of the text, ``keep`` a zlib-compressed bitmap, most
    significant bit first, with a bit set for each line that stays. A line's key
    is the line without white space at its ends, A-Z in lower case; keys of at
    least ``least_chars`` characters in at least ``least_docs`` different ids
    stay only in the largest id that holds them. Rows with a null id or text
    lose nothing; an id that comes twice is one document, of which every row
    loses its lines. Very long texts are read whole, repeated rows alike; an
    empty table gives no rows; other columns, of any name, are ignored.
    """
    found = materialize(_settled(materialize(_hashed(_framed(docs, id_col, text_col), least_chars), "lines"), least_docs), "runs")
    edge = found.where("edge")
    wide = edge.groupBy("h1", "h2").agg(F.count_distinct("id").alias("n"), F.max("id").alias("stays")).where(F.col("n") >= least_docs)
    # A partition has two edge runs at most, which bounds the keys, not their rows: those stay where they are.
    late = edge.join(F.broadcast(wide), ["h1", "h2"]).where(F.col("id") != F.col("stays"))
    lost = found.where("not edge").select("id", "th", "n_lines", "pos").unionByName(late.select("id", "th", "n_lines", "pos"))
    lost = lost.groupBy("id", "th", "n_lines").agg(F.collect_set("pos").alias("lost"))

    def work(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keep, dropped = [], []
            for n, lost in zip(batch.column("n_lines").to_pylist(), batch.column("lost").to_pylist(), strict=True):
                bits = np.ones(n, np.uint8)
                bits[lost] = 0
                keep.append(zlib.compress(np.packbits(bits).tobytes(), 1))
                dropped.append(len(lost))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), batch.column("n_lines"), pa.array(dropped, pa.int32()), pa.array(keep, pa.binary())], ["id", "th", "n_lines", "n_dropped", "keep"])

    return lost.mapInArrow(work, "id long, th long, n_lines int, n_dropped int, keep binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the lines that stay, plus ``__n_lines`` and ``__n_dropped``.

    A null text stays null and counts as one line, as does an empty one. A very
    long text is read whole; an empty table gives no rows. Other columns may have
    any name; those called like the two new ones are replaced.
    """
    own, new = Numbered(docs), ("__n_lines", "__n_dropped")
    text, id_ = F.col(own.of(text_col)).cast("string"), F.col(own.of(id_col)).cast("long")
    marks = bitmaps.select("id", "th", F.col("n_dropped").cast("long").alias("dropped"), "keep")
    joined = own.df.join(marks, (id_ == marks["id"]) & (F.xxhash64(text) == marks["th"]), "left")
    joined = joined.select(*(f"c{i}" for i in own.kept(new)), text.alias("text"), "keep", F.coalesce("dropped", F.lit(0)).alias("dropped"))
    at = own.kept(new).index(int(own.of(text_col)[1:]))
    fields = [*own.fields(new), T.StructField("__n_lines", T.LongType()), T.StructField("__n_dropped", T.LongType())]
    fields[at] = T.StructField(fields[at].name, T.StringType())

    def work(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            texts = strings(batch, "text", None)
            lines = [1] * len(texts)
            for i, (text, keep) in enumerate(zip(texts, batch.column("keep").to_pylist(), strict=True)):
                if text is None:
                    continue
                lines[i] = text.count(b"\n") + 1
                if keep is not None:
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=lines[i])
                    texts[i] = b"\n".join(x for x, b in zip(text.split(b"\n"), bits.tolist(), strict=True) if b)
            arrays = [*batch.columns[:-3], pa.array(lines, pa.int64()), batch.column("dropped")]
            arrays[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in fields])

    return joined.mapInArrow(work, T.StructType(fields))


def deduplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """``docs`` without the repeated lines; see ``keep_bitmaps`` for the rule. All rows and columns stay."""
    new = ("__n_lines", "__n_dropped")
    own = Numbered(docs)
    # Numbered names keep the rows' own columns apart from the two that are made and go.
    made = apply_bitmaps(own.df, keep_bitmaps(docs, id_col, text_col, least_chars, least_docs), own.of(id_col), own.of(text_col))
    return made.drop(*new).toDF(*docs.columns)
