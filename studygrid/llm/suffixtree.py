"""Substring deduplication with prefix-partitioned, depth-limited suffix trees.

A window is ``window`` consecutive words. In each window the 8-word prefix with
the least hash is its anchor, so equal windows have equal anchors at equal
places and a document needs a suffix only at its anchors, about one word in
twenty. Suffixes are grouped by that prefix. Prefixes that one document alone
has are dropped before any text moves. A prefix with more than ``group`` suffixes
is lengthened to 16, 32, ... words, with the windows that no longer hold it moved
to their own run of that length, until its groups fit in memory; a prefix as long
as a window is a leaf of the tree and needs its least document alone, which is a
grouped minimum. In each other group, the tree of the words that follow and the
tree of the words that come before are grown node by node (one sort a level); a
window is a pair of a left and a right node whose depths add up to ``window``,
and the least document under the pair decides. Groups are streamed through
memory in prefix order.

Documents of the same words are collapsed first: of those, all but the least id
lose every window.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Numbered, materialize, parts, release, strings

PREFIX = 8
#: Suffixes of a prefix that are grown as one tree; a unit of memory that results don't depend on.
GROUP = 100_000
#: Rows that a worker takes from a stream of groups at a time.
CHUNK = 30_000


def _powers(n: int, cache: dict = {}):  # noqa: B006
    import numpy as np

    if len(cache.get("up", ())) < n:
        base = 0x9E3779B97F4A7C15
        size = 1 << max(17, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            cache["up"] = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, base, np.uint64)])
            cache["down"] = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, pow(base, -1, 1 << 64), np.uint64)])
    return cache["up"], cache["down"]


def gram_hashes(words: list[bytes], width: int):
    """64-bit hashes of all runs of ``width`` words."""
    import numpy as np

    flat = np.frombuffer(b" ".join(words), np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.cumsum(sizes) - sizes
    up, down = _powers(len(flat) + 1)
    total = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[: len(flat)], out=total[1:])
    begin = starts[: len(words) - width + 1]
    end = (starts + sizes - 1)[width - 1 :]
    x = (total[end] - total[begin]) * down[begin] + end.astype(np.uint64) - begin.astype(np.uint64)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def anchors(words: list[bytes], window: int, width: int):
    """(hash, place, first window, last window) of each anchor: its windows are those it is the first least gram of."""
    import numpy as np

    hashes, span, out = gram_hashes(words, width), window - width + 1, []
    last = len(words) - window + 1
    for base in range(0, last, 1 << 22):
        n = min(1 << 22, last - base)
        least = ((hashes[base : base + n + span - 1] >> np.uint64(24)) << np.uint64(24)) | np.arange(n + span - 1, dtype=np.uint64)
        reach = 1
        while reach * 2 <= span:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if span > reach:
            least = np.minimum(least[: n], least[span - reach : span - reach + n])
        place = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        out.append((hashes[base + place[first]].view(np.int64), base + place[first], base + first, base + np.r_[first[1:], n] - 1))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _read(docs: DataFrame, window: int, width: int) -> DataFrame:
    def work(batches: Iterator) -> Iterator:
        from hashlib import sha256

        import numpy as np
        import pyarrow as pa

        release()
        for batch in batches:
            n_words, sha, found, sizes = [], [], [], []
            for text in strings(batch, "text"):
                words = text.split()
                n_words.append(len(words))
                sha.append(sha256(b" ".join(words)).hexdigest())
                if len(words) >= window:
                    found.append(anchors(words, window, width))
                    sizes.append(len(found[-1][0]))
                else:
                    sizes.append(0)
            cols = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 4
            entries = pa.StructArray.from_arrays([pa.array(cols[0]), *(pa.array(x.astype(np.int32)) for x in cols[1:])], ["h", "at", "lo", "hi"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("th"), pa.array(n_words, pa.int64()), pa.array(sha, pa.string()), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), entries)],
                ["id", "th", "n_words", "sha", "anchors"],
            )

    return docs.mapInArrow(work, "id long, th long, n_words long, sha string, anchors array<struct<h:long,at:int,lo:int,hi:int>>")


def _suffixes(joined: DataFrame, window: int) -> DataFrame:
    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["h", "id", "th", "lo", "off", "windows", "text"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for i, th, text, places in zip(batch.column("id").to_pylist(), batch.column("th").to_pylist(), strings(batch, "text"), batch.column("places").to_pylist(), strict=True):
                words = text.split()
                for p in places:
                    lo, hi = p["lo"], p["hi"]
                    for col, x in zip(rows, (p["h"], i, th, lo, p["at"] - lo, hi - lo + 1, b" ".join(words[lo : hi + window])), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types, strict=True)], names)

    return joined.mapInArrow(work, SUFFIX)


def tree_ranges(h, doc, off, windows, texts: list[bytes], window: int, width: int):
    """Runs of windows that a smaller document has too: (row, first, last), windows counted from each row's first.

    Rows of equal ``h`` are suffixes of one prefix group, ``off`` words into their text.
    """
    import numpy as np

    n, span = len(h), window - width + 1
    ids: dict[bytes, int] = {}
    left, right = np.zeros((span - 1, n), np.int64), np.zeros((window, n), np.int64)
    for r, text in enumerate(texts):
        words = [ids.setdefault(w, len(ids) + 1) for w in text.split()]
        o = int(off[r])
        if o:
            left[:o, r] = words[o - 1 :: -1] if o <= len(words) else 0
        tail = words[o : o + window]
        right[: len(tail), r] = tail

    def grow(node, symbols):
        _, out = np.unique(node * (len(ids) + 1) + symbols, return_inverse=True)
        return out.astype(np.int64)

    node = np.unique(h, return_inverse=True)[1].astype(np.int64)
    ends = {}
    for depth in range(1, window + 1):
        node = grow(node, right[depth - 1])
        if depth >= width:
            ends[depth] = node
    found = np.zeros((n, span + 1), bool)
    node = np.zeros(n, np.int64)
    for back in range(span):
        if back:
            node = grow(node, left[back - 1])
        j = off - back
        rows = np.flatnonzero((j >= 0) & (j < windows))
        if not len(rows):
            continue
        key = node[rows] * n + ends[window - back][rows]
        order = np.lexsort((doc[rows], key))
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        least = np.repeat(doc[rows][order][first], np.diff(np.r_[first, len(key)]))
        late = rows[order][least < doc[rows][order]]
        found[late, j[late]] = True
    edge = np.diff(np.pad(found, ((0, 0), (1, 0))).astype(np.int8), axis=1)
    row, begin = np.nonzero(edge == 1)
    _, stop = np.nonzero(edge == -1)
    return row, begin, stop - 1


def _grown(suffixes: DataFrame, window: int, width: int) -> DataFrame:
    names = ["h", "id", "th", "lo", "off", "windows"]
    dealt = suffixes.repartition(parts(suffixes), "h").sortWithinPartitions("h")

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def flush(x, texts):
            h, doc, th, lo, off, windows = x
            row, begin, end = tree_ranges(h, doc, off, windows, texts, window, width)
            return pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(th[row]), pa.array((lo[row] + begin).astype(np.int32)), pa.array((lo[row] + end).astype(np.int32))], ["id", "th", "begin", "end"])

        rest, texts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]
            rest = now if rest is None else [np.concatenate(x) for x in zip(rest, now, strict=True)]
            texts += batch.column("text").to_pylist()
            if len(texts) < CHUNK:
                continue
            if cut := int(np.argmax(rest[0] == rest[0][-1])):
                yield flush([x[:cut] for x in rest], texts[:cut])
                rest, texts = [x[cut:] for x in rest], texts[cut:]
        if texts:
            yield flush(rest, texts)

    return dealt.mapInArrow(work, "id long, th long, begin int, end int")


#: Rows of ``_suffixes``: a prefix, a document, the first window, the words before the prefix, the windows, and the words of all of them.
SUFFIX = "h long, id long, th long, lo int, off int, windows int, text binary"


def _lengthened(suffixes: DataFrame, window: int, longer: int) -> DataFrame:
    """The same windows with prefixes of ``longer`` words.

    Windows that hold the longer run from their anchor on share it; each of the
    others takes its last ``longer`` words.
    """

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        names = [x.split()[0] for x in SUFFIX.split(", ")]
        for batch in batches:
            out: list[list] = [[] for _ in types]
            columns = [batch.column(c).to_pylist() for c in names[1:]]
            for i, th, lo, off, windows, text in zip(*columns, strict=True):
                words = text.split()
                hashes = gram_hashes(words, longer).view(np.int64)
                # Windows from this one on hold ``longer`` words from the anchor on.
                full = max(0, off + longer - window)
                some = [(w + window - longer, w, w) for w in range(min(full, windows))]
                if full < windows:
                    some.append((off, full, windows - 1))
                for place, first, last in some:
                    for col, x in zip(out, (int(hashes[place]), i, th, lo + first, place - first, last - first + 1, b" ".join(words[first : last + window])), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names)

    return suffixes.mapInArrow(work, SUFFIX)


def _leaves(suffixes: DataFrame, window: int) -> DataFrame:
    """The windows of prefixes that are as long as a window: a leaf each, told apart by 128 bits."""

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in batches:
            pair = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, batch.column("text").to_pylist())), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), batch.column("id"), batch.column("th"), batch.column("lo")], ["w1", "w2", "id", "th", "begin"])

    rows = materialize(suffixes.mapInArrow(work, "w1 long, w2 long, id long, th long, begin int"), "windows")
    least = rows.groupBy("w1", "w2").agg(F.min("id").alias("least"))
    return rows.join(least, ["w1", "w2"]).where(F.col("least") < F.col("id")).select("id", "th", "begin", F.col("begin").alias("end"))


def _shared(h, rows: DataFrame) -> DataFrame:
    """``(h, n)``: prefixes that more than one document has, and how often."""
    return rows.groupBy(h.alias("h")).agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n")).where(F.col("a") < F.col("b")).select("h", "n")


def _cut(joined: DataFrame, window: int) -> DataFrame:
    def work(batches: Iterator) -> Iterator:
        from hashlib import sha256

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            removed, sha, kept_text = [], [], []
            for text, ranges in zip(strings(batch, "text"), batch.column("ranges").to_pylist(), strict=True):
                words = text.split()
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, [r["begin"] for r in ranges], 1)
                np.add.at(edge, [r["end"] + window for r in ranges], -1)
                keep = (np.cumsum(edge)[:-1] == 0).tolist()
                kept = b" ".join([w for w, k in zip(words, keep, strict=True) if k])
                removed.append(len(words) - sum(keep))
                sha.append(sha256(kept).hexdigest())
                kept_text.append(kept)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept_text, pa.binary()).cast(pa.string())], ["id", "th", "removed", "kept_sha", "kept"])

    return joined.mapInArrow(work, "id long, th long, removed long, kept_sha string, kept string")


def deduplicate_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, group: int = GROUP, digest: bool = False) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)``, one row per input row with an id; ``kept_sha256`` in place of kept on ``digest``.

    A word goes if a window that covers it also starts in a document of smaller
    id; ``kept`` is the words that stay, joined by one space. Null and empty
    texts have no words; rows with a null id take no part, as no id is smaller
    or larger; rows that repeat an id are compared with smaller ids alone. Very
    long texts are read whole; an empty table gives no rows; other columns, of
    any name, are ignored.
    """
    width = min(PREFIX, window)
    names = Numbered(docs)
    text, id_ = F.col(names.of(text_col)).cast("string"), F.col(names.of(id_col))
    frame = names.df.where(id_.isNotNull()).select(id_.cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    read = materialize(_read(frame, window, width), "words")
    least = read.groupBy("sha").agg(F.min("id").alias("least"))
    long_ = read.where(F.col("n_words") >= window)
    own = long_.join(least, "sha").where(F.col("id") == F.col("least")).select("id", "th", F.explode("anchors").alias("p"))
    shared = materialize(_shared(F.col("p.h"), own), "prefixes")
    places = own.join(shared, F.col("p.h") == F.col("h")).select("id", "th", "p", (F.col("n") > group).alias("frequent"))
    places = materialize(places, "anchors")
    suffixes = lambda rows: _suffixes(frame.join(rows.groupBy("id", "th").agg(F.collect_list("p").alias("places")).hint("merge"), ["id", "th"]), window)
    ranges = _grown(suffixes(places.where("not frequent")), window, width)
    frequent = places.where("frequent")
    rest = None if frequent.isEmpty() else suffixes(frequent)
    while rest is not None:
        if width == window:
            ranges = ranges.unionByName(_leaves(rest, window))
            break
        width = min(2 * width, window)
        longer = materialize(_lengthened(rest, window, width), f"suffixes-{width}", "zstd")
        shared = materialize(_shared(F.col("h"), longer), f"prefixes-{width}")
        few = longer.join(shared.where(F.col("n") <= group), "h", "left_semi")
        ranges = ranges.unionByName(_grown(few, window, width))
        many = shared.where(F.col("n") > group)
        rest = None if many.isEmpty() else longer.join(many, "h", "left_semi")
    ranges = ranges.groupBy("id", "th").agg(F.collect_list(F.struct("begin", "end")).alias("ranges"))
    cut = _cut(frame.join(ranges.hint("merge"), ["id", "th"]), window).dropDuplicates(["id", "th"])
    rows = read.select("id", "th", "n_words", "sha").join(least, "sha").withColumn("copy", (F.col("id") > F.col("least")) & (F.col("n_words") >= window))
    if digest:
        rows = rows.join(cut.drop("kept"), ["id", "th"], "left")
        kept = F.when(F.col("copy"), F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256")
    else:
        words = F.array_join(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != ""), " ")
        rows = rows.join(frame.dropDuplicates(["id", "th"]), ["id", "th"]).join(cut.drop("kept_sha"), ["id", "th"], "left")
        kept = F.when(F.col("copy"), F.lit("")).otherwise(F.coalesce("kept", words, F.lit(""))).alias("kept")
    removed = F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed")
    return rows.select(F.col("id").alias("doc_id"), "n_words", removed, kept)
