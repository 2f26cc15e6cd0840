"""SimHash near-duplicates by pigeonring filtering.

A 64-bit fingerprint is cut into four 16-bit segments on a ring. If two
fingerprints differ in at most 3 bits, some segment starts a chain whose first
l segments differ in at most floor(3 l / 4) bits together, for every l: 0, 1, 2
and 3. So segment i is equal and its successor differs in at most one bit, which
leaves one of the successor's bytes equal. Each fingerprint is filed under the
eight (segment, byte of the successor) keys of 24 bits; within a key the chain
budgets prune pairs before the full Hamming check.

Equal fingerprints are collapsed first. A key with more than ``block`` distinct
fingerprints is dealt out in pairs of blocks, so no task holds an unbounded
group, and a task gives back a spanning star of what it linked, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import materialize, parts, release, strings
from .components import components


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the word shingles of one lower-cased text."""
    import numpy as np
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(flat, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_digest
    packed = b"".join([digest(flat[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)])
    n, counts = len(starts), np.zeros(64, np.int64)
    rows = np.frombuffer(packed, np.uint8).reshape(-1, 8)
    for at in range(0, n, 4096):
        counts += np.unpackbits(rows[at : at + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` for every row; fp is the unsigned value in a signed long. Null text: 0."""

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        release()
        for batch in batches:
            fps = np.array([fingerprint(x) for x in strings(batch, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    frame = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return frame.mapInArrow(work, "doc_id long, fp long")


def _segment(fp, i: int):
    return F.shiftrightunsigned(fp, 16 * (i % 4)).bitwiseAND(F.lit(0xFFFF))


def chain_keys(fp):
    """The eight keys of a fingerprint: ring position, segment, byte number and byte of its successor."""
    keys = []
    for i in range(4):
        following = _segment(fp, i + 1)
        for half in range(2):
            byte = F.shiftrightunsigned(following, 8 * half).bitwiseAND(F.lit(0xFF))
            keys.append(F.lit((2 * i + half) << 24).cast("long") + _segment(fp, i) * 256 + byte)
    return F.array(*keys)


def _match(key, fp, rep, bits: int):
    """Link rows of equal key; returns (rep, root rep) of a spanning star. Sorted by key."""
    import numpy as np

    n = len(key)
    ring = ((key >> 25) & 3).astype(np.uint64)
    shift = ring * np.uint64(16)
    # Turn the ring so that each fingerprint starts at the segment of its key.
    turned = np.where(shift > 0, (fp >> shift) | (fp << ((np.uint64(64) - shift) % np.uint64(64))), fp)
    root = np.arange(n)
    at, step = np.arange(n - 1), 1
    masks = [np.uint64((1 << 16 * k) - 1) for k in (2, 3)]
    while len(at := at[at + step < n]) and len(at := at[key[at] == key[at + step]]):
        other = at + step
        delta = turned[at] ^ turned[other]
        ok = np.bitwise_count(delta & masks[0]) <= bits * 2 // 4
        ok &= np.bitwise_count(delta & masks[1]) <= bits * 3 // 4
        ok &= np.bitwise_count(delta) <= bits
        a, b = at[ok], other[ok]
        while len(a):
            ra, rb = root[a], root[b]
            open_ = ra != rb
            if not open_.any():
                break
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            low, high = np.minimum(ra, rb), np.maximum(ra, rb)
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root = root[root]
        step += 1
    order = np.lexsort((rep, root))
    first = np.r_[True, root[order][1:] != root[order][:-1]]
    least = rep[order][first][np.cumsum(first) - 1]
    keep = rep[order] != least
    return rep[order][keep], least[keep]


def links(distinct: DataFrame, bits: int = 3, block: int = 20_000) -> DataFrame:
    """``distinct(fp, rep)`` -> ``(src, dst)`` of reps, enough of them to span every component."""
    filed = distinct.select("fp", "rep", F.explode(chain_keys(F.col("fp"))).alias("key"))
    crowded = filed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    blocks = F.ceil(F.col("n") / block).cast("int")
    filed = filed.join(crowded, "key").withColumn("blocks", blocks)
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    filed = filed.withColumn("own", own).withColumn("other", other)
    filed = filed.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp", "rep")
    dealt = filed.repartition(parts(distinct), "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "fp")

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def flush(key, lo, hi, fp, rep):
            # One number for (key, lo, hi), keeping the ring position in place.
            cell = np.r_[0, np.cumsum((key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))] if len(key) else key
            tagged = (cell << 27) | key
            src, dst = _match(tagged, fp.view(np.uint64), rep, bits)
            return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])

        held = None
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "lo", "hi", "fp", "rep")]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            if len(held[0]) < 20_000:
                continue
            same = (held[0] == held[0][-1]) & (held[1] == held[1][-1]) & (held[2] == held[2][-1])
            cut = int(np.argmax(same))
            if cut:
                yield flush(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield flush(*held)

    return dealt.mapInArrow(work, "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per input row with an id.

    Null or empty text and text without words have fingerprint zero and link with
    each other; rows with a null id take no part, as they have no id to report;
    a repeated id gives a row for each of its rows; an empty table gives no rows.
    ``component_id`` is the least id reachable over fingerprints that differ in
    at most ``bits`` (up to 3) bits. Other columns are ignored.
    """
    if not 0 <= bits <= 3:
        raise ValueError("the chain keys hold for 0 to 3 bits")
    prints = materialize(fingerprints(docs.where(F.col(id_col).isNotNull()), id_col, text_col), "simhash")
    reps = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = components(links(reps, bits))
    classes = reps.join(roots, reps["rep"] == roots["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """One row of each group of near copies, all columns kept: that of the least id.

    Near copies have four fifths of their shingles of ``words`` words in common,
    or are linked by such; see ``shingles`` for how fingerprints find them. Null
    or empty text and text without words are alike, and one such row stays. Rows
    with a null id take part and stand for a group only if it has no other; of
    repeated rows one stays. An empty table gives no rows, a very long text is
    read whole, and other columns may have any name.
    """
    return shingles.one_of_each(docs, shingles.near_copies(docs, id_col, text_col, words), id_col, text_col)
