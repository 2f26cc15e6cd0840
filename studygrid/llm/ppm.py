"""Language-model scoring by prediction by partial matching over bytes.

The trie holds contexts of 0 to ``ORDER`` bytes with the counts of what follows,
gathered from all training texts. A symbol that the longest context has seen
gets (2 c - 1) / 2 t, with t occurrences and d different symbols there (escape
method D); else the escape d / 2 t is paid and the next shorter context is
asked, with the symbols already ruled out excluded from its counts; at last the
symbols never seen share evenly. Each text is read from a start mark to an end
symbol, so probabilities sum to one over texts.

A node is the last k + 1 bytes in one integer. Tasks count sorted nodes of the
longest contexts, which one shuffle adds up; shorter contexts are their sums.
What workers hold is bounded: of a trie with more than ``max_nodes`` nodes they
hold the log probabilities of the most frequent nodes of the longest contexts, and
all other symbols are looked up in the whole trie by joins. Scores are the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log10

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, materialize, small_batches, strings

ORDER = 5
#: Bytes that no UTF-8 text holds.
START, END = 0xFF, 0xFE
#: Trie nodes that workers hold; all others are looked up by joins.
MAX_NODES = 5_000_000
#: Tokens whose counts are broadcast; all others are looked up by a join.
MAX_TOKENS = 200_000
CHUNK = 1_000_000
_TRIES: dict = {}


def nodes(texts: list[bytes], order: int = ORDER):
    """Keys of all symbols of the texts with their contexts, and each text's number of symbols."""
    import numpy as np

    flat = np.frombuffer(b"".join([bytes([START]) * order + x + bytes([END]) for x in texts]), np.uint8)
    sizes = np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts))
    key = np.zeros(len(flat) - order, np.uint64)
    for i in range(order + 1):
        key <<= np.uint64(8)
        key |= flat[i : len(flat) - order + i]
    if len(texts) > 1:
        # Not those whose symbol is in the next text's run of start marks.
        starts = np.cumsum(sizes + order)[:-1]
        out = np.ones(len(key), bool)
        for i in range(order):
            out[starts - order + i] = False
        key = key[out]
    return key, sizes


def tally(keys, counts=None):
    import numpy as np

    if counts is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.diff(np.r_[first, len(keys)])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _lookup(table, keys):
    """Place of each key in a sorted table, and whether it is there."""
    import numpy as np

    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


@dataclass
class Trie:
    """``levels[k]``: sorted keys of k context bytes and a symbol, and their counts."""

    levels: list

    def prepare(self):
        """Sums of contexts, and the table of the longest ones, whose own counts are then let go."""
        import numpy as np

        self.contexts = []
        for k, (keys, counts) in enumerate(self.levels):
            first = np.flatnonzero(np.r_[True, keys[1:] >> np.uint64(8) != keys[:-1] >> np.uint64(8)]) if len(keys) else np.zeros(0, np.int64)
            below = np.zeros(len(keys), np.int64)
            for at in range(0, len(keys) if k else 0, 1 << 18):
                place, ok = _lookup(self.levels[k - 1][0], keys[at : at + (1 << 18)] & np.uint64((1 << 8 * k) - 1))
                below[at : at + (1 << 18)][ok] = self.levels[k - 1][1][place[ok]]
            # Occurrences, symbols, and the symbols' occurrences one level down.
            add = lambda x, f=first: np.add.reduceat(x, f) if len(f) else np.zeros(0, np.int64)
            self.contexts.append((keys[first] >> np.uint64(8), add(counts), np.diff(np.r_[first, len(keys)]), add(below)))
        keys, counts = self.levels[-1]
        total = np.repeat(self.contexts[-1][1], self.contexts[-1][2])
        self.table = Table(keys, np.log10((counts - 0.5) / total) if len(keys) else np.zeros(0))
        self.levels[-1] = None
        return self

    def walk(self, keys):
        """log10 probabilities of keys that the table does not hold, by escaping from context to context."""
        import numpy as np

        def steps():
            for k in range(len(self.levels) - 1, -1, -1):
                own = keys & np.uint64((1 << 8 * (k + 1)) - 1)
                ctxs, total, symbols, below = self.contexts[k]
                at, there = _lookup(ctxs, own >> np.uint64(8))
                if not len(ctxs):
                    continue
                count = np.zeros(len(own), np.int64)
                if self.levels[k]:
                    entry, seen = _lookup(self.levels[k][0], own)
                    count[seen] = self.levels[k][1][entry[seen]]
                yield there, count, total[at], symbols[at], below[at]

        return escaped(steps(), len(keys))

    def score(self, texts: list[bytes]):
        """log10 probability of each text, and the keys left to look up: none."""
        import numpy as np

        order = len(self.levels) - 1
        keys, sizes = nodes(texts, order)
        values, known = self.table.get(keys)
        if not known.all():
            missed, back = np.unique(keys[~known], return_inverse=True)
            values[~known] = self.walk(missed)[back]
        return np.add.reduceat(values, np.cumsum(sizes) - sizes), [keys[:0]] * len(texts)


@dataclass
class Part:
    """The log10 probabilities of some nodes of the longest contexts."""

    order: int
    keys: object
    values: object

    def prepare(self):
        self.table = Table(self.keys, self.values)
        self.keys = self.values = None
        return self

    def score(self, texts: list[bytes]):
        """log10 probability of the symbols of each text that are held, and the keys of all others."""
        import numpy as np

        keys, sizes = nodes(texts, self.order)
        values, known = self.table.get(keys)
        starts = np.cumsum(sizes) - sizes
        missed = np.split(keys[~known], np.cumsum(np.add.reduceat((~known).astype(np.int64), starts))[:-1])
        return np.add.reduceat(np.where(known, values, 0.0), starts), missed


def escaped(steps, n: int):
    """log10 probabilities of n symbols; ``steps`` has, from the longest context down, whether it is there, the
    symbol's count in it, its occurrences, its symbols, and their occurrences one level down."""
    import numpy as np

    out, done = np.zeros(n), np.zeros(n, bool)
    gone_t, gone_d = np.zeros(n), np.zeros(n)
    for there, count, total, symbols, below in steps:
        t, d = total - gone_t, symbols - gone_d
        live = there & ~done & (d > 0)
        hit = live & (count > 0)
        out[hit] += np.log10((count[hit] - 0.5) / t[hit])
        miss = live & (count == 0)
        out[miss] += np.log10(d[miss] / (2 * t[miss]))
        done |= hit
        gone_t, gone_d = np.where(there, below, 0), np.where(there, symbols, 0)
    rest = ~done
    out[rest] -= np.log10(256 - gone_d[rest])
    return out


class Table:
    """Open addressing from integers to floats, in arrays."""

    def __init__(self, keys, values):
        import numpy as np

        bits = max(4, int(len(keys) * 1.6).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, np.uint64(2**64 - 1)), np.zeros(1 << bits)
        for begin in range(0, len(keys), 1 << 18):
            self._put(keys[begin : begin + (1 << 18)], values[begin : begin + (1 << 18)])

    def _put(self, keys, values) -> None:
        import numpy as np

        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot] == np.uint64(2**64 - 1)
            at, who = slot[free], left[free]
            self.keys[at] = keys[who]
            self.values[at] = values[who]
            lost = self.keys[slot] != keys[left]
            left, slot = left[lost], (slot[lost] + 1) & self.mask

    def _slot(self, keys):
        import numpy as np

        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys):
        import numpy as np

        slot = self._slot(keys)
        held = self.keys[slot]
        known, values = held == keys, self.values[slot]
        left = np.flatnonzero(~known & (held != np.uint64(2**64 - 1)))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & self.mask
            held = self.keys[slot]
            hit = held == keys[left]
            known[left[hit]] = True
            values[left[hit]] = self.values[slot[hit]]
            go = ~hit & (held != np.uint64(2**64 - 1))
            left, slot = left[go], slot[go]
        return values, known


def gather(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``(token, node, n)`` over ``docs(text)``: counts of words and one end (empty token) a text, and of trie nodes."""

    def work(batches: Iterator) -> Iterator:
        from collections import Counter

        import numpy as np
        import pyarrow as pa

        _forget()
        names = ["token", "node", "n"]

        def words(seen):
            n = len(seen)
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.nulls(n, pa.int64()), pa.array(list(seen.values()), pa.int64())], names)

        seen, keys, counts, chunk, size = Counter(), np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

        def count():
            nonlocal keys, counts, chunk, size
            now, n = tally(nodes(chunk, order)[0])
            keys, counts = tally(np.concatenate([keys, now]), np.concatenate([counts, n]))
            chunk, size = [], 0

        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            for text in strings(batch, "text"):
                text = text.lower()
                seen.update(text.split())
                seen[b""] += 1
                chunk.append(text)
                size += len(text) + 1
                if size >= CHUNK:
                    count()
                    if len(seen) > 200_000:
                        yield words(seen)
                        seen.clear()
                    if len(keys) > 1_000_000:
                        yield pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.binary()), pa.array(keys.view(np.int64)), pa.array(counts)], names)
                        keys, counts = keys[:0], counts[:0]
        if chunk:
            count()
        yield words(seen)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.binary()), pa.array(keys.view(np.int64)), pa.array(counts)], names)

    return docs.mapInArrow(work, "token binary, node long, n long").groupBy("token", "node").agg(F.sum("n").alias("n"))


def _least_count(counts: DataFrame, most: int, steps: int = 1024) -> int:
    """The least count that at most ``most`` rows reach, whatever the counts are.

    A histogram of powers of two tells between which two it lies, further ones
    of ``steps`` equal steps narrow that down; none has more rows than steps.
    """
    power = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    above, low, high = 0, 1, None
    for r in sorted(counts.groupBy(power.alias("k")).count().collect(), key=lambda r: -r["k"]):
        if above + r["count"] > most:
            # Doubles may round a count next to a power of two up to it: the bounds leave room for that.
            low, high = 1 << max(0, r["k"] - 1), 1 << (r["k"] + 1)
            break
        above += r["count"]
    if high is None:
        return 1
    above = counts.where(F.col("n") >= high).count()
    while high - low > 0:
        width = -(-(high - low) // steps)
        at = F.expr(f"(n - {low}L) div {width}L")
        found = counts.where((F.col("n") >= low) & (F.col("n") < high)).groupBy(at.alias("k")).count().collect()
        for r in sorted(found, key=lambda r: -r["k"]):
            if above + r["count"] > most:
                if width == 1:
                    return low + r["k"] + 1
                low, high = low + r["k"] * width, min(high, low + (r["k"] + 1) * width)
                break
            above += r["count"]
        else:
            return low
    return high


def _masked(key, level, order: int):
    """The last ``level`` + 1 bytes of a key."""
    masks = F.array(*[F.lit((1 << 8 * (k + 1)) - 1).cast("long") for k in range(order + 1)])
    return F.col(key).bitwiseAND(F.element_at(masks, F.col(level) + 1))


def trie_nodes(counted: DataFrame, order: int = ORDER) -> DataFrame:
    """``(level, node, n)`` of the whole trie from ``gather``'s rows."""
    top = counted.where(F.col("node").isNotNull())
    below = top.select("node", "n", F.explode(F.sequence(F.lit(0), F.lit(order))).alias("level")).select("level", _masked("node", "level", order).alias("node"), "n")
    return materialize(below.groupBy("level", "node").agg(F.sum("n").alias("n")), "trie")


def build(every: DataFrame, order: int = ORDER) -> Trie:
    """The trie of all nodes."""
    import numpy as np

    table = every.toArrow()
    levels, node, n = (np.asarray(table.column(c)) for c in ("level", "node", "n"))
    out = []
    for k in range(order + 1):
        own = levels == k
        at = np.argsort(node[own])
        out.append((node[own][at].astype(np.uint64), n[own][at]))
    return Trie(out)


def _contexts(every: DataFrame, order: int) -> DataFrame:
    """``(level, ctx, total, symbols, below)``, as ``Trie.prepare`` has them."""
    lower = every.where(F.col("level") < order).select((F.col("level") + 1).alias("above"), F.col("node").alias("suffix"), F.col("n").alias("below"))
    own = every.withColumn("shorter", F.greatest(F.col("level") - 1, F.lit(0)))
    own = own.select("level", "node", "n", F.col("level").alias("above"), _masked("node", "shorter", order).alias("suffix"))
    joined = own.join(lower, ["above", "suffix"], "left")
    sums = joined.groupBy("level", F.shiftrightunsigned("node", 8).alias("ctx")).agg(F.sum("n").alias("total"), F.count("*").alias("symbols"), F.sum(F.coalesce("below", F.lit(0))).alias("below"))
    return materialize(sums, "contexts")


def _part(every: DataFrame, contexts: DataFrame, order: int, most: int) -> Part:
    """The most frequent nodes of the longest contexts, with their values from the whole trie."""
    import numpy as np

    top = every.where(F.col("level") == order)
    top = top.where(F.col("n") >= _least_count(top, most)).withColumn("ctx", F.shiftrightunsigned("node", 8))
    value = F.log10((F.col("n") - 0.5) / F.col("total")).alias("value")
    table = top.join(contexts.where(F.col("level") == order).select("ctx", "total"), "ctx").select("node", value).toArrow()
    return Part(order, np.asarray(table.column("node")).astype(np.uint64), np.asarray(table.column("value")))


def _looked_up(keys: DataFrame, every: DataFrame, contexts: DataFrame, order: int) -> DataFrame:
    """``(key, value)`` of distinct keys by the whole trie."""

    def find(rows, table, on, small):
        # Short contexts are few and asked for by many keys.
        few = rows.where(F.col("level") <= small).join(F.broadcast(table.where(F.col("level") <= small)), on, "left")
        return few.unionByName(rows.where(F.col("level") > small).join(table.where(F.col("level") > small), on, "left"))

    asked = keys.select("key", F.explode(F.sequence(F.lit(0), F.lit(order))).alias("level"))
    asked = asked.withColumn("node", _masked("key", "level", order)).withColumn("ctx", F.shiftrightunsigned("node", 8))
    asked = find(find(asked, every, ["level", "node"], 1), contexts, ["level", "ctx"], 2)
    names = ("n", "total", "symbols", "below")
    wide = asked.groupBy("key").agg(*[F.coalesce(F.max(F.when(F.col("level") == k, F.col(c))), F.lit(0)).alias(f"{c}{k}") for k in range(order + 1) for c in names])

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            get = lambda c, b=batch: b.column(c).to_numpy(zero_copy_only=False)
            steps = ((get(f"total{k}") > 0, get(f"n{k}"), get(f"total{k}"), get(f"symbols{k}"), get(f"below{k}")) for k in range(order, -1, -1))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(escaped(steps, batch.num_rows))], ["key", "value"])

    return wide.mapInArrow(work, "key long, value double")


def _prepared(tag: str, shared):
    """The trie and word scores of a run, made ready once a worker."""
    if tag not in _TRIES:
        _forget()
        trie, common = shared.value
        _TRIES[tag] = trie.prepare(), common
    return _TRIES[tag]


def _forget() -> None:
    _TRIES.clear()


def score(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, max_nodes: int = MAX_NODES, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``(doc_id, learned, n_tokens, n_known, train_tokens, base_score, score)``, one row per input row.

    Trained on the rows where the condition ``learn`` holds; A-Z are lower-cased.
    ``score`` is the log10 probability of the whole text; ``base_score`` that of
    its words and one end by smoothed word counts. A null text is like an empty
    one, which has the end alone; null ids and repeated rows count and are
    scored like others; without training rows all symbols are equally likely.
    """
    import uuid

    spark = docs.sparkSession
    frame = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learned"), F.col(text_col).cast("string").alias("text"))
    with small_batches(spark):
        counted = materialize(gather(frame.where("learned").select("text"), order), "grams")
    tokens = counted.where(F.col("token").isNotNull())
    total = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, weight = total["n"], total["n"] + 0.5 * (total["v"] + 1)
    often = tokens.where(F.col("n") >= _least_count(tokens, max_tokens)).toArrow()
    logs = {k: log10((n + 0.5) / weight) for k, n in zip(often.column("token").to_pylist(), often.column("n").to_pylist(), strict=True)}
    every = trie_nodes(counted, order)
    whole = every.count() <= max_nodes
    contexts = None if whole else _contexts(every, order)
    shared = spark.sparkContext.broadcast((build(every, order) if whole else _part(every, contexts, order, max_nodes), logs))
    tag = uuid.uuid4().hex

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        trie, common = _prepared(tag, shared)
        get, row = common.get, TaskContext.get().partitionId() << 40
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            texts = [x.lower() for x in strings(batch, "text")]
            n_tokens, n_known, base, rare, scores, missed, at = [], [], [], [], [], [], 0
            while at < len(texts):
                some, size = [], 0
                while at < len(texts) and (not some or size + len(texts[at]) < CHUNK):
                    some.append(texts[at])
                    size += len(texts[at])
                    at += 1
                found, left = trie.score(some)
                scores.append(found)
                missed += left
            for text in texts:
                words, sum_, other = text.split(), 0.0, []
                words.append(b"")
                for w in words:
                    v = get(w)
                    if v is None:
                        other.append(w)
                    else:
                        sum_ += v
                n_tokens.append(len(words))
                n_known.append(len(words) - len(other))
                base.append(sum_)
                rare.append(other)
            n = len(texts)
            ends = pa.array(np.cumsum([0, *map(len, missed)]), pa.int32())
            keys = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(missed).view(np.int64) if missed else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + n)), batch.column("doc_id"), batch.column("learned"), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(np.concatenate(scores) if scores else np.zeros(0)), pa.array(rare, pa.list_(pa.binary())), keys],
                ["row", "doc_id", "learned", "n_tokens", "n_known", "base", "score", "rare", "keys"],
            )
            row += n

    id_type = frame.schema["doc_id"].dataType.simpleString()
    with small_batches(spark):
        done = materialize(frame.mapInArrow(work, f"row long, doc_id {id_type}, learned boolean, n_tokens long, n_known long, base double, score double, rare array<binary>, keys array<long>"), "scored")
    seldom = done.select("row", F.explode("rare").alias("token")).groupBy("row", "token").agg(F.count("*").alias("times"))
    seldom = seldom.join(tokens.select("token", F.col("n").alias("c")), "token", "left")
    each = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(weight))
    seldom = seldom.groupBy("row").agg(F.sum(F.col("times") * each).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"))
    rest = F.lit(0.0)
    if not whole:
        missed = done.select("row", F.explode("keys").alias("key")).groupBy("row", "key").agg(F.count("*").alias("times"))
        values = _looked_up(missed.select("key").distinct(), every, contexts, order)
        missed = missed.join(values, "key").groupBy("row").agg(F.sum(F.col("times") * F.col("value")).alias("rest"))
        done, rest = done.join(missed, "row", "left"), F.coalesce("rest", F.lit(0.0))
    return done.join(seldom, "row", "left").select(
        "doc_id",
        "learned",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + rest).alias("score"),
    )


__all__ = ["Trie", "build", "gather", "held", "nodes", "score", "trie_nodes"]
