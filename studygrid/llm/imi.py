"""Embedding near-duplicates by an inverted multi-index.

Unit vectors are cut into halves, each with its own codebook, and the pairs of
codewords form a grid of cells. Every vector is filed in one cell. It visits
cells by the multi-sequence algorithm, in order of how far it would have to move
to be filed there: the squared distances to the two bisecting planes, summed. A
vector within the cosine threshold moves at most delta = sqrt(2 - 2 t), so that
cells beyond hold no link. How far links really reach is measured: ``PROBES``
vectors are compared with all others, and the traversal ends where all but a tenth
of 1 - ``recall`` of their links lie; at delta if the links found are too few to tell,
or at recall 1. Pairs that meet are settled by products of
single precision, which are off by less than ``NARROW``; the few that come as
near to the threshold as that are verified in double precision by a join, so
that cells carry vectors of half the size.

Equal vectors are one entry. A cell with more than ``block`` rows is dealt out as
pairs of blocks; tasks give back counts and spanning links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Numbered, materialize, parts
from .components import components

#: Rows that the codebooks are fitted on at least, and for each codeword; codewords of a half at most; rows a cell should hold.
SAMPLE, SAMPLE_EACH = 8192, 16
CODEWORDS = 4096
CELL_ROWS = 200
BLOCK = 4096
#: Vectors whose links are measured; steps of the reach; links in proportion to 1 / (1 - recall) that a measure takes at least.
PROBES, STEPS, TELLING = 2048, 1000, 3
#: Above the error of a product of two unit vectors in single precision, for up to some thousands of components.
NARROW = 1e-4


def codebook(rows, k: int, rounds: int = 12, seed: int = 5):
    """k-means; starts from distinct rows drawn by ``seed``."""
    import numpy as np

    rows = np.asarray(rows, float)
    distinct = np.unique(rows, axis=0)
    centers = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]]
    for _ in range(rounds):
        near = ((centers**2).sum(axis=1)[None] - 2 * rows @ centers.T).argmin(axis=1)
        sums, n = np.zeros_like(centers), np.bincount(near, minlength=len(centers))
        np.add.at(sums, near, rows)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
    return np.unique(centers, axis=0)


def margins(rows, centers):
    """Nearest codeword, and each codeword's distance from the row to the plane between it and the nearest."""
    import numpy as np

    size, at = (centers**2).sum(axis=1), np.arange(len(rows))
    d = (rows**2).sum(axis=1)[:, None] + size[None] - 2 * rows @ centers.T
    own = d.argmin(axis=1)
    # Codewords' distances from the nearest one, by products as well, so nothing of codewords by codewords is held.
    gap = np.sqrt(np.maximum(size[own][:, None] + size[None] - 2 * centers[own] @ centers.T, 0))
    gap[at, own] = 0
    out = np.where(gap > 0, (d - d[at, own][:, None]) / (2 * np.where(gap > 0, gap, 1)), 0)
    return own, np.maximum(out, 0)


def multi_sequence(a, b, most: float):
    """(i, j) of two ascending lists in order of a[i] + b[j], while that is at most ``most``."""
    import heapq

    heap, seen = [(a[0] + b[0], 0, 0)], {(0, 0)}
    while heap:
        total, i, j = heapq.heappop(heap)
        if total > most:
            return
        yield i, j
        for p in ((i + 1, j), (i, j + 1)):
            if p not in seen and p[0] < len(a) and p[1] < len(b):
                seen.add(p)
                heapq.heappush(heap, (a[p[0]] + b[p[1]], *p))


def reach(found, threshold: float, recall: float) -> float:
    """The squared reach that all but a tenth of 1 - ``recall`` of the measured links need; delta squared if they are too few, or recall is 1.

    ``found`` counts links by the step of delta squared that they need.
    """
    import numpy as np

    delta = 2 - 2 * threshold + 1e-9
    if recall >= 1 or found.sum() < TELLING / (1 - recall):
        return delta
    enough = int(np.searchsorted(np.cumsum(found), (1 - (1 - recall) / 10) * found.sum()))
    return min(delta, (enough + 1) / STEPS * delta)


def _linked(probe, members, weight, same, threshold: float):
    """Weighted number of members surely within the threshold of each probe, labels that spread over links, and pairs too near to tell.

    ``same``: for each probe the member that it is itself, or -1.
    """
    import numpy as np

    p, m = len(probe), len(members)
    hit, close = np.zeros((p, m), bool), []
    mine = same >= 0
    for at in range(0, p, 1024):
        product = probe[at : at + 1024] @ members.T
        own = mine[at : at + 1024]
        product[np.flatnonzero(own), same[at : at + 1024][own]] = -2
        hit[at : at + 1024] = product >= threshold + NARROW
        i, j = np.nonzero((product >= threshold - NARROW) & (product < threshold + NARROW))
        close.append((i + at, j))
    counts = hit @ weight
    label = np.arange(m, dtype=np.int32)
    top = np.full(p, m, np.int32)
    if hit.any():
        while True:
            for at in range(0, p, 1024):
                top[at : at + 1024] = np.where(hit[at : at + 1024], label[None], m).min(axis=1)
            # A probe that is a member shares that member's label.
            both = mine & (top < m)
            low = np.minimum(top[both], label[same[both]])
            top[both] = low
            new = label.copy()
            np.minimum.at(new, same[both], low)
            for at in range(0, p, 1024):
                new = np.minimum(new, np.where(hit[at : at + 1024], top[at : at + 1024, None], m).min(axis=0))
            if (new == label).all():
                break
            label = new
    return counts, top, label, [np.concatenate(x) for x in zip(*close, strict=True)]


def _needed(classes: DataFrame, probes: list, books: dict, unit, threshold: float) -> DataFrame:
    """``(step, n)``: links of the probes with all other vectors, counted by the step of delta squared at which the probe visits the other's cell."""

    def measure(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        sides, total = {}, np.zeros(STEPS, np.int64)
        names = {x: i for i, x in enumerate(sorted({p["label"] for p in probes}))}
        for w, (one, two) in books.items():
            own = [p for p in probes if len(p["x"]) == w]
            if own:
                u = unit([p["x"] for p in own])
                sides[w] = u, np.array([names[p["label"]] for p in own]), np.array([p["entry"] for p in own]), *(margins(half, book)[1].astype(np.float32) for half, book in ((u[:, : w // 2], one), (u[:, w // 2 :], two)))
        for batch in batches:
            label, entry = batch.column("label").to_pylist(), batch.column("entry").to_numpy()
            times, vectors = batch.column("times").to_numpy(), batch.column("x").to_pylist()
            for w in {len(v) for v in vectors} & set(sides):
                at = np.array([i for i, v in enumerate(vectors) if len(v) == w])
                u, (one, two), (p, labels, entries, m1, m2) = unit([vectors[i] for i in at]), books[w], sides[w]
                code = np.array([names.get(label[i], -1) for i in at])
                link = (p @ u.T >= threshold) & (labels[:, None] == code[None]) & (entries[:, None] != entry[at][None])
                i, j = np.nonzero(link)
                if len(i):
                    # Only members of a link are filed here.
                    some, back = np.unique(j, return_inverse=True)
                    o1, o2 = margins(u[some][:, : w // 2], one)[0][back], margins(u[some][:, w // 2 :], two)[0][back]
                    share = (m1[i, o1].astype(float) ** 2 + m2[i, o2].astype(float) ** 2) / (2 - 2 * threshold + 1e-9)
                    np.add.at(total, np.minimum((share * STEPS).astype(np.int64), STEPS - 1), times[at][j])
        steps = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(steps.astype(np.int32)), pa.array(total[steps])], ["step", "n"])

    return classes.select("label", "entry", "times", "x").mapInArrow(measure, "step int, n long")


def near_duplicates(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.98,
    recall: float = 0.999,
    block: int = BLOCK,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per input row with an id.

    Vectors link if labels are equal and not null and their cosine in double
    precision is at least ``threshold``. Vectors that are null, zero or empty, or
    hold null or non-finite components, link with nothing, as do vectors of
    different length. Rows with a null id take no part; repeated ids count each
    row. ``n_links`` counts other rows, copies included. An empty table gives no
    rows; other columns, of any name, are ignored.
    """
    names = Numbered(rows)
    x = F.transform(F.col(names.of(vector_col)), lambda v: v.cast("double"))
    id_ = F.col(names.of(id_col)).cast("long")
    all_rows = names.df.where(id_.isNotNull()).select(id_.alias("id"), F.col(names.of(label_col)).cast("string").alias("label"), x.alias("x"))
    fine = F.col("label").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("x", lambda v: v != 0)
    usable = all_rows.where(fine)
    classes = usable.groupBy("label", "x").agg(F.min("id").alias("rep"), F.count("*").alias("times"))
    # An id that repeats with other vectors stands for several entries; they are told apart by a number.
    classes = materialize(classes.withColumn("entry", F.xxhash64("label", "x")), "vectors")
    n, distinct = classes.agg(F.count("*"), F.count_distinct("entry")).first()
    if distinct < n:
        # Two vectors have one hash. A salted one is found for all, which needs another pass only here.
        for salt in range(1, 100):
            number = F.xxhash64("label", "x", F.lit(salt))
            if classes.select(F.count_distinct(number)).first()[0] == n:
                break
        else:
            raise RuntimeError("no numbering of the vectors is free of collisions")
        classes = materialize(classes.withColumn("entry", number), "vectors")
    else:
        number = F.xxhash64("label", "x")
    k = int(min(CODEWORDS, max(1, round((n / CELL_ROWS) ** 0.5))))
    chosen = classes.orderBy(F.xxhash64("entry"), "rep").limit(max(SAMPLE, SAMPLE_EACH * k)).select("label", "entry", "x").collect()
    sample = [r["x"] for r in chosen]
    if not n:
        return all_rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    import numpy as np

    by_width: dict[int, list] = {}
    for v in sample:
        by_width.setdefault(len(v), []).append(v)

    def unit(v):
        v = np.asarray(v, float)
        v = v / np.abs(v).max(axis=1, keepdims=True)
        return v / np.sqrt((v**2).sum(axis=1, keepdims=True))

    books = {}
    for w, vs in by_width.items():
        u = unit(vs)
        books[w] = (codebook(u[:, : w // 2], k), codebook(u[:, w // 2 :], k))
    found = np.zeros(STEPS, np.int64)
    if recall < 1 and n > PROBES:
        for r in _needed(classes, chosen[:PROBES], books, unit, threshold).groupBy("step").agg(F.sum("n").alias("n")).collect():
            found[r["step"]] = r["n"]
    most = reach(found, threshold, recall)

    def file(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            label, entry = batch.column("label").to_pylist(), batch.column("entry").to_pylist()
            times, vectors = batch.column("times").to_pylist(), batch.column("x").to_pylist()
            for w in {len(v) for v in vectors}:
                at = [i for i, v in enumerate(vectors) if len(v) == w]
                u = unit([vectors[i] for i in at])
                narrow = u.astype(np.float32)
                cells: list = [[0]] * len(at)
                if w in books:
                    one, two = books[w]
                    (o1, m1), (o2, m2) = margins(u[:, : w // 2], one), margins(u[:, w // 2 :], two)
                    cells = []
                    m1, m2 = m1**2, m2**2
                    a, b = np.argsort(m1, axis=1, kind="stable"), np.argsort(m2, axis=1, kind="stable")
                    for r in range(len(at)):
                        # The own codeword is first: its distance is zero, and ties are put behind it.
                        p, q = a[r][m1[r][a[r]] <= most].tolist(), b[r][m2[r][b[r]] <= most].tolist()
                        p.remove(o1[r])
                        q.remove(o2[r])
                        p, q = [int(o1[r]), *p], [int(o2[r]), *q]
                        cells.append([p[i] * len(two) + q[j] for i, j in multi_sequence(m1[r][p].tolist(), m2[r][q].tolist(), most)])
                for r, i in enumerate(at):
                    for c, cell in enumerate([cells[r][0], *cells[r]]):
                        for col, v in zip(out, (label[i], w << 32 | cell, c > 0, entry[i], times[i], narrow[r]), strict=True):
                            col.append(v)
            types = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.float32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["label", "cell", "probe", "entry", "times", "u"])

    filed = materialize(classes.mapInArrow(file, "label string, cell long, probe boolean, entry long, times long, u array<float>"), "cells")
    spread = filed.groupBy("label", "cell").agg(F.ceil(F.count_if(~F.col("probe")) / block).cast("int").alias("mb"), F.ceil(F.count_if("probe") / block).cast("int").alias("pb"))
    # Cells that nothing is filed in have nothing to verify.
    filed = filed.join(spread.where(F.col("mb") > 0), ["label", "cell"])
    own = F.pmod(F.xxhash64("entry"), F.when(F.col("probe"), F.col("pb")).otherwise(F.col("mb"))).cast("int")
    filed = filed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("probe"), F.col("mb")).otherwise(F.greatest("pb", F.lit(1))) - 1)))
    filed = filed.select("label", "cell", F.when(F.col("probe"), F.col("own")).otherwise(F.col("other")).alias("p"), F.when(F.col("probe"), F.col("other")).otherwise(F.col("own")).alias("m"), "probe", "entry", "times", "u")
    keys = ["label", "cell", "p", "m"]
    dealt = filed.repartition(parts(classes), *keys).sortWithinPartitions(*keys)

    def verify(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def flush(group):
            probe = np.array([g[0] for g in group])
            entry, times = np.array([g[1] for g in group], np.int64), np.array([g[2] for g in group], np.int64)
            u = np.stack([g[3] for g in group])
            pe, me = entry[probe], entry[~probe]
            at = {e: i for i, e in enumerate(me.tolist())}
            same = np.array([at.get(e, -1) for e in pe.tolist()], np.int64)
            counts, top, label, (i, j) = _linked(u[probe], u[~probe], times[~probe], same, threshold)
            tied = top < len(me)
            src = np.concatenate([pe[tied], me])
            dst = np.concatenate([me[top[tied]], me[label]])
            edge = src != dst
            linked = counts > 0
            none = pa.nulls(int(edge.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(pe[linked]), pa.nulls(int(linked.sum()), pa.int64()), pa.array(counts[linked].astype(np.int64))], ["src", "dst", "n"])
            yield pa.RecordBatch.from_arrays([pa.array(src[edge]), pa.array(dst[edge]), none], ["src", "dst", "n"])
            # Zero: still to be verified.
            yield pa.RecordBatch.from_arrays([pa.array(pe[i]), pa.array(me[j]), pa.array(np.zeros(len(i), np.int64))], ["src", "dst", "n"])

        key, group = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*keys, "probe", "entry", "times")]
            width = batch.column("u")
            for i, row in enumerate(zip(*columns, strict=True)):
                if row[:4] != key:
                    if len(group) > 1:
                        yield from flush(group)
                    key, group = row[:4], []
                group.append((*row[4:], width[i].values.to_numpy()))
        if len(group) > 1:
            yield from flush(group)

    found = materialize(dealt.mapInArrow(verify, "src long, dst long, n long"), "verified")

    def exactly(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            a, b = (unit(batch.column(c).to_pylist()) if len(set(map(len, batch.column(c).to_pylist()))) == 1 else [unit([v])[0] for v in batch.column(c).to_pylist()] for c in ("x", "y"))
            ok = pa.array([float(p @ q) >= threshold for p, q in zip(a, b, strict=True)], pa.bool_())
            yield batch.select(["src", "dst", "n"]).filter(ok)

    close = found.where("n = 0").select("src", "dst").distinct()
    close = close.join(classes.select(F.col("entry").alias("src"), "x"), "src").join(classes.select(F.col("entry").alias("dst"), F.col("x").alias("y"), F.col("times").alias("n")), "dst")
    close = materialize(close.select("src", "dst", "n", "x", "y").mapInArrow(exactly, "src long, dst long, n long"), "verified")
    links = found.where("n > 0").select("src", "n").unionByName(close.select("src", "n")).groupBy(F.col("src").alias("entry")).agg(F.sum("n").alias("others"))
    roots = components(found.where("n is null").select("src", "dst").unionByName(close.select("src", "dst"))).select(F.col("node").alias("entry"), "root")
    joined = classes.select("label", "x", "entry", "rep", "times").join(links, "entry", "left").join(roots, "entry", "left").withColumn("root", F.coalesce("root", "entry"))
    least = joined.groupBy("root").agg(F.min("rep").alias("component_id"))
    joined = joined.join(least, "root").select("entry", "component_id", (F.coalesce("others", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    marked = all_rows.select("id", F.when(fine, number).alias("entry")).join(joined, "entry", "left")
    component = F.coalesce("component_id", "id")
    return marked.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
