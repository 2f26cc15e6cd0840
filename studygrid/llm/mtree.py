"""Exact top-k inner products by M-trees.

With one more coordinate, sqrt(M - |x|^2) for rows and 0 for queries, where M is
the largest squared norm, a larger inner product is a smaller Euclidean distance,
so an M-tree serves. Rows are dealt to the nearest of some pivots, whose covering
radii bound what a query can find there. Queries visit pivots best-first in
rounds, a few more each time, until the bound of the next is beyond their k-th
best so far, which they take along to the next round. A pivot's rows are dealt
into blocks of bounded size; a block's tree is bulk-loaded into pages with a
routing row, a covering radius and each entry's distance to the routing row of
its page. Queries of a block search best-first too: each takes
its pages in order of their least possible distance until that is beyond its
k-th best, whole pages are skipped by the parent's stored distance before their
own is computed, and of a page only entries are computed that the stored
distances cannot rule out. Queries that read the same page in a round share one
matrix product. Equal vectors are one entry with its k + 1 least ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BLOCK = 16_384
#: Queries that meet a block at a time: it is copied once for so many.
QUERIES = 8192
PAGE = 256
FAN = 16
#: Most pivots; beyond so many blocks a pivot has several.
PIVOTS = 1024
#: Pivots a query visits in the first round, and how many times as many it has visited after each further one.
FIRST, GROWTH = 1, 8
#: Below every score; its negative is an integer too.
LOW = -(1 << 63) + 1


class MTree:
    """``rows``: int64 matrix; entries are numbered as the rows are.

    ``most`` is above the absolute value of every score. Below 2**53 products of
    doubles are exact; from there on scores are computed as integers, below 2**63.
    """

    def __init__(self, rows, page: int = PAGE, fan: int = FAN, seed: int = 7, most: float = 2.0**53):
        import numpy as np

        if most >= 2.0**63:
            raise OverflowError("scores beyond 64 bits")
        self.integers, self.exact, self.packed = rows, most <= 2.0**53, most * len(rows) < 2.0**61
        rows = rows.astype(np.float64)
        self.rows, self.page, self.fan = rows, page, fan
        norms = (rows**2).sum(axis=1)
        self.bound = float(norms.max()) if len(rows) else 0.0
        self.space = np.hstack([rows, np.sqrt(np.maximum(self.bound - norms, 0))[:, None]])
        self.rng = np.random.default_rng(seed)
        #: Pages that queries have read.
        self.reads = 0
        # Of each page: routing row, radius, entries, their stored distances, upper node.
        self.pages: list[tuple] = []
        # Of each upper node: routing row, radius; and of each page its distance to it.
        self.uppers: list[tuple] = []
        if len(rows):
            self._split(np.arange(len(rows)), None)

    def _distance(self, at, center):
        import numpy as np

        return np.sqrt(((self.space[at] - center) ** 2).sum(axis=1))

    def _split(self, at, upper) -> None:
        import numpy as np

        center = self.space[at].mean(axis=0)
        center = self.space[at[np.argmin(((self.space[at] - center) ** 2).sum(axis=1))]]
        far = self._distance(at, center)
        if len(at) <= self.page or not far.max() > 0:
            order = np.argsort(far, kind="stable")
            for k in range(0, len(at), max(self.page, 1)):
                own = order[k : k + self.page]
                up = upper if upper is not None else self._upper(center, far.max())
                self.pages.append((center, float(far[own].max()), at[own], far[own], up, float(np.sqrt(((center - self.uppers[up][0]) ** 2).sum()))))
            return
        pick = self.space[self.rng.choice(at, min(self.fan, len(at)), replace=False)]
        near = ((pick**2).sum(axis=1)[None] - 2 * self.space[at] @ pick.T).argmin(axis=1)
        groups = [at[near == j] for j in range(len(pick)) if (near == j).any()]
        if len(groups) == 1:
            groups = [at[order] for order in np.array_split(np.argsort(far, kind="stable"), 2)]
        for own in groups:
            self._split(own, upper if upper is not None else self._upper_of(own))

    def _upper(self, center, radius) -> int:
        self.uppers.append((center, float(radius)))
        return len(self.uppers) - 1

    def _upper_of(self, at) -> int:
        center = self.space[at[0]]
        return self._upper(center, self._distance(at, center).max())

    def search(self, queries, k: int, floor=None):
        """(k best scores, their rows) of each query, best first, -1 where there are fewer; ties to the smaller row.

        ``floor``: scores below it are not sought, LOW for any.
        """
        import numpy as np

        n, q = len(self.rows), len(queries)
        # Scores and rows of the k best; packed, a score and its row in one number.
        best, found = np.full((q, k), LOW), np.full((q, k), -1)
        if not n or not q:
            return best, found
        integers, queries = queries, queries.astype(np.float64)
        space = np.hstack([queries, np.zeros((q, 1))])
        norms = (queries**2).sum(axis=1)
        slack = 1e-6 * (1 + norms + self.bound)

        def distances(points, who):
            return np.sqrt(np.maximum((points**2).sum(axis=1)[None] + norms[who, None] - 2 * space[who] @ points.T, 0))

        everyone = np.arange(q)
        to_upper = distances(np.array([u[0] for u in self.uppers]), everyone)
        up = np.array([p[4] for p in self.pages])
        radius, stored = np.array([p[1] for p in self.pages]), np.array([p[5] for p in self.pages])
        # From stored distances alone; a page's own distance is computed when it could matter.
        guess = np.maximum(np.maximum(np.abs(to_upper[:, up] - stored) - radius, to_upper[:, up] - np.array([u[1] for u in self.uppers])[up]), 0)
        known = np.zeros((q, len(self.pages)), bool)
        own = np.full((q, len(self.pages)), np.nan)
        reach = np.full(q, np.inf)
        if floor is not None:
            some = floor > LOW
            reach[some] = norms[some] + self.bound - 2.0 * floor[some]
        active = everyone
        while len(active):
            page = guess[active].argmin(axis=1)
            nearest = guess[active, page]
            go = (nearest < np.inf) & (nearest**2 <= reach[active] + slack[active])
            active, page = active[go], page[go]
            if not len(active):
                break
            order = np.argsort(page, kind="stable")
            cuts = np.flatnonzero(np.r_[True, page[order][1:] != page[order][:-1]])
            for a, b in zip(cuts, [*cuts[1:], len(page)], strict=True):
                j, who = int(page[order[a]]), active[order[a:b]]
                center, r, at, far = self.pages[j][:4]
                new = who[~known[who, j]]
                if len(new):
                    own[new, j] = distances(center[None], new)[:, 0]
                    known[new, j] = True
                    guess[new, j] = np.maximum(guess[new, j], own[new, j] - r)
                    who = who[guess[who, j] ** 2 <= reach[who] + slack[who]]
                if len(who):
                    self.reads += len(who)
                    self._read(j, who, queries if self.exact else integers, at, far, own, reach, slack, best, found, norms, k)
                    guess[who, j] = np.inf
        if not self.packed:
            return best, found
        rows = np.where(best > LOW, n - 1 - best % n, -1)
        return np.where(rows >= 0, best // n, best), rows

    def _read(self, j, who, queries, at, far, own, reach, slack, best, found, norms, k) -> None:
        import numpy as np

        open_ = (own[who, j][:, None] - far[None]) ** 2 <= (reach[who] + slack[who])[:, None]
        some = open_.any(axis=0)
        if not some.any():
            return
        if self.exact:
            scores = np.rint(queries[who] @ self.rows[at[some]].T).astype(np.int64)
        else:
            scores = queries[who] @ self.integers[at[some]].T
        if self.packed:
            # A score and its row in one number that orders by score, then smaller row.
            ranked = np.where(open_[:, some], scores * len(self.rows) + (len(self.rows) - 1 - at[some]), LOW)
            both = np.concatenate([best[who], ranked], axis=1)
            if both.shape[1] > k:
                both = -np.partition(-both, k - 1, axis=1)[:, :k]
            best[who] = -np.sort(-both, axis=1)
            last = best[who, -1] // len(self.rows)
        else:
            both = np.concatenate([best[who], np.where(open_[:, some], scores, LOW)], axis=1)
            rows = np.concatenate([found[who], np.broadcast_to(at[some], scores.shape)], axis=1)
            order = np.lexsort((rows, -both), axis=1)[:, :k]
            best[who], found[who] = np.take_along_axis(both, order, axis=1), np.take_along_axis(rows, order, axis=1)
            found[who] = np.where(best[who] > LOW, found[who], -1)
            last = best[who, -1]
        full = best[who, -1] > LOW
        reach[who[full]] = np.minimum(reach[who[full]], norms[who[full]] + self.bound - 2.0 * last[full])


class Pivots:
    """Routing rows above the blocks, in the space of distances, with the radius of what was dealt to each."""

    def __init__(self, rows, bound: float):
        import numpy as np

        self.rows, self.bound = rows.astype(np.float64), bound
        self.last = np.sqrt(np.maximum(bound - (self.rows**2).sum(axis=1), 0))
        self.radius = np.full(len(rows), -np.inf)

    def distances(self, x, queries: bool):
        """Of rows, or of queries, whose last coordinate is 0, to all pivots."""
        import numpy as np

        x = x.astype(np.float64)
        norms = (x**2).sum(axis=1)
        last = np.zeros(len(x)) if queries else np.sqrt(np.maximum(self.bound - norms, 0))
        square = (norms + last**2)[:, None] + self.bound - 2 * (x @ self.rows.T + last[:, None] * self.last[None])
        return np.sqrt(np.maximum(square, 0))

    def order(self, queries):
        """Pivots that hold rows, nearest bound first, and the bounds in that order."""
        import numpy as np

        away = self.distances(queries, True)
        least = np.where(np.isfinite(self.radius)[None], np.maximum(away - self.radius[None], 0), np.inf)
        at = np.lexsort((away, least), axis=1)
        return at, np.take_along_axis(least, at, axis=1)


def quantized(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``(id, q)``: floor(scale * x) of each component; without vectors that are null or hold null or non-finite values."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    fine = ~F.exists(F.col("x"), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull() & fine).select("id", F.transform("x", lambda v: F.floor(v * scale)).alias("q"))


def _matrix(column, width: int):
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return flat.flatten().to_numpy().reshape(len(flat), width)


def _dealt(points: DataFrame, pivots: Pivots, width: int) -> DataFrame:
    """``(rep, q, p, away)``: each row's nearest pivot, ties to the first, and its distance."""
    shared = points.sparkSession.sparkContext.broadcast(pivots)

    def work(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x = _matrix(batch.column("q"), width)
            away = shared.value.distances(x, False)
            near = away.argmin(axis=1) if len(x) else np.zeros(0, int)
            yield pa.record_batch([batch.column("rep"), batch.column("q"), pa.array(near.astype(np.int32)), pa.array(away[np.arange(len(x)), near])], names=["rep", "q", "p", "away"])

    return materialize(points.mapInArrow(work, "rep long, q array<long>, p int, away double"), "dealt")


def _asked(queries: DataFrame, pivots: Pivots, width: int, start: int, stop: int) -> DataFrame:
    """``(asked, v, floor, p)``: the pivots from place ``start`` to ``stop`` in each query's order that may hold one of its best; ``queries(asked, v, floor)``."""
    shared = queries.sparkSession.sparkContext.broadcast(pivots)

    def work(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            q, floor = _matrix(batch.column("v"), width), batch.column("floor").to_numpy()
            norms = (q.astype(np.float64) ** 2).sum(axis=1)
            at, least = shared.value.order(q)
            reach = np.where(floor > LOW, norms + shared.value.bound - 2.0 * floor, np.inf) + 1e-6 * (1 + norms + shared.value.bound)
            may = np.isfinite(least) & (least**2 <= reach[:, None])
            may[:, :start] = False
            may[:, stop:] = False
            i, j = np.nonzero(may)
            who = pa.array(i)
            yield pa.record_batch([batch.column("asked").take(who), batch.column("v").take(who), batch.column("floor").take(who), pa.array(at[i, j].astype(np.int32))], names=["asked", "v", "floor", "p"])

    return queries.mapInArrow(work, "asked long, v array<long>, floor long, p int")


def top_k(
    rows: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: int = 64,
    block: int = BLOCK, queries: int = QUERIES, pivots: int = PIVOTS, report: dict | None = None,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` rows of highest integer inner product, itself left out.

    Ties go to the smaller id. Queries are the rows where ``is_query`` holds; a
    row that repeats an id and a vector counts once; a shorter vector is filled
    up with zeros; null ids take no part; fewer than ``k`` other rows give all of
    them; an empty table gives no rows; other columns, of any name, are ignored.
    Scores are exact integers; where norms allow one beyond 64 bits, or a
    component is beyond them, an OverflowError tells so.

    There is a pivot for every ``block`` rows, but no more than ``pivots``.
    ``report`` receives how many pivots queries visited, and how many that is at
    most (``visits``, ``possible``).
    """
    points = quantized(rows, id_col, vector_col, scale).dropDuplicates(["id", "q"])
    asked = quantized(rows.where(is_query), id_col, vector_col, scale).dropDuplicates(["id", "q"])
    turn = Window.partitionBy("q").orderBy("id")
    points = points.withColumn("at", F.row_number().over(turn)).where(F.col("at") <= k + 1)
    points = materialize(points.groupBy("q").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("ids")), "points")
    asked = materialize(asked.join(points.select("q", "rep"), "q").select("id", "rep"), "asked")
    norm = F.aggregate("q", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    size = points.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("d"), F.max(norm).alias("norm")).first()
    # No product of two rows is beyond the largest squared norm; rounding of that is far below the margin.
    most = 1.000001 * (size["norm"] or 0.0) + 1
    if most >= 2.0**63:
        raise OverflowError(f"squared norms of up to {size['norm']:.4g} allow scores beyond 64 bits")
    width = size["d"] or 0
    full = F.concat("q", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("q")))
    points_q = points.select("rep", full.alias("q"))
    sought = points_q.join(asked.select(F.col("rep").alias("asked")).distinct(), F.col("rep") == F.col("asked")).select("asked", F.col("q").alias("v"))
    best = _searched(points_q, sought, size["n"], width, size["norm"] or 0.0, most, k, block, queries, pivots, {} if report is None else report)
    listed = best.join(points.select("rep", "ids"), "rep").select("asked", "score", F.explode("ids").alias("vec_id"))
    first = Window.partitionBy("asked").orderBy(F.col("score").desc(), "vec_id")
    listed = listed.withColumn("at", F.row_number().over(first)).where(F.col("at") <= k + 1).select("asked", "score", "vec_id")
    listed = asked.select(F.col("id").alias("query_id"), F.col("rep").alias("asked")).join(listed, "asked").where(F.col("query_id") != F.col("vec_id"))
    first = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return listed.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searched(points: DataFrame, sought: DataFrame, n: int, width: int, bound: float, most: float, k: int, block: int, queries: int, pivots: int, report: dict) -> DataFrame:
    """``(asked, rep, score)``: the k + 1 best rows ``(rep, q)`` of each query ``(asked, v)``, itself among them."""
    import numpy as np

    wanted = min(max(1, -(-n // block)), pivots)
    some = [r["q"] for r in points.orderBy(F.xxhash64("rep"), "rep").limit(wanted).select("q").collect()]
    routing = Pivots(np.array(some, np.int64).reshape(len(some), width), bound)
    if wanted > 1:
        dealt = _dealt(points, routing, width)
    else:
        # One pivot bounds nothing: its radius is that of all rows.
        dealt = points.select("rep", "q", F.lit(0).alias("p"), F.lit(float("inf")).alias("away"))
    held = {r["p"]: r for r in dealt.groupBy("p").agg(F.count("*").alias("n"), F.max("away").alias("away")).collect()}
    for p, r in held.items():
        routing.radius[p] = min(r["away"], 4 * np.sqrt(bound) + 1)

    def table(values: dict, name: str) -> DataFrame:
        """A row for each pivot."""
        return F.broadcast(points.sparkSession.createDataFrame([(int(p), int(x)) for p, x in values.items()] or [(-1, 1)], f"p int, {name} int"))

    blocks = {p: -(-r["n"] // block) for p, r in held.items()}
    dealt = dealt.join(table(blocks, "blocks"), "p").select("p", "rep", "q", F.pmod(F.xxhash64("q"), F.col("blocks")).cast("int").alias("b"))

    def work(left, right):
        import pyarrow as pa

        rep, x = left.column("rep").to_numpy(), _matrix(left.column("q"), width)
        order = np.argsort(rep)
        rep, x = rep[order], x[order]
        who, q, floor = right.column("asked").to_numpy(), _matrix(right.column("v"), width), right.column("floor").to_numpy()
        scores, at = MTree(x, most=most).search(q, min(k + 1, max(1, len(rep))), floor)
        i, j = np.nonzero(at >= 0)
        return pa.table({"asked": who[i], "rep": rep[at[i, j]], "score": scores[i, j]}, pa.schema([("asked", pa.int64()), ("rep", pa.int64()), ("score", pa.int64())]))

    found, start, stop = None, 0, FIRST
    report |= {"visits": 0, "possible": 0}
    top = Window.partitionBy("asked").orderBy(F.col("score").desc(), "rep")
    while start < len(held) or found is None:
        if found is None:
            state = sought.withColumn("floor", F.lit(LOW).cast("long"))
        else:
            # With k + 1 rows found, only scores from the least of them on are of use.
            least = found.groupBy("asked").agg(F.when(F.count("*") > k, F.min("score")).alias("floor"))
            state = sought.join(least, "asked", "left").withColumn("floor", F.coalesce("floor", F.lit(LOW).cast("long")))
        asks = materialize(_asked(state, routing, width, start, stop), "asks")
        counts = {r["p"]: r["n"] for r in asks.groupBy("p").agg(F.count("*").alias("n")).collect()}
        report["visits"] += sum(counts.values())
        if not counts and found is not None:
            break
        turns = table({p: -(-c // queries) for p, c in counts.items()}, "turns")
        # Blocks that no query asks for stay where they are.
        left = dealt.join(turns, "p").select("p", "b", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("t"), "rep", "q")
        right = asks.join(turns, "p").join(table(blocks, "blocks"), "p")
        right = right.select("p", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), F.pmod(F.xxhash64("asked"), F.col("turns")).cast("int").alias("t"), "asked", "v", "floor")
        new = left.groupBy("p", "b", "t").cogroup(right.groupBy("p", "b", "t")).applyInArrow(work, "asked long, rep long, score long")
        both = new if found is None else new.unionByName(found)
        ranked = both.withColumn("at", F.row_number().over(top)).where(F.col("at") <= k + 1).select("asked", "rep", "score")
        if stop >= len(held) and len(held) <= 1:
            report["possible"] = report["visits"]
            return ranked
        found = materialize(ranked, "found")
        start, stop = stop, stop * GROWTH
    report["possible"] = sought.count() * len(held)
    return found
