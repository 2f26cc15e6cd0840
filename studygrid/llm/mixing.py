"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Each document gets the key -ln(u) / w: u is a hash of seed and id in (0, 1), w
its quality weight. A source's target is first met by complete epochs; the rest
takes documents in ascending key order until their prefix sum reaches it. The
prefix sum is distributed: keys are cut into ranges of their logarithm, sums of
ranges are added up first and each range is then summed on its own, so a source
that holds most rows is spread over many tasks. Of an exponential key, at any
weight, a range of 1 / c of the logarithm holds at most 0.37 / c of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Numbered, materialize

#: Rows that a range of keys is to have at most, and ranges for each power of e at least and at most.
ROWS, FEWEST, MOST = 50_000, 64, 65_536


def n_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text, size):
    """Weight of a document: 1 where its words are 2 to 15 characters long on average, else 0.25."""
    mean = F.char_length(text) / F.greatest(size, F.lit(1))
    return F.when((size > 0) & (mean >= 3) & (mean <= 16), F.lit(1.0)).otherwise(F.lit(0.25))


def targets(totals: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``totals(source, source_size)`` -> with ``target``.

    Sources by code point, null last, take the weights in turn. Targets share
    ``share`` times all sizes by weight; a target stops at ``most`` times its
    source's size and the excess goes to the others. That fixed point is the
    level L with sum(min(most * size, L * weight)) = total, found from prefix
    sums in the order in which sources fill up.
    """
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at % len(weights) + 1).cast("int"))
    frame = totals.withColumn("at", at).withColumn("w", turn).withColumn("cap", F.col("source_size") * float(most))
    fill = Window.orderBy(F.col("cap") / F.col("w"), "at")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    frame = (
        frame.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("left", F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level", (F.sum("source_size").over(all_rows) * float(share) - F.col("full")) / F.col("left"))
        .withColumn("turn", F.row_number().over(fill))
    )
    fits = F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("turn"))
    frame = frame.withColumn("first", F.min(fits).over(all_rows))
    frame = frame.withColumn("level", F.max(F.when(F.col("turn") == F.col("first"), F.col("level"))).over(all_rows))
    return frame.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """All columns of ``docs`` and ``__mix``: source, size and sampling key."""
    text = F.col(text_col).cast("string")
    hashed = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary")), 1, 13), 16, 10)
    u = (hashed.cast("double") + 0.5) / float(2**52)
    sized = docs.withColumn("__size", n_words(text))
    key = -F.log(u) / quality(text, F.col("__size"))
    return sized.select(*docs.columns, F.struct(key.alias("key"), F.col(id_col).alias("doc_id"), F.col("__size").alias("size")).alias("__mix"), F.col(source_col).alias("__source"))


def bucket(key, rows: int):
    """The range of a key, ascending with it, in a table of so many rows."""
    each = min(MOST, max(FEWEST, -(-37 * rows // (100 * ROWS))))
    return F.floor(F.log(key) * each).cast("int")


def _decided(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, share: float, most: float, seed: int) -> DataFrame:
    """``(doc_id, source, size, key, source_size, target, epochs, picked)`` of every row."""
    own = Numbered(docs)
    rows = _keyed(own.df, own.of(id_col), own.of(text_col), own.of(source_col), seed).select("__mix.*", F.col("__source").alias("source"))
    rows = materialize(rows, "mix")
    rows = rows.withColumn("bucket", bucket(F.col("key"), rows.count()))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    totals = sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("base"))
    goal = targets(totals, weights, share, most)
    base = base.join(goal, base["s"].eqNullSafe(goal["source"])).select("s", "b", "base", "source_size", "target")
    found = rows.join(base, rows["source"].eqNullSafe(base["s"]) & (rows["bucket"] == base["b"]))
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    start = F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0))
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    picked = (F.col("start") + F.col("size") / 2.0 <= rest) & (rest > 0)
    found = found.withColumn("epochs", epochs).withColumn("start", start).withColumn("picked", picked)
    return found.select("doc_id", "source", "size", "key", "source_size", "target", "epochs", "picked")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 42,
) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)``, one row per input row.

    ``copies`` is how often the mix holds the document: complete epochs, plus one
    if the fractional pass selects it; ``taken`` is copies times size. A document
    is selected if the budget reaches its middle, so a source misses its target
    by half a document at most. A null text has size 0; a null id hashes as
    empty text; equal keys go by id, then size, so reruns agree; rows that are
    repeated count each; an empty table gives no rows. Other columns are ignored.
    """
    found = _decided(docs, id_col, text_col, source_col, weights, share, most, seed).withColumn("copies", F.col("epochs") + F.col("picked").cast("long"))
    return found.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 42,
) -> DataFrame:
    """The mix itself: each row of ``docs``, all columns kept whatever their names, as often as ``mix`` counts copies.

    A source selects a prefix of its keys, so its last selected key decides for
    every row and no text is shuffled; that table has a row for each source and
    is broadcast if it is counted to be small.
    """
    found = _decided(docs, id_col, text_col, source_col, weights, share, most, seed)
    last = F.max(F.when(F.col("picked"), F.struct("key", "doc_id", "size"))).alias("__last")
    ends = materialize(found.groupBy(F.col("source").alias("__s")).agg(F.max("epochs").alias("__epochs"), last), "mix-ends")
    ends = F.broadcast(ends) if ends.count() < 100_000 else ends
    own = Numbered(docs)
    keyed = _keyed(own.df, own.of(id_col), own.of(text_col), own.of(source_col), seed)
    joined = keyed.join(ends, F.col("__source").eqNullSafe(F.col("__s")))
    copies = F.col("__epochs") + F.coalesce(F.col("__mix") <= F.col("__last"), F.lit(False)).cast("long")
    copied = joined.withColumn("__copies", copies).where(F.col("__copies") > 0)
    return copied.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*own.df.columns).toDF(*docs.columns)
