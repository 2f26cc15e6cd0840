"""Language identification by string kernels.

Texts are compared by a blended-spectrum presence kernel: the number of distinct
character n-grams, n = 1, 2, 3, that two lower-cased texts share, divided by the
geometric mean of their own numbers. A Nystroem map over landmark texts makes it
a feature vector, and one-versus-rest kernel ridge regression is fitted on all
labelled texts: tasks add up each language's products of features, which are as
many as the landmarks squared, and one task a language solves for its weights.
As kernel rows are products of presence vectors, landmarks, map and weights fold
into one matrix (n-grams of the landmarks x languages), and a batch of texts is
scored by one product of its presence matrix with that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Numbered, materialize, release

#: The basis of the map, not what is learned from: landmarks of all languages together, and characters of one.
LANDMARKS = 320
LANDMARK_CHARS = 20_000
RIDGE = 1e-2


def grams(text: str):
    """Sorted distinct keys of the text's 1-, 2- and 3-grams; a key holds each character plus one in 21 bits."""
    import numpy as np

    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4").astype(np.uint64) + np.uint64(1)
    out, key = [], code
    for n in range(3):
        if n:
            key = (key[:-1] << np.uint64(21)) | code[n:]
        if len(key):
            s = np.sort(key)
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
    return np.concatenate(out) if out else code


@dataclass
class Model:
    languages: list[str]
    vocabulary: object  # sorted keys of the landmarks' n-grams
    weights: object  # (len(vocabulary) + 1, languages); the last row is for all other n-grams

    def score(self, texts: list[str]):
        """Raw one-versus-rest scores, a row for each text; about 1 for a language's own text, -1 for others."""
        import numpy as np

        present = np.zeros((len(texts), len(self.weights)), np.float32)
        norm = np.ones(len(texts))
        for i, text in enumerate(texts):
            found = grams(text)
            at = np.searchsorted(self.vocabulary, found)
            at[at == len(self.vocabulary)] = 0
            present[i, at[self.vocabulary[at] == found]] = 1
            norm[i] = max(1, len(found)) ** 0.5
        return (present @ self.weights) / norm[:, None]


class Basis:
    """The Nystroem map of landmark texts: which of them hold each n-gram, and the root that makes their kernel the identity."""

    def __init__(self, texts: list[str]):
        import numpy as np

        rows = [grams(x) for x in texts]
        flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        order = np.argsort(flat, kind="stable")
        self.vocabulary, first = np.unique(flat[order], return_index=True)
        self.starts, self.owners = np.r_[first, len(flat)], owner[order]
        self.scale = np.array([max(1, len(r)) ** -0.5 for r in rows])
        values, vectors = np.linalg.eigh(self.kernel(rows) + 1e-6 * np.eye(len(rows)))
        self.root = (vectors / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T

    def kernel(self, rows: list):
        """Similarities of texts, given by their n-grams, with the landmarks."""
        import numpy as np

        out = np.zeros((len(rows), len(self.scale)))
        for i, found in enumerate(rows):
            at = np.searchsorted(self.vocabulary, found)
            at[at == len(self.vocabulary)] = 0
            at = at[self.vocabulary[at] == found]
            size = self.starts[at + 1] - self.starts[at]
            places = np.repeat(self.starts[at + 1] - np.cumsum(size), size) + np.arange(size.sum())
            out[i] = np.bincount(self.owners[places], minlength=len(self.scale)) * self.scale * max(1, len(found)) ** -0.5
        return out

    def features(self, texts: list[str]):
        return self.kernel([grams(x) for x in texts]) @ self.root

    def model(self, languages: list[str], solved) -> Model:
        """Landmarks, map and ``solved`` (landmarks x languages) folded into one matrix."""
        import numpy as np

        by_landmark = (self.root @ solved) * self.scale[:, None]
        folded = np.zeros((len(self.vocabulary) + 1, len(languages)), np.float32)
        for j in range(len(languages)):
            folded[:-1, j] = np.add.reduceat(by_landmark[self.owners, j], self.starts[:-1])
        return Model(languages, self.vocabulary, folded)


def moments(features):
    """The products of features, one row for each landmark, and below them their sums."""
    import numpy as np

    return np.vstack([features.T @ features, features.sum(axis=0)])


def solve(own, all_, n: int, total: int, ridge: float):
    """Weights of one language against the rest, each side with half of the weight, from ``moments`` of its own and of all rows."""
    import numpy as np

    yes, no = 0.5 * total / n, 0.5 / max(1 - n / total, 1e-9)
    weighted = yes * own[:-1] + no * (all_ - own)[:-1]
    return np.linalg.solve(weighted + ridge * total * np.eye(own.shape[1]), yes * own[-1] - no * (all_ - own)[-1])


def dealt(labels: list[str], landmarks: int) -> list[int]:
    """Places of at most so many rows, dealt evenly over the labels."""
    queues: dict[str, list[int]] = {k: [] for k in sorted(set(labels))}
    for i, x in enumerate(labels):
        queues[x].append(i)
    turns = sorted((turn, k, i) for k, queue in queues.items() for turn, i in enumerate(queue))
    return [i for _, _, i in turns[:landmarks]]


def fit(texts: list[str], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """The same model of texts at hand; None without texts."""
    import numpy as np

    if not texts:
        return None
    names = sorted(set(labels))
    basis = Basis([texts[i] for i in dealt(labels, landmarks)])
    features = basis.features(texts)
    own = [moments(features[np.array(labels) == k]) for k in names]
    return basis.model(names, np.stack([solve(x, sum(own), labels.count(k), len(texts), ridge) for k, x in zip(names, own, strict=True)], axis=1))


def _landmarks(frame: DataFrame, counts: list[tuple[str, int]], landmarks: int) -> list[str]:
    """Texts drawn by the least ``draw`` of ``frame(lang, draw, text)``, dealt evenly over the languages; of more languages than landmarks the largest have one."""
    some = sorted(sorted(counts, key=lambda x: (-x[1], x[0]))[:landmarks])
    # Of each language, a threshold on the draw leaves more than so many to rank.
    limits = frame.sparkSession.createDataFrame([(x, min(1.0, (2 * landmarks + 64) / n)) for x, n in some], "lang string, below double")
    turn = Window.partitionBy("lang").orderBy("draw", "th")
    drawn = frame.select("lang", "draw", F.xxhash64("text").alias("th")).join(F.broadcast(limits), "lang")
    drawn = drawn.where((F.col("draw") / float(2**64) + 0.5) <= F.col("below")).withColumn("at", F.row_number().over(turn)).where(F.col("at") <= landmarks)
    names = drawn.select("lang", "draw", "th").distinct().collect()
    names.sort(key=lambda r: (r["lang"], r["draw"], r["th"]))
    chosen = frame.sparkSession.createDataFrame([tuple(names[i]) for i in dealt([r["lang"] for r in names], landmarks)], "lang string, draw long, th long")
    rows = frame.withColumn("th", F.xxhash64("text")).join(F.broadcast(chosen), ["lang", "draw", "th"])
    rows = rows.groupBy("lang", "draw", "th").agg(F.min(F.left("text", F.lit(LANDMARK_CHARS))).alias("text")).collect()
    return [r["text"] for r in sorted(rows, key=lambda r: (r["lang"], r["draw"], r["th"]))]


SUMS = "lang string, at int, part int, x array<double>"


def _sums(frame: DataFrame, basis: Basis) -> DataFrame:
    """``moments`` of each language of ``frame(lang, text)``, a row for each landmark and one for their sums: ``SUMS``."""
    shared = frame.sparkSession.sparkContext.broadcast(basis)

    def rows(lang: str, at, part: int, x):
        import pyarrow as pa

        values = pa.ListArray.from_arrays(pa.array(range(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel(), pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(x), pa.string()), pa.array(at, pa.int32()), pa.array([part] * len(x), pa.int32()), values], ["lang", "at", "part", "x"])

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        from pyspark import TaskContext

        release()
        own, out = shared.value, {}
        for batch in batches:
            langs, texts = (batch.column(c).to_pylist() for c in ("lang", "text"))
            for k in range(0, len(texts), 64):
                features, now = own.features(texts[k : k + 64]), np.array(langs[k : k + 64])
                for x in set(langs[k : k + 64]):
                    more = moments(features[now == x])
                    out[x] = out[x] + more if x in out else more
        for x, total in out.items():
            yield rows(x, range(len(total)), TaskContext.get().partitionId(), total)

    def add(batches: Iterator) -> Iterator:
        import numpy as np

        key, total = None, None
        for batch in batches:
            values = batch.column("x")
            flat, ends = values.values.to_numpy(), values.offsets.to_numpy()
            for i, now in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lang", "at")), strict=True)):
                x = flat[ends[i] : ends[i + 1]]
                if now == key:
                    total += x
                    continue
                if key is not None:
                    yield rows(key[0], [key[1]], 0, total[None])
                key, total = now, np.array(x)
        if key is not None:
            yield rows(key[0], [key[1]], 0, total[None])

    # Parts are added in their order, so that reruns agree.
    return frame.select("lang", "text").mapInArrow(count, SUMS).repartition("lang", "at").sortWithinPartitions("lang", "at", "part").mapInArrow(add, SUMS)


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, landmarks: int = LANDMARKS, ridge: float = RIDGE, seed: int = 42) -> Model | None:
    """Fit on all texts that have a label and a letter, whole and whatever their number.

    Landmarks, the basis of the map, are drawn by a hash of the rows' ids.
    """
    import numpy as np

    own = Numbered(docs)
    lang, text = F.col(own.of(lang_col)), F.col(own.of(text_col))
    frame = own.df.where(lang.isNotNull() & text.rlike(r"\p{L}"))
    frame = frame.select(lang.cast("string").alias("lang"), F.xxhash64(F.lit(seed), F.col(own.of(id_col))).alias("draw"), text.alias("text"))
    counts = dict(sorted((r["lang"], r["count"]) for r in frame.groupBy("lang").count().collect()))
    if not counts:
        return None
    basis = Basis(_landmarks(frame, list(counts.items()), landmarks))
    sums, total, m = materialize(_sums(frame, basis), "language-sums"), sum(counts.values()), len(basis.scale)
    every = np.zeros((m + 1, m))
    for r in sums.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("lang", "x"))).alias("all")).select("at", F.aggregate("all", F.array_repeat(F.lit(0.0), m), lambda s, r: F.zip_with(s, r["x"], lambda a, b: a + b)).alias("x")).collect():
        every[r["at"]] = r["x"]
    shared = frame.sparkSession.sparkContext.broadcast((every, counts))

    def solved(key, pdf):
        import pandas as pd

        all_, n = shared.value
        x = np.stack(pdf.sort_values("at")["x"].to_list())
        return pd.DataFrame({"lang": [key[0]], "w": [solve(x, all_, n[key[0]], total, ridge)]})

    weights = {r["lang"]: r["w"] for r in sums.groupBy("lang").applyInPandas(solved, "lang string, w array<double>").collect()}
    return basis.model(list(counts), np.array([weights[k] for k in counts]).T)


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``lang_pred``, ``score``.

    A text that is null or has no letter gets ``und`` and 0, as does every text
    of an untrained model. ``score`` is the best raw score moved from (-1, 1) to
    (0, 1) and clipped. Ties go to the first language by code point. Very long
    texts are scored whole, repeated rows alike; an empty table gives no rows.
    Other columns may have any name; those called ``lang_pred`` or ``score`` are
    replaced.
    """
    shared, numbered, new = docs.sparkSession.sparkContext.broadcast(model), Numbered(docs), ("lang_pred", "score")
    fields = [*numbered.fields(new), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import regex

        release()
        own, letter = shared.value, regex.compile(r"\p{L}").search
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            read = [i for i, x in enumerate(texts) if x and letter(x)] if own else []
            for k in range(0, len(read), 64):
                some = read[k : k + 64]
                raw = own.score([texts[i] for i in some])
                best = raw.argmax(axis=1)
                for i, j, row in zip(some, best, raw, strict=True):
                    lang[i], score[i] = own.languages[j], min(1.0, max(0.0, (float(row[j]) + 1) / 2))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score)], [f.name for f in fields])

    kept = numbered.df.select(*(f"c{i}" for i in numbered.kept(new)), F.col(numbered.of(text_col)).cast("string").alias("text"))
    return kept.mapInArrow(work, T.StructType(fields))


def identify(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on the rows where ``learn`` holds and predict all rows; the label, id and source never enter a prediction."""
    return predict(docs, train(docs.where(learn), id_col, text_col, lang_col), text_col)
