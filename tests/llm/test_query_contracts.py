"""The registered queries on a written fixture: folds, divisors, end ids and the shared folder's rule."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from studygrid.llm import common, mtree, ppm
from studygrid.llm.queries import QUERIES, TOKENIZERS


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    path = str(tmp_path_factory.mktemp("tables"))
    kinds = {"en": ["the", "house", "with", "walls"], "de": ["das", "haus", "mit", "mauern"], "fr": ["une", "maison", "avec", "murs"]}
    docs = [(i, " ".join(rng.choice(kinds[lang], 12)) + ("\n" if i % 7 == 0 else ""), lang, f"s{i % 2}") for i, lang in ((i, list(kinds)[i % 3]) for i in range(90))]
    docs += [(200, None, "en", "s0"), (201, "", "fr", "s1"), (202, "12 !?", None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    vectors = [(i, rng.normal(size=6).tolist(), i % 3) for i in range(100)] + [(300, None, 1), (320, [float("nan")] * 6, 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path, docs, vectors


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_op1_holds_out_its_fold(spark, folder):
    path, docs, _ = folder
    got = {r["doc_id"]: r for r in QUERIES["op1_language_id"](spark, path).collect()}
    assert len(got) == len(docs) and all(got[d[0]]["held_out"] == (remainder(d[0], 4) == 2) for d in docs)
    assert {got[i]["lang_pred"] for i in (200, 201, 202)} == {"und"}
    right = [got[d[0]]["lang_pred"] == d[2] for d in docs[:90] if got[d[0]]["held_out"]]
    assert right and all(right) and all(0 <= r["score"] <= 1 for r in got.values())


def test_op2_asks_for_every_twentieth(spark, folder):
    path, _, vectors = folder
    got = sorted(map(tuple, QUERIES["op2_topk_mtree"](spark, path).select("query_id", "rank", "vec_id", "score").collect()))
    q = {i: np.floor(64 * np.asarray(np.asarray(v, np.float32), np.float64)).astype(int) for i, v, _ in vectors[:100]}
    want = []
    for i in range(0, 100, 20):
        best = sorted((-int(q[i] @ q[j]), j) for j in q if j != i)[:20]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert got == want


def test_op4_learns_from_all_but_its_fold(spark, folder):
    path, docs, _ = folder
    got = {r["doc_id"]: r for r in QUERIES["op4_ppm_score"](spark, path).collect()}
    counts: dict = {}
    tokens = lambda t: [*(t or "").lower().split(), None]
    for i, text, *_ in docs:
        if remainder(i, 5) != 1:
            for t in tokens(text):
                counts[t] = counts.get(t, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, text, *_ in docs:
        own = tokens(text)
        assert got[i]["held_out"] == (remainder(i, 5) == 1) and got[i]["train_tokens"] == n
        assert (got[i]["n_tokens"], got[i]["n_known"]) == (len(own), sum(t in counts for t in own))
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((counts.get(t, 0) + 0.5) / (n + 0.5 * (v + 1))) for t in own), abs=1e-9)
        assert got[i]["score"] < 0


def test_op9_ends_documents_with_id_2(spark, folder):
    path, docs, _ = folder
    coder, start = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json"), 0
    for r, (i, text, *_) in zip(QUERIES["op9_token_files"](spark, path).orderBy("doc_id").collect(), docs, strict=True):
        ids = np.array([*coder.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_least_count_is_exact_beyond_any_bound(spark):
    numbers = [1] * 50 + [2] * 9 + [700, 5000, 9999, 10_000, 10_000, 20_001, 20_002, (1 << 20) - 1, 1 << 20, (1 << 40) + 3, (1 << 40) + 4, (1 << 53) - 1]
    counts = spark.createDataFrame([(x,) for x in numbers], "n long").cache()
    for most in (0, 1, 2, 3, 5, 7, 8, 9, 11, 12, 20, 21, 70, 71, 100):
        least = ppm._least_count(counts, most, steps=16)
        held = sum(x >= least for x in numbers)
        assert held <= most, (most, least)
        below = [x for x in numbers if x < least]
        assert not below or held + below.count(max(below)) > most, (most, least)
    assert ppm._least_count(counts.limit(0), 0) == 1


def test_a_folder_of_one_machine_is_refused_on_a_cluster():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: None if key == "spark.checkpoint.dir" else "file:/here/spark-warehouse")

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)
    Session.sparkContext.master = "local[4]"
    assert common.shared_dir(Session) == "file:/here/spark-warehouse/studygrid-scratch"


@pytest.mark.parametrize("kind", ["clustered", "unstructured"])
def test_mtree_visits_the_pivots_that_matter(spark, kind):
    rng = np.random.default_rng(8)
    if kind == "clustered":
        x = (rng.normal(size=(30, 1, 8)) + 0.02 * rng.normal(size=(30, 40, 8))).reshape(-1, 8)
    else:
        x = rng.normal(size=(1200, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    report: dict = {}
    got = sorted(map(tuple, mtree.top_k(df, F.col("vec_id") % 60 == 0, k=5, block=20, queries=7, report=report).collect()))
    q = np.floor(64 * x).astype(int)
    want = []
    for i in range(0, 1200, 60):
        s = q @ q[i]
        want += [(i, n + 1, j, int(s[j])) for n, j in enumerate(sorted((j for j in range(1200) if j != i), key=lambda j: (-s[j], j))[:5])]
    assert got == want
    share = report["visits"] / report["possible"]
    print(kind, report, share)
    assert report["possible"] == 20 * 60 or kind == "clustered"
    assert share < (0.4 if kind == "clustered" else 1.01)
