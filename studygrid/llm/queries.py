"""The registered queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import huffman, imi, impact, langid, linededup, mixing, mtree, packing, ppm, prefix_bpe, simhash, suffixtree, turns
from .common import fit_batches, held, materialize, scratch_path

#: The vocabulary files' folder; STUDYGRID_TOKENIZERS names another.
TOKENIZERS = os.environ.get("STUDYGRID_TOKENIZERS") or os.path.dirname(public_tokenizers.path("x"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    fit_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held("doc_id", 4, 2)
    return langid.predict(docs.select("doc_id", "text", out.alias("held_out")), langid.train(docs.where(~out), "doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


def op2_topk_mtree(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings")
    return mtree.top_k(rows, F.col("vec_id") % 20 == 0, "vec_id", "embedding", k=20, scale=64)


def op3_mix_sources(spark, sf_dir):
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_ppm_score(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    found = ppm.score(docs, ~held("doc_id", 5, 1))
    return found.select("doc_id", held("doc_id", 5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_line_dedup(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs))
    return kept.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op6_bpe_round_trip(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    path = os.path.join(TOKENIZERS, "byte_bpe_multi_50k.tiktoken")
    coded = prefix_bpe.encode_column(docs.select("doc_id", F.col("text")), path, public_tokenizers.PATTERN, what=("n", "sha", "decoded_sha"))
    return coded.select("doc_id", F.col("__n").alias("n_tokens"), F.col("__sha").alias("ids_sha256"), F.col("__decoded_sha").alias("decoded_sha256"))


def op7_embedding_dedup(spark, sf_dir):
    return imi.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_substring_dedup(spark, sf_dir):
    return suffixtree.deduplicate_substrings(_table(spark, sf_dir, "documents"), digest=True)


def op9_token_files(spark, sf_dir):
    docs, path = _table(spark, sf_dir, "documents"), scratch_path(spark, "token-files")
    huffman.write_tokens(docs, path, os.path.join(TOKENIZERS, "byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=2)
    return huffman.read_tokens(spark, path, digest=True)


def op10_simhash(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` with the faults of op11's contract; nulls in any column count as one space."""
    key = F.concat_ws(":", *(F.coalesce(F.col(x).cast("string"), F.lit(" ")) for x in ("conv_id", "turn")))
    way = (F.crc32(key.cast("binary")) % 20).alias("way")
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit(" ")) for x in ("role", "text"))
    frame = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), way).where("way <> 0")
    text = F.when(F.col("way") == 1, F.lit("")).when(F.col("way") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("way") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("way") == 3, 2).otherwise(1)))
    return frame.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op11_conversation_repair(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations")
    faulty = damaged(rows)
    found = materialize(turns.audits(faulty), "audits")
    shas = turns.repaired(faulty, found, digest=True).withColumnRenamed("conv", "c2")
    known = found.join(shas, F.col("conv").eqNullSafe(F.col("c2")))
    every = rows.select("conv_id").distinct().join(known, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    numbers = (F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return every.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_impact_search(spark, sf_dir):
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return impact.search(impact.build(docs), items, k=50)


def op13_best_fit_packing(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    pieces = materialize(packing.pieces(docs, os.path.join(TOKENIZERS, "byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=2), "pieces")
    return packing.pack(pieces, 1024).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


_OWN = (
    op1_language_id, op2_topk_mtree, op3_mix_sources, op4_ppm_score, op5_line_dedup, op6_bpe_round_trip, op7_embedding_dedup,
    op8_substring_dedup, op9_token_files, op10_simhash, op11_conversation_repair, op12_impact_search, op13_best_fit_packing,
)
QUERIES = {f.__name__: f for f in _OWN}

SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL = {
    "op2_topk_mtree": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
              FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op3_mix_sources": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, coalesce(length(text), 0) AS chars,
                   (CAST(('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0 AS u FROM documents),
        k AS (SELECT *, -ln(u) / CASE WHEN size > 0 AND chars / greatest(size, 1) >= 3 AND chars / greatest(size, 1) <= 16 THEN 1.0 ELSE 0.25 END AS key FROM d),
        t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 2.0 * source_size AS cap FROM t),
        fill(step, source, source_size, w, cap, target, capped) AS (
            SELECT 0, source, source_size, w, cap, 1.5 * sum(source_size) OVER () * w / sum(w) OVER (), false FROM w
            UNION ALL
            SELECT step + 1, source, source_size, w, cap,
                   CASE WHEN capped OR target >= cap THEN cap
                        ELSE (1.5 * sum(source_size) OVER () - sum(CASE WHEN capped OR target >= cap THEN cap ELSE 0 END) OVER ()) * w
                             / sum(CASE WHEN capped OR target >= cap THEN 0 ELSE w END) OVER () END,
                   capped OR target >= cap
            FROM fill WHERE step < 60),
        g AS (SELECT source, source_size, CAST(target AS DOUBLE) AS target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM fill WHERE step = 60),
        p AS (SELECT k.*, g.source_size, g.target, g.epochs, g.target - g.epochs * g.source_size AS rest,
                     coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
              FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source)
        SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN rest > 0 AND start + size / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM p""",
    "op5_line_dedup": f"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents WHERE doc_id IS NOT NULL),
        l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
        k AS (SELECT *, translate(trim(line, {SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        h AS (SELECT key, max(doc_id) AS stays FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        f AS (SELECT k.doc_id, k.pos, k.line, h.key IS NOT NULL AND h.stays <> k.doc_id AS lost FROM k LEFT JOIN h ON k.key = h.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256 FROM f GROUP BY doc_id""",
    "op8_substring_dedup": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
        s AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS pos FROM d WHERE len(w) >= 50),
        h AS (SELECT doc_id, pos, md5(array_to_string(w[pos:pos + 49], ' ')) AS h FROM s),
        m AS (SELECT h, min(doc_id) AS least FROM h GROUP BY h HAVING min(doc_id) < max(doc_id)),
        lost AS (SELECT DISTINCT doc_id, pos + i AS pos FROM (SELECT doc_id, pos, unnest(range(0, 50)) AS i FROM h JOIN m USING (h) WHERE doc_id > least)),
        words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
        kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.pos) AS text, count(*) AS n FROM words ANTI JOIN lost ON words.doc_id = lost.doc_id AND words.pos = lost.pos GROUP BY words.doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
        FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id""",
    # Each conversation from its last row back: for each state before a row the least (cost, audit, repaired lines).
    "op11_conversation_repair": r"""
        WITH RECURSIVE k AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
        c AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, length(key) + 1), lambda i: [CAST(ascii(substr(key, i, 1)) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
                    lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) % 20 AS way FROM k),
        d AS (SELECT conv_id, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role,
                     CASE WHEN way = 1 THEN '' WHEN way = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                     unnest(range(CASE WHEN way = 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE way <> 0),
        o AS (SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
                     row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || ':' || text)) AS i FROM d),
        f AS (SELECT *, bare = '' AS blank, bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup,
                     left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
        g AS (SELECT *, NOT blank AND NOT dup AND right(bare, 1) NOT IN ('.', '!', '?') AS cut FROM f),
        n AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate,
                     count(*) FILTER (WHERE cut) AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id),
        r(conv_id, i, e0, e1, e2, e3) AS (
            SELECT conv_id, n + 1, {'c': 0, 'a': '', 'l': ''}, {'c': 6, 'a': 'II', 'l': chr(10) || 'user:' || chr(10) || 'assistant:'}, {'c': 3, 'a': 'I', 'l': chr(10) || 'assistant:'}, {'c': 0, 'a': '', 'l': ''} FROM n
            UNION ALL
            SELECT conv_id, i,
                   list_sort([b0, {'c': b2.c + 3, 'a': 'I' || b2.a, 'l': chr(10) || 'user:' || b2.l}, {'c': b3.c + 6, 'a': 'II' || b3.a, 'l': chr(10) || 'user:' || chr(10) || 'assistant:' || b3.l}])[1],
                   list_sort([b1, {'c': b2.c + 3, 'a': 'I' || b2.a, 'l': chr(10) || 'user:' || b2.l}, {'c': b3.c + 6, 'a': 'II' || b3.a, 'l': chr(10) || 'user:' || chr(10) || 'assistant:' || b3.l}])[1],
                   list_sort([b2, {'c': b3.c + 3, 'a': 'I' || b3.a, 'l': chr(10) || 'assistant:' || b3.l}])[1],
                   list_sort([b3, {'c': b2.c + 3, 'a': 'I' || b2.a, 'l': chr(10) || 'user:' || b2.l}])[1]
            FROM (SELECT g.conv_id, g.i,
                list_sort([{'c': e0.c + 4, 'a': 'D' || e0.a, 'l': e0.l}, {'c': CASE WHEN free AND initial IN ('s', 'u') THEN CASE WHEN initial = 's' THEN e1.c ELSE e2.c END + more ELSE 1000000000 END, 'a': 'K' || CASE WHEN initial = 's' THEN e1.a ELSE e2.a END, 'l': kept || CASE WHEN initial = 's' THEN e1.l ELSE e2.l END},
                           {'c': CASE WHEN free THEN e2.c + more + 3 ELSE 1000000000 END, 'a': 'R' || e2.a, 'l': as_u || e2.l}])[1] AS b0,
                list_sort([{'c': e1.c + 4, 'a': 'D' || e1.a, 'l': e1.l}, {'c': CASE WHEN free AND initial = 'u' THEN e2.c + more ELSE 1000000000 END, 'a': 'K' || e2.a, 'l': kept || e2.l}, {'c': CASE WHEN free THEN e2.c + more + 3 ELSE 1000000000 END, 'a': 'R' || e2.a, 'l': as_u || e2.l}])[1] AS b1,
                list_sort([{'c': e2.c + 4, 'a': 'D' || e2.a, 'l': e2.l}, {'c': CASE WHEN free AND initial = 'a' THEN e3.c + more ELSE 1000000000 END, 'a': 'K' || e3.a, 'l': kept || e3.l}, {'c': CASE WHEN free THEN e3.c + more + 3 ELSE 1000000000 END, 'a': 'R' || e3.a, 'l': as_a || e3.l}])[1] AS b2,
                list_sort([{'c': e3.c + 4, 'a': 'D' || e3.a, 'l': e3.l}, {'c': CASE WHEN free AND initial = 'u' THEN e2.c + more ELSE 1000000000 END, 'a': 'K' || e2.a, 'l': kept || e2.l}, {'c': CASE WHEN free THEN e2.c + more + 3 ELSE 1000000000 END, 'a': 'R' || e2.a, 'l': as_u || e2.l}])[1] AS b3
                FROM r JOIN (SELECT conv_id, i, initial, NOT blank AND NOT dup AS free, CASE WHEN cut THEN 3 ELSE 0 END AS more, chr(10) || role || ':' || text AS kept, chr(10) || 'user:' || text AS as_u, chr(10) || 'assistant:' || text AS as_a FROM g) g
                ON r.conv_id IS NOT DISTINCT FROM g.conv_id AND g.i = r.i - 1)),
        s AS (SELECT r.conv_id, e0 FROM r WHERE i = 1)
        SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               CAST(coalesce(e0.c, 0) AS BIGINT) AS cost, coalesce(e0.a, '') AS audit, sha256(coalesce(substr(e0.l, 2), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON a.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN s ON a.conv_id IS NOT DISTINCT FROM s.conv_id""",
    "op12_impact_search": r"""
        WITH t AS (SELECT doc_id, row_number() OVER () AS row, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
        p AS (SELECT row, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
        d AS (SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY row),
        s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS l FROM d),
        w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        f AS (SELECT item_id, p.row, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // l)))) AS BIGINT) AS score
              FROM q JOIN p USING (term) JOIN w USING (term) JOIN d USING (row), s GROUP BY item_id, p.row),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM f WHERE score > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 50""",
}
