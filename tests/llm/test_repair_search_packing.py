"""Conversation repair, the bit-sliced search and packing against plain versions on tables with every edge case."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from studygrid.llm import impact, packing, queries, turns
from studygrid.llm.common import materialize

TURNS = "conv_id long, turn long, role string, text string, c string, kind string, audit string"


def talks():
    """Nulls anywhere, blanks, copies, odd roles, one turn number for many rows, and a conversation of many segments."""
    rng, rows = random.Random(5), []
    for c in range(60):
        for t in range(rng.randint(1, 7)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""])
            text = rng.choice(["Yes.", "No", "Why?", " \t", "", None, "Long one!", "Yes.", "é.\n", "a:b\nuser:x."])
            rows.append((c, rng.choice([t, t, t + 2, 3, None]), role, text))
    rows += [(100, t, "user" if t % 2 == 0 else "assistant", f"{t} is said." if t % 17 else "cut") for t in range(1100)]
    rows += [(101, 0, "user", "same.")] * 700 + [(101, t, "assistant", "same.") for t in range(300)]
    rows += [(102, 0, "user", "x" * 300_000 + "."), (102, 1, "assistant", "y" * 300_000)]
    rows += [(None, 0, "user", "Hi."), (None, None, None, None), (103, 5, "user", None), (104, 1, "system", "Only.")]
    return rows


def in_order(rows):
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        by[c].append(((t is not None, t or 0), hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).hexdigest(), t, role, text))
    return {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in by.items()}


def brute_audit(rows):
    """The least (cost, audit, lines) by a search over whole prefixes, without segments."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {0: (0, "", ())}
    follow = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    name = {"u": "user", "a": "assistant"}

    def inserted(now):
        for _ in range(2):
            for state, (cost, audit, lines) in list(now.items()):
                role = "a" if state == 2 else "u"
                new = (cost + 3, audit + "I", (*lines, name[role] + ":"))
                if follow[state, role] not in now or new < now[follow[state, role]]:
                    now[follow[state, role]] = new
        return now

    for (_, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for state, (cost, audit, lines) in inserted(dict(best)).items():
            ways = [(state, cost + 4, "D", lines)]
            if fault not in ("blank", "duplicate"):
                more, given = 3 * (fault == "truncated"), "a" if state == 2 else "u"
                ways.append((follow[state, given], cost + 3 + more, "R", (*lines, f"{name[given]}:{text}")))
                if (state, role[:1]) in follow:
                    ways.append((follow[state, role[:1]], cost + more, "K", (*lines, f"{role}:{text}")))
            for to, c, edit, some in ways:
                if to not in after or (c, audit + edit) < after[to][:2]:
                    after[to] = (c, audit + edit, some)
        best = after
    empty = {s: x for s, x in best.items() if s == 0 and not x[2]}
    ends = inserted(dict(best))
    cost, audit, lines = min(x for s, x in [*empty.items(), *((s, x) for s, x in ends.items() if s == 3)])
    turns_ = [t for t, *_ in rows if t is not None]
    gaps = max(turns_) - min(turns_) + 1 - len(set(turns_)) if turns_ else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    count = collections.Counter(faults)
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, lines


@pytest.fixture(scope="module")
def talk(spark):
    return spark.createDataFrame([(*x, "clash", "clash", "clash") for x in talks()], TURNS).repartition(5)


def test_conversation_audits_and_replays_against_brute_force(spark, talk):
    want = {c: brute_audit(rows) for c, rows in in_order(talks()).items()}
    found = materialize(turns.audits(talk), "audits")
    got = {r["conv"]: tuple(r)[1:] for r in found.collect()}
    assert got == {c: x[:7] for c, x in want.items()}
    assert len(want[100][6]) > 5 * turns.SEGMENT and set("".join(x[6] for x in want.values())) == set("DIKR")
    shas = {r["conv"]: r["repaired_sha256"] for r in turns.repaired(talk, found, digest=True).collect()}
    assert shas == {c: hashlib.sha256("\n".join(x[7]).encode()).hexdigest() for c, x in want.items()}
    lines = collections.defaultdict(list)
    for r in sorted(turns.repaired(talk, found).collect(), key=lambda r: r["position"]):
        lines[r["conv"]].append(f"{r['role']}:{r['text']}")
    assert lines == {c: list(x[7]) for c, x in want.items() if x[7]}
    assert turns.audits(talk.limit(0)).count() == 0 and turns.repaired(talk.limit(0), found.limit(0)).count() == 0


def test_repaired_conversations_are_well_formed(talk):
    found = materialize(turns.audits(talk), "audits")
    again = materialize(turns.repaired(talk, found).where("edit <> 'I'"), "again")
    roles = collections.defaultdict(str)
    for r in sorted(turns.repaired(talk, found).collect(), key=lambda r: r["position"]):
        roles[r["conv"]] += r["role"][0]
    assert all(re.fullmatch("s?(ua)+", x) for x in roles.values())
    assert again.where("edit = 'D'").count() == 0


def test_segments_compose_like_the_whole():
    rng = random.Random(9)
    for _ in range(300):
        sig = "".join(rng.choice("suaoSUAOx") for _ in range(rng.randint(0, 12)))
        whole = turns.compose([[turns.solve(sig, s) for s in range(4)]])
        for cut in range(1, len(sig)):
            assert turns.compose([[turns.solve(x, s) for s in range(4)] for x in (sig[:cut], sig[cut:])]) == whole


def test_op11_query_on_a_written_table(spark, tmp_path):
    rng = random.Random(2)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} says {t}.") for c in range(140) for t in range(rng.randint(1, 6) if c < 60 else 1)] + [(None, 1, "user", None), (7, None, None, "null turn.")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"file://{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.QUERIES["op11_conversation_repair"](spark, f"file://{tmp_path}").collect()}
    kept = []
    for c, t, role, text in rows:
        way = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", " " if text is None else text
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        kept += [(c, t, "user" if way == 4 else role, text)] * (way != 0) * (2 if way == 3 else 1)
    want = {c: (*x[:7], hashlib.sha256("\n".join(x[7]).encode()).hexdigest()) for c, x in ((c, brute_audit(v)) for c, v in in_order(kept).items())}
    gone = {c for c, *_ in rows} - set(want)
    assert gone and got == want | {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in gone}


def test_carry_arithmetic_and_descent():
    rng = random.Random(4)
    for _ in range(200):
        n, numbers = rng.randint(1, 90), []
        total, sums = [], [0] * n
        for _ in range(rng.randint(1, 6)):
            numbers = [rng.choice([0, 0, rng.randrange(1 << rng.choice([1, 5, 40]))]) for _ in range(n)]
            sums = [a + b for a, b in zip(sums, numbers, strict=True)]
            impact.add(total, [sum((x >> i & 1) << p for p, x in enumerate(numbers)) for i in range(40)])
        assert [sum((one >> p & 1) << i for i, one in enumerate(total)) for p in range(n)] == sums
        k = rng.randint(1, 12)
        want = sorted((-s, p) for p, s in enumerate(sums) if s)[:k]
        assert impact._places(impact.highest(total, k)) == sorted(p for _, p in want)


TEXTS = "doc_id long, text string, term string, block string, n string"


def brute_search(docs, items, k):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = {c: c + 32 for c in range(65, 91)}
    counted = [(i, collections.Counter(term.findall((t or "").translate(lower)))) for i, t in docs]
    counted = [(i, c, c.total()) for i, c in counted if c]
    n, total, df = len(counted), sum(x for *_, x in counted), collections.Counter(t for _, c, _ in counted for t in c)
    asked, out = collections.defaultdict(set), []
    for i, t in items:
        asked[i] |= set(term.findall((t or "").translate(lower)))
    for item, terms in asked.items():
        scored = []
        for i, c, length in counted:
            m = 50 + 50 * length * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank + 1, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def test_search_against_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    vocabulary = ["Alpha", "beta", "gamma7", "Éa", "éa", "x", "漢字", "don't", "e-mail", "zz"] + [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30)))) for i in range(150)]
    docs += [(900, "alpha " * 5000), (901, None), (902, ""), (903, "--- !\x7f"), (None, "alpha beta"), (5, "beta beta"), (5, "beta beta"), (None, None)] + [(1000 + i, "tie tie") for i in range(30)]
    items = [(i, " ".join(rng.choice([*vocabulary, "unknown"]) for _ in range(rng.randint(1, 8)))) for i in range(20)]
    items += [(50, None), (51, "?!"), (52, "nowhere"), (3, "ALPHA alpha"), (None, "tie"), (53, "tie Tie, x")]
    df = spark.createDataFrame([(*x, "clash", "clash", "clash") for x in docs], TEXTS).repartition(3)
    asked = spark.createDataFrame([(*x, "a", "b") for x in items], "item_id long, text string, lot string, number string")
    for some, lot in ((32_768, 128), (7, 4)):
        monkeypatch.setattr(impact, "DOCS", some)
        found = impact.search(impact.build(df), asked, k=10, lot=lot)
        assert sorted(map(tuple, found.collect()), key=str) == brute_search(docs, items, 10)
    assert impact.search(impact.build(df.limit(0)), asked).count() == 0
    assert impact.search(impact.build(df), asked.limit(0)).count() == 0


def test_bins_take_the_best_fit_and_close_the_fullest():
    bins = packing.Bins(10, 3)
    assert [bins.put(x, n) for x, n in (("a", 6), ("b", 7), ("c", 8))] == [[], [], []]
    assert bins.put("d", 2) == [["c", "d"]]  # the least room that is enough, and full at once
    assert bins.put("e", 3) == [["b", "e"]] and bins.put("f", 9) == [] and bins.put("g", 8) == []
    assert bins.put("h", 5) == [["f"]]  # none has room: the fullest goes
    assert bins.put("whole", 10) == [["g"], ["whole"]] and sorted(bins.rest()) == [["a"], ["h"]]
    with pytest.raises(ValueError):
        bins.put("i", 11)


def check_packed(rows, size):
    at = collections.defaultdict(list)
    for r in rows:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for some in at.values():
        end = 0
        for offset, length in sorted(some):
            assert offset == end
            end += length
        assert 0 < end <= size
    return len(at)


def test_packing_of_texts(spark):
    spec = P.path("byte_bpe_50k.json")
    known = Tokenizer.from_file(spec)
    rng = random.Random(1)
    texts = [(i, " ".join(rng.choice(["word", "Ré", "12", "\n", "longer-one"]) for _ in range(rng.choice([3, 40, 300])))) for i in range(200)]
    texts += [(500, None), (501, ""), (502, "many words " * 3000), (None, "no id"), (7, "again"), (7, "again"), (503, "<|endoftext|> x")]
    df = spark.createDataFrame([(*x, "a", "b", "c") for x in texts], "doc_id long, text string, piece string, key string, ids string").repartition(4)
    found = materialize(packing.pieces(df, spec, P.PATTERN, 2, size=128, ids=True), "pieces")
    packed = materialize(packing.pack(found, 128), "packed")
    rows = packed.collect()
    want = []
    for i, t in texts:
        ids = known.encode(t or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) % 128 or 128, len(ids) + 1, 128)] if len(ids) > 128 else [0, len(ids)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(itertools.pairwise(cuts))]
    assert sorted((tuple(r[x] for x in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in rows), key=str) == sorted(want, key=str)
    n = check_packed(rows, 128)
    assert n <= 1.05 * sum(x[3] for x in want) / 128 + 2
    whole = packing.sequences(found, packed).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["ids_crc32"], r["length"]))
    assert len(whole) == n
    for r in whole:
        ids = bytes(r["ids"])
        assert [(o, zlib.crc32(ids[4 * o : 4 * (o + k)])) for o, _, k in sorted(by[r["sequence_id"]])] == [(o, c) for o, c, _ in sorted(by[r["sequence_id"]])]
    none = materialize(packing.pieces(df.limit(0), spec, P.PATTERN, 2), "none")
    assert packing.pack(none).count() == 0


def test_packing_in_rounds_leaves_little_room(spark):
    """Many tasks and few open bins: what is left open is packed again."""
    rng = random.Random(8)
    rows = [(i, 0, 0, rng.randint(1, 1024) if i % 2 else rng.randint(1, 100), 0, i) for i in range(30_000)]
    found = materialize(spark.createDataFrame(rows, packing.COLUMNS), "pieces")
    lower = sum(r[3] for r in rows) / 1024
    for most, each, bound in ((1024, 250_000, 1.01), (64, 1000, 1.03), (1024, 500, 1.02)):
        got = packing.pack(found, 1024, most, each).collect()
        assert sorted(r["key"] for r in got) == list(range(30_000))
        assert check_packed(got, 1024) <= bound * lower + 1
    again = packing.pack(found, 1024, 64, 1000).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, packing.pack(found.repartition(7), 1024, 64, 1000).collect()))


def test_op13_and_op12_queries_on_written_tables(spark, tmp_path):
    docs = [(i, f"text {i} " + "again and " * (300 * (i % 3)), None, None, None) for i in range(30)] + [(None, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "text again 7"), (2, None)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    packed = queries.QUERIES["op13_best_fit_packing"](spark, f"file://{tmp_path}")
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert check_packed(packed.collect(), 1024) >= 1
    known = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert packed.agg(F.sum("length")).first()[0] == sum(len(known.encode(t or "").ids) + 1 for _, t, *_ in docs)
    found = queries.QUERIES["op12_impact_search"](spark, f"file://{tmp_path}")
    assert sorted(map(tuple, found.collect()), key=str) == brute_search([x[:2] for x in docs], [(1, "text again 7"), (2, None)], 50)
