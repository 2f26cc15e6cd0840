"""Byte-level BPE by dynamic programming over byte prefixes.

Every prefix of a piece has one BPE encoding, and dropping its last token leaves
the encoding of a shorter prefix. So one number for each prefix, its last token,
holds the encodings of all of them: token t is the last one of prefix p if t ends
p and the pair (last token of what remains, t) is itself stable under the merges.
Appending bytes goes on from the table; after an edit the table is kept up to the
edit and taken up again once it has met the old one for as long as a token can be.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Numbered, cached

#: Pieces that a worker remembers (the latest, up to twice as many), and pairs of tokens, which start anew when full.
MEMORY, PAIRS = 200_000, 250_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


class PrefixEncoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.words = ranks, {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks))
        # The longest token that ends with these three bytes; other endings have shorter tokens only.
        self.reach: dict[bytes, int] = {}
        for x in ranks:
            if len(x) > self.reach.get(x[-3:], 2):
                self.reach[x[-3:]] = len(x)
        self.stable: dict[tuple[int, int], bool] = {}

    def _merged(self, text: bytes) -> list[int]:
        """Plain merging, lowest rank first, of a few bytes."""
        ranks, parts = self.ranks, [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1))
            if rank == 1 << 62:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[x] for x in parts]

    def _fits(self, before: int, token: int) -> bool:
        key = (before, token)
        if (known := self.stable.get(key)) is None:
            if len(self.stable) >= PAIRS:
                self.stable.clear()
            text = self.words[token] if before < 0 else self.words[before] + self.words[token]
            known = self.stable[key] = self._merged(text) == ([token] if before < 0 else [before, token])
        return known

    def extend(self, text: bytes, last: list[int], upto: int | None = None) -> list[int]:
        """Continue ``last``, the last tokens of prefixes of 1, 2, ... bytes of ``text``."""
        ranks, stable, reach = self.ranks.get, self.stable.get, self.reach.get
        for end in range(len(last) + 1, (len(text) if upto is None else upto) + 1):
            for begin in range(max(0, end - reach(text[end - 3 : end], 2)) if end > 3 else 0, end):
                token = ranks(text[begin:end])
                if token is not None:
                    before = last[begin - 1] if begin else -1
                    known = stable((before, token))
                    if known or known is None and self._fits(before, token):
                        last.append(token)
                        break
            else:
                raise ValueError(f"no token ends at byte {end}; a single byte has no rank")
        return last

    def edited(self, old: bytes, last: list[int], new: bytes) -> list[int]:
        """The table of ``new``, from that of ``old``, working only near where they differ."""
        same = 0
        while same < min(len(old), len(new)) and old[same] == new[same]:
            same += 1
        tail = 0
        while tail < min(len(old), len(new)) - same and old[-1 - tail] == new[-1 - tail]:
            tail += 1
        table, shift, met = list(last[:same]), len(old) - len(new), 0
        for end in range(same + 1, len(new) + 1):
            self.extend(new, table, end)
            met = met + 1 if end > len(new) - tail and table[-1] == last[end + shift - 1] else 0
            if met >= self.longest:
                # All last tokens in reach are equal, so those after them are too.
                return table + last[end + shift :]
        return table

    def tokens(self, table: list[int], length: int | None = None) -> list[int]:
        """The encoding of the prefix of ``length`` bytes."""
        end, out = len(table) if length is None else length, []
        while end:
            out.append(token := table[end - 1])
            end -= len(self.words[token])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        return self.tokens(self.extend(piece, []))

    def encode_all(self, pieces: list[bytes]) -> list[list[int]]:
        """The encodings of ``pieces``; in sorted order each goes on from the table of the prefix it shares with the one before."""
        out: list = [None] * len(pieces)
        before, table = b"", []
        for i in sorted(range(len(pieces)), key=pieces.__getitem__):
            piece = pieces[i]
            if (whole := self.ranks.get(piece)) is not None:
                out[i] = [whole]
                continue
            same = 0
            for x, y in zip(before, piece, strict=False):
                if x != y:
                    break
                same += 1
            del table[same:]
            out[i] = self.tokens(self.extend(piece, table))
            before = piece
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.words.__getitem__, ids))


class TextEncoder:
    """Encodes whole texts piece by piece, remembering the pieces with their ids in the ``forms`` asked for."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, forms: tuple[str, ...], room: int | None = None):
        from array import array

        from .pieces import Remembered, splitter

        self.encoder = own = PrefixEncoder(ranks)
        names = {v: str(v) for v in ranks.values()}
        # ids: 32-bit integers; names: decimal ids joined by commas; bytes: what they decode to.
        made = {"ids": lambda x: array("i", x).tobytes(), "names": lambda x: ",".join(map(names.__getitem__, x)), "bytes": own.decode}
        forms = [made[x] for x in forms]

        def learn(new: list[str]) -> list[tuple]:
            ids = own.encode_all([x.encode() for x in new])
            return list(zip(*(map(f, ids) for f in forms), strict=True))

        self.remembered = Remembered(splitter(pattern), learn, room or MEMORY)

    def encode(self, texts: list[str]) -> Iterator[tuple]:
        """For each text, for each of ``forms``, that of its pieces in order; no columns at all for an empty text."""
        return (tuple(zip(*x, strict=True)) for x in self.remembered.entries(texts))


def encode_column(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", what: tuple[str, ...] = ("ids",), room: int | None = None) -> DataFrame:
    """All columns of ``docs`` and those of ``what``, named ``__<name>``.

    ``ids``: array<int>, the encoding of the whole text; ``n``: its length;
    ``sha``: sha256 of the decimal ids joined by commas; ``decoded``: the bytes
    that the ids decode to; ``decoded_sha``: their sha256; ``text``: the decoded
    text, null where the text is null. A null text encodes like an empty one, to
    no ids. Texts of any length are encoded whole, a few million characters at a
    time; repeated rows stay, each encoded alike; an empty table gives none.
    Other columns, of any name and type, are passed on; one that has the name of
    a new column is replaced by it. The vocabulary, a file of fixed size, is
    broadcast; a worker remembers ``room`` to twice as many pieces (``MEMORY`` if
    None), of about 300 bytes each.
    """
    kinds = {"ids": T.ArrayType(T.IntegerType()), "n": T.LongType(), "sha": T.StringType(), "decoded": T.BinaryType(), "decoded_sha": T.StringType(), "text": T.StringType()}
    with open(ranks_path, "rb") as f:
        tag = zlib.crc32(f.read())
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    asked = set(what)
    needed = {"ids": {"ids", "n"}, "names": {"sha"}, "bytes": {"decoded", "decoded_sha", "text"}}
    forms = tuple(x for x, of in needed.items() if asked & of)
    if "n" in asked and "ids" not in asked and "sha" in asked:
        forms = tuple(x for x in forms if x != "ids")  # the commas tell the number

    def work(batches: Iterator) -> Iterator:
        from hashlib import sha256

        import numpy as np
        import pyarrow as pa

        from .pieces import in_lots, no_cycles

        types = {"n": pa.int64(), "sha": pa.string(), "decoded": pa.binary(), "decoded_sha": pa.string(), "text": pa.string()}
        encoder = cached(("bpe", tag, pattern, forms, room), lambda: TextEncoder(shared.value, pattern, forms, room))
        place = {x: i for i, x in enumerate(forms)}
        for batch in batches:
            at = 0
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for lot in in_lots([x or "" for x in texts]):
                some = batch.slice(at, len(lot))
                out: dict[str, list] = {k: [] for k in what}
                with no_cycles():
                    coded = list(encoder.encode(lot))
                for text, found in zip(texts[at : at + len(lot)], coded, strict=True):
                    ids = b"".join(found[place["ids"]]) if found and "ids" in place else b""
                    if "n" in asked:
                        n = len(ids) // 4
                    if "sha" in asked:
                        joined = ",".join(found[place["names"]]) if found else ""
                        n = joined.count(",") + 1 if joined else 0
                        out["sha"].append(sha256(joined.encode()).hexdigest())
                    if "n" in asked:
                        out["n"].append(n)
                    if "ids" in asked:
                        out["ids"].append(ids)
                    if "bytes" in place:
                        decoded = b"".join(found[place["bytes"]]) if found else b""
                        if "decoded" in asked:
                            out["decoded"].append(decoded)
                        if "decoded_sha" in asked:
                            out["decoded_sha"].append(sha256(decoded).hexdigest())
                        if "text" in asked:
                            out["text"].append(None if text is None else decoded.decode())
                made = []
                for k in what:
                    if k == "ids":
                        ends = np.cumsum([0, *(len(x) // 4 for x in out["ids"])])
                        made.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(out["ids"]), np.int32))))
                    else:
                        made.append(pa.array(out[k], types[k]))
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], *made], [f.name for f in fields])
                at += len(lot)

    own = Numbered(docs)
    new = [f"__{k}" for k in what]
    fields = [*own.fields(new), *(T.StructField(f"__{k}", kinds[k]) for k in what)]
    return own.df.select(*(f"c{i}" for i in own.kept(new)), F.col(own.of(text_col)).cast("string").alias("text")).mapInArrow(work, T.StructType(fields))
