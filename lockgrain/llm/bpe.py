"""Byte-level BPE encoding and decoding in time linear in the text.

Token bytes are mapped to Latin-1 so that one automaton character is one byte.  At a position the automaton gives the
longest token; it is accepted if it may stand after the token before it, else its next shorter prefix is tried, and
when none is left the last token is taken back.  Whether two tokens may be neighbours is decided once a pair, from
the merge trees on both sides of their border, and kept.  The result is exactly what merging by rank gives.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lockgrain.llm.common import arrow_schema, model, prepare, without

#: Entries of a worker's memo of pieces and of its memo of neighbours; a full memo starts anew, results stay the same.
MEMO = 300_000


class Codec:
    """Ranks of a byte-level vocabulary with the pattern that cuts text into pieces, each merged by itself."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.token = {i: t for t, i in ranks.items()}
        self.rank = {t.decode("latin-1"): i for t, i in ranks.items()}
        missing = [b for b in range(256) if chr(b) not in self.rank]
        if missing:
            raise ValueError(f"the vocabulary lacks single bytes: {missing[:5]}")
        self.text = {i: t for t, i in self.rank.items()}
        self.size = {i: len(t) for t, i in self.rank.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, bytes] = {}
        trie = ahocorasick.Automaton()
        for t, i in sorted(self.rank.items(), key=lambda x: x[1]):
            # a token that merging can never build stands only where it is a whole piece
            if len(t) > 1 and not self._derive(t, i):
                continue
            trie.add_word(t, i)
        trie.make_automaton()
        self.longest, self.most = trie.iter_long, max(map(len, self.rank))
        # the longest match at the start of all but the last byte
        self.shorter = {i: next(trie.iter_long(t[:-1]))[1] if len(t) > 1 else None for i, t in self.text.items()}

    def _match(self, s: str, pos: int) -> int:
        """The longest token at ``pos``; the automaton is shown no more than a token's length, as it takes in all it gets."""
        return next(self.longest(s[pos : pos + self.most]))[1]

    def _derive(self, t: str, i: int) -> bool:
        """Find the pair whose merge makes token ``t``; both halves have lower ranks and are no other merge's parts."""
        for k in range(1, len(t)):
            a, b = self.rank.get(t[:k], i), self.rank.get(t[k:], i)
            if a < i and b < i and (len(t[:k]) == 1 or a in self.halves) and (len(t[k:]) == 1 or b in self.halves) and self._neighbours(a, b, i):
                self.halves[i] = (a, b)
                return True
        return False

    def _spine(self, i: int, side: int) -> list[int]:
        out = [i]
        while i in self.halves:
            out.append(i := self.halves[i][side])
        return out

    def _neighbours(self, left: int, right: int, limit: int = 1 << 62) -> bool:
        """True if merging by rank leaves this border alone, as far as ranks below ``limit`` go.

        The tokens that touch the border over time are the right edge of the left tree and the left edge of the right
        one.  Two of them that touch merge if their pair's rank comes before either is merged on its own side; at
        equal ranks the pair further left goes first.
        """
        a, b = self._spine(left, 1)[::-1], self._spine(right, 0)[::-1]
        i = j = 0
        text, rank = self.text, self.rank
        while True:
            m = rank.get(text[a[i]] + text[b[j]], limit)
            up = a[i + 1] if i + 1 < len(a) else limit
            down = b[j + 1] if j + 1 < len(b) else limit
            if m < limit and m < up and m <= down:
                return False
            if i + 1 == len(a) and j + 1 == len(b):
                return True
            if up <= down:
                i += 1
            else:
                j += 1

    def encode_piece(self, piece: bytes) -> list[int]:
        s = piece.decode("latin-1")
        if (whole := self.rank.get(s)) is not None:
            return [whole]
        n, pos, out, dead = len(s), 0, [], set()
        fits, size, shorter = self.fits, self.size, self.shorter
        tok = self._match(s, 0)
        while True:
            end = pos + size[tok]
            ok = end not in dead
            if ok and out:
                pair = (out[-1], tok)
                ok = fits.get(pair)
                if ok is None:
                    if len(fits) >= MEMO:
                        fits.clear()
                    ok = fits[pair] = self._neighbours(*pair)
            if ok:
                out.append(tok)
                pos = end
                if pos == n:
                    return out
                tok = self._match(s, pos)
            elif shorter[tok] is not None:
                tok = shorter[tok]
            else:
                dead.add(pos)
                tok = out.pop()
                pos -= size[tok]

    def _packed(self, piece: str) -> bytes:
        if len(self.memo) >= MEMO:
            self.memo.clear()
        ids = array("i", self.encode_piece(piece.encode("utf-8"))).tobytes()
        if len(piece) <= 64:
            self.memo[piece] = ids
        return ids

    def encode_packed(self, text: str) -> bytes:
        """Ids of a whole text as native 32-bit integers."""
        get, miss = self.memo.get, self._packed
        return b"".join([get(p) or miss(p) for p in self.pattern.findall(text)])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), np.int32).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def load(path: str, pattern: str) -> Codec:
    """The codec of a rank file."""

    def make() -> Codec:
        with Path(path).open("rb") as f:
            return Codec({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)

    return model(("bpe", path, pattern), make)


def encode(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", out: str = "token_ids", keep_text: bool = True) -> DataFrame:
    """Append ``out``, array<int>: the ids of the whole text, without special tokens.

    Null and empty texts give an empty array, an empty table an empty one; time is linear in very long texts.  Rows are
    independent: repeats and ties need no rule.  An input column
    named like ``out`` is replaced.  Extra columns pass through.
    """
    prepare(docs.sparkSession)
    docs = without(docs, out)
    kept = [c for c in docs.columns if keep_text or c != text_col]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])
    at = docs.columns.index(text_col)
    keep = [docs.columns.index(c) for c in kept]
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(vocabulary, pattern)
        for batch in batches:
            parts = [codec.encode_packed(t) if t else b"" for t in batch.column(at).to_pylist()]
            ends = np.zeros(len(parts) + 1, np.int32)
            np.cumsum([len(p) // 4 for p in parts], out=ends[1:])
            ids = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(parts))])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [lists.cast(target.field(out).type)], schema=target)

    return docs.mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: str, pattern: str, ids_col: str = "token_ids", out: str = "decoded", keep_ids: bool = True) -> DataFrame:
    """Append ``out``, binary: the bytes of the ids.  Null or empty arrays give empty bytes; an unknown id raises KeyError."""
    prepare(df.sparkSession)
    df = without(df, out)
    kept = [c for c in df.columns if keep_ids or c != ids_col]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(out, T.BinaryType(), False)])
    at = df.columns.index(ids_col)
    keep = [df.columns.index(c) for c in kept]
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(vocabulary, pattern)
        for batch in batches:
            col = batch.column(at)
            ends, flat = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)
            valid = col.is_valid().to_numpy(zero_copy_only=False)
            data = [codec.decode(flat[ends[k] : ends[k + 1]].tolist()) if valid[k] else b"" for k in range(len(col))]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [pa.array(data, target.field(out).type)], schema=target)

    return df.mapInArrow(run, schema)
