"""Packing of documents into fixed-length training sequences by cutting-stock column generation.

A document is cut into full pieces, a body that is a multiple of ``GRID`` tokens and a tail shorter than that, so that
few different lengths occur.  Their histogram is covered with the fewest sequences by a linear program over packing
patterns, where the dual prices of the lengths go into a knapsack dynamic program that proposes the next pattern.  The
program's size depends on the number of different lengths alone, not on the documents.  Pattern counts are rounded down, the few pieces left are packed best-fit, and the
patterns' places are dealt to the pieces by their rank among those of the same length.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lockgrain.llm.common import arrow_schema, model, prepare, without

#: What is left of a document after its full pieces is cut once more, at its last multiple of this.
GRID = 32
#: Groups in which pieces of one length are ranked apart, so that no length is ranked by one task.
RANK_GROUPS = 1024


class Tokenizer:
    """Ids of a byte-level BPE vocabulary.

    ``json_path`` is the file of the ``tokenizers`` library.  Its twin ``rank_path`` holds the same vocabulary as ranks;
    texts of Latin letters and ASCII without an added token go through the faster library of rank files, all others
    through the former.
    """

    def __init__(self, json_path: str, rank_path: str | None, pattern: str | None):
        from tokenizers import Tokenizer as Library

        self.full = Library.from_file(json_path)
        #: Their literals are tokens of their own, which the rank twin does not know.
        self.added = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.fast = self.plain = None
        if rank_path:
            import base64
            import re

            import tiktoken

            with Path(rank_path).open("rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            # letters, digits, signs and spaces on whose classes all Unicode versions and regex libraries agree
            self.plain = re.compile("[\t\n\r\x20-\x7e¡-§©«®°±¶·»¿-ſ‐-―‘-‟…]*").fullmatch

    def encode(self, text: str) -> list[int]:
        if self.fast and self.plain(text) and not any(t in text for t in self.added):
            return self.fast(text)
        return self.full.encode(text, add_special_tokens=False).ids


def tokenizer(*key: str | None) -> Tokenizer:
    return model(("packing", *key), lambda: Tokenizer(*key))


def pieces(docs: DataFrame, json_path: str, rank_path: str | None = None, pattern: str | None = None, length: int = 1024, end_id: int = 0, grid: int = GRID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: id, start, length, doc_tokens and ``ids`` (binary: unsigned little-endian 32-bit ids).

    A document's ids end with ``end_id``.  It is cut every ``length`` ids, and the rest at its last
    multiple of ``grid``.  Null and empty texts have the end id alone.
    Rows with equal ids are documents of their own; a null id stays null.
    """
    prepare(docs.sparkSession)
    schema = T.StructType([docs.select(F.col(id_col).alias("doc_id")).schema[0], *[T.StructField(c, T.LongType(), False) for c in ("start", "length", "doc_tokens")], T.StructField("ids", T.BinaryType(), False)])
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(json_path, rank_path, pattern)
        for batch in batches:
            owner, start, size, total, data = [], [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                ids = tok.encode(text) if text else []
                ids.append(end_id)
                raw, n = array("I", ids).tobytes(), len(ids)
                cuts = [*range(0, n, length), n]
                if (tail := n - n % length % grid) not in (cuts[-2], n):
                    cuts.insert(-1, tail)
                for at, to in pairwise(cuts):
                    owner.append(k)
                    start.append(at)
                    size.append(to - at)
                    total.append(n)
                    data.append(raw[4 * at : 4 * to])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int32())), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(total, pa.int64()), pa.array(data, target.field("ids").type)], schema=target)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def price(sizes: np.ndarray, duals: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: an unbounded knapsack over ``sizes`` (ascending) of the given values."""
    best, take = np.zeros(room + 1), np.full(room + 1, -1)
    upto = np.searchsorted(sizes, np.arange(room + 1), "right")
    for w in range(1, room + 1):
        best[w] = best[w - 1]
        if n := upto[w]:
            gains = duals[:n] + best[w - sizes[:n]]
            k = gains.argmax()
            if gains[k] > best[w] + 1e-12:
                best[w], take[w] = gains[k], k
    pattern, w = np.zeros(len(sizes), int), room
    while w > 0:
        if take[w] >= 0:
            pattern[take[w]] += 1
            w -= sizes[take[w]]
        else:
            w -= 1
    return float(best[room]), pattern


def solve(demand: np.ndarray, rounds: int = 4000, tolerance: float = 2e-4) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used, exactly covering ``demand`` (index: length; its last index: the room).

    Revised simplex over generated columns.  It ends when no pattern has reduced cost, or when the bound from the
    best price shows that less than half a sequence, or the share ``tolerance`` of all, can be gained.  Any basis gives
    a valid plan, so that ``rounds`` bounds the time and not the result's validity.
    """
    room = len(demand) - 1
    rows = np.flatnonzero(demand)
    if not len(rows):
        return []
    basis = [np.where(rows == c, room // c, 0) for c in rows]
    inverse = np.diag([1.0 / (room // c) for c in rows])
    x = inverse @ demand[rows]
    for step in range(rounds):
        value, pattern = price(rows, inverse.sum(axis=0), room)
        if value <= 1 + 1e-9 or x.sum() * (1 - 1 / value) < max(0.5, tolerance * x.sum()):
            break
        u = inverse @ pattern
        able = u > 1e-9
        if not able.any():
            break
        ratio = np.where(able, x / np.where(able, u, 1), np.inf)
        k = int(np.argmin(ratio))
        x = x - ratio[k] * u
        x[k] = ratio[k]
        inverse[k] /= u[k]
        others = np.arange(len(rows)) != k
        inverse[others] -= np.outer(u[others], inverse[k])
        basis[k] = pattern
        if step % 200 == 199:  # rounding errors do not build up
            inverse = np.linalg.inv(np.array(basis, float).T)
            x = inverse @ demand[rows]
    left, plan = demand.astype(np.int64).copy(), []
    for short, times in sorted(zip(basis, np.floor(x + 1e-7).astype(np.int64), strict=True), key=lambda q: -q[1]):
        p = np.zeros(room + 1, int)
        p[rows] = short
        used = np.flatnonzero(p)
        times = int(min([max(0, times), *(left[used] // p[used])]))
        if times:
            plan.append((p, times))
            left -= times * p
    # what rounding left is best-fit, longest first; the open sequences are kept by their room
    open_, bins = {}, []
    for c in range(room, 0, -1):
        for _ in range(int(left[c])):
            free = min((r for r, b in open_.items() if r >= c and b), default=None)
            if free is None:
                bins.append(np.zeros(room + 1, int))
                k, free = len(bins) - 1, room
            else:
                k = open_[free].pop()
            bins[k][c] += 1
            open_.setdefault(free - c, []).append(k)
    return plan + [(b, 1) for b in bins]


def places(plan: list[tuple[np.ndarray, int]], room: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first ranks of its runs, and each run's pieces a sequence, first sequence and place in it."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    reached = np.zeros(room + 1, np.int64)
    first = 0
    for p, times in plan:
        place = 0
        for c in np.flatnonzero(p)[::-1]:
            n = int(p[c])
            runs.setdefault(int(c), []).append((int(reached[c]), n, first, place))
            reached[c] += n * times
            place += n
        first += times
    return {c: tuple(np.array(v, np.int64).T) for c, v in runs.items()}


def pack(parts: DataFrame, length: int = 1024, id_col: str = "doc_id", start_col: str = "start", length_col: str = "length") -> DataFrame:
    """Append ``sequence_id`` and ``offset`` to a table of pieces (at most ``length`` tokens each).

    ``parts`` is read three times: pass a written table.  Offsets of a sequence leave no gap.  Pieces are ranked by
    (id, start) within a length, so ties exist only between rows equal in both, whose order is free.  An empty table
    gives an empty table.  Null or non-positive lengths and lengths above ``length`` raise ValueError.
    """
    spark = parts.sparkSession
    prepare(spark)
    parts = without(parts, "sequence_id", "offset", "_class", "_group", "_rank", "_place")
    room = length
    dealt = parts.withColumn("_class", F.col(length_col).cast("int")).withColumn("_group", F.pmod(F.xxhash64(id_col, start_col), F.lit(RANK_GROUPS)).cast("int"))
    counts = dealt.groupBy("_class", "_group").count().collect()  # at most lengths x groups rows
    before = np.zeros((room + 1, RANK_GROUPS), np.int64)
    for c, g, n in counts:
        if c is None or not 0 < c <= room:
            raise ValueError(f"a piece is longer than {length}, or has no length")
        before[c, g] = n
    demand = before.sum(axis=1)
    before = np.cumsum(before, axis=1) - before
    runs = places(solve(demand), room)
    shared = spark.sparkContext.broadcast((before, runs))
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("_class", "_group").orderBy(id_col, start_col)).cast("long") - 1)
    kept = [c for c in ranked.columns if c not in ("_class", "_group", "_rank")]
    schema = T.StructType([ranked.schema[c] for c in kept] + [T.StructField("sequence_id", T.LongType(), False), T.StructField("_place", T.LongType(), False)])
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, runs = shared.value
        for batch in batches:
            c, g, r = (batch.column(batch.schema.names.index(n)).to_numpy() for n in ("_class", "_group", "_rank"))
            r = r + before[c, g]
            seq, place = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
            for k in np.unique(c):
                at = np.flatnonzero(c == k)
                since, each, first, base = runs[int(k)]
                i = np.searchsorted(since, r[at], "right") - 1
                d = r[at] - since[i]
                seq[at], place[at] = first[i] + d // each[i], base[i] + d % each[i]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index(n)) for n in kept] + [pa.array(seq), pa.array(place)], schema=target)

    w = Window.partitionBy("sequence_id").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.mapInArrow(run, schema).withColumn("offset", F.sum(length_col).over(w) - F.col(length_col)).drop("_place")
