"""Near-duplicate documents by b-bit MinHash.

Of every minimum only the low bits are kept, packed into a few integers.  Documents whose full minima agree in a band
share a bucket.  For candidates the similarity is estimated from the number of agreeing low bits, corrected for chance
agreement; what can reach the threshold is confirmed on the full shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lockgrain.llm.buckets import linked
from lockgrain.llm.common import arrow_schema, discard, if_small, prepare, staged, without

BANDS, ROWS, BITS = 32, 5, 4
MINIMA = BANDS * ROWS
#: Bytes of text that are hashed at once, about.
WINDOW = 1 << 20
#: Rows of a block, and shingles it may hold about, where a bucket's open rows are compared in blocks.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 4_000_000
#: Partners that are checked against one copy of a document's set.
PARTNERS = 256
#: Standard errors by which an estimate may fall short of the threshold and still be confirmed.
#: At the threshold this loses about as few pairs (3 in a million) as the bands do.
SLACK = 4.5

_rng = np.random.default_rng(20240229)
_byte = _rng.integers(0, 2**64, 256, np.uint64)
_byte[65:91] = _byte[97:123]
_space = np.zeros(256, bool)
_space[[32, 9, 10, 11, 12, 13]] = True
_a = _rng.integers(0, 2**64, MINIMA, np.uint64) | np.uint64(1)
_b = _rng.integers(0, 2**64, MINIMA, np.uint64)
_BASE, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of UTF-8 bytes (A-Z as a-z) and where the words start.

    Long input is taken in windows that end at white space, so that memory does not grow by more than the results.
    """
    b, parts, at = np.frombuffer(raw, np.uint8), [], 0
    while at < len(b):
        end = at + WINDOW
        while end < len(b):
            if len(gap := np.flatnonzero(_space[b[end : end + WINDOW]])):
                end += int(gap[0])
                break
            end += WINDOW
        h, start = _hashes(b[at:end])
        parts.append((h, start + at))
        at = end
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([h for h, _ in parts]), np.concatenate([s for _, s in parts])


def _hashes(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    solid = np.concatenate(([False], ~_space[b], [False]))
    turn = np.flatnonzero(solid[1:] != solid[:-1])
    start, size = turn[::2], turn[1::2] - turn[::2]
    if not len(start):
        return np.zeros(0, np.uint64), start
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    power = np.cumprod(np.full(int(size.max()) + 1, _BASE | np.uint64(1), np.uint64))
    return _mix(np.add.reduceat(_byte[b[solid[1:-1]]] * power[place], first) + size.astype(np.uint64) * _M2), start


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; fewer words make one shingle, none an empty set."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    begin = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])))
    h, start = word_hashes(b" ".join(raw))
    cut = np.searchsorted(start, begin)
    out = []
    s = h.copy()
    for k in range(1, words):
        s[: len(s) - k] = _mix(s[: len(s) - k] * _BASE + h[k:]) if len(h) > k else s[: len(s) - k]
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        n = hi - lo
        if n >= words:
            out.append(np.unique(s[lo : hi - words + 1]))
        elif n:
            whole = h[lo : lo + 1]
            for k in range(lo + 1, hi):
                whole = _mix(whole * _BASE + h[k : k + 1])
            out.append(_mix(whole + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(s: np.ndarray) -> np.ndarray:
    out = np.full(MINIMA, np.uint64(2**64 - 1), np.uint64)
    for at in range(0, len(s), 2048):
        np.minimum(out, (_mix(s[at : at + 2048])[:, None] * _a + _b).min(axis=0), out=out)
    return out


def packed(m: np.ndarray) -> np.ndarray:
    """The low bits of minima by place: ``BITS`` integers for each 64 minima."""
    words = -(-len(m) // 64)
    planes = np.zeros((words * 64, BITS), np.uint64)
    planes[: len(m)] = (m[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)
    low = planes.reshape(words, 64, BITS) << np.arange(64, dtype=np.uint64)[None, :, None]
    return np.bitwise_or.reduce(low, axis=1).ravel().view(np.int64)


def sketch(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and the packed low bits of the minima."""
    m = _mix(minima(s))
    rows = m.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64) * _BASE
    for r in range(ROWS):
        key = _mix(key * _M1 + rows[:, r])
    return key.view(np.int64), packed(m)


def estimate(x: Column, y: Column) -> Column:
    """Similarity from the share of agreeing b-bit values, corrected for agreement by chance."""
    differing = F.lit(0)
    for w in range(-(-MINIMA // 64)):
        parts = [F.get(x, F.lit(w * BITS + k)).bitwiseXOR(F.get(y, F.lit(w * BITS + k))) for k in range(BITS)]
        differing = differing + F.bit_count(reduce(Column.bitwiseOR, parts))
    chance = 2.0**-BITS
    return ((1 - differing / MINIMA) - chance) / (1 - chance)


def least_estimate(threshold: float) -> float:
    """The estimate below which a pair of that similarity falls only by more than ``SLACK`` standard errors."""
    chance = 2.0**-BITS
    agree = threshold * (1 - chance) + chance
    return threshold - SLACK * float(np.sqrt(agree * (1 - agree) / MINIMA)) / (1 - chance)


def groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Rows of sorted batches, a table for each run of equal values of the columns ``names`` (longs without nulls)."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.stack([batch.column(batch.schema.names.index(n)).to_numpy() for n in names], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi > lo:
                now = keys[lo].tolist()
                if held and now != last:
                    yield pa.Table.from_batches(held)
                    held = []
                last = now
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def similar(part: pa.Table, threshold_percent: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a bucket's block (or of two blocks) that can link and have this as their first common bucket.

    Rows have key, side, id, component, bands, low and short (set of 32-bit shingle hashes).  The estimate comes first,
    then the size of the intersection of the short sets.
    """
    get = lambda n: part.column(n).to_numpy()
    ids, comp, side, key = get("id"), get("component"), get("side"), part.column("key")[0].as_py()
    table = lambda n: part.column(n).combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
    bands, low = table("bands"), table("low")
    raw = part.column("short").to_pylist()
    sets = [np.frombuffer(r, np.uint32) for r in raw]
    size = np.array([len(s) for s in sets])
    both = part.column("both")[0].as_py()
    a_rows = np.flatnonzero(side == 0)
    b_rows = np.flatnonzero(side == 1) if both else a_rows
    differ = 1 - (least * (1 - 2.0**-BITS) + 2.0**-BITS)
    a_out, b_out = [], []
    flat = starts = None
    for i in a_rows.tolist():
        j = b_rows[(comp[b_rows] != comp[i]) & ((ids[b_rows] > ids[i]) if not both else (ids[b_rows] != ids[i]))]
        j = j[100 * np.minimum(size[j], size[i]) >= threshold_percent * np.maximum(size[j], size[i])]
        if not len(j):
            continue
        x = (low[j] ^ low[i]).reshape(len(j), -1, BITS)
        j = j[np.bitwise_count(np.bitwise_or.reduce(x, axis=2)).sum(axis=1) <= differ * MINIMA + 1e-9]
        if not len(j):
            continue
        same = bands[j] == bands[i]
        j = j[bands[i][same.argmax(axis=1)] == key]
        if not len(j):
            continue
        if flat is None:  # every shingle of the block as a number from 0
            code = np.unique(np.concatenate(sets), return_inverse=True)[1]
            starts = np.concatenate(([0], np.cumsum(size)))
            flat, mark = code, np.zeros(int(code.max()) + 1, bool)
        mine = flat[starts[i] : starts[i + 1]]
        mark[mine] = True
        common = np.array([np.count_nonzero(mark[flat[starts[k] : starts[k + 1]]]) for k in j.tolist()])
        mark[mine] = False
        j = j[100 * common >= threshold_percent * (size[i] + size[j] - common)]
        a_out.append(np.minimum(ids[i], ids[j]))
        b_out.append(np.maximum(ids[i], ids[j]))
    if not a_out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(a_out), np.concatenate(b_out)


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def document_groups(docs: DataFrame, shingle_words: int = 5, threshold_percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Sketches (id, h, n, digest and more), one a row of ``docs`` with the hash h of its text, and groups (digest, rep,
    component): of each distinct shingle set its smallest id and the smallest id that it reaches by links.

    Documents link if 100 * intersection >= threshold * union of their full shingle sets.  Equal sets are collapsed
    before any bucket is formed.
    """
    spark = docs.sparkSession
    prepare(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    longs = T.ArrayType(T.LongType(), False)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("h", T.LongType()), T.StructField("n", T.LongType(), False), T.StructField("digest", T.BinaryType()), T.StructField("bands", longs), T.StructField("low", longs)])
    target = arrow_schema(schema)

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), shingle_words)
            made = [sketch(s) if len(s) else (None, None) for s in sets]
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            arrays = [pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, target.field("digest").type)]
            arrays += [pa.array([m[k] for m in made], target.field(c).type) for k, c in enumerate(("bands", "low"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *arrays], schema=target)

    made = staged(source.mapInArrow(sketches, schema), "sketches")
    usable = made.where("digest is not null and id is not null")
    first = staged(usable.groupBy("digest").agg(F.min("id").alias("rep")), "first")
    # a distinct set is named by its smallest id; where rows of one id hold several sets, all but one get other names
    twice = first.groupBy("rep").agg(F.min("digest").alias("one"), F.count("*").alias("sets")).where("sets > 1")
    node = F.when(F.col("one").isNull() | (F.col("one") == F.col("digest")), F.col("rep")).otherwise(F.xxhash64("digest"))
    first = staged(first.join(twice, "rep", "left").select("digest", "rep", node.alias("node")), "first")
    reps = usable.join(first.select("digest", F.col("rep").alias("id"), "node"), ["digest", "id"]).groupBy("node").agg(*[F.first(c).alias(c) for c in ("id", "digest", "n", "bands", "low")])
    reps = staged(reps, "reps")
    rows = reps.select(F.explode("bands").alias("key"), F.col("node").alias("id"), F.col("n").alias("size"))
    shared = rows.groupBy("key").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x < y").select("key")
    members = staged(rows.join(if_small(staged(shared, "keys")), "key"), "members")
    least = least_estimate(threshold_percent / 100)
    low = reps.select("node", "low")
    pair = _schema(a=T.LongType(), b=T.LongType())
    set_schema = _schema(node=T.LongType(), set=T.BinaryType())

    def sets_of(nodes: DataFrame, short: bool = False) -> DataFrame:
        """(node, set) of the nodes: sorted 64-bit shingle hashes, or with ``short`` their low halves."""
        wanted = if_small(staged(reps.select("node", "id", "digest").join(if_small(nodes), "node", "left_semi"), "wanted"), 200_000)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = shingle_sets(batch.column(2).to_pylist(), shingle_words)
                fits = [k for k, (s, d) in enumerate(zip(sets, batch.column(1).to_pylist(), strict=True)) if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == bytes(d)]
                data = [(np.unique(sets[k].astype(np.uint32)) if short else sets[k]).tobytes() for k in fits]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(fits, pa.int32())), pa.array(data, arrow_schema(set_schema).field("set").type)], schema=arrow_schema(set_schema))

        found = source.join(wanted, "id").select("node", "digest", "text").mapInArrow(run, set_schema)
        # rows that repeat an id and its text have given the same set again
        return found.groupBy("node").agg(F.first("set").alias("set"))

    def verify(pairs: DataFrame, count: int) -> DataFrame:
        hopeful = pairs.join(low.select(F.col("node").alias("a"), F.col("low").alias("x")), "a").join(low.select(F.col("node").alias("b"), F.col("low").alias("y")), "b")
        hopeful = staged(hopeful.where(estimate(F.col("x"), F.col("y")) >= least).select("a", "b"), "hopeful", count)
        # the side that fewer documents share is the partner; each copy of the other's set serves a block of partners
        often = hopeful.select(F.explode(F.array("a", "b")).alias("hub")).groupBy("hub").count()
        sided = hopeful.join(often.select(F.col("hub").alias("a"), F.col("count").alias("m")), "a").join(often.select(F.col("hub").alias("b"), F.col("count").alias("n")), "b")
        sided = sided.select(F.when(F.col("m") >= F.col("n"), F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(F.col("m") >= F.col("n"), F.col("b")).otherwise(F.col("a")).alias("node"), F.greatest("m", "n").alias("m"))
        salt = F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / PARTNERS)).cast("long")
        sided = staged(sided.select("hub", "node", salt.alias("salt")), "sided", count)
        nodes = staged(sided.select("hub").union(sided.select("node")).distinct().withColumnRenamed("hub", "node"), "nodes", 2 * count)
        sets = staged(sets_of(nodes), "sets")
        hubs = sided.select("hub", "salt").distinct().select("hub", "salt", F.lit(0).cast("long").alias("part"), F.col("hub").alias("node"))
        both = hubs.union(sided.select("hub", "salt", F.lit(1).cast("long"), "node")).join(sets, "node").select("hub", "salt", "part", "node", "set")
        dealt = both.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "part")

        def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hub, own = None, None
            for batch in batches:
                of, part, node = (batch.column(k).to_numpy() for k in (0, 2, 3))
                good = []
                for k, s in enumerate(batch.column(4)):
                    x = np.frombuffer(s.as_buffer(), np.uint64)
                    if part[k] == 0:
                        hub, own = of[k], x.copy()
                        continue
                    assert hub == of[k]
                    union = len(np.union1d(x, own))
                    if 100 * (len(x) + len(own) - union) >= threshold_percent * union:
                        good.append(k)
                a, b = np.minimum(of[good], node[good]), np.maximum(of[good], node[good])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=arrow_schema(pair))

        out = staged(dealt.mapInArrow(confirm, pair), "confirmed", count)
        discard(hopeful, sided, nodes, sets)
        return out

    def search(open_: DataFrame) -> DataFrame:
        """Pairs of one bucket: its open rows are dealt into blocks, and two blocks at a time are compared in a task."""
        nodes = staged(open_.select(F.col("id").alias("node")).distinct(), "nodes", open_.count())
        sets = staged(sets_of(nodes, short=True).withColumnRenamed("set", "short"), "sets")
        many = open_.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).alias("blocks"))
        placed = open_.join(many, "key").withColumn("block", F.pmod(F.xxhash64("id", F.lit(9)), F.col("blocks")))
        placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        placed = placed.select("key", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), (F.col("block") != F.least("block", "other")).cast("long").alias("side"), (F.col("block") != F.col("other")).alias("both"), F.col("id").alias("node"), "component")
        full = placed.join(sets, "node").join(reps.select("node", "bands", "low"), "node").withColumnRenamed("node", "id")
        # within a pair of blocks of their own number all rows are on side 0
        dealt = full.repartition("key", "first", "second").sortWithinPartitions("key", "first", "second")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in groups(batches, ["key", "first", "second"]):
                if part.num_rows > 1:
                    a, b = similar(part, threshold_percent, least)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=arrow_schema(pair))

        out = staged(dealt.mapInArrow(run, pair), "similar")
        discard(nodes, sets)
        return out

    near = lambda x, y: 100 * F.least(x, y) >= threshold_percent * F.greatest(x, y)
    classes = linked(members, verify, search, near)
    named = first.join(if_small(classes), first["node"] == classes["node"], "left").select("digest", "rep", "component")
    heads = named.where("component is not null").groupBy("component").agg(F.min("rep").alias("head"))
    named = named.join(if_small(staged(heads, "heads")), "component", "left").select("digest", "rep", F.coalesce("head", "rep").alias("component"))
    return made, named


def near_duplicates(docs: DataFrame, shingle_words: int = 5, threshold_percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept): one row a row of ``docs``.

    Each row is a document; those link whose sets are similar enough, by ``document_groups``.  component_id is the
    smallest id that a row reaches by links, itself included; kept is whether that is its own id, so of equal rows with
    the smallest id of a group all are kept.  Null, empty and blank texts have no shingles and link with nothing.  Rows
    with null ids link with nothing, get the component of the documents with their set, and are not kept.  Texts may be
    of any length; ties do not occur, as the least id counts.  An empty table gives an empty table; other columns of
    ``docs`` are not looked at.
    """
    made, named = document_groups(docs, shingle_words, threshold_percent, id_col, text_col)
    all_ = made.join(named, "digest", "left").select("id", "n", F.coalesce("component", "id").alias("component_id"))
    return all_.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, shingle_words: int = 5, threshold_percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near duplicates, one of its smallest id; all columns of ``docs``.

    Rows without shingles, and those with null ids, all stay.  A row goes only for its own text: another row of the
    same id whose text is in no group stays.  Of a group's rows with the smallest id, the one of the least (set, text)
    stays, by their hashes; of rows that repeat it, any one.
    """
    made, named = document_groups(docs, shingle_words, threshold_percent, id_col, text_col)
    rows = made.where("id is not null and digest is not null").select("id", "h", "digest").join(named.select("digest", "component"), "digest")
    own = F.struct("digest", "h")
    several = rows.groupBy("component").agg(F.count("*").alias("rows"), F.min(F.when(F.col("id") == F.col("component"), own)).alias("head")).where("rows > 1")
    judged = staged(rows.join(several, "component").select("id", "h", ((F.col("id") == F.col("component")) & (own == F.col("head"))).alias("stays")), "judged")
    gone = staged(judged.where("not stays").select(F.col("id").alias("_id"), F.col("h").alias("_h")).distinct(), "gone")
    repeated = staged(judged.where("stays").groupBy(F.col("id").alias("_id"), F.col("h").alias("_h")).count().where("count > 1").drop("count"), "repeated")
    docs_ = without(docs, "_id", "_h", "_hash")
    on = lambda d: (F.col(id_col).cast("long") == d["_id"]) & (F.xxhash64(text_col) == d["_h"])
    left = docs_.join(if_small(gone), on(gone), "left_anti")
    if not repeated.isEmpty():
        same = left.join(if_small(repeated), on(repeated), "left_semi").withColumn("_hash", F.xxhash64(text_col)).dropDuplicates([id_col, "_hash"]).drop("_hash")
        left = left.join(if_small(repeated), on(repeated), "left_anti").unionByName(same)
    return left.select(*[F.col(f"`{c}`") for c in docs_.columns])
