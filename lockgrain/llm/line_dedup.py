"""Line deduplication by a segment-partition edit join, in DataFrame and SQL functions only.

Two lines within t edits share at least one of t + 1 segments of the shorter one, and that segment stands in the longer
one at a place that the edits before and after it bound.  Every distinct line is indexed by its segments and probes
the indexes of its own and up to t shorter lengths with the substrings at those places.  Candidates are verified by a
banded bit-parallel edit distance.  Lines that link form classes; the first line of a class stays, all others go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockgrain.llm.buckets import linked
from lockgrain.llm.common import FILE_ROWS, discard, if_small, prepare, staged, without
from lockgrain.llm.components import components

#: Edits (insertions, deletions, substitutions) up to which lines are the same.
EDITS = 2
#: Characters below which a line is never removed: headings, list marks and short replies repeat in clean text.
LEAST_CHARS = 20


def normal(line: Column) -> Column:
    """What lines are compared by: lower case, without white space around."""
    return F.trim(F.lower(line), F.lit(" \t\r\v\f"))


#: Words of 64 bits in the parity vector of a line's character pairs.
PARITY_WORDS = 4


def parities(norm: str) -> Column:
    """For each class of pairs of neighbouring characters, by a hash, whether the line holds an odd number of them.

    An edit removes two pairs at most and adds two, so lines within t edits differ in 4 * t places at most, while a
    replaced word changes about twice its length.
    """
    zero = f"array({', '.join(['0L'] * PARITY_WORDS)})"
    flipped = ", ".join(f"if(p div 64 = {w}, v[{w}] ^ shiftleft(1L, cast(p % 64 as int)), v[{w}])" for w in range(PARITY_WORDS))
    places = f"transform(sequence(1, size(c) - 1), i -> cast(pmod(hash(c[i - 1], c[i]), {64 * PARITY_WORDS}) as int))"
    return F.expr(f"get(transform(array(split({norm}, '')), c -> if(size(c) < 2, {zero}, aggregate({places}, {zero}, (v, p) -> array({flipped})))), 0)")


def probe_places(edits: int = EDITS) -> list[tuple[int, int, int]]:
    """(characters less, segment, shift) of the substrings that can equal a segment of a line that is up to ``edits`` shorter."""
    out = []
    for less in range(edits + 1):
        for i in range(1, edits + 2):
            after = edits + 1 - i  # segments behind this one, and so edits that may be there
            out += [(less, i, shift) for shift in range(max(1 - i, less - after), min(i - 1, less + after) + 1)]
    return out


def keys_at(distinct: DataFrame, places: list[tuple[int, int, int]], edits: int = EDITS) -> DataFrame:
    """(key, id, size) of the lines (id, norm, size) at each of the places.

    One expression serves all places: one for each would make a method too large to be compiled to machine code.
    """
    listed = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(place, ("less", "i", "shift"), strict=True)]) for place in places])
    rows = distinct.select("id", "norm", "size", F.explode(listed).alias("p")).select("id", "norm", "size", "p.*")
    i, other = F.col("i"), F.col("size") - F.col("less")
    base = F.floor(other / (edits + 1)).cast("int")
    short = edits + 1 - (other % (edits + 1))
    start, length = 1 + (i - 1) * base + F.greatest(F.lit(0), i - 1 - short) + F.col("shift"), base + (i > short).cast("int")
    # where each character is a byte, places are found without reading what stands before them
    part = lambda c: F.xxhash64(i, other.cast("int"), F.substring(c, start, length))
    key = F.when(F.octet_length("norm") == F.col("size"), part(F.col("norm").cast("binary"))).otherwise(part(F.col("norm")))
    return rows.select(key.alias("key"), "id", "size")


def distance(longer: str, shorter: str, edits: int = EDITS) -> Column:
    """Edit distance of two texts (names of columns; the first is not the shorter one) if it is ``edits`` at most, else more than that.

    A column of the distance matrix is held within the band of ``2 * edits + 1`` diagonals as two integers, one bit a
    row: where the value rises by one from the row above, and where it falls.  One step updates all rows of a column.
    The value on the main diagonal never falls, and exceeds the distance by ``edits`` at most: beyond that, no step is
    made any more.  What both texts begin or end with does not count and is cut off first, by comparing substrings of
    falling powers of two, so that near copies take few steps.
    """
    width, mid = 2 * edits + 1, 1 << edits
    mask, top = (1 << width) - 1, 1 << (width - 1)
    first = f"named_struct('p', {((1 << edits) - 1) << (edits + 1)}L, 'n', {(1 << (edits + 1)) - 1}L, 's', 0L)"
    equal = " + ".join(f"if(get(w.x, j - {edits + 1 - d}) = get(w.y, j - 1), {1 << d}L, 0L)" for d in range(width))
    # each "let" is a one-element array, so that a value used often is computed once
    let = lambda name, value, body: f"get(transform(array({value}), {name} -> {body}), 0)"
    step = let(
        "v",
        f"named_struct('p', shiftright(c.p, 1) | {top}L, 'n', shiftright(c.n, 1), 'm', {equal})",
        let(
            "z",
            f"((((v.m & v.p) + v.p) ^ v.p) | v.m | v.n) & {mask}L",
            let(
                "h",
                f"named_struct('u', shiftleft((v.n | ~(z | v.p)) & {mask}L, 1), 'd', shiftleft(z & v.p, 1))",
                f"named_struct('p', (h.d | ~(z | h.u)) & {mask}L, 'n', z & h.u & {mask}L, 's', c.s + if((z & {mid}L) = 0L, 1L, 0L))",
            ),
        ),
    )
    below = " + ".join(["c.s", *(f"if(size(w.x) - size(w.y) >= {k}, (shiftright(c.p, {edits + k}) & 1L) - (shiftright(c.n, {edits + k}) & 1L), 0L)" for k in range(1, edits + 1))])
    columns = "if(size(w.y) = 0, cast(array() as array<int>), sequence(1, size(w.y)))"
    chars = lambda c: f"if({c} = '', cast(array() as array<string>), split({c}, ''))"
    powers = f"array({', '.join(str(1 << k) for k in range(16, -1, -1))})"
    common = lambda t: f"aggregate({powers}, 0, (p, k) -> if(substring({t}.x, p + 1, k) = substring({t}.y, p + 1, k), p + k, p))"
    loop = let("w", f"named_struct('x', {chars('r.x')}, 'y', {chars('r.y')})", f"aggregate({columns}, {first}, (c, j) -> if(c.s > {2 * edits}L, c, {step}), c -> {below})")
    # the distance of reversed texts is the same
    loop = let("e", common("q"), let("r", "named_struct('x', substring(q.x, e + 1), 'y', substring(q.y, e + 1))", loop))
    loop = let("b", common("o"), let("q", "named_struct('x', reverse(substring(o.x, b + 1)), 'y', reverse(substring(o.y, b + 1)))", loop))
    return F.expr(let("o", f"named_struct('x', {longer}, 'y', {shorter})", loop))


def _classes(distinct: DataFrame, edits: int) -> DataFrame:
    """(node, component) of the distinct lines (id, norm, size) that link with another."""
    places = probe_places(edits)
    index = keys_at(distinct, [p for p in places if p[0] == p[2] == 0], edits).groupBy("key").agg(F.min("id").alias("c"), F.max("id").alias("z"))
    # a line's own segments are among its probes, so the probes of a key are all of its lines
    hits = staged(keys_at(distinct, places, edits).join(index, "key").where("id != c or c != z"), "hits")
    pairs = staged(hits.where("id != c").select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b")).distinct(), "pairs")

    def texts_of(ids: DataFrame) -> DataFrame:
        return distinct.join(if_small(ids), "id", "left_semi").select("id", "norm", "size")

    def verify(pairs: DataFrame, count: int) -> DataFrame:
        ids = staged(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids", 2 * count)
        # all lines are scanned for these few: moved to few files, as each task of the scan would write one of its own
        texts = staged(texts_of(ids).repartition(ids.count() // FILE_ROWS + 1), "texts")
        both = pairs.join(texts.select(F.col("id").alias("a"), F.col("norm").alias("x"), F.col("size").alias("m")), "a").join(texts.select(F.col("id").alias("b"), F.col("norm").alias("y"), F.col("size").alias("n")), "b")
        both = both.where(F.abs(F.col("m") - F.col("n")) <= edits)
        longer, shorter = F.when(F.col("m") >= F.col("n"), F.col("x")).otherwise(F.col("y")), F.when(F.col("m") >= F.col("n"), F.col("y")).otherwise(F.col("x"))
        both = both.select("a", "b", longer.alias("long"), shorter.alias("short"))
        out = staged(both.where(distance("long", "short", edits) <= edits).select("a", "b"), "near", count)
        discard(ids, texts)
        return out

    def search(open_: DataFrame) -> DataFrame:
        """Pairs of one key whose parity vectors allow a link, each in the first key that both have."""
        ids = staged(open_.groupBy("id").agg(F.collect_set("key").alias("keys")), "ids", open_.count())
        marked = staged(texts_of(ids.select("id")).select("id", parities("norm").alias("parity")).join(ids, "id"), "marked")
        rows = open_.join(if_small(marked, 50_000), "id")
        other = rows.select(F.col("key").alias("k2"), F.col("id").alias("b"), F.col("component").alias("c2"), F.col("size").alias("s2"), F.col("parity").alias("p2"), F.col("keys").alias("keys2"))
        flips = F.lit(0)
        for w in range(PARITY_WORDS):
            flips = flips + F.bit_count(F.get("parity", F.lit(w)).bitwiseXOR(F.get("p2", F.lit(w))))
        near = (F.abs(F.col("size") - F.col("s2")) <= edits) & (flips <= 4 * edits)
        first = F.array_min(F.array_intersect("keys", "keys2")) == F.col("key")
        on = (F.col("key") == F.col("k2")) & (F.col("id") < F.col("b")) & (F.col("component") != F.col("c2")) & near & first
        out = staged(rows.join(other, on).select(F.col("id").alias("a"), "b"), "open")
        discard(ids, marked)
        return out

    links = verify(pairs, pairs.count())
    members = staged(hits.where("c != z").select("key", "id", "size").distinct(), "members")
    discard(hits)
    # keys with more than one indexed line: their further pairs, for what is not yet in one component
    out = linked(members, verify, search, lambda x, y: F.abs(x - y) <= edits, (pairs, links))
    discard(members, pairs)
    return out


def repeated_lines(docs: DataFrame, edits: int = EDITS, least_chars: int = LEAST_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _text, _gone): for each distinct (id, hash of the text) with such lines, the sorted numbers of the lines
    to which an equal line, or one of the same class, stands earlier in the order of (id, line number).
    """
    prepare(docs.sparkSession)
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text"), F.posexplode(F.split(text_col, "\n")).alias("_line", "raw"))
    rows = rows.select("_id", "_text", "_line", normal(F.col("raw")).alias("norm")).where(F.length("norm") >= least_chars)
    rows = staged(rows.select("_id", "_text", "_line", F.xxhash64("norm").alias("id"), F.xxhash64(F.lit(1), F.col("norm")).alias("check"), "norm"), "lines")
    often = staged(rows.groupBy("id").agg(F.count("*").alias("times"), F.min("check").alias("x"), F.max("check").alias("y")).where("times > 1").select("id", (F.col("x") != F.col("y")).alias("clash")), "often")
    clash = often.where("clash").select("id", "clash")
    if not clash.isEmpty():  # different lines of one hash get other names
        rows = rows.join(if_small(clash), "id", "left").withColumn("id", F.when(F.col("clash"), F.xxhash64("id", "check")).otherwise(F.col("id"))).drop("clash")
        often = staged(rows.groupBy("id").count().where("count > 1").select("id"), "often")
    often = often.select("id")
    # only lines that stand more than once are moved to find one of each
    again = staged(rows.join(if_small(often), "id", "left_semi").groupBy("id").agg(F.min("norm").alias("norm")), "again")
    distinct = rows.join(if_small(often), "id", "left_anti").select("id", "norm").union(again).withColumn("size", F.length("norm"))
    classes = _classes(distinct, edits)
    place = F.struct("_id", "_line", "_text")
    known = staged(often.select("id").union(classes.select("node")).distinct(), "known")
    firsts = staged(rows.join(if_small(known), "id", "left_semi").groupBy("id").agg(F.min(place).alias("first")), "firsts")
    named = firsts.join(if_small(classes), firsts.id == classes.node)
    heads = named.groupBy("component").agg(F.min("first").alias("head"))
    moved = staged(named.join(heads, "component").select("id", "head"), "moved")
    firsts = staged(firsts.join(if_small(moved), "id", "left").select("id", F.coalesce("head", "first").alias("first")), "firsts")
    # all other lines stand once and are like no other: they are not looked at again
    judged = rows.select("_id", "_text", "_line", "id").join(if_small(firsts), "id").where(~place.eqNullSafe(F.col("first")))
    # rows that repeat a whole document give each of its lines more than once
    gone = staged(judged.groupBy("_id", "_text").agg(F.sort_array(F.collect_set("_line")).alias("_gone")), "gone")
    discard(rows, again, known, moved, firsts)
    return gone


def dedup_lines(docs: DataFrame, edits: int = EDITS, least_chars: int = LEAST_CHARS, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Append n_lines, n_dropped and dropped_lines (numbers from 0); the text is left without the dropped lines.

    Lines are what newlines separate.  Of equal or nearly equal lines of at least ``least_chars`` characters the first
    by (id, line number) stays, within a document too.  Shorter and blank lines always stay.  A null text stays null and
    has no lines; an empty one has one.  Rows with equal ids and texts are one document; null ids come first.  A
    document can become empty, but stays.  Input columns with an output's name are replaced.
    """
    docs = without(docs, "n_lines", "n_dropped", "dropped_lines", "_id", "_text", "_gone", "_hash", "_lines")
    gone = repeated_lines(docs, edits, least_chars, id_col, text_col)
    kept = [c for c in docs.columns if keep_text or c != text_col]
    lines, n_lines = F.split(text_col, "\n"), F.coalesce(F.size("_lines"), F.lit(0)).cast("long")
    rows = docs.withColumn("_hash", F.xxhash64(text_col))
    rows = rows if keep_text else rows.withColumn("n_lines", F.when(F.col(text_col).isNotNull(), F.size(lines)).otherwise(0).cast("long")).drop(text_col)
    # with whole texts, one plan at every size: which side would fit into memory says nothing of a larger corpus
    gone = gone.hint("merge") if keep_text else gone
    out = rows.join(gone, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_text")), "left")
    if keep_text:
        out = out.withColumn("_lines", lines).withColumn("n_lines", F.when(F.col(text_col).isNotNull(), n_lines).otherwise(0))
        # what stands between two dropped lines, before the first and after the last
        before = F.concat(F.array(F.lit(-1)), "_gone")
        between = F.transform(F.concat("_gone", F.array(F.size("_lines"))), lambda end, i: F.slice("_lines", F.get(before, i) + 2, end - F.get(before, i) - 1))
        text = F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(F.array_join(F.flatten(between), "\n"))
    columns = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in kept]
    return out.select(*columns, "n_lines", F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("_gone", F.array().cast("array<int>")).alias("dropped_lines"))
