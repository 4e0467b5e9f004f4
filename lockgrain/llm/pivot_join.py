"""Exact metric range join of embeddings.

On unit vectors a cosine of at least t is a distance of at most r = sqrt(2 - 2t).  Vectors go to the cell of their
nearest pivot.  By the triangle inequality a vector within r of a member of another cell is at most 2r further from
that cell's pivot than from its own; such vectors are copied to the other cell as border members, and each cell is
joined by itself.  Of two cells only the one with the lower number gets copies, so every link is found once.  A cell
that is still large is split again by pivots of its own, unless that would copy more than it parts.  Within a cell,
vectors whose distances to its pivot differ by more than r cannot link: they are dealt into bands of that width, and a
band meets itself and the next one, block by block.  Tasks return counts of links and a spanning forest, never all
pairs.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lockgrain.llm.common import discard, if_small, prepare, staged, without
from lockgrain.llm.components import components

#: Vectors of a cell from which it is split, and about how many a cell shall have after that.
CELL_ROWS = 4096
#: Pivots of one split, at most, and the sample of a cell's vectors that they are chosen from; cells are numbered by
#: pivots, a digit a level.
PIVOTS, SAMPLE = 512, 4096
#: Splits of splits, at most: as many digits as a long holds.
LEVELS = 6
#: Vectors of the sample on which the copies of a split are tried.
TRIAL = 512
#: Rows that a split may make of one, on average; beyond that the cell stays whole.
COPIES = 3.0
#: What rounding can add to a distance: near zero, the root of an error in the last digit.
SLACK = 1e-6
#: Vectors of a block; a task compares two blocks, and assigns eight times as many to cells.
BLOCK_ROWS = 1024


def unit(flat: np.ndarray, rows: int) -> np.ndarray:
    x = flat.astype(np.float64).reshape(rows, -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of tiny or huge components stay in range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _usable(vec: Column) -> Column:
    x = vec.cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))


def _vectors(column: pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return unit(lists.flatten().to_numpy(zero_copy_only=False), len(lists))


def spread_out(x: np.ndarray, most: int, radius: float) -> np.ndarray:
    """Rows to be pivots: each is the farthest from those before it, until every row is near one of them."""
    chosen = [0]
    near = 2 - 2 * (x @ x[0])
    while len(chosen) < most and (k := int(near.argmax())) not in chosen and near[k] > (radius / 2) ** 2:
        chosen.append(k)
        near = np.minimum(near, 2 - 2 * (x @ x[k]))
    return np.array(chosen)


def cells_of(x: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, is a border copy, distance to the cell's pivot) of every row's own cell and the cells of lower number
    that it may reach.
    """
    between = lambda a, b: np.sqrt(np.maximum(0.0, 2 - 2 * (a @ b.T)))
    d = between(x, pivots)
    home = d.argmin(axis=1)
    own = d[np.arange(len(x)), home]
    near = (d - own[:, None] <= 2 * radius + SLACK) & (np.arange(len(pivots))[None] < home[:, None])
    row, cell = np.nonzero(near)
    apart = between(pivots, pivots)[cell, home[row]]
    # the plane between two pivots is at least this far away, and all of the other cell lies behind it
    far = (d[row, cell] ** 2 - own[row] ** 2) / np.maximum(2 * apart, 1e-12) > radius + SLACK
    row, cell = row[~far], cell[~far]
    rows, cells = np.concatenate((np.arange(len(x)), row)), np.concatenate((home, cell))
    return rows, cells, np.concatenate((np.zeros(len(x), bool), np.ones(len(row), bool))), d[rows, cells]


def link_block(ids: np.ndarray, times: np.ndarray, x: np.ndarray, side: np.ndarray, border: np.ndarray, same: bool, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links between the two sides (or within one): ids with counts, and the edges of a spanning forest.

    ``border`` has a bit for each level at which a row is a copy; two copies of one level meet in another cell.
    """
    a = np.flatnonzero(side == 0)
    b = a if same else np.flatnonzero(side == 1)
    counts = np.zeros(len(ids), np.int64)
    if not len(a) or not len(b):
        return counts, np.zeros(0, np.int64), np.zeros(0, np.int64)
    hit = x[a] @ x[b].T >= least
    hit &= (border[a][:, None] & border[b][None]) == 0
    if same:
        np.fill_diagonal(hit, False)
    counts[a] += hit @ times[b]
    if not same:
        counts[b] += hit.T @ times[a]
    root = np.full(len(ids), -1)
    start, end = [], []
    for i in np.flatnonzero(hit.any(axis=1)):
        if root[a[i]] >= 0:
            continue
        root[a[i]], rows = a[i], np.array([i])
        while len(rows):  # breadth first, every row once
            cols = np.flatnonzero(hit[rows].any(axis=0))
            new = b[cols][root[b[cols]] < 0]
            root[new] = a[i]
            if same:
                rows = np.searchsorted(a, new)
                found = new
            else:
                back = np.flatnonzero(hit[:, np.isin(b, new)].any(axis=1)) if len(new) else np.zeros(0, int)
                rows = back[root[a[back]] < 0]
                root[a[rows]] = a[i]
                found = np.concatenate((new, a[rows]))
            start += [ids[a[i]]] * len(found)
            end += ids[found].tolist()
    return counts, np.array(start, np.int64), np.array(end, np.int64)


KEY = ["label", "dim", "cell"]
_ROW = "label string, dim int, cell long, border long, far double, id long, times long, vec {}"


def _split(rows: DataFrame, sizes: DataFrame, level: int, radius: float, kind: str) -> DataFrame:
    """Rows of cells (with their sizes) dealt to new cells by pivots of each cell's own, from a sample of it by hash.

    Pivots that would copy the sample's rows to more than ``COPIES`` cells on average are not used, and the cell's rows
    left out.  Those of the other cells are assigned in groups of bounded size, each with a copy of its pivots.
    """
    spread = F.xxhash64("id", F.lit(level))
    share = -(2.0**63) + 2.0**64 * F.least(F.lit(1.0), 2.0 * SAMPLE / F.col("n"))
    few = rows.join(if_small(sizes), KEY).where(spread.cast("double") < share)
    few = few.withColumn("place", F.row_number().over(Window.partitionBy(*KEY).orderBy(spread, "id"))).where(F.col("place") <= SAMPLE)

    def choose(part: pa.Table) -> pa.Table:
        x = _vectors(part.column("vec"))
        found = spread_out(x, PIVOTS, radius)
        trial = x[:: max(1, len(x) // TRIAL)]
        copies = len(cells_of(trial, x[found], radius)[0])
        return part.take(pa.array(found if copies <= COPIES * len(trial) else found[:0]))

    pivots = staged(few.select(*KEY, "vec").groupBy(*KEY).applyInArrow(choose, f"label string, dim int, cell long, vec {kind}"), "pivots")
    sizes = sizes.join(if_small(staged(pivots.select(*KEY).distinct(), "parted")), KEY, "left_semi")
    salts = F.ceil(F.col("n") / (8 * BLOCK_ROWS)).cast("int")
    dealt = rows.join(if_small(sizes), KEY).withColumn("salt", F.pmod(F.xxhash64("id", F.lit(5)), salts).cast("int")).select(*KEY, "salt", F.lit(1).alias("part"), "border", "id", "times", "vec")
    copies = pivots.join(if_small(sizes), KEY).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).select(*KEY, "salt", F.lit(0).alias("part"), F.lit(0).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("long"), "vec")

    def assign(part: pa.Table) -> pa.Table:
        is_row = part.column("part").to_numpy() == 1
        own, piv = part.filter(pa.array(is_row)), part.filter(pa.array(~is_row))
        if not own.num_rows:  # a group of pivots alone
            return pa.table({n: part.column(n).slice(0, 0) for n in (*KEY, "border")} | {"far": pa.array([], pa.float64())} | {n: part.column(n).slice(0, 0) for n in ("id", "times", "vec")})
        r, c, b, d = cells_of(_vectors(own.column("vec")), _vectors(piv.column("vec")), radius)
        got = own.take(pa.array(r))
        cell = got.column("cell").to_numpy() * (PIVOTS + 1) + c + 1
        border = got.column("border").to_numpy() | (b.astype(np.int64) << level)
        return pa.table({"label": got.column("label"), "dim": got.column("dim"), "cell": cell, "border": border, "far": d, "id": got.column("id"), "times": got.column("times"), "vec": got.column("vec")})

    return dealt.union(copies).groupBy(*KEY, "salt").applyInArrow(assign, _ROW.format(kind))


def cells(reps: DataFrame, radius: float) -> DataFrame:
    """``reps`` (label, dim, id, times, vec) in cells: cell, border, and far, the distance to the cell's pivot (-1 without)."""
    kind = reps.schema["vec"].dataType.simpleString()
    rows = staged(reps.select("label", "dim", F.lit(0).cast("long").alias("cell"), F.lit(0).cast("long").alias("border"), F.lit(-1.0).alias("far"), "id", "times", "vec"), "cells")
    done: list[DataFrame] = []
    for level in range(LEVELS):
        sizes = staged(rows.groupBy(*KEY).agg(F.count("*").alias("n")), "sizes")
        large = staged(sizes.where(F.col("n") > CELL_ROWS), "large")
        if large.isEmpty():
            break
        parts = staged(_split(rows, large, level, radius, kind), "cells")
        after = parts.groupBy("label", "dim", F.floor((F.col("cell") - 1) / (PIVOTS + 1)).alias("cell"), F.col("cell").alias("sub")).agg(F.count("*").alias("m"))
        after = after.groupBy(*KEY).agg(F.sum("m").alias("all"), F.max("m").alias("most"))
        worth = staged(large.join(after, KEY).where((F.col("all") <= COPIES * F.col("n")) & (F.col("most") <= 0.9 * F.col("n"))).select(*KEY), "worth")
        done.append(rows.join(if_small(worth), KEY, "left_anti"))
        up = parts.withColumn("parent", F.floor((F.col("cell") - 1) / (PIVOTS + 1)))
        rows = staged(up.join(if_small(worth.withColumnRenamed("cell", "parent")), ["label", "dim", "parent"], "left_semi").select(*rows.columns), "cells")
        discard(parts)
    return reduce(DataFrame.union, [*done, rows])


def meetings(dealt: DataFrame, radius: float) -> DataFrame:
    """Rows copied to the pairs of blocks in which they meet others: cell, band, kind, first, second and side.

    kind 0 is two blocks of a band (or one with itself), kind 1 a block and one of the next band.
    """
    band = F.when((F.col("far") < 0) | F.lit(radius <= 0), 0).otherwise(F.floor(F.col("far") / (radius + SLACK))).cast("long")
    rows = dealt.withColumn("band", band)
    blocks = staged(rows.groupBy(*KEY, "band").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("long").alias("blocks")), "blocks")
    near = lambda shift, name: blocks.select(*KEY, (F.col("band") - shift).alias("band"), F.col("blocks").alias(name))
    for shift, name in ((0, "own"), (1, "next"), (-1, "last")):
        rows = rows.join(if_small(near(shift, name)), [*KEY, "band"], "left")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit(9)), F.col("own")))
    upto = lambda n: F.when(F.coalesce(F.col(n), F.lit(0)) > 0, F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).otherwise(F.array().cast("array<bigint>"))
    place = lambda kind, band, first, second, side: F.struct(F.lit(kind).alias("kind"), band.alias("at"), first.alias("first"), second.alias("second"), side.cast("int").alias("side"))
    mine = F.col("block")
    within = F.transform(upto("own"), lambda o: place(0, F.col("band"), F.least(mine, o), F.greatest(mine, o), mine > o))
    below = F.transform(upto("next"), lambda o: place(1, F.col("band"), mine, o, F.lit(0)))
    above = F.transform(upto("last"), lambda o: place(1, F.col("band") - 1, o, mine, F.lit(1)))
    return rows.withColumn("m", F.explode(F.concat(within, below, above))).select(*KEY, "m.at", "m.kind", "m.first", "m.second", "m.side", "border", "id", "times", "vec")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Append n_links, component_id and kept to every row.

    Rows are compared if their labels are equal and not null and their vectors have equal lengths.  Null ids, and
    vectors that are null, empty, zero, or hold null or non-finite components, link with nothing: no links, their own
    id as component.  Equal vectors are collapsed first and counted with their number, so a common vector costs one
    row; the smallest id stands for them.  Vectors of equal ids
    share the id's component, and their links are counted together.  An empty table gives an empty table.  Input columns with an output's name are replaced.
    """
    spark = vectors.sparkSession
    prepare(spark)
    vectors = without(vectors, "n_links", "component_id", "kept", "_key", "_label", "_vec", "_component", "_links")
    usable = F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & _usable(F.col(vec_col))
    label, vec = F.col(label_col).cast("string").alias("label"), F.col(vec_col).alias("vec")
    reps = vectors.where(usable).select(F.col(id_col).cast("long").alias("id"), label, vec).groupBy("label", "vec").agg(F.min("id").alias("id"), F.count("*").alias("times"))
    reps = staged(reps.withColumn("dim", F.size("vec")), "vectors")
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    placed = meetings(cells(reps, radius), radius)

    def join(part: pa.Table) -> pa.Table:
        same = part.column("kind")[0].as_py() == 0 and part.column("first")[0].as_py() == part.column("second")[0].as_py()
        get = lambda n: part.column(n).to_numpy()
        ids = get("id")
        counts, start, end = link_block(ids, get("times"), _vectors(part.column("vec")), get("side"), get("border"), same, threshold)
        some = np.flatnonzero(counts)
        return pa.table({"a": pa.array(np.concatenate((ids[some], start))), "b": pa.array([None] * len(some) + end.tolist(), pa.int64()), "n": pa.array(counts[some].tolist() + [None] * len(start), pa.int64())})

    found = staged(placed.groupBy(*KEY, "at", "kind", "first", "second").applyInArrow(join, "a long, b long, n long"), "found")
    counts = found.where("n is not null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    classes = components(found.where("b is not null"), "a", "b")
    known = reps.select("id", "label", "vec", "times").join(counts, "id", "left").join(classes.select(F.col("node").alias("id"), "component"), "id", "left")
    known = known.select(F.col("label").alias("_label"), F.col("vec").alias("_vec"), F.coalesce("component", "id").alias("_component"), (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("_links"))
    own = F.col(id_col).cast("long")
    rows = vectors.withColumn("_key", F.when(usable, F.col(label_col).cast("string")))
    out = rows.join(known, (F.col("_key") == F.col("_label")) & (F.col(vec_col) == F.col("_vec")), "left")
    c = F.coalesce("_component", own)
    return out.select(*vectors.columns, F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), c.alias("component_id"), F.coalesce(own == c, F.lit(False)).alias("kept"))
