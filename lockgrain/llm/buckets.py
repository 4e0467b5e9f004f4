"""Links between rows that share a bucket, found without all pairs of a bucket.

A bucket's rows are first checked against one of them, the centre, for a few rounds with changing centres; links join
components.  A bucket whose rows are all in one component is done, so a large group of near copies costs as many
checks as it has rows.  Only what is left, pairs in different components of one bucket, goes to a search of the
caller's own, which sifts them before any pair is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockgrain.llm.common import discard, staged
from lockgrain.llm.components import components

CENTRE_ROUNDS = 2


def linked(members: DataFrame, verify: Callable[[DataFrame, int], DataFrame], search: Callable[[DataFrame], DataFrame], near: Callable[[Column, Column], Column] | None = None, start: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(node, component) of all ids with a link.

    ``members`` (key, id, size) is a written table whose buckets hold two ids or more; ``verify`` takes distinct pairs
    (a < b) and their number, and returns those that link, as a written table.  ``search`` gets the rows (key, id, size,
    component) that are still open after the centres and returns pairs (a < b) of one key and different components, as a
    written table, with every link among them.  Sizes for which ``near`` is false cannot link.  ``start`` are pairs
    verified before and the links among them.  An empty table gives an empty table.
    """
    tested, links = start or (None, None)
    total = members.count()
    classes = staged(components(links, "a", "b"), "classes", 2 * links.count()) if start else None
    for step in range(CENTRE_ROUNDS + 1):
        rows, before = members, classes
        if classes is not None:
            rows = rows.join(classes, rows.id == classes.node, "left").drop("node").withColumn("component", F.coalesce("component", "id"))
            open_ = rows.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
            rows = staged(rows.join(open_, "key"), "open", total)
            if rows.isEmpty():
                discard(rows)
                break
        else:
            rows = rows.withColumn("component", F.col("id"))
        if step < CENTRE_ROUNDS:
            order = F.col("id") if step == 0 else F.xxhash64("id", F.lit(step))
            best = rows.groupBy("key").agg(F.min(order).alias("least"))
            hub = rows.join(best, "key").where(order == F.col("least")).groupBy("key").agg(F.min("id").alias("c"), F.min("component").alias("cc"), F.min("size").alias("cs"))
            pairs = rows.join(hub, "key").where("id != c and component != cc")
            if near:
                pairs = pairs.where(near(F.col("size"), F.col("cs")))
            pairs, most = pairs.select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b")), total
        else:
            pairs = search(rows)
            most = pairs.count()
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = staged(pairs, "pairs", most)
        discard(rows)
        count = pairs.count()
        new = verify(pairs, count)
        tested = pairs if tested is None else tested.union(pairs)
        if new.isEmpty() and links is not None:
            continue
        links = new if links is None else links.union(new)
        classes = staged(components(links, "a", "b"), "classes", 2 * links.count())
        discard(before)
    return classes
