"""Connected components of a link table by large-star and small-star contraction.

No link list or label table ever reaches the driver: each round is two aggregations that keep a minimum a node
(combined before the shuffle) and plain equi-joins, which adaptive execution can split when a node is a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockgrain.llm.common import staged


#: Links up to which a round is one task: a few numbers a row, and moving them costs more than reading them.
TASK_LINKS = 200_000


def _near(edges: DataFrame, links: int) -> DataFrame:
    """``edges`` in one partition if ``links``, their count, are few: then no step of a round shuffles."""
    return edges.coalesce(1) if links <= TASK_LINKS else edges


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over links (a, b) with a > b; returns such links again."""
    pairs = lambda *ends: F.explode(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ends])).alias("e")
    both = edges.select(pairs(("a", "b"), ("b", "a"))).select("e.*") if large else edges
    least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
    least = least.select("n", F.least("n", "m").alias("m"))
    joined = both.join(least, both.a == least.n)
    if large:  # every larger neighbour is hung under the least of the neighbourhood
        out = joined.where("b > n").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # every smaller neighbour, and the node itself
        out = joined.select(pairs(("b", "m"), ("n", "m"))).select("e.*")
    return out.where("a > b").distinct()


def components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): for each node with a link, the least node that it reaches.

    Null ends and self-links are ignored; repeated links count once; an empty table gives an empty table.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    edges = links.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).where(x.isNotNull() & y.isNotNull() & (x != y)).distinct()
    edges = staged(edges, "links")
    before, count = None, edges.count()
    for _ in range(max_rounds):
        edges = staged(_star(_star(_near(edges, count), True), False), "links")
        # a fixed point is reached when links and the sums of their ends stay the same
        now = tuple(edges.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before, count = now, now[0]
    else:
        raise RuntimeError("components did not settle")
    edges = _near(edges, count)
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return out.union(roots)
