"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wayline.plans.storage import materialize

#: Contractions converge in a logarithmic number of rounds; reaching this means a fault, so it raises.
MAX_ROUNDS = 60


def connected_components(links: DataFrame) -> DataFrame:
    """``links``: (a, b) longs.  Returns (node, root): root is the smallest node reachable.

    Every node of a link occurs once in the result; nodes without links don't occur.
    Rows with a null end and loops are ignored.  Each round is two aggregations and
    two joins; a hub is reduced to its minimum before rows leave the map side, and a
    hub's links are the stream side of a join that adaptive execution can split.
    """
    edges = materialize(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    before = None
    for _ in range(MAX_ROUNDS):
        # Large star: each node's larger neighbours are tied to its smallest neighbour (or itself).
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: each node and its smaller neighbours are tied to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        edges = materialize(small, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
