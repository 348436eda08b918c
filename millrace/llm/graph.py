"""Connected components by minimum-edge contraction.

Borůvka's rounds as joins: every component picks its least outgoing edge, components joined by picked edges contract,
edges inside a component fall away. Each round at least halves the components that still have edges. The picked edges
are written to a table and form a spanning forest; nothing is gathered on the driver but counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import materialize

#: Far beyond what halving needs for any number of vertices.
MAX_ROUNDS = 64


def spanning_forest(edges: DataFrame, a: str = "a", b: str = "b") -> tuple[DataFrame, DataFrame]:
    """(vertex -> component, forest edges) of an undirected graph.

    ``component`` is one of the component's vertices. Loops and edges with a null end are left out, and so are
    vertices without an edge to another one; repeated edges count once. No edges give two empty tables.
    """
    low, high = F.least(a, b).alias("a"), F.greatest(a, b).alias("b")
    base = materialize(edges.where(f"`{a}` is not null and `{b}` is not null and `{a}` <> `{b}`").select(low, high).distinct(), "edges")
    label = materialize(base.select(F.explode(F.array("a", "b")).alias("vertex")).distinct().withColumn("component", F.col("vertex")), "labels")
    live = base.select("a", "b", F.col("a").alias("x"), F.col("b").alias("y"))
    forest = None
    for _ in range(MAX_ROUNDS):
        # Weights differ between edges, so that picked edges close no circle but that of two components picking one edge.
        weight = F.struct(F.xxhash64("a", "b").alias("h"), F.col("a"), F.col("b"))
        ends = F.explode(F.array(F.struct(F.col("x").alias("c"), F.col("y").alias("o")), F.struct(F.col("y").alias("c"), F.col("x").alias("o"))))
        picked = live.select(weight.alias("w"), ends.alias("e")).groupBy(F.col("e.c").alias("c")).agg(F.min(F.struct("w", F.col("e.o").alias("o"))).alias("m"))
        picked = materialize(picked.select("c", F.col("m.o").alias("parent"), F.col("m.w.a").alias("a"), F.col("m.w.b").alias("b")), "picked")
        if picked.isEmpty():
            break
        chosen = picked.select("a", "b").distinct()
        forest = chosen if forest is None else forest.unionByName(chosen)
        up = picked.select(F.col("c").alias("p"), F.col("parent").alias("pp"))
        tree = picked.select("c", "parent").join(up, F.col("parent") == F.col("p"), "left")
        two = (F.col("pp") == F.col("c")) & (F.col("c") < F.col("parent"))
        tree = materialize(tree.select("c", F.when(two, F.col("c")).otherwise(F.col("parent")).alias("parent")), "tree")
        for _ in range(MAX_ROUNDS):
            up = tree.select(F.col("c").alias("p"), F.col("parent").alias("pp"))
            jumped = tree.join(up, F.col("parent") == F.col("p"), "left").select("c", F.coalesce("pp", "parent").alias("parent"), (F.coalesce("pp", "parent") != F.col("parent")).alias("moved"))
            jumped = materialize(jumped, "jump")
            moved = not jumped.where("moved").isEmpty()
            tree = jumped.select("c", "parent")
            if not moved:
                break
        root = tree.select(F.col("c").alias("k"), F.col("parent").alias("root"))
        label = materialize(label.join(root, F.col("component") == F.col("k"), "left").select("vertex", F.coalesce("root", "component").alias("component")), "labels")
        left = live.join(root, F.col("x") == F.col("k"), "left").select("a", "b", F.coalesce("root", "x").alias("x"), "y")
        live = left.join(root, F.col("y") == F.col("k"), "left").select("a", "b", "x", F.coalesce("root", "y").alias("y")).where("x <> y")
        live = materialize(live, "live")
    return label, base.limit(0) if forest is None else forest
