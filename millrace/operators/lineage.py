"""Experiments and the checkpoints that came of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import checkpoint_step
from millrace.session import materialize

#: Longest chain of checkpoints that is followed; a longer one is an error.
MAX_DEPTH = 1000


def summary(experiments: DataFrame) -> DataFrame:
    """The fields of an experiment that a summary shows."""
    names = {
        "experiment_id": "id", "name": "name", "timestamp": "timestamp", "parent_checkpoint": "parent", "training_steps": "steps", "tokens_processed": "tokens",
        "learning_rate": "lr", "batch_size": "batch", "training_loss": "train_loss", "validation_loss": "val_loss", "checkpoint_path": "checkpoint", "evaluation_scores": "scores",
    }
    return experiments.select(*[F.col(a).alias(b) for a, b in names.items()])


def roots(edges: DataFrame, parent: str = "parent_checkpoint", child: str = "checkpoint_path") -> DataFrame:
    """Parents that are nobody's child; if there are none, the least parent."""
    parents = edges.select(F.col(parent).alias("node")).where("node is not null").distinct()
    top = parents.join(edges.select(F.col(child).alias("node")), "node", "left_anti")
    fallback = parents.agg(F.min("node").alias("node")).where("node is not null")
    none = top.limit(1).agg(F.count("*").alias("n")).where("n = 0").select(F.lit(1).alias("__none"))
    return top.unionByName(fallback.join(F.broadcast(none)).select("node"))


def paths(edges: DataFrame, parent: str = "parent_checkpoint", child: str = "checkpoint_path") -> DataFrame:
    """node, root, depth and path of everything below a root. A node that a path already holds is not followed again."""
    step = edges.select(F.col(parent).alias("p"), F.col(child).alias("c")).where("p is not null and c is not null").distinct()
    level = roots(edges, parent, child).select("node", F.col("node").alias("root"), F.lit(0).alias("depth"), F.array("node").alias("path"))
    level = materialize(level, "level")
    out = level
    for _ in range(MAX_DEPTH):
        level = level.join(step, F.col("node") == F.col("p")).where(~F.array_contains("path", F.col("c")))
        level = materialize(level.select(F.col("c").alias("node"), "root", (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("c")).alias("path")), "level")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    else:
        if not level.join(step, F.col("node") == F.col("p")).where(~F.array_contains("path", F.col("c"))).isEmpty():
            raise RuntimeError(f"a chain of more than {MAX_DEPTH} checkpoints")
    return out


def latest(checkpoints: DataFrame, path: str, keep: int = 1) -> DataFrame:
    """The ``keep`` checkpoints with the highest step; names without a step are left out."""
    stepped = checkpoints.withColumn("step", checkpoint_step(path)).where("step >= 0")
    return stepped.orderBy(F.desc("step"), path).limit(keep)
