"""Connected components of a link table by alternating large-star and small-star steps (Kiveris et al., 2014).

Each step is a grouped minimum and a join on the node, so a node with many links is pre-aggregated and its
links are split over tasks; every round is written to the shared folder, which ends its lineage. As soon as no more than
LOCAL_LINKS links are left, or from the start, one task ends the work: they take 16 bytes each, and a round of small
tables costs a dozen jobs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written
from .workers import tidy

MAX_ROUNDS = 60
#: Links that one task may join (32 MB).
LOCAL_LINKS = 2_000_000


@tidy
def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all links (u, v) at once: labels fall to those of neighbours, and to their labels' labels, until none does."""
    held = list(batches)
    columns = [[b.column(i).to_numpy() for b in held] for i in (0, 1)]
    if not columns[0]:
        return
    u, v = (np.concatenate(c) for c in columns)
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        moved = label.copy()
        # Roots of both ends fall, too, so that long chains join in few rounds.
        for at in (u, v, label[u], label[v]):
            np.minimum.at(moved, at, low)
        while not np.array_equal(moved, further := moved[moved]):
            moved = further
        if np.array_equal(moved, label):
            break
        label = moved
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "root"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, local_links: int = LOCAL_LINKS) -> DataFrame:
    """(node, root) of every node that links (u, v) name: root is the least node of its component."""
    edges = written(links.where("u <> v").select("u", "v"), "links")
    state = None
    for _ in range(MAX_ROUNDS):
        if edges.count() <= local_links:
            return edges.coalesce(1).mapInArrow(_joined, "node long, root long")
        edges = written(_small_star(_large_star(edges)), "links")
        if state == (state := _state(edges)):
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
