"""Connected components of a distributed edge table by least-label hooking and pointer jumping; by union-find where there are few edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import hot_keys, salted_join, scratch, settle

#: So many edges at most, about 1 MB, are joined in one process: rounds over the cluster would take longer by far.
LOCAL_EDGES = 1 << 16


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), a settled table; root is the least node reachable.

    More than LOCAL_EDGES are joined in rounds, which give the same. Rounds go on until no label changes. A round aggregates neighbours' least labels (combined before the shuffle)
    and then jumps each label to its own label, so long chains halve. Labels are written out each round: nothing
    gathers on the driver but the count of changes. The edges of a hub, and the members of a giant component, are dealt over
    many tasks. Loops and null ends are dropped; no edges give no rows.
    """
    edges = edges.select("a", "b").where("a <> b")
    with scratch(edges.sparkSession):
        return _gathered(edges) if edges.count() <= LOCAL_EDGES else _spread(edges)


def _gathered(edges: DataFrame) -> DataFrame:
    found = edges.toArrow()
    kind = edges.schema["a"].dataType.simpleString()
    nodes, at = np.unique(np.concatenate([found.column(c).to_numpy() for c in ("a", "b")]), return_inverse=True)
    up = list(range(len(nodes)))
    for x, y in zip(at[: found.num_rows].tolist(), at[found.num_rows :].tolist(), strict=True):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        up[max(x, y)] = min(x, y)
    for x, over in enumerate(up):  # no node lies under a greater one
        up[x] = up[over]
    label = pa.table({"node": nodes, "root": nodes[np.array(up, np.int64)]})
    return settle(edges.sparkSession.createDataFrame(label, f"node {kind}, root {kind}"), "components", lasting=True)


def _spread(e: DataFrame) -> DataFrame:
    e = settle(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = settle(e.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "labels")
    hot = hot_keys(e, "b")
    changed = e.limit(1).count()
    while changed:
        near = salted_join(e, label.withColumnRenamed("node", "b"), "b", "a", hot=hot).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        hooked = label.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        hooked = settle(hooked, "labels")
        jump = hooked.select(F.col("node").alias("root"), F.col("root").alias("further"))
        following = settle(salted_join(hooked, jump, "root", "node").select("node", "was", F.col("further").alias("root")), "labels")
        changed = following.where("root <> was").limit(1).count()
        label = following.select("node", "root")
    return settle(label, "components", lasting=True)
