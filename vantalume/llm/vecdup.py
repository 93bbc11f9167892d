"""Near-duplicate vectors by an inverted multi-index.

Each half of the vectors has its own codebook (k-means on at most ``sample`` vectors); the codewords' product is a grid
of cells, and every vector is stored in the cell nearest to it. A vector is searched by a multi-sequence traversal: cells are
visited in order of how far, over both halves, the vector lies beyond the border of its nearest codeword's cell. Nearer cells hold more
of the partners that a vector may have at the threshold; the traversal stops when the share of them that it has passed, as estimated
from those distances, reaches a level. The level is the one at which ``recall`` of planted partners, displaced from the sample's
vectors to exactly the threshold, have been met. Either vector of a pair may find the other, so fewer than 1 - recall of
pairs at the threshold are missed, and fewer yet above it. Cells are visited inside the vector's label only. Candidates of a cell are
verified in double precision, in blocks of bounded size. No number of cells, candidates or partners is capped.

The grid grows as the vectors, MEAN a cell, up to sample / 4 codewords a half (2.7e8 cells for each label at the default; a larger
``sample`` carries it further).

Vectors that are equal in every component and label form one class first; classes are searched, and members are counted.

Defined cases: null, zero and mixed-up (null or non-finite components) vectors, and null labels, link with nothing and are
their own component; vectors of other lengths than the 64 most frequent ones are compared among themselves only, exactly by
length; rows that share an id are vectors of their own; input columns other than the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map, bounded_batches, partitions, record, salted_join, scratch, settle
from .components import components

COSINE, RECALL = 0.98, 0.999
SAMPLE, PLANTED = 65_536, 8_192
#: Vectors a cell, on average.
MEAN = 8
#: Cells whose border lies so many standard deviations of a partner's displacement away hold next to none of them (1e-9).
REACH = 6.0
BLOCK = 512


def _kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    r = np.random.default_rng(seed)
    centres = x[r.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = ((centres**2).sum(1)[None] - 2 * x @ centres.T).argmin(1)
        for j in range(len(centres)):
            own = x[near == j]
            centres[j] = own.mean(0) if len(own) else x[r.integers(len(x))]
    return centres


class Codebooks:
    """Two independent codebooks for the halves of unit vectors of one length, and the level at which a search stops."""

    def __init__(self, x: np.ndarray, k: int, cosine: float, recall: float) -> None:
        self.half = max(1, x.shape[1] // 2)
        self.books = [_kmeans(np.ascontiguousarray(h), k) for h in (x[:, : self.half], x[:, self.half :]) if h.shape[1]]
        self.k = max(len(b) for b in self.books)
        self.spread = float(np.sqrt(2 * (1 - cosine) / x.shape[1]))
        self.level = 1.0
        if x.shape[1] > 1:
            self.level = self._level(x, cosine, recall)

    def _level(self, x: np.ndarray, cosine: float, recall: float) -> float:
        """The share passed before its partner's cell is reached, of ``recall`` of planted partners."""
        r = np.random.default_rng(9)
        x = x[r.integers(len(x), size=PLANTED)]
        off = r.standard_normal(x.shape)
        off -= (off * x).sum(1, keepdims=True) * x
        off /= np.linalg.norm(off, axis=1, keepdims=True)
        home, _ = self.cells(cosine * x + np.sqrt(1 - cosine * cosine) * off)
        _, visits = self.cells(x, shares=True)
        passed = [share[at[0]] if len(at := np.flatnonzero(cells == h)) else 1.0 for h, (cells, share) in zip(home, visits, strict=True)]
        return float(np.quantile(passed, recall, method="higher"))

    def beyond(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Of each half: the nearest codeword, and the distance to each other codeword's border."""
        near, out = [], []
        for book, h in zip(self.books, (x[:, : self.half], x[:, self.half :]), strict=False):
            norms = (book**2).sum(1)
            d = norms[None] - 2 * h @ book.T
            best = d.argmin(1)
            gap = np.sqrt(np.maximum(norms[best][:, None] + norms[None] - 2 * book[best] @ book.T, 1e-30))
            b = (d - d[np.arange(len(d)), best][:, None]) / (2 * gap)
            b[np.arange(len(d)), best] = 0.0
            near.append(best)
            out.append(b)
        return near, out

    def cells(self, x: np.ndarray, shares: bool = False) -> tuple[np.ndarray, list]:
        """The home cell of each vector, and the cells it visits, nearest first; with shares, all in reach and what was passed before each."""
        homes, visits = [], []
        step = max(1, (1 << 22) // self.k)  # bounded memory, whatever the codebooks' size
        for i in range(0, len(x), step):
            near, out = self.beyond(x[i : i + step])
            if len(near) == 1:
                near, out = [near[0], np.zeros(len(near[0]), int)], [out[0], np.zeros((len(near[0]), 1))]
            homes.append(near[0] * self.k + near[1])
            for a, b in zip(*out, strict=True):
                cells, share = _multi_sequence(a / self.spread, b / self.spread, self.k)
                visits.append((cells, share) if shares else cells[share <= self.level])
        return np.concatenate(homes) if homes else np.empty(0, int), visits


def _multi_sequence(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells (i, j) in reach by rising a[i]^2 + b[j]^2, and the estimated share of partners that the cells before each hold."""
    ia, ib = (np.flatnonzero(z <= REACH) for z in (a, b))
    s = a[ia][:, None] ** 2 + b[ib][None] ** 2
    i, j = np.nonzero(s <= REACH * REACH)
    s = s[i, j]
    order = np.argsort(s, kind="stable")
    mass = np.exp(-0.5 * s[order])
    before = np.cumsum(mass) - mass
    return (ia[i] * k + ib[j])[order], before / mass.sum()


def _grid(n: int, sample: int) -> int:
    """Codewords a half: cells grow as the vectors."""
    return int(np.clip(round((n / MEAN) ** 0.5), 4, max(4, sample // 4)))


def _matrix(lists: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows, scaled by powers of two, which is exact."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def classes_of(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> tuple[DataFrame, DataFrame]:
    """rows (id, label, v), v being null where it links with nothing, and the classes (cid, id, label, v, copies) of equal ones."""
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(label).cast("string").alias("label"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scale = F.array_max(F.transform("v", lambda x: F.abs(x)))
    fit = F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad & (scale > 0)
    rows = settle(rows.withColumn("v", F.when(F.coalesce(fit, F.lit(False)), F.col("v"))), "vectors")
    # -0.0 equals 0.0
    plain = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    classes = plain.where("v is not null").groupBy("label", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    classes = settle(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    return plain, classes


def _searched(classes: DataFrame, cosine: float, sample: int, recall: float) -> DataFrame:
    """Rows (cid, n, other): link counts that a block found for cid, and an edge that connects it."""
    spark = classes.sparkSession
    sizes = {r["d"]: r["n"] for r in classes.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).limit(64).collect()}
    books = {}
    for d, n in sizes.items():
        part = classes.where(F.size("v") == d)
        if n > sample:
            part = part.where(F.pmod(F.xxhash64("v"), F.lit(1_000_000)) < int(1_000_000 * sample / n) + 1).limit(sample)
        books[d] = Codebooks(_unit(_matrix(part.select("v").toArrow().column(0))), _grid(n, sample), cosine, recall)
    shared = spark.sparkContext.broadcast(books)

    def place(b: pa.RecordBatch) -> pa.RecordBatch:
        n = b.num_rows
        home, visits, scaled = np.zeros(n, np.int64), [None] * n, [None] * n
        lengths = b.column(1).value_lengths().to_numpy()
        for d in np.unique(lengths):
            at = np.flatnonzero(lengths == d)
            x = _matrix(b.column(1).take(pa.array(at)))
            book = shared.value.get(int(d))
            cells, seen = book.cells(_unit(x)) if book is not None else (np.zeros(len(x), int), [np.zeros(1, int)] * len(x))
            for k, i in enumerate(at):
                home[i], visits[i], scaled[i] = (int(d) << 32) + cells[k], (int(d) << 32) + seen[k].astype(np.int64), x[k].tobytes()
        return record(cid=b.column(0), label=b.column(2), copies=b.column(3), home=home, visits=pa.array(visits, pa.list_(pa.int64())), scaled=pa.array(scaled, pa.binary()))

    placed = settle(arrow_map(classes.select("cid", "v", "label", "copies"), place, "cid bigint, label string, copies bigint, home bigint, visits array<bigint>, scaled binary"), "placed")
    probes = placed.select("cid", "label", F.explode("visits").alias("cell"))
    here = placed.groupBy("label", F.col("home").alias("cell")).agg(F.count(F.lit(1)).alias("stored"))
    asked = probes.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("asked"))
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK)).cast("int")
    cells = settle(here.join(asked, ["label", "cell"]).select("label", "cell", blocks("stored").alias("ns"), blocks("asked").alias("na")), "cells")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    slot = lambda c: F.pmod(F.xxhash64("cid"), F.col(c)).cast("int")
    wide = placed.select("cid", "label", "copies", "home", "visits", "scaled")
    stored = wide.withColumn("cell", F.col("home")).join(cells, ["label", "cell"]).select("label", "cell", slot("ns").alias("sb"), every("na").alias("ab"), F.lit(0).alias("probe"), "cid", "copies", "home", "visits", "scaled")
    asking = wide.withColumn("cell", F.explode("visits")).join(cells, ["label", "cell"]).select("label", "cell", every("ns").alias("sb"), slot("na").alias("ab"), F.lit(1).alias("probe"), "cid", "copies", "home", "visits", "scaled")
    dealt = stored.union(asking).repartition(partitions(spark), "label", "cell", "sb", "ab").sortWithinPartitions("label", "cell", "sb", "ab", "probe")

    def block(group: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(group)
        probe, cid, copies, home = (t.column(c).to_numpy() for c in ("probe", "cid", "copies", "home"))
        x = np.frombuffer(b"".join(t.column("scaled").to_pylist()), np.float64).reshape(len(cid), -1)
        norm = np.sqrt((x * x).sum(1))
        s, a = np.flatnonzero(probe == 0), np.flatnonzero(probe == 1)
        hit = (x[a] @ x[s].T / (norm[a][:, None] * norm[s][None]) >= cosine) & (cid[a][:, None] != cid[s][None])
        i, j = np.nonzero(hit)
        if not len(i):
            return record(cid=np.empty(0, np.int64), n=np.empty(0, np.int64), other=np.empty(0, np.int64))
        # does the stored vector's own search find this pair too?
        seen = t.column("visits").to_pylist()
        back = {k: set(seen[s[k]]) for k in np.unique(j)}
        alone = np.array([home[a[x]] not in back[y] for x, y in zip(i.tolist(), j.tolist(), strict=True)])
        n = np.bincount(i, copies[s[j]], minlength=len(a)).astype(np.int64)
        m = np.bincount(j[alone], copies[a[i[alone]]], minlength=len(s)).astype(np.int64)
        # a spanning forest of the block's links, as edges
        edge_a, edge_b = _forest(cid[a[i]], cid[s[j]])
        x, y = np.flatnonzero(n), np.flatnonzero(m)
        return record(cid=np.concatenate([cid[a[x]], cid[s[y]], edge_a]), n=np.concatenate([n[x], m[y], np.zeros(len(edge_a), np.int64)]), other=pa.array(np.concatenate([np.zeros(len(x) + len(y), np.int64), edge_b]), mask=np.arange(len(x) + len(y) + len(edge_a)) < len(x) + len(y)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for b in batches:
            if not b.num_rows:
                continue
            label = np.array(b.column(0).to_pylist(), object)
            k = np.stack([b.column(c).to_numpy() for c in (1, 2, 3)], 1)
            cut = (k[1:] != k[:-1]).any(1) | (label[1:] != label[:-1])
            at = [0, *(np.flatnonzero(cut) + 1).tolist(), len(k)]
            for i, j in zip(at, at[1:], strict=False):
                own = (label[i], *k[i].tolist())
                if held and own != key:
                    yield block(held)
                    held = []
                key = own
                held.append(b.slice(i, j - i))
        if held:
            yield block(held)

    bounded_batches(spark)
    return settle(dealt.mapInArrow(run, "cid bigint, n bigint, other bigint"), "found")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the pairs connect, one fewer than the nodes of each part: by least-label spreading."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def near_duplicates(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """Per row: vec_id, n_links (other vectors linked directly), component_id (least id reachable), kept."""
    with scratch(vectors.sparkSession):
        rows, classes = classes_of(vectors, vec_id, embedding, label)
        found = _searched(classes, cosine, sample, recall)
        root = components(found.where("other is not null").select(F.col("cid").alias("a"), F.col("other").alias("b")))
        counted = found.groupBy("cid").agg(F.sum("n").alias("n"))
        joined = settle(classes.join(counted, "cid", "left").join(root.withColumnRenamed("node", "cid"), "cid", "left"), "joined", lasting=True)
        rows = settle(rows.select("id", "label", "v"), "rows", lasting=True)
    least = joined.where("root is not null").groupBy("root").agg(F.min("id").alias("least"))
    joined = salted_join(joined, least, "root", "cid", "left").where("copies > 1 or root is not null").select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("least", "id").alias("component"))
    out = salted_join(rows, joined, ["label", "v"], "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(vec_id), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
