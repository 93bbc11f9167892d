"""Exact nearest neighbours, and the search cascade: embed, retrieve, detect, re-rank.

A step takes a state and returns a copy with one field more; steps join with ``|``. Retrieved and later fields are lazy
DataFrames whose order is a column (``retrieval_rank``), never an accident of partitions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as vec
from ..sources.frames import read_images
from ..sources.store import Store
from .images import to_rgb
from .models import DETECTORS, ENCODERS, Loaded

DETECTION = "detection_score double, boxes array<array<float>>, scores array<float>, masks array<struct<h:int,w:int,bits:binary>>, labels array<string>"
#: Query vectors sent to every task of a batch search at once.
QUERY_BLOCK = 1_000
#: Retrieved rows that the driver holds at most.
MOST_HELD = 10_000


def knn(df: DataFrame, query: Sequence[float] | Column, k: int, metric: str = "l2", *, vector: str = "vector", ident: str = "id") -> DataFrame:
    """The k nearest rows with ``distance``; ties go to the lesser id, rows without a vector come last. Each task keeps k rows, the driver merges those: no shuffle."""
    if k < 0:
        raise ValueError("k is negative")
    return df.withColumn("distance", vec.METRICS[metric](F.col(vector), vec.vector(query))).orderBy(F.asc_nulls_last("distance"), ident).limit(k)


def knn_batch(df: DataFrame, queries: DataFrame, k: int, metric: str = "l2", *, vector: str = "vector", ident: str = "id", query_id: str = "query_id", query: str = "query") -> DataFrame:
    """The k nearest rows of every query: (query_id, id, distance, rank).

    A block of at most QUERY_BLOCK queries goes to every task as a matrix; each Arrow batch of rows is one matrix product with it, and
    gives at most k rows a query, whose distances are then computed term by term. The shuffle moves these alone. Rows and queries
    without a vector, or of another length than the block's first query, are in no result.
    """
    if k < 0:
        raise ValueError("k is negative")
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    out = None
    kinds = queries.schema[query_id].dataType.simpleString(), df.schema[ident].dataType.simpleString()
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == b)
        held = part.where(F.col(query).isNotNull()).select(query_id, F.col(query).cast("array<double>")).toArrow()  # QUERY_BLOCK rows, about
        near = df.select(ident, F.col(vector).cast("array<double>").alias("v")).mapInArrow(_nearest(held, k, metric), f"q {kinds[0]}, id {kinds[1]}, distance double")
        near = near.select(F.col("q").alias(query_id), F.col("id").alias(ident), "distance")
        ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy("distance", ident))).where(F.col("rank") <= k)
        out = ranked if out is None else out.union(ranked)
    return out


def _nearest(held: pa.Table, k: int, metric: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (id, v): of each batch the k nearest rows of every query (id, vector) in held."""
    held = held.combine_chunks()

    def matrix(lists: pa.ListArray) -> np.ndarray:
        return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held.num_rows or not k:
            return
        ids, lists = (held.column(c).chunk(0) for c in (0, 1))
        length = len(lists[0])
        same = pc.equal(pc.list_value_length(lists), length)
        ids, q = ids.filter(same), matrix(lists.filter(same))
        sizes = (q * q).sum(1)
        for b in batches:
            own = b.filter(pc.fill_null(pc.equal(pc.list_value_length(b.column(1)), length), False))
            if not own.num_rows:
                continue
            x = matrix(own.column(1))
            norms = (x * x).sum(1)
            dots = q @ x.T
            rough = vec.ROUGH[metric](dots, sizes[:, None], norms[None])
            most = min(k, len(x))
            edge = np.partition(rough, most - 1, axis=1)[:, most - 1]
            # rounding can't take a near row beyond this
            slack = 1e-9 * (1 + np.abs(edge) + (sizes + norms.max() if metric != "cosine" else 0))
            i, j = np.nonzero(~(rough > (edge + slack)[:, None]))
            exact = vec.EXACT[metric](x[j], q[i])
            order = np.lexsort((pc.rank(own.column(0).take(pa.array(j)), tiebreaker="min").to_numpy(), exact, i))
            i, j, exact = i[order], j[order], exact[order]
            first = np.searchsorted(i, i)
            kept = np.arange(len(i)) - first < k
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(i[kept])), own.column(0).take(pa.array(j[kept])), pa.array(exact[kept])], names=["q", "id", "distance"])

    return run


def cosine_documents(df: DataFrame, query: Sequence[float] | Column, k: int = 5, *, extra: Sequence[str] = ()) -> DataFrame:
    """(page_content, metadata) of the k nearest rows by cosine distance, which metadata holds raw."""
    found = knn(df, query, k, "cosine")
    return found.select(F.col("path").alias("page_content"), F.struct(F.col("timestamp").alias("ts"), "distance", *extra).alias("metadata"))


@dataclass(frozen=True)
class SearchState:
    query: str
    collection_id: str
    top_k_retrieve: int = 20
    top_k_final: int = 5
    query_embedding: np.ndarray | None = None
    retrieved: DataFrame | None = None
    detected: DataFrame | None = None
    results: DataFrame | None = None


class Step:
    def invoke(self, state: SearchState, config: dict | None = None, **kw: object) -> SearchState:
        raise NotImplementedError

    def __or__(self, other: Step) -> Chain:
        return Chain(self, other)


class Chain(Step):
    """Steps in a row; any prefix works, later fields stay None."""

    def __init__(self, *steps: Step) -> None:
        self.steps = [s for x in steps for s in (x.steps if isinstance(x, Chain) else [x])]

    def invoke(self, state: SearchState, config: dict | None = None, **kw: object) -> SearchState:
        for s in self.steps:
            state = s.invoke(state, config)
        return state


class EmbedQuery(Step):
    def __init__(self, encoder) -> None:
        self.encoder = encoder

    def invoke(self, state: SearchState, config: dict | None = None, **kw: object) -> SearchState:
        if not state.query:
            raise ValueError("the state has no query")
        return replace(state, query_embedding=np.asarray(self.encoder.embed_text(state.query)))


class Retrieve(Step):
    """Nearest rows of the collection: id, path, similarity_score (1 - squared L2 / 2), retrieval_rank, timestamp."""

    def __init__(self, store: Store) -> None:
        self.store = store

    def invoke(self, state: SearchState, config: dict | None = None, **kw: object) -> SearchState:
        if state.query_embedding is None:
            raise ValueError("the state has no query embedding")
        rows = self.store.open(state.collection_id)
        hits = knn(rows, state.query_embedding.tolist(), state.top_k_retrieve)
        # at most top_k_retrieve rows are ranked
        rank = F.row_number().over(Window.orderBy("distance", "id"))
        hits = hits.select("id", "path", vec.similarity(F.col("distance")).alias("similarity_score"), rank.alias("retrieval_rank"), "timestamp")
        if state.top_k_retrieve <= MOST_HELD:  # later steps use the rows several times; the collection is searched once
            hits = self.store.spark.createDataFrame(hits.collect(), hits.schema)
        return replace(state, retrieved=hits)


def max_score(scores: Column) -> Column:
    """The greatest score, 0 without any; not-a-number counts as 0."""
    clean = F.transform(scores, lambda s: F.coalesce(F.nanvl(s.cast("double"), F.lit(0.0)), F.lit(0.0)))
    return F.coalesce(F.array_max(clean), F.lit(0.0))


def detect(hits: DataFrame, detector, text: str, image: str = "image") -> DataFrame:
    """hits with the detector's output for each row's image and one text. Rows without detections stay, with score 0."""
    kept = [f for f in hits.schema.fields if f.name != image]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), DETECTION])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for x in b[image]:
                out = detector.invoke({"image": to_rgb(x), "text": text})
                scores = [float(s) for s in np.asarray(out["scores"], float).ravel()]
                masks = [np.asarray(m, bool) for m in out["masks"]] if out.get("masks") is not None else None
                labels = out.get("labels")
                rows.append({"detection_score": max([0.0 if s != s else s for s in scores], default=0.0), "boxes": [[float(v) for v in box] for box in out["boxes"]], "scores": scores, "masks": None if masks is None else [{"h": m.shape[0], "w": m.shape[1], "bits": np.packbits(m).tobytes()} for m in masks], "labels": None if labels is None else [str(x) for x in labels]})
            yield pd.concat([b.drop(columns=[image]).reset_index(drop=True), pd.DataFrame(rows, columns=["detection_score", "boxes", "scores", "masks", "labels"])], axis=1)

    return hits.mapInPandas(run, schema)


def thresholded(detections: DataFrame, score: str, label: str, label_score: str, box_threshold: float = 0.35, text_threshold: float = 0.25) -> DataFrame:
    """Detections that score above box_threshold; labels that don't score above text_threshold are null."""
    return detections.where(F.col(score) > box_threshold).withColumn(label, F.when(F.col(label_score) > text_threshold, F.col(label)))


class Detect(Step):
    """Runs a detector on the image of every hit; images are read late, for these rows only."""

    def __init__(self, detector, spark: SparkSession, on_missing: str = "fail") -> None:
        if on_missing not in ("fail", "null"):
            raise ValueError("on_missing is fail or null")
        self.detector, self.spark, self.on_missing = detector, spark, on_missing

    def invoke(self, state: SearchState, config: dict | None = None, **kw: object) -> SearchState:
        if state.retrieved is None:
            raise ValueError("the state has no retrieved rows")
        hits = state.retrieved
        paths = [r["path"] for r in hits.select("path").collect()]  # top_k_retrieve at most
        if not paths:
            return replace(state, detected=detect(hits.withColumn("image", F.lit(None).cast("binary")), self.detector, state.query))
        there = self._existing(paths)
        if self.on_missing == "fail" and len(there) < len(set(paths)):
            raise FileNotFoundError(f"no image at {sorted(set(paths) - set(there))[:3]}")
        if there:
            files = {origin: p for p, origin in there.items()}  # one file may be named in several ways
            images = read_images(self.spark, *files.values(), pattern="*").withColumnRenamed("path", "__origin")
            origins = self.spark.createDataFrame(list(there.items()), "path string, __origin string")
            joined = hits.join(F.broadcast(origins), "path", "left").join(images, "__origin", "left").drop("__origin").where("image is not null or path is not null")
            if self.on_missing == "fail":
                joined = joined.withColumn("image", F.coalesce("image", F.raise_error(F.concat(F.lit("no image can be read from "), "path"))))
        else:
            joined = hits.withColumn("image", F.lit(None).cast("binary"))
        found, lost = joined if self.on_missing == "fail" else joined.where("image is not null"), joined.where("image is null").drop("image")
        out = detect(found, self.detector, state.query)
        if self.on_missing == "null":
            cols = [F.lit(None).cast(out.schema[c].dataType).alias(c) for c in ("boxes", "scores", "masks", "labels")]
            out = out.unionByName(lost.select("*", F.lit(0.0).alias("detection_score"), *cols))
        return replace(state, detected=out)

    def _existing(self, paths: list[str]) -> dict[str, str]:
        """The paths that exist, with their origins as the image source names them."""
        out = {}
        for p in dict.fromkeys(x for x in paths if x):
            q = self.spark._jvm.org.apache.hadoop.fs.Path(p)
            fs = q.getFileSystem(self.spark._jsc.hadoopConfiguration())
            if fs.exists(q):
                out[p] = re.sub("^file:/+", "/", fs.makeQualified(q).toUri().toString())
        return out


def rerank(detected: DataFrame, k: int, score: Column | str = "detection_score") -> DataFrame:
    """The k rows of greatest score; equal ones keep their retrieval order. Scores aren't blended with similarity."""
    c = F.col(score) if isinstance(score, str) else score
    return detected.orderBy(F.desc(F.nanvl(c.cast("double"), F.lit(0.0))), "retrieval_rank").limit(k)


class Rerank(Step):
    def __init__(self, score: Column | str = "detection_score") -> None:
        self.score = score

    def invoke(self, state: SearchState, config: dict | None = None, **kw: object) -> SearchState:
        if state.detected is None:
            raise ValueError("the state has no detected rows")
        return replace(state, results=rerank(state.detected, state.top_k_final, self.score))


class Search(Step):
    """The whole cascade. The costly detector sees the retrieved rows only."""

    def __init__(self, encoder, detector, store: Store, on_missing: str = "fail") -> None:
        self.embed, self.retrieve, self.detect, self.rerank = EmbedQuery(encoder), Retrieve(store), Detect(detector, store.spark, on_missing), Rerank()
        self.chain = self.embed | self.retrieve | self.detect | self.rerank

    @classmethod
    def from_config(cls, spark: SparkSession, path: str, *, encoder: str = "hash", detector: str = "region") -> Search:
        from ..sources.config import IndexSettings

        if detector not in DETECTORS:
            raise ValueError(f"unknown detector {detector!r}; known are {sorted(DETECTORS)}")
        return cls(ENCODERS[encoder].from_config(path), Loaded.from_config(DETECTORS[detector], path), Store(spark, IndexSettings.load(path).db_path))

    def invoke(self, state: SearchState | None = None, config: dict | None = None, *, query: str | None = None, collection_id: str | None = None, top_k_retrieve: int = 20, top_k_final: int = 5, **kw: object) -> SearchState:
        if state is None:
            if query is None or collection_id is None:
                raise ValueError("a state, or a query and a collection id, is needed")
            state = SearchState(query, collection_id, top_k_retrieve, top_k_final)
        return self.chain.invoke(state)
