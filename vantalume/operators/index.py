"""Indexing: inputs to validated records, embeddings, and inserts or upserts with job tracking."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_id, path_id
from ..sources import store as st
from ..sources.config import IndexSettings
from ..sources.frames import with_contents
from .jobs import Jobs, JobStatus
from .models import ENCODERS, HashEncoder, Loaded

RECORD = "pos bigint, path string, content binary, ts double, given string"


def records(spark: SparkSession, images: list | DataFrame, collection_id: str, ids: list[str] | None = None, timestamps: list[float] | None = None) -> DataFrame:
    """(pos, id, path, ts, content): given ids, if any, hold for all images; else paths get collection-scoped ids and contents get content ids.

    A DataFrame of images has pos and path or content, and maybe id and ts. Ids that repeat within the call, and given ids that are null,
    are refused.
    """
    given_ids = "id" in images.columns if isinstance(images, DataFrame) else ids is not None
    if ids is not None and not isinstance(images, DataFrame) and None in ids:
        raise ValueError("a given id is null")
    if isinstance(images, DataFrame):
        have = images.columns
        df = images.select("pos", *(F.col(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in (("path", "string"), ("content", "binary"), ("ts", "double"))), (F.col("id") if "id" in have else F.lit(None).cast("string")).alias("given"))
    else:
        for name, given in (("ids", ids), ("timestamps", timestamps)):
            if given is not None and len(given) != len(images):
                raise ValueError(f"{len(given)} {name} for {len(images)} images")
        rows = []
        for i, x in enumerate(images):
            if isinstance(x, (str, Path)):
                path, content = str(x), None
            elif isinstance(x, np.ndarray):
                path, content = "", str(x.shape).encode() + np.ascontiguousarray(x).tobytes()
            elif isinstance(x, (bytes, bytearray)):
                path, content = "", bytes(x)
            else:
                raise TypeError(f"image {i} must be a path, an array or bytes, not {type(x).__name__}")
            rows.append((i, path, content, float(timestamps[i]) if timestamps is not None else 0.0, ids[i] if ids is not None else None))
        df = spark.createDataFrame(rows, RECORD)
    own = F.when(F.col("content").isNotNull(), content_id(F.col("content"))).otherwise(path_id(collection_id, F.col("path")))
    ident = F.coalesce("given", F.raise_error(F.lit("a given id is null"))) if given_ids else own
    df = df.select("pos", ident.alias("id"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce("ts", F.lit(0.0)).alias("ts"), "content")
    dupes = repeated_ids(df)
    shown = dupes.orderBy("pos").limit(4).collect()
    if shown:
        n = dupes.count()
        raise ValueError(f"duplicate ids in one call: {[r['id'] for r in shown[:3]]}" + (f" (+{n - 3} more)" if n > 3 else ""))
    return df


def repeated_ids(df: DataFrame) -> DataFrame:
    """(id, pos) of each repeat of an id, after its first row. Counting comes first, so that few rows are ranked."""
    many = df.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first")).where("n > 1")
    return df.join(many, "id").where("pos > first").select("id", "pos")


class Indexer:
    """Embeds images and writes them to a store's collections, one for each collection id.

    The encoder may be a models.Loaded one, which travels as its settings and is made once in each worker. progress, if given, is called
    with the job's status after each commit.
    """

    def __init__(self, spark: SparkSession, encoder: HashEncoder, db_path: str, batch_size: int | None = None, progress: Callable[[JobStatus], None] | None = None) -> None:
        self.spark, self.encoder, self.store = spark, encoder, st.Store(spark, db_path)
        self.jobs, self.progress = Jobs(self.store), progress
        self.batch_size = encoder.batch_size if batch_size is None else batch_size

    @classmethod
    def from_config(cls, spark: SparkSession, path: str, encoder: str = "hash") -> Indexer:
        settings = IndexSettings.load(path)
        return cls(spark, Loaded.from_config(ENCODERS[encoder], path), settings.db_path, settings.batch_size)

    def embedded(self, rows: DataFrame, collection_id: str) -> DataFrame:
        """The collection's rows: the encoder sees batches of batch_size, one after the other in each task."""
        encoder, size = self.encoder, self.batch_size

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for i in range(0, len(b), size):
                    part = b.iloc[i : i + size]
                    yield pd.DataFrame({"id": part["id"], "collection_id": collection_id, "vector": list(np.asarray(encoder.embed_images(list(part["content"])), np.float32)), "path": part["path"], "timestamp": part["ts"]})

        return st.check_dim(rows.select("id", "path", "ts", "content").mapInPandas(run, st.COLLECTION), encoder.embedding_dim)

    def _run(self, rows: DataFrame, collection_id: str, job_id: str | None, write: Callable[[str, DataFrame], None], commit_every: int | None) -> JobStatus:
        total = rows.count()
        job = self.jobs.start(collection_id, total, job_id)
        step = commit_every or max(1, total)
        try:
            for start in range(0, total, step):
                part = rows.where((F.col("pos") >= start) & (F.col("pos") < start + step)) if commit_every else rows
                write(collection_id, self.embedded(with_contents(part), collection_id))
                job.advance(min(step, total - start))
                if self.progress is not None:
                    self.progress(job)
            job.finish()
        except Exception as e:
            job.fail(str(e))
            raise
        return job

    def insert(self, images: list | DataFrame, collection_id: str, *, ids: list[str] | None = None, timestamps: list[float] | None = None, job_id: str | None = None, commit_every: int | None = None) -> JobStatus:
        """Add rows; an id that the collection has is refused before anything is embedded or a job is registered.

        One commit by default; with commit_every=batch_size each batch is a commit of its own, and a failure leaves earlier ones.
        """
        rows = records(self.spark, images, collection_id, ids, timestamps)
        old = self.store.create(collection_id)
        if not old.isEmpty():
            found = st.conflicts(old, rows)
            sample = [r["id"] for r in found.orderBy("id").limit(3).collect()]
            if sample:
                raise ValueError(f"{found.count()} ids already exist in {collection_id!r}: {sample}")
        return self._run(rows, collection_id, job_id, self.store.append, commit_every)

    def update(self, images: list | DataFrame, collection_id: str, *, ids: list[str] | None = None, timestamps: list[float] | None = None, job_id: str | None = None, commit_every: int | None = None) -> JobStatus:
        """Replace rows of equal id, add the others."""
        rows = records(self.spark, images, collection_id, ids, timestamps)
        self.store.create(collection_id)
        return self._run(rows, collection_id, job_id, self.store.upsert, commit_every)
