"""The engine's operators as queries over the driver's tables, each with the SQL it must agree with."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vec
from ..operators import annotate, images, index, jobs, masks, models, search
from ..sources import config, frames, store
from ..sources.paths import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _probe(df: DataFrame) -> list[float]:
    """The query vector: that of id 0."""
    return [float(x) for x in df.where("id = 0").first()["vector"]]


_Q = "q AS (SELECT cast(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0), v AS (SELECT vec_id, label, cast(embedding AS DOUBLE[]) AS e FROM embeddings)"


@_query(f"WITH {_Q} SELECT vec_id AS id, round(list_distance(e, q) ** 2, 6) AS distance, round(1e0 - list_distance(e, q) ** 2 / 2, 6) AS similarity FROM v, q ORDER BY list_distance(e, q) ** 2, vec_id LIMIT 10")
def knn_l2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _vectors(spark, sf_dir)
    return search.knn(df, _probe(df), 10).select("id", F.round("distance", 6).alias("distance"), F.round(vec.similarity(F.col("distance")), 6).alias("similarity"))


@_query(f"WITH {_Q} SELECT vec_id AS id, round(1e0 - list_cosine_similarity(e, q), 6) AS distance FROM v, q ORDER BY 1e0 - list_cosine_similarity(e, q), vec_id LIMIT 20")
def knn_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _vectors(spark, sf_dir)
    return search.knn(df, _probe(df), 20, "cosine").select("id", F.round("distance", 6).alias("distance"))


@_query("""WITH v AS (SELECT vec_id, cast(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_distance(v.e, q.e) ** 2 AS d FROM v, v q WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM p) SELECT query_id, id, round(d, 6) AS distance, cast(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def knn_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 100 against all rows: the queries grow with the table."""
    df = _vectors(spark, sf_dir)
    queries = df.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    return search.knn_batch(df, queries, 5).select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


@_query(f"WITH {_Q}, r AS (SELECT label, vec_id AS id, list_distance(e, q) ** 2 AS d, row_number() OVER (PARTITION BY label ORDER BY list_distance(e, q) ** 2, vec_id) AS rank FROM v, q) SELECT label, id, round(d, 6) AS distance, cast(rank AS INTEGER) AS rank FROM r WHERE rank <= 3")
def knn_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label is a collection of its own."""
    df = _vectors(spark, sf_dir)
    near = df.withColumn("distance", vec.sq_l2(F.col("vector"), vec.vector(_probe(df))))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("distance", "id"))).where("rank <= 3")
    return ranked.select("label", "id", F.round("distance", 6).alias("distance"), "rank")


@_query("SELECT vec_id, unnest(range(0, len(embedding))) AS pos, round(unnest(list_transform(e3, lambda x: x / n)), 6) AS x FROM (SELECT vec_id, embedding, e3, sqrt(list_sum(list_transform(e3, lambda x: x * x))) AS n FROM (SELECT vec_id, embedding, list_transform(cast(embedding AS DOUBLE[]), lambda x: x * 3e0) AS e3 FROM embeddings))")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    tripled = F.transform("vector", lambda x: x.cast("double") * 3.0)
    unit = _vectors(spark, sf_dir).select(F.col("id").alias("vec_id"), vec.normalize(tripled).alias("u"))
    return unit.select("vec_id", F.posexplode("u").alias("p", "x")).select("vec_id", F.col("p").cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


@_query(f"WITH {_Q} SELECT vec_id AS id, round(list_inner_product(e, q), 6) AS dot, round(list_distance(e, q), 6) AS l2, round(list_cosine_similarity(e, q), 6) AS cosine FROM v, q")
def metric_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _vectors(spark, sf_dir)
    v, q = F.col("vector"), vec.vector(_probe(df))
    return df.select("id", F.round(vec.dot(v, q), 6).alias("dot"), F.round(vec.l2(v, q), 6).alias("l2"), F.round(vec.cosine_similarity(v, q), 6).alias("cosine"))


@_query(f"WITH {_Q}, d AS (SELECT vec_id, list_cosine_similarity(e, q) AS s, label FROM v, q ORDER BY 1e0 - list_cosine_similarity(e, q), vec_id LIMIT 5) SELECT 'img/' || vec_id AS page_content, cast(label AS DOUBLE) AS ts, round(1e0 - s, 6) AS distance FROM d")
def cosine_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _vectors(spark, sf_dir).withColumns({"path": F.concat(F.lit("img/"), F.col("id").cast("string")), "timestamp": F.col("label").cast("double")})
    return search.cosine_documents(df, _probe(df), 5).select("page_content", F.col("metadata.ts").alias("ts"), F.round("metadata.distance", 6).alias("distance"))


@_query("SELECT doc_id, sha1(source || ':' || doc_id) AS id, sha1(text) AS content FROM documents")
def id_sha1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", tx.path_id(F.col("source"), F.col("doc_id").cast("string")).alias("id"), tx.content_id(F.col("text").cast("binary")).alias("content"))


_HALVES = "old AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS v FROM customer WHERE c_custkey % 3 <> 0), fresh AS (SELECT c_custkey AS id, c_name || '!' AS name, c_acctbal + 1 AS v FROM customer WHERE c_custkey % 2 = 0)"


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("v"))
    return c.where("id % 3 <> 0"), c.where("id % 2 = 0").select("id", F.concat("name", F.lit("!")).alias("name"), (F.col("v") + 1).alias("v"))


@_query(f"WITH {_HALVES} SELECT id FROM fresh WHERE id IN (SELECT id FROM old)")
def insert_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.conflicts(*_halves(spark, sf_dir))


@_query(f"WITH {_HALVES} SELECT count(*) AS n, list_aggregate(list_sort(list(id))[1:3], 'string_agg', ',') AS sample FROM fresh WHERE id IN (SELECT id FROM old)")
def conflict_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = store.conflicts(*_halves(spark, sf_dir))
    first = found.orderBy("id").limit(3).agg(F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",").alias("sample"))
    return found.agg(F.count(F.lit(1)).alias("n")).crossJoin(first)  # one row each


@_query(f"WITH {_HALVES} SELECT * FROM old WHERE id NOT IN (SELECT id FROM fresh) UNION ALL SELECT * FROM fresh")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.merged(*_halves(spark, sf_dir))


@_query("WITH h AS (SELECT sha1(text) AS id, doc_id AS pos FROM documents) SELECT id, pos FROM (SELECT *, min(pos) OVER (PARTITION BY id) AS first FROM h) WHERE pos > first")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.repeated_ids(_t(spark, sf_dir, "documents").select(F.sha1(F.col("text").cast("binary")).alias("id"), F.col("doc_id").alias("pos")))


@_query("SELECT o_orderkey, coalesce(max(l_discount), 0) AS detection_score, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def detect_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are hits, their lines detections; an order without lines scores 0."""
    lines = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_discount").alias("scores"))
    joined = _t(spark, sf_dir, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", search.max_score(F.col("scores")).alias("detection_score"), F.coalesce(F.size(F.coalesce("scores", F.array().cast("array<double>"))), F.lit(0)).cast("bigint").alias("n"))


@_query("WITH d AS (SELECT l_orderkey AS id, max(l_discount) AS detection_score, min(l_extendedprice) AS p FROM lineitem GROUP BY l_orderkey) SELECT id, detection_score FROM d ORDER BY detection_score DESC, id LIMIT 10")
def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("retrieval_rank")).agg(F.max("l_discount").alias("detection_score"))
    return search.rerank(d, 10).select(F.col("retrieval_rank").alias("id"), "detection_score")


@_query(f"""WITH {_Q}, h AS (SELECT vec_id AS id, list_distance(e, q) ** 2 AS d, row_number() OVER (ORDER BY list_distance(e, q) ** 2, vec_id) AS rank FROM v, q),
    s AS (SELECT id, d, rank, coalesce(max(l_discount), 0) AS score FROM h LEFT JOIN lineitem ON l_orderkey = id WHERE rank <= 20 GROUP BY id, d, rank)
    SELECT id, round(1e0 - d / 2, 6) AS similarity_score, score AS detection_score, cast(rank AS INTEGER) AS retrieval_rank FROM s ORDER BY score DESC, rank LIMIT 5""")
def search_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest 20, scored by the lines of the order of the same number, the best 5 of them."""
    df = _vectors(spark, sf_dir)
    hits = search.knn(df.select("id", "vector"), _probe(df), 20)
    hits = hits.select("id", vec.similarity(F.col("distance")).alias("similarity_score"), F.row_number().over(Window.orderBy("distance", "id")).alias("retrieval_rank"))
    # 20 hits go to the lines, not the lines to the hits
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_discount").join(F.broadcast(hits.select("id")), "id", "left_semi").groupBy("id").agg(F.collect_list("l_discount").alias("scores"))
    scored = hits.join(lines, "id", "left").withColumn("detection_score", search.max_score(F.coalesce("scores", F.array().cast("array<double>"))))
    return search.rerank(scored, 5).select("id", F.round("similarity_score", 6).alias("similarity_score"), "detection_score", "retrieval_rank")


@_query("SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0.04 THEN l_returnflag END AS label FROM lineitem WHERE l_discount > 0.05")
def threshold_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = search.thresholded(_t(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "label"), "l_discount", "label", "l_tax", 0.05, 0.04)
    return kept.select("l_orderkey", "l_linenumber", "label")


@_query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity / 50e0 > 0.88e0 AND 1e0 - l_tax > 0.95e0")
def mask_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50.0).alias("pred_iou"), (F.lit(1.0) - F.col("l_tax")).alias("stability"))
    return masks.of_quality(lines).select("l_orderkey", "l_linenumber")


# Every part is a rectangular mask of a 32 x 32 image; five parts share an image, and some masks are empty.
_PIXELS = """m AS (SELECT p_partkey // 5 AS image_id, p_partkey % 5 AS mask_idx, p_partkey * 7 % 24 AS x0, p_partkey * 5 % 24 AS y0, p_size % 9 AS mw, (p_size + p_partkey) % 8 AS mh FROM part),
    px AS (SELECT image_id, mask_idx, x, y FROM (SELECT image_id, mask_idx, y0, mh, unnest(range(x0, x0 + mw)) AS x FROM m), (SELECT unnest(range(0, 40)) AS y) t WHERE y >= y0 AND y < y0 + mh),
    a AS (SELECT image_id, mask_idx, count(*) AS n_px, avg(cast(x AS DOUBLE)) AS cx, avg(cast(y AS DOUBLE)) AS cy, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM px GROUP BY image_id, mask_idx),
    s AS (SELECT *, cast(n_px AS DOUBLE) / 1024e0 * (1e0 - sqrt((cx - 16) * (cx - 16) + (cy - 16) * (cy - 16)) / sqrt(512e0)) AS score FROM a),
    b AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, mask_idx DESC) - 1 AS j FROM s)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part").select((F.col("p_partkey") / 5).cast("bigint").alias("image_id"), (F.col("p_partkey") % 5).alias("mask_idx"), (F.col("p_partkey") * 7 % 24).alias("l"), (F.col("p_partkey") * 5 % 24).alias("t"), (F.col("p_size") % 9).alias("mw"), ((F.col("p_size") + F.col("p_partkey")) % 8).alias("mh"))
    part = part.where("mw > 0 and mh > 0")
    pixels = part.select("image_id", "mask_idx", "t", "mh", F.explode(F.sequence(F.col("l"), F.col("l") + F.col("mw") - 1)).alias("x")).select("image_id", "mask_idx", "x", F.explode(F.sequence(F.col("t"), F.col("t") + F.col("mh") - 1)).alias("y"))
    return masks.measured(pixels).withColumns({"w": F.lit(32).cast("bigint"), "h": F.lit(32).cast("bigint")}).withColumn("score", masks.mask_score(F.col("n_px"), F.col("cx"), F.col("cy"), F.col("w"), F.col("h")))


@_query(f"WITH {_PIXELS} SELECT image_id, mask_idx, n_px, round(cx, 6) AS cx, round(cy, 6) AS cy, round(score, 6) AS score, x0, y0, x1, y1 FROM s")
def mask_score_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("image_id", "mask_idx", "n_px", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), F.round("score", 6).alias("score"), "x0", "y0", "x1", "y1")


@_query(f"WITH {_PIXELS} SELECT image_id, mask_idx, j, round(score, 6) AS score FROM b WHERE j < 2")
def mask_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.best(_scored(spark, sf_dir), 2).select("image_id", "mask_idx", F.col("j").cast("bigint").alias("j"), F.round("score", 6).alias("score"))


@_query(f"""WITH {_PIXELS}, c AS (SELECT image_id, mask_idx, greatest(0, x0 - greatest(1, cast(floor((x1 - x0) * 0.1e0) AS INTEGER))) AS bx0, greatest(0, y0 - greatest(1, cast(floor((y1 - y0) * 0.1e0) AS INTEGER))) AS by0,
    least(32, x1 + greatest(1, cast(floor((x1 - x0) * 0.1e0) AS INTEGER))) AS bx1, least(32, y1 + greatest(1, cast(floor((y1 - y0) * 0.1e0) AS INTEGER))) AS by1 FROM b WHERE j = 0)
    SELECT *, greatest(bx1 - bx0, by1 - by0) AS side, (greatest(bx1 - bx0, by1 - by0) - (bx1 - bx0)) // 2 AS pad_left, (greatest(bx1 - bx0, by1 - by0) - (by1 - by0)) // 2 AS pad_top FROM c""")
def crop_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = masks.crops(masks.best(_scored(spark, sf_dir), 1), 0.1)
    return c.select("image_id", "mask_idx", *(F.col(f"box.{k}").alias(f"b{k}") for k in ("x0", "y0", "x1", "y1")), F.col("square.side").alias("side"), F.col("square.left").cast("bigint").alias("pad_left"), F.col("square.top").cast("bigint").alias("pad_top"))


@_query(f"WITH {_PIXELS}, i AS (SELECT DISTINCT p_partkey // 5 AS image_id FROM part) SELECT i.image_id, b.mask_idx, coalesce(b.j, 0) AS j, b.j IS NULL AS is_fallback FROM i LEFT JOIN (SELECT * FROM b WHERE j < 1) b USING (image_id)")
def mask_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _t(spark, sf_dir, "part").select((F.col("p_partkey") / 5).cast("bigint").alias("image_id")).distinct()
    return masks.with_fallback(images, masks.best(_scored(spark, sf_dir), 1)).select("image_id", "mask_idx", F.col("j").cast("bigint").alias("j"), "is_fallback")


@_query("SELECT p_partkey, x, CASE WHEN x < p_size % 16 THEN p_partkey % 256 ELSE 128 END AS gray, CASE WHEN x < p_size % 16 THEN p_partkey % 256 ELSE 0 END AS black, x * 16 > 127 AS bit FROM part, (SELECT unnest(range(0, 16)) AS x) t")
def background_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of one line of 16 pixels, of which a mask keeps the first ones."""
    fills = {name: images.ObjectExtractor(None, background=name) for name in ("gray", "black")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = np.arange(16)
        bit = models.to_mask({"height": 1, "width": 16, "nChannels": 1, "data": bytes((16 * x).tolist())})[0]
        for b in batches:
            lines: dict[str, list] = {name: [] for name in fills}
            for k, size in zip(b["p_partkey"], b["p_size"], strict=True):
                image, mask = np.full((1, 16, 3), k % 256, np.uint8), (x < size % 16)[None]
                for name, f in fills.items():
                    lines[name].append(f.fill(image, mask)[0, :, 0])
            level = {name: np.concatenate(v).astype(np.int64) if v else np.empty(0, np.int64) for name, v in lines.items()}
            yield pd.DataFrame({"p_partkey": np.repeat(b["p_partkey"].to_numpy(), 16), "x": np.tile(x, len(b)), **level, "bit": np.tile(bit, len(b))})

    return _t(spark, sf_dir, "part").select("p_partkey", "p_size").mapInPandas(run, "p_partkey bigint, x bigint, gray bigint, black bigint, bit boolean")


_CELLS = "i AS (SELECT p_partkey AS k, bit_count(p_partkey % 16) AS n FROM part)"


def _squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, ts, image): of each part an image of 8 x 8 whose four quarters are bright by the bits of its key."""
    k = F.col("p_partkey")
    line = lambda c: F.repeat(F.when(F.getbit(k, F.lit(c)) == 1, F.lit("c8c8c8")).otherwise(F.lit("000000")), 4)
    data = F.unhex(F.concat(F.repeat(F.concat(line(0), line(1)), 4), F.repeat(F.concat(line(2), line(3)), 4)))
    image = F.struct(F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(3).alias("nChannels"), data.alias("data"))
    return _t(spark, sf_dir, "part").select(F.concat(F.lit("q/"), k.cast("string")).alias("path"), (k / 4.0).alias("ts"), image.alias("image"))


@_query(f"""WITH {_CELLS}, j AS (SELECT k, n IN (0, 4) AS is_fallback, unnest(range(0, CASE WHEN n IN (0, 4) THEN 1 ELSE 3 END)) AS j FROM i)
    SELECT 'q/' || k || ':' || j AS id, replace(printf('%.6f_%d', k / 4e0, j), '.', '_') || '.png' AS file, cast(j AS INTEGER) AS j, is_fallback, 16 AS size, 768 AS n_bytes FROM j""")
def object_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every quarter stands out unless all are alike; the image then stands for itself."""
    made = images.ObjectExtractor(models.GridMasks(points_per_side=2), top_n=3, output_size=16).crops(_squares(spark, sf_dir))
    return made.select("id", "file", "j", "is_fallback", "size", F.octet_length("pixels").alias("n_bytes"))


@_query("SELECT 'q/' || p_partkey || ':0' AS id, CASE WHEN p_partkey % 3 = 0 THEN 224 ELSE 8 END AS height, p_partkey % 3 = 0 AS lost, CASE WHEN p_partkey % 3 = 0 THEN '50' WHEN p_partkey % 2 = 1 THEN 'C8' ELSE '00' END AS first FROM part")
def crop_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the originals are gone."""
    whole = _squares(spark, sf_dir)
    hits = whole.select(tx.crop_id(F.col("path"), F.lit(0)).alias("id"))
    found = images.with_originals(hits, whole.where(tx.source_path(F.col("path")).isNotNull() & (F.substring("path", 3, 20).cast("bigint") % 3 != 0)))
    return found.select("id", "original.height", "original.lost", F.hex(F.substring("original.pixels", 1, 1)).alias("first"))


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/catalog-{uuid.uuid4().hex}"


def _pictures(spark: SparkSession, folder: str, n: int = 8, level: int = 40) -> None:
    """Image files of 8 x 8: i.png has i bright columns; files that exist stay as they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pixels = []
            for i in b["id"]:
                image = np.full((8, 8, 3), level, np.uint8)
                image[:, :i] = (200, 210, 220)
                pixels.append(image.tobytes())
            yield pd.DataFrame({"id": b["id"].astype(str), "file": b["id"].astype(str) + ".png", "size": 8, "pixels": pixels, "ts": 0.0})

    crops = spark.range(n).mapInPandas(run, "id string, file string, size int, pixels binary, ts double")
    images.write_crops(crops, folder).collect()


@_query("SELECT i || '.png' AS name, 8 AS height, 8 AS width, CASE WHEN i > 0 THEN 220 ELSE 40 END AS blue FROM (SELECT unnest(range(0, 8)) AS i)")
def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops written as PNG files, listed in order and read back. Writing them again changes nothing."""
    folder = _folder(spark)
    _pictures(spark, folder)
    _pictures(spark, folder, level=7)
    listed = frames.listing(spark, folder).join(frames.read_images(spark, folder), "path")
    return listed.select(F.substring_index("path", "/", -1).alias("name"), "image.height", "image.width", F.conv(F.hex(F.substring("image.data", 1, 1)), 16, 10).cast("int").alias("blue"))


class _Probe(models.HashEncoder):
    """Every text meets one vector; contents are embedded as their length."""

    def __init__(self, vector: list[float] | None = None) -> None:
        super().__init__(1, 64)
        self.vector = vector

    def embed_text(self, text: str) -> np.ndarray:
        return np.array(self.vector)

    def embed_images(self, batch: list) -> np.ndarray:
        return np.array([[len(x)] for x in batch], np.float32).reshape(-1, 1)


@_query(f"""WITH {_Q}, h AS (SELECT vec_id AS id, list_distance(e, q) ** 2 AS d, row_number() OVER (ORDER BY list_distance(e, q) ** 2, cast(vec_id AS VARCHAR)) AS rank FROM v, q),
    s AS (SELECT *, CASE WHEN id % 8 = 0 THEN 1e0 ELSE id % 8 / 8e0 END * (0.5e0 + cast('0x' || sha1('cup')[1:4] AS INTEGER) / 131072e0) AS score FROM h WHERE rank <= 20)
    SELECT cast(id AS VARCHAR) AS id, round(1e0 - d / 2, 6) AS similarity_score, round(score, 6) AS detection_score, cast(rank AS INTEGER) AS retrieval_rank FROM s ORDER BY score DESC, rank LIMIT 5""")
def search_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole engine: a stored collection, its image files, and the chain that embeds, retrieves, detects and re-ranks."""
    folder, df = _folder(spark), _vectors(spark, sf_dir)
    _pictures(spark, f"{folder}/images")
    s = store.Store(spark, f"{folder}/db", buckets=8)
    path = F.concat(F.lit(f"{folder}/images/"), (F.col("id") % 8).cast("string"), F.lit(".png"))
    s.overwrite("all", df.select(F.col("id").cast("string").alias("id"), F.lit("all").alias("collection_id"), "vector", path.alias("path"), F.lit(0.0).alias("timestamp")))
    state = search.Search(_Probe(_probe(df)), models.RegionDetector(), s).invoke(query="cup", collection_id="all", top_k_retrieve=20, top_k_final=5)
    return state.results.select("id", F.round("similarity_score", 6).alias("similarity_score"), F.round("detection_score", 6).alias("detection_score"), "retrieval_rank")


@_query(f"""WITH {_Q} SELECT cast(vec_id AS VARCHAR) AS id, vec_id % 8 || '.png' AS name, round(1e0 - list_distance(e, q) ** 2 / 2, 6) AS similarity_score, cast(row_number() OVER (ORDER BY list_distance(e, q) ** 2, cast(vec_id AS VARCHAR)) AS INTEGER) AS retrieval_rank,
    true AS undetected FROM v, q ORDER BY list_distance(e, q) ** 2, cast(vec_id AS VARCHAR) LIMIT 20""")
def search_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain's first two steps; what later steps would fill in stays empty."""
    df, s = _vectors(spark, sf_dir), store.Store(spark, _folder(spark), buckets=4)
    path = F.concat((F.col("id") % 8).cast("string"), F.lit(".png"))
    s.append("all", df.select(F.col("id").cast("string").alias("id"), F.lit("all").alias("collection_id"), "vector", path.alias("path"), F.lit(0.0).alias("timestamp")))
    state = (search.EmbedQuery(_Probe(_probe(df))) | search.Retrieve(s)).invoke(search.SearchState("cup", "all"))
    undetected = F.lit(state.detected is None and state.results is None)
    return state.retrieved.select("id", F.col("path").alias("name"), F.round("similarity_score", 6).alias("similarity_score"), "retrieval_rank", undetected.alias("undetected"))


@_query("SELECT p_partkey, 64 AS dim, 1e0 AS norm, 1e0 AS reordered, p_name = p_type AS same FROM part")
def embed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts through an encoder that each worker makes once: unit vectors, the same for the same words in any order."""
    encoder = models.Loaded(models.HashEncoder, embedding_dim=64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = lambda t: encoder.invoke(t)["embedding"].astype(float)
        for b in batches:
            rows = []
            for k, name, kind in zip(b["p_partkey"], b["p_name"], b["p_type"], strict=True):
                u, v, w = of(name), of(" ".join(reversed(name.split()))), of(kind)
                rows.append((k, len(u), round(float(np.linalg.norm(u)), 6), round(float(u @ v), 6), bool(u @ w > 0.999999)))
            yield pd.DataFrame(rows, columns=["p_partkey", "dim", "norm", "reordered", "same"])

    return _t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type").mapInPandas(run, "p_partkey bigint, dim int, norm double, reordered double, same boolean")


@_query("SELECT p_partkey, p_partkey % 256 AS level, 768 AS n_bytes, 1 AS n_levels, 128 AS canvas FROM part")
def resized_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey images of 5 x 9 to three channels and to squares of 16, beside an empty canvas."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        empty = images.ObjectExtractor(None, background="gray").canvas(4, 4)
        for b in batches:
            out = [images.lanczos(images.to_rgb({"height": 5, "width": 9, "nChannels": 1, "data": bytes([k % 256]) * 45}), 16) for k in b["p_partkey"]]
            yield pd.DataFrame({"p_partkey": b["p_partkey"], "level": [int(x[0, 0, 0]) for x in out], "n_bytes": [x.nbytes for x in out], "n_levels": [len(np.unique(x)) for x in out], "canvas": int(empty.mean())})

    return _t(spark, sf_dir, "part").select("p_partkey").mapInPandas(run, "p_partkey bigint, level bigint, n_bytes int, n_levels int, canvas int")


@_query("SELECT p_partkey, p_partkey % 8 AS colour, 64 AS edge, 35 AS inside FROM part")
def boxes_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles of two pixels' width, their corners cut to whole numbers, in the palette's order."""
    colours = [list(c) for c in tx.PALETTE]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k in b["p_partkey"]:
                blank = np.full((32, 32, 3), 41, np.uint8)
                # boxes outside the image come first, so that the palette has moved on
                drawn = annotate.outlined(blank, [[99, 99, 99, 99]] * (k % 8) + [[k % 10 + 0.9, k % 7 + 0.2, k % 10 + 10.5, k % 7 + 8.7]], 2)
                edge = (drawn != blank).any(2)
                ys, xs = np.nonzero(edge)
                inner = (drawn[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1] == 41).all(2)
                rows.append((k, colours.index(drawn[edge][0].tolist()), int(edge.sum()), int(inner.sum())))
            yield pd.DataFrame(rows, columns=["p_partkey", "colour", "edge", "inside"])

    return _t(spark, sf_dir, "part").select("p_partkey").mapInPandas(run, "p_partkey bigint, colour bigint, edge int, inside int")


@_query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 3 ELSE 2 END AS n_fields, cast(event_id AS VARCHAR) AS first, 'f' || event_id AS last FROM events WHERE event_id % 5 <> 0")
def frame_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older frame list: all fields of a line, which white space parts."""
    i = F.col("event_id")
    line = F.concat(F.when(i % 5 == 0, F.lit("#")).otherwise(F.lit(" \t")), i.cast("string"), F.when(i % 3 == 0, F.lit("  x\t")).otherwise(F.lit(" ")), F.lit("f"), i.cast("string"), F.lit("  "))
    parsed = frames.parse_fields(_t(spark, sf_dir, "events").select(line.alias("value")))
    return parsed.select(F.col("fields")[0].cast("bigint").alias("event_id"), F.size("fields").alias("n_fields"), F.col("fields")[0].alias("first"), F.element_at("fields", -1).alias("last"))


@_query("SELECT i || '.png' AS name, 1 AS n, true AS by_path FROM (SELECT unnest(range(0, 8)) AS i)")
def streamed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that arrive in a folder are upserted; a second run over the grown folder takes what is new."""
    from ..streaming.ingest import ingest

    folder = _folder(spark)
    ix = index.Indexer(spark, _Probe(), f"{folder}/db")
    for n in (4, 8):
        _pictures(spark, f"{folder}/images", n)
        ingest(ix, f"{folder}/images", "live", f"{folder}/checkpoint").awaitTermination()
    rows = ix.store.open("live").groupBy("path").agg(F.count(F.lit(1)).cast("int").alias("n"), F.first("id").alias("id"))
    return rows.select(F.substring_index("path", "/", -1).alias("name"), "n", (F.col("id") == tx.path_id("live", F.col("path"))).alias("by_path"))


@_query("""SELECT * FROM (VALUES ('background', 'ValueError', 'unknown background'), ('conflict', 'ValueError', '1 ids already exist'), ('dimension', 'SparkRuntimeException', 'expected vectors of length 3'), ('duplicate ids', 'ValueError', 'duplicate ids in one call'),
    ('element type', 'TypeError', 'image 1 must be'), ('id count', 'ValueError', '1 ids for 2'), ('missing keys', 'KeyError', 'indexing'), ('negative k', 'ValueError', 'k is negative'), ('no collection', 'ValueError', 'no collection'), ('no detections', 'ValueError', 'no detected rows'),
    ('no query', 'ValueError', 'the state has no query'), ('no retrieval', 'ValueError', 'no retrieved rows'), ('timestamp count', 'ValueError', '1 timestamps for 2')) t(rule, kind, message)""")
def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the engine refuses: the error's kind, and the part of its message that names the reason."""
    folder = _folder(spark)
    s, ix = store.Store(spark, folder, buckets=1), index.Indexer(spark, _Probe(), folder)
    ix.insert([b"x"], "c", ids=["a"])
    s.write_text("empty.yaml", "models: {}\n")
    blank = search.SearchState("", "c")
    calls = {
        "background": (lambda: config.CropSettings(background="plaid"), "unknown background"),
        "conflict": (lambda: ix.insert([b"y"], "c", ids=["a"]), "1 ids already exist"),
        "dimension": (lambda: store.check_dim(s.open("c"), 3).collect(), "expected vectors of length 3"),
        "duplicate ids": (lambda: index.records(spark, [b"x", b"y"], "c", ids=["a", "a"]), "duplicate ids in one call"),
        "element type": (lambda: index.records(spark, [b"x", 5], "c"), "image 1 must be"),
        "id count": (lambda: index.records(spark, [b"x", b"y"], "c", ids=["a"]), "1 ids for 2"),
        "missing keys": (lambda: config.IndexSettings.of(yaml.safe_load(s.read_text("empty.yaml"))), "indexing"),
        "negative k": (lambda: search.knn(s.open("c"), [1.0], -1), "k is negative"),
        "no collection": (lambda: s.open("none"), "no collection"),
        "no detections": (lambda: search.Rerank().invoke(blank), "no detected rows"),
        "no query": (lambda: search.EmbedQuery(_Probe([1.0])).invoke(blank), "the state has no query"),
        "no retrieval": (lambda: search.Detect(models.RegionDetector(), spark).invoke(blank), "no retrieved rows"),
        "timestamp count": (lambda: index.records(spark, [b"x", b"y"], "c", timestamps=[1.0]), "1 timestamps for 2"),
    }
    rows = []
    for rule, (call, message) in calls.items():
        try:
            call()
        except Exception as e:
            rows.append((rule, type(e).__name__, message if message in str(e) else str(e)[:200]))
    return spark.createDataFrame(rows, "rule string, kind string, message string")


@_query("SELECT * FROM (VALUES ('batch_size', '16'), ('db_path', 'here'), ('embedding_dim', '8'), ('margin', '0.25'), ('output_size', '96'), ('background', 'black'), ('text_threshold', '0.25'), ('threshold', '0.35')) t(name, value)")
def settings_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One YAML file for models, indexing and preprocessing, read by the driver."""
    with tempfile.NamedTemporaryFile("w", suffix=".yaml") as f:
        f.write("models:\n  encoder: {embedding_dim: 8}\n  detector: {box_threshold: 0.35, text_threshold: 0.25}\nindexing: {db_path: here, batch_size: 16}\npreprocess: {background: black, margin: '0.25', output_size: '96'}\n")
        f.flush()
        ix, crop, found = config.IndexSettings.load(f.name), config.CropSettings.load(f.name), models.RegionDetector.from_config(f.name)
        dim = models.Loaded.from_config(models.HashEncoder, f.name).embedding_dim
    rows = {"embedding_dim": dim, "threshold": found.threshold, "text_threshold": found.text_threshold, "db_path": ix.db_path, "batch_size": ix.batch_size, "background": crop.background, "margin": crop.margin, "output_size": crop.output_size}
    return spark.createDataFrame([(k, str(v)) for k, v in rows.items()], "name string, value string")


def _contents(docs: DataFrame, mark: str) -> DataFrame:
    """Documents as images to index: their text's bytes, under an id of their own."""
    return docs.select(F.col("doc_id").alias("pos"), F.concat(F.coalesce("text", F.lit("")), F.lit(mark)).cast("binary").alias("content"), F.col("doc_id").cast("double").alias("ts"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"))


@_query("""SELECT 'doc-' || doc_id AS id, 'docs' AS collection_id, '' AS path, cast(doc_id AS DOUBLE) AS timestamp, cast(strlen(coalesce(text, '')) + CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS DOUBLE) AS size
    FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0""")
def indexer_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the documents are inserted, then every second one is updated: replaced or added."""
    docs = _t(spark, sf_dir, "documents")
    ix = index.Indexer(spark, _Probe(), _folder(spark))
    ix.insert(_contents(docs.where("doc_id % 3 <> 0"), "!"), "docs")
    ix.update(_contents(docs.where("doc_id % 2 = 0"), "!!"), "docs")
    return ix.store.open("docs").select("id", "collection_id", "path", "timestamp", F.col("vector")[0].cast("double").alias("size"))


@_query("""SELECT 'label-' || label AS job_id, 'c' || label AS collection_id, CASE WHEN label % 3 = 0 THEN 'running' WHEN label % 3 = 1 THEN 'done' ELSE 'failed' END AS state, count(*) AS total,
    CASE WHEN label % 3 = 2 THEN count(*) // 2 ELSE count(*) END AS processed, CASE WHEN label % 3 = 2 THEN 'no power' END AS error,
    format('JobStatus(job_id=''label-{}'', collection_id=''c{}'', state=''{}'', processed={}/{})', label, label, CASE WHEN label % 3 = 0 THEN 'running' WHEN label % 3 = 1 THEN 'done' ELSE 'failed' END, CASE WHEN label % 3 = 2 THEN count(*) // 2 ELSE count(*) END, count(*)) AS shown FROM embeddings GROUP BY label""")
def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job for each label, reported in two steps, and read back from the store's events."""
    kept = jobs.Jobs(store.Store(spark, _folder(spark)))
    for r in _t(spark, sf_dir, "embeddings").groupBy("label").count().collect():  # a row for each collection
        job = kept.start(f"c{r['label']}", r["count"], f"label-{r['label']}")
        job.advance(r["count"] // 2)
        if r["label"] % 3 == 2:
            job.fail("no power")
            continue
        job.advance(r["count"] - r["count"] // 2)
        if r["label"] % 3 == 1:
            job.finish()
    shown = spark.createDataFrame([(j.job_id, repr(j)) for j in kept.list_all()], "job_id string, shown string")
    return kept.table().select("job_id", "collection_id", "state", "total", "processed", "error").join(shown, "job_id")


@_query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS batch FROM documents")
def batch_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.batch_ids(_t(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 64).select("doc_id", "batch")


@_query("WITH b AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS batch FROM documents), c AS (SELECT batch, count(*) AS n FROM b GROUP BY batch) SELECT batch, n, cast(coalesce(sum(n) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS processed FROM c")
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.progress(frames.batch_ids(_t(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 64))


@_query("SELECT doc_id, sha1(coalesce(text, '')) AS content, lang, (row_number() OVER (ORDER BY source, doc_id) - 1) // 100 AS batch, row_number() OVER (ORDER BY source, doc_id) AS rn FROM documents")
def batch_ids_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of whole rows, in an order of few values first."""
    out = frames.batch_ids(_t(spark, sf_dir, "documents"), ["source", "doc_id"], 100)
    return out.select("doc_id", F.sha1(F.coalesce("text", F.lit("")).cast("binary")).alias("content"), "lang", "batch", "rn")


@_query("WITH r AS (SELECT doc_id, sha1(coalesce(text, '')) AS content, row_number() OVER (ORDER BY lang, doc_id) AS rn, count(*) OVER () AS n FROM documents) SELECT doc_id, content, rn FROM r WHERE (rn - 1) % greatest(1, n // 50) = 0 ORDER BY rn LIMIT 50")
def systematic_sample_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frames.systematic_sample(_t(spark, sf_dir, "documents"), ["lang", "doc_id"], 50)
    return out.select("doc_id", F.sha1(F.coalesce("text", F.lit("")).cast("binary")).alias("content"), "rn")


@_query("SELECT p_partkey, 'img/' || p_partkey || '.png:' || (p_partkey % 4) AS id, 'img/' || p_partkey || '.png' AS path FROM part")
def crop_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ident = tx.crop_id(F.concat(F.lit("img/"), F.col("p_partkey").cast("string"), F.lit(".png")), F.col("p_partkey") % 4)
    return _t(spark, sf_dir, "part").select("p_partkey", ident.alias("id")).withColumn("path", tx.source_path(F.col("id")))


@_query("SELECT event_id, replace(printf('%.6f_%d', value, event_id % 5), '.', '_') || '.png' AS file FROM events")
def crop_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", tx.crop_filename(F.col("value"), F.col("event_id") % 5).alias("file"))


@_query("""WITH o AS (SELECT p_partkey AS k, 'p' || p_partkey AS path FROM part WHERE p_partkey % 3 <> 0), c AS (SELECT 'p' || p_partkey || ':0' AS id FROM part)
    SELECT c.id, o.k, o.k IS NULL AS lost FROM c LEFT JOIN o ON split_part(c.id, ':', 1) = o.path""")
def crop_originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"))
    crops = part.select(tx.crop_id(F.col("path"), F.lit(0)).alias("id"))
    joined = crops.withColumn("path", tx.source_path(F.col("id"))).join(part.where("k % 3 <> 0"), "path", "left")
    return joined.select("id", "k", F.col("k").isNull().alias("lost"))


@_query(r"""WITH p AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || '. ' ELSE p_name || '  ' END AS t FROM part)
    SELECT p_partkey, CASE WHEN regexp_replace(t, '\s+$', '') LIKE '%.' THEN t ELSE regexp_replace(t, '\s+$', '') || ' .' END AS prompt FROM p""")
def prompt_terminator(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("p_partkey") % 3
    t = F.when(r == 0, F.col("p_name")).when(r == 1, F.concat("p_name", F.lit(". "))).otherwise(F.concat("p_name", F.lit("  ")))
    return _t(spark, sf_dir, "part").select("p_partkey", tx.terminated_prompt(t).alias("prompt"))


@_query("SELECT p_partkey, p_name[1:12] || ' ' || printf('%.2f', p_partkey % 64 / 64e0) AS label, p_partkey % 8 AS colour, p_partkey % 30 + 3 AS ax, greatest(p_partkey % 30 - 18, 0) AS ay, p_size || ' mask' || CASE WHEN p_size <> 1 THEN 's' ELSE '' END AS n FROM part")
def label_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    anchor = tx.text_anchor(k % 30, k % 30)
    # a colour's place in the palette
    colour = F.array_position(F.array(*(F.array(*map(F.lit, c)) for c in tx.PALETTE)), tx.palette(k)) - 1
    return _t(spark, sf_dir, "part").select("p_partkey", tx.label_text(F.col("p_name"), k % 64 / 64.0).alias("label"), colour.alias("colour"), anchor["x"].alias("ax"), anchor["y"].alias("ay"), tx.plural(F.col("p_size"), "mask").alias("n"))


@_query("""WITH d AS (SELECT l_orderkey AS id, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_discount, l_quantity) - 1 AS pos, l_returnflag, l_discount, l_quantity FROM lineitem)
    SELECT id, cast(pos AS INTEGER) AS pos, l_returnflag || ' ' || printf('%.2f', l_discount) AS text, cast(trunc(l_quantity) AS INTEGER) + 3 AS ax, greatest(cast(trunc(l_quantity) AS INTEGER) - 18, 0) AS ay FROM d""")
def annotation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_discount", "l_quantity"))).alias("d"))
    q = lambda x: x["l_quantity"]
    detected = lines.select("id", F.transform("d", lambda x: F.array(q(x), q(x), q(x), q(x))).alias("boxes"), F.transform("d", lambda x: x["l_discount"]).alias("scores"), F.transform("d", lambda x: x["l_returnflag"]).alias("labels"))
    return annotate.instructions(detected).select("id", "pos", "text", F.col("anchor.x").alias("ax"), F.col("anchor.y").alias("ay"))


@_query("WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS rn, count(*) OVER () AS n FROM events) SELECT event_id, rn FROM r WHERE (rn - 1) % greatest(1, n // 4) = 0 ORDER BY rn LIMIT 4")
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.systematic_sample(_t(spark, sf_dir, "events").select("event_id", "ts"), ["ts", "event_id"], 4).select("event_id", "rn")


@_query("SELECT event_id FROM events ORDER BY event_id LIMIT 100")
def max_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.head(_t(spark, sf_dir, "events").select("event_id").orderBy("event_id"), 100)


@_query("SELECT 'data/f' || event_id || '.png' AS path, round(value, 4) AS ts FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0")
def frame_list_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = _t(spark, sf_dir, "events"), F.col("event_id")
    line = F.when(i % 7 == 0, F.concat(F.lit("# "), i.cast("string"))).when(i % 11 == 0, F.lit("  ")).otherwise(F.concat(F.col("value").cast("string"), F.lit("  f"), i.cast("string"), F.lit(".png ")))
    return frames.parse_frames(e.select(line.alias("value")), "data/").select("path", F.round("ts", 4).alias("ts"))


@_query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def collection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label is a stored collection of its own."""
    s, df = store.Store(spark, _folder(spark), buckets=1), _t(spark, sf_dir, "embeddings")
    for r in df.select("label").distinct().collect():  # a row for each collection
        s.overwrite(f"label-{r['label']}", df.where(F.col("label") == r["label"]).select(F.col("vec_id").alias("id")))
    return s.counts().select(F.substring_index("collection", "-", -1).cast("int").alias("label"), "n")
