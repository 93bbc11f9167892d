"""Image sources, frame lists and samples of them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .paths import Resolver, opened

#: Rows of a range, about, and of the sample that cuts ranges, for each of them.
RANGE_ROWS, SAMPLE_ROWS = 1_000_000, 20
#: Bytes of file contents that a batch holds, about.
MOST_BYTES = 64 << 20


def parse_frames(lines: DataFrame, folder: str, value: str = "value") -> DataFrame:
    """(path, ts) of lines ``timestamp relative_path``; lines that start with # and blank ones are left out."""
    c = F.col(value)
    kept = lines.where(~c.startswith("#") & (F.regexp_replace(c, r"\s+", "") != ""))
    parts = F.split(F.regexp_replace(c, r"^\s+", ""), r"\s+", 2)
    return kept.select(F.concat(F.lit(folder.rstrip("/") + "/"), F.regexp_replace(parts[1], r"^\s+|\s+$", "")).alias("path"), parts[0].cast("double").alias("ts"))


def parse_fields(lines: DataFrame, value: str = "value") -> DataFrame:
    """All fields of each line that isn't a comment or blank."""
    c = F.col(value)
    return lines.where(~c.startswith("#") & (F.regexp_replace(c, r"\s+", "") != "")).select(F.split(F.regexp_replace(c, r"^\s+|\s+$", ""), r"\s+").alias("fields"))


def read_frames(spark: SparkSession, folder: str, name: str = "rgb.txt") -> DataFrame:
    return parse_frames(spark.read.text(f"{folder.rstrip('/')}/{name}"), folder)


def read_images(spark: SparkSession, *paths: str, pattern: str = "*.png") -> DataFrame:
    """(path, image) with pixels decoded on the JVM, blue first; sorted reading is up to the caller."""
    df = spark.read.format("image").option("pathGlobFilter", pattern).option("dropInvalid", True).load(list(paths))
    return df.select(plain_path(F.col("image.origin")).alias("path"), "image")


def with_contents(df: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """df whose null contents are read from their paths, file by file in the tasks that hold the rows; a missing file fails the job."""
    where = Resolver(df.sparkSession)
    at, of = df.columns.index(content), df.columns.index(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size, first = [], 0, 0
            for i, (name, raw) in enumerate(zip(b.column(of).to_pylist(), b.column(at), strict=True)):
                if raw.is_valid:
                    held.append(raw.as_py())
                else:
                    fs, found = opened(where(name))
                    with fs.open_input_file(found) as source:
                        held.append(source.read())
                size += len(held[-1])
                if size > MOST_BYTES or i == b.num_rows - 1:  # a batch's files needn't fit in memory together
                    part = b.slice(first, i + 1 - first)
                    yield part.set_column(at, b.schema.field(at), pa.array(held, b.schema.field(at).type))
                    held, size, first = [], 0, i + 1

    return df.mapInArrow(run, df.schema)


def plain_path(c: Column) -> Column:
    """A local file's path without its scheme; other schemes stay."""
    return F.regexp_replace(c, "^file:/+", "/")


def listing(spark: SparkSession, folder: str, pattern: str = "*.png") -> DataFrame:
    """Matching files in order of their path; contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(plain_path(F.col("path")).alias("path")).orderBy("path")


def systematic_sample(df: DataFrame, order: list[str], n: int = 4) -> DataFrame:
    """Every max(1, count // n)-th row in an order, n at most, with its position ``rn``."""
    step = max(1, df.count() // n)
    return numbered(df, order).where((F.col("rn") - 1) % step == 0).orderBy("rn").limit(n)


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows with their 1-based position in a total order.

    A bounded sample of the order's values cuts it into ranges. A row's range depends on the row alone, so the ranges' sizes and the rows'
    places in them agree however the plan is cut into tasks, run again or coalesced; the sample's luck decides only how even the
    ranges are. No task sees all rows.
    """
    spark, n = df.sparkSession, df.count()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE_ROWS))
    ranges = min(ranges, -(-n // 1000))  # few rows need few tasks
    key = F.struct(*(F.col(f"`{c}`") for c in order))
    kind = T.ArrayType(df.select(key.alias("k")).schema["k"].dataType)
    cuts = []
    if ranges > 1:
        sampled = df.select(key.alias("k")).sample(min(1.0, SAMPLE_ROWS * ranges / n), 7)
        place = F.percent_rank().over(Window.orderBy("k"))  # of the sample
        cuts = sorted((r["at"], r["k"]) for r in sampled.withColumn("at", F.floor(place * ranges).cast("int")).groupBy("at").agg(F.min("k").alias("k")).where("at > 0").collect())
    # one row, with an entry for each range
    df = df.crossJoin(F.broadcast(spark.createDataFrame([([k for _, k in cuts],)], T.StructType([T.StructField("__bounds", kind)]))))
    bounds = F.col("__bounds")
    span = max(1, round(ranges**0.5))
    # first among every span-th bound, then in that stretch
    coarse = F.size(F.filter(F.transform(F.sequence(F.lit(0), F.floor(F.size(bounds) / span).cast("int")), lambda i: F.get(bounds, i * span)), lambda b: b <= key))
    start = F.greatest(F.lit(0), coarse - 1) * span
    ranged = df.withColumn("__p", start + F.size(F.filter(F.slice(bounds, start + 1, span), lambda b: b <= key)))
    ranged = ranged.drop("__bounds")
    sizes = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # of the ranges' sizes
    offsets = sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__p").orderBy(*(F.col(f"`{c}`") for c in order)))
    return ranged.withColumn("__i", place).join(F.broadcast(offsets), "__p").withColumn("rn", F.col("__i") + F.col("__before")).drop("__p", "__i", "__before")


def head(df: DataFrame, most: int | None) -> DataFrame:
    """The first rows, or all if there is no limit."""
    return df.limit(most) if most else df


def batch_ids(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Consecutive batches of a size, the last one short."""
    return numbered(df, order).withColumn("batch", F.floor((F.col("rn") - 1) / size))


def progress(batched: DataFrame) -> DataFrame:
    """(batch, n, processed) of batch_ids(): each batch's rows, and how many rows stand before it."""
    return batched.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), (F.min("rn") - 1).alias("processed"))
