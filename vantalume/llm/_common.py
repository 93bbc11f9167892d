"""Shared folders, settled tables and the vectorised word kernel of the operators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.paths import removed, shared_folder

U64 = np.uint64
#: Bytes of text that the word kernel works on at once; it needs about 30 times as much memory.
CHUNK_BYTES = 1 << 20


_SCRATCH: ContextVar[tuple[str, ...]] = ContextVar("scratch", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are settled within, but for lasting ones, go when it ends."""
    folder = f"{(shared_folder(spark), *_SCRATCH.get())[-1]}/scratch-{uuid.uuid4().hex}"
    token = _SCRATCH.set((*_SCRATCH.get(), folder))
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        removed(spark, folder)


def settle(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, survives lost executors. A lasting table outlives its scratch()."""
    spark = df.sparkSession
    folders = (shared_folder(spark), *_SCRATCH.get())
    path = f"{folders[max(0, len(folders) - 1 - lasting)]}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, size: str = "4m") -> None:
    """Arrow batches to Python are bounded by bytes, not by rows alone: very long texts don't add up. A session that has a bound keeps it."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which an operator of the cluster sets to the data's size."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key of fewer rows is never hot.
HOT_ROWS = 1000


def hot_keys(many: DataFrame, *key: str, counts: DataFrame | None = None) -> DataFrame | None:
    """(key, __salts): the keys that hold more than twice a task's mean share of a settled table's rows, and how many tasks to deal each to.

    There are fewer of them than half the partitions, whatever the table's size; None without any. Where the keys are counted already,
    counts (key, n) saves a pass over the table.
    """
    spark = many.sparkSession
    total = many.count() if counts is None else counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if total <= HOT_ROWS:
        return None
    edge = max(HOT_ROWS, 2 * total // partitions(spark))
    counts = many.groupBy(*key).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts.select(*key, "n")
    found = [(*(r[k] for k in key), -(-r["n"] // edge)) for r in counts.where((F.col("n") > edge) & F.col(key[0]).isNotNull()).collect()]
    return spark.createDataFrame(found, ", ".join([*(f"`{k}` {many.schema[k].dataType.simpleString()}" for k in key), "__salts int"])) if found else None


def salted_join(many: DataFrame, few: DataFrame, key: str | list[str], by: str, how: str = "inner", hot: DataFrame | str | None = "count") -> DataFrame:
    """many joined with few, which has one row a key; many's hot keys are dealt by column ``by``, and few's rows repeated for them.

    many is settled, as its keys are counted first, unless its hot_keys() are given.
    """
    keys = [key] if isinstance(key, str) else key
    hot = hot_keys(many, *keys) if isinstance(hot, str) else hot
    if hot is None:
        return many.join(few, keys, how)
    dealt = many.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.pmod(F.xxhash64(by), F.coalesce("__salts", F.lit(1))).cast("int")).drop("__salts")
    each = few.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return dealt.join(each, [*keys, "__salt"], how).drop("__salt")


#: Bits of a mask() at most: its table has a row for 64 of them.
MASK_BITS = 1 << 24


def mask(keys: DataFrame, key: str) -> DataFrame:
    """(__at, __word): a bit table of bounded size, whatever the number of keys, that tells most keys that aren't there."""
    bit = F.pmod(F.xxhash64(key), F.lit(MASK_BITS))
    return keys.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("__at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("__word"))


def masked(df: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """df with __maybe: whether the row's key may be among those of a mask()."""
    at = F.pmod(F.xxhash64(key), F.lit(MASK_BITS))
    joined = df.withColumn("__at", F.shiftright(at, 6)).join(F.broadcast(table), "__at", "left")
    return joined.withColumn("__maybe", F.getbit(F.coalesce("__word", F.lit(0).cast("bigint")), (at % 64).cast("int")) == 1).drop("__at", "__word")


def remainder(doc_id: Column | str, divisor: int) -> Column:
    """crc32(doc_id as text) mod divisor; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % divisor


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _byte_table(separators: str) -> np.ndarray:
    table = np.ones(256, bool)
    table[[b for b in range(128) if re.match(separators, chr(b))]] = False
    return table


#: Words are runs of what is not white space; or of letters, digits and all beyond ASCII.
SPACED = _byte_table(r"[\x20\x09-\x0D]")
ALNUM = _byte_table(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
_BASE, _BASE_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        grown = []
        for base in (_BASE, _BASE_INV):
            p = np.full(n, U64(base))
            p[0] = 1
            with np.errstate(over="ignore"):
                grown.append(np.multiply.accumulate(p))
        _POWERS[:] = grown
    return _POWERS[0], _POWERS[1]


def word_hashes(data: np.ndarray, bounds: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of texts.

    data: UTF-8 bytes; bounds: n + 1 offsets of n texts in them; words: which bytes make words.
    Returns the hashes in order, and n + 1 offsets of the texts in the hashes. Equal words have equal hashes.
    """
    n = len(bounds) - 1
    data = LOWER[data[bounds[0] : bounds[-1]]]
    bounds = bounds - bounds[0]
    if not len(data):
        return np.empty(0, U64), np.zeros(n + 1, np.int64)
    inside = words[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] |= inside[cuts]
    last[cuts - 1] |= inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, U64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
        hashes = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))
    return hashes, np.searchsorted(starts, bounds)


def texts_of(batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    a = batch.cast(pa.large_string()) if not pa.types.is_large_string(batch.type) else batch
    if a.null_count:
        a = a.fill_null("")
    if not len(a):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1 + a.offset)[a.offset :]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.empty(0, np.uint8)
    return data, offsets


def chunked(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about that many bytes; a longer text is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def runs_of_words(data: np.ndarray, offsets: np.ndarray, words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, hashes, offsets) of the words of texts by bounded chunks."""
    for i, j in chunked(offsets):
        h, at = word_hashes(data, offsets[i : j + 1], words)
        yield i, j, h, at


def hashed(batch: pa.Array, words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """runs_of_words() of a string column."""
    yield from runs_of_words(*texts_of(batch), words)


def word_count(data: np.ndarray, bounds: np.ndarray, words: np.ndarray) -> int:
    """The words of all texts together, without their hashes."""
    inside = words[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] |= inside[cuts]
    return int(first.sum())


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive words, in order; empty if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    with np.errstate(over="ignore"):
        x = h[:n].copy()
        for i in range(1, k):
            x = mix64(x * U64(0x9FB21C651E98DF25) + h[i : n + i])
    return x


def cleared(at: np.ndarray, k: int) -> np.ndarray:
    """Positions at which k words of one text begin, given the texts' offsets."""
    keep = np.ones(max(0, int(at[-1]) - k + 1), bool)
    for d in range(1, k):
        cut = at[1:-1] - d
        keep[cut[(cut >= 0) & (cut < len(keep))]] = False
    # texts shorter than k words have their cuts doubled up; those were cleared too
    return np.flatnonzero(keep)


def owner(at: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def arrow_map(df: DataFrame, rows: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = rows(b)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def record(**columns: object) -> pa.RecordBatch:
    """A batch of named columns."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def append_map(df: DataFrame, keep: list[str], rows: Callable[[pa.RecordBatch], dict], added: str) -> DataFrame:
    """df's columns named in keep, and those that rows() gives for each batch; of equal names, the added ones stay."""
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(added).fields
    new, names = [f.name for f in fields], df.columns
    taken = {x.lower() for x in new}
    kept = [c for c in dict.fromkeys(keep) if c.lower() not in taken]
    # plain names on the way: those with dots can't be passed on
    sent = df.toDF(*(f"c{i}" for i in range(len(names))))
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"k{i} {types[c]}" for i, c in enumerate(kept)), *(f"n{i} {f.dataType.simpleString()}" for i, f in enumerate(fields))])

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        b = b.rename_columns(names)
        out = rows(b)
        arrays = [b.column(names.index(c)) for c in kept] + [out[c] if isinstance(out[c], pa.Array) else pa.array(out[c]) for c in new]
        return pa.RecordBatch.from_arrays(arrays, names=[*(f"k{i}" for i in range(len(kept))), *(f"n{i}" for i in range(len(new)))])

    return arrow_map(sent, one, schema).toDF(*kept, *new)


def least_keys(rows: DataFrame, by: str, most: int | dict, most_values: int = 1_000) -> dict:
    """Of each value of ``by`` in rows (by, key), the ``most``-th least key, or the greatest if there are fewer.

    Keys are 64-bit hashes; those that can't be among the least are left out by their share before any ranking, so
    that a value of any size sends a bounded number of rows to its task. More than most_values values are refused.
    """
    from pyspark.sql import Window

    counts = {r[by]: r["count"] for r in rows.groupBy(by).count().limit(most_values + 1).collect()}
    if len(counts) > most_values:
        raise ValueError(f"more than {most_values} values of {by}")
    if not counts:
        return {}
    limit = {k: most if isinstance(most, int) else most[k] for k in counts}
    bound = {k: min(2**63 - 1, int(-(2**63) + 2**64 * min(1.0, (2 * limit[k] + 1000) / n))) for k, n in counts.items()}
    literal = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[F.col(by)]
    likely = rows.where(F.col("key") <= literal(bound))
    ranked = likely.withColumn("at", F.row_number().over(Window.partitionBy(by).orderBy("key"))).where(F.col("at") <= literal(limit))
    return {r[by]: r["most"] for r in ranked.groupBy(by).agg(F.max("key").alias("most")).collect()}
