"""Stupid-backoff scores of documents from n-gram count tables over the whole corpus.

S(w after context) = c(context w) / c(context) if the n-gram occurs at least ``min_count`` times, else ALPHA * S(w after the
context without its first word); of a single word S = c(w) / N, or ALPHA / N where c(w) = 0. A text's first words have no n-gram of the
full order and back off. A document's score is the mean of log S over its words.

All n-grams of all documents are counted. A document is scored by what the others say: its own occurrences are left out of
c and N, since with them no n-gram would ever be unseen and a rare phrase would be scored by itself (``leave_out=False`` keeps them).

It is one relational plan at every size: n-grams are exploded, met with count tables dealt by their hash, and summed by document.

1. Texts are gathered in packs of bounded size, settled in the shared folder.
2. Each pack's distinct n-grams of all orders, with their counts there, are dealt by ranges of their hash to buckets. An n-gram
   is sent once a pack however often it occurs, so the commonest word loads its bucket no more than any other.
3. A bucket sums its n-grams over all packs and answers each pack with the totals, in the order in which they were asked.
4. A pack's answers meet its texts, and each document's log S are summed.

Nothing is sent to all executors, and the driver sees two sums. Buckets have a bounded number of n-grams: their number grows with the
texts. Rows are packed sorted columns, of which byte planes that hardly vary cost nothing in the shuffle.

Defined cases: null or wordless texts have no words and a null score; words are runs of other than white space, A-Z lower-cased;
repeated rows are scored alike and all count; an empty table gives no rows; a text longer than a pack is a pack of its own;
input columns other than the named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import SPACED, U64, bounded_batches, cleared, owner, partitions, record, runs_of_words, settle, texts_of, window_hash, word_count

ALPHA, ORDER = 0.4, 2
#: Documents and bytes of text that a pack has at most, but for a single longer text.
PACK_DOCS, PACK_BYTES = 50_000, 12 << 20
#: Bytes of text for each bucket: its n-grams are held in memory at once.
BUCKET_BYTES = 8 << 20


def _planes(x: np.ndarray) -> bytes:
    """Numbers by byte planes: the shuffle's compression removes the nearly constant ones."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes() if len(x) else b""


def _unplanes(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel() if raw else np.empty(0, kind)


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    if not len(key):
        return key, n
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(n[order], first)


def _edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Edges of sorted keys by bucket: a bucket is a range of hashes."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], U64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Runs of rows that agree in the first column."""
    held, key = [], None
    for b in batches:
        for row in b.to_pylist():
            k = next(iter(row.values()))
            if held and k != key:
                yield key, held
                held = []
            key = k
            held.append(row)
    if held:
        yield key, held


def packed(docs: DataFrame) -> DataFrame:
    """(uid, ids, lengths, texts, n_words, n_bytes): packs of (doc, text) rows, texts compressed."""
    doc_type = docs.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, task = pa.Codec("zstd"), TaskContext.get().partitionId()
        ids, lengths, parts, size, seq = [], [], [], 0, 0

        def out() -> pa.RecordBatch:
            doc, raw, n = pa.concat_arrays(ids), np.concatenate(parts), np.concatenate(lengths)
            at = np.append(0, np.cumsum(n))
            ids_of = pa.ListArray.from_arrays(pa.array([0, len(doc)], pa.int32()), doc)
            return record(uid=pa.array([task << 32 | seq], pa.int64()), ids=ids_of, lengths=pa.array([n.astype(np.int64).tobytes()], pa.binary()), texts=pa.array([codec.compress(raw.tobytes(), asbytes=True)], pa.binary()), n_words=pa.array([word_count(raw, at, SPACED)], pa.int64()), n_bytes=pa.array([len(raw)], pa.int64()))

        for b in batches:
            data, offsets = texts_of(b.column(1))
            i = 0
            while i < b.num_rows:
                j = int(np.searchsorted(offsets, offsets[i] + PACK_BYTES - size, "right")) - 1
                j = min(max(j, i + (not ids)), b.num_rows, i + PACK_DOCS - sum(map(len, ids)))
                if j > i:
                    ids.append(b.column(0).slice(i, j - i))
                    lengths.append(np.diff(offsets[i : j + 1]))
                    parts.append(np.array(data[offsets[i] : offsets[j]]))
                    size += int(offsets[j] - offsets[i])
                if j < b.num_rows:
                    yield out()
                    ids, lengths, parts, size, seq = [], [], [], 0, seq + 1
                i = j
        if ids:
            yield out()

    bounded_batches(docs.sparkSession)
    return settle(docs.mapInArrow(run, f"uid bigint, ids array<{doc_type}>, lengths binary, texts binary, n_words bigint, n_bytes bigint"), "packs")


def _texts(lengths: bytes, texts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a pack's texts."""
    n = np.frombuffer(lengths, np.int64)
    at = np.append(0, np.cumsum(n))
    raw = pa.Codec("zstd").decompress(texts, int(at[-1]), asbytes=True) if at[-1] else b""
    return np.frombuffer(raw, np.uint8), at


def _grams(h: np.ndarray, at: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each order the words that end an n-gram, and the n-grams' hashes."""
    out = [(np.arange(len(h)), h)]
    for n in range(2, order + 1):
        starts = cleared(at, n)
        out.append((starts + n - 1, window_hash(h, n)[starts] if len(starts) else np.empty(0, U64)))
    return out


def score(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", alpha: float = ALPHA, order: int = ORDER, min_count: int = 1, leave_out: bool = True, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per row: doc_id, n_words, log_score (sum of log S), lm_score (its mean by word, null without words)."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))
    packs = packed(docs)
    sums = packs.agg(F.sum("n_words").alias("words"), F.sum("n_bytes").alias("bytes")).first()
    p, total = partitions(spark), int(sums["words"] or 0)
    # several buckets a partition, each of a bounded size
    buckets = max(8 * p, -(-int(sums["bytes"] or 0) // bucket_bytes))
    doc_type, arrow_type = docs.schema["doc"].dataType.simpleString(), to_arrow_type(docs.schema["doc"].dataType)
    log_a = float(np.log(alpha))

    def kinds_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A pack's distinct n-grams of all orders in order, with their counts there."""
        held, size = [], 0
        for _, _, h, at in runs_of_words(data, offsets, SPACED):
            k, n = np.unique(np.concatenate([g for _, g in _grams(h, at, order)]), return_counts=True)
            held.append((k, n.astype(np.int64)))
            size += len(k)
            if len(held) > 8:  # small runs first, so that nothing is sorted often
                held = [_summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
        return _summed(*(np.concatenate(x) for x in zip(*held, strict=True))) if held else (np.empty(0, U64), np.empty(0, np.int64))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uid, lengths, texts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                keys, n = kinds_of(*_texts(lengths, texts))
                e = _edges(keys, buckets)
                at = [x for x in range(buckets) if e[x] < e[x + 1]]
                yield record(bucket=pa.array(at, pa.int32()), uid=pa.array([uid] * len(at), pa.int64()), keys=pa.array([_planes(keys[e[x] : e[x + 1]]) for x in at], pa.binary()), counts=pa.array([_planes(n[e[x] : e[x + 1]].astype(np.uint32)) for x in at], pa.binary()))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _grouped(batches):
            keys = [_unplanes(r["keys"], U64) for r in rows]
            kinds, n = _summed(np.concatenate(keys), np.concatenate([_unplanes(r["counts"], np.uint32) for r in rows]).astype(np.int64))
            for r, k in zip(rows, keys, strict=True):
                yield record(uid=pa.array([r["uid"]], pa.int64()), bucket=pa.array([bucket], pa.int32()), counts=pa.array([_planes(n[np.searchsorted(kinds, k)])], pa.binary()), ids=pa.nulls(1, pa.list_(arrow_type)), lengths=pa.nulls(1, pa.binary()), texts=pa.nulls(1, pa.binary()))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches):
            head, *answers = rows
            data, offsets = _texts(head["lengths"], head["texts"])
            keys, _ = kinds_of(data, offsets)
            counts = np.empty(len(keys), np.int64)
            i = 0
            for r in answers:
                n = _unplanes(r["counts"], np.int64)
                counts[i : i + len(n)] = n
                i += len(n)
            n_words, sums = np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1)
            for i, j, h, at in runs_of_words(data, offsets, SPACED):
                n_words[i:j] = np.diff(at)
                if not len(h):
                    continue
                doc = owner(at)
                others = np.maximum(1, total - n_words[i:j]) if leave_out else np.full(j - i, total)
                before, log_s = None, None
                for ends, grams in _grams(h, at, order):
                    place = np.searchsorted(keys, grams)
                    n = counts[place]
                    if leave_out and len(ends):
                        _, back, own = np.unique(place * (j - i) + doc[ends], return_inverse=True, return_counts=True)
                        n = n - own[back]
                    c = np.zeros(len(h), np.int64)
                    c[ends] = n
                    if log_s is None:
                        log_s = np.log(np.where(c > 0, c, alpha) / others[doc])
                    else:
                        seen = np.flatnonzero(c >= max(1, min_count))
                        log_s = log_a + log_s
                        log_s[seen] = np.log(c[seen] / before[seen - 1])
                    before = c
                sums[i:j] = np.bincount(doc, log_s, minlength=j - i)
            yield record(doc=pa.array(head["ids"], arrow_type), n_words=n_words, log_score=sums)

    bounded_batches(spark)
    asked = packs.select("uid", "lengths", "texts").mapInArrow(ask, "bucket int, uid bigint, keys binary, counts binary")
    fields = f"uid bigint, bucket int, counts binary, ids array<{doc_type}>, lengths binary, texts binary"
    answered = asked.repartition(p, "bucket").sortWithinPartitions("bucket").mapInArrow(answer, fields)
    texts = packs.select("uid", F.lit(-1).alias("bucket"), F.lit(None).cast("binary").alias("counts"), "ids", "lengths", "texts")
    together = texts.union(answered).repartition(p, "uid").sortWithinPartitions("uid", "bucket")
    out = together.mapInArrow(met, f"doc {doc_type}, n_words bigint, log_score double")
    some = F.col("n_words") > 0
    return out.select(F.col("doc").alias(doc_id), "n_words", F.when(some, F.col("log_score")).alias("log_score"), F.when(some, F.col("log_score") / F.col("n_words")).alias("lm_score"))
