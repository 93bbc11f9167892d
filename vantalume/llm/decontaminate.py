"""Benchmark decontamination by winnowing.

Each text's word k-grams are hashed and of each run of WINDOW - K + 1 of them the smallest is kept. Whatever
window of WINDOW words a document and an item share, both keep the same fingerprint from it, so joining the
fingerprints finds every shared window. A joined hit is then extended: each window of the document that kept that
fingerprint is compared as a whole, and windows that occur merge into spans.

The items go to the executors in blocks of at most ``block_words`` words (a bound that doesn't depend on the data);
a benchmark of several blocks takes one pass over the documents' texts for each, which writes its hits alone.

Defined cases: a null or wordless text has no words and no hits; an item of fewer than WINDOW words is one window
of its own length; a wordless item never occurs; items that share an id count once; a null id is written as the
empty text; repeated documents are rows of their own; input columns other than the named ones are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ALNUM, U64, append_map, cleared, hashed, settle, window_hash

WINDOW, K = 13, 6
BLOCK_WORDS = 2_000_000
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _sliding_min(g: np.ndarray, w: int) -> np.ndarray:
    m, have = g, 1
    while have < w:
        step = min(have, w - have)
        if len(m) <= step:
            return np.empty(0, U64)
        m = np.minimum(m[:-step], m[step:])
        have += step
    return m


def fingerprints(h: np.ndarray, at: np.ndarray, window: int = WINDOW, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Where each window of that many words starts, and the fingerprint that winnowing keeps from it."""
    starts = cleared(at, window)
    kept = _sliding_min(window_hash(h, k), window - k + 1)
    return starts, kept[starts] if len(starts) else np.empty(0, U64)


class Items:
    """Sorted fingerprint and window arrays of one block of items."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int = WINDOW, k: int = K) -> None:
        self.window, self.k, self.ids = window, k, ids
        prints, found = [], []
        for i, j, h, at in hashed(pa.array(texts, pa.string()), ALNUM):
            starts, kept = fingerprints(h, at, window, k)
            prints.append(np.unique(kept))
            whole = window_hash(h, window)
            item = np.searchsorted(at, starts, "right") - 1 + i
            found.append((np.full(len(starts), window), whole[starts] if len(starts) else np.empty(0, U64), item))
            for d in np.flatnonzero((np.diff(at) < window) & (np.diff(at) > 0)):
                n = int(at[d + 1] - at[d])
                found.append((np.array([n]), window_hash(h[at[d] : at[d + 1]], n), np.array([d + i])))
        self.prints = np.unique(np.concatenate(prints)) if prints else np.empty(0, U64)
        length, key, item = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, int), np.empty(0, U64), np.empty(0, int))
        #: By window length: sorted window hashes, and which items have each.
        self.of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in np.unique(length):
            pick = length == n
            pairs = np.unique(np.rec.fromarrays([key[pick], item[pick].astype(np.int64)], names="k,i"))
            keys, first = np.unique(pairs.k, return_index=True)
            self.of[int(n)] = keys, np.append(first, len(pairs)), np.ascontiguousarray(pairs.i)

    @staticmethod
    def _in(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        hit = np.flatnonzero(keys[at] == x)
        return hit, at[hit]

    def hits(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Occurring windows of some documents: start, length, row of self.of[length], ordered by start within each length."""
        out = []
        for n, (keys, _, _) in self.of.items():
            if n == self.window:
                starts, kept = fingerprints(h, at, self.window, self.k)
                if not len(starts) or not len(self.prints):
                    continue
                new = np.append(True, kept[1:] != kept[:-1])  # neighbours mostly keep the same fingerprint
                run = np.cumsum(new) - 1
                hit, _ = self._in(self.prints, kept[new])
                joined = np.zeros(int(run[-1]) + 1, bool)
                joined[hit] = True
                starts = starts[joined[run]]
                whole = window_hash(h, n)[starts] if len(starts) else np.empty(0, U64)
            else:
                starts = cleared(at, n)
                whole = window_hash(h, n)[starts] if len(starts) else np.empty(0, U64)
            hit, row = self._in(keys, whole)
            out.append((starts[hit], np.full(len(hit), n), row))
        if not out:
            return np.empty(0, int), np.empty(0, int), np.empty(0, int), np.empty(0, int)
        start, length, row = (np.concatenate(x) for x in zip(*out, strict=True))
        return start, length, row, np.searchsorted(at, start, "right") - 1

    def ids_of(self, length: int, rows: np.ndarray) -> set[str]:
        _, first, items = self.of[length]
        return {self.ids[i] for r in np.unique(rows) for i in items[first[r] : first[r + 1]].tolist()}


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int) -> list[Items]:
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.col(text).cast("string").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-int(size) // (6 * block_words)))
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b)
        rows = part.toArrow()
        yield Items(rows.column("id").to_pylist(), rows.column("text").to_pylist())


def mark(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with n_words, hit_spans (word positions, end exclusive, merged) and hit_items (sorted ids)."""
    keep = list(docs.columns) if keep is None else keep
    blocks = _blocks(benchmark, item_id, item_text, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _marked(docs, first, text, keep)
    # rows by number: a pass writes no more than its hits
    numbered = settle(docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*keep, text]))).withColumn("__row", F.monotonically_increasing_id()), "numbered")
    hits = None
    for block in (first, second, *blocks):
        found = _marked(numbered.select("__row", F.col(f"`{text}`").alias("text")), block, "text", ["__row"]).where(F.size("hit_items") > 0)
        found = settle(found.select("__row", "hit_spans", "hit_items"), "hits")
        hits = found if hits is None else hits.union(found)
    hits = hits.groupBy("__row").agg(F.flatten(F.collect_list("hit_spans")).alias("__spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_items")))).alias("__items"))
    return _marked(numbered.join(hits, "__row", "left"), None, text, keep)


def _marked(docs: DataFrame, block: Items | None, text: str, keep: list[str]) -> DataFrame:
    """docs with n_words, hit_spans and hit_items of one block of items; without one, of the columns __spans and __items."""
    shared = docs.sparkSession.sparkContext.broadcast(block) if block is not None else None

    def rows(b: pa.RecordBatch) -> dict:
        n = b.num_rows
        words = np.zeros(n, np.int64)
        if shared is None:
            spans = [[(s["start"], s["end"]) for s in x or []] for x in b.column(b.schema.get_field_index("__spans")).to_pylist()]
            names = [set(x or []) for x in b.column(b.schema.get_field_index("__items")).to_pylist()]
        else:
            items, spans, names = shared.value, [[] for _ in range(n)], [set() for _ in range(n)]
        for i, j, h, at in hashed(b.column(b.schema.get_field_index(text)), ALNUM):
            words[i:j] = np.diff(at)
            if shared is None:
                continue
            start, length, row, doc = items.hits(h, at)
            for d in np.unique(doc):
                mine = doc == d
                s, m, r = start[mine] - at[d], length[mine], row[mine]
                spans[i + d] += zip(s.tolist(), (s + m).tolist(), strict=True)
                for kind in np.unique(m):
                    names[i + d] |= items.ids_of(int(kind), r[m == kind])
        merged = []
        for x in spans:
            y: list[tuple[int, int]] = []
            for s, e in sorted(x):
                if y and s <= y[-1][1]:
                    y[-1] = (y[-1][0], max(e, y[-1][1]))
                else:
                    y.append((s, e))
            merged.append([{"start": s, "end": e} for s, e in y])
        return {"n_words": words, "hit_spans": pa.array(merged, SPANS), "hit_items": pa.array([sorted(x) for x in names], pa.list_(pa.string()))}

    return append_map(docs, keep, rows, "n_words bigint, hit_spans array<struct<start:int,end:int>>, hit_items array<string>")


def digest(marked: DataFrame) -> DataFrame:
    """mark()'s columns as counts: n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda a, s: a + (s["end"] - s["start"]).cast("bigint"))
    return (
        marked.withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("hit_items").cast("bigint"))
        .withColumn("items_sha256", F.sha2(F.array_join("hit_items", ","), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )


