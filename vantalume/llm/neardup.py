"""Near-duplicate documents by SetSketch registers, banding, joint likelihood and exact verification.

A text's set is its distinct word shingles. Each of M registers holds floor(1 - log_b(x)), cut to 0..Q + 1, of the
least of exponential variates x that hashing gives the set's elements; registers of parts merge by their maximum,
and two sets share a register with a probability near their Jaccard similarity J. BANDS bands of ROWS registers
give candidates: at J = 0.8 a pair shares no band with probability 3e-6.

Rows with equal sets form a class first (counted before the shuffle), and only classes go on, so copies never make
pairs. Candidates are then star-shaped: each member of a bucket against the bucket's leader, a number of pairs
linear in the rows. Pairs whose likelihood, given register comparisons and both set sizes, peaks below ``floor`` are
dropped (eight standard deviations under 0.8: a link is lost there with probability 1e-12), and the rest are confirmed on the
full sets. The rows of a bucket, a star or a component that holds a great part of all rows are dealt over many tasks. Links make components;
a blockwise pass, after a second star where pairs are many, compares what still shares a bucket across components: every member of a bucket's
smaller components against all members of other components, in blocks of bounded size. No bucket is cut or sampled.

Defined cases: null and wordless texts have the empty set and are linked with nothing; fewer words than a shingle
make one shingle; rows that share an id are documents of their own, each with its own component; a class of null ids only has
a null component and its rows are kept; input columns other than the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACED, U64, append_map, arrow_map, bounded_batches, cleared, hashed, hot_keys, mask, masked, mix64, partitions, record, salted_join, scratch, settle, window_hash
from .components import components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 5
M = BANDS * ROWS
BASE, RATE, Q = 1.001, 20.0, (1 << 16) - 2
FLOOR = 0.55
#: Up to so many pairs a class are compared blockwise at once; where there are more, a second star is to link some before.
DIRECT = 256
#: Members of a star that meet a copy of their leader's set.
STAR = 250

_rng = np.random.default_rng(77)
_XOR = _rng.integers(0, 1 << 63, M, dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 63, M, dtype=np.uint64) | U64(1)
_BAND = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | U64(1)


def shingle_sets(h: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one after the other, and their offsets."""
    starts = cleared(at, k)
    every = window_hash(h, k)[starts] if len(starts) else np.empty(0, U64)
    edge = np.searchsorted(starts, at)
    sets = []
    for d in range(len(at) - 1):
        n = int(at[d + 1] - at[d])
        sets.append(np.unique(every[edge[d] : edge[d + 1]]) if n >= k else window_hash(h[at[d] : at[d + 1]], n) if n else np.empty(0, U64))
    return (np.concatenate(sets) if sets else np.empty(0, U64)), np.cumsum([0, *map(len, sets)])


def set_keys(elements: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each set, equal for equal sets."""
    with np.errstate(over="ignore"):
        sums = [np.append(U64(0), np.cumsum(mix64(elements ^ U64(c)), dtype=U64)) for c in (0x51ED270B, 0xA54FF53A5F1D36F1)]
        return tuple((s[offsets[1:]] - s[offsets[:-1]]).view(np.int64) for s in sums)


def registers(elements: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The registers of each set, which mustn't be empty, as a row of M values."""
    least = np.empty((M, len(offsets) - 1), U64)
    for i in range(M):
        np.minimum.reduceat((elements ^ _XOR[i]) * _MUL[i], offsets[:-1], out=least[i])
    u = (least.T.astype(np.float64) + 0.5) / 2.0**64
    x = -np.log1p(-np.minimum(u, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, Q + 1).astype(np.uint16)


def _log_likelihood(u: np.ndarray, v: np.ndarray, more: np.ndarray, less: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of J = j, given the sets' shares u and v of both sizes and how many registers of u are above, below those of v. It is concave in j."""
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    return more * log(up) + less * log(down) + (M - more - less) * log(1 - up - down)


def likeliest(nu: np.ndarray, nv: np.ndarray, more: np.ndarray, less: np.ndarray) -> np.ndarray:
    """The J of the greatest joint likelihood, given set sizes and register comparisons."""
    u, v = ((x / (nu + nv))[:, None] for x in (nu, nv))
    grid = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)
    return grid[np.arange(len(nu)), _log_likelihood(u, v, more[:, None], less[:, None], grid).argmax(1)]


def _matrix(sketches: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), np.uint16).reshape(-1, M)


def _promising(nu: np.ndarray, nv: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float, floor: float) -> np.ndarray:
    """Which pairs of rows can be links: their sizes allow it, and the likelihood peaks at floor or above."""
    ok = np.minimum(nu, nv) >= similarity * np.maximum(nu, nv) - 1e-9
    out = np.zeros(len(nu), bool)
    at = np.flatnonzero(ok & ((a == b).sum(1) >= (floor - 0.1) * M))
    if len(at):
        x, y, total = a[at], b[at], (nu[at] + nv[at]).astype(float)
        args = nu[at] / total, nv[at] / total, (x > y).sum(1), (x < y).sum(1)
        # a concave function still rises where its peak lies beyond
        out[at] = _log_likelihood(*args, floor + 1e-4) >= _log_likelihood(*args, floor - 1e-4)
    return out


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of two sorted sets that aren't empty."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _by_group(width: int, of: Callable[[pa.Table], list[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over sorted rows: a function of each run of rows that agree in the first columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for x in batches:
            k = np.stack([x.column(c).to_numpy() for c in range(width)], 1)
            cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)] if len(k) else []
            for i, j in zip(cuts, cuts[1:], strict=False):
                if held and tuple(k[i]) != key:
                    yield from of(pa.Table.from_batches(held))
                    held = []
                key = tuple(k[i])
                held.append(x.slice(i, j - i))
        if held:
            yield from of(pa.Table.from_batches(held))

    return run


class Sketches:
    """The classes of equal sets of a table of texts, and the links between them."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, shingle: int, similarity: float, floor: float) -> None:
        self.docs = docs.select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{text}`").cast("string").alias("text"), *_row_keys(doc_id, text))
        self.shingle, self.percent, self.similarity, self.floor = shingle, round(similarity * 100), similarity, floor
        k = shingle

        def rows(b: pa.RecordBatch) -> dict:
            n = np.zeros(b.num_rows, np.int64)
            keys = np.zeros((2, b.num_rows), np.int64)
            sketch: list[bytes | None] = [None] * b.num_rows
            for i, j, h, at in hashed(b.column(1), SPACED):
                elements, offsets = shingle_sets(h, at, k)
                n[i:j] = np.diff(offsets)
                keys[:, i:j] = set_keys(elements, offsets)
                full = np.flatnonzero(np.diff(offsets))
                if len(full):
                    for d, r in zip(full, registers(elements, np.append(offsets[full], len(elements))), strict=True):
                        sketch[i + d] = r.tobytes()
            return {"n": n, "h1": keys[0], "h2": keys[1], "sketch": pa.array(sketch, pa.binary())}

        self.rows = settle(append_map(self.docs, ["doc", "k1", "k2"], rows, "n bigint, h1 bigint, h2 bigint, sketch binary"), "sketches")
        grouped = self.rows.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("copies"), F.first("sketch").alias("sketch"))
        self.classes = settle(grouped.withColumn("rid", F.monotonically_increasing_id()), "classes")

    def buckets(self) -> DataFrame:
        """(key, rid) of every band of every class; a key's last bits are its band's number."""

        def rows(b: pa.RecordBatch) -> pa.RecordBatch:
            bands = _matrix(b.column(1)).astype(U64).reshape(-1, BANDS, ROWS)
            with np.errstate(over="ignore"):
                keys = mix64((bands * _BAND[None]).sum(2, dtype=U64)) & ~U64(BANDS - 1) | np.arange(BANDS, dtype=U64)[None]
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.view(np.int64).ravel()))
            return record(rid=b.column(0), keys=lists)

        return arrow_map(self.classes.select("rid", "sketch"), rows, "rid bigint, keys array<bigint>").select(F.explode("keys").alias("key"), "rid")

    def estimated(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that can be links by their sketches."""
        similarity, floor = self.similarity, self.floor
        side = lambda x: self.classes.select(F.col("rid").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))

        def rows(b: pa.RecordBatch) -> pa.RecordBatch:
            c = {x: b.column(b.schema.get_field_index(x)) for x in ("a", "b", "na", "nb", "sa", "sb")}
            ok = _promising(c["na"].to_numpy(), c["nb"].to_numpy(), _matrix(c["sa"]), _matrix(c["sb"]), similarity, floor) if b.num_rows else np.empty(0, bool)
            return record(a=c["a"].filter(pa.array(ok)), b=c["b"].filter(pa.array(ok)))

        joined = salted_join(pairs, side("b"), "b", "a").join(side("a"), "a")
        fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * self.percent
        return settle(arrow_map(joined.where(fits), rows, "a bigint, b bigint"), "candidates")

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(rid, elements) of the classes in nodes, made again from one text of each.

        A bit table of bounded size, whatever the number of nodes, tells most texts that aren't asked for before they leave the JVM.
        """
        k = self.shingle
        wanted = settle(nodes.select("rid").distinct().join(self.classes.select("rid", "doc", "h1", "h2"), "rid"), "wanted")
        asked = masked(self.docs.select("doc", "text"), "doc", mask(wanted, "doc")).where("__maybe").select("text")

        def rows(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for i, j, h, at in hashed(b.column(0), SPACED):
                elements, offsets = shingle_sets(h, at, k)
                h1, h2 = set_keys(elements, offsets)
                yield record(h1=h1, h2=h2, elements=pa.array([elements[offsets[d] : offsets[d + 1]].tobytes() for d in range(j - i)], pa.binary()))

        made = arrow_map(asked, rows, "h1 bigint, h2 bigint, elements binary")
        return settle(made.join(wanted.select("rid", "h1", "h2"), ["h1", "h2"]).dropDuplicates(["h1", "h2"]).select("rid", "elements"), "sets")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) with 100 * intersection >= percent * union. b's set travels once for about STAR a's."""
        percent = self.percent
        sets = self.sets(pairs.select(F.col("a").alias("rid")).union(pairs.select(F.col("b").alias("rid"))))
        salts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("salts"))
        member = salted_join(pairs, salts, "b", "a").select(F.col("a").alias("rid"), "b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"))
        leader = salts.select(F.col("b").alias("rid"), "b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"))
        wide = member.union(leader).join(sets, "rid").select("b", "salt", "kind", F.col("rid").alias("a"), "elements")
        wide = wide.repartition(partitions(pairs.sparkSession), "b", "salt").sortWithinPartitions("b", "salt", "kind")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, owner = np.empty(0, U64), None
            for x in batches:
                a, b = [], []
                for lead, salt, kind, rid, raw in zip(*(c.to_pylist() for c in x.columns), strict=True):
                    s = np.frombuffer(raw, U64)
                    if kind == 0:
                        held, owner = s, (lead, salt)
                    elif owner == (lead, salt):
                        if _linked(s, held, percent):
                            a.append(rid)
                            b.append(lead)
                yield record(a=pa.array(a, pa.int64()), b=pa.array(b, pa.int64()))

        bounded_batches(pairs.sparkSession)
        return settle(wide.mapInArrow(run, "a bigint, b bigint"), "links")

    def crossing(self, shared: DataFrame, label: DataFrame, hot: DataFrame | None) -> DataFrame:
        """The rows (key, rid, comp) of buckets that hold more than one component; hot are the hot_keys() of all buckets."""
        marked = shared.join(label.withColumnRenamed("node", "rid"), "rid", "left").select("key", "rid", F.coalesce("root", "rid").alias("comp"))
        marked = settle(marked, "marked")
        mixed = marked.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
        return settle(salted_join(marked, mixed, "key", "rid", hot=hot), "mixed")

    def heads(self, mixed: DataFrame) -> DataFrame:
        """Per bucket: its largest component (main), the rows of that (most) and of all (n)."""
        by_comp = mixed.groupBy("key", "comp").count()
        return settle(by_comp.groupBy("key").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"), F.sum("count").alias("n"), F.max("count").alias("most")), "heads")

    def blockwise(self, mixed: DataFrame, top: DataFrame, block: int = 256) -> DataFrame:
        """Confirmed links between a bucket's smaller components and all its other components; top are the heads() of the buckets.

        Sketches meet in blocks of at most about ``block`` rows a side and tell which rows have a promising partner;
        only their sets come to the same blocks, where the pairs are confirmed. A pair is compared in the first
        band that both share, once, and never becomes a row: only links come out.
        """
        blocks = lambda c: F.greatest(F.lit(1), F.ceil(c / block)).cast("int")
        sized = salted_join(mixed, top, "key", "rid").select("key", "rid", "comp", (F.col("comp") != F.col("main")).alias("stray"), blocks(F.col("n")).alias("nm"), blocks(F.col("n") - F.col("most")).alias("ns"))
        place = lambda n: F.pmod(F.xxhash64("rid"), n).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        members = sized.select("key", "rid", "comp", place(F.col("nm")).alias("mb"), every(F.col("ns")).alias("sb"), F.lit(False).alias("stray"))
        strays = sized.where("stray").select("key", "rid", "comp", every(F.col("nm")).alias("mb"), place(F.col("ns")).alias("sb"), F.lit(True).alias("stray"))
        dealt = ["key", "mb", "sb"]
        sketched = self.classes.select("rid", "n", "sketch")
        p = partitions(mixed.sparkSession)
        wide = members.union(strays).join(sketched, "rid").select(*dealt, "stray", "rid", "comp", "n", "sketch").repartition(p, *dealt).sortWithinPartitions(*dealt)
        similarity, floor, percent = self.similarity, self.floor, self.percent

        def promising(t: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
            """Each stray's row, and the rows of its promising partners."""
            stray, comp, n = (t.column(c).to_numpy() for c in ("stray", "comp", "n"))
            sketch, band = _matrix(t.column("sketch").combine_chunks()), int(t.column("key")[0].as_py()) & (BANDS - 1)
            bands = sketch.reshape(len(sketch), BANDS, ROWS)
            m = np.flatnonzero(~stray)
            for s in np.flatnonzero(stray):
                at = m[comp[m] != comp[s]]
                if len(at):
                    at = at[(bands[at] == bands[s]).all(2).argmax(1) == band]
                if len(at):
                    at = at[_promising(np.full(len(at), n[s]), n[at], np.broadcast_to(sketch[s], (len(at), M)), sketch[at], similarity, floor)]
                if len(at):
                    yield int(s), at

        def sift(t: pa.Table) -> list[pa.RecordBatch]:
            rows = np.zeros(t.num_rows, bool)
            for s, at in promising(t):
                rows[s] = rows[at] = True
            return t.select([*dealt, "stray", "rid", "comp", "n"]).filter(pa.array(rows)).combine_chunks().to_batches()

        def confirm(t: pa.Table) -> list[pa.RecordBatch]:
            rid, comp = t.column("rid").to_numpy(), t.column("comp").to_numpy()
            lengths = np.array([len(x) // 8 for x in t.column("elements").to_pylist()])
            flat = np.frombuffer(b"".join(t.column("elements").to_pylist()), U64)
            starts = np.cumsum(lengths) - lengths
            a, b = [], []
            for s, at in promising(t):
                # one look-up of all the partners' elements in the stray's set
                own = flat[starts[s] : starts[s] + lengths[s]]
                where = np.repeat(starts[at] - np.cumsum(lengths[at]) + lengths[at], lengths[at]) + np.arange(lengths[at].sum())
                x = flat[where]
                hit = own[np.minimum(np.searchsorted(own, x), len(own) - 1)] == x
                both = np.add.reduceat(hit, np.cumsum(lengths[at]) - lengths[at], dtype=np.int64)
                found = at[100 * both >= percent * (lengths[s] + lengths[at] - both)]
                found = found[np.unique(comp[found], return_index=True)[1]]  # one link joins the components
                a += rid[np.repeat(s, len(found))].tolist()
                b += rid[found].tolist()
            return [record(a=np.array(a, np.int64), b=np.array(b, np.int64))]

        bounded_batches(mixed.sparkSession)
        kind = "key bigint, mb int, sb int, stray boolean, rid bigint, comp bigint, n bigint"
        sifted = settle(wide.mapInArrow(_by_group(3, sift), kind), "sifted")
        sets = self.sets(sifted.select("rid"))
        wide = sifted.join(sketched.select("rid", "sketch"), "rid").join(sets, "rid").select(*dealt, "stray", "rid", "comp", "n", "sketch", "elements").repartition(p, *dealt).sortWithinPartitions(*dealt)
        return settle(wide.mapInArrow(_by_group(3, confirm), "a bigint, b bigint"), "links")

    @staticmethod
    def _pairs(top: DataFrame) -> int:
        """How many pairs of rows blockwise() meets."""
        return top.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - F.col("most"))), F.lit(0))).first()[0]

    def labels(self) -> DataFrame:
        """(node, root) of every class that is linked with another."""
        bands = settle(self.buckets(), "bands")
        sizes = settle(bands.groupBy("key").agg(F.min("rid").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
        hot = hot_keys(bands, "key", counts=sizes)
        shared = settle(salted_join(bands, sizes.select("key", "b"), "key", "rid", hot=hot), "buckets")
        star = settle(shared.where("rid <> b").select(F.col("rid").alias("a"), "b").distinct(), "star")
        links = self.confirmed(self.estimated(star))
        label = components(links)
        mixed = self.crossing(shared.select("key", "rid"), label, hot)
        top = self.heads(mixed)
        pairs = self._pairs(top)
        if not pairs:
            return label
        if pairs > DIRECT * self.classes.count():
            second = mixed.groupBy("key").agg(F.min_by(F.struct("rid", "comp"), F.xxhash64("rid", "key")).alias("lead"))
            star = salted_join(mixed, second, "key", "rid").where("comp <> lead.comp").select(F.greatest("rid", "lead.rid").alias("a"), F.least("rid", "lead.rid").alias("b")).distinct()
            star = settle(star, "star")
            more = self.confirmed(self.estimated(star))
            if not more.isEmpty():
                links = links.union(more)
                label = components(links)
                mixed = self.crossing(mixed.select("key", "rid"), label, hot)
                top = self.heads(mixed)
        more = self.blockwise(mixed, top)
        return label if more.isEmpty() else components(links.union(more))


def _grouped(docs: DataFrame, doc_id: str, text: str, shingle: int, similarity: float, floor: float) -> DataFrame:
    """Per row: doc, k1 and k2 (hashes of id and text), n, component (the least id reachable) and group (its number; null for an empty set)."""
    with scratch(docs.sparkSession):
        s = Sketches(docs, doc_id, text, shingle, similarity, floor)
        classes = s.classes.select("h1", "h2", "doc", "copies", "rid").join(s.labels().withColumnRenamed("node", "rid"), "rid", "left").withColumn("group", F.coalesce("root", "rid"))
        classes = settle(classes.drop("rid"), "classes", lasting=True)
        rows = settle(s.rows.select("doc", "k1", "k2", "n", F.when(F.col("n") > 0, F.col("h1")).alias("h1"), "h2"), "rows", lasting=True)
    least = classes.where("root is not null").groupBy("root").agg(F.min("doc").alias("least"))
    grouped = salted_join(classes, least, "root", "doc", "left").select("h1", "h2", F.coalesce("least", "doc").alias("component"), "group")
    return salted_join(rows, grouped, ["h1", "h2"], "doc", "left").select("doc", "k1", "k2", "n", "group", F.coalesce("component", "doc").alias("component"))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, floor: float = FLOOR) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least id reachable by links), kept (doc_id is its component's)."""
    out = _grouped(docs, doc_id, text, shingle, similarity, floor)
    return out.select(F.col("doc").alias(doc_id), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("doc").eqNullSafe(F.col("component")).alias("kept"))


def representatives(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, floor: float = FLOOR) -> DataFrame:
    """docs with one row of each group of near duplicates, that of the least id (null last) and then text hash; rows without words all stay.

    Rows are told apart by id and text, so a row that shares its id with a group's best one, but not its text, goes.
    """
    grouped = _grouped(docs, doc_id, text, shingle, similarity, floor)
    order = F.struct(F.col("doc").isNull(), F.col("doc"), F.col("k1"), F.col("k2"))
    best = grouped.where("group is not null").groupBy("group").agg(F.min(order).alias("best")).select(F.col("best.k1").alias("__k1"), F.col("best.k2").alias("__k2"))
    k1, k2 = _row_keys(doc_id, text)
    words = F.coalesce(F.col(f"`{text}`").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.withColumns({"__k1": k1, "__k2": k2})
    once = rows.where(words).join(best, ["__k1", "__k2"], "left_semi").dropDuplicates(["__k1", "__k2"])
    return once.union(rows.where(~words).select(*once.columns)).select(*(F.col(f"`{c}`") for c in docs.columns))


def _row_keys(doc_id: str, text: str) -> tuple[Column, Column]:
    """Two hashes that tell rows apart by id and text."""
    pair = F.col(f"`{doc_id}`"), F.col(f"`{text}`").cast("string")
    return F.xxhash64(*pair).alias("k1"), F.xxhash64(F.lit("row"), *pair).alias("k2")
