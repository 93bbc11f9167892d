"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree, with DataFrame functions only.

1. Every document has a size in words. Sources, in code-point order, carry repeating weights; they share a multiple of all sizes,
   and none gets more than ``most`` times its own: the water level of the capped shares is a closed form over the
   sources sorted by cap per weight.
2. A hash deals a source's documents into BLOCKS blocks. A source's target is so many whole passes over its blocks and one
   partial pass over blocks in a permuted order; the block at the edge is cut at one of its sub-blocks, and that at one document, of
   which the rest is taken. Block tables have at most BLOCKS rows a source, so a source of any size is dealt with in parallel.
3. The blocks of all passes are counted by source. A binary tree over the output shards splits these exact quotas: at each
   node the left half's counts are drawn from the multivariate hypergeometric distribution (a chain of conditional
   hypergeometric draws by inversion from the mode), the right half has the rest. Leaves hold each shard's quotas. More than
   ROW_SOURCES sources are dealt to groups: the groups' counts are split first, and each group's quotas are the draws of a tree over
   its own sources, which is the same distribution; so no row holds all sources.
4. A source's blocks in a second permuted order go to the shards by their quotas, disjointly; rows are shuffled within shards.

All draws are hashes of a seed and names, so reruns agree. Sources may be any number; ``max_sources`` refuses more, if given.

Defined cases: null texts have size 0 and take 0; a null source is the last one; without words all targets are 0; equal ids are
rows of their own; an empty table gives no rows; of equal names, the operator's columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import partitions, settle

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
BLOCKS, SHARDS, SEED = 1024, 16, 20240601
#: Sources that a row of the splitting tree holds, about.
ROW_SOURCES = 1_000
#: Rows of a block table that may be sent to all executors.
MOST_SENT = 100_000
#: Words of the mixture for each task that shuffles it: some 64 MB.
TASK_WORDS = 10_000_000
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _key(source: Column) -> Column:
    """A text that tells null from every source, in code-point order with null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(k, source_size, target) from (k, source_size): capped shares by weight, at the level where they use up the total."""
    n = len(weights)
    # text order is by UTF-8 bytes, which is that of code points
    at = F.pmod(F.row_number().over(Window.orderBy("k")) - 1, F.lit(n))
    rows = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), at + 1)).withColumn("cap", F.lit(most) * F.col("source_size"))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("total", F.lit(share) * F.sum("source_size").over(every)).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", "k")
    rows = rows.withColumn("capped", F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
    rows = rows.withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "k", "level"))).over(every)["level"]
    return rows.withColumn("found", level).select("k", "source_size", F.least("cap", F.coalesce(F.col("found"), F.lit(float("inf"))) * F.col("weight")).cast("double").alias("target"))


def _cut(units: DataFrame, by: list[str], rest: str, order: list[Column]) -> DataFrame:
    """units with part: how many of ``rest`` words each unit's ``words`` give in that order; a part of words is the edge."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum("words").over(w) - F.col("words")
    return units.withColumn("part", F.greatest(F.lit(0), F.least(F.col("words"), F.col(rest) - before)))


def _hypergeometric(total: str, good: str, draws: str, u: str) -> str:
    """SQL: how many of ``draws`` from ``total`` things of which ``good`` are good are good, at quantile u; by inversion from the mode."""
    lo, hi = f"greatest(0L, {draws} - ({total} - {good}))", f"least({draws}, {good})"
    mode = f"least({hi}, greatest({lo}, cast(floor(cast({draws} + 1 as double) * ({good} + 1) / ({total} + 2)) as bigint)))"
    spread = f"cast(12 + 12 * sqrt(cast({draws} as double) * {good} * ({total} - {good}) * ({total} - {draws}) / greatest(1D, cast({total} as double) * {total} * greatest(1L, {total} - 1))) as bigint)"
    up = "(cast(v.g - x as double) * (v.d - x)) / (cast(x + 1 as double) * (v.t - v.g - v.d + x + 1))"
    down = "(cast(x as double) * (v.t - v.g - v.d + x)) / (cast(v.g - x + 1 as double) * (v.d - x + 1))"
    ups = "if(v.m < v.h, sequence(v.m, v.h - 1), cast(array() as array<bigint>))"
    downs = "if(v.m > v.l, sequence(v.m, v.l + 1, -1L), cast(array() as array<bigint>))"
    mass = lambda xs, r: f"aggregate({xs}, struct(1D as w, 0D as s), (a, x) -> struct(a.w * {r} as w, a.s + a.w * {r} as s), a -> a.s)"
    walk = lambda xs, r, first, to: f"aggregate({xs}, struct(1D as w, {first} as left, cast(null as bigint) as pick), (a, x) -> struct(a.w * {r} as w, a.left - a.w * {r} as left, if(a.pick is null and a.left < a.w * {r}, {to}, a.pick) as pick))"
    inner = f"transform(array(struct(v as v, {u} * (1 + {mass(ups, up)} + {mass(downs, down)}) as goal)), g -> if(g.goal < 1, v.m, transform(array({walk(ups, up, 'g.goal - 1', 'x + 1')}), q -> coalesce(q.pick, {walk(downs, down, 'q.left', 'x - 1')}.pick, v.m))[0]))[0]"
    lo_, hi_ = f"greatest({lo}, {mode} - {spread})", f"least({hi}, {mode} + {spread})"
    return f"transform(array(struct({total} as t, {good} as g, {draws} as d, {mode} as m, {lo_} as l, {hi_} as h)), v -> {inner})[0]"


def quotas(counts: DataFrame, shards: int, seed: int = SEED, n_sources: int | None = None, row_sources: int = ROW_SOURCES) -> DataFrame:
    """(shard, k, quota) from (k, n): the splitting tree. Of more than row_sources sources a row holds a group, whose quotas are split first."""
    counts = settle(counts, "counts")
    groups = -(-(counts.count() if n_sources is None else n_sources) // max(2, row_sources))
    gathered = F.array_sort(F.collect_list(F.struct("k", F.col("n").cast("bigint").alias("n")))).alias("counts")
    drawn = "cast(round(aggregate(counts, 0L, (b, s) -> b + s.n) * (cast(m / 2 as int) / m)) as bigint)"
    if groups > 1:
        group = F.concat(F.lit("group "), F.pmod(F.xxhash64(F.lit(seed), F.lit("group"), F.lit(groups), "k"), F.lit(groups)).cast("string")).alias("g")
        split = quotas(counts.groupBy(group).agg(F.sum("n").alias("n")).withColumnRenamed("g", "k"), shards, seed, groups, row_sources)
        per = split.groupBy(F.col("k").alias("g")).agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "quota"))), lambda s: s["quota"]).alias("per"))
        nodes = counts.groupBy(group).agg(gathered).join(per, "g").select(F.lit(0).alias("first"), F.lit(shards).alias("m"), "counts", "per")
        drawn = "aggregate(slice(per, first + 1, cast(m / 2 as int)), 0L, (b, q) -> b + q)"
    else:
        nodes = counts.agg(gathered).select(F.lit(0).alias("first"), F.lit(shards).alias("m"), "counts", F.array().cast("array<bigint>").alias("per"))
    u = f"((xxhash64({seed}, first, m, s.k) & 9007199254740991) + 0.5D) / 9007199254740992D"
    draw = _hypergeometric("a.total", "s.n", "a.draws", u)
    fold = f"""aggregate(counts, struct(aggregate(counts, 0L, (b, s) -> b + s.n) as total,
        {drawn} as draws, cast(array() as array<struct<k:string,n:bigint>>) as kept),
        (a, s) -> transform(array({draw}), d -> struct(a.total - s.n as total, a.draws - d as draws, array_append(a.kept, struct(s.k as k, d as n)) as kept))[0], a -> a.kept)"""
    level = 1
    while level < shards:
        split = nodes.withColumn("left", F.when(F.col("m") > 1, F.expr(fold)).otherwise(F.col("counts")))
        half = F.expr("cast(m / 2 as int)")
        child = lambda first, m, c: F.struct(first.alias("first"), m.cast("int").alias("m"), c.alias("counts"))
        rest = F.zip_with("counts", "left", lambda a, b: F.struct(a["k"].alias("k"), (a["n"] - b["n"]).alias("n")))
        both = F.when(F.col("m") > 1, F.array(child(F.col("first"), half, F.col("left")), child(F.col("first") + half, F.col("m") - half, rest))).otherwise(F.array(child(F.col("first"), F.col("m"), F.col("counts"))))
        nodes = split.select(F.explode(both).alias("c"), "per").select("c.*", "per")
        level *= 2
    return nodes.select(F.col("first").alias("shard"), F.explode("counts").alias("c")).select("shard", F.col("c.k").alias("k"), F.col("c.n").alias("quota"))


class Mix:
    """How a table's documents are taken: sources with targets, and blocks with their passes and shards."""

    def __init__(self, docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, shards: int = SHARDS, blocks: int = BLOCKS, seed: int = SEED, max_sources: int | None = None, row_sources: int = ROW_SOURCES) -> None:
        self.docs, self.doc_id, self.text, self.source, self.blocks, self.shards, self.seed = docs, doc_id, text, source, blocks, shards, seed
        self.sized = settle(self.keyed(docs).select(F.col(f"`{doc_id}`").alias("id"), "__k", "__size", "__h"), "sizes")
        block = self.sized.groupBy(F.col("__k").alias("k"), self.b1().alias("b1")).agg(F.sum("__size").alias("words"), F.count(F.lit(1)).alias("docs"))
        block = settle(block, "blocks")
        self.sources = settle(targets(block.groupBy("k").agg(F.sum("words").alias("source_size")), weights, share, most), "targets")
        self.n_sources = self.sources.count()
        if max_sources is not None and self.n_sources > max_sources:
            raise ValueError(f"{self.n_sources} sources; max_sources is {max_sources}")
        passes = F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
        whole = self.sources.withColumn("passes", passes).withColumn("rest", (F.round("target") - F.col("passes") * F.col("source_size")).cast("bigint"))
        order = [F.xxhash64(F.lit(seed), F.lit("pass"), "k", "b1"), F.col("b1")]
        cut = settle(_cut(block.join(whole, "k"), ["k"], "rest", order), "cut")
        units = cut.where("words > 0").select("k", "b1", F.explode(F.when(F.col("part") > 0, F.sequence(F.lit(0), F.col("passes"))).when(F.col("passes") > 0, F.sequence(F.lit(0), F.col("passes") - 1)).otherwise(F.array().cast("array<int>"))).alias("pass"))
        self.quotas = settle(quotas(units.groupBy("k").agg(F.count(F.lit(1)).alias("n")), shards, seed, self.n_sources, row_sources), "quotas")
        span = Window.partitionBy("k").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
        slots = self.quotas.withColumn("end", F.sum("quota").over(span)).where("quota > 0").select("k", "shard", F.explode(F.sequence(F.col("end") - F.col("quota") + 1, F.col("end"))).alias("slot"))
        drawn = units.withColumn("slot", F.row_number().over(Window.partitionBy("k").orderBy(F.xxhash64(F.lit(seed), F.lit("shard"), "k", "b1", "pass"), "b1", "pass")).cast("bigint"))
        placed = drawn.join(slots, ["k", "slot"]).groupBy("k", "b1").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("draws"))
        self.cut = settle(cut.join(placed, ["k", "b1"], "left").select("k", "b1", "words", "part", "passes", "rest", "target", "source_size", "draws"), "drawn")
        self._edges()

    def keyed(self, docs: DataFrame) -> DataFrame:
        h = F.xxhash64(F.lit(self.seed), f"`{self.doc_id}`", f"`{self.text}`")
        return docs.withColumns({"__k": _key(F.col(f"`{self.source}`").cast("string")), "__size": words_of(F.col(f"`{self.text}`").cast("string")), "__h": h})

    def b1(self) -> Column:
        return F.pmod("__h", F.lit(self.blocks))

    def b2(self) -> Column:
        return F.pmod(F.shiftright("__h", 24), F.lit(1024))

    def _edges(self) -> None:
        """The edge block of each source, its edge sub-block, and the documents taken there."""
        edge = self.cut.where("part > 0 and part < words").select(F.col("k").alias("__k"), F.col("b1").alias("__b1"), F.col("part").alias("rest"))
        inside = settle(self.sized.withColumn("__b1", self.b1()).join(edge, ["__k", "__b1"]).withColumn("__b2", self.b2()), "edge")
        subs = inside.groupBy("__k", "__b1", "__b2").agg(F.sum("__size").alias("words"), F.first("rest").alias("rest"))
        self.subs = settle(_cut(subs, ["__k", "__b1"], "rest", [F.col("__b2")]).select("__k", "__b1", "__b2", F.col("words").alias("sub_words"), F.col("part").alias("sub_part")), "subs")
        at = inside.join(self.subs.where("sub_part > 0 and sub_part < sub_words"), ["__k", "__b1", "__b2"])
        at = at.groupBy("__k", "__b1", "__b2", "__h", "__size").agg(F.count(F.lit(1)).alias("same"), F.first("sub_part").alias("rest")).withColumn("words", F.col("__size") * F.col("same"))
        self.last = settle(_cut(at, ["__k", "__b1", "__b2"], "rest", [F.col("__h"), F.col("__size")]).select("__k", "__b1", "__b2", "__h", "__size", F.floor(F.col("part") / F.col("same")).alias("doc_part")), "last")

    def _sent(self, t: DataFrame, rows: int) -> DataFrame:
        """Sent to all executors only if so many rows are bound to fit."""
        return F.broadcast(t) if rows <= MOST_SENT else t

    def taken(self, keyed: DataFrame) -> DataFrame:
        """keyed() rows with source_size, target, __draws (passes and shards of the row's block) and __part (words of the partial pass)."""
        cut = self._sent(self.cut.select(F.col("k").alias("__k"), F.col("b1").alias("__b1"), "words", "part", "passes", "target", "source_size", F.col("draws").alias("__draws")), self.n_sources * self.blocks)
        rows = keyed.withColumn("__b1", self.b1()).withColumn("__b2", self.b2()).join(cut, ["__k", "__b1"])
        rows = rows.join(self._sent(self.subs, self.n_sources * 1024), ["__k", "__b1", "__b2"], "left").join(self.last, ["__k", "__b1", "__b2", "__h", "__size"], "left")
        edge = F.when(F.col("sub_part") == 0, F.lit(0)).when(F.col("sub_part") == F.col("sub_words"), F.col("__size")).otherwise(F.coalesce("doc_part", F.lit(0)))
        part = F.when(F.col("part") == 0, F.lit(0)).when(F.col("part") == F.col("words"), F.col("__size")).otherwise(edge)
        return rows.withColumn("__part", part.cast("bigint"))

    def counted(self) -> DataFrame:
        """Per row: id, size, source_size, target, taken (words of all passes) and shards (of each pass)."""
        rows = self.taken(self.sized)
        shards = F.transform(F.coalesce("__draws", F.array().cast("array<struct<pass:int,shard:int>>")), lambda d: d["shard"])
        return rows.select(F.col("id").alias(self.doc_id), F.col("__size").alias("size"), "source_size", "target", (F.col("passes") * F.col("__size") + F.col("__part")).cast("bigint").alias("taken"), shards.alias("shards"))

    def rows(self) -> DataFrame:
        """The mixture: docs' columns with shard, pass, position and partial (only the text's first words are taken), one row for each
        time a document is taken, shuffled in its shard."""
        names = [c for c in self.docs.columns if c.lower() not in ("shard", "pass", "position", "partial")]
        rows = self.taken(self.keyed(self.docs)).withColumn("__d", F.explode("__draws"))
        words = F.when(F.col("__d.pass") < F.col("passes"), F.col("__size")).otherwise(F.col("__part"))
        # the first words with the white space before each, as they stand
        cut = F.array_join(F.slice(F.regexp_extract_all(F.col(f"`{self.text}`").cast("string"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, words.cast("int")), "")
        partial = words < F.col("__size")
        text = F.when(partial, cut).otherwise(F.col(f"`{self.text}`"))
        position = F.xxhash64(F.lit(self.seed), F.lit("row"), "__h", "__d.pass")
        out = rows.where(words > 0).select(*(text.alias(c) if c == self.text else F.col(f"`{c}`") for c in names), F.col("__d.shard").alias("shard"), F.col("__d.pass").alias("pass"), position.alias("position"), partial.alias("partial"))
        # a shard may be far larger than a task: it is shuffled in slices of its position, as many as the words taken ask for
        taken = self.sources.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
        tasks = max(partitions(out.sparkSession), -(-int(taken) // TASK_WORDS))
        slices = max(1, -(-32 * tasks // self.shards))  # many for each task, so that tasks are even
        return out.repartition(tasks, "shard", F.pmod("position", F.lit(slices))).sortWithinPartitions("shard", "position")
