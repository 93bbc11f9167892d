"""Secret scans by multipart credential linking, with DataFrame functions only.

Base spans stand by themselves: assignments, access identifiers and long hex runs. Weak candidates (a 40-character key-like
string, a 20-character upper-case identifier, an endpoint) are reported only if at most ``reach`` code points lie
between them and each part that complements them: a weak secret needs an access identifier; a weak identifier needs a secret and an endpoint; an endpoint
needs an access identifier and a secret. Positions are found without leaving the JVM: the pieces between a pattern's matches and the
matches add up to code-point offsets.

Linking is an interval join within a text: over the parts of a role by their start, the greatest end so far is kept; a candidate
looks it up at the last place where a partner in reach may start. That end decides exactly whether a partner is in reach, however long
the parts are, so a text with many parts makes rows in proportion to its parts, never pairs. Texts that occur often are linked once.

Defined cases: null texts are empty and have no spans; equal rows get equal spans; spans may overlap (kinds are searched apart).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import settle

REACH = 256
#: Fixed patterns of the base kinds, in their order; a match counts from the given length on.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "weaksecret", "weakid", "endpoint")
WEAK = {
    "weaksecret": r"(?<![A-Za-z0-9/+])(?=[A-Za-z/+]*[0-9])(?=[a-z0-9/+]*[A-Z])(?=[A-Z0-9/+]*[a-z])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])",
    "weakid": r"(?<![A-Za-z0-9])(?=[A-Z]*[0-9])(?=[0-9]*[A-Z])(?!AKIA)[A-Z0-9]{20}(?![A-Za-z0-9])",
    "endpoint": r"[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]+",
}
#: What a weak kind needs nearby: roles are access (0), secret (1), endpoint (2).
NEEDS = {"weaksecret": (0,), "weakid": (1, 2), "endpoint": (0, 1)}
ROLE = {"assign": 1, "access": 0, "hex": 1, "weaksecret": 1, "weakid": 0, "endpoint": 2}
SPAN = "array<struct<start:int,end:int,kind:int>>"
CHUNK = 256


def _spans(text: Column, pattern: str, kind: str, least: int = 0) -> Column:
    """The matches of a pattern as spans. Offsets are summed by chunks, so that many matches stay cheap."""
    k = F.lit(KINDS.index(kind))
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    # (length before, length of match, length of group 2) of each match
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if least else matches
    parts = F.zip_with(F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("len"))), groups, lambda x, g: F.struct(x["gap"].alias("gap"), x["len"].alias("len"), F.length(g).alias("own")))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / CHUNK).cast("int")), lambda c: F.slice(parts, c * CHUNK + 1, CHUNK))

    def inner(chunk: Column) -> Column:
        empty = F.array().cast(SPAN)
        start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
        step = lambda a, x: F.struct((a["at"] + x["gap"] + x["len"]).alias("at"), F.array_append(a["out"], F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["len"]).alias("end"), F.when(x["own"] >= least, k).otherwise(F.lit(-1)).alias("kind"))).alias("out"))
        return F.aggregate(chunk, start, step)

    done = F.transform(chunks, inner)
    state = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
    shift = lambda o, a: F.transform(o, lambda s: F.struct((s["start"] + a).alias("start"), (s["end"] + a).alias("end"), s["kind"].alias("kind")))
    joined = F.flatten(F.aggregate(done, state, lambda a, c: F.struct((a["at"] + c["at"]).alias("at"), F.array_append(a["out"], shift(c["out"], a["at"])).alias("out")))["out"])
    return F.when(text.rlike(pattern), F.filter(joined, lambda s: s["kind"] >= 0)).otherwise(F.array().cast(SPAN))


def _sorted(spans: Column) -> Column:
    """By start, then kind: the order of the struct (start, kind, end)."""
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.transform(keyed, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None, reach: int = REACH) -> DataFrame:
    """docs with base_spans and spans (base and linked ones), sorted by start and kind."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("base_spans", "spans")]
    t = F.coalesce(F.col("__text"), F.lit(""))
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").cast("string").alias("__text"))
    base = _sorted(F.concat(_spans(t, ASSIGN, "assign", 6), _spans(t, ACCESS, "access"), _spans(t, HEX, "hex")))
    # by NEEDS and ROLE, all links have an endpoint but that of a weak secret to an access identifier, strong or weak
    # either identifier is a run of 20 capitals and digits, which prose lacks: it is looked for first
    may = t.contains("://") | t.rlike("[A-Z0-9]{20}") & t.rlike(WEAK["weaksecret"]) & (t.contains("AKIA") | t.rlike(WEAK["weakid"]))
    plain = rows.where(~may).select(*(f"`{c}`" for c in keep), base.alias("base_spans")).select("*", F.col("base_spans").alias("spans"))
    # written out: it has few rows, and filters inferred from the explosion below mustn't search all texts again
    marked = rows.where(may).select(*(f"`{c}`" for c in keep), base.alias("base_spans"), F.concat(*(_spans(t, p, k) for k, p in WEAK.items())).alias("__weak"), F.sha2(t, 256).alias("__key"))
    marked = settle(marked, "candidates")
    linked = _link(marked, reach)
    added = F.coalesce("__linked", F.array().cast(SPAN))
    joined = marked.join(linked, "__key", "left").select(*(f"`{c}`" for c in keep), "base_spans", _sorted(F.concat("base_spans", added)).alias("spans"))
    return plain.union(joined)


def _link(marked: DataFrame, reach: int) -> DataFrame:
    """(__key, __linked): the weak spans of each text that have all they need within reach."""
    part = F.explode(F.concat("base_spans", "__weak")).alias("s")
    parts = marked.where(F.size("__weak") > 0).select("__key", part).select("__key", "s.start", "s.end", "s.kind").distinct()
    role = reduce(lambda a, kv: F.when(F.col("kind") == KINDS.index(kv[0]), F.lit(kv[1])).otherwise(a), ROLE.items(), F.lit(-1))
    needs = reduce(lambda a, kv: F.when(F.col("kind") == KINDS.index(kv[0]), F.array(*map(F.lit, kv[1]))).otherwise(a), NEEDS.items(), F.array().cast("array<int>"))
    none = F.lit(None).cast("int")
    # a part stands at its start; a probe at the last place where a partner may start, after the parts there
    stand = parts.select("__key", role.alias("role"), F.col("start").alias("at"), F.lit(0).alias("probe"), F.col("end").alias("reaches"), none.alias("start"), none.alias("end"), none.alias("kind"), none.alias("asked"))
    probes = parts.where(F.col("kind") >= 3).select("*", F.explode(needs).alias("role"), F.size(needs).alias("asked"))
    probes = probes.select("__key", "role", (F.col("end") + reach).alias("at"), F.lit(1).alias("probe"), none.alias("reaches"), "start", "end", "kind", "asked")
    so_far = Window.partitionBy("__key", "role").orderBy("at", "probe").rowsBetween(Window.unboundedPreceding, 0)
    met = stand.union(probes).withColumn("furthest", F.max("reaches").over(so_far)).where((F.col("probe") == 1) & (F.col("furthest") >= F.col("start") - reach))
    found = met.groupBy("__key", "start", "end", "kind").agg(F.countDistinct("role").alias("roles"), F.first("asked").alias("asked")).where("roles = asked")
    return found.groupBy("__key").agg(F.collect_list(F.struct("start", "end", "kind")).alias("__linked"))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans, which are sorted by start, replaced by a mark.

    Spans go by chunks, each over the stretch of text that it covers, so that the work follows the text's length even with many spans.
    """
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / CHUNK).cast("int")), lambda c: F.slice(spans, c * CHUNK + 1, CHUNK))
    furthest = F.transform(chunks, lambda c: F.array_max(F.transform(c, lambda s: s["end"])))
    # where the spans before each chunk end
    before = F.aggregate(furthest, F.array(F.lit(0)), lambda a, e: F.array_append(a, F.greatest(F.element_at(a, -1), e)))

    def piece(chunk: Column, at: Column, to: Column) -> Column:
        own = F.transform(F.array(F.substring(text, at + 1, to - at)), lambda t: inner(chunk, at, t))
        return own[0]

    def inner(chunk: Column, at: Column, stretch: Column) -> Column:
        start = F.struct(at.alias("at"), F.array().cast("array<string>").alias("out"))

        def step(a: Column, s: Column) -> Column:
            shown = F.when(s["start"] >= a["at"], F.concat(F.substring(stretch, a["at"] - at + 1, s["start"] - a["at"]), F.lit(mark))).otherwise(F.lit(""))
            return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.array_append(a["out"], shown).alias("out"))

        return F.array_join(F.aggregate(chunk, start, step)["out"], "")

    bounds = F.zip_with(F.slice(before, 1, F.size(chunks)), F.slice(before, 2, F.size(chunks)), lambda a, b: F.struct(a.alias("at"), b.alias("to")))
    pieces = F.zip_with(chunks, bounds, lambda c, b: piece(c, b["at"], b["to"]))
    tail = F.substring(text, F.element_at(before, -1) + 1, F.length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(text)


def digest(scanned: DataFrame) -> DataFrame:
    """scan()'s spans as counts and digests."""
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == KINDS.index(k))).cast("bigint")
    return scanned.select("*", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(written(F.col("base_spans")), 256).alias("base_sha256"), written(F.col("spans")).alias("written")).drop("base_spans", "spans").withColumnRenamed("written", "spans")
