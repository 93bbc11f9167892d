"""Operators whose results brute force can give: every case against it, on hard small tables."""

from __future__ import annotations

import hashlib
import inspect
import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantalume.llm import _common, components, decontaminate, lmscore, mixing, neardup, secret_scan, vecdup, warc

from .conftest import Forest, alnum, spaced


def key(x):
    return tuple((v is not None, v if v is not None else 0) for v in x)


def test_word_kernel():
    import pyarrow as pa

    texts = ["Ab aB", None, "", "é É 世界 x\x0by", " a ", "x" * 70]
    for table, words in ((_common.SPACED, spaced), (_common.ALNUM, alnum)):
        seen = {}
        for i, j, h, at in _common.hashed(pa.array(texts), table):
            for d in range(i, j):
                own = h[at[d - i] : at[d - i + 1]].tolist()
                assert len(own) == len(words(texts[d]))
                assert all(seen.setdefault(w, x) == x for w, x in zip(words(texts[d]), own, strict=True))
        assert len(set(seen.values())) == len(seen)


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (9, 9), (None, 1)] + [(i, i + 1) for i in range(100, 140)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4} | {i: 100 for i in range(100, 141)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block_words", [2_000_000, 40])
def test_decontaminate(spark, docs, no_docs, block_words):
    texts = [r.text for r in docs.where("doc_id in (4, 7, 130)").collect()]
    items = [(str(i), t) for i, t in enumerate(texts)] + [("s", "the house"), ("s", "the house"), ("n", None), ("e", "--"), (None, "river"), ("q", "nowhere at all")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    windows = defaultdict(set)
    for ident, t in items:
        w = alnum(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(ident or "")
    lengths = {len(k) for k in windows}

    def brute(t):
        w = alnum(t)
        hit, found = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[g]
        return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)

    out = decontaminate.digest(decontaminate.mark(docs, bench, block_words=block_words))
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out.collect()), key=key)
    assert got == sorted(((r.doc_id, *brute(r.text)) for r in docs.collect()), key=key)
    assert decontaminate.mark(no_docs, bench).count() == 0
    assert decontaminate.digest(decontaminate.mark(docs, bench.limit(0))).where("n_hit > 0").count() == 0


@pytest.mark.parametrize("shingle", [4, 5])
def test_near_duplicates(docs, no_docs, shingle):
    rows = docs.select("doc_id", "text").collect()

    def shingles(t):
        w = spaced(t)
        return frozenset(tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))) if w else frozenset()

    sets = [shingles(r.text) for r in rows]
    f = Forest()
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                f.join(i, j)
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[f.find(i)] = min(least.get(f.find(i), r.doc_id), r.doc_id)
    want = sorted(((r.doc_id, len(sets[i]), least.get(f.find(i)), r.doc_id == least.get(f.find(i))) for i, r in enumerate(rows)), key=key)
    got = sorted((tuple(r) for r in neardup.near_duplicates(docs, shingle=shingle).collect()), key=key)
    assert got == want
    assert sum(not r[3] for r in got) > 10
    assert neardup.near_duplicates(no_docs).count() == 0


def test_near_duplicates_of_a_chain(spark):
    """Each text is near the next only: later rounds must join what the stars left apart."""
    rows = [(i, " ".join(f"w{k}" for k in range(5 * i, 5 * i + 64))) for i in range(60)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()
    assert {r.component_id for r in got} == {0}


def test_near_duplicates_of_a_star(spark, monkeypatch):
    """A hub with thousands of near copies of its own: hot buckets, stars and components are dealt over tasks, and nothing is lost."""
    monkeypatch.setattr(_common, "HOT_ROWS", 50)
    base = [f"w{k}" for k in range(120)]
    rows = [(i, " ".join([*base[: 40 + i % 70], f"x{i}", *base[41 + i % 70 :]])) for i in range(1500)] + [(2000 + i, f"alone {i} b c d e {i}") for i in range(300)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(i, 0) for i in range(1500)] + [(2000 + i, 2000 + i) for i in range(300)]


def test_near_duplicates_in_few_jobs(spark, monkeypatch):
    """Jobs cost time by their number where tasks are many: links too few for rounds over the cluster, and buckets too small for a second star, go without."""
    r = np.random.default_rng(8)
    words = [[f"w{i}x{k}" for k in range(100)] for i in range(40)]
    texts = [[f"y{r.integers(1000)}" if r.random() < share else w for w in words[i % 40]] for i in range(240) for share in [0.01 * (i // 40)]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(1000 + i, " ".join(f"w{k}" for k in range(5 * i, 5 * i + 64))) for i in range(60)], "doc_id long, text string")

    def found(group):
        spark.sparkContext.setJobGroup(group, group)
        try:
            rows = sorted(map(tuple, neardup.near_duplicates(df, shingle=4).collect()))
            return rows, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    got, jobs = found("few")
    assert jobs < 120
    f = Forest()
    sets = {i: {tuple(w[k : k + 4]) for k in range(len(w) - 3)} for i, t in df.collect() for w in [t.split()]}
    for i, j in itertools.combinations(sets, 2):
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            f.join(i, j)
    assert got == [(i, len(sets[i]), f.find(i), i == f.find(i)) for i in sorted(sets)]
    monkeypatch.setattr(components, "LOCAL_EDGES", 0)
    monkeypatch.setattr(neardup, "DIRECT", 0)
    monkeypatch.setattr(neardup, "STAR", 2)
    again, rounds = found("rounds")
    assert again == got and rounds > jobs


def test_few_and_many_edges(spark, monkeypatch):
    """Components are the same in one process as in rounds over the cluster."""
    r = np.random.default_rng(6)
    edges = spark.createDataFrame([tuple(x) for x in r.integers(-300, 300, (260, 2)).tolist()] + [(None, 3), (4, None), (900, 900), (2**62, -(2**62))], "a long, b long")
    few = sorted(map(tuple, components.components(edges).collect()))
    monkeypatch.setattr(components, "LOCAL_EDGES", 0)
    assert few == sorted(map(tuple, components.components(edges).collect())) and len({x[1] for x in few}) > 20


def test_salted_join(spark):
    many = spark.range(3000).select(F.when(F.col("id") % 3 != 0, F.lit(7)).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id")).cast("int").alias("k"), "id").cache()
    few = spark.range(0, 3000, 7).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("v"))
    assert [tuple(r) for r in _common.hot_keys(many, "k").collect()] == [(7, 2)]
    for how in ("inner", "left"):
        got, want = (sorted(map(str, d.select("k", "id", "v").collect())) for d in (_common.salted_join(many, few, "k", "id", how), many.join(few, "k", how)))
        assert got == want


def test_rows_of_one_id(spark):
    """Rows are documents of their own: a near copy goes, though another row of its id stays."""
    x, y = " ".join(f"x{k}" for k in range(60)), " ".join(f"y{k}" for k in range(60))
    rows = [(5, x, 1), (5, y, 2), (3, f"{y} z", 3), (5, x, 4), (None, x, 5), (None, "p q r s t u v", 6), (None, "p q r s t u v", 7), (9, " ", 8), (9, " ", 9), (None, None, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k1 int")
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in neardup.near_duplicates(df).collect())
    assert got == sorted([(5, 5, True), (5, 3, False), (3, 3, True), (5, 5, True), (-1, 5, False), (-1, -1, True), (-1, -1, True), (9, 9, True), (9, 9, True), (-1, -1, True)])
    kept = neardup.representatives(df)
    assert kept.columns == df.columns
    left = sorted((str(r.doc_id), str(r.text)) for r in kept.collect())
    assert left == sorted([("5", x), ("3", f"{y} z"), ("None", "p q r s t u v"), ("9", " "), ("9", " "), ("None", "None")])


def test_registers_merge_and_estimate():
    r = np.random.default_rng(3)
    a, b = r.integers(0, 1 << 63, (2, 900), dtype=np.uint64)
    u, v = np.concatenate([a, b[:100]]), np.concatenate([a[:800], b])
    ku, kv, both = (neardup.registers(x, np.array([0, len(x)]))[0] for x in (u, v, np.concatenate([u, v])))
    assert (np.maximum(ku, kv) == both).all()
    j = len({*u.tolist()} & {*v.tolist()}) / len({*u.tolist()} | {*v.tolist()})
    got = neardup.likeliest(np.array([float(len(u))]), np.array([float(len(v))]), np.array([(ku > kv).sum()]), np.array([(ku < kv).sum()]))[0]
    assert abs(got - j) < 0.15
    # the slope at the floor tells on which side of it the likelihood peaks
    sketches = np.stack([neardup.registers(np.unique(np.concatenate([a[:k], b[: 900 - k]])), np.array([0, len(np.unique(np.concatenate([a[:k], b[: 900 - k]])))]))[0] for k in range(300, 900, 20)])
    n = np.full(len(sketches) - 1, 900)
    x, y = sketches[:-1], np.broadcast_to(sketches[-1], (len(sketches) - 1, neardup.M))
    peak = neardup.likeliest(n.astype(float), n.astype(float), (x > y).sum(1), (x < y).sum(1))
    told = neardup._promising(n, n, x, y, 0.8, 0.55)
    assert (told == (peak >= 0.55))[np.abs(peak - 0.55) > 0.011].all() and 0 < told.sum() < len(told)


@pytest.mark.parametrize(("order", "min_count", "leave_out", "bucket_bytes"), [(2, 1, True, 1 << 23), (2, 2, False, 1 << 23), (3, 1, False, 500), (3, 2, True, 500), (1, 1, True, 1 << 23)])
def test_lm_scores(docs, no_docs, order, min_count, leave_out, bucket_bytes, monkeypatch):
    monkeypatch.setattr(lmscore, "PACK_BYTES", 3000)
    rows = docs.collect()

    def grams(t):
        w = spaced(t)
        return Counter(g for n in range(1, order + 1) for g in zip(*(w[k:] for k in range(n)), strict=False))

    counts = Counter()
    for r in rows:
        counts.update(grams(r.text))
    total = sum(n for k, n in counts.items() if len(k) == 1)

    def brute(t):
        w, own = spaced(t), grams(t) if leave_out else Counter()
        others = max(1, total - len(w)) if leave_out else total

        def log_s(i, n):
            if n == 1:
                return math.log((counts[w[i],] - own[w[i],] or 0.4) / others)
            gram = tuple(w[i - n + 1 : i + 1]) if i >= n - 1 else None
            if gram and counts[gram] - own[gram] >= min_count:
                return math.log((counts[gram] - own[gram]) / (counts[gram[:-1]] - own[gram[:-1]]))
            return math.log(0.4) + log_s(i, n - 1)

        return len(w), round(sum(log_s(i, order) for i in range(len(w))) / len(w), 8) if w else None

    options = {"order": order, "min_count": min_count, "leave_out": leave_out, "bucket_bytes": bucket_bytes}
    got = [(r.doc_id, r.n_words, None if r.lm_score is None else round(r.lm_score, 8)) for r in lmscore.score(docs, **options).collect()]
    assert sorted(got, key=key) == sorted(((r.doc_id, *brute(r.text)) for r in rows), key=key)
    assert lmscore.score(no_docs, **options).count() == 0
    one = docs.where("doc_id = 4")
    assert lmscore.score(one, **options).first().n_words == len(spaced(one.first().text))


def test_mixing(docs, no_docs):
    m = mixing.Mix(docs, shards=5, blocks=8)
    got = m.counted().collect()
    sizes, by = Counter(), {}
    for r in docs.collect():
        sizes[r.source] += len(spaced(r.text))
        by[r.doc_id, len(spaced(r.text))] = r.source
    names = [*sorted(k for k in sizes if k is not None), None]
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    left, target, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        level = left / sum(weight[k] for k in free)
        over = [k for k in free if level * weight[k] > 2 * sizes[k]]
        if not over:
            target |= {k: level * weight[k] for k in free}
            break
        for k in over:
            target[k] = 2.0 * sizes[k]
            left -= target[k]
            free.discard(k)
    taken = Counter()
    for r in got:
        assert r.taken <= 2 * r.size
    for r in m.taken(m.keyed(docs)).selectExpr("source", "source_size", "target", "passes * __size + __part as taken").collect():
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
        taken[r.source] += r.taken
    assert all(abs(taken[k] - target[k]) <= 1 for k in names) and len(got) == docs.count()
    again = mixing.Mix(docs.repartition(7), shards=5, blocks=8).counted()
    assert sorted(map(str, got)) == sorted(map(str, again.collect()))
    rows = m.rows()
    whole = {(r.doc_id, r.source, len(spaced(r.text))): r.text for r in docs.collect()}
    texts = {t for t in whole.values() if t}
    for r in rows.collect():
        assert not r.partial and r.text in texts or r.partial and any(t.startswith(r.text) and len(t) > len(r.text) for t in texts)
    words = {r.source: r.w for r in rows.select("source", mixing.words_of(F.col("text")).alias("w")).groupBy("source").agg(F.sum("w").alias("w")).collect()}
    assert words == {k: v for k, v in taken.items() if v}
    quota = [r.q for r in m.quotas.groupBy("shard").agg(F.sum("quota").alias("q")).collect()]
    assert len(quota) == 5 and max(quota) - min(quota) <= 2
    assert mixing.Mix(no_docs).counted().count() == 0 and mixing.Mix(no_docs).rows().count() == 0
    with pytest.raises(ValueError):
        mixing.Mix(docs, max_sources=2)


@pytest.mark.parametrize("row_sources", [2, 7, 1000])
def test_quotas_by_groups(spark, row_sources):
    """Groups of sources in rows of their own: shards stay even, and every source's blocks are all dealt."""
    n = {f"0s{i:03d}": 1 + i * 37 % 90 for i in range(60)}
    got = mixing.quotas(spark.createDataFrame(list(n.items()), "k string, n bigint"), 5, 3, row_sources=row_sources).collect()
    assert len(got) == 300 and all(r.quota >= 0 for r in got)
    by_source, by_shard = Counter(), Counter()
    for r in got:
        by_source[r.k] += r.quota
        by_shard[r.shard] += r.quota
    assert by_source == n and max(by_shard.values()) - min(by_shard.values()) <= 2
    # a source's share of a shard is near its share of all
    total = sum(n.values())
    assert sum((r.quota - n[r.k] / 5) ** 2 / (n[r.k] / 5 * 4 / 5) for r in got) / 300 * total / (total - 1) < 1.3


def test_mixing_by_groups(spark, docs):
    """Rows of two sources at most: the same words are taken, and all rows are placed; no number of sources is refused by default."""
    whole, groups = (mixing.Mix(docs, shards=5, blocks=8, row_sources=n) for n in (1000, 2))
    taken = lambda m: sorted(str((r.doc_id, r.size, r.taken, len(r.shards))) for r in m.counted().collect())
    assert taken(whole) == taken(groups)
    quota = lambda m, k: sorted((r[k], r.q) for r in m.quotas.groupBy(k).agg(F.sum("quota").alias("q")).collect())
    assert quota(whole, "k") == quota(groups, "k") and max(q for _, q in quota(groups, "shard")) - min(q for _, q in quota(groups, "shard")) <= 2
    assert inspect.signature(mixing.Mix).parameters["max_sources"].default is None


def test_hypergeometric_law(spark):
    n, good, draws = 40, 15, 18
    sql = mixing._hypergeometric(f"{n}L", f"{good}L", f"{draws}L", "u")
    seen = Counter(r[0] for r in spark.range(8000).selectExpr("(id + 0.5D) / 8000 as u").selectExpr(sql).collect())
    for x in range(draws + 1):
        assert abs(seen[x] / 8000 - math.comb(good, x) * math.comb(n - good, draws - x) / math.comb(n, draws)) < 0.002


def test_secrets(spark, no_docs):
    secret = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKE1"
    access = "AKIA" + "B7" * 8
    texts = ["é😀 password=abcdef x", "secret=token:abcdefghij", f"AKIA{access} {secret}", f"{secret} alone", f"{access}{' ' * 400}{secret}", f"{access} {secret} https://x.y/z", "PASSWD: 'a' token=\"0123456789\"", None, "", "token=abcdef " * 700, "ab" * 40 + "AKIA123", "https://x.y/z only"]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(5, texts[5], 1), (None, texts[5], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = secret_scan.digest(secret_scan.scan(df, keep=["doc_id", "text"])).collect()
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    for r in got:
        t = r.text or ""
        base = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        text = ",".join(f"{secret_scan.KINDS[k]}:{a}:{e}" for a, k, e in sorted(base))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in base) for i in range(3)]
    spans = {r.doc_id: r.spans for r in got}
    assert spans[2] == "access:0:24,weaksecret:25:65" and spans[3] == "" and "weak" not in spans[4] and spans[11] == ""
    assert spans[5] == spans[None] == "access:0:20,weaksecret:21:61,endpoint:62:75"
    assert len(spans[9].split(",")) == 700
    clean = secret_scan.scan(df).withColumn("text", secret_scan.redacted(F.col("text"), F.col("spans")))
    assert {r.doc_id: r.text for r in clean.collect()}[0] == "é😀 [SECRET] x"
    assert secret_scan.scan(no_docs).count() == 0


def test_secrets_of_long_texts(spark):
    """Thousands of parts in one text are linked and replaced in their order."""
    secret, access = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKE1", "AKIA" + "B7" * 8
    text = f"{access} {secret} and so on, token=abcdef1 " * 8_000
    scanned = secret_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    got = scanned.select(F.size("base_spans").alias("b"), F.size("spans").alias("n"), secret_scan.redacted(F.col("text"), F.col("spans")).alias("clean")).first()
    assert (got.b, got.n) == (16_000, 24_000) and got.clean == "[SECRET] [SECRET] and so on, [SECRET] " * 8_000


def test_weak_pairs_need_no_marker(spark):
    """A weak identifier next to a weak secret links by itself; an endpoint far away changes nothing."""
    secret, ident = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKE1", "B7" * 10
    pair = f"{ident} {secret}"
    texts = [pair, f"{pair}{' ' * 100_000}https://x.y/z", f"{ident} alone", f"{ident}{' ' * 400}{secret}", f"{pair} https://x.y/z"]
    scanned = secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r.doc_id: r for r in scanned.select("*", secret_scan.written(F.col("spans")).alias("w"), secret_scan.redacted(F.col("text"), F.col("spans")).alias("clean")).collect()}
    assert [got[i].w for i in range(5)] == ["weaksecret:21:61", "weaksecret:21:61", "", "", "weakid:0:20,weaksecret:21:61,endpoint:62:75"]
    assert got[0].clean == f"{ident} [SECRET]"


def test_reach_is_the_gap_between_spans(spark):
    """Against all pairs of spans, with spans longer than the reach and gaps around it."""
    r = np.random.default_rng(4)
    secret, access, ident = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKE1", "AKIA" + "B7" * 8, "C8" * 10
    make = {"assign": lambda: "token=" + "z" * int(r.choice([8, 300, 900])), "access": lambda: access, "hex": lambda: "ab" * int(r.choice([12, 400])), "weaksecret": lambda: secret, "weakid": lambda: ident, "endpoint": lambda: "https://" + "y" * int(r.choice([3, 500]))}
    texts, spans = [f"token={'z' * 300} {ident} https://x.y/z"], [[("assign", 0, 306), ("weakid", 307, 327), ("endpoint", 328, 341)]]
    for _ in range(150):
        text, own = "", []
        for kind in r.choice(list(make), int(r.integers(1, 6))):
            text += " " * int(r.choice([1, 100, 255, 256, 257, 400]))
            own.append((str(kind), len(text), len(text := text + make[kind]())))
        texts.append(text)
        spans.append(own)
    roles, needs = secret_scan.ROLE, secret_scan.NEEDS
    near = lambda p, q: max(q[1] - p[2], p[1] - q[2]) <= 256
    want = [[p for p in own if all(any(roles[q[0]] == n and near(p, q) for q in own) for n in needs.get(p[0], ()))] for own in spans]
    scanned = secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {x.doc_id: x.w for x in scanned.select("doc_id", secret_scan.written(F.col("spans")).alias("w")).collect()}
    assert [got[i] for i in range(len(texts))] == [",".join(f"{k}:{a}:{e}" for k, a, e in w) for w in want]
    assert len(got[0].split(",")) == 3


def test_redacted(spark):
    """Against a loop, with more spans than a chunk, nested, overlapping and touching ones, and characters beyond the basic plane."""
    r = np.random.default_rng(8)
    rows = []
    for n in (0, 1, 5, 255, 256, 257, 700):
        text = "".join(r.choice(list("abé😀 ")) for _ in range(4 * n + 3))
        starts = np.sort(r.integers(0, len(text), n))
        rows.append((text, [(int(s), int(min(len(text), s + r.integers(1, 9))), 0) for s in starts]))
    rows.append(("x" * 2000, [(5, 1500, 0)] + [(i, i + 1, 0) for i in range(6, 900)] + [(1500, 1600, 0)]))
    df = spark.createDataFrame(rows, f"text string, spans {secret_scan.SPAN}")
    got = {x.text: x.out for x in df.select("text", secret_scan.redacted(F.col("text"), F.col("spans")).alias("out")).collect()}
    for text, spans in rows:
        out, at = "", 0
        for s, e, _ in spans:
            if s >= at:
                out += text[at:s] + "[SECRET]"
            at = max(at, e)
        assert got[text] == out + text[at:]


def test_vectors(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((400, 16))
    x[100:140] = x[99] + 0.02 * r.standard_normal((40, 16))
    x[200:210] = x[199] * np.arange(1, 11)[:, None]
    rows = [(i, v.astype(np.float32).tolist(), i % 2 if i < 90 else 0) for i, v in enumerate(x)]
    rows += [(500 + i, rows[99][1], 0) for i in range(5)] + [(600, None, 0), (601, [0.0] * 16, 0), (602, [None, *rows[99][1][1:]], 0), (603, [float("nan"), *rows[99][1][1:]], 0), (604, rows[99][1], None), (605, rows[99][1], None), (606, [1.0, 2.0], 0), (607, [2.0, 4.0], 0), (608, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    fit = [(i, np.array(v, float), lab) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    f, n = Forest(), Counter()
    for a, (i, u, lab) in enumerate(fit):
        for j, v, other in fit[:a]:
            if lab == other and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.98:
                f.join(i, j)
                n[i] += 1
                n[j] += 1
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vecdup.near_duplicates(df).collect()}
    assert got == {i: (n[i], f.find(i), f.find(i) == i) for i, _, _ in rows}
    assert vecdup.near_duplicates(df.limit(0)).count() == 0


def test_vectors_at_the_threshold(spark):
    """A cosine of exactly 0.98 links, and one below by the least that doubles can tell doesn't; extra columns clash with the result's."""
    rows = [(1, [1.0, 0.0, 0.0, 0.0], 0), (2, [49.0, 7.0, 5.0, 5.0], 0), (3, [98e20, 14e20, 10e20, 10e20], 0), (4, [49.0, 7.0, 5.0, 5.000000001], 0), (5, [1.0, 0.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame([(*r, 9, 9, 9) for r in rows], "vec_id long, embedding array<double>, label int, kept int, n_links int, id int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vecdup.near_duplicates(df).collect()}
    assert got == {1: (2, 1), 2: (3, 1), 3: (3, 1), 4: (2, 1), 5: (0, 5)}


def test_recall_of_vectors(spark):
    """Planted pairs at the threshold among 50,000 vectors: the traversal stops early and still meets them."""
    r = np.random.default_rng(7)
    x = r.standard_normal((48_000, 24)).astype(np.float32)
    y = x[:2500] / np.linalg.norm(x[:2500], axis=1, keepdims=True)
    off = r.standard_normal(y.shape)
    off -= (off * y).sum(1, keepdims=True) * y
    c = r.uniform(0.9801, 0.983, (2500, 1))
    y = c * y + np.sqrt(1 - c * c) * off / np.linalg.norm(off, axis=1, keepdims=True)
    every = np.concatenate([x.astype(float), y])
    import pyarrow as pa

    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(every)), "embedding": pa.array(list(every), pa.list_(pa.float64())), "label": np.arange(len(every)) % 48_000 % 3})).repartition(8)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vecdup.near_duplicates(df, sample=8_000).collect()}
    assert sum(got[48_000 + i][1] == got[i][1] for i in range(2500)) >= 0.995 * 2500
    books = vecdup.Codebooks(vecdup._unit(x[:8000].astype(float)), 77, 0.98, 0.999)
    assert books.level < 1 and np.mean([len(v) for v in books.cells(vecdup._unit(x[:500].astype(float)))[1]]) < 0.2 * 77 * 77


def test_warc(spark):
    rows = [(i, f"http://a.example/{i % 5}?q={i}", "<p>same</p>" * 20) for i in range(10)] + [(20, None, None), (21, "x y\r\nz", ""), (22, "http://b", "short"), (23, "http://b", "short"), (3, "http://again", "<p>same</p>" * 20), (None, "http://n", "é" * 60), (30, "http://n", "é" * 60), (-1, "http://[bad", "ü" * 99)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    first = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)

    def want(i, h):
        raw = (h or "").encode()
        f = first.get(h, i)
        return (i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if f == i else "revisit", None if f == i else f)

    history, folder = warc.archive(df)
    got = [(r.page, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(history, folder).collect()]
    text = lambda v: None if v is None else str(v)
    assert sorted(map(str, got)) == sorted(str((text(w[0]), *w[1:4], text(w[4]))) for w in (want(i, h) for i, _, h in rows))
    assert sorted((tuple(r) for r in warc.round_trip(df).collect()), key=key) == sorted((want(i, h) for i, _, h in rows), key=key)
    order = sorted(((r.range, (r.urlkey, r.ts, r.page)) for r in history.collect()), key=lambda x: x[0])
    assert [x for _, x in order] == sorted(x for _, x in order) and len(order) == len(rows)
    assert warc.round_trip(df.limit(0)).count() == 0
    payloads = {r.page: r.payload for r in warc.read(history, folder, payloads=True).where("record_type = 'response'").collect()}
    assert payloads["-1"] == ("ü" * 99).encode()


@pytest.mark.parametrize("bits", [1 << 24, 64])
def test_warc_of_text_ids(spark, monkeypatch, bits):
    """Empty and null ids differ; a payload that most rows share is dealt over tasks; a full bit table loses nothing; other columns may clash."""
    monkeypatch.setattr(_common, "MASK_BITS", bits)
    monkeypatch.setattr(_common, "HOT_ROWS", 20)
    rows = [(f"p{i:03d}", None, "hot " * 40) for i in range(300)] + [(f"q{i}", "http://c/%20 é", f"one {i} " * (i % 40)) for i in range(200)]
    rows += [("", "http://e", "x" * 100), (None, "http://e", "x" * 100), ("z", "http://e", "x" * 100), (None, "u", "only null " * 20), (None, "u", "only null " * 20), (" a/b?", "u", None)]
    df = spark.createDataFrame([(*r, "clash", "clash", 1, 2) for r in rows], "page_id string, url string, html string, digest string, payload string, length int, first int").repartition(5)
    first = {}
    for i, _, h in rows:
        if i is not None and len(h or "") >= 100:
            first[h] = min(first.get(h, i), i)
    want = [(i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), *(("response", None) if first.get(h, i) == i else ("revisit", first[h]))) for i, _, h in rows]
    got = warc.round_trip(df).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_merge_is_globally_ordered(spark):
    import random

    r = random.Random(4)
    rows = [(f"k{r.randrange(30):02d}", r.randrange(5), str(i), f"f{i % 7}", i, 1) for i in range(500)]
    merged = warc.merge(spark.createDataFrame(rows, warc.INDEX), range_rows=60).withColumn("part", F.spark_partition_id())
    got = [(x.part, x.urlkey, x.ts, x.page) for x in merged.collect()]
    assert got == sorted(got) and [g[1:] for g in got] == sorted(g[1:] for g in got) and len(got) == 500
    runs = [sorted((r.randrange(9), k) for _ in range(r.randrange(8))) for k in range(6)]
    assert list(warc.LoserTree([iter(x) for x in runs])) == sorted(sum(runs, []))
    assert list(warc.LoserTree([])) == []
