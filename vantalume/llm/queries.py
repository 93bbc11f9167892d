"""One query for each operator, over its whole table with production parameters, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_extract, langid, lmscore, mixing, neardup, secret_scan, toxicity, vecdup, warc
from ._common import remainder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep=["page_id", "url"])


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic").where(remainder("doc_id", 5) != 0)
    model = toxicity.train(toxicity.labelled(docs, labels))
    return toxicity.toxicity(docs.withColumn("held_out", remainder("doc_id", 5) == 0), model, keep=["doc_id", "held_out"])


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source")).counted()


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.mark(docs, _table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return decontaminate.digest(marked).drop("hit_spans", "hit_items")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = remainder("doc_id", 3) == 1
    models = langid.train(docs.where(~held_out))
    return langid.identify(docs.select("doc_id", "text", held_out.alias("held_out")), models, keep=["doc_id", "held_out"])


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"]))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4)


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lmscore.score(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "n_words", F.round("lm_score", 6).alias("lm_score"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op4_mixing takes from: each document's size, and its source's size and target."""
    rows = mixing.Mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source")).counted()
    return rows.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base spans of op7_secrets, without what linking adds."""
    return op7_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_html, op2_toxicity, op3_warc, op4_mixing, op5_decontaminate, op6_langid, op7_secrets, op8_neardup, op9_vectors, op10_lm, mixing_targets, secret_base, pipeline)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL = {
    "op3_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
        SELECT page_id, cast(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f""",
    "op5_decontaminate": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        b AS (SELECT cast(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
        bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
        dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
        hit AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
        words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
        SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op8_neardup": f"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, least(4, len(w)) AS n, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
        h AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        l AS (SELECT a, b FROM h UNION ALL SELECT b, a FROM h),
        r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
        SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.a = d.doc_id GROUP BY d.doc_id""",
    "op9_vectors": """
        WITH RECURSIVE v AS (SELECT vec_id, label, cast(embedding AS DOUBLE[]) AS e FROM embeddings),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
        SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN c ON v.vec_id = c.a LEFT JOIN n ON v.vec_id = n.a""",
    "op10_lm": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        t AS (SELECT doc_id, w[i] AS w, CASE WHEN i > 1 THEN w[i - 1] END AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
        o1 AS (SELECT doc_id, w, count(*) AS o FROM t GROUP BY doc_id, w), c1 AS (SELECT w, sum(o) AS c FROM o1 GROUP BY w),
        o2 AS (SELECT doc_id, v, w, count(*) AS o FROM t WHERE v IS NOT NULL GROUP BY doc_id, v, w), c2 AS (SELECT v, w, sum(o) AS c FROM o2 GROUP BY v, w),
        n AS (SELECT count(*) AS n FROM t), l AS (SELECT doc_id, greatest(1, (SELECT n FROM n) - count(*)) AS others FROM t GROUP BY doc_id),
        e1 AS (SELECT doc_id, w, c - o AS c FROM o1 JOIN c1 USING (w)), e2 AS (SELECT doc_id, v, w, c - o AS c FROM o2 JOIN c2 USING (v, w)),
        s AS (SELECT t.doc_id, count(*) AS n_words, avg(ln(CASE WHEN e2.c >= 1 THEN cast(e2.c AS DOUBLE) / ev.c ELSE 0.4e0 * CASE WHEN e1.c > 0 THEN cast(e1.c AS DOUBLE) ELSE 0.4e0 END / others END)) AS x
              FROM t JOIN l ON l.doc_id = t.doc_id JOIN e1 ON e1.doc_id = t.doc_id AND e1.w = t.w LEFT JOIN e2 ON e2.doc_id = t.doc_id AND e2.v = t.v AND e2.w = t.w LEFT JOIN e1 ev ON ev.doc_id = t.doc_id AND ev.w = t.v GROUP BY t.doc_id)
        SELECT d.doc_id, coalesce(n_words, 0) AS n_words, round(x, 6) AS lm_score FROM d LEFT JOIN s USING (doc_id)""",
    "mixing_targets": """
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
        s AS (SELECT source, cast(sum(size) AS BIGINT) AS z, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source),
        w AS (SELECT source, z, [5e0, 2e0, 1e0][(i - 1) % 3 + 1] AS w, 2e0 * z AS cap FROM s),
        o AS (SELECT *, 1.5e0 * sum(z) OVER () - sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING) + cap AS rest, sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM w),
        l AS (SELECT arg_min(rest / free, cap / w) FILTER (WHERE rest / free <= cap / w) AS level FROM o)
        SELECT doc_id, size, z AS source_size, round(least(cap, coalesce(level * w, cap)), 4) AS target FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source, l""",
    "secret_base": """
        WITH k AS (SELECT * FROM (VALUES (0, 'assign', '(?i:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 6), (1, 'access', '(AKIA[A-Z0-9]+)', 20), (2, 'hex', '([0-9a-f]+)', 24)) v(kind, name, pattern, least)),
        m AS (SELECT doc_id, kind, name, least, regexp_extract_all(t, pattern) AS m, regexp_extract_all(t, pattern, 1) AS g, string_split_regex(t, pattern) AS p FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents), k),
        i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m),
        e AS (SELECT doc_id, kind, name, cast(list_sum(list_transform(p[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS BIGINT) AS s, len(m[i]) AS n FROM i WHERE len(g[i]) >= least),
        a AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n0, count(*) FILTER (WHERE kind = 1) AS n1, count(*) FILTER (WHERE kind = 2) AS n2, string_agg(name || ':' || s || ':' || (s + n), ',' ORDER BY s, kind) AS spans FROM e GROUP BY doc_id)
        SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM documents LEFT JOIN a USING (doc_id)""",
}
