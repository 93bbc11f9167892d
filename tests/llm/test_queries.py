"""The registered queries themselves: against their SQL, and by the contract's columns, splits and rules."""

from __future__ import annotations

import hashlib
import os
import re
import shutil
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from vantalume.llm.queries import ORACLE_SQL, QUERIES

TABLES = "documents embeddings pages benchmark labels conversations".split()


def norm(v):
    return round(v, 9) + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def in_fold(doc_id, divisor, rest):
    return zlib.crc32(str(doc_id).encode()) % divisor == rest


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_agrees_with_sql(spark, sf_dir, duck, name):
    df, want = QUERIES[name](spark, sf_dir), duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in sorted(want.columns)]
    got = sorted(repr([norm(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    assert got == sorted(repr([norm(r[i]) for i in at]) for r in want.fetchall())


def with_changed(sf_dir, folder, name, change, spark):
    """A folder of the same tables, one of them changed."""
    os.makedirs(folder)
    for t in TABLES:
        if t != name:
            shutil.copy(f"{sf_dir}/{t}.parquet", f"{folder}/{t}.parquet")
    change(spark.read.parquet(f"{sf_dir}/{name}.parquet")).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_toxicity_query(spark, sf_dir, tmp_path):
    got = {r.doc_id: r for r in QUERIES["op2_toxicity"](spark, sf_dir).collect()}
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.held_out == in_fold(d, 5, 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for d, r in got.items())
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = with_changed(sf_dir, tmp_path / "t", "labels", lambda df: df.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))), spark)
    again = {r.doc_id: r for r in QUERIES["op2_toxicity"](spark, other).collect()}
    assert {d: r.score for d, r in got.items()} == {d: r.score for d, r in again.items()}


def test_language_query(spark, sf_dir, tmp_path):
    got = {r.doc_id: r for r in QUERIES["op6_langid"](spark, sf_dir).collect()}
    assert all(r.held_out == in_fold(d, 3, 1) and 0 <= r.score <= 1 for d, r in got.items())
    truth = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    langs = {r.lang for r in truth.values() if r.lang is not None}
    right = [got[d].lang_pred == r.lang for d, r in truth.items() if r.lang is not None and got[d].held_out]
    assert sum(right) >= 0.97 * len(right) and {r.lang_pred for r in got.values()} <= langs | {"und"}
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in truth[d].text or "")) for d, r in got.items())
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    other = with_changed(sf_dir, tmp_path / "t", "documents", lambda df: df.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))), spark)
    again = {r.doc_id: r for r in QUERIES["op6_langid"](spark, other).collect()}
    assert {d: (r.lang_pred, r.score) for d, r in got.items()} == {d: (r.lang_pred, r.score) for d, r in again.items()}


def test_html_query(spark, sf_dir):
    df = QUERIES["op1_html"](spark, sf_dir)
    assert df.columns[:4] == ["page_id", "url", "text", "n_chars"] and dict(df.dtypes)["n_chars"] == "bigint"
    rows = df.collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    assert all(r.n_chars == len(r.text) and not re.search(r"<[a-z]+[ >]|&amp;|\s\s", r.text) for r in rows)


def test_mixing_query(spark, sf_dir):
    df = QUERIES["op4_mixing"](spark, sf_dir)
    assert {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}.items() <= dict(df.dtypes).items()
    rows = {r.doc_id: r for r in df.collect()}
    assert rows == {r.doc_id: r for r in QUERIES["op4_mixing"](spark, sf_dir).collect()}
    sources = {r.doc_id: r.source for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    taken, target = {}, {}
    for d, r in rows.items():
        assert 0 <= r.taken <= 2 * r.size
        taken[sources[d]] = taken.get(sources[d], 0) + r.taken
        target[sources[d]] = r.target
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)


def test_secrets_query(spark, sf_dir):
    """Base spans by a loop over whole texts; linked ones only add to them."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    for r in QUERIES["op7_secrets"](spark, sf_dir).collect():
        t = texts[r.doc_id]
        base = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in assign.finditer(t) if len(m[2]) >= 6]
        base += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        base += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        base = [x for *_, x in sorted(base)]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r.spans.split(",")) | {""} and r.n_assign + r.n_access + r.n_hex == len(base)


@pytest.fixture(scope="module")
def larger():
    path = "/root/testdata/sf0.1"
    if not os.path.isdir(path):
        pytest.skip("the driver's tables aren't here")
    return path


def test_held_out_toxicity(spark, larger):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    rows = [(r.score, r.predicted, labels[r.doc_id]) for r in QUERIES["op2_toxicity"](spark, larger).where("held_out").collect() if r.doc_id in labels]
    toxic, clean = ([s for s, _, y in rows if y == k] for k in (1, 0))
    above = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / len(toxic) / len(clean)
    assert above >= 0.93 and sum(p == y for _, p, y in rows) >= 0.97 * len(rows) and sum(p > y for _, p, y in rows) <= 0.01 * len(rows)


def test_held_out_language(spark, larger):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{larger}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [(r.lang_pred, r.rejected, langs[r.doc_id]) for r in QUERIES["op6_langid"](spark, larger).where("held_out").collect() if langs[r.doc_id] is not None]
    assert sum(a == b for a, _, b in rows) >= 0.995 * len(rows) and sum(x for _, x, _ in rows) <= 0.001 * len(rows)
