from __future__ import annotations

import os
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantalume.functions import geometry, text, vectors
from vantalume.operators import annotate, images, index, jobs, masks, models, search
from vantalume.sources import config, frames, store


class Fixed(models.HashEncoder):
    """Texts meet the first axis; image i's bytes tell its axis."""

    def embed_text(self, text):
        return np.eye(4, dtype=np.float32)[0]

    def embed_images(self, batch):
        self_axis = [int(bytes(x)[-1]) % 4 if not isinstance(x, np.ndarray) else 0 for x in batch]
        return np.eye(4, dtype=np.float32)[self_axis]


class Broken(Fixed):
    def embed_images(self, batch):
        raise RuntimeError("no power")


@pytest.fixture
def fixed():
    return Fixed(embedding_dim=4, batch_size=2)


@pytest.fixture
def png_paths(tmp_path):
    out = []
    for i in range(3):
        p = tmp_path / f"{i:04d}.png"
        p.write_bytes(images.png(np.full((8, 8, 3), (i * 30, 0, 200), np.uint8)))
        out.append(str(p))
    return out


def blobs(n):
    return [b"img" + bytes([i]) for i in range(n)]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, z array<float>")
    a, z = F.col("a"), F.col("z")
    r = df.select(vectors.dot(a, a), vectors.l2(a, z), vectors.cosine_similarity(a, a), vectors.normalize(a), vectors.normalize(z), vectors.similarity(vectors.sq_l2(a, a))).first()
    assert tuple(r) == (25.0, 5.0, 1.0, [0.6, 0.8], [0.0, 0.0], 1.0)


def test_text_functions(spark):
    df = spark.createDataFrame([("cat  ", "a.png", 1.5), ("cat. ", None, 0.625)], "t string, p string, s double")
    rows = df.select(text.terminated_prompt(F.col("t")), text.path_id("c", F.col("p")), text.label_text(F.col("t"), F.col("s")), text.crop_filename(F.col("s"), F.lit(2)), text.source_path(text.crop_id(F.col("p"), F.lit(3)))).collect()
    assert rows[0][0] == "cat ." and rows[1][0] == "cat. "
    assert len(rows[0][1]) == 40 and rows[1][1] is None
    assert rows[1][2] == "cat.  0.62" and rows[0][3] == "1_500000_2.png" and rows[0][4] == "a.png"


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "db"))
    assert s.list() == []
    with pytest.raises(ValueError):
        s.open("x")
    s.create("x")
    assert s.list() == ["x"] and s.count("x") == 0
    row = lambda i, t: (i, "x", [1.0], "", float(t))
    s.append("x", spark.createDataFrame([row("a", 1), row("b", 1)], store.COLLECTION))
    s.upsert("x", spark.createDataFrame([row("b", 2), row("c", 2)], store.COLLECTION))
    assert sorted((r.id, r.timestamp) for r in s.open("x").collect()) == [("a", 1.0), ("b", 2.0), ("c", 2.0)]
    s.vacuum("x")
    assert s.count("x") == 3
    s.overwrite("x", spark.createDataFrame([row("z", 3)], store.COLLECTION))
    s.upsert("x", spark.createDataFrame([], store.COLLECTION))
    assert [r.id for r in s.open("x").collect()] == ["z"]
    for i in range(store.MOST_FOLDERS + 2):  # many appends to one bucket are compacted
        s.append("x", spark.createDataFrame([row("z", i)], store.COLLECTION))
    assert s.count("x") == store.MOST_FOLDERS + 3 and max(map(len, s._manifest("x").values())) <= store.MOST_FOLDERS
    with pytest.raises(Exception, match="expected vectors"):
        store.check_dim(s.open("x"), 2).collect()


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "db"), buckets=8)
    rows = lambda ids, t: spark.createDataFrame([(i, "x", [1.0], "", t) for i in ids], store.COLLECTION)
    s.append("x", rows([f"i{k}" for k in range(200)], 1.0))
    before = s._manifest("x")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    s.upsert("x", rows(["i3", "new"], 2.0).mapInPandas(counted, store.COLLECTION))
    after = s._manifest("x")
    assert seen.value == 2 and len(before) == 8
    assert 1 <= sum(after[b] != before[b] for b in before) <= 2
    got = {r.id: r.timestamp for r in s.open("x").collect()}
    assert len(got) == s.count("x") == 201 and got["i3"] == got["new"] == 2.0 and got["i4"] == 1.0


def test_insert_update_and_ids(spark, tmp_path, fixed, png_paths):
    ix = index.Indexer(spark, fixed, str(tmp_path / "db"))
    job = ix.insert(png_paths, "c", timestamps=[1, 2, 3], job_id="j1")
    assert (job.state, job.total, job.processed) == ("done", 3, 3)
    assert ix.store.open("c").columns == ["id", "collection_id", "vector", "path", "timestamp"]
    with pytest.raises(ValueError, match="already exist"):
        ix.insert(png_paths[:1], "c", job_id="never")
    assert jobs.get_status("never") is None
    ix.update(png_paths, "c", timestamps=[7, 8, 9])
    assert sorted(r.timestamp for r in ix.store.open("c").collect()) == [7.0, 8.0, 9.0]
    a = {r.id for r in index.records(spark, png_paths, "c").collect()}
    assert a == {r.id for r in index.records(spark, png_paths, "c").collect()} != {r.id for r in index.records(spark, png_paths, "d").collect()}
    same = [{r.id for r in index.records(spark, blobs(2), c).collect()} for c in "cd"]
    assert same[0] == same[1]
    with pytest.raises(Exception, match="given id is null"):
        index.records(spark, blobs(2), "c", ids=["a", None])
    with pytest.raises(Exception, match="given id is null"):
        index.records(spark, spark.createDataFrame([(0, b"x", "a"), (1, b"y", None)], "pos long, content binary, id string"), "c").collect()
    with pytest.raises(Exception, match="No such file|Failed to open"):
        ix.insert([str(png_paths[0]) + ".gone"], "c", job_id="gone")
    assert jobs.get_status("gone")["state"] == "failed"
    assert ix.insert([], "empty").state == "done" and ix.store.exists("empty")


def test_input_checks(spark):
    for bad, error in (({"ids": ["a"]}, ValueError), ({"timestamps": [1.0]}, ValueError), ({"ids": ["a", "a"]}, ValueError)):
        with pytest.raises(error):
            index.records(spark, blobs(2), "c", **bad)
    with pytest.raises(TypeError, match="image 1"):
        index.records(spark, [b"x", 5], "c")
    with pytest.raises(ValueError, match=r"\+1 more"):
        index.records(spark, blobs(5), "c", ids=["a"] * 5)


def test_batches_and_failure(spark, tmp_path, fixed):
    ix = index.Indexer(spark, fixed, str(tmp_path / "db"))
    seen = []
    job = ix._run(index.records(spark, blobs(5), "c"), "c", "steps", lambda c, rows: seen.append((jobs.JobRegistry.get("steps").processed, rows.count())), 2)
    assert seen == [(0, 2), (2, 2), (4, 1)] and job.processed == 5
    with pytest.raises(Exception, match="no power"):
        index.Indexer(spark, Broken(embedding_dim=4), str(tmp_path / "db")).insert(blobs(2), "f", job_id="bad")
    status = jobs.get_status("bad")
    assert status["state"] == "failed" and "no power" in status["error"]


def test_jobs(spark):
    job = jobs.JobRegistry.start("c", 10_000, "")
    assert len(job.job_id) == 32
    threads = [threading.Thread(target=lambda: [job.advance() for _ in range(1000)]) for _ in range(10)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert job.processed == 10_000 and "processed=10000/10000" in repr(job)
    job.finish()
    with pytest.raises(AttributeError):
        job.string  # noqa: B018
    assert list(job.as_dict()) == ["job_id", "collection_id", "state", "total", "processed", "started_at", "finished_at", "error"]
    assert job.as_row(spark).first().state == "done" and job in jobs.JobRegistry.list_all()
    assert jobs.JobRegistry.start("c", 1, job.job_id) is jobs.JobRegistry.get(job.job_id)


def test_jobs_outlive_their_process(spark, tmp_path, fixed):
    """Statuses are folded from the store's event files, which another process may read; of one id the job started last counts."""
    told = []
    ix = index.Indexer(spark, fixed, str(tmp_path / "db"), progress=lambda job: told.append(job.processed))
    ix.insert(blobs(5), "c", job_id="a", commit_every=2)
    assert told == [2, 4, 5]
    with pytest.raises(Exception, match="no power"):
        index.Indexer(spark, Broken(embedding_dim=4), str(tmp_path / "db")).insert(blobs(2), "f", job_id="b")
    ix.jobs.start("d", 9, "c").advance(4)
    ix.update(blobs(1), "c", job_id="again")
    ix.update(blobs(2), "c", job_id="again")
    fresh = jobs.Jobs(store.Store(spark, str(tmp_path / "db")))
    got = {r.job_id: r for r in fresh.table().collect()}
    assert {k: (r.state, r.total, r.processed) for k, r in got.items()} == {"a": ("done", 5, 5), "b": ("failed", 2, 0), "c": ("running", 9, 4), "again": ("done", 2, 2)}
    assert "no power" in got["b"].error and got["c"].finished_at is None and got["a"].started_at <= got["a"].finished_at
    assert fresh.list_all() == [] and {j.job_id for j in ix.jobs.list_all()} == {"a", "c", "again"} and jobs.get_status("a")["state"] == "done"
    assert jobs.Jobs(store.Store(spark, str(tmp_path / "none"))).table().count() == 0
    with pytest.raises(ValueError):
        jobs.JobRegistry.table()


def test_search_reads_the_collection_once(spark, tmp_path, fixed, png_paths):
    s = store.Store(spark, str(tmp_path / "db"))
    s.append("c", spark.createDataFrame([(str(i), "c", [1.0, 0.0, 0.0, 0.0], p, 0.0) for i, p in enumerate(png_paths)], store.COLLECTION))
    out = search.Search(fixed, models.RegionDetector(), s).invoke(query="q", collection_id="c")
    assert "parquet" not in out.results._jdf.queryExecution().optimizedPlan().toString().lower() and out.results.count() == 3


def test_knn_and_cascade(spark, tmp_path, fixed, png_paths):
    ix = index.Indexer(spark, fixed, str(tmp_path / "db"))
    rows = [(f"id-{i}", "coll", [float(x) for x in np.eye(4)[i]], p, 0.0) for i, p in enumerate(png_paths)]
    ix.store.append("coll", spark.createDataFrame(rows, store.COLLECTION))
    s = search.Search(fixed, models.RegionDetector(labels=True), ix.store)
    part = (s.embed | s.retrieve).invoke(search.SearchState("cat", "coll"))
    got = part.retrieved.orderBy("retrieval_rank").collect()
    assert [r.id for r in got] == ["id-0", "id-1", "id-2"] and [round(r.similarity_score, 5) for r in got] == [1.0, 0.0, 0.0]
    assert part.detected is None
    full = s.invoke(query="cat", collection_id="coll", top_k_final=2)
    assert full.results.count() == 2 and full.detected.count() == 3
    first = full.results.first()
    assert first.labels == ["cat"] and first.masks[0].h == 8 and first.detection_score > 0
    with pytest.raises(ValueError):
        s.invoke(query="cat")
    for step in (s.retrieve, s.detect, s.rerank):
        with pytest.raises(ValueError):
            step.invoke(search.SearchState("q", "coll"))
    with pytest.raises(ValueError):
        s.embed.invoke(search.SearchState("", "coll"))


def test_engine_from_settings(spark, tmp_path, png_paths):
    path = tmp_path / "c.yaml"
    path.write_text(f"models:\n  encoder: {{embedding_dim: 8, batch_size: 2}}\n  detector: {{threshold: 0.0, labels: true}}\nindexing: {{db_path: {tmp_path}/db}}\n")
    index.Indexer.from_config(spark, str(path)).insert(png_paths, "c")
    out = search.Search.from_config(spark, str(path)).invoke(query="red", collection_id="c", top_k_final=2)
    assert out.results.count() == 2 and out.results.first().labels == ["red"]
    with pytest.raises(ValueError, match="unknown detector"):
        search.Search.from_config(spark, str(path), detector="none")


def test_missing_images(spark, tmp_path, fixed):
    st = store.Store(spark, str(tmp_path / "db"))
    st.append("c", spark.createDataFrame([("a", "c", [1.0, 0.0, 0.0, 0.0], "/nowhere.png", 0.0)], store.COLLECTION))
    with pytest.raises(FileNotFoundError):
        search.Search(fixed, models.RegionDetector(), st).invoke(query="q", collection_id="c")
    out = search.Search(fixed, models.RegionDetector(), st, on_missing="null").invoke(query="q", collection_id="c")
    assert out.results.first().detection_score == 0.0


def test_every_hit_meets_its_image(spark, tmp_path, fixed, png_paths):
    """Relative, doubled and spaced paths are found; a file that isn't an image fails, or scores 0 without failing."""
    (tmp_path / "a b.png").write_bytes((tmp_path / "0000.png").read_bytes())
    (tmp_path / "broken.png").write_bytes(b"no image")
    here = spark._jvm.java.lang.System.getProperty("user.dir")
    relative = os.path.relpath(png_paths[0], here)
    named = [relative, png_paths[0], f"file:{png_paths[1]}", str(tmp_path / "a b.png")]

    def run(name, paths, **kw):
        st = store.Store(spark, str(tmp_path / name))
        st.append("c", spark.createDataFrame([(str(i), "c", [1.0, 0.0, 0.0, 0.0], p, 0.0) for i, p in enumerate(paths)], store.COLLECTION))
        return search.Search(fixed, models.RegionDetector(), st, **kw).invoke(query="q", collection_id="c", top_k_final=9).results.collect()

    for kw in ({}, {"on_missing": "null"}):
        got = run(f"good{len(kw)}", named, **kw)
        assert sorted(r.path for r in got) == sorted(named) and all(r.boxes is not None for r in got)
    with pytest.raises(Exception, match="no image can be read from .*broken.png"):
        run("bad", [*named, str(tmp_path / "broken.png")])
    got = {r.path: r for r in run("null", [*named, str(tmp_path / "broken.png")], on_missing="null")}
    assert len(got) == 5 and got[str(tmp_path / "broken.png")].boxes is None


def test_rerank_and_max_score(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate([0.1, 0.9, 0.4, 0.7])], "retrieval_rank int, detection_score double")
    assert [r.detection_score for r in search.rerank(df, 2).collect()] == [0.9, 0.7]
    assert search.rerank(df, 9).count() == 4
    lists = spark.createDataFrame([([0.1, 0.4],), ([0.9, 0.2],), ([],), ([float("nan")],)], "s array<double>")
    assert [r[0] for r in lists.select(search.max_score(F.col("s"))).collect()] == [0.4, 0.9, 0.0, 0.0]
    with pytest.raises(ValueError):
        search.knn(df, [1.0], -1)
    gaps = spark.createDataFrame([(1, None), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0])], "id int, vector array<double>")
    assert [r.id for r in search.knn(gaps.where("id < 4"), [0.0, 1.0], 3).collect()] == [3, 2, 1]
    probes = spark.createDataFrame([(7, [0.0, 1.0]), (8, None), (9, [1.0, 0.0])], "query_id int, query array<double>")
    for metric in ("l2", "cosine", "dot"):
        got = search.knn_batch(gaps, probes, 5, metric).collect()
        assert sorted((r.query_id, r.id, r["rank"]) for r in got) == [(7, 2, 2), (7, 3, 1), (9, 2, 1), (9, 3, 2)]
    assert search.knn_batch(gaps, probes, 0).count() == search.knn_batch(gaps.limit(0), probes, 2).count() == search.knn_batch(gaps, probes.limit(0), 2).count() == 0


def test_models():
    e = models.HashEncoder(8)
    assert e.invoke("a b")["embedding"].shape == (8,) and e.invoke([np.zeros((2, 2, 3), np.uint8)] * 3)["embedding"].shape == (3, 8)
    assert np.allclose(np.linalg.norm(e.embed_images(blobs(3)), axis=1), 1)
    with pytest.raises(TypeError):
        e.invoke(5)
    with pytest.raises(TypeError):
        models.GridMasks().invoke({"image": 1})
    with pytest.raises(KeyError):
        models.RegionDetector().invoke({"image": np.zeros((2, 2, 3))})
    # images by grey level, arrays by their truth
    grey = {"height": 1, "width": 4, "nChannels": 1, "data": bytes([0, 127, 128, 255])}
    assert models.to_mask(grey).tolist() == [[False, False, True, True]]
    assert models.to_mask(np.array([[0, 127, 128, 255]], np.uint8)).tolist() == models.to_mask([[0, 0.5, 2, -1]]).tolist() == [[False, True, True, True]]
    image = np.zeros((8, 8, 3), np.uint8)
    image[:4] = 200
    found = lambda **kw: models.RegionDetector(labels=True, **kw).invoke({"image": image, "text": "red cup"})
    assert found(box_threshold=0.9)["scores"] == [] and found()["labels"] == ["red cup"] and found(text_threshold=1.0)["labels"] == [""]
    count = lambda **kw: len(models.GridMasks(points_per_side=2, **kw).invoke(image)["masks"])
    assert count() == 4 and count(pred_iou_thresh=0.5) == 0 and count(stability_score_thresh=1.0) == 0
    m = np.zeros((5, 6), bool)
    m[1:3, 0:4] = True
    out = models.finish_masks([m, m], [1, 2], [[0, 0, 1, 1]])
    assert out["boxes"] == [[0.0, 0.0, 1.0, 1.0], [0.0, 1.0, 3.0, 2.0]] and models.mask_box(m & False) == [0.0] * 4


class Counted(models.HashEncoder):
    made = 0

    def __init__(self, **settings):
        super().__init__(**settings)
        Counted.made += 1


def test_model_is_made_once_in_a_process(spark, tmp_path):
    import pickle

    lazy = models.Loaded(Counted, embedding_dim=4, batch_size=2)
    assert lazy.embedding_dim == 4 and Counted.made == 0 and len(pickle.dumps(lazy)) < 300
    for _ in range(3):
        assert pickle.loads(pickle.dumps(lazy)).embed_images(blobs(2)).shape == (2, 4)
    assert Counted.made == 1
    ix = index.Indexer(spark, models.Loaded(models.HashEncoder, embedding_dim=4, batch_size=2), str(tmp_path / "db"))
    ix.insert(blobs(5), "c")
    assert ix.store.count("c") == 5
    path = tmp_path / "c.yaml"
    path.write_text("models:\n  encoder: {embedding_dim: 6}\n")
    assert models.Loaded.from_config(models.HashEncoder, path).embed_text("x").shape == (6,)


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("models:\n  encoder: {embedding_dim: 4}\nindexing: {db_path: x}\npreprocess: {margin: '0.2', top_n: '3'}\n")
    assert models.HashEncoder.from_config(path).embedding_dim == 4
    assert config.IndexSettings.load(path) == config.IndexSettings("x", None)
    assert config.CropSettings.load(path).margin == 0.2 and config.CropSettings.load(path).top_n == 3
    with pytest.raises(KeyError):
        models.GridMasks.from_config(path)
    with pytest.raises(NotImplementedError):
        config.model_settings(path, None)
    with pytest.raises(ValueError):
        config.CropSettings(background="plaid")


def test_mask_choice_and_sql_form_agree(spark):
    r = np.random.default_rng(1)
    sets = [[r.random((20, 30)) < p for p in (0.0, 0.3, 0.05, 0.3)] for _ in range(4)]
    px = [(i, k, int(x), int(y)) for i, ms in enumerate(sets) for k, m in enumerate(ms) for y, x in zip(*np.nonzero(m), strict=True)]
    dims = spark.createDataFrame([(i, 30, 20) for i in range(4)], "image_id int, w int, h int")
    scored = masks.scored(masks.measured(spark.createDataFrame(px, "image_id int, mask_idx int, x int, y int")), dims)
    chosen = masks.crops(masks.best(scored, 2))
    for row in chosen.collect():
        assert images.best_masks(sets[row.image_id], 30, 20, 2)[row.j] == row.mask_idx
        assert abs(images.score_masks(sets[row.image_id], 30, 20)[row.mask_idx] - row.score) < 1e-12
        assert models.mask_box(sets[row.image_id][row.mask_idx]) == [row.x0, row.y0, row.x1, row.y1]
    assert masks.with_fallback(dims.union(spark.createDataFrame([(9, 1, 1)], dims.schema)), chosen).where("is_fallback").count() == 1
    same = np.ones((4, 4), bool)
    assert images.best_masks([same, same], 4, 4, 1) == [1] and images.best_masks([same & False] * 2, 4, 4, 3) == [0]


def test_extractor(spark, tmp_path, png_paths):
    image = np.full((32, 48, 3), 50, np.uint8)
    image[8:16, 12:24] = 250
    ex = images.ObjectExtractor(models.GridMasks(min_contrast=60), top_n=2, output_size=16)
    assert [c.shape for c in ex.extract(image)] == [(16, 16, 3)] and len(ex.extract([image, image])) == 2
    with pytest.warns(UserWarning, match="no masks"):
        assert len(ex.extract(np.zeros((8, 8, 3), np.uint8))) == 1
    for bad in (5, [5]):
        with pytest.raises(TypeError):
            ex.extract(bad)
    mask = np.zeros((4, 4), bool)
    mask[:2, :2] = True
    for name, level in images.FILLS.items():
        out = images.ObjectExtractor(None, background=name).fill(np.full((4, 4, 3), 200, np.uint8), mask)
        assert (out[:2, :2] == 200).all() and (out[2:] == level).all()
    noisy = images.ObjectExtractor(None, background="noise")
    assert (noisy.canvas(4, 4) == noisy.canvas(4, 4)).all()
    dull = spark.createDataFrame([(f"/{c}.png", 0.0, (32, 48, 3, bytes(image[..., ::-1].tobytes()))) for c in "ab"], "path string, ts double, image struct<height:int,width:int,nChannels:int,data:binary>")
    noisy = images.ObjectExtractor(models.GridMasks(min_contrast=60), background="noise", output_size=16)
    first, second = noisy.crops(dull).orderBy("path").collect()
    assert first.pixels != second.pixels and first.pixels == noisy.crops(dull).orderBy("path").first().pixels
    df = frames.read_images(spark, str(tmp_path)).withColumn("ts", F.lit(1.25))
    assert df.count() == 3
    crops = ex.crops(df)
    listed = images.write_crops(crops, str(tmp_path / "crops")).collect()
    assert sorted(r.id.rsplit(":")[-1] for r in listed) == ["0", "0", "0"] and (tmp_path / "crops/1_250000_0.png").exists()
    assert images.to_rgb(frames.read_images(spark, png_paths[1]).first().image)[0, 0].tolist() == [30, 0, 200]
    assert images.placeholder().shape == (224, 224, 3)


def test_annotations(spark):
    d = spark.createDataFrame([("a", [[1.7, 40.0, 5.0, 6.0]], [0.5], ["a long label here"]), ("b", [], [], [])], "id string, boxes array<array<double>>, scores array<double>, labels array<string>")
    r = annotate.instructions(d).collect()
    assert len(r) == 1 and r[0].box == [1, 40, 5, 6] and r[0].text == "a long label 0.50" and (r[0].anchor.x, r[0].anchor.y) == (4, 22)
    image = np.zeros((6, 6, 3), np.uint8)
    assert (annotate.outlined(image, []) == image).all() and annotate.outlined(image, [[1, 1, 4, 4]])[1, 2].tolist() == list(text.PALETTE[0])
    assert annotate.blend(image, [np.ones((6, 6), bool)]).any()
    big = np.full((60, 120, 3), 40, np.uint8)
    mask = np.zeros((60, 120), bool)
    mask[30:50, 10:60] = True
    out = annotate.annotate(big, [[10, 30, 60, 50]], [0.625], "cup", [mask])
    assert out[30, 10].tolist() == out[31, 20].tolist() == list(text.PALETTE[0]) and out[40, 30].tolist() not in ([40] * 3, list(text.PALETTE[0]))
    white = (out == 255).all(2)
    ys, xs = np.nonzero(white)
    assert (xs.min(), ys.min()) == (13, 12) and white[12:22, 13:19].sum() == 4 * sum(bin(int(b)).count("1") for b in annotate.GLYPHS["C"])
    assert annotate.written(0.625, "a very long label", 12) == "a very long  0.62" and (annotate.annotate(big, [], [], []) == big).all()
    assert (annotate.annotate(big, [[500, 500, 600, 600]], [1], ["x"]) == big).all()


def test_annotated_hits(spark, fixed, png_paths, tmp_path):
    hits = frames.read_images(spark, str(tmp_path)).withColumn("id", F.col("path"))
    detected = search.detect(hits, models.RegionDetector(labels=True), "cup").join(hits.select("id", "image"), "id")
    got = annotate.annotated(detected).collect()
    assert len(got) == 3 and all((r.annotated.height, r.annotated.width, len(r.annotated.pixels)) == (8, 8, 192) for r in got)
    assert "image" not in got[0].asDict() and got[0].labels == ["cup"]


def test_originals_of_crops(spark, png_paths, tmp_path):
    hits = spark.createDataFrame([(f"{png_paths[0]}:0", 1.0), (f"{png_paths[0]}:1", 2.0), ("/gone.png:0", 3.0)], "id string, score double")
    got = {r.id: r for r in images.with_originals(hits, frames.read_images(spark, str(tmp_path))).collect()}
    assert len(got) == 3 and got[f"{png_paths[0]}:1"].original.pixels == got[f"{png_paths[0]}:0"].original.pixels == bytes([0, 0, 200] * 64)
    assert tuple(got["/gone.png:0"].original) == (224, 224, bytes([80]) * (224 * 224 * 3), True) and got["/gone.png:0"].score == 3.0


def test_frames(spark, tmp_path):
    (tmp_path / "rgb.txt").write_text("# head\n\n1.5 rgb/a b.png \n  2.25\trgb/c.png\n")
    assert [tuple(r) for r in frames.read_frames(spark, str(tmp_path)).collect()] == [(f"{tmp_path}/rgb/a b.png", 1.5), (f"{tmp_path}/rgb/c.png", 2.25)]
    assert frames.parse_fields(spark.read.text(str(tmp_path / "rgb.txt"))).first().fields == ["1.5", "rgb/a", "b.png"]
    df = spark.range(10)
    assert [r.id for r in frames.systematic_sample(df, ["id"]).collect()] == [0, 2, 4, 6]
    assert frames.head(df, None).count() == 10 and frames.head(df, 3).count() == 3
    batched = frames.batch_ids(spark.range(5), ["id"], 2)
    assert sorted(map(tuple, frames.progress(batched).collect())) == [(0, 2, 0), (1, 2, 2), (2, 1, 4)]
    assert frames.batch_ids(spark.range(0), ["id"], 2).count() == 0
    assert [r["count"] for r in frames.batch_ids(spark.range(5), ["id"], 2).groupBy("batch").count().orderBy("batch").collect()] == [2, 2, 1]


def test_positions_of_wide_rows(spark):
    """Each position comes once, whatever adaptive execution makes of the plan; nulls, equal prefixes and skewed values included."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    try:
        n = 400_000
        order = F.when(F.col("id") % 97 == 0, None).when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.pmod(F.xxhash64("id"), F.lit(1000)))
        df = spark.range(n).select(order.alias("o"), "id", F.repeat(F.sha2(F.col("id").cast("string"), 256), 8).alias("wide"))
        got = frames.numbered(df, ["o", "id"]).select("rn", "o", "id", F.length("wide").alias("w"))
        s = got.agg(F.count("rn").alias("n"), F.countDistinct("rn").alias("d"), F.min("rn").alias("lo"), F.max("rn").alias("hi"), F.min("w").alias("w")).first()
        assert tuple(s) == (n, n, 1, n, 512)
        rows = got.orderBy("rn").select("o", "id").toPandas()
        key = list(zip(rows["o"].fillna(-1), rows["id"], strict=True))
        assert key == sorted(key)
        assert frames.systematic_sample(df, ["o", "id"], 7).count() == 7
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_listing_and_streaming(spark, tmp_path, fixed, png_paths):
    from vantalume.streaming.ingest import ingest

    assert [r.path for r in frames.listing(spark, str(tmp_path)).collect()] == sorted(png_paths)
    ix = index.Indexer(spark, fixed, str(tmp_path / "db"))
    for _ in range(2):
        ingest(ix, str(tmp_path), "live", str(tmp_path / "ck")).awaitTermination(120)
        assert ix.store.count("live") == 3
    assert {r.id for r in ix.store.open("live").collect()} == {r.id for r in index.records(spark, png_paths, "live").collect()}


def test_geometry(spark):
    df = spark.createDataFrame([(0, 1, 3, 2, 6, 5)], "x0 int, y0 int, x1 int, y1 int, w int, h int")
    box = geometry.padded_box(*(F.col(c) for c in ("x0", "y0", "x1", "y1", "w", "h")), 0.1)
    r = df.select(box.alias("b")).select("b.*", geometry.square(F.col("b")).alias("s")).first()
    assert (r.x0, r.y0, r.x1, r.y1) == (0, 0, 4, 3) and tuple(r.s) == (4, 3, 4, 0, 0)
    assert df.select(geometry.centrality(F.lit(0.0), F.lit(0.0), F.lit(0), F.lit(0))).first()[0] == 1.0
