"""Operators that learn: held-out accuracy, defined cases, and the pipeline."""

from __future__ import annotations

import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantalume.llm import html_extract, langid, toxicity
from vantalume.llm._common import least_keys, remainder


def test_language(spark, docs, no_docs):
    train = docs.where(remainder("doc_id", 3) != 1)
    models = langid.train(train)
    got = {(r.doc_id, r.text): r for r in langid.identify(docs, models).collect()}
    rows = docs.collect()
    for r in rows:
        out = got[r.doc_id, r.text]
        assert 0 <= out.score <= 1
        if not any(c.isalpha() for c in r.text or ""):
            assert out.lang_pred == "und" and out.rejected and out.score == 0
        elif r.doc_id is not None and r.doc_id < 120 and len(r.text) > 30:
            assert out.lang_pred == r.lang and not out.rejected
    assert langid.identify(no_docs, models).count() == 0
    none = langid.train(no_docs)
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}
    junk = spark.createDataFrame([(1, "ζξψω ЖЩЮЯ " * 40)], "doc_id int, text string")
    assert langid.identify(junk, models).first().rejected


def test_rejection_is_calibrated(spark):
    """On rows that nothing was fitted on: own texts stay, texts of a language that wasn't learned go, and a sole language has its slack."""
    r = random.Random(6)
    sounds = {"a": "ka ti mo ru se no".split(), "b": "str ing old esh wen arr".split(), "c": "zzi qua xyo vvu jhe kwy".split()}
    text = lambda x: " ".join("".join(r.choices(sounds[x], k=r.randint(1, 3))) for _ in range(r.choice([30, 80, 200])))
    rows = [(i, text("ab"[i % 2]), "ab"[i % 2]) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = langid.train(df)
    fresh = spark.createDataFrame([(x, text(x)) for x in "abc" for _ in range(150)], "truth string, text string")
    got = Counter((x.truth, x.rejected) for x in langid.identify(fresh, models).collect())
    assert got["a", True] + got["b", True] <= 2 and got["c", True] >= 148
    alone = langid.train(df.where("lang = 'a'"))
    got = Counter((x.truth, x.rejected) for x in langid.identify(fresh, alone).collect())
    assert got["a", True] == 0 and got["c", True] == 150
    with pytest.raises(ValueError, match="values of lang"):
        langid.train(spark.range(1200).selectExpr("id AS doc_id", "'a' AS text", "cast(id AS string) AS lang"))


def test_kneser_ney_sums_to_one():
    s, of, _ = langid.symbols(["abracadabra abba", "cab bad"])
    keys, counts = np.unique(langid.trigrams(s, of)[0], return_counts=True)
    letters = np.unique(keys & np.uint64((1 << 21) - 1))
    m = langid._Model(keys, counts, len(letters))
    for context in np.unique(keys >> np.uint64(21)):
        assert math.isclose(m.p((context << np.uint64(21)) | letters, 3).sum(), 1, rel_tol=1e-9)
    # shared tables give the same as the model itself, seen or not
    every = langid.Models({"a": (keys, counts), "b": (keys[::2], counts[::2])})
    own = langid._Model(keys, counts, len(letters) + 1)
    probe = np.concatenate([keys, keys ^ np.uint64(1), keys ^ np.uint64(1 << 21)])
    assert np.allclose(every.of(probe)[:, 0], np.log(own.p(probe, 3)), atol=1e-5)


def test_toxicity(spark, no_docs):
    r = random.Random(8)
    plain = [f"{a}{b}" for a in "ba be bi bo lu ma ne".split() for b in "rt st nd la mo ti".split()]
    rows = []
    for i in range(900):
        words = [r.choice(plain) for _ in range(r.choice([6, 30, 80]))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(2):
                words.insert(r.randrange(len(words)), r.choice(["zorgle", "vraxi", f"kloom{r.choice('abcdefgh')}"]))
        rows.append((i, " ".join(words) + ".", int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    held = remainder("doc_id", 5) == 0
    model = toxicity.train(df.where(~held))
    out = toxicity.toxicity(df.where(held), model).collect()
    wrong = [x for x in out if x.predicted != x.toxic]
    assert len(wrong) <= 2, wrong
    assert any(s.startswith("kloo") for s in model.stems)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "zorgle " * 5000)], "doc_id long, text string")
    got = {x.doc_id: x for x in toxicity.toxicity(odd, model).collect()}
    assert got[1].predicted == got[2].predicted == 0 and got[3].predicted == 1
    assert toxicity.toxicity(no_docs, model).count() == 0
    assert toxicity.train(df.limit(0)).theta is toxicity.PRIOR


def test_grammar():
    run = toxicity.grammar().run
    assert run("TOI") == "--t" and run("OI") == "--" and run("IOI") == "--I" and run("IBOI") == "---I" and run("NOI") == "--n" and run("NOOOII") == "-----I"
    assert run("TBI") == "---" and run("TIBI") == "-t-I" and run("NBII") == "---I"
    assert run("TRI") == "--r" and run("QIQII") == "-r--I" and run("MOHT") == "---X" and run("MNHT") == "----" and run("HT") == "--"
    g = toxicity.Grammar({"clod": 4.0}, {"blor": 5.0})
    assert g.features("he is not a clod. You clod!")[:3] == [0.0, 4.0, 4.0]
    assert g.features("Blorping, blor. “clod” I will kill you")[0] == 5.0 and g.features("I will kill you")[4] == 3.0
    assert g.scores(np.array([g.features("clod"), g.features("what a clod. He left"), g.features("you clod")])).round(1).tolist()[:2] == [0.0, 0.0]
    assert g.scores(np.array([g.features("you clod"), g.features("a clod and a clod")])).min() > 0.5


def test_labels_of_one_id(spark):
    """Of several labels the greatest holds, whatever the rows' order; null ids, other labels and labels of no document are left out."""
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, "d"), (None, "e"), (4, "f")], "doc_id long, text string")
    labels = [(1, 0), (1, 1), (2, 0), (2, 0), (3, None), (3, 7), (None, 1), (9, 1), (4, 0)]
    for rows in (labels, labels[::-1]):
        got = toxicity.labelled(docs, spark.createDataFrame(rows, "doc_id long, toxic int")).collect()
        assert sorted((r.doc_id, r.text, r.toxic) for r in got) == [(1, "a", 1), (2, "b", 0), (2, "c", 0), (4, "f", 0)]
    assert toxicity.labelled(docs, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def test_html():
    model = html_extract.default_model()
    right = Counter()
    for page in html_extract.labelled_pages(60, seed=123):
        t = html_extract.Tree(page)
        for x, o, k in zip(t.text, model.marginals(t), t.keep, strict=True):
            if x is not None:
                right[(o >= 0) == (k == "1")] += 1
    assert right[True] > 0.95 * sum(right.values())
    text = lambda p: " ".join(model.blocks(p))
    page = '<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/a">Home page</a></li></ul></nav><div class="ad">Buy a new house today, it is cheap.</div><article><h1>A &amp; B</h1><p><b>First  part.<br><p>Second &lt;part&gt;,\n with&nbsp;space.</p><script>var t="</p>";</script></article><section class="comments"><p>I like this one very much.</p></section><footer>&copy; somebody, all rights.</footer>'
    assert text(page) == "A & B First part. Second <part>, with space."
    assert text(None) == text("") == text("<p") == text("<script>x") == ""
    assert text(page[:-20]) == text(page)


def test_html_open_head():
    shown = lambda p: [x for x in html_extract.Tree(p).text if x]
    head = '<html><head><title>T</title><script>var t = "<p>no</p>";</script><template><p>no</p></template><meta charset=x>\n'
    for opened in ("", "</head>", "<body>", "</head><body>"):
        assert shown(f"{head}{opened}<article><p>One.</p><p>Two.</p></article>") == ["One.", "Two."]
    assert shown(f"{head}Bare text.<p>One.</p>") == ["Bare text.", "One."]
    assert shown(f"{head}<template>no</head><p>One.</p>") == shown(f"{head}<template>no<body><p>One.</p></template>") == ["One."]
    assert html_extract.default_model().blocks(f"{head}<article><h1>Title</h1><p>Some text that is good. And more of it.</p></article>") == ["Title", "Some text that is good. And more of it."]


@pytest.mark.parametrize("tag", ["select", "button", "svg", "object", "template", "canvas", "datalist", "math", "audio", "video"])
def test_html_unclosed_dropped(tag):
    shown = lambda p: [x for x in html_extract.Tree(p).text if x]
    # closed by an open ancestor's end, whether or not a later element of the name is closed
    assert shown(f"<div><p>A.</p><{tag}>no</div><p>B.</p>") == ["A.", "B."]
    assert shown(f"<div><p>A.</p><{tag}>no</div><p>B.</p><{tag}>no</{tag}><p>C.</p>") == ["A.", "B.", "C."]
    # without an ancestor by the next block
    assert shown(f"<{tag}>no<article><p>A.</p></article>") == ["A."]
    # blocks within a closed one are not the page's, nor are end tags in its scripts
    assert shown(f'<div><{tag}><div>no</div><p>no</p><script>"</div>"</script>no</{tag}>A.</div><p>B.</p>') == ["A.", "B."]


def test_html_quotes_and_deep_nesting():
    shown = lambda p: [x for x in html_extract.Tree(p).text if x]
    assert shown("<p title=don't>Hello, it's a nice day.</p><p>Isn't it?</p>") == ["Hello, it's a nice day.", "Isn't it?"]
    assert shown('<p title="a > b" x=\'c > d\'>One.</p><a href=/x?y="z>link</a> two') == ["One.", "link two"]
    assert shown('<p title = "a>b"c>One.<p a=>Two.<p a= >Three.<p =">Four.') == ["One.", "Two.", "Three.", "Four."]
    assert shown('<p title="never closed>One.') == ["One."]
    began = time.perf_counter()
    n = 20_000
    assert shown("<div>" * n + "</section>" * n + "x" + "</div>" * n) == ["x"]
    assert shown("<ul>" + "<div>" * n + "<li>a</li>" * n) == ["a"] * n
    assert shown("<select>" + "<div>" * n + "</section>" * n + "</select>b") == ["b"]
    assert time.perf_counter() - began < 10


#: Pages laid out as the generator's aren't; what is marked with * is the article.
BY_HAND = (
    """<body bgcolor=white><table width=100%><tr><td colspan=2 class=topbar><a href=/>Start</a> <a href=/news>News</a> <a href=/about>About us</a></td></tr><tr><td width=120 class=navcol><a href=/1>One</a><br><a href=/2>Two</a><br><a href=/3>Three</a></td>
    <td><h2>*The old mill opens again</h2><p>*After nine years of work the mill by the river has opened its doors.</p><p>*Its owner, who learned the trade from an uncle, expects many visitors this summer.</p></td></tr><tr><td class=footer>Copyright 1998 by the town.</td></tr></table></body>""",
    """<div id=page><div id=masthead class=site-header><p>A blog about gardens</p></div><div id=primary><div class=post id=post-12><h1 class=entry-title>*Growing beans on a balcony</h1><div class=entry><p>*Beans need little more than light, water and something to climb.</p>
    <ol><li>*Soak the seeds for a night.</li><li>*Put them two fingers deep into the soil.</li></ol><blockquote><p>*My neighbour says that they grow while you watch.</p></blockquote></div></div><div id=comments class=comments-area><h3>2 replies</h3><ol class=comment-list><li>Mine never came up at all.</li><li>Try again in May, it is warmer then.</li></ol></div></div>
    <div id=secondary class=widget-area><h3>Recent posts</h3><ul><li><a href=/a>On snails</a></li><li><a href=/b>On rain</a></li></ul></div></div>""",
    """<html><body><div role=navigation><a href=#content>Skip</a> <a href=/i>Index</a></div><main id=content role=main><h1>*Tides</h1><p>*Tides are the rise and fall of sea levels.</p><h2>*Causes</h2><p>*They are caused by the pull of the moon and, to a lesser degree, of the sun.</p>
    <table class=data><tr><th>*Place</th><th>*Range</th></tr><tr><td>*Saint-Malo</td><td>*12 m</td></tr></table><p>*Where the shape of the coast helps, the range is large.</p></main><div class=footer-links><a href=/p>Privacy</a> <a href=/c>Contact</a></div></body></html>""",
    """<body><header class=top><a href=/>Daily paper</a><form action=/s><input name=q> Search the paper</form></header><section class=story-body><h1>*Council votes for the bridge</h1><p>*The council voted last night to rebuild the bridge, by nine votes to four.</p><div class=advert-inline><p>Buy two, get one free, only this week!</p></div>
    <p>*Work is to begin in spring. It will take two years.</p><aside class=related><h4>More on this</h4><ul><li><a href=/x>The bridge in pictures</a></li></ul></aside><p>*A ferry will run until then.</p></section><div class=gdpr-overlay><p>We use cookies to make this site better. By staying you agree.</p></div><footer><p>All rights reserved by the paper.</p></footer></body>""",
    """<body><div class=wrap><div class=share-bar><a href=/f>Share</a> <a href=/t>Post</a></div><div><h1>*How to sharpen a knife</h1><p>*Lay the stone on a wet cloth so that it stays where it is.</p><p>*Draw the blade over it at an even angle, from heel to tip, ten times on each side.</p><p>*Wipe it clean.</p><figure><img src=k.png><figcaption>*The right angle is flat.</figcaption></figure></div>
    <div class=newsletter-signup><p>Get our letter every week, it is free of charge.</p></div><div class=site-footer><p>Made with care in the north.</p></div></div></body>""",
    """<body><nav class=crumbs><a href=/>Home</a> / <a href=/r>Recipes</a></nav><article class=recipe><header><h1>*Potato soup</h1><p>*A soup for cold days, for four people.</p></header><h3>*You need</h3><ul><li>*One kilogram of potatoes</li><li>*Two onions</li><li>*A litre of stock</li></ul><p>*Cook the potatoes and onions in the stock for half an hour, then mash them.</p></article><section id=discussion><article><p>I added leeks and it was very good.</p></article></section></body>""",
)


def test_html_of_other_layouts():
    model = html_extract.default_model()
    right = wrong = lost = 0
    for page in BY_HAND:
        want = [x[1:] for x in html_extract.Tree(page).text if x and x[0] == "*"]
        got = [x.removeprefix("*") for x in model.blocks(page)]
        right, wrong, lost = right + len(set(want) & set(got)), wrong + len(set(got) - set(want)), lost + len(set(want) - set(got))
    assert right >= 0.9 * (right + lost) and wrong <= 0.1 * (right + wrong)


def test_sum_product_is_exact():
    """Against the sum over all states of a small tree."""
    import itertools

    model = html_extract.default_model()
    t = html_extract.Tree("<article><p>One sentence here.</p><ul><li>two</li></ul></article>")
    n = len(t.parent)
    weight = [sum(model.weight.get(f, 0.0) for f in fs[1:]) for fs in t.features]
    mass = [[0.0, 0.0] for _ in range(n)]
    for state in itertools.product((0, 1), repeat=n - 1):
        s = (1, *state)
        p = math.exp(sum(w for w, x in zip(weight[1:], s[1:], strict=True) if x))
        for i in range(1, n):
            p *= model.edge[t.features[i][0]][2 * s[t.parent[i]] + s[i]]
        for i in range(1, n):
            mass[i][s[i]] += p
    for i, got in enumerate(model.marginals(t)):
        if i:
            assert math.isclose(got, math.log(mass[i][1] / mass[i][0]), abs_tol=1e-6)


def test_extract_frame(spark):
    rows = [(1, "u", "<article><p>Some text that is good. And more of it.</p></article>", "x"), (2, None, None, "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_extract.extract(df).collect()}
    assert got[1].text.startswith("Some text") and got[1].n_chars == len(got[1].text) and (got[2].text, got[2].n_chars) == ("", 0)
    assert html_extract.extract(df.limit(0)).count() == 0
    clash = df.selectExpr("page_id", "url", "html", "'x' AS n_chars", "7 AS n_blocks", "'y' AS `a.b`")
    out = html_extract.extract(clash)
    assert out.columns == ["page_id", "url", "html", "a.b", "text", "n_chars", "n_blocks"] and {r.page_id: r.n_chars for r in out.collect()} == {1: got[1].n_chars, 2: 0}
    sentence = "Some text that is good and goes on. "
    long = spark.createDataFrame([(1, f"<article><p>{sentence * 60_000}</p></article>"), (2, "<p>" * 50_000)], "page_id long, html string")
    assert {r.page_id: r.n_chars for r in html_extract.extract(long).collect()} == {1: 60_000 * len(sentence) - 1, 2: 0}


def test_least_keys(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("by"), F.xxhash64("id").alias("key"))
    want = {b: sorted(r.key for r in df.where(F.col("by") == b).collect())[9] for b in (0, 1)}
    assert least_keys(df, "by", 10) == want
    assert least_keys(df, "by", 10**6) == {b: df.where(F.col("by") == b).agg(F.max("key")).first()[0] for b in (0, 1)}


@pytest.fixture(scope="module")
def tables(spark, docs, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame([(900, "Der Wald und password=abcdef123 die Straße über Wasser schön", "de", "src0", 60)], "doc_id long, text string, lang string, source string, n_chars long")).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, docs.where("doc_id = 7").first().text)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_pipeline(spark, tables):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    kept = {}
    for name, stage in p.STAGES:
        docs = stage(spark, docs, tables).cache()
        kept[name] = docs.collect()
        if name != "mixture":
            assert docs.columns == p.COLUMNS
    ids = {k: [r.doc_id for r in v] for k, v in kept.items()}
    assert not {200, 201, 202, 203} & set(ids["language"]) and 900 in ids["language"]
    assert min(i for i in ids["near_duplicates"] if i in range(120, 150)) == 120 and ids["near_duplicates"].count(5) == 1 and ids["near_duplicates"].count(None) <= 1
    assert 7 not in ids["decontamination"] and set(ids["decontamination"]) < set(ids["near_duplicates"])
    assert any("[SECRET]" in r.text and r.n_chars == len(r.text) for r in kept["secrets"]) and ids["secrets"].__len__() == len(ids["decontamination"])
    assert {"shard", "pass", "position"} <= set(docs.columns)
    assert p.run(spark, tables).count() == len(kept["mixture"])
    empty = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        empty = stage(spark, empty, tables)
        assert empty.count() == 0
