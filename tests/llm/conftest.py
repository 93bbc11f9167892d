from __future__ import annotations

import random
import re

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words int, score string, spans string, h1 string"


def spaced(t):
    """Words between white space, A-Z lower-cased."""
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")))


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")))


def make_docs():
    r = random.Random(5)
    vocabulary = {"en": "the of and to in house river green walk slowly over bright stone".split(), "de": "der die und nicht über straße schön größe wald wasser kälte öl".split()}
    rows = []
    for i in range(120):
        lang = "en" if i % 3 else "de"
        words = [r.choice(vocabulary[lang]) + r.choice(["", "", "s", "ing", str(i % 7)]) for _ in range(r.choice([1, 3, 12, 40, 160]))]
        rows.append((i, " ".join(words).capitalize(), lang, f"src{i % 4}"))
    base = [r.choice("abcdefghij") + r.choice("klmnop") + str(r.randrange(400)) for _ in range(120)]
    for i in range(120, 150):  # near copies, and copies
        copy = list(base)
        for _ in range(i % 6):
            copy[r.randrange(120)] = f"x{r.randrange(1000)}"
        rows.append((i, " ".join(copy), "en", "src0"))
    rows += [(200, None, None, None), (201, "", "en", "src1"), (202, " \n\t ", "en", None), (203, "!!! 123 ???", "de", "src2"), (None, "the house and the river", "en", "src1"), (None, "the house and the river", "en", "src1"), (5, rows[5][1], "en", "src9"), (204, "wort " * 30_000, "de", "src3")]
    return [(*x, len(x[1]) if x[1] is not None else None, 7, "clash", "clash", "clash") for x in rows]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(make_docs(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


class Forest:
    def __init__(self):
        self.p = {}

    def find(self, x):
        self.p.setdefault(x, x)
        while self.p[x] != x:
            x = self.p[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.p[max(a, b)] = min(a, b)
