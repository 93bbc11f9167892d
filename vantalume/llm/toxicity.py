"""Toxicity by a weighted finite-state pattern grammar.

Words become classes (insult, threat verb, modal, target, negation, report, quote mark, other); a clause is the word
sequence between punctuation marks. Five transducers are composed into one machine that rewrites a clause's
class string: negation marks insults in its scope, reported speech those said by others, target those aimed at
someone, threat a modal with a threat verb and a target, and insult turns the marked symbols into scored kinds. A document is
scored by its matched clauses: each kind's summed weights enter a logistic model. An insult aimed at no one scores only where the
document has insulted before, so a lone word never does.

Insult words and stems (a word's first 4 to 7 letters) with their weights, and the kinds' coefficients, are
learned from labelled rows, at most ``most_toxic`` and ``most_clean`` of them, least by a hash of the id. A term
must be in many toxic texts, nearly absent from clean ones, and stand in varied contexts, so that copies of one text
don't make their words insults; no number of terms is capped. A short fixed word list serves where no label speaks.

Defined cases: null and empty texts get the score of a text without matches; without labelled rows of both classes fixed
coefficients are used; equal ids are drawn together; input columns other than the named ones are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import append_map, arrow_map, least_keys, record, scratch, settle

MOST_TOXIC, MOST_CLEAN = 4000, 8000
STEMS = range(4, 8)
#: Characters of text whose terms a task of the training counts at once.
PIECE_CHARS = 1 << 18
TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)?|[.!?;:,\n]|[\"“”„«»]")
BREAKS = frozenset(".!?;:,\n")
QUOTES = frozenset('"“”„«»')
#: Words of the grammar's classes, in four languages.
INSULTS = frozenset("idiot idiots stupid moron morons loser losers dumb scum trash worthless pathetic disgusting dummkopf abschaum imbécile ordure imbécil basura".split())
THREATS = frozenset("kill hurt destroy beat burn shoot stab töten umbringen tuer matar".split())
MODALS = frozenset("will gonna shall should must i'll we'll werde werden vais vamos voy".split())
TARGETS = frozenset("you your you're u they them he she him her him du dich dein ihr sie tu toi ton vous ellos tú te usted".split())
NEGATIONS = frozenset("not no never isn't aren't don't nicht kein keine nie pas jamais nunca".split())
REPORTS = frozenset("said says called calls wrote claimed told sagte nannte dit appelé dijo llamó".split())

Arc = tuple[int, str]


class Transducer:
    """A deterministic letter transducer: arcs by (state, letter); other letters pass, to ``rest`` of the state."""

    def __init__(self, arcs: dict[tuple[int, str], Arc], rest: dict[int, int] | None = None) -> None:
        self.arcs, self.rest = arcs, rest or {}

    def step(self, state: int, letter: str) -> Arc:
        return self.arcs.get((state, letter)) or (self.rest.get(state, state), letter)


class Composed:
    """A cascade of transducers run as one machine; its states and arcs are made as they are met."""

    def __init__(self, *parts: Transducer) -> None:
        self.parts, self.made = parts, {}

    def run(self, letters: Iterable[str]) -> str:
        state, out = (0,) * len(self.parts), []
        for x in letters:
            arc = self.made.get((state, x))
            if arc is None:
                after, y = [], x
                for t, s in zip(self.parts, state, strict=True):
                    s, y = t.step(s, y)
                    after.append(s)
                arc = self.made[state, x] = tuple(after), y
            state = arc[0]
            out.append(arc[1])
        return "".join(out)


def grammar() -> Composed:
    """Input letters: I insult, H threat verb, M modal, T target, N negation, R report, Q quote mark, O other, B the clause's end.
    Output kinds: I plain after an earlier insult, t targeted, n negated, r reported, X threat; anything else counts nothing."""
    scope = 3
    negation = Transducer({(s, "N"): (scope, "O") for s in range(scope + 1)} | {(s, "I"): (s - 1, "n") for s in range(1, scope + 1)} | {(s, "H"): (s - 1, "O") for s in range(1, scope + 1)}, {s: s - 1 for s in range(1, scope + 1)})
    reported = Transducer({(0, "R"): (1, "O"), (0, "Q"): (2, "O"), (2, "Q"): (0, "O"), (1, "Q"): (2, "O"), (1, "I"): (1, "r"), (2, "I"): (2, "r"), (1, "n"): (1, "r"), (2, "n"): (2, "r"), (1, "H"): (1, "O"), (2, "H"): (2, "O"), (1, "R"): (1, "O"), (2, "R"): (2, "O")})
    threat = Transducer({(0, "M"): (1, "O"), (1, "M"): (1, "O"), (2, "M"): (1, "O"), (1, "H"): (2, "O"), (0, "H"): (0, "O"), (2, "H"): (2, "O"), (2, "T"): (0, "X")})
    target = Transducer({(0, "T"): (1, "O"), (1, "T"): (1, "O"), (1, "I"): (1, "t"), (1, "X"): (1, "X")})
    for t in (negation, reported, threat, target):
        t.arcs |= {(state, "B"): (0, "B") for state in range(scope + 1)}
    insult = Transducer({(s, x): (s, x) for s in (0, 1) for x in "nrX"} | {(s, x): (s, "-") for s in (0, 1) for x in "OTMHNRQB"} | {(0, "I"): (1, "-"), (1, "I"): (1, "I"), (0, "t"): (1, "t"), (1, "t"): (1, "t")})
    return Composed(negation, reported, threat, target, insult)


KINDS = "ItnrX"
#: Bias and kinds' coefficients used without labels.
PRIOR = np.array([-3.0, 2.0, 2.5, 0.3, 0.3, 2.5])


class Grammar:
    """The machine with its lexicon and coefficients."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]) -> None:
        self.words, self.stems, self.theta = words, stems, PRIOR
        self.lengths = sorted({len(s) for s in stems})
        self.machine = grammar()
        self.fixed = {w: c for c, group in (("H", THREATS), ("M", MODALS), ("R", REPORTS), ("N", NEGATIONS), ("T", TARGETS)) for w in group}

    def weight(self, word: str) -> float:
        w = self.words.get(word)
        if w is None:
            for n in self.lengths:
                w = self.stems.get(word[:n])
                if w is not None:
                    return w
            return 0.0
        return w

    def features(self, text: str | None) -> list[float]:
        """Summed weights of each kind over the matched clauses."""
        total = [0.0] * len(KINDS)
        tokens = TOKEN.findall((text or "").lower())
        hits = {}
        for t in set(tokens):
            w = self.weight(t)
            if w:
                hits[t] = w
        live = [i for i, t in enumerate(tokens) if t in hits or t in THREATS] if hits or not THREATS.isdisjoint(tokens) else []
        end = -1
        words, letters = [], []
        for i in live:
            if i < end:
                continue
            begin = i
            while begin > 0 and tokens[begin - 1] not in BREAKS:
                begin -= 1
            end = i
            while end < len(tokens) and tokens[end] not in BREAKS:
                end += 1
            clause = tokens[begin:end]
            words += [*clause, ""]
            letters += ["I" if t in hits else "Q" if t in QUOTES else self.fixed.get(t, "O") for t in clause] + ["B"]
        for t, kind in zip(words, self.machine.run(letters), strict=True):
            if kind != "-":
                total[KINDS.index(kind)] += hits.get(t, 3.0)
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.theta[0] + np.log1p(x) @ self.theta[1:], -50, 50)))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "machine"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.machine = grammar()


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Bias and coefficients, none below 0, by projected gradient steps on both classes' mean loss."""
    x = np.column_stack([np.ones(len(x)), np.log1p(x)])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    theta = PRIOR.copy()
    rate = 4.0 / max(1e-9, np.linalg.eigvalsh((x * weight[:, None]).T @ x)[-1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -50, 50)))
        step = x.T @ (weight * (p - y)) + 0.003 * (theta - PRIOR)
        theta = theta - rate * step
        theta[1:] = np.maximum(theta[1:], 0)
    return theta


def _pieces(b: pa.RecordBatch, most: int = PIECE_CHARS) -> Iterator[tuple[list, list]]:
    """The labels and texts of a batch (y, text), in runs of so many characters: their words' counts are held at once."""
    ys, texts, size = [], [], 0
    for y, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
        t = t.as_py() or ""
        ys.append(y)
        texts.append(t)
        size += len(t)
        if size >= most:
            yield ys, texts
            ys, texts, size = [], [], 0
    yield ys, texts


def _terms(text: str | None) -> tuple[set[str], set[str]]:
    words = {t for t in TOKEN.findall((text or "").lower()) if t[0].isalpha()}
    return words, {f"^{w[:n]}" for w in words for n in STEMS if len(w) > n}


def labelled(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", label: str = "toxic", most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> DataFrame:
    """docs with the labels of a bounded sample, written out: ids are drawn from the labels before any text moves.

    Of several labels of one id the greatest holds: a text that anyone marked is toxic. Labels other than 0 and 1 are left out.
    """
    key = F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    one = labels.where(F.col(label).isin(0, 1)).groupBy(doc_id).agg(F.max(label).alias(label))
    one = settle(one.select(doc_id, label, key.alias("__key")), "labels")
    edges = least_keys(one.select(F.col(label).cast("int").alias("y"), F.col("__key").alias("key")), "y", {1: most_toxic, 0: most_clean})
    drawn = reduce(lambda a, b: a | b, (((F.col(label) == y) & (F.col("__key") <= edge)) for y, edge in edges.items()), F.lit(False))
    # at most most_toxic + most_clean ids
    return settle(docs.drop(label).join(F.broadcast(one.where(drawn).select(doc_id, label)), doc_id), "labelled")


def train(rows: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> Grammar:
    """A grammar learned from rows, which have a text and a label 0 or 1 (others are left out)."""
    with scratch(rows.sparkSession):
        return _train(rows, doc_id, text, label, most_toxic, most_clean)


def _train(rows: DataFrame, doc_id: str, text: str, label: str, most_toxic: int, most_clean: int) -> Grammar:
    key = F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    rows = rows.where(F.col(label).isin(0, 1)).select(F.col(label).cast("int").alias("y"), F.col(text).cast("string").alias("text"), key.alias("key"))
    edges = least_keys(rows.select("y", "key"), "y", {1: most_toxic, 0: most_clean})
    if len(edges) < 2:
        return Grammar(dict.fromkeys(INSULTS, 3.0), {})
    rows = rows.where(((F.col("y") == 1) & (F.col("key") <= edges[1])) | ((F.col("y") == 0) & (F.col("key") <= edges[0]))).select("y", "text")
    rows = settle(rows, "labelled")

    def count(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for ys, texts in _pieces(b):
            found: dict[int, Counter] = {0: Counter(), 1: Counter()}
            n = [0, 0]
            for y, t in zip(ys, texts, strict=True):
                for group in _terms(t):
                    found[y].update(group)
                n[y] += 1
            terms = list(found[0].keys() | found[1].keys())
            yield record(term=pa.array([*terms, ""], pa.string()), tox=pa.array([*(found[1][t] for t in terms), n[1]], pa.int64()), clean=pa.array([*(found[0][t] for t in terms), n[0]], pa.int64()))

    df = arrow_map(rows, count, "term string, tox bigint, clean bigint").groupBy("term").agg(F.sum("tox").alias("tox"), F.sum("clean").alias("clean"))
    n1, n0 = (lambda r: (r["tox"], r["clean"]))(df.where("term = ''").first())
    # so many toxic texts that chance alone would give less than one such term in two samples
    kinds = df.where("term != '' and tox >= 3").count()
    least = max(3, math.ceil(0.004 * n1), math.ceil(math.log(0.5 / max(1, kinds)) / math.log(n1 / (n1 + n0))))
    odds = F.log((F.col("tox") + 0.5) / (n1 + 1)) - F.log((F.col("clean") + 0.5) / (n0 + 1))
    picked = df.where((F.col("term") != "") & (F.col("tox") >= least)).withColumn("odds", odds).where("odds >= 3.5").collect()
    odds_of = {r["term"]: r["odds"] for r in picked}
    tox_of = {r["term"]: r["tox"] for r in picked}

    def contexts(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for _, texts in _pieces(b):
            term, context, doc = [], [], []
            for t in texts:
                tokens = ["", *TOKEN.findall(t.lower()), ""]
                for i in range(1, len(tokens) - 1):
                    w = tokens[i]
                    for x in (w, *(f"^{w[:n]}" for n in STEMS if len(w) > n)):
                        if x in odds_of:
                            term.append(x)
                            context.append(f"{tokens[i - 1]} {tokens[i + 1]}" if x[0] != "^" else w)
                            doc.append(f"{tokens[i - 1]} {tokens[i + 1]}")
            yield record(term=pa.array(term, pa.string()), own=pa.array(context, pa.string()), context=pa.array(doc, pa.string()))

    varied = arrow_map(rows.where("y = 1"), contexts, "term string, own string, context string").groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("context").alias("contexts"), F.countDistinct("own").alias("forms")).collect()
    words, stems = {}, {}
    for r in varied:
        x = r["term"]
        if r["contexts"] < max(3, 0.4 * r["n"]):
            continue
        if x[0] != "^":
            words[x] = odds_of[x]
        elif r["forms"] >= 3 and odds_of[x] >= 4:
            stems[x[1:]] = odds_of[x]
    # of nested stems with nearly the same texts, the longest is the stem
    for x in sorted(stems, key=len):
        if any(len(y) > len(x) and y.startswith(x) and tox_of[f"^{y}"] >= 0.9 * tox_of[f"^{x}"] for y in stems):
            del stems[x]
    learned = Grammar(words | {w: 3.0 for w in INSULTS if w not in words}, stems)
    shared = rows.sparkSession.sparkContext.broadcast(learned)

    def measure(b: pa.RecordBatch) -> pa.RecordBatch:
        x = [shared.value.features(t) for t in b.column(1).to_pylist()]
        return record(y=b.column(0), x=pa.array(x, pa.list_(pa.float64())))

    fitted = arrow_map(rows, measure, "y int, x array<double>").toArrow()
    learned.theta = _logistic(np.array(fitted.column("x").to_pylist(), float).reshape(-1, len(KINDS)), fitted.column("y").to_numpy())
    return learned


def toxicity(docs: DataFrame, model: Grammar, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with score (0 to 1), predicted (1 if score >= 0.5) and clauses (weight of each kind)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(b: pa.RecordBatch) -> dict:
        m = shared.value
        x = np.array([m.features(t) for t in b.column(b.schema.get_field_index(text)).to_pylist()]).reshape(-1, len(KINDS))
        p = m.scores(x)
        return {"score": p, "predicted": (p >= 0.5).astype(np.int32), "clauses": pa.array(x.tolist(), pa.list_(pa.float64()))}

    return append_map(docs, list(docs.columns) if keep is None else keep, rows, "score double, predicted int, clauses array<double>")
