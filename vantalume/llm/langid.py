"""Language identification by interpolated Kneser-Ney character models of order 3.

Letters are lower-cased and anything else is one space; a trigram is three 21-bit code points in a 64-bit key. Of all
languages' models one pair of arrays is kept: sorted keys, and for each key every language's log probability (already
interpolated, so that a language that lacks the n-gram has its backed-off value). Only n-grams that no language has are
backed off while scoring. The language with the lowest mean cross-entropy wins.

At most ``sample`` training documents a language are drawn, the least by a hash of the id (equal ids come or stay together);
their texts count whole. Four fifths fit the models; the rest calibrates rejection. Its texts are cut into pieces of 8, 16, ... trigrams;
for each length, a piece's own cross-entropies are held against those that pieces of other languages get where their own model is
left out. A text is rejected if it has no letter, or if its cross-entropy lies above the middle between what 999 in 1,000 own
pieces of about its length stay below and the median of the foreign ones; or, without foreign pieces, ``slack`` above the own ones.
Where the median lies lower, as with very short texts, the own pieces' edge holds. Languages of fewer than 50 drawn rows are calibrated on all of them.

Defined cases: null or letterless texts are ``und`` with score 0; without any training text all are ``und``; ties go
to the first language by code point; repeated rows are scored alike; more than 1,000 languages are refused.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import U64, append_map, arrow_map, least_keys, record, scratch, settle

SAMPLE = 1500
SLACK = 1.5
#: Characters of texts, and cells of n-grams by languages, that are worked on at once.
CHUNK_CHARS, CHUNK_CELLS = 1 << 18, 1 << 20
#: Lengths at which rejection is calibrated are 2 to these powers.
LEAST_POWER, MOST_POWER = 3, 12
FEW = 50
_LETTER = np.array([chr(i).isalpha() for i in range(0x10000)])


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts, each with a space before and after; the text of each; the letters in each text."""
    joined = "\0".join((x or "").replace("\0", " ").lower() for x in texts)
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    cut = c == 0
    letter = np.zeros(len(c), bool)
    low = c < 0x10000
    letter[low] = _LETTER[c[low]]
    high = np.flatnonzero(~low)
    if len(high):
        kinds, back = np.unique(c[high], return_inverse=True)
        letter[high] = np.array([chr(k).isalpha() for k in kinds])[back]
    text = np.cumsum(cut)
    n_letters = np.bincount(text[letter], minlength=len(texts)) if len(c) else np.zeros(len(texts), int)
    s = np.where(letter, c, 32).astype(U64)
    # one space for a run of them, also across a cut; cuts stay apart by the text's number
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 32) | (s[:-1] != 32) | cut[1:]
    s, text = s[keep], text[keep]
    first = np.append(True, text[1:] != text[:-1]) if len(text) else np.empty(0, bool)
    lead = np.flatnonzero(first & (s != 32))
    s, text = np.insert(s, lead, 32), np.insert(text, lead, text[lead])
    return s, text, n_letters


def trigrams(s: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the trigrams within a text, and their text."""
    if len(s) < 3:
        return np.empty(0, U64), np.empty(0, int)
    key = (s[:-2] << U64(42)) | (s[1:-1] << U64(21)) | s[2:]
    ok = text[:-2] == text[2:]
    return key[ok], text[:-2][ok]


def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(x), bool), np.zeros(len(x), int)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return keys[at] == x, at


def _discount(counts: np.ndarray) -> float:
    n1, n2 = int((counts == 1).sum()), int((counts == 2).sum())
    return n1 / (n1 + 2 * n2) if n1 and n2 else 0.75


class _Model:
    """One language's interpolated Kneser-Ney probabilities."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, vocabulary: int) -> None:
        low = U64((1 << 42) - 1)
        self.floor = 1.0 / vocabulary

        def level(grams: np.ndarray, c: np.ndarray) -> tuple:
            d = _discount(c)
            context, at = np.unique(grams >> U64(21), return_inverse=True)
            total = np.bincount(at, c)
            return grams, np.maximum(c - d, 0) / total[at], context, d * np.bincount(at) / total

        two, c2 = np.unique(keys & low, return_counts=True)
        one, c1 = np.unique(two & U64((1 << 21) - 1), return_counts=True)
        self.levels = [level(one, c1.astype(float)), level(two, c2.astype(float)), level(keys, counts.astype(float))]

    def p(self, grams: np.ndarray, order: int) -> np.ndarray:
        if not order:
            return np.full(len(grams), self.floor)
        keys, direct, context, back = self.levels[order - 1]
        has, at = _find(keys, grams)
        known, c = _find(context, grams >> U64(21))
        lower = self.p(grams & U64((1 << (21 * (order - 1))) - 1), order - 1)
        return np.where(has, direct[at] if len(direct) else 0.0, 0.0) + np.where(known, back[c] if len(back) else 1.0, 1.0) * lower


class Models:
    """All languages' log probabilities in shared sorted arrays."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.langs = sorted(counts)
        every = np.unique(np.concatenate([k for k, _ in counts.values()])) if counts else np.empty(0, U64)
        vocabulary = len(np.unique(every & U64((1 << 21) - 1))) + 1
        own = [_Model(*counts[x], vocabulary) for x in self.langs]
        table = lambda grams, n: np.stack([np.log(m.p(grams, n)) for m in own], 1).astype(np.float32) if own else np.empty((0, 0), np.float32)
        two = np.unique(every & U64((1 << 42) - 1))
        one = np.unique(two & U64((1 << 21) - 1))
        self.keys = [one, two, every]
        self.logp = [table(one, 1), table(two, 2), table(every, 3)]
        self.contexts, self.backs = [], []
        for n in (1, 2, 3):
            context = np.unique(self.keys[n - 1] >> U64(21))
            logs = []
            for m in own:
                known, at = _find(m.levels[n - 1][2], context)
                logs.append(np.log(np.where(known, m.levels[n - 1][3][at], 1.0)))
            self.contexts.append(context)
            self.backs.append(np.stack(logs, 1).astype(np.float32) if own else np.empty((0, 0), np.float32))
        self.floor = np.float32(np.log(1.0 / vocabulary))
        #: The greatest cross-entropy that isn't rejected, by language and the length's power of two.
        self.limit = np.full((len(self.langs), MOST_POWER + 1), np.inf)

    def of(self, grams: np.ndarray, order: int = 3) -> np.ndarray:
        if not order:
            return np.full((len(grams), len(self.langs)), self.floor, np.float32)
        has, at = _find(self.keys[order - 1], grams)
        out = self.logp[order - 1][at] if len(self.keys[order - 1]) else np.zeros((len(grams), len(self.langs)), np.float32)
        miss = np.flatnonzero(~has)
        if len(miss):
            x = grams[miss]
            known, c = _find(self.contexts[order - 1], x >> U64(21))
            out[miss] = np.where(known[:, None], self.backs[order - 1][c], 0) + self.of(x & U64((1 << (21 * (order - 1))) - 1), order - 1)
        return out

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean cross-entropies (texts x languages), trigrams of each text, letters of each text."""
        s, text, letters = symbols(texts)
        grams, of = trigrams(s, text)
        n = np.bincount(of, minlength=len(texts))
        out = np.zeros((len(texts), len(self.langs)))
        if not self.langs:
            return out, n, letters
        step = max(1 << 12, CHUNK_CELLS // len(self.langs))
        for i in range(0, len(grams), step):
            logs, t = self.of(grams[i : i + step]), of[i : i + step]
            for k in range(len(self.langs)):
                out[:, k] -= np.bincount(t, logs[:, k], minlength=len(texts))
        return out / np.maximum(n, 1)[:, None], n, letters

    def pieces(self, text: str | None) -> list[tuple[int, np.ndarray]]:
        """For each power of two, the mean cross-entropies (pieces x languages) of a text's pieces of so many trigrams."""
        grams, _ = trigrams(*symbols([text])[:2])
        least, sums = 1 << LEAST_POWER, []
        step = max(least, CHUNK_CELLS // max(1, len(self.langs)) // least * least)
        for i in range(0, len(grams) // least * least, step):
            logs = self.of(grams[i : min(i + step, len(grams) // least * least)])
            sums.append(-logs.reshape(-1, least, len(self.langs)).sum(1, dtype=np.float64))
        out, x = [], np.concatenate(sums) if sums else np.empty((0, len(self.langs)))
        for power in range(LEAST_POWER, MOST_POWER + 1):
            if not len(x):
                break
            out.append((power, x / (1 << power)))
            x = x[: len(x) // 2 * 2].reshape(-1, 2, len(self.langs)).sum(1)
        return out

    def over(self, best: np.ndarray, cross: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Which texts lie above their language's limit, given their languages, cross-entropies and trigrams."""
        power = np.minimum(np.floor(np.log2(np.maximum(n, 1))).astype(int), MOST_POWER)
        return cross > self.limit[best, power]


def _runs(texts: list[str | None], most: int = CHUNK_CHARS):
    i = 0
    while i < len(texts):
        j, total = i, 0
        while j < len(texts) and (j == i or total + len(texts[j] or "") <= most):
            total += len(texts[j] or "")
            j += 1
        yield i, j
        i = j


def train(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, slack: float = SLACK) -> Models:
    """Models of the languages in the column lang of docs, which has training rows only."""
    with scratch(docs.sparkSession):
        return _train(docs, doc_id, text, lang, sample, slack)


def _train(docs: DataFrame, doc_id: str, text: str, lang: str, sample: int, slack: float) -> Models:
    key = F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    pairs = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), key.alias("key"))
    bound = least_keys(pairs, "lang", sample)
    chosen = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), key.alias("key"))
    if bound:
        limits = F.create_map(*[F.lit(x) for kv in bound.items() for x in kv])
        chosen = chosen.where(F.col("lang").isNotNull() & (F.col("key") <= limits[F.col("lang")]))
    else:
        chosen = chosen.limit(0)
    chosen = settle(chosen.select("lang", "text", F.col("key")), "chosen")
    few = [r["lang"] for r in chosen.groupBy("lang").count().where(F.col("count") < FEW).collect()]
    scarce = F.col("lang").isin(few) if few else F.lit(False)
    held = F.pmod(F.xxhash64("key", F.lit("held")), F.lit(5)) == 0
    fitting, held_back = (chosen.where(c).select("lang", "text") for c in (scarce | ~held, scarce | held))

    def count(b: pa.RecordBatch):
        langs, texts = np.array(b.column(0).to_pylist(), object), b.column(1).to_pylist()
        for i, j in _runs(texts):
            s, text, _ = symbols(texts[i:j])
            grams, of = trigrams(s, text)
            for x in set(langs[i:j]):
                k, c = np.unique(grams[langs[i:j][of] == x] if len(of) else grams, return_counts=True)
                yield record(lang=pa.array([x] * len(k), pa.string()), gram=k.view(np.int64), n=c.astype(np.int64))

    counted = arrow_map(fitting, count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = np.array(counted.column("lang").to_pylist(), object)
    grams, ns = counted.column("gram").to_numpy().astype(np.int64).view(U64), counted.column("n").to_numpy()
    counts = {}
    for x in sorted(set(names.tolist())):
        pick = np.flatnonzero(names == x)
        order = pick[np.argsort(grams[pick])]
        counts[x] = grams[order], ns[order]
    models = Models(counts)
    if counts:
        _calibrate(models, held_back, slack)
    return models


def _calibrate(models: Models, held_back: DataFrame, slack: float) -> None:
    """Sets the limits from rows (lang, text) that the models weren't fitted on."""
    shared = held_back.sparkSession.sparkContext.broadcast(models)

    def entropies(b: pa.RecordBatch):
        m = shared.value
        at = {x: i for i, x in enumerate(m.langs)}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if lang not in at:
                continue
            for power, h in m.pieces(text):
                yield record(by=np.full(len(h), at[lang], np.int32), power=np.full(len(h), power, np.int32), own=np.ones(len(h), bool), h=h[:, at[lang]].copy())
                if len(m.langs) > 1:
                    h[:, at[lang]] = np.inf
                    yield record(by=h.argmin(1).astype(np.int32), power=np.full(len(h), power, np.int32), own=np.zeros(len(h), bool), h=h.min(1))

    found = arrow_map(held_back, entropies, "by int, power int, own boolean, h double").groupBy("by", "power").agg(
        F.expr("percentile_approx(h, 0.999, 100000) FILTER (WHERE own)").alias("own"), F.expr("percentile_approx(h, 0.5, 100000) FILTER (WHERE NOT own)").alias("foreign")
    )
    for r in found.collect():
        if r["own"] is not None:
            models.limit[r["by"], r["power"]] = r["own"] + (slack if r["foreign"] is None else max(0.0, r["foreign"] - r["own"]) / 2)
    # a length without pieces has the limit of the next lesser one
    for power in range(LEAST_POWER + 1, MOST_POWER + 1):
        gone = np.isinf(models.limit[:, power])
        models.limit[gone, power] = models.limit[gone, power - 1]


def identify(docs: DataFrame, models: Models, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with lang_pred, score (0 to 1), cross_entropy and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def rows(b: pa.RecordBatch) -> dict:
        m = shared.value
        texts = b.column(b.schema.get_field_index(text)).to_pylist()
        pred, score, cross, rejected = [], [], [], []
        for i, j in _runs(texts):
            h, n, letters = m.score(texts[i:j])
            if m.langs:
                best = h.argmin(1)
                low = h[np.arange(len(h)), best]
                p = 1 / np.exp((low[:, None] - h) * np.minimum(n, 50)[:, None]).sum(1)
            else:
                best, low, p, letters = np.zeros(j - i, int), np.zeros(j - i), np.zeros(j - i), np.zeros(j - i, int)
            some = letters > 0
            pred += [m.langs[k] if ok else "und" for k, ok in zip(best.tolist(), some.tolist(), strict=True)]
            score += np.where(some, p, 0.0).tolist()
            cross += np.where(some, low, 0.0).tolist()
            over = m.over(best, low, n) if m.langs else np.ones(j - i, bool)
            rejected += (~some | over).tolist()
        return {"lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64()), "cross_entropy": pa.array(cross, pa.float64()), "rejected": pa.array(rejected, pa.bool_())}

    return append_map(docs, list(docs.columns) if keep is None else keep, rows, "lang_pred string, score double, cross_entropy double, rejected boolean")
