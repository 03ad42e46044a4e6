"""Language identification by interpolated Kneser-Ney character language models.

One model per language over lower-cased text whose runs of anything but letters become one
space. A language's n-grams of an order stand in one sorted array of 64-bit hashes; beside it
lie their log probabilities, already interpolated down to the uniform distribution, and in a
second pair of arrays the log back-off weights of its contexts. A text's score is its
cross-entropy per character under each model; the lowest wins. A batch's distinct n-grams are
looked up once in each language, so time and memory grow with the sum of the models.

The models are fitted on at most DOCS_A_LANG distinct whole texts of each language, in hash
order, from the rows offered for learning (the bound of the fitting sample); MAX_GRAMS bounds
what a model keeps of an order, rarest n-grams going first. Texts stay on the executors: they
count n-grams there, each language is fitted in one task, and the driver gathers the finished
arrays. Scoring covers all characters of all texts. The number of languages is not limited.

Rejection is calibrated on documents that the models did not see (CALIBRATION_DOCS a language):
the winner's cross-entropy may lie REJECT_MARGIN above what those had, and more for short texts,
whose cross-entropy scatters by the root of their length; so ordinary documents stay.

A null text, or one without a letter, is ``und`` with score 0, and rejected; so is nothing else
that no model is there for. Null labels teach nothing. Ties go to the first language by name.
Repeated rows count once in fitting and get equal results. An empty table teaches no language
and gives an empty result. Other columns travel in ``row`` whatever their names.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulith.llm.common import released, staged

ORDER = 4
DOCS_A_LANG = 256
CALIBRATION_DOCS = 200
MAX_GRAMS = 1 << 20
REJECT_MARGIN = 1.2
REJECT_CHARS = 64
SLICE = 1 << 18
UNDETERMINED = "und"

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _fold() -> np.ndarray:
    """For each code point its folded letter: lower case, or a space for anything but letters."""
    table = np.full(0x110000, 32, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low[0])
    return table


_folded: list[np.ndarray] = []
_NONE = np.zeros(0, dtype=np.uint64)


def codes(text: str) -> np.ndarray:
    """Folded code points with single spaces, one before and one after; empty without letters."""
    if not _folded:
        _folded.append(_fold())
    raw = _folded[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    letter = raw != 32
    if not letter.any():
        return raw[:0]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    raw = raw[keep]
    ends = [] if raw[-1] == 32 else [32]
    return np.concatenate([[32], raw, ends]).astype(np.uint64)


def _hashes(x: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams that begin at each place, by order from 1; each extends the hash of its context."""
    out: list[np.ndarray] = []
    with np.errstate(over="ignore"):
        for n in range(1, order + 1):
            m = max(0, len(x) - n + 1)
            h = x[n - 1 :] if n == 1 else out[-1][:m] + x[n - 1 :]
            h = (h + np.uint64(1)) * _MUL
            h ^= h >> np.uint64(29)
            h *= _MIX
            h ^= h >> np.uint64(32)
            out.append(h)
    return out


@dataclass
class Language:
    """One language's sorted hash arrays, by order from 1."""

    grams: list[np.ndarray]
    logs: list[np.ndarray]  # log2 probabilities
    contexts: list[np.ndarray]  # by the order of the context, from 1
    weights: list[np.ndarray]  # log2 back-off weights
    floor: float  # log2 probability of an unseen character

    def lookup(self, hs: list[np.ndarray], places: np.ndarray, n: int) -> np.ndarray:
        """log2 probability of the character at each place after the n - 1 before it. hs: see ``_hashes``."""
        out = np.zeros(len(places))
        todo = np.arange(len(places))
        for k in range(n, 0, -1):
            at = places[todo] - (k - 1)
            where, hit = _found(self.grams[k - 1], hs[k - 1][at])
            out[todo[hit]] += self.logs[k - 1][where[hit]]
            todo, at = todo[~hit], at[~hit]
            if k > 1 and len(todo):
                where, hit = _found(self.contexts[k - 2], hs[k - 2][at])
                out[todo[hit]] += self.weights[k - 2][where[hit]]
        out[todo] += self.floor
        return out


def _found(table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each hash would stand in the sorted table, and whether it does."""
    if not len(table):
        return np.zeros(len(h), dtype=np.int64), np.zeros(len(h), dtype=bool)
    where = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return where, table[where] == h


@dataclass
class Model:
    langs: list[str]
    languages: list[Language]
    limits: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def entropies(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Bits per character of each text under each model; None without a letter.

        Texts are scored together, SLICE characters at a time; a longer text is cut into pieces
        whose first characters see those before the cut.
        """
        out: list[np.ndarray | None] = [None] * len(texts)
        chars = np.ones(len(texts))
        sums = np.zeros((len(texts), len(self.langs)))
        pieces: list[tuple[int, np.ndarray, int]] = []
        held = 0

        def flush() -> None:
            nonlocal pieces, held
            if pieces:
                self._score(pieces, sums)
            pieces, held = [], 0

        for i, text in enumerate(texts):
            x = codes(text) if text else _NONE
            if not len(x):
                continue
            chars[i] = len(x) - 1
            out[i] = sums[i]
            for lo in range(1, len(x), SLICE):
                piece = x[max(0, lo - ORDER + 1) : lo + SLICE]
                pieces.append((i, piece, min(lo, ORDER - 1)))
                held += len(piece)
                if held >= SLICE:
                    flush()
        flush()
        return [None if e is None else -e / n for e, n in zip(out, chars, strict=True)]

    def _score(self, pieces: list[tuple[int, np.ndarray, int]], sums: np.ndarray) -> None:
        """Adds each piece's log2 probabilities, but for its first skip characters, to the row of its text."""
        x = np.concatenate([p for _, p, _ in pieces])
        sizes = np.array([len(p) for _, p, _ in pieces])
        within = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        owner = np.repeat(np.array([i for i, _, _ in pieces]), sizes)
        scored = within >= np.repeat([k for _, _, k in pieces], sizes)
        hs = _hashes(x, ORDER)
        for n in range(ORDER, 0, -1):  # shorter ones only at the beginning of a text
            at = np.flatnonzero(scored & (within >= n - 1 if n == ORDER else within == n - 1))
            if len(at):
                _, first, back = np.unique(hs[n - 1][at - (n - 1)], return_index=True, return_inverse=True)
                for j, language in enumerate(self.languages):
                    sums[:, j] += np.bincount(owner[at], weights=language.lookup(hs, at[first], n)[back], minlength=len(sums))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float, bool]]:
        """Language, confidence, bits per character and rejected, for each text."""
        got = []
        for text, e in zip(texts, self.entropies(texts), strict=True):
            if e is None or not len(e):  # no letter, or no language learned: only the former is rejected
                got.append((UNDETERMINED, 0.0, 0.0, e is None))
                continue
            best = int(np.argmin(e))
            # odds softened as if the text had at most 64 independent characters
            p = np.exp2(-(e - e[best]) * min(64, len(text)))
            limit = self.limits[best] + REJECT_MARGIN + _scatter(len(text)) if len(self.limits) else np.inf
            got.append((self.langs[best], float(1 / p.sum()), float(e[best]), bool(e[best] > limit)))
        return got


def _scatter(chars: int) -> float:
    """How much more the cross-entropy of a text of so many characters may exceed the usual."""
    return REJECT_MARGIN * (REJECT_CHARS / max(1, chars)) ** 0.5


def counted(texts: list[str]) -> pd.DataFrame:
    """n, gram, context, suffix and times of the distinct n-grams of some texts."""
    parts = []
    streams = [_hashes(c, ORDER) for t in texts if len(c := codes(t))]
    for n in range(1, ORDER + 1):
        g = np.concatenate([_NONE, *(h[n - 1] for h in streams)])
        none = [np.zeros(len(h[0]), dtype=np.uint64) for h in streams]
        c = np.concatenate([_NONE, *(h[n - 2][: len(h[n - 1])] if n > 1 else z for h, z in zip(streams, none, strict=True))])
        s = np.concatenate([_NONE, *(h[n - 2][1 : len(h[n - 1]) + 1] if n > 1 else z for h, z in zip(streams, none, strict=True))])
        u, first, times = np.unique(g, return_index=True, return_counts=True)
        parts.append(pd.DataFrame({"n": n, "gram": u.view(np.int64), "context": c[first].view(np.int64), "suffix": s[first].view(np.int64), "times": times}))
    return pd.concat(parts, ignore_index=True)


def fit(rows: pd.DataFrame) -> Language:
    """Interpolated Kneser-Ney from the counts of one language, one discount an order: the top order counts times, lower ones left extensions."""
    orders = []
    extended: np.ndarray | None = None
    for n in range(ORDER, 0, -1):
        own = rows[rows["n"] == n]
        u, c, s = (own[k].to_numpy(dtype=np.int64).view(np.uint64) for k in ("gram", "context", "suffix"))
        count = own["times"].to_numpy(dtype=np.float64)
        order = np.argsort(u)
        u, c, s, count = u[order], c[order], s[order], count[order]
        if extended is not None:  # continuation count: distinct n-grams one longer that end in this one
            su, sc = np.unique(extended, return_counts=True)
            where, hit = _found(su, u)
            count = np.where(hit, sc[where] if len(sc) else 1, 1).astype(np.float64)
        extended = s
        if len(u) > MAX_GRAMS:
            keep = np.sort(np.lexsort((u, -count))[:MAX_GRAMS])
            u, c, s, count = u[keep], c[keep], s[keep], count[keep]
        orders.append((u, count, c, s))
    orders.reverse()
    size = len(orders[0][0])
    grams, logs, contexts, weights = [], [], [], []
    floor, below_grams, below = 0.0, _NONE, np.zeros(0)
    for n, (u, count, c, s) in enumerate(orders, 1):
        ones, twos = (count == 1).sum(), (count == 2).sum()
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        cu, back = np.unique(c, return_inverse=True)
        held = np.bincount(back, weights=count, minlength=len(cu))
        mass = d * np.bincount(back, minlength=len(cu)) / np.maximum(held, 1)
        uniform = 1.0 / (size + 1.0)
        if n == 1:
            lower = np.full(len(u), uniform)
            floor = float(np.log2((mass[0] if len(mass) else 1.0) * uniform))
        else:
            where, hit = _found(below_grams, s)
            lower = np.where(hit, below[where] if len(below) else uniform, uniform)
        p = np.maximum(count - d, 0) / np.maximum(held[back], 1) + mass[back] * lower
        below_grams, below = u, p
        grams.append(u)
        logs.append(np.log2(np.maximum(p, 1e-30)).astype(np.float32))
        if n > 1:
            contexts.append(cu)
            weights.append(np.log2(np.maximum(mass, 1e-30)).astype(np.float32))
    return Language(grams, logs, contexts, weights, floor)


def _stored(language: Language) -> bytes:
    out = io.BytesIO()
    np.savez(out, np.array([language.floor]), *language.grams, *language.logs, *language.contexts, *language.weights)
    return out.getvalue()


def _restored(raw: bytes) -> Language:
    with np.load(io.BytesIO(raw)) as f:
        x = [f[f"arr_{i}"] for i in range(4 * ORDER - 1)]
    return Language(x[1 : ORDER + 1], x[ORDER + 1 : 2 * ORDER + 1], x[2 * ORDER + 1 : 3 * ORDER], x[3 * ORDER :], float(x[0][0]))


def sampled(docs: DataFrame, label: str = "lang") -> DataFrame:
    """text, lang and fits: of each language the first distinct texts in hash order; the first of them calibrate.

    Hashes are uniform, so a range of them holds about twice the texts that are wanted; that
    range is sized by the count of distinct texts, whatever number of rows each has.
    """
    n = DOCS_A_LANG + CALIBRATION_DOCS
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col(label).cast("string").alias("lang"))
    rows = rows.where("text is not null and lang is not null").withColumn("h", F.xxhash64("text"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("texts"))
    top = F.lit(-(2.0**63)) + F.lit(2.0**64) * F.least(F.lit(1.0), F.lit(2.0 * n) / F.col("texts"))
    near = rows.join(F.broadcast(counts), "lang").where(F.col("h").cast("double") <= top).groupBy("lang", "h").agg(F.first("text").alias("text"))
    ranked = near.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).withColumn("found", F.count("*").over(Window.partitionBy("lang")))
    ranked = ranked.withColumn("held", F.when(F.col("found") > 1, F.greatest(F.lit(1), F.least(F.lit(CALIBRATION_DOCS), F.expr("found div 3")))).otherwise(0))
    return ranked.where(F.col("place") <= F.col("held") + DOCS_A_LANG).select("text", "lang", (F.col("place") > F.col("held")).alias("fits"))


def learn(docs: DataFrame, label: str = "lang") -> Model:
    """Fit and calibrate on rows of docs with text and label."""
    sample = staged(sampled(docs, label), "langid-sample")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lang, own in f.groupby("lang"):
                yield counted(own["text"].tolist()).assign(lang=lang)[["lang", "n", "gram", "context", "suffix", "times"]]

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(rows["lang"].iloc[0], _stored(fit(rows)))], columns=["lang", "model"])

    grams = sample.where("fits").select("lang", "text").mapInPandas(count, "lang string, n int, gram long, context long, suffix long, times long")
    summed = grams.groupBy("lang", "n", "gram").agg(F.first("context").alias("context"), F.first("suffix").alias("suffix"), F.sum("times").alias("times"))
    made = staged(summed.groupBy("lang").applyInPandas(fitted, "lang string, model binary"), "langid-models")
    got = {r.lang: _restored(bytes(r.model)) for r in made.toLocalIterator()}
    model = Model(sorted(got), [got[lang] for lang in sorted(got)])
    if got:
        row = F.struct("lang", F.length("text").alias("chars")).alias("row")
        held = _scored(sample.where("not fits"), model, row).where("lang_pred <> 'und'")
        over = F.max(F.col("bits") - F.lit(REJECT_MARGIN) * F.sqrt(F.lit(float(REJECT_CHARS)) / F.greatest("row.chars", F.lit(1))))
        limits = {r.lang: r.limit for r in held.groupBy("row.lang").agg(over.alias("limit")).collect()}
        model.limits = np.array([limits.get(lang, np.inf) for lang in model.langs])
    return model


OUTPUT = "lang_pred string, score double, bits double, rejected boolean"


def _scored(docs: DataFrame, model: Model, row) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the sum of the models: bounded by the fitting sample

    def predicted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for t in texts:
            rows = [x for lo in range(0, len(t), 256) for x in model.predict(t.iloc[lo : lo + 256].tolist())]
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "bits", "rejected"])

    @F.pandas_udf(OUTPUT)
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from released(predicted(texts))

    got = docs.select(row, scored(F.col("text").cast("string")).alias("got"))
    return got.select("row", "got.*")


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs as one struct ``row`` with lang_pred, score (the winner's share, 0 to 1), bits a character and rejected."""
    return _scored(docs, model, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
