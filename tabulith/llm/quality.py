"""Quality by co-training: two classifiers that see different things teach one another.

The content view sees measures of the whole text (kinds of characters, words, repetition,
lines), the metadata view the source, the language and the length that the table states.
Both are logistic regressions. They start from labelled documents; in each round each view
labels the pool documents of which it is most sure, in the classes' proportion, and hands
them to the other view, so that neither is taught by itself. Labelled documents kept apart
calibrate both views (Platt), and their calibrated log odds are added, less the prior that
both hold.

The fit uses at most ROWS_A_CLASS labelled documents of each class and POOL unlabelled ones,
the first by a hash of doc_id: the documented bound of the sample. Of these, measures reach
the driver, never texts. Scoring reads all texts whole.

A null text is measured as an empty one. Null metadata is a value of its own. Of a repeated
document the row of the smallest hash is learned from, and repeated rows get equal scores. Without
labels of both classes every score is the class share (0.5 of empty tables). Equally sure documents
go by their order of hash. Texts of any length are measured whole. Other columns travel in ``row``
whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.llm.near_dup import _grouped, word_hashes

ROWS_A_CLASS = 4000
POOL = 20_000
ROUNDS = 5
SURE = 0.9
SHARE_A_ROUND = 0.1
CALIBRATION = 5  # one labelled document in so many
RIDGE = 1.0
SOURCES, LANGS, SIZES = 256, 32, 32

_KINDS = np.zeros(256, dtype=np.int64)
for _name, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r", "\n", ".,;:'\"-()", "!?", "*#$%&@^~", "|/\\_=+<>[]{}`"), start=1):
    _KINDS[[ord(c) for c in _chars]] = _name
KINDS = 10  # the first: bytes of characters beyond ASCII, and controls


def measures(texts: list[str | None]) -> np.ndarray:
    """[text, measure]: logs of sizes, shares of kinds of characters, distinct, most frequent and repeated words, lines."""
    return np.concatenate([_measured([t or "" for t in texts[lo:hi]]) for lo, hi in _grouped([t or "" for t in texts])]) if texts else np.zeros((0, KINDS + 9))


def _measured(texts: list[str]) -> np.ndarray:
    n = len(texts)
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(r) for r in raw])
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    owner = np.repeat(np.arange(n), sizes)
    kinds = np.bincount(owner * KINDS + _KINDS[data], minlength=n * KINDS).reshape(n, KINDS)
    words, counts = word_hashes(texts)
    of = np.repeat(np.arange(n), counts)
    key = np.sort(of.astype(np.uint64) << np.uint64(44) | words >> np.uint64(20))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    times = np.diff(first, append=len(key))
    distinct = np.bincount((key[first] >> np.uint64(44)).astype(np.int64), minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, (key[first] >> np.uint64(44)).astype(np.int64), times)
    same = np.flatnonzero((words[1:] == words[:-1]) & (of[1:] == of[:-1])) if len(words) else np.zeros(0, dtype=np.int64)
    again = np.bincount(of[same], minlength=n)
    some, total = np.maximum(counts, 1), np.maximum(sizes, 1)
    lines = kinds[:, 5] + 1
    more = [np.log1p(sizes), np.log1p(counts), distinct / some, most / some, again / some, np.log(total / some), np.log(total / lines), kinds[:, 6] / some, (sizes == 0).astype(float)]
    return np.concatenate([kinds / total[:, None], np.stack(more, axis=1)], axis=1)


def metadata(source: str | None, lang: str | None, n_chars: int | None) -> tuple[int, int, int]:
    """The three places of a document in the metadata view."""
    place = lambda x, n: n - 1 if x is None else zlib.crc32(x.encode("utf-8", "surrogatepass")) % (n - 1)
    size = SIZES - 1 if n_chars is None else min(SIZES - 2, max(0, int(n_chars)).bit_length())
    return place(source, SOURCES), SOURCES + place(lang, LANGS), SOURCES + LANGS + size


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights and, last, the intercept, by Newton's method with a ridge on the weights."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-7:
            break
    return w


def _odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: list[np.ndarray]  # of the content and the metadata view
    scales: list[tuple[float, float]]  # Platt's slope and intercept of each
    prior: float  # log odds
    taught: list[int]  # pseudo-labels that each view was given

    def views(self, x: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated log odds of both views."""
        one = _odds((x - self.mean) / self.spread, self.weights[0])
        w = self.weights[1]
        two = w[places].sum(axis=1) + w[-1]
        return tuple(np.clip(a * z + b, -20, 20) for z, (a, b) in zip((one, two), self.scales, strict=True))

    def scores(self, x: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        one, two = self.views(x, places)
        share = lambda z: 1 / (1 + np.exp(-z))
        return share(one + two - self.prior), share(one), share(two)


def _onehot(places: np.ndarray) -> np.ndarray:
    out = np.zeros((len(places), SOURCES + LANGS + SIZES))
    out[np.arange(len(places))[:, None], places] = 1
    return out


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope, never negative, and intercept that turn a view's odds into the calibration rows' odds."""
    w = logistic(z[:, None], y, 0.1)
    if w[0] <= 0:
        p = np.clip(y.mean(), 0.01, 0.99)
        return 0.0, float(np.log(p / (1 - p)))
    return float(w[0]), float(w[1])


def fit(x: np.ndarray, places: np.ndarray, y: np.ndarray, pool_x: np.ndarray, pool_places: np.ndarray) -> Model:
    """x, places and y of labelled documents; measures and places of the pool."""
    width = SOURCES + LANGS + SIZES
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        prior = float(np.log(p / (1 - p)))
        d = x.shape[1]
        return Model(np.zeros(d), np.ones(d), [np.zeros(d + 1), np.zeros(width + 1)], [(0.0, prior)] * 2, prior, [0, 0])
    kept = np.arange(len(y)) % CALIBRATION == CALIBRATION - 1
    if len(np.unique(y[kept])) < 2 or len(np.unique(y[~kept])) < 2:  # too few to keep some apart
        kept = np.ones(len(y), dtype=bool)
    base = ~kept if not kept.all() else kept
    mean, spread = x[base].mean(axis=0), np.maximum(x[base].std(axis=0), 1e-3)
    sees = [(x - mean) / spread, _onehot(places)]
    pool = [(pool_x - mean) / spread, _onehot(pool_places)]
    given_x = [[v[base]] for v in sees]
    given_y = [[y[base].astype(float)] for _ in sees]
    free = [np.ones(len(pool_x), dtype=bool) for _ in sees]  # pool documents that a view hasn't been given yet
    share = float(y[base].mean())
    taught = [0, 0]
    weights = [logistic(sees[k][base], y[base].astype(float)) for k in (0, 1)]
    for _ in range(ROUNDS if len(pool_x) else 0):
        sure = [1 / (1 + np.exp(-np.clip(_odds(pool[k], weights[k]), -30, 30))) for k in (0, 1)]
        moved = 0
        for teacher in (0, 1):
            pupil = 1 - teacher
            p = sure[teacher]
            quota = max(1, int(SHARE_A_ROUND * len(p)))
            for label, part, q in ((1.0, share, p), (0.0, 1 - share, 1 - p)):
                able = np.flatnonzero(free[pupil] & (q >= SURE))
                best = able[np.argsort(-q[able], kind="stable")][: max(1, int(quota * part))]
                if len(best):
                    given_x[pupil].append(pool[pupil][best])
                    given_y[pupil].append(np.full(len(best), label))
                    free[pupil][best] = False
                    taught[pupil] += len(best)
                    moved += len(best)
        if not moved:
            break
        weights = [logistic(np.concatenate(given_x[k]), np.concatenate(given_y[k])) for k in (0, 1)]
    scales = [platt(_odds(sees[k][kept], weights[k]), y[kept].astype(float)) for k in (0, 1)]
    p = float(np.clip(y.mean(), 0.01, 0.99))
    return Model(mean, spread, weights, scales, float(np.log(p / (1 - p))), taught)


_SEEN = "measures array<double>, places array<int>"


def _seen(texts: pd.Series, source: pd.Series, lang: pd.Series, n_chars: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    places = [metadata(s, g, None if pd.isna(c) else c) for s, g, c in zip(source, lang, n_chars, strict=True)]
    return measures(texts.tolist()), np.array(places, dtype=np.int64).reshape(len(places), 3)


def _inputs() -> list:
    return [F.col(c).cast(t) for c, t in (("text", "string"), ("source", "string"), ("lang", "string"), ("n_chars", "long"))]


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """From docs (doc_id, text, source, lang, n_chars) and labels (doc_id, label); of repeated labels the highest counts."""

    @F.pandas_udf(_SEEN)
    def seen(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in parts:
            x, places = _seen(*columns)
            yield pd.DataFrame({"measures": list(x), "places": list(places)})

    one = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    order = F.xxhash64("doc_id")
    picked = [one.where(F.col("y") == c).orderBy(order, "doc_id").limit(ROWS_A_CLASS) for c in (0, 1)]
    picked = F.broadcast(picked[0].union(picked[1]))  # 2 * ROWS_A_CLASS rows at most
    rows = docs.select("doc_id", *[c.alias(n) for c, n in zip(_inputs(), ("text", "source", "lang", "n_chars"), strict=True)])
    measured = lambda df, *more: df.select("doc_id", seen(*_inputs()).alias("seen"), *more)
    # of repeated documents the one of the smallest hash, so that each label brings one row
    every = F.struct("text", "source", "lang", "n_chars")
    known = rows.join(picked, "doc_id").groupBy("doc_id", "y").agg(F.min_by(every, F.xxhash64("text", "source", "lang", "n_chars")).alias("of"))
    ours = measured(known.select("doc_id", "y", "of.*"), "y")
    # hashes are uniform, so a part of their range holds about twice the pool; the limit cuts it to the first by hash,
    # and what is sorted are measures, not texts
    width = 1 << 64
    top = -(1 << 63) + min(width - 1, int(width * min(1.0, 2.0 * POOL / max(1, docs.count()))))
    near = measured(rows.where(order <= F.lit(top)).join(picked.select("doc_id"), "doc_id", "left_anti"), F.xxhash64("text").alias("text_hash"))
    chosen = near.orderBy(order, "text_hash").limit(POOL).select("doc_id", "seen", F.lit(None).cast("int").alias("y"))
    got = ours.unionByName(chosen).collect()
    got.sort(key=lambda r: (r.doc_id is None, r.doc_id or 0, r.y is None, r.y or 0, r.seen.measures))
    arrays = lambda some: (np.array([r.seen.measures for r in some]).reshape(len(some), KINDS + 9), np.array([r.seen.places for r in some], dtype=np.int64).reshape(len(some), 3))
    known = sorted((r for r in got if r.y is not None), key=lambda r: zlib.crc32(str(r.doc_id).encode()))
    return fit(*arrays(known), np.array([r.y for r in known]), *arrays([r for r in got if r.y is None]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs as one struct ``row`` with score (both views), content, metadata and predicted (1: good)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred weights

    @F.pandas_udf("score double, content double, metadata double")
    def scored(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in parts:
            yield pd.DataFrame(dict(zip(("score", "content", "metadata"), shared.value.scores(*_seen(*columns)), strict=True)))

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    got = docs.select(row, scored(*_inputs()).alias("got"))
    return got.select("row", "got.*", (F.col("got.score") >= 0.5).cast("int").alias("predicted"))
