"""Personal data: fixed patterns, and further spans by weak supervision.

Base spans (e-mail, IP, card, phone) come from four patterns and always stay. Candidates for
further spans are tokens with digits and runs of capitalised words that touch no base span.
Regex, gazetteer and context labelers answer yes, no or nothing on each candidate. Counts of
answers over the whole corpus go through expectation-maximisation (Dawid-Skene, for each kind of
candidate: per labeler and class a distribution over its three answers, silence being one, under
the condition that no labeler is worse than chance), whose posteriors are the soft labels of
a logistic span classifier over shape and context features. What reaches the driver is one count
per distinct (answers, features) pattern: all features are buckets, so their number is bounded
whatever the corpus.

A null text counts as empty and has no spans. Texts of any length are read whole. Repeated rows
get equal results. Spans that start together are listed in the order of KINDS. An empty table
teaches a model without patterns and gives an empty result. Other columns travel in ``row``
whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "number", "name")
KINDS = (*BASE, *ADDED)
KIND_CODES = {"secret": "s", "number": "d", "name": "n"}
_RANK = {k: i for i, k in enumerate(KINDS)}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# the look-behind only spares restarts inside a run of digits, which fail as its start did
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ outwards: a run before it is read once."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > last and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            out.append((lo, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind."""
    found = [(a, b, "email") for a, b in emails(text)]
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((*m.span(), "ip"))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                d = _NOT_DIGIT.sub("", m[0])
                if 14 <= len(d) <= 19 and luhn(d):
                    found.append((*m.span(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    found.append((*m.span(), "phone"))
    found.sort(key=lambda s: (s[0], _RANK[s[2]]))
    return found


# ---- candidates, labelers and features -------------------------------------------------

GIVEN = frozenset(
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah "
    "Charles Karen Daniel Nancy Matthew Lisa Anthony Betty Mark Sandra Paul Ashley Steven Emily Andrew Donna Joshua Michelle Peter Anna "
    "Hans Karl Heinz Jürgen Ursula Monika Petra Sabine Pierre Jean Marie Claire Luc Sophie Camille Juan José María Carmen Carlos Ana Luis "
    "Pedro Pablo Miguel Javier Laura Elena Lucía".split()
)
#: Words that stand capitalised in titles and legal lines of any kind.
NOT_NAMES = frozenset(
    "The And All Any For From With This That These Those You Your Our Not Are Was Has Have Will May Shall Rights Reserved License Licensed Licence Public General Private Commons Copyright "
    "Version Terms Conditions Policy Privacy Service Services Company Limited Software Source Open Free Foundation University Institute Street Road City State United North South East West New "
    "Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December".split()
)
CUES = re.compile(
    r"(?:token|secret|password|passwd|api|key|tel|phone|fax|mobile|call|ssn|passport|account|iban|card|contact|name|mr|mrs|ms|dr|dear|signed|born|mail|id)\W{0,6}$",
    re.IGNORECASE,
)
DULL = re.compile(r"(?:version|page|chapter|figure|section|table|volume|no|cc|by|by-nc|by-sa|step|item)\W{0,3}$", re.IGNORECASE)
_CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+(?: [A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+)+")
_TOKEN_END = re.compile(r"[\s,;\"'<>|()\[\]{}]")
_SECRET = re.compile(r"(?:[0-9a-fA-F]{20,}|(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9+/_-]{20,}={0,2})$")
_NUMBERED = re.compile(r"(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}|(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}|[0-9]{9,19}|[0-9]{3}[-.][0-9]{3}[-.][0-9]{4})$")
_DULL_NUMBER = re.compile(r"[0-9]{1,5}(?:[.,:/-][0-9]{1,4}){0,2}[.%]?$")
_NO_CARD = re.compile(r"[0-9]{14,19}$")  # were it a card by its checksum, it would be a base span
_EDGES = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "+/=_-")
REACH = 40
TRUST = 0.1  # of all candidates, as answers that a labeler is taken to have given rightly before any is counted


def candidates(text: str, taken: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of tokens with digits and capitalised runs that touch none of the taken spans."""
    spans = sorted((a, b) for a, b, _ in taken)
    k, done = 0, 0
    for m in _DIGITS.finditer(text):
        if m.start() < done:
            continue
        lo, hi = m.span()
        while lo > done and not _TOKEN_END.match(text[lo - 1]):
            lo -= 1
        e = _TOKEN_END.search(text, hi)
        hi = e.start() if e else len(text)
        done = hi
        while lo < hi and text[lo] in _EDGES:
            lo += 1
        while hi > lo and text[hi - 1] in _EDGES:
            hi -= 1
        while k < len(spans) and spans[k][1] <= lo:
            k += 1
        if lo < hi and not (k < len(spans) and spans[k][0] < hi):
            yield lo, hi, "secret" if re.search("[A-Za-z]", text[lo:hi]) else "number"
    k = 0
    for m in _CAPITALS.finditer(text):
        while k < len(spans) and spans[k][1] <= m.start():
            k += 1
        if not (k < len(spans) and spans[k][0] < m.end()):
            yield m.start(), m.end(), "name"


def votes(text: str, lo: int, hi: int, kind: str) -> str:
    """One answer per labeler: + yes, - no, 0 none."""
    s, before = text[lo:hi], text[max(0, lo - REACH) : lo]
    words = s.split(" ") if kind == "name" else []
    rx_secret = "+" if kind == "secret" and _SECRET.match(s) else "-" if len(s) < 6 else "0"
    rx_number = "0" if kind == "name" else "-" if _NO_CARD.match(s) else "+" if _NUMBERED.match(s) else "-" if _DULL_NUMBER.match(s) else "0"
    gazetteer = "0" if kind != "name" else "+" if words[0] in GIVEN or words[-2] in GIVEN else "-" if NOT_NAMES.intersection(words) else "0"
    context = "+" if CUES.search(before) else "-" if DULL.search(before) else "0"
    assigned = "+" if re.search(r"[=:] ?[\"']?$", before) else "0"
    shape = "-" if kind == "name" and (not before or before.rstrip(" ")[-1:] in ".!?\n") else "+" if kind == "secret" and len(s) >= 16 else "0"
    return rx_secret + rx_number + gazetteer + context + assigned + shape


def features(text: str, lo: int, hi: int, kind: str) -> str:
    """Bucketed shape and context, one character each: kind, length, digit share, upper share, neighbours, cue."""
    s, before = text[lo:hi], text[max(0, lo - REACH) : lo]
    n = len(s)
    digits, upper = sum(c.isdigit() for c in s), sum(c.isupper() for c in s)
    side = lambda c: "_" if not c else "q" if c in "\"'" else "p" if not c.isalnum() and not c.isspace() else "s"
    cue = "c" if CUES.search(before) else "d" if DULL.search(before) else "n"
    given = "g" if kind == "name" and GIVEN.intersection(s.split(" ")) else "n"
    return f"{KIND_CODES[kind]}{min(6, n.bit_length())}{min(4, 4 * digits // n)}{min(4, 4 * upper // n)}{side(text[lo - 1 : lo])}{side(text[hi : hi + 1])}{cue}{given}"


def patterns(docs: DataFrame) -> Counter[tuple[str, str]]:
    """How often each (votes, features) pattern stands in all texts."""

    @F.pandas_udf("map<string,long>")
    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            out = []
            for text in t:
                c: Counter[str] = Counter()
                if text:
                    for lo, hi, kind in candidates(text, base_spans(text)):
                        c[f"{votes(text, lo, hi, kind)} {features(text, lo, hi, kind)}"] += 1
                out.append(dict(c))
            yield pd.Series(out)

    rows = docs.select(F.explode(counted(F.col("text").cast("string"))).alias("pattern", "n"))
    got = rows.groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    return Counter({tuple(r.pattern.split(" ")): r.n for r in got})


def reliabilities(counts: Counter[str], rounds: int = 100) -> tuple[float, np.ndarray, dict[str, float]]:
    """EM over patterns of answers: the prior of yes, [labeler, class, answer] probabilities, each pattern's posterior.

    It starts from the share of yes among the answers given. All three answers count, silence
    as well; TRUST is the weight of a prior that yes is said of spans and no of others.
    """
    keys = sorted(counts)
    if not keys:
        return 0.5, np.zeros((0, 2, 3)), {}
    w = np.array([counts[k] for k in keys], dtype=float)
    a = np.array([["-0+".index(c) for c in k] for k in keys])
    yes, no = (a == 2).sum(axis=1), (a == 0).sum(axis=1)
    p = (yes + 0.25) / (yes + no + 1.0)
    lab = np.arange(a.shape[1])
    for _ in range(rounds):
        prior = float(np.clip((w * p).sum() / w.sum(), 0.01, 0.99))
        theta = np.ones((a.shape[1], 2, 3))
        theta[:, 0, 0] += TRUST * w.sum() * (1 - prior)
        theta[:, 1, 2] += TRUST * w.sum() * prior
        for c, q in enumerate((1 - p, p)):
            for v in range(3):
                theta[:, c, v] += ((w * q)[:, None] * (a == v)).sum(axis=0)
        theta /= theta.sum(axis=2, keepdims=True)
        # no labeler is worse than chance: a yes never speaks against a span, a no or silence never for one
        ratio = np.log(theta[:, 1]) - np.log(theta[:, 0])
        ratio = np.concatenate([np.minimum(ratio[:, :2], 0), np.maximum(ratio[:, 2:], 0)], axis=1)
        odds = math.log(prior / (1 - prior)) + ratio[lab, a].sum(axis=1)
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        done = np.abs(new - p).max() < 1e-6
        p = new
        if done:
            break
    return prior, theta, dict(zip(keys, p.tolist(), strict=True))


def _onehot(f: str) -> list[str]:
    return [f"{i}{c}" for i, c in enumerate(f)] + [f"{f[0]}{i}{c}" for i, c in enumerate(f) if i]


class SpanModel:
    """Logistic regression over bucket features; decides on a candidate by its feature pattern alone."""

    def __init__(self, counts: Counter[tuple[str, str]]):
        by_kind: dict[str, Counter[str]] = {}
        for (v, f), n in counts.items():
            by_kind.setdefault(f[0], Counter())[v] += n
        self.labelers = {kind: reliabilities(own) for kind, own in by_kind.items()}
        names = sorted({x for _, f in counts for x in _onehot(f)})
        self.index = {x: i for i, x in enumerate(names)}
        keys = sorted(counts)
        x = np.zeros((len(keys), len(names) + 1))
        for r, (_, f) in enumerate(keys):
            x[r, [self.index[z] for z in _onehot(f)]] = 1
            x[r, -1] = 1
        y = np.array([self.labelers[f[0]][2][v] for v, f in keys])
        w = np.array([counts[k] for k in keys], dtype=float)
        self.w = self._newton(x, y, w) if keys else np.zeros(1)

    @staticmethod
    def _newton(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        beta, ridge = np.zeros(x.shape[1]), 1.0
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            g = x.T @ (w * (p - y)) + ridge * beta
            h = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
            step = np.linalg.solve(h, g)
            beta -= np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-8:
                break
        return beta

    def probability(self, f: str) -> float:
        z = self.w[-1] + sum(self.w[self.index[x]] for x in _onehot(f) if x in self.index)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def learn(docs: DataFrame) -> SpanModel:
    return SpanModel(patterns(docs))


def all_spans(text: str, model: SpanModel, memo: dict[str, bool]) -> tuple[list, list]:
    """Base spans, and base with added ones."""
    base = base_spans(text)
    more = list(base)
    for lo, hi, kind in candidates(text, base):
        f = features(text, lo, hi, kind)
        ok = memo.get(f)
        if ok is None:
            ok = memo[f] = model.probability(f) >= 0.5
        if ok:
            more.append((lo, hi, kind))
    more.sort(key=lambda s: (s[0], _RANK[s[2]]))
    return base, more


OUTPUT = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def detect(docs: DataFrame, model: SpanModel) -> DataFrame:
    """docs as one struct ``row`` with counts of base spans, their digest, and all spans as kind:start:end."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred weights

    @F.pandas_udf(OUTPUT)
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo: dict[str, bool] = {}
        for t in texts:
            out = []
            for text in t:
                base, more = all_spans(text or "", shared.value, memo)
                n = Counter(k for _, _, k in base)
                show = lambda s: ",".join(f"{k}:{a}:{b}" for a, b, k in s)
                out.append((*(n[k] for k in BASE), hashlib.sha256(show(base).encode()).hexdigest(), show(more)))
            yield pd.DataFrame(out, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, found(F.col("text").cast("string")).alias("got")).select("row", "got.*")


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Spans become <KIND>; of overlapping ones the first by start, and of those the longest, covers the rest."""
    out, at = [], 0
    for lo, hi, kind in sorted(spans, key=lambda s: (s[0], -s[1], _RANK[s[2]])):
        if lo < at:
            at = max(at, hi)
            continue
        out += [text[at:lo], f"<{kind.upper()}>"]
        at = hi
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, model: SpanModel) -> DataFrame:
    """docs with every span of its text replaced by its kind, and n_chars, where there is one, counted anew. Null stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo: dict[str, bool] = {}
        for t in texts:
            yield pd.Series([None if x is None else redact(x, all_spans(x, shared.value, memo)[1]) for x in t], dtype=object)

    out = docs.withColumn("text", clean(F.col("text").cast("string")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
