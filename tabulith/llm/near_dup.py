"""Near duplicates by ProbMinHash, banding and exact verification.

A text is the sequence of its words (runs of anything but ASCII white space, lower case); its
elements are shingles of five words, weighted by 1 + ln(times) so that repeated passages count
more, but not in proportion. A shorter text is one shingle.

1. Each element's points arrive as a Poisson process of the rate of its weight, seeded by the
   element alone; each point falls on one of M registers, which keeps its first arrival's
   element. Two texts agree in a register with the probability Jaccard of their weighted sets
   (the plain Jaccard where weights are equal). Arrivals beyond a time at which all registers
   are filled can't matter, so generation stops there (early termination).
2. Texts with equal word sequences are one node, so large groups of copies vanish here.
3. Registers form BANDS bands of ROWS; nodes that share a band are candidates. A text with
   repeated elements is banded by registers of unit weights too, in the same buckets, so that
   candidates are found by the measure that links are verified by, whatever is repeated. In each
   bucket all are compared with its hub, the member with most neighbours.
4. Candidates are verified by the exact Jaccard of their shingle sets, 0.8 or more; links form
   components.
5. A bucket is torn if a member's component is not its hub's. Members of torn buckets are joined
   exactly, by prefixes: all elements stand in one order, rare ones first; two sets of n and o
   elements whose first common element is at places p and q share at most min(n - p, o - q), so
   similar sets meet in an element that comes early in both. Only pairs of different components
   are formed, and each has a member outside its hub's component, so a linked crowd, however
   large, is never paired with itself, and neither are texts that differ from each other in
   elements of their own. The order comes from a table of counts of bounded size (MAX_CELLS);
   elements that share a cell make more work, never another result.

Shingle sets are computed only for one row of each text in some shared bucket: a bitmap of
bounded size (MAX_BITS) tells which rows to skip; a false hit costs work, never a result.

Result: one row per document with class_id, the smallest doc_id of its component. A null text
is a class of its own, as is any text that nothing resembles; texts without words are copies
of one another. Null ids sort last. Repeated rows fall into one class. Texts of any length count
whole. An empty table gives an empty result. Other columns of docs are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.llm.common import released, staged

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 28, 5
M = BANDS * ROWS
SLACK = 4.0
BATCH_BYTES = 1 << 20
MAX_BITS = 1 << 28
MAX_CELLS = 1 << 22
_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    with np.errstate(over="ignore"):
        x = x + _U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _powers(n: int, base: int) -> np.ndarray:
    """base ** 0, 1, .. mod 2 ** 64, by doubling."""
    out = np.ones(1, dtype=np.uint64)
    step = base
    with np.errstate(over="ignore"):
        while len(out) < n:
            out = np.concatenate([out, out * _U(step)])
            step = step * step & 0xFFFFFFFFFFFFFFFF
    return out[:n]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts in order, and how many words each text has."""
    raw = [t.lower().encode("utf-8", "surrogatepass") + b" " for t in texts]
    data = np.frombuffer(b" " + b"".join(raw), dtype=np.uint8)
    space = _SPACE[data]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    sizes = ends - starts
    at = np.flatnonzero(~space)
    first = np.cumsum(sizes) - sizes
    within = np.arange(len(at)) - np.repeat(first, sizes)
    power = _powers(int(sizes.max()), 0x9E3779B97F4A7C15 | 1)
    with np.errstate(over="ignore"):
        value = mixed(data[at].astype(np.uint64) + _U(1)) * power[within]
        words = mixed(np.add.reduceat(value, first) + sizes.astype(np.uint64))
    borders = np.cumsum([len(r) for r in raw]) + 1
    counts = np.diff(np.searchsorted(starts, borders), prepend=0)
    return words, counts


def shingles(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of every shingle; a text of fewer than WORDS words, but some, has one."""
    owner = np.repeat(np.arange(len(counts)), counts)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(words))  # words from here to the text's end
    with np.errstate(over="ignore"):
        full = np.flatnonzero(left >= WORDS)
        h = np.zeros(len(full), dtype=np.uint64)
        for k in range(WORDS):
            h = (h ^ words[full + k]) * _U(0xD6E8FEB86659FD93)
            h ^= h >> _U(32)
        short = np.flatnonzero((counts > 0) & (counts < WORDS))
        lone = []
        begin = np.cumsum(counts) - counts
        for i in short.tolist():
            x = _U(counts[i])
            for w in words[begin[i] : begin[i] + counts[i]]:
                x = (x ^ w) * _U(0xD6E8FEB86659FD93)
                x ^= x >> _U(32)
            lone.append(x)
    return np.concatenate([owner[full], short]), np.concatenate([h, np.array(lone, dtype=np.uint64)])


def weighted(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements of each text: owner, element (44 bits of the hash) and weight, by owner and element."""
    key = np.sort(owner.astype(np.uint64) << _U(44) | h >> _U(20))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    weight = np.diff(first, append=len(key))
    key = key[first]
    return (key >> _U(44)).astype(np.int64), key & _U((1 << 44) - 1), 1 + np.log(weight)


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, m: int = M) -> np.ndarray:
    """ProbMinHash: [text, register] elements of the first arrivals; rows of texts without elements are 0."""
    out = np.zeros((texts, m), dtype=np.uint64)
    total = np.bincount(owner, weights=weight, minlength=texts)
    todo = total > 0
    slack = SLACK
    while todo.any():
        stop = np.where(todo, m * (math.log(m) + slack) / np.maximum(total, 1e-9), 0.0)
        first = np.full(texts * m, np.inf)
        points = []
        live = np.flatnonzero(todo[owner])
        own, e, w = owner[live], element[live], weight[live]
        state, t = mixed(e), np.zeros(len(live))
        while len(own):
            state = mixed(state)
            t = t - np.log(((state >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / w
            keep = t < stop[own]
            own, e, w, state, t = own[keep], e[keep], w[keep], state[keep], t[keep]
            register = (mixed(state ^ _U(0x5851F42D4C957F2D)) >> _U(32)) * _U(m) >> _U(32)
            place = own * m + register.astype(np.int64)
            np.minimum.at(first, place, t)
            points.append((place, t, e))
        for place, t, e in points:
            won = first[place] == t
            out.reshape(-1)[place[won]] = e[won]
        todo &= np.isinf(first.reshape(texts, m)).any(axis=1)  # some register is empty: later arrivals matter
        slack *= 2
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    h = np.zeros((len(sig), BANDS), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            h = (h ^ mixed(sig[:, r::ROWS][:, :BANDS])) * _U(0xD6E8FEB86659FD93)
            h ^= h >> _U(29)
    return h


def band_hashes(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int) -> list[list[int | None]]:
    """Of each text the hashes of its bands by unit weights, and, where elements repeat, those by its own weights that differ."""
    plain = bands(signatures(owner, element, np.ones(len(weight)), texts)).view(np.int64)
    out = plain.tolist()
    again = np.unique(owner[weight > 1])
    if len(again):
        own = np.isin(owner, again)
        more = bands(signatures(np.searchsorted(again, owner[own]), element[own], weight[own], len(again))).view(np.int64)
        for i, w, p in zip(again.tolist(), more.tolist(), plain[again].tolist(), strict=True):
            out[i] += [x if x != y else None for x, y in zip(w, p, strict=True)]
    return out


def _grouped(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about BATCH_BYTES characters."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BATCH_BYTES:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _keys(words: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """128 bits of each word sequence."""
    ends = np.cumsum(counts)
    within = np.arange(len(words)) - np.repeat(ends - counts, counts)
    out = []
    with np.errstate(over="ignore"):
        for base in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB):
            value = mixed(words ^ _U(base)) * _powers(int(counts.max(initial=0)) + 1, base | 1)[within]
            sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(value, dtype=np.uint64)])
            out.append(mixed(sums[ends] - sums[ends - counts] + counts.astype(np.uint64)))
    return [row.tobytes() for row in np.stack(out, axis=1)]


def _signed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column(2).to_pylist()]
        keys: list[bytes] = []
        listed: list = []
        sizes: list[int] = []
        for lo, hi in _grouped(texts):
            words, counts = word_hashes(texts[lo:hi])
            keys += _keys(words, counts)
            owner, element, weight = weighted(*shingles(words, counts))
            sizes += np.bincount(owner, minlength=hi - lo).tolist()
            got = band_hashes(owner, element, weight, hi - lo)
            listed += [b if n else None for b, n in zip(got, counts.tolist(), strict=True)]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(listed, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "key", "n", "bands"])


def _set_rows(bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) % _U(8 * len(bits))
            hit = np.flatnonzero(bits[(h >> _U(3)).astype(np.int64)] >> (h & _U(7)).astype(np.uint8) & 1)
            texts = [t or "" for t in batch.column(1).take(pa.array(hit)).to_pylist()]
            for lo, hi in _grouped(texts):
                words, counts = word_hashes(texts[lo:hi])
                owner, element, _ = weighted(*shingles(words, counts))
                sets = [e.tobytes() for e in np.split(element, np.searchsorted(owner, np.arange(1, hi - lo)))]
                yield pa.record_batch([pa.array(_keys(words, counts), pa.binary()), pa.array(sets, pa.binary())], names=["key", "elements"])

    return run


def _sets(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(e, dtype=np.uint64) for e in batch.column("elements").to_pylist()]


def _cells(element: np.ndarray, cells: int) -> np.ndarray:
    return (mixed(element) & _U(cells - 1)).astype(np.int64)


def _cell_rows(cells: int):
    """How many sets of a batch have an element in each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, n = np.unique(_cells(np.concatenate([np.zeros(0, dtype=np.uint64), *_sets(batch)]), cells), return_counts=True)
            yield pa.record_batch([pa.array(cell), pa.array(n)], names=["cell", "n"])

    return run


def _prefix_rows(levels: np.ndarray):
    """The elements by which a set can meet a similar one, with their places in the common order; those that no other set has are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, place, found = [], [], []
            for i, e in enumerate(_sets(batch)):
                level = levels[_cells(e, len(levels))]
                first = np.lexsort((e, level))[: int((1 - THRESHOLD) * len(e) + 1e-6) + 1]
                at = np.flatnonzero(level[first])
                row.append(np.full(len(at), i))
                place.append(at)
                found.append(e[first[at]])
            if row:
                rows = np.concatenate(row)
                n = np.array([len(e) // 8 for e in batch.column("elements").to_pylist()])
                kept = batch.select(["key", "label", "apart"]).take(pa.array(rows))
                yield pa.record_batch([*kept.columns, pa.array(n[rows]), pa.array(np.concatenate(place)), pa.array(np.concatenate(found).view(np.int64))], names=["key", "label", "apart", "n", "place", "element"])

    return run


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        one, two = (batch.column(i).to_pylist() for i in (2, 3))
        sets = [(np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)) for a, b in zip(one, two, strict=True)]
        common = [len(np.intersect1d(a, b, assume_unique=True)) for a, b in sets]
        linked = [c > 0 and c >= THRESHOLD * (len(a) + len(b) - c) - 1e-9 for c, (a, b) in zip(common, sets, strict=True)]
        yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that are similar enough."""
    one = sets.select(F.col("key").alias("a"), F.col("elements").alias("ea"))
    two = sets.select(F.col("key").alias("b"), F.col("elements").alias("eb"))
    rows = pairs.join(one, "a").join(two, "b").select("a", "b", "ea", "eb")
    return staged(rows.mapInArrow(lambda batches: released(_common(batches)), "a binary, b binary"), "neardup-linked")


def joined(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets (key, label, apart, elements) of different labels, one at least apart, that may be similar: no similar pair is missing."""
    spark = sets.sparkSession
    size = sets.agg(F.sum(F.octet_length("elements"))).first()[0] or 0
    cells = min(MAX_CELLS, max(1 << 12, 1 << (size // 2).bit_length()))
    counts = sets.select("elements").mapInArrow(_cell_rows(cells), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    level = F.least(F.lit(255), F.floor(8 * F.log2("n"))).cast("short")
    found = counts.where("n > 1").select(F.col("cell").cast("int"), level.alias("level")).toArrow()
    levels = np.zeros(cells, dtype=np.uint8)
    levels[found.column("cell").to_numpy()] = found.column("level").to_numpy()
    shared = spark.sparkContext.broadcast(levels)  # MAX_CELLS bytes at most
    rows = sets.mapInArrow(lambda batches: _prefix_rows(shared.value)(batches), "key binary, label binary, apart boolean, n long, place long, element long")
    rows = staged(rows, "neardup-prefixes")
    one = rows.where("apart").select("element", F.col("key").alias("a"), F.col("label").alias("l"), "n", F.col("place").alias("p"))
    two = rows.select("element", F.col("key").alias("b"), F.col("label").alias("m"), "apart", F.col("n").alias("o"), F.col("place").alias("q"))
    able = f"l <> m and (not apart or a < b) and {1 + THRESHOLD} * least(n - p, o - q) >= {THRESHOLD} * (n + o) - 1e-6"
    return one.join(two, "element").where(able).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every linked node: the smallest key it can reach, by neighbours' labels and their labels' labels."""
    links = links.select("a", "b")
    edges = staged(links.union(links.select("b", "a")).distinct(), "neardup-edges")
    labels = staged(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "neardup-labels")
    while True:
        heard = edges.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        new = labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = new.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label"))
        step = staged(new, "neardup-labels")
        if not step.where("old <> label").limit(1).count():
            return step.select("node", "label")
        labels = step.select("node", "label")


def classes(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, text_hash (of the raw text), class_id, and keeper: this is the text to keep of the class."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    rows = staged(read.where("text is not null").mapInArrow(lambda batches: released(_signed_rows(batches)), f"doc_id {kind}, text_hash long, key binary, n long, bands array<long>"), "neardup-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    nodes = staged(rows.groupBy("key").agg(first.alias("first"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands")), "neardup-nodes")
    member = nodes.where("bands is not null").select("key", F.posexplode("bands").alias("at", "hash"))
    member = member.where("hash is not null").select("key", F.expr(f"at % {BANDS}").alias("band"), "hash")
    shared = member.groupBy("band", "hash").agg(F.count("*").alias("members")).where("members > 1")
    member = staged(member.join(shared, ["band", "hash"]), "neardup-members")
    degree = member.groupBy("key").agg(F.sum("members").alias("degree"))
    ranked = member.select("key", "band", "hash").join(degree, "key")
    hubs = ranked.groupBy("band", "hash").agg(F.max(F.struct("degree", "key")).alias("hub")).select("band", "hash", F.col("hub.key").alias("hub"))
    member = staged(member.select("key", "band", "hash").join(hubs, ["band", "hash"]).where("key <> hub"), "neardup-buckets")
    stars = staged(member.select(F.col("key").alias("a"), F.col("hub").alias("b")).distinct(), "neardup-stars")
    # shingle sets of texts in shared buckets, of one row each through a bitmap
    wanted = staged(stars.select(F.col("a").alias("key")).union(stars.select("b")).distinct(), "neardup-wanted")
    texts = wanted.join(nodes, "key").select(F.xxhash64("first.doc_id", "first.text_hash").alias("h"))
    size = min(MAX_BITS, max(1 << 15, 1 << (16 * max(1, texts.count()) - 1).bit_length()))
    place = F.expr(f"(h & {size - 1})")
    maps = texts.select(place.alias("p")).groupBy(F.expr("p div 32768").alias("part")).agg(F.bitmap_construct_agg(F.expr("p % 32768")).alias("bits")).collect()
    bits = np.zeros(size // 8, dtype=np.uint8)
    for r in maps:
        bits[r.part * 4096 : r.part * 4096 + 4096] = np.frombuffer(r.bits, dtype=np.uint8)
    found = read.where("text is not null").select(F.xxhash64("doc_id", "text_hash").alias("h"), "text").mapInArrow(lambda batches: released(_set_rows(bits)(batches)), "key binary, elements binary")
    sets = staged(found.groupBy("key").agg(F.first("elements").alias("elements")).join(wanted, "key", "left_semi"), "neardup-sets")
    # each text against all its hubs
    links = linked(stars, sets)
    labels = components(links)
    # members of buckets where some member's component is not the hub's
    named = lambda df, k: df.join(labels.select(F.col("node").alias(k), F.col("label").alias(f"{k}_label")), k, "left").withColumn(f"{k}_label", F.coalesce(f"{k}_label", k))
    told = named(named(member, "key"), "hub").select("band", "hash", "key", F.col("key_label").alias("label"), (F.col("key_label") != F.col("hub_label")).alias("apart"))
    told = staged(told, "neardup-told")
    torn = told.join(told.where("apart").select("band", "hash").distinct(), ["band", "hash"], "left_semi")
    torn = torn.groupBy("key").agg(F.first("label").alias("label"), F.max("apart").alias("apart"))
    torn = staged(torn.join(sets, "key"), "neardup-torn")
    if torn.limit(1).count():
        more = linked(joined(torn), sets)
        if more.limit(1).count():
            labels = components(links.union(more))
    whole = nodes.select("key", "first").join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    heads = whole.groupBy("label").agg(F.min("first").alias("head"))
    named_nodes = whole.join(heads, "label").select("key", "head")
    out = rows.select("doc_id", "text_hash", "key").join(named_nodes, "key")
    keeper = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_hash") == F.col("head.text_hash"))
    alone = read.where("text is null").select("doc_id", "text_hash", F.col("doc_id").alias("class_id"), F.lit(True).alias("keeper"))
    return out.select("doc_id", "text_hash", F.col("head.doc_id").alias("class_id"), keeper.alias("keeper")).union(alone)
