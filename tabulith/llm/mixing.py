"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents stand in a seeded random order (a 64-bit hash of the row; equal rows,
which nothing tells apart, by a number of their own after it).
A source with target T and S words is passed over floor(T / S) times in full and once
more up to the document where the remaining words are reached. Equal slices of the hash
range are the source's blocks, so a pass is a known number of blocks and the draws of
all sources are exact block quotas. A binary tree divides those quotas among the output
shards: at each node the left half's quotas are one multivariate-hypergeometric draw.
A shard then owns a disjoint run of permuted blocks of each source, and its rows are
ordered by a seeded hash, which is a shuffle local to the shard. Shards, and the parts that a
shard is sorted in, grow with the words of the mix.

What reaches the driver is one short row per source and, while the last pass is cut, at most
256 sums per source and round; nothing grows with documents. MAX_BLOCKS and MAX_BLOCK_BITS set
how fine a source is cut for dealing; they change no quota of words and no document's copies.

Null sources form one source of their own, which comes last. Null and empty texts have no words:
they are in no mix. Very long texts are one document each, taken whole. Of equal rows as many are
taken as are needed. An empty table gives an empty result. Columns of docs named like a helper's
are safe: the row travels as one struct.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulith.llm.common import staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SEED = 20260
SHARDS, MOST_SHARDS = 16, 256
WORDS_A_PART = 1 << 24
BROADCAST_BYTES = 32 << 20
DOCS_A_BLOCK = 64
MAX_BLOCK_BITS = 20
MAX_BLOCKS = 900_000_000


def water_fill(sizes: list[int], weights: list[float], share: float, cap: float) -> list[float]:
    """Targets in proportion to weights with sum share * sum(sizes), none above cap * size.

    What a capped source can't take goes to the others by weight, until none is above.
    """
    targets = [0.0] * len(sizes)
    left, open_ = share * sum(sizes), [i for i, s in enumerate(sizes) if s > 0]
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > cap * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = left * weights[i] / total
            break
        for i in full:
            targets[i] = cap * sizes[i]
        left -= sum(targets[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return targets


def split_tree(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """quotas[source] blocks dealt to shards: an array [source, shard] whose rows sum to quotas.

    Every node splits its shards in halves and its quotas by a multivariate-hypergeometric
    draw whose size is the left half's share of all blocks. Large colours are drawn one by one
    as nested hypergeometric numbers. The generator is seeded by the node, so subtrees can be
    drawn anywhere and agree.
    """
    out = np.zeros((len(quotas), shards), dtype=np.int64)

    def walk(q: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[:, lo] = q
            return
        mid = (lo + hi) // 2
        rng = np.random.Generator(np.random.PCG64([seed, lo, hi]))
        rest, want = int(q.sum()), int(q.sum()) * (mid - lo) // (hi - lo)
        left = np.zeros_like(q)
        for i, n in enumerate(q.tolist()):
            rest -= n
            left[i] = rng.hypergeometric(n, rest, want) if n and want else 0
            want -= int(left[i])
        walk(left, lo, mid)
        walk(q - left, mid, hi)

    walk(np.asarray(quotas, dtype=np.int64), 0, shards)
    return out


def sized(docs: DataFrame, extra: list[str] = ()) -> DataFrame:
    """doc_id, source, size, the place in the source's random order (h, and tie among equal rows), and other columns asked for.

    tie is any numbering of the rows: of equal rows, whichever is taken, the result is the same.
    """
    return docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(SEED), "doc_id", "text", "source").alias("h"),
        F.xxhash64(F.lit(SEED), F.monotonically_increasing_id()).alias("tie"),
        *extra,
    )


LEVELS = 16  # bytes of (h, tie)


def _signed(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


def _halves(v: int) -> tuple[int, int]:
    """A place in the order as signed h and tie."""
    return _signed(v >> 64), _signed(v & (1 << 64) - 1)


def _before(cut_h: str, cut_tie: str):
    """The row stands before a place of the order, in unsigned order."""
    flip = lambda c: F.col(c).bitwiseXOR(F.lit(-(1 << 63)))
    return (flip("h") < flip(cut_h)) | ((F.col("h") == F.col(cut_h)) & (flip("tie") < flip(cut_tie)))


def _top(level: int):
    """(h, tie) cut to the bytes before level, as two columns."""
    keep = lambda c, n: F.lit(0).cast("long") if n <= 0 else F.col(c) if n >= 8 else F.shiftrightunsigned(F.col(c), 64 - 8 * n)
    return keep("h", level), keep("tie", level - 8)


def _digit(level: int):
    """The level-th byte of (h, tie)."""
    return F.shiftrightunsigned(F.col("h" if level < 8 else "tie"), 56 - 8 * (level % 8)).bitwiseAND(F.lit(255))


def _cut_pass(sizes: DataFrame, rest: dict[str | None, float]) -> dict[str | None, tuple[int, int | None]]:
    """For each source the place in the order before which a partial pass takes documents, and one more document's place, or None.

    The 256 sums of a byte locate the slice where the rest is reached; each round looks only
    inside that slice, so it ends when the slice holds one document.
    """
    spark = sizes.sparkSession
    prefix = {k: 0 for k, v in rest.items() if v > 0}
    left = dict(rest)
    cut = {k: 0 for k in rest}
    for level in range(LEVELS):
        if not prefix:
            break
        rows = sizes
        if level:
            parts = [(k, *((_signed(v >> 8 * (level - 8)), _signed(v & (1 << 8 * (level - 8)) - 1)) if level > 8 else (_signed(v), 0))) for k, v in prefix.items()]
            at = spark.createDataFrame(parts, "k string, at_h long, at_tie long")
            h, tie = _top(level)
            rows = rows.join(_small(at, len(parts)), F.col("source").eqNullSafe(F.col("k")) & (h == F.col("at_h")) & (tie == F.col("at_tie")))
        sums = rows.groupBy("source", _digit(level).alias("digit")).agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect()
        by: dict[str | None, list] = {}
        for r in sums:
            if r.source in prefix:
                by.setdefault(r.source, []).append((r.digit, r.words, r.n))
        after = {}
        for k, slices in by.items():
            base = prefix[k] << 8
            for digit, words, n in sorted(slices):
                here = base | digit
                shift = 8 * (LEVELS - 1 - level)
                if words <= left[k]:
                    left[k] -= words
                    cut[k] = (here + 1) << shift
                elif n == 1 or level == LEVELS - 1:
                    if words - left[k] < left[k]:  # nearer with this document than without
                        left[k] -= words
                        cut[k] = (here + 1) << shift
                    break
                else:
                    cut[k] = here << shift
                    after[k] = here
                    break
        prefix = after
    gaps = [(k, float(v), *_halves(cut[k])) for k, v in left.items() if v >= 1 and cut[k] < 1 << 128]
    more: dict[str | None, int] = {}
    if gaps:
        at = spark.createDataFrame(gaps, "k string, gap double, cut_h long, cut_tie long")
        later = sizes.join(_small(at, len(gaps)), F.col("source").eqNullSafe(F.col("k"))).where(~_before("cut_h", "cut_tie") & (F.col("size") > 0) & (F.col("size") < 2 * F.col("gap")))
        best = later.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "h", "tie")).alias("b"))
        more = {r.source: (r.b.h & (1 << 64) - 1) << 64 | r.b.tie & (1 << 64) - 1 for r in best.collect()}
    return {k: (cut[k], more.get(k)) for k in rest}


def _small(df: DataFrame, rows: int, width: int = 200) -> DataFrame:
    """Broadcast if its rows fit; else the join is left to the planner, which splits hot sources."""
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df


def planned(sizes: DataFrame, shards: int | None = None, seed: int = SEED, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Every row of sizes (see ``sized``) with source_size, target, taken and draws.

    draws lists the row's copies as (shard, part, position); a row that isn't taken has none.
    shards: by the words of the mix, if not given.
    """
    spark: SparkSession = sizes.sparkSession
    per = sizes.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("docs")).collect()
    per = sorted(per, key=lambda r: (r.source is None, (r.source or "").encode("utf-32-be")))
    words = [r.words for r in per]
    targets = water_fill(words, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(per))], share, cap)
    wanted = math.ceil(sum(targets) / WORDS_A_PART)
    shards = shards or min(MOST_SHARDS, max(SHARDS, 1 << max(0, wanted - 1).bit_length()))
    parts = max(SHARDS, math.ceil(wanted / shards))
    passes = [int(t // w) if w else 0 for t, w in zip(targets, words, strict=True)]
    rest = {r.source: (t - p * r.words) for r, t, p in zip(per, targets, passes, strict=True)}
    cuts = _cut_pass(sizes, rest) if per else {}
    bits = [min(MAX_BLOCK_BITS, max(0, math.ceil(math.log2(max(1, r.docs / DOCS_A_BLOCK))))) for r in per]
    while sum(2 << b for b in bits) > MAX_BLOCKS and any(bits):  # numpy's hypergeometric numbers end at 10^9
        bits = [max(0, b - 1) for b in bits]
    part = [-((-cuts[r.source][0]) >> (128 - b)) for r, b in zip(per, bits, strict=True)]
    quotas = [p * (1 << b) + x for p, b, x in zip(passes, bits, part, strict=True)]
    dealt = split_tree(quotas, shards, seed)
    rows = []
    for i, r in enumerate(per):
        cut, more = cuts[r.source]
        whole = cut >= 1 << 128
        rows.append((r.source, r.words, float(targets[i]), passes[i] + whole, *_halves(0 if whole else cut), *((None, None) if more is None else _halves(more)), bits[i], np.cumsum(dealt[i]).tolist()))
    plan = spark.createDataFrame(rows, "k string, source_size long, target double, passes int, cut_h long, cut_tie long, more_h long, more_tie long, bits int, ends array<long>")
    joined = sizes.join(_small(plan, len(rows), 100 + 8 * shards), F.col("source").eqNullSafe(F.col("k")))
    extra = (_before("cut_h", "cut_tie") | F.coalesce((F.col("h") == F.col("more_h")) & (F.col("tie") == F.col("more_tie")), F.lit(False))).cast("int")
    copies = F.when(F.col("size") > 0, F.col("passes") + extra).otherwise(F.lit(0))
    # a pass visits the blocks in an order of its own: an odd multiplier permutes a power of two
    blocks = F.expr("shiftleft(1L, bits)")
    block = F.when(F.col("bits") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftrightunsigned(h, 64 - bits)"))
    order = lambda p: F.pmod(F.col("block") * (F.lit(2) * F.pmod(F.xxhash64(F.lit(seed), p), F.lit(1 << 20)) + 1), F.col("blocks"))
    index = lambda p: p * F.col("blocks") + F.when(p < F.col("passes"), order(p)).otherwise(F.col("block"))
    shard = lambda p: F.least(F.size(F.filter("ends", lambda e: e <= index(p))), F.lit(shards - 1))
    position = lambda p: F.xxhash64(F.lit(seed + 1), "h", "tie", p)
    draw = lambda p: F.struct(shard(p).alias("shard"), F.pmod(position(p), F.lit(parts)).cast("int").alias("part"), position(p).alias("position"))
    draws = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), draw)).otherwise(F.array().cast("array<struct<shard:int,part:int,position:bigint>>"))
    kept = [c for c in sizes.columns if c not in ("doc_id", "source", "size", "h", "tie")]
    return (
        joined.withColumns({"copies": copies.cast("int"), "block": block, "blocks": blocks})
        .withColumn("draws", draws)
        .select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "draws", *kept)
    )


def mix(docs: DataFrame, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """The mixed corpus: docs' columns, one row per copy drawn, dealt to shards and shuffled inside each part of a shard."""
    sizes = staged(sized(docs, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")]), "mix-sizes")
    drawn = planned(sizes, shards, seed).select("row", F.explode("draws").alias("draw"))
    dealt = drawn.repartition(F.col("draw.shard"), F.col("draw.part")).sortWithinPartitions("draw.shard", "draw.part", "draw.position")
    return dealt.select("row.*")


def mix_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and the shards of its copies."""
    sizes = staged(sized(docs), "mix-sizes")
    return planned(sizes).select("doc_id", "size", "source_size", "target", "taken", F.array_sort("draws.shard").alias("shards"))
