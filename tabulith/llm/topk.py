"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are sorted into blocks by length, so a block's longest vector bounds every product
with it. A query's k-th best score among the longest vectors of all is its first threshold;
threshold / (|query| * longest) is the cosine that a block would have to offer. A block out of
reach of a whole query block is never sent to it. Inside a pair of blocks each query is pruned
by the local cosine: over 1 the block is skipped, from COORDINATE_FROM on candidates whose
coordinate at the query's largest places rules the cosine out are dropped, below it those
that are too short. What is left is verified by exact integer products.

Blocks cut equal lengths by row number, so a vector that repeats a million times still gives
even blocks. Every block that isn't ruled out is compared: the result is exact. Candidate blocks
are dealt once, by block, and stay; query blocks go to them, in the narrowest integers that hold
them. The driver holds one length and one dimension per block of BLOCK vectors, nothing per vector.

A row whose vector is null, or holds a null or a component that isn't finite, takes no part.
Vectors of different dimension have no product; that of two empty vectors is 0. Components and
scores beyond 64 bits are taken as the largest or smallest long. Rows are told apart by place,
not by id, so a repeated row is a candidate for its twin. Null ids come last among ties and are
no queries. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulith.llm.common import staged

BLOCK = 4096
QUERIES = 1024
LISTED = 4096
COORDINATE_FROM = 0.7
SCALE = 256
_BLOCKS = "part int, dim int, longest double, ids array<long>, rows array<long>, matrix binary"


def scaled(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id, row and the vector as integers floor(SCALE * x), for rows that take part."""
    x = F.transform(F.col(vector_column), lambda v: v.cast("double"))
    fine = F.col(vector_column).isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    rows = vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(id_column).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * SCALE)).alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, a: s + a.cast("double") * a.cast("double")))
    return rows.select("id", F.monotonically_increasing_id().alias("row"), F.size("v").alias("dim"), length.alias("length"), "v")


def _packed(size: int, queries: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, int, int, float, list[int]]] = []

        def flush() -> pa.RecordBatch:
            own = sorted(held, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
            matrix = np.array([r[4] for r in own], dtype=np.int64)
            if matrix.size and -(1 << 31) < matrix.min() and matrix.max() < 1 << 31:
                matrix = matrix.astype(np.int32)
            longest = max(r[3] for r in own)
            block = pa.record_batch(
                [pa.array([0], pa.int32()), pa.array([own[0][2]], pa.int32()), pa.array([longest]), pa.array([[r[0] for r in own]], pa.list_(pa.int64())), pa.array([[r[1] for r in own]], pa.list_(pa.int64())), pa.array([matrix.tobytes()], pa.binary())],
                names=["part", "dim", "longest", "ids", "rows", "matrix"],
            )
            held.clear()
            return block

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if held and (len(held) >= size or held[0][2] != row[2]):
                    yield flush()
                held.append(row)
        if held:
            yield flush()

    return run


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Blocks by dimension and length; numbered from the longest down."""
    made = rows.repartitionByRange("dim", F.desc("length"), "row").sortWithinPartitions("dim", F.desc("length"), "row")
    blocks = staged(made.mapInArrow(_packed(size, name == "queries"), _BLOCKS), f"topk-{name}")
    return blocks.withColumn("part", F.xxhash64("dim", F.element_at("rows", 1)))


def _matrix(raw: bytes, dim: int, rows: int) -> np.ndarray:
    if not dim:
        return np.zeros((rows, 0), dtype=np.int64)
    return np.frombuffer(raw, dtype=np.int32 if len(raw) == 4 * dim * rows else np.int64).reshape(rows, dim).astype(np.int64)


LEAST, MOST = np.iinfo(np.int64).min + 1, np.iinfo(np.int64).max


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products, by doubles where every partial sum fits them; those beyond 64 bits become the nearest long."""
    if not q.size or not c.size:
        return np.zeros((len(q), len(c)), dtype=np.int64)
    most = float(np.abs(q.astype(np.float64)).max()) * float(np.abs(c.astype(np.float64)).max()) * q.shape[1]
    if most < 2.0**52:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if most < 2.0**62:
        return q @ c.T
    return np.clip(q.astype(object) @ c.astype(object).T, int(LEAST), int(MOST)).astype(np.int64)


def _best(scores: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """For each row the places of its k best scores, its own last; ties to the earlier place."""
    n = scores.shape[1]
    if n > k and float(np.abs(scores.astype(np.float64)).max(initial=0)) * n < 2.0**61:
        key = scores * n + np.arange(n - 1, -1, -1)
        key[own] = LEAST
        top = np.argpartition(key, n - k, axis=1)[:, n - k :]
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(key, top, axis=1), axis=1), axis=1)
    return np.argsort(~np.where(own, LEAST - 1, scores), axis=1, kind="stable")[:, :k]


def _thresholds(k: int):
    """Adds to each query block the k-th best score of each query in the block beside it, or the least long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            col = {n: batch.column(i).to_pylist() for i, n in enumerate(names)}
            out = []
            for i in range(batch.num_rows):
                q, c = _matrix(col["matrix"][i], col["dim"][i], len(col["rows"][i])), _matrix(col["c_matrix"][i], col["dim"][i], len(col["c_rows"][i]))
                s = _products(q, c).astype(np.float64)
                s[np.array(col["rows"][i])[:, None] == np.array(col["c_rows"][i])[None, :]] = -np.inf
                out.append(np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k].tolist() if s.shape[1] >= k else [-np.inf] * len(q))
            keep = [n for n in names if not n.startswith("c_")]
            yield pa.record_batch([*[batch.column(names.index(n)) for n in keep], pa.array(out, pa.list_(pa.float64()))], names=[*keep, "least"])

    return run


def _compare(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                dim = col["dim"][i]
                q, c = _matrix(col["matrix"][i], dim, len(col["rows"][i])), _matrix(col["c_matrix"][i], dim, len(col["c_rows"][i]))
                q_rows, c_rows = np.array(col["rows"][i]), np.array(col["c_rows"][i])
                c_ids = col["c_ids"][i]
                least = np.array(col["least"][i])
                ql, cl = (np.sqrt((m.astype(np.float64) ** 2).sum(axis=1)) for m in (q, c))
                out: list[tuple] = []

                def keep(rows: np.ndarray, places: np.ndarray, scores: np.ndarray) -> None:
                    """rows of q against places of c; scores may hold the query itself."""
                    own = q_rows[rows][:, None] == c_rows[places][None, :]
                    for r, top in zip(rows.tolist(), _best(scores, own, k), strict=True):
                        at = np.searchsorted(rows, r)
                        out.extend((col["ids"][i][r], int(q_rows[r]), c_ids[places[t]], int(c_rows[places[t]]), int(scores[at, t])) for t in top.tolist() if not own[at, t] and scores[at, t] >= least[r])  # noqa: B023

                with np.errstate(divide="ignore", invalid="ignore"):
                    reach = ql * cl.max(initial=0.0) * (1 + 1e-9)
                    cosine = np.where(least <= 0, -1.0, np.where(reach > 0, least / reach, np.inf))
                by_length = np.flatnonzero(cosine < COORDINATE_FROM)
                if len(by_length):
                    need = np.where(least > 0, least / np.maximum(ql, 1e-300), -1.0)[by_length].min()
                    places = np.flatnonzero(cl * (1 + 1e-9) >= need)
                    if len(places):
                        keep(by_length, places, _products(q[by_length], c[places]))
                for r in np.flatnonzero((cosine >= COORDINATE_FROM) & (cosine <= 1)).tolist():
                    # |x_f - t q_f| <= sqrt((1 - t^2)(1 - q_f^2)) for unit vectors of cosine t or more, t for each candidate
                    t = np.minimum(least[r] / np.maximum(ql[r] * cl, 1e-300), 2.0) * (1 - 1e-9)
                    fine = t <= 1
                    unit = q[r] / ql[r]
                    for f in np.argsort(-np.abs(unit))[:2]:
                        x = c[:, f] / np.maximum(cl, 1e-300)
                        slack = np.sqrt(np.maximum(0.0, 1 - t * t) * max(0.0, 1 - unit[f] ** 2)) + 1e-7
                        low = t * unit[f] - slack if unit[f] > 0 else t * unit[f] + slack
                        fine &= x >= low if unit[f] > 0 else x <= low
                    places = np.flatnonzero(fine)
                    if len(places):
                        keep(np.array([r]), places, _products(q[r : r + 1], c[places]))
                if out:
                    yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["query_id", "query_row", "vec_id", "row", "score"])

    return run


def search(vectors: DataFrame, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", every: int = 50) -> DataFrame:
    """query_id, rank, vec_id and score of the k best products of each row whose id is divisible by ``every``."""
    rows = staged(scaled(vectors, id_column, vector_column), "topk-rows")
    blocks = _blocks(rows, BLOCK, "candidates")
    queries = _blocks(rows.where(F.col("id") % every == 0), QUERIES, "queries")
    listed = blocks.select("part", "dim", "longest", F.size("ids").alias("n")).collect()
    top = {}
    for r in sorted(listed, key=lambda r: (-r.longest, r.part)):
        top.setdefault(r.dim, r.part)
    named = blocks.select(F.col("part").alias("c_part"), F.col("ids").alias("c_ids"), F.col("rows").alias("c_rows"), F.col("matrix").alias("c_matrix"))
    # first thresholds: each query against the block of the longest vectors, one block for each dimension
    spark = vectors.sparkSession
    first = spark.createDataFrame(list(top.items()), "dim int, c_part long").join(named, "c_part").select("dim", "c_rows", "c_matrix")
    known = queries.join(first, "dim").select("part", "dim", "longest", "ids", "rows", "matrix", "c_rows", "c_matrix")
    known = staged(known.mapInArrow(_thresholds(k), "part long, dim int, longest double, ids array<long>, rows array<long>, matrix binary, least array<double>"), "topk-thresholds")
    # a query block goes to the blocks whose longest vector can reach some threshold of it
    # (rows of LISTED blocks at most)
    reach = spark.createDataFrame([(r.dim, i // LISTED, r.part, r.longest) for i, r in enumerate(listed)], "dim int, chunk int, c_part long, c_longest double")
    reach = reach.groupBy("dim", "chunk").agg(F.collect_list(F.struct("c_part", "c_longest")).alias("those"))
    sent = known.join(reach, "dim").select("dim", "longest", "ids", "rows", "matrix", "least", F.explode("those").alias("that"))
    sent = sent.where(F.array_min("least") <= F.col("longest") * F.col("that.c_longest") * (1 + 1e-9)).withColumn("c_part", F.col("that.c_part"))
    tasks = max(1, len(listed))
    pairs = sent.select("c_part", "dim", "ids", "rows", "matrix", "least").repartition(tasks, "c_part").join(named.repartition(tasks, "c_part"), "c_part")
    found = pairs.drop("c_part").mapInArrow(_compare(k), "query_id long, query_row long, vec_id long, row long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
