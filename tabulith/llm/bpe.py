"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Encoding:
1. Every text is cut into pre-tokens; texts are gathered in chunks of bounded size. A chunk
   lists its distinct words by word bucket, and each text becomes the positions of its
   pre-tokens in that list (a row per text).
2. The chunks' lists are shuffled by bucket, so equal words of all chunks meet in one task,
   which merges each distinct word once. There are as many buckets as BUCKET_BYTES of text.
3. Ids go back to their chunks; there each distinct word's ids are joined with the broadcast
   token-byte table, and texts are reassembled by position, once as ids and once as those bytes.

The chunks are written once to the shared folder: their borders then can't change when an
executor is lost, and words and positions are read as two branches of the same rows.
No key is hot: a chunk adds each word once, however frequent it is.

Decoding joins the token-byte table (at most MAX_VOCABULARY rows, so it may be broadcast)
and concatenates by position: with ``digest`` as a map-side join in the reassembling task, and in
``decode``, from ids alone, as a join of exploded ids. The former spares a row for each chunk and
token, whose number grows with the chunks.

Null texts count as empty; an empty text has no ids. Texts of any length are encoded whole.
Repeated rows stay apart: a text is known by its chunk and row, not by its id, which may be
null. An empty table gives an empty result. Other columns of docs are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulith.llm.common import released, staged

CHUNK_CHARS = 24 << 20
CHUNK_ROWS = 32768
TEXTS_A_ROW, WORDS_A_ROW = 1024, 1 << 19  # a row ends at either
LEVEL = 6  # of compression: what is written and shuffled is mostly ranks
COMMON = 255  # ranks below it take one byte, others go to a stream of their own
MAX_VOCABULARY = 1 << 20
BUCKET_BYTES = 32 << 20


@lru_cache(maxsize=4)
def _ranks(name: str) -> dict[bytes, int]:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        found = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if len(found) > MAX_VOCABULARY:
        raise ValueError("the vocabulary is larger than a broadcast table may be")
    return found


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: of all neighbours the pair of the lowest rank is joined, the leftmost first, until no pair has a rank."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    end = list(range(1, n + 1))  # of the part that starts here; 0 where none does
    before = list(range(-1, n - 1))
    queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, stop = heapq.heappop(queue)
        middle = end[i]
        if not middle or middle == n or end[middle] != stop:  # one of the two parts has grown or gone
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            r = ranks.get(word[i : end[stop]])
            if r is not None:
                heapq.heappush(queue, (r, i, end[stop]))
        if i:
            left = before[i]
            r = ranks.get(word[left:stop])
            if r is not None:
                heapq.heappush(queue, (r, left, stop))
    return [ranks[word[i:e]] for i, e in enumerate(end) if e]


def _class(prop: str) -> str:
    """The code points of a Unicode property as ranges of a character class."""
    import regex

    chars = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    return "".join(f"\\U{ord(m[0][0]):08x}-\\U{ord(m[0][-1]):08x}" for m in regex.finditer(rf"{prop}+", chars))


@lru_cache(maxsize=1)
def splitter():
    """The public pattern for the standard engine, whose bitmaps of explicit classes are some times faster.

    Properties become the code points that they stand for; nothing else of the pattern changes.
    """
    import re

    import public_tokenizers

    pattern = public_tokenizers.PATTERN
    space = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    letters, numbers = _class(r"\p{L}"), _class(r"\p{N}")
    pattern = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letters}{numbers}]")
    pattern = pattern.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
    pattern = pattern.replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]")
    return re.compile(pattern)


def _pack(*parts: np.ndarray | bytes) -> bytes:
    """Arrays of non-negative int32 by byte planes, so that high bytes cost nothing, and bytes; each with its size."""
    out = []
    for p in parts:
        raw = np.ascontiguousarray(np.asarray(p, dtype="<i4").view(np.uint8).reshape(-1, 4).T).tobytes() if isinstance(p, np.ndarray) else p
        out += [len(raw).to_bytes(8, "little"), raw]
    return zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(out))


def _unpack(payload: bytes, kinds: str) -> list[np.ndarray | bytes]:
    """kinds: i for an array, b for bytes."""
    raw, at, out = zstandard.ZstdDecompressor().decompress(payload), 0, []
    for kind in kinds:
        n = int.from_bytes(raw[at : at + 8], "little")
        part = raw[at + 8 : at + 8 + n]
        at += 8 + n
        out.append(part if kind == "b" else np.ascontiguousarray(np.frombuffer(part, dtype=np.uint8).reshape(4, -1).T).view("<i4").ravel())
    return out


def _cut(data: bytes, sizes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes, dtype=np.int64)
    return [data[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]


def _chunks(buckets: int, schema: pa.Schema):
    """A chunk's rows: its texts as ranks of its words (most frequent first), and its words by bucket with their ranks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter().findall
        serial = count(TaskContext.get().partitionId() << 32)
        ids: list = []
        found: list[np.ndarray] = []
        chars = 0
        slots: defaultdict[str, int] = defaultdict(count().__next__)

        def flush() -> pa.RecordBatch:
            nonlocal ids, found, chars, slots
            raw = [w.encode() for w in slots]
            bucket = np.fromiter((zlib.crc32(w) for w in raw), dtype=np.int64, count=len(raw)) % buckets
            often = np.bincount(np.concatenate(found), minlength=len(raw)) if raw else np.zeros(0, dtype=np.int64)
            alphabetic = np.empty(len(raw), dtype=np.int64)
            alphabetic[sorted(range(len(raw)), key=raw.__getitem__)] = np.arange(len(raw))
            order = np.lexsort((alphabetic, bucket, -often))
            rank = np.empty(len(raw), dtype=np.int32)
            rank[order] = np.arange(len(raw), dtype=np.int32)
            rows = []
            lo = 0
            while lo < len(ids):
                hi, words_held = lo, 0
                while hi < len(ids) and hi - lo < TEXTS_A_ROW and words_held < WORDS_A_ROW:
                    words_held += len(found[hi])
                    hi += 1
                part, own_ids, lo = found[lo:hi], ids[lo:hi], hi
                sizes = np.array([len(x) for x in part], dtype=np.int32)
                slot = rank[np.concatenate(part)]
                rare = slot[slot >= COMMON] - COMMON
                rows.append((None, own_ids, _pack(sizes, np.minimum(slot, COMMON).astype(np.uint8).tobytes(), rare)))
            by = order[np.argsort(bucket[order], kind="stable")]  # by bucket, then rank
            for own in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1) if len(by) else []:
                words = [raw[i] for i in own.tolist()]
                rows.append((int(bucket[own[0]]), None, _pack(np.diff(rank[own], prepend=0), np.array([len(w) for w in words]), b"".join(words))))
            columns = [[next(serial)] * len(rows), *map(list, zip(*rows, strict=True))]
            ids, found, chars, slots = [], [], 0, defaultdict(count().__next__)
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                words = split(text)
                found.append(np.fromiter(map(slots.__getitem__, words), dtype=np.int32, count=len(words)))
                ids.append(doc_id)
                chars += len(text)
                if chars >= CHUNK_CHARS or len(ids) >= CHUNK_ROWS:
                    yield flush()
        if ids:
            yield flush()

    return run


def _merge(name: str):
    schema = pa.schema([("chunk", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each distinct word of this task's buckets is merged once; its ids go back to every chunk that has it."""
        ranks = _ranks(name)
        known: dict[bytes, list[int]] = {}  # of one bucket: rows come by bucket
        here = None
        for batch in batches:
            out = []
            for payload, bucket in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if bucket != here:
                    known, here = {}, bucket
                places, sizes, words = _unpack(payload, "iib")
                ids = []
                for w in _cut(words, sizes):
                    got = known.get(w)
                    if got is None:
                        got = known[w] = merge(w, ranks)
                    ids.append(got)
                out.append(_pack(places, np.array([len(x) for x in ids]), np.array([i for x in ids for i in x])))
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], schema=schema)

    return run


def _reassemble(tokens: Broadcast, want_ids: bool, digest: bool, schema: pa.Schema):
    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        parts = [_unpack(p, "iii") for p in words.column("payload").to_pylist()]
        ranks = np.concatenate([np.cumsum(r) for r, _, _ in parts]) if parts else np.zeros(0, dtype=np.int64)
        sizes = np.concatenate([n for _, n, _ in parts]).astype(np.int64) if parts else ranks
        flat = np.concatenate([i for _, _, i in parts]) if parts else ranks.astype(np.int32)
        starts, lengths = np.empty_like(ranks), np.empty_like(ranks)
        starts[ranks], lengths[ranks] = np.cumsum(sizes) - sizes, sizes
        shown, plain = [], []
        if digest:
            table = tokens.value  # the token-byte table: joined with the ids of every distinct word
            decimal = {i: str(i) for i in table}
            for a, n in zip(starts.tolist(), lengths.tolist(), strict=True):
                word = flat[a : a + n].tolist()
                shown.append(",".join([decimal[i] for i in word]))
                plain.append(b"".join([table[i] for i in word]))
        doc_ids: list = []
        totals, gathered, digests = [], [], []
        for own, payload in zip(texts.column("doc_ids").to_pylist(), texts.column("payload").to_pylist(), strict=True):
            counts, common, rare = _unpack(payload, "ibi")
            slots = np.frombuffer(common, dtype=np.uint8).astype(np.int64)
            slots[slots == COMMON] += rare
            doc_ids += own
            ends = np.cumsum(counts)
            held = lengths[slots]
            sums = np.concatenate([[0], np.cumsum(held)])
            totals.append(sums[ends] - sums[ends - counts])
            if want_ids:  # of each word its run of flat
                gathered.append(flat[np.repeat(starts[slots] - sums[:-1], held) + np.arange(sums[-1])])
            if digest:
                at = slots.tolist()
                for hi, n in zip(ends.tolist(), counts.tolist(), strict=True):
                    mine = at[hi - n : hi]
                    digests.append((hashlib.sha256(",".join([shown[i] for i in mine]).encode()).hexdigest(), hashlib.sha256(b"".join([plain[i] for i in mine])).hexdigest()))
        n_tokens = np.concatenate(totals) if totals else np.zeros(0, dtype=np.int64)
        columns = [pa.array(doc_ids, schema.field("doc_id").type), pa.array(n_tokens, pa.int64())]
        if want_ids:
            offsets = np.concatenate([[0], np.cumsum(n_tokens)]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(gathered) if gathered else flat, pa.int32())))
        if digest:
            columns += [pa.array([d[k] for d in digests], pa.string()) for k in (0, 1)]
        del parts, shown, plain
        list(released(iter(())))
        return pa.Table.from_arrays(columns, names=schema.names).cast(schema)

    return run


def encode(docs: DataFrame, name: str = "byte_bpe_multi_50k.tiktoken", ids: bool = True, digest: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, and on request ids, and the digests of the ids and of the bytes decoded from them.

    name: a rank file of public_tokenizers.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark: SparkSession = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    read = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    size = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    made = T.StructType().add("chunk", "long").add("bucket", "integer").add("doc_ids", T.ArrayType(kind)).add("payload", "binary")
    cutting = _chunks(buckets, to_arrow_schema(made))
    chunks = staged(read.mapInArrow(lambda batches: released(cutting(batches)), made), "bpe-chunks")
    words = chunks.where(F.col("bucket").isNotNull()).select("chunk", "payload", "bucket")
    merging = _merge(name)
    sorted_words = words.repartition(F.col("bucket")).sortWithinPartitions("bucket").select("chunk", "payload", "bucket")
    merged = sorted_words.mapInArrow(lambda batches: released(merging(batches)), "chunk long, payload binary")
    texts = chunks.where(F.col("bucket").isNull()).select("chunk", "doc_ids", "payload")
    out = T.StructType().add("doc_id", kind).add("n_tokens", "long")
    out = out.add("ids", T.ArrayType(T.IntegerType())) if ids else out
    out = out.add("ids_sha256", "string").add("decoded_sha256", "string") if digest else out
    tokens = spark.sparkContext.broadcast({i: b for b, i in _ranks(name).items()} if digest else {})  # MAX_VOCABULARY rows at most
    return texts.groupBy("chunk").cogroup(merged.groupBy("chunk")).applyInArrow(_reassemble(tokens, ids, digest, to_arrow_schema(out)), out)


def token_bytes(spark: SparkSession, name: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """The token-byte table: id, bytes."""
    ranks = _ranks(name)
    return spark.createDataFrame(pa.table({"id": pa.array(ranks.values(), pa.int32()), "bytes": pa.array(ranks.keys(), pa.binary())}))


def decode(encoded: DataFrame, name: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """Texts of encoded(doc_id, ids): ids are exploded, joined with the token-byte table and concatenated by position.

    A text without ids is empty; an id that the table lacks makes the text null.
    """
    rows = encoded.select(F.monotonically_increasing_id().alias("row"), "doc_id", "ids")
    one = rows.select("row", "doc_id", F.posexplode_outer("ids").alias("pos", "id"))
    joined = one.join(F.broadcast(token_bytes(encoded.sparkSession, name)), "id", "left")
    whole = joined.groupBy("row", "doc_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", F.hex("bytes").alias("hex"))))).alias("parts"),
        F.bool_or(F.col("id").isNotNull() & F.col("bytes").isNull()).alias("unknown"),
    )
    text = F.unhex(F.array_join(F.col("parts.hex"), "")).cast("string")
    return whole.select("doc_id", F.when(~F.col("unknown"), text).alias("text"))
