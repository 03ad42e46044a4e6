"""Each method against brute force, an exact round trip or held-out rows."""

import hashlib
import html.parser
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulith.llm import bpe, langid, mixing, near_dup, pii, quality, queries, topk, toxicity, webp, wrapper
from tabulith.llm.common import table

SF = "/root/testdata/sf0.001"


# ---- 1 ----------------------------------------------------------------------------------


def sets_of(texts):
    words, counts = near_dup.word_hashes(texts)
    owner, element, weight = near_dup.weighted(*near_dup.shingles(words, counts))
    return owner, element, weight


def test_shingles_are_those_of_a_plain_split():
    texts = ["a b c d e f", "A  b\tc d e\nf g", "", "one", "x y x y x y x y"]
    owner, _, weight = sets_of(texts)
    for i, t in enumerate(texts):
        w = t.lower().split()
        want = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
        assert sorted(weight[owner == i]) == pytest.approx(sorted(1 + np.log(list(want.values()))) if want else [])


def test_registers_estimate_the_probability_jaccard():
    rng = np.random.default_rng(5)
    a, b = rng.permutation(3000)[:200], rng.permutation(3000)[:200]
    b[:150] = a[:150]
    wa, wb = (dict(zip(x.tolist(), rng.uniform(1, 3, len(x)), strict=True)) for x in (a, b))
    wb |= {k: wa[k] for k in a[:150].tolist()}
    owner = np.repeat([0, 1], [len(wa), len(wb)])
    element = np.array([*wa, *wb], dtype=np.uint64)
    sig = near_dup.signatures(owner, element, np.array([*wa.values(), *wb.values()]), 2, m=4096)
    # the probability Jaccard: sum over common elements of 1 / sum over all of the larger scaled weight
    want = sum(1 / sum(max(wa.get(e, 0) / wa[d], wb.get(e, 0) / wb[d]) for e in set(wa) | set(wb)) for d in set(wa) & set(wb))
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03


def brute_classes(rows):
    shingled = {}
    for i, t in rows:
        w = (t or "").lower().split()
        shingled[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else ["empty"])
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = [i for i, t in rows if t is not None]
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            p, q = shingled[a], shingled[b]
            if len(p & q) >= 0.8 * len(p | q):
                r, s = sorted((root(a), root(b)))
                parent[s] = r
    return {i: root(i) for i, _ in rows}


def test_classes_are_those_of_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    r = random.Random(2)
    base = [w for _, t in rows for w in (t or "").split()]
    for k in range(60):  # near copies at all distances, in chains
        words = base[k * 40 : k * 40 + 120]
        for _ in range(3):
            words = [w if r.random() > 0.02 else "changed" for w in words]
            rows.append((10_000 + len(rows), " ".join(words)))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: x.class_id for x in near_dup.classes(df).collect()} == brute_classes(rows)


def test_near_copies_on_a_template_that_many_share(spark):
    r = random.Random(3)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    template = words(176)
    rows = [(i, " ".join(template + words(28))) for i in range(120)]
    for k in range(60):  # two that share a little more than the template, so that their similarity is just above 0.8
        tail = words(28)
        rows += [(1000 + 2 * k, " ".join(template + tail)), (1001 + 2 * k, " ".join(template + tail[: 6 + k % 4] + words(22 - k % 4)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(rows)
    assert sum(want[1001 + 2 * k] == 1000 + 2 * k for k in range(60)) == 60
    assert {x.doc_id: x.class_id for x in near_dup.classes(df).collect()} == want


def test_near_copies_with_repeated_lines(spark):
    r = random.Random(4)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    rows = []
    for k in range(40):  # one of two repeats a line that the other lacks, or has once
        body, line = words(104), words(15)
        rows += [(2 * k, " ".join(body + line * (k % 2))), (2 * k + 1, " ".join(body + line * 50))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(rows)
    assert all(want[2 * k + 1] == 2 * k for k in range(40))
    assert {x.doc_id: x.class_id for x in near_dup.classes(df).collect()} == want


# ---- 2 ----------------------------------------------------------------------------------


def test_targets_are_capped_and_reshared():
    assert mixing.water_fill([100, 100, 100], [3, 1, 2], 1.5, 2) == pytest.approx([200, 250 / 3, 500 / 3])
    assert sum(mixing.water_fill([10, 1000], [3, 1], 1.5, 2)) == pytest.approx(1515)
    assert mixing.water_fill([], [], 1.5, 2) == [] and mixing.water_fill([0, 5], [1, 1], 1.5, 2) == [0, 7.5]


def test_the_tree_deals_all_quotas():
    dealt = mixing.split_tree([1000, 7, 0, 50_000], 16, 3)
    assert dealt.sum(axis=1).tolist() == [1000, 7, 0, 50_000] and (dealt >= 0).all()
    assert dealt.sum(axis=0).max() - dealt.sum(axis=0).min() <= 8
    assert (dealt == mixing.split_tree([1000, 7, 0, 50_000], 16, 3)).all()


def test_the_mix_keeps_its_promises(spark):
    docs = table(spark, SF, "documents")
    got = mixing.mix_report(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_report(docs).collect()))
    texts = {r.doc_id: r for r in docs.collect()}
    by = {}
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id].text or "")) and r.taken <= 2 * r["size"]
        by.setdefault(texts[r.doc_id].source, []).append(r)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(r["size"] for r in by[s]) for s in names]
    want = mixing.water_fill(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2)
    for s, size, target in zip(names, sizes, want, strict=True):
        assert all(r.source_size == size and r.target == pytest.approx(target) for r in by[s])
        assert abs(sum(r.taken for r in by[s]) - target) <= max(r["size"] for r in by[s])
    assert mixing.mix(docs).count() == sum(len(r.shards) for r in got)


@pytest.mark.parametrize("copies, others", [(1000, 0), (1000, 37), (1, 0), (3, 500)])
def test_equal_rows_are_cut_among(spark, copies, others):
    rows = [(1, "one two", "b")] * copies + [(2 + i, "some other words stand here", "b") for i in range(others)] + [(9000 + i, "a b c", f"a{i}") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for parts in (1, 5):
        got = mixing.mix_report(docs.repartition(parts)).collect()
        own = [r for r in got if r.doc_id < 9000]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 5 and all(r.taken <= 2 * r["size"] for r in got)
        if parts == 1:
            first = sorted((r.doc_id, r.taken) for r in got)
        assert sorted((r.doc_id, r.taken) for r in got) == first


def test_many_sources(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('w ', 1 + id % 7) AS text", "concat('s', id) AS source")
    got = mixing.mix_report(docs).collect()
    assert len(got) == 3000 and len({r.target for r in got}) > 3 and all(r.taken <= 2 * r["size"] for r in got)


# ---- 3 and 5 ----------------------------------------------------------------------------


def held_out_labels(spark, label):
    labels = {r.doc_id: r[label] for r in table(spark, SF.replace("0.001", "0.01"), "labels").collect()}
    return labels, SF.replace("0.001", "0.01")


def auc(scores, y):
    one, zero = (np.array([s for s, v in zip(scores, y, strict=True) if v == k]) for k in (1, 0))
    return ((one[:, None] > zero) + 0.5 * (one[:, None] == zero)).mean()


@pytest.mark.parametrize("name, label", [("op3_toxicity", "toxic"), ("op5_quality", "quality")])
def test_held_out_rows_are_told_apart(spark, name, label):
    labels, sf_dir = held_out_labels(spark, label)
    rows = [r for r in queries.queries()[name](spark, sf_dir).collect() if r.held_out and r.doc_id in labels]
    y = [labels[r.doc_id] for r in rows]
    assert auc([r.score for r in rows], y) > 0.95
    assert np.mean([r.predicted == v for r, v in zip(rows, y, strict=True)]) > 0.93


def test_grams_by_slices_are_those_of_the_whole(monkeypatch):
    texts = ["Some text, with WORDS and ümlauts " * 40, "", "ab"]
    whole = [x.tolist() for x in toxicity.grams(texts)]
    monkeypatch.setattr(toxicity, "SLICE", 50)
    assert [x.tolist() for x in toxicity.grams(texts)] == whole


def test_a_label_is_learned_from_the_whole_text(spark):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(40):
        clean = " ".join(r.choice(("river", "stone", "garden", "window", "letter", "morning")) for _ in range(9000))
        assert len(clean) > 50_000
        rows.append((i, clean + (" you vile wretched scum" if i % 2 else " you kind old friend")))
        labels.append((i, i % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    scores = model.scores(["vile wretched scum", "kind old friend"])
    assert scores[0] > 0.8 and scores[1] < 0.2
    assert np.all((model.scores([t for _, t in rows]) >= 0.5) == [y for _, y in labels])


def test_views_teach_each_other():
    rng = np.random.default_rng(1)
    n = 3000
    y = rng.integers(0, 2, n)
    x = rng.normal(size=(n, quality.KINDS + 9)) + 1.5 * y[:, None] * (np.arange(quality.KINDS + 9) < 3)
    places = np.array([quality.metadata(f"s{2 * rng.integers(0, 5) + (v if rng.random() < 0.95 else 1 - v)}", "en", 100) for v in y])
    few = np.arange(n) < 40
    model = quality.fit(x[few], places[few], y[few], x[~few], places[~few])
    score, content, meta = model.scores(x[~few], places[~few])
    assert min(model.taught) > 100
    assert auc(score, y[~few]) >= max(auc(content, y[~few]), auc(meta, y[~few])) - 0.01 and auc(score, y[~few]) > 0.97


def test_measures_of_texts():
    got = quality.measures(["The the THE cat!!", "", None])
    assert got.shape == (3, quality.KINDS + 9) and (got[1] == got[2]).all()
    assert got[0, quality.KINDS + 2] == pytest.approx(3 / 4) and got[0, quality.KINDS + 4] == pytest.approx(1 / 4) or got[0, quality.KINDS + 2] == pytest.approx(2 / 4)


# ---- 4 ----------------------------------------------------------------------------------


@pytest.mark.parametrize("shape", [(1, 1), (1, 7), (5, 1), (9, 13), (33, 17)])
def test_images_round_trip(shape):
    rng = np.random.default_rng(sum(shape))
    blocks = tuple(webp._blocks(n, 2) for n in shape)
    modes = rng.integers(0, 14, blocks).astype(np.uint32) << np.uint32(8)
    factors, groups = rng.integers(0, 1 << 24, blocks).astype(np.uint32), rng.integers(0, 3, blocks).astype(np.uint32)
    every = (webp.PREDICTOR, webp.CROSS_COLOUR, webp.SUBTRACT_GREEN)
    for argb in (rng.integers(0, 1 << 32, shape, dtype=np.uint32), rng.integers(0, 4, shape).astype(np.uint32) * np.uint32(0x010203), np.full(shape, 0xFF112233, np.uint32)):
        for given in ({}, {"cache_bits": 4}, {"transforms": every, "modes": modes, "factors": factors, "cache_bits": 3}, {"groups": groups}, {"groups": groups, "cache_bits": 11}, {"transforms": every[::-1], "modes": modes, "factors": factors}):
            assert (webp.decode(webp.encode(argb, **given)) == argb).all()
        if len(np.unique(argb)) <= 256:
            assert (webp.decode(webp.encode(argb, (webp.PALETTE,))) == argb).all()


def test_a_predicted_pixel_by_hand():
    left, top, corner = (np.array([[v] * 4], dtype=np.int16) for v in (100, 50, 80))
    assert webp.predicted(11, left, top, top, corner).tolist() == [[50] * 4]  # nearer to what left + top - corner says
    assert webp.predicted(12, left, top, top, corner).tolist() == [[70] * 4]
    assert webp.predicted(13, left, top, top, corner).tolist() == [[73] * 4]  # half of a negative difference goes towards 0
    assert webp.predicted(10, left, top, top, corner).tolist() == [[(90 + 50) // 2] * 4]


def test_a_minimal_file_byte_by_byte():
    """One black opaque pixel, written by hand: five codes of one symbol each."""
    bits = [(0, 14), (0, 14), (0, 1), (0, 3), (0, 1), (0, 1), (0, 1)]
    for symbol in (0, 0, 0, 255, 0):
        bits += [(1, 1), (0, 1), (1, 1), (symbol, 8)]
    value, size = 0, 0
    for v, n in bits:
        value, size = value | v << size, size + n
    body = b"\x2f" + value.to_bytes((size + 7) // 8, "little")
    body += b"\0" * (len(body) % 2)
    data = b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body
    assert webp.decode(data).tolist() == [[0xFF000000]]


def test_corrupt_files_are_told():
    good = webp.store(b"abc" * 500)[0]
    for bad in (b"", good[:40], b"RIFF" + good[5:], good[:20] + b"\x00" + good[21:]):
        with pytest.raises(webp.Corrupt):
            webp.decode(bad)


def test_near_places_of_the_distance_map():
    assert webp.NEAR[:8] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2)] and webp.NEAR[-1] == (8, 7) and len(webp.NEAR) == 120


def test_payloads_are_read_back(spark, monkeypatch):
    texts = [r.text or "" for r in table(spark, SF, "documents").collect()]
    want = {hashlib.sha256(p).hexdigest() for p in (t.encode() + b"\xff" * (-len(t.encode()) % 576 or (0 if t else 576)) for t in texts)}
    got = queries.queries()["op4_webp"](spark, SF).collect()
    assert {r.payload_sha256 for r in got} == want and all(r.payload_bytes % 576 == 0 and r.payload_bytes >= r.n_bytes for r in got)
    raw = "".join(texts).encode()[:200_000]
    monkeypatch.setattr(webp, "SLICE_BITS", 1 << 12)
    monkeypatch.setattr(webp, "MAX_ROWS", 50)
    images = webp.store(raw)
    assert len(images) > 2 and b"".join(webp.samples(webp.decode(m)) for m in images).startswith(raw)


def test_every_means_of_the_format_stores_documents():
    r = random.Random(11)
    used = Counter()
    for i in range(4000):
        raw = " ".join(r.choice(("river", "stone", "garden", "window", "letter")) for _ in range(1 + r.randrange(300))).encode()
        share = zlib.crc32(raw) % webp.SHARES
        if share < 5 or i < 100:
            used[share] += 1
            assert b"".join(webp.samples(webp.decode(m)) for m in webp.store(raw)).startswith(raw)
    assert all(used[k] for k in range(5))


def test_every_document_is_stored_with_every_means(spark):
    """No share of the payloads is left out: transforms, colour cache and groups of codes stand in each image."""
    modes, docs = set(), webp.stored(table(spark, SF, "documents")).collect()
    assert len(docs) == table(spark, SF, "documents").count()
    for data in (m for row in docs for m in row.media):
        r, width, height = webp._opened(bytes(data))
        todo, x = webp._transforms(r, width, height, webp._image)
        assert {webp.PREDICTOR, webp.CROSS_COLOUR, webp.SUBTRACT_GREEN} <= {t[0] for t in todo}
        assert r.read(1) and r.read(4) == webp.CACHE_BITS and r.read(1)  # the cache, and a group for each block
        bits = r.read(3) + 2
        blocks = webp._blocks(x, bits) * webp._blocks(height, bits)
        assert len(np.unique(webp._image(r, webp._blocks(x, bits), webp._blocks(height, bits), False))) == min(2, blocks)
        modes |= {int(m) >> 8 & 15 for t in todo if t[0] == webp.PREDICTOR for m in t[2].ravel()}
    assert modes == set(range(14))


def test_predictors_and_factors_are_those_that_take_the_fewest_bits(spark):
    """By place alone they took 1.1 bytes for a byte of text."""
    raws = [(r.text or "").encode() for r in table(spark, SF, "documents").collect()]
    assert sum(len(m) for images in webp.store_many(raws) for m in images) < 0.9 * sum(map(len, raws))
    rng, r = np.random.default_rng(3), random.Random(3)
    steps = rng.integers(0, 3, (40, webp.UNIT)).astype(np.uint8)
    drawn = [np.cumsum(steps, axis=0, dtype=np.uint8), np.cumsum(steps.reshape(40, -1, 3), axis=1, dtype=np.uint8), rng.integers(0, 256, (40, webp.UNIT)).astype(np.uint8)]
    drawn += [drawn[0][:33], np.repeat(rng.integers(0, 256, (40, webp.WIDTH)).astype(np.uint8), 3, axis=1)]  # a block of one row; grey
    for raw in [*(a.tobytes() for a in drawn), " ".join(r.choice(("river", "stone", "garden", "\u00e4", "1234")) for _ in range(4000)).encode()]:
        (argb,), (stored,) = webp._images_of(raw), webp.store(raw)
        assert (webp.decode(stored) == argb).all()
        shape = tuple(webp._blocks(n, webp.SHARE_BITS) for n in argb.shape)
        groups = np.arange(shape[0] * shape[1]).reshape(shape) % 2
        for factor in (0, -32 & 255):
            for mode in range(14):  # one for all blocks
                given = {"modes": np.full(shape, mode << 8, np.uint32), "factors": np.full(shape, factor * 0x101, np.uint32), "groups": groups, "cache_bits": webp.CACHE_BITS, "bits": webp.SHARE_BITS}
                assert len(stored) <= 1.03 * len(webp.encode(argb, (webp.PREDICTOR, webp.SUBTRACT_GREEN, webp.CROSS_COLOUR), **given))


def test_many_images_are_read_as_one_by_one():
    r, rng = random.Random(5), np.random.default_rng(5)
    raws = [b"", b"a", b" " * 3000, bytes(range(256)) * 9, rng.bytes(5000), b"x" * 40_000 + b"end"]
    raws += [" ".join(r.choice(("river", "stone", "\u00e4", "1234", "\n")) for _ in range(r.randrange(900))).encode() for _ in range(60)]
    stored = webp.store_many(raws)
    for raw, images, argb in zip(raws, stored, webp.decode_many(m for images in stored for m in images), strict=True):
        assert len(images) == 1 and (webp.decode(images[0]) == argb).all() and images == webp.store(raw)
        assert webp.samples(argb) == raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
    # images of another encoder: no transforms, other groups, back-references and codes; several values of alpha
    blocks = (webp._blocks(20, 2), webp._blocks(24, 2))
    modes, factors, groups = rng.integers(0, 14, blocks).astype(np.uint32) << np.uint32(8), rng.integers(0, 1 << 24, blocks).astype(np.uint32), rng.integers(0, 3, blocks).astype(np.uint32)
    means = ({}, {"cache_bits": 4}, {"groups": groups}, {"transforms": (webp.PREDICTOR, webp.CROSS_COLOUR), "modes": modes, "factors": factors, "groups": groups, "cache_bits": 11}, {"transforms": (webp.SUBTRACT_GREEN,)})
    drawn = [a.astype(np.uint32) for _ in range(12) for a in (rng.integers(0, 1 << 32, (20, 24)), 0xFF000000 + rng.integers(0, 5, (20, 24)), np.full((20, 24), 0xFF102030))]
    coded = [(webp.encode(a, **given), a) for a in drawn for given in means] + [(webp.encode(a, (webp.PALETTE,)), a) for a in drawn if len(np.unique(a)) < 9]
    assert all((got == a).all() for got, (_, a) in zip(webp.decode_many(m for m, _ in coded), coded, strict=True))
    for k in (25, 60, 90):
        with pytest.raises(webp.Corrupt):
            list(webp.decode_many([images[0] for images in stored[6:20]] + [stored[7][0][:k]]))


def test_pixel_arrays(spark):
    media = spark.createDataFrame([(1, bytearray(webp.encode(np.array([[0xFF010203, 0x80FFFFFF]], dtype=np.uint32)))), (2, None), (3, bytearray(b"no"))], "k int, media binary")
    got = {r.row.k: (r.width, r.height, r.pixels and bytes(r.pixels)) for r in webp.pixels(media).collect()}
    assert got == {1: (2, 1, bytes([1, 2, 3, 255, 255, 255, 255, 128])), 2: (None, None, None), 3: (None, None, None)}


# ---- 6 ----------------------------------------------------------------------------------


def test_top_products_are_those_of_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    want = con.execute(queries.oracle_sql()["op6_topk"]).fetchall()
    assert sorted(map(tuple, queries.queries()["op6_topk"](spark, SF).select("query_id", "rank", "vec_id", "score").collect())) == sorted(want)


def test_top_products_of_odd_vectors(spark, monkeypatch):
    r = random.Random(3)
    rows = [(i, [float(r.randrange(-3, 4)) for _ in range(3)]) for i in range(0, 400, 5)] + [(50, []), (100, []), (7, []), (None, [1.0, 1.0, 1.0])]
    rows += [(150, [1e300, -1e300]), (151, [1e300, 1e17]), (152, [-1e300, 2.0]), (200, [3e9, 4e9, 1.0]), (201, [5e9, -6e9, 1.0]), (0, [2.0, 2.0, 2.0]), (0, [2.0, 2.0, 2.0])]

    def whole(x):
        return max(-(1 << 63), min((1 << 63) - 1, int(np.floor(256 * x)) if abs(x) < 1e15 else int(x) * 256))

    scaled = [(i, [whole(x) for x in v]) for i, v in rows]
    want = []
    for a, (i, v) in enumerate(scaled):
        if i is not None and i % 50 == 0:
            found = [(max(-(1 << 63) + 1, min((1 << 63) - 1, sum(x * y for x, y in zip(v, w, strict=True)))), j) for b, (j, w) in enumerate(scaled) if a != b and len(w) == len(v)]
            found.sort(key=lambda f: (-f[0], f[1] is None, f[1] or 0))
            want += [(i, n, j, s) for n, (s, j) in enumerate(found[:5], 1)]
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERIES", 4)
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("row", F.lit("x")).withColumn("score", F.lit(1)))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


# ---- 7 ----------------------------------------------------------------------------------


def brute_base(text):
    found = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d)) % 10 == 0:
            found.append((m.start(), m.end(), "card"))
    found += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found, key=lambda s: (s[0], pii.BASE.index(s[2])))


def test_base_spans_are_those_of_the_patterns(spark):
    r = random.Random(4)
    parts = ["a.b", "@", "x-y.org", "4111 1111 1111 1111", "10.0.0.1", "300.1.1.1", "+49 (30) 123-4567", "1.2.3.4.5", "00", "-", " ", ".", "+1", "é", "\n", "7" * 16, "%", "c@d@e.f.g"]
    made = ["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(3000)]
    for text in [*made, *[x.text or "" for x in table(spark, SF, "documents").collect()]]:
        assert pii.base_spans(text) == brute_base(text), text


def test_labelers_reliabilities_are_recovered():
    rng = np.random.default_rng(8)
    truth = rng.random(20_000) < 0.3
    right = (0.95, 0.9, 0.85, 0.8)
    spoken = (1.0, 0.9, 0.8, 0.7)
    votes = Counter("".join("0" if rng.random() > s else "+" if (t if rng.random() < p else not t) else "-" for p, s in zip(right, spoken, strict=True)) for t in truth)
    prior, theta, posterior = pii.reliabilities(votes)
    assert abs(prior - 0.3) < 0.03 and posterior["++++"] > 0.99 > 0.01 > posterior["----"]
    assert [theta[k, 1, 2] / (theta[k, 1, 2] + theta[k, 1, 0]) for k in range(4)] == pytest.approx(right, abs=0.04)


def test_added_spans_on_planted_text(spark):
    """Recall and precision of the added spans on texts whose spans are known."""
    r = random.Random(12)
    letters, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    some = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    word = lambda: some(letters, r.randrange(2, 9))
    plants = [
        lambda: ("secret", 'token = "', some("0123456789abcdef", 40), '"'),
        lambda: ("secret", "api_key: ", some(letters, 1) + some(digits, 1) + some(letters + upper + digits, 30), ""),
        lambda: ("number", "ssn ", f"{some(digits, 3)}-{some(digits, 2)}-{some(digits, 4)}", ""),
        lambda: ("number", "iban ", "DE" + some(digits, 20), ""),
        lambda: ("name", "contact: ", f"{r.choice(['Maria', 'Peter', 'Anna', 'John', 'Laura'])} {r.choice(upper)}{word()}", ""),
        lambda: ("name", "signed ", f"{r.choice(['Thomas', 'Susan', 'Pablo', 'Claire'])} {r.choice(upper)}{word()}", ""),
    ]
    decoys = [lambda: f"page {r.randrange(999)}", lambda: f"version {r.randrange(9)}.{r.randrange(9)}", lambda: "under the Apache License here", lambda: f"in {r.randrange(1900, 2030)}", lambda: f"costs {r.randrange(99)}.50", lambda: "All Rights Reserved by us", lambda: some("123456789", 3)]
    rows, want = [], set()
    for i in range(600):
        parts = []
        for _ in range(12):
            parts += [word() for _ in range(r.randrange(3, 12))]
            if r.random() < 0.4:
                parts.append(r.choice(decoys)())
            if r.random() < 0.15:
                kind, cue, value, after = r.choice(plants)()
                lo = len(" ".join(parts)) + 1 + len(cue)
                want.add((i, "secret" if kind == "number" and value[0] == "D" else kind, lo, lo + len(value)))
                parts.append(cue + value + after)
        rows.append((i, " ".join(parts)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = set()
    for x in pii.detect(docs, pii.learn(docs)).collect():
        got |= {(x.row.doc_id, k, int(a), int(b)) for k, a, b in (s.split(":") for s in x.spans.split(",") if s) if k in pii.ADDED}
    missed = Counter((k, dict(rows)[i][max(0, a - 9) : b]) for i, k, a, b in want - got)
    assert len(got & want) / len(want) > 0.9 and len(got & want) / len(got) > 0.9, (list(missed)[:9], list(got - want)[:9])


def test_masks_cover_all_spans(spark):
    docs = spark.createDataFrame([(1, "write to a@b.org or 10.0.0.1 now", 32), (2, None, None)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in pii.masked(docs, pii.learn(docs)).collect()}
    assert got[1].text == "write to <EMAIL> or <IP> now" and got[1].n_chars == len(got[1].text) and got[2].text is None


# ---- 8 ----------------------------------------------------------------------------------


def test_ids_are_those_of_the_library_and_decode(spark, monkeypatch):
    import base64

    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(6)
    odd = ["".join(chr(r.choice([32, 10, 65, 97, 39, 48, 0xE9, 0x4E2D, 0x1F600, 0x301, 0xA0, 0x3000, 33])) for _ in range(r.randrange(60))) for _ in range(200)]
    texts = [(i, t) for i, t in enumerate([*odd, *[x.text for x in table(spark, SF, "documents").collect()], "I'LL don't", None])]
    got = {x.doc_id: x for x in bpe.encode(spark.createDataFrame(texts, "doc_id long, text string"), ids=True, digest=True).collect()}
    for i, t in texts:
        ids = library.encode_ordinary(t or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    long = "".join(chr(r.choice(range(97, 123))) for _ in range(20_000))
    for word in [long, long[:300] + "\u4f60\u597d" * 50, "a" * 5000, *texts[3][1].split()]:
        assert bpe.merge(word.encode(), ranks) == library._core_bpe.encode_single_piece(word.encode())
    back = bpe.decode(spark.createDataFrame([(i, got[i].ids) for i, _ in texts[:50]] + [(-1, [10**6])], "doc_id long, ids array<int>"))
    assert {x.doc_id: x.text for x in back.collect()} == {**{i: t or "" for i, t in texts[:50]}, -1: None}


# ---- 9 ----------------------------------------------------------------------------------


def model_of(texts):
    return langid.Model(sorted(texts), [langid.fit(langid.counted(texts[lang])) for lang in sorted(texts)])


def brute_kneser_ney(texts, order=4):
    """log2 P(c | context), by the textbook's recursion over strings."""
    streams = ["".join(map(chr, langid.codes(t).tolist())) for t in texts]
    grams = [Counter(s[i : i + n] for s in streams for i in range(len(s) - n + 1)) for n in range(order + 1)]
    letters = len(grams[1])
    counts = {order: grams[order]}
    for n in range(order - 1, 0, -1):
        left = Counter(g[1:] for g in grams[n + 1])
        counts[n] = {g: left.get(g, 1) for g in grams[n]}

    def discount(n):
        ones, twos = (sum(v == k for v in counts[n].values()) for k in (1, 2))
        return ones / (ones + 2 * twos) if ones and twos else 0.5

    def p(c, context):
        n = len(context) + 1
        d = discount(n)
        held = {g: v for g, v in counts[n].items() if g[:-1] == context}
        below = 1 / (letters + 1) if n == 1 else p(c, context[1:])
        total = sum(held.values())
        return (max(held.get(context + c, 0) - d, 0) + d * len(held) * below) / total if total else below

    return p


def test_entropies_are_those_of_the_textbook():
    texts = {"x": ["ab abc abd abe " * 3, "abba cab"], "y": ["xyz xzy zyx " * 5]}
    model = model_of(texts)
    for j, lang in enumerate(model.langs):
        p = brute_kneser_ney(texts[lang])
        for text in ("abc", "cab bad xyz", "q", "zyx zyx a"):
            s = "".join(map(chr, langid.codes(text).tolist()))
            want = -sum(np.log2(p(s[i], s[max(0, i - 3) : i])) for i in range(1, len(s))) / (len(s) - 1)
            assert model.entropies([text])[0][j] == pytest.approx(want, abs=1e-5)


def test_texts_by_pieces_score_as_wholes(monkeypatch):
    model = model_of({"x": ["the cat sat on the mat " * 20], "y": ["der Hund lag auf dem Sofa " * 20]})
    text = "the dog lag on dem mat and the Sofa " * 30
    whole = model.entropies([text, "cat", None, "1"])
    monkeypatch.setattr(langid, "SLICE", 37)
    pieces = model.entropies([text, "cat", None, "1"])
    assert np.allclose(whole[0], pieces[0]) and np.allclose(whole[1], pieces[1]) and whole[2] is pieces[3] is None


def test_languages_of_held_out_rows(spark):
    sf_dir = SF.replace("0.001", "0.01")
    lang = {r.doc_id: r.lang for r in table(spark, sf_dir, "documents").collect()}
    got = [r for r in queries.queries()["op9_langid"](spark, sf_dir).collect() if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got]) > 0.97


def test_copies_do_not_shrink_the_sample(spark, monkeypatch):
    monkeypatch.setattr(langid, "DOCS_A_LANG", 20)
    monkeypatch.setattr(langid, "CALIBRATION_DOCS", 10)
    rows = [("the same text again", "en")] * 5000 + [(f"some other text of number {chr(97 + i % 26)}{chr(97 + i // 26)}", "en") for i in range(100)]
    rows += [("immer derselbe Satz", "de")] * 20_000 + [(f"ein anderer Satz {chr(97 + i)}", "de") for i in range(15)] + [("seul", "fr"), (None, "it"), ("nobody", None)]
    sample = langid.sampled(spark.createDataFrame(rows, "text string, lang string")).collect()
    fits = Counter(r.lang for r in sample if r.fits)
    assert fits == {"en": 20, "de": 11, "fr": 1} and len({r.text for r in sample}) == len(sample)


def test_hundreds_of_labels_and_foreign_texts(spark):
    r = random.Random(9)
    rows, names = [], []
    for k in range(300):
        letters = r.sample("abcdefghijklmnopqrstuvwxyz", 9)
        names.append(f"l{k:03d}")
        rows += [(" ".join("".join(r.choice(letters) for _ in range(r.randrange(2, 7))) for _ in range(40)), names[-1]) for _ in range(6)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    model = langid.learn(docs)
    assert model.langs == names
    got = langid.predict(docs, model).collect()
    assert np.mean([g.row.lang == g.lang_pred for g in got]) > 0.99 and not any(g.rejected for g in got)


def test_foreign_texts_are_rejected_and_others_are_not(spark):
    docs = table(spark, SF, "documents")
    model = langid.learn(docs)
    odd = model.predict(["\u4f60\u597d\u5417" * 20, "\u0436\u0443\u043a " * 30, "qxzjk vwqqz jjxkq zzqxv " * 9])
    assert all(rejected for *_, rejected in odd)
    words = [w for r in docs.collect() if r.lang == "en" and r.text for w in r.text.split()[:9]]
    assert not any(rejected for *_, rejected in model.predict([" ".join(words[i : i + 3]) for i in range(0, 300, 3)]))


# ---- 10 ---------------------------------------------------------------------------------


def page(body, extra=""):
    return f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href=/>Home</a></nav><div class='ad'>Buy</div><article><h1>Head</h1>{body}</article>{extra}<div class=comments><p>First!</p></div><footer>(c)</footer><script>x()</script></body></html>"


@pytest.mark.parametrize(
    "html, text",
    [
        (page("<p>One &amp; <b>two</b>\n three</p><ul><li>a<li>b</ul>"), "Head\nOne & two three\na\nb"),
        (page("<p>x<br>y</p><aside>side</aside><form>f</form><p>&#233;&nbsp;z"), "Head\nx y\né z"),
        ("<p>only</p>", "only"),
        ("", ""),
        (None, ""),
        ("<script>1</script>", ""),
    ],
)
def test_main_text(html, text):
    assert wrapper.text_of(html, None) == text


def test_wrappers_generalise_and_do_not_depend_on_the_cut(spark):
    pages = [(i, f"http://h.example/{i}", page("".join(f"<p>text {i} {k} with some words</p>" for k in range(1 + i % 3)), "<p>Same everywhere</p>" if i % 2 else "")) for i in range(24)]
    whole = wrapper.wrap(wrapper.parse(pages[0][2]))
    for _, _, html in pages[1:]:
        whole = wrapper.merge(whole, wrapper.wrap(wrapper.parse(html)))
    assert "(<p>#PCDATA</p>)+" in wrapper.expression(whole) and ")?" in wrapper.expression(whole)
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = {i: "Head\n" + "\n".join(f"text {i} {k} with some words" for k in range(1 + i % 3)) for i, _, _ in pages}
    for parts in (1, 7):
        assert {r.row.page_id: r.text for r in wrapper.main_texts(df.repartition(parts)).collect()} == want


@pytest.mark.parametrize("n", [7, 8, 24])
def test_what_all_pages_of_a_host_share_stays_in_the_article(spark, n):
    pages = [(i, f"http://h.example/{i}", page(f"<p>By the editors</p><h2>Part {i}</h2><p>text {i} one</p><p>text {i} two</p>")) for i in range(n)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = {i: f"Head\nBy the editors\nPart {i}\ntext {i} one\ntext {i} two" for i in range(n)}
    assert {r.row.page_id: r.text for r in wrapper.main_texts(df).collect()} == want


class Marked(html.parser.HTMLParser):
    """What stands between <article> and </article> of the pages of the test tables, by blocks: a plain reading for comparison."""

    def __init__(self):
        super().__init__()
        self.inside, self.lines, self.held = False, [], []

    def cut(self):
        line = " ".join("".join(self.held).split())
        self.lines += [line] if line else []
        self.held = []

    def handle_starttag(self, tag, attrs):
        if tag in ("article", "h1", "p"):
            self.cut()
            self.inside |= tag == "article"
        elif tag == "br":
            self.held.append(" " if self.inside else "")

    def handle_endtag(self, tag):
        if tag in ("article", "h1", "p"):
            self.cut()
            self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.held.append(data)


def test_articles_of_the_tables(spark):
    sf_dir = SF.replace("0.001", "0.01")
    want = {}
    for r in table(spark, sf_dir, "pages").collect():
        reader = Marked()
        reader.feed(r.html)
        reader.close()
        reader.cut()
        want[r.page_id] = "\n".join(reader.lines)
    got = {r.page_id: r.text for r in queries.queries()["op10_main_text"](spark, sf_dir).collect()}
    assert np.mean([got[i] == t for i, t in want.items()]) == 1


def test_articles_without_telling_names(spark):
    """Hosts whose pages say nothing by names: the wrapper must find the article by what varies."""
    r = random.Random(7)
    say = lambda n: " ".join(r.choice(("river", "stone", "garden", "window", "letter", "morning", "of", "the")) for _ in range(n))
    frames = [
        lambda t: f"<ul><li><a href=/>Home page</a><li><a href=/n>All the news</a></ul><div>{t}</div><center>{'All rights are reserved by the owner of this place. ' * 9}</center>",
        lambda t: f"<div class=x1><p><a href=/>One</a><br><a href=/2>Two</a></p></div><div class=q>{t}</div><div class=r>{'The owner of this place says this everywhere. ' * 9}</div>",
        lambda t: f"<div class=a><div class=b><a href=/>Start</a></div><div class=c>{t}<ul><li><a href=/x>More of this</a><li><a href=/y>More of that</a></ul></div></div>",
    ]
    pages, want = [], {}
    for h, frame in enumerate(frames):
        for i in range(9):
            blocks = [say(30 + r.randrange(40)) for _ in range(2 + i % 4)]
            pages.append((100 * h + i, f"http://h{h}.example/{i}", "<html><body>" + frame(f"<h2>Summary</h2>{''.join(f'<p>{b}</p>' for b in blocks)}") + "</body></html>"))
            want[100 * h + i] = "\n".join(["Summary", *blocks])
    got = {x.row.page_id: x.text for x in wrapper.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {i for i in want if got[i] != want[i]} == set()


def test_pages_of_any_depth_and_width(spark):
    deep = "<div>" * 3000 + "<p>at the bottom</p>" + "</div>" * 3000
    wide = "".join(f"<div class=c{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}>part {k} of many words</div>" for k in range(3000))
    pages = [(1, "http://deep.example/", deep), (2, "http://wide.example/1", wide), (3, "http://wide.example/2", wide[: len(wide) // 2]), (4, "http://wide.example/3", "<p>another kind of page here</p>")]
    got = {x.row.page_id: x.text for x in wrapper.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[1] == "at the bottom" and got[2] == "\n".join(f"part {k} of many words" for k in range(3000)) and got[4] == "another kind of page here"
    page = wrapper.parse(wide)
    whole = wrapper.merge(wrapper.wrap(page), wrapper.wrap(wrapper.parse(wide[: len(wide) // 2])))
    assert len(whole[wrapper.CHILDREN]) <= wrapper.MOST_CHILDREN
