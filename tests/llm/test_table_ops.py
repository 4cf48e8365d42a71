"""Mixing, sharding, nearest neighbours, WebP, and the pipeline."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkscope.llm import ann, mixing, queries, sharding, webp


def docs_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("part", F.lit(1))


def some_docs(n=400, seed=1):
    r = random.Random(seed)
    rows = [(k, " ".join(["w"] * r.randint(0, 40)) if k % 11 else None, "hot" if k % 3 == 0 else r.choice(["a", "b", "é", None])) for k in range(n)]
    return rows + [(5, rows[5][1], rows[5][2])] * 3


# -- mixing -------------------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= {*over}
        if not open_:
            return out


def test_mixing(spark, monkeypatch):
    rows = some_docs()
    df = docs_frame(spark, rows)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (4, 0), (None, 1), (7, None)], "doc_id long, quality int")
    source = {}
    for k, t, s in rows:
        source[k] = s
    results = []
    for bucket in (4_096, 7):
        monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
        results.append(sorted(tuple(r) for r in mixing.mix(df, labels).collect()))
    assert results[0] == results[1]  # buckets steer work, not results
    sizes = {}
    for k, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    taken = {}
    for k, size, total, target, got in results[0]:
        s = source[k]
        assert total == sizes[s] and math.isclose(target, want[s]) and 0 <= got <= 2 * size
        taken[s] = taken.get(s, 0) + got
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    for s in sizes:  # whole epochs, then a prefix of the keys, one document in part
        own = [(size, got) for k, size, _, _, got in results[0] if source[k] == s and size]
        epochs = min(g // n for n, g in own)
        extra = [(n, g - epochs * n) for n, g in own]
        assert sum(0 < e < n for n, e in extra) <= 1 and all(e <= n for n, e in extra)


def test_mixing_edges(spark):
    assert mixing.mix(docs_frame(spark, [(1, "a", "x")]).where("false")).count() == 0
    only = [(1, None, None), (2, "", None)]
    assert [(r.size, r.taken) for r in mixing.mix(docs_frame(spark, only)).collect()] == [(0, 0), (0, 0)]


def test_quality_weights(spark):
    """Labelled documents are drawn more often, over many ids."""
    rows = [(k, "w " * 10, "a" if k < 3_000 else "b") for k in range(6_000)]
    labels = spark.createDataFrame([(k, int(k % 2)) for k in range(6_000)], "doc_id long, quality int")
    got = mixing.mix(docs_frame(spark, rows), labels, share=0.5).where("doc_id >= 3000").collect()
    good, poor = (sum(r.taken for r in got if r.doc_id % 2 == q) for q in (1, 0))
    assert good > 1.5 * poor


# -- sharding -----------------------------------------------------------------------------------


def test_sharding(spark, monkeypatch):
    rows = some_docs(1_000)
    df = docs_frame(spark, rows)
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 50)
    got = sharding.interleave(df).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    shards = {s: sorted(r.slot for r in got if r.shard == s) for s in range(8)}
    assert all(v == list(range(len(v))) for v in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    text, source = {k: t or "" for k, t, _ in rows}, {k: s for k, _, s in rows}
    for r in got:
        data = text[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
    for s in {*source.values()}:  # every shard matches the mixture
        per = [sum(source[r.doc_id] == s for r in got if r.shard == k) for k in range(8)]
        assert max(per) - min(per) <= 2
    # ranks against brute force: one window over everything
    again = sharding.interleave(df).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 10**6)
    assert sorted(map(tuple, sharding.interleave(df).collect())) == sorted(map(tuple, got))
    plan = sharding.interleave(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sharding_edges(spark):
    assert sharding.interleave(docs_frame(spark, [(1, "a", "x")]).where("false")).count() == 0
    got = sharding.interleave(docs_frame(spark, [(None, None, None), (1, "é", "x")])).collect()
    assert sorted((r.size, r.slot) for r in got) == [(1, 0), (3, 0)]


# -- neighbours ----------------------------------------------------------------------------------


def test_ann_recall(spark):
    r = np.random.default_rng(2)
    v = r.normal(size=(1_500, 16)).astype(np.float32) * r.uniform(0.5, 2, (1_500, 1)).astype(np.float32)
    v[100:400] = v[7]  # a large group of copies
    rows = [(k, [float(x) for x in row]) for k, row in enumerate(v)]
    rows += [(2_000, None), (2_001, [0.0] * 16), (2_002, [float("nan")] * 16), (2_003, [None] + [1.0] * 15), (2_004, [1.0, 2.0]), (2_005, [2.0, 1.0]), (20, rows[20][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(df, df.where("vec_id % 20 = 0"), k=10).toPandas()
    good = [(k, x) for k, x in rows[:1_500]]
    import pandas as pd

    base = pd.DataFrame(good, columns=["vec_id", "embedding"])
    want = ann.exact(base, base[base.vec_id % 20 == 0], 10)
    assert {*got.query_id} == {*want}
    hits = 0
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        assert [*part["rank"]] == [*range(1, len(part) + 1)] and q not in {*part.id}
        assert [*part.score] == sorted(part.score, reverse=True)
        exact = [float((np.float64(v[q]) * np.float64(v[i])).sum()) for i in part.id]
        assert np.allclose(exact, part.score, rtol=1e-12)
        hits += len({*part.id} & {*want[q]})
    assert hits >= 0.95 * 10 * len(want)
    copies = got[got.query_id == 120].sort_values("rank")
    assert [*copies.id] == want[120]  # ties go to the smaller id
    assert ann.search(df.where("false"), df.where("false")).count() == 0
    pair = ann.search(df.where("vec_id >= 2004"), df.where("vec_id = 2004")).collect()
    assert [(r.id, r.score) for r in pair] == [(2_005, 4.0)]


# -- WebP ----------------------------------------------------------------------------------------


class Writer:
    """A bit writer with canonical codes, independent of the module under test."""

    def __init__(self):
        self.bits: list[int] = []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n)]

    def code(self, lengths, alphabet):
        """Declare a code by its lengths, each written in four bits; give its words."""
        self.put(0, 1)
        self.put(15, 4)
        order = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
        for s in order:
            self.put(4 if s < 16 else 0, 3)
        self.put(0, 1)
        for s in range(alphabet):
            self.bits += [int(b) for b in f"{lengths.get(s, 0):04b}"]
        words, code, before = {}, 0, 0
        for s in sorted(lengths, key=lambda s: (lengths[s], s)):
            code <<= lengths[s] - before
            before = lengths[s]
            words[s] = f"{code:0{before}b}"
            code += 1
        return words

    def symbol(self, words, s):
        self.bits += [int(b) for b in words[s]]

    def single(self, s):
        self.put(1, 1)
        self.put(0, 1)
        self.put(1, 1)
        self.put(s, 8)

    def bytes(self):
        bits = self.bits + [0] * (-len(self.bits) % 8)
        return bytes(sum(b << k for k, b in enumerate(bits[i : i + 8])) for i in range(0, len(bits), 8))


def skewed(symbols):
    """Lengths 1, 2, 3, ... over the symbols."""
    symbols = list(symbols)
    return {s: min(k + 1, len(symbols) - 1) for k, s in enumerate(symbols)}


def head(w, width, height):
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(0, 4)


def put_pixels(w, pixels, extra=(), distances=(0, 1), actions=None, cache_bits=0, main=True):
    """An entropy-coded image of literals, or of the given actions."""
    flat = [int(p) for p in np.asarray(pixels).ravel()]
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(0, 1)
    channel = lambda shift: sorted({p >> shift & 255 for p in flat} | {0, 1})
    alphabet = 280 + (1 << cache_bits if cache_bits else 0)
    codes = [w.code(skewed([*channel(8), *extra]), alphabet)] if len({*channel(8), *extra}) <= 14 else [w.code({s: 9 for s in range(512)} if alphabet >= 512 else balanced(alphabet), alphabet)]
    codes += [w.code(skewed(c) if len(c) <= 14 else balanced(256), 256) for c in (channel(16), channel(0), channel(24))]
    codes.append(w.code(skewed([*distances]) if len(distances) > 2 else {d: 1 for d in distances}, 40))
    for act in actions if actions is not None else [("p", p) for p in flat]:
        if act[0] == "p":
            for words, shift in zip(codes, (8, 16, 0, 24)):
                w.symbol(words, act[1] >> shift & 255)
        elif act[0] == "copy":
            _, symbol, more, n, distance, dmore, dn = act
            w.symbol(codes[0], 256 + symbol)
            w.put(more, n)
            w.symbol(codes[4], distance)
            w.put(dmore, dn)
        else:
            w.symbol(codes[0], 280 + act[1])


def balanced(n):
    """A complete code over n symbols with two lengths."""
    size = (n - 1).bit_length()
    short = (1 << size) - n
    return {s: size - 1 if s < short else size for s in range(n)}


def random_pixels(r, height, width, colours=6):
    table = r.integers(0, 1 << 32, colours, dtype=np.uint64).astype(np.uint32)
    return table[r.integers(0, colours, (height, width))]


def channels(p):
    return [p >> s & 255 for s in (24, 16, 8, 0)]


def pack(c):
    return c[0] << 24 | c[1] << 16 | c[2] << 8 | c[3]


def predict(mode, img, y, x):
    """Predicted channels by the format's definition, one pixel at a time."""
    h, w = len(img), len(img[0])
    if y == 0:
        return [255, 0, 0, 0] if x == 0 else channels(img[0][x - 1])
    if x == 0:
        return channels(img[y - 1][0])
    L, T, TL = channels(img[y][x - 1]), channels(img[y - 1][x]), channels(img[y - 1][x - 1])
    TR = channels(img[y - 1][x + 1] if x + 1 < w else img[y][0])
    avg = lambda a, b: [(i + j) // 2 for i, j in zip(a, b)]
    clamp = lambda v: max(0, min(255, v))
    if mode == 11:
        p = [a + b - c for a, b, c in zip(L, T, TL)]
        return L if sum(abs(i - j) for i, j in zip(p, L)) < sum(abs(i - j) for i, j in zip(p, T)) else T
    if mode == 12:
        return [clamp(a + b - c) for a, b, c in zip(L, T, TL)]
    if mode == 13:
        return [clamp(m + int((m - c) / 2)) for m, c in zip(avg(L, T), TL)]
    return [[255, 0, 0, 0], L, T, TR, TL, avg(avg(L, TR), T), avg(L, TL), avg(L, T), avg(TL, T), avg(T, TR), avg(avg(L, TL), avg(T, TR))][mode]


def test_webp_literals_and_references():
    r = np.random.default_rng(1)
    img = random_pixels(r, 7, 9)
    w = Writer()
    head(w, 9, 7)
    w.put(0, 1)
    put_pixels(w, img)
    assert (webp.decode_vp8l(w.bytes()) == img).all()
    row = [int(p) for p in img.ravel()[:9]]
    # nine literals, a copy of 20 from one row up (distance code 1), the rest by the pixel before (code 2)
    w = Writer()
    head(w, 9, 7)
    w.put(0, 1)
    copies = [("copy", 8, 3, 3, 0, 0, 0), ("copy", 9, 9, 3, 1, 0, 0)]  # prefix 8: 17 + 3; prefix 9: 25 + 7 (clipped below)
    copies[1] = ("copy", 10, 1, 4, 1, 0, 0)  # prefix 10: 33 + 1
    put_pixels(w, img.ravel()[:9], extra=(256 + 8, 256 + 10), actions=[("p", p) for p in row] + copies)
    out = webp.decode_vp8l(w.bytes()).ravel().tolist()
    want = list(row)
    for _ in range(20):
        want.append(want[-9])
    for _ in range(34):
        want.append(want[-1])
    assert out == want
    assert webp.NEAR[:6] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0)] and len(webp.NEAR) == 120 and webp.NEAR[-1] == (8, 7)


def test_webp_cache():
    r = np.random.default_rng(2)
    img = random_pixels(r, 4, 8, 3).ravel()
    bits = 4
    cache, actions = {}, []
    for p in map(int, img):
        at = (0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - bits)
        actions.append(("cache", at) if cache.get(at) == p else ("p", p))
        cache[at] = p
    assert any(a[0] == "cache" for a in actions)
    w = Writer()
    head(w, 8, 4)
    w.put(0, 1)
    used = sorted({280 + a[1] for a in actions if a[0] == "cache"})
    put_pixels(w, img, extra=used, actions=actions, cache_bits=bits)
    assert (webp.decode_vp8l(w.bytes()).ravel() == img).all()


@pytest.mark.parametrize("mode", range(14))
def test_webp_predictors(mode):
    r = np.random.default_rng(mode)
    img = [[int(p) for p in row] for row in r.integers(0, 1 << 32, (9, 11), dtype=np.uint64)]
    residual = [[pack([(a - b) & 255 for a, b in zip(channels(img[y][x]), predict(mode, img, y, x))]) for x in range(11)] for y in range(9)]
    w = Writer()
    head(w, 11, 9)
    w.put(1, 1)
    w.put(0, 2)
    w.put(0, 3)  # blocks of four
    put_pixels(w, np.full((3, 3), 0xFF000000 | mode << 8, np.uint32), main=False)
    w.put(0, 1)
    put_pixels(w, np.array(residual, np.uint64).astype(np.uint32))
    assert (webp.decode_vp8l(w.bytes()) == np.array(img, np.uint64).astype(np.uint32)).all()


def test_webp_colour_and_green():
    r = np.random.default_rng(3)
    img = r.integers(0, 1 << 32, (6, 10), dtype=np.uint64).astype(np.uint32)
    elements = r.integers(0, 1 << 24, (2, 3), dtype=np.uint64).astype(np.uint32) | np.uint32(0xFF000000)
    signed = lambda v: v - 256 if v > 127 else v
    coded = np.zeros_like(img)
    for y in range(6):
        for x in range(10):
            a, red, green, blue = channels(int(img[y, x]))
            red, blue = (red - green) & 255, (blue - green) & 255  # subtract green, then cross-colour
            _, red_blue, green_blue, green_red = channels(int(elements[y >> 2, x >> 2]))
            delta = lambda t, c: signed(t) * signed(c) >> 5
            coded[y, x] = pack([a, (red - delta(green_red, green)) & 255, green, (blue - delta(green_blue, green) - delta(red_blue, red)) & 255])
    w = Writer()
    head(w, 10, 6)
    w.put(1, 1)
    w.put(2, 2)
    w.put(1, 1)
    w.put(1, 2)
    w.put(0, 3)
    put_pixels(w, elements, main=False)
    w.put(0, 1)
    put_pixels(w, coded)
    assert (webp.decode_vp8l(w.bytes()) == img).all()


@pytest.mark.parametrize("colours", [2, 3, 11, 40])
def test_webp_palette(colours):
    r = np.random.default_rng(colours)
    table = np.unique(r.integers(0, 1 << 32, colours, dtype=np.uint64)).astype(np.uint32)
    index = r.integers(0, len(table), (5, 13))
    pack_bits = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    depth, per = 8 >> pack_bits, 1 << pack_bits
    rows = [[sum(int(i) << (k * depth) for k, i in enumerate(row[x : x + per])) << 8 for x in range(0, 13, per)] for row in index]
    deltas, before = [], [0] * 4
    for p in map(int, table):
        deltas.append(pack([(a - b) & 255 for a, b in zip(channels(p), before)]))
        before = channels(p)
    w = Writer()
    head(w, 13, 5)
    w.put(1, 1)
    w.put(3, 2)
    w.put(len(table) - 1, 8)
    put_pixels(w, np.array([deltas], np.uint64).astype(np.uint32), main=False)
    w.put(0, 1)
    put_pixels(w, np.array(rows, np.uint32))
    assert (webp.decode_vp8l(w.bytes()) == table[index]).all()


def test_webp_groups():
    """Two prefix-code groups chosen by an entropy image."""
    w = Writer()
    head(w, 8, 4)
    w.put(0, 1)
    w.put(0, 1)  # no cache
    w.put(1, 1)  # groups
    w.put(0, 3)  # blocks of four
    put_pixels(w, np.array([[0xFF000000, 0xFF000100]], np.uint32), main=False)
    for green in (7, 9):
        for s in (green, 1, 2, 255):
            w.single(s)
        w.single(0)
    got = webp.decode_vp8l(w.bytes())
    assert (got[:, :4] == 0xFF010702).all() and (got[:, 4:] == 0xFF010902).all()


def test_webp_store():
    r = random.Random(4)
    cases = [b"", b" " * 192, bytes(range(256)) * 3, b"ab" * 96, "é".encode() * 500, bytes(r.choices(range(256), k=192 * 50))]
    for raw in cases:
        stored = webp.store(raw)
        back, images = webp.fetch(stored)
        assert back == raw and webp.store(raw) == stored
        assert webp.decode(stored).shape[1] == 64 and images[0].dtype == np.uint8
    wide = b"abc" * (64 * 16_384 + 64)
    assert webp.fetch(webp.store(wide))[0] == wide and webp.decode(webp.store(wide)).shape[0] <= 16_384
    for bad in (b"", b"RIFF\0\0\0\0WEBP", webp.store(b"x")[:40], b"RIFF" + b"\xff" * 20):
        with pytest.raises((webp.FormatError, KeyError)):
            webp.decode(bad)


class PlainReader:
    """A second decoder, bit by bit and pixel by pixel, sharing nothing with the module under test."""

    def __init__(self, data):
        self.bits = "".join(f"{b:08b}"[::-1] for b in data)
        self.at = 0

    def take(self, n):
        part = self.bits[self.at : self.at + n]
        assert len(part) == n
        self.at += n
        return int(part[::-1] or "0", 2)

    def code(self, alphabet):
        if self.take(1):
            n = self.take(1) + 1
            used = [self.take(8 if self.take(1) else 1)]
            used += [self.take(8)] if n == 2 else []
            return {"" if n == 1 else str(k): s for k, s in enumerate(sorted(used))}
        order = [17, 18, 0, 1, 2, 3, 4, 5, 16, *range(6, 16)]
        small = [0] * 19
        for s in order[: self.take(4) + 4]:
            small[s] = self.take(3)
        inner, lengths, last = self.canonical(small), [], 8
        left = 2 + self.take(2 + 2 * self.take(3)) if self.take(1) else alphabet
        while len(lengths) < alphabet and left:
            left -= 1
            s = self.symbol(inner)
            last = s if 0 < s < 16 else last
            lengths += [s] if s < 16 else [last] * (3 + self.take(2)) if s == 16 else [0] * (3 + self.take(3)) if s == 17 else [0] * (11 + self.take(7))
        return self.canonical(lengths)

    @staticmethod
    def canonical(lengths):
        used = sorted((n, s) for s, n in enumerate(lengths) if n)
        if len(used) == 1:
            return {"": used[0][1]}
        out, code, size = {}, -1, 0
        for n, s in used:
            code = code + 1 << n - size
            size = n
            out[f"{code:0{n}b}"] = s
        return out

    def symbol(self, code):
        word = ""
        while word not in code:
            word += self.bits[self.at]
            self.at += 1
        return code[word]

    def number(self, s):
        return s + 1 if s < 4 else (2 + s % 2 << (s - 2 >> 1)) + self.take(s - 2 >> 1) + 1

    def image(self, w, h, main):
        cache_bits = self.take(4) if self.take(1) else 0
        assert not main or not self.take(1)
        codes = [self.code(280 + (1 << cache_bits if cache_bits else 0))] + [self.code(n) for n in (256, 256, 256, 40)]
        near = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
        out, cache, self.refs, self.cached = [], {}, 0, 0

        def add(p):
            out.append(p)
            if cache_bits:
                cache[(p * 0x1E35A7BD & 0xFFFFFFFF) >> 32 - cache_bits] = p

        while len(out) < w * h:
            s = self.symbol(codes[0])
            if s < 256:
                r, b, a = (self.symbol(c) for c in codes[1:4])
                add(a << 24 | r << 16 | s << 8 | b)
            elif s < 280:
                n, d = self.number(s - 256), self.number(self.symbol(codes[4]))
                d = d - 120 if d > 120 else max(1, near[d - 1][0] + near[d - 1][1] * w)
                self.refs += 1
                for _ in range(n):
                    add(out[-d])
            else:
                self.cached += 1
                add(cache[s - 280])
        return out

    def picture(self):
        assert self.take(8) == 0x2F
        w, h = self.take(14) + 1, self.take(14) + 1
        self.take(4)
        undo, wide = [], w
        while self.take(1):
            kind = self.take(2)
            if kind < 2:
                bits = self.take(3) + 2
                across = (wide + (1 << bits) - 1) >> bits
                undo.append((kind, bits, across, self.image(across, (h + (1 << bits) - 1) >> bits, False)))
            else:
                assert kind == 3
                n = self.take(8) + 1
                steps, table = self.image(n, 1, False), [0]
                for p in steps:
                    table.append(sum(((table[-1] >> k & 255) + (p >> k & 255) & 255) << k for k in (0, 8, 16, 24)))
                pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
                undo.append((3, pack, wide, table[1:]))
                wide = wide + (1 << pack) - 1 >> pack
        self.kinds = [u[0] for u in undo]
        px = self.image(wide, h, True)
        split = lambda p: [p >> k & 255 for k in (24, 16, 8, 0)]
        signed = lambda v: v - 256 if v > 127 else v
        for kind, bits, across, data in reversed(undo):
            if kind == 3:
                depth = 8 >> bits
                px = [data[(px[y * wide + (x >> bits)] >> 8 & 255) >> (x % (1 << bits)) * depth & (1 << depth) - 1] for y in range(h) for x in range(w)]
            elif kind == 1:
                for i, p in enumerate(px):
                    a, r, g, b = split(p)
                    _, rb, gb, gr = split(data[(i // w >> bits) * across + (i % w >> bits)])
                    r = r + (signed(gr) * signed(g) >> 5) & 255
                    b = b + (signed(gb) * signed(g) >> 5) + (signed(rb) * signed(r) >> 5) & 255
                    px[i] = a << 24 | r << 16 | g << 8 | b
            else:
                for i, p in enumerate(px):
                    x, y = i % w, i // w
                    mode = data[(y >> bits) * across + (x >> bits)] >> 8 & 15
                    by = 0xFF000000 if not i else px[i - 1] if not y else px[i - w] if not x else {0: 0xFF000000, 1: px[i - 1], 2: px[i - w], 4: px[i - w - 1]}[mode]
                    px[i] = sum((u + v & 255) << k for u, v, k in zip(split(p), split(by), (24, 16, 8, 0)))
        return w, h, px


def test_webp_store_by_a_second_decoder():
    """The stored form uses what the method names, and another decoder reads the same pixels."""
    r = random.Random(11)
    prose = " ".join("".join(r.choices("etaoinshrdlu", k=r.randint(1, 9))) for _ in range(700)).encode()
    raws = [b" " * 192, b"ab c" * 600, prose, prose + prose[: 192 * 8], bytes(r.choices(b"abc", k=4_000)), bytes((k // 192 * 7 + k % 3 * 90) % 256 for k in range(192 * 70)), bytes(range(256)) * 40, ("é日本 " * 900).encode()]
    raws.append(b"".join(bytes([x, (x * 3) % 256, (x * 5) % 256]) for x in (r.randrange(256) for _ in range(2_000))))
    raws.append(b"".join(r.choices([bytes(r.randrange(256) for _ in range(3)) for _ in range(400)], [20] * 60 + [1] * 340, k=4_000)))
    kinds, refs, cached = set(), 0, 0
    for raw in raws:
        payload = raw + b" " * (-len(raw) % 192)
        stored = webp.store(payload)
        found, _ = webp.chunks(stored)
        reader = PlainReader(found[b"VP8L"])
        w, h, px = reader.picture()
        assert b"".join(bytes([p >> 16 & 255, p >> 8 & 255, p & 255]) for p in px)[: len(payload)] == payload and all(p >> 24 == 255 for p in px)
        assert (webp.decode(stored).ravel() == np.array(px, np.uint32)).all() and (w, h) == (64, max(1, -(-len(payload) // 192)))
        kinds |= {*reader.kinds}
        refs, cached = refs + reader.refs, cached + reader.cached
    assert kinds == {0, 1, 3} and refs and cached


def test_webp_code_lengths():
    """Codes are complete and short enough for any counts, and best where no code is too long."""
    r = np.random.default_rng(5)
    cases = [np.array([1] * 400 + [2] * 136), np.array([1] * 535 + [500]), 2 ** np.arange(30), r.integers(0, 3, 536), r.zipf(1.3, 536), np.array([0, 7, 0]), np.array([0, 0])]
    for counts in cases:
        symbols, lengths = webp._code_lengths(counts)
        assert lengths.max() <= webp.DEEPEST and (len(symbols) < 2 or (2.0**-lengths).sum() == 1)
        assert len(symbols) < 2 or {*symbols.tolist()} == {*np.flatnonzero(counts).tolist()}


def test_webp_many_rows():
    """A payload of more than one image's rows, and code declarations that come again."""
    raw = bytes(random.Random(3).choices(b"some text of letters  ", k=192 * 16_500))
    stored = webp.store(raw)
    assert webp.fetch(stored)[0] == raw and stored.count(b"VP8L") >= 2


def test_webp_frame(spark):
    rows = [(1, "abc"), (2, None), (3, ""), (4, "abc"), (4, "x" * 70_000), (None, "é" * 96)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("feature", F.lit(1))
    got = webp.media(df, keep_bytes=True).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_bytes): r for r in got}
    assert by[1, 3].payload_sha256 == by[4, 3].payload_sha256 and by[1, 3].media_sha256 == by[4, 3].media_sha256
    assert by[2, 0].payload_bytes == 192 == by[3, 0].payload_bytes and by[None, 192].payload_bytes == 192
    for r in got:
        text = next(t for k, t in rows if k == r.doc_id and len((t or "").encode()) == r.n_bytes) or ""
        payload, _ = webp.payload_of(text)
        assert webp.fetch(bytes(r.media))[0] == payload and r.tail_crc32 == zlib.crc32(payload[-16:]) and r.media_bytes == len(r.media)
    assert webp.media(df.where("false")).count() == 0


# -- pipeline -------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(9)
    en, fr = "the cat sat on a mat and then ran far away from all of them".split(), "le chat est sur la table et puis la fille part loin de tous".split()
    rows = []
    for k in range(120):
        words = r.choices(en if k % 2 else fr, k=r.randint(60, 120))
        text = " ".join(words) + ("\nsubscribe to our letter" if k % 3 else "")
        rows.append((k, text, "en" if k % 2 else "fr", "s%d" % (k % 4), len(text)))
    rows += [(500, rows[3][1], "en", "s0", 1), (501, "123 456", "en", "s1", 7), (502, None, None, "s2", None), (503, "x " + rows[8][1], "fr", "s0", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        kept[k] = docs.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    assert {x.doc_id for x in kept[0]} == {k for k, *_ in rows} - {501, 502}
    assert not any("subscribe" in x.text for x in kept[1]) and all(x.n_chars == len(x.text) for x in kept[1])
    ids = [x.doc_id for x in kept[2]]
    assert len(ids) == len({*ids}) and 500 not in ids and {3, 8} <= {*ids}
    assert {x.doc_id for x in kept[3]} <= {*ids} and {x.text for x in kept[3]} <= {x.text for x in kept[2]}
    assert len(kept[4]) == len(kept[3]) and {x.doc_id for x in kept[4]} == {x.doc_id for x in kept[3]}
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, kept[4]))


def test_lines_of_a_large_source(spark):
    """A line on 3% of a large source goes; a rare line and the texts beside it stay."""
    import corpus_pipeline

    own = lambda k: f"line of {k}\n\nand  more of {k} "
    texts = [own(k) + ("\nread our letter" if k % 33 == 0 else "") + ("\na rare line" if k % 150 == 0 else "") for k in range(1_000)]
    rows = [(k, t, "en", "big", len(t)) for k, t in enumerate(texts)] + [(2_000, "read our letter", "en", "small", 15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert got == {k: t.replace("\nread our letter", "") for k, t, *_ in rows}


def test_rows_without_an_id_of_their_own(spark, tmp_path):
    """Null and repeated ids: every row is mixed by its own plan, once."""
    import corpus_pipeline

    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, "no id %d" % k, "en", "a", 7) for k in range(4)] + [(7, "shared id %d" % k, None, "a", 11) for k in range(4)] + [(9, "equal row here", "en", None, 14)] * 4
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, kind)
    assert corpus_pipeline.near_dedup(spark, docs.where("doc_id = 7"), "").count() == 4
    got = [tuple(r) for r in corpus_pipeline.mixing_stage(spark, docs, str(tmp_path)).collect()]
    plan = mixing.mix(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).where("taken > 0").collect()
    want = {k: sum(math.ceil(r.taken / r.size) for r in plan if r.doc_id == k) for k in (None, 7, 9)}
    assert {k: sum(r[0] == k for r in got) for k in want} == want and all(want.values())
    assert {*got} <= {*rows} and len({*got}) == len({*rows})


def test_registry():
    assert sorted(queries.QUERIES) == sorted(f"op{n}_{x}" for n, x in enumerate("pii simhash langid substrings line_dedup mixing ann bpe sharding webp".split(), 1))


def test_webp_literals_of_a_stretch_together(monkeypatch):
    """Literals measured by stretches are those read one by one, at any stretch, and take less time."""
    import time

    r = random.Random(19)
    vocabulary = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 9))) for _ in range(3_000)]
    for n in (120, 900, 30_000):
        text = " ".join(r.choice(vocabulary) for _ in range(n)) + "again and again " * 20
        payload = webp.payload_of(text)[0]
        stored = webp.store(payload)
        for stretch in (1, 7, 100, 1 << 15):
            monkeypatch.setattr(webp, "STRETCH", stretch)
            assert webp.fetch(stored)[0] == payload
        for cut in (3, 40, len(stored) // 3):
            image = webp.chunks(stored)[0][b"VP8L"]
            with pytest.raises(webp.FormatError):
                webp.decode_vp8l(image[: len(image) - cut])

    def least_time():
        spent = []
        for _ in range(5):
            begin = time.process_time()
            pixels = webp.decode_vp8l(image)
            spent.append(time.process_time() - begin)
        return min(spent), pixels

    together, pixels = least_time()
    monkeypatch.setattr(webp, "_stretches", lambda bits, group, width, height: webp._one_group(bits, group, width, height, 0))
    singly, same = least_time()
    assert (pixels == same).all() and together < 0.8 * singly, (together, singly)
