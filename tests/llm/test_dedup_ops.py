"""SimHash, suffix-array dedup, line dedup."""

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from inkscope.llm import components, induced, linededup, neardup, simhash, substrings


def union(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 420)] + [(5, 5)]
    got = {x.node: x.root for x in components.roots(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    want = union(edges, {n for e in edges for n in e})
    assert got == {n: want[n] for n in nodes}
    assert components.roots(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_fingerprint(text, n=3):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", lower) if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    texts = [None, "", " \n", "one", "one two", "Ä B c", "a b c d e f a b c", "x " * 500, "A\x0bB\x0cC\xa0D e"]
    assert [simhash.fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]
    assert [simhash.fingerprint(t, 5) for t in texts] == [brute_fingerprint(t, 5) for t in texts]


def test_links_lose_none(spark):
    """All pairs within three bits are connected, by halves and by whole balls alike."""
    r = random.Random(5)
    prints = {0, (1 << 64) - 1}
    for _ in range(60):
        base = r.getrandbits(64)
        for _ in range(r.randint(1, 6)):
            base ^= sum(1 << b for b in r.sample(range(64), r.randint(0, 4)))
            prints.add(base)
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    want = union([(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3], signed)
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    for crowd in (1, 2, 1_000):
        pairs = [(x.a, x.b) for x in simhash.links(df, crowd).collect()]
        assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 and a < b for a, b in pairs)
        assert union(pairs, signed) == want


def test_block_links_lose_none(spark, monkeypatch):
    r = random.Random(15)
    prints = {0, (1 << 64) - 1}
    for _ in range(50):
        base = r.getrandbits(64)
        for _ in range(r.randint(1, 8)):
            base ^= sum(1 << b for b in r.sample(range(64), r.randint(0, 10)))
            prints.add(base)
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    for radius in (2, 5, 8, 11):
        want = union([(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= radius], signed)
        pairs = [(x.a, x.b) for x in simhash.block_links(df, radius).collect()]
        assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= radius and a < b for a, b in pairs)
        assert union(pairs, signed) == want
    balls = [simhash._block_ball(k, lo, hi) for k, (lo, hi) in enumerate(((0, 21), (21, 42), (42, 64)))]
    keys = df.limit(1).select("fp", F.concat(*balls).alias("k")).first()
    assert len(keys.k) == len({*keys.k}) == 67 and sorted(x >> 56 for x in keys.k) == [0] * 22 + [1] * 22 + [2] * 23
    assert keys.k[0] == keys.fp & (1 << 21) - 1 and keys.k[1] == keys.k[0] ^ 1
    near = np.array([b ^ 5 for b in range(400)] + [31 << 40], np.int64)  # one large bucket
    a, b = simhash._search(near, 3)
    assert len(a) == len(b) <= len(near) and {*union(zip(a.tolist(), b.tolist()), near.tolist()).values()} == {0, 31 << 40}
    fp = np.unique(np.random.default_rng(1).integers(0, 1 << 12, 900) << 9)  # dense: small and large buckets
    values = [[(int(f) >> lo & (1 << hi - lo) - 1 | k << 56) for f in fp] for k, (lo, hi) in enumerate(((0, 21), (21, 42), (42, 64)))]
    rows = [(v ^ flip, f) for vs in values for v, f in zip(vs, fp.tolist()) for flip in [0, *(1 << i for i in range(22))]]
    key, fps = (np.array(x, np.int64) for x in zip(*sorted(rows)))
    brute = [(int(x), int(y)) for x in fp for y in fp if x < y and int(x ^ y).bit_count() <= 8]
    for limit in (0, 48, 10**6):
        monkeypatch.setattr(simhash, "SMALL", limit)
        got = simhash._pairs(key, fps, 8).to_pydict()
        assert union(zip(got["a"], got["b"]), fp.tolist()) == union(brute, fp.tolist())


def test_groups(spark):
    body = "the quick brown fox jumps over the lazy dog and runs away from " * 20
    rows = [(9, body, "x"), (3, body, "x"), (4, body + "end", "x"), (7, None, "x"), (2, "", "x"), (8, "other words entirely " * 9, "x"), (8, "other words entirely " * 9, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.groups(df.select("doc_id", "text")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.component_id for r in got}
    assert by[9] == by[3] == 3 and by[7] == by[2] == 2 and by[8] == 8
    prints = {k: brute_fingerprint(t) for k, t, _ in rows}
    want = union([(a, b) for a in prints for b in prints if (prints[a] ^ prints[b]).bit_count() <= 3], prints)
    assert by == want
    assert simhash.groups(df.where("false").select("doc_id", "text")).count() == 0


def jaccard(a, b):
    a, b = ({*neardup.shingle_set(t).tolist()} for t in (a, b))
    return len(a & b) / len(a | b)


def kept_by_stage(spark, texts):
    import corpus_pipeline

    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()}


def test_near_copies_at_the_threshold_are_linked(spark):
    """Copies at 0.80 to 0.84, long and short, all leave."""
    r = random.Random(23)
    words = lambda n: ["w%d" % r.randrange(10**6) for _ in range(n)]
    texts = []
    for n, more in [(300, 70)] * 20 + [(84, 20)] * 20 + [(24, 5)] * 10 + [(8, 1)] * 10:
        base = words(n)
        texts += [" ".join(base), " ".join(base + words(more))]
    assert all(0.8 <= jaccard(a, b) < 0.85 for a, b in zip(texts[::2], texts[1::2]))
    assert kept_by_stage(spark, texts) == {*range(0, len(texts), 2)}


@pytest.mark.parametrize("edits", [3, 9])
def test_large_groups_of_near_copies(spark, edits):
    """Forests of crowded buckets give the components of all pairs, from far fewer of them."""
    r = random.Random(edits)
    texts = []
    for _ in range(3):
        base = ["w%d" % r.randrange(10**6) for _ in range(120)]
        for _ in range(150):
            copy = base[:]
            for _ in range(r.randint(1, edits)):
                copy[r.randrange(len(copy))] = "x%d" % r.randrange(10**6)
            texts.append(" ".join(copy))
    sets = [{*neardup.shingle_set(t).tolist()} for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    want = union(pairs, range(len(texts)))
    assert kept_by_stage(spark, texts) == {*want.values()}
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = neardup.prints(rows).select("node", "sketch").dropDuplicates(["node"])
    found = neardup.candidates(nodes)
    assert found.where("bucket is not null").count() > 0
    assert found.select("a", "b").distinct().count() < 0.5 * 3 * 150 * 149 / 2  # of the pairs within the groups


def test_groups_near_but_not_near_enough_make_few_rows(spark, monkeypatch):
    """Pairs of a large group that meet but mostly stay under 0.8 are verified, yet are no rows of any table."""
    r = random.Random(41)
    base = ["w%d" % r.randrange(10**6) for _ in range(150)]
    texts = []
    for k in range(300):
        copy = base[:]
        for at in r.sample(range(150), 1 if k % 10 == 0 else 4):
            copy[at] = "x%d" % r.randrange(10**6)
        texts.append(" ".join(copy))
    sets = [{*neardup.shingle_set(t).tolist()} for t in texts]
    pairs = [(i, j) for i in range(300) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    want = union(pairs, range(300))
    assert 100 < len({*want.values()}) < 290 and len(pairs) < 0.05 * 300 * 299 / 2
    counts, real = [], neardup.verified

    def counted(pairs, sets):
        counts.append(pairs.count())
        return real(pairs, sets)

    monkeypatch.setattr(neardup, "verified", counted)
    assert kept_by_stage(spark, texts) == {*want.values()}
    assert sum(counts) < 20 * len(texts)


def test_components_of_one_bucket(monkeypatch):
    """Every near pair of a bucket counts, in pieces of any size."""
    rng = np.random.default_rng(7)
    for trial in range(60):
        monkeypatch.setattr(neardup, "ROOM", int(rng.choice([1, 200, 1 << 20])))
        n = int(rng.integers(2, 40))
        core = np.arange(int(rng.integers(3, 25)))
        sets = [np.unique(np.append(rng.choice(core, max(1, len(core) - int(rng.integers(0, 4))), replace=False), rng.integers(100, 110))) for _ in range(n)]
        rows = np.stack([np.full(n, 5), np.arange(n) * 3, rng.integers(0, 1 << 18, n) ** 2, np.zeros(n, np.int64)])
        size = np.array([len(x) for x in sets])
        near = lambda i, j: (int(rows[2, i]) ^ int(rows[2, j])).bit_count() <= neardup.RADIUS
        true = [(i, j) for i in range(n) for j in range(i) if near(i, j) and 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]
        want = union(true, range(n))
        assert neardup._least(rows, np.concatenate(sets), size).tolist() == [want[k] for k in range(n)]


def test_near_fingerprints_alone_drop_nothing(spark):
    """Pairs below 0.8 stay, alone and at the end of a chain of true copies."""
    r = random.Random(29)
    words = lambda n: ["w%d" % r.randrange(10**6) for _ in range(n)]
    texts = []
    for k in range(40):
        base = words(300)
        texts += [" ".join(base), " ".join(base + words(80 + k % 20))]
    assert all(0.7 < jaccard(a, b) < 0.8 for a, b in zip(texts[::2], texts[1::2]))
    assert kept_by_stage(spark, texts) == {*range(len(texts))}
    base = words(100)
    chain = [" ".join(base[k * 8 : k * 8 + 60]) for k in range(4)] + ["short text", "Short  TEXT", "other text"]
    want = union([(a, b) for a in range(7) for b in range(a) if jaccard(chain[a], chain[b]) >= 0.8], range(7))
    assert kept_by_stage(spark, chain) == {*want.values()}


# -- suffix order ----------------------------------------------------------------------------


def test_suffix_order(monkeypatch):
    r = np.random.default_rng(0)
    for trial in range(400):
        monkeypatch.setattr(induced, "BLOCK", int(r.choice([1, 3, 1 << 19])))
        n, depth = int(r.integers(1, 120)), int(r.choice([3, 5, 10, 50]))
        s = r.integers(0, int(r.integers(1, 4)) + 1, n).astype(np.uint8)
        if trial % 3 == 0:
            s = np.tile(s[: max(1, n // 4)], 4)
        if trial % 7 == 0:
            s = np.full(n, 1, np.uint8)
        if trial % 5 == 0:
            s = np.minimum(s.astype(int) * 127, 254).astype(np.uint8)
        order, shared = induced.suffix_order(s, depth, budget=64 if trial % 2 else 1 << 20)  # 64: everything spills
        b = bytes(s)
        assert sorted(order.tolist()) == list(range(len(s)))
        keys = [b[i : i + depth] for i in order]
        assert keys == sorted(keys)
        common = [next((k for k, (x, y) in enumerate(zip(a, c)) if x != y), min(len(a), len(c))) for a, c in zip(keys, keys[1:])]
        assert shared.tolist() == [0, *common]
        starts = np.array([i for i in range(len(s) - depth + 1) if 0 not in b[i : i + depth]], int)
        if len(starts):
            classes = induced.prefix_classes(s, starts, depth)
            seen = defaultdict(set)
            for i, c in zip(starts, classes):
                seen[b[i : i + depth]].add(int(c))
            assert all(len(v) == 1 for v in seen.values()) and len({*classes.tolist()}) == len(seen)


def _check(spark, rows, **sizes):
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), **sizes).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2])
    assert sorted(((r.doc_id, bytes(r.kept), r.n_spans) for r in got), key=key) == sorted(substrings.brute(rows), key=key)
    assert all(r.n_bytes - r.n_removed == len(r.kept) for r in got)
    return got


def test_substrings(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choices("abcdefg é", k=r.randint(2, 8)))
    shared = [" ".join(word() for _ in range(r.randint(8, 30))) for _ in range(6)]
    rows = []
    for k in range(60):
        parts = [" ".join(word() for _ in range(r.randint(1, 25))) for _ in range(3)]
        for s in r.sample(shared, r.randint(0, 3)):
            a = r.randrange(len(s))
            parts.insert(r.randint(0, 3), s[a : a + r.randint(20, 200)])
        rows.append((k, "".join(parts)))
    rows += [(70, None), (None, rows[3][1]), (None, rows[3][1]), (71, ""), (72, rows[5][1][:49]), (73, "a" * 300), (74, "a" * 120), (75, "é" * 80), (75, "é" * 80), (76, "\0" * 60), (77, "\0" * 60), (5, rows[5][1])]
    for sizes in ({}, {"group_bytes": 900, "shard_bytes": 700}):
        assert sum(x.n_removed for x in _check(spark, rows, **sizes))


def test_substrings_empty(spark):
    assert _check(spark, [(1, None), (2, "")]) and not substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect()


# -- lines ------------------------------------------------------------------------------------


def brute_lines(rows, ratio, least):
    pages, held = defaultdict(int), defaultdict(int)
    for _, text, host in rows:
        pages[host or ""] += 1
        for line in {x for x in (text or "").split("\n") if x.strip(" ")}:
            held[host or "", line] += 1
    bad = {k for k, n in held.items() if n >= least and n > ratio * pages[k[0]]}
    out = []
    for key, text, host in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if (host or "", x) not in bad]
        out.append((key, text if len(kept) == len(lines) else "\n".join(kept), len(lines) if text else 0, len(lines) - len(kept)))
    return out


def test_lines(spark):
    r = random.Random(8)
    rows = []
    for k in range(90):
        lines = [f"own {k} {j}" for j in range(r.randint(0, 4))]
        lines += ["menu"] * (r.random() < 0.5) + ["foot"] * (r.random() < 0.15) * 2 + ["", "  "] * (r.random() < 0.3)
        r.shuffle(lines)
        rows.append((k, "\n".join(lines), r.choice(["a", "b", None])))
    rows += [(200, None, "a"), (None, "menu\nx", "a"), (None, "menu\nx", "a"), (201, "", None), (202, "menu\n", "rare")]
    df = spark.createDataFrame(rows, "page_id long, text string, host string").withColumn("line", F.lit("clash"))
    for ratio, least in ((0.2, 5), (0.4, 1)):
        got = linededup.drop_boilerplate(df, F.col("host"), ratio=ratio, least=least).collect()
        show = lambda x: (str(x[0]), str(x[1]), x[2], x[3])
        assert sorted(show((r.page_id, r.text, r.n_lines, r.n_dropped)) for r in got) == sorted(map(show, brute_lines(rows, ratio, least)))
        assert sum(r.n_dropped for r in got)
    assert linededup.drop_boilerplate(df.where("false"), F.col("host")).count() == 0


def test_page_lines(spark):
    html = "<html><script>var a='<p>';</script><p> One <b>two</b></p><!-- no --><style>x</style>\nthree</html>"
    df = spark.createDataFrame([(html, "HTTP://u@Host.EXAMPLE:80/x"), (None, None), ("plain", "//x")], "html string, url string")
    got = [(r.t, r.h) for r in df.select(linededup.visible_lines().alias("t"), linededup.host_of().alias("h")).collect()]
    assert got == [("One\ntwo\nthree", "host.example"), ("", ""), ("plain", "")]


@pytest.mark.parametrize("piece", ["<b>", "<!-- c -->", "\n", "\r\n", "<script>x</script>", "<", "<!--", "<script>", "<style>y</style>", "x <b>"])
def test_very_long_pages(spark, piece):
    """A million tags, comments, line ends or things never closed take constant stack and linear time."""
    n = 1_000_000
    df = spark.createDataFrame([(1, "http://h/", "start " + "<p>one</p>"), (2, "http://h/", "start <p>")], "page_id long, url string, html string")
    df = df.withColumn("html", F.concat("html", F.repeat(F.lit(piece), n), F.lit("<i>end</i>")))
    got = {r.page_id: r for r in df.select("page_id", F.split(linededup.visible_lines(), "\n").alias("x")).select("page_id", F.size("x").alias("n"), F.col("x")[0].alias("a")).collect()}
    assert {r.a.split("<")[0].strip() for r in got.values()} <= {"start", "start x"}
    assert (got[1].n > n) == (piece == "x <b>")


def test_small_hosts(spark):
    """The ratio alone decides for a host of a few pages; a host's only page stays whole."""
    df = spark.createDataFrame([(1, "foot\na", "x"), (2, "foot\nb", "x"), (3, "c", "x"), (4, "foot\nd", "y")], "page_id long, text string, host string")
    assert {r.page_id: r.text for r in linededup.drop_boilerplate(df, F.col("host")).collect()} == {1: "a", 2: "b", 3: "c", 4: "foot\nd"}
