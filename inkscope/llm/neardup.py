"""Near-duplicate documents: wide SimHash finds pairs, shingle sets decide them.

Two texts are near duplicates if the Jaccard similarity of their sets of shingle
hashes is 0.8 or more.  Texts of equal sets are one node.

Candidates come from a SimHash of 384 bits.  Two sets at 0.8 differ in 0.15 of the
bits, far too many for balls, but nearly always in bits whose vote was close.  The
first 340 bits are cut into 20 blocks of 17; every node emits each block with all
flips of its two closest bits, 80 rows.  A pair whose other bits agree in one block
shares a row: of 15,000 drawn pairs right at 0.8 six did not (sets of 41 and 50).
Votes of few shingles are mostly ties, so sets of up to 40 also emit their least
hashes, enough that two such sets at 0.8 must share one.  Pairs that meet are compared on
128 bits, at a radius beyond four deviations of a pair at 0.8.

Every candidate pair is then verified on the two sets; only true edges reach the
components.  Only texts of candidate nodes are read again, one a node.

A bucket in which many pairs meet (a large group of near copies) gives no pairs, but
its members: their sets come to the bucket, and all its pairs between different
components are verified there.  What leaves it is a star for each component, so
the components are those of all pairs while every table of the plan grows in
proportion to the texts: 80 rows a member, and two pairs at most for each row of
any other bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_slices
from .components import roots

WORDS64 = 6
BLOCKS, WIDTH, FLIPS = 20, 17, 2
#: Sets up to this size also emit their least hashes.
SHORT = 40
#: Differing bits of 128 that still make a candidate: of block keys, and of least hashes.
RADIUS, SHORT_RADIUS = 36, 48
#: Buckets beyond this are compared in blocks of rows.
SMALL = 512
#: A bucket of more pairs than this a row is crowded.
MANY = 2
#: Items of sets compared at once.
ROOM = 1 << 20

_SUBSETS = np.array([[m >> i & 1 for i in range(FLIPS)] for m in range(1 << FLIPS)], np.int64)


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles; of all words where they are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    begins = (ends - size).tolist()
    digest = xxhash.xxh64_intdigest
    last = ends[shingle - 1 :].tolist() or [len(line)]
    return np.unique(np.array([digest(line[s:e], 42) for s, e in zip(begins, last)], np.uint64))


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """A further 64 bits of each hash (splitmix64 from seed ``k``)."""
    x = h + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _votes(sets: list[np.ndarray]) -> np.ndarray:
    """Ones less zeros of each of the 384 bits, a row for each set (none empty)."""
    size = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    h = np.concatenate(sets)
    wide = np.stack([_mixed(h, k) for k in range(WORDS64)], 1)
    bits = np.unpackbits(wide.astype(">u8").view(np.uint8).reshape(len(h), -1), axis=1)
    return 2 * np.add.reduceat(bits, starts, axis=0, dtype=np.int32) - size[:, None]


def _sketches(sets: list[np.ndarray]) -> list[bytes]:
    """Of each set: 48 bytes of SimHash, the closest bits of each block, least hashes of a short set."""
    out: list[bytes] = [b""] * len(sets)
    full = [k for k, s in enumerate(sets) if len(s)]
    while full:
        part, held = [], 0
        while full and (not part or held + len(sets[full[-1]]) <= 32_768):
            held += len(sets[full[-1]])
            part.append(full.pop())
        votes = _votes([sets[k] for k in part])
        prints = np.packbits(votes > 0, axis=1)
        close = np.abs(votes[:, : BLOCKS * WIDTH]).reshape(len(part), BLOCKS, WIDTH)
        low = np.argsort(close, axis=2, kind="stable")[:, :, :FLIPS].astype(np.uint8)
        for row, k in enumerate(part):
            n = len(sets[k])
            least = sets[k][: n - -(-4 * n // 5) + 1] if n <= SHORT else sets[k][:0]
            out[k] = prints[row].tobytes() + low[row].tobytes() + least.tobytes()
    return out


def prints(df: DataFrame, shingle: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, h, node, sketch): a hash of the text, of its shingle set, and its sketch."""

    def run(part: pa.RecordBatch) -> dict:
        sets = [shingle_set(t, shingle) for t in part.column(text).to_pylist()]
        node = np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets], np.uint64).view(np.int64)
        return {key: part.column(key), "h": part.column("h"), "node": pa.array(node), "sketch": pa.array(_sketches(sets), pa.binary())}

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, F.xxhash64(text).alias("h"), text)
    return map_slices(rows, run, f"{key} {kind}, h bigint, node bigint, sketch binary", text)


_HEAD = WORDS64 * 8 + BLOCKS * FLIPS


def _variants(batches):
    """(key, node, s0, s1) of nodes: keys of blocks count up from zero, of least hashes are negative."""
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("s0", pa.int64()), ("s1", pa.int64())])
    for batch in batches:
        for begin in range(0, batch.num_rows, 2_000):
            piece = batch.slice(begin, 2_000)
            sketch = piece.column("sketch").to_pylist()
            some = [k for k, s in enumerate(sketch) if s]
            if not some:
                continue
            node = piece.column("node").to_numpy()[some]
            head = np.frombuffer(b"".join(sketch[k][:_HEAD] for k in some), np.uint8).reshape(len(some), -1)
            bits = np.unpackbits(head[:, : WORDS64 * 8], axis=1)[:, : BLOCKS * WIDTH].reshape(len(some), BLOCKS, WIDTH)
            value = bits.astype(np.int64) @ (1 << np.arange(WIDTH, dtype=np.int64))
            flip = np.int64(1) << head[:, WORDS64 * 8 :].reshape(len(some), BLOCKS, FLIPS).astype(np.int64)
            value += np.arange(BLOCKS, dtype=np.int64) << WIDTH
            keys = (value[:, :, None] ^ (flip @ _SUBSETS.T)).reshape(len(some), -1)
            word = np.ascontiguousarray(head[:, :16]).view(np.int64)
            least = [np.frombuffer(sketch[k][_HEAD:], np.int64) for k in some]
            row = np.concatenate([np.repeat(np.arange(len(some)), keys.shape[1]), np.repeat(np.arange(len(some)), [len(x) for x in least])])
            key = np.concatenate([keys.ravel(), np.concatenate(least) | np.int64(-(1 << 63))])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, node[row], word[row, 0], word[row, 1])], schema=schema)


def candidates(nodes: DataFrame) -> DataFrame:
    """(a, b, bucket) of ``nodes`` (node distinct, sketch): pairs a < b to be verified, without a bucket;
    or members ``a`` of a crowded bucket, without ``b``, whose pairs are verified there (``within``).
    """
    rows = nodes.select("node", "sketch").mapInArrow(_variants, "key bigint, node bigint, s0 bigint, s1 bigint")
    dealt = rows.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_meet, "a bigint, b bigint, bucket bigint").distinct()


def _buckets(batches, columns):
    """Rows of whole buckets, from batches sorted by the first column."""
    held = np.zeros((len(columns), 0), np.int64)
    for batch in batches:
        rows = np.concatenate([held, np.stack([batch.column(c).to_numpy() for c in columns])], 1)
        if not rows.shape[1]:
            continue
        at = int(np.searchsorted(rows[0], rows[0, -1]))  # the last bucket may go on
        held = rows[:, at:]
        yield rows[:, :at]
    yield held


def _meet(batches):
    for rows in _buckets(batches, ("key", "node", "s0", "s1")):
        yield from _pairs(rows)


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of rows (key, node, s0, s1)."""
    return np.bitwise_count((x[2] ^ y[2]).view(np.uint64)).astype(np.int16) + np.bitwise_count((x[3] ^ y[3]).view(np.uint64))


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether rows of one key are within the radius of that kind of key."""
    return (_distance(x, y) <= np.where(x[0] < 0, SHORT_RADIUS, RADIUS)) & (x[1] != y[1])


def _pairs(rows: np.ndarray):
    if rows.shape[1] < 2:
        return
    key = rows[0]
    start = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
    size = np.diff(np.concatenate([start, [len(key)]]))
    of = np.repeat(np.arange(len(size)), size)
    small = np.flatnonzero((size[of] > 1) & (size[of] <= SMALL))
    found = []
    step, at = 1, np.arange(len(small))
    while at.size:
        at = at[at + step < len(small)]
        at = at[key[small[at]] == key[small[at + step]]]
        x, y = small[at], small[at + step]
        hit = _near(rows[:, x], rows[:, y])
        found.append(np.stack([x[hit], y[hit]]))
        step += 1
    if found:
        x, y = np.concatenate(found, 1)
        many = (np.bincount(of[x], minlength=len(size)) > MANY * size)[of[x]]
        yield _batch(rows[1, x[~many]], rows[1, y[~many]])
        yield _members(rows[:2, np.unique([x[many], y[many]])])
    for k in np.flatnonzero(size > SMALL):
        yield from _large(rows[:, start[k] : start[k] + size[k]])


def _large(own: np.ndarray):
    """The near pairs of one bucket, or its members that have any, where the pairs are many."""
    n = own.shape[1]
    touched, found, pairs = np.zeros(n, bool), [], 0
    for k in range(n - 1):
        hit = np.flatnonzero(_near(own[:, k : k + 1], own[:, k + 1 :])) + k + 1
        if hit.size:
            touched[k] = touched[hit] = True
            pairs += len(hit)
            if pairs <= MANY * n:
                found.append(np.stack([np.full(len(hit), k), hit]))
    if pairs > MANY * n:
        yield _members(own[:2, touched])
    elif found:
        x, y = np.concatenate(found, 1)
        yield _batch(own[1, x], own[1, y])


def _members(rows: np.ndarray) -> pa.RecordBatch:
    """Rows (key, node) as members of crowded buckets."""
    return pa.RecordBatch.from_arrays([pa.array(rows[1]), pa.nulls(rows.shape[1], pa.int64()), pa.array(rows[0])], ["a", "b", "bucket"])


def _batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(len(pairs), pa.int64())], ["a", "b", "bucket"])


def _whole(batches):
    """Tables of one bucket's rows each, from batches sorted by bucket."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        key = batch.column("bucket").to_numpy()
        if not len(key):
            continue
        edges = np.flatnonzero(np.append(True, key[1:] != key[:-1])).tolist()
        for begin, end in zip(edges, [*edges[1:], len(key)]):
            if held and key[begin] != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            last = key[begin]
            held.append(batch.slice(begin, end - begin))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _least(rows: np.ndarray, items: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of each of the rows (key, node, s0, s1) of a bucket: the first one linked to it by near pairs at 0.8 or more.

    ``items`` are the rows' sets, one after the other, none empty.
    """
    n = rows.shape[1]
    label = np.arange(n)
    items = np.unique(items, return_inverse=True)[1]
    ends = np.cumsum(size)
    held = np.zeros(len(items), bool)
    apart = n
    for k in range(n - 1):
        if apart == 1:
            break
        rest = np.flatnonzero(label[k + 1 :] != label[k]) + k + 1
        rest = rest[_near(rows[:, k : k + 1], rows[:, rest])]
        rest = rest[5 * np.minimum(size[k], size[rest]) >= 4 * np.maximum(size[k], size[rest])]
        if not rest.size:
            continue
        own = items[ends[k] - size[k] : ends[k]]
        held[own] = True
        true, part = [], max(1, ROOM // int(2 * size[k]))  # a set is at most 5 / 4 of another
        for begin in range(0, len(rest), part):
            some = rest[begin : begin + part]
            n_each = size[some]
            stop = np.cumsum(n_each)
            at = np.arange(stop[-1]) + np.repeat(ends[some] - stop, n_each)
            shared = np.add.reduceat(held[items[at]], stop - n_each, dtype=np.int64)
            true.append(some[9 * shared >= 4 * (size[k] + n_each)])  # i / (size - i) >= 4 / 5
        held[own] = False
        linked = np.unique(label[np.concatenate([[k], *true])])
        if len(linked) > 1:
            label[np.isin(label, linked)] = linked[0]
            apart -= len(linked) - 1
    return label


def _stars(batches):
    """(a, b): the members b of each component of a bucket beside its least one."""
    for own in _whole(batches):
        own = own.take(pc.sort_indices(own, [("node", "ascending")]))
        rows = np.stack([own.column(c).to_numpy() for c in ("bucket", "node", "s0", "s1")])
        sets = own.column("items").combine_chunks()
        label = _least(rows, sets.flatten().to_numpy(), pc.list_value_length(sets).to_numpy().astype(np.int64))
        moved = np.flatnonzero(label != np.arange(len(label)))
        yield pa.RecordBatch.from_arrays([pa.array(rows[1, label[moved]]), pa.array(rows[1, moved])], ["a", "b"])


def within(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): stars that link what the near pairs at 0.8 or more of each bucket link, for ``members`` (bucket, node)."""
    rows = members.join(sets, "node").select("bucket", "node", "s0", "s1", "items")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_stars, "a bigint, b bigint").distinct()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) at 0.8 or more, by ``sets`` (node, items: distinct)."""
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
    both = one.join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    size = F.size("x") + F.size("y")
    fits = (5 * F.least(F.size("x"), F.size("y")) >= 4 * F.greatest(F.size("x"), F.size("y"))) & (
        9 * F.size(F.array_intersect("x", "y")) >= 4 * size  # i / (size - i) >= 4 / 5
    )
    return both.where(fits).select("a", "b")


def _sets(df: DataFrame, wanted: DataFrame, shingle: int, key: str, text: str) -> DataFrame:
    """(node, s0, s1, items) of the ``wanted`` (node, s0, s1, key, h), each from one of its texts."""

    def run(part: pa.RecordBatch) -> dict:
        sets = [shingle_set(t, shingle).view(np.int64) for t in part.column(text).to_pylist()]
        return {c: part.column(c) for c in ("node", "s0", "s1")} | {"items": pa.array(sets, pa.list_(pa.int64()))}

    rows = df.select(key, F.xxhash64(text).alias("h"), text).join(wanted, [key, "h"]).dropDuplicates(["node"])
    return map_slices(rows.select("node", "s0", "s1", text), run, "node bigint, s0 bigint, s1 bigint, items array<bigint>", text)


def survivors(df: DataFrame, shingle: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, h): the row of least key, then least text hash, of each group. Keys are not null."""
    found = cut(prints(df, shingle, key, text))
    nodes = cut(found.groupBy("node").agg(F.min("sketch").alias("sketch"), F.min(F.struct(key, "h")).alias("least")))
    found = cut(candidates(nodes))
    pairs, members = found.where("b is not null").select("a", "b"), found.where("b is null").select("bucket", F.col("a").alias("node"))
    ends = found.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    half = lambda at: F.conv(F.hex(F.substring("sketch", at, 4)), 16, 10).cast("bigint")
    words = [F.shiftleft(half(at), 32).bitwiseOR(half(at + 4)).alias(f"s{k}") for k, at in enumerate((1, 9))]
    wanted = nodes.join(ends, "node", "left_semi").select("node", *words, "least.*")
    sets = cut(_sets(df, wanted, shingle, key, text))
    edges = verified(pairs, sets).unionByName(within(members, sets))
    linked = roots(edges).withColumnRenamed("node", "of")
    named = nodes.join(linked, nodes.node == linked.of, "left").select("least", F.coalesce("root", "node").alias("root"))
    return named.groupBy("root").agg(F.min("least").alias("least")).select("least.*")
