"""SimHash near-duplicate groups by meet-in-the-middle ball hashing.

A fingerprint has 64 bits; two documents link when theirs differ in at most
``RADIUS`` = 3 bits.  Every distinct fingerprint emits the variants within half
the radius (one flipped bit) and the variants are shuffled.  Two balls of
radius one meet if the fingerprints differ in two bits; the third bit lies in
one of the two 32-bit halves, so variants are keyed on the half in which the bit
was flipped: of three differing bits one half holds at most one.  A variant of
one fingerprint then equals the other fingerprint on that half.  Colliding
pairs are verified inside the join, on all 64 bits, so only true links leave it.

A half that very many fingerprints share would make the verification
quadratic.  Fingerprints that touch such a half (``crowd`` or more) are linked
by whole balls instead: those of even parity emit radius one, those of odd
parity radius two, keyed on all 64 bits.  Members of such a bucket lie within
radius of the least member at distance one or less, so a star replaces its
pairs.  Both ways are exact and linear in the rows they emit.

Equal fingerprints are one node before anything is emitted, so copies cost
nothing.  Components are taken by ``components.roots``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_slices
from .components import roots

RADIUS = 3
#: Distinct fingerprints sharing a half from which whole balls are used.
CROWD = 2_000


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of one text; zero where it has no word."""
    return int(_fingerprints([text], shingle)[0])


def _fingerprints(texts: list[str | None], shingle: int) -> np.ndarray:
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    for k, text in enumerate(texts):
        if not text:
            continue
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            continue
        if len(words) <= shingle:
            found = [digest(b" ".join(words), 42)]
        else:
            line = b" ".join(words)
            size = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(size + 1) - 1
            begins = (ends - size).tolist()
            found = [digest(line[s:e], 42) for s, e in zip(begins, ends[shingle - 1 :].tolist())]
        counts[k] = len(found)
        hashes += found
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(counts)
    if not full.size:
        return out
    starts = np.concatenate([[0], np.cumsum(counts[full])])
    words64 = np.array(hashes, np.uint64)
    for begin in range(0, len(full), 512):
        part = full[begin : begin + 512]
        lo, hi = starts[begin], starts[begin + len(part)]
        bits = np.unpackbits(words64[lo:hi].byteswap().view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, starts[begin : begin + len(part)] - lo, axis=0, dtype=np.int32)
        over = 2 * ones > counts[part][:, None]
        out[part] = np.packbits(over, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def fingerprints(df: DataFrame, shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): a signed 64-bit SimHash of each whole text.

    Null and wordless texts have fingerprint zero, texts shorter than a shingle
    the hash of all their words.
    """

    def run(part: pa.RecordBatch) -> dict:
        return {key: part.column(key), "fp": pa.array(_fingerprints(part.column(text).to_pylist(), shingle).view(np.int64))}

    kind = df.schema[key].dataType.simpleString()
    return map_slices(df.select(key, text), run, f"{key} {kind}, fp bigint", text)


def _half(fp: str, side: str):
    """Low or high 32 bits, tagged with the side so that one join serves both."""
    low = F.col(fp).bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(fp, 32)
    return F.when(F.col(side) == 0, low).otherwise(high.bitwiseOR(F.lit(1 << 32)))


def _sides(fps: DataFrame) -> DataFrame:
    return fps.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("side")).select("fp", _half("fp", "side").alias("half"))


#: Zero and the 32 single bits: differences within half the radius on one half.
_BALL = "concat(array(0L), transform(sequence(0, 31), i -> shiftleft(1L, i)))"


def links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b), a < b: fingerprints of ``fps`` (distinct) to be linked.

    Every pair within the radius is given, or joined through a star of such pairs.
    """
    centres = _sides(fps)
    crowded = centres.groupBy("half").count().where(F.col("count") >= crowd).select("half")
    variants = centres.select("fp", F.expr(f"explode(transform({_BALL}, d -> half ^ d))").alias("half"))
    near = (
        variants.select(F.col("fp").alias("b"), "half")
        .join(centres.select(F.col("fp").alias("a"), "half").join(crowded, "half", "left_anti"), "half")
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS))
        .select("a", "b")
    )
    return near.unionByName(_stars(variants.join(crowded, "half", "left_semi").select("fp").distinct()))


def _stars(fps: DataFrame) -> DataFrame:
    single = "transform(sequence(0, 63), i -> shiftleft(1L, i))"
    double = (
        "flatten(transform(sequence(0, 62), i -> transform(sequence(i + 1, 63), j -> shiftleft(1L, i) ^ shiftleft(1L, j))))"
    )
    close = fps.select("fp", F.expr(f"explode(transform(concat(array(0L), {single}), d -> fp ^ d))").alias("v"), F.lit(True).alias("hub"))
    far = fps.where(F.bit_count("fp") % 2 == 1).select(
        "fp", F.expr(f"explode(transform({double}, d -> fp ^ d))").alias("v"), F.lit(False).alias("hub")
    )
    both = close.unionByName(far)
    hubs = both.where("hub").groupBy("v").agg(F.min("fp").alias("h"))
    return (
        both.join(hubs, "v")
        .where("fp <> h")
        .select(F.least("fp", "h").alias("a"), F.greatest("fp", "h").alias("b"))
        .distinct()
    )


def _edges(radius: int) -> list[int]:
    """First bits of the blocks, and 64."""
    blocks = max(2, -(-(radius + 1) // 3))
    return [64 * k // blocks for k in range(blocks + 1)]


def block_links(fps: DataFrame, radius: int) -> DataFrame:
    """(a, b), a < b: enough links within ``radius`` to connect all that are.

    For radii that whole halves cannot serve.  With one block for every three
    bits of ``radius + 1``, some block of a linked pair differs in two bits at most,
    so the balls of radius one around the two blocks meet: a variant is shared.
    Members of a bucket are compared on all 64 bits, sorted runs of small buckets at
    once, large ones by a search that gives each member one link, not all pairs.

    Keys have 64 / blocks bits: chance meetings, which cost a comparison each and no
    row, grow with the square of the distinct fingerprints over 2 ** bits.
    """
    edge = _edges(radius)
    parts = [_block_ball(k, lo, hi) for k, (lo, hi) in enumerate(zip(edge, edge[1:]))]
    variants = fps.select("fp", F.explode(F.concat(*parts)).alias("key"))
    dealt = variants.repartition("key").sortWithinPartitions("key")
    return dealt.select("key", "fp").mapInArrow(lambda batches: _meet(batches, radius), "a bigint, b bigint").distinct()


def _block_ball(k: int, lo: int, hi: int):
    """ARRAY of the variants of bits ``lo`` to ``hi`` within one flip, tagged with the block."""
    value = F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).bitwiseOR(F.lit(k << 56))
    ball = F.expr(f"concat(array(0L), transform(sequence(0, {hi - lo - 1}), i -> shiftleft(1L, i)))")
    return F.transform(ball, lambda flip: value.bitwiseXOR(flip))


#: Buckets beyond this are searched, not compared pair by pair.
SMALL = 48


def _meet(batches, radius: int):
    held_key, held_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        key = np.concatenate([held_key, batch.column("key").to_numpy()])
        fp = np.concatenate([held_fp, batch.column("fp").to_numpy()])
        if not len(key):
            continue
        cut_at = int(np.searchsorted(key, key[-1]))  # the last bucket may go on
        held_key, held_fp = key[cut_at:], fp[cut_at:]
        yield _pairs(key[:cut_at], fp[:cut_at], radius)
    yield _pairs(held_key, held_fp, radius)


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= radius


def _first_shared(key: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Whether ``key`` is the one of a pair's shared variants that reports it.

    It is their common block, or the lesser block with the lowest differing bit
    taken over.  In the other buckets they share, the pair is left to that one.
    """
    edge = np.array(_edges(radius))
    block = key >> 56
    low, width = edge[block].astype(np.uint64), (edge[block + 1] - edge[block]).astype(np.uint64)
    mask = (np.uint64(1) << width) - np.uint64(1)
    x, y = (a.view(np.uint64) >> low) & mask, (b.view(np.uint64) >> low) & mask
    differ = x ^ y
    lowest = differ & (~differ + np.uint64(1))
    least = np.minimum(x, y)
    chosen = np.where(np.bitwise_count(differ) == 2, least ^ lowest, least)
    return chosen == (key.view(np.uint64) & ((np.uint64(1) << np.uint64(56)) - np.uint64(1)))


def _pairs(key: np.ndarray, fp: np.ndarray, radius: int) -> pa.RecordBatch:
    found: list[tuple[np.ndarray, np.ndarray]] = []
    if len(key) > 1:
        start = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        size = np.diff(np.concatenate([start, [len(key)]]))
        small = np.flatnonzero((np.repeat(size, size) > 1) & (np.repeat(size, size) <= SMALL))
        k, f = key[small], fp[small]
        for step in range(1, int(size[(size > 1) & (size <= SMALL)].max(initial=1))):
            hit = np.flatnonzero((k[step:] == k[:-step]) & _near(f[step:], f[:-step], radius))
            hit = hit[_first_shared(k[hit], f[hit], f[hit + step], radius)]
            found.append((f[hit], f[hit + step]))
        for at in np.flatnonzero(size > SMALL):
            found.append(_search(fp[start[at] : start[at] + size[at]], radius))
    a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
    b = np.concatenate([y for _, y in found]) if found else np.zeros(0, np.int64)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _search(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among ``fp``: each member is met once."""
    left = np.unique(fp)
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    while left.size:
        front, left = left[:1], left[1:]
        while front.size and left.size:
            met = np.zeros(left.size, bool)
            for begin in range(0, front.size, 64):  # in blocks of bounded memory
                rest = np.flatnonzero(~met)
                for lo in range(0, rest.size, 65_536):
                    part = rest[lo : lo + 65_536]
                    near = _near(front[begin : begin + 64, None], left[part][None, :], radius)
                    hit = near.any(0)
                    a.append(front[begin + near.argmax(0)[hit]])
                    b.append(left[part[hit]])
                    met[part[hit]] = True
            front, left = left[met], left[~met]
    empty = np.zeros(0, np.int64)
    return np.concatenate(a) if a else empty, np.concatenate(b) if b else empty


def groups(
    df: DataFrame, shingle: int = 3, crowd: int = CROWD, key: str = "doc_id", text: str = "text", radius: int = RADIUS
) -> DataFrame:
    """(key, fp, component_id): ``component_id`` is the least key of the group.

    Radii other than three are linked by blocks.  Repeated rows give repeated
    results; an empty table gives none.
    """
    prints = cut(fingerprints(df, shingle, key, text))
    nodes = prints.groupBy("fp").agg(F.min(key).alias("least"))
    linked = links(nodes.select("fp"), crowd) if radius == RADIUS else block_links(nodes.select("fp"), radius)
    found = roots(linked)
    named = nodes.join(found, nodes.fp == found.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    component = named.groupBy("root").agg(F.min("least").alias("component_id"))
    class_of = cut(named.join(component, "root").select("fp", "component_id"))
    return prints.join(class_of, "fp", "left").select(key, "fp", "component_id")
