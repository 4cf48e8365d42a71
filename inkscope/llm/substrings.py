"""Exact substring dedup: bytes under a string of ``length`` bytes that an
earlier document holds too are removed.

Windows of 50 bytes are compared by the suffix order of shards
(``induced.prefix_classes``).  To bring equal windows to one shard without
moving every suffix, a window goes by its *minimizer*, the least hashed 20-gram in
it: equal windows have equal minimizers, and neighbouring windows mostly share one, so
a run of them travels as one short string.

1. Documents are dealt to groups by a hash of their id.  Each group reports the
   minimizers of its runs, as packed arrays by hash range.
2. A minimizer that two documents hold is reported back to its groups; all
   others are done with.
3. The groups send their distinct runs of shared minimizers to shards, each
   with its least document id.  Copies within a group collapse here, so a
   passage on a third of all documents reaches its shard once a group.
4. A shard sorts the suffixes of its distinct runs (of minimizers that more than
   one distinct run has; a lone run meets no other) and takes the least id of
   every class of equal windows; a run's windows that are held by a smaller id
   than its own least are flagged, one bit each, back to its group.
5. The group marks the flagged windows, and those whose run an earlier document of
   its own holds, and cuts the bytes they cover.

Hash collisions only bring unequal windows together; classes compare bytes, so
the result is exact.  Ids are compared as numbers; documents of equal id do not
count as earlier, a null id is after all others.  Null texts are empty and
texts shorter than a window lose nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, sha256_hex
from .induced import prefix_classes

LENGTH = 50
GRAM = 20
GROUP_BYTES = 4 << 20
SHARD_BYTES = 8 << 20
LAST = np.iinfo(np.int64).max

_ODD = [np.uint64(0x9E3779B97F4A7C15)]
for _ in range(5):  # the multiplier's powers 1, 2, 4, 8, 16
    _ODD.append(np.uint64(int(_ODD[-1]) ** 2 % (1 << 64)))


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 20 bytes from every position on."""
    h = b.astype(np.uint64) + np.uint64(1)
    kept = None
    for k, size in enumerate((1, 2, 4, 8)):
        h = h[:-size] * _ODD[k] + h[size:]
        if size == 2:
            kept = h  # hashes of four bytes
    h = h[: len(b) - GRAM + 1] * _ODD[2] + kept[16 : 16 + len(b) - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


class Runs:
    """Runs of neighbouring windows of one minimizer, of a list of documents."""

    def __init__(self, ids: np.ndarray, texts: list[bytes]):
        self.ids, self.texts = ids, texts
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = b"".join(texts)
        total = len(self.bytes)
        empty = np.zeros(0, np.int64)
        self.start, self.count, self.doc, self.key = empty, empty, empty, np.zeros(0, np.uint64)
        if total < LENGTH:
            return
        h = _gram_hashes(np.frombuffer(self.bytes, np.uint8))
        for step in (1, 2, 4, 8):
            h = np.minimum(h[:-step], h[step:])
        h = np.minimum(h[:-15], h[15:])  # of 31 neighbours
        inside = np.zeros(total + 1, np.int8)  # windows that cross no border
        fit = self.size >= LENGTH
        np.add.at(inside, self.begin[fit], 1)
        np.add.at(inside, self.begin[fit] + self.size[fit] - LENGTH + 1, -1)
        inside = np.cumsum(inside[:-1], dtype=np.int8)[: len(h)] > 0
        first = inside.copy()
        first[1:] &= (h[1:] != h[:-1]) | ~inside[:-1]
        first[self.begin[fit]] = True
        self.start = np.flatnonzero(first)
        ends = inside.copy()
        ends[:-1] &= first[1:] | ~inside[1:]
        self.count = np.flatnonzero(ends) - self.start + 1
        self.key = h[self.start] >> np.uint64(16)  # 48 bits travel
        self.doc = np.searchsorted(self.begin[fit], self.start, "right") - 1
        self.doc = np.flatnonzero(fit)[self.doc]

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct minimizers in order, whether two ids of these documents hold it)."""
        order = np.lexsort((self.ids[self.doc], self.key))
        key, owner = self.key[order], self.ids[self.doc][order]
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        last = np.concatenate([at[1:] - 1, [len(key) - 1]]) if len(at) else at
        return key[at], owner[at] != owner[last]

    def shared(self, keys: np.ndarray):
        """Distinct runs of the given minimizers: what travels, and who holds it.

        Returns (run numbers, content number of each, contents, least id of each).
        """
        at = np.minimum(np.searchsorted(keys, self.key), max(len(keys) - 1, 0))
        runs = np.flatnonzero(keys[at] == self.key) if len(keys) else np.zeros(0, np.int64)
        number: dict[bytes, int] = {}
        data = self.bytes
        starts = self.start[runs]
        ends = starts + self.count[runs] + LENGTH - 1
        content = np.fromiter(
            (number.setdefault(data[s:e], len(number)) for s, e in zip(starts.tolist(), ends.tolist())), np.int64, len(runs)
        )
        least = np.full(len(number), LAST)
        np.minimum.at(least, content, self.ids[self.doc[runs]])
        return runs, content, list(number), least

    def shard_of(self, runs, content, count: int, shards: int) -> np.ndarray:
        out = np.zeros(count, np.int64)
        out[content] = (self.key[runs] % np.uint64(shards)).astype(np.int64)
        return out


def _documents(rows: pa.Table) -> Runs:
    ids = rows.column("id").fill_null(LAST).to_numpy()
    texts = [(t or "").encode("utf-8", "surrogatepass") for t in rows.column("text").to_pylist()]
    order = sorted(range(len(texts)), key=lambda k: (ids[k], texts[k]))
    return Runs(ids[order], [texts[k] for k in order])


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.table({n: pa.array(list(c), kinds[k]) for (n, k), c in zip(fields, columns)})


_KEYS = "part int, g bigint, keys binary, twice binary"
_BACK = "g bigint, kind int, shard int, content binary"
_SENT = "shard int, g bigint, lengths binary, least binary, content binary"
_DONE = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def _packed(keys: np.ndarray) -> bytes:
    """48-bit keys as their high four and low two bytes."""
    return (keys >> np.uint64(16)).astype(np.uint32).tobytes() + (keys & np.uint64(0xFFFF)).astype(np.uint16).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    n = len(data) // 6
    return np.frombuffer(data, np.uint32, n).astype(np.uint64) << np.uint64(16) | np.frombuffer(data, np.uint16, n, 4 * n)


def _report(key, rows: pa.Table, parts: int) -> pa.Table:
    keys, twice = _documents(rows).keys()
    part = ((keys * _ODD[0] >> np.uint64(24)) % np.uint64(parts)).astype(np.int64)  # minimizers crowd at low values
    order = np.argsort(part, kind="stable")
    keys, twice, part = keys[order], twice[order], part[order]
    edge = np.searchsorted(part, np.arange(parts + 1))
    g = key[0].as_py()
    return _table(_KEYS, [(p, g, _packed(keys[a:b]), np.packbits(twice[a:b]).tobytes()) for p, (a, b) in enumerate(zip(edge, edge[1:])) if b > a])


def _match(rows: pa.Table) -> pa.Table:
    groups = rows.column("g").to_pylist()
    keys = [_unpacked(k) for k in rows.column("keys").to_pylist()]
    twice = [np.unpackbits(np.frombuffer(t, np.uint8))[: len(k)] for t, k in zip(rows.column("twice").to_pylist(), keys)]
    everything = np.sort(np.concatenate(keys + [k[t > 0] for k, t in zip(keys, twice)]))
    shared = np.unique(everything[1:][everything[1:] == everything[:-1]])
    out = []
    for g, k in zip(groups, keys):
        at = np.minimum(np.searchsorted(shared, k), max(len(shared) - 1, 0))
        mine = k[shared[at] == k] if len(shared) else k[:0]
        if len(mine):
            out.append((g, 0, 0, _packed(mine)))
    return _table(_BACK, out)


def _shared_keys(back: pa.Table) -> np.ndarray:
    found = [_unpacked(c) for c, k in zip(back.column("content").to_pylist(), back.column("kind").to_pylist()) if k == 0]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _send(rows: pa.Table, back: pa.Table, shards: int) -> pa.Table:
    if not back.num_rows or not rows.num_rows:
        return _table(_SENT, [])
    g = rows.column("g")[0].as_py()
    held = _documents(rows)
    runs, content, strings, least = held.shared(_shared_keys(back))
    shard = held.shard_of(runs, content, len(strings), shards)
    lengths = np.fromiter(map(len, strings), np.int32, len(strings))
    squeeze = zstandard.ZstdCompressor(3)
    out = []
    for s in np.unique(shard).tolist():
        mine = np.flatnonzero(shard == s)
        out.append((s, g, lengths[mine].tobytes(), least[mine].tobytes(), squeeze.compress(b"".join([strings[k] for k in mine]))))
    return _table(_SENT, out)


def _sort_shard(key, rows: pa.Table) -> pa.Table:
    shard = key[0].as_py()
    number: dict[bytes, int] = {}
    entries = []
    for g, lengths, least, data in zip(*(rows.column(c).to_pylist() for c in ("g", "lengths", "least", "content"))):
        lengths, data = np.frombuffer(lengths, np.int32), zstandard.decompress(data)
        ends = np.cumsum(lengths)
        which = np.fromiter((number.setdefault(data[e - n : e], len(number)) for e, n in zip(ends.tolist(), lengths.tolist())), np.int64, len(lengths))
        entries.append((g, which, np.frombuffer(least, np.int64)))
    owner = np.full(len(number), LAST)
    for _, which, least in entries:
        np.minimum.at(owner, which, least)
    strings = list(number)
    windows = np.fromiter(map(len, strings), np.int64, len(strings)) - LENGTH + 1
    first = np.cumsum(windows) - windows
    of = np.repeat(np.arange(len(strings)), windows)
    held_by = owner[of]
    # a run that shares its minimizer with no other run holds windows that no other run holds
    _, key, count = np.unique(Runs(np.zeros(len(strings), np.int64), strings).key, return_inverse=True, return_counts=True)
    mixed = np.flatnonzero(count[key.ravel()] > 1)
    if len(mixed):
        text = np.frombuffer(b"\xff".join([strings[k] for k in mixed]) + b"\xff", np.uint8) + np.uint8(1)  # UTF-8 has no byte 255: it wraps to the separator 0
        begin = np.cumsum(windows[mixed] + LENGTH) - windows[mixed] - LENGTH
        inner = np.repeat(np.arange(len(mixed)), windows[mixed])
        step = np.arange(len(inner)) - np.repeat(np.cumsum(windows[mixed]) - windows[mixed], windows[mixed])
        classes = prefix_classes(text, begin[inner] + step, LENGTH)
        least_of_class = np.full(int(classes.max()) + 1, LAST)
        np.minimum.at(least_of_class, classes, owner[mixed[inner]])
        held_by[first[mixed[inner]] + step] = least_of_class[classes]
    out = []
    for g, which, least in entries:
        n = windows[which]
        at = np.repeat(first[which] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        flags = held_by[at] < np.repeat(least, n)
        if flags.any():
            out.append((g, 1, shard, np.packbits(flags).tobytes()))
    give_back()
    return _table(_BACK, out)


def _cut(rows: pa.Table, back: pa.Table, shards: int) -> pa.Table:
    if not rows.num_rows:
        return _table(_DONE, [])
    held = _documents(rows)
    runs, content, strings, least = held.shared(_shared_keys(back))
    total = len(held.bytes)
    cover = np.zeros(total + 1, np.int64)
    if len(runs):
        windows = np.fromiter(map(len, strings), np.int64, len(strings)) - LENGTH + 1
        first = np.cumsum(windows) - windows
        flags = np.zeros(int(windows.sum()), bool)
        shard = held.shard_of(runs, content, len(strings), shards)
        for kind, s, data in zip(*(back.column(c).to_pylist() for c in ("kind", "shard", "content"))):
            if kind == 1:
                mine = np.flatnonzero(shard == s)
                n = windows[mine]
                at = np.repeat(first[mine] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                flags[at] = np.unpackbits(np.frombuffer(data, np.uint8))[: len(at)] > 0
        n = windows[content]
        run = np.repeat(np.arange(len(runs)), n)
        step = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        gone = flags[first[content[run]] + step] | np.repeat(held.ids[held.doc[runs]] > least[content], n)
        at = (held.start[runs][run] + step)[gone]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + LENGTH, -1)
    removed = np.cumsum(cover[:-1]) > 0
    out = []
    data = np.frombuffer(held.bytes, np.uint8)
    for i, b, n in zip(held.ids.tolist(), held.begin.tolist(), held.size.tolist()):
        r = removed[b : b + n]
        lost = int(r.sum())
        spans = int(r[:1].sum() + (r[1:] & ~r[:-1]).sum()) if lost else 0
        out.append((None if i == LAST else i, n, lost, spans, data[b : b + n][~r].tobytes() if lost else held.bytes[b : b + n]))
    return _table(_DONE, out)


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", group_bytes: int = GROUP_BYTES, shard_bytes: int = SHARD_BYTES, digest: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept): ``kept`` is what is left, as bytes.

    With ``digest`` the last column is ``kept_sha256`` instead.  The sizes
    steer memory only, not results.
    """
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    shards = max(1, -(-total // shard_bytes))
    held = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    held = held.withColumn("g", F.pmod(F.xxhash64(F.col("id"), F.lit(4)), F.lit(groups)))
    by = held.groupBy("g")
    keys = by.applyInArrow(lambda key, rows: _report(key, rows, shards), _KEYS)
    shared = keys.groupBy("part").applyInArrow(lambda rows: _match(rows), _BACK)
    sent = by.cogroup(shared.groupBy("g")).applyInArrow(lambda rows, back: _send(rows, back, shards), _SENT)
    flags = sent.groupBy("shard").applyInArrow(lambda key, rows: _sort_shard(key, rows), _BACK)

    def finish(rows, back):
        out = _cut(rows, back, shards)
        if digest:
            hashes = pa.array([sha256_hex(k) for k in out.column("kept").to_pylist()], pa.string())
            out = out.drop_columns(["kept"]).append_column("kept_sha256", hashes)
        return out

    schema = _DONE.replace("kept binary", "kept_sha256 string") if digest else _DONE
    done = by.cogroup(shared.unionByName(flags).groupBy("g")).applyInArrow(finish, schema)
    return done.withColumnRenamed("id", key)


def brute(documents: list[tuple[int | None, str | None]], length: int = LENGTH) -> list[tuple[int | None, bytes, int]]:
    """(id, kept bytes, removed spans) by the definition, for small inputs."""
    first: dict[bytes, int] = {}
    data = [(LAST if i is None else i, (t or "").encode()) for i, t in documents]
    for i, b in data:
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            first[w] = min(first.get(w, LAST), i)
    out = []
    for (i, b), (original, _) in zip(data, documents):
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((original, bytes(x for x, g in zip(b, gone) if not g), spans))
    return out
