"""Language identification by prediction by partial matching.

Each language has a context tree over bytes.  A context is the longest suffix
(at most ``ORDER`` bytes) of the text so far that training saw; in a context
that has seen ``t`` bytes of ``d`` kinds, a kind seen ``c`` times costs
``-log2(c / (t + d))`` bits and any other the escape ``-log2(d / (t + d))`` plus
its cost one context shorter (method C).  Below the empty context every byte
costs 8 bits.  The statistics are frozen after training, so the cost of a byte
depends on its context alone, and the trees are laid out as one table

    context id x byte class -> bits under every language

with the escapes already followed.  Scoring a text is then three array
lookups a byte, and its code length under a language is exact: the sum.

Training counts n-grams on the executors and gathers the counts only; they are
bounded by the languages and the alphabet, not by the corpus.  At most about
``per_language`` labelled documents of each language are used (chosen by a hash
of their id, so any run on any cluster chooses the same).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices

ORDER = 3
UNKNOWN = "und"
#: Documents a language may give to the fit; expected, by hash sampling.
PER_LANGUAGE = 4_000
_ASCII_LETTER = re.compile(r"[A-Za-z]")


def has_letter(text: str | None) -> bool:
    """Whether any character is a Unicode letter."""
    return bool(text) and (bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text)))


def count_ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of 1 to ORDER + 1 bytes and how often each occurs.

    An n-gram is packed as its length and its bytes; texts start after a line
    break, which their first contexts see.
    """
    grams, counts = [], []
    for n in range(1, ORDER + 2):
        found = []
        for text in texts:
            b = np.frombuffer(b"\n" * (n - 1) + text, np.uint8).astype(np.int64)
            if len(b) < n:
                continue
            code = np.full(len(b) - n + 1, n, np.int64)
            for k in range(n):
                code = code << 8 | b[k : len(b) - n + 1 + k]
            found.append(code)
        if found:
            g, c = np.unique(np.concatenate(found), return_counts=True)
            grams.append(g)
            counts.append(c)
    if not grams:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(grams), np.concatenate(counts)


@dataclass(frozen=True)
class Model:
    """Frozen context trees of all languages as lookup tables."""

    languages: tuple[str, ...]
    classes: np.ndarray  # byte -> class; 0 is any byte that training never saw
    width: int  # classes
    state: np.ndarray  # packed classes of the last ORDER bytes -> context id
    bits: np.ndarray  # (context id * width + class) -> float32 bits, one column a language

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of every text (rows) under every language (columns)."""
        out = np.zeros((len(texts), len(self.languages)))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        full = np.flatnonzero(sizes)
        group: list[int] = []
        held = 0
        for k in [*full.tolist(), -1]:
            if k < 0 or held + sizes[k] > (1 << 20):
                if group:
                    self._score(texts, group, sizes, out)
                group, held = [], 0
            if k >= 0:
                group.append(k)
                held += int(sizes[k])
        return out

    def _score(self, texts, group, sizes, out) -> None:
        lead = b"\n" * ORDER
        c = self.classes[np.frombuffer(b"".join(lead + texts[k] for k in group), np.uint8)]
        code = np.zeros(len(c) - ORDER, np.int32)
        for k in range(ORDER):
            code = code * self.width + c[k : len(c) - ORDER + k]
        rows = self.bits[self.state[code] * self.width + c[ORDER:]]
        n = sizes[group]
        begin = np.cumsum(n + ORDER) - n - ORDER
        keep = np.stack([begin, begin + n], 1).ravel()  # the bytes of the next lead are skipped
        sums = np.add.reduceat(np.concatenate([rows, np.zeros((1, rows.shape[1]), rows.dtype)]), keep, axis=0, dtype=np.float64)
        out[group] = sums[::2]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, posterior of it under equal priors); ``und`` scores 0."""
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        known = [has_letter(t) for t in texts]
        bits = self.code_lengths([t.encode("utf-8", "surrogatepass") if k else b"" for t, k in zip(texts, known)])
        best = bits.argmin(1)
        share = 1 / np.exp2(bits.min(1, keepdims=True) - bits).sum(1)
        return [(self.languages[b], s) if k else (UNKNOWN, 0.0) for k, b, s in zip(known, best.tolist(), share.tolist())]


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Compile the context trees from each language's n-gram counts.

    Languages are kept in code point order, so ties go to the first.
    """
    languages = tuple(sorted(counts))
    seen = np.zeros(256, bool)
    seen[10] = True
    for grams, _ in counts.values():
        seen[grams[grams >> 8 == 1] & 255] = True
    classes = np.zeros(256, np.int32)
    classes[seen] = np.arange(1, seen.sum() + 1)
    width = int(seen.sum()) + 1
    contexts: list[np.ndarray] = []
    for n in range(1, ORDER + 1):
        grams = [g[g >> (8 * (n + 1)) == n + 1] >> 8 & ((1 << (8 * n)) - 1) for g, _ in counts.values()]
        contexts.append(np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.int64))
    first = np.cumsum([1, *map(len, contexts)])
    total = int(first[-1])

    def locate(n: int, code: np.ndarray) -> np.ndarray:
        """Ids of contexts of n bytes, of their longest known suffix where unknown."""
        if n == 0:
            return np.zeros(len(code), np.int64)
        known = contexts[n - 1]
        at = np.minimum(np.searchsorted(known, code), max(len(known) - 1, 0))
        hit = known[at] == code if len(known) else np.zeros(len(code), bool)
        out = at + first[n - 1]
        if not hit.all():
            out[~hit] = locate(n - 1, code[~hit] & ((1 << (8 * (n - 1))) - 1))
        return out

    bits = np.zeros((total, width, len(languages)), np.float32)
    for k, language in enumerate(languages):
        grams, count = counts[language]
        table = bits[:, :, k]
        for n in range(0, ORDER + 1):
            own = grams >> (8 * (n + 1)) == n + 1
            code = grams[own] & ((1 << (8 * (n + 1))) - 1)
            c = count[own].astype(np.float64)
            if n == 0:
                ids, low = np.array([0]), np.full((1, width), 8.0)
            else:
                ids = np.arange(first[n - 1], first[n - 1] + len(contexts[n - 1]))
                low = table[locate(n - 1, contexts[n - 1] & ((1 << (8 * (n - 1))) - 1))]
            base = ids[0] if len(ids) else 0
            row = locate(n, code >> 8) - base
            kind = classes[code & 255]
            t = np.bincount(row, c, minlength=len(ids))
            d = np.bincount(row, minlength=len(ids)).astype(np.float64)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(d > 0, -np.log2(d / (t + d)), 0.0)
            table[ids] = low + escape[:, None]
            table[row + base, kind] = -np.log2(c / (t + d)[row])
    alphabet = np.concatenate([[256], np.flatnonzero(seen)])  # class -> a byte; 256 stands for none
    code = np.zeros(1, np.int64)
    broken = np.zeros(1, np.int64)  # bytes after the last unseen one
    for _ in range(ORDER):
        code = (code[:, None] << 8 | (alphabet & 255)[None, :]).ravel()
        broken = np.where(alphabet[None, :] == 256, 0, np.minimum(broken[:, None] + 1, ORDER)).ravel()
    state = np.zeros(len(code), np.int32)
    for n in range(1, ORDER + 1):
        at = np.flatnonzero(broken == n)
        state[at] = locate(n, code[at] & ((1 << (8 * n)) - 1))
    return Model(languages, classes, width, state, bits.reshape(total * width, len(languages)))


def fit(df: DataFrame, label: str = "lang", key: str = "doc_id", text: str = "text", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on the rows of ``df`` whose label and text are not null.

    ``per_language`` bounds the documents a language gives (an expectation;
    all of them while there are fewer).  No labelled row: a model that answers
    ``und`` only.
    """
    labelled = df.select(F.col(key).alias("k"), F.col(label).alias("label"), F.col(text).alias("t"))
    labelled = labelled.where("label is not null and t is not null")
    sizes = labelled.groupBy("label").count().collect()  # one row a language
    share = F.lit(0.0)
    for row in sizes:
        share = F.when(F.col("label") == row["label"], min(1.0, per_language / row["count"])).otherwise(share)
    draw = F.pmod(F.xxhash64(F.col("k").cast("string")), F.lit(1 << 20)) / float(1 << 20)
    sample = labelled.where(draw < share)

    def run(batches):
        held: dict[str, list[bytes]] = {}
        size = 0

        def flush():
            for name, texts in held.items():
                grams, counts = count_ngrams(texts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams)), pa.array(grams), pa.array(counts)], ["label", "gram", "n"])
            held.clear()

        for batch in batches:
            for name, t in zip(batch.column("label").to_pylist(), batch.column("t").to_pylist()):
                held.setdefault(name, []).append(t.encode("utf-8", "surrogatepass"))
                size += len(t)
                if size > (4 << 20):
                    yield from flush()
                    size = 0
        yield from flush()

    counted = sample.select("label", "t").mapInArrow(run, "label string, gram bigint, n bigint")
    gathered = counted.groupBy("label", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = np.array(gathered.column("label").to_pylist(), object)
    grams, n = gathered.column("gram").to_numpy(), gathered.column("n").to_numpy()
    return build({name: (grams[names == name], n[names == name]) for name in sorted({*names.tolist()})})


def predict(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, lang_pred, score, *keep) of every row from its text alone."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(part: pa.RecordBatch) -> dict:
        found = shared.value.predict(part.column(text).to_pylist())
        return {key: part.column(key), "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]} | {
            c: part.column(c) for c in keep
        }

    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    ddl = f"{key} {fields[key]}, lang_pred string, score double" + "".join(f", {c} {fields[c]}" for c in keep)
    return map_slices(df.select(key, text, *[c for c in keep if c not in (key, text)]), run, ddl, text)


def held_out(key: str = "doc_id", folds: int = 5):
    """True for the fold that no fit may see: crc32(key as text) mod ``folds`` is 0."""
    return F.crc32(F.col(key).cast("string")) % folds == 0
