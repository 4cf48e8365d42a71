"""BPE encoding and decoding with a compiled tokenization automaton.

The automaton reads tokens.  It starts as one state in which every base symbol
loops; the merges are then compiled one after the other, each by a *merge
gadget*.  The gadget of ``(u, v) -> uv``, the j-th merge, finds the state ``q``
that arcs ``u`` lead to and, if ``q`` has an arc ``v``,

* copies ``q`` without its arc ``v`` and lets all arcs ``u`` lead to the copy
  (from now on ``u v`` is written ``uv``);
* gives every state that has an arc ``u`` an arc ``uv``, which leads where ``v`` led.

All arcs of one label lead to the same state, so a transition is the label's
state, if the present state has the arc.  The arcs a state lacks are few runs of
labels once labels are numbered in preorder of the tree ``left half -> token``,
children by rank: cutting ``v`` at rank ``j`` takes away ``v`` and everything
that later merges would have made of it, which is a tail of ``v``'s subtree.
``Automaton`` therefore holds, for each state, its sorted run bounds in one
table; a transition is one search in it.

The correct encoding of a pre-split word is the only path that spells it.  It
is found left to right for all new words of a batch together: from each
position a trie proposes labels and the transition table admits one a position.
Decoding reads nothing but token ids and emits their labels.

Null texts are empty texts (no token).  Rows keep their order; other columns
are untouched by the operator.
"""

from __future__ import annotations

import functools
import itertools
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_slices, sha256_hex

#: The pre-tokenizer's pattern and Unicode white space.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
SPACE = regex.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
#: Characters at which ``str.split`` cuts although they are not white space here.
ODD_SPACE = regex.compile("[\x1c-\x1f]")
END = "</w>"


def byte_symbols() -> list[str]:
    """Printable stand-in for each byte: itself where visible, else from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class PairTable:
    """Open-addressing map from pairs of tokens to ranks, probed with numpy."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(len(left)).bit_length() + 2)
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, -1, np.int32)
        for key, j in zip((left.astype(np.int64) << 20 | right).tolist(), rank.tolist()):
            at = self._at(key)
            while self.keys[at] >= 0 and self.keys[at] != key:
                at = (at + 1) & self.mask
            self.keys[at], self.ranks[at] = key, j

    def _at(self, key):
        return ((key ^ (key >> 17)) * 0x9E3779B1 >> 11) & self.mask

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where no merge joins it."""
        key = left.astype(np.int64) << 20 | right
        at = self._at(key)
        held = self.keys[at]
        out = np.where(held == key, self.ranks[at], np.int32(-1))
        open_ = np.flatnonzero((held != key) & (held >= 0))
        while open_.size:
            at[open_] = (at[open_] + 1) & self.mask
            held = self.keys[at[open_]]
            hit = held == key[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out


class Automaton:
    """Deterministic token automaton of one BPE vocabulary, compiled merge by merge.

    ``state`` is the state that arcs of a token lead to (-1: no path reaches it),
    ``missing`` the sorted bounds of the label runs that states have no arc for.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.size = max(vocab.values()) + 1
        self.labels = [""] * self.size
        for token, i in vocab.items():
            self.labels[i] = token
        symbols = byte_symbols()
        base = [vocab[s + end] for end in ("", END) for s in symbols]
        steps = []
        made: dict[int, int] = dict.fromkeys(base, -1)
        for j, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if w in made:
                raise ValueError(f"two merges make the token {a + b!r}")
            made[w] = j
            steps.append((u, v, w))
        self._number(base, steps)
        self._compile(base, steps)
        spelled: dict[int, tuple[int, ...]] = {t: (k,) for k, t in enumerate(base)}
        for u, v, w in steps:
            if self.state[w] >= 0:
                spelled[w] = spelled[u] + spelled[v]
        self._build_trie(spelled)

    def _number(self, base: list[int], steps: list[tuple[int, int, int]]) -> None:
        """Preorder numbers of the tokens, children of a left half in the order of their merges."""
        weight = np.ones(self.size, np.int64)
        for u, _, w in reversed(steps):
            weight[u] += weight[w]
        self.number = np.full(self.size, -1, np.int64)
        self.number[base] = np.cumsum(weight[base]) - weight[base]
        free = self.number + 1
        for u, _, w in steps:  # parents are made before their children
            self.number[w] = free[u]
            free[u] += weight[w]
            free[w] = self.number[w] + 1
        self.end = self.number + weight

    def _compile(self, base: list[int], steps: list[tuple[int, int, int]]) -> None:
        number, end = self.number.tolist(), self.end.tolist()
        grown = [n + 1 for n in number]  # end of a token's subtree so far
        state = [-1] * self.size
        for t in base:
            state[t] = 0
        #: cuts of each state: the cut label's number, and the tail of its subtree made later
        origin, cuts = [-1], [(-1, -1, -1)]
        for u, v, w in steps:
            q, n = state[u], number[v]
            while q > 0 and not (cuts[q][0] == n or cuts[q][1] <= n < cuts[q][2]):
                q = origin[q]
            if q == 0 and state[v] >= 0:  # no cut on the way took the arc
                origin.append(state[u])
                cuts.append((n, grown[v], end[v]))
                state[w], state[u] = state[v], len(cuts) - 1
            grown[u] += end[w] - number[w]
        used = sorted({*state} - {-1} | {0})
        place = {q: k for k, q in enumerate(used)}
        self.state = np.array([place.get(q, -1) for q in state], np.int32)
        rows: list[int] = []
        low: list[int] = []
        high: list[int] = []
        for k, q in enumerate(used):
            while q > 0:
                n, lo, hi = cuts[q]
                rows += (k, k)
                low += (n, lo)
                high += (n + 1, hi)
                q = origin[q]
        at = np.array(rows, np.int64) * self.size
        lo, hi = at + np.array(low, np.int64), at + np.array(high, np.int64)
        order = np.argsort(lo[lo < hi], kind="stable")
        lo, hi = lo[lo < hi][order], np.maximum.accumulate(hi[lo < hi][order]) if len(order) else hi[:0]
        first = np.ones(len(lo), bool)
        first[1:] = lo[1:] > hi[:-1]
        last = np.ones(len(lo), bool)
        last[:-1] = first[1:]
        self.missing = np.stack([lo[first], hi[last]], 1).ravel()
        self.states = len(used)

    def _build_trie(self, spelled: dict[int, tuple[int, ...]]) -> None:
        children: list[dict[int, int]] = [{}]
        token = [-1]
        for t, path in spelled.items():
            node = 0
            for s in path:
                if s not in children[node]:
                    children[node][s] = len(children)
                    children.append({})
                    token.append(-1)
                node = children[node][s]
            token[node] = t
        self.token = np.array(token, np.int32)
        arcs = [(n, s, child) for n, c in enumerate(children) for s, child in c.items()]
        node, symbol, child = (np.array(x, np.int64) for x in zip(*arcs))
        self.next = PairTable(node, symbol, child.astype(np.int32))
        self.inner = np.array([bool(c) for c in children])

    def step(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The state that each ``token`` leads to from ``state``, -1 where there is no such arc."""
        cut = np.searchsorted(self.missing, state.astype(np.int64) * self.size + self.number[token], "right") & 1
        return np.where(cut, np.int32(-1), self.state[token])

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """Token ids of each non-empty pre-split piece (its UTF-8 bytes)."""
        out: list[list[int]] = [[]] * len(pieces)
        order = sorted(range(len(pieces)), key=lambda k: len(pieces[k]))
        begin = 0
        while begin < len(order):
            longest = max(8, 2 * len(pieces[order[begin]]))
            end = begin
            while end < len(order) and len(pieces[order[end]]) <= longest and end - begin < 40_000:
                end += 1
            group = order[begin:end]
            for k, ids in zip(group, self._encode_block([pieces[k] for k in group])):
                out[k] = ids
            begin = end
        return out

    def _encode_block(self, pieces: list[bytes]) -> list[list[int]]:
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(size.max())
        sym = np.zeros((len(pieces), width), np.int16)
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        starts = np.cumsum(size) - size
        row = np.repeat(np.arange(len(pieces)), size)
        sym[row, np.arange(len(flat)) - starts[row]] = flat
        sym[np.arange(len(pieces)), size - 1] += 256
        state = np.zeros((len(pieces), width + 1), np.int32)
        label = np.full((len(pieces), width + 1), -1, np.int32)
        came = np.zeros((len(pieces), width + 1), np.int32)
        for i in range(width):
            at = np.flatnonzero((size > i) & ((label[:, i] >= 0) if i else True))
            node = np.zeros(len(at), np.int32)
            end = i
            while at.size:
                node = self.next.find(node, sym[at, end])
                end += 1
                live = node >= 0
                at, node = at[live], node[live]
                token = self.token[node]
                named = np.flatnonzero(token >= 0)
                if named.size:
                    rows, token = at[named], token[named]
                    to = self.step(state[rows, i], token)
                    rows, token, to = rows[to >= 0], token[to >= 0], to[to >= 0]
                    state[rows, end], label[rows, end], came[rows, end] = to, token, i
                live = self.inner[node] & (size[at] > end)
                at, node = at[live], node[live]
        out = []
        for end, tokens, origin in zip(size.tolist(), label.tolist(), came.tolist()):
            ids = []
            while end > 0:
                ids.append(tokens[end])
                end = origin[end]
            ids.reverse()
            out.append(ids)
        return out


class Codec:
    """Normalises, pre-splits, encodes and decodes texts with one vocabulary.

    ``memo`` bounds the words remembered between texts; it changes speed only.
    """

    def __init__(self, path: str, memo: int = 150_000):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.automaton = Automaton(spec["model"]["vocab"], merges)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_added = (
            regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
            if self.added
            else None
        )
        self.labels = dict(enumerate(self.automaton.labels)) | {i: s for s, i in self.added.items()}
        self.digits = list(map(str, range(max(self.labels) + 1)))
        self.memo = memo
        self.ids: dict[str, tuple[int, ...]] = {}

    def forget(self) -> None:
        """Drop the remembered words."""
        self.ids.clear()

    def words(self, text: str) -> list[str]:
        """Words of a text without added tokens: normalised, cut at white space."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        if ODD_SPACE.search(text):
            return [w for w in SPACE.split(text) if w]
        return text.split()

    def segments(self, text: str) -> list[str]:
        """Words and added tokens of a text in order."""
        if self.split_added is None or "<|" not in text:
            return self.words(text)
        out: list[str] = []
        for k, part in enumerate(self.split_added.split(text)):
            out.extend([part] if k % 2 else self.words(part))
        return out

    def learn(self, words: set[str]) -> None:
        """Encode the words that are not remembered yet."""
        if len(self.ids) > self.memo:
            self.forget()
        new = [w for w in words if w not in self.ids]
        cuts = [[w] if w.isalpha() else PIECES.findall(w) for w in new]
        pieces = list({p for c in cuts for p in c})
        encoded = dict(zip(pieces, map(tuple, self.automaton.encode([p.encode() for p in pieces]))))
        for word, cut in zip(new, cuts):
            if word in self.added:
                self.ids[word] = (self.added[word],)
            else:
                self.ids[word] = encoded[cut[0]] if len(cut) == 1 else sum((encoded[p] for p in cut), ())

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Token ids of each text."""
        cut = [self.segments(t) if t else [] for t in texts]
        self.learn(set().union(*cut) if cut else set())
        return [list(itertools.chain.from_iterable(map(self.ids.__getitem__, c))) for c in cut]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0]

    def written(self, ids: list[int]) -> str:
        """Decimal ids joined by spaces."""
        return " ".join(map(self.digits.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """Emit the arc labels of ``ids``; special tokens stay."""
        return " ".join(map(self.labels.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenize(df: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids array, decoded) of every row."""
    where = path or default_vocabulary()

    def run(part: pa.RecordBatch) -> dict:
        own = codec(where)
        ids = own.encode_batch(part.column(text).to_pylist())
        return {key: part.column(key), "n_tokens": [len(i) for i in ids], "ids": ids, "decoded": [own.decode(i) for i in ids]}

    kind = df.schema[key].dataType.simpleString()
    ddl = f"{key} {kind}, n_tokens bigint, ids array<int>, decoded string"
    return map_slices(df.select(key, text), run, ddl, text, lambda: codec(where).forget())


def digests(df: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row; nothing is shuffled."""
    where = path or default_vocabulary()

    def run(part: pa.RecordBatch) -> dict:
        own = codec(where)
        ids = own.encode_batch(part.column(text).to_pylist())
        return {
            key: part.column(key),
            "n_tokens": [len(i) for i in ids],
            "ids_sha256": [sha256_hex(own.written(i).encode()) for i in ids],
            "decoded_sha256": [sha256_hex(own.decode(i).encode()) for i in ids],
        }

    kind = df.schema[key].dataType.simpleString()
    ddl = f"{key} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_slices(df.select(key, text), run, ddl, text, lambda: codec(where).forget())
