"""BPE, language identification, personal data."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkscope.llm import bpe, langid, pii

ODD = [
    None, "", "   ", "aaa aaaa  AAAAAAAAAAAA don't I'll 123 4.5 =-=-=", "<|endoftext|>x<|startoftext|> y<|no", "Σας ΣΑΣ İ é é", "日本語テキスト", "\x1c a\x1cb 'S  x​z",
    "thththth" * 50, "a" * 5_000, "🙂🙂 ﬁ ǅ", "tab\tnl\n\r\x0b\x85\xa0 x", "x" + "é" * 300,
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


def test_bpe_equals_library(library):
    r = random.Random(1)
    texts = [t for t in ODD if t is not None] + ["".join(r.choices("abcdeth inréß'’ 1.,-\n", k=r.randint(0, 80))) for _ in range(800)]
    codec = bpe.Codec(bpe.default_vocabulary(), memo=50)
    for text, ids in zip(texts, codec.encode_batch(texts)):
        want = library.encode(text, add_special_tokens=False)
        assert ids == want.ids and codec.written(ids) == " ".join(map(str, want.ids)), text
        assert codec.decode(ids) == library.decode(want.ids, skip_special_tokens=False), text


def brute_bpe(word, merges):
    parts = list(word)
    while True:
        ranks = [(merges.get((a, b), math.inf), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))]
        best = min(ranks, default=(math.inf, 0))
        if best[0] == math.inf:
            return parts
        k = best[1]
        a, b = parts[k], parts[k + 1]
        out, i = [], 0
        while i < len(parts):
            if i + 1 < len(parts) and (parts[i], parts[i + 1]) == (a, b):
                out.append(a + b)
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out


def test_automaton_small_grammars():
    """Random merge lists over three letters against merging by rank."""
    r = random.Random(7)
    symbols = bpe.byte_symbols()
    for _ in range(25):
        alive = ["a", "b", "c", "c</w>", "a</w>"]
        merges: list[tuple[str, str]] = []
        for _ in range(14):
            u, v = r.choice([x for x in alive if not x.endswith("</w>")]), r.choice(alive)
            if (u, v) not in merges and u + v not in alive:
                merges.append((u, v))
                alive.append(u + v)
        vocab = {t: k for k, t in enumerate([*symbols, *(s + "</w>" for s in symbols), *(u + v for u, v in merges)])}
        auto = bpe.Automaton(vocab, merges)
        rank = {m: k for k, m in enumerate(merges)}
        words = ["".join(r.choices("abc", k=r.randint(1, 12))) for _ in range(60)]
        for word, ids in zip(words, auto.encode([w.encode() for w in words])):
            want = brute_bpe([*word[:-1], word[-1] + "</w>"], rank)
            assert [auto.labels[i] for i in ids] == want, (merges, word)
        # the gadgets done literally: states are sets of arcs, copied one by one
        arcs = [{*symbols, *(s + "</w>" for s in symbols)}]
        leads = dict.fromkeys(arcs[0], 0)
        for u, v in merges:
            if u not in leads or v not in arcs[leads[u]]:
                continue
            old = leads[v]
            arcs.append(arcs[leads[u]] - {v})
            leads[u] = len(arcs) - 1
            leads[u + v] = old
            for state in arcs:
                state |= {u + v} if u in state else set()
        assert {auto.labels[t] for t in range(auto.size) if auto.state[t] >= 0} == {*leads}
        tokens = np.array([vocab[t] for t in leads])
        for t, q in leads.items():
            to = auto.step(np.full(len(tokens), auto.state[vocab[t]]), tokens)
            assert {auto.labels[k] for k, s in zip(tokens, to) if s >= 0} == arcs[q]


def test_bpe_frame(spark, library):
    rows = [(k, t, "x") for k, t in enumerate(ODD)] + [(3, ODD[3], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.tokenize(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == library.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids)
        assert bpe.codec(bpe.default_vocabulary()).decode(r.ids) == r.decoded
    assert bpe.digests(df.where("false")).count() == 0
    assert {r.doc_id: r.n_tokens for r in bpe.digests(df).collect()}[0] == 0


# -- language ---------------------------------------------------------------------------


def brute_bits(training, language, text):
    """Code length by walking escapes one byte at a time."""
    tree = defaultdict(Counter)
    known = set()
    for name, texts in training.items():
        for t in texts:
            for n in range(langid.ORDER + 1):
                s = b"\n" * n + t
                for i in range(n, len(s)):
                    known.add(s[i])
                    if name == language:
                        tree[s[i - n : i]][s[i]] += 1
    known.add(10)

    def cost(context, x):
        c = tree.get(context)
        low = lambda: cost(context[1:], x) if context else 8.0
        if not c:
            return low()
        t, d = sum(c.values()), len(c)
        return -math.log2(c[x] / (t + d)) if x in c else -math.log2(d / (t + d)) + low()

    s = b"\n" * langid.ORDER + text
    total = 0.0
    for i in range(langid.ORDER, len(s)):
        context = s[i - langid.ORDER : i]
        for k in range(len(context)):
            if context[k] not in known:
                return brute_tail(s, i, known, cost, total)
        total += cost(context, s[i])
    return total


def brute_tail(s, start, known, cost, total):
    for i in range(start, len(s)):
        context = s[i - langid.ORDER : i]
        bad = [k for k, b in enumerate(context) if b not in known]
        total += cost(context[bad[-1] + 1 :] if bad else context, s[i])
    return total


def test_code_lengths():
    training = {"a": [b"hello world he said", "yé hello".encode()], "b": [b"bonjour le monde", "ça va bien".encode()]}
    model = langid.build({k: langid.count_ngrams(v) for k, v in training.items()})
    texts = [b"hello monde", "zé~ bien he".encode(), b"x", b"", b"QQ\nhello", b"\0\0he", b"o" * 400]
    got = model.code_lengths(texts)
    want = [[brute_bits(training, k, t) for k in ("a", "b")] for t in texts]
    assert np.allclose(got, want, rtol=1e-5)


def test_langid_frame(spark):
    en, fr = "the cat sat on the mat and ran away ", "le chat est sur la table et la fille "
    rows = [(k, (en if k % 2 else fr) * (1 + k % 3), "en" if k % 2 else "fr", "s") for k in range(60)]
    rows += [(100, None, "en", "s"), (101, "123 !!", "en", "s"), (102, en, None, "s"), (103, "", "fr", "s"), (None, en, "en", "s"), (1, en, "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.fit(df.where(~langid.held_out()))
    got = langid.predict(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.lang_pred for r in got}
    assert all(by[k] == ("en" if k % 2 else "fr") for k in range(60)) and by[102] == "en" == by[None]
    assert (by[100], by[101], by[103]) == ("und",) * 3
    none = langid.fit(df.where("false"))
    assert {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"}
    few = langid.fit(df, per_language=5)
    assert few.languages == ("en", "fr") or few.languages


# -- personal data ------------------------------------------------------------------------

_SLOW = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def slow_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    test = {
        "email": lambda s: True,
        "ip": lambda s: all(int(x) <= 255 for x in s.split(".")),
        "card": lambda s: 16 <= len(digits(s)) <= 19 and pii.luhn(digits(s)),
        "phone": lambda s: 8 <= len(digits(s)) <= 15,
    }
    return [(k, *m.span()) for k, p in _SLOW.items() for m in p.finditer(text) if test[k](m[0])]


def test_base_spans():
    r = random.Random(2)
    for _ in range(6_000):
        text = "".join(r.choices("a@.1 2+-()%9", k=r.randint(1, 40)))
        assert sorted(pii.base_spans(text)) == sorted(slow_spans(text)), text
    for text in ("a" * 200_000 + "@", "1" * 200_000, "1." * 100_000, "+1" + "." * 200_000, "a@" * 50_000):
        pii.base_spans(text)  # linear time


def test_tagger_held_out():
    texts, spans = pii.labelled_examples(300, seed=99)
    got = pii.model_spans(texts, pii.default_tagger())
    hits = sum(len({*a} & {*b}) for a, b in zip(got, spans))
    assert hits > 0.95 * sum(map(len, spans)) and hits > 0.95 * sum(map(len, got))


def test_gradients():
    """The analytic gradient of the sequence likelihood against differences."""
    t = pii.Tagger(hidden=3, seed=1)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    x = np.array([[0, 5, 6, 15, 2], [1, 2, 3, 7, 9]])
    y = np.array([[0, 1, 2, 0, 0], [3, 4, 0, 7, 8]])
    _, g = t._gradients(x, y)
    for name, at in (("xf", (1, 5, 1)), ("rb", (2, 1, 2)), ("o", (2, 3)), ("t", (1, 2)), ("bf", (1, 0, 2)), ("ob", (0,))):
        keep = t.p[name][at]
        t.p[name][at] = keep + 1e-3
        up, _ = t._gradients(x, y)
        t.p[name][at] = keep - 1e-3
        down, _ = t._gradients(x, y)
        t.p[name][at] = keep
        assert abs((up - down) / 2e-3 - g[name][at]) < 2e-3, name


def test_windows_are_seamless():
    """A span is found wherever it lies against the grid of windows."""
    tagger = pii.default_tagger()
    phone = "(415) 555-0134"
    text = lambda p: ("lorem ipsum " * 20)[: p - 1] + " " + phone + " amet sit"
    found = sum(("phone", p, p + len(phone)) in pii.model_spans([text(p)], tagger)[0] for p in range(20, 180, 4))
    assert found >= 38  # of 40


def whole_path(text, tagger):
    """Spans of one plain Viterbi pass over a whole text's blended scores."""
    n = pii._windows(len(text))
    c = np.full(n * pii.STRIDE + pii.OVERLAP, 4, np.int32)
    c[: len(text)] = pii.classes(text)
    e = tagger.emissions(np.stack([c[k * pii.STRIDE :][: pii.WINDOW] for k in range(n)], 1))
    total = np.zeros((len(c), pii.TAGS), np.float32)
    for k in range(n):
        w = np.ones((pii.WINDOW, 1), np.float32)
        w[: pii.OVERLAP] = pii._RAMP if k else 1
        w[pii.STRIDE :] = 1 - pii._RAMP if k < n - 1 else 1
        total[k * pii.STRIDE :][: pii.WINDOW] += e[:, k] * w
    tags = tagger.viterbi(total[: len(text), None], np.array([len(text)]))[:, 0]
    out = []
    for b in np.flatnonzero(tags % 2 == 1).tolist():
        end = b + 1
        while end < len(tags) and tags[end] == tags[b] + 1:
            end += 1
        kind, part = pii.KINDS[(int(tags[b]) - 1) // 2], text[b:end]
        d = "".join(x for x in part if x in "0123456789")
        if part.strip() and (kind != "card" or (13 <= len(d) <= 19 and pii.luhn(d))):
            end -= len(part) - len(part.rstrip())
            out.append((kind, min(end, b + len(part) - len(part.lstrip())), end))
    return out


def test_one_path_through_the_whole_text():
    """Parts and blocks give the spans of one pass, with a good model and with one that cannot tell."""
    r = random.Random(6)
    pieces, _ = pii.labelled_examples(60, seed=3)
    texts = ["", "x", *(" ".join(r.choices(pieces, k=r.randint(1, 30))) for _ in range(12))]
    for tagger in (pii.default_tagger(), pii.Tagger(hidden=4, seed=3)):
        want = [whole_path(t, tagger) if t else [] for t in texts]
        assert sum(map(len, want))
        for block in (1, 3, 512):
            assert pii.model_spans(texts, tagger, block=block) == want


def test_every_window_is_scored(monkeypatch):
    """Plain prose goes through the network like any other text; spelled-out addresses need no digit and no sign."""
    tagger, seen = pii.default_tagger(), []
    plain = tagger.emissions
    monkeypatch.setattr(tagger, "emissions", lambda x: seen.append(x.shape[1]) or plain(x))
    assert pii.model_spans(["plain words " * 5_000], tagger) == [[]] and sum(seen) == pii._windows(60_000)
    for text, part in (("write bob [at] example [dot] com", "bob [at] example [dot] com"), ("so card 4111.1111.1111.1111 ok", "4111.1111.1111.1111"), ("call (310) 555-4510 today", "(310) 555-4510")):
        at = text.index(part)
        assert any(s <= at + 2 and e >= at + len(part) - 2 for _, s, e in pii.model_spans([text], tagger)[0]), text


def test_pii_long_text():
    """A text of millions of characters is scored in blocks; digits all the way are one long stretch."""
    tagger = pii.default_tagger()
    text = "words of no one " * 130_000 + "+1 (310) 555-4510 " + "more of them " * 1_000
    base, found = pii.find([text], tagger)[0]
    assert base == [("phone", 2_080_000, 2_080_017)] and {*base} <= {*found}
    pii.find(["0123456789" * 3_000], tagger)


def test_pii_frame(spark):
    rows = [(1, "mail a.b@c.de now", "x"), (2, None, "x"), (3, "", "x"), (4, "ip 10.0.0.1 and 10.0.0.1", "x"), (4, "ip 10.0.0.1 and 10.0.0.1", "x"), (None, "+44 20 7946 0958", "x"), (5, "plain words " * 3_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = [r.asDict() for r in pii.digests(df).collect()]
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["spans"] == "email:5:13" and by[1]["n_email"] == 1
    assert by[4]["n_ip"] == 2 and by[None]["n_phone"] == 1 and by[5]["spans"] == by[2]["spans"] == ""
    for r in got:
        text = next(t for k, t, _ in rows if k == r["doc_id"]) or ""
        order = sorted(slow_spans(text), key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        assert r["base_sha256"] == pii.sha256_hex(pii.joined(order).encode())
    full = pii.annotate(df).where("doc_id = 4").select(F.explode("spans").alias("s")).select("s.*").collect()
    assert {(s.kind, s.start, s.base) for s in full} == {("ip", 3, True), ("ip", 16, True)}
    assert pii.digests(df.where("false")).count() == 0
