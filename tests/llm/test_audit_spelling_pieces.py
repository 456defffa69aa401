"""Spelling groups, the filter audit and the tokenizer against brute force, and on awkward rows."""

import os
import random
import zlib
from collections import Counter
from itertools import combinations, permutations

import pytest
from pyspark.sql import functions as F

from trialgrid.llm import filter_audit, fingerprint, sentencepiece_codec, spelling, toxicity
from trialgrid.llm.queries import queries

SCHEMA = "doc_id long, text string, lang string, source string, word string, mask int, ids string"
LETTER = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(map(chr, range(0xC0, 0x100)))


def _rows(texts, sources=("s1", "s2", None)):
    return [(k, t, "en", sources[k % len(sources)], "x", 7, None) for k, t in enumerate(texts)]


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def _groups(rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        run = ""
        for c in [*(text or ""), " "]:
            if c in LETTER:
                run += c.lower() if c.isascii() else c
                continue
            if run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
            run = ""
    n = {w: k for w, k in counts.items() if len(w) >= 7 and k >= 2}
    near = {w: [o for o in n if _near(w, o)] for w in n}
    best = {w: min(near[w], key=lambda o: (-n[o], o), default=None) for w in n}
    form = {w: b if b and n[b] >= 10 * n[w] else None for w, b in best.items()}
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def test_spelling(spark):
    rng = random.Random(3)
    stems = ["separate", "Colourful", "naïveté", "occurrence", "aaaaaaa", "ÀÉÎõûüç", "restaurant", "x" * 3000]
    texts = []
    for _ in range(150):
        words = []
        for _ in range(rng.randrange(30)):
            w = rng.choice(stems)
            for _ in range(rng.choice((0, 0, 0, 1, 1, 2))):
                k = rng.randrange(len(w) + 1)
                w = rng.choice((w[:k] + w[k + 1 :], w[:k] + rng.choice("aeé") + w[k:], w[:k] + rng.choice("aeé") + w[k + 1 :]))
            words.append(w)
        texts.append(rng.choice((" ", ", ", "7")).join(words))
    texts += ["separate " * 400, "seperate " * 30, "seperite seperate seperite seperite", None, "", "12 34"]
    rows = _rows(texts) + [(None, "separate restaurants", "en", "s1", "x", 7, None)] * 3 + [(1, "restaurants", "en", "s1", "x", 7, None)] * 2
    out = spelling.group_spellings(spark.createDataFrame(rows, SCHEMA))
    found = [tuple(r) for r in out.collect()]
    assert len(found) == len(set(found)) and set(found) == _groups(rows)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    roots = {w: (f, r) for w, f, r, *_ in found}
    assert any(f and f != r for f, r in roots.values())  # a chain of two


def test_signatures_miss_no_pair(spark):
    """All pairs one edit apart among dense words, replaced and inserted, at either end and repeated letters."""
    rng = random.Random(8)
    words = {"".join(rng.choice("aab") for _ in range(rng.choice((7, 8)))) for _ in range(120)} | {"b" * k for k in range(7, 12)}
    words |= {w[:k] + "é" + w[k + 1 :] for w in list(words)[:20] for k in (0, 3, 6)}
    vocabulary = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    pairs = [(r.word, r.other) for r in spelling.near_pairs(vocabulary).collect()]
    assert len(pairs) == len({frozenset(p) for p in pairs})
    assert {frozenset(p) for p in pairs} == {frozenset(p) for p in combinations(words, 2) if _near(*p)}


def _failing(rows):
    least = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            least[text or ""] = min(least.get(text or "", doc_id), doc_id)
    out = []
    for doc_id, text, _, source, *_ in rows:
        t = text or ""
        words = [w for w in t.replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": doc_id is not None and doc_id > least[t],
        }
        out.append((doc_id, source or "", fails))
    return out


def test_filter_audit(spark):
    rng = random.Random(5)
    texts = []
    for k in range(90):
        n = rng.choice((0, 10, 49, 50, 51, 80))
        words = [rng.choice(("same", f"w{j}", f"W{j}", f"ü{j}")) if rng.random() < 0.7 else "again" for j in range(n)]
        texts.append(rng.choice((" ", "\n", "\x0b", "  ")).join(words) + rng.choice(("", " $5", "\t", "*")))
    texts += [texts[k] for k in (3, 4, 5, 3)] + [None, "", " ", " x", "A" * 5 + "a" * 95, "A" * 6 + "a" * 94, " " + "word " * 20000]
    rows = _rows(texts) + [(3, texts[3], "en", "s1", "x", 7, None)] * 2 + [(None, texts[3], "en", None, "x", 7, None)] * 2
    labels = [(k, k % 2, int(k % 3 == 0)) for k in range(0, 100, 2)] + [(4, 1, 1), (None, 1, 1), (6, None, None)]
    known = {}
    for i, q, t in labels:
        if i is not None:
            good, toxic = known.get(i, (False, False))
            known[i] = (good or q == 1, toxic or t == 1)
    docs = _failing(rows)
    want = set()
    for part in {p for _, p, _ in docs}:
        own = [(known.get(i, (False, False)), f) for i, p, f in docs if p == part]
        gone_of, rest = Counter(), []
        for order in map("".join, permutations("ABCDE")):
            gone = [False] * len(own)
            for step, own_filter in enumerate(order, 1):
                hit = [f[own_filter] for _, f in own]
                here = [h and not g for h, g in zip(hit, gone, strict=True)]
                redundant = sum(h and g for h, g in zip(hit, gone, strict=True))
                gone = [g or h for g, h in zip(gone, hit, strict=True)]
                alone = sum(h and sum(f.values()) == 1 for h, (_, f) in zip(hit, own, strict=True))
                lost = [sum(h and flags[k] for h, (flags, _) in zip(here, own, strict=True)) for k in (0, 1)]
                gone_of[own_filter] += sum(here)
                rest.append((part, order, step, len(own) - sum(gone), sum(here), redundant, alone, *lost, own_filter))
        want |= {(*r[:-1], gone_of[r[-1]]) for r in rest}
    out = filter_audit.audit_filters(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = [tuple(r) for r in out.collect()]
    assert len(found) == len(want) and set(found) == want


def test_potential_is_the_shapley_value(spark):
    """Differences of the potential against the mean over all orders, for a game of any worths."""
    rng = random.Random(2)
    worth = [0] + [rng.randrange(1000) for _ in range(31)]
    got = spark.range(1).select(filter_audit.potential(F.array(*[F.lit(v).cast("long") for v in worth])).alias("p")).first().p
    for k in range(5):
        total = 0
        for order in permutations(range(5)):
            before = sum(1 << i for i in order[: order.index(k)])
            total += worth[before | 1 << k] - worth[before]
        assert got[31] - got[31 - (1 << k)] == total


@pytest.fixture(scope="module")
def model():
    tokenizers = pytest.importorskip("public_tokenizers")
    return sentencepiece_codec.read_model(tokenizers.path("piece_bpe_32k.model"))


def test_pieces(spark, model):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = random.Random(6)
    texts = [None, "", " ", "▁", "  two  spaces ", "a▁b ▁ c", "\x00\ttab\r\n", "漢字 emoji 😀", "<s> </s> <unk>", "word " * 5000, "x" * 5000, "é́", "<0x41>"]
    texts += ["".join(rng.choice("ab ▁\néA.漢  ") for _ in range(rng.randrange(30))) for _ in range(200)]
    rows = _rows(texts) + _rows(texts[:3])
    out = sentencepiece_codec.encode_documents(spark.createDataFrame(rows, SCHEMA), model).collect()
    assert len(out) == len(rows)
    want = {k: [*own.encode(t or ""), own.eos_id()] for k, t in enumerate(texts)}
    for r in out:
        assert r.ids == want[r.doc_id] and r.decoded == own.decode(want[r.doc_id])
        assert r.decoded == (texts[r.doc_id] or "").replace("▁", " ")


def test_chunk_table(model):
    """Blocks and table sizes change nothing; models that may cross a marker are told apart."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    own = sentencepiece.SentencePieceProcessor(model_proto=model)
    text = "some  words ▁ and more\n words, 漢字  in  blocks" * 20
    for most, block in ((1 << 17, 1 << 20), (5, 7), (3, 1)):
        texts = [text, "", text[:50], "  "]
        found = sentencepiece_codec.ChunkTable(own, most).encode(texts, block)
        assert [list(memoryview(ids).cast("i")) for ids in found] == own.encode(texts)
    assert sentencepiece_codec.separable(model)
    changed = sentencepiece_model_pb2.ModelProto.FromString(model)
    changed.pieces[400].piece = "of▁the"
    assert not sentencepiece_codec.separable(changed.SerializeToString())


def test_nothing_in(spark, model):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert not spelling.group_spellings(none).count() and not filter_audit.audit_filters(none, labels).count()
    assert not sentencepiece_codec.encode_documents(none, model).count()
    only_empty = spark.createDataFrame(_rows([None, ""]), SCHEMA)
    assert not spelling.group_spellings(only_empty).count() and filter_audit.audit_filters(only_empty, labels).count() == 1200


def test_cuts_hold_in_every_script(spark):
    """One character put in front, or in the middle, of 5,000: little of the fingerprint changes, in any script or case."""
    rng = random.Random(5)
    made = {
        "chinese": [chr(c) for c in range(0x4E00, 0x8000)], "arabic": [*"ابتثجحخدذرزسشصضطظعغفقكلمنهوي   "], "greek": [*"αβγδεζηθικλμνξοπρστυφχψω   "],
        "upper": [*"EEEETTTAAAOOOIIINNNSSSHHRRDDLLUCMWFGYPBVK      "], "unbroken": [*"abcdefghijklmnopqrstuvwxyz"], "emoji": [chr(c) for c in range(0x1F300, 0x1F600)],
    }
    texts = {k: "".join(rng.choice(letters) for _ in range(5000)) for k, letters in made.items()}
    rows = [(k, t, v) for k, t in texts.items() for v in ("x" + t, t[:2500] + "x" + t[2500:])]
    df = spark.createDataFrame(rows, "k string, a string, b string").select("k", fingerprint.paragraph_digests(F.col("a")).alias("a"), fingerprint.paragraph_digests(F.col("b")).alias("b"))
    for r in df.collect():
        assert len(set(r.a) & set(r.b)) / len(set(r.a) | set(r.b)) > 0.9, r.k
    tiny = spark.createDataFrame([("",), ("a",), ("\n\n",), ("é",), ("漢\n漢",)], "t string").select(F.size(fingerprint.paragraph_digests(F.col("t"))).alias("n"))
    assert [r.n for r in tiny.collect()] == [0, 1, 0, 1, 1]


def test_names():
    assert {"op11_spelling", "op12_filter_audit", "op13_sentencepiece"} <= set(queries())


def test_secret_network_on_planted_tokens(spark):
    """Keys and harmless tokens it was not taught on, in loud and punctuated surroundings too: precision and recall, not accuracy."""
    import numpy as np

    from trialgrid.llm import secret_scan

    rng = random.Random(10)
    word = lambda: "".join(rng.choice("bdklmnrst") + rng.choice("aeiou") for _ in range(3))
    text = lambda k: " ".join(word() if j % 9 else f"{word()}{rng.randrange(10**6)}" for j in range(40)) + (f" token = 'a{rng.randrange(16**14):x}'" if k % 3 == 0 else "")
    found = secret_scan._found(spark.createDataFrame([(k, text(k)) for k in range(120)], "doc_id long, text string"), "doc_id", "text")
    model = secret_scan.train(found)
    around = [bytes(r.v) for r in found.select(F.explode("candidates").alias("c")).select(F.explode("c.views").alias("v")).limit(200).collect()]
    pictures, kinds = secret_scan._set_in(around, 977)
    taken, kinds = model.probabilities(secret_scan._codes(pictures)) >= model.threshold, np.array(kinds) > 0
    assert (taken & kinds).sum() / taken.sum() > 0.97 and taken[kinds].mean() > 0.95


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the test tables")
def test_toxicity_recall_and_precision(spark):
    """Taught on the labels of even ids, judged on those of odd ids."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet") for name in ("documents", "labels"))
    said = toxicity.score_toxicity(docs, labels.where("doc_id % 2 = 0")).select("doc_id", F.col("toxic").alias("said"))
    told = labels.where("doc_id % 2 = 1").select("doc_id", (F.col("toxic") == 1).alias("told"))
    n = said.join(told, "doc_id").agg(*[F.count_if(c).alias(k) for k, c in (("both", F.col("said") & F.col("told")), ("said", F.col("said")), ("told", F.col("told")))]).first()
    assert n.both / n.said > 0.9 and n.both / n.told > 0.85


def test_blocks_hold_no_crowd(spark, monkeypatch):
    """Null ids, one id, and ids in steps: no block of texts takes in them all, and scores are those of other ids."""
    from trialgrid.llm import pitman_yor

    monkeypatch.setattr(pitman_yor, "BLOCK_BYTES", 400)
    sizes, kind = [], type(spark.range(0))
    real = kind.groupBy

    def watched(self, *keys):
        if [k for k in keys if isinstance(k, str)] == ["block"] and "text" in self.columns:
            sizes.append(max(r["count"] for r in real(self, "block").count().collect()))
        return real(self, *keys)

    monkeypatch.setattr(kind, "groupBy", watched)
    for ids in ([None] * 200, [5] * 200, [k * 8000 for k in range(200)], list(range(200))):
        rows = [(i, f"word{k % 9} other{k % 5} w{k}") for k, i in enumerate(ids)]
        out = pitman_yor.score_documents(spark.createDataFrame(rows, "doc_id long, text string"))
        assert out.count() == 200 and sizes.pop() < 60
