"""Token, histogram and merge operators against brute force on small sequences."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import tokens as K
from corpusloom.operators import bpe, histograms, sequences, unigram

TEXTS = ["", "a", "aaaa", "aaaab", "ababab", "banana bandana", "çğ ı😀", "xyz" * 20 + "\n" + "xyz" * 20]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "doc_id bigint, text string")


def collapsed(x, a, b, n):
    return [n if i + 1 < len(x) and t == a and x[i + 1] == b else t for i, t in enumerate(x) if not (i and x[i - 1] == a and t == b)]


def greedily(x, a, b, n):
    out = []
    for t in x:
        if out and out[-1] == a and t == b:
            out[-1] = n
        else:
            out.append(t)
    return out


def test_bytes(docs):
    want = [list((t or "").encode()) for t in [*TEXTS, None]]
    assert [r["toks"] for r in sequences.encode(docs).orderBy("doc_id").collect()] == want
    assert [r[0] for r in docs.orderBy("doc_id").select(K.byte_tokens("text")).collect()] == want
    assert [r["toks"] for r in sequences.encode(docs, 1, 2).orderBy("doc_id").collect()] == [[1, *w, 2] for w in want]


def test_merges(docs):
    toks = sequences.encode(docs).orderBy("doc_id")
    for a, b in [(97, 97), (97, 98), (98, 97), (120, 121)]:
        rows = toks.select("toks", K.collapse(F.col("toks"), a, b, 256).alias("c"), K.greedy(F.col("toks"), a, b, 256).alias("g")).collect()
        for r in rows:
            assert r["c"] == collapsed(r["toks"], a, b, 256)
            assert r["g"] == greedily(r["toks"], a, b, 256)
            x = np.array([*r["toks"], -1])
            assert bpe.collapse(x, a, b, 256).tolist()[:-1] == r["c"]
            assert bpe.greedy(x, a, b, 256).tolist()[:-1] == r["g"]
    rules = [(97, 97, 256), (256, 97, 257), (97, 98, 258)]
    for how, f in (("greedy", greedily), ("collapse", collapsed)):
        for r, t in zip(bpe.apply(toks, rules, how).orderBy("doc_id").collect(), toks.collect(), strict=True):
            want = t["toks"]
            for rule in rules:
                want = f(want, *rule)
            assert r["toks"] == want


def test_pairs_and_ngrams(docs):
    toks = [r["toks"] for r in sequences.encode(docs).collect()]
    want = Counter(x << 32 | y for t in toks for x, y in zip(t, t[1:], strict=False))
    s = sequences.encode(docs)
    assert {r["key"]: r["cnt"] for r in histograms.pairs(s).collect()} == want
    assert {r["key"]: r["cnt"] for r in histograms.pairs_sql(s).collect()} == want
    grams = Counter(tuple(t[i : i + n]) for t in toks for n in (1, 2, 3) for i in range(len(t) - n + 1))
    assert {tuple(r["gram"]): r["cnt"] for r in histograms.ngrams(s, 1, 3).collect()} == grams


def trained(toks, k):
    toks, out = [list(t) for t in toks], []
    for step in range(k):
        counts = Counter((x, y) for t in toks for x, y in zip(t, t[1:], strict=False))
        if not counts or max(counts.values()) < 2:
            break
        a, b = min(counts, key=lambda p: (-counts[p], p))
        out.append((step, a, b, 256 + step, counts[a, b]))
        toks = [collapsed(t, a, b, 256 + step) for t in toks]
    return out


def test_training(docs):
    s = sequences.encode(docs)
    toks = [r["toks"] for r in s.collect()]
    assert bpe.train(s, 12, checkpoint_every=3) == trained(toks, 12)
    first = [(m[1], m[2]) for m in trained(toks, 4)]
    assert [m[1:4] for m in bpe.train(s, 6, warm=first)] == [m[1:4] for m in trained(toks, 6)]
    assert all((m[1], m[2]) not in first for m in bpe.train(s, 7, warm=first, freeze=True)[4:])
    assert bpe.train(s.limit(0), 3) == []


def test_pieces_and_ranks(spark):
    merges = [(97, 98, 256), (256, 99, 257)]
    assert bpe.pieces(merges)[257] == b"abc"
    assert bpe.merge_lines(merges, bpe.strings(bpe.pieces(merges))) == ["a b", "ab c"]
    ranks = spark.createDataFrame([(bytearray([b]), b) for b in range(256)] + [(bytearray(b"ab"), 256), (bytearray(b"abc"), 257)], "piece binary, rank bigint")
    assert sorted(map(tuple, bpe.merges_from_ranks(ranks).collect())) == [(256, 97, 98), (257, 256, 99)]
    one = spark.createDataFrame([(bytearray(range(256)),)], "piece binary").select(K.string_piece(K.token_string(F.col("piece"))).alias("p"))
    assert bytes(one.first()["p"]) == bytes(range(256))


def all_segmentations(data, vocab):
    if not data:
        return [[]]
    return [[i, *rest] for p, i in vocab.items() if data.startswith(p) for rest in all_segmentations(data[len(p) :], vocab)]


def test_unigram():
    vocab = {b"a": 0, b"b": 1, b"ab": 2, b"aba": 3}
    logp = np.log([0.3, 0.2, 0.4, 0.1])
    for data in (b"", b"a", b"abab", b"ababa"):
        ways = all_segmentations(data, vocab)
        weights = [np.exp(sum(logp[i] for i in w)) for w in ways]
        z, counts = unigram.expectation(data, vocab, logp, 3)
        assert abs(z - np.log(sum(weights))) < 1e-9
        want = Counter()
        for w, p in zip(ways, weights, strict=True):
            for i in w:
                want[i] += p / sum(weights)
        assert all(abs(counts.get(i, 0) - want[i]) < 1e-9 for i in range(4))
        best = max(weights)
        assert np.isclose(np.exp(sum(logp[i] for i in unigram.best_path(data, vocab, logp, 3))), best)
    assert unigram.best_path(b"xyz", vocab, logp, 3) == [120, 121, 122]


def test_lattice(spark):
    """Segments worked by themselves give what whole strings give, with and without single bytes, long pieces included."""
    rng = np.random.default_rng(5)
    singles = [bytes([b]) for b in range(256)]
    for pieces in (singles + [b"ab", b"ba", b"aba", b"bb"], singles + [b"abababababa", b"bbbb", b"a b"], [b"a", b"b", b"ab", b" "], singles):
        vocab = unigram.Vocabulary(pieces, np.log(rng.dirichlet(np.ones(len(pieces)))).tolist(), 0)
        by_piece, logp = vocab.by_piece(), np.array(vocab.logp)
        texts = [b"", b"a", b"abababababab", b"xyz"] + [bytes(rng.choice(list(b"ab c"), int(rng.integers(0, 40))).astype(np.uint8)) for _ in range(60)]
        lattice = unigram.Lattice(vocab)
        assert [b"".join(x) for x in lattice.segments(texts)] == texts
        seqs = spark.createDataFrame([(i, list(t)) for i, t in enumerate(texts)], "doc_id bigint, toks array<int>")
        want = np.zeros(max(256, len(pieces)))
        for t in texts:
            for i, c in unigram.expectation(t, by_piece, logp, vocab.longest)[1].items():
                want[i] += c
        got = np.zeros(len(want))
        for r in unigram.expected(seqs, vocab).collect():
            got[r["piece_id"]] = r["exp_count"]
        assert np.allclose(got, want)
        paths = {r["doc_id"]: r["toks"] for r in unigram.segment(seqs, vocab).collect()}
        weight = lambda ids: sum(logp[i] for i in ids)
        for i, t in enumerate(texts):
            best = unigram.best_path(t, by_piece, logp, vocab.longest)
            assert paths[i] == best or np.isclose(weight(paths[i]), weight(best)) and b"".join(pieces[k] for k in paths[i]) == t


def test_unigram_fit(spark):
    s = sequences.encode(spark.createDataFrame([(i, t) for i, t in enumerate(["banana bandana", "bandana banana", "ananas banana"])], "doc_id bigint, text string"))
    v = unigram.fit(s, 2, 262, 4)
    assert len(v.pieces) <= 262 and v.pieces[:256] == [bytes([b]) for b in range(256)]
    assert abs(sum(np.exp(v.logp)) - 1) < 1e-6
