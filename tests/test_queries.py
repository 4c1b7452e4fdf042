"""Queries that SQL cannot express, against brute force on a small table."""

import math
from collections import Counter

import numpy as np
import pytest

from corpusloom.operators import unigram
from corpusloom.plans import catalogue, corpus_queries  # noqa: F401

TEXTS = ["trenle geldim", "köylere, köyler; 12", "", None, "banana bandana banana", "kapıcı evlerden", "bandana  ananas"]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("queries")
    rows = [(i, t, "tr", f"s{i % 2}", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def result(spark, sf, name):
    return catalogue.queries()[name](spark, sf).collect()


def suffixed(word):
    """(stem, tags and roles of the suffixes) by hand, for the words of TEXTS."""
    return {
        "trenle": ("tren", [("CASE=INS", "case")]), "geldim": ("geldim", []), "köylere": ("köy", [("AFFIX=PL CASE=DAT", "case")]), "köyler": ("köy", [("AFFIX=PL", "affix")]),
        "banana": ("ban", 2 * [("CASE=DAT", "case")]), "bandana": ("band", 2 * [("CASE=DAT", "case")]), "kapıcı": ("kapıc", [("CASE=ACC", "case")]), "evlerden": ("ev", [("AFFIX=PL CASE=ABL", "case")]), "ananas": ("ananas", []),
    }[word]


def test_turkish_queries(spark, sf):
    words = [w for t in TEXTS for w in "".join(c if c.isalpha() else " " for c in t or "").split()]
    want = Counter(s for w in words for s in suffixed(w)[1])
    assert {(r["tags"], r["role"]): r["cnt"] for r in result(spark, sf, "tr_suffixes")} == want
    between = [" ", ", ", "; 12", " ", " ", " ", "  "]  # what stands between words and after them
    pieces = sum(1 + len(suffixed(w)[1]) for w in words) + len(between)
    r = result(spark, sf, "morph_purity")[0]
    assert r["documents"] == len(TEXTS) and r["tagged_segments"] == sum(want.values())
    assert math.isclose(r["purity"], r["tagged_segments"] / r["total_segments"]) and r["total_segments"] == pieces


def test_unigram_queries(spark, sf):
    pairs = Counter(b for t in TEXTS for b in zip((t or "").encode(), (t or "").encode()[1:], strict=False))
    top = sorted(pairs, key=lambda p: (-pairs[p], p))[:64]
    vocab = unigram.Vocabulary.of_bytes([bytes([b]) for b in range(256)] + [bytes(p) for p in top])
    by_piece, logp = vocab.by_piece(), np.array(vocab.logp)
    counts = Counter()
    for t in TEXTS:
        counts.update(unigram.expectation((t or "").encode(), by_piece, logp, 2)[1])
    got = {r["piece_id"]: r["exp_count"] for r in result(spark, sf, "unigram_estep")}
    assert all(math.isclose(got.get(i, 0), c, abs_tol=6e-4) for i, c in counts.items()) and math.isclose(sum(got.values()), sum(counts.values()), rel_tol=1e-3)
    got = {r["doc_id"]: r["n_tokens"] for r in result(spark, sf, "viterbi_tokens")}
    for i, t in enumerate(TEXTS):
        n = len((t or "").encode())
        fewest = [0] + [10**9] * n  # all pieces are equally likely: as few as can be
        for end in range(1, n + 1):
            for size in (1, 2):
                if size <= end and (t or "").encode()[end - size : end] in by_piece:
                    fewest[end] = min(fewest[end], fewest[end - size] + 1)
        assert got[i] == fewest[n]


def test_hybrid_query(spark, sf):
    """Four merges by full counts, then an epoch over their pieces."""
    seqs = [list((t or "").encode()) for t in TEXTS]
    pieces = {b: bytes([b]) for b in range(256)}
    for new in range(256, 260):
        counts = Counter(p for s in seqs for p in zip(s, s[1:], strict=False))
        left, right = min(counts, key=lambda p: (-counts[p], p))
        pieces[new] = pieces[left] + pieces[right]
        seqs = [[new if i + 1 < len(s) and (x, s[i + 1]) == (left, right) else x for i, x in enumerate(s) if not (i and (s[i - 1], x) == (left, right))] for s in seqs]
    rows = result(spark, sf, "hybrid_cycle")
    found = {bytes.fromhex(r["piece"]): r["logp"] for r in rows}
    assert set(pieces.values()) <= set(found) and len(rows) <= 280
    assert math.isclose(sum(math.exp(v) for v in found.values()), 1, rel_tol=1e-3)
