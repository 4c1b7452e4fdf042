"""What Python workers hold at once does not grow with a table or with the rows of a batch."""

import random
import tracemalloc

import pyarrow as pa
import pytest

from corpusloom.plans import catalogue, corpus_queries  # noqa: F401

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(n: int) -> str:
    rng = random.Random(n)
    return " ".join("".join(rng.choice("aeiklnrst") for _ in range(rng.randrange(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder, text = tmp_path_factory.mktemp("memory"), words(4_000)
    rows = spark.range(0, 400, 1, 1).selectExpr("id as doc_id", f"substring('{text}', cast(id as int) + 1) as text", "'tr' as lang", "'s' as source", "20000L as n_chars")
    rows.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def captured(spark, sf, name, monkeypatch):
    """The functions that a query gives to mapInArrow."""
    found, kind = [], type(spark.range(0))
    plain = kind.mapInArrow
    with monkeypatch.context() as m:
        m.setattr(kind, "mapInArrow", lambda self, f, *a, **b: found.append(f) or plain(self, f, *a, **b))
        catalogue.queries()[name](spark, sf)
    return found


@pytest.mark.parametrize("name", ["tr_suffixes", "morph_purity", "recompose"])
def test_segments_of_a_large_batch(spark, sf, name, monkeypatch):
    run = captured(spark, sf, name, monkeypatch)[0]
    text = words(600)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "text": [text] * 999 + [None], "lang": ["tr"] * 1000, "source": ["s"] * 1000})
    tracemalloc.start()
    try:
        n = 0
        for out in run(iter([batch])):
            assert out.column(1).nbytes < 1_200_000
            n += out.num_rows
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 1000 and most < 60_000_000


@pytest.mark.parametrize("name", ["bpe_merges_3", "bpe_tokens_after_3", "piece_table", "hybrid_cycle"])
def test_batches_of_tokens_are_small(spark, sf, name, monkeypatch):
    """Partitions of 2 MB of text; sequences of integers would make batches of 8 MB of them."""
    kind = type(spark.range(0))
    plain = kind.mapInArrow

    def watched(f):
        def run(batches):
            def small(b):
                if b.nbytes > 5_000_000:
                    raise ValueError(f"a batch of {b.nbytes} bytes")
                return b

            return f(map(small, batches))

        return run

    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, **b: plain(self, watched(f), *a, **b))
    assert catalogue.queries()[name](spark, sf).count() > 0


def test_merged_sequences_stay_in_the_worker(spark, sf, monkeypatch):
    """What bpe_tokens_after_3 gets back is a row of sums for each document, not its sequences."""
    run = captured(spark, sf, "bpe_tokens_after_3", monkeypatch)[-1]
    text = words(2_000).encode()
    ids, texts = list(range(300)), [*[text] * 297, None, b"", b"zz"]
    out = pa.Table.from_batches(run(iter([pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts, pa.binary())], names=["doc_id", "toks"])])))
    assert out.nbytes < 30_000 and out["doc_id"].to_pylist() == ids
    n, sums = out["n_tokens"].to_pylist(), out["token_sum"].to_pylist()
    assert n[-3:] == [0, 0, 2] and sums[-3:] == [0, 0, 244]
    assert len(set(n[:-3])) == len(set(sums[:-3])) == 1 and 0 < n[0] < len(text)


def test_totals_are_those_of_the_sequences(spark):
    from corpusloom.operators import bpe

    rng = random.Random(5)
    seqs = spark.createDataFrame([(i, [rng.randrange(3) for _ in range(rng.randrange(60))]) for i in range(50)], "doc_id bigint, toks array<int>")
    rules = [(0, 0, 3), (3, 1, 4), (4, 4, 5)]
    for how in ("greedy", "collapse"):
        whole = {r["doc_id"]: (len(r["toks"]), sum(r["toks"])) for r in bpe.apply(seqs, rules, how).collect()}
        assert {r["doc_id"]: (r["n_tokens"], r["token_sum"]) for r in bpe.totals(seqs, rules, how).collect()} == whole
