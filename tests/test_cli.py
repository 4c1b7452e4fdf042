"""The command line end to end on small files, checkpoints and what continues from them."""

import json
import random

import pytest

from corpusloom import cli
from corpusloom.operators import benchmark, bpe, evaluate, export
from corpusloom.sources import formats, sinks, store


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    rng = random.Random(3)
    folder = tmp_path_factory.mktemp("data")
    for k in range(2):
        (folder / f"{k}.txt").write_text("\n".join(" ".join(rng.choice(["tide", "tidal", "stream", "streams"]) for _ in range(9)) for _ in range(20)))
    return f"{folder}/*.txt"


def run(spark, *args):
    assert cli.main([str(x) for x in args]) == 0


def test_bpe_and_resume(spark, data, tmp_path):
    """Training in one go and from a checkpoint of half the merges give the same files; other settings are refused."""
    run(spark, "train-bpe", "--data", data, "--merges", 6, "--out-dir", tmp_path / "whole", "--checkpoint-dir", tmp_path / "c")
    whole = json.loads((tmp_path / "whole" / "bpe_merges.json").read_text())["merges"]
    assert len(whole) == 6 and formats.pair_of_files(str(tmp_path / "whole"))[1] == [tuple(m.values()) for m in whole]
    state = json.loads((tmp_path / "c" / "state.json").read_text())
    state["state"]["merges"] = state["state"]["merges"][:3]
    (tmp_path / "c" / "state.json").write_text(json.dumps(state))
    run(spark, "resume-bpe", "--data", data, "--merges", 6, "--out-dir", tmp_path / "again", "--resume-from", tmp_path / "c")
    assert json.loads((tmp_path / "again" / "bpe_merges.json").read_text())["merges"] == whole
    with pytest.raises(ValueError, match="merges"):
        cli.main(["resume-bpe", "--data", data, "--merges", "7", "--out-dir", str(tmp_path / "x"), "--resume-from", str(tmp_path / "c")])
    run(spark, "train-bpe", "--data", data, "--merges", 4, "--out-dir", tmp_path / "warm", "--warm-start", tmp_path / "whole" / "bpe_merges.json")
    assert json.loads((tmp_path / "warm" / "bpe_merges.json").read_text())["merges"] == whole[:4]


def test_privacy(spark, data, tmp_path):
    run(spark, "train-bpe", "--data", data, "--merges", 3, "--out-dir", tmp_path, "--privacy", "hash-merges", "--privacy-salt", "s")
    hidden = json.loads((tmp_path / "bpe_merges.json").read_text())
    assert hidden["privacy"]["redacted"] and len(hidden["privacy"]["merge_hashes"]) == 3 and not (tmp_path / "merges.txt").exists()
    assert sinks.merge_hashes([(116, 105, 256)], "s") != sinks.merge_hashes([(116, 105, 256)], "t")


def test_unigram_and_hybrid_resume(spark, data, tmp_path):
    common = ["--data", data]
    run(spark, "train-unigram", *common, "--vocab-size", 270, "--epochs", 2, "--out-dir", tmp_path / "u2", "--max-subword-len", 4)
    run(spark, "train-unigram", *common, "--vocab-size", 270, "--epochs", 1, "--out-dir", tmp_path / "u1", "--max-subword-len", 4, "--checkpoint-dir", tmp_path / "uc")
    run(spark, "train-unigram", *common, "--vocab-size", 270, "--epochs", 2, "--out-dir", tmp_path / "u12", "--max-subword-len", 4, "--resume-from", tmp_path / "uc")
    assert (tmp_path / "u12" / "unigram.vocab").read_text() == (tmp_path / "u2" / "unigram.vocab").read_text() != (tmp_path / "u1" / "unigram.vocab").read_text()
    with pytest.raises(ValueError, match="vocab_size"):
        cli.main(["train-unigram", *common, "--vocab-size", "271", "--max-subword-len", "4", "--resume-from", str(tmp_path / "uc"), "--out-dir", str(tmp_path / "x")])
    hybrid = ["train-hybrid", *common, "--merges", 2, "--max-unigram-len", 4]
    run(spark, *hybrid, "--cycles", 2, "--out-dir", tmp_path / "h2")
    run(spark, *hybrid, "--cycles", 1, "--out-dir", tmp_path / "h1", "--checkpoint-dir", tmp_path / "hc")
    run(spark, *hybrid, "--cycles", 2, "--out-dir", tmp_path / "h12", "--resume-from", tmp_path / "hc")
    read = lambda n: json.loads((tmp_path / n / "hybrid_manifest.json").read_text())
    assert read("h12") == read("h2") and len(read("h2")["merges"]) == 4 and read("h1")["cycles"] == 1
    run(spark, *hybrid, "--cycles", 1, "--out-dir", tmp_path / "hw", "--warm-start", tmp_path / "h1" / "bpe_merges.json", "--time-minutes", 5)
    assert read("hw")["merges"][:2] == read("h1")["merges"] and len(read("hw")["merges"]) == 4
    run(spark, *hybrid, "--cycles", 1, "--out-dir", tmp_path / "h0", "--time-minutes", 0)
    assert read("h0")["cycles"] == 0


def test_evaluate_and_export(spark, data, tmp_path, capsys):
    run(spark, "train-bpe", "--data", data, "--merges", 5, "--out-dir", tmp_path / "m")
    run(spark, "evaluate", "--data", data, "--artifacts", tmp_path / "m", "--output", tmp_path / "r.json", "--morphology-lang", "tr")
    report = json.loads((tmp_path / "r.json").read_text())
    assert report["corpus"]["documents"] == 40 and report["artifacts"]["merge_rules"] == 5 and report["oov"]["instances"] == 0
    assert report["compression"]["tokens_per_byte"] < 1 and report["morphology"]["config"]["language"] == "tr" and report["code_mode"]["config"]["enabled"] is False
    run(spark, "train-unigram", "--data", data, "--vocab-size", 280, "--epochs", 1, "--out-dir", tmp_path / "u", "--max-subword-len", 6)
    run(spark, "evaluate", "--data", data, "--vocab", tmp_path / "u" / "unigram.vocab", "--segmentation", "viterbi", "--output", tmp_path / "u.json")
    assert json.loads((tmp_path / "u.json").read_text())["compression"]["tokens_per_byte"] < 1
    (tmp_path / "stats.json").write_text(json.dumps({"a": {"count": 3, "vector": [1.0, 0.0]}, "b": {"count": 1, "vector": [1.0, 0.1]}}))
    (tmp_path / "vocab.json").write_text(json.dumps({"a": 0, "b": 1, "c": 2}))
    run(spark, "export-embeddings", "--vocab", tmp_path / "vocab.json", "--stats", tmp_path / "stats.json", "--dedupe-similarity", 0.9, "--dimension", 2, "--output-dir", tmp_path / "e")
    assert json.loads((tmp_path / "e" / "vocab.json").read_text()) == {"a": 0, "c": 1}
    log = json.loads((tmp_path / "e" / "pruning_log.json").read_text())
    assert [(x["token"], x["merged_into"], x["action"]) for x in log] == [("b", "a", "deduped")]
    assert json.loads((tmp_path / "e" / "embeddings.json").read_text())[0] == pytest.approx([1.0, 0.025])
    capsys.readouterr()
    run(spark, "stream-batches", "--data", data, "--batch-size", 16)
    assert len(capsys.readouterr().out.splitlines()) == 3
    with pytest.warns(UserWarning, match="--device"):
        run(spark, "train-bpe", "--data", data, "--dry-run", "--device", "cuda")


def test_clusters():
    """Made-up vectors take part in comparisons, never in what is exported."""
    c = export.Clusters(0.5, {"keep"})
    for token, count, vector in [("a", 2.0, None), ("b", 6.0, [1.0, 0.0]), ("keep", 1.0, [1.0, 0.0]), ("c", 2.0, [1.0, 0.2])]:
        c.add(token, ord(token[0]), count, vector, vector or [1.0, 1.0])
    assert [(h["token"], h["count"]) for h in c.heads] == [("a", 10.0), ("keep", 1.0)] and [x["merged_into"] for x in c.log] == ["a", "a"]
    assert c.heads[0]["vector"] == pytest.approx([1.0, 0.05]) and c.heads[1]["vector"] == [1.0, 0.0]
    assert export.standing_vector("x", 4, 1) != export.standing_vector("x", 4, 2) and max(map(abs, export.standing_vector("x", 50))) <= 1


def test_formats_and_store(spark, tmp_path):
    pieces, scores = formats.imported_pieces([("▁a", -1.0), ("<0x41>", -2.0), ("ş", -3.0)], 4)
    assert pieces[:3] == [b" a", b"A", "ş".encode()] and scores == [-1.0, -2.0, -3.0, -20.0] and len(formats.imported_pieces([("a", 0.0), ("b", 0.0)], 1)[0]) == 1
    assert formats.piece_of("6162") == b"ab" and formats.piece_of("xyz") == b"xyz" and formats.piece_of(formats.hex_piece(b"\xff")) == b"\xff"
    path = f"file://{tmp_path}/deep/x.json"
    store.write_text(path, "ü")
    store.write_text(path, "ö")
    assert store.read_text(path) == "ö" == store.read_text(f"{tmp_path}/deep/x.json") and store.exists(path) and not store.exists(f"{path}.part")
    sinks.save_bpe(str(tmp_path), [(97, 98, 256)])
    (tmp_path / "merges.txt").write_text("#version: 0.2\na c\n")
    with pytest.raises(ValueError, match="line 2"):
        formats.pair_of_files(str(tmp_path))
    assert formats.warm_start(str(tmp_path)) == [(97, 98)]


def test_benchmark(spark, data, tmp_path, capsys):
    run(spark, "benchmark", "--data", data, "--bpe-merges", 2, "--unigram-vocab", 260, "--output-dir", tmp_path, "--partitions", 1, 2)
    out = capsys.readouterr().out
    assert "bpe-2" in out and "hybrid" in out and (tmp_path / "summary.md").read_text() in out
    points = benchmark.history(spark, str(tmp_path))
    assert sorted(r["name"] for r in points.collect()) == ["bpe-1", "bpe-2", "hybrid", "unigram"]
    report = json.loads(next(tmp_path.glob("benchmark-*.json")).read_text())
    assert [s["reference"] for s in report["scaling"]] == ["bpe-1"] and report["corpus"]["sequences"] == 40
    slow = report | {"timestamp": "9999", "runs": [r | {"tokens_per_second": r["tokens_per_second"] / (2 if r["name"] == "unigram" else 1)} for r in report["runs"]]}
    benchmark.save(str(tmp_path), slow)
    assert benchmark.regressions(spark, str(tmp_path)) == ["unigram"]
    with pytest.raises(ValueError, match="runs"):
        benchmark.save(str(tmp_path), report | {"runs": []})
    with pytest.raises(ValueError, match="none of"):
        benchmark.Spec("x", "other")


def test_other_tokenizers(spark):
    import public_tokenizers
    import tiktoken

    texts = ["It's  two words", "", None, "çok güzel 123"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = formats.ranks(path)
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    counts = {r["doc_id"]: (r["tokens"], r["bytes"]) for r in evaluate.tokenizer_counts(docs, path).collect()}
    assert counts == {i: (len(library.encode_ordinary(t or "")), len((t or "").encode())) for i, t in enumerate(texts)}
    total = evaluate.tokenizer_stats(evaluate.tokenizer_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))).first()
    assert total["documents"] == 4 and total["tokens"] > 0 and total["bytes"] == sum(b for _, b in counts.values())
    few = {p: r for p, r in ranks.items() if r < 400}  # a trained list's beginning, as merges of ids
    rules = [(a, b, r) for r, a, b in formats.splits(few)]
    small = tiktoken.Encoding("y", pat_str=r"[\s\S]+", mergeable_ranks=few, special_tokens={})
    single = {p[0]: r for p, r in few.items() if len(p) == 1}
    seqs = spark.createDataFrame([(i, [single[b] for b in (t or "").encode()]) for i, t in enumerate(texts)], "doc_id bigint, toks array<int>")
    encoded = {r["doc_id"]: r["toks"] for r in bpe.apply(seqs, rules).collect()}
    assert encoded == {i: small.encode_ordinary(t or "") for i, t in enumerate(texts)}
    pieces = spark.createDataFrame([(r, bytearray(p)) for p, r in few.items()], "id int, piece binary")
    back = {r["doc_id"]: bytes(r["bytes"]) for r in bpe.decode(bpe.apply(seqs, rules), pieces).collect()}
    assert back == {i: t.encode() for i, t in enumerate(texts) if t}
