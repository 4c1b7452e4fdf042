"""Morphology, code, evaluation, export, formats and streams on small fixtures."""

import json
import math
import os
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from corpusloom.operators import code, evaluate, export, histograms, morphology, sequences, telemetry
from corpusloom.plans import catalogue, corpus_queries  # noqa: F401
from corpusloom.sources import files, formats, sinks
from corpusloom.streaming import leases, shards


def segments(spark, text, language, **options):
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    return [(s["surface"], list(s["tags"]), s["role"]) for s in morphology.segmented(docs, language, **options).first()["segments"]]


def test_turkish(spark):
    text = "Trenle köylere döndük; bahçeler'de İİ bekliyor. Söz: 7 kapıcılar"
    found = segments(spark, text, "tr")
    assert "".join(s for s, _, _ in found) == text
    assert found[0][0] == "Tren" and found[1] == ("le", ["CASE=INS"], "case")
    at = next(i for i, s in enumerate(found) if s[0] == "lere")
    assert found[at - 1][0] == "köy" and found[at][1] == ["AFFIX=PL", "CASE=DAT"]
    assert not any(r == "case" for _, _, r in segments(spark, text, "tr", case_markers=False))
    assert not any(r == "affix" for _, _, r in segments(spark, text, "tr", affix_tags=False))


def test_segmented_bytes(spark):
    """What is no UTF-8 is kept as one segment without tags."""
    rows = [(1, bytearray("köylere".encode())), (2, bytearray(b"\xff\xfe a")), (3, None)]
    found = {r["doc_id"]: r["segments"] for r in morphology.segmented_bytes(spark.createDataFrame(rows, "doc_id bigint, payload binary"), "tr").collect()}
    assert [s["surface"] for s in found[1]] == ["köy", "lere"] and [(s["surface"].encode("latin-1"), list(s["tags"]), s["role"]) for s in found[2]] == [(b"\xff\xfe a", [], None)]
    assert found[3] == []


def test_scripts(spark):
    found = segments(spark, "雨のち晴れ、GPU 12枚²", "ja")
    assert [(s, t[0][-8:]) for s, t, _ in found] == [("雨", "PT=KANJI"), ("のち", "HIRAGANA"), ("晴", "PT=KANJI"), ("れ", "HIRAGANA"), ("、", "RY=PUNCT"), ("GPU", "PT=LATIN"), (" ", "RY=SPACE"), ("12", "=NUMERIC"), ("枚", "PT=KANJI"), ("²", "=NUMERIC")]
    assert [r for _, _, r in found].count("separator") == 2
    korean = segments(spark, "바람 부는 날?\u3000٣", "ko")
    assert [t[0].split("=")[1] for _, t, _ in korean] == ["HANGUL", "SPACE", "HANGUL", "SPACE", "HANGUL", "PUNCT", "SPACE", "NUMERIC"]


def test_code(spark):
    rows = [(1, "python", "def f(x):\n    return x + 1\n"), (2, "python", "def ("), (3, "typescript", "let a = 1"), (4, None, None)]
    found = {r["doc_id"]: r for r in code.linearized(spark.createDataFrame(rows, "doc_id bigint, language string, source string")).collect()}
    assert [found[i]["kind"] for i in (1, 2, 3, 4)] == ["ast", "bytes", "bytes", "bytes"]
    assert found[1]["symbols"] == {"SYM0": "f", "SYM1": "x"} and found[1]["str_toks"][0] == "node|Module|"
    seqs = spark.createDataFrame([(1, list("ABCABC")), (2, list("XABCY"))], "doc_id bigint, str_toks array<string>")
    short, metas = code.compressed(seqs, 3, 2)
    assert metas == {"META0": ["A", "B", "C"]}
    assert {r["doc_id"]: r["str_toks"] for r in short.collect()} == {1: ["META0", "META0"], 2: ["X", "META0", "Y"]}


def test_code_many_patterns(spark):
    """A dictionary beyond the size that goes to every task gives the same as a small one."""
    rng = random.Random(6)
    rows = [(i, [rng.choice("abcdefgh") for _ in range(rng.randint(0, 60))]) for i in range(80)] + [(80, None), (81, []), (None, list("abcabc")), (3, list("abab"))]
    seqs = spark.createDataFrame(rows, "doc_id bigint, str_toks array<string>").repartition(3)
    short, metas = code.compressed(seqs, 4, 2)
    many, found = code.compressed(seqs, 4, 2, most=5)
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["str_toks"])
    assert len(metas) > 5 and found == metas and sorted(many.collect(), key=key) == sorted(short.collect(), key=key)
    frame = spark.createDataFrame(list(metas.items()), "name string, pattern array<string>")
    assert code.pattern_reduction(seqs, 4, 2).first()["reduction"] == code.reduction(short, frame).first()["reduction"] > 0
    blocks = code.in_blocks(seqs, 100)
    assert blocks.select("block").distinct().count() > 10
    named = code.block_patterns(blocks, 4, 2).withColumn("name", F.to_json("pattern"))
    assert sum(len(r["str_toks"]) for r in code.rewritten_in_blocks(blocks, named).collect()) == sum(len(r["str_toks"]) for r in short.collect())
    assert code.pattern_reduction(seqs.limit(0), 4, 2).first()["reduction"] == 0.0


def test_evaluation(spark):
    docs = spark.createDataFrame([(1, "abab"), (2, "")], "doc_id bigint, text string")
    report = evaluate.evaluate(spark, docs, {"ab": 256, "a": 97}, [(97, 98, 256)], language="tr")
    assert report["corpus"]["total_tokens"] == 2 and report["corpus"]["total_bytes"] == 4
    assert report["oov"] == {"instances": 0, "rate": 0.0, "unique": []}
    empty = evaluate.evaluate(spark, docs.limit(0), {}, [])
    assert empty["corpus"]["average_tokens"] == 0.0 and empty["compression"]["tokens_per_byte"] == 0.0
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 1}}, "additionalProperties": False}
    assert evaluate.violations({"a": 1}, schema) == [] and len(evaluate.violations({"a": 0, "b": 1}, schema)) == 2


def test_export(spark):
    rows = [("<unk>", 0, 0.0, None), ("sun", 1, 9.0, [0.25, 0.75]), ("moon", 2, 3.0, [0.25, 0.75]), ("dust", 3, 0.2, None)]
    vocab = spark.createDataFrame(rows, "token string, id bigint, count double, vector array<double>")
    kept, log = export.pruned(vocab, 1.0, ["<unk>"])
    assert [r["token"] for r in kept.orderBy("new_id").collect()] == ["<unk>", "sun", "moon"] and [r["token"] for r in log.collect()] == ["dust"]
    heads, merged = export.deduplicated(vocab, 0.99, ["<unk>"], 2)
    assert "moon" not in [r["token"] for r in heads.collect()]
    assert [(r["token"], r["merged_into"]) for r in merged.collect()][0] == ("moon", "sun")


def test_formats(spark, tmp_path):
    merges = [(97, 98, 256), (256, 99, 257), (35, 35, 258)]
    sinks.save_bpe(str(tmp_path), merges)
    vocab = formats.vocabulary(f"{tmp_path}/vocab.json")
    for name in ("merges.txt", "bpe_merges.json", "tokenizer.json"):
        assert formats.merge_rules(f"{tmp_path}/{name}", vocab) == merges
    assert formats.merge_rules(f"{tmp_path}/merges.txt", vocab, strict_compat=True) == []
    for name in ("merges.txt", "bpe_merges.json", "tokenizer.json", "merges.tiktoken"):
        assert formats.warm_start(f"{tmp_path}/{name}") == [m[:2] for m in merges]
    sinks.save_checkpoint(f"{tmp_path}/c", "bpe", {"merges": merges}, {"min_count": 2})
    assert sinks.load_checkpoint(spark, f"{tmp_path}/c", "bpe", {"min_count": 2})[0] == {"merges": [list(m) for m in merges]}


def test_files(spark, tmp_path):
    (tmp_path / "b.txt").write_text("two\r\nthree\x0bfour\n\n", newline="")
    (tmp_path / "a.txt").write_text("one")
    import zstandard

    os.makedirs(tmp_path / "z")
    (tmp_path / "z" / "x.zst").write_bytes(zstandard.compress(b"packed"))
    assert [r["text"] for r in files.lines(spark, [f"{tmp_path}/*.txt"]).orderBy("doc_id").collect()] == ["one", "two", "three", "four"]
    assert bytes(files.decompressed(files.shards(spark, [f"{tmp_path}/z"])).first()["content"]) == b"packed"
    (tmp_path / "m.jsonl").write_text(json.dumps({"language": "Python", "source": "x = 1"}) + "\n" + json.dumps({"language": "toml", "source": "a"}))
    assert [r["language"] for r in files.code(spark, [f"{tmp_path}/m.jsonl"], {"python"}).collect()] == ["python"]


def test_lines_by_splits(spark, tmp_path):
    """No line is lost where adaptive execution joins partitions, and files are cut into splits; numbers have no gaps."""
    want = []
    for f in range(8):
        lines = [f"{f}-{i} " + "x" * 590 for i in range(3000)]
        (tmp_path / f"{f}.txt").write_text("\n".join(lines))
        want += lines
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400k")
    try:
        found = files.lines(spark, [str(tmp_path)]).orderBy("doc_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["text"] for r in found] == want and [r["doc_id"] for r in found] == list(range(24000))


def test_batches(spark):
    """Every row has a batch under adaptive execution, whatever the partitions; repeated orders have places of their own."""
    seqs = spark.range(1000).select((F.col("id") % 700).alias("doc_id"), F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: i.cast("int")).alias("toks"))
    shapes = sequences.batch_shapes(sequences.batches(seqs, 64)).orderBy("batch").collect()
    assert [(r["batch"], r["n_rows"]) for r in shapes] == [(i, 64) for i in range(15)] + [(15, 40)]
    assert sequences.batches(seqs.limit(0), 64).count() == 0


def test_streams(spark):
    docs = spark.createDataFrame([(i, "abcabc" * i) for i in range(6)], "doc_id bigint, text string")
    want = {tuple(r) for r in histograms.pairs(sequences.encode(docs)).collect()}
    assert {tuple(r) for r in shards.stream_pair_counts(spark, docs).collect()} == want
    state = ("free", 0)
    for event in ("grant", "timeout", "grant", "complete", "grant"):
        state = leases.step(*state, event)
    assert state == ("done", 2)
    events = [(1, 1, "r0", "grant"), (1, 2, "r0", "fail"), (1, 3, "r1", "grant"), (2, 4, "r1", "grant"), (2, 5, "r1", "complete"), (3, 6, "r2", "heartbeat")]
    found = leases.final_states(spark, spark.createDataFrame(events, "chunk_id bigint, at bigint, rank string, event string")).collect()
    assert sorted(map(tuple, found)) == [(1, "r1", "leased", 2), (2, "r1", "done", 1), (3, "r2", "free", 0)]


def test_shards_and_chunks(spark, tmp_path):
    """A stream of shards resumes after what it has had; records of consumed shards; chunks and names of jobs."""
    import zstandard

    source, seen = tmp_path / "in", []
    source.mkdir()
    record = f"{tmp_path}/record"
    for k in range(2):
        (source / f"{k}.zst").write_bytes(zstandard.compress(f"shard {k}".encode()))
        (source / f"{k}.bin").write_bytes(f"plain {k}".encode())
        fresh = files.not_consumed(files.shards(spark, [str(source)]), files.remembered(spark, record))
        assert sorted(r["path"].rsplit("/")[-1] for r in fresh.collect()) == [f"{k}.bin", f"{k}.zst"]
        files.remember(fresh, record)
        batch = lambda df, _: seen.extend(bytes(r["content"]).decode() for r in df.collect())
        shards.shard_stream(spark, str(source), 1).writeStream.foreachBatch(batch).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        assert sorted(seen) == sorted(f"{n} {i}" for n in ("plain", "shard") for i in range(k + 1))
    assert {r["offset"] for r in files.remembered(spark, record).collect()} >= {7}
    rows = leases.chunk_rows(spark.createDataFrame([("a", 10), ("b", 0), ("c", 4)], "key string, total bigint"), 4).collect()
    assert sorted((r["key"], r["chunk_id"], r["start"], r["end"]) for r in rows) == [(n, *c) for n, t in (("a", 10), ("c", 4)) for c in leases.chunks(t, 4)]
    assert leases.job_id(["a", "b"]) != leases.job_id(["ab"]) and len(leases.job_id([])) == 22


def test_control(spark):
    """Depths, scales and states at the edges of their rules."""
    rows = [(None, 4, 0.9, 8), (0.8, 4, 0.95, 8), (0.0, 3, 0.85, 2), (0.4, 1, 0.7, 8)]
    f = spark.createDataFrame(rows, "u double, depth int, mean double, limit int")
    assert [r[0] for r in f.select(telemetry.backpressure_depth(F.col("u"))).collect()] == [8, 1, 8, 5]
    depth = lambda event: [r[0] for r in f.select(telemetry.prefetch(F.lit(event), F.col("depth"), F.col("mean"), F.lit(0.8), 1, 8)).collect()]
    assert depth("oom") == [2, 2, 1, 1] and depth("high_utilization") == [3, 2, 2, 1] and depth("low_utilization") == [5, 5, 4, 2] and depth("other") == [4, 4, 3, 1]
    scale = lambda s, r, m: f.limit(1).select(telemetry.lease_scale(F.lit(s).cast("double"), F.lit(r), F.lit(m))).first()[0]
    assert [scale(None, 9.0, 1.0), scale(1.0, 9.0, 1.0), scale(1.0, 0.1, 1.0), scale(2.0, 0.0, 1.0), scale(None, 0.0, 0.0)] == [4.0, 1.5, 0.5, 2.0, 1.0]
    assert [r[0] for r in f.select(telemetry.lease_limit(F.col("limit"), F.lit(0.5), 8)).collect()] == [7, 7, 3, 7]
    state = "mean_vram double, var_vram double, fallback double, oom boolean, samples int, batch int, workers int, transfer int"
    states = [(0.5, 0.0, 0.1, False, 8, 100, 4, 1000), (0.5, 0.02, 0.0, False, 8, 100, 4, 1000), (0.99, 0.0, 0.5, False, 8, 100, 4, 1000), (0.85, 0.0, 0.1, False, 8, 100, 4, 1000), (0.5, 0.0, 0.1, False, 2, 100, 4, 1000), (0.5, 0.0, 0.1, True, 8, 100, 1, 1000)]
    found = [tuple(r) for r in telemetry.tuned(spark.createDataFrame(states, state)).select("next_batch", "next_workers", "next_transfer").collect()]
    assert found == [(118, 4, 1090), (105, 4, 1027), (85, 5, 975), (100, 4, 1000), (100, 4, 1000), (50, 1, 1000)]


def test_telemetry(spark):
    rows = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([3, 5, 1, 8])], "k int, t int, v double")
    want = 3.0
    for v in (5, 1, 8):
        want = 0.2 * v + 0.8 * want
    assert abs(telemetry.ewma(rows, "k", ["t"], "v", 0.2).first()["ewma"] - want) < 1e-9
    zero = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "w string, x double")
    assert {r["weight"] for r in telemetry.weights(zero, "w", "x").collect()} == {0.5}
    augmented = sequences.augment(spark.createDataFrame([(0, list(range(50)))], "doc_id bigint, toks array<int>"), sequences.Augmentation("diffusion", 0.5, 3))
    toks = augmented.first()["toks"]
    assert sorted(toks) == list(range(50)) and toks != list(range(50))
    assert augmented.select(F.size("toks")).first()[0] == 50


def test_entry():
    import __spark_entry__ as entry

    assert entry.oracle_sql().keys() <= entry.queries().keys() and len(entry.queries()) > 50


def test_all_pairs(spark, tmp_path):
    """Vectors of every label are compared, and those of all blocks and lengths."""
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], i % 3) for i in range(60)] + [(i, [1.0, 2.0, 3.0, 4.0], i % 3) for i in range(60, 70)]
    rows += [(70, [1.0, 2.0], 0), (71, [], 1), (72, None, 1), (73, [0.0] * 4, 2), (74, [1.0, None, 3.0, 4.0], 0), (None, [1.0, 2.0, 3.0, 4.0], 0), (60, [1.0, 2.0, 3.0, 4.0], 1)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")

    def cos(x, y):
        n = min(len(x), len(y))
        norm = math.sqrt(sum(p * p for p in x[:n]) * sum(q * q for q in y[:n]))
        return sum(p * q for p, q in zip(x, y, strict=False)) / norm if norm else -1.0

    whole = [(i, [float(np.float32(e)) for e in v]) for i, v, _ in rows if i is not None and v and None not in v]
    want = sorted((min(i, j), max(i, j), round(cos(x, y), 5)) for k, (i, x) in enumerate(whole) for j, y in whole[k + 1 :] if i != j and cos(x, y) >= 0.5)
    for block in (7, 2048):
        assert sorted((r["a"], r["b"], round(r["similarity"], 5)) for r in export.all_pairs(vectors, 0.5, block=block).collect()) == want
    assert export.all_pairs(vectors.limit(0), 0.5).count() == export.links(vectors.limit(0), 0.5).count() == 0
    count, best = Counter(), {}
    for a, b, c in want:
        for i in (a, b):
            count[i] += 1
            best[i] = max(best.get(i, -1), c)
    for block in (7, 2048):
        assert {r["vec_id"]: (r["links"], round(r["best"], 5)) for r in export.links(vectors, 0.5, block=block).collect()} == {i: (n, best[i]) for i, n in count.items()}
    vectors.where("size(embedding) = 4").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {r["vec_id"]: r["links"] for r in catalogue.queries()["dedupe_pairs_cosine"](spark, str(tmp_path)).collect()}
    assert found[60] >= 10 and found[61] >= 10  # of all labels
