"""Command line: train-bpe, resume-bpe, train-unigram, train-hybrid, evaluate, export-embeddings, stream-batches, benchmark."""

from __future__ import annotations

import argparse
import json
import sys
import time
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import benchmark, bpe, code, evaluate, export, hybrid, morphology, sequences, unigram
from corpusloom.session import session
from corpusloom.sources import files, formats, sinks, store

#: Flags about devices, threads and transfers, which the cluster manager and Spark see to: taken, and ignored with a warning.
IGNORED = ["--device", "--io-workers", "--prefetch-batches", "--prefetch-jitter", "--target-util", "--min-batch", "--max-batch", "--token-bytes", "--log-every", "--bpe-log-every", "--dtype"]
PRIVACY = ["none", "hash-merges", "tie-randomize"]
TRAINERS = ("train-bpe", "resume-bpe", "train-unigram", "train-hybrid")


def flags(p: argparse.ArgumentParser, *named: tuple[str, object]) -> None:
    """Options by name and default, whose type is the default's; a type stands for no default."""
    for name, default in named:
        if isinstance(default, bool):
            p.add_argument(name, action="store_true")
        elif isinstance(default, type):
            p.add_argument(name, type=default)
        else:
            p.add_argument(name, type=type(default), default=default)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("corpusloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    made = {name: sub.add_parser(name) for name in (*TRAINERS, "evaluate", "export-embeddings", "stream-batches", "benchmark")}
    for name, c in made.items():
        flags(c, ("--master", "local[*]"), ("--bos", int), ("--eos", int), ("--seed", 1337), *((x, str) for x in IGNORED))
        if name not in ("export-embeddings", "benchmark"):
            c.add_argument("--data", nargs="+", required=True)
            flags(c, ("--code-mode", False), ("--code-langs", str), ("--meta-compress", False), ("--meta-max-length", 8), ("--morphology-lang", str))
            for option in ("--morphology-case-markers", "--morphology-affix-tags"):
                c.add_argument(option, action=argparse.BooleanOptionalAction, default=True)
        if name in TRAINERS or name == "stream-batches":
            c.add_argument("--compression", default="none", choices=["none", "zstd", "gzip", "lz4"])
            c.add_argument("--augmentation", default="none", choices=["none", "entropy", "diffusion"])
            flags(c, ("--aug-strength", 0.0), ("--batch-size", 1024))
        if name in TRAINERS:
            flags(c, ("--base-vocab", 256), ("--out-dir", f"./{name.removeprefix('train-').removeprefix('resume-')}_out"), ("--checkpoint-dir", str), ("--checkpoint-every", 0), ("--resume-from", str), ("--dry-run", False), ("--time-minutes", float), ("--warm-start", str))
        if name in ("train-bpe", "resume-bpe", "train-hybrid"):
            flags(c, ("--merges", 50_000), ("--min-count", 2), ("--freeze-warm-start", False), ("--tie-seed", int), ("--privacy-salt", str))
            c.add_argument("--privacy", default="none", choices=PRIVACY)
    flags(made["train-unigram"], ("--vocab-size", 50_000), ("--max-subword-len", 8), ("--epochs", 1))
    flags(made["train-hybrid"], ("--cycles", 1), ("--unigram-epochs", 1), ("--max-unigram-len", 8), ("--vocab-size", int))
    flags(made["stream-batches"], ("--max-batches", int))
    e = made["evaluate"]
    flags(e, ("--artifacts", str), ("--vocab", str), ("--merges", str), ("--tokenizer", str), ("--model-type", str), ("--output", "-"), ("--segmentation", str), ("--schema", str), ("--deterministic", False))
    x = made["export-embeddings"]
    x.add_argument("--vocab", required=True)
    x.add_argument("--keep-token", action="append", default=[])
    b = made["benchmark"]
    b.add_argument("--data", nargs="+")
    b.add_argument("--partitions", nargs="+", type=int)
    flags(b, ("--output-dir", "./benchmark_out"), ("--bpe-merges", 8), ("--unigram-vocab", 288), ("--max-real-docs", int), ("--synthetic-docs", 256), ("--synthetic-max-len", 512), ("--synthetic-vocab", 256), ("--tolerance", 0.1))
    flags(x, ("--output-dir", "./embeddings_out"), ("--dimension", 16), ("--stats", str), ("--min-frequency", 0.0), ("--dedupe-similarity", float))
    return p


def texts(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """(doc_id, text) of the data: lines of text files, or the tokens of source files, one to a line."""
    if a.code_mode:
        languages = set(a.code_langs.split(",")) if a.code_langs else None
        rows = files.code(spark, a.data, languages).withColumn("doc_id", F.monotonically_increasing_id())
        samples = code.linearized(rows)
        trees = samples.where("kind = 'ast'").select("doc_id", "str_toks")
        if a.meta_compress:
            trees = code.compressed(trees, a.meta_max_length)[0]
        plain = samples.where("kind = 'bytes'").join(rows.select("doc_id", F.col("source").alias("text")), "doc_id").select("doc_id", "text")
        return trees.select("doc_id", code.corpus_text(trees).alias("text")).unionByName(plain)
    if getattr(a, "compression", "none") != "none":
        return files.lines_of(files.decompressed(files.shards(spark, a.data)))
    return files.lines(spark, a.data)


def corpus(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    docs = texts(spark, a)
    if a.morphology_lang:  # segments are sequences of their own, so that no merge crosses them
        options = {"case_markers": a.morphology_case_markers, "affix_tags": a.morphology_affix_tags} if a.morphology_lang == "tr" else {}
        cut = morphology.segmented(docs, a.morphology_lang, **options)
        docs = cut.select(F.col("doc_id"), F.posexplode("segments.surface").alias("pos", "text")).select((F.col("doc_id") * (1 << 20) + F.col("pos")).alias("doc_id"), "text")
    seqs = sequences.encode(docs, a.bos, a.eos)
    how = sequences.Augmentation(a.augmentation, a.aug_strength, a.seed)
    return sequences.augment(seqs, how) if how.enabled else seqs


def deadline(minutes: float | None):
    until = None if minutes is None else time.monotonic() + 60 * minutes
    return (lambda: time.monotonic() >= until) if until is not None else (lambda: False)


def train_bpe(spark: SparkSession, a: argparse.Namespace) -> None:
    config = {"base_vocab": a.base_vocab, "merges": a.merges, "min_count": a.min_count}
    done: list[tuple] = []
    if a.resume_from and store.exists(f"{a.resume_from}/state.json"):
        done = [tuple(m) for m in sinks.load_checkpoint(spark, a.resume_from, "bpe", config)[0]["merges"]]
    elif a.resume_from:  # a folder of tokenizer files instead of a checkpoint
        done = [(i, *m, 0) for i, m in enumerate(formats.pair_of_files(a.resume_from)[1])]
    elif a.command == "resume-bpe":
        raise SystemExit("resume-bpe needs --resume-from")
    warm = [m[1:3] for m in done] or (formats.warm_start(a.warm_start) if a.warm_start else [])
    over, kept = deadline(a.time_minutes), list(done)

    def step(number: int, merge: tuple, count: int) -> bool:
        kept.append((number, *merge, count))
        if a.checkpoint_dir and a.checkpoint_every and len(kept) % a.checkpoint_every == 0:
            sinks.save_checkpoint(a.checkpoint_dir, "bpe", {"merges": kept}, config)
        return not over()

    seed = a.tie_seed if a.tie_seed is not None else a.seed if a.privacy == "tie-randomize" else None
    found = bpe.train(corpus(spark, a), a.merges, a.base_vocab, a.min_count, warm, a.freeze_warm_start, seed, on_step=step)
    found = done + found[len(done) :]
    if a.checkpoint_dir:
        sinks.save_checkpoint(a.checkpoint_dir, "bpe", {"merges": found}, config)
    rules = [m[1:4] for m in found]
    sinks.save_bpe_redacted(a.out_dir, rules, a.privacy_salt or "") if a.privacy == "hash-merges" else sinks.save_bpe(a.out_dir, rules)


def train_unigram(spark: SparkSession, a: argparse.Namespace) -> None:
    config = {"base_vocab": a.base_vocab, "vocab_size": a.vocab_size, "max_subword_len": a.max_subword_len}
    start = None
    if a.resume_from:
        start = unigram.Vocabulary.from_state(sinks.load_checkpoint(spark, a.resume_from, "unigram", config)[0])
    elif a.warm_start:
        start = unigram.Vocabulary(*formats.imported_pieces(formats.scored_pieces(a.warm_start)), base=0)
        lacking = [bytes([b]) for b in range(256) if bytes([b]) not in set(start.pieces)]
        start.pieces, start.logp = lacking + start.pieces, [min(start.logp, default=0.0)] * len(lacking) + start.logp
        start.base = len(lacking)

    def saved(vocab: unigram.Vocabulary) -> None:
        if a.checkpoint_dir and len(vocab.history) % max(1, a.checkpoint_every) == 0:
            sinks.save_checkpoint(a.checkpoint_dir, "unigram", vocab.state(), config)

    vocab = unigram.fit(corpus(spark, a), a.epochs, a.vocab_size, a.max_subword_len, start, batch_size=a.batch_size, deadline=deadline(a.time_minutes), on_epoch=saved)
    if a.checkpoint_dir:
        sinks.save_checkpoint(a.checkpoint_dir, "unigram", vocab.state(), config)
    sinks.save_unigram(a.out_dir, vocab)


def train_hybrid(spark: SparkSession, a: argparse.Namespace) -> None:
    config = {"base_vocab": a.base_vocab, "merges": a.merges, "unigram_epochs": a.unigram_epochs, "max_unigram_len": a.max_unigram_len}
    start = hybrid.Hybrid.from_manifest(sinks.load_checkpoint(spark, a.resume_from, "hybrid", config)[0]) if a.resume_from else None

    def saved(model: hybrid.Hybrid) -> None:
        if a.checkpoint_dir and model.cycles % max(1, a.checkpoint_every) == 0:
            sinks.save_checkpoint(a.checkpoint_dir, "hybrid", model.manifest(), config)

    warm = formats.warm_start(a.warm_start) if a.warm_start else None
    seed = a.tie_seed if a.tie_seed is not None else a.seed if a.privacy == "tie-randomize" else None
    seconds = None if a.time_minutes is None else 60 * a.time_minutes
    model = hybrid.fit(corpus(spark, a), a.cycles, a.merges, a.unigram_epochs, a.vocab_size or a.base_vocab + a.merges, a.max_unigram_len, start, seconds, warm, a.freeze_warm_start, a.min_count, seed, saved)
    if a.checkpoint_dir:
        sinks.save_checkpoint(a.checkpoint_dir, "hybrid", model.manifest(), config)
    sinks.save_hybrid(a.out_dir, model, (a.privacy_salt or "") if a.privacy == "hash-merges" else None)


def evaluated(spark: SparkSession, a: argparse.Namespace) -> None:
    def beside(*names: str) -> str | None:
        return next((f"{a.artifacts}/{n}" for n in names if a.artifacts and store.exists(f"{a.artifacts}/{n}")), None)

    vocab = a.vocab or beside("vocab.json", "unigram.prob", "unigram.vocab")
    if not vocab:
        raise SystemExit("evaluate needs --vocab, or --artifacts with one")
    merges, tokenizer = a.merges or beside("merges.json", "bpe_merges.json", "merges.txt"), a.tokenizer or beside("tokenizer.json")
    if a.code_mode:
        languages = set(a.code_langs.split(",")) if a.code_langs else None
        sources = files.code(spark, a.data, languages).withColumn("doc_id", F.monotonically_increasing_id())
        report = evaluate.evaluate_code(spark, sources, formats.vocabulary(vocab), a.meta_compress, a.meta_max_length)
    else:
        options = {"case_markers": a.morphology_case_markers, "affix_tags": a.morphology_affix_tags}
        report = evaluate.from_files(spark, a.data, vocab, merges, tokenizer, a.segmentation, model=a.model_type, language=a.morphology_lang, bos=a.bos, eos=a.eos, morphology_options=options)
    sinks.save_report(a.output, report, json.loads(store.read_text(a.schema)) if a.schema else None)


def exported(spark: SparkSession, a: argparse.Namespace) -> None:
    vocab, stats = formats.vocabulary(a.vocab), {t: (c, v) for t, c, v in formats.stats(a.stats)} if a.stats else {}
    rows = [(t, i, *stats.get(t, (0.0, None))) for t, i in sorted(vocab.items(), key=lambda x: x[1])]
    frame = spark.createDataFrame(rows, "token string, id bigint, count double, vector array<double>")
    kept, log = export.pruned(frame, a.min_frequency, a.keep_token)
    kept = kept.select("token", kept["new_id"].alias("id"), "count", "vector")
    lost = [r.asDict() for r in log.collect()]
    if a.dedupe_similarity is not None:
        kept, merged = export.deduplicated(kept, a.dedupe_similarity, a.keep_token, a.dimension, a.seed)
        lost += [r.asDict() for r in merged.collect()]
    final = [(r["token"], i, r["count"], r["vector"]) for i, r in enumerate(kept.orderBy("id").collect())]
    sinks.save_package(a.output_dir, {t: i for t, i, _, _ in final}, export.embeddings(final, a.dimension, a.seed), lost, {"original_size": len(vocab)})


def streamed(spark: SparkSession, a: argparse.Namespace) -> None:
    """A line for each batch, by order; all of them, or max_batches."""
    shapes = sequences.batch_shapes(sequences.batches(corpus(spark, a), a.batch_size))
    if a.max_batches:
        shapes = shapes.where(F.col("batch") < a.max_batches)
    for r in shapes.orderBy("batch").toLocalIterator():
        shape = (r["n_rows"], r["width"])
        print(f"batch {r['batch']}: tokens={shape} mask={shape} lengths={(r['n_rows'],)}")


def benchmarked(spark: SparkSession, a: argparse.Namespace) -> None:
    """Runs over the data, or made-up sequences; exits with the runs that have become slower than the folder's first report allows."""
    if a.data:
        docs = files.lines(spark, a.data)
        seqs = sequences.encode(sequences.limited(docs, a.max_real_docs) if a.max_real_docs else docs, a.bos, a.eos)
    else:
        seqs = sequences.synthetic(spark, a.synthetic_docs, a.synthetic_max_len, a.synthetic_vocab, a.seed)
    report = benchmark.run(seqs, benchmark.default_specs(a.bpe_merges, a.unigram_vocab, a.partitions), a.data or ["synthetic"])
    benchmark.save(a.output_dir, report)
    print(benchmark.table(report))
    if slower := benchmark.regressions(spark, a.output_dir, a.tolerance):
        raise SystemExit(f"slower than at first: {', '.join(slower)}")


HANDLERS = {"train-bpe": train_bpe, "resume-bpe": train_bpe, "train-unigram": train_unigram, "train-hybrid": train_hybrid, "evaluate": evaluated, "export-embeddings": exported, "stream-batches": streamed, "benchmark": benchmarked}


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    for flag in IGNORED:
        if getattr(a, flag[2:].replace("-", "_")) is not None:
            warnings.warn(f"{flag} has no meaning here and is ignored", stacklevel=1)
    if getattr(a, "base_vocab", 256) < 256:
        raise SystemExit("--base-vocab must hold all bytes")
    spark = session(a.master)
    if getattr(a, "dry_run", False):
        summary = sequences.summary(corpus(spark, a)).first().asDict()
        print(json.dumps({"command": a.command, **summary}))
        return 0
    HANDLERS[a.command](spark, a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
