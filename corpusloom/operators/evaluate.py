"""Evaluation of a vocabulary on a corpus: compression, unknown tokens, segmentation and code reduction, as one nested report."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.tokens import ratio
from corpusloom.operators import bpe, code, morphology, sequences, unigram
from corpusloom.session import make_importable
from corpusloom.sources import formats


def corpus_totals(docs: DataFrame, seqs: DataFrame) -> DataFrame:
    """Documents, bytes, tokens and their averages, 0 where nothing is there."""
    b = docs.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("bigint").alias("total_bytes"))
    t = seqs.agg(F.coalesce(F.sum(F.size("toks")), F.lit(0)).cast("bigint").alias("total_tokens"))
    both = b.crossJoin(t)  # one row each
    return both.select("*", ratio(F.col("total_bytes"), F.col("documents")).alias("average_bytes"), ratio(F.col("total_tokens"), F.col("documents")).alias("average_tokens"))


def compression(totals: DataFrame) -> DataFrame:
    return totals.select(ratio(F.col("total_tokens"), F.col("total_bytes")).alias("tokens_per_byte"), ratio(F.col("total_bytes"), F.col("total_tokens")).alias("bytes_per_token"))


def tokenizer_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, tokens, bytes) as a tokenizer file of another library counts them: tokenizer.json, a rank file, or a SentencePiece model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([count(t) for t in texts], pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64())], names=["doc_id", "tokens", "bytes"])

    make_importable(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, tokens bigint, bytes bigint")


@lru_cache(4)
def counter(path: str) -> Callable[[str], int]:
    """A text's number of tokens, by one of the libraries; one for each worker process."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(model.encode(t))
    if path.endswith(".tiktoken"):
        import tiktoken

        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        encoding = tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=formats.ranks(path), special_tokens={})
        return lambda t: len(encoding.encode_ordinary(t))
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)


def tokenizer_stats(counts: DataFrame) -> DataFrame:
    """Documents, bytes and tokens of tokenizer_counts(), with bytes a token and tokens a document."""
    sums = counts.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    return sums.select("*", ratio(F.col("bytes"), F.col("tokens")).alias("bytes_per_token"), ratio(F.col("tokens"), F.col("documents")).alias("tokens_per_document"))


def unknown(tokens: DataFrame, known: DataFrame) -> DataFrame:
    """(tok, cnt) of counted tokens that are not in known (tok)."""
    return tokens.join(known.select("tok"), "tok", "left_anti")


def oov(tokens: DataFrame, known: DataFrame) -> DataFrame:
    """Instances, rate and number of distinct unknown tokens, of counted tokens (tok, cnt)."""
    marked = tokens.join(known.select("tok", F.lit(1).alias("known")), "tok", "left")
    lost = F.when(F.col("known").isNull(), F.col("cnt")).otherwise(0)
    sums = marked.agg(F.coalesce(F.sum(lost), F.lit(0)).alias("instances"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("tokens"), F.count_if(F.col("known").isNull()).alias("distinct_items"))
    return sums.select("instances", ratio(F.col("instances"), F.col("tokens")).alias("rate"), "distinct_items")


def model_type(vocab: str, merges: str | None, asked: str | None) -> str:
    """bpe, unigram or hybrid: what is asked for, else by the files' names."""
    if asked:
        if asked not in ("bpe", "unigram", "hybrid"):
            raise ValueError(f"unknown model type {asked}")
        return asked
    name = vocab.rsplit("/", 1)[-1].lower()
    if "hybrid" in name or name.endswith(".prob"):
        return "hybrid"
    if name.endswith((".vocab", ".model")):
        return "unigram"
    return "bpe"


def evaluate(
    spark: SparkSession, docs: DataFrame, vocab: dict[str, int], merges: list[tuple[int, int, int]], *, bos: int | None = None, eos: int | None = None, language: str | None = None,
    morphology_options: dict | None = None, artifacts: dict | None = None, segment=None,
) -> dict[str, Any]:
    """The report over plain text (doc_id, text). segment: a function of sequences to use instead of merges."""
    base = sequences.encode(docs, bos, eos)
    seqs = (segment(base) if segment else bpe.apply(base, merges, "greedy")).persist()
    try:
        counted = seqs.select(F.explode("toks").alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("cnt")).persist()
        totals = corpus_totals(docs, seqs).first().asDict()
        ids = spark.createDataFrame([(int(i),) for i in set(vocab.values())] or [(-1,)], "tok int")
        lost = unknown(counted, ids).select("tok", "cnt").orderBy("tok").collect()  # distinct ids of a vocabulary
        rate = oov(counted, ids).first()
        counted.unpersist()
    finally:
        seqs.unpersist()
    tokens, size = totals["total_tokens"], totals["total_bytes"]
    report = {
        "artifacts": {"vocab": None, "vocab_size": len(vocab), "merges": None, "merge_rules": len(merges), "tokenizer": None, "model_type": "bpe"} | (artifacts or {}),
        "corpus": totals,
        "compression": {"tokens_per_byte": tokens / size if size else 0.0, "bytes_per_token": size / tokens if tokens else 0.0},
        "oov": {"instances": rate["instances"], "rate": rate["rate"], "unique": [r["tok"] for r in lost]},
        "morphology": morphology_report(docs, language, **(morphology_options or {})),
        "code_mode": {"mode": "plain", "documents": totals["documents"], "reduction": 0.0, "config": code_config(False)},
    }
    return report


def code_config(enabled: bool, languages: list[str] | None = None, meta: bool = False, longest: int = 8) -> dict:
    return {"enabled": enabled, "languages_filter": languages, "meta_compress": meta, "meta_max_length": longest}


def morphology_report(docs: DataFrame, language: str | None, case_markers: bool = True, affix_tags: bool = True) -> dict:
    """How a language's plugin cuts the documents; the two options are Turkish's."""
    config = {"enabled": language is not None, "language": language, "case_markers": case_markers, "affix_tags": affix_tags}
    if language is None:
        return {"enabled": False, "documents": 0, "tagged_segments": 0, "total_segments": 0, "average_segments": 0.0, "roles": {}, "purity": 0.0, "config": config}
    options = {"case_markers": case_markers, "affix_tags": affix_tags} if language == "tr" else {}
    cut = morphology.segmented(docs, language, **options).persist()
    counted = {r["role"]: r["cnt"] for r in morphology.roles(cut).where("role in ('affix', 'case')").orderBy("role").collect()}
    out = {"enabled": True} | morphology.totals(cut).first().asDict() | {"roles": counted, "config": config}
    cut.unpersist()
    return out


def evaluate_code(spark: SparkSession, sources: DataFrame, vocab: dict[str, int], meta: bool = False, longest: int = 8) -> dict[str, Any]:
    """The report over sources (doc_id, language, source)."""
    samples = code.linearized(sources).persist()
    trees = samples.where("kind = 'ast'").select("doc_id", "str_toks")
    metas: dict[str, list[str]] = {}
    if meta:
        trees, metas = code.compressed(trees, longest)
    names = trees.select(F.explode("str_toks").alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("cnt"))
    raw = samples.where("kind = 'bytes'").select(F.explode("byte_toks").alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("cnt"))
    known_names = spark.createDataFrame([(t,) for t in vocab] or [("",)], "tok string")
    known_ids = spark.createDataFrame([(int(i),) for i in set(vocab.values())] or [(-1,)], "tok int")
    a, b = oov(names, known_names).first(), oov(raw, known_ids).first()
    lost = [r["tok"] for r in unknown(raw, known_ids).orderBy("tok").collect()] + [r["tok"] for r in unknown(names, known_names).orderBy("tok").collect()]
    total = sum(r["n"] or 0 for d in (names, raw) for r in d.agg(F.sum("cnt").alias("n")).collect())
    kinds = {r["kind"]: r["n"] for r in samples.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = sources.agg(F.coalesce(F.sum(F.octet_length("source")), F.lit(0))).first()[0]
    cut = code.reduction(trees, spark.createDataFrame([(k, v) for k, v in metas.items()] or [("", [])], "name string, pattern array<string>")).first()["reduction"] if meta else 0.0
    languages = sorted(r["language"] for r in samples.select("language").distinct().collect())
    samples.unpersist()
    n = sum(kinds.values())
    return {
        "corpus": {"documents": n, "total_bytes": size, "total_tokens": total, "average_bytes": size / n if n else 0.0, "average_tokens": total / n if n else 0.0},
        "compression": {"tokens_per_byte": total / size if size else 0.0, "bytes_per_token": size / total if total else 0.0},
        "oov": {"instances": a["instances"] + b["instances"], "rate": (a["instances"] + b["instances"]) / total if total else 0.0, "unique": lost},
        "code_mode": {"mode": "code", "documents": n, "ast_samples": kinds.get("ast", 0), "fallback_samples": kinds.get("bytes", 0), "languages": languages, "meta_compress": metas, "reduction": cut, "config": code_config(True, None, meta, longest)},
    }


def nested_sum(value: Any) -> float:
    """The sum of all numbers in nested lists and mappings."""
    if isinstance(value, dict):
        return sum(map(nested_sum, value.values()))
    if isinstance(value, (list, tuple, set)):
        return sum(map(nested_sum, value))
    return value if isinstance(value, (int, float)) and not isinstance(value, bool) else 0


_KINDS = {"object": dict, "array": list, "string": str, "number": (int, float), "integer": int, "boolean": bool, "null": type(None)}


def violations(value: Any, schema: dict, root: dict | None = None, at: str = "$") -> list[str]:
    """What of a value breaks a JSON schema; the part of the language: type, enum, anyOf, $ref, bounds, required, properties, items."""
    root = root or schema
    if "$ref" in schema:
        target = root
        for part in schema["$ref"].removeprefix("#/").split("/"):
            target = target[part]
        return violations(value, target, root, at)
    out: list[str] = []
    if "anyOf" in schema and all(violations(value, s, root, at) for s in schema["anyOf"]):
        out.append(f"{at}: fits none of the alternatives")
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: {value!r} is not one of {schema['enum']}")
    if "type" in schema:
        kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        if not any(isinstance(value, _KINDS[k]) and not (isinstance(value, bool) and k in ("number", "integer")) for k in kinds):
            return [*out, f"{at}: {type(value).__name__} instead of {', '.join(kinds)}"]
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            out.append(f"{at}: below {schema['minimum']}")
        if value > schema.get("maximum", value):
            out.append(f"{at}: above {schema['maximum']}")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}: no {k}" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in known:
                out += violations(v, known[k], root, f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}: {k} is not known")
            elif isinstance(schema.get("additionalProperties"), dict):
                out += violations(v, schema["additionalProperties"], root, f"{at}.{k}")
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0):
            out.append(f"{at}: fewer than {schema['minItems']} items")
        if "items" in schema:
            for i, v in enumerate(value):
                out += violations(v, schema["items"], root, f"{at}[{i}]")
    return out


def from_files(spark: SparkSession, paths: list[str], vocab_path: str, merges_path: str | None = None, tokenizer: str | None = None, segmentation: str | None = None, **options) -> dict[str, Any]:
    """The report of text files, by lines, with a vocabulary and merges read from files.

    segmentation: viterbi cuts texts into the scored pieces of a .vocab or .prob file; otherwise merges alone are applied."""
    from corpusloom.sources import files

    vocab = formats.vocabulary(vocab_path)
    merges = formats.merge_rules(merges_path, vocab) if merges_path else []
    artifacts = {"vocab": vocab_path, "merges": merges_path, "tokenizer": tokenizer, "model_type": model_type(vocab_path, merges_path, options.pop("model", None))}
    segment = None
    if segmentation == "viterbi":
        pieces, scores = formats.imported_pieces(formats.scored_pieces(vocab_path))
        pieces += [bytes([b]) for b in range(256) if bytes([b]) not in set(pieces)]  # so that every text has a path
        scores += [min(scores, default=0.0) - 10.0] * (len(pieces) - len(scores))
        model = unigram.Vocabulary(pieces, scores)
        segment = lambda seqs: unigram.segment(seqs, model)
    elif segmentation is not None:
        raise ValueError(f"unknown segmentation {segmentation}")
    return evaluate(spark, files.lines(spark, paths), vocab, merges, artifacts=artifacts, segment=segment, **options)
