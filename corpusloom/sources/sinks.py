"""Writers of vocabularies, reports and checkpoints. Each writes whole files, through a name of its own that is then renamed."""

from __future__ import annotations

import base64
import hashlib
import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from corpusloom.operators import bpe
from corpusloom.operators.hybrid import Hybrid
from corpusloom.operators.unigram import Vocabulary
from corpusloom.sources.store import exists, read_text, write_text

VERSION = 1


def save_bpe(folder: str, merges: list[tuple[int, int, int]], special: dict[str, int] | None = None) -> None:
    """vocab.json, merges.txt, tokenizer.json, merges.tiktoken and bpe_merges.json."""
    found = bpe.pieces(merges)
    names = bpe.strings(found)
    vocab = {names[i]: i for i in sorted(names)} | (special or {})
    listed = bpe.merge_lines(merges, names)
    write_text(f"{folder}/vocab.json", json.dumps(vocab, ensure_ascii=False))
    write_text(f"{folder}/merges.txt", "\n".join(["#version: 0.2", *listed]) + "\n")
    model = {"type": "BPE", "vocab": vocab, "merges": [r.split(" ") for r in listed]}
    split = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    added = [{"id": i, "content": t, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True} for t, i in (special or {}).items()]
    write_text(f"{folder}/tokenizer.json", json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": added, "normalizer": None, "pre_tokenizer": split, "post_processor": None, "decoder": {"type": "ByteLevel"}, "model": model}, ensure_ascii=False))
    unique = {}
    for i in sorted(found):
        unique.setdefault(found[i], i)
    write_text(f"{folder}/merges.tiktoken", "".join(f"{base64.b64encode(p).decode()} {i}\n" for p, i in unique.items()))
    write_text(f"{folder}/bpe_merges.json", json.dumps({"merges": [{"left": a, "right": b, "id": n} for a, b, n in merges]}))


def merge_hashes(merges: list[tuple[int, int, int]], salt: str) -> list[str]:
    """What shows that two lists have a merge in common without showing it."""
    return [hashlib.sha256(salt.encode() + left.to_bytes(8, "big") + right.to_bytes(8, "big")).hexdigest() for left, right, _ in merges]


def save_bpe_redacted(folder: str, merges: list[tuple[int, int, int]], salt: str) -> None:
    """Salted hashes of the merges in place of vocabulary and merges."""
    write_text(f"{folder}/bpe_merges.json", json.dumps({"vocab_size": 256 + len(merges), "privacy": {"redacted": True, "merge_hashes": merge_hashes(merges, salt)}}))


def save_unigram(folder: str, vocab: Vocabulary) -> None:
    """unigram.vocab (piece, score) and unigram.prob (piece, probability of 12 decimals, below a header)."""
    import math

    text = [p.decode("latin-1").replace(" ", "▁") for p in vocab.pieces]
    z = sum(math.exp(v) for v in vocab.logp)
    write_text(f"{folder}/unigram.vocab", "".join(f"{t}\t{v:.6f}\n" for t, v in zip(text, vocab.logp, strict=True)))
    write_text(f"{folder}/unigram.prob", "piece\tprobability\n" + "".join(f"{t}\t{math.exp(v) / z:.12f}\n" for t, v in zip(text, vocab.logp, strict=True)))


def save_hybrid(folder: str, model: Hybrid, salt: str | None = None) -> None:
    write_text(f"{folder}/hybrid_manifest.json", json.dumps(model.manifest(salt), sort_keys=True))
    if model.vocabulary:
        save_unigram(folder, model.vocabulary)
    if salt is None:
        save_bpe(folder, [m[1:4] for m in model.merges])


def save_package(folder: str, vocab: dict[str, int], vectors: list[list[float]], log: list[dict], config: dict) -> None:
    """Four files: vocabulary, embeddings, pruning log and manifest."""
    write_text(f"{folder}/vocab.json", json.dumps(vocab, ensure_ascii=False))
    write_text(f"{folder}/embeddings.json", json.dumps(vectors))
    write_text(f"{folder}/pruning_log.json", json.dumps(log))
    write_text(f"{folder}/manifest.json", json.dumps(config | {"vocab_size": len(vocab), "dimensions": len(vectors[0]) if vectors else 0, "pruned": len(log)}, sort_keys=True))


def save_symbols(path: str, symbols: dict[str, str]) -> str:
    """Beside a source file."""
    write_text(f"{path}.symbols.json", json.dumps(symbols, indent=2))
    return f"{path}.symbols.json"


def save_report(path: str, report: dict, schema: dict | None = None) -> None:
    """With sorted keys, after validation; - prints it."""
    from corpusloom.operators.evaluate import violations

    if schema and (found := violations(report, schema)):
        raise ValueError("; ".join(found))
    text = json.dumps(clean(report), indent=2, sort_keys=True, ensure_ascii=False)
    if path == "-":
        print(text)
    else:
        write_text(path, text)


def clean(value: Any) -> Any:
    """For JSON: no NaN or infinity, bytes as hex."""
    if isinstance(value, dict):
        return {str(k): clean(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [clean(v) for v in value]
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return None if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))) else value


def save_checkpoint(folder: str, trainer: str, state: dict, config: dict, seqs: DataFrame | None = None) -> None:
    """A manifest, and the sequences as Parquet beside it where they are part of the state."""
    if seqs is not None:
        seqs.write.mode("overwrite").parquet(f"{folder}/sequences")
    write_text(f"{folder}/state.json", json.dumps({"version": VERSION, "trainer": trainer, "config": config, "state": clean(state)}))


def load_checkpoint(spark: SparkSession, folder: str, trainer: str, config: dict | None = None) -> tuple[dict, DataFrame | None]:
    """State and sequences; a different trainer, version or setting is an error."""
    data = json.loads(read_text(f"{folder}/state.json"))
    if data["version"] != VERSION or data["trainer"] != trainer:
        raise ValueError(f"a checkpoint of {data['trainer']}, version {data['version']}")
    wrong = {k for k, v in (config or {}).items() if data["config"].get(k) != v}
    if wrong:
        raise ValueError(f"settings differ from the checkpoint's: {', '.join(sorted(wrong))}")
    return data["state"], spark.read.parquet(f"{folder}/sequences") if exists(f"{folder}/sequences") else None
