"""Cycles of merges and unigram epochs: merges give pieces, pieces get probabilities, merges start from those before."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from corpusloom.operators import bpe, unigram


@dataclass
class Hybrid:
    merges: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    vocabulary: unigram.Vocabulary | None = None
    cycles: int = 0
    history: list[dict] = field(default_factory=list)

    def manifest(self, salt: str | None = None) -> dict:
        """What a reader needs to go on; with a salt, merges appear as hashes only."""
        out = {"base_vocab": 256, "vocab_size": len(self.vocabulary.pieces) if self.vocabulary else 256, "cycles": self.cycles, "phase_history": self.history}
        if salt is None:
            out["merges"] = [list(m[1:4]) for m in self.merges]
        else:
            import hashlib

            out["privacy"] = {"redacted": True, "merge_hashes": [hashlib.sha256(salt.encode() + m[1].to_bytes(8, "big") + m[2].to_bytes(8, "big")).hexdigest() for m in self.merges]}
        if self.vocabulary:
            out["unigram_logp"] = self.vocabulary.logp
            out["unigram_pieces"] = [p.hex() for p in self.vocabulary.pieces]
        return out

    @staticmethod
    def from_manifest(data: dict) -> Hybrid:
        merges = [(i, *m, 0) for i, m in enumerate(data.get("merges", []))]
        pieces = [bytes.fromhex(p) for p in data.get("unigram_pieces", [])]
        vocab = unigram.Vocabulary(pieces, list(data["unigram_logp"]), data.get("base_vocab", 256)) if pieces else None
        return Hybrid(merges, vocab, data.get("cycles", 0), list(data.get("phase_history", [])))


def fit(
    seqs: DataFrame, cycles: int, merges_each: int, epochs: int, target: int, longest: int = 16, start: Hybrid | None = None, seconds: float | None = None, warm: list[tuple[int, int]] | None = None,
    freeze: bool = False, min_count: int = 2, tie_seed: int | None = None, on_cycle: Callable[[Hybrid], None] | None = None,
) -> Hybrid:
    """Cycles over the original sequences, those of start included; each starts from the merges so far, the first from warm.

    freeze, min_count and tie_seed are what train() takes; a time budget ends between cycles, and on_cycle follows each."""
    out, began = start or Hybrid(), time.monotonic()
    while out.cycles < cycles and (seconds is None or time.monotonic() - began < seconds):
        before = [(m[1], m[2]) for m in out.merges] or list(warm or [])
        out.merges = bpe.train(seqs, len(before) + merges_each, min_count=min_count, warm=before, freeze=freeze, tie_seed=tie_seed)
        found = bpe.pieces([m[1:4] for m in out.merges])
        names = list(dict.fromkeys(found[i] for i in sorted(found)))
        first = unigram.Vocabulary.of_bytes(names)
        first.base = 256
        out.vocabulary = unigram.fit(seqs, epochs, target, longest, first, "corpus")
        out.cycles += 1
        out.history.append({"cycle": out.cycles, "merges": len(out.merges), "vocab": len(out.vocabulary.pieces)})
        if on_cycle:
            on_cycle(out)
    return out
