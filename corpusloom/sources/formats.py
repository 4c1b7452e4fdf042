"""Vocabulary, merge and statistics files: readers that take what the writers here and common tools make. These files are small; they are
read on the driver, from any store that Spark reads."""

from __future__ import annotations

import base64
import json
import re
from typing import Any

from corpusloom.functions.tokens import alphabet
from corpusloom.sources.store import exists, read_text


def vocabulary(path: str) -> dict[str, int]:
    """Tokens to ids: a JSON map, or a .vocab or .prob file by lines, where the first line of a token counts."""
    text = read_text(path)
    if path.endswith(".json"):
        data = json.loads(text)
        data = data.get("model", {}).get("vocab", data) if isinstance(data, dict) else {t: i for i, t in enumerate(data)}
        return {t: int(i) for t, i in data.items()}
    out: dict[str, int] = {}
    rows = [r for r in text.splitlines() if r]
    if path.endswith(".prob") and rows and not is_number(rows[0].split("\t")[-1]):
        rows = rows[1:]  # its header
    for i, row in enumerate(rows):
        out.setdefault(row.split("\t")[0], i)
    return out


def is_number(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return True


def merge_rules(path: str, vocab: dict[str, int], strict_compat: bool = False) -> list[tuple[int, int, int]]:
    """(left, right, new_id) of a merges file in any of its forms: lists of ids or names, mappings with left, right and id, or lines.

    strict_compat takes lines and the mapping by step as giving no rules."""
    text = read_text(path)
    if path.endswith(".json"):
        data = json.loads(text)
        if isinstance(data, dict):
            data = data.get("model", {}).get("merges") or data.get("merges") or ([] if strict_compat else [data[k] for k in sorted(data, key=lambda k: int(k) if k.isdigit() else 0) if isinstance(data[k], (list, dict))])
    else:
        rows = text.splitlines()
        if rows and rows[0].startswith("#version"):
            rows = rows[1:]  # any later # is a token
        data = [] if strict_compat else [r.split(" ") for r in rows if r.strip()]
    return [r for i, x in enumerate(data) if (r := rule(x, vocab, i)) is not None]


def rule(x: Any, vocab: dict[str, int], step: int) -> tuple[int, int, int] | None:
    if isinstance(x, str):
        x = x.split(" ")
    if isinstance(x, dict):
        left, right, new = x.get("left"), x.get("right"), x.get("id", x.get("new_id"))
    else:
        left, right, new = (*x, None)[:3]
    if isinstance(left, str) and isinstance(right, str):
        new = new if new is not None else vocab.get(left + right)
        left, right = vocab.get(left), vocab.get(right)
    elif new is None:
        new = 256 + step
    return None if None in (left, right, new) else (int(left), int(right), int(new))


def stats(path: str) -> list[tuple[str, float, list[float] | None]]:
    """(token, count, vector) of a JSON map whose values are a number, a vector, or a mapping with count or frequency and vector."""
    out = []
    for token, v in json.loads(read_text(path)).items():
        if isinstance(v, (int, float)):
            out.append((token, float(v), None))
        elif isinstance(v, list):
            out.append((token, 0.0, [float(x) for x in v]))
        else:
            vector = v.get("vector")
            out.append((token, float(v.get("count", v.get("frequency", 0.0))), [float(x) for x in vector] if vector else None))
    return out


def ranks(path: str) -> dict[bytes, int]:
    """Pieces and ranks of lines `base64 rank`."""
    return {base64.b64decode(a): int(b) for a, b in (r.split() for r in read_text(path).splitlines() if r.strip())}


def tokenizer(path: str) -> tuple[dict[str, int], list[tuple[int, int, int]]]:
    """Vocabulary and merges of a tokenizer.json, whose merges must all name tokens that it has."""
    model = json.loads(read_text(path))["model"]
    vocab = {t: int(i) for t, i in model["vocab"].items()}
    out = []
    for m in model.get("merges", []):
        left, right = m.split(" ") if isinstance(m, str) else m
        if left not in vocab or right not in vocab or left + right not in vocab:
            raise ValueError(f"a merge of tokens that the vocabulary lacks: {left} {right}")
        out.append((vocab[left], vocab[right], vocab[left + right]))
    return vocab, out


def pair_of_files(folder: str) -> tuple[dict[str, int], list[tuple[int, int, int]]]:
    """Vocabulary and merges of a folder with tokenizer.json, or with vocab.json and merges.txt; where it has both, they must agree."""
    found = []
    if exists(f"{folder}/tokenizer.json"):
        found.append(tokenizer(f"{folder}/tokenizer.json"))
    if exists(f"{folder}/vocab.json") and exists(f"{folder}/merges.txt"):
        vocab = vocabulary(f"{folder}/vocab.json")
        merges = []
        for number, row in enumerate(read_text(f"{folder}/merges.txt").splitlines()):
            if not row.strip() or (number == 0 and row.startswith("#version")):
                continue
            left, _, right = row.partition(" ")
            if left not in vocab or right not in vocab or left + right not in vocab:
                raise ValueError(f"line {number + 1} of merges.txt: a merge of tokens that vocab.json lacks: {row}")
            merges.append((vocab[left], vocab[right], vocab[left + right]))
        found.append((vocab, merges))
    if not found:
        raise FileNotFoundError(f"neither tokenizer.json nor vocab.json and merges.txt in {folder}")
    if len(found) == 2 and (found[0][1] != found[1][1] or any(found[1][0].get(t, i) != i for t, i in found[0][0].items())):
        raise ValueError(f"tokenizer.json and the files beside it in {folder} disagree")
    return found[0]


def scored_pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a .vocab file, or of a .model file where its package is installed."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path.removeprefix("file://"))
        return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
    out = []
    for row in read_text(path).splitlines():
        piece, _, score = row.partition("\t")
        if score and is_number(score):
            out.append((piece, float(score)))
    return out


def imported_pieces(scored: list[tuple[str, float]], size: int | None = None, missing: float = -20.0) -> tuple[list[bytes], list[float]]:
    """Pieces as bytes with their scores, as many as size, if it is given: cut off, or filled with unused pieces of the missing score.

    A lower one eighth block stands for a blank, and <0xNN> for a byte."""
    pieces, scores = [], []
    for text, score in scored[:size]:
        byte = re.fullmatch(r"<0x([0-9A-Fa-f]{2})>", text)
        pieces.append(bytes.fromhex(byte[1]) if byte else text.replace("▁", " ").encode())
        scores.append(score)
    for i in range(len(pieces), size or 0):
        pieces.append(f"<unused{i}>".encode())
        scores.append(missing)
    return pieces, scores


def hex_piece(piece: bytes) -> str:
    return piece.hex()


def piece_of(text: str) -> bytes:
    """The bytes of a piece in a checkpoint: hexadecimal digits; what is none is taken as Latin-1, or as UTF-8."""
    try:
        return bytes.fromhex(text)
    except ValueError:
        try:
            return text.encode("latin-1")
        except UnicodeEncodeError:
            return text.encode()


def warm_start(path: str) -> list[tuple[int, int]]:
    """The pairs to start from, of a folder of tokenizer files, a tokenizer.json, a rank file, a merges file or a manifest of merges."""
    if "." not in path.rstrip("/").rsplit("/", 1)[-1]:
        for name in ("bpe_merges.json", "hybrid_manifest.json", "merges.tiktoken"):
            if exists(f"{path}/{name}"):
                return warm_start(f"{path}/{name}")
        return [(a, b) for a, b, _ in pair_of_files(path)[1]]
    if path.endswith("tokenizer.json"):
        return [(a, b) for a, b, _ in tokenizer(path)[1]]
    if path.endswith(".tiktoken"):
        return [(a, b) for _, a, b in splits(ranks(path))]
    if path.endswith(".txt"):
        ids: dict[str, int] = {c: b for b, c in alphabet().items()}
        out = []
        for number, row in enumerate(read_text(path).splitlines()):
            left, _, right = row.partition(" ")
            if right and not (number == 0 and row.startswith("#version")) and left in ids and right in ids:
                out.append((ids[left], ids[right]))
                ids[left + right] = 255 + len(out)
        return out
    data = json.loads(read_text(path))
    return [(int(m["left"]), int(m["right"])) if isinstance(m, dict) else (int(m[0]), int(m[1])) for m in (data["merges"] if isinstance(data, dict) else data)]


def splits(found: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """(rank, left, right) of longer pieces: the first split into pieces of lower ranks."""
    out = []
    for piece, rank in sorted(found.items(), key=lambda x: x[1]):
        if len(piece) > 1:
            cut = next(((found[piece[:i]], found[piece[i:]]) for i in range(1, len(piece)) if found.get(piece[:i], rank) < rank and found.get(piece[i:], rank) < rank), None)
            if cut is None:
                raise ValueError(f"piece {piece!r} has no split of lower ranks")
            out.append((rank, *cut))
    return out
