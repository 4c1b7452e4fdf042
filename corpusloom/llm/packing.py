"""Vector bin packing of tokenised examples under limits on tokens, segments and loss-bearing tokens.

Each input partition packs its own examples in one streaming pass: a window of waiting pieces is held, an open sequence takes the
waiting piece with the largest dot product of its demand and the sequence's residual capacity among those that fit (weights: the
reciprocal capacities), and what no piece fits is filled with a cut of the longest one. There is no shuffle, no state beyond the
window, and a task that is run again gives the same sequences, because its input is the same file split in the same order.

Defined cases: null or empty text has the terminator alone; an empty table gives no rows; repeated rows and repeated doc_ids are
packed once for each row; a null doc_id stays null; texts longer than a sequence are cut; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import id_and_text, ready, slices_of, text_slices

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, loss_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("loss_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
#: Strings of these characters alone are split and encoded piece by piece; others go through the whole tokenizer.
_PLAIN = re.compile("[!-~À-įı-ɏ]+").fullmatch


@dataclass(frozen=True)
class Limits:
    """What a sequence holds at most."""

    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048


class WordEncoder:
    """Ids of whole texts, as the tokenizer file gives them, as little-endian unsigned 32-bit bytes.

    No pre-token of this tokenizer spans white space, so that the ids of a text are those of its parts between blanks and line
    feeds, one after the other; parts and pre-tokens seen before come from caches of bounded size."""

    PARTS, PIECES = 400_000, 500_000
    #: Lower-case pieces of these characters are merged as byte strings over an alphabet that tells a piece's last byte from others.
    LETTERS, MARKS = [*range(97, 123), *range(0xC3, 0xCA), *range(0x80, 0xC0)], [*range(33, 65), *range(91, 97), *range(123, 127)]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.added = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.byte_char = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        vocab, end = self.tokenizer.get_vocab(with_added_tokens=False), self.model.end_of_word_suffix
        self.mergers = [self.merger(vocab, end, alphabet) for alphabet in (self.LETTERS, self.MARKS)]
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # the cache before this one, so that frequent parts stay
        self.pieces: dict[str, bytes] = {}

    def merger(self, vocab: dict[str, int], end: str, alphabet: list[int]) -> tuple:
        """The vocabulary's merges over an alphabet: its bytes, a table from them to symbols, what marks the last one, and the rank merger."""
        import tiktoken

        code = {b: i for i, b in enumerate(alphabet)}
        of_char = {self.byte_char[b]: i for b, i in code.items()}
        last, ranks = len(alphabet), {}
        for token, rank in vocab.items():
            body = token.removesuffix(end)
            if body and all(c in of_char for c in body):
                symbols = [of_char[c] for c in body]
                symbols[-1] += last * (body != token)
                ranks[bytes(symbols)] = rank
        for b in range(2 * last, 256):  # never used; the merger wants every byte
            ranks[bytes([b])] = 10_000_000 + b
        table = bytes(code.get(b, 0) for b in range(256))
        return bytes(alphabet), table, last, tiktoken.Encoding("merger", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def piece(self, piece: str) -> bytes:
        """Ids of a lower-case pre-token; KeyError where its alphabet lacks one of its bytes."""
        found = self.pieces.get(piece)
        if found is None:
            if len(self.pieces) >= self.PIECES:
                self.pieces.clear()
            alphabet, table, last, merge = self.mergers[not piece[0].isalpha()]
            raw = piece.encode()
            if unknown := raw.translate(None, alphabet):
                raise KeyError(unknown)
            symbols = bytearray(raw.translate(table))
            symbols[-1] += last
            found = self.pieces[piece] = array("I", merge(bytes(symbols))).tobytes()
        return found

    def part(self, part: str) -> bytes:
        if not _PLAIN(part):
            return self.whole(part)
        try:
            return b"".join(map(self.piece, self.split(part.lower())))
        except KeyError:  # contractions, signs and letters beyond the alphabets
            return self.whole(part)

    def __call__(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            return self.whole(text)
        parts, cache = text.replace("\n", " ").split(" "), self.parts
        try:
            return b"".join(map(cache.__getitem__, parts))
        except KeyError:
            if len(cache) >= self.PARTS:
                self.older, cache = cache, {}
                self.parts = cache
            older = self.older
            for p in [p for p in set(parts) if p not in cache]:
                cache[p] = older[p] if p in older else self.part(p)
            return b"".join(map(cache.__getitem__, parts))


@lru_cache(1)
def word_encoder(path: str) -> WordEncoder:
    """One for each worker process, so that its caches outlive a task."""
    return WordEncoder(path)


class Packer:
    """Waiting pieces, and the sequences made of them."""

    def __init__(self, limits: Limits, window: int):
        self.limits, self.window = limits, window
        self.most = max(window, limits.segments)  # short pieces wait until they fill a sequence's segments
        size = self.most + window + 64
        self.need = np.full(size, np.inf)  # tokens; a free slot needs infinitely many
        self.loss = np.zeros(size)
        self.held: list = [None] * size
        self.free = list(range(size - 1, -1, -1))
        self.tokens = 0

    def add(self, piece: tuple) -> None:
        """piece: (doc_id, start, ids as bytes, the document's tokens, loss-bearing tokens as the last so many of the piece)."""
        i = self.free.pop()
        self.held[i] = piece
        self.need[i], self.loss[i] = len(piece[2]) // 4, piece[4]
        self.tokens += len(piece[2]) // 4

    def take(self, i: int, tokens: int) -> tuple:
        """The first tokens of a waiting piece; the rest stays."""
        doc, start, ids, total, loss = self.held[i]
        n = len(ids) // 4
        self.tokens -= tokens
        if tokens == n:
            self.held[i] = None
            self.need[i], self.loss[i] = np.inf, 0
            self.free.append(i)
            return doc, start, ids, total, loss
        rest = min(loss, n - tokens)
        self.held[i] = (doc, start + tokens, ids[4 * tokens :], total, rest)
        self.need[i], self.loss[i] = n - tokens, rest
        return doc, start, ids[: 4 * tokens], total, loss - rest

    def sequence(self, capacity: int) -> list[tuple]:
        """The next sequence. Each waiting piece has one segment, which adds the same to every dot product."""
        tokens_left, segments_left, loss_left, out = capacity, self.limits.segments, self.limits.loss_tokens, []
        while tokens_left and segments_left and len(self.free) < len(self.held):
            dot = self.need * (tokens_left / capacity**2) + self.loss * (loss_left / self.limits.loss_tokens**2) + segments_left / self.limits.segments**2
            dot[(self.need > tokens_left) | (self.loss > loss_left)] = -1
            i = int(dot.argmax())
            if dot[i] >= 0:
                tokens = int(self.need[i])
            else:  # nothing fits: a cut of the longest one
                i = int(np.where(np.isinf(self.need), -1, self.need).argmax())
                n, loss = int(self.need[i]), int(self.loss[i])
                tokens = min(tokens_left, n, n - loss + loss_left)  # loss-bearing tokens are the last ones
                if tokens <= 0:
                    break
            taken = self.take(i, tokens)
            out.append(taken)
            tokens_left, segments_left, loss_left = tokens_left - tokens, segments_left - 1, loss_left - taken[4]
        return out

    def ready(self, last: bool) -> Iterator[list[tuple]]:
        """Sequences that can be closed, by tokens or, of short pieces, by segments; the last tokens go into sequences at powers of
        two, which need no padding."""
        while True:
            waiting = len(self.held) - len(self.free)
            if waiting <= self.most and not (self.tokens >= self.limits.tokens and (last or waiting > self.window)):
                break
            yield self.sequence(self.limits.tokens)
        while last and self.tokens:
            yield self.sequence(min(self.limits.tokens, 1 << (self.tokens.bit_length() - 1)))


def _rows(sequences: Iterator[list[tuple]], first: int, schema: pa.Schema = _ARROW) -> Iterator[pa.RecordBatch]:
    """Batches of a schema's columns; where it has several before start, a piece's document is a tuple of them."""
    several = schema.get_field_index("start") > 1
    rows: list[tuple] = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for k, pieces in enumerate(sequences):
        offset = 0
        for doc, start, ids, total, loss in pieces:
            n = len(ids) // 4
            rows.append((*(doc if several else (doc,)), start, n, ids, total, loss, first + k, offset))
            offset += n
        if len(rows) >= 2000:
            yield out()
            rows = []
    if rows:
        yield out()


def pack(examples: Iterator[tuple], limits: Limits, window: int) -> Iterator[list[tuple]]:
    """Sequences, as lists of pieces, of examples (doc_id, ids as bytes, loss-bearing tokens)."""
    packer, most = Packer(limits, window), 4 * limits.tokens
    for doc, ids, loss in examples:
        total = len(ids) // 4
        for at in range(0, len(ids), most):
            part = ids[at : at + most]
            n = len(part) // 4
            packer.add((doc, at // 4, part, total, max(0, min(n, loss - (total - at // 4 - n)) if loss < total else n)))
            yield from packer.ready(False)
    yield from packer.ready(True)


def pack_documents(docs: DataFrame, tokenizer_path: str, limits: Limits = Limits(), window: int = 256, terminator: int = 1, encoder: Callable = word_encoder) -> DataFrame:
    """A row for each piece: its document, place in the document's ids, ids (little-endian unsigned 32-bit), sequence and offset there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer_path), np.array([terminator], dtype="<u4").tobytes()
        examples = ((d, ids, len(ids) // 4) for keys, texts in text_slices(batches) for d, t in zip(keys, texts, strict=True) for ids in (encode(t) + end,))
        context = TaskContext.get()
        yield from _rows(pack(examples, limits, window), (context.partitionId() if context else 0) << 33)

    return id_and_text(docs).mapInArrow(run, SCHEMA)


TURNS = "conv_id long, turn long, example long, start long, length long, ids binary, example_tokens long, loss_tokens long, sequence_id long, offset long"
_TURNS = pa.schema([(f.split(" ")[0], pa.binary() if f.endswith("binary") else pa.int64()) for f in TURNS.split(", ")])


def pack_conversations(turns: DataFrame, tokenizer_path: str, limits: Limits = Limits(2048, 32, 1536), window: int = 256, loss_role: str = "assistant") -> DataFrame:
    """Instruction data (conv_id, turn, role, text): every turn is an example, and only turns of loss_role bear loss.

    A row for each piece: its conversation, turn and example (a number that no other row of the table has), then as in pack_documents().
    Null texts have the terminator alone, a null role bears no loss, null identifiers stay null, and rows that repeat a turn are examples
    of their own; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = word_encoder(tokenizer_path), np.array([1], dtype="<u4").tobytes()
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 33

        def examples() -> Iterator[tuple]:
            number = base
            for b in (x for batch in batches for x in slices_of(batch, 2)):
                for c, turn, text, role in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                    ids = encode(text or "") + end
                    yield (c, turn, number), ids, len(ids) // 4 * (role == loss_role)
                    number += 1

        yield from _rows(pack(examples(), limits, window), base, _TURNS)

    ready(turns.sparkSession)
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "text", "role").mapInArrow(run, TURNS)
