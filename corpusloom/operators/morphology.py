"""Segmentation of text into tagged segments that put together give the text again. Plugins are registered by name.

Script runs are regular expressions over built-in functions; Turkish suffixes are stripped in a loop, word by word, in Arrow batches."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.batches import slices
from corpusloom.session import make_importable

SEGMENTS = "array<struct<surface:string,tags:array<string>,role:string>>"
#: Distinct words whose segments a task keeps at most.
WORDS_KEPT = 50_000

# The letters of a Turkish word.
TURKISH_WORD = re.compile(r"[A-Za-zÇĞİÖŞÜçğıöşüÂÎÛâîû']+")
TURKISH_PARTS = re.compile(f"({TURKISH_WORD.pattern})")
# Turkish case suffixes and their tags, in the order in which they are tried.
TURKISH_CASES = [
    (["lardan", "lerden"], ["AFFIX=PL", "CASE=ABL"]),
    (["larda", "lerde"], ["AFFIX=PL", "CASE=LOC"]),
    (["lara", "lere"], ["AFFIX=PL", "CASE=DAT"]),
    (["dan", "den", "tan", "ten"], ["CASE=ABL"]),
    (["yla", "yle", "la", "le"], ["CASE=INS"]),
    (["na", "ne", "ya", "ye", "a", "e"], ["CASE=DAT"]),
    (["nın", "nin", "nun", "nün", "ın", "in", "un", "ün"], ["CASE=GEN"]),
    (["ı", "i", "u", "ü"], ["CASE=ACC"]),
]
# Other Turkish suffixes and their tags, in the order in which they are tried.
TURKISH_AFFIXES = [
    (["lar", "ler"], ["AFFIX=PL"]),
    (["cı", "ci", "cu", "cü"], ["AFFIX=AGENT"]),
    (["siz", "sız", "suz", "süz"], ["AFFIX=WITHOUT"]),
    (["miş", "mış", "muş", "müş"], ["AFFIX=PAST"]),
]
# Scripts as ranges of code points, tried in order.
KANJI = [(0x4E00, 0x9FFF), (0x3400, 0x4DBF)]
HIRAGANA = [(0x3040, 0x309F)]
KATAKANA = [(0x30A0, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D)]
HANGUL = [(0xAC00, 0xD7A3)]
LATIN = [(0x41, 0x5A), (0x61, 0x7A)]
JAPANESE = [("SCRIPT=KANJI", KANJI), ("SCRIPT=HIRAGANA", HIRAGANA), ("SCRIPT=KATAKANA", KATAKANA)]
KOREAN = [("SCRIPT=HANGUL", HANGUL)]
#: What Python's str.isspace() knows beyond the regular expression's blanks.
BLANK = r"\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Digits beyond decimal ones: superscripts, subscripts and circled digits.
DIGIT = r"\p{Nd}\x{B2}\x{B3}\x{B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247C}\x{2488}-\x{2490}"

_PLUGINS: dict[str, Callable] = {}


def plugin(name: str) -> Callable:
    def add(f: Callable) -> Callable:
        _PLUGINS[name] = f
        return f

    return add


def available() -> list[str]:
    return sorted(_PLUGINS)


def segmented(docs: DataFrame, language: str, **options) -> DataFrame:
    """docs with segments."""
    if language not in _PLUGINS:
        raise KeyError(f"no morphology for {language}; there is {', '.join(available())}")
    return _PLUGINS[language](docs, **options)


def letters(ranges: list[tuple[int, int]]) -> str:
    """The inside of a character class."""
    return "".join(rf"\x{{{lo:X}}}-\x{{{hi:X}}}" for lo, hi in ranges)


def script_segments(text: Column, scripts: list[tuple[str, list[tuple[int, int]]]]) -> Column:
    """Runs of one script as segments; every other character a separator.

    A segment is told by its first code point alone; only those beyond ASCII and all scripts are held against classes of characters."""
    ascii_sign = r"[\x{00}-/:-@\[-`{-\x{7F}]"  # the classes have nothing in common: frequent ones come first
    runs = "|".join([f"[{letters(LATIN)}]+", ascii_sign, *(f"[{letters(r)}]+" for _, r in scripts), f"[{DIGIT}]+"])
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?s)({runs}|.)"), F.lit(1))
    described = lambda s, tag, role: F.struct(s.alias("surface"), F.array(F.lit(tag)).alias("tags"), F.lit(role).alias("role"))

    def describe(s: Column) -> Column:
        point = F.ascii(s)
        inside = lambda lo, hi: (point >= lo) & (point <= hi)
        kinds = [(inside(0x61, 0x7A) | inside(0x41, 0x5A), "SCRIPT=LATIN", "lexeme"), (point == 0x20, "CATEGORY=SPACE", "separator"), (inside(0x30, 0x39), "SCRIPT=NUMERIC", "lexeme"), (inside(0x9, 0xD) | inside(0x1C, 0x1F), "CATEGORY=SPACE", "separator"), (point < 0x80, "CATEGORY=PUNCT", "separator")]
        kinds += [(inside(lo, hi), name, "lexeme") for name, ranges in scripts for lo, hi in ranges]
        kinds += [(s.rlike(f"^[{DIGIT}]"), "SCRIPT=NUMERIC", "lexeme"), (s.rlike(f"^[{BLANK}]"), "CATEGORY=SPACE", "separator")]
        out = F.when(kinds[0][0], described(s, *kinds[0][1:]))
        for condition, *what in kinds[1:]:
            out = out.when(condition, described(s, *what))
        return out.otherwise(described(s, "CATEGORY=PUNCT", "separator"))

    return F.transform(found, describe)


@plugin("ja")
def japanese(docs: DataFrame) -> DataFrame:
    return docs.withColumn("segments", script_segments(F.col("text"), JAPANESE))


@plugin("ko")
def korean(docs: DataFrame) -> DataFrame:
    return docs.withColumn("segments", script_segments(F.col("text"), KOREAN))


def turkish_rules(case_markers: bool, affix_tags: bool) -> list[tuple[str, list[str], str]]:
    listed = [(c, "case") for c in TURKISH_CASES if case_markers] + [(a, "affix") for a in TURKISH_AFFIXES if affix_tags]
    return [(suffix, tags, role) for (suffixes, tags), role in listed for suffix in suffixes]


def by_last_letter(rules: list[tuple[str, list[str], str]]) -> dict[str, list[tuple[int, str]]]:
    out: dict[str, list[tuple[int, str]]] = {}
    for i, (suffix, _, _) in enumerate(rules):
        out.setdefault(suffix[-1], []).append((i, suffix))
    return out


def turkish_word(word: str, rules: dict[str, list[tuple[int, str]]]) -> tuple[list[str], list[int | None]]:
    """The stem and the suffixes after it, and the number of each one's rule; rules, by last letter, are tried in their order, each suffix
    once at most, and something of the word must stay."""
    stem, low, found, after = word, word.lower(), [], -1
    while True:
        for i, suffix in rules.get(low[-1], ()):
            if i > after and low.endswith(suffix) and len(low) > len(suffix):
                break
        else:
            break
        found.append((stem[-len(suffix) :], i))
        stem, low, after = stem[: -len(suffix)], low[: -len(suffix)], i
    return ([stem, *(s for s, _ in reversed(found))], [None, *(i for _, i in reversed(found))]) if found and stem else ([word], [None])


class Turkish:
    """Segments of texts as Arrow columns. Words and what is between them are looked up in the distinct ones of a slice; tags and roles go
    by the number of their rule."""

    def __init__(self, rules: list[tuple[str, list[str], str]]) -> None:
        self.rules, self.last = rules, by_last_letter(rules)
        self.tags = pa.array([*(tags for _, tags, _ in rules), []], pa.list_(pa.string()))
        self.roles = pa.array([*(role for _, _, role in rules), None], pa.string())
        self.kept: dict[str, tuple[list[str], list[int | None]]] = {}

    def part(self, part: str) -> tuple[list[str], list[int | None]]:
        if not TURKISH_WORD.match(part):
            return ([part], [None]) if part else ([], [])
        if part not in self.kept:
            if len(self.kept) >= WORDS_KEPT:
                self.kept.clear()
            self.kept[part] = turkish_word(part, self.last)
        return self.kept[part]

    def __call__(self, texts: pa.Array) -> pa.Array:
        codes: dict[str, int] = defaultdict(lambda: len(codes))
        places: list[int] = []
        ends = [0]
        for text in texts:
            places += [codes[p] for p in TURKISH_PARTS.split(text.as_py() or "")]
            ends.append(len(places))
        found = [self.part(p) for p in codes]
        of_place = pa.array(places, pa.int32())
        surfaces = pa.array([x for x, _ in found], pa.list_(pa.string())).take(of_place)
        rules = pc.fill_null(pa.array([x for _, x in found], pa.list_(pa.int32())).take(of_place).flatten(), len(self.rules))
        bounds = np.concatenate([[0], np.cumsum(np.array(surfaces.value_lengths(), np.int32))])[ends].astype(np.int32)
        parts = pa.StructArray.from_arrays([surfaces.flatten(), self.tags.take(rules), self.roles.take(rules)], names=["surface", "tags", "role"])
        return pa.ListArray.from_arrays(pa.array(bounds), parts)


@plugin("tr")
def turkish(docs: DataFrame, case_markers: bool = True, affix_tags: bool = True) -> DataFrame:
    rules = turkish_rules(case_markers, affix_tags)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, at = Turkish(rules), names.index("text")
        for b in slices(batches, at):
            yield pa.RecordBatch.from_arrays([*b.columns, cut(b.column(at))], names=[*names, "segments"])

    make_importable(docs.sparkSession)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, segments {SEGMENTS}")


def segmented_bytes(payloads: DataFrame, language: str, **options) -> DataFrame:
    """segmented() of (…, payload binary): the segments of what is UTF-8; anything else is one segment without tags, shown as Latin-1."""
    readable = F.is_valid_utf8(F.col("payload").cast("string"))
    docs = payloads.withColumn("text", F.when(readable, F.col("payload").cast("string")))
    whole = F.array(F.struct(F.decode("payload", "ISO-8859-1").alias("surface"), F.array().cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("role")))
    kept = F.when(F.col("text").isNull() & F.col("payload").isNotNull(), whole).otherwise(F.col("segments"))
    return segmented(docs, language, **options).withColumn("segments", kept).drop("text")


def recomposed(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["surface"]), "")


def totals(docs: DataFrame) -> DataFrame:
    """Documents, segments, tagged ones, the average, and their share."""
    n = F.size("segments")
    tagged = F.size(F.filter("segments", lambda s: F.size(s["tags"]) > 0))
    sums = docs.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(n), F.lit(0)).alias("total_segments"), F.coalesce(F.sum(tagged), F.lit(0)).alias("tagged_segments"))
    safe = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return sums.select("*", safe(F.col("total_segments"), F.col("documents")).alias("average_segments"), safe(F.col("tagged_segments"), F.col("total_segments")).alias("purity"))


def roles(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode("segments").alias("s")).where("s.role is not null").groupBy(F.col("s.role").alias("role")).agg(F.count(F.lit(1)).alias("cnt"))
