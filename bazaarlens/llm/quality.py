"""Quality rules as a short-circuit cascade.

A rule looks at features of a whole text and may reject it. What each rule costs and which documents it
rejects is estimated on a sample; the cascade then runs the rule with the most rejections per cost
first, the next by its rejections among what is left, and so on, and stops at the first rejection.
The order decides how much work is done and which rule is named, never which documents are kept.

Features are computed once per document and only when a rule asks for them.

Defined results: a null text counts as empty; a document with fewer than ten words is rejected; repeated rows
get equal results; long texts are judged whole; rules with equal rejections per cost run in the order given; bytes that are not
UTF-8 are no letters; an empty table gives no rows, and the rules then run in the order given.
"""

from __future__ import annotations

import time
import unicodedata
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.tables import raw_texts
from bazaarlens.llm.words import SHINGLE_WORDS, window_hashes, word_hashes, word_spans

#: Documents whose ids have the lowest hashes form the sample that costs and selectivity are estimated on.
SAMPLE_ROWS = 1000

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_BLANK = b" \t\n\x0b\x0c\r"

#: Letters by how they are judged: scripts without capitals have UNCASED ones, those without spaces between words UNSPACED ones.
OTHER, LOWER, UPPER, UNCASED, UNSPACED = range(5)
#: Thai to Burmese, Khmer, Tai, Balinese, kana and Han, Yi, Javanese and further Burmese, compatibility and rare Han.
UNSPACED_SCRIPTS = (
    (0x0E00, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x3005, 0x3007),
    (0x3031, 0x312F), (0x31A0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0xA4CF), (0xA980, 0xA9FF), (0xAA60, 0xAA7F),
    (0xF900, 0xFAFF), (0xFF66, 0xFF9D), (0x1B000, 0x1B16F), (0x20000, 0x323AF),
)


@cache
def _letter_kinds() -> np.ndarray:
    """The kind of every code point up to the last letter; the last entry stands for all above."""
    kinds = np.zeros(0x32400, np.uint8)
    for code in range(len(kinds)):
        category = unicodedata.category(chr(code))
        if category[0] == "L":
            kinds[code] = {"Ll": LOWER, "Lu": UPPER}.get(category, UNCASED)
    for first, last in UNSPACED_SCRIPTS:
        part = kinds[first:last + 1]
        part[part == UNCASED] = UNSPACED
    return kinds


class TextFeatures:
    """Counts over one text, each computed when first asked for."""

    def __init__(self, raw: bytes):
        self.raw = raw

    @cached_property
    def data(self) -> np.ndarray:
        return np.frombuffer(self.raw, np.uint8)

    @cached_property
    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        return word_spans(self.data)

    @cached_property
    def n_words(self) -> int:
        return len(self.spans[0])

    @cached_property
    def word_chars(self) -> int:
        """Code points inside words: all bytes of words but the continuation bytes of UTF-8."""
        starts, ends = self.spans
        return int((ends - starts).sum()) - int(np.count_nonzero((self.data & 0xC0) == 0x80))

    @cached_property
    def n_symbols(self) -> int:
        return int(np.count_nonzero(_SYMBOLS[self.data]))

    @cached_property
    def lines(self) -> list[bytes]:
        return [line for line in self.raw.split(b"\n") if line.strip(_BLANK)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside a five-word window that occurs at least twice in the text."""
        windows = window_hashes(word_hashes(self.raw))
        if len(windows) < 2:
            return 0
        order = np.argsort(windows, kind="stable")
        ranked = windows[order]
        same = ranked[1:] == ranked[:-1]
        if not same.any():
            return 0
        repeated = np.zeros(len(windows), bool)
        repeated[order[1:][same]] = True
        repeated[order[:-1][same]] = True
        edges = np.zeros(len(windows) + SHINGLE_WORDS, np.int64)
        at = np.flatnonzero(repeated)
        np.add.at(edges, at, 1)
        np.add.at(edges, at + SHINGLE_WORDS, -1)
        return int(np.count_nonzero(np.cumsum(edges) > 0))

    @cached_property
    def n_exclamations(self) -> int:
        return self.raw.count(b"!")

    @cached_property
    def letters(self) -> np.ndarray:
        """The number of letters of each kind."""
        if self.raw.isascii():
            upper = int(np.count_nonzero((self.data >= 65) & (self.data <= 90)))
            lower = int(np.count_nonzero((self.data >= 97) & (self.data <= 122)))
            return np.array([0, lower, upper, 0, 0])
        kinds = _letter_kinds()
        codes = np.frombuffer(self.raw.decode(errors="replace").encode("utf-32-le"), np.uint32)
        counts = np.bincount(kinds[np.minimum(codes, len(kinds) - 1)], minlength=5)
        counts[OTHER] = 0
        return counts

    @cached_property
    def upper_share(self) -> float:
        """Share of capitals among the letters of scripts that have them; 0 if these are not half of the letters."""
        cased = int(self.letters[LOWER] + self.letters[UPPER])
        return int(self.letters[UPPER]) / cased if cased and 2 * cased >= int(self.letters.sum()) else 0.0

    @cached_property
    def spaced(self) -> bool:
        """Whether at least half of the letters are of scripts that separate words by spaces."""
        return 2 * int(self.letters[UNSPACED]) <= int(self.letters.sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[TextFeatures], bool]


BASE_RULES = (
    Rule("too_few_words", lambda f: f.n_words < 10),
    Rule("repeated_passages", lambda f: 100 * f.n_repeat_words > 20 * f.n_words),
)
RULES = (
    *BASE_RULES,
    Rule("repeated_lines", lambda f: 2 * f.n_dup_lines > len(f.lines)),
    Rule("symbols", lambda f: 10 * f.n_symbols > 3 * f.n_words),
    Rule("shouting", lambda f: f.upper_share > 0.7),
    Rule("exclamations", lambda f: 10 * f.n_exclamations > 3 * f.n_words),
    Rule("word_length", lambda f: f.word_chars < 2 * f.n_words or f.word_chars > 30 * f.n_words and f.spaced),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def first_rejection(features: TextFeatures, rules: Iterable[Rule]) -> str | None:
    return next((rule.name for rule in rules if rule.rejects(features)), None)


def estimate(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS):
    """Seconds per document of each rule, and how many sampled documents each set of rules rejects.

    The result is bounded by the number of rules and of their combinations on ``sample_rows`` documents.
    """
    # Hashes of ids are sorted, not texts: each task sends as many numbers as the sample has rows at most.
    draw = F.xxhash64("doc_id")
    last = docs.select(draw.alias("draw")).orderBy("draw").limit(sample_rows).agg(F.max("draw").alias("draw")).first()
    text = F.coalesce(F.col("text"), F.lit(""))
    sample = docs.where(draw <= F.lit(last.draw)).select(text.alias("text")).limit(sample_rows)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rejected, seconds = [], []
            for raw in raw_texts(batch.column(0)):
                bits, spent = 0, []
                for i, rule in enumerate(rules):
                    began = time.perf_counter()
                    bits |= int(rule.rejects(TextFeatures(raw))) << i
                    spent.append(time.perf_counter() - began)
                rejected.append(bits)
                seconds.append(spent)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rejected, pa.int64()), pa.array(seconds, pa.list_(pa.float64()))], ["rejected", "seconds"],
            )

    measured = sample.mapInArrow(measure, "rejected bigint, seconds array<double>")
    found = measured.groupBy("rejected").agg(
        F.count(F.lit(1)).alias("documents"),
        *[F.sum(F.col("seconds")[i]).alias(f"seconds_{i}") for i in range(len(rules))],
    ).collect()
    documents = sum(r.documents for r in found) or 1
    costs = [sum(r[f"seconds_{i}"] for r in found) / documents for i in range(len(rules))]
    return costs, {r.rejected: r.documents for r in found}


def plan(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules in the order of most rejections per cost among what the rules before them leave."""
    costs, patterns = estimate(docs, rules, sample_rows)
    left, ordered = list(range(len(rules))), []
    while left:
        def gain(i: int) -> float:
            return sum(n for bits, n in patterns.items() if bits >> i & 1) / max(costs[i], 1e-9)

        best = max(left, key=lambda i: (gain(i), -costs[i], -i))
        left.remove(best)
        ordered.append(rules[best])
        patterns = {bits: n for bits, n in patterns.items() if not bits >> best & 1}
    return ordered


def keep(docs: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """The documents that no rule rejects, with all their columns."""
    ordered = plan(docs) if rules is None else list(rules)
    at = docs.columns.index("text")

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(
                [first_rejection(TextFeatures(raw), ordered) is None for raw in raw_texts(batch.column(at))],
                pa.bool_(),
            ))

    return docs.mapInArrow(passing, docs.schema)


def judge(docs: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and the rule that rejected the document, if any."""
    ordered = plan(docs) if rules is None else list(rules)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in raw_texts(batch.column(1)):
                features = TextFeatures(raw)
                rejected_by = first_rejection(features, ordered)
                base_failed = first_rejection(features, BASE_RULES) is not None
                rows.append((
                    *(getattr(features, name) for name in MEASURES), base_failed,
                    not base_failed and rejected_by is None, rejected_by,
                ))
            columns = list(zip(*rows, strict=True)) or [()] * (len(MEASURES) + 3)
            kinds = [pa.int64()] * len(MEASURES) + [pa.bool_(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                ["doc_id", *MEASURES, "base_failed", "kept", "rejected_by"],
            )

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + "".join(f"{m} bigint, " for m in MEASURES)
    return docs.select("doc_id", "text").mapInArrow(judged, schema + "base_failed boolean, kept boolean, rejected_by string")
