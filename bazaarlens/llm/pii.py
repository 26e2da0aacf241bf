"""Personal data by weak supervision: labelers vote on spans, EM weighs them, a classifier decides.

Base patterns find e-mail addresses, IP addresses, card and phone numbers; what they find always counts. Wider
patterns propose further spans and leave the decision to what follows: addresses whose @ and dots are written out, in brackets
or as words, in any case and length; runs of hexadecimal groups, compressed ones too; card numbers and national phone numbers
in many groupings, which dates, times, amounts and order numbers look like as well. On each span labelers of three sorts vote yes, no or nothing: patterns, gazetteers
(top-level domains, issuer prefixes, calling codes) and context words before the span. Expectation-maximisation
over the counts of vote combinations estimates how reliable each labeler is, without labelled data; its
posteriors train a logistic span classifier, which decides on the proposed spans.

A span's votes and shape are one small number, so the corpus is reduced to the counts of these numbers (at most
MOST_CODES rows) before anything reaches the driver. Texts are scanned once.

Defined results: a null or empty text has no spans; offsets are code points, the end is exclusive, and bytes that are not
UTF-8 count as one each or as few as Python's decoder makes of them; long texts are scanned whole; spans that start together come in the
order of the kinds; of equal rows each gets the same spans; an empty table gives no rows.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.tables import raw_texts, stored

KINDS = ("email", "ip", "card", "phone")
#: Probability from which a proposed span counts.
ACCEPT = 0.5
CONTEXT_CHARS = 32

# --- fixed values: gazetteers ---
TOP_LEVEL_DOMAINS = frozenset(
    "com org net edu gov mil int info biz io co me eu de fr es it uk us nl be ch at pl ru cn jp kr in br mx ca au "
    "se no fi dk pt gr cz ie nz za ar cl tr il ua ro hu".split()
)
ISSUER_PREFIXES = ("4", "51", "52", "53", "54", "55", "2221", "2720", "34", "37", "36", "38", "6011", "65", "35", "62")
CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 94 98".split())
CONTEXT = {
    "email": ("mail", "contact", "correo", "courriel", "write to", "reach"),
    "ip": ("ip", "host", "server", "address", "serveur", "dirección", "adresse"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "anruf", "teléfono", "appel"),
}
COUNTER_CONTEXT = ("order", "version", "invoice", "isbn", "token", "build", "id:", "no.", "number of")

# --- patterns ---

_EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_HEAD = re.compile(r"[A-Za-z0-9._%+-]*")
# A match that begins inside a run of digits would begin at its start as well, so the start is enough.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# An @ written out: in brackets, or as a word if a dot follows that is written out too.
_DOT = r"(?:[ \t]?[(\[{<][ \t]?dot[ \t]?[)\]}>][ \t]?|[ \t]dot[ \t]|\.)"
_AT = re.compile(
    r"[ \t]?[(\[{<][ \t]?at[ \t]?[)\]}>][ \t]?|[ \t]at[ \t](?=[a-z0-9-]+(?:[ \t]?[(\[{<][ \t]?dot\b|[ \t]dot[ \t]))", re.IGNORECASE,
)
_WRITTEN_TAIL = re.compile(rf"[a-z0-9-]+(?:{_DOT}[a-z0-9-]+)+", re.IGNORECASE)
_WRITTEN_HEAD = re.compile(r"[\w.+-]*")
_WIDE = {
    "ip": re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])"),
    "card": re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[ ./-]?[0-9]{4}){3}(?![0-9A-Za-z])"),
    "phone": re.compile(
        r"(?<![0-9A-Za-z+.,:/-])(?:00[0-9]{1,3}[ .-]?)?\(?[0-9]{2,5}\)?(?:[ ./-][0-9]{2,8}){1,5}(?![0-9A-Za-z:]|[.,/-][0-9])"
    ),
}

# --- fixed values: how national phone numbers are grouped, and what other numbers look like ---
NATIONAL_PHONES = re.compile(
    r"\(?[2-9][0-9]{2}\)?[ .-][2-9][0-9]{2}[ .-][0-9]{4}"  # North America
    r"|0[1-9](?:[ .-][0-9]{2}){4}"  # France
    r"|\(?0[0-9]{2,4}\)?[ -][0-9]{3,4}[ -][0-9]{3,4}|0[0-9]{4}[ -][0-9]{6}"  # United Kingdom
    r"|\(?0[0-9]{2,5}\)?[ /-][0-9]{5,8}"  # Germany
    r"|[6-9][0-9]{2}(?:[ .-][0-9]{3}){2}|[6-9][0-9]{2}(?:[ .-][0-9]{2}){3}"  # Spain
    r"|00[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-][0-9]{2,8}){1,4}"  # with the international prefix
)
OTHER_NUMBERS = re.compile(
    r"[0-9]{4}[-/.][0-9]{2}[-/.][0-9]{2}(?:[ -][0-9]{2,8})?|[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{2,4}(?:[ -][0-9]{2,4})*"  # dates
    r"|[1-9][0-9]{0,2}(?:[ .]000)+|[1-9][0-9](?:[ .][0-9]{3})+|[0-9]{2,}[.][0-9]{2,}"  # amounts
    r"|(?:[0-9]{4}[ -]){3,4}[0-9]{1,4}"  # cards
)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses, found from each @ outwards so that long words without one cost nothing."""
    done = 0
    at = text.find("@")
    while at >= 0:
        tail = _EMAIL_TAIL.match(text, at)
        if tail:
            head = _EMAIL_HEAD.match(text[done:at][::-1]).end() if at - done < 256 else _head(text, done, at)
            if head:
                done = tail.end()
                yield at - head, done
        at = text.find("@", max(at + 1, done))


def _head(text: str, done: int, at: int, pattern: re.Pattern = _EMAIL_HEAD) -> int:
    """Characters before an @ that may belong to an address, taken in steps that double."""
    step = 256
    while True:
        start = max(done, at - step)
        head = pattern.match(text[start:at][::-1]).end()
        if head < at - start or start == done:
            return head
        step *= 2


def written_emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses with the @ written out, found from each mark outwards, whatever their length."""
    done = 0
    mark = _AT.search(text)
    while mark:
        tail = _WRITTEN_TAIL.match(text, mark.end())
        after = max(mark.start() + 1, mark.end() - 1)
        if tail:
            head = _head(text, done, mark.start(), _WRITTEN_HEAD)
            start = mark.start() - head
            start += len(text[start:mark.start()]) - len(text[start:mark.start()].lstrip(".+-_"))
            if start < mark.start():
                after = done = tail.end()
                yield start, done
        mark = _AT.search(text, after)


def base_spans(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns' matches that pass their checks."""
    for start, end in emails(text):
        yield 0, start, end
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
            yield 1, m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
            yield 2, m.start(), m.end()
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            yield 3, m.start(), m.end()


def proposed_spans(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """Matches of the wider patterns that overlap no base span of any kind."""
    taken = sorted((start, end) for _, start, end in base)
    starts = [start for start, _ in taken]
    reach = np.maximum.accumulate([end for _, end in taken]).tolist() if taken else []
    for kind, name in enumerate(KINDS):
        spans = written_emails(text) if name == "email" else (m.span() for m in _WIDE[name].finditer(text))
        for start, end in spans:
            before = int(np.searchsorted(starts, end)) - 1  # spans that start before the match ends
            if before < 0 or reach[before] <= start:
                yield kind, start, end


# --- labelers ---

YES, NO, NOTHING = 1, 0, 2
LABELERS = ("base_pattern", "checked_format", "gazetteer", "context", "counter_context", "usual_shape")
#: A code is a kind, whether the base pattern found it, and a vote of three values per labeler.
MOST_CODES = len(KINDS) * 2 * 3 ** len(LABELERS)


def _is_address(span: str) -> bool:
    if ":" not in span:
        return all(len(p) <= 3 for p in span.split("."))
    try:
        return ipaddress.IPv6Address(span) is not None
    except ValueError:
        return False


def _format_vote(name: str, span: str) -> int:
    digits = _digits(span)
    if name == "card":
        return YES if luhn(digits) else NO
    if name == "ip":
        return YES if _is_address(span) else NO
    if name == "phone":
        return YES if 9 <= len(digits) <= 15 else NO
    return NOTHING


def _gazetteer_vote(name: str, span: str) -> int:
    digits = _digits(span)
    if name == "email":
        last = re.split(r"[^A-Za-z0-9-]+", span)[-1].lower()
        return YES if last in TOP_LEVEL_DOMAINS else NO
    if name == "card":
        return YES if digits.startswith(ISSUER_PREFIXES) else NO
    if name == "phone" and span[:1] == "+":
        return YES if any(digits[:n] in CALLING_CODES for n in (1, 2)) else NO
    if name == "phone":
        return NO if OTHER_NUMBERS.fullmatch(span) else YES if NATIONAL_PHONES.fullmatch(span) else NO
    if name == "ip":
        if ":" in span:  # addresses that are handed out begin with these digits
            return YES if span.lower().startswith(("2", "fc", "fd", "fe80")) else NO
        return NO if digits.startswith("0") or span.startswith(("127.", "255.")) else NOTHING
    return NOTHING


def _shape_vote(name: str, span: str) -> int:
    marks = {c for c in span if not c.isalnum()}
    if name == "email":
        return YES if len(span) <= 64 and ".." not in span else NO
    if name == "card":
        return YES if len(marks) <= 1 and len(_digits(span)) in (15, 16) else NO
    if name == "phone":
        return NO if span.count(".") >= 2 and " " in span else YES if len(marks) >= 2 or span.startswith(("0", "(")) else NOTHING
    if name == "ip" and ":" in span:
        return YES if span.count(":") >= 2 and any(c in "abcdefABCDEF" for c in span) else NO
    return NOTHING


def votes(name: str, text: str, start: int, end: int, is_base: bool) -> tuple[int, ...]:
    span, before = text[start:end], text[max(0, start - CONTEXT_CHARS):start].lower()
    return (
        YES if is_base else NOTHING,
        _format_vote(name, span),
        _gazetteer_vote(name, span),
        YES if any(word in before for word in CONTEXT[name]) else NOTHING,
        NO if any(word in before for word in COUNTER_CONTEXT) else NOTHING,
        _shape_vote(name, span),
    )


def encoded(kind: int, is_base: bool, cast: tuple[int, ...]) -> int:
    code = kind * 2 + is_base
    for vote in cast:
        code = code * 3 + vote
    return code


def decoded(code: int) -> tuple[int, bool, tuple[int, ...]]:
    cast = []
    for _ in LABELERS:
        code, vote = divmod(code, 3)
        cast.append(vote)
    return code // 2, bool(code % 2), tuple(reversed(cast))


def candidates(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, code) of base and proposed spans, by start and then kind."""
    base = list(base_spans(text))
    found = [
        (start, kind, end, encoded(kind, is_base, votes(KINDS[kind], text, start, end, is_base)))
        for is_base, spans in ((True, base), (False, proposed_spans(text, base)))
        for kind, start, end in spans
    ]
    return sorted(found)


# --- label model and classifier ---

def reliabilities(cast: np.ndarray, counts: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Posterior probability of each vote combination, by expectation-maximisation over labelers.

    Given the truth, labelers vote independently. Each has its own chances to vote yes, no or nothing on
    true and on false spans, smoothed by one vote each. The start is the share of yes among the votes cast.
    """
    yes, no = (cast == YES).sum(axis=1), (cast == NO).sum(axis=1)
    truth = (yes + 0.5) / (yes + no + 1)
    for _ in range(rounds):
        prior = (truth @ counts + 1) / (counts.sum() + 2)
        odds = np.full(len(cast), np.log(prior) - np.log1p(-prior))
        for labeler in range(cast.shape[1]):
            chance = np.array([
                [counts[cast[:, labeler] == v] @ belief[cast[:, labeler] == v] + 1 for v in (NO, YES, NOTHING)]
                for belief in (1 - truth, truth)
            ])
            chance /= chance.sum(axis=1, keepdims=True)
            odds += np.log(chance[1] / chance[0])[cast[:, labeler]]
        truth = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return truth


def span_features(cast: np.ndarray) -> np.ndarray:
    """Yes and no votes of the labelers that do not know whether the base pattern matched."""
    rest = cast[:, 1:]
    return np.column_stack([np.ones(len(cast)), rest == YES, rest == NO]).astype(float)


def trained(features: np.ndarray, truth: np.ndarray, counts: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression on soft labels, by Newton's method."""
    weights = np.zeros(features.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(features @ weights, -30, 30)))
        gradient = features.T @ (counts * (truth - p)) - ridge * weights
        curvature = (features * (counts * p * (1 - p))[:, None]).T @ features + ridge * np.eye(len(weights))
        weights += np.linalg.solve(curvature, gradient)
    return weights


def accepted_codes(counts: dict[int, int]) -> set[int]:
    """The codes whose spans count: all of the base patterns, and those that the classifier accepts."""
    accepted = set()
    for kind in range(len(KINDS)):
        codes = sorted(code for code in counts if decoded(code)[0] == kind)
        if not codes:
            continue
        cast = np.array([decoded(code)[2] for code in codes])
        number = np.array([counts[code] for code in codes], float)
        features = span_features(cast)
        weights = trained(features, reliabilities(cast, number), number)
        chance = 1 / (1 + np.exp(-np.clip(features @ weights, -30, 30)))
        accepted |= {code for code, p in zip(codes, chance, strict=True) if decoded(code)[1] or p >= ACCEPT}
    return accepted


# --- operator ---

def scanned(docs: DataFrame) -> DataFrame:
    """doc_id and the candidate spans of each text with their codes."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32()), ("code", pa.int32())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                [dict(zip(("start", "kind", "stop", "code"), c, strict=True)) for c in candidates(raw.decode(errors="replace"))]
                for raw in raw_texts(batch.column(1))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(
        scan, f"doc_id {kind}, spans array<struct<start int, kind int, stop int, code int>>",
    )


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans: arrays of (start, kind, stop, code), by start and kind.

    ``base`` has what the base patterns found, ``spans`` that and the accepted proposals.
    """
    every = stored(scanned(docs), "spans")
    rows = every.select(F.explode("spans.code").alias("code")).groupBy("code").count().collect()
    accepted = sorted(accepted_codes({r["code"]: r["count"] for r in rows}))
    ours = F.array(*map(F.lit, accepted)) if accepted else F.array().cast("array<int>")
    return every.select(
        "doc_id",
        F.filter("spans", lambda s: is_base_code(s["code"])).alias("base"),
        F.filter("spans", lambda s: F.array_contains(ours, s["code"])).alias("spans"),
    )


def is_base_code(code):
    return F.floor(code / F.lit(3 ** len(LABELERS))) % 2 == 1


def listed(spans):
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"),
    )), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256 and spans."""
    found = find(docs)

    def number(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        "doc_id", *[number(kind).alias(f"n_{name}") for kind, name in enumerate(KINDS)],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )
