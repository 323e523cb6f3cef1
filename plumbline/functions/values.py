"""Value mentions of texts (numbers, money, dates, durations and more, with spans), as pure functions and one Arrow-batched operator."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

# Number words and units.
ONES = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
TENS = {w: 10 * (i + 2) for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split())}
MONTHS = "january february march april may june july august september october november december".split()
UNITS = "second seconds minute minutes hour hours day days week weeks month months year years"
CURRENCY = {"$": "USD", "€": "EUR", "£": "GBP", "₹": "INR"}
NUMBER = r"\d[\d,]*(?:\.\d+)?"
WORD = "|".join([*ONES, *TENS, "hundred", "thousand"])
WORDS = rf"\b(?:{WORD})(?:[ -](?:and )?(?:{WORD}))*\b"


@dataclass(frozen=True)
class Mention:
    raw: str
    value: str
    kind: str
    unit: str | None
    start: int
    end: int
    context: str = ""


#: Characters on either side of a mention that tell what it is about.
AROUND = 25


def number_of_words(text: str) -> int | None:
    """"two hundred and five" is 205: hundreds and thousands accumulate, "and" says nothing."""
    total = part = 0
    seen = False
    for w in re.split(r"[ -]+", text.lower()):
        if w == "and":
            continue
        if w in ONES or w in TENS:
            part += ONES.get(w, TENS.get(w, 0))
        elif w == "hundred":
            part = max(part, 1) * 100
        elif w == "thousand":
            total, part = total + max(part, 1) * 1000, 0
        else:
            return None
        seen = True
    return total + part if seen else None


def plain(text: str) -> str:
    """A number without commas, times its k, m or b."""
    m = re.match(rf"({NUMBER})\s*(k|m|b|thousand|million|billion)?$", text.strip(), re.I)
    if not m:
        return text
    times = {"k": 1e3, "thousand": 1e3, "m": 1e6, "million": 1e6, "b": 1e9, "billion": 1e9}.get((m[2] or "").lower(), 1)
    return f"{float(m[1].replace(',', '')) * times:g}" if times != 1 or "." in m[1] else m[1].replace(",", "")


#: (kind, pattern, whether it is of number words alone), met in order: an earlier kind's span is not read again.
PASSES = tuple(
    (kind, re.compile(p, re.I), p.startswith(WORDS))
    for kind, p in (
        ("version", r"\bv(?:ersion)?\s?\d+(?:\.\d+)+\b"),
        ("percentage", rf"{NUMBER}\s?(?:%|percent\b)"),
        ("percentage", rf"{WORDS}\s+percent\b"),
        ("money", rf"[$€£₹]\s?{NUMBER}(?:\s?(?:k|m|b|thousand|million|billion)\b)?"),
        ("money", rf"\b(?:USD|EUR|GBP|INR|Rs\.?)\s?{NUMBER}"),
        ("money", rf"{NUMBER}\s?(?:dollars|euros|pounds|rupees)\b"),
        ("duration", rf"{NUMBER}[ -](?:{UNITS.replace(' ', '|')})\b"),
        ("duration", rf"{WORDS}[ -](?:{UNITS.replace(' ', '|')})\b"),
        ("date", r"\b\d{4}-\d{2}-\d{2}\b"),
        ("date", rf"\b(?:{'|'.join(MONTHS)})\s+\d{{1,2}}(?:,\s*\d{{4}})?\b|\b\d{{1,2}}\s+(?:{'|'.join(MONTHS)})(?:\s+\d{{4}})?\b"),
        ("year", r"\b[12]\d{3}\b"),
        ("quantity", rf"{NUMBER}\s+[a-z]{{3,}}s\b"),
        ("number", rf"\b{NUMBER}(?:[kmb]\b)?"),
        ("number", WORDS),
    )
)
FIRST = re.compile(rf"{NUMBER}\s?(?:k|m|b|thousand|million|billion)?(?![a-z])", re.I)
SPELT_RUN = re.compile(WORDS, re.I)
DIGIT = re.compile(r"\d")
SPELT = re.compile(rf"\b(?:{WORD})\b", re.I)


def mentions(text: str | None) -> list[Mention]:
    """The text's values in order of place. An earlier kind's characters are not read again; a map of taken characters keeps that linear in the text."""
    text = text or ""
    digits, spelt = DIGIT.search(text) is not None, SPELT.search(text) is not None
    if not digits and not spelt:
        return []
    out: list[Mention] = []
    taken = bytearray(len(text))
    for kind, pattern, words in PASSES:
        if not (spelt if words else digits):
            continue
        for m in pattern.finditer(text):
            if taken.find(1, m.start(), m.end()) >= 0:
                continue
            taken[m.start() : m.end()] = b"\1" * (m.end() - m.start())
            raw, unit = m.group(), None
            value = raw.lower()
            if kind in ("percentage", "money", "duration", "quantity", "number"):
                if found := FIRST.search(raw):
                    value = plain(found.group())
                elif found := SPELT_RUN.search(raw):
                    value = str(number_of_words(found.group()))
            if kind == "percentage":
                unit = "%"
            elif kind == "money":
                unit = next((c for s, c in CURRENCY.items() if s in raw), re.sub(r"[\d\s,.]", "", raw).upper())
            elif kind in ("duration", "quantity"):
                unit = raw.split()[-1].lower().rstrip("s") if " " in raw else raw.split("-")[-1].lower().rstrip("s")
            out.append(Mention(raw, value, kind, unit, m.start(), m.end(), text[max(0, m.start() - AROUND) : m.end() + AROUND].lower()))
    return sorted(out, key=lambda x: (x.start, x.end))


def compatible(a: Mention, b: Mention) -> bool:
    """Kinds that can be compared: equal ones (durations and quantities of one unit), a bare number with any figure, a date with a year."""
    if a.kind == b.kind:
        return a.kind not in ("duration", "quantity") or a.unit == b.unit
    return ("number" in (a.kind, b.kind) and {a.kind, b.kind} <= {"number", "money", "duration", "quantity", "percentage"}) or {a.kind, b.kind} == {"date", "year"}


def about(m: Mention) -> set[str]:
    """The longer words around a mention that are no numbers."""
    return {w for w in re.findall(r"[a-z]+", m.context) if len(w) > 3 and w not in ONES and w not in TENS and w not in ("hundred", "thousand")}


def same_context(a: Mention, b: Mention) -> bool:
    """Two mentions share a word around them, or one has none."""
    x, y = about(a), about(b)
    return not x or not y or bool(x & y)


def equal(a: Mention, b: Mention) -> bool:
    return a.value == b.value and (a.unit == b.unit or "number" in (a.kind, b.kind) or {a.kind, b.kind} == {"date", "year"})


CRITICAL = {"money", "duration", "percentage", "date", "version"}


def align(claim: list[Mention], evidence: list[Mention]) -> dict[str, int]:
    """Matches, conflicts (with the first comparable mention in a like context) and critical values without any counterpart."""
    out = {"matches": 0, "conflicts": 0, "missing": 0}
    for c in claim:
        near = [e for e in evidence if compatible(c, e) and same_context(c, e)]
        if any(equal(c, e) for e in near):
            out["matches"] += 1
        elif near:
            out["conflicts"] += 1
        elif c.kind in CRITICAL:
            out["missing"] += 1
    return out


def value_mentions(rows: DataFrame, *, key: str, text: str = "text") -> DataFrame:
    """One row a mention: key, raw, value, kind, unit, start, end."""

    names = [key, "raw", "value", "kind", "unit", "start", "end"]

    def run(batches):
        for b in batches:
            got = [mentions(t) for t in b.column(1).to_pylist()]
            own = b.column(0).take(pa.array([i for i, ms in enumerate(got) for _ in ms], pa.int64()))
            flat = [m for ms in got for m in ms]
            text = lambda f: pa.array([getattr(m, f) for m in flat], pa.string())  # noqa: E731, B023
            place = lambda f: pa.array([getattr(m, f) for m in flat], pa.int32())  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([own, *map(text, names[1:5]), *map(place, names[5:])], names)

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, raw string, value string, kind string, unit string, start int, end int")
