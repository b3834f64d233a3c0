"""Personal data in texts: regular expressions propose spans, checksums confirm them, context words adjust the score.

Base kinds (email, ip, card, phone) are fixed rules: every proposal that passes its check counts, with no retry inside a failed one. The
method adds kinds that a pattern alone can't decide: iban (mod-97; words or numbers in capitals after it aren't part of it), national (a phone number without a country code), ssn (a
nine-digit number in groups) and birth (a date). Each proposal starts with the score of its pattern; a passed checksum raises it, a failed one ends
it; a context word within CONTEXT characters before it raises it, and those at THRESHOLD or more are spans. Added spans never
replace base spans; where one overlaps a base span it is left out, as the base kind has said what it is.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "national", "ssn", "birth")
CONTEXT = 40
THRESHOLD = 0.5

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit run is tried from its start only: any later start in it fails where the start failed.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9+.-])\(?0?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_BIRTH = re.compile(r"(?<![0-9.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})(?![0-9])")
_WORDS = {
    "iban": re.compile(r"\b(?:iban|account|bank|konto|compte|cuenta)\b", re.I),
    "national": re.compile(r"\b(?:phone|tel|telephone|telefon|téléphone|teléfono|call|mobile|fax)\b", re.I),
    "ssn": re.compile(r"\b(?:ssn|social security)\b", re.I),
    "birth": re.compile(r"\b(?:born|birth|dob|geboren|né|née|nacido|nacida)\b", re.I),
}
#: Score of a pattern alone, with a context word added, and with a checksum added.
_SCORES = {"iban": (0.3, 0.1, 0.5), "national": (0.2, 0.4, 0.0), "ssn": (0.3, 0.4, 0.0), "birth": (0.1, 0.5, 0.0)}


def luhn(digits: str) -> bool:
    """Whether the digits, from the right every second doubled, sum to a multiple of ten."""
    values = [int(c) for c in reversed(digits)]
    return (sum(values[0::2]) + sum(v // 5 + 2 * v % 10 for v in values[1::2])) % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 13616: the first four characters moved to the end, letters as 10 to 35, the remainder by 97 is 1."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at)):
            yield begin, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds, by kind, then start; code points, end exclusive."""
    found = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(own := p.lstrip("0")) <= 3 and int(own or "0") <= 255 for p in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                found.append(("phone", *m.span()))
    return found


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Spans that pass mod-97: of a proposal's ends at group borders the last that does; after a proposal without any, the scan goes on behind its first group."""
    at = 0
    while m := _IBAN.search(text, at):
        begin, end = m.span()
        while end > begin and not (15 <= len(iban := text[begin:end].replace(" ", "")) <= 34 and mod97(iban)):
            end = text.rfind(" ", begin, end)
        if end > begin:
            yield begin, end
            at = end
        else:
            space = text.find(" ", begin, m.end())
            at = space if space > 0 else m.end()


def added_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of the added kinds that reach THRESHOLD and overlap no base span, by kind, then start."""
    found = []
    # base spans merged to disjoint ones, so that a look at two neighbours tells whether a span meets any
    begins, ends = [], []
    for a, b in sorted((a, b) for _, a, b in base):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            begins.append(a)
            ends.append(b)
    for kind, pattern in (("iban", _IBAN), ("national", _NATIONAL), ("ssn", _SSN), ("birth", _BIRTH)):
        alone, near, checked = _SCORES[kind]
        for begin, end in _ibans(text) if kind == "iban" else (m.span() for m in pattern.finditer(text)):
            score = alone
            if kind == "iban":
                score += checked
            part = text[begin:end]
            if kind == "ssn" and (part[:3] in ("000", "666") or part[0] == "9" or "-00-" in part or part.endswith("0000")):
                continue
            if _WORDS[kind].search(text, max(0, begin - CONTEXT), begin):
                score += near
            meets = bisect_left(begins, end)
            if score >= THRESHOLD and not (meets and ends[meets - 1] > begin):
                found.append((kind, begin, end))
    return found


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, base_spans, spans, n_email, n_ip, n_card, n_phone) for each row of docs(doc_id, text).

    Spans are `kind:start:end` in code points of the whole text, end exclusive, joined by commas, by kind (email, ip, card, phone,
    iban, national, ssn, birth) and start. A null text is empty and has none; repeated rows, null doc_ids and more columns change nothing; an empty
    table gives an empty result. Every pattern takes time linear in the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base = [base_spans(t) for t in batch.column("text").to_pylist()]
            every = [b + added_spans(t, b) for t, b in zip(batch.column("text").to_pylist(), base)]
            counts = [pa.array([sum(k == kind for k, _, _ in b) for b in base], pa.int64()) for kind in BASE_KINDS]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(map(_joined, base)), pa.array(map(_joined, every)), *counts],
                ["doc_id", "base_spans", "spans", *(f"n_{k}" for k in BASE_KINDS)],
            )

    schema = "doc_id long, base_spans string, spans string, n_email long, n_ip long, n_card long, n_phone long"
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)
