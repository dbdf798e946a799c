"""Personal data in texts: patterns propose spans, validators confirm them, context words adjust the score.

Base kinds, leftmost and non-overlapping within a kind: email; ip, parts at most 255; card, 12 to 19 digits
that pass Luhn; phone, 9 to 15 digits. A match that fails is dropped and not tried anew. They are kept at
any score. The method adds iban, confirmed by mod-97, and ssn, whose score passes THRESHOLD only with a
context word near it.

A span's score is its kind's prior, plus what context words within WINDOW characters add. Positions are
code points, ends exclusive.

Plan: one pass, no shuffle; a Python worker holds a slice of an Arrow batch at a time. Every pattern is
matched in time linear in the text: from its fixed character ('@', '.', '+') or first digit outwards.

Cases: null and empty texts have no spans; ties in start are in the order of KINDS; repeated rows give
repeated results; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.common import batches, only, read

#: Kinds in the order in which ties stand.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT = {
    "email": ("mail", "contact"),
    "ip": ("ip", "address", "server", "host"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank"),
    "ssn": ("ssn", "social security"),
}
BOOST, WINDOW, THRESHOLD = 0.3, 40, 0.5

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTS = re.compile(r"\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"\b(?=([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b))")
SSN = re.compile(r"\b(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}\b", re.ASCII)
NOT_DIGIT = re.compile(r"[^0-9]")


def back(text: str, at: int, low: int, allowed: frozenset) -> int:
    while at > low and text[at - 1] in allowed:
        at -= 1
    return at


def emails(text: str) -> Iterator[tuple[int, int]]:
    """A local part is the whole run before '@': from any later start it would end at the same '@'."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = back(text, at, end, LOCAL)
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def ips(text: str) -> Iterator[tuple[int, int]]:
    end, m = 0, DOTS.search(text)
    while m:
        start = back(text, m.start(), end, DIGITS)
        if start < m.start():
            end = m.end()
            if all(int(shorten(p)) <= 255 for p in text[start:end].split(".")):
                yield start, end
            m = DOTS.search(text, end)
        else:
            m = DOTS.search(text, m.start() + 1)


def shorten(digits: str) -> str:
    """The number without leading zeros, cut where it is too large anyway."""
    return digits.lstrip("0")[:4] or "0"


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37 and 12 <= len(digits := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


def mod97(iban: str) -> bool:
    plain = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """The longest run of groups after a country code and check digits that passes mod-97. Every place where one
    may begin is tried, so that a candidate that fails hides none that begins within it."""
    after = 0
    for m in IBAN.finditer(text):
        whole = m[1]
        for end in sorted({len(whole), *(x.start() for x in re.finditer(" ", whole))}, reverse=True) if m.start() >= after else ():
            if len(whole[:end].replace(" ", "")) >= 15 and mod97(whole[:end]):
                after = m.start() + end
                yield m.start(), after
                break


def ssns(text: str) -> Iterator[tuple[int, int]]:
    return (m.span() for m in SSN.finditer(text))


FIND = {"email": emails, "ip": ips, "card": cards, "phone": phones, "iban": ibans, "ssn": ssns}


def spans(text: str) -> list[tuple[int, int, int, float]]:
    """(start, index of the kind, end, score), in order."""
    out = []
    for k, kind in enumerate(KINDS):
        for start, end in FIND[kind](text):
            near = text[max(0, start - WINDOW) : start].lower() + " " + text[end : end + WINDOW].lower()
            score = min(1.0, PRIOR[kind] + BOOST * any(w in near for w in CONTEXT[kind]))
            if kind in BASE or score >= THRESHOLD:
                out.append((start, k, end, round(score, 3)))
    return sorted(out)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores array<double>"


def find_pii(docs: DataFrame) -> DataFrame:
    """One row a document with columns doc_id and text; scores has each span's, in the order of spans."""

    def run(source):
        for batch in batches(source):
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = spans(text) if text else []
                said = [f"{KINDS[k]}:{start}:{end}" for start, k, end, _ in found]
                base = ",".join(s for s, x in zip(said, found, strict=True) if x[1] < len(BASE))
                counts = [sum(x[1] == k for x in found) for k in range(len(BASE))]
                rows.append((doc_id, *counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(said), [x[3] for x in found]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], NAMES)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
TYPES = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.list_(pa.float64())]


def query(spark, sf_dir):
    return find_pii(only(read(spark, sf_dir, "documents"), doc_id="doc_id", text="text"))
