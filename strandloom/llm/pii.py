"""Personal data by anchor expansion.

One pass of an Aho-Corasick automaton over the text finds all anchors: at-signs, plus signs before a digit, digits around a dot, digits
that follow each other directly or by one space or hyphen, URL schemes, and identifier cues. From each, a deterministic local parser walks
outward and validates what it finds: an e-mail address around an at-sign, an international phone number from a plus sign on, an IPv4 address
around a dot, a card number from a chain's first two digits on, a network address behind a scheme, an IBAN or account number behind a cue.
A parser doesn't look at what an earlier find of its kind covers.

Spans are code points, end exclusive. Kinds, in their order: email, ip, card, phone, then url, iban, account.
Every parser is linear in the text, also in texts of one long run.

Cases: null and empty texts have no spans. Equal rows get equal spans. Other columns are untouched.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "url", "iban", "account"]
SPANS = "array<struct<kind:string,start:int,end:int>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

SCHEMES = ["http://", "https://", "ftp://"]
CUES = ["account", "acct", "iban", "konto", "kontonummer", "compte", "cuenta", "passport", "passeport", "pasaporte", "reisepass", "ssn", "social security", "tax id", "routing", "sort code"]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
URL = re.compile(r"(?:[^\s/?#@\"'<>]{1,200}@)?((?:[A-Za-z0-9-]+\.)*[A-Za-z0-9-]+)(?::[0-9]{1,5})?(?:[/?#][^\s\"'<>]*)?")
NUMBER = re.compile(r"[ \t]*(?:number|no\.?|nr\.?|#)?[ \t]*[:=#]?[ \t]*(?:([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{1,4}){3,8})|([0-9](?:[ -]?[0-9]){5,33}))(?![A-Za-z0-9])", re.ASCII)
DIGITS = "0123456789"
LOWER = {c: c + 32 for c in range(65, 91)}
LUHN = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]

_AUTOMATON = []


def automaton():
    if not _AUTOMATON:
        import ahocorasick

        made = ahocorasick.Automaton()
        words = [("@", "email")] + [(word, "url") for word in SCHEMES] + [(word, "account") for word in CUES]
        words += [("+" + d, "phone") for d in DIGITS] + [(f"{a}.{b}", "ip") for a in DIGITS for b in DIGITS] + [(a + between + b, "card") for a in DIGITS for between in ("", " ", "-") for b in DIGITS]
        for word, kind in words:
            made.add_word(word, (kind, len(word)))
        made.make_automaton()
        _AUTOMATON.append(made)
    return _AUTOMATON[0]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(LUHN[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def iban(value: str) -> bool:
    value = value.replace(" ", "")
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def spans(text: str) -> list[tuple[str, int, int]]:
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    mail_end = ip_end = card_end = phone_end = url_end = account_end = 0
    for end, (kind, length) in automaton().iter(text.translate(LOWER)):
        start = end + 1 - length
        if kind == "card":
            if start >= card_end:  # else in a chain that has been looked at
                m = CARD.match(text, start)
                card_end = m.end()
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(m.span())
        elif kind == "ip":
            while start > ip_end and text[start - 1] in DIGITS:
                start -= 1
            if start >= ip_end and (m := IP.match(text, start)):
                ip_end = m.end()
                if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in m.group().split(".")):
                    found["ip"].append(m.span())
        elif kind == "phone":
            if start >= phone_end and (m := PHONE.match(text, start)):
                phone_end = m.end()
                if 8 <= sum(c in DIGITS for c in m.group()) <= 15:
                    found["phone"].append(m.span())
        elif kind == "email":
            m = DOMAIN.match(text, end) if end >= mail_end else None
            if m:
                while start > mail_end and text[start - 1] in LOCAL:
                    start -= 1
                if start < end:
                    found["email"].append((start, m.end()))
                    mail_end = m.end()
        elif kind == "url":
            if start >= url_end and (not start or not text[start - 1].isalnum()) and (m := URL.match(text, end + 1)) and ("." in m[1] or m[1] == "localhost"):
                stop = m.end()
                while text[stop - 1] in ".,;:!?)]}":
                    stop -= 1
                found["url"].append((start, stop))
                url_end = stop
        elif not start or not text[start - 1].isalnum():
            m = NUMBER.match(text, end + 1)
            if m and m.start() >= account_end:
                if m[1]:
                    if iban(m[1]):
                        found["iban"].append(m.span(1))
                        account_end = m.end()
                elif 6 <= sum(c.isdigit() for c in m[2]) <= 20:
                    found["account"].append(m.span(2))
                    account_end = m.end()
    return [(kind, a, b) for kind in KINDS for a, b in sorted(found[kind])]


def redacted(text: str) -> str:
    """text with every span replaced by its kind in brackets; of overlapping spans the one that starts first, then the longest, counts."""
    out, at = [], 0
    for kind, start, end in sorted(spans(text), key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    out.append(text[at:])
    return "".join(out)


def pii_spans(text: Column) -> Column:
    """Column of spans of a text column: array of (kind, start, end)."""

    @F.arrow_udf(SPANS)
    def find(column: pa.Array) -> pa.Array:
        return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in spans(t)] if t else [] for t in column.to_pylist()], SPAN_TYPE)

    return find(text.cast("string"))


def pii_redacted(text: Column) -> Column:
    @F.arrow_udf("string")
    def redact(column: pa.Array) -> pa.Array:
        return pa.array([redacted(t) if t else t for t in column.to_pylist()], pa.string())

    return redact(text.cast("string"))


def find_pii(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, pii: its spans in the order of kinds, then starts."""
    return small_batches(docs).select("doc_id", pii_spans(F.col("text")).alias("pii"))


def redact_pii(docs: DataFrame) -> DataFrame:
    """docs with text (and n_chars, if there) after redaction; all other columns and rows as they are."""
    out = small_batches(docs).withColumn("text", pii_redacted(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
