"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over the whole text: at-signs, plus signs,
digits, scheme separators and identifier cues.  At each anchor a small deterministic parser
expands to both sides, fixes the boundaries and validates.  Parsers never look back over text
that one of their kind has consumed, so a text of any shape takes linear time.

Kinds: email, ip, card, phone (the base kinds), then url, iban and account, which only anchors
of their own add.  Spans are in code points, end exclusive.

Defined results: null and empty texts have no spans; rows that repeat a doc_id are judged one by
one, a null doc_id too; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from catamatch.llm.common import map_slices, texts

KINDS = ("email", "ip", "card", "phone", "url", "iban", "account")
BASE = KINDS[:4]
CUES = ("account", "acct", "konto", "compte", "cuenta")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_CARD_RUN = re.compile(r"[0-9 -]*")
_PHONE_RUN = re.compile(r"[ ().0-9-]*")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_URL_REST = re.compile(r"[^\s<>\"'`|\\^{}\[\]]+")
_IBAN = re.compile(r"[\s:.#]{0,8}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?:[ \t]{0,4}(?:no|nr|number|num)\b)?[\s.:#]{1,8}([0-9](?:[ -]?[0-9]){5,16})(?![0-9])", re.I)


@cache
def automaton() -> ahocorasick.Automaton:
    """Anchors and the parser each one calls."""
    a = ahocorasick.Automaton()
    for word, tag in (("@", "@"), ("+", "+"), ("://", "s"), *((d, "d") for d in "0123456789")):
        a.add_word(word, (tag, len(word)))
    for word in ("iban", "IBAN", "Iban"):
        a.add_word(word, ("i", len(word)))
    for word in CUES:
        for form in (word, word.capitalize(), word.upper()):
            a.add_word(form, ("a", len(form)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    twice = "0246813579"
    return sum(int(twice[int(d)]) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def _valid_iban(text: str) -> bool:
    code = text.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _email(text: str, at: int, done: int):
    lo = at
    while lo > done and text[lo - 1] in _LOCAL:
        lo -= 1
    m = _DOMAIN.match(text, at + 1) if lo < at else None
    return (lo, m.end()) if m else None


def _addresses(text: str, start: int) -> tuple[list[tuple[int, int]], int]:
    """Dotted quadruples in the run of digits and dots from ``start`` on, and the run's end."""
    found, group = [], []
    end = start
    while m := _DIGITS.match(text, end):
        group.append(m.span())
        end = m.end()
        if len(group) == 4:
            parts = [text[a:b].lstrip("0") for a, b in group]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                found.append((group[0][0], end))
            group = []
        if not text.startswith(".", end):
            break
        end += 1
    return found, end


def _phone(text: str, at: int):
    if not _DIGITS.match(text, at + 1):
        return None
    last = _PHONE_RUN.match(text, at + 1).end()
    while last > at + 3 and not text[last - 1].isdigit():
        last -= 1
    if last <= at + 3:
        return None
    return (at, last) if 9 <= len(_NOT_DIGIT.sub("", text[at:last])) <= 15 else None


def _url(text: str, at: int, done: int):
    lo = at
    while lo > done and text[lo - 1] in _SCHEME:
        lo -= 1
    while lo < at and not (text[lo].isascii() and text[lo].isalpha()):
        lo += 1
    m = _URL_REST.match(text, at + 3) if lo < at else None
    end = at + 3 + len(m[0].rstrip(".,;:!?)")) if m else 0
    return (lo, end) if m and end > at + 3 and text[at + 3].isalnum() else None


def find(text: str) -> list[tuple[int, int, int]]:
    """Sorted (start, kind number, end) of all spans."""
    spans: list[tuple[int, int, int]] = []
    mail_end = address_end = card_end = url_end = iban_end = account_end = 0
    for last, (tag, size) in automaton().iter(text):
        if tag == "d":
            if last >= address_end:
                found, address_end = _addresses(text, last)
                spans += [(a, 1, b) for a, b in found]
            if last >= card_end:
                card_end = _CARD_RUN.match(text, last).end()
                for m in _CARD.finditer(text, last, card_end):
                    digits = _NOT_DIGIT.sub("", m[0])
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        spans.append((m.start(), 2, m.end()))
        elif tag == "@":
            if got := _email(text, last, mail_end):
                spans.append((got[0], 0, got[1]))
                mail_end = got[1]
            else:
                mail_end = last + 1
        elif tag == "+":
            if got := _phone(text, last):
                spans.append((got[0], 3, got[1]))
        elif tag == "s":
            if last >= url_end:
                got = _url(text, last - 2, url_end)
                url_end = got[1] if got else last + 1
                if got:
                    spans.append((got[0], 4, got[1]))
        elif tag == "i":
            if last >= iban_end and (m := _IBAN.match(text, last + 1)) and _valid_iban(m[1]):
                spans.append((m.start(1), 5, m.end(1)))
                iban_end = m.end(1)
        elif last >= account_end and (m := _ACCOUNT.match(text, last + 1)):
            spans.append((m.start(1), 6, m.end(1)))
            account_end = m.end(1)
    return sorted(spans)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base spans and all spans as ``kind:start:end,...``."""
    def run(cols):
        out = {"doc_id": cols["doc_id"], **{f"n_{k}": [] for k in BASE}, "base": [], "spans": []}
        for raw in cols["text"]:
            spans = find(raw.decode())
            base = [s for s in spans if s[1] < len(BASE)]
            for i, k in enumerate(BASE):
                out[f"n_{k}"].append(sum(s[1] == i for s in base))
            out["base"].append(joined(base))
            out["spans"].append(joined(spans))
        return out

    counts = ", ".join(f"n_{k} bigint" for k in BASE)
    return map_slices(texts(docs), run, f"doc_id bigint, {counts}, base string, spans string")


def mask(text: str) -> str:
    """The text with every span replaced by its kind; overlapping spans become one."""
    out, at = [], 0
    for a, k, b in find(text):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame) -> DataFrame:
    """The documents with personal data masked; other columns pass through."""
    @pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return text.map(mask, na_action="ignore")

    return docs.withColumn("text", run(F.col("text")))
