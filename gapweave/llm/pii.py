"""Personal data by anchor expansion.

An Aho-Corasick automaton reports anchors: at-signs, plus signs before digits, dotted and
paired digits, URL schemes and cues of account numbers. A deterministic parser expands each
anchor to the left and right over the characters its kind may hold and validates the span;
no pattern is matched against the rest of the text.

Base kinds have the spans that leftmost, non-overlapping, greedy matches of these patterns have:
email `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, ip (four dotted numbers up to
255), card (14 to 19 digits, single spaces or hyphens between, Luhn), phone (+, 10 to 15
digits). A match that fails its check is dropped, and the next one starts behind it. Kinds the
anchors add: url (scheme://userinfo@host, so addresses with credentials), iban (mod 97) and
account (digits behind a cue). They never displace base spans.

Cases: null is an empty text; offsets are code points, end exclusive; null doc_ids and
repeated rows are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship
from . import _arrow

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "account")

DIGITS = frozenset("0123456789")
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") | DIGITS
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
SCHEMES = ("http://", "https://", "ftp://", "ftps://", "ssh://", "sftp://")
CUES = ("account no", "account number", "acct no", "acct #", "account #", "iban", "ssn", "konto", "compte no", "cuenta no")

_automaton = None


def automaton() -> ahocorasick.Automaton:
    """Anchors of all kinds; text is searched as it is, cues in a few spellings."""
    global _automaton
    if _automaton is None:
        a = ahocorasick.Automaton()
        a.add_word("@", ("email", 1))
        for d in "0123456789":
            a.add_word("+" + d, ("phone", 2))
            for e in "0123456789":
                a.add_word(f"{d}.{e}", ("ip", 3))
                for gap in ("", " ", "-"):
                    a.add_word(d + gap + e, ("card", 2 + len(gap)))
        for s in SCHEMES:
            a.add_word(s, ("url", len(s)))
        for c in CUES:
            for v in {c, c.upper(), c.capitalize(), c.title()}:
                a.add_word(v, ("cue", len(v)))
        a.make_automaton()
        _automaton = a
    return _automaton


def _right(t: str, at: int, allowed: frozenset, end: int) -> int:
    while at < end and t[at] in allowed:
        at += 1
    return at


def _left(t: str, at: int, allowed: frozenset, least: int) -> int:
    while at > least and t[at - 1] in allowed:
        at -= 1
    return at


def email(t: str, sign: int, least: int) -> tuple[int, int] | None:
    """The address around the at-sign, not reaching back before `least`."""
    start, n = _left(t, sign, LOCAL, least), len(t)
    if start == sign:
        return None
    end = first = _right(t, sign + 1, LABEL, n)
    if first == sign + 1:
        return None
    while end < n and t[end] == "." and (to := _right(t, end + 1, LABEL, n)) > end + 1:
        end = to
    return (start, end) if end > first else None


def dotted(t: str, anchor: int) -> tuple[list[tuple[int, int]], int]:
    """Digit runs joined by single dots around the anchor (a digit), and where their chain ends."""
    at = anchor
    while True:
        at = _left(t, at, DIGITS, 0)
        if at >= 2 and t[at - 1] == "." and t[at - 2] in DIGITS:
            at -= 1
        else:
            break
    runs, n = [], len(t)
    while True:
        end = _right(t, at, DIGITS, n)
        runs.append((at, end))
        if end + 1 < n and t[end] == "." and t[end + 1] in DIGITS:
            at = end + 1
        else:
            return runs, end


def _byte(t: str) -> bool:
    t = t.lstrip("0")
    return len(t) <= 3 and int(t or 0) <= 255


def paired(t: str, anchor: int) -> tuple[int, int]:
    """The chain of digits with at most one space or hyphen between, around the anchor (a digit)."""
    at, n = anchor, len(t)
    while at and (t[at - 1] in DIGITS or at > 1 and t[at - 1] in " -" and t[at - 2] in DIGITS):
        at -= 1 if t[at - 1] in DIGITS else 2
    end = anchor + 1
    while end < n and (t[end] in DIGITS or end + 1 < n and t[end] in " -" and t[end + 1] in DIGITS):
        end += 1 if t[end] in DIGITS else 2
    return at, end


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if k % 2 == 0 else 2 * x - 9 * (x > 4)
    return total % 10 == 0


def phone(t: str, plus: int) -> tuple[int, int] | None:
    """The number at a plus sign that a digit follows."""
    end = _right(t, plus + 2, PHONE, len(t))
    while end > plus + 3 and t[end - 1] not in DIGITS:
        end -= 1
    if end <= plus + 3 or t[end - 1] not in DIGITS:
        return None
    return (plus, end) if 10 <= sum(c in DIGITS for c in t[plus:end]) <= 15 else None


def url(t: str, scheme: int, after: int) -> tuple[int, int] | None:
    """scheme://user[:password]@host with a dotted or local host name."""
    n = len(t)
    end = after
    while end < n and not t[end].isspace() and t[end] not in "/\"'<>@":
        end += 1
    if end == after or end >= n or t[end] != "@":
        return None
    host = _right(t, end + 1, LABEL | frozenset(".:"), n)
    while host > end + 1 and t[host - 1] in ".:-":
        host -= 1
    return (scheme, host) if host > end + 1 else None


def iban(code: str) -> bool:
    """Country, check digits and 11 to 30 more characters that fulfil mod 97."""
    if not (15 <= len(code) <= 34 and code[:2].isalpha() and code[2:4].isdigit() and code.isascii() and code.isalnum()):
        return False
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def account(t: str, after: int) -> tuple[str, int, int] | None:
    """An IBAN, or 6 to 17 digits in groups joined by spaces or hyphens, right behind a cue."""
    at, n = after, len(t)
    while at < n and at < after + 4 and t[at] in " .:#=":
        at += 1
    if at + 1 < n and t[at] in ALNUM and t[at] not in DIGITS and t[at + 1] in ALNUM and t[at + 1] not in DIGITS:
        end, last, code = at, at, ""
        while end < n and len(code) < 34 and (t[end] in ALNUM or t[end] == " "):
            if t[end] != " ":
                code += t[end]
                if iban(code):
                    last = end + 1
            end += 1
        return ("iban", at, last) if last > at else None
    if at < n and t[at] in DIGITS:
        start, end = paired(t, at)
        if start == at and 6 <= sum(c in DIGITS for c in t[at:end]) <= 17:
            return "account", at, end
    return None


def spans(t: str) -> list[tuple[str, int, int]]:
    """All spans of a text as (kind, start, end), by start, then kind in the order of KINDS."""
    out: list[tuple[str, int, int]] = []
    done = dict.fromkeys(KINDS, 0)  # where the search of each kind goes on
    for last, (kind, n) in automaton().iter(t):
        at = last + 1 - n
        if kind == "email":
            if got := email(t, at, done["email"]):
                out.append(("email", *got))
                done["email"] = got[1]
        elif kind == "ip":
            if at >= done["ip"]:
                runs, done["ip"] = dotted(t, at)
                for k in range(0, len(runs) - 3, 4):
                    if all(_byte(t[a:b]) for a, b in runs[k : k + 4]):
                        out.append(("ip", runs[k][0], runs[k + 3][1]))
        elif kind == "card":
            if at >= done["card"]:
                start, done["card"] = paired(t, at)
                digits = t[start : done["card"]].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", start, done["card"]))
        elif kind == "phone":
            if got := phone(t, at):
                out.append(("phone", *got))
        elif kind == "url":
            if at >= done["url"] and (got := url(t, at, last + 1)):
                out.append(("url", *got))
                done["url"] = got[1]
        elif last + 1 >= done["account"] and (got := account(t, last + 1)):
            out.append(got)
            done["account"] = got[2]
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda s: (s[1], order[s[0]]))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans array<struct<kind, start, end>> of every document."""
    ship(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _arrow.slices(batch, "text"):
                found = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(t)] if t else [] for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def digest(found: list[tuple[str, int, int]]) -> str:
    """SHA-256 of the base spans, as the query states it."""
    return hashlib.sha256(joined([s for s in found if s[0] in BASE]).encode()).hexdigest()
