"""Personal data by anchor expansion: Aho-Corasick finds cues, local parsers find what belongs to them."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_and_text, slices, texts

#: Words that announce an identifier, in any case.
CUES = (
    "token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "api-key", "api key", "access_key", "accesskey", "access-key",
    "private_key", "private-key", "privatekey", "bearer", "iban", "ssn", "passport", "account", "acct",
)
SCHEMES = ("http://", "https://", "ftp://", "www.")
SCHEMA = "doc_id long, kind string, start long, end long, value string"
#: Lengths of the account numbers of ISO 13616 by country.
IBAN = dict(
    (x[:2], int(x[2:]))
    for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23"
        " GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30"
        " NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
    ).split()
)

# The numbers in these are those of the standards: 64 characters of the local part of an address, 63 of a label, 253 of a name.
_DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])")
_HOST = re.compile(r"(?:\d{1,3}(?:\.\d{1,3}){3}|localhost|(?:[\w-]{1,63}\.)+[^\W\d_]{2,24})(?::\d{1,5})?(?=[/?#\s]|\W|$)")
_IP = re.compile(r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})(?!\.?\d)(?![^\W\d_])")
_PHONE = re.compile(r"(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})|\(\d{3}\)|\d{3}(?=[ .-]))[ .-]?\d{3}[ .-]?\d{4}(?!\d)")
_INTERNATIONAL = re.compile(r"\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?!\d)")
_SSN = re.compile(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\d-])")
_ACCOUNT = re.compile(r"(?:\d{12,19}|\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,3})?)(?![\d])(?!\.\d)")
#: What stands between a cue and its value: the end of its name, perhaps in quotes, and a sign or word of assignment.
_ASSIGNED = re.compile(r"[\"']?(?:[ _-]?(?:id|no|nr|number|key)\b)?[\"']?[ \t]*(?:(=>|:=|[=:#])|(is)\b)?[ \t]*", re.I)
_CLOSERS, _OPENERS = ")]}", "([{"


class _Runs:
    """The ends of runs of characters that a pattern takes; a run is looked through once, however many anchors are in it."""

    def __init__(self, text: str, pattern: str):
        self.text, self.match = text, re.compile(pattern).match
        self.start = self.stop = 0

    def end(self, at: int) -> int:
        if not self.start <= at < self.stop:
            self.start, self.stop = at, self.match(self.text, at).end()
        return max(self.stop, at)


class _Text:
    """A text and the runs in it that parsers ask for."""

    def __init__(self, text: str):
        self.text = text
        self.lower = text.lower()
        if len(self.lower) != len(text):  # a few letters become two
            self.lower = "".join(x if len(x := c.lower()) == 1 else c for c in text)
        self.authority = _Runs(text, r"[^\s/?#<>\"'|\\]*")
        self.rest = _Runs(text, r"[^\s<>\"'|]*")
        self.value = _Runs(text, r"[^\s\"'<>,;`]*")
        self.hexes = _Runs(text, r"[0-9A-Fa-f:.]*")
        #: Places found once for a run: its last at-sign; the end of its value and the last place of a sign that makes it a secret.
        self.signs: dict[int, int] = {}
        self.values: dict[int, tuple[int, int, int]] = {}


def build_automaton() -> ahocorasick.Automaton:
    """The anchors in lower case; it reads a copy of a text that is lower-cased and as long."""
    automaton = ahocorasick.Automaton()
    for word, sort in anchors().items():
        automaton.add_word(word, (len(word), sort))
    automaton.make_automaton()
    return automaton


def anchors() -> dict[str, str]:
    found = dict.fromkeys(SCHEMES, "scheme") | dict.fromkeys(CUES, "cue") | {"@": "at", ":": "colon"}
    found |= dict.fromkeys("0123456789+(", "number")
    return found | {f"{country.lower()}{digit}": "iban" for country in IBAN for digit in "0123456789"}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    code = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in code)) % 97 == 1


def _email(t: _Text, at: int) -> tuple[int, int, str] | None:
    text, start = t.text, at
    while start > 0 and at - start <= 64 and (text[start - 1].isalnum() or text[start - 1] in "._%+-"):
        start -= 1
    while start < at and text[start] in ".-%+":
        start += 1
    local = text[start:at]
    domain = _DOMAIN.match(text, at + 1)
    if not local or len(local) > 64 or local[-1] == "." or ".." in local or not domain or len(domain[0]) > 253:
        return None
    return start, domain.end(), "email"


def _url(t: _Text, start: int, end: int) -> tuple[int, int, str] | None:
    text = t.text
    if start and (text[start - 1].isalnum() or text[start - 1] == "."):
        return None
    stop = t.authority.end(end)
    if stop not in t.signs:
        t.signs[stop] = text.rfind("@", t.authority.start, stop)
    host = _HOST.match(text, end)
    if not host and (at := t.signs[stop]) >= end:  # a user, perhaps with a password, before the host
        host = _HOST.match(text, at + 1)
    elif host and end <= (at := t.signs[stop]) and text[host.end() : host.end() + 1] in ("@", ":"):
        host = _HOST.match(text, at + 1) or host
    if not host:
        return None
    stop = t.rest.end(host.end())
    opened = {c: text.find(o, start, stop) for o, c in zip(_OPENERS, _CLOSERS)}
    while stop > host.end() and (text[stop - 1] in ".,;:!?*$%&#" or text[stop - 1] in _CLOSERS and not 0 <= opened[text[stop - 1]] < stop):
        stop -= 1
    return start, stop, "url"


def _number(t: _Text, at: int) -> tuple[int, int, str] | None:
    """A number that begins here: address, phone, social security or account."""
    text = t.text
    before = text[at - 1] if at else " "
    if before.isalnum() or before in "_@" or before == "." and at > 1 and text[at - 2].isdigit():
        return None
    found = _IP.match(text, at)
    if found and all(int(x) < 256 for x in found.groups()):
        return at, found.end(), "ip_address"
    for pattern, kind in ((_SSN, "ssn"), (_ACCOUNT, "account"), (_PHONE, "phone"), (_INTERNATIONAL, "phone")):
        found = pattern.match(text, at)
        if found:
            digits = re.sub(r"\D", "", found[0])
            end = found.end()
            after = text[end] if end < len(text) else " "
            if after.isalnum() or after in "_@" or kind == "phone" and not 7 <= len(digits) <= 15:
                continue
            if kind == "account" and not luhn(digits):
                continue
            return at, end, kind
    return None


def _iban(t: _Text, at: int) -> tuple[int, int, str] | None:
    """A country, two digits and what the country's length leaves, single spaces or hyphens between any of them."""
    text, left, end = t.text, IBAN[t.lower[at : at + 2].upper()], at
    if at and (text[at - 1].isalnum() or text[at - 1] == "_"):
        return None
    signs: list[str] = []
    while end < len(text) and len(signs) < left:
        c = text[end]
        if c.isascii() and c.isalnum():
            signs.append(c.upper())
        elif c not in " -" or not text[end - 1].isalnum():
            return None
        end += 1
    if len(signs) < left or not "".join(signs[2:4]).isdigit() or end < len(text) and (text[end].isalnum() or text[end] == "_"):
        return None
    return (at, end, "iban") if mod97("".join(signs)) else None


def _ipv6(t: _Text, at: int) -> tuple[int, int, str] | None:
    """The address of hexadecimal groups around a colon."""
    text = t.text
    if t.hexes.start <= at < t.hexes.stop:
        return None  # the run around an earlier colon
    start = at
    while start > 0 and text[start - 1] in "0123456789abcdefABCDEF":
        start -= 1
    stop = t.hexes.end(start)
    while stop > start and (text[stop - 1] == "." or text[stop - 1] == ":" and text[stop - 2 : stop - 1] != ":"):
        stop -= 1
    value = text[start:stop]
    if len(value) > 45 or value.count(":") < 2 or not any(c.isdigit() for c in value) or len([x for x in value.split(":") if x]) < 2:
        return None
    if start and (text[start - 1].isalnum() or text[start - 1] in "_:.") or stop < len(text) and (text[stop].isalnum() or text[stop] == "_"):
        return None
    try:
        ipaddress.IPv6Address(value)
    except ValueError:
        return None
    return start, stop, "ip_address"


def _cued(t: _Text, start: int, end: int) -> tuple[int, int, str] | None:
    """The identifier that a cue announces.

    It goes up to the quote that closes it, else to white space or a sign that ends values. A cue that ends a longer name, such as
    access_token, needs an assignment. A value that is assigned needs a digit or a sign that passwords have, another a digit.
    """
    text = t.text
    m = _ASSIGNED.match(text, end)
    at = m.end()
    if at == end or at >= len(text) or start and text[start - 1].isalnum() and not m[1]:
        return None
    if t.lower.startswith(SCHEMES, at):
        return None
    if t.lower[at : at + 2].upper() in IBAN and (iban := _iban(t, at)):
        return iban
    quote = text[at] if text[at] in "\"'`" else ""
    close = text.find(quote, at + 1) if quote else -1
    if 0 <= (line := text.find("\n", at, close)) < close:
        close = line if line < 0 else -1
    if close > 0 and m[1]:
        at += 1
        stop = close
        sure = any(c.isdigit() or c in "@#$%^&*!~" for c in text[at:stop])
    else:
        at += bool(quote)
        key = t.value.end(at)
        if key not in t.values:
            stop, begin = key, t.value.start
            while stop > begin and text[stop - 1] in ".=-:!?)]}":
                stop -= 1
            digit = max((i for i in range(stop - 1, begin - 1, -1) if text[i].isdigit()), default=-1)
            sign = max((i for i in range(stop - 1, begin - 1, -1) if text[i] in "@#$%^&*!~"), default=-1)
            t.values[key] = stop, digit, sign
        stop, digit, sign = t.values[key]
        sure = digit >= at or bool(m[1]) and sign >= at
    if stop - at < 6 or not sure:
        return None
    if stop - at < 40:
        value = text[at:stop]
        if _SSN.fullmatch(value):
            return at, stop, "ssn"
        if value.replace("-", "").isdigit():
            return at, stop, "account"
    return at, stop, "credential"


def _hits(automaton: ahocorasick.Automaton, lower: str) -> list[tuple[int, int, str]]:
    """(start, end, sort) of all anchors in the order of their ends; of those that end alike the longer first."""
    return [(end + 1 - n, end + 1, sort) for end, (n, sort) in automaton.iter(lower)]


def find(automaton: ahocorasick.Automaton, text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) in the order of their places; they don't overlap."""
    t = _Text(text)
    return choose(t, _hits(automaton, t.lower))


def choose(t: _Text, hits: Iterable[tuple[int, int, str]]) -> list[tuple[str, int, int, str]]:
    """What the parsers make of the anchors.

    E-mail addresses come first, from left to right. Of the others that which comes first by its anchor wins over what
    overlaps it, except that it must not cut an address; a URL that covers addresses whole stands for them.
    """
    hits = list(hits)
    emails: list[tuple[int, int, str]] = []
    taken = 0
    for start, _, sort in hits:
        if sort == "at" and start >= taken and (x := _email(t, start)) and x[0] >= taken:
            emails.append(x)
            taken = x[1]
    spans: list[tuple[int, int, str]] = []
    k = taken = 0
    for start, end, sort in hits:
        if sort == "at" or start < taken:
            continue
        while k < len(emails) and emails[k][1] <= start:
            k += 1
        if k < len(emails) and emails[k][0] <= start:
            continue
        if sort == "scheme":
            got = _url(t, start, end)
        elif sort == "number":
            got = _number(t, start)
        elif sort == "iban":
            got = _iban(t, start)
        elif sort == "colon":
            got = _ipv6(t, start)
        else:
            got = _cued(t, start, end)
        if not got or got[0] < taken:
            continue
        past = k
        while got[2] == "url" and past < len(emails) and emails[past][1] <= got[1]:  # addresses that the URL covers
            past += 1
        if not any(a < got[1] and got[0] < b for a, b, _ in emails[max(0, past - (got[2] != "url")) : past + 2]):
            del emails[k:past]
            spans.append(got)
            taken = got[1]
    return [(kind, a, b, t.text[a:b]) for a, b, kind in sorted([*spans, *emails])]


def find_private(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row (doc_id, kind, start, end, value) for each e-mail, web or network address, phone, account or credential.

    An automaton reads the whole text once, lower-cased, for anchors: at-signs, schemes, colons, cues such as ``token`` in any case, the
    beginnings of IBANs and the signs that begin numbers. Parsers that look only around the anchor expand it to both sides and
    validate the boundaries. Values have no greatest length but those that standards set.
    Offsets count characters from 0, ``end`` is exclusive. Rows of a text don't overlap: e-mail addresses come before all but URLs that
    cover them, of the others that whose anchor comes first. A number without a cue is an account if its Luhn sum is right, an IBAN has
    its country's length and a remainder of 1. Null and empty texts have no rows, very long ones are read whole in linear time; repeated
    rows repeat theirs; a null id stays null; an empty table gives no rows. Other columns, of any name, are not read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = build_automaton()
        for batch in slices(batches, 1):
            rows = [
                (i, *x) for i, t in zip(batch.column(0).to_pylist(), texts(batch.column(1))) if t for x in find(automaton, t)
            ]
            if rows:
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.record_batch(
                    [pa.array(c, t) for c, t in zip(zip(*rows), types)],
                    names=["doc_id", "kind", "start", "end", "value"],
                )

    rows = id_and_text(docs, doc_id, text)
    return rows.mapInArrow(scan, SCHEMA)
