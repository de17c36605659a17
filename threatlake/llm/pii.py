"""Personal data by anchor expansion.

One Aho-Corasick pass finds short anchors (at-signs, scheme marks, digit joints, plus
signs, identifier cues); deterministic local parsers expand each anchor to the
boundaries of an email, address, card, phone, link or account and validate it.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

from pyspark.sql import DataFrame

from .common import fresh, map_texts

#: Order of kinds among spans that start together; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "url", "iban", "ssn", "secret")
_RANK = {k: i for i, k in enumerate(KINDS)}
_DIGITS = "0123456789"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN_AT = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP_AT = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD_AT = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE_AT = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL_AT = re.compile(r"[^\s<>\"'`{}|\\^\[\]]+")
_IBAN_AT = re.compile(r"[\s:#=]{0,4}([A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]){11,30})")
#: Characters of an account number by country (IBAN registry).
_IBAN_SIZE = {c: int(n) for n, cs in (p.split(":") for p in (
    "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA "
    "23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM "
    "28:AL,AZ,BY,CY,DO,GT,HN,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU").split()) for c in cs.split(",")}  # fmt: skip
_SSN_AT = re.compile(r"[\s:#=]{0,4}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])")
_SECRET_AT = re.compile(r"[A-Za-z0-9_+/=-]{20,}(?=\")")


@cache
def _anchors():
    import ahocorasick

    found = ahocorasick.Automaton()
    words = {"@": "email", "://": "url", '= "': "secret", ': "': "secret", '="': "secret"}
    words |= {cue: "iban" for cue in ("IBAN", "iban", "Iban")} | {cue: "ssn" for cue in ("SSN", "ssn")}
    words |= {d + ".": "ip" for d in _DIGITS} | {"+" + d: "phone" for d in _DIGITS}
    words |= {a + joint + b: "card" for a in _DIGITS for b in _DIGITS for joint in ("", " ", "-")}
    for text, kind in words.items():
        found.add_word(text, (kind, len(text)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _iban(text: str) -> bool:
    text = text.replace(" ", "")
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _iban_size(run: str) -> int:
    """Length of the account number that a run of groups begins with, 0 if there is none.

    The country fixes its number of characters; where the country is not known, every end
    of a group is tried, longest first.
    """
    places = [i + 1 for i, c in enumerate(run) if c != " "]
    if known := _IBAN_SIZE.get(run[:2]):
        ends = [places[known - 1]] if len(places) >= known else []
    else:
        ends = [i for i in reversed(places) if i == len(run) or run[i] == " "]
    return next((i for i in ends if _iban(run[:i])), 0)


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """All valid spans (kind, start, end), by start and kind. Code points, end exclusive."""
    out: list[tuple[str, int, int]] = []
    done = dict.fromkeys(KINDS, 0)  # where the last candidate of a kind ended, valid or not
    for last, (kind, size) in _anchors().iter(text):
        at, end = last - size + 1, last + 1
        if at < done[kind]:
            continue
        if kind == "email":
            start = at
            while start > done["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN_AT.match(text, end)):
                done["email"] = m.end()
                out.append(("email", start, m.end()))
        elif kind == "ip":
            start = at
            while start > done["ip"] and text[start - 1] in _DIGITS:
                start -= 1
            if m := _IP_AT.match(text, start):
                done["ip"] = m.end()
                if all(map(_octet, m[0].split("."))):
                    out.append(("ip", start, m.end()))
        elif kind == "card":
            m = _CARD_AT.match(text, at)
            done["card"] = m.end()
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", at, m.end()))
        elif kind == "phone":
            if m := _PHONE_AT.match(text, at):
                done["phone"] = m.end()
                if 10 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    out.append(("phone", at, m.end()))
        elif kind == "url":
            start = at
            while start > done["url"] and text[start - 1] in _SCHEME:
                start -= 1
            # a run is matched only behind a scheme, and then left behind: linear in the text
            if start < at and text[start].isalpha() and (m := _URL_AT.match(text, end)):
                stop = end + len(m[0].rstrip(".,;:!?)"))
                done["url"] = m.end()
                if stop > end:
                    out.append(("url", start, stop))
        elif kind == "iban":
            if (m := _IBAN_AT.match(text, end)) and (size := _iban_size(m[1])):
                done["iban"] = m.start(1) + size
                out.append(("iban", m.start(1), m.start(1) + size))
        elif kind == "ssn":
            if m := _SSN_AT.match(text, end):
                done["ssn"] = m.end()
                out.append(("ssn", m.start(1), m.end(1)))
        elif m := _SECRET_AT.match(text, end):
            done["secret"] = m.end()
            out.append(("secret", end, m.end()))
    out.sort(key=lambda s: (s[1], _RANK[s[0]]))
    return out


def _join(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _columns(texts: list[str]) -> dict[str, list]:
    got: dict[str, list] = {n: [] for n in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")}
    for text in texts:
        spans = find_spans(text)
        base = [s for s in spans if _RANK[s[0]] < 4]
        for kind in KINDS[:4]:
            got[f"n_{kind}"].append(sum(s[0] == kind for s in base))
        got["base_sha256"].append(hashlib.sha256(_join(base).encode()).hexdigest())
        got["spans"].append(_join(spans))
    return got


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: counts of the base kinds, a digest of the base spans, all spans.

    A null or empty text has no spans (the digest is that of the empty string). Rows are
    independent, so repeated rows, ties and null ids give one row each; other columns are
    ignored. An empty table gives no rows. Work is linear in the text: each parser starts
    after the last candidate of its kind.
    """
    schema = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return map_texts(fresh(docs, id_col, text_col), _columns, schema).withColumnRenamed("_id", id_col)
