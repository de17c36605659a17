"""Secrets, confirmed by their structure.

Base patterns find assignments, access ids and long hex runs. Beyond them, every base64 or
hex run that can hold a key, every armoured block and every dotted token is a candidate; it
is decoded and parsed (nested lengths of key encodings, the parts of a signed token), and
only what parses whole is reported.
"""

from __future__ import annotations

import binascii
import hashlib
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import fresh, map_texts

#: Order of kinds among spans that start together; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "armoured_key", "base64_key", "hex_key", "signed_token", "sealed_token")
BASE = 3
_RANK = {k: i for i, k in enumerate(KINDS)}
_ASSIGN = re.compile(r"""(?ia:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----")
_RUN64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
_RUN16 = re.compile(r"[0-9A-Fa-f]{80,}")
_DOTTED = re.compile(r"[A-Za-z0-9_.-]+")
_SOFT = re.compile(r"\\r|\\n|[\s]+")
_OPENSSH = b"openssh-key-v1\0"
#: Wrappings of an encoding in an encoding that are taken off before it must parse.
LAYERS = 3
#: Fixed values (RFC 7518): algorithms of a signed token and the bytes of a signature, 0 where the key decides.
SIGNED = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES256K": 64, "ES384": 96, "ES512": 132, "EdDSA": 64, "RS256": 0, "RS384": 0, "RS512": 0, "PS256": 0, "PS384": 0, "PS512": 0}
#: Least bytes of a signature whose size the key decides (512 bits).
LEAST_SIGNATURE = 64


def from_base64(text: str) -> bytes | None:
    """Bytes of a base64 text in either alphabet, with or without padding; None if it is none."""
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(text) % 4 == 1:
        return None
    try:
        return binascii.a2b_base64(text + "=" * (-len(text) % 4), strict_mode=True)
    except (binascii.Error, ValueError):
        return None


def elements(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the elements that fill data[start:end]; None if a length does not fit."""
    out = []
    while start < end:
        if end - start < 2 or data[start] & 31 == 31:
            return None
        tag, size, start = data[start], data[start + 1], start + 2
        if size > 127:
            more = size & 127
            if not 0 < more < 5 or start + more > end or not data[start] or (more == 1 and data[start] < 128):
                return None
            size, start = int.from_bytes(data[start : start + more]), start + more
        if start + size > end:
            return None
        out.append((tag, start, start + size))
        start += size
    return out


def _algorithm(data: bytes, element: tuple[int, int, int]) -> bool:
    """A sequence that begins with an object identifier of whole arcs."""
    inner = elements(data, *element[1:]) if element[0] == 0x30 else None
    return bool(inner) and inner[0][0] == 6 and inner[0][1] < inner[0][2] and data[inner[0][2] - 1] < 128


def _whole(data: bytes, element: tuple[int, int, int]) -> bool:
    """A positive integer without needless leading bytes."""
    tag, a, b = element
    return tag == 2 and a < b and data[a] < 128 and not (b - a > 1 and data[a] == 0 and data[a + 1] < 128)


def is_der_key(data: bytes) -> bool:
    """A private key in DER: RSA, DSA, EC, PKCS 8 (plain or encrypted) or a PKCS 12 store."""
    top = elements(data, 0, len(data)) if data[:1] == b"\x30" else None
    parts = elements(data, *top[0][1:]) if top and len(top) == 1 else None
    if not parts or len(parts) < 2:
        return False
    tags = [t for t, _, _ in parts]
    number = data[parts[0][1] : parts[0][2]]
    if len(parts) >= 9 and number in (b"\0", b"\1") and all(_whole(data, p) for p in parts[:9]):
        return parts[1][2] - parts[1][1] >= 32 and (len(parts) == 9) == (number == b"\0")
    if len(parts) == 6 and number == b"\0" and all(_whole(data, p) for p in parts):
        return parts[1][2] - parts[1][1] >= 32
    if tags[:2] == [2, 4] and number == b"\1":  # the curve's parameters and the public point may follow
        return parts[1][2] - parts[1][1] >= 16 and set(tags[2:]) <= {0xA0, 0xA1} and all(elements(data, a, b) for _, a, b in parts[2:])
    if tags[:3] == [2, 0x30, 4] and number in (b"\0", b"\1"):
        return _algorithm(data, parts[1]) and parts[2][2] - parts[2][1] >= 16 and set(tags[3:]) <= {0xA0, 0x81, 0xA1}
    if tags == [0x30, 4]:
        return _algorithm(data, parts[0]) and parts[1][2] - parts[1][1] >= 16
    return tags[:2] == [2, 0x30] and number == b"\3" and len(parts) <= 3 and _algorithm(data, parts[1])


def _strings(data: bytes, at: int, count: int) -> int:
    """Where `count` strings, each after its length in four bytes, end; -1 if one does not fit."""
    for _ in range(count):
        if at + 4 > len(data):
            return -1
        at += 4 + int.from_bytes(data[at : at + 4])
    return at if at <= len(data) else -1


def is_openssh_key(data: bytes) -> bool:
    """An OpenSSH private key: cipher, derivation and its options, a count, that many public keys, one block."""
    if not data.startswith(_OPENSSH):
        return False
    at = _strings(data, len(_OPENSSH), 3)
    if at < 0 or at + 4 > len(data):
        return False
    keys = int.from_bytes(data[at : at + 4])
    return 0 < keys < len(data) and _strings(data, at + 4, keys + 1) == len(data)


def is_key(data: bytes | None, layers: int = LAYERS) -> bool:
    """Whether bytes are a private key, or a text that is an encoded one, up to `layers` times."""
    while data:
        if is_der_key(data) or is_openssh_key(data):
            return True
        try:
            text = data.decode("ascii").strip()
        except UnicodeDecodeError:
            return False
        if layers <= 0 or not text:
            return False
        if any(True for _ in _armoured(text)):
            return True
        layers -= 1
        data = bytes.fromhex(text) if _RUN16.fullmatch(text) and len(text) % 2 == 0 else from_base64(_SOFT.sub("", text))
    return False


def _armoured(text: str) -> Iterator[tuple[int, int]]:
    """Armoured private keys: the body ends at the next dashes, which must close the same label."""
    for m in _ARMOUR.finditer(text):
        stop = text.find("-----", m.end())
        if stop < 0:
            return
        close = f"-----END {m[1]}-----"
        if text.startswith(close, stop):
            body = text[m.end() : stop]
            if "\n\n" in body.strip().replace("\r", ""):  # header lines of an encrypted key
                body = body.strip().replace("\r", "").split("\n\n", 1)[1]
                if len(data := from_base64(_SOFT.sub("", body)) or b"") >= 64 and len(data) % 8 == 0:
                    yield m.start(), stop + len(close)
            elif (data := from_base64(_SOFT.sub("", body))) and (is_der_key(data) or is_openssh_key(data)):
                yield m.start(), stop + len(close)


def _object(part: str) -> dict | None:
    data = (from_base64(part) or b"").strip()
    if not data.startswith(b"{") or not data.endswith(b"}"):
        return None
    try:
        return json.loads(data)
    except (ValueError, RecursionError):
        return None


def token_parts(head: dict, rest: list[str]) -> int:
    """Parts after the header that make a token with it: two if signed, four if sealed, else none."""
    if len(rest) >= 4 and isinstance(head.get("enc"), str):
        fits = all(rest[1:4]) and all(from_base64(p) is not None for p in rest[:4] if p)
        return 4 if fits and isinstance(head.get("alg"), str) else 0
    size = SIGNED.get(head["alg"]) if isinstance(head.get("alg"), str) else None
    if len(rest) < 2 or size is None or from_base64(rest[0]) is None:
        return 0
    got = len(from_base64(rest[1]) or b"")
    return 2 if got == size or not size and got >= LEAST_SIGNATURE else 0


def _tokens(text: str) -> Iterator[tuple[str, int, int]]:
    for m in _DOTTED.finditer(text):
        parts, starts, at = m[0].split("."), [], m.start()
        for p in parts:
            starts.append(at)
            at += len(p) + 1
        k = 0
        while k + 2 < len(parts):
            cut = parts[k].find("eyJ")  # a header may follow other characters of the alphabet
            for skip in sorted({0, max(cut, 0)}):
                if (head := _object(parts[k][skip:])) and (more := token_parts(head, parts[k + 1 : k + 5])):
                    k += more
                    yield "signed_token" if more == 2 else "sealed_token", starts[k - more] + skip, starts[k] + len(parts[k])
                    break
            k += 1


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end), by start and kind. Code points, end exclusive."""
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    blocks = list(_armoured(text)) if "-----BEGIN " in text else []
    out += [("armoured_key", a, b) for a, b in blocks]
    k = 0
    for m in _RUN64.finditer(text):
        while k < len(blocks) and blocks[k][1] <= m.start():
            k += 1
        if not (k < len(blocks) and blocks[k][0] <= m.start()) and not _RUN16.fullmatch(m[0]) and is_key(from_base64(m[0])):
            out.append(("base64_key", *m.span()))
    out += [("hex_key", *m.span()) for m in _RUN16.finditer(text) if (m.end() - m.start()) % 2 == 0 and is_key(bytes.fromhex(m[0]))]
    out += _tokens(text)
    out.sort(key=lambda s: (s[1], _RANK[s[0]]))
    return out


def _join(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _columns(texts: list[str]) -> dict[str, list]:
    got: dict[str, list] = {n: [] for n in (*(f"n_{k}" for k in KINDS[:BASE]), "n_confirmed", "base_sha256", "spans")}
    for text in texts:
        spans = find_secrets(text)
        base = [s for s in spans if _RANK[s[0]] < BASE]
        for kind in KINDS[:BASE]:
            got[f"n_{kind}"].append(sum(s[0] == kind for s in base))
        got["n_confirmed"].append(len(spans) - len(base))
        got["base_sha256"].append(hashlib.sha256(_join(base).encode()).hexdigest())
        got["spans"].append(_join(spans))
    return got


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: counts of the base kinds and of confirmed ones, a digest of the base spans, all spans.

    A null or empty text has no spans (the digest is that of the empty string). Rows are
    independent: repeated rows, ties and null ids give one row each; other columns, whatever
    their names, are ignored. An empty table gives no rows. Whole texts of any length are
    searched; each pattern takes linear time, and a candidate is decoded once per layer.
    """
    schema = "n_assign long, n_access long, n_hex long, n_confirmed long, base_sha256 string, spans string"
    return map_texts(fresh(docs, id_col, text_col), _columns, schema).withColumnRenamed("_id", id_col)
