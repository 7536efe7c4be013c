"""Secret scan with structural confirmation.

Three base kinds are found by shape: ``assign`` (a value given to a password-like
name), ``access`` (an access key id) and ``hex`` (a long hex run). Further kinds are
reported only after decoding a candidate and parsing what it holds:

* ``der``  base64 (common or URL-safe; lines may be indented, their ends escaped) or hex of one DER sequence whose nested lengths fill it exactly and
  that starts as a private or public key does (a version or big integer, or an
  algorithm identifier with an object id);
* ``ssh``  base64 of the SSH key formats: length-prefixed fields that fill it, or the
  private-key container with its nested public keys;
* ``jwt``  three dot-separated parts: a JSON header naming an algorithm, a JSON body, a signature.

Spans are in code points, end exclusive. Nulls and edges: a null or empty text has
no spans; ids and other columns may hold anything; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dunning.llm.common import add_columns

KINDS = ("assign", "access", "hex", "der", "ssh", "jwt")
BASE_KINDS = KINDS[:3]
REPLACEMENT = "[SECRET]"

# Fixed patterns; letters of the names in either case, ASCII only. A run that is long
# enough is found by its length: shorter runs cannot be part of a longer match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_CHARS = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
#: Between two lines of a key: a line end, also escaped as in JSON text, and an indent.
JOIN = r"(?:\r?\n|(?:\\+r)?\\+n)[\x20\t]*"
#: Base64 (also over several lines, as in key files) that can hold a key: it starts with a
#: DER sequence's tag and long length, an SSH field length, or the SSH container's magic. The
#: last line may be of any length, or padding alone. In the common and in the URL-safe alphabet.
BASE64 = tuple(
    re.compile(rf"(?:(?<![{abc}])|(?<=\\n))(?:M[A-P]|AAAA[A-Z]|b3BlbnNzaC1rZXktdjE)[{abc}]{{28,}}(?:{JOIN}[{abc}]+)*(?:(?:{JOIN})?=){{0,2}}") for abc in ("A-Za-z0-9+/", "A-Za-z0-9_-")
)
JOINED = re.compile(JOIN)
NOT_DATA = re.compile(f"{JOIN}|=")
LINE = re.compile(f"{JOIN}|([A-Za-z0-9+/_-]+)")
HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{38,}")
SSH_MAGIC = b"openssh-key-v1\0"


def _der(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values in data[start:end], or None if the lengths don't fill it."""
    found, at = [], start
    while at < end:
        if at + 2 > end:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + size > end:
            return None
        found.append((tag, at, at + size))
        at += size
    return found


def is_der_key(data: bytes) -> bool:
    """One sequence that fills the data and is laid out as a key."""
    top = _der(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    parts = _der(data, *top[0][1:])
    if not parts or len(parts) < 2:
        return False
    first, second = parts[0], parts[1]
    if first[0] == 0x02:  # version or modulus, then an integer, an algorithm or key octets
        return second[0] in (0x02, 0x04, 0x30) and all(_der(data, *p[1:]) is not None for p in parts if p[0] in (0x30, 0x31))
    if first[0] == 0x30:  # algorithm identifier, then the key as bits or octets
        inner = _der(data, *first[1:])
        return bool(inner) and inner[0][0] == 0x06 and second[0] in (0x03, 0x04)
    return False


def _fields(data: bytes, at: int, most: int) -> tuple[list[bytes], int]:
    """Up to ``most`` length-prefixed fields from ``at`` on, and where they end."""
    found = []
    while len(found) < most and at + 4 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            break
        found.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return found, at


def is_ssh_key(data: bytes) -> bool:
    """Length-prefixed fields that start with a key type and fill the data."""
    found, end = _fields(data, 0, 16)
    return end == len(data) and len(found) >= 2 and re.fullmatch(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]+", found[0]) is not None


def ssh_container_size(data: bytes) -> int | None:
    """Bytes of the private-key container at the start of the data: cipher, key derivation and
    its options, the number of keys, so many public keys, and the private part."""
    if not data.startswith(SSH_MAGIC):
        return None
    names, at = _fields(data, len(SSH_MAGIC), 3)
    keys = int.from_bytes(data[at : at + 4], "big")
    if len(names) < 3 or not 1 <= keys <= 16:
        return None
    parts, end = _fields(data, at + 4, keys + 1)
    return end if len(parts) == keys + 1 and all(is_ssh_key(k) for k in parts[:-1]) else None


def der_size(data: bytes) -> int | None:
    """Bytes of the sequence at the start of the data, by its own length."""
    if len(data) < 4 or data[0] != 0x30:
        return None
    n = data[1] & 0x7F if data[1] & 0x80 else 0
    if n > 4:
        return None
    return 2 + n + int.from_bytes(data[2 : 2 + n], "big") if n else 2 + data[1]


def _base64(text: str, urlsafe: bool = False) -> bytes | None:
    text = NOT_DATA.sub("", text)
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_" if urlsafe else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def _end_of(text: str, size: int) -> int | None:
    """Where the base64 of ``size`` bytes ends in ``text`` (which may hold line ends), with its
    padding; None if that is not the end of a line."""
    left = -(-size * 4 // 3)
    for m in LINE.finditer(text):
        if m[1] is None:
            continue
        if left < len(m[0]):
            return None
        left -= len(m[0])
        if not left:
            return m.end() + len(re.match(rf"(?:(?:{JOIN})?=){{0,{-size % 3}}}", text[m.end() :])[0])
    return None


def confirmed(run: str) -> tuple[int, int] | None:
    """(place in KINDS, length) of the key that a base64 run starts with; lines of other
    text may follow it in the run."""
    line = JOINED.split(run, maxsplit=1)[0]
    first = _base64(line, urlsafe=True)
    if first is not None and is_ssh_key(first):
        return 4, len(line)
    if first is not None and is_der_key(first):
        return 3, len(line)
    whole = NOT_DATA.sub("", run)
    data = _base64(whole[: len(whole) - (len(whole) % 4 == 1)], urlsafe=True) or b""
    for size, kind in ((der_size(data), 3), (ssh_container_size(data), 4)):
        end = None if size is None else _end_of(run, size)
        if end is not None:
            data = _base64(run[:end], urlsafe=True) or b""
            if kind == 4 and ssh_container_size(data) == len(data) or kind == 3 and is_der_key(data):
                return kind, end
    return None


def is_jwt(text: str) -> bool:
    head, body, _ = text.split(".")
    try:
        parsed = [json.loads(_base64(part, urlsafe=True) or b"") for part in (head, body)]
    except (ValueError, RecursionError):
        return False
    return all(isinstance(p, dict) for p in parsed) and isinstance(parsed[0].get("alg"), str)


def spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end), sorted."""
    if not text:
        return []
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for m in (m for pattern in BASE64 for m in pattern.finditer(text)):
        if found := confirmed(m[0]):
            out.append((m.start(), found[0], m.start() + found[1]))
    for m in HEX_KEY.finditer(text):
        if len(m[0]) % 2 == 0 and is_der_key(bytes.fromhex(m[0])):
            out.append((m.start(), 3, m.end()))
    out += [(m.start(), 5, m.end()) for m in JWT.finditer(text) if is_jwt(m[0])]
    return sorted(set(out))


def listed(found: list[tuple[int, int, int]]) -> str:
    """kind:start:end by start, then kind, comma-joined."""
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


def redacted(text: str | None, found: list[tuple[int, int, int]]) -> str | None:
    """The text with every stretch covered by spans replaced."""
    if not found:
        return text
    out, at, start, end = [], 0, found[0][0], found[0][2]
    for s, _, e in [*found[1:], (len(text) + 1, 0, 0)]:
        if s > end:
            out += [text[at:start], REPLACEMENT]
            at, start = end, s
        end = max(end, e) if s <= end else e
    return "".join([*out, text[at:]])


SCAN_FIELDS = [
    *[T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS],
    T.StructField("base_sha256", T.StringType()),
    T.StructField("spans", T.StringType()),
    T.StructField("redacted", T.StringType()),
]


def _scan():
    def run(texts: pa.Array) -> list[pa.Array]:
        rows = []
        for text in texts.to_pylist():
            found = spans(text)
            base = [x for x in found if x[1] < len(BASE_KINDS)]
            counts = [sum(x[1] == k for x in base) for k in range(len(BASE_KINDS))]
            rows.append([*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(found), redacted(text, found) if found else None])
        types = [pa.int64()] * len(BASE_KINDS) + [pa.string()] * 3
        return [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]

    return run


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` and n_assign, n_access, n_hex, base_sha256, spans and redacted (null where nothing was found)."""
    return add_columns(df, text, SCAN_FIELDS, _scan)


def redact(df: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``df`` with secrets replaced in the text, and its length where something was."""
    names = df.columns
    i, j = names.index(text), names.index(n_chars) if n_chars in names else None
    found = scan(df.toDF(*[f"c{k}" for k in range(len(names))]), f"c{i}")
    hit = F.col("redacted").isNotNull()
    cols = [F.col(f"c{k}") for k in range(len(names))]
    cols[i] = F.coalesce("redacted", f"c{i}")
    if j is not None:
        cols[j] = F.when(hit, F.char_length("redacted").cast(df.schema[j].dataType)).otherwise(F.col(f"c{j}"))
    return found.select(*[c.alias(n) for c, n in zip(cols, names, strict=True)])
