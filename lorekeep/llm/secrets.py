"""Secret scan with structural confirmation.

Base spans come from three patterns (assignments, access key ids, hex runs), matched from the left without overlap,
each kind by itself; a match that is too short is dropped, with the text it took. Then candidates for encoded keys
are decoded and parsed, and reported only if their structure holds to the last byte:

- ``jwt``: three dotted base64url parts whose header is a JSON object with a string ``alg``, whose payload is a JSON
  object and whose signature is there unless ``alg`` is ``none``;
- ``der``: base64 or hex of an ASN.1 key: every nested length fits its parent exactly, and the fields are those of
  an RSA, DSA, EC, PKCS#8 (plain or encrypted) or public key; a key inside PKCS#8 is no PKCS#8 itself;
- ``ssh``: base64 of an OpenSSH private key or public key blob whose length-prefixed strings fill it exactly, the keys
  inside being public ones;
- ``pem``: a BEGIN/END block with a key label whose body decodes to ``der`` or ``ssh``, or, under the header lines of an
  encrypted body, to whole cipher blocks.

Nesting is bounded by these rules, not by the depth of the input.

Texts go through in Arrow batches; a text is scanned whole, one at a time, so memory is that of a batch. Offsets are
code points, ends exclusive.

Defined results: a null text counts as empty and has no spans; ids may be null or repeat, each row has its own
result; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm import runtime

#: Fixed values of the contract: the base patterns, with the least lengths, in the listed order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_VALUE = 8
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # 16 or more with the prefix; a shorter run holds no longer one
HEX = re.compile(r"[0-9a-f]{32,}")
#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "jwt", "der", "ssh", "pem")

JWT = re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]{14,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}")
HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){24,}(?![0-9A-Fa-f])")
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*(?:PRIVATE|PUBLIC) KEY)-----((?:\s*[A-Z][A-Za-z-]{2,20}:[^\r\n]*)*)([A-Za-z0-9+/=\s]{16,}?)-----END \1-----")
ENCRYPTED = re.compile(r"Proc-Type: ?4,ENCRYPTED\s+DEK-Info: ?[A-Z0-9-]+,((?:[0-9A-Fa-f]{2}){8,16})\s*")
#: Bytes of the smallest cipher block.
BLOCK = 8
WORDS_OF_ASSIGN = ("password", "passwd", "secret", "token", "apikey", "api_key")

SCHEMA = "row_id long, spans array<struct<kind:string,start:int,end:int,detail:string>>"
SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("detail", pa.string())]))


def decode_base64(text: str) -> bytes | None:
    """Standard or url-safe, padded or not."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


def der_items(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values that fill data[at:end] exactly, by definite and minimal lengths; else None."""
    out = []
    while at < end:
        if at + 2 > end:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end or data[at] == 0:
                return None
            size = int.from_bytes(data[at : at + n], "big")
            if size < 0x80:
                return None
            at += n
        if at + size > end:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


INTEGER, BITS, OCTETS, NULL, OID, SEQUENCE = 0x02, 0x03, 0x04, 0x05, 0x06, 0x30


def parse_der(data: bytes, inside: bool = False) -> str | None:
    """Names the key that the bytes encode, to the last one; ``inside``: of a PKCS#8 key."""
    top = der_items(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != SEQUENCE:
        return None
    items = der_items(data, *top[0][1:])
    if not items or any(a == b for tag, a, b in items if tag in (INTEGER, OID, BITS, OCTETS)):
        return None
    tags = [tag for tag, _, _ in items]
    small = data[items[0][1] : items[0][2]] if tags[0] == INTEGER else None
    if small == b"\x00" and len(tags) == 9 and set(tags) == {INTEGER} and items[1][2] - items[1][1] >= 32:
        return "rsa_private"
    if small == b"\x01" and tags[1:2] == [OCTETS] and all(t in (0xA0, 0xA1) for t in tags[2:]) and items[1][2] - items[1][1] in (28, 32, 48, 66):
        return "ec_private"
    if small == b"\x00" and tags == [INTEGER] * 6 and items[1][2] - items[1][1] >= 64:
        return "dsa_private"
    if inside:
        return None
    if small in (b"\x00", b"\x01") and tags[1:3] == [SEQUENCE, OCTETS] and all(t in (0xA0, 0xA1, 0x81) for t in tags[3:]):
        algorithm = der_items(data, *items[1][1:])
        inner = data[items[2][1] : items[2][2]]
        nested = parse_der(inner, True) or (der_items(inner, 0, len(inner)) and inner[0] in (OCTETS, INTEGER))
        return "pkcs8_private" if algorithm and algorithm[0][0] == OID and nested else None
    if tags == [SEQUENCE, OCTETS] and items[1][2] - items[1][1] >= 2 * BLOCK:
        algorithm = der_items(data, *items[0][1:])
        return "pkcs8_encrypted" if algorithm and [tag for tag, _, _ in algorithm] == [OID, SEQUENCE] else None
    if tags == [SEQUENCE, BITS]:
        algorithm = der_items(data, *items[0][1:])
        return "public" if algorithm and algorithm[0][0] == OID and data[items[1][1]] == 0 else None
    if tags == [INTEGER, INTEGER] and items[0][2] - items[0][1] >= 64:
        return "rsa_public"
    return None


def _strings(data: bytes, at: int, count: int | None = None) -> tuple[list[bytes], int] | None:
    """Length-prefixed strings from ``at``: ``count`` of them, or all up to the end."""
    out = []
    while at < len(data) if count is None else len(out) < count:
        if at + 4 > len(data):
            return None
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        out.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return out, at


SSH_MAGIC = b"openssh-key-v1\0"
#: Key types of the SSH protocol and how many strings follow the type.
SSH_TYPES = {b"ssh-rsa": 2, b"ssh-dss": 4, b"ssh-ed25519": 1, b"ecdsa-sha2-nistp256": 2, b"ecdsa-sha2-nistp384": 2, b"ecdsa-sha2-nistp521": 2}


def parse_ssh(data: bytes) -> str | None:
    if data.startswith(SSH_MAGIC):
        head = _strings(data, len(SSH_MAGIC), 3)
        if head is None or head[1] + 4 > len(data):
            return None
        keys = int.from_bytes(data[head[1] : head[1] + 4], "big")
        body = _strings(data, head[1] + 4, keys + 1) if 1 <= keys <= 16 else None
        return "openssh_private" if body and body[1] == len(data) and all(map(parse_public, body[0][:-1])) else None
    return parse_public(data)


def parse_public(data: bytes) -> str | None:
    if data[:4] not in (b"\0\0\0\x07", b"\0\0\0\x0b", b"\0\0\0\x13"):
        return None
    parts = _strings(data, 0)
    if parts and len(parts[0]) - 1 == SSH_TYPES.get(parts[0][0], -1) and all(parts[0]):
        return parts[0][0].decode()
    return None


def parse_jwt(token: str) -> str | None:
    head, payload, signature = token.split(".")
    if not (decode_base64(head[: len(head) // 4 * 4]) or b"").lstrip().startswith(b"{"):
        return None
    try:
        a, b = (json.loads(decode_base64(x) or b"") for x in (head, payload))
    except (ValueError, RecursionError):
        return None
    if not isinstance(a, dict) or not isinstance(b, dict) or not isinstance(a.get("alg"), str):
        return None
    sealed = decode_base64(signature) if signature else b""
    # Names of algorithms are printable ASCII; JSON can also spell half a character, which is no text at all.
    if sealed is None or not (a["alg"].isascii() and a["alg"].isprintable()) or (a["alg"].lower() != "none" and len(sealed) < 16):
        return None
    return a["alg"]


def parse_pem(headers: str, body: str) -> str | None:
    data = decode_base64("".join(body.split()))
    if data is None:
        return None
    if headers and ENCRYPTED.fullmatch(headers.strip()):
        return "encrypted" if len(data) % BLOCK == 0 else None
    return parse_der(data) or parse_ssh(data)


def base_spans(text: str) -> list[tuple[str, int, int, str | None]]:
    out = []
    low = text.lower()
    if any(w in low for w in WORDS_OF_ASSIGN):
        out += [("assign", *m.span(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        out += [("access", *m.span(), None) for m in ACCESS.finditer(text)]
    if longest(text) >= 32:
        out += [("hex", *m.span(), None) for m in HEX.finditer(text)]
    return out


def longest(text: str) -> int:
    """The longest run without white space: no single-line key is longer."""
    return max(map(len, text.split()), default=0)


def confirmed_spans(text: str) -> list[tuple[str, int, int, str | None]]:
    """Candidates whose decoded bytes have the structure of a key or a signed token."""
    out = []
    if longest(text) >= 32:
        if "." in text:
            out += [("jwt", *m.span(), found) for m in JWT.finditer(text) if (found := parse_jwt(m[0]))]
        for m in BASE64.finditer(text):
            data = decode_base64(m[0])
            if data is None:
                continue
            if found := parse_der(data):
                out.append(("der", *m.span(), found))
            elif found := parse_ssh(data):
                out.append(("ssh", *m.span(), found))
        taken = {(a, b) for _, a, b, _ in out}
        for m in HEX_KEY.finditer(text):
            data = binascii.unhexlify(m[0])
            if m.span() not in taken and (found := parse_der(data) or parse_ssh(data)):
                out.append(("ssh" if data[:1] != b"\x30" else "der", *m.span(), found))
    if "-----BEGIN " in text:
        out += [("pem", *m.span(), found) for m in PEM.finditer(text) if (found := parse_pem(m[2], m[3]))]
    return out


RANK = {kind: n for n, kind in enumerate(KINDS)}


def spans_of(text: str | None) -> list[tuple[str, int, int, str | None]]:
    """All spans by start, then kind as listed."""
    body = text or ""
    return sorted(base_spans(body) + confirmed_spans(body), key=lambda x: (x[1], RANK[x[0]], x[2]))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns (row_id, spans) with the typed spans of each row's text."""
    runtime.ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end", "detail"), s, strict=True)) for s in spans_of(x.as_py())] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, SPAN)], names=["row_id", "spans"])

    return df.selectExpr(f"CAST(`{id_col}` AS long) AS row_id", f"CAST(`{text_col}` AS string) AS body").mapInArrow(run, SCHEMA)


def digest_columns(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and the number of confirmed spans."""
    name = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda *kinds: F.size(F.filter("spans", lambda s: s["kind"].isin(*kinds))).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    return found.select(
        F.col("row_id").alias("doc_id"),
        *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(F.array_join(F.transform(base, name), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", name), ",").alias("spans"),
        count(*KINDS[3:]).alias("n_confirmed"),
    )
