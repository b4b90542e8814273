"""Secret scan (operator 3): keyword prefilter, anchored expressions near hits, embedded checksums.

One Aho-Corasick pass over the lower-cased text finds every place where a keyword starts. Only there an
anchored regular expression is tried on the original text. Hex runs have no keyword: a run of 24
characters always covers three neighbours of a stride of 8, so a vectorised test of every eighth
character takes the keyword's place. Tokens that carry their own checksum are kept only if it holds.
The scan is a narrow map over the documents: no shuffle, whole texts, one pass.

Defined results: a null text counts as empty; a document without a secret has an empty span list;
repeated rows give repeated rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from .common import in_small_batches

#: The three base kinds in their listed order; the kinds with a checksum follow.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "checked", "xkey")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "checked": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"),
    "xkey": ("xprv",),
}
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
XKEY = re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![0-9A-Za-z])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX, STRIDE = 6, 20, 24, 8

SPANS_TYPE = ArrayType(StructType().add("kind", StringType()).add("start", IntegerType()).add("end", IntegerType()))
_IS_HEX = np.zeros(129, bool)
_IS_HEX[[ord(c) for c in "0123456789abcdef"]] = True
_LOWER = {c: c + 32 for c in range(65, 91)}


def _build() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


_AUTOMATON = _build()


def crc_holds(body: str, check: str) -> bool:
    """The last six base-62 digits are the CRC-32 of the thirty characters before them."""
    value = 0
    for c in check:
        value = value * 62 + BASE62.index(c)
    return value == zlib.crc32(body.encode("ascii"))


def base58_holds(text: str) -> bool:
    """Base58Check: the last four bytes are the head of the doubled SHA-256 of the rest."""
    value = 0
    for c in text:
        value = value * 58 + BASE58.index(c)
    raw = value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big")
    return len(raw) == 82 and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def _codes(text: str) -> np.ndarray:
    """One number per code point, those beyond ASCII as 128."""
    if text.isascii():
        return np.frombuffer(text.encode("ascii"), np.uint8)
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128)


def _hex_spans(text: str) -> list[tuple[int, int]]:
    if len(text) < MIN_HEX:
        return []
    near = _IS_HEX[_codes(text)[::STRIDE]]
    hits = np.flatnonzero(near[:-1] & near[1:]) * STRIDE if len(near) > 1 else ()
    out, last = [], 0
    for at in hits:
        if at < last:
            continue
        start = int(at)
        while start > 0 and text[start - 1] in "0123456789abcdef":
            start -= 1
        last = HEX.match(text, start).end()
        if last - start >= MIN_HEX:
            out.append((start, last))
    return out


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start, then kind as listed."""
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):
        low = text.translate(_LOWER)
    starts: dict[str, list[int]] = {}
    for end, (kind, n) in _AUTOMATON.iter(low):
        starts.setdefault(kind, []).append(end - n + 1)
    out = [("hex", a, b) for a, b in _hex_spans(text)]
    for kind, rule, keep in (
        ("assign", ASSIGN, lambda m: len(m[1]) >= MIN_ASSIGN),
        ("access", ACCESS, lambda m: m.end() - m.start() >= MIN_ACCESS),
        ("checked", CHECKED, lambda m: crc_holds(m[1], m[2])),
        ("xkey", XKEY, lambda m: base58_holds(m[0])),
    ):
        last = 0
        for at in sorted(starts.get(kind, ())):
            if at >= last and (m := rule.match(text, at)):
                last = m.end()
                if keep(m):
                    out.append((kind, at, last))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, the columns of ``keep`` and ``secret_spans`` of every row."""
    keep = [c for c in keep or [] if c != id_col]
    given = docs.select(F.col(id_col), *[F.col(c) for c in keep], F.col(text_col).alias("_scan"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end"), s)) for s in find_spans(t.as_py())] for t in batch.column("_scan")]
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(found, _TYPE)], [*names, "secret_spans"])

    kept = given.drop("_scan").schema
    return in_small_batches(given).mapInArrow(scan, kept.add("secret_spans", SPANS_TYPE))


def redact(text: str | None, spans, mask: str) -> str | None:
    """The text with every span replaced by the mask; overlapping spans get one mask."""
    if not text or not spans:
        return text
    out, last = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
        if s["start"] >= last:
            out += [text[last : s["start"]], mask]
        last = max(last, s["end"])
    return "".join([*out, text[last:]])


def redact_secrets(docs: DataFrame, text_col: str = "text", mask: str = "<secret>") -> DataFrame:
    """``docs`` with the secrets of its text column masked, columns and their order unchanged (null text stays null);
    ``n_chars``, where there is such a column of longs, counts the characters of a changed text anew."""
    schema = docs.schema
    counted = any(f.name == "n_chars" and f.dataType == LongType() for f in schema.fields)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at).to_pylist()
            new = [redact(t, [dict(zip(("kind", "start", "end"), s)) for s in find_spans(t)], mask) for t in texts]
            columns = [batch.column(i) for i in range(batch.num_columns)]
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if counted:
                n = batch.schema.get_field_index("n_chars")
                columns[n] = pa.array([c if a == b else len(b) for a, b, c in zip(texts, new, columns[n].to_pylist())], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return in_small_batches(docs).mapInArrow(scan, schema)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts and digests of the spans of each document."""
    found = scan_secrets(docs)
    s = F.col("secret_spans")
    count = lambda kind: F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(s, lambda x: x["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(s).alias("spans"))
