"""Secret scan with a recursive decoding worklist.

The text is the first layer. Each layer is scanned for the base kinds; then its percent escapes, its Unicode escapes
and character references, and each of its base64 runs (inflated if zlib or gzip) are unwrapped into further layers,
which join the worklist unless a layer of the same content and place was met before (cycle detection). Work ends at
the fixpoint: when no layer yields another. Each layer carries, for every character, the span of the original text it
came from, so a match at any depth is reported as a span of the original.

Base64 is read in either alphabet, across line breaks, and from any place of a run: plain content at all four phases,
compressed content from wherever its first bytes are. What it holds is read byte for byte (Latin-1), as every kind and
escape is ASCII. Compressed content is inflated through all its members and whatever follows them, in pieces of about
PIECE characters that are scanned one after another, so a bomb costs time and not memory; a piece never ends within a
word, wrapped base64 or an assignment, which are held whole.

Base kinds, leftmost and non-overlapping within a kind, are found in the first layer as they stand; decoded layers
only add spans. A clean text pays three searches.

Null or empty text: no spans. Repeated rows: each alike. Empty table: no rows. Extra columns: kept by redact() and not
read by scan().
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # a run of 16 or more is a run whose length passes
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
_BREAK = r"[ \t]*+(?:\r?\n|(?:\\r)?\\n)[ \t>]*+"
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{22,}={0,2}")
_WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{{4,}}+{_BREAK})+[A-Za-z0-9+/_-]++={{0,2}}")
_BREAKS = re.compile(_BREAK)
_ALPHABETS = re.compile(r"[A-Za-z0-9+/]{22,}={0,2}"), re.compile(r"[A-Za-z0-9_-]{22,}={0,2}")
_LINE64 = re.compile(r"[A-Za-z0-9+/_=-]+").fullmatch
#: Base64 of the first bytes of gzip, and of zlib at its usual levels.
_PACKED = re.compile(r"H4sI|eA[E-H]|eF[4-7]|eJ[w-z]|eN[o-r]")
PIECE, FEED = 1 << 20, 1 << 16
OUT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

Span = tuple[int, int, int]  # start, end, place of the kind in KINDS


def base_spans(text: str) -> list[Span]:
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return out


class Layer:
    """A text and, for each of its characters, the span of the original it stands for (None: the same place)."""

    def __init__(self, text: str, starts: np.ndarray | None = None, ends: np.ndarray | None = None):
        self.text, self.starts, self.ends = text, starts, ends

    def origin(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.starts is None else (int(self.starts[a:b].min()), int(self.ends[a:b].max()))

    def replaced(self, pattern: re.Pattern, decode) -> Layer | None:
        """This layer with each match decoded, or None if nothing changes."""
        text, parts, lows, highs, at, changed = self.text, [], [], [], 0, False
        starts = np.arange(len(text)) if self.starts is None else self.starts
        ends = np.arange(1, len(text) + 1) if self.ends is None else self.ends
        for m in pattern.finditer(text):
            got = decode(m)
            if got is None or got == m[0]:
                continue
            changed = True
            parts += [text[at : m.start()], got]
            a, b = self.origin(*m.span())
            lows += [starts[at : m.start()], np.full(len(got), a)]
            highs += [ends[at : m.start()], np.full(len(got), b)]
            if len(got) * 3 == len(m[0]) and m[0][0] == "%":  # one character for each escape
                k = np.arange(m.start(), m.end(), 3)
                lows[-1], highs[-1] = starts[k], ends[k + 2]
            at = m.end()
        if not changed:
            return None
        return Layer("".join([*parts, text[at:]]), np.concatenate([*lows, starts[at:]]), np.concatenate([*highs, ends[at:]]))


def _percent(m: re.Match) -> str:
    return bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace")


def _escape(m: re.Match) -> str | None:
    code = int(m[6]) if m[6] else int(next(g for g in m.groups()[:5] if g), 16)
    return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def _magic(raw: bytes) -> int:
    return 31 if raw.startswith(b"\x1f\x8b") else 15 if raw[:2] in (b"x\x01", b"x\x5e", b"x\x9c", b"x\xda") else 0


def _fed(d, data: bytes) -> Iterator[bytes]:
    """The pieces that come of data."""
    while not d.eof:
        out = d.decompress(data, FEED)
        data = d.unconsumed_tail
        if out:
            yield out
        if not data and len(out) < FEED:
            return


def _members(chunks: Iterator[bytes], rest: bool) -> Iterator[bytes]:
    """One level of inflating: all members and, if asked for, as it is what follows them or can't be inflated."""
    d, head = None, b""
    for chunk in chunks:
        data = head + chunk
        head = b""
        while data:
            if d is None:
                if len(data) < 2 and data in (b"\x1f", b"x"):
                    head = data
                    break
                if not (wbits := _magic(data)):
                    if rest:
                        yield data
                        yield from chunks
                    return
                d = zlib.decompressobj(wbits)
            before = d.copy()
            try:
                yield from _fed(d, data)
            except zlib.error:
                # what came before the fault, byte by byte, and the rest as it is
                for k in range(len(data)):
                    try:
                        yield from _fed(before, data[k : k + 1])
                    except zlib.error:
                        break
                if rest:
                    yield data
                    yield from chunks
                return
            data, d = (d.unused_data, None) if d.eof else (b"", d)
    if head and rest:
        yield head


def inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Compressed bytes inflated as often as they are compressed, in pieces; what reproduces itself is inflated once.
    What is not compressed at the outermost level is left out: it has been read as it is."""
    met: set = set()
    while True:
        first = b""
        for chunk in chunks:
            first += chunk
            if len(first) >= 2:
                break
        mark = hashlib.sha1(first).digest()
        chunks = itertools.chain([first], chunks)
        if not _magic(first) or mark in met:
            return chunks
        met.add(mark)
        chunks = _members(chunks, bool(met - {mark}))


def _texts(chunks: Iterator[bytes], piece: int) -> Iterator[str]:
    """The bytes as texts of about a piece. None ends within a word, lines of base64, or before what is assigned."""
    held, parts, size = "", [], 0
    for chunk in chunks:
        parts.append(chunk.decode("latin-1"))
        size += len(chunk)
        if size < max(piece, len(held)):
            continue
        text = held + "".join(parts)
        parts, size = [], 0
        cut = max(text.rfind(c) for c in " \t\r\n\0") + 1
        while cut and _LINE64(text[(before := text.rfind("\n", 0, cut - 1) + 1) : cut].strip() or " "):
            cut = before
        cut = max(0, len(text[:cut].rstrip(" :=\"'")) - 64)
        if cut:
            yield text[: max(cut + 64, 1)]
        held = text[cut:]
    if held or parts:
        yield held + "".join(parts)


def unwrap64(run: str, piece: int = PIECE) -> Iterator[tuple[int, str]]:
    """Texts that a base64 run may hold, each with the place in the run where it begins."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    decoded = lambda part: base64.b64decode(part[: len(part) - (len(part) % 4 == 1)] + "=" * (-len(part) % 4 % 3))
    for k in range(4):
        yield 0, decoded(body[k:]).decode("latin-1")
    for m in _PACKED.finditer(body):
        chunks = (decoded(body[k : k + FEED]) for k in range(m.start(), len(body), FEED))
        for text in _texts(inflated(chunks), piece):
            yield m.start(), text


def _runs(text: str) -> Iterator[tuple[str, np.ndarray | int]]:
    """The base64 runs of a text, with the place of their first character, or, if wrapped, of each character."""
    for m in _BASE64.finditer(text):
        run, at = m[0], m.start()
        parts = {x.span() for alphabet in _ALPHABETS for x in alphabet.finditer(run)} | {(0, len(run))}
        yield from ((run[a:b], at + a) for a, b in sorted(parts))
    for m in _WRAPPED.finditer(text):
        breaks = [x.span() for x in _BREAKS.finditer(m[0])]
        keep = np.ones(len(m[0]), bool)
        for a, b in breaks:
            keep[a:b] = False
        run, at = "".join(itertools.compress(m[0], keep)), np.flatnonzero(keep) + m.start()
        if len(run) < 22:
            continue
        parts = {x.span() for alphabet in _ALPHABETS for x in alphabet.finditer(run)} | {(0, len(run))}
        yield from ((run[a:b], at[a:b]) for a, b in sorted(parts))


def _unwrapped(layer: Layer, run: str, at: np.ndarray | int, piece: int) -> Iterator[Layer]:
    for k, inner in unwrap64(run, piece):
        a, b = layer.origin(*((at + k, at + len(run)) if isinstance(at, int) else (int(at[k]), int(at[-1]) + 1)))
        yield Layer(inner, np.broadcast_to(np.int64(a), len(inner)), np.broadcast_to(np.int64(b), len(inner)))


def _inner(layer: Layer, piece: int) -> Iterator[Layer]:
    for run, at in _runs(layer.text):
        yield from _unwrapped(layer, run, at, piece)


def find(text: str | None, piece: int = PIECE) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: both sorted by start, then kind."""
    if not text:
        return [], []
    base = base_spans(text)
    work, seen, found = [iter([Layer(text)])], set(), set(base)
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if layer.starts is not None:
            mark = (hashlib.sha1(layer.text.encode("utf-8", "replace")).digest(), int(layer.starts.min(initial=0)), int(layer.ends.max(initial=0)))
            if mark in seen:
                continue
            seen.add(mark)
            found.update((*layer.origin(a, b), k) for a, b, k in base_spans(layer.text))
        if "%" in layer.text and (child := layer.replaced(_PERCENT, _percent)):
            work.append(iter([child]))
        if ("\\" in layer.text or "&#" in layer.text) and (child := layer.replaced(_UNICODE, _escape)):
            work.append(iter([child]))
        work.append(_inner(layer, piece))
    order = lambda s: (s[0], s[2], s[1])
    return sorted(base, key=order), sorted(found, key=order)


def told(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, and all spans as kind:start:end by start, then kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts: list[list[int]] = [[], [], []]
            digests, spans = [], []
            for text in batch.column("text").to_pylist():
                base, every = find(text)
                for k in range(3):
                    counts[k].append(sum(s[2] == k for s in base))
                digests.append(hashlib.sha256(told(base).encode()).hexdigest())
                spans.append(told(every))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=[c.split()[0] for c in OUT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, OUT)


def redacted(text: str | None, mark: str = "[secret]") -> str | None:
    """The text with every span, overlapping ones together, replaced by the mark."""
    _, spans = find(text)
    if not spans:
        return text
    out, at = [], 0
    reach = -1
    for a, b, _ in sorted(spans):
        if a < reach:
            reach = max(reach, b)
        else:
            if reach >= 0:
                at = reach
            out += [text[at:a], mark]
            reach = b
    return "".join([*out, text[reach:]])


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with secrets in text replaced, and n_chars (if there) counted anew. All rows and other columns stay."""
    columns, kinds = docs.columns, dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = [redacted(t, mark) for t in batch.column("text").to_pylist()]
            at = batch.schema.get_field_index("text")
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield batch

    out = docs.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in columns))
    return out.withColumn("n_chars", F.length("text").cast(kinds["n_chars"])) if "n_chars" in columns else out
