"""Secrets in texts and in what is encoded in them."""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import html
import lzma
import re
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order that ties at one start are listed in; the first three are the base.
KINDS = ("assign", "access", "hex", "jwt", "pem", "forge")
#: Characters that blobs may unfold to beside the text. It only guards against nested inflation bombs: a blob whose
#: layers go beyond it is reported as unread and masked as a whole.
MOST_DECODED = 1 << 32
#: Levels of escapes that are undone and scanned one by one; all deeper ones are undone in one step.
LEVELS = 16
#: Bytes of a layer that are held at once, and characters that two windows of a longer one have in common.
WINDOW, OVERLAP = 1 << 24, 1 << 20
#: Bytes that are inflated at a time.
PIECE = 1 << 20

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++){2,}+")
_JWT_HEAD = re.compile(r"(?:^|(?<=-))eyJ[A-Za-z0-9_-]{8}")
_GAP = r"(?:\s|\\[nr])*+"
_PEM_MARK = r"[A-Z ]{0,30}PRIVATE KEY-----"
#: A key up to its end mark; without one, the lines after its first mark that a key is made of.
_PEM = re.compile(rf"-----BEGIN {_PEM_MARK}(?:[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+-----END {_PEM_MARK}|(?:(?:{_GAP}(?:(?:Proc-Type|DEK-Info):[^\n\\]*+|[A-Za-z0-9+/=]{{16,}}+))++(?:{_GAP}[A-Za-z0-9+/]++(?:=|(?=\s*\Z))=?)?)?)")
_FORGE = re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|glpat-[A-Za-z0-9_-]{20,})", re.ASCII)
_ESCAPE = re.compile(r"(?:%[0-9A-Fa-f]{2})+|\\u\{[0-9A-Fa-f]{1,6}\}|(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#x[0-9A-Fa-f]{1,6};")
#: The escapes that end where the reading stands: a byte of a longer character, or half of a pair, counts with those before it.
_LAST = re.compile(r"(?:(?:%[0-9A-Fa-f]{2}){1,4}|\\u\{[0-9A-Fa-f]{1,6}\}|(?:\\u[0-9A-Fa-f]{4}){1,2}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#x[0-9A-Fa-f]{1,6};)\Z")
_LONGEST = 12
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_MARKS = ("%", "\\u", "\\U", "\\x", "&#")


class Places:
    """Where a layer's characters stand in the text, by runs: copied ones shift, others stand for a range as a whole."""

    def __init__(self, runs: list[tuple[int, int, int, bool]]) -> None:
        self.runs = runs
        self.starts = [r[0] for r in runs]

    def back(self, lo: int, hi: int) -> tuple[int, int]:
        """The range of the text that a range of the layer came from."""
        at, first, last, copied = self.runs[max(0, bisect_right(self.starts, lo) - 1)]
        begin = first + lo - at if copied else first
        at, first, last, copied = self.runs[max(0, bisect_right(self.starts, max(lo, hi - 1)) - 1)]
        return begin, max(begin, first + hi - at if copied else last)

    def parts(self, size: int) -> Iterator[tuple[int, int, int, int, bool]]:
        """Each run's bounds in a layer of ``size`` characters, its range in the text and whether it is copied."""
        for k, (at, lo, hi, copied) in enumerate(self.runs):
            yield at, self.runs[k + 1][0] if k + 1 < len(self.runs) else size, lo, hi, copied


def _plain(text: str) -> Iterator[tuple[str, int, int]]:
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or ("api" in low and "key" in low):
        for m in _ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 6:
                yield "assign", *m.span()
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if m.end() - m.start() >= 20:
                yield "access", *m.span()
    for m in _HEX.finditer(text):
        yield "hex", *m.span()
    if "eyJ" in text:
        yield from _jwts(text)
    for kind, mark, rule in (("pem", "-----BEGIN ", _PEM), ("forge", "gh", _FORGE), ("forge", "xox", _FORGE), ("forge", "glpat-", _FORGE)):
        if mark in text:
            for m in rule.finditer(text):
                yield kind, *m.span()


def _jwts(text: str) -> Iterator[tuple[str, int, int]]:
    """Three parts with dots between them, the first from an `eyJ` on that begins a word; each part is read once."""
    for m in _DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        starts = [at, *(at := at + len(x) + 1 for x in parts[:-1])]
        k = 0
        while k + 2 < len(parts):
            head = _JWT_HEAD.search(parts[k]) if len(parts[k + 1]) >= 8 and len(parts[k + 2]) >= 8 else None
            if head:
                yield "jwt", starts[k] + head.start(), starts[k + 2] + len(parts[k + 2])
            k += 3 if head else 1


def _decoded(said: str) -> str | None:
    """What a run of escapes of one sort stands for; None if nothing."""
    try:
        if said[0] == "%":
            return bytes.fromhex(said.replace("%", "")).decode()
        if said[0] == "&":
            return html.unescape(said)
        if said.startswith("\\u{"):
            return chr(int(said[3:-1], 16))
        if said.startswith("\\u"):
            return b"".join(int(x, 16).to_bytes(2, "big") for x in said.split("\\u")[1:]).decode("utf-16-be")
        return chr(int(said[2:], 16))
    except (ValueError, OverflowError):
        return None


def _level(text: str, places: Places) -> tuple[str, Places] | None:
    """The text with one level of its escapes undone, and where it came from; None if nothing changes."""
    pieces, runs, size, at, old = [], [], 0, 0, places.parts(len(text))
    part = next(old)

    def copy(upto: int) -> None:
        nonlocal part, at, size
        while at < upto:
            while part[1] <= at:
                part = next(old)
            begin, stop, lo, hi, copied = part
            end = min(stop, upto)
            runs.append((size, lo + at - begin, lo + end - begin, True) if copied else (size, lo, hi, False))
            size += end - at
            at = end

    for m in _ESCAPE.finditer(text):
        new = _decoded(m[0])
        if new is None or new == m[0]:
            continue
        pieces += [text[at : m.start()], new]
        copy(m.start())
        runs.append((size, *places.back(*m.span()), False))
        size += len(new)
        at = m.end()
    if not pieces:
        return None
    pieces.append(text[at:])
    copy(len(text))
    return "".join(pieces), Places(runs or [(0, 0, 0, False)])


def _ending(said: str) -> Iterator[str]:
    """The escapes at the end of a run of them, the shortest first."""
    size = 3 if said[0] == "%" else 6 if said.startswith("\\u") and said[2] != "{" else len(said)
    return (said[-k:] for k in range(size, len(said) + 1, size))


def _every_level(text: str, places: Places) -> tuple[str, Places]:
    """The text with all levels of its escapes undone: as soon as what was read ends in an escape, it becomes what it
    stands for, which may end the escape around it. Each character is read once, and each step makes the text shorter.
    """
    out: list[tuple[str, int, int]] = []
    for begin, stop, lo, hi, copied in places.parts(len(text)):
        for k in range(begin, stop):
            out.append((text[k], lo + k - begin, lo + k - begin + 1) if copied else (text[k], lo, hi))
            while out and out[-1][0] in "0123456789abcdefABCDEF};":
                m = _LAST.search("".join(x[0] for x in out[-_LONGEST:]))
                told = next(((e, c) for e in _ending(m[0]) if (c := _decoded(e)) not in (None, e)), None) if m else None
                if told is None:
                    break
                escape, new = told
                first, last = out[-len(escape)][1], out[-1][2]
                del out[-len(escape) :]
                out += [(c, first, last) for c in new]
    return "".join(x[0] for x in out), Places([(k, lo, hi, False) for k, (_, lo, hi) in enumerate(out)] or [(0, 0, 0, False)])


def _decoder(raw: bytes):
    """A decompressor for the gzip, zlib, bzip2 or xz stream that the bytes begin with; None for anything else."""
    if raw[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if raw[:1] == b"\x78" and len(raw) > 1 and (raw[0] << 8 | raw[1]) % 31 == 0:
        return zlib.decompressobj()
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if raw[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


def _inflated(raw: bytes) -> Iterator[bytes | None]:
    """The content of all streams that the bytes begin with, one after another, in pieces; nothing for anything else.

    None at the end tells that a stream broke off.
    """
    while (one := _decoder(raw)) is not None:
        feed = raw
        try:
            while True:
                part = one.decompress(feed, PIECE)
                if part:
                    yield part
                feed = getattr(one, "unconsumed_tail", b"")
                if one.eof or not (part or feed):
                    break
        except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
            yield None
            return
        if not one.eof:
            yield None
            return
        raw = one.unused_data


def _readable(text: str) -> bool:
    odd = sum(not (c.isprintable() or c in "\t\n\r") for c in text)
    return bool(text) and odd * 20 <= len(text)


def _unpacked(blob: str) -> Iterator[str | None]:
    """The text in a base64 blob, also through compressed streams in it; None tells that part of it can't be read.

    Content of more than ``WINDOW`` bytes comes in windows that overlap by ``OVERLAP`` characters.
    """
    bare = blob.rstrip("=").replace("-", "+").replace("_", "/")
    if len(bare) % 4 == 1:
        return
    try:
        raw = base64.b64decode(bare + "=" * (-len(bare) % 4))
    except (binascii.Error, ValueError):
        return
    seen: set[bytes] = set()
    broken = False
    while True:
        pieces, size, rest = [], 0, _inflated(raw)
        for piece in rest:
            broken |= piece is None and bool(pieces)
            pieces.append(piece or b"")
            size += len(piece or b"")
            if size > WINDOW:
                break
        if size > WINDOW:
            break
        inner = b"".join(pieces)
        if not inner or inner in seen:
            try:
                text = raw.decode(errors="ignore" if broken else "strict")
            except UnicodeDecodeError:
                return
            if _readable(text):
                yield text
                if broken:
                    yield None
            return
        seen.add(inner)
        raw = inner
    decode, held = codecs.getincrementaldecoder("utf-8")(), ""
    try:
        for piece in chain(pieces, rest):
            if piece is None:
                yield None
                break
            held += decode.decode(piece)
            if len(held) >= WINDOW:
                yield held if _readable(held) else None
                held = held[-OVERLAP:]
    except UnicodeDecodeError:
        yield None
    if held:
        yield held if _readable(held) else None


def _mark(layer: str, place: tuple[int, int]) -> tuple[bytes, tuple[int, int]]:
    return hashlib.sha256(layer.encode("utf-8", "surrogatepass")).digest(), place


def unfold(text: str, most: int = MOST_DECODED) -> tuple[list[tuple[str, int, int, int]], list[tuple[int, int]]]:
    """Secrets as ``(kind, start, end, depth)`` by start, then kind, and the places whose layers weren't read to the end.

    A worklist of layers, the text first: each layer is scanned, its escapes and blobs give new layers, and a layer
    whose content was met before at the same place isn't entered again. No kind's pattern holds an escape, so undoing
    all escapes at once loses none. ``LEVELS`` levels of escapes are layers each; what is nested deeper is undone in
    one step, so the work follows the text's length. Spans are mapped back to the text; a span in a blob covers the
    whole blob. Long layers are unfolded and scanned window by window.
    """
    found: dict[tuple[str, int, int], int] = {}
    unread: set[tuple[int, int]] = set()
    work: deque[tuple[Iterator[str | None], Places, int, int]] = deque([(iter([text]), Places([(0, 0, len(text), True)]), 0, 0)])
    seen: set[tuple[bytes, tuple[int, int]]] = set()
    left = most
    while work:
        windows, places, depth, level = work.popleft()
        layer = next(windows, "")
        if layer == "":
            continue
        cost = len(layer or "") if depth and not level else 0
        if layer is None or left < cost:
            unread.add(places.back(0, 0))
            continue
        work.append((windows, places, depth, level))
        mark = _mark(layer, places.back(0, len(layer)))
        if mark in seen:
            continue
        seen.add(mark)
        left -= cost
        for kind, lo, hi in _plain(layer):
            place = (kind, *places.back(lo, hi))
            found[place] = min(depth, found.get(place, depth))
        if any(x in layer for x in _MARKS):
            if level < LEVELS:
                made = _level(layer, places)
            else:
                made = _every_level(layer, places) if level == LEVELS else None
            if made:
                work.append((iter([made[0]]), made[1], depth + 1, level + 1))
        for m in _BASE64.finditer(layer):
            whole = Places([(0, *places.back(*m.span()), False)])
            work.append((_unpacked(m[0]), whole, depth + 1, 0))
    spans = sorted(((*span, depth) for span, depth in found.items()), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return spans, sorted(unread)


def find(text: str, most: int = MOST_DECODED) -> tuple[list[tuple[str, int, int, int]], bool]:
    """The secrets of :func:`unfold` and whether every layer was read to its end."""
    spans, unread = unfold(text, most)
    return spans, not unread


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, spans, complete`` for each row: ``spans array<struct<kind,start,end,depth>>`` in code points.

    Depth 0 spans stand in the text itself, deeper ones in what was unwrapped from it. Whole texts are read. Null
    texts are empty, repeated rows are judged alike, an empty table gives no rows.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("depth", pa.int64())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [find(text.as_py() or "") for text in batch.column(1)]
            spans = pa.array([[dict(zip(("kind", "start", "end", "depth"), s, strict=True)) for s in found] for found, _ in told], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), spans, pa.array([c for _, c in told], pa.bool_())], ["doc_id", "spans", "complete"])

    return docs.select("doc_id", "text").mapInArrow(each, "doc_id long, spans array<struct<kind:string,start:long,end:long,depth:long>>, complete boolean")


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """The documents with every secret's span (overlapping ones as one) replaced by ``mask`` in ``text``.

    A blob whose layers could not be read to the end is masked too. Other columns and all rows stay, null texts stay null; ``n_chars``, where there is one, is set anew.
    """

    def clean(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            if text is not None:
                at, pieces = 0, []
                spans, unread = unfold(text)
                for lo, hi in sorted([*((lo, hi) for _, lo, hi, _ in spans), *unread]):
                    if hi <= at:
                        continue
                    if lo >= at:
                        pieces += [text[at:lo], mask]
                    at = hi
                text = "".join([*pieces, text[at:]]) if pieces else text
            out.append(text)
        return pd.Series(out, dtype=object)

    out = docs.select(*[(F.pandas_udf(clean, "string")(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`")) for c in docs.columns])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
