"""Secret scans through nested encodings.

A worklist starts with the whole text. Each layer is scanned for secrets and for encoded regions:
percent escapes, Unicode escapes, base64, and compressed bytes inside base64. What a region decodes
to becomes a layer of its own, until no layer yields another one; a layer whose content has been
seen is not opened again, which ends cycles. Every layer maps its characters to code points of the
document: percent and Unicode escapes character by character, base64 and compression to their whole
region, so what is found anywhere is reported where it stands in the text.

Percent escapes are resolved over the whole layer, and in each blank-free token too. Base64 may be broken
over lines, and may begin or end within a run of its alphabet ('key_...', a path): a run is read at the
alignment of its start and at those of every character behind a break, '/', '_', '-' or '+', and any
stretch of at least ``LEAST_TEXT`` characters of text in the bytes is a layer; so are UTF-16 bytes. Compressed
streams (zlib, gzip, bzip2, xz, Zstandard) are looked for at the same places, raw deflate at the start
of a run; all members of a stream are unpacked, and streams within streams.

Streams are unpacked piece by piece, and layers are opened one at a time, depth first. What unpacks to
more than ``WINDOW`` bytes is scanned in windows that overlap by ``OVERLAP``, so memory is bounded by the
depth of nesting, whatever a stream unpacks to. Only there, base64 of more than ``OVERLAP`` characters
that holds a compressed stream is read no further than its window.

Defined results. A null text counts as empty: zero counts, no spans. Repeated rows are scanned as
often as they occur; a very long text is scanned whole; an empty table gives an empty result; other columns
are not read. ``n_refused`` counts compressed streams that break off before their end; what came until
then is scanned. The same text at the same place is opened once.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

KINDS = ("assign", "access", "hex")
WINDOW = 16 << 20
OVERLAP = 64 << 10
_STEP = 1 << 20
LEAST_BASE64 = 16
#: The shortest secret, 'token:' and eight characters, has as many.
LEAST_TEXT = 14
# Fixed patterns of the three kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
_HINTS = ("passw", "secret", "token", "api")
_TOKEN = re.compile(r"[!-~]+")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})")
_STRETCH = re.compile("[^\x00-\x08\x0e-\x1f\x7f\udc80-\udcff]{%d,}" % LEAST_TEXT)
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
_BREAK = re.compile(r"[ \t]*\r?\n[ \t]*")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST_BASE64)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret in one layer: leftmost, non-overlapping in each kind."""
    found = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


class _Zstd:
    """Zstandard with the interface of the standard library's decompressors."""

    def __init__(self):
        import zstandard

        self._d, self._rest = zstandard.ZstdDecompressor(max_window_size=1 << 27).decompressobj(), b""

    def decompress(self, data: bytes, most: int) -> bytes:
        out, self._rest = b"", self._rest + data
        while self._rest and len(out) < most and not self._d.eof:
            out, self._rest = out + self._d.decompress(self._rest[:1_024]), self._rest[1_024:]
        return out

    eof = property(lambda self: self._d.eof)
    unused_data = property(lambda self: self._d.unused_data + self._rest)
    needs_input = property(lambda self: not self._rest)


def _zlib_header(head: bytes) -> bool:
    return len(head) > 2 and head[0] & 15 == 8 and head[0] >> 4 <= 7 and int.from_bytes(head[:2], "big") % 31 == 0


#: (what a stream begins with, its decompressor). A header of two bytes proves little: some of the stream must unpack.
_STREAMS: tuple[tuple[Callable[[bytes], bool], Callable], ...] = (
    (lambda h: h[:2] == b"\x1f\x8b", lambda: zlib.decompressobj(31)),
    (_zlib_header, lambda: zlib.decompressobj(15)),
    (lambda h: h[:3] == b"BZh" and h[4:10] == b"1AY&SY", bz2.BZ2Decompressor),
    (lambda h: h[:6] == b"\xfd7zXZ\0", lzma.LZMADecompressor),
    (lambda h: h[:4] == b"\x28\xb5\x2f\xfd", _Zstd),
)


def _errors() -> tuple[type[Exception], ...]:
    try:
        from zstandard import ZstdError
    except ImportError:
        return (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError, ImportError)
    return (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError, ZstdError)


_ERRORS = _errors()


def _stream_of(head: bytes) -> Callable | None:
    """The decompressor that unpacks something from ``head``."""
    for begins, make in _STREAMS:
        if begins(head):
            try:
                d = make()
                if d.decompress(head, 64) or d.eof or hasattr(d, "needs_input"):
                    return make
            except _ERRORS:
                pass
    return None


def _deflated(data: bytes) -> bool:
    """Whether bytes without a header are a raw deflate stream of text."""
    d = zlib.decompressobj(-15)
    try:
        out = d.decompress(data, 4_096)
    except zlib.error:
        return False
    if len(out) < LEAST_TEXT or not (d.eof and not d.unused_data or len(out) == 4_096):
        return False
    return sum(b < 32 and b not in b"\t\n\r" or b > 126 for b in out) * 4 < len(out)


def _inflate(chunks: Iterator[bytes], make: Callable, broken: list[int]) -> Iterator[bytes]:
    """What a stream and its further members unpack to, in pieces of about ``_STEP`` bytes."""
    d, fed = make(), next(chunks, b"")
    try:
        while True:
            out = d.decompress(fed, _STEP)
            if out:
                yield out
            if d.eof:
                rest = d.unused_data
                while len(rest) < 6 and (more := next(chunks, b"")):
                    rest += more
                if _stream_of(rest) is None or make not in [m for begins, m in _STREAMS if begins(rest)]:
                    return
                d, fed = make(), rest
                continue
            # zlib hands back what it has not taken in yet, the others keep it.
            fed = getattr(d, "unconsumed_tail", b"")
            if not fed and (getattr(d, "needs_input", None) or not hasattr(d, "needs_input") and len(out) < _STEP):
                fed = next(chunks, b"")
                if not fed:
                    broken[0] += 1
                    return
    except _ERRORS:
        broken[0] += 1


def _unpacked(data: bytes, broken: list[int]) -> Iterator[bytes] | None:
    """Pieces of what the bytes unpack to, through any number of streams in streams; None if they are no stream."""
    make = _stream_of(data) or (_deflated(data) and (lambda: zlib.decompressobj(-15))) or None
    if make is None:
        return None
    chunks, seen = iter([data]), {hashlib.sha256(data[:_STEP]).digest()}
    while make is not None:
        chunks = _inflate(chunks, make, broken)
        head = b""
        while len(head) < 4_096 and (more := next(chunks, b"")):
            head += more
        mark = hashlib.sha256(head).digest()
        if mark in seen:  # a stream that unpacks to itself
            return iter(())
        seen.add(mark)
        chunks, make = itertools.chain([head], chunks), _stream_of(head)
    return chunks


def _wide(data: bytes) -> str | None:
    """Bytes as UTF-16, if most of its characters are of the first 256."""
    if len(data) < 8:
        return None
    half = len(data) // 2
    for zeros, name in ((data[1::2].count(0), "utf-16-le"), (data[0::2].count(0), "utf-16-be")):
        if zeros * 10 >= half * 7:
            return data[: half * 2].decode(name, "replace")
    return None


def _text(data: bytes) -> str:
    return _wide(data) or data.decode("utf-8", "surrogateescape")


def _windows(pieces: Iterator[bytes]) -> Iterator[tuple[str, bool]]:
    """(text, whether its first characters are a window's edge) of all pieces: one text, or overlapping windows."""
    held, cut = b"", False
    for piece in pieces:
        held += piece
        while len(held) > WINDOW:
            yield _text(held[:WINDOW]), cut
            held, cut = held[WINDOW - OVERLAP :], True
    if held and not (cut and len(held) <= OVERLAP):
        yield _text(held), cut


def _stretches(body: str, breaks: set[int], broken: list[int]) -> Iterator[tuple[str, int, int, bool]]:
    """(text, start, end, cut) of what ``body``, a run in the standard alphabet, decodes to in whole or in part.

    ``breaks`` are offsets at which base64 may begin besides 0.
    """
    for r in sorted({0} | {b % 4 for b in breaks}):
        part = body[r : len(body) - (len(body) - r) % 4] if (len(body) - r) % 4 == 1 else body[r:]
        data = binascii.a2b_base64(part + "=" * (-len(part) % 4))
        plain = None
        if r == 0:
            pieces = _unpacked(data, broken)
            for text, cut in _windows(pieces or iter(())):
                yield text, 0, len(body), cut
            try:
                plain = _wide(data) or data.decode()
            except UnicodeDecodeError:
                pass
            if plain:
                yield plain, 0, len(body), False
        for b in sorted(breaks):
            at = (b - r) // 4 * 3
            if b % 4 == r and b and any(begins(data[at : at + 8]) for begins, _ in _STREAMS):
                pieces = _unpacked(data[at:], broken)
                for text, cut in _windows(pieces or iter(())):
                    yield text, b, len(body), cut
        wide = _wide(data) if r else None
        if wide:
            yield wide, r, len(body), False
        text = data.decode("utf-8", "surrogateescape")
        at = done = 0
        for m in _STRETCH.finditer(text):
            at += len(text[done : m.start()].encode("utf-8", "surrogateescape"))
            done, size = m.start(), len(m[0].encode())
            if plain != m[0]:
                yield m[0], r + at // 3 * 4, min(len(body), r - (at + size) // -3 * 4), False


class _Layer:
    """A decoded text; ``starts`` and ``ends`` give the document's span of each of its characters, or one for all."""

    def __init__(self, text: str, starts: list[int] | range, ends: list[int] | range, whole: bool = False, cut: bool = False):
        self.text, self.starts, self.ends, self.whole, self.cut = text, starts, ends, whole, cut

    def span(self, a: int, b: int) -> tuple[int, int]:
        return (self.starts[0], self.ends[0]) if self.whole else (self.starts[a], self.ends[b - 1])

    def part(self, a: int, b: int) -> tuple[list[int], list[int]]:
        if self.whole:
            return [self.starts[0]] * (b - a), [self.ends[0]] * (b - a)
        return list(self.starts[a:b]), list(self.ends[a:b])


def _percent(layer: _Layer, a: int, b: int) -> _Layer:
    """A token, or a whole layer, with its percent escapes resolved: runs of them are UTF-8."""
    starts, ends = layer.part(a, b)
    t = layer.text[a:b]
    out, s, e, i = [], [], [], 0
    while i < len(t):
        run = _PERCENT.match(t, i)
        if run:
            data = binascii.unhexlify(run[0].replace("%", ""))
            at = i
            for ch in data.decode("utf-8", "replace"):
                n = len(ch.encode()) if ch != "\ufffd" else 1
                stop = min(run.end(), at + 3 * n)
                out.append(ch)
                s.append(starts[at])
                e.append(ends[stop - 1])
                at = min(stop, run.end() - 1)
            i = run.end()
        else:
            out.append(t[i])
            s.append(starts[i])
            e.append(ends[i])
            i += 1
    return _Layer("".join(out), s, e)


def _escapes(layer: _Layer, hits: list[re.Match]) -> _Layer:
    """The whole layer with its Unicode escapes resolved."""
    t = layer.text
    out, s, e, i = [], [], [], 0
    starts, ends = layer.part(0, len(t))
    for m in hits:
        code = int(next(g for g in m.groups() if g), 16)
        if code > 0x10FFFF or 0xD800 <= code <= 0xDFFF:
            continue
        out.append(t[i : m.start()])
        s += starts[i : m.start()]
        e += ends[i : m.start()]
        out.append(chr(code))
        s.append(starts[m.start()])
        e.append(ends[m.end() - 1])
        i = m.end()
    out.append(t[i:])
    return _Layer("".join(out), s + starts[i:], e + ends[i:])


def _inner(layer: _Layer, broken: list[int]) -> Iterator[_Layer]:
    """The layers within a layer, one after another."""
    if _PERCENT.search(layer.text):
        yield _percent(layer, 0, len(layer.text))
        for m in _TOKEN.finditer(layer.text):
            if _PERCENT.search(m[0]):
                yield _percent(layer, m.start(), m.end())
    if "\\" in layer.text and (hits := list(_ESCAPE.finditer(layer.text))):
        yield _escapes(layer, hits)
    for start, end, run, breaks, places in _runs(layer):
        body = run.rstrip("=")
        if len(body) < len(run) or not body.isalnum():
            breaks = breaks | {i + 1 for i, ch in enumerate(body) if ch in "/_-+" and i + 1 < len(body)}
        for plain, i, j, cut in _stretches(body.replace("-", "+").replace("_", "/"), breaks, broken):
            to = end if j == len(body) else start + (places[j - 1] + 1 if places else j)
            a, b = layer.span(start + (places[i] if places else i), to)
            yield _Layer(plain, [a], [b], True, cut)


def _runs(layer: _Layer) -> Iterator[tuple[int, int, str, set[int], list[int] | None]]:
    """(start, end, run, places where base64 may begin, where its characters are) of every run of base64's alphabet."""
    for m in _BASE64.finditer(layer.text):
        yield m.start(), m.end(), m[0], {1, 2, 3} if layer.cut and m.start() == 0 else set(), None
    if "\n" in layer.text:
        for m in _WRAPPED.finditer(layer.text):
            if m.end() - m.start() < LEAST_BASE64:
                continue
            lines = _BREAK.split(m[0])
            joints, n = set(), 0
            for x in lines[:-1]:
                n += len(x)
                joints.add(n)
            yield m.start(), m.end(), "".join(lines), joints, [i for i, ch in enumerate(m[0]) if ch not in " \t\r\n"]


def scan(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]], int, int]:
    """(base spans, all spans, layers opened, streams that break off) of a whole text."""
    text = text or ""
    base = base_spans(text)
    found, broken, layers = set(base), [0], 0

    def key(t: str, a: int, b: int) -> tuple[bytes, int, int]:
        return hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest(), a, b

    root = _Layer(text, range(len(text)), range(1, len(text) + 1))
    seen: set[tuple[bytes, int, int]] = set()
    work = [_inner(root, broken)]
    while work:
        x = next(work[-1], None)
        if x is None:
            work.pop()
            continue
        if not x.text or x.text == text and (x.starts[0], x.ends[-1]) == (0, len(text)):
            continue
        mark = key(x.text, x.starts[0], x.ends[-1])
        if mark in seen:
            continue
        seen.add(mark)
        layers += 1
        found.update((*x.span(a, b), kind) for a, b, kind in base_spans(x.text))
        work.append(_inner(x, broken))
    order = lambda z: (z[0], KINDS.index(z[2]), z[1])
    return sorted(base, key=order), sorted(found, key=order), layers, broken[0]


def digest(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers", "n_refused")}
        for t in texts(batch.column(1)):
            base, every, layers, refused = scan(t)
            for kind in KINDS:
                rows[f"n_{kind}"].append(sum(1 for x in base if x[2] == kind))
            rows["base_sha256"].append(hashlib.sha256(digest(base).encode()).hexdigest())
            rows["spans"].append(digest(every))
            rows["n_layers"].append(layers)
            rows["n_refused"].append(refused)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), **{k: pa.array(v, pa.string() if k in ("base_sha256", "spans") else pa.int64()) for k, v in rows.items()}})


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row a document: counts of base spans, their digest, all spans, and how many layers were opened or refused."""
    kinds = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long, n_refused long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan_batches, kinds)
