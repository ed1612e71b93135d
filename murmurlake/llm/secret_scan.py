"""Secret scans through nested encodings: a worklist of decoded layers, worked off until nothing new appears."""

from __future__ import annotations

import base64
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurlake.llm.common import prepare

#: What counts as a secret: publicly documented credential formats, and assignments to a telling name.
PATTERNS = {
    "aws_access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github_token": r"\bgh[pousr]_[A-Za-z0-9]{36,}\b",
    "google_api_key": r"\bAIza[0-9A-Za-z_-]{35}",
    "slack_token": r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
    "stripe_key": r"\b[sr]k_(?:live|test)_[0-9a-zA-Z]{16,}",
    "json_web_token": r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "private_key": r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----",
    "assigned": r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?([A-Za-z0-9+/_.~$!@#%^&*-]{8,})",
}
_COMPILED = {kind: re.compile(pattern) for kind, pattern in PATTERNS.items()}
#: A decompressed layer beyond so many bytes is reported as ``oversize_layer`` and scanned in chunks that overlap.
LAYER_BYTES, CHUNK_BYTES, OVERLAP_BYTES = 32 << 20, 1 << 20, 64 << 10

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|(?:\\u[0-9A-Fa-f]{4})+|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:\r?\n[A-Za-z0-9+/_-]{16,})*(?:\r?\n[A-Za-z0-9+/_-]{1,15}(?![A-Za-z0-9+/_-]))?={0,2}")
#: What any secret, or any encoding of one, stands in whole: characters that all are ASCII, 12 at least.
_RUN = re.compile(rb"[\t\r\n\f\x20-\x7e]{12,}")
_ODD = re.compile(rb"[\x00-\x08\x0b\x0e-\x1f\x7f]")
#: Where compressed data may begin.
_MAGIC = re.compile(rb"\x1f\x8b\x08|[\x08-\x78][\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
_SOME_ESCAPE = r"%[0-9A-Fa-f]{2}|\\[uUx]"

SCHEMA = "doc_id bigint, kind string, start bigint, end bigint, depth int, path string, fingerprint string"


class Layer:
    """A text that was reached by decoding, and the span of the whole document that any span of it is from: by
    character where escapes are decoded in place (``starts``, ``ends``), for a decoded block and all within it the
    block's own ``span``, in the document itself the same. Places are always the document's, however deep the layer."""

    def __init__(self, text: str, path: tuple[str, ...], starts: list[int] | None = None, ends: list[int] | None = None, span: tuple[int, int] | None = None):
        self.text, self.path, self.starts, self.ends, self.span = text, path, starts, ends, span

    def at(self, start: int, end: int) -> tuple[int, int]:
        if self.span is not None:
            return self.span
        if self.starts is None:
            return start, end
        return (self.starts[start], self.ends[max(start, end - 1)]) if self.starts else (0, 0)

    def block(self, text: str, path: tuple[str, ...], span: tuple[int, int]) -> Layer:
        """A block of this layer, decoded."""
        return Layer(text, (*self.path, *path), span=self.at(*span))


def escapes(match: re.Match) -> list[tuple[str, int, int]]:
    """Characters of a run of Unicode escapes with the span of each; surrogate pairs join, lone ones stay as they are."""
    run, base = match.group(), match.start()
    code = next((g for g in match.groups() if g), None)
    if code is not None:
        value = int(code, 16)
        return [(chr(value), base, match.end())] if value < 0x110000 and not 0xD800 <= value < 0xE000 else [(c, base + i, base + i + 1) for i, c in enumerate(run)]
    units = [int(run[i + 2 : i + 6], 16) for i in range(0, len(run), 6)]
    out, i = [], 0
    while i < len(units):
        a, b = units[i], base + 6 * i
        if 0xD800 <= a < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1] < 0xE000:
            out.append((chr(0x10000 + ((a - 0xD800) << 10) + units[i + 1] - 0xDC00), b, b + 12))
            i += 2
            continue
        out += [(run[6 * i + j], b + j, b + j + 1) for j in range(6)] if 0xD800 <= a < 0xE000 else [(chr(a), b, b + 6)]
        i += 1
    return out


def percents(match: re.Match) -> list[tuple[str, int, int]]:
    """Characters of a run of percent escapes; bytes that aren't UTF-8 stay as they are."""
    base, raw = match.start(), bytes.fromhex(match.group().replace("%", ""))
    out, i = [], 0
    while i < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append((raw[i : i + size].decode(), base + 3 * i, base + 3 * (i + size)))
                i += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out += [(match.group()[3 * i + j], base + 3 * i + j, base + 3 * i + j + 1) for j in range(3)]
            i += 1
    return out


def in_place(layer: Layer, pattern: re.Pattern, decode, name: str) -> Layer | None:
    """The layer with all escapes of a kind decoded, or None if that changes nothing."""
    parts, starts, ends, done, text = [], [], [], 0, layer.text
    mapped = layer.span is None
    for match in pattern.finditer(text):
        parts.append(text[done : match.start()])
        if mapped:
            starts += range(done, match.start())
            ends += range(done + 1, match.start() + 1)
        for char, a, b in decode(match):
            parts.append(char)
            if mapped:
                starts.append(a)
                ends.append(b)
        done = match.end()
    if not parts:
        return None
    parts.append(text[done:])
    new = "".join(parts)
    if new == text:
        return None
    path = (*layer.path, name)
    if not mapped:
        return Layer(new, path, span=layer.span)
    starts += range(done, len(text))
    ends += range(done + 1, len(text) + 1)
    if layer.starts is not None:
        starts, ends = [layer.starts[a] for a in starts], [layer.ends[b - 1] for b in ends]
    return Layer(new, path, starts, ends)


def opener(raw: bytes):
    """What decompresses data that begins so, and whether it takes small parts only; None if nothing does."""
    if raw[:2] == b"\x1f\x8b" or weak(raw):
        return zlib.decompressobj(47), False
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor(), False
    if raw[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor(), False
    if raw[:4] == b"\x28\xb5\x2f\xfd":
        return zstandard.ZstdDecompressor().decompressobj(), True
    return None


def weak(raw: bytes) -> bool:
    """Whether data begins like zlib's, which other data often does."""
    return len(raw) > 2 and raw[0] & 15 == 8 and (raw[0] << 8 | raw[1]) % 31 == 0


def streamed(source: Iterator[bytes], whole: list[int] | None = None) -> Iterator[bytes]:
    """Decompressed chunks of the members (frames, streams) that stand one after another in data that comes in chunks;
    nothing if it isn't compressed. Damaged data and what follows the last member end it. ``whole`` gets an entry for
    each member that is complete."""
    unpacker, small, held = None, False, b""
    for data in source:
        held += data
        while True:
            if unpacker is None:
                if not held or (found := opener(held)) is None:
                    break
                unpacker, small = found
            try:
                if small:
                    part, held = held[:4096], held[4096:]
                    out = unpacker.decompress(part) if part else b""
                else:
                    out = unpacker.decompress(held, CHUNK_BYTES)
                    held = getattr(unpacker, "unconsumed_tail", b"")
            except Exception:  # noqa: BLE001 - each library has its own errors for data that only looks compressed
                return
            if out:
                yield out
            if unpacker.eof:
                held, unpacker = unpacker.unused_data + (held if small else b""), None
                if whole is not None:
                    whole.append(len(held))
            elif not held and len(out) < CHUNK_BYTES:
                break
        if unpacker is None and held:
            return


def unpacked(raw: bytes) -> tuple[bytes | None, bool]:
    """Decompressed bytes of all members, and whether they were too many; None if it isn't compressed or holds nothing.
    Of damaged data what comes before the damage counts, but for zlib's, which other data may look like."""
    parts, size, whole = [], 0, []
    raw = bytes(raw)
    for part in streamed(iter([raw]), whole):
        parts.append(part)
        size += len(part)
        if size > LAYER_BYTES:
            return None, True
    if not whole and weak(raw):
        return None, False
    return b"".join(parts) or None, False


def inflated(source: Iterator[bytes]) -> Iterator[bytes]:
    """Decompressed chunks of a stream, through as many compressions as it has."""
    first = next(source, b"")
    source = itertools.chain([first], source)
    if opener(first) is None:
        yield from source
    else:
        yield from inflated(streamed(source))


def overlapping(source: Iterator[bytes]) -> Iterator[bytes]:
    """Chunks that begin and end at white space where there is any near, each with the end of the one before."""
    held = b""
    for data in source:
        held += data
        if len(held) < CHUNK_BYTES + OVERLAP_BYTES:
            continue
        space = max(held.rfind(c, len(held) - OVERLAP_BYTES) for c in (b" ", b"\n", b"\t"))
        end = space if space >= 0 else len(held)
        yield held[:end]
        back = re.search(rb"\s", held[end - OVERLAP_BYTES : end])
        held = held[end - OVERLAP_BYTES + (back.start() if back else 0) :]
    if held:
        yield held


def clean(raw: bytes) -> str | None:
    if not raw or _ODD.search(raw):
        return None
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return None


def readable(raw: bytes) -> str | None:
    """The bytes as text; of those that aren't, the runs of ASCII that may hold something."""
    return clean(raw) or "\0".join(m.group().decode() for m in _RUN.finditer(raw)) or None


def decoded(block: str) -> bytes:
    return base64.b64decode(block[: len(block) - (len(block) % 4 == 1)] + "=" * (-len(block) % 4 % 3))


def candidates(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Spans of a match that may be one block: all of it, lines of one width with a shorter last one and without it,
    single lines."""
    if "\n" not in text[a:b]:
        return [(a, b)]
    lines = [(a + m.start(), a + m.end()) for m in re.finditer(r"[^\r\n]+", text[a:b])]
    out, first = [(a, b)], 0
    for k in range(1, len(lines) + 1):
        width = lines[first][1] - lines[first][0]
        if k < len(lines) and lines[k][1] - lines[k][0] == width:
            continue
        if k < len(lines) and lines[k][1] - lines[k][0] < width:
            out.append((lines[first][0], lines[k][1]))
        out.append((lines[first][0], lines[k - 1][1]))
        first = k
    return list(dict.fromkeys(out + [x for x in lines if x[1] - x[0] >= 16]))


def blocks(layer: Layer) -> Iterator[tuple[Layer | Iterator[Layer] | None, tuple[int, int]]]:
    """A layer for each base64 block that holds text, compressed text or something that may be text, and for one that
    unpacks to too much None and then its chunks."""

    def unpack(raw: bytes, span: tuple[int, int]) -> Iterator[tuple[Layer | Iterator[Layer] | None, tuple[int, int]]]:
        path, too_much, met = ("base64",), False, set()
        while (mark := hashlib.sha256(raw).digest()) not in met:  # data that unpacks to itself ends here
            met.add(mark)
            inner, too_much = unpacked(raw)
            if inner is None:
                break
            raw, path = inner, (*path, "compressed")
        if too_much:
            yield None, span
            texts = filter(None, map(readable, overlapping(inflated(iter([raw])))))
            yield (layer.block(text, (*path, "compressed"), span) for text in texts), span
        elif (text := readable(raw)) is not None:
            yield layer.block(text, path, span), span

    for match in _BASE64.finditer(layer.text):
        done, a, b = [], *match.span()
        for x, y in (spans := candidates(layer.text, a, b)):
            # a shorter last line without padding may be a word that only stands below the block: both are blocks then
            if any(p <= x and y <= q and not (p == x and "\n" in layer.text[y:q] and "=" not in layer.text[y:q]) for p, q in done):
                continue
            block = re.sub(r"[\r\n=]", "", layer.text[x:y]).replace("-", "+").replace("_", "/")
            raw = decoded(block)
            if len(block) % 4 != 1 and (clean(raw) or unpacked(raw) != (None, False)):
                done.append((x, y))
                yield from unpack(raw, (x, y))
        for x, y in [(a, b)] if not done else [s for s in spans if "\n" not in layer.text[s[0] : s[1]] and not any(p <= s[0] and s[1] <= q for p, q in done)]:
            yield from inside(layer, x, y, unpack)


def inside(layer: Layer, a: int, b: int, unpack) -> Iterator[tuple[Layer | Iterator[Layer] | None, tuple[int, int]]]:
    """Layers of a block that is none from its beginning on: something else may stand before it. For each of the four
    ways to align it, what is text or compressed from a path's slash, a hyphen or an underscore on, what looks
    compressed from anywhere on, else all of it with its odd bytes."""
    places = [i for i in range(a, b) if layer.text[i] not in "\r\n="]
    block = "".join(layer.text[i] for i in places).replace("-", "+").replace("_", "/")
    starts: dict[int, list[int]] = {k: [k] for k in range(min(4, max(0, len(block) - 15)))}
    for m in re.finditer(r"[+/]", block):
        if layer.text[places[m.start()]] != "+" and len(block) - m.end() >= 16:
            starts.setdefault(m.end() % 4, []).append(m.end())
    for at in starts.values():
        at = sorted(set(at))
        raw, base = decoded(block[at[0] :]), at[0]
        bad = max((m.end() for m in _ODD.finditer(raw)), default=0)
        for k in at:
            rest = (k - base) // 4 * 3
            if rest >= bad and clean(raw[rest:]):
                yield from unpack(raw[rest:], (places[k], b))
                break
        else:
            for m in _MAGIC.finditer(raw):
                if unpacked(raw[m.start() :]) != (None, False):
                    yield from unpack(raw[m.start() :], (places[base + m.start() // 3 * 4], b))
            yield from unpack(raw, (places[base], b))


def explore(work: list[Layer | Iterator[Layer]], seen: set, found: dict) -> None:
    """Work off layers and all that is in them; of an iterator of layers one after another."""

    def new(layer: Layer) -> bool:
        """What was met before at its place holds nothing new; a cycle ends here."""
        mark = (hashlib.sha256(layer.text.encode("utf-8", "surrogatepass")).digest(), *layer.at(0, len(layer.text)))
        return mark not in seen and (seen.add(mark) or True)

    while work:
        layer = work.pop(0)
        if not isinstance(layer, Layer):
            for chunk in layer:
                if new(chunk):
                    explore([chunk], seen, found)
            continue
        for kind, pattern in _COMPILED.items():
            for match in pattern.finditer(layer.text):
                group = match.lastindex or 0
                start, end = layer.at(*match.span(group))
                mark = hashlib.sha256(match.group(group).encode("utf-8", "surrogatepass")).hexdigest()[:16]
                found.setdefault((kind, start, end, mark), (len(layer.path), "/".join(layer.path)))
        work += [x for x in (in_place(layer, _URL, percents, "url"), in_place(layer, _UNICODE, escapes, "unicode")) if x and new(x)]
        for child, span in blocks(layer):
            if child is None:
                found.setdefault(("oversize_layer", *layer.at(*span), ""), (len(layer.path) + 1, "/".join((*layer.path, "base64"))))
            elif not isinstance(child, Layer) or new(child):
                work.append(child)


def scan(text: str) -> list[tuple[str, int, int, int, str, str]]:
    """``kind, start, end, depth, path, fingerprint`` of the secrets of a text and of all layers in it."""
    seen, found = {(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest(), 0, len(text))}, {}
    explore([Layer(text, ())], seen, found)
    return sorted((kind, a, b, depth, path, mark) for (kind, a, b, mark), (depth, path) in found.items())


#: Texts without any of these hold no secret and no layer: the least that a secret takes is 12 characters, and so 16 of
#: base64, that of a nested block more.
_WORTH = "|".join([_SOME_ESCAPE, r"AKIA|ASIA|gh[pousr]_|AIza|xox[abprs]-|[sr]k_|eyJ|-----BEGIN|(?i:passw|pwd|secret|token|key)", r"[A-Za-z0-9+/_-]{16}"])


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each secret of each row of ``docs``: its kind, where it is in the document (characters; for one in
    a decoded block the block), how many layers down and by which decodings, and a fingerprint of its value.

    URL escapes and Unicode escapes are decoded over the whole layer, so what stands beside them counts too; base64
    blocks of 16 characters or more (also URL-safe, also wrapped at 16 or more, also with other characters of the
    alphabet before them) that hold text, or compressed text of any number of members, become layers of their own; of
    other bytes the runs of ASCII do. Layers are worked off until none is new; there is no limit of depth, and a very
    long text that decodes to others as long time and again takes time for each. A secret that several layers show at
    the same place counts once, at the least depth, of equal depths by the first path that leads there. Null and empty
    texts have none; very long ones are scanned whole; repeated rows are reported each; a null id stays null; other
    columns are ignored, whatever their names; an empty table gives an empty one. A block that unpacks beyond
    ``LAYER_BYTES`` is reported as ``oversize_layer`` and scanned in chunks; an encoded block in it that is longer than
    ``OVERLAP_BYTES`` may be cut between two. Map only."""
    prepare(docs.sparkSession)
    names = ["doc_id", "kind", "start", "end", "depth", "path", "fingerprint"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pc.fill_null(batch.column(1), "")
            worth = pc.match_substring_regex(column, _WORTH)
            ids, rows = batch.column(0).filter(worth), []
            for doc, text in zip(ids.to_pylist(), column.filter(worth).to_pylist()):
                rows += [(doc, *row) for row in scan(text)]
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, SCHEMA)
