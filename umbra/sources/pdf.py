"""A small PDF reader on the standard library: files in, drawing operations and properties out.

It reads classic cross-reference files with plain or Flate streams, simple fonts with
widths and ToUnicode maps, forms, and layers that are off by default. Encrypted and broken
files, and those with object streams, give one row with an error and no operations.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OBJECT = re.compile(rb"(?:^|[\r\n\s])(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_TOKEN = re.compile(rb"\s*(?:%[^\r\n]*\s*)*(<<|>>|\[|\]|\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|/[^\s()<>\[\]{}/%]*|[^\s()<>\[\]{}/%]+)", re.S)
#: Content operators and what they are called in the table of operations; fixed values.
NAMES = {
    "q": "save", "Q": "restore", "cm": "transform", "BT": "beginText", "Tm": "setTextMatrix", "Td": "moveText", "TD": "setLeadingMoveText", "T*": "nextLine", "TL": "setLeading",
    "Tz": "setHScale", "Ts": "setTextRise", "Tr": "setTextRenderingMode", "W": "clip", "W*": "eoClip", "BMC": "beginMarkedContent", "EMC": "endMarkedContent",
}
PAINTS = {"f": "fill", "F": "fill", "f*": "eoFill", "B": "fillStroke", "B*": "eoFillStroke", "b": "closeFillStroke", "b*": "closeEOFillStroke", "n": "endPath", "S": "stroke", "s": "closeStroke"}
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
SCALE = 1.5
#: Bytes that one stream may inflate to.
MOST_BYTES = 256 << 20
#: What a broken file may raise; it ends that file, not the job.
BROKEN = (ValueError, KeyError, IndexError, TypeError, AttributeError, ArithmeticError, MemoryError, zlib.error, RecursionError)


class Ref(int):
    """A reference to an object by number."""


class Name(str):
    """A PDF name."""


def _string(raw: bytes) -> bytes:
    def one(m: re.Match) -> bytes:
        c = m[1]
        return bytes([int(c, 8) & 255]) if c[:1].isdigit() else b"" if c in (b"\n", b"\r", b"\r\n") else ESCAPES.get(c, c)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, raw, flags=re.S)


def parse(data: bytes) -> Iterator:
    """Tokens as Python values: numbers, Name, bytes, lists, dicts, Ref; bare words as str."""
    stack: list[list] = [[]]
    for m in _TOKEN.finditer(data):
        t = m[1]
        if t in (b"<<", b"["):
            stack.append([t])
            continue
        if t in (b">>", b"]") and len(stack) > 1:
            kind, *items = stack.pop()
            value = items if kind == b"[" else {k: v for k, v in zip(items[::2], items[1::2], strict=False) if isinstance(k, Name)}
        elif t[:1] == b"(":
            value = _string(t[1:-1])
        elif t[:1] == b"<":
            digits = re.sub(rb"\s", b"", t[1:-1])
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif t[:1] == b"/":
            value = Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), t[1:]).decode("latin-1"))
        elif re.fullmatch(rb"[+-]?(?:\d+\.?\d*|\.\d+)", t):
            value = float(t) if b"." in t else int(t)
        elif t == b"R" and len(stack[-1]) >= 2 and isinstance(stack[-1][-2], int):
            _, number = stack[-1].pop(), stack[-1].pop()
            value = Ref(number)
        else:
            value = {b"true": True, b"false": False, b"null": None}.get(t, t.decode("latin-1"))
        if len(stack) == 1 and isinstance(value, str) and not isinstance(value, Name):
            yield from stack[0]
            stack[0] = []
            yield value
        else:
            stack[-1].append(value)
    yield from stack[0]


class Document:
    """Objects of a file by number."""

    def __init__(self, data: bytes):
        if not data.lstrip()[:5] == b"%PDF-":
            raise ValueError("not a PDF file")
        if b"/Encrypt" in data:
            raise ValueError("the file is encrypted")
        self.raw = {int(m[1]): m[3] for m in _OBJECT.finditer(data)}
        trailers = [next(parse(m[1]), {}) for m in re.finditer(rb"\btrailer\s*(<<.*?>>)\s*startxref", data, re.S)]
        self.trailer = {k: v for t in trailers for k, v in t.items()}
        if "Root" not in self.trailer:
            raise ValueError("the file has no plain trailer")

    def get(self, value):
        """The value, or what it refers to (a stream gives its dictionary)."""
        hops = 0
        while isinstance(value, Ref) and hops < 32:
            value, hops = next(parse(self.raw.get(value, b"null").split(b"stream", 1)[0]), None), hops + 1
        return value

    def stream(self, value) -> bytes:
        if isinstance(value, list):
            return b"\n".join(map(self.stream, value))
        head, _, body = self.raw.get(value, b"").partition(b"stream")
        info = next(parse(head), {}) or {}
        body = body.removeprefix(b"\r\n") if body[:2] == b"\r\n" else body[1:]
        body = body[: body.rfind(b"endstream")]
        length = self.get(info.get("Length"))
        body = body[:length] if isinstance(length, int) and length <= len(body) else body
        filters = self.get(info.get("Filter")) or []
        for f in filters if isinstance(filters, list) else [filters]:
            if f != "FlateDecode":
                raise ValueError(f"unknown filter {f}")
            inflater = zlib.decompressobj()
            body = inflater.decompress(body, MOST_BYTES)
            if inflater.unconsumed_tail:
                raise ValueError("a stream is too large")
        return body

    def pages(self) -> Iterator[dict]:
        def walk(node, inherited: dict, depth: int) -> Iterator[dict]:
            node = self.get(node) or {}
            own = inherited | {k: node[k] for k in ("Resources", "MediaBox") if k in node}
            if "Kids" in node and depth < 64:
                for kid in self.get(node["Kids"]) or []:
                    yield from walk(kid, own, depth + 1)
            else:
                yield own | node

        yield from walk((self.get(self.trailer["Root"]) or {}).get("Pages"), {}, 0)

    def layers_off(self) -> set[int]:
        config = self.get((self.get((self.get(self.trailer["Root"]) or {}).get("OCProperties")) or {}).get("D")) or {}
        return {int(r) for r in self.get(config.get("OFF")) or [] if isinstance(r, Ref)}

    def properties(self) -> Iterator[tuple[str, str, str]]:
        """(origin, source, value) of strings and numbers of the Info dictionary, then of the elements and attributes of XMP."""
        for k, v in (self.get(self.trailer.get("Info")) or {}).items():
            v = self.get(v)
            if isinstance(v, bytes):
                yield "info", str(k), v[2:].decode("utf-16-be", "replace") if v[:2] == b"\xfe\xff" else v.decode("latin-1")
            elif isinstance(v, (int, float)) and not isinstance(v, (bool, Ref)):
                yield "info", str(k), f"{v:g}"
        packet = (self.get(self.trailer["Root"]) or {}).get("Metadata")
        if isinstance(packet, Ref):
            text = self.stream(packet).decode("utf-8", "replace")
            # no parser, so no entities that grow: texts of innermost elements, and attributes
            for tag, value in re.findall(r"<([\w.-]+:[\w.-]+)(?:\s[^<>]*)?>([^<>]+)</\1>", text):
                if value.strip():
                    yield "xmp", tag, html.unescape(value.strip())
            for tag, value in re.findall(r"\s((?!xmlns)[\w.-]+:[\w.-]+)=[\"']([^\"'<>]+)[\"']", text):
                if not tag.startswith(("rdf:", "xml:", "x:")):
                    yield "xmp", tag, html.unescape(value)

    def font(self, value) -> dict:
        f = self.get(value) or {}
        widths, first = self.get(f.get("Widths")) or [], f.get("FirstChar", 0)
        unicode_of: dict[int, str] = {}
        if isinstance(f.get("ToUnicode"), Ref):
            cmap = self.stream(f["ToUnicode"])
            text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
            for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
                unicode_of |= {int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block)}
            for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
                for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                    start = text(c)
                    unicode_of |= {int(a, 16) + i: start[:-1] + chr(ord(start[-1]) + i) for i in range(int(b, 16) - int(a, 16) + 1)}
        return {"widths": {first + i: self.get(w) for i, w in enumerate(widths)}, "unicode": unicode_of}

    def glyphs(self, font: dict, text: bytes) -> list[dict]:
        return [{"unicode": font["unicode"].get(c, bytes([c]).decode("cp1252", "replace")), "width": font["widths"].get(c, 500), "isSpace": c == 32} for c in text]

    def operations(self, content: bytes, resources: dict, off: set[int], depth: int = 0) -> Iterator[tuple[str, list]]:
        """(function, arguments) of a content stream, forms included."""
        part = lambda kind, name: (self.get(resources.get(kind)) or {}).get(name)
        font, operands, xs, ys = {"widths": {}, "unicode": {}}, [], [], []
        for t in parse(content):
            if isinstance(t, Name) or not isinstance(t, str):
                operands.append(t)
                continue
            a, operands = operands, []
            if t in NAMES:
                yield NAMES[t], [x for x in a if isinstance(x, (int, float))]
            elif t == "Tf":
                font = self.font(part("Font", a[0]))
                yield "setFont", [str(a[0]), a[1]]
            elif t in ("Tj", "'", '"'):
                if t != "Tj":
                    yield "nextLine", []
                yield "showText", [self.glyphs(font, a[-1])]
            elif t == "TJ":
                yield "showText", [[g for x in a[0] for g in (self.glyphs(font, x) if isinstance(x, bytes) else [x])]]
            elif t in ("rg", "g"):
                yield "setFillRGBColor", ["#" + "".join(f"{max(0, min(255, int(v * 255 + 0.5))):02x}" for v in (a if t == "rg" else a * 3))]
            elif t == "k":
                yield "setFillRGBColor", ["#" + "".join(f"{max(0, min(255, int((1 - v) * (1 - a[3]) * 255 + 0.5))):02x}" for v in a[:3])]
            elif t == "gs":
                state = self.get(part("ExtGState", a[0])) or {}
                yield "setGState", [[["ca", self.get(state["ca"])]] if "ca" in state else []]
            elif t == "BDC":
                layer = part("Properties", a[1]) if isinstance(a[1], Name) else None
                yield "beginMarkedContentProps", [str(a[0]), not (isinstance(layer, Ref) and int(layer) in off)]
            elif t == "re":
                xs += [a[0], a[0] + a[2]]
                ys += [a[1], a[1] + a[3]]
            elif t in ("m", "l", "c", "v", "y"):
                xs += a[::2]
                ys += a[1::2]
            elif t in PAINTS:
                yield "constructPath", [PAINTS[t], None, [min(xs), min(ys), max(xs), max(ys)] if xs else None]
                xs, ys = [], []
            elif t == "sh":
                yield "shadingFill", []
            elif t == "Do":
                target = part("XObject", a[0])
                form = self.get(target) or {}
                if form.get("Subtype") == "Image":
                    yield "paintImageXObject", []
                elif isinstance(target, Ref) and depth < 12:
                    yield "paintFormXObjectBegin", [self.get(form.get("Matrix")) or [1, 0, 0, 1, 0, 0]]
                    yield from self.operations(self.stream(target), self.get(form.get("Resources")) or resources, off, depth + 1)
                    yield "paintFormXObjectEnd", []


def file_operations(data: bytes) -> Iterator[tuple[int, float, float, int, str, str]]:
    """page_number, page width and height, operation_index, fn, args of a file."""
    doc = Document(data)
    off = doc.layers_off()
    for number, page in enumerate(doc.pages(), 1):
        area = [float(doc.get(v)) for v in doc.get(page.get("MediaBox")) or [0, 0, 612, 792]]
        for index, (fn, args) in enumerate(doc.operations(doc.stream(page["Contents"]) if "Contents" in page else b"", doc.get(page.get("Resources")) or {}, off)):
            yield number, (area[2] - area[0]) * SCALE, (area[3] - area[1]) * SCALE, index, fn, json.dumps(args)


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """PDF files under a path as binary rows; other files are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(path)


def read_operations(files: DataFrame) -> DataFrame:
    """doc_id, page_number, page_width, page_height, operation_index, fn, args, error of binary rows (path, content).

    A file that cannot be read gives one row with its error and nulls; others go on.
    """
    kinds = [("doc_id", pa.string()), ("page_number", pa.int32()), ("page_width", pa.float64()), ("page_height", pa.float64()), ("operation_index", pa.int32()), ("fn", pa.string()), ("args", pa.string()), ("error", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    rows = [(path.as_py(), *row, None) for row in file_operations(content.as_py() or b"")]
                except BROKEN as e:
                    rows = [(path.as_py(), None, None, None, None, None, None, str(e))]
                columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])

    return files.select("path", F.col("content")).mapInArrow(run, "doc_id string, page_number int, page_width double, page_height double, operation_index int, fn string, args string, error string")


def read_properties(files: DataFrame) -> DataFrame:
    """Property entries (doc_id, ord, origin, source, value) of binary rows; a file that cannot be read has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    doc = Document(content.as_py() or b"")
                    found = list(doc.properties())
                except BROKEN:
                    continue
                rows += [(path.as_py(), n, *entry) for n, entry in enumerate(found)]
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "ord", "origin", "source", "value"])

    return files.select("path", "content").mapInArrow(run, "doc_id string, ord int, origin string, source string, value string")
