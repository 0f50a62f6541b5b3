"""PDF files as evidence rows: pages, text glyphs, images, paths, annotations and document nodes.

`decode` turns a folder of files into one table of events, by binaryFile and one Arrow pass; files over the size limit are
rejected on the listing, before their content is read. What isn't supported is said in `error` or simply leaves no row:
encryption other than RC4, vertical writing, fonts' own programs (widths come from the font dictionary), and clips that aren't
rectangles, which count as their bounds.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.functions import pages as selections
from glyphlake.schema import LIMITS
from glyphlake.sources.pdf_layers import DESTINATIONS, Layers
from glyphlake.sources.pdf_objects import Document, Name, Operator, PdfError, Reader, Ref, Stream
from glyphlake.sources.pdf_security import NOT_ALLOWED

EVENTS = "path string, page_number int, kind string, seq bigint, payload string, error string"


def to_unicode(data: bytes) -> tuple[dict[int, str], str | None]:
    """(code -> text, verdict) of a ToUnicode map: MALFORMED if it can't be parsed, INVALID if it maps nothing usable."""
    out: dict[int, str] = {}
    reader = Reader(data)
    text = lambda b: b.decode("utf-16-be", "replace") if len(b) > 1 else b.decode("latin-1")
    if re.search(rb"<[^<>0-9A-Fa-f\s]|<[0-9A-Fa-f\s]*[^0-9A-Fa-f\s<>][^<>]*>", re.sub(rb"<<.*?>>", b"", data, flags=re.S)):
        return out, "MALFORMED_TOUNICODE_CMAP"
    mode, args = None, []
    while (x := reader.read()) is not None:
        if isinstance(x, Operator):
            if x in ("beginbfchar", "beginbfrange"):
                mode, args = str(x)[5:], []
            elif x in ("endbfchar", "endbfrange"):
                size = 2 if mode == "bfchar" else 3
                if mode is None or len(args) % size:
                    return out, "MALFORMED_TOUNICODE_CMAP"
                for k in range(0, len(args), size):
                    row = args[k : k + size]
                    if not all(isinstance(v, bytes) for v in row[: size - 1]):
                        return out, "MALFORMED_TOUNICODE_CMAP"
                    first = int.from_bytes(row[0], "big")
                    if size == 2:
                        if isinstance(row[1], bytes):
                            out[first] = text(row[1])
                        continue
                    last = int.from_bytes(row[1], "big")
                    for i in range(min(last - first + 1, 65_536)):
                        if isinstance(row[2], list):
                            if i < len(row[2]) and isinstance(row[2][i], bytes):
                                out[first + i] = text(row[2][i])
                        elif isinstance(row[2], bytes) and row[2]:
                            out[first + i] = text((int.from_bytes(row[2], "big") + i).to_bytes(len(row[2]), "big", signed=False)) if int.from_bytes(row[2], "big") + i < 256 ** len(row[2]) else "�"
                mode = None
        elif mode:
            args.append(x)
    return out, None if out else "INVALID_TOUNICODE_CMAP"


@dataclass
class Font:
    name: str = "<unnamed>"
    subtype: str = "<unknown>"
    encoding: str = "<implicit>"
    embedded: bool = False
    damaged: bool = False
    to_unicode_present: bool = False
    verdict: str | None = None
    wide: bool = False
    untrusted: bool = False
    widths: dict[int, float] = field(default_factory=dict)
    default: float = 500.0
    texts: dict[int, str] | None = None
    predefined: str | None = None

    def codes(self, s: bytes) -> list[int]:
        return [int.from_bytes(s[i : i + 2], "big") for i in range(0, len(s) - 1, 2)] if self.wide else list(s)

    def text(self, code: int) -> str | None:
        if self.untrusted:
            return None
        if self.texts is not None and code in self.texts:
            return self.texts[code]
        if self.wide:
            return code.to_bytes(2, "big").decode(self.predefined, "replace") if self.predefined else None
        return bytes([code]).decode("cp1252", "replace") if code >= 32 else chr(code)


def read_font(doc: Document, value) -> Font:
    f = doc.get(value)
    if not isinstance(f, dict):
        return Font("<malformed-font>", damaged=True, untrusted=True)
    font = Font(name_of(doc, f.get("BaseFont"), "<unnamed>"), name_of(doc, f.get("Subtype"), "<unknown>"))
    font.wide = font.subtype == "Type0"
    inner = f
    if font.wide:
        below = doc.get(f.get("DescendantFonts"), [])
        inner = doc.get(below[0]) if isinstance(below, list) and below else None
        if not isinstance(inner, dict):
            return Font("<malformed-font>", font.subtype, damaged=True, untrusted=True, wide=True)
        font.default = float(doc.get(inner.get("DW"), 1000))
        w = [doc.get(x) for x in doc.get(inner.get("W"), [])]
        k = 0
        while k + 1 < len(w):
            if isinstance(w[k + 1], list):
                font.widths |= {w[k] + i: doc.get(x) for i, x in enumerate(w[k + 1])}
                k += 2
            elif k + 2 < len(w):
                font.widths |= dict.fromkeys(range(w[k], min(w[k + 1], w[k] + 65_535) + 1), w[k + 2])
                k += 3
            else:
                break
    else:
        first = doc.get(f.get("FirstChar"), 0)
        font.widths = {first + i: doc.get(x) for i, x in enumerate(doc.get(f.get("Widths"), []))}
    descriptor = doc.get(inner.get("FontDescriptor"), {})
    font.embedded = isinstance(descriptor, dict) and any(k in descriptor for k in ("FontFile", "FontFile2", "FontFile3"))
    encoding = doc.get(f.get("Encoding"))
    if isinstance(encoding, Name):
        font.encoding = name_of(doc, encoding, "<unnamed>")
    elif isinstance(encoding, Stream):
        font.encoding = name_of(doc, encoding.entries.get("CMapName"), "<stream>")
    elif isinstance(encoding, dict):
        font.encoding = name_of(doc, encoding.get("BaseEncoding"), "<dictionary>")
    elif encoding is not None:
        font.encoding = "<other>"
    unicode = doc.get(f.get("ToUnicode"))
    font.to_unicode_present = unicode is not None
    if isinstance(unicode, Stream):
        font.texts, font.verdict = to_unicode(doc.decoded(unicode))
    elif isinstance(unicode, Name):
        font.predefined = predefined(unicode)
        font.verdict = None if font.predefined else "INVALID_TOUNICODE_CMAP" if unicode in CODE_MAPS else "MALFORMED_TOUNICODE_CMAP"
    elif unicode is not None:
        font.verdict = "MALFORMED_TOUNICODE_CMAP"
    return font


#: Predefined maps whose codes are Unicode, with their encoding, and such that say nothing of Unicode.
UNICODE_MAPS = {f"{kind}-{d}": code for kind, code in (("UniGB-UCS2", "utf-16-be"), ("UniCNS-UCS2", "utf-16-be"), ("UniJIS-UCS2", "utf-16-be"), ("UniKS-UCS2", "utf-16-be"), ("UniGB-UTF16", "utf-16-be"), ("UniCNS-UTF16", "utf-16-be"), ("UniJIS-UTF16", "utf-16-be"), ("UniKS-UTF16", "utf-16-be")) for d in "HV"}
CODE_MAPS = ("Identity-H", "Identity-V")


def predefined(name: str) -> str | None:
    """The encoding of a predefined map's codes, if they are Unicode."""
    return UNICODE_MAPS.get(name)


def name_of(doc: Document, value, fallback: str) -> str:
    """A name without controls, of at most 128 code points; the fallback for what is none, or blank."""
    name = doc.get(value)
    if not isinstance(name, str) or not name.strip():
        return fallback
    return "".join(c for c in name if not (ord(c) < 32 or 127 <= ord(c) < 160))[:128] or fallback


def times(a, b):
    """Matrix product: a first, then b."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def bounds(m, x0, y0, x1, y1):
    xs = [m[0] * x + m[2] * y + m[4] for x, y in ((x0, y0), (x1, y0), (x0, y1), (x1, y1))]
    ys = [m[1] * x + m[3] * y + m[5] for x, y in ((x0, y0), (x1, y0), (x0, y1), (x1, y1))]
    return min(xs), min(ys), max(xs), max(ys)


def polygon_area(points: list[tuple[float, float]]) -> float:
    """The area within a polygon, whichever way its points run."""
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1], strict=True))) / 2


def cut_to(points: list[tuple[float, float]], box: tuple[float, float, float, float]) -> list[tuple[float, float]]:
    """What of a convex polygon lies in a box: one side of the box after the other cuts it."""
    for axis, bound, sign in ((0, box[0], 1), (1, box[1], 1), (0, box[2], -1), (1, box[3], -1)):
        depth = [(p[axis] - bound) * sign for p in points]
        left = []
        for i, (p, d) in enumerate(zip(points, depth, strict=True)):
            before, b = points[i - 1], depth[i - 1]
            if (d >= 0) != (b >= 0):
                t = b / (b - d)
                left.append((before[0] + (p[0] - before[0]) * t, before[1] + (p[1] - before[1]) * t))
            if d >= 0:
                left.append(p)
        points = left
        if not points:
            break
    return points


@dataclass
class State:
    ctm: tuple = (1, 0, 0, 1, 0, 0)
    font: Font | None = None
    font_obj: int = -1
    size: float = 0.0
    char: float = 0.0
    word: float = 0.0
    scale: float = 1.0
    lead: float = 0.0
    rise: float = 0.0
    mode: int = 0
    fill_alpha: float = 1.0
    stroke_alpha: float = 1.0
    width: float = 1.0
    clip: tuple | None = None
    cap: int = 0
    no_stroke: bool = False


class LimitError(PdfError):
    """A file that takes more work than it may."""

    def __init__(self, code: str, most: int):
        super().__init__(f"PDF exceeds the configured {LABELS[code]} limit of {most}")
        self.code = code


LABELS = {code: label for code, label, _ in LIMITS}


class Work:
    """Counts events against limits: a count above its limit raises LimitError."""

    def __init__(self, limits: dict[str, int] | None = None):
        self.most = {code: n for code, _, n in LIMITS} | (limits or {})
        self.done = dict.fromkeys(self.most, 0)

    def add(self, code: str, n: int = 1) -> None:
        self.done[code] += n
        if self.done[code] > self.most[code]:
            raise LimitError(code, self.most[code])

    def page(self) -> None:
        """Most limits are a page's; glyphs, characters and surfaces are a document's."""
        for code in self.done:
            if code not in ("GLYPH_COUNT", "SEMANTIC_CHARACTER_COUNT", "DOCUMENT_SURFACE_COUNT"):
                self.done[code] = 0


class PageReader:
    """Runs a page's content and gathers its events: (kind, payload)."""

    def __init__(self, doc: Document, work: Work | None = None, layers: Layers | None = None):
        self.doc, self.events, self.fonts = doc, [], {}
        self.work = work or Work()
        self.layers = layers or Layers(doc, {})
        self.crop: tuple | None = None
        self.frames: list[tuple[int, str] | None] = []
        self.seen_frames: set[int] = set()
        self.frame_no = 0
        self.hidden = 0  # depth of hidden content
        self.descriptions: set[tuple] = set()

    def layer(self, value) -> bool:
        """Whether optional content is visible in the view; it is told of as a reference. None refers to nothing that can be told."""
        if value is None:
            self.events.append(("reference", {"node": None, "membership": False, **dict.fromkeys(DESTINATIONS)}))
            return False
        self.work.add("OPTIONAL_CONTENT_REFERENCE_COUNT")
        states = {d: self.layers.hidden(value, d) for d in DESTINATIONS}
        self.events.append(("reference", {"node": value.number if isinstance(value, Ref) else -1, "membership": self.layers.is_membership(value), **states}))
        return states["view"] is False

    def font(self, value) -> tuple[Font, int]:
        key = value.number if isinstance(value, Ref) else -1 - len(self.fonts)
        if key not in self.fonts:
            self.fonts[key] = f = read_font(self.doc, value)
            self.events.append(("font", {"font_obj": key, "name": f.name, "subtype": f.subtype, "encoding": f.encoding, "embedded": f.embedded, "damaged": f.damaged, "vertical": f.encoding.endswith("-V"), "to_unicode_present": f.to_unicode_present, "to_unicode_verdict": f.verdict, "subset": bool(re.match(r"[A-Z]{6}\+.", f.name))}))
        return self.fonts[key], key

    def run(self, data: bytes, resources: dict, state: State, form_depth: int = 0, in_annotation: bool = False) -> None:
        doc, reader, args, stack = self.doc, Reader(data), [], []
        tm = line = (1, 0, 0, 1, 0, 0)
        path: list[tuple[float, float]] = []
        clip_next = False
        s = state

        def show(text: bytes) -> None:
            nonlocal tm
            font = s.font or Font(untrusted=True, name="<malformed-font>")
            if not in_annotation:
                key = (font.name, font.subtype, font.encoding, font.embedded, font.damaged, font.to_unicode_present)
                if key not in self.descriptions:
                    self.descriptions.add(key)
                    self.work.add("FONT_COUNT")
            for code in font.codes(text):
                unicode = font.text(code)
                m = times((s.size * s.scale, 0, 0, s.size, 0, s.rise), times(tm, s.ctm))
                wide = float(font.widths.get(code, font.default) or 0) / 1000
                advance = (wide * s.size + s.char + (s.word if code == 32 and not font.wide else 0)) * s.scale
                frame = next((f for f in reversed(self.frames) if f), None)
                first = frame is not None and frame[0] not in self.seen_frames
                if first:
                    self.seen_frames.add(frame[0])
                if not in_annotation:
                    self.work.add("GLYPH_COUNT")
                    self.work.add("SEMANTIC_CHARACTER_COUNT", len(unicode or "") if frame is None else len(frame[1].replace("\u00ad", "")) if first else 0)
                inside = s.clip is None or (s.clip[0] <= m[4] <= s.clip[2] and s.clip[1] <= m[5] <= s.clip[3])
                self.events.append(("glyph", {
                    "raw_unicode": unicode, "code_unicodes": [unicode], "code": code, "font_obj": s.font_obj, "font_name": font.name, "font_size_pt": abs(s.size) * math.hypot(*times(tm, s.ctm)[2:4]), "in_form": form_depth > 0, "in_annotation": in_annotation, "mapping_untrusted": font.untrusted,
                    "actual_text_frame": frame and frame[0], "actual_text": frame and frame[1], "frame_first": first, "vertical": font.encoding.endswith("-V"), "x": m[4], "y": m[5], "w": abs(wide * m[0]), "h": abs(m[3]), "scale_x": m[0], "shear_y": m[1], "fill": s.mode % 4 in (0, 2), "stroke": s.mode % 4 in (1, 2), "fill_alpha": s.fill_alpha, "stroke_alpha": s.stroke_alpha, "in_clip": inside,
                }))
                tm = times((1, 0, 0, 1, advance, 0), tm)

        def paint(fill: bool, stroke: bool) -> None:
            nonlocal path, clip_next
            if path:
                box = (min(p[0] for p in path), min(p[1] for p in path), max(p[0] for p in path), max(p[1] for p in path))
                if fill or stroke:
                    self.work.add("PAINTED_VECTOR_PATH_COUNT")
                    drawn = stroke and s.stroke_alpha > 0 and not s.no_stroke
                    half = max(0.25, s.width * math.sqrt(abs(s.ctm[0] * s.ctm[3] - s.ctm[1] * s.ctm[2]))) / 2 if drawn else 0
                    seen = (box[0] - half, box[1] - half, box[2] + half, box[3] + half)
                    if drawn and not fill and len(path) == 2 and s.cap == 0:  # a line with butt ends reaches to its sides only
                        (ax, ay), (bx, by) = path
                        size = math.hypot(bx - ax, by - ay) or 1.0
                        dx, dy = half * abs(by - ay) / size, half * abs(bx - ax) / size
                        seen = (box[0] - dx, box[1] - dy, box[2] + dx, box[3] + dy)
                    shown = not in_annotation and not self.hidden and (fill and s.fill_alpha > 0 or drawn)
                    self.events.append(("path", self.clipped(seen, s) | {"kind": "both" if fill and stroke else "fill" if fill else "stroke", "shown": shown, "in_annotation": in_annotation, "fill_alpha": s.fill_alpha, "stroke_alpha": s.stroke_alpha}))
                if clip_next:
                    c = s.clip or box
                    s.clip = (max(c[0], box[0]), max(c[1], box[1]), min(c[2], box[2]), min(c[3], box[3]))
            path, clip_next = [], False

        point = lambda x, y: path.append((s.ctm[0] * x + s.ctm[2] * y + s.ctm[4], s.ctm[1] * x + s.ctm[3] * y + s.ctm[5]))
        while (x := reader.read()) is not None:
            if not isinstance(x, Operator):
                args.append(x)
                continue
            op, a, args = str(x), args, []
            try:
                if op == "q":
                    stack.append(State(**vars(s)))
                elif op == "Q" and stack:
                    s = stack.pop()
                elif op == "cm":
                    s.ctm = times(tuple(a[:6]), s.ctm)
                elif op == "gs":
                    g = doc.get((doc.get(resources.get("ExtGState"), {})).get(a[0]), {})
                    s.fill_alpha, s.stroke_alpha = float(doc.get(g.get("ca"), s.fill_alpha)), float(doc.get(g.get("CA"), s.stroke_alpha))
                elif op == "w":
                    s.width = a[0]
                elif op == "J":
                    s.cap = a[0]
                elif op == "d":
                    dashes = [v for v in a[0] if isinstance(v, (int, float))]
                    s.no_stroke = bool(dashes) and min(dashes) >= 0 and sum(dashes) == 0
                elif op == "BT":
                    tm = line = (1, 0, 0, 1, 0, 0)
                elif op == "Tf":
                    s.font, s.font_obj = self.font(doc.get(resources.get("Font"), {}).get(a[0]))
                    s.size = a[1]
                elif op in ("Tc", "Tw", "TL", "Ts", "Tr"):
                    setattr(s, {"Tc": "char", "Tw": "word", "TL": "lead", "Ts": "rise", "Tr": "mode"}[op], a[0])
                elif op == "Tz":
                    s.scale = a[0] / 100
                elif op in ("Td", "TD"):
                    s.lead = -a[1] if op == "TD" else s.lead
                    tm = line = times((1, 0, 0, 1, a[0], a[1]), line)
                elif op == "Tm":
                    tm = line = tuple(a[:6])
                elif op == "T*":
                    tm = line = times((1, 0, 0, 1, 0, -s.lead), line)
                elif op in ("Tj", "'", '"'):
                    if op == '"':
                        s.word, s.char = a[0], a[1]
                    if op != "Tj":
                        tm = line = times((1, 0, 0, 1, 0, -s.lead), line)
                    show(a[-1])
                elif op == "TJ":
                    for v in a[0]:
                        if isinstance(v, bytes):
                            show(v)
                        else:
                            tm = times((1, 0, 0, 1, -v / 1000 * s.size * s.scale, 0), tm)
                elif op in ("m", "l"):
                    point(*a[:2])
                elif op in ("c", "v", "y"):
                    for k in range(0, len(a) - 1, 2):
                        point(a[k], a[k + 1])
                elif op == "re":
                    for dx, dy in ((0, 0), (a[2], 0), (a[2], a[3]), (0, a[3])):
                        point(a[0] + dx, a[1] + dy)
                elif op in ("W", "W*"):
                    clip_next = True
                elif op in ("f", "F", "f*", "S", "s", "B", "B*", "b", "b*", "n"):
                    paint(op[0] in "fFBb", op[0] in "SsBb")
                elif op == "sh":
                    self.work.add("PAINTED_VECTOR_PATH_COUNT")
                    shown = not in_annotation and not self.hidden and s.fill_alpha > 0
                    self.events.append(("path", self.clipped(s.clip or (-1e9, -1e9, 1e9, 1e9), s) | {"kind": "shading", "shown": shown, "in_annotation": in_annotation, "fill_alpha": s.fill_alpha, "stroke_alpha": 0.0}))
                elif op in ("BDC", "BMC"):
                    props = a[1] if len(a) > 1 else {}
                    entry = doc.get(resources.get("Properties"), {}).get(props) if isinstance(props, Name) else props
                    props = doc.get(entry)
                    if self.hidden:
                        self.hidden += 1
                    elif a[:1] == [Name("OC")] or self.layers.is_reference(entry):
                        self.hidden += not self.layer(entry if isinstance(props, dict) and props else None)
                    actual = doc.get(props.get("ActualText")) if isinstance(props, dict) else None
                    self.frame_no += 1
                    self.frames.append((self.frame_no, string(actual)) if isinstance(actual, bytes) else None)
                elif op == "EMC":
                    self.hidden -= self.hidden > 0
                    if self.frames:
                        self.frames.pop()
                elif op == "Do":
                    self.external(doc.get(doc.get(resources.get("XObject"), {}).get(a[0])), resources, s, form_depth, in_annotation)
                elif op == "BI":
                    end = re.compile(rb"\sEI(?=[\s]|$)").search(data, reader.at)
                    reader.at = end.end() if end else len(data)
                    self.image(s, None, in_annotation)
            except (IndexError, TypeError, AttributeError, KeyError, ZeroDivisionError, OverflowError):
                doc.recovered += 1

    def external(self, x, resources, s, form_depth, in_annotation) -> None:
        if not isinstance(x, Stream):
            self.doc.recovered += 1
        elif x.entries.get("Subtype") == "Image":
            self.image(s, x.entries.get("OC"), in_annotation)
        elif form_depth < 32:
            layer = x.entries.get("OC")
            hidden = isinstance(self.doc.get(layer), dict) and not self.layer(layer)
            self.hidden += hidden
            matrix = tuple(self.doc.get(v) for v in self.doc.get(x.entries.get("Matrix"), (1, 0, 0, 1, 0, 0)))
            inner = State(**vars(s))
            inner.ctm = times(matrix, s.ctm)
            try:
                self.run(self.doc.decoded(x), self.doc.get(x.entries.get("Resources"), resources), inner, form_depth + 1, in_annotation)
            finally:
                self.hidden -= hidden

    def image(self, s: State, layer, in_annotation: bool) -> None:
        self.work.add("IMAGE_COUNT")
        shown = not in_annotation and not self.hidden and s.fill_alpha > 0
        if isinstance(self.doc.get(layer), dict):
            shown &= self.layer(layer)
        m = s.ctm
        seen = [(m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))]
        for box in (self.crop, s.clip):
            seen = cut_to(seen, box) if box and seen else seen
        area = polygon_area(seen) if seen else 0.0  # a turned image covers less than its bounds
        self.events.append(("image", self.clipped(bounds(m, 0, 0, 1, 1), s) | {"fill_alpha": s.fill_alpha, "shown": shown, "in_annotation": in_annotation, "area": area}))

    @staticmethod
    def clipped(box, s: State) -> dict:
        c = s.clip or box
        return dict(zip(("x0", "y0", "x1", "y1"), (max(box[0], c[0]), max(box[1], c[1]), min(box[2], c[2]), min(box[3], c[3])), strict=True))


def string(b: bytes) -> str:
    """A text string of the document."""
    if b.startswith(b"\xfe\xff"):
        return b[2:].decode("utf-16-be", "replace")
    return b[3:].decode("utf-8", "replace") if b.startswith(b"\xef\xbb\xbf") else b.decode("latin-1")


def page_list(doc: Document) -> list[dict]:
    """The pages, with what they inherit."""
    out, seen = [], set()
    stack = [(doc.get(doc.trailer["Root"]).get("Pages"), {})]
    while stack:
        value, above = stack.pop()
        key = value.number if isinstance(value, Ref) else None
        node = doc.get(value)
        if not isinstance(node, dict) or key in seen:
            doc.recovered += 1
            continue
        seen.add(key)
        own = above | {k: node[k] for k in ("Resources", "MediaBox", "CropBox", "Rotate") if k in node}
        kids = doc.get(node.get("Kids"))
        if isinstance(kids, list):
            stack += [(k, own) for k in reversed(kids)]
        else:
            out.append(node | own)
    return out


def document_events(doc: Document, work: Work):
    """Nodes of the form tree, the name tree and associated files; flags of the catalog."""
    root = doc.get(doc.trailer["Root"])
    form = doc.get(root.get("AcroForm"))
    names = doc.get(doc.get(root.get("Names"), {}).get("EmbeddedFiles")) if isinstance(doc.get(root.get("Names"), {}), dict) else None
    fields = doc.get(form.get("Fields")) if isinstance(form, dict) else None
    yield "catalog", {"xfa": isinstance(form, dict) and "XFA" in form, "portfolio": isinstance(doc.get(root.get("Collection")), dict), "form_complete": form is None or isinstance(fields, list)}
    start = [("form", k) for k in (fields if isinstance(fields, list) else [])] + ([("names", doc.get(root.get("Names"))["EmbeddedFiles"])] if names is not None else [])
    stack, number, seen = [(t, v, None, 0) for t, v in start], 0, set()
    while stack:
        tree, value, parent, depth = stack.pop()
        key = (tree, value.number) if isinstance(value, Ref) else None
        node, number = doc.get(value), number + 1
        work.add("DOCUMENT_SURFACE_COUNT")
        me = value.number if isinstance(value, Ref) else -number
        ok = isinstance(node, dict)
        yield "node", {"tree": tree, "node": me, "parent": parent, "is_dict": ok, "field_type": str(doc.get(node["FT"])) if ok and "FT" in node else None, "subtype": str(doc.get(node["Subtype"])) if ok and "Subtype" in node else None, "has_appearance": ok and "AP" in node, "names_len": len(doc.get(node.get("Names"), [])) if ok else 0}
        if ok and key not in seen and depth <= 64:
            stack += [(tree, k, me, depth + 1) for k in (doc.get(node.get("Kids"), []) or [])]
        seen.add(key)
    for k, v in enumerate(doc.get(root.get("AF"), []) or []):
        work.add("DOCUMENT_SURFACE_COUNT")
        yield "node", {"tree": "af", "node": k, "parent": None, "is_dict": isinstance(doc.get(v), dict), "field_type": None, "subtype": None, "has_appearance": False, "names_len": 0}


def numbers_of(doc: Document, value, n: int) -> list[float] | None:
    """n finite numbers, or None."""
    value = doc.get(value)
    found = [doc.get(v) for v in value] if isinstance(value, list) else []
    good = len(found) >= n and all(isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) for v in found[:n])
    return [float(v) for v in found[:n]] if good else None


def page_event(doc: Document, page: dict) -> dict:
    """Crop, rotation, and whether they are such that places on the page can be told."""
    box = next((b for k in ("CropBox", "MediaBox") if (b := numbers_of(doc, page.get(k), 4))), None)
    doc.recovered += box is None and ("CropBox" in page or "MediaBox" in page)
    box = box or [0.0, 0.0, 612.0, 792.0]
    crop = (min(box[0], box[2]), min(box[1], box[3]), abs(box[2] - box[0]), abs(box[3] - box[1]))
    turn = doc.get(page.get("Rotate"), 0)
    turn = int(turn) if isinstance(turn, (int, float)) and math.isfinite(turn) else 0
    return dict(zip(("crop_x", "crop_y", "crop_w", "crop_h"), crop, strict=True)) | {"rotation": turn % 360, "assessed": crop[2] > 0 and crop[3] > 0 and turn % 90 == 0}


def appearances(doc: Document, annotation: dict) -> list[tuple[int, Stream]]:
    """The streams of an annotation's appearances, each once, by object number."""
    out, table = {}, doc.get(annotation.get("AP"))
    for state in ("N", "R", "D") if isinstance(table, dict) else ():
        entry = table.get(state)
        found = doc.get(entry)
        for v in [entry] if isinstance(found, Stream) else found.values() if isinstance(found, dict) else ():
            if isinstance(doc.get(v), Stream):
                out[v.number if isinstance(v, Ref) else id(v)] = doc.get(v)
    return sorted(out.items())


def annotation_events(reader: PageReader, doc: Document, page: dict) -> None:
    listed = doc.get(page.get("Annots"))
    for k, ref in enumerate(listed if isinstance(listed, list) else ()):
        a = doc.get(ref)
        if not isinstance(a, dict):
            continue
        reader.work.add("ANNOTATION_COUNT")
        rect, flags = numbers_of(doc, a.get("Rect"), 4), doc.get(a.get("F"), 0)
        flags = flags if isinstance(flags, int) else 0
        where = dict(zip("xywh", (min(rect[0], rect[2]), min(rect[1], rect[3]), abs(rect[2] - rect[0]), abs(rect[3] - rect[1])), strict=True)) if rect else dict.fromkeys("xywh")
        layer = a.get("OC")
        layer = layer if isinstance(doc.get(layer), dict) else None
        reader.layer(layer)
        hidden = reader.layers.hidden(layer, "view") if layer is not None else None
        reader.events.append(("annotation", where | {"annot_no": k, "is_widget": doc.get(a.get("Subtype")) == "Widget", "invisible": bool(flags & 1), "hidden": bool(flags & 2), "no_view": bool(flags & 32), "oc_present": layer is not None, "oc_hidden": hidden, "oc_unknown": layer is not None and hidden is None}))
        for number, s in appearances(doc, a):
            reader.work.add("ANNOTATION_APPEARANCE_STREAM_COUNT")
            reader.events.append(("appearance", {"annot_no": k, "stream_obj": number}))
            resources = doc.get(s.entries.get("Resources"), {})
            reader.run(doc.decoded(s), resources if isinstance(resources, dict) else {}, State(), 0, True)


def file_events(data: bytes, spec: str | None = None, most_pages: int = 1000, limits: dict[str, int] | None = None):
    """(page_number, kind, payload) of a file; raises PdfError if it has no report."""
    doc = Document(data)
    found = page_list(doc)
    if not found:
        raise PdfError("PDF contains no pages")
    if len(found) > most_pages:
        raise PdfError(f"PDF exceeds the configured page limit of {most_pages}")
    if doc.security and not doc.security.extraction_allowed:
        raise PdfError(NOT_ALLOWED)
    chosen, out, work = selections.resolve(spec, len(found)), [], Work(limits)
    layers = Layers(doc, doc.get(doc.trailer["Root"]))
    for n in chosen:
        page = found[n - 1]
        out.append((n, "page", page_event(doc, page)))
        work.page()
        reader = PageReader(doc, work, layers)
        crop = out[-1][2]
        reader.crop = (crop["crop_x"], crop["crop_y"], crop["crop_x"] + crop["crop_w"], crop["crop_y"] + crop["crop_h"])
        content = doc.get(page.get("Contents"), [])
        parts = [doc.get(c) for c in content] if isinstance(content, list) else [content]
        resources = doc.get(page.get("Resources"), {})
        reader.run(b"\n".join(doc.decoded(p) for p in parts if isinstance(p, Stream)), resources if isinstance(resources, dict) else {}, State())
        reader.hidden = 0
        annotation_events(reader, doc, page)
        out += [(n, *e) for e in reader.events]
    out = [(0, *e) for e in document_events(doc, work)] + out
    out.insert(0, (0, "file", {"page_count": len(found), "recovered": doc.recovered, "encrypted": doc.security is not None, "extraction_allowed": True, "size": len(data)}))
    return out


def _decoding(spec: str | None, most_pages: int, limits: dict[str, int] | None = None):
    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    rows = [(path, n, kind, i, json.dumps(payload), None) for i, (n, kind, payload) in enumerate(file_events(content.as_py(), spec, most_pages, limits))]
                except Exception as e:  # whatever is wrong with one file is a row of its own, and never ends a batch
                    limit = "HEAP" if isinstance(e, MemoryError) else "STACK" if isinstance(e, RecursionError) else getattr(e, "code", None)
                    said = str(e) if isinstance(e, PdfError) else f"Could not audit PDF: {type(e).__name__} {e}"
                    rows = [(path, 0, "error", 0, json.dumps({"limit": limit}), " ".join(said.split())[:500])]
                for at in range(0, len(rows), 10_000):
                    cols = list(zip(*rows[at : at + 10_000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], ["path", "page_number", "kind", "seq", "payload", "error"])

    return run


def decode(spark: SparkSession, folder: str, page_selection: str | None = None, most_bytes: int = 100 << 20, most_pages: int = 1000, limits: dict[str, int] | None = None) -> DataFrame:
    """EVENTS of all *.pdf files below folder. Files that are too large, or can't be read, give one row of kind error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(folder)
    fit = files.filter(F.col("length") <= most_bytes).select("path", "content").mapInArrow(_decoding(page_selection, most_pages, limits), EVENTS)
    none = lambda t: F.lit(None).cast(t)
    large = files.filter(F.col("length") > most_bytes).select("path", F.lit(0).alias("page_number"), F.lit("error").alias("kind"), F.lit(0).cast("bigint").alias("seq"), none("string").alias("payload"), F.concat(F.lit("PDF exceeds the configured size limit of "), F.lit(str(most_bytes)), F.lit(" bytes")).alias("error"))
    return fit.unionByName(large)


def rows_of(events: DataFrame, kind: str, schema: str) -> DataFrame:
    """The events of a kind, with their payload as columns of a schema."""
    own = events.filter(F.col("kind") == kind)
    return own.select(F.col("path").alias("file_id"), "page_number", "seq", F.from_json("payload", schema).alias("p")).select("file_id", "page_number", "seq", "p.*")


GLYPH = "raw_unicode string, code_unicodes array<string>, code int, font_obj bigint, font_name string, font_size_pt float, in_form boolean, in_annotation boolean, mapping_untrusted boolean, actual_text_frame bigint, actual_text string, frame_first boolean, vertical boolean, x double, y double, w double, h double, scale_x double, shear_y double, fill boolean, stroke boolean, fill_alpha double, stroke_alpha double, in_clip boolean"
FONT = "font_obj bigint, name string, subtype string, encoding string, embedded boolean, damaged boolean, vertical boolean, to_unicode_present boolean, to_unicode_verdict string, subset boolean"
BOX = "kind string, x0 double, y0 double, x1 double, y1 double, shown boolean, in_annotation boolean, area double, fill_alpha double, stroke_alpha double"
PAGE = "crop_x double, crop_y double, crop_w double, crop_h double, rotation int, assessed boolean"
ANNOTATION = "annot_no int, is_widget boolean, hidden boolean, invisible boolean, no_view boolean, oc_present boolean, oc_hidden boolean, oc_unknown boolean, x double, y double, w double, h double"
REFERENCE = "node bigint, membership boolean, view boolean, print boolean, export boolean"
NODE = "tree string, node bigint, parent bigint, is_dict boolean, field_type string, subtype string, has_appearance boolean, names_len int"
CATALOG = "xfa boolean, portfolio boolean, form_complete boolean"
FILE = "page_count int, recovered int, encrypted boolean, extraction_allowed boolean, size bigint"


def text_glyphs(events: DataFrame) -> DataFrame:
    """Glyph rows of the text pass: those of annotations are left out."""
    return rows_of(events, "glyph", GLYPH).filter(~F.col("in_annotation")).withColumn("glyph_no", F.col("seq"))
