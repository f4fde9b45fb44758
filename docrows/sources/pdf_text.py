"""A small decoder for PDF files, from the public specification: the page tree, Flate streams, text and path operators.

It reads simple fonts in Latin-1, and objects that stand alone or in object streams. Richer decoders are passed to
sources.documents as ``decode``.
"""

from __future__ import annotations

import re
import zlib

_STREAM = re.compile(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\n?endstream", re.S)
_SHOW = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\[|\]|[-+]?[0-9]*\.?[0-9]+|[A-Za-z'\"*]+", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|.)", re.S)
_PLAIN = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1")
    code = lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _PLAIN.get(m[1], m[1])
    return _ESCAPE.sub(code, token[1:-1]).decode("latin-1")


_OBJECT = re.compile(rb"(?:^|[\r\n\s])(\d+)\s+\d+\s+obj\b(.*?)(?=endobj)", re.S)
_REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R")


def shown(body: bytes) -> str:
    """Text that a content stream shows; lines end where the text position moves on."""
    text, args = [], []
    for token in _SHOW.findall(body):
        if token[:1] in b"(<":
            args.append(_string(token))
        elif token in (b"Tj", b"TJ"):
            text.append("".join(args))
            args = []
        elif token in (b"'", b'"'):
            text.append("\n" + "".join(args))
            args = []
        elif token in (b"Td", b"TD", b"T*", b"Tm", b"ET"):
            text.append("\n")
            args = []
        elif token.isalpha():
            args = []
    return re.sub(r"\n+", "\n", "".join(text)).strip()


def stream(piece: bytes) -> bytes:
    """The inflated streams of an object, or of a whole file, one after the other; one that can't be inflated is empty."""
    out = []
    for head, body in _STREAM.findall(piece):
        if b"FlateDecode" in head:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        out.append(body)
    return b"\n".join(out)


def _packed(body: bytes) -> dict[int, bytes]:
    """The objects in an object stream, by number. Its head has their numbers and places, in pairs."""
    data, first = stream(body), re.search(rb"/First\s+(\d+)", body)
    head = [int(x) for x in re.findall(rb"\d+", data[: int(first[1])])] if first else []
    begins = sorted(zip(head[1::2], head[::2]))
    ends = [*(at for at, _ in begins[1:]), len(data)]
    return {n: data[int(first[1]) + at : int(first[1]) + end] for (at, n), end in zip(begins, ends)}


class PdfPages:
    """The pages of a file in the order of its page tree, blank ones too. A page is decoded when it is asked for."""

    def __init__(self, content: bytes):
        self.objects = {int(n): body for n, body in _OBJECT.findall(content)}
        for body in [b for b in self.objects.values() if re.search(rb"/Type\s*/ObjStm\b", b)]:
            self.objects = _packed(body) | self.objects
        self.tree: list[tuple[int, ...]] = []  # each page with the nodes above it, nearest first
        roots = [n for n, body in self.objects.items() if re.search(rb"/Type\s*/Pages\b", body) and not re.search(rb"/Parent\b", body)]
        todo, seen = [(n,) for n in roots[:1]], set()
        while todo:
            path = todo.pop(0)
            body = self.objects.get(path[0], b"")
            if path[0] in seen:
                continue
            seen.add(path[0])
            if re.search(rb"/Type\s*/Pages\b", body):
                todo = [(k, *path) for k in self._references(body, rb"/Kids")] + todo
            elif re.search(rb"/Type\s*/Page\b", body):
                self.tree.append(path)
        bare = () if self.tree else (shown(x) for x in (stream(m[0]) for m in _STREAM.finditer(content)) if b"BT" in x)
        self.bare = [t for t in bare if t]  # without a tree, each content stream that shows text, in file order

    @staticmethod
    def _references(body: bytes, key: bytes) -> list[int]:
        return [int(x) for m in re.findall(key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body) for x in _REFERENCE.findall(m)]

    def __len__(self) -> int:
        return len(self.tree) or len(self.bare)

    def content(self, page: int) -> bytes:
        return b"\n".join(stream(self.objects.get(k, b"")) for k in self._references(self.objects[self.tree[page][0]], rb"/Contents"))

    def text(self, page: int) -> str:
        return shown(self.content(page)) if self.tree else self.bare[page]

    def _inherited(self, page: int, pattern: bytes) -> re.Match | None:
        return next((m for n in self.tree[page] if (m := re.search(pattern, self.objects.get(n, b""), re.S))), None)

    def _widths(self, page: int) -> dict[str, dict[int, float]]:
        """Glyph widths in thousandths by font name and code, where the fonts say them."""
        found = self._inherited(page, rb"/Resources\s*(\d+)\s+\d+\s+R|/Resources\s*(<<.*)")
        body = (self.objects.get(int(found[1]), b"") if found[1] else found[2]) if found else b""
        fonts = re.search(rb"/Font\s*(?:(\d+)\s+\d+\s+R|<<(.*?)>>)", body, re.S)
        listed = (self.objects.get(int(fonts[1]), b"") if fonts[1] else fonts[2]) if fonts else b""
        out = {}
        for name, n in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", listed):
            font = self.objects.get(int(n), b"")
            first, given = re.search(rb"/FirstChar\s+(\d+)", font), re.search(rb"/Widths\s*(?:\[([^\]]*)\]|(\d+)\s+\d+\s+R)", font)
            if first and given:
                numbers = given[1] if given[1] is not None else self.objects.get(int(given[2]), b"")
                out[name.decode("latin-1")] = {int(first[1]) + k: float(x) for k, x in enumerate(re.findall(rb"[-+]?[0-9.]+", numbers))}
        return out

    def layout(self, page: int) -> tuple[list[tuple[float, float, float, float, str]], list[tuple[float, float, float, float]]]:
        """Words (x0, x1, top, bottom, text) and drawn lines (x0, y0, x1, y1) of a page, in points from its upper left corner."""
        if not self.tree:
            return [], []
        box = self._inherited(page, rb"/MediaBox\s*\[([^\]]*)\]")
        left, _, _, upper = [float(x) for x in box[1].split()] if box else (0, 0, 612, 792)
        words, rules = _drawn(self.content(page), self._widths(page))
        return [(a - left, b - left, upper - t, upper - u, text) for a, b, t, u, text in words], [(a - left, upper - b, c - left, upper - d) for a, b, c, d in rules]


_TOKEN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)|[A-Za-z'\"*]+", re.S)
_PAINT = {"S", "s", "f", "F", "f*", "B", "B*", "b", "b*"}
_UNIT = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def _times(m: tuple[float, ...], n: tuple[float, ...]) -> tuple[float, ...]:
    """The transformation m, then n."""
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


def _at(x: float, y: float, m: tuple[float, ...]) -> tuple[float, float]:
    return x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5]


def _drawn(body: bytes, widths: dict[str, dict[int, float]]) -> tuple[list, list]:
    """Words (x0, x1, top, bottom, text) and lines of a content stream, y upwards. Glyphs of unknown width are half as wide as high."""
    glyphs: list[tuple[float, float, float, float, str]] = []  # x0, x1, baseline, size, character
    rules, path, here, begun = [], [], (0.0, 0.0), (0.0, 0.0)
    ctm, saved, tm, tlm = _UNIT, [], _UNIT, _UNIT
    font, size, lead, spread, wide, scale = "", 12.0, 0.0, 0.0, 0.0, 1.0
    args: list = []

    def show(parts: list) -> None:
        nonlocal tm
        for part in parts:
            if isinstance(part, float):
                tm = _times((1, 0, 0, 1, -part / 1000 * size * scale, 0), tm)
                continue
            for ch in part:
                w = (widths.get(font, {}).get(ord(ch), 500.0) / 1000 * size + spread + (wide if ch == " " else 0)) * scale
                m = _times(tm, ctm)
                (x0, y), (x1, _) = _at(0, 0, m), _at(w, 0, m)
                glyphs.append((x0, x1, y, abs(size * m[3]) or size, ch))
                tm = _times((1, 0, 0, 1, w, 0), tm)

    def line_to(dx: float, dy: float) -> None:
        nonlocal tm, tlm
        tm = tlm = _times((1, 0, 0, 1, dx, dy), tlm)

    for token in _TOKEN.findall(body):
        if token[:1] in b"(<":
            args.append(_string(token))
            continue
        if token[:1] == b"/":
            args.append(token[1:].decode("latin-1"))
            continue
        if token[:1] in b"[]":
            continue
        op = token.decode("latin-1")
        if op[-1].isdigit() or op[-1] == ".":
            args.append(float(op))
            continue
        n = [x for x in args if isinstance(x, float)]
        try:
            if op == "q":
                saved.append((ctm, font, size, lead, spread, wide, scale))
            elif op == "Q" and saved:
                ctm, font, size, lead, spread, wide, scale = saved.pop()
            elif op == "cm":
                ctm = _times(tuple(n[-6:]), ctm)
            elif op == "BT":
                tm = tlm = _UNIT
            elif op == "Tf":
                font, size = str(args[-2]), n[-1]
            elif op == "Tm":
                tm = tlm = tuple(n[-6:])
            elif op in ("Td", "TD"):
                lead = -n[-1] if op == "TD" else lead
                line_to(n[-2], n[-1])
            elif op == "T*":
                line_to(0, -lead)
            elif op == "TL":
                lead = n[-1]
            elif op == "Tc":
                spread = n[-1]
            elif op == "Tw":
                wide = n[-1]
            elif op == "Tz":
                scale = n[-1] / 100
            elif op in ("Tj", "TJ"):
                show(args)
            elif op in ("'", '"'):
                line_to(0, -lead)
                show(args[-1:])
            elif op == "m":
                here = begun = _at(n[-2], n[-1], ctm)
            elif op == "l":
                to = _at(n[-2], n[-1], ctm)
                path.append((*here, *to))
                here = to
            elif op == "h":
                path.append((*here, *begun))
            elif op == "re":
                (a, b), (c, d) = _at(n[-4], n[-3], ctm), _at(n[-4] + n[-2], n[-3] + n[-1], ctm)
                path += [(a, b, c, b), (a, d, c, d), (a, b, a, d), (c, b, c, d)]
            elif op in _PAINT or op == "n":
                rules += [r for r in path if op != "n" and (abs(r[0] - r[2]) < 1 or abs(r[1] - r[3]) < 1)]
                path = []
        except (IndexError, ValueError, TypeError):
            pass  # an operator without what it needs draws nothing
        args = []
    return _words(glyphs), rules


def _words(glyphs: list[tuple[float, float, float, float, str]]) -> list[tuple[float, float, float, float, str]]:
    """Glyphs that follow each other on a line, without white space between, are a word."""
    out: list[list] = []
    end = None  # x1, baseline and size of the word's last glyph
    for x0, x1, y, size, ch in glyphs:
        if ch.isspace():
            end = None
            continue
        if end and abs(y - end[1]) < 0.3 * size and -0.3 * size < x0 - end[0] < 0.2 * size:
            out[-1][1], out[-1][4] = x1, out[-1][4] + ch
        else:
            out.append([x0, x1, y + 0.8 * size, y - 0.2 * size, ch])
        end = (x1, y, size)
    return [tuple(w) for w in out]


def pages(content: bytes) -> list[str]:
    """Text of each page, blank ones too."""
    file = PdfPages(content)
    return [file.text(k) for k in range(len(file))]
