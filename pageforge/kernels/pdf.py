"""Pages of PDF files without decoding them: read, copied, turned and put together as they are.

Reads files with plain objects and with object streams; encrypted files are refused.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from typing import NamedTuple

import numpy as np


class Ref(NamedTuple):
    number: int


class Name(str):
    """A name, with its slash."""


class Stream(NamedTuple):
    head: dict
    body: bytes


_SKIP = re.compile(rb"(?:[\x00\t\n\x0c\r ]|%[^\r\n]*)*")
_REF = re.compile(rb"(\d+)\s+\d+\s+R(?![A-Za-z])")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
_WORD = re.compile(rb"/[^\x00\t\n\x0c\r ()<>\[\]{}/%]*|[A-Za-z'\"*]+")
_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b")


def parse(data: bytes, at: int):
    """The value at a place, and the place behind it; strings stay as they are written."""
    at = _SKIP.match(data, at).end()
    if data[at : at + 2] == b"<<":
        out, at = {}, _SKIP.match(data, at + 2).end()
        while data[at : at + 2] != b">>":
            key, at = parse(data, at)
            out[key], at = parse(data, at)
            at = _SKIP.match(data, at).end()
        return out, at + 2
    first = data[at : at + 1]
    if first == b"[":
        items, at = [], _SKIP.match(data, at + 1).end()
        while data[at : at + 1] != b"]":
            item, at = parse(data, at)
            items.append(item)
            at = _SKIP.match(data, at).end()
        return items, at + 1
    if first == b"(":
        depth, end = 1, at + 1
        while depth:
            c = data[end]
            end += 2 if c == 0x5C else 1
            depth += (c == 0x28) - (c == 0x29)
        return data[at:end], end
    if first == b"<":
        end = data.index(b">", at) + 1
        return data[at:end], end
    if m := _REF.match(data, at):
        return Ref(int(m[1])), m.end()
    if m := _NUMBER.match(data, at):
        return (float(m[0]) if b"." in m[0] else int(m[0])), m.end()
    m = _WORD.match(data, at)
    if not m or not m[0]:
        raise ValueError("malformed PDF")
    word = m[0].decode("latin-1")
    return (Name(word) if word[0] == "/" else {"true": True, "false": False, "null": None}.get(word, word)), m.end()


def written(value) -> bytes:
    if isinstance(value, dict):
        return b"<< " + b" ".join(k.encode("latin-1") + b" " + written(v) for k, v in value.items()) + b" >>"
    if isinstance(value, list):
        return b"[" + b" ".join(map(written, value)) + b"]"
    if isinstance(value, Stream):
        return written(value.head) + b"\nstream\n" + value.body + b"\nendstream"
    if isinstance(value, Ref):
        return b"%d 0 R" % value.number
    if isinstance(value, bool) or value is None:
        return {True: b"true", False: b"false", None: b"null"}[value]
    return value if isinstance(value, bytes) else str(value).encode("latin-1")


def unpacked(stream: Stream) -> bytes | None:
    """What a stream holds; None where it is coded in a way that is not read here."""
    kind = stream.head.get("/Filter")
    kind = kind[0] if isinstance(kind, list) and len(kind) == 1 else kind
    if kind is None or kind == []:
        return stream.body
    return zlib.decompressobj().decompress(stream.body) if kind == "/FlateDecode" and not stream.head.get("/DecodeParms") else None


class File:
    def __init__(self, data: bytes) -> None:
        self.objects: dict[int, object] = {}
        at, lengths, root = 0, {}, None
        while m := _OBJECT.search(data, at):
            value, at = parse(data, m.end())
            at = _SKIP.match(data, at).end()
            if isinstance(value, dict) and data[at : at + 6] == b"stream":
                at += 8 if data[at + 6 : at + 8] == b"\r\n" else 7
                size = value.get("/Length")
                if not isinstance(size, int) or b"endstream" not in data[at + size : at + size + 20]:
                    size = data.index(b"endstream", at) - at
                value = Stream({k: v for k, v in value.items() if k != "/Length"}, data[at : at + size])
                value.head["/Length"] = size
                at += size
                if value.head.get("/Type") == "/XRef":
                    root = value.head.get("/Root", root)
                    lengths |= {k: v for k, v in value.head.items() if k == "/Encrypt"}
            self.objects[int(m[1])] = value
        for m in re.finditer(rb"trailer\s*(?=<<)", data):
            head = parse(data, m.end())[0]
            root = head.get("/Root", root)
            lengths |= {k: v for k, v in head.items() if k == "/Encrypt"}
        if lengths:
            raise ValueError("encrypted PDF")
        for held in [o for o in self.objects.values() if isinstance(o, Stream) and o.head.get("/Type") == "/ObjStm"]:
            body = unpacked(held) or b""
            at, first = 0, held.head["/First"]
            for _ in range(held.head["/N"]):
                number, at = parse(body, at)
                place, at = parse(body, at)
                self.objects.setdefault(number, parse(body, first + place)[0])
        if root is None:
            raise ValueError("PDF without a root")
        self.pages: list[dict] = []
        self._collect(self.get(root)["/Pages"], {}, set())

    def get(self, value):
        while isinstance(value, Ref):
            value = self.objects.get(value.number)
        return value

    def _collect(self, ref, above: dict, seen: set) -> None:
        if ref in seen:
            return
        seen.add(ref)
        node = self.get(ref)
        own = above | {k: node[k] for k in ("/Resources", "/MediaBox", "/CropBox", "/Rotate") if k in node}
        if "/Kids" in node:
            for kid in self.get(node["/Kids"]):
                self._collect(kid, own, seen)
        else:
            self.pages.append(own | {k: v for k, v in node.items() if k != "/Parent"})

    def text(self, page: dict) -> str:
        """The strings that a page shows, byte by byte as Latin-1: enough to count characters, not to read every font."""
        parts = self.get(page.get("/Contents"))
        parts = [self.get(p) for p in parts] if isinstance(parts, list) else [parts]
        body = b"\n".join(unpacked(p) or b"" for p in parts if isinstance(p, Stream))
        out, held, at = [], [], _SKIP.match(body, 0).end()
        while at < len(body):
            try:
                value, at = parse(body, at)
            except (ValueError, IndexError):
                break
            if isinstance(value, str) and not isinstance(value, Name):
                if value in ("Tj", "TJ", "'", '"'):
                    flat = [y for x in held for y in (x if isinstance(x, list) else [x]) if isinstance(y, bytes)]
                    out += [_shown(y) for y in flat]
                held = []
                if value == "ID":  # the bytes of an image in the text of the page
                    at = body.find(b"EI", at) + 2 or len(body)
            else:
                held.append(value)
            at = _SKIP.match(body, at).end()
        return "".join(out)

    def image(self, page: dict) -> np.ndarray | None:
        """The page's picture as [height, width, (b, g, r)], where it is one lossless image of 8 bits."""
        held = self.get(self.get(page.get("/Resources", {})).get("/XObject", {})) or {}
        found = [x for x in map(self.get, held.values()) if isinstance(x, Stream) and x.head.get("/Subtype") == "/Image"]
        if len(found) != 1 or found[0].head.get("/BitsPerComponent") != 8:
            return None
        n = {"/DeviceRGB": 3, "/DeviceGray": 1}.get(str(self.get(found[0].head.get("/ColorSpace"))))
        body, h, w = unpacked(found[0]), found[0].head["/Height"], found[0].head["/Width"]
        if n is None or body is None or len(body) < h * w * n:
            return None
        return np.repeat(np.frombuffer(body, np.uint8)[: h * w * n].reshape(h, w, n), 3 // n, axis=2)[..., ::-1]


_ESCAPE = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _shown(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1")
    one = lambda m: bytes([int(m[1], 8) & 255]) if m[1] else _ESCAPE.get(m[2], b"" if m[2] in b"\r\n" else m[2])
    return re.sub(rb"\\(?:([0-7]{1,3})|(\r\n|.))", one, token[1:-1], flags=re.S).decode("latin-1")


def copied(parts: list[tuple[File, dict, int]], first: int, parent: Callable[[int], int]) -> tuple[list[bytes], list[int]]:
    """The objects of pages (file, page, degrees to turn it clockwise) with everything they refer to, numbered from `first`
    on, bytes of streams unchanged; and the numbers of the pages.  `parent` gives the number above the k-th page."""
    rows: list[bytes] = []
    kids, numbers = [], {}
    for k, (file, page, turn) in enumerate(parts):
        todo: list = []

        def moved(value, file=file, todo=todo):
            if isinstance(value, Ref):
                key = (id(file), value.number)
                if key not in numbers:
                    numbers[key] = first + len(rows)
                    rows.append(b"")
                    todo.append((numbers[key], file.objects.get(value.number)))
                return Ref(numbers[key])
            if isinstance(value, dict):
                return {k: moved(v) for k, v in value.items() if k != "/Parent"}
            if isinstance(value, list):
                return [moved(v) for v in value]
            return Stream(moved(value.head), value.body) if isinstance(value, Stream) else value

        own = moved(page) | {"/Parent": Ref(parent(k))}
        if turn % 360:
            own["/Rotate"] = ((file.get(page.get("/Rotate")) or 0) + turn) % 360
        kids.append(first + len(rows))
        rows.append(written(own))
        while todo:
            number, value = todo.pop()
            rows[number - first] = written(moved(value))
    return [b"%d 0 obj\n" % k + body + b"\nendobj\n" for k, body in enumerate(rows, first)], kids


def joined(parts: list[tuple[File, dict, int]]) -> bytes:
    """One file of pages (file, page, degrees to turn it clockwise), each with everything it refers to, bytes unchanged."""
    rows, kids = copied(parts, 3, lambda _: 2)
    tops = [{Name("/Type"): Name("/Catalog"), Name("/Pages"): Ref(2)}, {Name("/Type"): Name("/Pages"), Name("/Kids"): list(map(Ref, kids)), Name("/Count"): len(kids)}]
    rows = [b"%d 0 obj\n" % k + written(top) + b"\nendobj\n" for k, top in enumerate(tops, 1)] + rows
    out, places = bytearray(b"%PDF-1.5\n"), []
    for body in rows:
        places.append(len(out))
        out += body
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(rows) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(rows) + 1, start))
