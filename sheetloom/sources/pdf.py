"""Page documents as a data source: a row for each page with its displayed size, and files that can't be opened told apart; and a sink for plain ones.

``spark.dataSource.register(PdfPages)``, then ``spark.read.format("pdf_pages").load(folder)``. A partition is a run of
files of bounded size. Only what tells pages is read of a file: cross-references, the page tree, boxes and
rotations; contents are neither decoded nor drawn.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes and files of a partition; a larger file is one of its own.
PART_BYTES, PART_FILES = 32 << 20, 256
#: Levels of a page tree, and tables of cross-references, beyond which a file counts as damaged.
DEEPEST = 64
PROTECTED, DAMAGED = "password-protected", "damaged"
_TOKEN = re.compile(rb"(?:[\x00\t\n\f\r ]|%[^\r\n]*)*(<<|>>|\[|\]|/[^\x00\t\n\f\r ()<>\[\]{}/%]*|\(|<[0-9A-Fa-f\s]*>|[^\x00\t\n\f\r ()<>\[\]{}/%]+)")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)\Z")


class Ref(int):
    """The number of an object that stands elsewhere."""


class _Scanner:
    """Values of the document language, one after another."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def token(self) -> bytes:
        m = _TOKEN.match(self.data, self.at)
        if not m:
            raise ValueError("no value")
        self.at = m.end()
        return m[1]

    def value(self) -> Any:
        t = self.token()
        if t == b"<<":
            found = {}
            while (k := self.token()) != b">>":
                found[k] = self.value()
            return found
        if t == b"[":
            items = []
            while True:
                before = self.at
                if self.token() == b"]":
                    return items
                self.at = before
                items.append(self.value())
        if t == b"(":
            return self._text()
        if _NUMBER.match(t):
            if t.isdigit():  # "12 0 R" is a reference
                before = self.at
                try:
                    if self.token().isdigit() and self.token() == b"R":
                        return Ref(t)
                except ValueError:
                    pass
                self.at = before
                return int(t)
            return float(t)
        return t

    def _text(self) -> bytes:
        depth, begin = 1, self.at
        while depth:
            c = self.data[self.at : self.at + 1]
            if not c:
                raise ValueError("a text without end")
            self.at += 2 if c == b"\\" else 1
            depth += (c == b"(") - (c == b")")
        return self.data[begin : self.at - 1]


class PdfFile:
    """Cross-references and pages of one file. Raises ValueError for a damaged one, PermissionError for a protected one."""

    def __init__(self, data: bytes):
        self.data, self.where, self.held, self.trailer = data, {}, {}, {}
        start = data.rfind(b"startxref")
        if b"%PDF-" not in data[:1024] or start < 0:
            raise ValueError("no page document")
        at, seen = _Scanner(data, start + 9).value(), set()
        while isinstance(at, int) and at not in seen and len(seen) < DEEPEST:
            seen.add(at)
            at = self._references(at)
        if b"Encrypt" in {k.lstrip(b"/") for k in self.trailer}:
            raise PermissionError(PROTECTED)

    def _references(self, at: int) -> int | None:
        """Take in the table or stream of references at a place, where none was known before; the place of the one before it."""
        scan = _Scanner(self.data, at)
        if self.data[at : at + 4] == b"xref":
            scan.at += 4
            while (t := scan.token()) != b"trailer":
                first, n = int(t), int(scan.token())
                for i in range(first, first + n):
                    place, _, kind = scan.token(), scan.token(), scan.token()
                    if kind == b"n":
                        self.where.setdefault(i, (1, int(place), 0))
            trailer = scan.value()
            if b"/XRefStm" in trailer:
                self._references(trailer[b"/XRefStm"])
        else:
            trailer, body = self._object(at)
            widths = trailer[b"/W"]
            size, index = sum(widths), trailer.get(b"/Index", [0, trailer[b"/Size"]])
            rows = iter(body[i : i + size] for i in range(0, len(body) - size + 1, size))
            for first, n in zip(index[::2], index[1::2], strict=True):
                for i, row in zip(range(first, first + n), rows, strict=False):
                    fields, done = [], 0
                    for k, w in enumerate(widths):
                        fields.append(int.from_bytes(row[done : done + w], "big") if w else int(k == 0))
                        done += w
                    if fields[0] in (1, 2):
                        self.where.setdefault(i, tuple(fields))
        self.trailer = trailer | self.trailer
        return trailer.get(b"/Prev")

    def _object(self, at: int) -> tuple[Any, bytes]:
        """The object that begins at a place, and its stream, decoded."""
        scan = _Scanner(self.data, at)
        scan.token(), scan.token()
        if scan.token() != b"obj":
            raise ValueError("no object")
        value, after = scan.value(), scan.at
        try:
            streams = scan.token() == b"stream"
        except ValueError:
            streams = False
        if not streams or not isinstance(value, dict):
            return value, b""
        begin = scan.at + (2 if self.data[scan.at : scan.at + 2] == b"\r\n" else 1)
        length = self.resolve(value.get(b"/Length"))
        body = self.data[begin : begin + length] if isinstance(length, int) else self.data[begin : self.data.index(b"endstream", after)]
        way = self.resolve(value.get(b"/Filter"))
        if way in (b"/FlateDecode", [b"/FlateDecode"]):
            body = zlib.decompressobj().decompress(body)
            parameters = self.resolve(value.get(b"/DecodeParms")) or {}
            parameters = parameters[0] if isinstance(parameters, list) else parameters
            if parameters.get(b"/Predictor", 1) >= 10:
                body = _unpredicted(body, parameters.get(b"/Columns", 1) * parameters.get(b"/Colors", 1))
        return value, body

    def resolve(self, value: Any) -> Any:
        """A value, or the object that a reference names; null for one that isn't there."""
        for _ in range(DEEPEST):
            if not isinstance(value, Ref):
                return None if value == b"null" else value
            if value not in self.held:
                self.held[value] = self._found(int(value))
            value = self.held[value]
        raise ValueError("references in a circle")

    def _found(self, number: int) -> Any:
        kind, place, order = self.where.get(number, (0, 0, 0))
        if kind == 0:
            return None
        if kind == 1:
            return self._object(place)[0]
        about, body = self._object(self.where[place][1])
        scan = _Scanner(body)
        heads = [(int(scan.token()), int(scan.token())) for _ in range(self.resolve(about[b"/N"]))]
        return _Scanner(body, self.resolve(about[b"/First"]) + heads[order][1]).value()

    def pages(self) -> list[tuple[float, float, int]]:
        """Displayed width and height, in points, and rotation of each page; boxes, rotations and units that a page lacks are its ancestors'."""
        root = self.resolve(self.trailer[b"/Root"])
        out: list[tuple[float, float, int]] = []
        self._walk(root[b"/Pages"], {}, out, 0)
        return out

    def _walk(self, node: Any, above: dict, out: list, depth: int) -> None:
        own = self.resolve(node)
        if not isinstance(own, dict) or depth > DEEPEST:
            raise ValueError("no page tree")
        known = above | {k: self.resolve(own[k]) for k in (b"/MediaBox", b"/CropBox", b"/Rotate") if self.resolve(own.get(k)) is not None}
        if b"/Kids" in own:
            for kid in self.resolve(own[b"/Kids"]):
                self._walk(kid, known, out, depth + 1)
            return
        box = lambda name: [float(self.resolve(x)) for x in known[name]] if name in known else None
        media = box(b"/MediaBox") or [0.0, 0.0, 612.0, 792.0]
        shown = _square(media)
        if crop := box(b"/CropBox"):
            a, b = _square(crop), shown
            cut = [max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])]
            shown = cut if cut[0] < cut[2] and cut[1] < cut[3] else shown
        unit = self.resolve(own.get(b"/UserUnit")) or 1
        turn = known.get(b"/Rotate", 0)
        turn = int(turn) % 360 if turn % 90 == 0 else 0
        width, height = (shown[2] - shown[0]) * unit, (shown[3] - shown[1]) * unit
        out.append((height, width, turn) if turn in (90, 270) else (width, height, turn))


def _square(box: list[float]) -> list[float]:
    return [min(box[0], box[2]), min(box[1], box[3]), max(box[0], box[2]), max(box[1], box[3])]


def _unpredicted(data: bytes, width: int) -> bytes:
    """Rows of bytes of which each tells how it follows from the one above and the bytes before it."""
    out, above = bytearray(), bytearray(width)
    for at in range(0, len(data), width + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + width])
        for i in range(len(row)):
            left, up, corner = (row[i - 1] if i else 0), above[i], (above[i - 1] if i else 0)
            if kind == 4:
                by = [abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)]
                guess = (left, up, corner)[by.index(min(by))]
            else:
                guess = (0, left, up, (left + up) // 2)[kind]
            row[i] = (row[i] + guess) & 255
        out += row
        above = row
    return bytes(out)


def _filesystem(path: str) -> tuple[Any, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


@dataclass
class _Files(InputPartition):
    paths: list[str]


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, where = _filesystem(self.path)
        found = files.get_file_info(fs.FileSelector(where, recursive=True)) if files.get_file_info(where).type == fs.FileType.Directory else [files.get_file_info(where)]
        parts: list[_Files] = []
        held = 0
        for f in sorted((f for f in found if f.is_file and f.path.lower().endswith(".pdf")), key=lambda f: f.path):
            if not parts or held + f.size > PART_BYTES or len(parts[-1].paths) >= PART_FILES:
                parts.append(_Files([]))
                held = 0
            parts[-1].paths.append(f.path)
            held += f.size
        return parts or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        files, _ = _filesystem(self.path)
        for path in partition.paths:
            with files.open_input_stream(path) as stream:
                data = stream.read()
            try:
                pages = PdfFile(data).pages()
            except PermissionError:
                yield path, None, None, None, None, None, PROTECTED
            except (ValueError, KeyError, IndexError, TypeError, AttributeError, zlib.error, RecursionError):
                yield path, None, None, None, None, None, DAMAGED
            else:
                for i, (width, height, turn) in enumerate(pages):
                    yield path, i + 1, len(pages), width, height, turn, None


class PdfPages(DataSource):
    """Rows (path, page, pages, width, height, rotation, error) of the files under a path whose names end in .pdf.

    A file that can't be opened has one row with an error: 'password-protected' if it is encrypted in any way, else 'damaged'.
    """

    @classmethod
    def name(cls) -> str:
        return "pdf_pages"

    def schema(self) -> str:
        return "path string, page int, pages int, width double, height double, rotation int, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])


@dataclass
class _Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    """Writes files under other names; they get their own when all tasks are done."""

    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator[Any]) -> WriterCommitMessage:
        files, where = _filesystem(self.path)
        files.create_dir(where, recursive=True)
        moves, name, held, kind = [], None, [], None

        def close() -> None:
            if held:
                moves.append((f"{where}/_{uuid.uuid4().hex}", f"{where}/{name}.pdf"))
                with files.open_output_stream(moves[-1][0]) as out:
                    out.write(_FORMS.get(kind, pdf_bytes)(held))

        for r in rows:
            if r["file"] != name:
                close()
                name, held = r["file"], []
                kind = r["kind"]
            held.append((r["width"], r["height"], r["rotation"], r["text"] or ""))
        close()
        return _Written(moves)

    def commit(self, messages: list[_Written | None]) -> None:
        files, _ = _filesystem(self.path)
        for m in messages:
            for temporary, final in m.moves if m else ():
                files.move(temporary, final)

    def abort(self, messages: list[_Written | None]) -> None:
        files, _ = _filesystem(self.path)
        for m in messages:
            for temporary, _ in m.moves if m else ():
                files.delete_file(temporary)


class PdfFiles(DataSource):
    """A sink for rows (file, kind, width, height, rotation, text), a page each: rows of a file lie together and in order in a partition.

    ``kind`` tells how a file is written: 'packed' with objects in compressed streams, 'protected' with an encryption entry, 'cut' short in
    the middle, anything else plainly.
    """

    @classmethod
    def name(cls) -> str:
        return "pdf_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def pdf_bytes(pages: list[tuple[float | None, float | None, int | None, str]], packed: bool = False, extra: bytes = b"") -> bytes:
    """A plain document of pages (width, height, rotation, text); what is null is left to the root of the tree, which has 612 x 792. ``packed`` puts objects into compressed streams."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>"}
    groups = [pages[i : i + 8] for i in range(0, len(pages), 8)]
    number, kids, streams = 2, [], {}
    for group in groups:
        number += 1
        own, mine = number, []
        for width, height, turn, text in group:
            number += 2
            box = b"" if width is None or height is None else f"/MediaBox [0 0 {width} {height}]".encode()
            turned = b"" if turn is None else f"/Rotate {turn}".encode()
            objects[number - 1] = b"<< /Type /Page /Parent %d 0 R %s %s /Contents %d 0 R >>" % (own, box, turned, number)
            streams[number] = zlib.compress(text.encode())
            mine.append(b"%d 0 R" % (number - 1))
        objects[own] = b"<< /Type /Pages /Parent 2 0 R /Count %d /Kids [%s] >>" % (len(mine), b" ".join(mine))
        kids.append(b"%d 0 R" % own)
    objects[2] = b"<< /Type /Pages /Count %d /MediaBox [0 0 612 792] /Kids [%s] >>" % (len(pages), b" ".join(kids))
    out, place = bytearray(b"%PDF-1.7\n"), {}

    def put(i: int, body: bytes) -> None:
        place[i] = len(out)
        out.extend(b"%d 0 obj\n" % i + body + b"\nendobj\n")

    for i, body in streams.items():
        put(i, b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(body) + body + b"\nendstream")
    if not packed:
        for i, body in objects.items():
            put(i, body)
        begin = len(out)
        out += b"xref\n0 %d\n0000000000 65535 f \n" % (number + 1) + b"".join(b"%010d 00000 n \n" % place[i] for i in range(1, number + 1))
        out += b"trailer\n<< /Size %d /Root 1 0 R %s >>\nstartxref\n%d\n%%%%EOF" % (number + 1, extra, begin)
        return bytes(out)
    heads, bodies = [], b""
    for i, body in objects.items():
        heads.append(b"%d %d" % (i, len(bodies)))
        bodies += body + b" "
    head = b" ".join(heads) + b" "
    packed_body = zlib.compress(head + bodies)
    put(number + 1, b"<< /Type /ObjStm /N %d /First %d /Length %d /Filter /FlateDecode >>\nstream\n" % (len(objects), len(head), len(packed_body)) + packed_body + b"\nendstream")
    begin = len(out)
    place[number + 2] = begin
    inside = {i: k for k, i in enumerate(objects)}
    rows = [b"\x00" * 7] + [(b"\x02" + (number + 1).to_bytes(4, "big") + inside[i].to_bytes(2, "big")) if i in inside else (b"\x01" + place[i].to_bytes(4, "big") + b"\x00\x00") for i in range(1, number + 3)]
    flat = zlib.compress(b"".join(b"\x02" + bytes((x - y) & 255 for x, y in zip(row, above, strict=True)) for row, above in zip(rows, [b"\x00" * 7, *rows], strict=False)))
    put(number + 2, b"<< /Type /XRef /Size %d /W [1 4 2] /Root 1 0 R %s /Length %d /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 7 >> >>\nstream\n" % (number + 3, extra, len(flat)) + flat + b"\nendstream")
    return bytes(out + b"startxref\n%d\n%%%%EOF" % begin)


_FORMS = {"packed": lambda pages: pdf_bytes(pages, packed=True), "protected": lambda pages: pdf_bytes(pages, extra=b"/Encrypt 1 0 R"), "cut": lambda pages: pdf_bytes(pages)[: len(pdf_bytes(pages)) // 2]}
