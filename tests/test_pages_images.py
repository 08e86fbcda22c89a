import struct
import zlib

import pytest

from sheetloom.sources import images, pdf


def opened(data):
    try:
        return pdf.PdfFile(data).pages()
    except PermissionError:
        return pdf.PROTECTED
    except (ValueError, KeyError, IndexError, TypeError, AttributeError, zlib.error, RecursionError):
        return pdf.DAMAGED


PAGES = [(100.5, 200, 0, "a"), (None, None, 90, "(b\\"), (300, 400, 450, "c" * 900), (10, 20, None, "")] * 5
SIZES = [(100.5, 200, 0), (792, 612, 90), (400, 300, 90), (10, 20, 0)] * 5


@pytest.mark.parametrize("packed", [False, True])
def test_pages_of_written_documents(packed):
    data = pdf.pdf_bytes(PAGES, packed)
    assert opened(data) == SIZES
    assert opened(b"junk before\n" + data) == pdf.DAMAGED  # places no longer fit
    assert opened(pdf.pdf_bytes(PAGES, packed, b"/Encrypt << /Filter /Standard >>")) == pdf.PROTECTED
    for cut in range(0, len(data) - 8, 97):
        assert opened(data[:cut]) == pdf.DAMAGED
    assert opened(data.replace(b"/Root", b"/Boot")) == pdf.DAMAGED and opened(b"") == pdf.DAMAGED and opened(pdf.pdf_bytes([])) == []


def hand(objects, trailer=b"/Root 1 0 R", more=b""):
    out, place = bytearray(b"%PDF-1.4\n"), {}
    for i, body in objects.items():
        place[i] = len(out)
        out += b"%d 0 obj " % i + body + b" endobj\n"
    begin = len(out)
    out += b"xref\r\n0 1\n0000000000 65535 f \n" + b"".join(b"%d 1\n%010d 00000 n \n" % (i, at) for i, at in place.items())
    return bytes(out + b"trailer <<" + trailer + b">>\n" + more + b"startxref %d %%%%EOF" % begin), begin


def test_inherited_boxes_units_and_updates():
    tree = {
        1: b"<< /Type/Catalog /Pages 2 0 R /Names (odd \\) text (nested) >>) >>",
        2: b"<< /Kids [3 0 R 4 0 R] /MediaBox 7 0 R /Rotate 270 % remark\n /Count 3 >>",
        3: b"<< /Kids [5 0 R 6 0 R] /CropBox [10 10 60 5000] >>", 4: b"<</Parent 2 0 R/UserUnit 2/Rotate 0>>",
        5: b"<< /MediaBox [0 0 50 40] >>", 6: b"<< /Rotate -90 /CropBox [900 900 901 901] >>", 7: b"[100 0 0 8 0 R]", 8: b"30.5",
    }
    data, begin = hand(tree)
    assert opened(data) == [(30, 40, 270), (30.5, 100, 270), (200, 61, 0)]
    # A later part of the file that puts another object in place of one.
    at = len(data)
    newer = data + b"\n8 0 obj 20 endobj\nxref\n8 1\n%010d 00000 n \ntrailer << /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (at + 1, begin, at + 1 + len(b"8 0 obj 20 endobj\n"))
    assert opened(newer) == [(30, 40, 270), (20, 100, 270), (200, 40, 0)]
    assert opened(hand(tree | {3: b"<< /Kids [2 0 R] >>"})[0]) == pdf.DAMAGED  # a tree in a circle
    assert opened(hand(tree | {8: b"8 0 R"})[0]) == pdf.DAMAGED


def test_source(spark, tmp_path):
    for source in (pdf.PdfPages, pdf.PdfFiles):
        spark.dataSource.register(source)
    rows = [("x", "plain", 10.0, 20.0, 0, "t"), ("x", "plain", 30.0, 20.0, None, None), ("y", "cut", 1.0, 1.0, 0, ""), ("z", "protected", None, None, 0, "é"), ("w", "packed", None, None, 90, "é")]
    frame = spark.createDataFrame(rows, "file string, kind string, width double, height double, rotation int, text string")
    frame.repartition("file").write.format("pdf_files").mode("append").save(str(tmp_path / "a"))
    (tmp_path / "a/b").mkdir()
    (tmp_path / "a/b/EMPTY.PDF").write_bytes(b"")
    (tmp_path / "a/other.txt").write_bytes(b"%PDF-")
    read = lambda path: sorted(((r.path.rsplit("/", 1)[-1], r.page, r.pages, r.width, r.height, r.rotation, r.error) for r in spark.read.format("pdf_pages").load(path).collect()), key=str)
    assert read(str(tmp_path / "a")) == sorted([
        ("x.pdf", 1, 2, 10.0, 20.0, 0, None), ("x.pdf", 2, 2, 30.0, 20.0, 0, None), ("w.pdf", 1, 1, 792.0, 612.0, 90, None), ("y.pdf", None, None, None, None, None, "damaged"),
        ("z.pdf", None, None, None, None, None, "password-protected"), ("EMPTY.PDF", None, None, None, None, None, "damaged"),
    ], key=str)
    assert len(read(f"file://{tmp_path}/a/x.pdf")) == 2
    (tmp_path / "none").mkdir()
    assert read(str(tmp_path / "none")) == []


def exif(turn, order=">"):
    return struct.pack(order + "2sHIHHHIHHI", b"MM" if order == ">" else b"II", 42, 8, 1, 0x0112, 3, 1, turn, 0, 0)


def jpeg(width, height, *segments):
    part = lambda mark, body: b"\xff" + bytes([mark]) + struct.pack(">H", len(body) + 2) + body
    return b"\xff\xd8" + b"".join(part(*s) for s in segments) + b"\xff" + part(0xC2, struct.pack(">BHHB", 8, height, width, 3) + b"\x01\x22\x00" * 3) + b"\xff\xda"


def test_headers():
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480)
    assert images.header(png) == ("png", 640, 480, 1) and images.header(png[:-1]) == ("png", None, None, None)
    assert images.header(jpeg(30, 20)) == ("jpeg", 30, 20, 1)
    for order in "<>":
        for turn in range(1, 9):
            want = ("jpeg", 20, 30, turn) if turn >= 5 else ("jpeg", 30, 20, turn)
            assert images.header(jpeg(30, 20, (0xE0, b"JFIF\x00"), (0xE1, b"http://x\x00"), (0xE1, b"Exif\x00\x00" + exif(turn, order)), (0xC4, b"\x00"))) == want
    assert images.header(jpeg(30, 20, (0xE1, b"Exif\x00\x00" + exif(9)))) == ("jpeg", 30, 20, 1)
    assert images.header(jpeg(30, 20, (0xE1, b"Exif\x00\x00" + exif(6)[:12]))) == ("jpeg", 30, 20, 1)
    whole = jpeg(30, 20, (0xE1, b"Exif\x00\x00" + exif(6)))
    assert all(images.header(whole[:n]) == ("jpeg", None, None, None) for n in range(2, len(whole) - 2 - 9 - 1))
    assert images.header(b"\xff\xd8\xff\xda") == images.header(jpeg(0, 20)) == ("jpeg", None, None, None)
    riff = lambda kind, body: b"RIFF\x00\x00\x00\x00WEBP" + kind + struct.pack("<I", len(body)) + body
    assert images.header(riff(b"VP8 ", b"\x00\x00\x00\x9d\x01\x2a" + struct.pack("<HH", 0x4000 | 300, 200))) == ("webp", 300, 200, 1)
    assert images.header(riff(b"VP8L", b"\x2f" + struct.pack("<I", 299 | 199 << 14))) == ("webp", 300, 200, 1)
    canvas = riff(b"VP8X", b"\x08\x00\x00\x00" + (299).to_bytes(3, "little") + (199).to_bytes(3, "little"))
    assert images.header(canvas) == ("webp", 300, 200, 1) and images.header(canvas + b"EXIF" + struct.pack("<I", 26) + exif(8, "<")) == ("webp", 200, 300, 8)
    assert images.header(b"GIF89a") == images.header(None) == images.header(b"") == (None, None, None, None)


def test_headers_of_rows(spark):
    rows = spark.createDataFrame([(1, bytearray(jpeg(30, 20)), "x"), (2, None, None)], "image_id int, content binary, `odd name` string")
    got = images.with_headers(rows).orderBy("image_id").collect()
    assert [tuple(r) for r in got] == [(1, "x", "jpeg", 30, 20, 1), (2, None, None, None, None, None)]
    assert images.with_headers(rows.select("content")).count() == 2 and images.with_headers(rows.limit(0)).count() == 0
