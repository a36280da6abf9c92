"""Mail parsing, links and images."""

import base64
import struct

import pytest

from mailprism.functions import image as I
from mailprism.functions import links as L
from mailprism.operators.email_job import email_attachments, email_links, parse_emails, parse_message, text_of
from mailprism.sources.files import read_eml_tree
from pyspark.sql import functions as F

MULTIPART = b"""From: a@example.com
To: =?UTF-8?B?0J/RkdGC0YA=?= <b@example.org>
Subject: Report
Date: Mon, 5 Feb 2024 10:00:00 +0000
Message-ID: <1@example.com>
MIME-Version: 1.0
Content-Type: multipart/mixed; boundary="b"

--b
Content-Type: text/plain; charset="UTF-8"

see https://text.example.com/x) and http://a.example.com
--b
Content-Type: text/html; charset="UTF-8"

<a HREF='http://a.example.com'>a</a><a href=https://h.example.com/?q=1>b</a>
--b
Content-Type: text/plain
Content-Disposition: attachment

inside
--b
Content-Type: application/pdf; name="r.pdf"
Content-Transfer-Encoding: base64

aGVsbG8=
--b--
"""


def test_plain_message():
    got = parse_message(b'From: test@example.com\nSubject: Hello\nContent-Type: text/plain; charset="UTF-8"\n\nTest body with http://example.com/link')
    assert got["subject"] == "Hello" and "Test body" in got["text_body"] and "http://example.com/link" in got["links"]


def test_encoded_subject():
    assert parse_message(b"Subject: =?UTF-8?B?0J/RgNC40LLQtdGC?=\n\nHi")["subject"] == "Привет"


@pytest.mark.parametrize("charset, codec", [("windows-1251", "cp1251"), ("koi8-r", "koi8-r"), ("utf-8", "utf-8"), ("nonsense", "cp1251")])
def test_charsets(charset, codec):
    raw = f"Subject: T\nContent-Type: text/plain; charset={charset}\n\nПривет мир".encode(codec)
    assert "Привет мир" in parse_message(raw)["text_body"]


def test_eight_bit_header_and_body_without_charset():
    got = parse_message("Subject: Тема\n\nПривет\x00 мир ﬁ".encode())
    assert got["subject"] == "Тема" and got["text_body"] == "Привет мир fi"


def test_payload_that_its_encoding_cannot_have_stays_as_sent():
    got = parse_message(b"Content-Transfer-Encoding: base64\nContent-Type: text/plain; charset=koi8-r\n\n" + "Привет".encode("cp1251"))
    assert got["text_body"] == "оПХБЕР"


def test_body_charsets_by_their_bytes():
    assert text_of("мир".encode(), "rot13") == "мир"
    assert text_of("мир".encode("cp1251"), "utf-8") == "мир"
    assert text_of(b"\x98\xff", None) == b"\x98\xff".decode("koi8-r")


def test_empty_message():
    got = parse_message(b"")
    assert got["subject"] == "" and got["text_body"] == "" and got["links"] == [] and got["raw_headers"] == {}


def test_multipart_tables(spark):
    frame = spark.createDataFrame([(1, bytearray(MULTIPART)), (2, bytearray(b"")), (3, bytearray(b"\xff\xfe\x00:"))], "id int, raw binary")
    parsed = parse_emails(frame)
    rows = {r.id: r for r in parsed.collect()}
    first = rows[1]
    assert first.subject == "Report" and first.to_addr.startswith("Пётр") and first.message_id == "<1@example.com>"
    assert first.date.startswith("Mon") and first.raw_headers["Subject"] == "Report"
    assert "inside" not in first.text_body
    links = [(r.position, r.link) for r in email_links(parsed, "id").orderBy("position").collect()]
    assert links == [
        (0, "http://a.example.com"), (1, "https://h.example.com/?q=1"), (2, "https://text.example.com/x"),
    ]
    files = {r.filename: r for r in email_attachments(parsed, "id").collect()}
    assert set(files) == {"unnamed", "r.pdf"}
    assert (files["r.pdf"].size, files["r.pdf"].content_type) == (5, "application/pdf")
    assert files["r.pdf"].sha256 == "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"


def test_mail_tree(spark, tmp_path):
    for folder, name, body in [
        ("Spam_1", "a.eml", "Subject: x\n\nbuy"), ("easy_ham/deep_ham", "b.eml", "Content-Type: text/html\n\n<p>hi <b>you</b></p>"),
        ("ham", "c.eml", "Subject: blank\n\n  \n"), ("other", "d.eml", "Subject: y\n\nskip"),
    ]:
        path = tmp_path / folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    got = {(r.text, r.label, r.source, r.ai_assisted) for r in read_eml_tree(spark, str(tmp_path)).collect()}
    assert got == {("buy", 1, "human", 0), ("hi you", 0, "human", 0)}


def test_anchor_mismatch(spark):
    html = (
        '<a href="http://evil.example.com/x">www.bank.example.com</a><a href=\'https://www.bank.example.com\'>bank.example.com</a>'
        '<a href="https://bank.example.com"><b>click</b> here</a><a href="/rel">bank.example.com</a><a name=x>bank.example.com</a>'
    )
    frame = spark.createDataFrame([(html,)], "html string").select(F.explode(L.anchors("html")).alias("a"))
    got = [r.m for r in frame.select(L.anchor_mismatch("a.href", "a.text").alias("m")).collect()]
    assert got == [True, False, False, False]


def png(*chunks):
    data = b"\x89PNG\r\n\x1a\n"
    for kind, body in [(b"IHDR", struct.pack(">IIBBBBB", 3, 5, 8, 6, 0, 0, 0)), *chunks]:
        data += struct.pack(">I", len(body)) + kind + body + b"\0\0\0\0"
    return data


JPEG = b"\xff\xd8\xff\xe0\x00\x10JFIF\0\x01\x01\0\0\x01\0\x01\0\0\xff\xfe\x00\x04hi\xff\xc0\x00\x0b\x08\x00\x07\x00\x09\x01\x01\x11\0"


def test_image_facts_and_score(spark):
    images = [b"", b"junk", png(), png((b"tEXt", b"Author\0me"), (b"gAMA", b"\0\0\0\1")), JPEG, b"GIF89a\x04\0\x06\0", b"\xff\xd8\xff", b"\x89PNG\r\n\x1a\n"]
    frame = spark.createDataFrame([(i, bytearray(v)) for i, v in enumerate(images)], "i int, image binary")
    facts = I.with_image_facts(frame, "image").withColumn("qr", F.when(F.col("i") == 3, F.array(F.lit("q"))))
    rows = facts.select(
        "i", "format", "width", "height", "metadata_keys", "n_bytes", I.image_header("image").alias("h"),
        I.image_score("n_bytes", "decode_error", "metadata_keys", "qr").alias("score"),
        I.image_reason("n_bytes", "decode_error", "qr").alias("reason"),
    ).orderBy("i").collect()
    assert [r.score for r in rows] == [0.0, 0.0, 0.1, 0.25, 0.0, 0.0, 0.0, 0.0]
    assert [(r.format, r.width, r.height) for r in rows[2:6]] == [("PNG", 3, 5), ("PNG", 3, 5), ("JPEG", 9, 7), ("GIF", 4, 6)]
    assert (rows[2].h.width, rows[5].h.height) == (3, 6)
    assert rows[3].metadata_keys == ["Author", "gamma"] and "comment" in rows[4].metadata_keys
    assert rows[0].reason == I.REASON_EMPTY and rows[1].reason == I.REASON_BROKEN and rows[3].reason == I.REASON_QR


def test_image_payload(spark):
    data = base64.b64encode(b"\x00\x01pixels").decode()
    values = [data, f"data:image/png;base64,{data}", data[:4] + "\n " + data[4:], None, "", "abc", "YQ=", "YWI=", "abcd=", "a"]
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    got = [None if r.p is None else bytes(r.p) for r in frame.select(I.decode_image_payload("v", F.lit(None).cast("string")).alias("p")).collect()]
    assert got == [b"\x00\x01pixels"] * 3 + [b"", b"", None, None, b"ab", base64.b64decode("abcd"), None]


def test_png_of_impossible_size_is_undecodable(spark):
    head = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4s", 13, b"IHDR")
    rows = [(1, bytearray(head + struct.pack(">II", 0xFFFFFFFF, 5) + bytes(20))), (2, bytearray(head + struct.pack(">II", 7, 5) + bytes(20)))]
    frame = spark.createDataFrame(rows, "id int, image binary")
    facts = {r.id: r for r in I.with_image_facts(frame, "image").collect()}
    assert facts[1].decode_error and facts[1].width is None and (facts[2].width, facts[2].height) == (7, 5)
    heads = {r.id: r.h for r in frame.select("id", I.image_header("image").alias("h")).collect()}
    assert heads[1].format is None and heads[2].format == "PNG"


def tiff(order, tags, start=8, cut=None):
    """A file of one directory; `tags` are (tag, type, count, value)."""
    data = {"<": b"II*\0", ">": b"MM\0*"}[order] + struct.pack(order + "I", start) + bytes(max(0, start - 8))
    data += struct.pack(order + "H", len(tags))
    for tag, kind, count, value in tags:
        body = struct.pack(order + "HH", value, 0) if (kind, count) == (3, 1) else struct.pack(order + "I", value)
        data += struct.pack(order + "HHI", tag, kind, count) + body
    return (data + bytes(4) + struct.pack(order + "HHH", 8, 8, 8))[:cut]


def bmp(width, height, bits, size=40, compression=0, alpha=0):
    head = struct.pack("<IiiHHIIiiII", size, width, height, 1, bits, compression, 0, 0, 0, 0, 0)
    return b"BM" + bytes(12) + head + struct.pack("<IIII", 0, 0, 0, alpha) + bytes(80)


def webp(kind, body):
    return b"RIFF" + bytes(4) + b"WEBP" + kind + struct.pack("<I", len(body)) + body


def test_six_formats(spark):
    size = [(256, 3, 1, 7), (257, 4, 1, 9)]
    colours = 10 + 12 * 6 + 4  # where the three sample sizes lie behind six entries
    rgb = [*size, (258, 3, 3, colours), (262, 3, 1, 2), (277, 3, 1, 3), (282, 5, 1, 0)]
    cases = [
        (bmp(7, -9, 24), ("BMP", 7, 9, "RGB", ["compression", "dpi"])),
        (bmp(7, 9, 32, 124, 3, 0xFF000000), ("BMP", 7, 9, "RGBA", ["compression", "dpi"])),
        (b"BM" + bytes(12) + struct.pack("<IHHHH", 12, 7, 9, 1, 8), ("BMP", 7, 9, "P", ["compression"])),
        (webp(b"VP8 ", b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 7, 9)), ("WEBP", 7, 9, "RGB", ["background", "loop"])),
        (webp(b"VP8L", b"\x2f" + struct.pack("<I", 6 | 8 << 14)), ("WEBP", 7, 9, "RGB", ["background", "loop"])),
        (webp(b"VP8X", b"\x14\0\0\0" + b"\6\0\0\x08\0\0"), ("WEBP", 7, 9, "RGBA", ["background", "loop", "xmp"])),
        (tiff("<", rgb), ("TIFF", 7, 9, "RGB", ["compression"])),
        (tiff(">", rgb), ("TIFF", 7, 9, "RGB", ["compression"])),
        (tiff(">", [*size, (262, 3, 1, 1), (282, 5, 1, 0), (283, 5, 1, 0), (296, 3, 1, 1)], 300), ("TIFF", 7, 9, "1", ["compression", "resolution"])),
        (tiff("<", [*size, (258, 3, 1, 16), (262, 3, 1, 1), (282, 5, 1, 0), (283, 5, 1, 0)]), ("TIFF", 7, 9, "I;16", ["compression", "dpi", "resolution"])),
        (png((b"IDAT", b""), (b"tEXt", b"Late\0x")), ("PNG", 3, 5, "RGBA", [])),
        (JPEG, ("JPEG", 9, 7, "L", ["comment", "jfif", "jfif_density", "jfif_unit", "jfif_version"])),
        (b"GIF89a\x04\0\x06\0\x80", ("GIF", 4, 6, "P", ["version"])),
    ]
    broken = [
        tiff("<", size, cut=30), tiff("<", [(256, 3, 1, 7)]), tiff("<", []), b"II*\0\xff\xff\xff\xff", b"MM\0*\x7f\xff\xff\xff", b"II*\0", b"BM",
        b"RIFF", webp(b"VP8 ", bytes(10)), webp(b"ABCD", bytes(20)), bmp(0, 9, 24), bmp(7, 9, 24, 41), b"RIFF" + bytes(4) + b"WAVE" + bytes(20),
        b"\xff\xd8" + bytes(40), tiff("<", [(256, 4, 1, 2**32 - 1), (257, 4, 1, 2**32 - 1)]), None,
    ]
    rows = [(i, None if v is None else bytearray(v)) for i, v in enumerate([data for data, _ in cases] + broken)]
    facts = I.with_image_facts(spark.createDataFrame(rows, "i int, image binary"), "image").orderBy("i").collect()
    got = [(r.format, r.width, r.height, r.mode, r.metadata_keys) for r in facts[: len(cases)]]
    assert got == [want for _, want in cases]
    assert [r.i for r in facts[len(cases) : -1] if r.format is not None and r.width is not None] == []
    assert all(r.decode_error for r in facts[len(cases) : -2])
