"""Image payloads: decoding, header facts and score."""

from __future__ import annotations

import struct
from string import ascii_letters, digits

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailprism.functions.common import as_column, first_nonempty, let

# Weights and wording of the image score.
WEIGHT_NO_METADATA = 0.10
WEIGHT_QR = 0.25
REASON_EMPTY = "no image payload"
REASON_BROKEN = "image could not be decoded"
REASON_QR = "QR code detected"
REASON_NONE = "no QR code detected; AI-image score is heuristic"

IMAGE_FACTS = T.StructType(
    [
        T.StructField("format", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("mode", T.StringType()),
        T.StructField("metadata_keys", T.ArrayType(T.StringType())),
    ]
)


# Runs of characters outside base64. They are listed one by one, as Java then looks a character
# up in a table and not in one range after the other.
_FOREIGN = f"[^{ascii_letters}{digits}+/=]+"


def decode_image_payload(image_data: Column | str, image_base64: Column | str) -> Column:
    """Bytes of the first payload given: data-URL head cut off, base64 decoded.

    Characters outside the alphabet are ignored; missing padding gives NULL, and the message
    is then skipped as malformed. No payload gives zero bytes.
    """
    value = first_nonempty(image_data, image_base64)
    body = F.element_at(F.split(value, ",", 2), -1)

    # Payloads are large: each step is bound, so that none is computed once per use.
    def decoded(kept: Column) -> Column:
        def padded(bare: Column) -> Column:
            padding, rest = F.length(kept) - F.length(bare), F.length(bare) % 4
            whole = (rest == 0) | ((rest == 2) & (padding >= 2)) | ((rest == 3) & (padding >= 1))
            return F.when(whole, F.try_to_binary(bare, F.lit("base64")))

        return let(F.rtrim(kept, F.lit("=")), padded)

    return let(F.regexp_replace(body, _FOREIGN, ""), decoded)


def _big_endian(data: Column, start: int, size: int) -> Column:
    """An unsigned number; NULL beyond 31 bits, which no image has."""
    return F.conv(F.hex(F.substring(data, start, size)), 16, 10).try_cast("int")


def _number(digits: Column, little: Column | bool) -> Column:
    """The number that hexadecimal digits of at most four bytes write, in either byte order."""
    turned = F.concat(*[F.substring(digits, at, 2) for at in (7, 5, 3, 1)])
    if isinstance(little, bool):
        return F.conv(turned if little else digits, 16, 10).cast("long")
    return F.conv(F.when(little, turned).otherwise(digits), 16, 10).cast("long")


def _at(data: Column, start: Column | int, size: int, little: Column | bool = True) -> Column:
    """The unsigned number in `size` bytes from zero-based `start`; NULL beyond the end."""
    place = F.lit(start) if isinstance(start, int) else start
    whole = F.octet_length(data) >= place + size
    return F.when(whole, _number(F.hex(F.substring(data, (place + 1).cast("int"), F.lit(size))), little))


def _facts_struct(name: str, width: Column, height: Column, mode: Column, keys: Column) -> Column:
    """Header facts; NULL unless both sizes were read and no side is zero."""
    facts = F.struct(
        F.lit(name).alias("format"), width.try_cast("int").alias("width"), height.try_cast("int").alias("height"),
        mode.alias("mode"), keys.cast("array<string>").alias("metadata_keys"),
    )
    return F.when((width > 0) & (height > 0), facts)


def _keys(*named: tuple[str, Column | bool]) -> Column:
    """The names whose condition holds, sorted."""
    return F.array_sort(F.array_compact(F.array(*[F.when(F.lit(c) if isinstance(c, bool) else c, F.lit(n)) for n, c in named])))


# Colour type of a PNG header and the mode of its pixels.
_PNG_MODES = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}


def _png_mode(value: Column) -> Column:
    depth, colour = _at(value, 24, 1), _at(value, 25, 1)
    mode = F.when((colour == 0) & (depth == 1), F.lit("1")).when((colour == 0) & (depth == 16), F.lit("I;16"))
    mode = mode.when((colour == 4) & (depth == 16), F.lit("RGBA"))
    for code, name in _PNG_MODES.items():
        mode = mode.when(colour == code, F.lit(name))
    return mode


def _bmp(value: Column) -> Column:
    """Bitmaps: the size of the second header tells the layout; a negative height runs downwards."""
    size = _at(value, 14, 4)
    early, later = size == 12, size.isin(40, 52, 56, 64, 108, 124)
    signed = _at(value, 22, 4)
    height = F.when(signed >= 2**31, F.lit(2**32) - signed).otherwise(signed)
    bits = F.when(early, _at(value, 24, 2)).when(later, _at(value, 28, 2))
    alpha = (bits == 32) & (_at(value, 30, 4) == 3) & (size >= 56) & (_at(value, 66, 4) > 0)
    mode = F.when(bits.isin(1, 4, 8), F.lit("P")).when(alpha, F.lit("RGBA")).when(bits.isin(16, 24, 32), F.lit("RGB"))
    return _facts_struct(
        "BMP", F.when(early, _at(value, 18, 2)).when(later, _at(value, 18, 4)), F.when(early, _at(value, 20, 2)).when(later, height),
        mode, _keys(("compression", True), ("dpi", later)),
    )


def _webp(value: Column) -> Column:
    """WebP: the first chunk of the RIFF container is lossy, lossless or extended."""
    kind = F.hex(F.substring(value, 13, 4))
    lossy = (kind == "56503820") & (F.hex(F.substring(value, 24, 3)) == "9D012A")
    lossless = (kind == "5650384C") & (_at(value, 20, 1) == 0x2F)
    extended, flags = kind == "56503858", _at(value, 20, 1)
    packed = _at(value, 21, 4)
    width = (
        F.when(lossy, _at(value, 26, 2).bitwiseAND(0x3FFF)).when(lossless, packed.bitwiseAND(0x3FFF) + 1)
        .when(extended, _at(value, 24, 4).bitwiseAND(0xFFFFFF) + 1)
    )
    height = (
        F.when(lossy, _at(value, 28, 2).bitwiseAND(0x3FFF)).when(lossless, F.shiftright(packed, 14).bitwiseAND(0x3FFF) + 1)
        .when(extended, _at(value, 27, 2) + 65536 * _at(value, 29, 1) + 1)
    )
    alpha = (lossless & (packed.bitwiseAND(1 << 28) > 0)) | (extended & (flags.bitwiseAND(0x10) > 0))
    keys = _keys(
        ("background", True), ("loop", True), ("exif", extended & (flags.bitwiseAND(0x08) > 0)),
        ("icc_profile", extended & (flags.bitwiseAND(0x20) > 0)), ("xmp", extended & (flags.bitwiseAND(0x04) > 0)),
    )
    return _facts_struct("WEBP", width, height, F.when(alpha, F.lit("RGBA")).otherwise(F.lit("RGB")), keys)


def _tiff(value: Column) -> Column:
    """TIFF in either byte order: the entries of the first directory, wherever it lies.

    One directory is read, so chains that run in circles do no harm; one that does not lie
    inside the file makes the image unreadable.
    """
    little = F.hex(F.substring(value, 1, 2)) == "4949"
    size, start = F.octet_length(value), _at(value, 4, 4, little)
    start = F.when(start < size, start)
    n = _number(F.rpad(F.hex(F.substring(value, (start + 1).cast("int"), F.lit(2))), 4, "0"), False)
    n = F.when(little, n % 256 * 256 + F.floor(n / 256)).otherwise(n)
    inside = (start >= 8) & (n > 0) & (size >= start + 2 + 12 * n)
    slots = F.when(inside, F.transform(
        F.sequence(F.lit(0), (n - 1).cast("int")),
        lambda i: F.hex(F.substring(value, (start + 3).cast("int") + 12 * i, F.lit(12))),
    ))

    tags = (256, 257, 258, 259, 262, 277, 296, 338, 339, 282, 283, 34675)
    big = [f"{tag:04X}" for tag in tags]
    names = F.when(little, F.array(*[F.lit(t[2:] + t[:2]) for t in big])).otherwise(F.array(*[F.lit(t) for t in big]))

    def read(found: Column) -> Column:
        """The first value: in the entry if all fit four bytes, else where it points; -1 for other types."""
        kind = F.when(little, F.substring(found, 5, 2)).otherwise(F.substring(found, 7, 2))
        raw = F.substring(found, 17, 8)
        whole = _number(raw, little)
        short = F.when(little, whole % 65536).otherwise(F.floor(whole / 65536))
        place = F.when(whole < size, whole + 1).cast("int")
        far = _number(F.rpad(F.hex(F.substring(value, place, F.lit(2))), 8, "0"), little)
        far = F.when(little, far % 65536).otherwise(F.floor(far / 65536))
        byte = F.conv(F.substring(raw, 1, 2), 16, 10).cast("long")
        value_of = F.when(kind == "01", byte).when(kind == "04", whole)
        value_of = value_of.when(kind == "03", F.when(_number(F.substring(found, 9, 8), little) > 2, far).otherwise(short))
        return F.when(found.isNotNull(), value_of.otherwise(F.lit(-1)))

    def values(entries: Column) -> Column:
        def first(name: Column) -> Column:
            return F.get(F.filter(entries, lambda e: F.startswith(e, name)), F.lit(0))

        return let(F.transform(names, lambda name: let(first(name), read)), facts)

    def facts(numbers: Column) -> Column:
        number = {tag: F.get(numbers, F.lit(i)) for i, tag in enumerate(tags)}
        light, bits, samples = number[262], F.coalesce(number[258], F.lit(1)), F.coalesce(number[277], F.lit(1))
        grey, unit = light.isin(0, 1), number[296]
        mode = (
            F.when(grey & (samples == 2), F.lit("LA")).when(grey & (bits == 1), F.lit("1")).when(grey & (bits <= 8), F.lit("L"))
            .when(grey & (bits == 16), F.lit("I;16")).when(grey & (bits == 32) & (number[339] == 3), F.lit("F"))
            .when(grey & (bits == 32), F.lit("I"))
            .when((light == 2) & (samples == 4) & (F.coalesce(number[338], F.lit(2)) != 0), F.lit("RGBA")).when(light == 2, F.lit("RGB"))
            .when(light == 3, F.lit("P")).when(light == 5, F.lit("CMYK"))
            .when((light == 6) & number[259].isin(6, 7), F.lit("RGB")).when(light == 6, F.lit("YCbCr")).when(light == 8, F.lit("LAB"))
        )
        measured = number[282].isNotNull() & number[283].isNotNull()
        keys = _keys(
            ("compression", True), ("dpi", measured & (unit.isNull() | unit.isin(2, 3))),
            ("resolution", measured & (unit.isNull() | ~unit.isin(2, 3))), ("icc_profile", number[34675].isNotNull()),
        )
        return _facts_struct("TIFF", number[256], number[257], mode, keys)

    return let(slots, values)


def image_header(data: Column | str) -> Column:
    """Struct of format, width, height, mode and metadata keys, by native expressions.

    PNG, GIF, BMP and WebP are read at fixed places, TIFF by its first directory. The keys are
    NULL for PNG and GIF, whose chunks have to be walked. Palettes are not looked at, so the
    mode of a grey palette is P as well.
    """
    value = as_column(data)
    head = F.hex(F.substring(value, 1, 12))
    png = F.startswith(head, F.lit("89504E470D0A1A0A")) & (F.octet_length(value) >= 24)
    png = png & _big_endian(value, 17, 4).isNotNull() & _big_endian(value, 21, 4).isNotNull()
    gif = F.startswith(head, F.lit("474946383761")) | F.startswith(head, F.lit("474946383961"))
    gif = gif & (F.octet_length(value) >= 10)
    unknown = F.lit(None).cast("array<string>")
    fixed = F.struct(
        F.when(png, F.lit("PNG")).when(gif, F.lit("GIF")).alias("format"),
        F.when(png, _big_endian(value, 17, 4)).when(gif, _at(value, 6, 2).cast("int")).alias("width"),
        F.when(png, _big_endian(value, 21, 4)).when(gif, _at(value, 8, 2).cast("int")).alias("height"),
        F.when(png, _png_mode(value)).when(gif, F.when(_at(value, 10, 1) >= 128, F.lit("P")).otherwise(F.lit("L"))).alias("mode"),
        unknown.alias("metadata_keys"),
    )
    tiff = F.startswith(head, F.lit("49492A00")) | F.startswith(head, F.lit("4D4D002A"))
    walked = (
        F.when(F.startswith(head, F.lit("424D")), _bmp(value))
        .when(F.startswith(head, F.lit("52494646")) & F.endswith(head, F.lit("57454250")), _webp(value))
        .when(tiff, _tiff(value))
    )
    return F.coalesce(walked, fixed)


# PNG chunks and JPEG segments that count as metadata, by reported name.
_PNG_KEYS = {
    b"pHYs": "dpi", b"gAMA": "gamma", b"cHRM": "chromaticity", b"sRGB": "srgb", b"iCCP": "icc_profile",
    b"tRNS": "transparency", b"eXIf": "exif",
}
# Fixed value: the largest width or height of the PNG format.
MOST_PIXELS = 2**31 - 1
_PNG_TEXT = {b"tEXt", b"zTXt", b"iTXt"}
# Number of colour components of a JPEG frame and the mode of its pixels.
_JPEG_MODES = {1: "L", 3: "RGB", 4: "CMYK"}
NOTHING = (None,) * len(IMAGE_FACTS)


def _png_facts(data: bytes):
    width, height = struct.unpack(">II", data[16:24])
    if max(width, height) > MOST_PIXELS:
        return NOTHING
    keys, at = set(), 8
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":  # what follows the pixels is no part of the header
            break
        if kind in _PNG_TEXT:
            keys.add(data[at + 8 : at + 8 + size].split(b"\0", 1)[0].decode("latin-1"))
        elif kind in _PNG_KEYS:
            keys.add(_PNG_KEYS[kind])
        at += size + 12
    return "PNG", width, height, None, sorted(keys)


def _jpeg_facts(data: bytes):
    keys, at = set(), 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF or 0xD0 <= marker <= 0xD8 or marker == 0x01:
            at += 1 if marker == 0xFF else 2
            continue
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + size]
        if marker == 0xE0 and body.startswith(b"JFIF"):
            keys.update(["jfif", "jfif_version", "jfif_unit", "jfif_density"])
        elif marker == 0xE1 and body.startswith(b"Exif"):
            keys.add("exif")
        elif marker == 0xE2 and body.startswith(b"ICC_PROFILE"):
            keys.add("icc_profile")
        elif marker == 0xEE and body.startswith(b"Adobe"):
            keys.update(["adobe", "adobe_transform"])
        elif marker == 0xFE:
            keys.add("comment")
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", body[1:5])
            return "JPEG", width, height, _JPEG_MODES.get(body[5]), sorted(keys)
        at += 2 + size
    return NOTHING


def _facts(data: bytes | None):
    if not data:
        return NOTHING
    try:
        if data.startswith(b"\x89PNG\r\n\x1a\n"):
            return _png_facts(data)
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return ("GIF", *struct.unpack("<HH", data[6:10]), None, ["version"])
        if data.startswith(b"\xff\xd8"):
            return _jpeg_facts(data)
    except (struct.error, IndexError):
        pass
    return NOTHING


@F.arrow_udf(IMAGE_FACTS)
def _probe(images: pa.Array) -> pa.Array:
    rows = [dict(zip(IMAGE_FACTS.names, _facts(v))) for v in images.to_pylist()]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string())]
    return pa.array(rows, pa.struct(list(zip(IMAGE_FACTS.names, kinds))))


def with_image_facts(df: DataFrame, image: str) -> DataFrame:
    """Add size, format, width, height, mode and metadata keys, read from the file header.

    Pixels are not decoded; `decode_error` says that no known header was found. Only PNG, GIF
    and JPEG cross to Python, to have their chunks walked; other rows give it NULL.
    """
    value = F.col(image)
    walked = F.hex(F.substring(value, 1, 2)).isin("8950", "4749", "FFD8")
    read = df.withColumn("_header", image_header(value)).withColumn("_facts", _probe(F.when(walked, value)))
    facts = {n: F.coalesce(F.col(f"_header.{n}"), F.col(f"_facts.{n}")) for n in IMAGE_FACTS.names}
    facts |= {n: F.when(~walked, F.col(f"_header.{n}")).otherwise(F.col(f"_facts.{n}")) for n in ("format", "width", "height")}
    return read.select(
        *df.columns,
        F.octet_length(image).alias("n_bytes"),
        *[F.when(facts["format"].isNotNull(), facts[n]).alias(n) for n in IMAGE_FACTS.names],
        ((F.octet_length(image) > 0) & facts["format"].isNull()).alias("decode_error"),
    )


def image_score(n_bytes: Column | str, decode_error: Column | str, metadata_keys: Column | str, qr_codes: Column | str) -> Column:
    """Score of an image from its facts; no payload and broken payloads score zero."""
    bare = F.coalesce(F.size(F.coalesce(as_column(metadata_keys), F.array().cast("array<string>"))), F.lit(0)) == 0
    points = F.when(bare, F.lit(WEIGHT_NO_METADATA)).otherwise(F.lit(0.0)) + F.when(
        _has_codes(qr_codes), F.lit(WEIGHT_QR)
    ).otherwise(F.lit(0.0))
    unread = (as_column(n_bytes) == 0) | as_column(decode_error)
    return F.when(unread, F.lit(0.0)).otherwise(F.bround(points, 3))


def image_reason(n_bytes: Column | str, decode_error: Column | str, qr_codes: Column | str) -> Column:
    return (
        F.when(as_column(n_bytes) == 0, F.lit(REASON_EMPTY))
        .when(as_column(decode_error), F.lit(REASON_BROKEN))
        .when(_has_codes(qr_codes), F.lit(REASON_QR))
        .otherwise(F.lit(REASON_NONE))
    )


def _has_codes(qr_codes: Column | str) -> Column:
    return F.coalesce(F.size(as_column(qr_codes)) > 0, F.lit(False))
