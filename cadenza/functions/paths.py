"""File paths as columns: format, identity, file URI, title."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions and the formats they stand for.
FORMATS = {"mp3": "mp3", "wav": "wav", "flac": "flac", "aiff": "aiff", "aif": "aiff"}
# FNV-1a, 32 bits.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619
# Characters escaped in a URI's path besides control characters, DEL and bytes from 128 up.
URI_ESCAPED = " \"#%&'<>?[]^`{|}"


def extension(path: Column) -> Column:
    """What follows the last dot of the file name, '' if there is none or it begins the name."""
    return F.regexp_extract(path, r"[^/][.]([^./]+)$", 1)


def audio_format(path: Column) -> Column:
    """mp3, wav, flac, aiff, or null."""
    ext = F.lower(extension(path))
    out = F.lit(None).cast("string")
    for k, v in FORMATS.items():
        out = F.when(ext == k, v).otherwise(out)
    return out


def is_supported(path: Column) -> Column:
    return audio_format(path).isNotNull()


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_stem(path: Column) -> Column:
    """The file name without its extension; a name that only begins with a dot is its own stem."""
    return F.regexp_extract(path, r"([^/]+?)([.][^./]*)?$", 1)


def normalized(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def _bytes(text: Column) -> Column:
    """The UTF-8 bytes as numbers; an empty text gives an empty array."""
    raw = F.encode(text, "utf-8")
    each = F.transform(F.sequence(F.lit(1), F.octet_length(raw)), lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("long"))
    return F.when(F.octet_length(raw) > 0, each).otherwise(F.array().cast("array<bigint>"))


def track_id(path: Column) -> Column:
    """FNV-1a of the normalized path, without its sign bit: equal paths in any case and with either slash share it."""
    step = lambda h, b: h.bitwiseXOR(b) * F.lit(FNV_PRIME).cast("long") % F.lit(1 << 32)
    h = F.aggregate(_bytes(normalized(path)), F.lit(FNV_OFFSET).cast("long"), step)
    return h.bitwiseAND(F.lit(0x7FFFFFFF).cast("long")).cast("int")


def has_drive(path: Column) -> Column:
    return path.rlike("^[A-Za-z]:")


def location_uri(path: Column) -> Column:
    """file://localhost and the path: slashes forward, one before a drive, other bytes escaped where they must be."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    p = F.when(has_drive(p), F.concat(F.lit("/"), p)).otherwise(p)
    plain = "".join(f"\\x{c:02X}" for c in range(32, 127) if chr(c) not in URI_ESCAPED)
    runs = F.regexp_extract_all(p, F.lit(f"[{plain}]+|[^{plain}]+"), F.lit(0))  # in all as long as the path
    one = lambda x: F.when(x.rlike(f"^[{plain}]"), x).otherwise(F.regexp_replace(F.hex(F.encode(x, "utf-8")), "(..)", "%$1"))
    return F.concat(F.lit("file://localhost"), F.array_join(F.transform(runs, one), ""))


def title(tag: Column, path: Column) -> Column:
    """The tag, or the file's stem where there is none; an empty tag stays."""
    return F.coalesce(tag, file_stem(path))
