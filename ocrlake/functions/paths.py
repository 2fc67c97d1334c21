"""Path functions: one spelling, extensions, file kinds."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Image extensions and their media types
MEDIA_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp"}
IMAGE_EXTENSIONS = tuple(MEDIA_TYPES)
# Ends of names of files still being written
TEMPORARY_ENDS = (".tmp", ".crdownload", ".partial", ".part", ".swp", ".lock")


def normalize_path(c: Column) -> Column:
    """Backslashes, no ``\\\\?\\`` prefix, upper-case drive letter, no backslash at the end (but that of a drive root)."""
    s = F.translate(c, "/", "\\")
    s = F.when(s.startswith("\\\\?\\UNC\\"), F.concat(F.lit("\\\\"), F.substring(s, 9, 1 << 30))).when(s.startswith("\\\\?\\"), F.substring(s, 5, 1 << 30)).otherwise(s)
    s = F.when(s.rlike("^[A-Za-z]:"), F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30))).otherwise(s)
    cut = F.regexp_replace(s, r"\\+$", "")
    return F.when(F.length(s) <= 3, s).otherwise(F.when(F.length(cut) < 3, F.substring(s, 1, 3)).otherwise(cut))


def normalize_path_of(path: str) -> str:
    s = path.replace("/", "\\")
    if s.startswith("\\\\?\\UNC\\"):
        s = "\\\\" + s[8:]
    elif s.startswith("\\\\?\\"):
        s = s[4:]
    if re.match("[A-Za-z]:", s):
        s = s[0].upper() + s[1:]
    if len(s) <= 3:
        return s
    cut = s.rstrip("\\")
    return cut if len(cut) >= 3 else s[:3]


def canonical_path(path: str) -> str:
    """The real path in plain spelling; the path as given where it cannot be resolved."""
    try:
        return normalize_path_of(os.path.realpath(path, strict=True))
    except OSError:
        return normalize_path_of(path)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)([^\\/]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-case extension without the dot; '' if there is none (a leading dot starts a name, not an extension)."""
    return F.lower(F.regexp_extract(file_name(path), r"(?s)^.+\.([^.]*)$", 1))


def is_image(path: Column) -> Column:
    return extension(path).isin(*IMAGE_EXTENSIONS)


def is_temporary(path: Column) -> Column:
    name = F.lower(file_name(path))
    ends = F.lit(False)
    for e in TEMPORARY_ENDS:
        ends = ends | name.endswith(e)
    return (name == "") | name.startswith(".") | name.startswith("~$") | ends


def is_supported_image(path: Column) -> Column:
    return ~is_temporary(path) & is_image(path)


def media_type(ext: Column) -> Column:
    low, out = F.lower(ext), F.lit("application/octet-stream")
    for e, kind in MEDIA_TYPES.items():
        out = F.when(low == e, kind).otherwise(out)
    return out


def data_url(ext: Column, content: Column) -> Column:
    """Bytes as a data address; the built-in encoder's line breaks are taken out."""
    return F.concat(F.lit("data:"), media_type(ext), F.lit(";base64,"), F.translate(F.base64(content), "\r\n", ""))


def item_id_of_uri(uri: Column) -> Column:
    """Item number in the path of an image address (last segment, without what follows a dot); null if it is none."""
    return F.regexp_extract(uri, r"(\d+)(?:\.[^/]*)?/?$", 1).try_cast("long")
