"""Path, time and key expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Suffixes of media files.
SUFFIXES = ["jpg", "jpeg", "png", "tif", "tiff", "bmp", "webp"]


def suffix(path: Column) -> Column:
    """Lower-cased suffix of the last path component, empty without one."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def is_media(path: Column) -> Column:
    return suffix(path).isin(SUFFIXES)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]+$", 1)


def stem(name: Column) -> Column:
    """A name without its last suffix; a leading dot starts no suffix."""
    return F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 1)


def dot_suffix(name: Column) -> Column:
    return F.regexp_extract(name, r"^.+?(\.[^.]*)?$", 1)


def is_inside(path: Column, root: str) -> Column:
    """Component-wise containment: a sibling that only shares the root's prefix is outside."""
    root = root.rstrip("/")
    return (path == root) | path.startswith(root + "/")


def project_key(path: Column) -> Column:
    return F.md5(path)


def exif_timestamp(original: Column, top_original: Column, top_datetime: Column) -> Column:
    """First non-empty field as a timestamp; a field that can't be parsed gives null, not the next one."""
    first = F.coalesce(F.nullif(original, F.lit("")), F.nullif(top_original, F.lit("")), F.nullif(top_datetime, F.lit("")))
    return F.try_to_timestamp(first, F.lit("yyyy:MM:dd HH:mm:ss"))


def json_field(document: Column, name: str, kind: str) -> Column:
    """A field of a JSON object; null if it is absent or the document can't be read."""
    return F.from_json(document, f"`{name}` {kind}")[name]
