"""Scalar functions of texts, paths and numbers, as columns where operators need them and in Python for reports."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The blank characters that trimming removes, as the body of a Java character class.
BLANK = r"\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"


def units(text: Column | str) -> Column:
    """UTF-16 code units of a text; a text with a byte for each character has as many, and only others are encoded."""
    wide = (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")
    return F.when(F.octet_length(text) == F.char_length(text), F.char_length(text).cast("long")).otherwise(wide)


def tokens(n_units: Column) -> Column:
    """Estimated tokens: four units each, rounded up."""
    return F.ceil(n_units / 4).cast("long")


def rtrim(text: Column | str) -> Column:
    return F.regexp_replace(text, f"[{BLANK}]+\\z", "")


def trim(text: Column | str) -> Column:
    return F.regexp_replace(rtrim(text), f"\\A[{BLANK}]+", "")


def escape(text: Column | str) -> Column:
    """A text as an attribute value: only double quotes are escaped."""
    return F.replace(F.col(text) if isinstance(text, str) else text, F.lit('"'), F.lit("&quot;"))


def prefixes(path: str) -> Column:
    """The path and all paths above it, shortest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def collated(path: str) -> Column:
    """A sort key in locale order."""
    return F.collate(F.col(path), "UNICODE")


def comparable(mapping: str) -> Column:
    """A mapping as it is compared: slashes turned, none at the end."""
    return F.regexp_replace(F.replace(F.trim(F.col(mapping)), F.lit("\\"), F.lit("/")), "/+$", "")


def node_path(raw: str) -> str:
    """A node path as given by a user: blanks, one './' in front and slashes at the end go."""
    return re.sub(r"/+$", "", re.sub(r"^\./", "", raw.strip()))


def project_path(root: str, raw: str) -> str:
    """A path relative to the project root; ValueError if it is empty or lies outside."""
    given = raw.strip().replace("\\", "/")
    if not given:
        raise ValueError("path cannot be empty")
    at = posixpath.relpath(posixpath.normpath(posixpath.join(root, given)), root)
    if at.startswith(".."):
        raise ValueError(f"path is outside the project root: {raw}")
    return "" if at == "." else at


def pluralize(word: str, n: int) -> str:
    return word if n == 1 else word[:-1] + "ies" if word.endswith("y") else word + "s"


def thousands(n: int) -> str:
    return f"{n:,}"


def rounded(x: float, digits: int = 0) -> str:
    """Half away from zero for positive numbers, as a text."""
    scale = 10**digits
    return f"{int(x * scale + 0.5) / scale:.{digits}f}"


def short_hash(digest: str | None) -> str:
    return digest[:8] if digest else "none"


def semver(version: str | None) -> tuple | None:
    """A version as a key to compare, or None if it is not a semantic version; a pre-release comes before its release."""
    m = re.fullmatch(r"v?(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?", (version or "").strip())
    if not m:
        return None
    pre = tuple((0, int(x), "") if x.isdigit() else (1, 0, x) for x in m[4].split(".")) if m[4] else ()
    return (int(m[1]), int(m[2]), int(m[3]), not pre, pre)


def load_order(path: str):
    """A key that puts paths in load order: segment by segment, as bytes."""
    return F.translate(path, "/", "\x01")
