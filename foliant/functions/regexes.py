"""Regular expressions of templates, written in Python's dialect, as Columns in Java's.

PREFIX gives Java the meaning that the templates expect: case folding and white space of all of Unicode, ^ and $ at
every \\n only. Named groups are rewritten; a pattern that either dialect rejects is quarantined when it is loaded.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = "(?imdU)"
#: Line ends as text readers split them.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
_META = re.compile(r"[\\\[\](){}*+?|^$]")
_FLAGS = re.compile(r"^\(\?[aiLmsux]+\)")


def is_literal(pattern: str) -> bool:
    """Without a metacharacter (the dot does not count) a pattern is searched as it is written."""
    return not _META.search(pattern.strip())


def literal(pattern: str) -> str:
    """The words of a literal pattern, with any white space between."""
    return r"\s+".join(map(re.escape, pattern.split())) or re.escape(pattern)


@lru_cache(maxsize=1024)
def effective(pattern: str) -> str:
    return literal(pattern) if is_literal(pattern) else pattern


@lru_cache(maxsize=1024)
def java(pattern: str) -> str:
    """A Python pattern for Java; ValueError if Python rejects it."""
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"not a pattern: {pattern!r}: {e}") from e
    body = _FLAGS.sub("", pattern)
    body = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1].replace('_', '')}>", body)
    return PREFIX + re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\\\k<{m[1].replace('_', '')}>", body)


def groups(pattern: str) -> int:
    return re.compile(pattern).groups


def hits(text: Column, pattern: str) -> Column:
    return text.rlike(java(pattern))


def capture(text: Column, pattern: str) -> Column:
    """The first group that is not empty, else the whole match; null where nothing matches."""
    p = java(pattern)
    found = [F.nullif(F.regexp_extract(text, p, k), F.lit("")) for k in range(1, groups(pattern) + 1)]
    return F.coalesce(*found, F.regexp_substr(text, F.lit(p)))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def lines(text: Column) -> Column:
    """Lines without their ends; a last line end starts no further line."""
    parts = F.split(text, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def words(line: Column) -> Column:
    """How many words a line has."""
    return F.when(strip(line) == "", 0).otherwise(F.size(F.split(strip(line), r"(?U)\s+")))
