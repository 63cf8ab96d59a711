"""String helpers with Python's whitespace and full-match rules."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's ``str.strip`` removes; as a class for patterns, ASCII controls suffice
# next to Unicode-aware ``\\s``.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SPACE = r"[\s\x1C-\x1F]"


def strip(text: Column) -> Column:
    """Trim Unicode white space on both sides."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def full_match(text: Column, pattern: str) -> Column:
    """Whole-string regular expression match."""
    return text.rlike(rf"\A(?:{pattern})\z")


def lookup(key: Column, table: Mapping[str, object], default: object) -> Column:
    """Value of a fixed table for ``key``, without a join."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), key), F.lit(default))


def quoted(text: Column) -> Column:
    """``text`` in single quotes, as messages show it."""
    return F.concat(F.lit("'"), text, F.lit("'"))
