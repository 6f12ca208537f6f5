"""Column functions on BINARY values. Positions are 0-based byte offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf8(text: Column) -> Column:
    """The UTF-8 bytes of a string."""
    return F.encode(text, "UTF-8")


def part(content: Column, start: Column | int, length: Column | int) -> Column:
    """``length`` bytes from offset ``start``."""
    start = F.lit(start) if isinstance(start, int) else start
    length = F.lit(length) if isinstance(length, int) else length
    return F.substring(content, start.cast("int") + 1, length.cast("int"))


def starts(length: Column, window: Column | int, step: int = 1) -> Column:
    """Offsets 0, step, 2*step ... at which a window fits into ``length`` bytes; none if it does not fit."""
    window = F.lit(window) if isinstance(window, int) else window
    return F.when(length >= window, F.sequence(F.lit(0), (length - window).cast("int"), F.lit(step))).otherwise(F.array().cast("array<int>"))


def positions(content: Column, pattern: Column) -> Column:
    """Offsets of all occurrences, overlapping ones included."""
    # the pattern's first four bytes first: most offsets fail there
    head = F.substring(pattern, 1, 4)
    n = F.length(head)
    near = F.filter(starts(F.length(content), F.length(pattern)), lambda i: F.substring(content, i + 1, n) == head)
    return F.filter(near, lambda i: F.substring(content, i + 1, F.length(pattern)) == pattern)


def quoted(pattern: Column) -> Column:
    """A regular expression for the bytes of a pattern over ISO-8859-1 text."""
    return F.regexp_replace(F.lower(F.hex(pattern)), "(..)", "\\\\x$1")


def latin1(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def count_overlapping(content: Column, pattern: Column) -> Column:
    return F.regexp_count(latin1(content), F.concat(F.lit("(?="), quoted(pattern), F.lit(")"))).cast("bigint")


def count_disjoint(content: Column, pattern: Column) -> Column:
    """Occurrences from left to right that do not overlap."""
    return F.regexp_count(latin1(content), quoted(pattern)).cast("bigint")


def byte_at(content: Column, offset: Column | int) -> Column:
    """The byte at an offset, 0 to 255; null outside."""
    return F.conv(F.nullif(F.hex(part(content, offset, 1)), F.lit("")), 16, 10).cast("int")


def byte_array(content: Column) -> Column:
    """All bytes as an array of 0 to 255."""
    return F.transform(starts(F.length(content), 1), lambda i: F.conv(F.hex(F.substring(content, i + 1, 1)), 16, 10).cast("int"))


def u64be(x: Column) -> Column:
    """Eight big-endian bytes of a non-negative number."""
    return F.unhex(F.lpad(F.hex(x.cast("bigint")), 16, "0"))


def hex_status(pattern: Column) -> Column:
    """OK or why a pattern in hexadecimal is refused: empty, odd, or not lower-case digits."""
    return (
        F.when(pattern.isNull() | (pattern == ""), "EMPTY_QUERY")
        .when(F.length(pattern) % 2 == 1, "ODD_LENGTH")
        .when(~pattern.rlike("^[0-9a-f]+$"), "INVALID_HEX")
        .otherwise("OK")
    )


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: named inside a lambda it would be computed for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def shares(content: Column) -> Column:
    """The share of each byte value that occurs, in order of value; for short contents."""
    n = F.length(content).cast("double")
    return let(byte_array(content), lambda bs: F.transform(F.array_sort(F.array_distinct(bs)), lambda k: F.size(F.filter(bs, lambda b: b == k)) / n))


def entropy(content: Column) -> Column:
    """Bits of Shannon entropy per byte; 0 for no bytes."""
    return F.abs(F.aggregate(shares(content), F.lit(0.0), lambda a, p: a - p * F.log2(p)))


def simpson(content: Column) -> Column:
    """The sum of squared byte shares; 0 for no bytes."""
    return F.aggregate(shares(content), F.lit(0.0), lambda a, p: a + p * p)


def display_path(path: Column) -> Column:
    """A path's bytes as text, bytes that are not UTF-8 escaped (not to be parsed back)."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def shown(s):
        return s.map(lambda b: None if b is None else bytes(b).decode("utf-8", "backslashreplace"))

    return shown(path)


def safe_path(path: Column) -> Column:
    """Whether a raw relative path is usable: not empty or absolute, no NUL, no component empty, . or .."""
    text = latin1(path)
    parts = F.split(text, "/")
    return F.coalesce((F.length(path) > 0) & ~F.contains(text, F.lit("\0")) & F.forall(parts, lambda c: ~c.isin("", ".", "..")), F.lit(False))
