"""Text normalisation as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that Unicode (and Python's str.strip) treats as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Values up to this many characters travel through a shuffle as they are; longer ones as a digest.
KEY_LENGTH = 128


def quoted(name: str) -> Column:
    """Column reference for a name that may hold dots, spaces or back-ticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def normalize_text(c: Column) -> Column:
    """Case and surrounding whitespace removed: the key under which variants of a value meet."""
    return F.lower(strip(c))


def is_plain_key(c: Column) -> Column:
    return (F.length(c) <= KEY_LENGTH) | c.rlike(r"^[\s\d.,eE+-]*$")


def value_key(c: Column) -> Column:
    """A grouping key as selective as the value itself but short enough to shuffle.

    Long values become a SHA-256 digest, prefixed so that it is longer than any plain key and
    never meets one. Number-like text stays plain at any length, because numbers are parsed
    from the key.
    """
    digest = F.concat(F.lit("#" * (KEY_LENGTH - 63)), F.sha2(c, 256))
    return F.when(is_plain_key(c), c).otherwise(digest)
