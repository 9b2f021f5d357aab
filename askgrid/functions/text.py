"""String helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

END_MARK = "</s>"

# The characters that count as white space when text is stripped.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def cut_between(text: Column, separator: Column) -> Column:
    """Stripped text between the 1st and 2nd separator; null where it is absent."""
    piece = F.replace(F.split_part(text, separator, F.lit(2)), F.lit(END_MARK), F.lit(""))
    return F.when(F.contains(text, separator), strip(piece))
