"""Repeatable pseudo-random keys that any engine with md5 can recompute."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askgrid.schemas import KEY_FIELDS


def digest(*parts: Column | str | int) -> Column:
    """Hex md5 of the parts joined by ``|``."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def hash60(*parts: Column | str | int) -> Column:
    """The first 60 bits of :func:`digest` as a bigint."""
    return F.conv(F.substring(digest(*parts), 1, 15), 16, 10).cast(T.LongType())


def question_key(names: list[str] = KEY_FIELDS) -> Column:
    """One short column standing for all key columns.

    JSON keeps the field boundaries and tells null from text, so two different
    keys never meet; shuffling 64 characters is far cheaper than shuffling the
    passages and tables themselves.
    """
    return F.sha2(F.to_json(F.struct(*names)), 256)
