"""Hash-derived values that any SQL engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha1_le32(text: Column) -> Column:
    """The first four bytes of SHA-1, little-endian, as a bigint."""
    h = F.sha1(text.cast("binary"))
    swapped = F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)])
    return F.conv(swapped, 16, 10).cast("bigint")


def u01(seed: int | str, tag: str, *keys: Column) -> Column:
    """A uniform number in [0, 1) that depends on seed, tag and keys only: repeatable where a random generator is not."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(tag), *[k.cast("string") for k in keys]).cast("binary"))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def u01_sql(seed: int | str, tag: str, *keys: str) -> str:
    joined = " || ':' || ".join([f"'{seed}:{tag}'", *(f"CAST({k} AS VARCHAR)" for k in keys)])
    return f"(CAST('0x' || substr(md5({joined}), 1, 8) AS BIGINT) / 4294967296.0)"
