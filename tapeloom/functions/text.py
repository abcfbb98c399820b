"""Parsing, keys and serialization."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def safe_double(value: Column) -> Column:
    """Number or 0.0; text that is no number counts as 0.0 too."""
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def lenient_array(value: Column, schema: T.ArrayType) -> Column:
    """Parse a JSON array, or one whose quotes are single; anything else is an empty array."""
    strict = F.from_json(value, schema)
    requoted = F.from_json(F.replace(value, F.lit("'"), F.lit('"')), schema)
    return F.coalesce(strict, requoted, F.array().cast(schema))


def lenient_strings(value: Column) -> Column:
    """As ``lenient_array`` for plain strings, but a bare scalar becomes a one-element array."""
    schema = T.ArrayType(T.StringType())
    looks_like_list = F.trim(value).startswith("[")
    parsed = F.coalesce(
        F.from_json(value, schema),
        F.from_json(F.replace(value, F.lit("'"), F.lit('"')), schema),
    )
    return F.when(looks_like_list & parsed.isNotNull(), parsed).when(
        F.coalesce(value, F.lit("")) != "", F.array(value)
    ).otherwise(F.array().cast(schema))


def split_trim(value: Column) -> Column:
    return F.transform(F.split(value, ","), lambda x: F.trim(x))


def surrogate_key(*parts: Column) -> Column:
    """64-bit hash of the text of the parts; dates and their text hash alike."""
    return F.xxhash64(*[p.cast("string") for p in parts])


def composite_key(*parts: Column) -> Column:
    return F.concat_ws("_", *[p.cast("string") for p in parts])


def content_key(title: Column, url: Column, time_update: Column) -> Column:
    """sha-256 of title and url, followed by the snapshot time."""
    return F.concat_ws("_", F.sha2(F.concat_ws("_", title, url), 256), time_update.cast("string"))


def stable_fraction(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts only, so a lost task repeats it exactly."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def is_malformed(raw: Column, parsed: Column, required: str) -> Column:
    """A record whose text is present but whose required field cannot be read."""
    return raw.isNotNull() & (parsed.isNull() | parsed[required].isNull())
