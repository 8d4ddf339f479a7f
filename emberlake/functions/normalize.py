"""Scalar rules used by every join and aggregate: identifiers, timestamps, guarded arithmetic. Column to Column."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def contract_key(c: Column) -> Column:
    """Trimmed, lower case, without 0x. Stays text: ids have up to 78 digits."""
    return F.regexp_replace(F.lower(F.trim(c)), "0x", "")


def wallet_key(c: Column) -> Column:
    """0x and 40 lower-case hex digits; a zero-padded 32-byte topic is cut to its last 20 bytes; anything else is null."""
    bare = F.regexp_replace(F.lower(F.trim(c)), "^0x", "")
    return F.when(bare.rlike("^[0-9a-f]{40}$"), F.concat(F.lit("0x"), bare)).when(bare.rlike("^0{24}[0-9a-f]{40}$"), F.concat(F.lit("0x"), F.substring(bare, 25, 40)))


def wallet_shard(c: Column, shards: int = 250) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(c.cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(shards))


def any_timestamp(c: Column) -> Column:
    """Epoch seconds as text, else an ISO text; null if neither."""
    number = c.try_cast("double")
    return F.coalesce(F.timestamp_micros((number * 1_000_000).cast("long")), c.try_cast("timestamp"))


def seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def no_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def truthy(c: Column) -> Column:
    """'true' and '1' in any case; null counts as false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1"), F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    return ratio(dot, norm(a) * norm(b))


def text_similarity(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.nullif(F.greatest(F.length(a), F.length(b)).cast("double"), F.lit(0.0))


def erf(x):
    """The error function to about 1e-14, by 2/sqrt(pi) e^(-x^2) sum of 2^n x^(2n+1) / (2n+1)!!, whose terms have one sign; 1 beyond 6."""
    near = F.greatest(F.lit(-6.0), F.least(F.lit(6.0), x))
    square = near * near
    start = F.struct(near.alias("term"), near.alias("total"))

    def step(acc, n):
        term = acc["term"] * 2 * square / (2 * n + 1)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(140)), start, step, lambda acc: acc["total"])
    return 2 / math.sqrt(math.pi) * F.exp(-square) * series


def normal_cdf(z):
    return 0.5 * (1 + erf(z / math.sqrt(2)))
