"""Tokenisation and token-id arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of any script, periods, commas and the two special markers.
TOKEN = r"([\p{L}\p{N}_]+|[.,]|\[mask\]|\[pad\])"
PAD, MASK = "[PAD]", "[MASK]"


def tokenize(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))
    return F.transform(found, lambda t: F.when(t == "[mask]", MASK).when(
        t == "[pad]", PAD).otherwise(t))


def pad_ids(ids: Column, length: Column | int, pad_id: int = 0, strict: bool = False) -> Column:
    """Cut or fill to ``length``; ``strict`` raises instead of cutting."""
    length = F.lit(length) if isinstance(length, int) else length
    fitted = F.concat(F.slice(ids, F.lit(1), length), F.array_repeat(
        F.lit(pad_id).cast("bigint"), F.greatest(F.lit(0), length - F.size(ids))))
    if not strict:
        return fitted
    return F.when(F.size(ids) > length, F.raise_error(
        F.lit("token sequence exceeds the given length")).cast("array<bigint>")).otherwise(fitted)


def unit_hash(*parts: Column) -> Column:
    """Deterministic number in [0, 1) from a key, equal on every engine."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def mask_tokens(tokens: Column, key: Column, seed: int, p: float = 0.15) -> Column:
    """Replace tokens by the mask with probability ``p``; padding is never masked."""
    return F.transform(tokens, lambda t, i: F.when(
        (t != PAD) & (unit_hash(F.lit(seed), key, i) < p), MASK).otherwise(t))
