"""Strict and fuzzy fingerprints of offers."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import fingerprint_text, let

PERMUTATIONS = 128
BODY = 200


def _number(c: Column) -> Column:
    """A number as text; null and 0 are ''. Decimals write the same in every engine."""
    return F.when(c.isNull() | (c == 0), "").otherwise(c.cast("string"))


def strict_fingerprint(domain: Column, category: Column, monthly: Column, currency: Column, location: Column, ram_mb: Column, storage_gb: Column, bandwidth_gb: Column) -> Column:
    """SHA-1 of the lower-cased, pipe-joined parts. Nulls are '' (concat_ws alone would skip them)."""
    text = [F.coalesce(c, F.lit("")) for c in (domain, category)] + [_number(monthly.cast("decimal(12,2)"))] + [F.coalesce(c, F.lit("")) for c in (currency, location)]
    return F.sha1(F.lower(F.concat_ws("|", *text, *map(_number, (ram_mb, storage_gb, bandwidth_gb)))).cast("binary"))


def shingles(text: Column, width: int = 3) -> Column:
    """Distinct runs of ``width`` characters; a shorter text has none. The text is bound first, so that it is made once and not for every run."""

    def runs(t: Column) -> Column:
        n = F.char_length(t)
        return F.when(n < width, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0), n - width), lambda i: F.substring(t, i + 1, F.lit(width)))))

    return let(text, runs)


#: The least prime above 2**32.
PRIME = 4_294_967_311


def permutation(k: int) -> tuple[int, int]:
    """Multiplier and addend of permutation ``k``; both stay below 2**30, so that no product leaves 64 bits."""
    return 1 + (k * 2_654_435_761 + 374_761_393) % (2**30 - 1), (k * 2_246_822_519 + 668_265_263) % 2**30


def minhash(items: Column, permutations: int = PERMUTATIONS) -> Column:
    """For each permutation the least of (a h + b) mod ``PRIME`` over the items' 32-bit hashes h; nulls where there are none.
    Every item is hashed once (the head of its MD5, which other engines have too)."""
    hashes = F.transform(items, lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 8), 16, 10).cast("long"))
    rules = F.expr(f"array({', '.join(f"named_struct('a', {a}L, 'b', {b}L)" for a, b in map(permutation, range(permutations)))})")
    return let(hashes, lambda s: F.transform(rules, lambda p: F.array_min(F.transform(s, lambda h: (h * p["a"] + p["b"]) % PRIME))))


#: Runs of characters, distinct in their texts, that are hashed at once.
AT_ONCE = 1_000_000
_LETTER = 2**21 - 1


def _runs(text: str | None) -> np.ndarray:
    """The distinct runs of three characters, each as one number of 63 bits."""
    c = np.frombuffer((text or "").encode("utf-32-le"), "<u4").astype(np.int64)
    return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:])


def _least(texts: list[np.ndarray], permutations: int) -> Iterator[list[int] | None]:
    """The signatures of texts, each given by its runs; None where there are none. A run that many of the texts have is hashed once."""
    sizes = np.array([len(x) for x in texts], np.int64)
    runs, at = np.unique(np.concatenate([np.empty(0, np.int64), *texts]), return_inverse=True)
    letters = np.stack([runs >> 42, runs >> 21 & _LETTER, runs & _LETTER], 1).astype("<u4").tobytes().decode("utf-32-le")
    hashes = np.frombuffer(b"".join(md5(letters[k : k + 3].encode()).digest()[:4] for k in range(0, len(letters), 3)), ">u4").astype(np.int64)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    least = iter(np.stack([np.minimum.reduceat(((hashes * a + b) % PRIME)[at], starts) for a, b in map(permutation, range(permutations))], 1).tolist() if len(starts) else [])
    return (next(least) if n else None for n in sizes)


def text_minhash(text: Column, permutations: int = PERMUTATIONS, at_once: int = AT_ONCE) -> Column:
    """``minhash`` of the ``shingles`` of whole texts, whatever their length; null for one of fewer than three characters."""

    @F.arrow_udf("array<long>")
    def signed(texts: pa.Array) -> pa.Array:
        out, held, n = [], [], 0
        for x in texts:
            held.append(_runs(x.as_py()))
            n += len(held[-1])
            if n >= at_once:
                out += _least(held, permutations)
                held, n = [], 0
        return pa.array([*out, *_least(held, permutations)], pa.list_(pa.int64()))

    return signed(text)


def fuzzy_text(title: Column, domain: Column, body: Column) -> Column:
    return F.concat_ws(" ", F.lower(F.coalesce(domain, F.lit(""))), fingerprint_text(title), fingerprint_text(F.substring(F.coalesce(body, F.lit("")), 1, BODY)))


def fuzzy_fingerprint(title: Column, domain: Column, body: Column, permutations: int = PERMUTATIONS) -> Column:
    """SHA-1 of the MinHash signature: equal exactly where signatures are."""
    return F.sha1(F.array_join(F.transform(minhash(shingles(fuzzy_text(title, domain, body)), permutations), lambda x: F.coalesce(x.cast("string"), F.lit("-"))), ",").cast("binary"))


def digest_similarity(a: Column, b: Column) -> Column:
    """1 where equal, 0 where lengths differ, else the share of equal characters."""
    same = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(a == b, 1.0).when(F.char_length(a) != F.char_length(b), 0.0).otherwise(same / F.char_length(a))
