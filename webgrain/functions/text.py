"""Text measures as native columns: cleaning, tokens, n-grams, readability, fingerprints."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that keyword tokens leave out.
STOP_WORDS = (
    "a an and are as at be been but by can for from has have how i if in into is it its more not of on or our that the their this to was we what when where which who will with you your"
).split()


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row."""
    return F.transform(F.array(value), body)[0]


def clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def keyword_tokens(text: Column) -> Column:
    """Lower-case letters, digits and inner hyphens; words of three characters or more, no stop words or bare numbers."""
    raw = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\s-]", " "), r"\s+")
    trimmed = F.transform(raw, lambda w: F.regexp_replace(w, "^-|-$", ""))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(trimmed, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w) & ~w.rlike(r"^\d+$"))


def _run(tokens: Column, n: int):
    return lambda i: F.array_join(F.slice(tokens, i, n), " ")


def ngrams(tokens: Column, low: int, high: int) -> Column:
    """All runs of low to high tokens, shorter ones first, in order."""
    return let(tokens, lambda t: _ngrams(t, low, high))


def _ngrams(tokens: Column, low: int, high: int) -> Column:
    runs = []
    for n in range(low, high + 1):
        some = F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), _run(tokens, n))
        runs.append(F.when(F.size(tokens) >= n, some).otherwise(F.array().cast("array<string>")))
    return F.concat(*runs)


# Patterns of words, and of tokens that fingerprints are made of.
SIMHASH_TOKEN = re.compile(rb"[a-z0-9]{3,}")
WORD = r"[A-Za-z0-9]+(?:['’-][A-Za-z0-9]+)*"


def syllables(word: Column) -> Column:
    """Runs of one or two vowels in the ASCII letters, silent endings and a leading y aside; at least 1, 0 without letters."""

    def count(w: Column) -> Column:
        core = F.regexp_replace(F.regexp_replace(w, "(?:[^laeiouy]es|ed|[^laeiouy]e)$", ""), "^y", "")
        return F.when(
            F.length(w) > 3, F.greatest(F.lit(1), F.size(F.regexp_extract_all(core, F.lit("[aeiouy]{1,2}"), F.lit(0))))
        ).when(F.length(w) > 0, 1).otherwise(0)

    return let(F.regexp_replace(F.lower(word), "[^a-z]", ""), count)


def syllable_total(words: Column) -> Column:
    """Sum of the syllables of all words, by patterns over the joined words instead of each one."""
    joined = F.regexp_replace(F.lower(F.array_join(words, " ")), "[^a-z ]", "")

    def count(t: Column) -> Column:
        times = lambda s, pattern: F.regexp_count(s, F.lit(pattern))
        short = times(t, "(?<![a-z])[a-z]{1,3}(?![a-z])")
        long = F.regexp_replace(t, "(?<![a-z])[a-z]{1,3}(?![a-z])", "")
        core = F.regexp_replace(F.regexp_replace(long, "(?:[^laeiouy]es|ed|[^laeiouy]e)(?![a-z])", ""), "(?<![a-z])y", "")
        # a long word has its vowel runs, or one syllable where it has none
        return let(core, lambda c: short + times(c, "[aeiouy]{1,2}") + times(t, "[a-z]{4,}") - times(c, "[a-z]*[aeiouy][a-z]*"))

    return let(joined, count)


def readability(text: Column) -> Column:
    """Struct of words, sentences, syllables, words per sentence, reading ease (0 to 100), grade (from 0), minutes."""
    t = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    sentences = F.filter(F.split(t, r"[.!?]+(?:\s|$)"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")) != "")

    def measures(n: Column) -> Column:
        w, s, y = n["w"].cast("double"), n["s"].cast("double"), n["y"].cast("double")
        some = (n["w"] > 0) & (n["s"] > 0)
        per = F.when(n["s"] > 0, w / s).otherwise(0.0)
        return F.struct(
            n["w"].cast("long").alias("words"),
            n["s"].cast("long").alias("sentences"),
            n["y"].cast("long").alias("syllables"),
            per.alias("words_per_sentence"),
            F.when(some, F.greatest(F.lit(0.0), F.least(F.lit(100.0), 206.835 - 1.015 * (w / s) - 84.6 * (y / w)))).alias("reading_ease"),
            F.when(some, F.greatest(F.lit(0.0), 0.39 * (w / s) + 11.8 * (y / w) - 15.59)).alias("grade"),
            (w / 225).alias("minutes"),
        )

    counts = let(
        words,
        lambda ws: F.struct(
            F.size(ws).alias("w"),
            F.size(sentences).alias("s"),
            syllable_total(ws).alias("y"),
        )
    )
    return let(counts, measures)


def token_hash(token: Column) -> Column:
    """First 64 bits of a token's SHA-256, as a signed long."""
    return F.conv(F.substring(F.sha2(token, 256), 1, 16), 16, -10).cast("long")


#: Token hashes that a Python worker keeps.
CACHED_TOKENS = 200_000


def simhash(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and fingerprint (long): bit i is set where the frequency-weighted votes of token hashes are 0 or more.

    Tokens are runs of three or more of a-z0-9, in lower case; rows without any have all bits set. Each row is hashed on its
    own in Arrow batches, so nothing is shuffled, and a very long text costs its distinct tokens alone.
    """
    kind = df.select(key).dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        place = np.arange(64, dtype=np.uint64)
        for b in batches:
            out = np.full(b.num_rows, -1, np.int64)
            for i, t in enumerate(b.column(1).cast(pa.large_binary()).to_pylist()):
                found = Counter(SIMHASH_TOKEN.findall(t))
                if not found:
                    continue
                if len(known) > CACHED_TOKENS:
                    known.clear()
                for token in [x for x in found if x not in known]:
                    known[token] = int.from_bytes(hashlib.sha256(token).digest()[:8], "big")
                h = np.array([known[x] for x in found], np.uint64)
                n = np.array(list(found.values()), np.int64)
                ones = n @ ((h[:, None] >> place) & np.uint64(1)).astype(np.int64)
                out[i] = ((2 * ones >= n.sum()).astype(np.uint64) << place).sum(dtype=np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], names=[key, "fingerprint"])

    lowered = df.select(key, F.lower(F.coalesce(text, F.lit(""))).alias("__text"))
    return lowered.mapInArrow(run, f"`{key}` {kind}, fingerprint long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def fingerprint(*parts: Column) -> Column:
    """SHA-256 over the parts joined by line feeds."""
    return F.sha2(F.concat_ws("\n", *parts), 256)
