"""Quality rules: fixed text features and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word uni- and bigrams are estimated, one from trusted documents and
one from all documents.  A document's score is the mean over its n-grams of the logarithm of the
ratio of both; documents below a fixed threshold are rejected.  Everything is DataFrame functions.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let

#: Buckets of the two multinomials; their counts are the only thing that reaches the driver.
BUCKETS = 1 << 15
#: Trusted documents that are used at most, those of the smallest hashed keys.
TRUSTED_ROWS = 100_000
#: Share of the raw multinomial in the smoothed trusted one: an n-gram that trusted documents
#: never use weighs log(MIXED), whatever the corpus's size.
MIXED = 0.1
#: Least mean log-ratio of a document that is kept, in nats per n-gram.
THRESHOLD = -0.1
WINDOW = 8
# Fixed values of the base rules.
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def pairs_of(hashes: Column) -> Column:
    """Hashes of adjacent words; the last place, which has no neighbour, is the last word's own."""
    return F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + 1)))


def repeated_words(pairs: Column, window: int = WINDOW) -> Column:
    """Words in windows of eight that occur twice or more, from the hashes of adjacent words.

    Windows are compared by 64-bit hashes, made by doubling.  If all differ, which an array's
    distinct size tells, nothing repeats; else (hash, place) pairs are sorted, those with an equal
    neighbour are kept, and the union of their windows is measured.  All steps are linear but for
    the sorts.
    """
    last = F.size(pairs) - window

    def doubled(hashes: Column, reach: int) -> Column:
        return F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + reach)))

    windows = let(doubled(pairs, 2), lambda four: doubled(four, 4))
    windows = F.slice(windows, 1, F.greatest(last + 1, F.lit(0)))

    def covered(places: Column) -> Column:
        # Windows in order of place: each adds what the next one doesn't.
        steps = F.transform(places, lambda p, i: F.coalesce(F.least(F.get(places, i + 1) - p, F.lit(window)), F.lit(window)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def repeated(found: Column) -> Column:
        pairs = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        again = let(
            pairs,
            lambda s: F.transform(
                F.filter(
                    s,
                    lambda e, i: F.coalesce(e["h"] == F.get(s, i - 1)["h"], F.lit(False))
                    | F.coalesce(e["h"] == F.get(s, i + 1)["h"], F.lit(False)),
                ),
                lambda e: e["p"],
            ),
        )
        return let(F.sort_array(again), covered)

    counted = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(repeated(w)))
    return F.when(last >= 0, counted).otherwise(F.lit(0))


def grams_of(hashes: Column, pairs: Column) -> Column:
    """Hashes of a text's words and of its pairs of adjacent words, in one array."""
    return F.concat(hashes, F.slice(pairs, 1, F.greatest(F.size(hashes) - 1, F.lit(0))))


def bucket_of(gram: Column) -> Column:
    return gram.bitwiseAND(BUCKETS - 1).cast("int")


def _hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def log_ratios(df: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text") -> list[float]:
    """Per bucket the log of the ratio of the trusted to the raw share.

    ``trusted`` holds keys; the ``TRUSTED_ROWS`` of the smallest hash are used, which bounds the
    broadcast.  Raw counts cover every row of ``df``.  The trusted shares are mixed with the raw
    ones by ``MIXED``.
    """
    chosen = trusted.select(F.col(key).alias("trusted_key")).where("trusted_key is not null").distinct()
    chosen = chosen.orderBy(F.xxhash64("trusted_key"), "trusted_key").limit(TRUSTED_ROWS)
    rows = df.select(F.col(key).alias("own_key"), _grams_of_text(text).alias("grams"))
    rows = rows.join(F.broadcast(chosen), F.col("own_key") == F.col("trusted_key"), "left")
    grams = rows.select(F.explode("grams").alias("gram"), F.col("trusted_key").isNotNull().cast("int").alias("good"))
    counts = grams.groupBy(bucket_of(F.col("gram")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good")).collect()
    total, good = sum(r["n"] for r in counts), sum(r["good"] for r in counts)
    out = [0.0] * BUCKETS
    for r in counts:
        raw = r["n"] / total
        trusted_share = r["good"] / good if good else raw
        out[r["bucket"]] = math.log((1 - MIXED) * trusted_share / raw + MIXED)
    return out


def _grams_of_text(text: str) -> Column:
    hashes = _hashes(F.coalesce(F.col(text), F.lit("")))
    return let(hashes, lambda h: let(pairs_of(h), lambda p: grams_of(h, p)))


def features(text: Column, ratios: list[float] | None) -> Column:
    """Struct of the base features and, with ``ratios``, of the score (null without words)."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    repeats = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    weights = F.from_json(F.lit(json.dumps(ratios or [])), "array<double>")

    def of(hashes: Column, pairs: Column) -> Column:
        total = F.aggregate(grams_of(hashes, pairs), F.lit(0.0), lambda a, g: a + F.get(weights, bucket_of(g)))
        fields = [F.size(hashes).cast("long").alias("n_words"), repeated_words(pairs).cast("long").alias("n_repeat_words")]
        if ratios is not None:
            fields.append(F.when(F.size(hashes) > 0, total / (2 * F.size(hashes) - 1)).alias("score"))
        return F.struct(*fields)

    found = let(_hashes(text), lambda h: let(pairs_of(h), lambda p: of(h, p)))
    return F.struct(
        found.alias("of_words"),
        (F.length(text) - F.regexp_count(text, F.lit(f"[{SPACE}]"))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        repeats.cast("long").alias("n_dup_lines"),
    )


def judge(
    df: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """``df`` with a struct ``quality``: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, score, base_failed, kept.

    A column of that name is replaced; all rows stay, repeated ones too.  Null and empty texts
    have no words and fail the base rules; with no trusted document all scores are 0 and the base
    rules decide alone; empty tables give no rows.  A narrow job after the counts.
    """
    ratios = log_ratios(df, trusted, key, text)
    made = df.withColumn("quality", features(F.coalesce(F.col(text), F.lit("")), ratios))
    words, repeats = F.col("quality.of_words.n_words"), F.col("quality.of_words.n_repeat_words")
    failed = (words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * words)
    score = F.col("quality.of_words.score")
    return made.withColumn(
        "quality",
        F.struct(
            words.alias("n_words"), F.col("quality.word_chars").alias("word_chars"),
            F.col("quality.n_symbols").alias("n_symbols"), F.col("quality.n_dup_lines").alias("n_dup_lines"),
            repeats.alias("n_repeat_words"), score.alias("score"), failed.alias("base_failed"),
            (~failed & F.coalesce(score >= threshold, F.lit(False))).alias("kept"),
        ),
    )


def trusted_of(labels: DataFrame) -> DataFrame:
    """Keys of documents labelled good and not toxic."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")
