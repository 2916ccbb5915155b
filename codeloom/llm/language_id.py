"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the hashed n-grams of all labelled texts per language in numpy, one partial table
per task, and adds them up by language and bucket.  The matrix of log-probabilities has as many
cells as languages times buckets, whatever the corpus holds; it travels with the scoring tasks,
which add up the columns of a text's n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Lengths of the n-grams and buckets that all of them share; a power of two.
LENGTHS = (1, 2, 3)
BUCKETS = 1 << 15
#: Bound of the matrix: more languages than this are an error, not a larger broadcast.
MAX_LANGUAGES = 500

_LETTER = regex.compile(r"\p{L}")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_buckets(text: str, lengths: tuple[int, ...] = LENGTHS, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all n-grams of the lower-cased text, one after the other."""
    low = f" {text.lower()} ".encode("utf-32-le", "surrogatepass")
    points = np.frombuffer(low, dtype=np.uint32).astype(np.uint64)
    shift = np.uint64(64 - buckets.bit_length() + 1)
    out, gram = [], np.zeros(len(points), dtype=np.uint64)
    for n in range(1, max(lengths) + 1):
        size = len(points) - n + 1
        if size < 1:
            break
        gram = (gram[:size] + points[n - 1 :] + np.uint64(n)) * _MIX
        gram ^= gram >> np.uint64(29)
        if n in lengths:
            out.append(((gram * _MIX) >> shift).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def has_letter(text: str | None) -> bool:
    return bool(text) and bool(_LETTER.search(text))


def _pieces(text: str, size: int = 1 << 20) -> Iterator[str]:
    """A very long text in pieces, so that its n-grams need bounded memory."""
    for at in range(0, max(len(text), 1), size):
        yield text[at : at + size]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    documents: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if lang not in totals:
                totals[lang] = np.zeros(BUCKETS, np.int64)
            documents[lang] = documents.get(lang, 0) + 1
            for piece in _pieces(text.as_py() or ""):
                totals[lang] += np.bincount(gram_buckets(piece), minlength=BUCKETS)
    for lang, counts in totals.items():
        used = np.flatnonzero(counts)
        # Bucket -1 counts the documents.
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * (len(used) + 1), pa.string()),
                pa.array(np.append(used, -1), pa.int32()),
                pa.array(np.append(counts[used], documents[lang]), pa.int64()),
            ],
            names=["lang", "bucket", "n"],
        )


@dataclass(frozen=True)
class Model:
    """Languages in alphabetical order, log-probabilities (buckets x languages), log-priors."""

    languages: tuple[str, ...]
    grams: np.ndarray
    priors: np.ndarray


def train(df: DataFrame, lang: str = "lang", text: str = "text", smoothing: float = 0.5) -> Model:
    """Fit on all rows with a language; texts without a letter teach nothing.

    No languages at all give a model that always answers ``und``.
    """
    labelled = df.select(F.col(lang).cast("string"), F.col(text)).where(
        F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")
    )
    counts = labelled.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = stored(counts, "gram-counts")  # read twice
    names = [r[0] for r in counts.where("bucket = -1").select("lang").limit(MAX_LANGUAGES + 1).collect()]
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # Languages times buckets at most: bounded by the two parameters above.
    rows = counts.toPandas() if names else pd.DataFrame({"lang": [], "bucket": [], "n": []})
    languages = tuple(sorted(names))
    table = np.zeros((BUCKETS, max(len(languages), 1)))
    documents = np.ones(max(len(languages), 1))
    index = {k: i for i, k in enumerate(languages)}
    for name, part in rows.groupby("lang"):
        grams = part[part.bucket >= 0]
        table[grams.bucket.to_numpy(), index[name]] = grams.n.to_numpy()
        documents[index[name]] = part.loc[part.bucket < 0, "n"].iloc[0]
    table = np.log(table + smoothing) - np.log(table.sum(axis=0) + smoothing * BUCKETS)
    return Model(languages, table.astype(np.float32), np.log(documents / documents.sum()))


def score(model: Model, text: str) -> np.ndarray:
    """Log-likelihood of a text in each language, with the prior."""
    total = model.priors.copy()
    for piece in _pieces(text):
        used, times = np.unique(gram_buckets(piece), return_counts=True)
        total += times.astype(np.float64) @ model.grams[used]
    return total


def predict(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", unknown: str = "und") -> DataFrame:
    """One row per input row: doc_id, lang_pred and score, the posterior probability.

    Null texts and such without a letter are ``und`` with score 0; ties go to the first language
    in alphabetical order; only the key and the text are read.
    """
    shared = df.sparkSession.sparkContext.broadcast((model.languages, model.grams, model.priors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for batch in batches:
            langs, scores = [], []
            for cell in batch.column(1):
                value = cell.as_py()
                if not m.languages or not has_letter(value):
                    langs.append(unknown)
                    scores.append(0.0)
                    continue
                total = score(m, value)
                best = int(total.argmax())
                langs.append(m.languages[best])
                scores.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text)).mapInArrow(
        run, "doc_id long, lang_pred string, score double"
    )


def held_out(key: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether crc32 of the key as text leaves remainder ``fold``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == fold
