"""Language identification by multilingual mixture inference.

Each language has a smoothed distribution over hashed character trigrams.  A document is a mixture of languages:
expectation-maximisation estimates the proportions from its trigram counts, first over all languages, then over the
set that a penalised likelihood (BIC, with trigram counts divided by their overlap) selects by forward search, in the
order of those first proportions and down to ``least_share``.  The language with
the largest proportion is the prediction, the proportion its score.  One more component, flat over the hash space,
stands for text of no learned language; ``noise`` is its proportion.

The model is fitted on at most ``most_per_language`` labelled documents of each language (those with the least keyed
hash of their id), whole texts; every document is scored over its whole text, in linear time.

Edge cases: null text or text without a letter is ``und`` with score 0; no labelled documents: everything is ``und``;
repeated rows are scored each; ties go to the language first by code point; empty tables give none.  More than
``MOST_LANGUAGES`` distinct languages are refused, as the model goes to every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldstone.llm.common import small_enough, stored

BUCKETS = 1 << 14
UND = "und"
_LETTER = regex.compile(r"\p{L}")
MOST_LANGUAGES = 1000
#: ASCII bytes other than letters part words; bytes of other characters stay.
_TABLE = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_PIECE = 1 << 20


def trigram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets and counts of the byte trigrams of the text's letters; None without a letter."""
    if not text or not _LETTER.search(text):
        return None
    letters = b" ".join(text.lower().encode("utf-8", "replace").translate(_TABLE).split())
    raw = np.frombuffer(b" " + letters + b" ", np.uint8)
    total = np.zeros(BUCKETS, np.int64)
    for k in range(0, max(1, len(raw) - 2), _PIECE):
        b = raw[k : k + _PIECE + 2].astype(np.uint32)
        if len(b) >= 3:
            code = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))
            total += np.bincount(((code * np.uint32(0x27D4EB2F)) >> np.uint32(32 - 14)).astype(np.int64), minlength=BUCKETS)
    at = total.nonzero()[0]
    return at, total[at]


@dataclass
class Model:
    languages: list[str]
    p: np.ndarray  # (BUCKETS, languages + 1); the last is the flat component

    def infer(self, text: str | None, *, overlap: float = 3.0, rounds: int = 12, least_share: float = 0.02) -> tuple[str, float, float]:
        """(language, score, noise)."""
        grams = trigram_counts(text) if self.languages else None
        if grams is None:
            return UND, 0.0, 1.0
        at, counted = grams
        count = counted.astype(np.float64)
        n = float(count.sum())
        rows = self.p[at]
        flat = len(self.languages)

        def mixture(chosen: list[int]) -> tuple[np.ndarray, np.ndarray]:
            p = rows if chosen == list(range(flat)) else rows[:, [*chosen, flat]]
            mix = np.full(p.shape[1], 1.0 / p.shape[1])
            for _ in range(rounds):
                mix *= (count / (p @ mix)) @ p
                mix /= n
            return mix, p

        def penalised(mix: np.ndarray, p: np.ndarray) -> float:
            return float(count @ np.log(p @ mix)) / overlap - 0.5 * len(mix) * np.log(max(2.0, n / overlap))

        full, _ = mixture(list(range(flat)))
        order = np.argsort(-full[:flat], kind="stable").tolist()
        chosen = [order[0]]
        mix, p = mixture(chosen)
        rest = [k for k in order[1:] if full[k] >= least_share]
        best = penalised(mix, p) if rest else 0.0
        for k in rest:
            other, p = mixture([*chosen, k])
            if (value := penalised(other, p)) > best:
                best, mix, chosen = value, other, [*chosen, k]
        shares = dict(zip(chosen, mix[:-1].tolist()))
        top = max(sorted(shares), key=shares.get)
        return self.languages[top], min(1.0, max(0.0, shares[top])), float(mix[-1])


def fit(labelled: DataFrame, *, text_col: str, lang_col: str, id_col: str, most_per_language: int = 500) -> Model:
    """Fit on a bounded sample; the counts (languages x BUCKETS) are summed on the executors."""
    key = F.xxhash64(F.lit("langid"), F.col(id_col))
    first = W.partitionBy(lang_col).orderBy(key, F.col(id_col))
    # Thin rows choose the sample; texts are fetched after, by ids of which there are at most languages x most_per_language.
    chosen = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, lang_col).withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= most_per_language).select(F.col(id_col).alias("__id")).distinct()
    chosen = stored(chosen, "langid")
    if small_enough(chosen, MOST_LANGUAGES * most_per_language):
        chosen = F.broadcast(chosen)
    sample = labelled.where(F.col(lang_col).isNotNull()).join(chosen, F.col(id_col).eqNullSafe(F.col("__id")), "left_semi").select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                grams = trigram_counts(text.as_py())
                if grams is not None:
                    np.add.at(total.setdefault(lang, np.zeros(BUCKETS)), grams[0], grams[1])
        for lang, c in total.items():
            at = c.nonzero()[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang", "bucket", "n"])

    rows = sample.mapInArrow(count, "lang string, bucket int, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = stored(rows, "langid-counts")
    if not small_enough(rows.select("lang").distinct(), MOST_LANGUAGES):
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    rows = rows.toPandas()
    languages = sorted(set(rows["lang"]))
    counts = np.zeros((BUCKETS, len(languages)))
    for k, lang in enumerate(languages):
        own = rows[rows["lang"] == lang]
        counts[own["bucket"].to_numpy(), k] = own["n"].to_numpy()
    p = (counts + 0.05) / (counts + 0.05).sum(axis=0) if languages else counts
    flat = np.full((BUCKETS, 1), 1.0 / 4096)  # flat over the trigrams that letters make, not over the whole space
    return Model(languages, np.concatenate([p, flat], axis=1))


def predict(docs: DataFrame, model: Model, *, text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "noise")) -> DataFrame:
    """``docs`` with language, score and noise under ``names``; columns of these names are replaced."""
    docs = docs.drop(*names)
    schema = docs.select("*", F.lit("").alias(names[0]), F.lit(0.0).alias(names[1]), F.lit(0.0).alias(names[2])).schema
    place = docs.columns.index(text_col)
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [known.value.infer(x.as_py()) for x in batch.column(place)]
            cols = list(zip(*got)) if got else [(), (), ()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64())], [*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts`` (null: -1, in no held-out part)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(-1))
