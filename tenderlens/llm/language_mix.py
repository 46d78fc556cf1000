"""Language identification of texts in several languages.

Each language is a distribution over hashed letter trigrams. Expectation-maximisation finds
the proportions of a mixture of languages under which a text's trigrams are most likely, and
languages join the set while they raise the likelihood by more than a penalty for each.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlens.llm.common import claim_caches, ship, table

BUCKETS = 1 << 16
MAX_LANGUAGES = 500
UNKNOWN = "und"
SMOOTHING = 0.05
ROUNDS = 25
SLICE = 1 << 20
_LETTER = regex.compile(r"\p{L}")
_OTHER = re.compile(r"[\W\d_]+")
_COUNTS_DDL = "lang string, bucket int, n long"
_RESULT_DDL = "lang_pred string, score double, languages array<string>, proportions array<double>, likelihood double"


def trigram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the letter trigrams of the whole text, words set off by one space.

    Texts beyond ``SLICE`` characters are counted slice by slice, so memory is bounded; a cut
    counts as the edge of a word.
    """
    total = None
    for at in range(0, len(text), SLICE):
        plain = " " + _OTHER.sub(" ", text[at : at + SLICE]).lower() + " "
        codes = np.frombuffer(plain.encode("utf-32-le"), np.uint32).astype(np.uint64)
        keys = (codes[:-2] * np.uint64(0x9E3779B1) + codes[1:-1] * np.uint64(0x85EBCA77) + codes[2:] * np.uint64(0xC2B2AE3D)) & np.uint64(0xFFFFFFFF)
        keys = ((keys ^ (keys >> np.uint64(15))) * np.uint64(0x2C1B3C6D) & np.uint64(0xFFFFFFFF)) >> np.uint64(16)
        counts = np.bincount(keys.astype(np.int64), minlength=BUCKETS)
        total = counts if total is None else total + counts
    if total is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    used = np.flatnonzero(total)
    return used, total[used]


def learn_counts(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over every whole text with a language. Tasks send sums; null text or lang is skipped."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_caches("language_mix")
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text and _LETTER.search(text):
                    buckets, counts = trigram_counts(text)
                    if lang not in sums:
                        sums[lang] = np.zeros(BUCKETS, np.int64)
                    sums[lang][buckets.astype(np.int64)] += counts
        for lang, total in sums.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used)), pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["lang", "bucket", "n"]
            )

    pairs = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    return pairs.mapInArrow(count, _COUNTS_DDL).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Trigram probabilities of each language: at most ``MAX_LANGUAGES`` times ``BUCKETS`` numbers."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + SMOOTHING
        self.probability = (smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float64) if languages else counts

    @classmethod
    def learn(cls, docs: DataFrame) -> LanguageModel:
        rows = learn_counts(docs).groupBy("lang").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n"))
        found = rows.limit(MAX_LANGUAGES + 1).collect()
        if len(found) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages: is this column a language?")
        found.sort(key=lambda r: r["lang"])
        counts = np.zeros((len(found), BUCKETS))
        for row, r in zip(counts, found):
            row[r["b"]] = r["n"]
        return cls([r["lang"] for r in found], counts)

    def infer(self, text: str | None) -> tuple[str, float, list[str], list[float], float]:
        """(language, its proportion, chosen languages, their proportions, mean log-likelihood over an even chance)."""
        if not text or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0, [], [], 0.0
        buckets, counts = trigram_counts(text)
        given = self.probability[:, buckets]
        n = counts.sum()
        single = np.log(given) @ counts
        chosen = [int(single.argmax())]
        share, best = np.ones(1), single.max()
        # A language costs one proportion: half the logarithm of the sample, and at least a hundredth of the text.
        penalty = 0.5 * np.log(n) + 2.0
        while len(chosen) < len(self.languages):
            mix = share @ given[chosen]
            gains = [
                (float(np.log(0.9 * mix + 0.1 * given[k]) @ counts), k) for k in range(len(self.languages)) if k not in chosen
            ]
            _, k = max(gains)
            shares, value = self._proportions(given[chosen + [k]], counts, n)
            if value - best <= penalty or shares[-1] < 0.01:
                break
            chosen, share, best = chosen + [k], shares, value
        order = np.argsort(-share, kind="stable")
        names = [self.languages[chosen[i]] for i in order]
        return names[0], float(min(1.0, share[order[0]])), names, [float(s) for s in share[order]], float(best / n + np.log(BUCKETS))

    @staticmethod
    def _proportions(given: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, float]:
        share = np.full(len(given), 1 / len(given))
        for _ in range(ROUNDS):
            owed = share[:, None] * given
            owed /= owed.sum(axis=0)
            new = owed @ counts / n
            moved = np.abs(new - share).max()
            share = new
            if moved < 1e-4:
                break
        return share, float(np.log(share @ given) @ counts)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with lang_pred, score, languages, proportions and likelihood (replaced if there).

    Only the text is looked at, whole. A null text, or one without a letter, is ``und`` with
    score 0 and no languages. Ties go to the language that sorts first. All other columns and
    repeated rows stay; an empty table, or a model without languages, is fine. ``likelihood`` is the mean
    logarithm by which the mixture beats an even chance for all trigrams.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    results = ["lang_pred", "score", "languages", "proportions", "likelihood"]
    names = [c for c in docs.columns if c not in results]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_caches("language_mix")
        learned = shared.value
        for batch in batches:
            rows = [learned.infer(t.as_py()) for t in batch.column(batch.schema.get_field_index("text"))]
            found = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(c, k) for c, k in zip(found, kinds))], names=[*names, *results]
            )

    kept = docs.select(*names)
    fields = [*kept.schema.fields, *docs.sparkSession.createDataFrame([], _RESULT_DDL).schema.fields]
    return kept.mapInArrow(predict, type(kept.schema)(fields))


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def learn_from(docs: DataFrame) -> LanguageModel:
    """The model of all documents that aren't held out; a null doc_id counts as held out."""
    return LanguageModel.learn(docs.filter(~F.coalesce(held_out(F.col("doc_id")), F.lit(True))).select("text", "lang"))


def op10_language_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn_from(docs)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(True)).alias("held_out"), "lang_pred", "score",
        "languages", "proportions",
    )
