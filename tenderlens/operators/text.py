"""TF-IDF similarity between the requested and the offered text of each offer line.

Work is done once per distinct text and once per distinct text pair. Each text becomes
one sparse vector row, so no join key ever multiplies terms by pairs; terms are counted
inside a text's row, and of all terms only those that may be frequent enough are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlens.config import LOST, WON, TextSettings
from tenderlens.functions.text import one_two_grams, text_hash, tokens
from tenderlens.functions.vectors import dense_dot, sparse_dot
from tenderlens.operators.selection import layout_positions, top_by_count
from tenderlens.session import stored, stored_meanwhile

SIDE_A, SIDE_B = "item_text", "offer_text"
# Different terms that a task adds up before it hands them on, some 50 MB.
HELD_TERMS = 200_000
# A vocabulary of so many terms (some 20 MB) may travel to every task.
LISTED_TERMS = 200_000
# Characters of texts whose grams are looked at together, some 60 MB of arrays.
SLICE_CHARS = 2_000_000
# Terms are added up in 2 ** 20 buckets first; a part of them is a row of the shuffle.
SKETCH_BITS, SKETCH_PARTS = 20, 64


def with_text_hashes(offers: DataFrame) -> DataFrame:
    """Add the keys of both texts; a missing text counts as the empty one."""
    return offers.withColumns({"a_hash": text_hash(F.col(SIDE_A)), "b_hash": text_hash(F.col(SIDE_B))})


def corpus(offers: DataFrame) -> DataFrame:
    """Distinct texts of both sides; ``copies`` is 2 for a text found on both.

    Copies merge before the one shuffle of texts. ``slot`` spreads what is made of them.
    """
    sides = F.inline(F.array(
        F.struct(F.col("a_hash").alias("text_hash"), F.coalesce(SIDE_A, F.lit("")).alias("text"),
                 F.lit(1).alias("in_a"), F.lit(0).alias("in_b")),
        F.struct(F.col("b_hash").alias("text_hash"), F.coalesce(SIDE_B, F.lit("")).alias("text"),
                 F.lit(0).alias("in_a"), F.lit(1).alias("in_b")),
    ))
    return (
        offers.select(sides)
        # A hash stands for one text, and as a key the text lets copies merge by hashing, without a sort.
        .groupBy("text_hash", "text")
        .agg((F.max("in_a") + F.max("in_b")).alias("copies"))
        .withColumn("slot", F.xxhash64("text_hash"))
    )


def word_lists(texts: DataFrame) -> DataFrame:
    """The words of every text, a blank between them (no word holds one); cutting them is the dear part, so store
    this where it is read twice."""
    return texts.select("slot", "text_hash", "copies", F.array_join(tokens(F.col("text")), " ").alias("words"))


def term_counts(words: DataFrame) -> DataFrame:
    """Occurrences of every 1-2-gram per text."""
    cut = F.filter(F.split("words", " "), lambda w: w != "")
    return (
        words.select("slot", "text_hash", "copies", F.explode(one_two_grams(cut)).alias("term"))
        .groupBy("slot", "text_hash", "copies", "term")
        .agg(F.count("*").alias("tf"))
    )


def _slices(batch: pa.RecordBatch, *columns: str) -> Iterator[pa.RecordBatch]:
    """Rows of some ``SLICE_CHARS`` in these columns at a time."""
    ends = np.cumsum(sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype("i8") for c in columns))
    cuts = np.flatnonzero(np.diff(ends // SLICE_CHARS)) + 1
    for low, high in pairwise([0, *cuts.tolist(), batch.num_rows]):
        if low < high:
            yield batch.slice(low, high - low)


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """The 1-2-grams of word lists: the text each is in, its first and its second word (0: none), and all words from
    number 1 on."""
    lists = pc.split_pattern(texts, " ")
    at = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    coded = lists.flatten().dictionary_encode()
    known, word = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype("i8") + 1
    if "" in known:  # a text without words is split into one empty word
        some = word != known.index("") + 1
        at, word = at[some], word[some]
    near = at[1:] == at[:-1]
    first, second = word[:-1][near], word[1:][near]
    return np.r_[at, at[:-1][near]], np.r_[word, first], np.r_[np.zeros_like(word), second], known


def _buckets(first: np.ndarray, second: np.ndarray, known: list[str], seen: dict[str, int]) -> np.ndarray:
    """The bucket of each gram, the same in every task; ``seen`` keeps the hashes of words."""
    for w in known:
        if w not in seen:
            seen[w] = int.from_bytes(blake2b(w.encode(), digest_size=8).digest(), "little")
    h = np.array([0, *(seen[w] for w in known)], "u8")
    if len(seen) > HELD_TERMS:
        seen.clear()
    mixed = h[first] * np.uint64(0x9E3779B97F4A7C15) + h[second] * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(64 - SKETCH_BITS)).astype("i8")


def _bucket_counts(words: DataFrame) -> np.ndarray:
    """Occurrences of terms by bucket, times ``copies``: no term occurs more often than its bucket says."""
    buckets_of, grams, slices, n = _buckets, _grams, _slices, 2**SKETCH_BITS
    size = n // SKETCH_PARTS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(n), {}
        for batch in batches:
            for part in slices(batch, "words"):
                at, first, second, known = grams(part.column("words"))
                copies = part.column("copies").to_numpy(zero_copy_only=False)
                counts += np.bincount(buckets_of(first, second, known, seen), copies[at], n)
        kind = "u4" if counts.max() < 2**32 else "u8"
        parts = [counts[i : i + size].astype(kind).tobytes() for i in range(0, n, size)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_PARTS), "int32"), pa.array(parts, "binary")], ["part", "counts"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
                sums[part] = sums.get(part, 0) + np.frombuffer(counts, f"u{len(counts) // size}").astype("i8")
        yield pa.RecordBatch.from_arrays([pa.array(sums, "int32"), pa.array([x.tobytes() for x in sums.values()], "binary")], ["part", "counts"])

    schema = "part int, counts binary"
    partial = words.select("copies", "words").mapInArrow(counted, schema).repartition(SKETCH_PARTS // 4, "part")
    found = {r["part"]: np.frombuffer(r["counts"], "i8") for r in partial.mapInArrow(added, schema).collect()}
    return np.concatenate([found.get(i, np.zeros(size, "i8")) for i in range(SKETCH_PARTS)])


def _likely_cut(counts: np.ndarray, terms: int) -> int:
    """A count that more than ``terms`` terms are likely to reach, 0 where bucket counts don't tell. A bucket holds
    many rare terms beside a frequent one, as many as the median bucket."""
    rank = terms + terms // 3
    if rank >= np.count_nonzero(counts):
        return 0
    return max(0, int(np.partition(counts, -rank)[-rank] - 2 * np.median(counts)))


def term_totals(words: DataFrame, held: int = HELD_TERMS, heavy: np.ndarray | None = None) -> DataFrame:
    """Per term its texts and occurrences, both times ``copies``. A text's terms are counted in its own row and added
    up over the texts of a task, ``held`` terms at a time, so no row for each term of each text is ever made. With
    ``heavy``, only terms of these buckets."""
    buckets_of, grams, slices = _buckets, _grams, _slices
    shared = None if heavy is None else words.sparkSession.sparkContext.broadcast(heavy)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, int] = {}
        sums: list[tuple[np.ndarray, ...]] = []
        seen: dict[str, int] = {}

        def merged() -> tuple[np.ndarray, ...]:
            if not sums:
                return (np.zeros(0, "i8"),) * 3
            term, *counts = (np.concatenate(c) for c in zip(*sums))
            term, at = np.unique(term, return_inverse=True)
            return term, *(np.bincount(at, c, len(term)).astype("i8") for c in counts)

        def rows() -> pa.RecordBatch:
            term, in_texts, occurs = merged()
            known = pa.array(numbers, "string")
            first, second = known.take(pa.array((term >> 32) - 1)), known.take(pa.array((term & 0xFFFFFFFF) - 1, mask=term & 0xFFFFFFFF == 0))
            joined = pc.binary_join_element_wise(first, second, " ", null_handling="skip")
            return pa.RecordBatch.from_arrays([joined, pa.array(in_texts), pa.array(occurs)], ["term", "n_texts", "occurrences"])

        for batch in batches:
            for part in slices(batch, "words"):
                at, first, second, known = grams(part.column("words"))
                if shared is not None:
                    kept = shared.value[buckets_of(first, second, known, seen)]
                    at, first, second = at[kept], first[kept], second[kept]
                n = len(known) + 1
                found, tf = np.unique((at * n + first) * n + second, return_counts=True)
                copies = part.column("copies").to_numpy(zero_copy_only=False)[found // (n * n)]
                term, which = np.unique(found % (n * n), return_inverse=True)
                number = np.array([0, *(numbers.setdefault(w, len(numbers) + 1) for w in known)])
                own = number[term // n] << 32 | number[term % n]
                sums.append((own, np.bincount(which, copies, len(term)), np.bincount(which, copies * tf, len(term))))
                if sum(len(x[0]) for x in sums) >= 4 * held:
                    sums[:] = [merged()]
                    if len(sums[0][0]) >= held:
                        yield rows()
                        sums.clear(), numbers.clear()
        yield rows()

    partial = words.select("copies", "words").mapInArrow(totals, "term string, n_texts long, occurrences long")
    return partial.groupBy("term").agg(F.sum("n_texts").alias("n_texts"), F.sum("occurrences").alias("occurrences"))


def _most_frequent(words: DataFrame, min_texts: int, terms: int) -> DataFrame:
    """``top_by_count`` of the terms in enough texts, without counting all others one by one. Every term that occurs
    ``least`` times is in a bucket that does, and is counted exactly; where as many as asked for do, no other term can
    be among them. Else ``least`` was set too high."""
    counts = _bucket_counts(words)
    least = _likely_cut(counts, terms)
    while True:
        counted = term_totals(words, heavy=counts >= least if least > 1 else None)
        frequent = stored(counted.filter(F.col("n_texts") >= min_texts))
        if least <= 1 or frequent.filter(F.col("occurrences") >= least).limit(terms).count() == terms:
            return top_by_count(frequent, "occurrences", "term", terms)
        least //= 4


def fit_vocabulary(
    texts: DataFrame, settings: TextSettings = TextSettings(), words: DataFrame | None = None
) -> DataFrame:
    """Terms in enough texts, the most frequent ones first, with smoothed idf.

    At most ``max_terms`` rows; equal frequencies are cut in term order. Terms are numbered
    in the range layout, so without a limit the table may have any size. ``words`` are the
    stored word lists of the texts.
    """
    if words is None:
        with stored_meanwhile(word_lists(texts)) as words:
            return fit_vocabulary(words, settings, words)
    n_texts = F.lit(words.agg(F.sum("copies").alias("n")).first()["n"])
    if settings.max_terms is not None:
        frequent = _most_frequent(words, settings.min_texts, settings.max_terms)
    else:
        frequent = term_totals(words).filter(F.col("n_texts") >= settings.min_texts)
    return layout_positions(frequent, [], [F.desc("occurrences"), F.asc("term")], "term_id").select(
        F.col("term_id").cast("int"),
        "term",
        "n_texts",
        "occurrences",
        (F.log((1 + n_texts) / (1 + F.col("n_texts"))) + 1).alias("idf"),
    )


@dataclass
class _Lookup:
    """A vocabulary in arrays: numbers of its words from 1 on, its terms as numbers of both words in their order, the
    id of each, and idf by id."""

    numbers: dict[str, int]
    terms: np.ndarray
    ids: np.ndarray
    idf: np.ndarray

    def terms_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, id and frequency of each known term of each word list, in this order."""
        at, first, second, known = _grams(texts)
        number = np.array([0, *(self.numbers.get(w, -1) for w in known)])
        first, second = number[first], number[second]
        some = (first > 0) & (second >= 0)
        at, term = at[some], first[some] << 32 | second[some]
        place = np.minimum(np.searchsorted(self.terms, term), max(0, len(self.terms) - 1))
        hit = self.terms[place] == term if len(self.terms) else np.zeros(len(term), bool)
        found, tf = np.unique(at[hit] * len(self.idf) + self.ids[place[hit]], return_counts=True)
        n = max(1, len(self.idf))
        return found // n, found % n, tf


def _lookup(vocabulary: DataFrame, listed: int) -> _Lookup | None:
    """None where the vocabulary has more than ``listed`` terms."""
    known = vocabulary.select("term", "term_id", "idf").limit(listed + 1).collect()
    if len(known) > listed:
        return None
    numbers: dict[str, int] = {}
    pairs = [[numbers.setdefault(w, len(numbers) + 1) for w in r["term"].split(" ")] for r in known]
    terms = np.array([p[0] << 32 | (p[1] if len(p) > 1 else 0) for p in pairs], "i8")
    ids, order = np.array([r["term_id"] for r in known], "i8"), np.argsort(terms)
    idf = np.zeros(ids.max(initial=-1) + 1)
    idf[ids] = [r["idf"] for r in known]
    return _Lookup(numbers, terms[order], ids[order], idf)


def _to_varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes of seven bits, all but the last of a number marked; and where each ends."""
    size = 1 + sum((values >> 7 * k > 0).astype("i8") for k in range(1, 5))
    ends = np.cumsum(size)
    data = np.zeros(ends[-1] if len(ends) else 0, "u1")
    for k in range(size.max(initial=0)):
        longer = size > k
        data[(ends - size)[longer] + k] = values[longer] >> 7 * k & 127 | np.where(size[longer] > k + 1, 128, 0)
    return data, ends


def _from_varints(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128) + 1
    size = np.diff(np.r_[0, ends])
    shift = 7 * (np.arange(len(data)) - np.repeat(ends - size, size))
    return np.add.reduceat((data & 127).astype("i8") << shift, ends - size) if len(ends) else ends


def _packed_terms(at: np.ndarray, ids: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The texts with terms, and for each its terms in a few bytes: steps from id to id, each with its frequency."""
    first = np.flatnonzero(np.diff(at, prepend=-1))
    steps = np.diff(ids, prepend=0)
    steps[first] = ids[first]
    data, ends = _to_varints(np.stack([steps, tf], 1).ravel())
    offsets = np.r_[0, ends[2 * np.r_[first[1:], len(ids)] - 1]] if len(ids) else np.zeros(1)
    packed = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.astype("i4")), pa.py_buffer(data)])
    return at[first], packed


def _unpacked_terms(packed: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, id and frequency of each term of packed ones; a null has none."""
    _, offsets, data = packed.buffers()
    ends = np.frombuffer(offsets, "i4")[packed.offset : packed.offset + len(packed) + 1]
    data = np.frombuffer(data, "u1")[ends[0] : ends[-1]] if data else np.zeros(0, "u1")
    values = _from_varints(data)
    n_terms = np.diff(np.r_[0, np.cumsum(data < 128)][ends - ends[0]]) // 2
    at, steps = np.repeat(np.arange(len(packed)), n_terms), values[::2]
    summed = np.cumsum(steps)
    first = np.cumsum(n_terms) - n_terms
    some = n_terms > 0
    base = np.zeros(len(packed), "i8")
    base[some] = summed[first[some]] - steps[first[some]]
    return at, summed - base[at], values[1::2]


def tfidf_vectors(
    texts: DataFrame, vocabulary: DataFrame, words: DataFrame | None = None, listed: int = LISTED_TERMS, packed: bool = False
) -> DataFrame:
    """One sparse unit vector per text with at least one known term. A vocabulary of ``listed`` terms at most travels
    to the tasks, which look up the terms of a text in its own row; a larger one is joined. ``packed`` keeps ids and
    frequencies instead, in some two bytes a term, for ``pair_cosines``; not with a larger vocabulary."""
    words = word_lists(texts) if words is None else words
    vocabulary = stored(vocabulary.select("term", "term_id", "idf"))
    lookup = _lookup(vocabulary, listed)
    if lookup is None:
        return _joined_vectors(words, vocabulary)
    shared = words.sparkSession.sparkContext.broadcast(lookup)
    slices, pack = _slices, _packed_terms

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        kind = pa.list_(pa.struct([("id", pa.int32()), ("w", pa.float64())]))
        for batch in batches:
            for part in slices(batch, "words"):
                at, ids, tf = of.terms_of(part.column("words"))
                if packed:
                    kept, terms = pack(at, ids, tf)
                    columns, names = [terms], ["terms"]
                else:
                    w = tf * of.idf[ids]
                    first = np.flatnonzero(np.diff(at, prepend=-1))
                    kept, norms = at[first], np.sqrt(np.add.reduceat(w * w, first)) if len(first) else w
                    entries = pa.StructArray.from_arrays([pa.array(ids, "int32"), pa.array(w)], fields=[*kind.value_type])
                    terms = pa.ListArray.from_arrays(pa.array(np.r_[first, len(ids)], "int32"), entries, type=kind)
                    columns, names = [pa.array(norms), terms], ["norm", "terms"]
                own = part.select(["slot", "text_hash"]).take(pa.array(kept, "int64"))
                yield pa.RecordBatch.from_arrays([*own.columns, *columns], ["slot", "text_hash", *names])

    of_terms = "terms binary" if packed else "norm double, terms array<struct<id: int, w: double>>"
    return words.select("slot", "text_hash", "words").mapInArrow(vectors, f"slot long, text_hash string, {of_terms}")


def _joined_vectors(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    weighted = term_counts(words).join(vocabulary, "term").select(
        "slot", "text_hash", "term_id", (F.col("tf") * F.col("idf")).alias("w")
    )
    return weighted.groupBy("slot", "text_hash").agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"),
        F.collect_list(F.struct(F.col("term_id").alias("id"), F.col("w").alias("w"))).alias("terms"),
    )


def pair_lines(hashed: DataFrame, with_text: bool = False) -> DataFrame:
    """Winning and losing lines per (tender, text pair). This narrow table replaces the
    texts in everything that follows, so a pair repeated over millions of lines of a
    tender is shuffled once. ``with_text`` keeps the texts beside their hashes, a missing one
    as the empty one, so that ``corpus`` can read them off this table once it is stored."""
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in (SIDE_A, SIDE_B)] if with_text else []
    return hashed.groupBy("tender_id", "a_hash", "b_hash", *texts).agg(
        F.count_if(F.col("outcome") == WON).alias("n_won"), F.count_if(F.col("outcome") == LOST).alias("n_lost")
    )


def distinct_pairs(lines: DataFrame) -> DataFrame:
    return lines.select("a_hash", "b_hash").distinct()


def pair_cosines(pairs: DataFrame, vectors: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """Cosine of each text pair; 0 when either text has no known term. Packed vectors need their vocabulary."""
    if dict(vectors.dtypes)["terms"] == "binary":
        return _packed_cosines(pairs, vectors, vocabulary)
    a = vectors.select(F.col("text_hash").alias("a_hash"), F.col("norm").alias("a_norm"), F.col("terms").alias("a_terms"))
    b = vectors.select(F.col("text_hash").alias("b_hash"), F.col("norm").alias("b_norm"), F.col("terms").alias("b_terms"))
    return pairs.join(a, "a_hash", "left").join(b, "b_hash", "left").select(
        "a_hash",
        "b_hash",
        F.coalesce(
            sparse_dot(F.col("a_terms"), F.col("b_terms")) / (F.col("a_norm") * F.col("b_norm")), F.lit(0.0)
        ).alias("similarity"),
    )


def _packed_cosines(pairs: DataFrame, vectors: DataFrame, vocabulary: DataFrame) -> DataFrame:
    known = vocabulary.select("term_id", "idf").collect()
    idf = np.zeros(max((r["term_id"] for r in known), default=-1) + 1)
    idf[[r["term_id"] for r in known]] = [r["idf"] for r in known]
    shared = pairs.sparkSession.sparkContext.broadcast(idf)
    slices, unpacked = _slices, _unpacked_terms

    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared.value
        for batch in batches:
            for part in slices(batch, "a_terms", "b_terms"):
                n = part.num_rows
                sides = [unpacked(part.column(c)) for c in ("a_terms", "b_terms")]
                (a, a_w), (b, b_w) = ((at * len(idf) + ids, tf * idf[ids]) for at, ids, tf in sides)
                norms = [np.sqrt(np.bincount(at, w * w, n)) for (at, *_), w in zip(sides, (a_w, b_w))]
                place = np.minimum(np.searchsorted(b, a), max(0, len(b) - 1))
                hit = np.flatnonzero(b[place] == a) if len(b) else place[:0]
                dots = np.bincount(sides[0][0][hit], a_w[hit] * b_w[place[hit]], n)
                scale = norms[0] * norms[1]
                similarity = np.divide(dots, scale, out=np.zeros(n), where=scale > 0)
                yield pa.RecordBatch.from_arrays([part.column("a_hash"), part.column("b_hash"), pa.array(similarity)], ["a_hash", "b_hash", "similarity"])

    a, b = (vectors.select(F.col("text_hash").alias(f"{x}_hash"), F.col("terms").alias(f"{x}_terms")) for x in "ab")
    joined = pairs.join(a, "a_hash", "left").join(b, "b_hash", "left").select("a_hash", "b_hash", "a_terms", "b_terms")
    return joined.mapInArrow(cosines, "a_hash string, b_hash string, similarity double")


def lexical_similarity(
    hashed: DataFrame, settings: TextSettings = TextSettings(), pairs: DataFrame | None = None, listed: int = LISTED_TERMS
) -> DataFrame:
    """TF-IDF cosine per distinct (a_hash, b_hash) of the hashed offer lines.

    Texts are cut into words once; word lists and vectors are stored, as both are read twice, and word lists are
    deleted once the vectors are there.
    """
    pairs = stored(distinct_pairs(hashed)) if pairs is None else pairs
    with stored_meanwhile(word_lists(corpus(hashed))) as words:
        vocabulary = stored(fit_vocabulary(words, settings, words))
        vectors = stored(tfidf_vectors(words, vocabulary, words, listed, packed=True))
    return pair_cosines(pairs, vectors, vocabulary)


def delta_similarity(lines: DataFrame, pair_similarity: DataFrame, suffix: str) -> DataFrame:
    """Per tender: mean similarity of winning lines, of losing lines, and the difference.

    ``lines`` are counts per (tender, pair), see ``pair_lines``.
    """
    scored = (
        lines.filter((F.col("n_won") > 0) | (F.col("n_lost") > 0))
        .join(pair_similarity, ["a_hash", "b_hash"])
        .filter(F.col("similarity").isNotNull())
    )

    def mean(n: str):
        total = F.sum(n)
        return F.when(total > 0, F.sum(F.col(n) * F.col("similarity")) / total)

    means = scored.groupBy("tender_id").agg(mean("n_won").alias("w"), mean("n_lost").alias("l"))
    return means.select(
        "tender_id",
        F.col("w").alias(f"sim_won_{suffix}"),
        F.col("l").alias(f"sim_lost_{suffix}"),
        (F.col("w") - F.col("l")).alias(f"delta_sim_{suffix}"),
    )


def dense_similarity(pairs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Dot product of the unit vectors of each text pair; null when one is missing."""
    a = embeddings.select(F.col("text_hash").alias("a_hash"), F.col("embedding").alias("a_vec"))
    b = embeddings.select(F.col("text_hash").alias("b_hash"), F.col("embedding").alias("b_vec"))
    return pairs.join(a, "a_hash", "left").join(b, "b_hash", "left").select(
        "a_hash", "b_hash", dense_dot(F.col("a_vec"), F.col("b_vec")).alias("similarity")
    )
