"""Near-duplicate documents by consistent weighted sampling of TF-IDF word shingles.

Three readings of the texts: document frequencies of shingles into a table of fixed size, a
signature of consistent weighted samples for each text, and the weighted sets of those texts
that share a band with another. Texts of a band are tied to one of them, not paired with each
other; only texts that are still in different components are looked at again. Every link is
verified by weighted Jaccard similarity.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tenderlens.llm.common import claim_caches, few_files, keep_cache, components, digest, ship, shuffle_parts, stored, table

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 4
# Pairs whose signatures agree in fewer samples than this share are not measured: at the
# threshold that is more than four standard deviations below the mean.
LEAST_ESTIMATE = 0.55
# The frequency table: two rows of so many counters; the least of two is taken.
COUNTERS, SEGMENT = 1 << 20, 1 << 14
# How far frequency may move a weight: 1 for a shingle of all documents, 1 + IDF_SHARE for one
# of a single document. Small, or a large group of copies would lose its own links, since its
# shared shingles are frequent and its edits are not.
IDF_SHARE = 0.25
WORD_CACHE = 100_000
# Rows that a task answers at a time.
ANSWER = 1_000
# Members of a band that are compared with each other in one task.
BLOCK = 512
_WORD = re.compile(r"\w+")
_MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_hashes = _WordHash()
keep_cache("weighted_minhash", _hashes.clear)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX2
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(hashes in order, counts, digest of the words) of a whole text; fewer words than ``words`` are one shingle.

    Words are runs of letters, digits and underscores, in lower case. A text without words has no shingle.
    """
    found = _WORD.findall((text or "").lower())
    w = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    size = min(words, len(w))
    if not size:
        return w, np.empty(0, np.int64), b""
    h = np.zeros(len(w) - size + 1, np.uint64)
    for i in range(size):
        h = (h ^ w[i : len(w) - size + 1 + i]) * _MIX1
        h ^= h >> np.uint64(31)
    return *np.unique(_mixed(h), return_counts=True), xxhash.xxh3_128_digest(w.tobytes())


def row_key() -> list[F.Column]:
    """Tells rows of different doc_id or text apart; copies of one text under other doc_ids differ,
    so no join on it gathers them."""
    return digest(F.col("doc_id").cast("long"), F.col("text"))


def _cells(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(COUNTERS - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)


def _in_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), ANSWER):
            yield batch.slice(at, ANSWER)


def frequencies(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """Two rows of ``COUNTERS`` document frequencies over every document: 16 MB whatever the input."""
    ship(docs.sparkSession)
    segments = COUNTERS // SEGMENT

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_caches("weighted_minhash")
        sums, held, size = np.zeros((2, COUNTERS), np.int64), [], 0

        def add() -> None:
            for row, cells in zip(sums, _cells(np.concatenate(held))):
                row += np.bincount(cells, minlength=COUNTERS)

        for batch in batches:
            for text in batch.column(0):
                h, _, _ = shingles(text.as_py(), words)
                held.append(h)
                size += len(h)
                if size > COUNTERS // 4:
                    add()
                    held, size = [], 0
        if held:
            add()
        for segment in range(2 * segments):
            part = sums.reshape(-1, SEGMENT)[segment]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)])], names=["segment", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_caches("weighted_minhash")
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                new = np.frombuffer(zlib.decompress(counts.as_py()), np.int64)
                sums[segment] = sums[segment] + new if segment in sums else new
        for segment, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)])], names=["segment", "counts"])

    kind = "segment int, counts binary"
    sums = docs.select("text").mapInArrow(count, kind).repartition(min(shuffle_parts(docs.sparkSession), 2 * segments), "segment").mapInArrow(total, kind)
    found = np.zeros((2 * segments, SEGMENT), np.int64)
    for row in sums.collect():
        found[row["segment"]] = np.frombuffer(zlib.decompress(row["counts"]), np.int64)
    return found.reshape(2, COUNTERS)


def _gamma_quantiles(n: int = 1 << 16) -> np.ndarray:
    """Gamma(2, 1) at the middle of ``n`` equal steps of probability, by Newton's method."""
    p = (np.arange(n) + 0.5) / n
    x = np.sqrt(2 * p) + p
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / (x * np.exp(-x) + 1e-300), 1e-6)
    return x


_GAMMA = _gamma_quantiles().astype(np.float32)
_LOG_GAMMA = np.log(_GAMMA)


@dataclass
class Weights:
    """Weights by frequency: two tables of fixed size."""

    idf: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray, n_docs: int) -> Weights:
        n = max(n_docs, 1)
        return cls((1 + IDF_SHARE * np.log(n / np.clip(counts, 1, n)) / np.log(n + 1)).astype(np.float32))

    def __call__(self, h: np.ndarray, counts: np.ndarray) -> np.ndarray:
        a, b = _cells(h)
        return np.maximum(self.idf[0][a], self.idf[1][b]) * counts


def signature(h: np.ndarray, weights: np.ndarray, samples: int, chunk: int = 1024) -> np.ndarray:
    """Improved consistent weighted samples: two sets agree in each with probability their weighted Jaccard similarity.

    Sample k is the shingle of least ln a = ln c - r (t - b) - r with t = floor(ln w / r + b);
    r and c are Gamma(2, 1), b is uniform, all three read from the hash of shingle and k.
    """
    seeds = _mixed(np.arange(1, samples + 1, dtype=np.uint64) * _MIX1)
    best, chosen = np.full(samples, np.inf, np.float32), np.zeros(samples, np.uint64)
    low = np.uint64(0xFFFF)
    for at in range(0, len(h), chunk):
        part, logs = h[at : at + chunk], np.log(weights[at : at + chunk]).astype(np.float32)[:, None]
        z = _mixed((part[:, None] ^ seeds) * _MIX1)
        r = _GAMMA[(z & low).astype(np.intp)]
        c = _LOG_GAMMA[((z >> np.uint64(16)) & low).astype(np.intp)]
        b = ((z >> np.uint64(32)) & low).astype(np.float32) * np.float32(2**-16)
        t = np.floor(logs / r + b)
        a = c - r * (t - b + 1)
        least = a.argmin(axis=0)
        each = np.arange(samples)
        better = a[least, each] < best
        best[better] = a[least, each][better]
        value = _mixed((part[least] ^ (t[least, each].astype(np.int64).astype(np.uint64) * _MIX2)) * _MIX1)
        chosen[better] = value[better]
    return chosen


def weighted_similarity(x: np.ndarray, wx: np.ndarray, y: np.ndarray, wy: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sets of hashes in order."""
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = y[at] == x
    common = np.minimum(wx[both], wy[at[both]]).sum(dtype=np.float64)
    return float(common / (wx.sum(dtype=np.float64) + wy.sum(dtype=np.float64) - common))


def signatures(docs: DataFrame, weights, words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, t1, t2, id, signature, keys) of every document; id, the digest of the words, is null without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_caches("weighted_minhash")
        band = _mixed(np.arange(1, bands + 1, dtype=np.uint64) * _MIX2)
        for batch in _in_answers(batches):
            found = []
            for text in batch.column(3):
                h, counts, name = shingles(text.as_py(), words)
                if not name:
                    found.append((None, None, None))
                    continue
                s = signature(h, weights.value(h, counts), bands * rows)
                keys = band.copy()
                for column in s.reshape(bands, rows).T:
                    keys = _mixed((keys ^ column) * _MIX1)
                found.append((name, (s & np.uint64(0x7FFFFFFF)).astype(np.int32), keys.astype(np.int64)))
            ids, sigs, keys = zip(*found) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(ids, pa.binary()), pa.array(sigs, pa.list_(pa.int32())), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "t1", "t2", "id", "signature", "keys"],
            )

    t1, t2 = row_key()
    ddl = "doc_id long, t1 long, t2 long, id binary, signature array<int>, keys array<long>"
    return stored(docs.select(F.col("doc_id").cast("long"), t1.alias("t1"), t2.alias("t2"), "text").mapInArrow(sign, ddl))


class _Candidates:
    """Verified links between the texts that share a band with another."""

    def __init__(self, docs: DataFrame, signed: DataFrame, weights, words: int, similarity: float, bands: int = BANDS):
        self.weights, self.similarity = weights, similarity
        texts = signed.filter("id IS NOT NULL").dropDuplicates(["id"]).select("id", "t1", "t2", "signature", "keys")
        self.texts = stored(few_files(texts, signed.count()))
        entries = self.texts.select("id", F.explode("keys").alias("key"))
        buckets = entries.groupBy("key").agg(F.min("id").alias("leader"), F.count("*").alias("n")).filter("n > 1")
        # A bucket has two members or more, and each text as many as it has bands.
        buckets = stored(few_files(buckets, signed.count() * bands // 2))
        self.members = stored(entries.join(buckets, "key").select("key", "id", "leader", "n"))
        wanted = self.members.select("id").distinct().join(self.texts.select("id", "t1", "t2"), "id")
        self.sets = self._sets(docs, wanted, words)

    def _sets(self, docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
        def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            claim_caches("weighted_minhash")
            for batch in _in_answers(batches):
                found = []
                for text in batch.column(1):
                    h, counts, _ = shingles(text.as_py(), words)
                    found.append((h.tobytes(), zlib.compress(counts.astype("<u4").tobytes(), 1)))
                hashes, counts = zip(*found) if found else ([], [])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.binary()), pa.array(counts, pa.binary())], names=["id", "hashes", "counts"])

        t1, t2 = row_key()
        # One row stands for all copies of its words.
        texts = docs.select(t1.alias("t1"), t2.alias("t2"), "text").join(wanted, ["t1", "t2"]).dropDuplicates(["t1", "t2"])
        return stored(texts.select("id", "text").mapInArrow(collect, "id binary, hashes binary, counts binary"))

    def measure(self, pairs: DataFrame) -> DataFrame:
        """Weighted similarity of distinct pairs (a, b) whose signatures agree often enough."""
        weights, texts, sets = self.weights, self.texts, self.sets
        agree = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda e: e)) / F.size("sa")
        likely = (
            pairs.join(texts.select(F.col("id").alias("a"), F.col("signature").alias("sa")), "a")
            .join(texts.select(F.col("id").alias("b"), F.col("signature").alias("sb")), "b")
            .filter(agree >= LEAST_ESTIMATE).select("a", "b")
        )
        filled = likely.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha"), F.col("counts").alias("ca")), "a").join(
            sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb"), F.col("counts").alias("cb")), "b"
        )

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            claim_caches("weighted_minhash")
            for batch in _in_answers(batches):
                found = []
                for ha, ca, hb, cb in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                    x, y = np.frombuffer(ha, np.uint64), np.frombuffer(hb, np.uint64)
                    wx, wy = (weights.value(h, np.frombuffer(zlib.decompress(c), "<u4")) for h, c in ((x, ca), (y, cb)))
                    found.append(weighted_similarity(x, wx, y, wy))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["a", "b", "similarity"])

        columns = filled.select("a", "b", "ha", "ca", "hb", "cb")
        return columns.mapInArrow(compare, "a binary, b binary, similarity double")

    def roots(self, pairs: DataFrame, rows: int, before: DataFrame | None = None) -> DataFrame:
        """Components after measuring more pairs, ``rows`` of them at most."""
        return self._joined(self.measure(pairs).filter(F.col("similarity") >= self.similarity).select("a", "b"), rows, before)

    def _joined(self, links: DataFrame, rows: int, before: DataFrame | None) -> DataFrame:
        """The components so far stand for all links so far; without a new link they stay."""
        links = stored(few_files(links.distinct(), rows))
        found = links.count()
        if before is not None and not found:
            return before
        return components(links, found) if before is None else components(links.union(before.select("id", "root")), found + before.count())

    def _open(self, pairs: DataFrame, roots: DataFrame) -> DataFrame:
        """Pairs whose ends are still in different components."""
        of = lambda c: roots.select(F.col("id").alias(c), F.col("root").alias(f"r{c}"))
        return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")

    def _links_in_split_bands(self, roots: DataFrame, block: int = BLOCK) -> DataFrame:
        """Links (a, b) between components that meet in a band, found where the members are.

        Members are dealt into blocks; each pair of blocks is a group of bounded size whose
        texts are compared in one task, in the first band that they share. Only links leave it.
        """
        weights, similarity = self.weights, self.similarity
        placed = self.members.filter("n > 2").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        split = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select("key")
        split = stored(few_files(split, self.members.count() // 3))
        dealt = (
            placed.join(split, "key").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
            .withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
            .withColumn("side", F.when(F.col("lo") == F.col("hi"), 2).otherwise((F.col("own") == F.col("hi")).cast("int")))
            .select("key", "lo", "hi", "side", "id", "root")
        )
        groups = ["key", "lo", "hi"]
        filled = (
            dealt.join(self.texts.select("id", "signature", "keys"), "id").join(self.sets, "id")
            .select(*groups, "side", "id", "root", "signature", "keys", "hashes", "counts")
            .repartition(shuffle_parts(roots.sparkSession), *groups).sortWithinPartitions(*groups)
        )

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            claim_caches("weighted_minhash")
            held: list[dict] = []
            for row in (r for batch in _in_answers(batches) for r in batch.to_pylist()):
                if held and any(row[g] != held[0][g] for g in groups):
                    yield from _answer(_links_of_group(held, weights.value, similarity))
                    held = []
                held.append(row)
            yield from _answer(_links_of_group(held, weights.value, similarity))

        return filled.mapInArrow(compare, "a binary, b binary")

    def link(self) -> DataFrame:
        """(id, root) of the components of all links within bands.

        First each text and the leader it shares most bands with; then its other leaders, if
        they are in another component; then, in bands that still hold several components, all
        members of different ones. A pair of one component would change nothing, so no
        component is lost by leaving it out.
        """
        members = self.members.count()
        stars = (
            self.members.filter("id != leader").groupBy("id", "leader").agg(F.count("*").alias("shared"))
            .withColumn("first", F.row_number().over(Window.partitionBy("id").orderBy(F.col("shared").desc(), "leader")) == 1)
            .select(F.col("id").alias("a"), F.col("leader").alias("b"), "first")
        )
        stars = stored(few_files(stars, members))
        ties = stars.count()
        roots = self.roots(stars.filter("first").select("a", "b"), ties)
        others = stars.filter("NOT first").select("a", "b")
        if not others.isEmpty():
            roots = self.roots(self._open(others, roots), ties, roots)
        return self._joined(self._links_in_split_bands(roots), members, roots)


def _answer(links: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    if links:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*links)], names=["a", "b"])


def _links_of_group(rows: list[dict], weights: Weights, similarity: float) -> list[tuple[bytes, bytes]]:
    """Links that tie components of a group together; a pair that is tied already is not compared."""
    if len({r["root"] for r in rows}) < 2:
        return []
    keys, signatures = (np.array([r[c] for r in rows]) for c in ("keys", "signature"))
    band = int(np.flatnonzero((keys == rows[0]["key"]).all(axis=0))[0])
    side = np.array([r["side"] for r in rows])
    parent = {r["root"]: r["root"] for r in rows}

    def top(x: bytes) -> bytes:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sets: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def weighted(i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in sets:
            h = np.frombuffer(rows[i]["hashes"], np.uint64)
            sets[i] = h, weights(h, np.frombuffer(zlib.decompress(rows[i]["counts"]), "<u4"))
        return sets[i]

    links = []
    for i in range(len(rows) - 1):
        rest = slice(i + 1, None)
        likely = (signatures[rest] == signatures[i]).mean(axis=1) >= LEAST_ESTIMATE
        first = (keys[rest] == keys[i]).argmax(axis=1) == band
        across = (side[rest] == 2) | (side[rest] != side[i])
        for j in (np.flatnonzero(likely & first & across) + i + 1).tolist():
            x, y = top(rows[i]["root"]), top(rows[j]["root"])
            if x != y and weighted_similarity(*weighted(i), *weighted(j)) >= similarity:
                parent[max(x, y)] = min(x, y)
                links.append((rows[i]["id"], rows[j]["id"]))
    return links


def near_duplicate_classes(
    docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, t1, t2 (``row_key``), class_id (least doc_id of its class).

    Texts of equal words are one text from the start. Null texts and texts without a word are
    classes of their own, with their own doc_id. A row without doc_id gets the least doc_id of
    its class, or null. Rows with equal doc_id and different texts are told apart by t1 and t2.
    """
    spark = docs.sparkSession
    ship(spark)
    weights = spark.sparkContext.broadcast(Weights.of(frequencies(docs, words), docs.count()))
    signed = signatures(docs, weights, words, bands, rows)
    roots = _Candidates(docs, signed, weights, words, similarity, bands).link()
    rooted = stored(
        signed.select("doc_id", "t1", "t2", "id").join(roots, "id", "left").select("doc_id", "t1", "t2", F.coalesce("root", "id").alias("root"))
    )
    least = rooted.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("class_id"))
    least = stored(few_files(least, rooted.count()))
    return rooted.join(least, "root", "left").select(
        "doc_id", "t1", "t2", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "root"
    )


def drop_near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with one document of each class: the one of least doc_id. Texts without a word stay; of repeated rows one stays."""
    columns = docs.columns
    classes = stored(near_duplicate_classes(docs.select("doc_id", "text"), **settings))
    # Rows of a class without any doc_id: the one of least digest stays.
    best = classes.filter("root IS NOT NULL").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "t1", "t2")).alias("w"))
    single = classes.filter("root IS NULL").select("t1", "t2").distinct()
    kept = best.select("w.t1", "w.t2").union(single).toDF("_keep_t1", "_keep_t2")
    kept = stored(few_files(kept, classes.count()))
    t1, t2 = row_key()
    marked = docs.withColumns({"_keep_k1": t1, "_keep_k2": t2})
    match = (F.col("_keep_k1") == F.col("_keep_t1")) & (F.col("_keep_k2") == F.col("_keep_t2"))
    return marked.join(kept, match, "left_semi").dropDuplicates(["_keep_k1", "_keep_k2"]).select(*columns)


def op8_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicate_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))
