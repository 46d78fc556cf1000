"""Byte-pair encoding on contiguous arrays of adjacent ranks.

For a short word two arrays are held: its parts and the merge rank of each neighbouring pair.
The least rank is found by a scan, that boundary is deleted, and the ranks on both sides of it
are looked up anew. Words of one length are rows of one matrix, so a step is a few array
operations for thousands of words, and since every word still at work loses one boundary a
step, the matrix stays full. Long words take all pairs of the least rank at once.
"""

from __future__ import annotations

import hashlib
import json
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlens.llm import tokens
from tenderlens.llm.common import keep_cache, ship, table

TOKENIZER = "byte_bpe_50k.json"
SHORT = 64
_NONE = np.iinfo(np.int32).max
# Fixed value: how byte-level tokenizers of this family cut a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_built: dict[bytes, "RankBpe"] = {}
keep_cache("token ids", lambda: (_built.clear(), tokens._encoders.clear()))


def byte_alphabet() -> list[str]:
    """The visible character that stands for each byte: itself if printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in set(plain) else next(rest)) for b in range(256)]


class RankBpe:
    """Encoder and decoder of a byte-level tokenizer file."""

    def __init__(self, spec: bytes):
        file = json.loads(spec)
        vocabulary = file["model"]["vocab"]
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.words = regex.compile(WORDS)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.letters = np.array([vocabulary[c] for c in byte_alphabet()], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in file["model"]["merges"]]
        self.stride = max(vocabulary.values()) + 1
        keys = np.array([vocabulary[a] * self.stride + vocabulary[b] for a, b in pairs], np.int64)
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of = keys[order], order.astype(np.int32)
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in vocabulary.items()}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.encoder = tokens.ChunkEncoder(self.encode_parts)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left.astype(np.int64) * self.stride + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.rank_of[at], _NONE)

    def short_words(self, words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, their ids) for a matrix of words of one byte length, finished ones together."""
        ids, rows = self.letters[words], np.arange(len(words))
        ranks, done = self.ranks(ids[:, :-1], ids[:, 1:]), []
        while ids.shape[1] > 1 and len(rows):
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(rows)), at]
            ended = least == _NONE
            if ended.any():
                done.append((rows[ended], ids[ended]))
                rows, ids, ranks, at, least = (x[~ended] for x in (rows, ids, ranks, at, least))
            if not len(rows):
                break
            width, each = ids.shape[1] - 1, np.arange(len(rows))
            columns = np.arange(width)
            ids = np.take_along_axis(ids, columns + (columns > at[:, None]), axis=1)
            ids[each, at] = self.merged[least]
            columns = columns[:-1]
            ranks = np.take_along_axis(ranks, columns + (columns >= at[:, None]), axis=1)
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < width - 1)
            ranks[left, at[left] - 1] = self.ranks(ids[left, at[left] - 1], ids[left, at[left]])
            ranks[right, at[right]] = self.ranks(ids[right, at[right]], ids[right, at[right] + 1])
        if len(rows):
            done.append((rows, ids))
        return done

    def long_word(self, word: bytes) -> np.ndarray:
        """A pair of higher rank cannot arise from one of lower rank before it, so all places of the least go at once."""
        ids = self.letters[np.frombuffer(word, np.uint8)]
        while len(ids) > 1:
            ranks = self.ranks(ids[:-1], ids[1:])
            least = ranks.min()
            if least == _NONE:
                break
            at = np.flatnonzero(ranks == least)
            runs = np.flatnonzero(np.diff(at, prepend=-2) > 1)
            at = at[(np.arange(len(at)) - np.repeat(runs, np.diff(runs, append=len(at)))) % 2 == 0]
            ids = ids.copy()
            ids[at] = self.merged[least]
            ids = np.delete(ids, at + 1)
        return ids

    def encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        found, by_length = {}, defaultdict(list)
        for w in words:
            by_length[len(w)].append(w)
        for length, same in by_length.items():
            if length > SHORT:
                found |= {w: self.long_word(w).astype("<u4").tobytes() for w in same}
                continue
            matrix = np.frombuffer(b"".join(same), np.uint8).reshape(len(same), length)
            for rows, ids in self.short_words(matrix):
                raw, size = ids.astype("<u4").tobytes(), 4 * ids.shape[1]
                for k, row in enumerate(rows.tolist()):
                    found[same[row]] = raw[k * size : (k + 1) * size]
        return found

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        cut, specials = [], {t: np.array([i], "<u4").tobytes() for t, i in self.special.items()}
        for part in parts:
            if self.cut and any(t in part for t in specials):
                pieces = [p for p in self.cut.split(part) if p]
                cut.append([x for p in pieces for x in ([p] if p in specials else [w.encode() for w in self.words.findall(p)])])
            else:
                cut.append([w.encode() for w in self.words.findall(part)])
        known = self.encode_words(list({w for ws in cut for w in ws if isinstance(w, bytes)})) | specials
        return [b"".join([known[w] for w in ws]) for ws in cut]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, as bytes."""
        return self.encoder.ids(texts)

    def decode(self, ids: bytes) -> str:
        get = self.bytes_of.__getitem__
        return b"".join(map(get, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def rank_bpe(spec: bytes) -> RankBpe:
    if spec not in _built:
        _built[spec] = RankBpe(spec)
    return _built[spec]


def encode_documents(docs: DataFrame, spec: bytes) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) of every whole text; null texts are empty.

    Other columns are not read. Rows with equal doc_id stay apart, a null doc_id stays null,
    an empty table gives no row. Strings of special tokens in a text become their ids.
    """
    return _encoded(docs, spec, "doc_id long, ids binary", lambda ids, _: [ids])


def _encoded(docs: DataFrame, spec: bytes, ddl: str, outputs) -> DataFrame:
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.claim_caches("token ids")
        bpe = rank_bpe(shared.value)
        names = [c.split()[0] for c in ddl.split(", ")]
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, run in tokens.in_slices(texts):
                rows = [outputs(ids, bpe) for ids in bpe.encode(run)]
                columns = [pa.array(doc_ids[first : first + len(run)], pa.int64()), *map(pa.array, zip(*rows))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, ddl)


def round_trip_digests(docs: DataFrame, spec: bytes) -> DataFrame:
    """doc_id, n_tokens, sha256 of the ids and of the text decoded from them, without moving either."""
    return _encoded(
        docs, spec, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
        lambda ids, bpe: [len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()],
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"), tokens.tokenizer_file(TOKENIZER))
