"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions. Each decision has a tree of contexts, the bytes before it,
the nearest first; every context from none to DEPTH bytes holds a Krichevsky-Trofimov
estimate, and a context's estimate and the product of its extensions' are averaged half and
half, from the longest contexts to the empty one. A text's probability is that of its bytes
under the tree of the training texts.

The tree grows with the corpus and is never in one place: it lies in buckets of contexts
with the same nearest bytes. Texts lie in blocks; a block asks the buckets only for the
different strings of bytes it holds, so a frequent one travels once for each block.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlens.llm.common import only_result, ship, stored, table

DEPTH = 6  # context bytes; with the byte itself they fit a positive long
MIDDLE, SHALLOW = 4, 2  # depths at which the tree is cut, so that no group holds more than 2^24 strings
MOST_BUCKETS = 4096
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_END = b"\n"
_NEVER = float(np.log10(np.array([0.5]))[0])  # the log of a count of 0 and one half


@dataclass(frozen=True)
class Sizes:
    """What bounds the memory of a task, whatever the size of the corpus; scores don't depend on it."""

    block: int = 64 << 20  # bytes of texts that look up their strings together
    piece: int = 4 << 20  # bytes of one text that are handled at a time
    slice: int = 4 << 20  # bytes turned into strings at a time
    salt: int = 64  # blocks that are added up together, and that a copy of a bucket serves


# --- numbers and words as bytes --------------------------------------------------------------


def _squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def _unsqueeze(blob: bytes) -> bytes:
    return pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)


def pack_numbers(x: np.ndarray) -> bytes:
    """Numbers of one width, byte by byte of their places, so that what they share compresses."""
    return _squeeze(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def unpack_numbers(blob: bytes, dtype) -> np.ndarray:
    planes = np.frombuffer(_unsqueeze(blob), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


class Strings:
    """Context bytes (nearest first) and a byte, as sorted longs."""

    @staticmethod
    def pack(keys: np.ndarray) -> bytes:
        return pack_numbers(np.diff(keys, prepend=np.int64(0)))

    @staticmethod
    def unpack(blob: bytes) -> np.ndarray:
        return np.cumsum(unpack_numbers(blob, np.int64))

    @staticmethod
    def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Sorted different keys and the sums of their numbers."""
        keys, numbers = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = _runs(keys)
        return keys[first], np.add.reduceat(numbers[order], first) if len(first) else numbers

    @staticmethod
    def find(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(known, keys)

    @staticmethod
    def buckets(keys: np.ndarray, n: int) -> np.ndarray:
        return _bucket_of(keys >> 8 * (DEPTH + 1 - MIDDLE), n)

    class Tally:
        def __init__(self, slice_size: int):
            self.waiting, self.size, self.parts, self.held = {True: [], False: []}, 0, [], 0
            self.slice = slice_size

        def add(self, body: bytes, learn: bool) -> None:
            self.waiting[learn].append(body)
            self.size += len(body)
            if self.size >= self.slice:
                self._count()

        def _count(self) -> None:
            for learn, bodies in self.waiting.items():
                if bodies:
                    keys = np.sort(keys_of(bodies)[0])
                    first = _runs(keys)
                    counts = np.diff(np.append(first, len(keys)))
                    self.parts.append((keys[first], counts if learn else np.zeros_like(counts)))
                    self.held += len(first)
            self.waiting, self.size = {True: [], False: []}, 0
            if self.held > self.slice:
                self.parts = [Strings.merge(self.parts)]
                self.held = 0

        def result(self) -> tuple[np.ndarray, np.ndarray]:
            self._count()
            return Strings.merge(self.parts) if self.parts else (np.empty(0, np.int64), np.empty(0, np.int64))


class Words:
    """Words as bytes; the end of a text is a word of its own."""

    @staticmethod
    def pack(keys) -> bytes:
        return _squeeze(b" ".join(keys))

    @staticmethod
    def unpack(blob: bytes) -> np.ndarray:
        return _array(_unsqueeze(blob).split(b" "))

    @staticmethod
    def merge(parts) -> tuple[np.ndarray, np.ndarray]:
        total: dict[bytes, int] = {}
        for keys, numbers in parts:
            for k, n in zip(keys.tolist(), numbers.tolist()):
                total[k] = total.get(k, 0) + n
        keys = sorted(total)
        return _array(keys), np.fromiter((total[k] for k in keys), np.int64, len(keys))

    @staticmethod
    def find(known, keys) -> np.ndarray:
        at = {k: i for i, k in enumerate(known.tolist())}
        return np.fromiter((at[k] for k in keys.tolist()), np.int64, len(keys))

    @staticmethod
    def buckets(keys, n: int) -> np.ndarray:
        return np.fromiter((zlib.crc32(k) % n for k in keys.tolist()), np.int64, len(keys))

    class Tally:
        def __init__(self, slice_size: int):
            self.learnt, self.seen = Counter(), set()

        def add(self, body: bytes, learn: bool) -> None:
            (self.learnt if learn else self.seen).update(words_of(body))

        def result(self):
            keys = sorted(self.learnt.keys() | self.seen)
            return _array(keys), np.fromiter((self.learnt[k] for k in keys), np.int64, len(keys))


def _array(words: list[bytes]) -> np.ndarray:
    found = np.empty(len(words), object)
    found[:] = words
    return found


def _runs(keys: np.ndarray) -> np.ndarray:
    """First places of runs of equal values."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)


def _bucket_of(context: np.ndarray, n: int) -> np.ndarray:
    mixed = context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


# --- texts -----------------------------------------------------------------------------------


def pieces_of(text: str | None, size: int = Sizes.piece) -> Iterator[tuple[int, bytes]]:
    """(tokens, bytes) of a text, piece by piece; the bytes are DEPTH bytes of context and then new ones.

    A-Z become lower case, words are set off by one blank, and a line feed, which no word can
    hold, is the end. Pieces are cut where words end. A null text is an empty one.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    context, begun, at = b"\0" * DEPTH, False, 0
    while True:
        cut = _BLANK.search(raw, at + size) if at + size < len(raw) else None
        end = cut.start() if cut else len(raw)
        words = raw[at:end].translate(_LOWER).split()
        body = (b" " if begun and words else b"") + b" ".join(words) + (b"" if cut else _END)
        begun = begun or bool(words)
        if body:
            yield len(words) + (0 if cut else 1), context + body
            context = (context + body)[-DEPTH:]
        if not cut:
            return
        at = end


def words_of(body: bytes) -> list[bytes]:
    words = body[DEPTH:].strip(b" \n").split(b" ")
    return (words if words != [b""] else []) + ([_END] if body.endswith(_END) else [])


def keys_of(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(string of each byte with its context, place of each body's first one)."""
    raw = b"".join(bodies)
    lengths = np.array([len(b) for b in bodies])
    ends = np.cumsum(lengths)
    # Eight bytes from every place on: the oldest context byte is the lowest, the byte itself stands above the context.
    window = np.ndarray((len(raw),), "<i8", raw + b"\0" * 8, strides=(1,))
    inside = np.ones(len(raw), bool)
    for k in range(1, DEPTH + 1):
        inside[ends - k] = False
    window = window[inside]
    keys = ((window & ((1 << 8 * DEPTH) - 1)) << 8) | ((window >> 8 * DEPTH) & 255)
    return keys, ends - lengths - DEPTH * np.arange(len(bodies))


_PIECES_DDL = "task int, unit int, row long, doc_id long, held_out boolean, n_tokens long, body binary"


def text_pieces(docs: DataFrame, held_out: Column, sizes: Sizes = Sizes()) -> DataFrame:
    """The texts in pieces, with the task that read them and, in it, a unit of about a block's bytes."""
    ship(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, row, size, unit = TaskContext.get().partitionId(), 0, 0, 0
        columns: list[tuple] = []
        waiting = 0

        def batch() -> pa.RecordBatch:
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary())
            names = [c.split()[0] for c in _PIECES_DDL.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*columns), types)], names=names)

        for rows in batches:
            for doc_id, held, text in zip(*(rows.column(i).to_pylist() for i in range(3))):
                for tokens, body in pieces_of(text, sizes.piece):
                    columns.append((task, unit, row, doc_id, held, tokens, body))
                    size, waiting = size + len(body), waiting + len(body)
                    if size >= sizes.block:
                        unit, size = unit + 1, 0
                    if waiting >= sizes.slice:
                        yield batch()
                        columns, waiting = [], 0
                row += 1
        if columns:
            yield batch()

    wanted = docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out, F.lit(False)), F.col("text"))
    return wanted.mapInArrow(cut, _PIECES_DDL)


# --- counts in buckets ------------------------------------------------------------------------

_COUNTS = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("numbers", pa.binary())])
_COUNTS_DDL = "bucket int, block long, keys binary, numbers binary"


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def counts_by_block(pieces: DataFrame, kind, buckets: int, sizes: Sizes = Sizes()) -> DataFrame:
    """For each block and bucket: the different keys that the block holds, with how often its training texts do."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, at = kind.Tally(sizes.slice), None

        def flush() -> Iterator[pa.RecordBatch]:
            keys, counts = tally.result()
            place = kind.buckets(keys, buckets)
            order = np.argsort(place, kind="stable")
            keys, counts, place = keys[order], counts[order], place[order]
            for a, b in _spans(place):
                yield _table(_COUNTS, [(int(place[a]), at, kind.pack(keys[a:b]), pack_numbers(counts[a:b]))])

        for batch in batches:
            for block, held, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if block != at:
                    if at is not None:
                        yield from flush()
                    tally, at = kind.Tally(sizes.slice), block
                tally.add(body, not held)
        if at is not None:
            yield from flush()

    return pieces.select("block", "held_out", "body").mapInArrow(count, _COUNTS_DDL)


def _spans(values: np.ndarray) -> list[tuple[int, int]]:
    first = _runs(values)
    return list(zip(first.tolist(), np.append(first[1:], len(values)).tolist()))


def totals_by_bucket(counts: DataFrame, kind, sizes: Sizes = Sizes()) -> DataFrame:
    """One row per bucket: its keys with their sums. Some blocks are added up at a time, then their sums."""

    def add(rows: pa.Table) -> pa.Table:
        blobs = zip(rows.column("keys").to_pylist(), rows.column("numbers").to_pylist())
        keys, numbers = kind.merge([(kind.unpack(k), unpack_numbers(n, np.int64)) for k, n in blobs])
        return pa.Table.from_batches([_table(_COUNTS, [(rows.column("bucket")[0].as_py(), 0, kind.pack(keys), pack_numbers(numbers))])])

    salted = counts.withColumn("salt", F.floor(F.col("block") / sizes.salt))
    return salted.groupBy("bucket", "salt").applyInArrow(add, _COUNTS_DDL).groupBy("bucket").applyInArrow(add, _COUNTS_DDL)


_ANSWER = pa.schema([("block", pa.int64()), ("word", pa.bool_()), ("keys", pa.binary()), ("numbers", pa.binary())])
_ANSWER_DDL = "block long, word boolean, keys binary, numbers binary"


def answers(counts: DataFrame, model: DataFrame, kind, dtype, sizes: Sizes = Sizes()) -> DataFrame:
    """For each block and bucket: the block's keys with the model's numbers. A bucket is copied once for every ``salt`` blocks."""

    def look(asked: pa.Table, known: pa.Table) -> pa.Table:
        keys = kind.unpack(known.column("keys")[0].as_py())
        numbers = unpack_numbers(known.column("numbers")[0].as_py(), dtype)
        rows, of_block = [], {}
        for block, blob in zip(asked.column("block").to_pylist(), asked.column("keys").to_pylist()):
            of_block.setdefault(block, []).append(blob)
        for block, blobs in of_block.items():
            wanted = [kind.unpack(blob) for blob in blobs]
            if len(wanted) > 1:  # several tasks read the block's texts
                wanted = [kind.merge([(k, np.zeros(len(k), np.int64)) for k in wanted])[0]]
            rows.append((block, kind is Words, kind.pack(wanted[0]), pack_numbers(numbers[kind.find(keys, wanted[0])])))
        return pa.Table.from_batches([_table(_ANSWER, rows)])

    salted = counts.select("bucket", F.floor(F.col("block") / sizes.salt).alias("salt"), "block", "keys")
    asking = salted.select(F.col("bucket").alias("of"), F.col("salt").alias("part")).distinct()
    copies = asking.join(model.select(F.col("bucket").alias("of"), "keys", "numbers"), "of")
    return salted.groupBy("bucket", "salt").cogroup(copies.groupBy("of", "part")).applyInArrow(look, _ANSWER_DDL)


# --- the tree ---------------------------------------------------------------------------------


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """By recurrence to 8 and more, then Stirling's series."""
    small = np.where(x < 8, x, 1.0)
    product = np.ones_like(small)
    for _ in range(8):
        product = np.where(x < 8, product * small, product)
        small = small + 1
    y = np.where(x < 8, x + 8, x)
    series = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - np.log(product)


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    a, b = zeros.astype(float), ones.astype(float)
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - 1.1447298858494002 - _log_gamma(a + b + 1)


def ascend(keys: np.ndarray, n: np.ndarray, below: np.ndarray | None, deep: int, low: int):
    """(levels, keys, n, below): the contexts of ``deep`` bytes down to ``low`` + 1, and what those of ``low`` start from.

    ``keys`` are sorted: a context, nearest byte first, and a byte. A decision k of a context
    is a run of keys that agree but for their last 8 - k bits. ``below`` holds, at one key of
    each run, the sum of the logs of the extensions' probabilities. A level has for each key
    and decision the weight of the context's own estimate and that estimate, and each key's
    place among the keys of the next shorter contexts.
    """
    levels = []
    for depth in range(deep, low, -1):
        m = len(keys)
        weight, estimate, up = (np.zeros((m, 8)) for _ in range(3))
        for k in range(8):
            first = _runs(keys >> (8 - k))
            size = np.diff(np.append(first, m))
            bit = (keys >> (7 - k)) & 1
            ones = np.add.reduceat(n * bit, first)
            zeros = np.add.reduceat(n, first) - ones
            own = log_estimate(zeros, ones)
            if depth == DEPTH:
                total, share = own, np.ones(len(first))
            else:
                total = np.logaddexp(own, np.add.reduceat(below[:, k], first)) - np.log(2)
                share = np.exp(own - np.log(2) - total)
            up[first, k] = total
            weight[:, k] = np.repeat(share, size)
            estimate[:, k] = (np.where(bit == 1, np.repeat(ones, size), np.repeat(zeros, size)) + 0.5) / (np.repeat(zeros + ones, size) + 1.0)
        shorter = (keys >> 16 << 8) | (keys & 255)
        order = np.argsort(shorter, kind="stable")
        sorted_keys = shorter[order]
        first = _runs(sorted_keys)
        place = np.empty(m, np.int64)
        place[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, m)))
        levels.append((weight, estimate, place))
        keys, n, below = sorted_keys[first], np.add.reduceat(n[order], first), np.add.reduceat(up[order], first, axis=0)
    return levels, keys, n, below


def descend(levels, mixed: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities mixed so far, and the share that longer contexts still decide, from the shortest to the longest."""
    for weight, estimate, place in reversed(levels):
        mixed, rest = mixed[place] + rest[place] * weight * estimate, rest[place] * (1 - weight)
    return mixed, rest


_PART = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("numbers", pa.binary()), ("values", pa.binary())])
_PART_DDL = "bucket int, keys binary, numbers binary, values binary"


def _parts(keys: np.ndarray, n: np.ndarray, values: np.ndarray, drop: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of a level, dealt out by the nearest bytes of their context (all but the last ``drop`` of the key)."""
    place = _bucket_of(keys >> 8 * drop, buckets) if buckets > 1 else np.zeros(len(keys), np.int64)
    order = np.argsort(place, kind="stable")
    keys, n, values, place = keys[order], n[order], values[order], place[order]
    for a, b in _spans(place):
        yield _table(_PART, [(int(place[a]), Strings.pack(keys[a:b]), pack_numbers(n[a:b]), pack_numbers(values[a:b].ravel()))])


def _joined_parts(keys: list[bytes], numbers: list[bytes], values: list[bytes], width: int):
    """Parts of a bucket as one, sorted by key; no key lies in two of them."""
    all_keys = np.concatenate([Strings.unpack(k) for k in keys])
    all_numbers = np.concatenate([unpack_numbers(n, np.int64) for n in numbers])
    all_values = np.concatenate([unpack_numbers(v, np.float64).reshape(-1, width) for v in values])
    order = np.argsort(all_keys)
    return all_keys[order], all_numbers[order], all_values[order]


def fit_tree(totals: DataFrame, buckets: int) -> DataFrame:
    """(bucket, keys, numbers): log10 probability (32-bit) of every key of ``totals`` under the tree of their counts.

    The tree is weighted from its longest contexts to the empty one and read back the other
    way, cut at MIDDLE and SHALLOW: a bucket of the deepest part shares MIDDLE nearest bytes,
    one of the middle part SHALLOW; what is left, at most 2^24 keys, is one task's.
    """
    middles = min(buckets, 256)

    def deep_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                _, keys, counts, below = ascend(Strings.unpack(k), unpack_numbers(n, np.int64), None, DEPTH, MIDDLE)
                yield from _parts(keys, counts, below, MIDDLE + 1 - SHALLOW, middles)

    def gather(rows: pa.Table) -> pa.Table:
        keys, n, values = _joined_parts(*(rows.column(c).to_pylist() for c in ("keys", "numbers", "values")), 8)
        row = (rows.column("bucket")[0].as_py(), Strings.pack(keys), pack_numbers(n), pack_numbers(values.ravel()))
        return pa.Table.from_batches([_table(_PART, [row])])

    middle = stored(totals.select("keys", "numbers").mapInArrow(deep_up, _PART_DDL).groupBy("bucket").applyInArrow(gather, _PART_DDL))

    def middle_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, n, v in zip(*(batch.column(i).to_pylist() for i in range(3))):
                _, keys, counts, below = ascend(Strings.unpack(k), unpack_numbers(n, np.int64), unpack_numbers(v, np.float64).reshape(-1, 8), MIDDLE, SHALLOW)
                yield from _parts(keys, counts, below, 0, 1)

    def top(rows: pa.Table) -> pa.Table:
        keys, n, below = _joined_parts(*(rows.column(c).to_pylist() for c in ("keys", "numbers", "values")), 8)
        levels, last, _, _ = ascend(keys, n, below, SHALLOW, -1)
        mixed, rest = descend(levels, np.zeros((len(last), 8)), np.ones((len(last), 8)))
        return pa.Table.from_batches(list(_parts(keys, n, np.hstack([mixed, rest]), 1, middles)), schema=_PART)

    crown = middle.select("keys", "numbers", "values").mapInArrow(middle_up, _PART_DDL).groupBy("bucket").applyInArrow(top, _PART_DDL)
    below_crown = middle.join(crown.select("bucket", F.col("keys").alias("short"), F.col("values").alias("mixed")), "bucket")

    def middle_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, n, v, short, mixed in zip(*(batch.column(i).to_pylist() for i in range(5))):
                keys, counts = Strings.unpack(k), unpack_numbers(n, np.int64)
                levels, last, _, _ = ascend(keys, counts, unpack_numbers(v, np.float64).reshape(-1, 8), MIDDLE, SHALLOW)
                found = _continued(levels, last, short, mixed)
                yield from _parts(keys, counts, np.hstack(found), 1, buckets)

    parts = below_crown.select("keys", "numbers", "values", "short", "mixed").mapInArrow(middle_down, _PART_DDL)
    gathered = parts.groupBy("bucket").agg(F.collect_list(F.struct("keys", "values")).alias("parts"))

    def deep_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, k, n, parts in zip(*(batch.column(i).to_pylist() for i in range(4))):
                keys = Strings.unpack(k)
                levels, last, _, _ = ascend(keys, unpack_numbers(n, np.int64), None, DEPTH, MIDDLE)
                short = np.concatenate([Strings.unpack(p["keys"]) for p in parts])
                mixed = np.concatenate([unpack_numbers(p["values"], np.float64).reshape(-1, 16) for p in parts])
                at = np.argsort(short)[np.searchsorted(np.sort(short), last)]
                found, _ = descend(levels, mixed[at, :8], mixed[at, 8:])
                logs = np.log10(found).sum(axis=1).astype(np.float32)
                yield _table(_COUNTS, [(bucket, 0, k, pack_numbers(logs))])

    return totals.join(gathered, "bucket").select("bucket", "keys", "numbers", "parts").mapInArrow(deep_down, _COUNTS_DDL)


def _continued(levels, last: np.ndarray, short: bytes, mixed: bytes) -> tuple[np.ndarray, np.ndarray]:
    known, values = Strings.unpack(short), unpack_numbers(mixed, np.float64).reshape(-1, 16)
    at = np.searchsorted(known, last)
    return descend(levels, values[at, :8], values[at, 8:])


# --- scores -----------------------------------------------------------------------------------

_SCORED_DDL = "task int, row long, doc_id long, held_out boolean, n_tokens long, n_bytes long, n_known long, words double, score double"


def score_pieces(pieces: DataFrame, found: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """Each piece with its known words, the sum of log10(count + 0.5) over its words, and its log10 probability.

    A group is a block of texts and the numbers of the strings and words in it.
    """

    def score(texts: pa.Table, numbers: pa.Table) -> pa.Table:
        packed = list(zip(*(numbers.column(c).to_pylist() for c in ("word", "keys", "numbers"))))
        half: dict[bytes, float] = {}
        for word, k, n in packed:
            if word:
                half.update(zip(Words.unpack(k).tolist(), np.log10(unpack_numbers(n, np.int64) + 0.5).tolist()))
        n_known, sums, n_bytes = [], [], []
        for body in texts.column("body"):
            body = body.as_py()
            logs = list(map(half.__getitem__, words_of(body)))
            n_bytes.append(len(body) - DEPTH)
            n_known.append(len(logs) - logs.count(_NEVER))
            sums.append(float(sum(logs)))
        half = {}
        strings = [(Strings.unpack(k), unpack_numbers(n, np.float32)) for word, k, n in packed if not word]
        known, logs = (np.concatenate(c) for c in zip(*strings))
        strings = packed = None
        order = np.argsort(known)
        known, logs = known[order], logs[order]
        scores, waiting, size = [], [], 0

        def flush(bodies: list[bytes]) -> None:
            keys, starts = keys_of(bodies)
            # Sorted and each once, keys are found in one pass through memory; in the order of the text they miss the cache.
            order = np.argsort(keys)
            first = _runs(keys[order])
            found = logs[np.searchsorted(known, keys[order[first]])]
            of_byte = np.empty(len(keys))
            of_byte[order] = np.repeat(found, np.diff(np.append(first, len(keys))))
            scores.extend(np.add.reduceat(of_byte, starts).tolist())

        for body in texts.column("body"):
            waiting.append(body.as_py())
            size += len(waiting[-1])
            if size >= sizes.slice // 2:
                flush(waiting)
                waiting, size = [], 0
        if waiting:
            flush(waiting)
        carried = [texts.column(c) for c in ("task", "row", "doc_id", "held_out", "n_tokens")]
        return pa.Table.from_arrays([*carried, pa.array(n_bytes, pa.int64()), pa.array(n_known, pa.int64()), pa.array(sums, pa.float64()), pa.array(scores, pa.float64())],
                                    names=[c.split()[0] for c in _SCORED_DDL.split(", ")])

    texts = pieces.select("block", "task", "row", "doc_id", "held_out", "n_tokens", "body")
    return texts.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(score, _SCORED_DDL)


def score_documents(docs: DataFrame, held_out: Column, sizes: Sizes = Sizes()) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    ``docs`` needs doc_id and text; other columns are read only by ``held_out``, which says
    whether a row is kept out of the training (null: it isn't). Whole texts are read, in
    pieces. A null or empty text is its end alone. Rows with equal doc_id are scored each on
    their own, a null doc_id stays null, an empty table has no rows. Without training texts
    every bit has probability one half. ``base_score`` is the word model's log10 probability,
    ``score`` the tree's, of the same lower-cased words, each set off by a blank, and the end.
    """
    spark = docs.sparkSession

    def build() -> DataFrame:
        cut = stored(text_pieces(docs, held_out, sizes))
        size, tasks = cut.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0)), F.coalesce(F.max("task"), F.lit(0)) + 1).first()
        # Small tasks share a block; a block may hold several units only where they are small.
        share = max(1, sizes.block * tasks // max(size, 1))
        pieces = cut.withColumn("block", F.floor(F.col("task") / min(share, tasks)) + F.col("unit").cast("long") * tasks)
        buckets = min(MOST_BUCKETS, max(8, size // (sizes.slice * 4)))
        strings, words = stored(counts_by_block(pieces, Strings, buckets, sizes)), stored(counts_by_block(pieces, Words, buckets, sizes))
        totals, word_totals = stored(totals_by_bucket(strings, Strings, sizes)), stored(totals_by_bucket(words, Words, sizes))
        tokens, vocabulary = _sums(word_totals)
        model = stored(fit_tree(totals, buckets))
        found = answers(strings, model, Strings, np.float32, sizes).unionByName(answers(words, word_totals, Words, np.int64, sizes))
        scored = score_pieces(pieces, found, sizes).groupBy("task", "row").agg(
            F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"),
            *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "n_bytes", "words", "score")],
        )
        base = F.col("words") - F.col("n_tokens") * float(np.log10(tokens + 0.5 * (vocabulary + 1)))
        return scored.select(
            "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
            "n_bytes", (-F.col("score") / float(np.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"),
        )

    return only_result(spark, build)


def _sums(word_totals: DataFrame) -> tuple[int, int]:
    """(tokens, different tokens) of the training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [unpack_numbers(n, np.int64) for n in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([int(n.sum()) for n in numbers]), pa.array([int((n > 0).sum()) for n in numbers])], names=["n", "v"])

    row = word_totals.select("numbers").mapInArrow(count, "n long, v long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    return row[0], row[1]


def op13_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1)
