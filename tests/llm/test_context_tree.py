"""op13 against a context tree and a word model in plain Python."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderlens.llm import context_tree as ct

SCHEMA = "doc_id long, text string, score string, row string"


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1


def words(text):
    lower = re.sub(r"[A-Z]", lambda m: m.group().lower(), text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


class Tree:
    """Counts of bits by (bits of the byte so far, context bytes) with the mixture as it is defined."""

    def __init__(self):
        self.counts, self.children, self.memo = {}, {}, {}

    @staticmethod
    def steps(data):
        padded = b"\0" * ct.DEPTH + data
        for i, byte in enumerate(data):
            context = padded[i : i + ct.DEPTH][::-1]
            bits = format(byte, "08b")
            for k in range(8):
                yield context, bits[:k], int(bits[k])

    def learn(self, data):
        for context, node, bit in self.steps(data):
            for d in range(ct.DEPTH + 1):
                self.counts.setdefault((node, context[:d]), [0, 0])[bit] += 1
                if d:
                    self.children.setdefault((node, context[: d - 1]), set()).add(context[:d])

    def own(self, at):
        a, b = self.counts.get(at, (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def weighted(self, at):
        if at not in self.memo:
            node, context = at
            own = self.own(at)
            if len(context) < ct.DEPTH:
                longer = sum(self.weighted((node, c)) for c in self.children.get(at, ()))
                own = np.logaddexp(own, longer) - math.log(2)
            self.memo[at] = own
        return self.memo[at]

    def probability(self, node, context, bit, depth=0):
        at = (node, context[:depth])
        counts = self.counts.get(at, [0, 0])
        estimate = (counts[bit] + 0.5) / (sum(counts) + 1)
        if depth == ct.DEPTH:
            return estimate
        share = math.exp(self.own(at) - math.log(2) - self.weighted(at))
        return share * estimate + (1 - share) * self.probability(node, context, bit, depth + 1)

    def log10(self, data):
        return sum(math.log10(self.probability(n, c, b)) for c, n, b in self.steps(data))


def brute(rows):
    tree, counts = Tree(), {}
    for doc_id, text in rows:
        if not held(doc_id):
            tree.learn(" ".join(words(text)).encode() + b"\n")
            for w in [*words(text), None]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    out = []
    for doc_id, text in rows:
        tokens = [*words(text), None]
        base = sum(math.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        out.append((doc_id, held(doc_id), len(tokens), sum(w in counts for w in tokens), n, base, tree.log10(" ".join(words(text)).encode() + b"\n")))
    return out


def check(spark, rows, parts=3, sizes=ct.Sizes()):
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(parts)
    got = [tuple(r)[:7] for r in ct.score_documents(frame, held_out(), sizes).collect()]
    key = lambda r: (r[:5][0] is None, r[0] or 0, r[2], round(r[5], 4), round(r[6], 3))
    got, want = sorted(got, key=key), sorted(brute(rows), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-5)


def corpus():
    rng = random.Random(4)
    vocabulary = ["The", "cat", "sät", "on", "mats", "ЖУК", "a\x1cb", "\x85", "\0", "_", "."]
    texts = [rng.choice([" ", "\n", "\t "]).join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 12))) for _ in range(40)]
    return [(i, t) for i, t in enumerate(texts)] + [(50, None), (51, ""), (52, " \n "), (None, "null id Here"), (3, texts[3]), (3, texts[3])]


def test_matches_plain_python(spark):
    check(spark, corpus())


def test_small_pieces_blocks_and_slices_give_the_same(spark):
    """Everything that is cut at scale is cut here: texts, units, blocks, sums and buckets."""
    check(spark, corpus()[:25] + [(70, "long " * 30), (71, "x" * 100 + " y")], 2, ct.Sizes(block=300, piece=9, slice=70, salt=2))


def test_nothing_to_learn_from_and_empty(spark):
    alone = next(i for i in range(100) if held(i))
    (row,) = ct.score_documents(spark.createDataFrame([(alone, "ab c", "", "")], SCHEMA), held_out()).collect()
    assert row["score"] == pytest.approx(-5 * 8 * math.log10(2), rel=1e-6) and row["n_known"] == 0 and row["bits_per_byte"] == pytest.approx(8)
    assert row["base_score"] == 0 and row["train_tokens"] == 0
    assert ct.score_documents(spark.createDataFrame([], SCHEMA), held_out()).collect() == []


def test_pieces_join_to_the_normal_text():
    text = "  Some WORDS\n\n and  some\tmore \x1c x" + "y" * 30 + "  "
    want = " ".join(words(text)).encode() + b"\n"
    for size in (1, 5, 1000):
        pieces = list(ct.pieces_of(text, size))
        assert b"".join(b[ct.DEPTH :] for _, b in pieces) == want
        assert sum(n for n, _ in pieces) == len(words(text)) + 1
        assert [w for _, b in pieces for w in ct.words_of(b)] == [*(w.encode() for w in words(text)), b"\n"]


def test_estimates_of_large_counts():
    zeros, ones = np.array([0, 1, 7, 8, 100, 10**6, 10**9]), np.array([0, 0, 9, 3, 5, 10**5, 1])
    want = [math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1) for a, b in zip(zeros, ones)]
    assert ct.log_estimate(zeros, ones) == pytest.approx(want, rel=1e-9, abs=1e-5)  # both lose digits in differences of huge logs
