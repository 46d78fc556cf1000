"""Secrets in texts: candidate strings found by pattern, judged by a random forest.

Features are the length of a candidate, its character transitions, how much of it words of
the corpus cover, whether it is part of a path or an address, the words next to it and whether
one names it. Counts
of words cover every document; the forest is trained on labelled findings.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tenderlens.llm.common import claim_caches, digest, ship, stored, table

DICTIONARY_WORDS = 50_000
COUNTER_ENTRIES = 300_000
LABELLED = 4_000
TREES, DEPTH, SEED = 40, 8, 5
THRESHOLD = 0.5
CONTEXT = 48
MASK = "[SECRET]"
# What a text calls a password, token or key, and the password of an address; what stands before the
# name is found from the match backwards. An address as value is left to its parts.
NAMED = re.compile(
    r"(?i:passw(?:or)?d|passphrase|passcode|(?<![a-z])pass|pwd|secret|token|credentials?|(?:api|access|private|secret|signing|encryption|master|account|auth)[ _-]?key|auth(?:orization)?|bearer)"
    r"(?:\\?[\"'])?(?:\s*(?:=>|:=|[:=])\s*|\s+(?:is|was)\s+)(?:\\?[\"'])?(?i:(?:bearer|basic|token)\s+)?(?![A-Za-z][A-Za-z0-9+.-]*://)(?P<value>[^\s\"'<>,;]{4,})"
    r"|://[^\s/:@?#\"'<>]*:(?P<url>[^\s/\"'<>]+)@(?=[^\s@])"
)
# A long run of key characters; one with a digit in it is a candidate.
RUN = re.compile(r"[A-Za-z0-9+/_=.~-]{16,}")
_DIGIT = re.compile("[0-9]")
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")
_NAMED_END = re.compile(r"(?i:pass(?:w(?:or)?d|phrase|code)?|pwd|secret|token|credentials?|key|auth(?:orization)?|bearer)\\?[\"']?(?:\s*(?:=>|:=|[:=])\s*|\s+(?:is|was)\s+)\\?[\"']?(?i:(?:bearer|basic|token)\s+)?$")
_URL_END = re.compile(r"://[^\s/:@]*:$")
_RUNS = re.compile(r"[A-Za-z]+")
_WORD = re.compile(r"[^\W\d_]{3,24}")
# Words that speak for and against a secret.
SECRET_WORDS = ("secret", "token", "password", "passwd", "pwd", "key", "auth", "credential", "bearer", "private", "access")
PLAIN_WORDS = ("commit", "sha", "md5", "checksum", "digest", "hash", "uuid", "guid", "version", "file", "http", "www", "path", "mail", "phone", "isbn", "doi", "id")
PLACEHOLDERS = ("example", "xxxx", "your", "changeme", "placeholder", "dummy", "sample", "1234567", "abcdef", "test")
_SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789"


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over every whole text, letters only, in lower case. Tasks send sums of what they read."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_caches("secret_scan")
        seen: Counter[str] = Counter()

        def sums() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                seen.update(_WORD.findall((text.as_py() or "").lower()))
                if len(seen) > COUNTER_ENTRIES:
                    yield sums()
                    seen.clear()
        if seen:
            yield sums()

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Corpus:
    """The most frequent words, at most ``DICTIONARY_WORDS`` (words of one count stay or go together),
    and the letter transitions in them."""

    words: frozenset[str]
    transitions: np.ndarray
    common: list[str]

    @classmethod
    def of(cls, docs: DataFrame) -> Corpus:
        counts = stored(word_counts(docs))
        # The least count that no more than DICTIONARY_WORDS words reach; only those words leave their tasks.
        sizes = counts.groupBy("n").agg(F.count("*").alias("words"))
        reached = F.sum("words").over(Window.orderBy(F.col("n").desc()))
        cut = sizes.withColumn("reached", reached).filter(F.col("reached") <= DICTIONARY_WORDS).agg(F.min("n")).first()[0]
        top = [] if cut is None else sorted(counts.filter(F.col("n") >= cut).collect(), key=lambda r: (-r["n"], r["word"]))
        size = len(_SYMBOLS)
        steps = np.full((size, size), 0.5)
        at = {c: i for i, c in enumerate(_SYMBOLS)}
        for row in top:
            for a, b in zip(row["word"], row["word"][1:]):
                if a in at and b in at:
                    steps[at[a], at[b]] += math.log1p(row["n"])
        return cls(frozenset(r["word"] for r in top), np.log(steps / steps.sum(axis=1, keepdims=True)), [r["word"] for r in top[:2000]])


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def features(before: str, value: str, after: str, corpus: Corpus) -> list[float]:
    n = len(value)
    kinds = [_kind(c) for c in value]
    counts = Counter(value)
    lower = value.lower()
    at = [i for i in map(_SYMBOLS.find, lower) if i >= 0]
    steps = corpus.transitions[at[:-1], at[1:]] if len(at) > 1 else np.zeros(1)
    covered = sum(len(r) for r in _RUNS.findall(lower) if r in corpus.words)
    near, rest = before.lower()[-CONTEXT:], after.lower()[:16]
    found = [
        min(n, 200), sum(a != b for a, b in zip(kinds, kinds[1:])) / n, -sum(c / n * math.log2(c / n) for c in counts.values()),
        float(steps.mean()), covered / n, kinds.count(0) / n, kinds.count(2) / n, kinds.count(3) / n,
        float(all(c in "0123456789abcdef" for c in lower)), len(counts) / n,
        value.count("/") + value.count("\\"), value.count(".") + value.count("-"),
        float(before.endswith(("/", "@", ".", "\\")) or rest.startswith(("@", "/", "."))),
        float(bool(re.search(r"[:=]\s*[\"']?$", before))), float(before.endswith(("\"", "'")) and rest.startswith(("\"", "'"))),
        float(any(w in near for w in SECRET_WORDS)), float(any(re.search(rf"\b{w}", near) for w in PLAIN_WORDS)),
        float(any(w in lower for w in PLACEHOLDERS)),
        float(bool(_NAMED_END.search(before))), float(rest.startswith("@") and bool(_URL_END.search(before))),
    ]
    return [float(x) for x in found]


def _around(text: str, start: int, value: str) -> tuple[int, str, str, str]:
    return start, text[max(0, start - CONTEXT) : start], value, text[start + len(value) : start + len(value) + 16]


def _runs_of(text: str, at: int, end: int) -> Iterator[tuple[int, str, str, str]]:
    for m in RUN.finditer(text, at, end):
        if _DIGIT.search(m[0]):
            yield _around(text, m.start(), m[0].rstrip(".~-"))


def candidates_of(text: str | None) -> Iterator[tuple[int, str, str, str]]:
    """(start, before, candidate, after) in the whole text; start counts code points. Named values
    come first and runs lie between them, so no two candidates overlap and no name is part of one."""
    text = text or ""
    at = 0
    while m := NAMED.search(text, at):
        kind = m.lastgroup
        start, value, name = m.start(kind), m[kind], m.start()
        while name > at and text[name - 1] in _NAME:
            name -= 1
        yield from _runs_of(text, at, name)
        if kind == "url":
            # A user can be a token.
            yield from _runs_of(text, m.start() + 3, start - 1)
        elif name and text[name - 1] in "?&":
            value = re.split("[&#]", value, maxsplit=1)[0]
        at = start + len(value)
        if kind == "value":
            value = value.rstrip(".~-\\")
        if value:
            yield _around(text, start, value)
    yield from _runs_of(text, at, len(text))


def made_findings(common: list[str], n: int = LABELLED, seed: int = SEED) -> list[tuple[str, str, str, int]]:
    """Labelled findings (before, candidate, after, label): what ``candidates_of`` finds in whole texts
    in forms that credentials, and the strings mistaken for them, are known to have, between frequent
    words of the corpus."""
    rng = random.Random(seed)
    words = common or ["word"]
    pick = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    some = lambda k: " ".join(rng.choice(words) for _ in range(k))
    digits, hexes = "0123456789", "0123456789abcdef"
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + digits
    plain = ("required", "invalid", "missing", "optional", "none", "null", "true", "false", "string", "expired", "wrong", "disabled", "hidden")

    def chosen() -> str:
        """A password as people choose them: words or letters with digits or signs among them."""
        word = rng.choice([rng.choice(words), pick(alnum[26:52], rng.randint(4, 9))])
        return rng.choice([
            lambda: word + pick(digits, rng.randint(1, 4)) + rng.choice(["", "!", "#"]), lambda: word.title() + pick(digits, rng.randint(1, 4)),
            lambda: word + pick(digits, 1) + rng.choice(words), lambda: word.translate(str.maketrans("oeai", "0341")).title() + pick(alnum, 3) + pick(digits, 1),
            lambda: pick(alnum, rng.randint(6, 12)) + pick(digits, 1), lambda: pick(alnum + "!#%*", rng.randint(10, 20)),
        ])()

    def secret() -> tuple[str, str, str]:
        value = rng.choice([
            lambda: pick(hexes, rng.choice([32, 40, 64])), lambda: pick(alnum + "+/", rng.choice([40, 44, 64])),
            lambda: pick(alnum, rng.randint(20, 40)), lambda: rng.choice(["ghp_", "sk_live_", "xoxb-", "AKIA", "glpat-", "ya29."]) + pick(alnum, rng.randint(16, 36)),
            lambda: ".".join(["eyJ" + pick(alnum, 17), "eyJ" + pick(alnum, 40), pick(alnum + "-_", 43)]), chosen, chosen,
        ])()
        form = rng.random()
        if form < 0.1:
            return f"{some(3)} {rng.choice(['postgres', 'mysql', 'https', 'redis', 'amqp'])}://{rng.choice(words)}:", rng.choice([value, chosen()]).replace("/", "_"), f"@{rng.choice(words)}.internal/{rng.choice(words)}"
        if form < 0.2:
            # Bare: only what shows by itself that it is one.
            return f"{some(5)} ", rng.choice([
                lambda: rng.choice(["ghp_", "sk_live_", "xoxb-", "AKIA", "glpat-", "ya29."]) + pick(alnum, rng.randint(16, 36)),
                lambda: pick(alnum + "+/", rng.choice([40, 44, 64])), lambda: ".".join(["eyJ" + pick(alnum, 17), "eyJ" + pick(alnum, 40), pick(alnum + "-_", 43)]),
            ])(), f" {some(2)}"
        if form < 0.3:
            return f"{some(3)} https://{rng.choice(words)}.org/{rng.choice(words)}?{rng.choice(['access_token', 'token', 'api_key', 'auth'])}=", value, rng.choice([f"&{rng.choice(words)}=1 {some(1)}", f" {some(2)}"])
        name = rng.choice(["token", "secret", "password", "passphrase", "pwd", "api_key", "api-key", "access_key", "auth", "Authorization: Bearer", "private_key"])
        if rng.random() < 0.4 and " " not in name:
            name = rng.choice(["client_", "AWS_SECRET_", "DB_", "db.", "my-", rng.choice(words) + "_"]) + name
            name = name.upper() if rng.random() < 0.5 else name
        joint, quote = rng.choice([" = ", "=", ": ", " is "]), rng.choice(["\"", "'", ""])
        if " " in name or (len(value) >= 20 and rng.random() < 0.2):
            joint = " "
        return f"{some(5)} {name}{joint}{quote}", value, f"{quote} {some(2)}"

    def mistaken() -> tuple[str, str, str]:
        value, before, after = rng.choice([
            lambda: (pick(hexes, 40), f"{some(4)} commit ", f" {some(2)}"), lambda: (pick(hexes, rng.choice([32, 64])), f"{some(3)} {rng.choice(['md5', 'sha256', 'checksum'])}: ", f" {some(2)}"),
            lambda: (f"mail{rng.randint(0, 99)}.example.com", f"{some(4)} {rng.choice(words)}.{rng.randint(0, 99)}@", f" {some(2)}"),
            lambda: ("/".join(rng.choice(words) for _ in range(4)) + f"{rng.randint(0, 999)}.txt", f"{some(4)} /", f" {some(2)}"),
            lambda: (pick(digits, rng.randint(16, 20)), f"{some(5)} ", f" {some(2)}"), lambda: ("-".join(rng.choice(words) for _ in range(4)) + pick(digits, 2), f"{some(5)} ", f" {some(2)}"),
            lambda: ("".join(rng.choice(words).title() for _ in range(3)) + pick(digits, 2), f"{some(5)} ", f"() {some(2)}"),
            lambda: ("-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12)), f"{some(4)} uuid ", f" {some(2)}"), lambda: (f"www.{rng.choice(words)}{rng.randint(1, 99)}.example.org/{rng.choice(words)}", f"{some(4)} https://", f" {some(2)}"),
            lambda: (rng.choice(["your_token_here_123", "xxxxxxxxxxxxxxxx1", "EXAMPLEKEY1234567890", "changeme_password1"]), f"{some(3)} token = \"", f"\" {some(2)}"),
            lambda: (rng.choice(words) + "_" + rng.choice(words), f"{some(4)} token: ", f" {some(2)}"), lambda: (".".join(str(rng.randint(0, 255)) for _ in range(4)) + f":{rng.randint(1000, 9999)}", f"{some(5)} ", f" {some(2)}"),
            lambda: (rng.choice(words) * 2 + pick(digits, 1) + rng.choice(words) * 2, f"{some(5)} ", f" {some(2)}"),
            lambda: (rng.choice([*plain, rng.choice(words)]), f"{some(4)} {rng.choice(['password', 'token', 'secret', 'auth'])}{rng.choice([' is ', ': ', ' was ', ' = '])}", f" {some(2)}"),
            lambda: (rng.choice(["${", "{{", "%("]) + rng.choice(words) + "}", f"{some(4)} {rng.choice(['password', 'token', 'secret'])}{rng.choice([': ', '=', ' = '])}", f" {some(2)}"),
        ])()
        return before, value, after

    found = []
    while len(found) < n:
        label = len(found) % 2
        before, value, after = secret() if label else mistaken()
        for start, b, v, a in candidates_of(before + value + after):
            exact = start == len(before) and v == value.rstrip(".~-\\")
            if exact if label else start < len(before) + len(value):
                found.append((b, v, a, label))
                break
    return found


def train(spark: SparkSession, corpus: Corpus, findings: list[tuple[str, str, str, int]]) -> RandomForestClassificationModel:
    """A forest over labelled findings: at most ``LABELLED`` of them, the first ones."""
    rows = [(features(b, v, a, corpus), float(y)) for b, v, a, y in findings[:LABELLED]]
    frame = spark.createDataFrame(rows, "x array<double>, label double").select(array_to_vector("x").alias("features"), "label")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, minInstancesPerNode=2).fit(frame)


def scan_secrets(docs: DataFrame, corpus: Corpus, forest: RandomForestClassificationModel) -> DataFrame:
    """One row for each candidate: doc_id, d1, d2, start, length, value_sha256, score.

    The whole text is read; start and length count code points. Null and empty texts have no
    candidate. Rows with equal doc_id and different text differ in d1 and d2; repeated rows
    give repeated findings. The candidate itself is not returned.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(corpus)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_caches("secret_scan")
        for batch in batches:
            rows = []
            for doc_id, d1, d2, text in zip(*(batch.column(i).to_pylist() for i in range(3)), (t.as_py() for t in batch.column(3))):
                for start, before, value, after in candidates_of(text):
                    rows.append((doc_id, d1, d2, start, len(value), hashlib.sha256(value.encode()).hexdigest(), features(before, value, after, shared.value)))
            if rows:
                kinds = [pa.int64()] * 5 + [pa.string(), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "d1", "d2", "start", "length", "value_sha256", "x"]
                )

    d1, d2 = digest(F.col("doc_id").cast("long"), F.col("text"))
    found = docs.select(F.col("doc_id").cast("long"), d1.alias("d1"), d2.alias("d2"), "text").mapInArrow(
        find, "doc_id long, d1 long, d2 long, start long, length long, value_sha256 string, x array<double>"
    )
    judged = forest.transform(found.withColumn("features", array_to_vector("x")))
    return judged.select("doc_id", "d1", "d2", "start", "length", "value_sha256", vector_to_array("probability")[1].alias("score"))


def learned(docs: DataFrame, findings: list[tuple[str, str, str, int]] | None = None) -> tuple[Corpus, RandomForestClassificationModel]:
    corpus = Corpus.of(docs)
    return corpus, train(docs.sparkSession, corpus, made_findings(corpus.common) if findings is None else findings)


def mask_secrets(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every confirmed secret replaced by ``MASK``; n_chars, if there, follows the new text.

    Other texts and all rows stay, null texts too.
    """
    found = scan_secrets(docs.select("doc_id", "text"), *learned(docs)).filter(F.col("score") >= threshold)
    spans = stored(
        found.groupBy(F.col("d1").alias("_secret_d1"), F.col("d2").alias("_secret_d2"))
        .agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("_secret_spans"))
    )
    d1, d2 = digest(F.col("doc_id").cast("long"), F.col("text"))
    joined = docs.withColumns({"_secret_k1": d1, "_secret_k2": d2}).join(
        spans, (F.col("_secret_k1") == F.col("_secret_d1")) & (F.col("_secret_k2") == F.col("_secret_d2")), "left"
    )
    # Few spans a text: the text up to each, the mask, and what follows the last.
    seen = F.aggregate(
        "_secret_spans", F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda s, x: F.struct(
            F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, x["start"] - s["at"]), F.lit(MASK)).alias("out"),
            (x["start"] + x["length"]).alias("at"),
        ),
    )
    text = F.when(
        F.col("_secret_spans").isNotNull(), F.concat(seen["out"], F.substring(F.col("text"), seen["at"] + 1, F.char_length("text")))
    ).otherwise(F.col("text"))
    masked = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.col("_secret_spans").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return masked.select(*docs.columns)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan_secrets(docs, *learned(docs)).filter(F.col("score") >= THRESHOLD).select("doc_id", "start", "length", "value_sha256", "score")
