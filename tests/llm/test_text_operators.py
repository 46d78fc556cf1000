"""Line dedup, packing, token files, byte-pair encoding, language, secrets: plain Python beside each."""

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SF
from tenderlens.llm import language_mix, line_dedup, packing, rank_bpe, registry, secret_scan, simple8b, token_files, tokens
from tools.compare import rows_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    "", " ", "   ", "\n", "a  b", "a   b \n\n  c\t\td  ", "<|endoftext|>x <|endoftext|> <|endoftext|>  y", "foo\n bar \n bar  x",
    "'s 's  's don't", "ﬁ É é ́x Σας", "日本 語", " lead", "trail ", " \n x", "x \n \n", "x\x00y", "x \x85 y", "a" * 3000, "ab" * 300, "-" * 777,
    "x²½Ⅷ٣", "\x1c\x1d a\x1c b",
]


def frame(spark, texts, extra=""):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def library():
    found = {}
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        found[name] = Tokenizer.from_file(public_tokenizers.path(name))
        found[name].no_truncation()
        found[name].no_padding()
    return found


def ids_of(library, name, text):
    return library[name].encode(text or "", add_special_tokens=False).ids


# --- ids ---------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_parts_give_the_ids_of_the_text(library, name):
    encoder = tokens.library_encoder(tokens.tokenizer_file(name))
    for text in ODD:
        assert np.frombuffer(encoder.ids([text])[0], "<u4").tolist() == ids_of(library, name, text), repr(text)


@cache
def loaded(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("abZ. ,!\n\t's\u00e91\u00b2\u0301\u3000\u00a0\u0085\u2028\u2003\x1c\x1d\x1e\x1f\x0b\0\u0130\u03a3<|endoftext|>"), max_size=60))
def test_ids_of_any_text(text):
    """Both tokenizers, with control characters that Python alone takes for blanks."""
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        spec, library = tokens.tokenizer_file(name), loaded(name)
        got = tokens.library_encoder(spec).ids([text, "", text + " x"])
        want = [library.encode(t, add_special_tokens=False).ids for t in (text, "", text + " x")]
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == want
    library = loaded("byte_bpe_50k.json")
    own = rank_bpe.rank_bpe(tokens.tokenizer_file("byte_bpe_50k.json"))
    want = library.encode(text, add_special_tokens=False).ids
    ids = own.encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_windows_and_long_texts_give_the_same_ids(monkeypatch):
    monkeypatch.setattr(tokens, "WINDOW", 50)
    monkeypatch.setattr(tokens, "CACHE_BYTES", 2_000)
    texts = ["The cat, sat. " * 30, "x" * 500, "", "a b\n\n c" * 40, "\u3000 " * 50, "word, " * 3] * 2
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        spec, library = tokens.tokenizer_file(name), loaded(name)
        got = tokens.library_encoder(spec).ids(texts)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_rank_bpe_on_odd_texts(library):
    own = rank_bpe.rank_bpe(tokens.tokenizer_file("byte_bpe_50k.json"))
    for text in ODD:
        want = ids_of(library, "byte_bpe_50k.json", text)
        ids = own.encode([text])[0]
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(text)
        assert own.decode(ids) == library["byte_bpe_50k.json"].decode(want, skip_special_tokens=False)


def test_short_and_long_words_agree():
    own = rank_bpe.rank_bpe(tokens.tokenizer_file("byte_bpe_50k.json"))
    rng = np.random.default_rng(1)
    for length in (2, 3, 17, 64):
        words = rng.integers(97, 103, (50, length)).astype(np.uint8)
        for rows, ids in own.short_words(words):
            for row, one in zip(rows, ids):
                assert one.tolist() == own.long_word(words[row].tobytes()).tolist()


def test_op9_is_the_library(spark, library):
    got = {r["doc_id"]: r for r in registry.QUERIES["op9_bpe"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = np.array(ids_of(library, "byte_bpe_50k.json", d["text"]), "<u4")
        assert got[d["doc_id"]]["n_tokens"] == len(ids)
        assert got[d["doc_id"]]["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[d["doc_id"]]["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()


def test_bpe_nulls_and_empty_table(spark):
    spec = tokens.tokenizer_file("byte_bpe_50k.json")
    rows = spark.createDataFrame([(None, "a"), (1, None), (1, "a"), (1, "a")], "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["doc_id"], r["n_tokens"]) for r in rank_bpe.round_trip_digests(rows, spec).collect())
    assert got == [(False, 1, 0), (False, 1, 1), (False, 1, 1), (True, None, 1)]
    assert rank_bpe.round_trip_digests(rows.filter("false"), spec).count() == 0


# --- packing -----------------------------------------------------------------------------


@given(st.integers(1, 10**6))
def test_piece_lengths(n):
    lengths = packing.piece_lengths(n)
    assert sum(lengths) == n and lengths == sorted(lengths, reverse=True)
    assert all(k & (k - 1) == 0 and k <= packing.LONGEST for k in lengths)
    assert len({k for k in lengths if k < packing.LONGEST}) == sum(k < packing.LONGEST for k in lengths)


def test_op1_every_id_in_one_piece(spark, library):
    got = registry.QUERIES["op1_packing"](spark, SF).collect()
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert set(by_doc) == {d["doc_id"] for d in docs}
    for d in docs:
        ids = np.array([*ids_of(library, packing.TOKENIZER, d["text"]), 1], "<u4")
        at = 0
        for r in sorted(by_doc[d["doc_id"]], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert sorted(r["sequence_id"] for r in got) == list(range(len(got)))
    assert {r["offset"] for r in got} == {0}
    lengths = [r["length"] for r in sorted(got, key=lambda r: r["sequence_id"])]
    assert lengths == sorted(lengths, reverse=True)


def test_packing_nulls_clashes_and_empty(spark):
    rows = frame(spark, [None, "", "a b c"]).withColumns({"task": F.lit("x"), "number": F.lit(1), "length": F.lit("y")})
    got = packing.pack_documents(rows, tokens.tokenizer_file(packing.TOKENIZER)).collect()
    assert sorted((r["doc_id"], r["length"], len(r["ids"])) for r in got) == [(0, 1, 4), (1, 1, 4), (2, 4, 16)]
    assert packing.pack_documents(rows.filter("false"), tokens.tokenizer_file(packing.TOKENIZER)).count() == 0


# --- token files -------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 2**16), st.integers(0, 2**64 - 1)), max_size=400), st.sampled_from([7, 64, 8192]))
def test_simple8b_round_trip(values, block):
    words, offsets = simple8b.encode(np.array(values, np.uint64), block)
    assert simple8b.decode(words, offsets, len(values), block).tolist() == values
    if len(offsets) > 1:
        assert simple8b.decode(words, offsets, len(values), block, 1, 2).tolist() == values[block : 2 * block]


def test_simple8b_packs_tightly():
    words, _ = simple8b.encode(np.ones(600, np.uint64))
    assert len(words) == 10
    assert len(simple8b.encode(np.full(300, 40_000, np.uint64))[0]) == 100


def test_op7_reads_back_what_the_library_gives(spark, library):
    got = {r["doc_id"]: r for r in registry.QUERIES["op7_token_files"](spark, SF).collect()}
    start = 0
    for d in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array([*ids_of(library, token_files.TOKENIZER, d["text"]), 2], "<u4")
        r = got[d["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files_nulls_repeats_and_empty(spark, tmp_path):
    spec = tokens.tokenizer_file(token_files.TOKENIZER)
    rows = frame(spark, [None, "", "a b", "x " * 9000]).union(frame(spark, [None, "", "a b"])).withColumn("part", F.lit("p"))
    token_files.write_token_files(rows, spec, str(tmp_path / "a"), chunk_ids=50)
    got = token_files.read_token_files(spark, str(tmp_path / "a")).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [0, 0, 1, 1, 2, 2, 3]
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    token_files.write_token_files(rows.filter("false"), spec, str(tmp_path / "b"))
    assert token_files.read_token_files(spark, str(tmp_path / "b")).count() == 0


# --- lines -------------------------------------------------------------------------------


def plain_lines(docs, min_docs, keep_first=False):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER))
    seen, first = defaultdict(set), {}
    for i, t in sorted(docs):
        for p, line in enumerate((t or "").split("\n")):
            seen[key(line)].add((i, t))
            first.setdefault(key(line), (i, p))
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        gone = [bool(key(x)) and len(seen[key(x)]) >= min_docs and not (keep_first and first[key(x)] == (i, p)) for p, x in enumerate(lines)]
        out[i] = (len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g))
    return out


@pytest.mark.parametrize("keep_first", [False, True])
def test_lines_against_plain_python(spark, keep_first):
    texts = [None, "", "\n", "A line \nown %d", "\ta LINE\n\n\nÉté", "été\na line", "\x0ba line\x0c\nx "] + ["boiler\n%d\nBOILER" % i for i in range(150)]
    texts += ["\n".join(f"l{i % 70}" for i in range(400)), "\n".join(f"l{i}" for i in range(70))]
    docs = frame(spark, texts).withColumns({"pos": F.lit("a"), "h1": F.lit(None).cast("int"), "kept": F.lit(3)})
    want = plain_lines(list(enumerate(texts)), 2, keep_first)
    marked = line_dedup.keep_bitmaps(docs, 2, keep_first=keep_first)
    got = marked.withColumn("t", line_dedup.kept_text(F.col("text"), F.col("kept"), F.col("n_dropped"))).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["t"]) for r in got} == want
    cleaned = line_dedup.drop_common_lines(docs, 2, keep_first=keep_first)
    assert cleaned.columns == docs.columns and cleaned.filter("text IS NULL").count() == 1
    assert line_dedup.keep_bitmaps(docs.filter("false"), 2).count() == 0


def test_repeated_rows_of_one_document_are_one(spark):
    docs = spark.createDataFrame([(1, "a\nb"), (1, "a\nb"), (None, "b"), (2, "c")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_dropped"]) for r in line_dedup.keep_bitmaps(docs, 2).collect())
    assert got == [(0, 1), (1, 1), (1, 1), (2, 0)]


def test_op5_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    result = con.execute(registry.ORACLES["op5_line_dedup"])
    names = [d[0] for d in result.description]
    df = registry.QUERIES["op5_line_dedup"](spark, SF)
    assert rows_of(df.columns, df.collect()) == rows_of(names, result.fetchall())


def test_line_dedup_runs_no_python(spark):
    plan = registry.QUERIES["op5_line_dedup"](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- language ----------------------------------------------------------------------------


def test_op10_held_out_accuracy(spark):
    got = registry.QUERIES["op10_language_mix"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and held
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_mixtures_and_odd_texts(spark):
    en, de = "the house and the garden were with them that day ", "der hund und die katze sind nicht im haus und auch nicht "
    train = frame(spark, [en * 30, de * 30]).withColumn("lang", F.expr("if(doc_id = 0, 'en', 'de')"))
    model = language_mix.LanguageModel.learn(train)
    odd = frame(spark, [None, "", "123 !?", en, de * 3 + en, en * 60_000]).withColumns({"score": F.lit("x"), "lang": F.lit(None).cast("string")})
    got = {r["doc_id"]: r for r in language_mix.identify(odd, model).collect()}
    assert [got[i]["lang_pred"] for i in range(6)] == ["und", "und", "und", "en", "de", "en"]
    assert got[4]["languages"] == ["de", "en"] and 0.6 < got[4]["proportions"][0] < 0.9
    assert got[3]["languages"] == ["en"] and got[0]["score"] == 0
    nothing = language_mix.LanguageModel.learn(train.filter("false"))
    assert {r["lang_pred"] for r in language_mix.identify(odd, nothing).collect()} == {"und"}
    assert language_mix.identify(odd.filter("false"), model).count() == 0


def test_mixture_proportions_maximise_likelihood():
    rng = np.random.default_rng(0)
    given_ = rng.random((2, 50))
    given_ /= given_.sum(axis=1, keepdims=True)
    counts = rng.multinomial(5000, 0.3 * given_[0] + 0.7 * given_[1])
    share, value = language_mix.LanguageModel._proportions(given_, counts, counts.sum())
    grid = np.linspace(0.001, 0.999, 999)
    best = max(float(np.log(g * given_[0] + (1 - g) * given_[1]) @ counts) for g in grid)
    assert value > best - 0.5 and abs(share.sum() - 1) < 1e-9


# --- secrets -----------------------------------------------------------------------------


def test_forest_on_findings_it_has_not_seen(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    corpus = secret_scan.Corpus.of(docs)
    forest = secret_scan.train(spark, corpus, secret_scan.made_findings(corpus.common))
    fresh = secret_scan.made_findings(corpus.common, 600, seed=99)
    rows = [([float(x) for x in secret_scan.features(b, v, a, corpus)], y) for b, v, a, y in fresh]
    from pyspark.ml.functions import array_to_vector

    frame_ = spark.createDataFrame(rows, "x array<double>, y int").withColumn("features", array_to_vector("x"))
    right = forest.transform(frame_).filter("prediction = y").count()
    assert right >= 0.95 * len(fresh)


def test_op6_finds_planted_tokens_and_no_addresses(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = defaultdict(set)
    for r in registry.QUERIES["op6_secret_scan"](spark, SF).collect():
        value = docs[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert hashlib.sha256(value.encode()).hexdigest() == r["value_sha256"]
        got[r["doc_id"]].add(value)
    for doc_id, text in docs.items():
        assert set(re.findall(r'token = "([0-9a-f]{40})"', text)) <= got[doc_id]
    assert not any("example.com" in v for vs in got.values() for v in vs)


def test_masking(spark):
    secret = "0f1e2d3c4b5a69788796a5b4c3d2e1f00f1e2d3c"
    texts = [None, "", f'é token = "{secret}" and\nmore', f'token = "{secret}" x token = "{secret[::-1]}"', "commit " + secret + " was plain", "nothing here"]
    docs = frame(spark, texts).union(frame(spark, texts[:4])).withColumns({"start": F.lit(1), "x": F.lit("k")})
    got = secret_scan.mask_secrets(docs)
    assert got.columns == docs.columns
    rows = sorted((r["doc_id"], r["text"], r["n_chars"]) for r in got.collect() if r["text"] is not None)
    assert (2, 'é token = "[SECRET]" and\nmore', 29) in rows and (3, 'token = "[SECRET]" x token = "[SECRET]"', 39) in rows
    assert (5, "nothing here", 12) in rows and len(rows) == 8 and got.count() == 10
    assert secret_scan.mask_secrets(docs.filter("false")).count() == 0


NAMED = [
    ("password: ", "hunt3r1", ""), ("postgres://app:", "Tr0ub4dor", "@db.internal/x"), ("passphrase: ", "correct1horse", " and more"),
    ("password is ", "Tr0ub4dor99", ""), ("client_secret=", "9f8e7d6c5b4a39281706f5e4d3c2b1a0", ""), ("DB_PASSWORD=", "correct1horse", ""),
    ("AWS_SECRET_ACCESS_KEY=", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzEXAQRLEKE", ""), ("private_key=", "abcDEF0123987654xyz", ""),
    ("https://h.org/a?access_token=", "ya29.a0AfH6SMBx8273645", "&page=1"), ("see /a/b1/c/d2/PASSWORD=", "Tr0ub4dor99", ""),
    ("Authorization: Bearer ", "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl", ""), ('{\\"password\\": \\"', "Abcd1239", '\\"}'),
]


def test_named_values_are_candidates_without_their_names():
    for before, value, after in NAMED:
        found = [(start, v) for start, _, v, _ in secret_scan.candidates_of(f"one two {before}{value}{after}")]
        assert (len("one two " + before), value) in found, before
    long = "token" * 100_000
    assert list(secret_scan.candidates_of(long)) == [] and [v for _, _, v, _ in secret_scan.candidates_of(long + "1")] == [long + "1"]


def test_made_findings_are_candidates_of_whole_texts(spark):
    corpus = secret_scan.Corpus.of(spark.read.parquet(f"{SF}/documents.parquet"))
    for before, value, after, _ in secret_scan.made_findings(corpus.common, 300, seed=4):
        assert value in [v for _, _, v, _ in secret_scan.candidates_of(before + value + after)] or len(before) == secret_scan.CONTEXT
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [f"one two three {b}{v}{a}" for b, v, a in NAMED] + ["the password is required here", "token: required", "mail a.5@mail99.example.com now"]
    found = secret_scan.scan_secrets(frame(spark, texts), *secret_scan.learned(docs)).filter("score >= 0.5").collect()
    hit = {(r["doc_id"], r["start"], r["length"]) for r in found}
    assert sum((i, len("one two three " + b), len(v)) in hit for i, (b, v, _) in enumerate(NAMED)) >= len(NAMED) - 1
    assert not {r["doc_id"] for r in found} & set(range(len(NAMED), len(texts)))


def test_pipeline_keeps_texts_where_no_language_is_named(spark):
    import corpus_pipeline

    texts = ["some words here", "日本語", "12 34 !", "", None, "x"]
    docs = frame(spark, texts).withColumn("lang", F.lit(None).cast("string"))
    got = corpus_pipeline.keep_known_languages(spark, docs, SF)
    assert got.columns == docs.columns
    assert {r["text"] for r in got.collect()} == {"some words here", "日本語", "x"}


def test_numerals_are_no_letters(spark):
    docs = frame(spark, ["der die das und", "²½ Ⅷ ٣", "ª"])
    model = language_mix.learn_from(docs)
    got = {r["doc_id"]: r["lang_pred"] for r in language_mix.identify(docs, model).collect()}
    assert got[1] == "und" and got[0] == "en" and got[2] == "en"


def test_short_parts_are_kept_in_a_table_of_fixed_size(monkeypatch):
    """Whatever comes, the table stays as large as it is and a part is encoded once while it stands there."""
    asked = []

    def plainly(parts):
        asked.extend(parts)
        return [np.array([len(p), *map(ord, p[:9])], "<u4").tobytes() for p in parts]

    monkeypatch.setattr(tokens, "CACHE_BYTES", 200 * 50)
    encoder = tokens.ChunkEncoder(plainly)
    places = len(encoder.table.ids)
    want = lambda text: b"".join(np.array([len(p), *map(ord, p[:9])], "<u4").tobytes() for p in tokens.parts_of(text))
    text = "a bb ccc dddd a bb"
    assert encoder.ids([text, text]) == [want(text)] * 2
    assert len(asked) == len(set(asked))
    known = len(asked)
    assert encoder.ids([text]) == [want(text)] and len(asked) == known
    many = " ".join(f"w{i} longer{i} much-longer-than-that{i}" for i in range(2000))
    assert encoder.ids([many, text]) == [want(many), want(text)]
    assert len(encoder.table.ids) == places and len(encoder.fresh) + len(encoder.old) < 4000


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_parts_side_by_side_give_their_own_ids(library, name):
    """Words with accents, stops and quotes in one call: few of them need a mark between them."""
    words = ["Straße", "naïve.", "l'été", "don't", "ÀÉÎ", "<|endoftext|>", "İst", "éa", "x ", "σας", "a×b", "12ab", "日本", "x<y", "%%%"]
    text = " " + " ".join(f"{a}{b}" for a in words for b in words)
    encoder = tokens.library_encoder(tokens.tokenizer_file(name))
    pool, first, size = encoder.encode_raw([f" {w}".encode() for w in words])
    for w, at, n in zip(words, first, size):
        assert pool[at : at + n].tolist() == ids_of(library, name, f" {w}"), w
    assert np.frombuffer(encoder.ids([text])[0], "<u4").tolist() == ids_of(library, name, text)
