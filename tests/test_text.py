import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderlens.config import TextSettings
from tenderlens.functions.text import fold, one_two_grams, tokens
from tenderlens.functions.vectors import dense_dot, sparse_dot
from tenderlens.operators import embeddings, text
from tenderlens.plans.score_job import attach_dense
from tenderlens.sources.tables import EMBEDDING_SCHEMA, read_embeddings, upsert_embeddings

ALL_TERMS = TextSettings(min_texts=1)


def lines(spark, rows):
    df = spark.createDataFrame(rows, "tender_id string, outcome string, item_text string, offer_text string")
    return text.with_text_hashes(df)


def test_tokens_fold_accents_and_keep_unicode_words(spark):
    df = spark.createDataFrame([("Camión ñandú  a 12 ÁÉ_x straße",), ("étude",), ("",)], "t string")
    got = [r[0] for r in df.select(tokens(F.col("t"))).collect()]
    assert got == [["camion", "nandu", "12", "ae_x", "straße"], ["etude"], []]
    assert df.select(fold(F.lit("ÀÇ"))).first()[0] == "ac"


@pytest.mark.parametrize("text", ["ữ ṡ ὰ", "ﬁn ﬃ ĳ", "한글 가 힣", "ｆｕｌｌ ① ℋ ½", "İstanbul Σας", "𝒜 𝔟 ﷺ", "plain", "e\u0301\u0327 o\u0308"])
def test_folding_is_that_of_unicode(spark, text):
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    assert spark.range(1).select(fold(F.lit(text)), fold(F.concat(F.lit(text), F.lit(""))).alias("b")).first()[0] == plain


def test_grams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>")
    assert [r[0] for r in df.select(one_two_grams(F.col("w"))).collect()] == [["a", "b", "c", "a b", "b c"], ["a"], []]


def test_sparse_dot_against_dict(spark):
    rng = np.random.default_rng(0)
    def vec():
        ids = rng.choice(30, 12, replace=False)
        return [(int(i), float(w)) for i, w in zip(ids, rng.normal(size=12))]
    rows = [(vec(), vec()) for _ in range(20)] + [([], vec())]
    df = spark.createDataFrame(rows, "a array<struct<id:int,w:double>>, b array<struct<id:int,w:double>>")
    got = [r[0] for r in df.select(sparse_dot(F.col("a"), F.col("b"))).collect()]
    want = [sum(w * dict(b).get(i, 0.0) for i, w in a) for a, b in rows]
    assert got == pytest.approx(want)
    dense = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], "a array<float>, b array<float>")
    assert dense.select(dense_dot(F.col("a"), F.col("b"))).first()[0] == 11.0


def test_shared_text_counts_twice(spark):
    hashed = lines(spark, [("1", "won", "red bolt", "red bolt"), ("2", "won", "red nut", None)])
    texts = {r["text"]: r["copies"] for r in text.corpus(hashed).collect()}
    assert texts == {"red bolt": 2, "red nut": 1, "": 1}
    vocabulary = {r["term"]: r for r in text.fit_vocabulary(text.corpus(hashed), ALL_TERMS).collect()}
    assert vocabulary["red"]["n_texts"] == 3
    assert vocabulary["red"]["idf"] == pytest.approx(math.log(5 / 4) + 1)
    assert vocabulary["red"]["term_id"] == 0


def test_similarity_bounds_and_deltas(spark):
    rows = [
        ("1", "won", "acero inoxidable liso", "acero inoxidable liso"), ("1", "lost", "acero inoxidable liso", "madera verde"),
        ("1", "other", "acero inoxidable liso", "acero"), ("2", "won", "madera verde", None), ("3", "lost", "acero", "madera verde clara"),
    ]
    hashed = lines(spark, rows)
    pairs = text.lexical_similarity(hashed, ALL_TERMS)
    values = [r["similarity"] for r in pairs.collect()]
    assert len(values) == 5 and all(-1e-12 <= v <= 1 + 1e-12 for v in values)
    got = {r["tender_id"]: r for r in text.delta_similarity(text.pair_lines(hashed), pairs, "tfidf").collect()}
    assert got["1"]["sim_won_tfidf"] == pytest.approx(1.0)
    assert (got["1"]["sim_lost_tfidf"], got["1"]["delta_sim_tfidf"]) == (0.0, pytest.approx(1.0))
    assert (got["2"]["sim_won_tfidf"], got["2"]["sim_lost_tfidf"], got["2"]["delta_sim_tfidf"]) == (0.0, None, None)


def test_vocabulary_below_minimum_gives_zero(spark):
    hashed = lines(spark, [("1", "won", "uno dos", "uno dos"), ("2", "lost", "tres", "cuatro")])
    assert {r["similarity"] for r in text.lexical_similarity(hashed).collect()} == {0.0}


def test_vocabulary_cut_is_by_frequency_then_term(spark):
    hashed = lines(spark, [("1", "won", "bb bb aa cc", "aa cc")])
    kept = text.fit_vocabulary(text.corpus(hashed), TextSettings(max_terms=2, min_texts=1)).orderBy("term_id").collect()
    assert [r["term"] for r in kept] == ["aa", "aa cc"] or [r["term"] for r in kept] == ["aa", "bb"]
    assert [r["occurrences"] for r in kept] == [2, 2]


def test_line_counts_weigh_the_mean(spark):
    same = ("1", "won", "alfa beta", "alfa beta")
    hashed = lines(spark, [same, same, same, ("1", "won", "alfa beta", "gama")])
    pairs = text.lexical_similarity(hashed, ALL_TERMS)
    assert text.delta_similarity(text.pair_lines(hashed), pairs, "x").first()["sim_won_x"] == pytest.approx(0.75)


def test_embeddings_only_encode_misses(spark):
    def make_encoder():
        return lambda texts: np.array([[len(t), 1.0] for t in texts], dtype=np.float32)

    texts = spark.createDataFrame([("h1", "abc"), ("h2", "hello"), ("h3", "")], "text_hash string, text string")
    cache = spark.createDataFrame(
        [("h1", "m", [0.0, 1.0]), ("h2", "other", [1.0, 0.0])], EMBEDDING_SCHEMA
    )
    fresh = embeddings.embed_missing(texts, cache, make_encoder, "m", batch_size=1)
    got = {r["text_hash"]: r for r in fresh.collect()}
    assert set(got) == {"h2", "h3"} and got["h2"]["model"] == "m"
    assert all(np.linalg.norm(r["embedding"]) == pytest.approx(1.0) for r in got.values())
    full = {(r["text_hash"], r["model"]) for r in upsert_embeddings(cache, fresh).collect()}
    assert full == {("h1", "m"), ("h2", "m"), ("h3", "m")}
    assert [r["text_hash"] for r in embeddings.cache_hits(texts, cache, "m").collect()] == ["h1"]


def test_dense_similarity_misses_are_null(spark):
    pairs = spark.createDataFrame([("a", "b"), ("a", "zz")], "a_hash string, b_hash string")
    vectors = spark.createDataFrame([("a", [0.6, 0.8]), ("b", [0.6, 0.8])], "text_hash string, embedding array<float>")
    got = {r["b_hash"]: r["similarity"] for r in text.dense_similarity(pairs, vectors).collect()}
    assert got["b"] == pytest.approx(1.0) and got["zz"] is None


def test_dense_features_encode_each_text_once(spark, tmp_path):
    path, marks = str(tmp_path / "cache"), tmp_path / "marks"
    marks.mkdir()
    folder = str(marks)

    def make_encoder():
        def encode(texts):
            for t in texts:
                with open(f"{folder}/{t or 'empty'}", "a") as f:
                    f.write("x")
            return np.array([[1.0, float(len(t))] for t in texts], dtype=np.float32)

        return encode

    rows = [("1", "won", "abc", "xyz"), ("1", "lost", "abc", ""), ("2", "won", "abc", None)]
    offers = spark.createDataFrame(rows, "tender_id string, outcome string, item_text string, offer_text string")
    tenders = spark.createDataFrame([("1",), ("2",), ("3",)], "tender_id string")
    hashed = text.with_text_hashes(offers)
    lines = text.pair_lines(hashed)
    for _ in range(2):
        got = {r["tender_id"]: r for r in attach_dense(tenders, hashed, lines, make_encoder, "m", path).collect()}
        assert got["1"]["sim_won_dense"] == pytest.approx(1.0)
        assert got["1"]["delta_sim_dense"] == pytest.approx(1.0 - 1 / math.sqrt(10))
        assert got["2"]["sim_lost_dense"] is None and got["3"]["sim_won_dense"] is None
    assert {p.name: p.read_text() for p in marks.iterdir()} == {"abc": "x", "xyz": "x", "empty": "x"}
    assert read_embeddings(spark, path, "m").count() == 3 and read_embeddings(spark, path, "other").count() == 0
    alone = attach_dense(tenders, hashed, lines, make_encoder, "m").filter("tender_id = '1'").first()
    assert alone["sim_won_dense"] == pytest.approx(1.0)


def test_characters_that_fold_to_several_are_few_runs(spark):
    from tenderlens.functions import text as folding

    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    found = spark.createDataFrame([(c,) for c in chars], "c string").filter(F.col("c").rlike(folding._SEVERAL_PATTERN))
    assert {r["c"] for r in found.collect()} == set(folding._SEVERAL) | {chr(c) for c in range(0xAC00, 0xD7A4)}
    assert folding._SEVERAL_PATTERN.count("x{") < 300  # each is tried in turn, so not one for each character


def test_terms_are_counted_in_the_rows_of_texts(spark):
    rows = [("1", "won", "uno dos tres uno dos", "dos tres"), ("2", "lost", "dos tres", "uno dos"), ("3", "won", None, "seis")]
    texts = text.corpus(lines(spark, rows)).coalesce(1)
    plan = text.fit_vocabulary(texts, TextSettings(max_terms=None, min_texts=1))
    want = {r["term"]: (r["n"], r["o"]) for r in text.term_counts(text.word_lists(texts)).groupBy("term").agg(
        F.sum("copies").alias("n"), F.sum(F.col("tf") * F.col("copies")).alias("o")).collect()}
    for held in (1, 3, 1000):
        got = {r["term"]: (r["n_texts"], r["occurrences"]) for r in text.term_totals(text.word_lists(texts), held).collect()}
        assert got == want
    # "dos tres" is found on both sides and counts twice.
    assert want["dos"] == (4, 5) and want["dos tres"] == (3, 3)

    def as_dict(vectors):
        return {r["text_hash"]: (r["norm"], sorted((t["id"], t["w"]) for t in r["terms"])) for r in vectors.collect()}

    looked_up, joined = as_dict(text.tfidf_vectors(texts, plan)), as_dict(text.tfidf_vectors(texts, plan, listed=2))
    assert looked_up.keys() == joined.keys() and len(joined) == 4
    for key, (norm, terms) in joined.items():
        assert looked_up[key][0] == pytest.approx(norm)
        assert [t[0] for t in looked_up[key][1]] == [t[0] for t in terms]
        assert [t[1] for t in looked_up[key][1]] == pytest.approx([t[1] for t in terms])


def test_texts_are_read_off_the_pair_counts(spark):
    df = lines(spark, [("t", "Adjudicada", "a b", None), ("t", "x", "a b", ""), ("u", None, None, "c d"), (None, "x", "a b", "c d")])
    kept = text.pair_lines(df, with_text=True)
    plain = sorted(map(tuple, text.pair_lines(df).collect()), key=str)
    assert sorted(map(tuple, kept.drop("item_text", "offer_text").collect()), key=str) == plain
    want = {(r["text"], r["copies"]) for r in text.corpus(df).collect()}
    found = text.corpus(kept)
    assert {(r["text"], r["copies"]) for r in found.collect()} == want == {("a b", 1), ("", 2), ("c d", 1)}
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def _prose(spark, n=40):
    """A few frequent words among rare ones, in texts of both sides; one text without words and one missing."""
    rng = np.random.default_rng(7)
    def sentence(i):
        return " ".join(f"w{min(int(rng.zipf(1.3)), 40)}" if rng.random() < 0.7 else f"rare{i}x{j}" for j in range(30))
    texts = [sentence(i) for i in range(n)] + ["", None]
    return lines(spark, [(str(i // 4), ("won", "lost", "other")[i % 3], a, b) for i, (a, b) in enumerate(zip(texts, [*texts[1:], "¿? !"]))])


def test_vocabulary_counts_only_terms_of_heavy_buckets(spark, monkeypatch):
    words = text.stored(text.word_lists(text.corpus(_prose(spark))))
    every = text.term_totals(words).filter(F.col("n_texts") >= 3)
    want = sorted((r["term"], r["n_texts"], r["occurrences"]) for r in every.orderBy(F.desc("occurrences"), "term").limit(10).collect())
    seen, plain = [], text.term_totals
    def counted(*a, heavy=None, **b):
        df = plain(*a, heavy=heavy, **b)
        seen.append(None if heavy is None else df.count())
        return df
    monkeypatch.setattr(text, "term_totals", counted)
    def found():
        return sorted((r["term"], r["n_texts"], r["occurrences"]) for r in text._most_frequent(words, 3, 10).collect())
    assert found() == want and seen[0] < plain(words).count() / 10
    # A cut that was set too high is lowered until it holds.
    seen.clear()
    monkeypatch.setattr(text, "_likely_cut", lambda counts, terms: 10**5)
    assert found() == want and len(seen) > 1


def test_packed_terms_round_trip():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    at = np.repeat([0, 2, 3], [3, 1, 200])
    ids = np.concatenate([[0, 5, 300_000], [199_999], np.sort(rng.choice(40_000, 200, replace=False))])
    tf = rng.integers(1, 20_000, len(ids))
    kept, packed = text._packed_terms(at, ids, tf)
    assert kept.tolist() == [0, 2, 3]
    rows = pa.array([None, *packed.to_pylist(), None])
    for shift, some in ((1, rows), (0, rows.slice(1, 3))):
        got = text._unpacked_terms(some)
        assert got[0].tolist() == (np.searchsorted([0, 2, 3], at) + shift).tolist()
        assert got[1].tolist() == ids.tolist() and got[2].tolist() == tf.tolist()
    assert [len(x) for x in text._unpacked_terms(pa.array([None, None], "binary"))] == [0, 0, 0]
    assert [len(x) for x in text._packed_terms(at[:0], ids[:0], tf[:0])] == [0, 0]


def test_packed_cosines_equal_those_of_sparse_rows(spark):
    hashed = _prose(spark)
    settings = TextSettings(max_terms=60, min_texts=2)
    packed, rows = (
        {(r["a_hash"], r["b_hash"]): r["similarity"] for r in text.lexical_similarity(hashed, settings, listed=n).collect()}
        for n in (1000, 0)
    )
    assert packed == pytest.approx(rows) and len(packed) == 42 and 0.0 in packed.values() and max(packed.values()) > 0.1


def test_each_document_meets_the_next_one(spark, tmp_path):
    from catalog import bindings

    ids = [*range(-3, 3), 62, 63, 64, 64, 65, 127, 128, 128, 130, None, None, 2**62, 2**62 + 1]
    rows = [(d, f"text {i}" if i % 7 else None, "en") for i, d in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = bindings.text_lines(spark, str(tmp_path))
    want = sorted(((d, t, u) for d, t, _ in rows for u in ([u for e, u, _ in rows if d is not None and e == d + 1] or [None])), key=str)
    assert sorted(((r["doc_id"], r["item_text"], r["offer_text"]) for r in got.collect()), key=str) == want
    assert {r["outcome"] for r in got.filter("doc_id IS NULL").collect()} == {"other"}
    # Texts are shuffled once, not as questions and as answers.
    fresh = bindings.text_lines(spark, str(tmp_path))
    assert str(fresh._jdf.queryExecution().executedPlan()).count("Exchange") == 1


def test_what_was_shuffled_for_a_stored_table_is_deleted(spark):
    import time
    from pathlib import Path

    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    def shuffled():
        return {p.name for d in folders for p in Path(d.getPath()).rglob("shuffle_*.data")}
    before, setting = shuffled(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false")
    table = text.stored(spark.range(1000).repartition(3, "id"))
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before and table.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == setting
