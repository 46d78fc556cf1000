"""Line deduplication that moves hashes and returns bitmaps.

Line hashes are range-partitioned with a salt of the document, sorted inside by document and
position, and read as streams: each stream gives the first occurrence of a line and the
number of documents that hold it. The answer for a document is a bitmap of the lines it
keeps; whole words of ones are left out, so a document that loses nothing has an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tenderlens.llm.common import digest, shuffle_parts, stored, table

WORD = 62
SALTS = 64
# The characters stripped from a line, and ASCII letters only.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_lines(text: Column) -> Column:
    """Lines of a text; null and empty texts are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def line_occurrences(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(h1, h2, d1, d2, doc, pos) of every line whose key has at least ``min_chars`` code points.

    d1, d2 tell rows with equal doc_id and different text apart.
    """
    d1, d2 = digest(F.col("doc_id"), F.col("text"))
    lines = docs.select(F.col("doc_id").alias("doc"), d1.alias("d1"), d2.alias("d2"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    keyed = lines.withColumn("key", line_key(F.col("line"))).filter(F.char_length("key") >= max(min_chars, 0))
    h1, h2 = digest(F.col("key"))
    return keyed.select(h1.alias("h1"), h2.alias("h2"), "d1", "d2", "doc", "pos")


def line_stats(occurrences: DataFrame, salts: int = SALTS) -> DataFrame:
    """(h1, h2, n_docs, first_doc, first_d1, first_d2, first_pos) of every line hash.

    The salt comes from the document, so a document's lines of one hash stay in one stream and
    a line that a third of all rows hold is spread over ``salts`` streams; their sums are exact.
    """
    parts = shuffle_parts(occurrences.sparkSession)
    stream = Window.partitionBy("h1", "h2", "salt").orderBy("doc", "d1", "d2", "pos")
    streamed = (
        occurrences.withColumn("salt", F.pmod("d2", F.lit(salts)).cast("int"))
        .repartitionByRange(parts, "h1", "h2", "salt")
        .withColumn("place", F.struct("doc", "d1", "d2", "pos"))
        .withColumn("before", F.lag(F.struct("d1", "d2")).over(stream))
        .withColumn("new_doc", (F.col("before").isNull() | (F.col("before") != F.struct("d1", "d2"))).cast("long"))
    )
    return streamed.groupBy("h1", "h2").agg(F.sum("new_doc").alias("n_docs"), F.min("place").alias("first")).select(
        "h1", "h2", "n_docs", F.col("first.doc").alias("first_doc"), F.col("first.d1").alias("first_d1"),
        F.col("first.d2").alias("first_d2"), F.col("first.pos").alias("first_pos"),
    )


def dropped_bitmaps(docs: DataFrame, min_docs: int, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """(d1, d2, dropped): the words of each document's bitmap that have a line to drop.

    A line goes where its key is in at least ``min_docs`` documents; with ``keep_first`` its
    first occurrence stays. ``dropped`` is an array of (word, bits).
    """
    # Stored once: the range layout reads its input twice, and the join reads it again.
    occurrences = stored(line_occurrences(docs, min_chars))
    # Unique on their side, so a hot line only repeats on the left; stored, so that both sides of
    # the join are shuffles of their own and adaptive execution can split the left one.
    frequent = stored(line_stats(occurrences).filter(F.col("n_docs") >= min_docs))
    lost = occurrences.join(frequent, ["h1", "h2"])
    if keep_first:
        lost = lost.filter(~((F.col("d1") == F.col("first_d1")) & (F.col("d2") == F.col("first_d2")) & (F.col("pos") == F.col("first_pos"))))
    return (
        lost.groupBy("d1", "d2", (F.col("pos") / WORD).cast("int").alias("word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, pos % {WORD})")).alias("bits"))
        .groupBy("d1", "d2").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"))
    )


def keep_bitmaps(docs: DataFrame, min_docs: int, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept: (word, bits) of the words with a line to drop.

    Bit ``i`` of word ``w`` stands for line ``62 w + i`` of the text split at newlines and is 1
    where the line stays; words that are not listed are all ones. A null or empty text is one
    empty line. Rows with equal doc_id and text count as one document and get the same bitmap;
    rows with equal doc_id and different text are two. An empty table gives no row. All
    columns of ``docs`` stay; those three are replaced if they are there.
    """
    d1, d2 = digest(F.col("doc_id"), F.col("text"))
    bitmaps = dropped_bitmaps(docs.select("doc_id", "text"), min_docs, min_chars, keep_first).select(
        F.col("d1").alias("_line_d1"), F.col("d2").alias("_line_d2"), F.col("dropped").alias("_line_dropped")
    )
    full = (1 << WORD) - 1
    return (
        docs.drop("n_lines", "n_dropped", "kept")
        .withColumns({"_line_k1": d1, "_line_k2": d2})
        .join(bitmaps, (F.col("_line_k1") == F.col("_line_d1")) & (F.col("_line_k2") == F.col("_line_d2")), "left")
        .withColumns({
            "n_lines": F.size(split_lines(F.col("text"))).cast("long"),
            "n_dropped": F.coalesce(
                F.aggregate(F.map_values("_line_dropped"), F.lit(0), lambda s, b: s + F.bit_count(b)), F.lit(0)
            ).cast("long"),
            "kept": F.transform_values("_line_dropped", lambda w, b: F.bitwise_not(b).bitwiseAND(F.lit(full))),
        })
        .drop("_line_k1", "_line_k2", "_line_d1", "_line_d2", "_line_dropped")
    )


def kept_text(text: Column, kept: Column, n_dropped: Column) -> Column:
    """The lines that a bitmap keeps, joined by newlines; null and empty texts give an empty one."""
    stays = F.filter(
        split_lines(text),
        lambda line, i: F.coalesce(F.getbit(kept[(i / WORD).cast("int")], i % WORD), F.lit(1)) == 1,
    )
    return F.when(n_dropped > 0, F.array_join(stays, "\n")).otherwise(F.coalesce(text, F.lit("")))


def drop_common_lines(docs: DataFrame, min_docs: int, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """``docs`` with the text that stays; a text that loses nothing is left as it was, null too."""
    columns = docs.columns
    marked = keep_bitmaps(docs, min_docs, min_chars, keep_first)
    text = F.when(F.col("n_dropped") > 0, kept_text(F.col("text"), F.col("kept"), F.col("n_dropped"))).otherwise(F.col("text"))
    return marked.withColumn("text", text).select(*columns)


MIN_DOCS = 10


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = keep_bitmaps(table(spark, sf_dir, "documents"), MIN_DOCS)
    return marked.select(
        "doc_id", "n_lines", "n_dropped",
        F.sha2(kept_text(F.col("text"), F.col("kept"), F.col("n_dropped")), 256).alias("kept_sha256"),
    )


OP5_SQL = f"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k
  FROM split
), common AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
), marked AS (
  SELECT doc_id, pos, line, k IN (SELECT k FROM common) AS gone FROM keyed
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
