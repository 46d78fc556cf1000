"""Reader of the bulk offer-line CSV files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tenderlens.operators.cleaning import text_columns, union_by_name
from tenderlens.session import stored

SEPARATOR = ";"
ENCODING = "ISO-8859-1"
ROW_ORDER = "row_id"
MISFIT = "misfit_row"
# So many file names (some MB) may be broadcast; with more of them the join shuffles.
LISTED = 50_000

# Cells read as missing.
NULL_MARKERS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Cells typed as numbers on reading (no decimal comma here).
INTEGER_PATTERN = r"^\s*[+-]?\d{1,18}\s*$"
FLOAT_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"


def csv_files(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the CSV files directly under a folder, sorted; no content is read."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(folder, "*.csv")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(status.getPath().toString() for status in found or [] if status.isFile())


def _reader(spark: SparkSession, multi_line: bool):
    return (
        spark.read.option("sep", SEPARATOR).option("encoding", ENCODING).option("header", True)
        .option("escape", '"').option("multiLine", multi_line).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", MISFIT)
    )


# A cell: quoted, with doubled quotes inside and perhaps a tail before the separator, or plain; and the rest of a
# line whose cell began in an earlier one. Possessive, so that no line is tried in more than one way.
_QUOTED = r'[^"]*+(?:""[^"]*+)*+"(?:[^";][^;]*+)?'
_CELLS = f'(?:"{_QUOTED}|(?:[^";][^;]*+)?)'
_ENDS_OUTSIDE = f"(?s)^{_CELLS}(?:;{_CELLS})*+$"
_CLOSES = f"(?s)^{_QUOTED}(?:;{_CELLS})*+$"


def physical_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(_file, _start, _line, value, after_out, after_in): the lines of every split, and whether a line that begins
    outside or inside a quoted cell ends inside one."""
    raw = spark.read.option("lineSep", "\n").text(list(paths)).select(
        F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)).alias("_line"),
        F.decode(F.col("value").cast("binary"), ENCODING).alias("value"),
    )
    bare = F.regexp_replace("value", r"\r$", "")
    return raw.select("*", (~bare.rlike(_ENDS_OUTSIDE)).cast("int").alias("after_out"), (~bare.rlike(_CLOSES)).cast("int").alias("after_in"))


def has_line_breaks_in_cells(spark: SparkSession, paths: Sequence[str]) -> bool:
    """Whether some line leaves a quoted cell open, so that it goes on in the next."""
    return not physical_lines(spark, paths).filter("after_out = 1").isEmpty()


def _composed(df: DataFrame, keys: Sequence[str], order: str, out: str, inside: str, name: str) -> DataFrame:
    """Add ``name``: the steps from the first row of its keys to this one, as one.

    A step maps outside/inside at its begin to outside/inside at its end: it forgets what was
    before (both give the same), keeps it, or turns it round. So many of them in a row are the
    last that forgets and the parity of turns after it, which running sums give.
    """
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    forgets = F.col(out) == F.col(inside)
    turns = F.sum(((F.col(out) == 1) & (F.col(inside) == 0)).cast("long")).over(upto)
    df = df.withColumn("_turns", turns)
    fixed = F.last(F.when(forgets, F.struct(F.col(out).alias("value"), F.col("_turns").alias("at"))), ignorenulls=True).over(upto)
    df = df.withColumn("_fixed", fixed)
    since = F.pmod(F.col("_turns") - F.coalesce(F.col("_fixed.at"), F.lit(0)), F.lit(2)).cast("int")
    known = F.col("_fixed.value")

    def of(begin: int):
        return F.coalesce(known, F.lit(begin)).bitwiseXOR(since)

    return df.withColumn(name, F.struct(of(0).alias("out"), of(1).alias("inside"))).drop("_turns", "_fixed")


def records(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(_file, _start, _line, value): the records of CSV files whose quoted cells may hold line breaks, headers left out.

    Splits are read side by side, as for files without such cells. What the lines of a split
    do to the state at its begin is one step; a scan over the steps of a file's splits tells
    where each begins. Only the lines of records with several are brought together; place and
    line are those of the first. A file that ends inside a cell is an error.
    """
    lines = physical_lines(spark, paths)
    split = ["_file", "_start"]
    inside = Window.partitionBy(*split).orderBy("_line")
    stepped = _composed(lines, split, "_line", "after_out", "after_in", "_upto").withColumns({
        "_before": F.lag("_upto").over(inside), "_head": (F.row_number().over(inside) == 1) & (F.col("_start") == 0),
    })
    # Read twice; the files are cut into lines, matched and sorted once.
    stepped = stored(stepped)
    # One row for each split: what it does, and where its last record begins for either state at its begin.
    begins = {
        s: F.max(F.when((F.coalesce(F.col(f"_before.{s}"), F.lit(0 if s == "out" else 1))) == 0, F.col("_line"))) for s in ("out", "inside")
    }
    splits = stepped.groupBy(*split).agg(
        F.max_by("_upto", "_line").alias("_does"), begins["out"].alias("_last_out"), begins["inside"].alias("_last_inside")
    ).select("*", F.col("_does.out").alias("_out"), F.col("_does.inside").alias("_inside"))
    of_file = Window.partitionBy("_file").orderBy("_start")
    splits = stored(_composed(splits, ["_file"], "_start", "_out", "_inside", "_all").withColumn(
        "_begin", F.coalesce(F.lag("_all.out").over(of_file), F.lit(0))
    ))
    broken = splits.groupBy("_file").agg(F.max_by("_all.out", "_start").alias("open")).filter("open = 1").select("_file").limit(5).collect()
    if broken:
        raise ValueError(f"a quoted cell is never closed in {', '.join(r['_file'] for r in broken)}")
    last = F.when(F.col("_begin") == 0, F.col("_last_out")).otherwise(F.col("_last_inside"))
    opened = F.last(F.when(last.isNotNull(), F.struct(F.col("_start").alias("start"), last.alias("line"))), ignorenulls=True)
    earlier = of_file.rowsBetween(Window.unboundedPreceding, -1)
    entries = splits.select(*split, "_begin", opened.over(earlier).alias("_open"))
    begun = F.when(F.col("_begin") == 0, F.col("_before.out")).otherwise(F.col("_before.inside"))
    placed = stepped.join(entries, split).withColumns({
        "_was": F.coalesce(begun, F.col("_begin")),
        "_is": F.when(F.col("_begin") == 0, F.col("_upto.out")).otherwise(F.col("_upto.inside")),
    })
    own = F.last(F.when(F.col("_was") == 0, F.struct(F.col("_start").alias("start"), F.col("_line").alias("line"))), ignorenulls=True)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("_record", F.coalesce(own.over(upto), F.col("_open")))
    single = placed.filter("_was = 0 AND _is = 0 AND NOT _head").select("_file", "_record", "value")
    parts = F.array_sort(F.collect_list(F.struct("_start", "_line", "value")))
    several = placed.filter("_was = 1 OR _is = 1").groupBy("_file", "_record").agg(
        F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("value"), F.bool_or("_head").alias("_head")
    ).filter("NOT _head").drop("_head")
    whole = single.unionByName(several).filter(F.btrim("value") != "")
    return whole.select("_file", F.col("_record.start").alias("_start"), F.col("_record.line").alias("_line"), F.regexp_replace("value", r"\r$", "").alias("value"))


def read_offers_csv(spark: SparkSession, folders: Sequence[str], multi_line: bool | None = None) -> list[DataFrame]:
    """One typed DataFrame per distinct header found in the folders' CSV files.

    Files sharing a header are read together, and large ones are split, also where quoted
    cells hold line breaks (``multi_line`` true, or found by a scan when it is None). Every frame
    gets ``row_id``, a struct that sorts by file, place of the split and line, and
    ``misfit_row``: the raw record where a row has more or fewer cells than the header (its
    cells are read as far as they go), null elsewhere. A file that can't be read is an error.
    """
    files = [f for folder in folders for f in csv_files(spark, folder)]
    by_header: dict[tuple[str, ...], list[str]] = {}
    for path in files:
        header = tuple(_reader(spark, False).csv(path).columns)
        if header:
            by_header.setdefault(header, []).append(path)
    numbers = spark.createDataFrame(list(enumerate(files)) or [], "_file_no int, _file string")
    frames = []
    for header, paths in by_header.items():
        names = ["`" + c.replace("`", "``") + "`" for c in (*header, MISFIT)]
        schema = ", ".join(f"{c} string" for c in names)
        broken = has_line_breaks_in_cells(spark, paths) if multi_line is None else multi_line
        if broken:
            cells = F.from_csv("value", schema, {"sep": SEPARATOR, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": MISFIT})
            # Stored, as the types of the columns are found by a pass of its own over all records.
            keyed = stored(records(spark, paths).withColumn("_cells", cells).select(*[F.col(f"_cells.{c}") for c in names], "_file", "_start", "_line"))
        else:
            # A task may read several splits, each in one go: inside a split its line count only rises.
            keyed = _reader(spark, False).schema(schema).csv(paths).select(
                *[F.col(c) for c in names],
                F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/").alias("_file"),
                F.col("_metadata.file_block_start").alias("_start"),
                F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)).alias("_line"),
            )
        order = F.struct(F.col("_file_no").alias("file"), F.col("_start").alias("start"), F.col("_line").alias("line"))
        ordered = keyed.join(F.broadcast(numbers) if len(files) <= LISTED else numbers, "_file", "left").withColumn(ROW_ORDER, order)
        frames.append(infer_numbers(with_nulls(ordered.drop("_file", "_file_no", "_start", "_line"))))
    return frames


def with_nulls(df: DataFrame) -> DataFrame:
    return df.withColumns({
        c: F.when(~F.col(f"`{c}`").isin(list(NULL_MARKERS)), F.col(f"`{c}`")) for c in text_columns(df) if c != MISFIT
    })


def infer_numbers(df: DataFrame) -> DataFrame:
    """Text columns that hold only numbers become bigint or double: one pass for all."""
    texts = [c for c in text_columns(df) if c != MISFIT]
    if not texts:
        return df
    row = df.agg(*[
        e
        for i, c in enumerate(texts)
        for e in (
            F.count(f"`{c}`").alias(f"n{i}"),
            F.count_if(F.col(f"`{c}`").rlike(INTEGER_PATTERN)).alias(f"i{i}"),
            F.count_if(F.col(f"`{c}`").rlike(FLOAT_PATTERN)).alias(f"f{i}"),
            F.count("*").alias(f"all{i}"),
        )
    ]).first()
    casts = {}
    for i, c in enumerate(texts):
        if row[f"n{i}"] == row[f"i{i}"] == row[f"all{i}"] and row[f"n{i}"]:
            casts[c] = F.trim(F.col(f"`{c}`")).try_cast("bigint")
        elif row[f"n{i}"] == row[f"f{i}"]:
            casts[c] = F.trim(F.col(f"`{c}`")).try_cast("double")
    return df.withColumns(casts)


def read_all_offers(spark: SparkSession, folders: Sequence[str], multi_line: bool | None = None) -> DataFrame:
    return union_by_name(read_offers_csv(spark, folders, multi_line))
