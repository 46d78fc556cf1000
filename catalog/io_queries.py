"""Queries that write driver tables through the sources and sinks and read them back, and
queries with one right answer for the iterative operators; each with its SQL."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import bindings as b
from catalog.oracles import ORACLES as OF_CATALOG
from catalog.oracles import up, with_ctes
from catalog.queries import PAGE, rounded
from tenderlens.config import BASE_FEATURES
from tenderlens.operators import embeddings, forest, graph, history, tenders
from tenderlens.functions.text import text_hash
from tenderlens.session import ensure_checkpoint_dir, stored
from tenderlens.sources import indexes, offers_csv, segments, tables, tender_json
from tenderlens.sources.columns import to_offer_lines, unreadable_numbers
from tenderlens.streaming import latest, sync

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4()}"


def _comma(amount: str) -> F.Column:
    return F.replace(F.col(amount).cast("string"), F.lit("."), F.lit(","))


def _as_csv(df: DataFrame, name: str) -> str:
    path = folder(df.sparkSession, name)
    df.write.option("sep", ";").option("escape", '"').option("encoding", "ISO-8859-1").option("header", True).csv(path)
    return path


# --- files ---------------------------------------------------------------------------------


@query("""
SELECT 'T-' || l_orderkey AS tender_id, count(*) AS n_lines, min(l_linenumber)::bigint AS first_line,
  max(l_linenumber)::bigint AS last_line, sum(l_quantity)::double AS quantity, 'Ñandú "x"' AS item_text
FROM lineitem GROUP BY l_orderkey
""")
def csv_round_trip(spark, sf):
    """All lines as ';' Latin-1 files, read back; first and last line of a tender by row_id."""
    lines = b.table(spark, sf, "lineitem").orderBy("l_orderkey", "l_linenumber").select(
        F.concat(F.lit("T-"), "l_orderkey").alias("NroLicitacion"), F.col("l_linenumber").alias("linea"),
        F.col("l_quantity").cast("double").alias("CantidadItem"), F.lit('Ñandú "x"').alias("DescripcionItem"),
    )
    read = offers_csv.read_all_offers(spark, [_as_csv(lines, "csv")]).filter("misfit_row IS NULL")
    return read.groupBy(F.col("NroLicitacion").alias("tender_id")).agg(
        F.count("*").alias("n_lines"), F.min_by("linea", "row_id").alias("first_line"), F.max_by("linea", "row_id").alias("last_line"),
        F.sum(F.col("CantidadItem").cast("double")).alias("quantity"), F.first("DescripcionItem").alias("item_text"),
    )


@query("""
SELECT 'T-' || l_orderkey AS tender_id, l_linenumber::bigint AS line_no, l_suppkey AS supplier_id, l_extendedprice::double AS amount,
  CASE l_linenumber % 4 WHEN 0 THEN 'plain' WHEN 1 THEN 'two' || chr(10) || 'lines; "quoted"' WHEN 2 THEN '"' || chr(10) || chr(10) || ';' ELSE '5" pipe' END AS item_text
FROM lineitem
""")
def csv_line_breaks(spark, sf):
    """All lines as files whose cells hold line breaks, quotes and separators; splits are read side by side."""
    kind = F.col("l_linenumber") % 4
    text = F.when(kind == 0, "plain").when(kind == 1, 'two\nlines; "quoted"').when(kind == 2, '"\n\n;').otherwise('5" pipe')
    lines = b.table(spark, sf, "lineitem").select(
        F.concat(F.lit("T-"), "l_orderkey").alias("NroLicitacion"), F.col("l_linenumber").alias("linea"), F.col("l_suppkey").alias("prov"),
        text.alias("DescripcionItem"), F.col("l_extendedprice").alias("monto"),
    )
    read = offers_csv.read_all_offers(spark, [_as_csv(lines, "csv")]).filter("misfit_row IS NULL")
    return read.select(
        F.col("NroLicitacion").alias("tender_id"), F.col("linea").alias("line_no"), F.col("prov").alias("supplier_id"),
        F.col("monto").cast("double").alias("amount"), F.col("DescripcionItem").alias("item_text"),
    )


@query("""
SELECT count(*) AS n_rows, count(*) FILTER (WHERE bad) AS unreadable, count(*) FILTER (WHERE NOT bad) AS amounts,
  round(sum(l_extendedprice) FILTER (WHERE NOT bad), 1) AS total
FROM (SELECT *, l_linenumber = 7 AND l_orderkey % 5 = 0 AS bad FROM lineitem)
""")
def ingest_counts(spark, sf):
    """Decimal-comma amounts with some bad cells among all lines: only those are lost, and counted."""
    bad = (F.col("l_linenumber") == 7) & (F.col("l_orderkey") % 5 == 0)
    lines = b.table(spark, sf, "lineitem").select(
        F.concat(F.lit("T-"), "l_orderkey").alias("NroLicitacion"), F.when(bad, "n/d").otherwise(_comma("l_extendedprice")).alias("MontoTotalOferta")
    )
    read = offers_csv.read_all_offers(spark, [_as_csv(lines, "csv")])
    offers = to_offer_lines(read).agg(F.count("offer_total").alias("amounts"), F.round(F.sum("offer_total"), 1).alias("total"))
    return unreadable_numbers(read).select("n_rows", F.col("offer_total").alias("unreadable")).crossJoin(F.broadcast(offers))


@query("SELECT 'N-' || n_nationkey AS code, n_name AS name, false AS failed FROM nation")
def detail_files(spark, sf):
    """A detail file for each nation, written and read back."""
    detail = F.struct(F.concat(F.lit("N-"), "n_nationkey").alias("CodigoExterno"), F.col("n_name").alias("Nombre"))
    path = folder(spark, "details")
    b.table(spark, sf, "nation").select("n_nationkey", F.array(detail).alias("Listado")).write.partitionBy("n_nationkey").json(path)
    return tender_json.read_tender_details(spark, path, code_from_file=False).select("code", F.col("detail.Nombre").alias("name"), "failed")


# --- tables --------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def snapshot_round_trip(spark, sf):
    """A table replaced by a part of itself: the newest version is what is read."""
    path = folder(spark, "snapshot")
    orders = b.table(spark, sf, "orders")
    tables.write_snapshot(orders.select("o_orderkey", "o_totalprice", "o_orderstatus"), path)
    tables.write_snapshot(tables.read_snapshot(spark, path).filter("o_orderstatus = 'F'").drop("o_orderstatus"), path)
    return tables.read_snapshot(spark, path)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders")
def upsert_typed(spark, sf):
    """Half of the orders come as text with a decimal comma; no value is lost."""
    orders = b.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    raised = orders.filter("o_orderkey % 2 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return tables.upsert_by_key(orders, raised.withColumn("o_totalprice", _comma("o_totalprice")), "o_orderkey")


@query("""
SELECT 1::bigint AS id, 'ok' AS state, (SELECT count(*) FROM orders) AS n_tenders
UNION ALL SELECT 2, 'ok', (SELECT count(*) FROM lineitem) UNION ALL SELECT 3, 'no_data', 0
""")
def run_log(spark, sf):
    path = folder(spark, "log")
    for name in ("orders", "lineitem"):
        tables.append_run_log(spark, path, "scoring", {"state": "ok", "n_tenders": b.table(spark, sf, name).count()})
    tables.append_run_log(spark, path, "scoring", {"state": "no_data", "n_tenders": 0})
    return tables.read_log(spark, path, "scoring").select("id", "state", "n_tenders")


@query("""
SELECT ts::date AS day, count(*) * CASE WHEN ts::date = (SELECT max(ts::date) FROM events) THEN 2 ELSE 1 END AS n_rows,
  (SELECT max(ts::date) FROM events) AS newest
FROM events GROUP BY 1
""")
def daily_sync(spark, sf):
    """Events written by day, the newest day then replaced by itself twice over."""
    path = folder(spark, "days")
    events = b.table(spark, sf, "events").select("event_id", F.to_date("ts").alias("day"))
    tables.write_days(events, path)
    newest = tables.last_synced_day(spark, path)
    last = events.filter(F.col("day") == F.lit(newest))
    for _ in range(2):
        tables.write_days(last.union(last), path)
    return spark.read.parquet(path).groupBy("day").agg(F.count("*").alias("n_rows")).withColumn("newest", F.lit(newest))


@query("SELECT DISTINCT sha256(text) AS text_hash, 'm' AS model, length(text) % 7 AS mark FROM documents")
def embedding_cache(spark, sf):
    """Vectors appended by two overlapping runs, and those of another model: each text once."""
    path = folder(spark, "cache")
    docs = b.table(spark, sf, "documents").select("doc_id", text_hash(F.col("text")).alias("text_hash"), (F.char_length("text") % 7).cast("float").alias("mark"))
    rows = docs.select("doc_id", "text_hash", F.lit("m").alias("model"), F.array("mark").alias("embedding"))
    tables.append_embeddings(rows.filter("doc_id % 3 < 2").drop("doc_id"), path)
    tables.append_embeddings(rows.filter("doc_id % 3 > 0").drop("doc_id"), path)
    tables.append_embeddings(rows.drop("doc_id").withColumn("model", F.lit("other")), path)
    return tables.read_embeddings(spark, path, "m").select("text_hash", "model", F.col("embedding")[0].cast("long").alias("mark"))


@query("""
SELECT 'events_view' AS name, c AS column_name FROM (SELECT unnest(['day', 'n']) AS c) WHERE (SELECT count(*) FROM events) > 0
UNION ALL SELECT 'absent', NULL
""")
def table_probe(spark, sf):
    """Columns of a registered view made from the events, and of a name that isn't there."""
    b.table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).createOrReplaceTempView("events_view")
    rows = [("events_view", c) for c in tables.table_columns(spark, "events_view")]
    rows += [("absent", None)] if not tables.table_exists(spark, "absent_table") and not tables.table_columns(spark, "absent_table") else []
    return spark.createDataFrame(rows, "name string, column_name string")


# --- laid-out tables --------------------------------------------------------------------------


def _ranked(spark: SparkSession, sf: str) -> tuple[str, int]:
    """(path, rows) of what pages show of the scored table, by rank; small chunks, so that these tables have some."""
    path, scored = folder(spark, "ranked"), b.scored(spark, sf).select(*PAGE)
    indexes.write_ranked(scored, path, [F.desc_nulls_last("risk_score"), F.asc("tender_id")], 500)
    return path, scored.count()


@query(with_ctes("""
SELECT tender_id, risk_score, winner_name FROM (
  SELECT *, row_number() OVER (ORDER BY risk_score DESC NULLS LAST, tender_id) - 1 AS place, count(*) OVER () AS n FROM s_scored) r
WHERE place >= n * 9 // 10 AND place < n * 9 // 10 + 100
"""))
def deep_page(spark, sf):
    """A page nine tenths down the ranking, from the one or two files that hold it."""
    path, n = _ranked(spark, sf)
    return indexes.stored_page(spark, path, 100, n * 9 // 10, 500).select("tender_id", "risk_score", "winner_name")


@query("""
SELECT o_orderkey, count(*) AS n, sum(l_quantity)::double AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey
WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY 1
""")
def clustered_lookup(spark, sf):
    """All lines of the last order, from a table in ranges of the key."""
    path, lines = folder(spark, "clustered"), b.table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    lines = lines.join(b.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", "left_semi")
    indexes.write_clustered(lines, path, "o_orderkey", rows_per_key=4)
    stored_lines = spark.read.parquet(path)
    last = stored_lines.agg(F.max("o_orderkey")).first()[0]
    found = stored_lines.filter(F.col("o_orderkey") == last)
    return found.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%er_0%12%'")
def names_by_part(spark, sf):
    """Customers by a part of the name with wildcards, through the runs of three characters of the different names."""
    customers = b.table(spark, sf, "customer").select("c_custkey", "c_name")
    grams = stored(indexes.name_grams(customers, "c_name"))
    return indexes.with_name_like(customers, "c_name", grams, "er_0%12")


# --- sync ----------------------------------------------------------------------------------


@query("SELECT DISTINCT c_custkey::varchar AS code FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'O'")
def active_codes(spark, sf):
    """Customers with an open order as the codes active in a table of many lines each."""
    orders = b.table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "Publicada").otherwise("Cerrada")
    return sync.active_codes(orders.select(F.col("o_custkey").alias("tender_id"), status.alias("status")))


@query("""
SELECT count(*) FILTER (WHERE o_orderstatus <> 'P') AS n_listed, count(*) AS n_queried,
  count(*) FILTER (WHERE o_orderkey % 10 <> 0 AND c_mktsegment <> 'MACHINERY') AS n_upserted,
  count(*) FILTER (WHERE o_orderkey % 10 = 0) AS n_failed, count(*) FILTER (WHERE o_orderkey % 10 <> 0) AS n_processed,
  count(*) FILTER (WHERE o_orderkey % 10 <> 0 AND o_orderstatus = 'P') AS n_gone
FROM orders JOIN customer ON o_custkey = c_custkey
""")
def sync_counts(spark, sf):
    """One sync step: every tenth answer failed, orders in state P are no longer listed."""
    details = tender_json.parse_details(b.detail_payloads(spark, sf), "payload").select(
        F.col("detail.CodigoExterno").alias("code"), "detail",
        (F.regexp_extract(F.col("detail.CodigoExterno"), r"(\d+)$", 1).cast("long") % 10 == 0).alias("failed"), F.col("detail.Estado").alias("status"),
    )
    # Stored, as the step reads it several times and making it is most of the work.
    details = stored(details)
    listing = details.filter("status <> 'P'").select("code", F.lit(5).alias("state"))
    result = sync.sync_batch(listing, details.select("code"), details.drop("status"))
    seen = result.processed.agg(F.count("*").alias("n_processed"), F.count_if(F.col("state") == tables.GONE).alias("n_gone"))
    return result.counts.crossJoin(F.broadcast(seen))


# Three listings of the orders: urgent ones come in state 5 with the first, change to 6 with the second where the order
# is finished, and those in state P are no longer listed by the third. Every tenth has no answer before the last; of these
# one that is no longer listed then was never known.
_SYNC = """
WITH o AS (SELECT o_orderkey, o_orderstatus AS st, o_orderkey % 10 = 0 AS late FROM orders WHERE o_orderpriority = '1-URGENT'), """


@query(_SYNC + """
s AS (SELECT 1 AS id, o_orderkey, late FROM o UNION ALL SELECT 2, o_orderkey, late FROM o WHERE st = 'F' OR late
  UNION ALL SELECT 3, o_orderkey, false FROM o WHERE late <> (st = 'P'))
SELECT id::bigint AS id, 'ok' AS state, 'listing-' || id AS detail, CASE WHEN id = 3 THEN (SELECT count(*) FROM o WHERE st <> 'P') ELSE (SELECT count(*) FROM o) END AS n_listed,
  count(*) AS n_queried, count(*) FILTER (WHERE NOT late) AS n_upserted, 0::bigint AS n_failed FROM s GROUP BY id
""")
def sync_log(spark, sf):
    """Three listings against stored tables, the first delivered twice, with answers landed in files between them."""
    return tables.read_log(spark, _synced(spark, sf).log, "sync").drop("run_at")


@query(_SYNC.rstrip(", ") + """
SELECT 'O-' || o_orderkey AS code, CASE WHEN st = 'P' THEN -1 WHEN st = 'F' THEN 6 ELSE 5 END AS state,
  CASE WHEN st = 'P' OR late THEN 'answer 3' WHEN st = 'F' THEN 'answer 2' ELSE 'answer 1' END AS name FROM o WHERE NOT (late AND st = 'P')
""")
def sync_result(spark, sf):
    """States and updates after the three listings; both are read from segments of several batches."""
    paths = _synced(spark, sf)
    updates = sync.current_offers(spark, paths).select(F.col("tender_id").alias("code"), F.col("tender_name").alias("name"))
    return tables.read_state(spark, paths.state).join(updates, "code", "full")


_SYNCED: dict[tuple[str, str], sync.SyncPaths] = {}


def _synced(spark: SparkSession, sf: str) -> sync.SyncPaths:
    """The tables of the three listings, made once per session and folder."""
    slot = (spark.sparkContext.applicationId, sf)
    if slot in _SYNCED:
        return _SYNCED[slot]
    orders = b.table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(
        F.concat(F.lit("O-"), "o_orderkey").alias("code"), F.col("o_orderstatus").alias("st"), (F.col("o_orderkey") % 10 == 0).alias("late")
    )
    details = folder(spark, "details")

    def land(answered, name: str) -> None:
        """One JSON line for each code, some files for all; the code is in the payload."""
        payload = F.struct(
            F.col("code").alias("CodigoExterno"), F.lit(name).alias("Nombre"), F.lit("Publicada").alias("Estado"), F.struct(F.lit("MUNICIPALIDAD DE X").alias("NombreOrganismo")).alias("Comprador")
        )
        answered.select(F.array(payload).alias("Listado")).write.mode("overwrite").json(details)

    paths = sync.SyncPaths(details, *(folder(spark, n) for n in ("bulk", "updates", "state", "log")), buckets=8)
    five, six = F.lit(5).alias("state"), F.when(F.col("st") == "F", 6).otherwise(5).alias("state")
    steps = (
        ("listing-1", orders.select("code", five), orders.filter("NOT late")), ("listing-1", orders.select("code", five), orders.filter("NOT late")),
        ("listing-2", orders.select("code", six), orders.filter("NOT late")), ("listing-3", orders.filter("st <> 'P'").select("code", six), orders),
    )
    for name, listing, answered in steps:
        land(answered, f"answer {name[-1]}")
        sync.apply_listing(spark, listing, name, paths, code_from_file=False)
    _SYNCED[slot] = paths
    return paths


@query("""
SELECT o_orderkey, CASE WHEN o_orderdate >= TIMESTAMP '2000-01-01' THEN 'new' WHEN o_orderkey % 3 = 0 THEN 'third' ELSE 'old' END AS mark,
  CASE WHEN o_orderdate < TIMESTAMP '2000-01-01' AND o_orderkey % 3 <> 0 THEN o_totalprice END AS amount, true AS merged FROM orders
""")
def segment_upserts(spark, sf):
    """All orders, then two overlapping batches of some, as segments; buckets are merged between and after."""
    path = folder(spark, "segments")
    orders = b.table(spark, sf, "orders")
    segments.append_segment(orders.select("o_orderkey", F.lit("old").alias("mark"), F.col("o_totalprice").alias("amount")), path, "o_orderkey", 16)
    segments.append_segment(orders.filter("o_orderkey % 3 = 0").select("o_orderkey", F.lit("third").alias("mark")), path, "o_orderkey")
    merged = segments.compact(spark, path, "o_orderkey", 1)
    segments.append_segment(orders.filter("o_orderdate >= TIMESTAMP '2000-01-01'").select("o_orderkey", F.lit("new").alias("mark")), path, "o_orderkey")
    return segments.read_segments(spark, path, "o_orderkey").withColumn("merged", F.lit(len(merged) > 0))


@query(with_ctes(OF_CATALOG["latest_per_key"]))
def latest_streamed(spark, sf):
    """All events dealt over files whatever their time, read by a stream in some four batches."""
    path = folder(spark, "latest")
    events = b.code_events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    events.withColumn("_deal", F.pmod(F.hash("event_id"), F.lit(4))).write.partitionBy("_deal").parquet(f"{path}/in")
    files = len(spark.read.parquet(f"{path}/in").inputFiles())
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", -(-files // 4)).parquet(f"{path}/in/*")
    latest.follow(stream, path, "code", ["ts", "event_id"], late="36500 days", span="7 days").awaitTermination()
    return latest.read_latest(spark, path, "code").select("code", "state", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id")


# --- dates, vectors, communities, forest -----------------------------------------------------


@query("""
SELECT o_orderkey, date_trunc('second', o_orderdate) AS published_at, date_trunc('second', o_orderdate) AS questions_start,
  date_trunc('second', o_orderdate) AS answers_at, CASE WHEN o_orderkey % 2 = 0 THEN date_trunc('second', o_orderdate) END AS closed_at
FROM orders
""")
def parse_all_timestamps(spark, sf):
    """Every date column of the files that is there, by default."""
    o = b.table(spark, sf, "orders")
    spaced, joined = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    return tenders.parse_timestamps(o.select(
        "o_orderkey", spaced.alias("published_at"), joined.alias("questions_start"), spaced.alias("answers_at"),
        F.when(F.col("o_orderkey") % 2 == 0, joined).otherwise("pronto").alias("closed_at"),
    ))


LETTERS = "abcdefghijklmnopqrstuvwxyz"


@query(f"""
WITH t AS (SELECT sha256(text) AS text_hash, lower(any_value(text)) AS x, bool_or(lang = 'en') AS known FROM documents GROUP BY 1),
c AS (SELECT text_hash, list_transform(string_split('{",".join(LETTERS)}', ','), lambda l: length(x) - length(replace(x, l, ''))) AS n FROM t WHERE NOT known)
SELECT text_hash, 'm' AS model, list_position(n, list_max(n)) - 1 AS letter FROM c
""")
def embed_missing_known(spark, sf):
    """The texts the cache lacks, encoded by their most frequent letter."""

    def make_encoder():
        def encode(texts):
            lines = pd.Series(texts).str.lower()
            counts = np.stack([lines.str.count(c) for c in LETTERS], axis=1)
            return np.eye(len(LETTERS), dtype=np.float32)[counts.argmax(axis=1)]

        return encode

    docs = b.table(spark, sf, "documents").select("text", "lang", text_hash(F.col("text")).alias("text_hash"))
    known = docs.filter("lang = 'en'").select("text_hash", F.lit("m").alias("model"), F.array(F.lit(1.0).cast("float")).alias("embedding"))
    texts = docs.groupBy("text_hash").agg(F.first("text").alias("text"))
    found = embeddings.embed_missing(texts, known.distinct(), make_encoder, "m")
    letter = F.array_position(F.transform("embedding", lambda v: v > 0.5), True) - 1
    return found.select("text_hash", "model", letter.cast("int").alias("letter"))


@query("""
WITH v AS (SELECT 'I:' || n_nationkey AS id, n_regionkey AS r FROM nation
  WHERE n_regionkey IN (SELECT n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)
  UNION ALL SELECT 'P:' || s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
s AS (SELECT r, (row_number() OVER (ORDER BY count(*) DESC, min(id)) - 1)::int AS community FROM v GROUP BY r)
SELECT id, community FROM v JOIN s USING (r)
""")
def region_communities(spark, sf):
    """Every nation buys from every supplier of its region and no other: communities are the regions."""
    nations = b.table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    home = nations.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("region"))
    suppliers = b.table(spark, sf, "supplier").join(F.broadcast(home), "s_nationkey").select("s_suppkey", "region")
    # Five nations to a region, so the links are five to a supplier.
    edges = suppliers.join(nations, F.col("region") == F.col("n_regionkey")).select(
        F.concat(F.lit("I:"), "n_nationkey").alias("src"), F.concat(F.lit("P:"), "s_suppkey").alias("dst"), F.lit(1.0).alias("weight")
    )
    return graph.communities(stored(edges), b.SETTINGS.graph)


@query(f"""
WITH s AS (SELECT CASE WHEN year(o_orderdate) < 1999 THEN 'train' ELSE 'test' END AS split, o_totalprice AS a FROM orders),
q AS (SELECT quantile_cont(a, 0.95) AS cut FROM s WHERE split = 'train')
SELECT split, count(*) AS n_rows, {up("avg((a > cut)::int) * 100")} AS anomaly_pct FROM s, q GROUP BY split
""")
def anomaly_rate_known(spark, sf):
    """The rate on a known column in place of the score."""
    split = F.when(F.year("o_orderdate") < 1999, "train").otherwise("test")
    scores = b.table(spark, sf, "orders").select(split.alias("split"), F.col("o_totalprice").alias("anomaly"))
    return rounded(forest.anomaly_rate(scores), "anomaly_pct")


@query("""
WITH s AS (SELECT CASE WHEN year(o_orderdate) < 1999 THEN 'train' ELSE 'test' END AS split FROM orders)
SELECT split, count(*) AS n_rows, count(*) AS n_keys, true AS in_range, true AS planted_in_front FROM s GROUP BY split
""")
def isolation_summary(spark, sf):
    """Rows, keys and range of the scores by split, and whether tenders far from all others lead their split."""
    built = stored(b.features(spark, sf).select("tender_id", "published_at", *BASE_FEATURES))
    # The first tender of each side of the cut: one key of the whole table for each of three groups at most.
    key = F.struct(F.col("tender_id").isNotNull().alias("known"), "tender_id")
    firsts = [r[0] for r in built.groupBy(F.year("published_at") < 1999).agg(F.min(key)["tender_id"].alias("first")).select("first").collect()]
    planted = reduce(lambda a, c: a | c, [F.col("tender_id").eqNullSafe(F.lit(k)) for k in firsts], F.lit(False))
    far = built.withColumns({f: F.when(planted, F.lit(1e12)).otherwise(F.col(f).cast("double")) for f in BASE_FEATURES if f in built.columns})
    scores = stored(forest.isolation_scores(far, BASE_FEATURES, b.SETTINGS.forest))
    ranked = scores.filter("tender_id IS NOT NULL").withColumn("planted", planted)
    return ranked.groupBy("split").agg(
        F.count("*").alias("n_rows"), F.count_distinct("tender_id").alias("n_keys"),
        F.bool_and(F.col("anomaly").between(0, 1)).alias("in_range"),
        (F.max(F.when(F.col("planted"), F.col("anomaly"))) >= F.max(F.when(~F.col("planted"), F.col("anomaly")))).alias("planted_in_front"),
    )


# --- history that grows ---------------------------------------------------------------------


@query(with_ctes(OF_CATALOG["prior_concentration"]))
def prior_concentration_added(spark, sf):
    """Closed tenders in one run and open ones, some of them older, in the next, which opens the months it touches only."""
    built = stored(tenders.assemble_tenders(b.offer_lines(spark, sf), b.ROW_ORDER))
    path = folder(spark, "history")
    is_open = F.col("status") == "Publicada"
    history.add_awards(built.filter(~is_open), path)
    history.add_awards(built.filter(is_open), path)
    return rounded(history.stored_concentration(spark, path), "supplier_share", "buyer_share")


@query("""
WITH RECURSIVE e AS (
  SELECT DISTINCT 2 * o_custkey AS a, 2 * l_suppkey + 1 AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey = s_nationkey),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
n AS (SELECT 2 * c_custkey AS v FROM customer UNION ALL SELECT 2 * s_suppkey + 1 FROM supplier),
r AS (SELECT v, v AS root FROM n UNION SELECT l.b, r.root FROM r JOIN l ON r.v = l.a)
SELECT v::bigint AS v, min(root)::bigint AS part FROM r GROUP BY v
""")
def connected_parts(spark, sf):
    """Nations as communities of customers and suppliers, split where trade inside the nation leaves them apart."""
    customers, suppliers = b.table(spark, sf, "customer"), b.table(spark, sf, "supplier")
    member = customers.select((F.col("c_custkey") * 2).cast("long").alias("v"), F.col("c_nationkey").alias("comm")).unionByName(
        suppliers.select((F.col("s_suppkey") * 2 + 1).cast("long").alias("v"), F.col("s_nationkey").alias("comm"))
    )
    trade = b.table(spark, sf, "orders").join(b.table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(
        (F.col("o_custkey") * 2).cast("long").alias("src"), (F.col("l_suppkey") * 2 + 1).cast("long").alias("dst")
    ).distinct()
    links = stored(trade.unionByName(trade.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return graph.connected_parts(links, member).withColumnRenamed("comm", "part")
