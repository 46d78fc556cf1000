"""The driver tables seen as offer lines, text pairs, payloads and code states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tenderlens.config import (
    LOST,
    NO_TEXT,
    OTHER,
    WON,
    FlagRules,
    ForestSettings,
    ScoringSettings,
)
from tenderlens.operators.score import combine_scores
from tenderlens.plans.score_job import tender_features
from tenderlens.operators.rules import rule_score
from tenderlens.session import spread, stored
from tenderlens.sources.tender_json import DATE_FIELDS, TOP_FIELDS

# Prices here are small and the years earlier, so two cut-offs move with them.
SETTINGS = ScoringSettings(flags=FlagRules(round_step=10.0), forest=ForestSettings(cut_year=1999))
ROW_ORDER = ["line_no", "supplier_id", "item_name", "offer_total"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def outcome_of(flag: str):
    f = F.col(flag)
    return F.when(f == "A", WON).when(f == "R", LOST).when(f.isNotNull(), OTHER)


def offer_lines(spark: SparkSession, sf: str, buyer: str = "nation", with_text: bool = False) -> DataFrame:
    """Orders with their lines as tenders with offers; an order without lines stays as one
    line without a supplier. ``buyer`` is the customer's nation or the customer."""
    of_order = Window.partitionBy("l_orderkey")
    suppliers = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_nationkey", "s_acctbal"
    )
    # Suppliers and parts meet the lines before these are shuffled by order, so that what a tender is made of lies in one
    # task from there on. A line without an order key is no order's.
    lines = table(spark, sf, "lineitem").filter("l_orderkey IS NOT NULL")
    rows = lines.count()
    lines = lines.join(suppliers, "l_suppkey", "left")
    if with_text:
        parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type", "p_brand")
        lines = lines.join(parts, "l_partkey", "left")
    # With suppliers or parts listed twice a line comes twice, which changes neither date.
    lines = spread(lines, rows, "l_orderkey").withColumns({
        "closed_at": F.min("l_shipdate").over(of_order), "awarded_at": F.max("l_shipdate").over(of_order)
    })
    customers = table(spark, sf, "customer").join(
        table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select("c_custkey", "c_name", "c_nationkey", "n_name")
    by_nation = buyer == "nation"
    priority = F.col("o_orderpriority")
    orders = table(spark, sf, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    joined = spread(orders, rows, "o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    columns = [
        F.col("o_orderkey").alias("tender_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_suppkey").alias("supplier_id"),
        F.col("s_name").alias("supplier_name"),
        F.when(F.col("s_acctbal") > 5000, "Grande").when(F.col("s_acctbal").isNotNull(), "MiPyme").alias("supplier_size"),
        F.concat(F.lit("sector "), F.col("s_nationkey")).alias("supplier_activity"),
        outcome_of("l_returnflag").alias("outcome"),
        F.floor(F.col("l_extendedprice") + 0.5).cast("double").alias("offer_total"),
        F.col("l_partkey").cast("string").alias("item_name"),
        F.col("l_quantity").alias("item_qty"),
        (F.col("c_nationkey").cast("long") if by_nation else F.col("o_custkey")).alias("buyer_id"),
        (F.col("n_name") if by_nation else F.col("c_name")).alias("institution"),
        F.col("o_totalprice").alias("estimate"),
        F.when(priority == "5-LOW", "No").otherwise("Si").alias("estimate_visible"),
        F.when(priority == "4-NOT SPECIFIED", NO_TEXT).otherwise(priority).alias("justification"),
        F.col("o_orderdate").alias("published_at"),
        "closed_at",
        "awarded_at",
        F.when(F.col("o_orderstatus") == "O", "Publicada").otherwise("Adjudicada").alias("status"),
    ]
    if with_text:
        columns += [
            F.col("p_name").alias("item_text"),
            F.when(F.col("l_returnflag") == "A", F.concat_ws(" ", "p_name", "p_brand"))
            .otherwise(F.concat_ws(" ", "p_type", "p_brand")).alias("offer_text"),
        ]
    return joined.select(*columns)


def features(spark: SparkSession, sf: str, buyer: str = "nation") -> DataFrame:
    return tender_features(offer_lines(spark, sf, buyer), ROW_ORDER, SETTINGS)


def region_communities(spark: SparkSession, sf: str) -> DataFrame:
    """A fixed assignment of buyers to communities: the region of the nation."""
    return table(spark, sf, "nation").select(
        F.concat(F.lit("I:"), F.col("n_nationkey")).alias("id"), F.col("n_regionkey").alias("community")
    )


_STORED: dict[tuple[str, str], DataFrame] = {}


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """The stored scored table that the read queries read: rules only, so plain SQL can
    repeat it. Built once per session and folder."""
    slot = (spark.sparkContext.applicationId, sf)
    if slot not in _STORED:
        ruled = stored(rule_score(features(spark, sf), SETTINGS.weights))
        regions = table(spark, sf, "nation").select(
            F.col("n_nationkey").cast("long").alias("buyer_id"), F.col("n_regionkey").alias("community_id")
        )
        placed = ruled.withColumn("anomaly", F.lit(None).cast("double")).join(F.broadcast(regions), "buyer_id", "left")
        _STORED[slot] = stored(combine_scores(placed, SETTINGS.rules_share, SETTINGS.forest_share))
    return _STORED[slot]


def text_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Each document asks, the next one answers.

    Runs of 64 ids lie together, and the first document of a run also comes to the run before it, so a text is
    shuffled once instead of once as question and once as answer. Documents without an id have no answer.
    """
    doc = F.col("doc_id")
    own = F.shiftright(doc, 6)
    docs = table(spark, sf, "documents").select("doc_id", "text").withColumn(
        "run", F.explode(F.when(doc % 64 == 0, F.array(own, own - 1)).otherwise(F.array(F.coalesce(own, F.xxhash64("text")))))
    )
    after = Window.partitionBy("run").orderBy("doc_id").rangeBetween(1, 1)
    answered = docs.withColumn("answers", F.when(doc.isNotNull(), F.collect_list(F.struct(F.col("text").alias("offer_text"))).over(after)))
    asked = answered.filter(doc.isNull() | (own == F.col("run")))
    kind = doc % 3
    return asked.withColumn("answer", F.explode_outer("answers")).select(
        F.floor(doc / 4).alias("tender_id"),
        F.when(kind == 0, WON).when(kind == 1, LOST).otherwise(OTHER).alias("outcome"),
        "doc_id",
        F.col("text").alias("item_text"),
        "answer.offer_text",
    )


def raw_frames(spark: SparkSession, sf: str) -> list[DataFrame]:
    """Two raw inputs in file headers: all lines with gaps, and the first lines again."""
    gap = F.col("l_linenumber") % 7 == 0
    price = F.when(F.col("l_quantity") == 50, 0.0).otherwise(F.col("l_extendedprice"))
    lines = table(spark, sf, "lineitem")
    full = lines.select(
        F.concat(F.lit("T-"), "l_orderkey").alias("NroLicitacion"),
        F.when(~gap, F.concat(F.lit("S-"), "l_suppkey")).alias("ProveedorRUT"),
        F.when(~gap, F.col("l_quantity")).alias("CantidadItem"),
        F.when(~gap, F.replace(price.cast("string"), F.lit("."), F.lit(","))).alias("MontoTotalOferta"),
        F.col("l_tax").alias("MontoNetoOferta"),
        F.when(F.col("l_partkey") % 11 != 0, F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")).alias("FechaCierre"),
        F.col("l_returnflag").alias("ResultadoOferta"),
        F.when(F.col("l_partkey") % 25 == 0, "nota").alias("Observacion"),
        "l_linenumber",
    )
    again = full.filter(F.col("l_linenumber") == 1).drop("Observacion")
    return [full.drop("l_linenumber"), again.drop("l_linenumber")]


def code_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as sightings of a code in a state."""
    return table(spark, sf, "events").select(
        F.concat_ws("|", "user_id", "event_type").alias("code"),
        (F.floor("value") % 5).cast("int").alias("state"),
        "ts",
        "event_id",
    )


# Payload fields that hold their own name and a number, null for one order in thirteen; and the dates, a day apart.
PLAIN_FIELDS = [f for f in TOP_FIELDS.values() if f not in ("CodigoExterno", "Estado", "MontoEstimado")]
DATES = list(DATE_FIELDS.values())


def detail_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Each order as the JSON text of a tender detail, with every field of the flat row and all its lines in order."""
    item = F.struct(
        F.concat(F.lit("part "), "l_partkey").alias("NombreProducto"),
        F.col("l_returnflag").alias("Descripcion"),
        F.col("l_linestatus").alias("UnidadMedida"),
        F.col("l_quantity").alias("Cantidad"),
    )
    # The lines of one order, some seven.
    lines = table(spark, sf, "lineitem").filter("l_orderkey IS NOT NULL")
    rows = lines.count()
    lines = spread(lines, rows, "l_orderkey").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", item.alias("item")))).alias("lines")
    )
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    joined = (
        spread(orders, rows, "o_orderkey")
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    )
    key = F.col("o_orderkey")
    plain = [F.when(key % 13 != i % 13, F.concat(F.lit(f"{f} "), key % 1000)).alias(f) for i, f in enumerate(PLAIN_FIELDS)]
    days = [
        F.when(key % 11 != i, F.date_format(F.col("o_orderdate") + F.expr(f"INTERVAL {i} DAYS"), "yyyy-MM-dd'T'HH:mm:ss")).alias(f)
        for i, f in enumerate(DATES)
    ]
    payload = F.struct(
        F.concat(F.lit("O-"), key).alias("CodigoExterno"),
        F.col("o_orderstatus").alias("Estado"),
        F.col("o_totalprice").alias("MontoEstimado"),
        *plain,
        F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_orderpriority") != "5-LOW", 0).alias("VisibilidadMonto"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.struct(
            F.concat(F.lit("Municipalidad de "), "c_mktsegment").alias("NombreOrganismo"),
            F.col("c_name").alias("NombreUnidad"),
            F.col("c_custkey").cast("string").alias("RutUnidad"),
            F.col("c_nationkey").cast("string").alias("CodigoOrganismo"),
        )).alias("Comprador"),
        F.struct(*days).alias("Fechas"),
        F.struct(F.coalesce(F.col("lines.item"), F.array()).alias("Listado")).alias("Items"),
    )
    return joined.select(F.to_json(payload).alias("payload"))
