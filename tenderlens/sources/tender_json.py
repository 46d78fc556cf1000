"""Reader and flattener of landed tender JSON: detail payloads and active listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderlens.session import by_shuffle
from tenderlens.sources.columns import COLUMN_NAMES

SECTOR_KEYWORD = "MUNICIPALIDAD"
SECTOR_LABEL = "Municipalidades"

# Column of the flat row -> field of the payload.
TOP_FIELDS = {
    "NroLicitacion": "CodigoExterno",
    "NombreLicitacion": "Nombre",
    "TipoLicitacion": "Tipo",
    "Descripcion": "Descripcion",
    "MonedaLicitacion": "Moneda",
    "MontoEstimadoLicitacion": "MontoEstimado",
    "BaseEstimacionMontoLicitacion": "Estimacion",
    "FuenteFinanciamiento": "FuenteFinanciamiento",
    "JustificacionMontoEstimado": "JustificacionMontoEstimado",
    "UnidadTiempoEvaluacion": "UnidadTiempoEvaluacion",
    "EstadoLicitacion": "Estado",
    "ContemplaObrasPublicas": "Obras",
    "LicitacionInformada": "Informada",
    "TipoConvocatoria": "TipoConvocatoria",
    "NroEtapasLicitacion": "Etapas",
    "SubContratacion": "SubContratacion",
    "ProhibicionSubContratacion": "ProhibicionContratacion",
    "TomaRazonContraloria": "TomaRazon",
    "PublicidadOfertasTecnicas": "EstadoPublicidadOfertas",
    "Contrato": "Contrato",
    "TiempoDuracionContrato": "TiempoDuracionContrato",
    "UnidadTiempoDuracionContrato": "UnidadTiempoDuracionContrato",
    "ValorTiempoRenovacion": "ValorTiempoRenovacion",
    "TipoPago": "TipoPago",
    "ObservacionContrato": "ObservacionContract",
    "ExtensionPlazo": "ExtensionPlazo",
}
DATE_FIELDS = {
    "FechaPublicacion": "FechaPublicacion",
    "FechaInicioPreguntas": "FechaInicio",
    "FechaFinalPreguntas": "FechaFinal",
    "FechaPublicacionRespuestas": "FechaPubRespuestas",
    "FechaActoAperturaTecnica": "FechaActoAperturaTecnica",
    "FechaActoAperturaEconomica": "FechaActoAperturaEconomica",
    "FechaCierre": "FechaCierre",
    "FechaAdjudicacion": "FechaAdjudicacion",
}
BUYER_FIELDS = {
    "UnidadCompra": "NombreUnidad",
    "UnidadCompraRUT": "RutUnidad",
    "entCode": "CodigoOrganismo",
    "Institucion": "NombreOrganismo",
}
ITEM_FIELDS = {
    "NombreItem": "NombreProducto",
    "DescripcionItem": "Descripcion",
    "UnidadMedida": "UnidadMedida",
    "CantidadItem": "Cantidad",
}


def _strings(names, **typed: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, typed.get(n, T.StringType())) for n in names])


DETAIL_SCHEMA = T.StructType(
    _strings(TOP_FIELDS.values(), MontoEstimado=T.DoubleType()).fields
    + [
        T.StructField("VisibilidadMonto", T.IntegerType()),
        T.StructField("Comprador", _strings(BUYER_FIELDS.values())),
        T.StructField("Fechas", _strings(DATE_FIELDS.values())),
        T.StructField("Items", T.StructType([
            T.StructField("Listado", T.ArrayType(_strings(ITEM_FIELDS.values(), Cantidad=T.DoubleType())))
        ])),
    ]
)
DETAIL_FILE_SCHEMA = T.StructType([
    T.StructField("Listado", T.ArrayType(DETAIL_SCHEMA)),
    T.StructField("_corrupt_record", T.StringType()),
])
LISTING_FILE_SCHEMA = T.StructType([
    T.StructField("Listado", T.ArrayType(T.StructType([
        T.StructField("CodigoExterno", T.StringType()), T.StructField("CodigoEstado", T.IntegerType()),
    ])))
])


def parse_details(df: DataFrame, json_column: str) -> DataFrame:
    """Detail payload text to a ``detail`` struct column."""
    return df.withColumn("detail", F.from_json(F.col(json_column), DETAIL_SCHEMA))


def read_tender_details(
    spark: SparkSession, path: str, code_from_file: bool = True, codes: DataFrame | None = None
) -> DataFrame:
    """Landed detail responses: code, first listed detail (null when none), failed flag.

    One JSON object per file, named after its code; a file that does not parse is failed.
    Without ``code_from_file`` an object per line, its code in the payload. With ``codes`` (a
    column ``code``) only theirs are kept, by a join.
    """
    raw = spark.read.schema(DETAIL_FILE_SCHEMA).option("multiLine", code_from_file).option(
        "columnNameOfCorruptRecord", "_corrupt_record"
    ).json(path, pathGlobFilter="*.json")
    detail = F.get("Listado", F.lit(0))
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    code = name if code_from_file else detail["CodigoExterno"]
    found = raw.select(
        code.alias("code"), detail.alias("detail"), F.col("_corrupt_record").isNotNull().alias("failed"), code.alias("_named")
    )
    if codes is not None:
        found = found.join(by_shuffle(codes.select(F.col("code").alias("_named"))), "_named", "left_semi")
    return found.drop("_named")


def listing_codes(listing: DataFrame) -> DataFrame:
    """(code, state) rows of listing payloads. Entries without a code are dropped; of a
    code listed twice the later entry wins: the larger _order, then array position."""
    order = F.col("_order") if "_order" in listing.columns else F.lit(0)
    entries = listing.select(order.alias("_order"), F.posexplode("Listado").alias("_pos", "entry")).select(
        "_order", "_pos", F.col("entry.CodigoExterno").alias("code"), F.col("entry.CodigoEstado").alias("state")
    )
    named = entries.filter(F.coalesce("code", F.lit("")) != "")
    return latest_per_key(named, "code", ["_order", "_pos"]).select("code", "state")


def read_active_listing(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(LISTING_FILE_SCHEMA).option("multiLine", True).json(path)
    return listing_codes(raw.withColumn("_order", F.col("_metadata.file_name")))


def latest_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` per key, as one mergeable aggregation."""
    rest = [c for c in df.columns if c != key]
    latest = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return latest.select(key, *[F.col("_row")[c].alias(c) for c in rest])


def in_sector(organisation: Column, keyword: str = SECTOR_KEYWORD) -> Column:
    return F.upper(F.coalesce(organisation, F.lit(""))).contains(keyword)


def flatten_details(details: DataFrame, column: str = "detail", renamed: bool = True) -> DataFrame:
    """One flat row of 44 columns per detail; only the first item is kept. A missing
    nested object leaves its columns null. ``renamed`` gives this package's names."""
    d = F.col(column)
    item = F.get(d["Items"]["Listado"], F.lit(0))
    visible = F.when(d["VisibilidadMonto"] == 1, d["MontoEstimado"])
    columns = {c: d[f] for c, f in TOP_FIELDS.items()}
    columns |= {"MontoEstimadoVisible": visible, "Sector": F.lit(SECTOR_LABEL)}
    columns |= {c: d["Fechas"][f] for c, f in DATE_FIELDS.items()}
    columns |= {c: d["Comprador"][f] for c, f in BUYER_FIELDS.items()}
    columns |= {c: item[f] for c, f in ITEM_FIELDS.items()}
    return details.select(*[e.alias(COLUMN_NAMES[c] if renamed else c) for c, e in columns.items()])


def detail_items(details: DataFrame, column: str = "detail") -> DataFrame:
    """One row per listed item with its number from 1; a detail without items is one row without one."""
    rows = details.select(
        F.col(column)["CodigoExterno"].alias("tender_id"), F.posexplode_outer(F.col(column)["Items"]["Listado"]).alias("_pos", "_item")
    )
    return rows.select(
        "tender_id", F.col("_item").isNotNull().alias("has_item"), (F.coalesce("_pos", F.lit(0)) + 1).cast("long").alias("item_no"),
        *[F.col("_item")[f].alias(COLUMN_NAMES[c]) for c, f in ITEM_FIELDS.items()],
    )
