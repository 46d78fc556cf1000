"""Column names of the public tender files and their names in this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlens.config import LOST, OTHER, WON
from tenderlens.functions.scalars import is_sentinel, parse_number

# Headers of the published CSV files -> names used here.
COLUMN_NAMES = {
    "NroLicitacion": "tender_id",
    "NombreLicitacion": "tender_name",
    "TipoLicitacion": "tender_type",
    "Descripcion": "description",
    "MonedaLicitacion": "currency",
    "MontoEstimadoLicitacion": "estimate",
    "MontoEstimadoVisible": "estimate_visible",
    "BaseEstimacionMontoLicitacion": "estimate_basis",
    "FuenteFinanciamiento": "funding",
    "JustificacionMontoEstimado": "justification",
    "FechaPublicacion": "published_at",
    "FechaInicioPreguntas": "questions_start",
    "FechaFinalPreguntas": "questions_end",
    "FechaPublicacionRespuestas": "answers_at",
    "FechaActoAperturaTecnica": "technical_opening_at",
    "FechaActoAperturaEconomica": "economic_opening_at",
    "FechaCierre": "closed_at",
    "FechaAdjudicacion": "awarded_at",
    "UnidadTiempoEvaluacion": "evaluation_time_unit",
    "EstadoLicitacion": "status",
    "ContemplaObrasPublicas": "public_works",
    "LicitacionInformada": "informed",
    "TipoConvocatoria": "call_type",
    "NroEtapasLicitacion": "n_stages",
    "SubContratacion": "subcontracting",
    "ProhibicionSubContratacion": "subcontracting_ban",
    "TomaRazonContraloria": "comptroller_review",
    "PublicidadOfertasTecnicas": "technical_offers_public",
    "Contrato": "contract",
    "TiempoDuracionContrato": "contract_length",
    "UnidadTiempoDuracionContrato": "contract_length_unit",
    "ValorTiempoRenovacion": "renewal_time",
    "TipoPago": "payment_type",
    "ObservacionContrato": "contract_note",
    "ExtensionPlazo": "extension",
    "UnidadCompra": "buyer_name",
    "UnidadCompraRUT": "buyer_id",
    "entCode": "entity_code",
    "Institucion": "institution",
    "Sector": "sector",
    "RubroN1": "category_1",
    "RubroN2": "category_2",
    "NombreItem": "item_name",
    "DescripcionItem": "item_text",
    "UnidadMedida": "unit",
    "CantidadItem": "item_qty",
    "ProveedorRUT": "supplier_id",
    "Proveedor": "supplier_name",
    "TamanoProveedor": "supplier_size",
    "ActividadProveedor": "supplier_activity",
    "ResultadoOferta": "outcome",
    "MontoTotalOferta": "offer_total",
    "MontoNetoOferta": "offer_net",
    "EspecificacionesProveedor": "offer_text",
}

# Outcome labels of the files.
OUTCOME_WON = "Ganadora"
OUTCOME_LOST = "Perdedora"
VISIBLE = "Si"

# Columns the scoring operators read, with their types; absent ones become null.
REQUIRED = {
    "tender_id": "string", "supplier_id": "string", "supplier_name": "string", "supplier_size": "string",
    "supplier_activity": "string", "outcome": "string", "offer_total": "double", "item_name": "string",
    "item_qty": "double", "item_text": "string", "offer_text": "string", "buyer_id": "string",
    "institution": "string", "estimate": "double", "estimate_visible": "string", "justification": "string",
    "published_at": "string", "closed_at": "string", "awarded_at": "string", "status": "string",
}


# Columns of the files that hold a point in time.
DATE_COLUMNS = tuple(ours for theirs, ours in COLUMN_NAMES.items() if theirs.startswith("Fecha"))


def _renamed(clean: DataFrame) -> DataFrame:
    return clean.withColumnsRenamed({c: COLUMN_NAMES[c] for c in clean.columns if c in COLUMN_NAMES})


def _typed(df: DataFrame, column: str, kind: str) -> Column:
    """Numbers may come as text with a decimal comma, whatever the rest of their column holds."""
    if column not in df.columns:
        return F.lit(None).cast(kind)
    if kind == "double" and df.schema[column].dataType.simpleString() == "string":
        return parse_number(F.col(column))
    return F.col(column).cast(kind)


def unreadable_numbers(clean: DataFrame) -> DataFrame:
    """One row: per number column that is text, the values that are no number and no placeholder.

    ``to_offer_lines`` makes them null; jobs log these counts.
    """
    df = _renamed(clean)
    texts = [c for c, k in REQUIRED.items() if k == "double" and c in df.columns and df.schema[c].dataType.simpleString() == "string"]
    bad = {c: F.count_if(~is_sentinel(F.col(c)) & parse_number(F.col(c)).isNull()) for c in texts}
    return df.agg(F.count("*").alias("n_rows"), *[n.alias(c) for c, n in bad.items()])


def to_offer_lines(clean: DataFrame) -> DataFrame:
    """Rename a cleaned file table, normalise outcomes and visibility, add absent columns.

    A number column that stayed text is read value by value, so one bad cell costs itself
    only; ``unreadable_numbers`` counts such cells.

    The estimate counts as visible for the literal label or for any amount in the
    visibility column, which is how the tender feed reports it.
    """
    df = _renamed(clean)
    df = df.withColumns({c: _typed(df, c, t) for c, t in REQUIRED.items()})
    visible = F.col("estimate_visible")
    return df.withColumns({
        "outcome": F.when(F.col("outcome") == OUTCOME_WON, WON)
        .when(F.col("outcome") == OUTCOME_LOST, LOST)
        .when(F.col("outcome").isNotNull(), OTHER),
        "estimate_visible": F.when(visible.try_cast("double") > 0, F.lit(VISIBLE)).otherwise(visible),
    })
