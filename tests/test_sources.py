import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from tenderlens.config import CleaningRules
from tenderlens.plans.clean_job import ingest_offers
from tenderlens.plans.score_job import run_scoring
from tenderlens.sources import offers_csv, tables, tender_json
from tenderlens.sources.columns import to_offer_lines

HEADER = "NroLicitacion;ProveedorRUT;ResultadoOferta;MontoTotalOferta;MontoNetoOferta;CantidadItem;EspecificacionesProveedor"


def write_csv(folder, name, *lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes("\n".join(lines).encode("latin-1") + b"\n")


@pytest.fixture()
def folders(tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    write_csv(a, "2.csv", HEADER, 'L-2;S-1;Perdedora;30;27;NA;"dos ""líneas""\ny punto; coma"')
    write_csv(a, "1.csv", HEADER, "L-1;S-1;Ganadora;10;9,5;1;Ñandú", "L-1;S-1;Ganadora;10;9,5;1;Ñandú", "L-1;S-2;Perdedora;12,5;11;2;")
    write_csv(a, "notes.txt", "ignored")
    write_csv(b, "3.csv", "NroLicitacion;Extra;MontoTotalOferta", "L-3;7;5", "L-4;8.5;0")
    return [str(a), str(b)]


def test_csv_reading(spark, folders):
    frames = offers_csv.read_offers_csv(spark, folders)
    assert len(frames) == 2
    rows = offers_csv.read_all_offers(spark, folders).orderBy("row_id").collect()
    assert [r["NroLicitacion"] for r in rows] == ["L-1", "L-1", "L-1", "L-2", "L-3", "L-4"]
    assert rows[0]["EspecificacionesProveedor"] == "Ñandú" and rows[2]["EspecificacionesProveedor"] is None
    assert rows[3]["EspecificacionesProveedor"] == 'dos "líneas"\ny punto; coma' and rows[3]["CantidadItem"] is None
    types = dict(frames[0].dtypes)
    assert (types["MontoTotalOferta"], types["MontoNetoOferta"], types["CantidadItem"]) == ("string", "string", "double")
    assert dict(frames[1].dtypes)["Extra"] == "double" and dict(frames[1].dtypes)["MontoTotalOferta"] == "bigint"


def test_ingest_and_score(spark, folders, tmp_path):
    table, log = str(tmp_path / "clean"), str(tmp_path / "log")
    metrics = ingest_offers(spark, folders, table, log)
    assert (metrics.rows_in, metrics.duplicate_keys) == (6, 2)
    clean = tables.read_snapshot(spark, table)
    assert {"tender_id", "outcome", "offer_total", "buyer_id", "row_id"} <= set(clean.columns)
    assert {r["outcome"] for r in clean.select("outcome").distinct().collect()} == {"won", "lost"}
    entry = tables.read_log(spark, log, "ingestion").first()
    assert (entry["id"], entry["state"], entry["rows_in"], entry["rows_out"]) == (1, "ok", 6, metrics.rows_out)
    assert ingest_offers(spark, [str(tmp_path)], table, log) is None

    scored, runs = str(tmp_path / "scored"), str(tmp_path / "runs")
    summary = run_scoring(spark, clean, ["row_id"], scored, runs)
    assert summary["state"] == "ok" and summary["n_tenders"] == clean.select("tender_id").distinct().count()
    result = tables.read_snapshot(spark, scored)
    assert result.select("tender_id").distinct().count() == result.count()
    assert result.filter(~F.col("risk_score").between(0, 100)).count() == 0
    assert run_scoring(spark, clean.limit(0), ["row_id"], scored, runs)["state"] == "no_data"
    assert [r["state"] for r in tables.read_log(spark, runs, "scoring").orderBy("id").collect()] == ["ok", "no_data"]


def test_offer_lines_normalise_labels(spark):
    df = spark.createDataFrame(
        [("1", "Ganadora", "26000000.0"), ("2", "Perdedora", "Si"), ("3", "Revocada", "No"), ("4", None, None)],
        "NroLicitacion string, ResultadoOferta string, MontoEstimadoVisible string",
    )
    got = {r["tender_id"]: (r["outcome"], r["estimate_visible"]) for r in to_offer_lines(df).collect()}
    assert got == {"1": ("won", "Si"), "2": ("lost", "Si"), "3": ("other", "No"), "4": (None, None)}


DETAIL = {
    "CodigoExterno": "9-1-LE26", "Nombre": "TUBERIA", "Estado": "Publicada", "MontoEstimado": 500.0, "VisibilidadMonto": 1,
    "Comprador": {"NombreOrganismo": "I. Municipalidad de Lota", "RutUnidad": "6-5", "NombreUnidad": "Obras"},
    "Fechas": {"FechaPublicacion": "2026-03-01T10:00:00", "FechaCierre": None},
    "Items": {"Listado": [{"NombreProducto": "tubo", "Cantidad": 4}, {"NombreProducto": "codo"}]},
}


def flat(spark, detail):
    df = spark.createDataFrame([(json.dumps(detail),)], "payload string")
    return tender_json.flatten_details(tender_json.parse_details(df, "payload"), renamed=False)


def test_flatten_detail(spark):
    df = flat(spark, DETAIL)
    assert len(df.columns) == 44 and "NombreInstitucion" not in df.columns
    row = df.first()
    assert (row["NroLicitacion"], row["Institucion"], row["MontoEstimadoVisible"]) == ("9-1-LE26", "I. Municipalidad de Lota", 500.0)
    assert (row["NombreItem"], row["CantidadItem"], row["Sector"]) == ("tubo", 4.0, "Municipalidades")
    assert (row["FechaPublicacion"], row["FechaCierre"]) == ("2026-03-01T10:00:00", None)


@pytest.mark.parametrize("change", [
    {"Items": {"Listado": []}}, {"Items": None}, {"Comprador": None}, {"Fechas": None}, {"VisibilidadMonto": 0}, {"VisibilidadMonto": None},
])
def test_flatten_is_null_safe(spark, change):
    row = flat(spark, DETAIL | change).first()
    assert row["NroLicitacion"] == "9-1-LE26"
    if "VisibilidadMonto" in change:
        assert row["MontoEstimadoVisible"] is None and row["MontoEstimadoLicitacion"] == 500.0
    if "Items" in change:
        assert row["NombreItem"] is None
    if "Comprador" in change:
        assert row["Institucion"] is None


def test_sector(spark):
    df = spark.createDataFrame([("I. Municipalidad de X",), ("Ministerio",), (None,)], "o string")
    assert [r[0] for r in df.select(tender_json.in_sector(F.col("o"))).collect()] == [True, False, False]


def test_detail_files(spark, tmp_path):
    (tmp_path / "A-1.json").write_text(json.dumps({"Listado": [DETAIL]}))
    (tmp_path / "A-2.json").write_text(json.dumps({"Listado": []}))
    (tmp_path / "A-3.json").write_text("{broken")
    got = {r["code"]: (r["detail"] is not None, r["failed"]) for r in tender_json.read_tender_details(spark, str(tmp_path)).collect()}
    assert got == {"A-1": (True, False), "A-2": (False, False), "A-3": (False, True)}


def test_listing_later_entry_wins(spark, tmp_path):
    entries = [{"CodigoExterno": "A", "CodigoEstado": 5}, {"CodigoExterno": "", "CodigoEstado": 5}, {"CodigoEstado": 5},
               {"CodigoExterno": "A", "CodigoEstado": 6}, {"CodigoExterno": "B", "CodigoEstado": 5}]
    (tmp_path / "l.json").write_text(json.dumps({"Listado": entries}))
    got = {r["code"]: r["state"] for r in tender_json.read_active_listing(spark, str(tmp_path / "l.json")).collect()}
    assert got == {"A": 6, "B": 5}


def test_snapshot_may_replace_what_it_reads(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.read_snapshot(spark, path) is None and not tables.snapshot_exists(spark, path)
    tables.write_snapshot(spark.range(3).toDF("n"), path)
    tables.write_snapshot(tables.read_snapshot(spark, path).filter("n > 0"), path)
    assert sorted(r["n"] for r in tables.read_snapshot(spark, path).collect()) == [1, 2]


def test_upsert_matches_columns_by_name(spark):
    target = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "k string, n int, s string")
    batch = spark.createDataFrame([(9.0, "a", "drop"), (8.0, "c", "drop")], "n double, k string, other string")
    got = tables.upsert_by_key(target, batch, "k")
    assert got.columns == ["k", "n", "s"]
    assert {tuple(r) for r in got.collect()} == {("b", 3, "z"), ("a", 9, None), ("c", 8, None)}
    assert tables.upsert_by_key(None, batch, "k").columns == ["n", "k", "other"]


def test_overlay_keeps_bids(spark):
    bulk = spark.createDataFrame([("a", "s1", "old"), ("a", "s2", "old"), ("b", "s1", "old")], "tender_id string, supplier_id string, status string")
    updates = spark.createDataFrame([("a", "new"), ("c", "new")], "tender_id string, status string")
    got = {tuple(r) for r in tables.overlay_offers(bulk, updates).collect()}
    assert got == {("a", "s1", "new"), ("a", "s2", "new"), ("b", "s1", "old"), ("c", None, "new")}


def test_log_ids_count_up(spark, tmp_path):
    path = str(tmp_path / "log")
    assert [tables.append_run_log(spark, path, "sync", {"state": "ok"}) for _ in range(3)] == [1, 2, 3]
    assert tables.read_log(spark, path, "sync").count() == 3


def test_missing_state_is_empty_and_a_damaged_one_an_error(spark, tmp_path):
    assert tables.read_state(spark, str(tmp_path / "none")).count() == 0
    broken = tmp_path / "state" / "v=0"
    broken.mkdir(parents=True)
    (broken / "_SUCCESS").write_text("")
    (broken / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        tables.read_state(spark, str(tmp_path / "state")).count()


def test_upsert_refuses_to_lose_a_value(spark):
    target = spark.createDataFrame([("a", 1.0, 1)], "k string, x double, n int")
    good = spark.createDataFrame([("b", "12,5", "7")], "k string, x string, n string")
    assert {tuple(r) for r in tables.upsert_by_key(target, good, "k").collect()} == {("a", 1.0, 1), ("b", 12.5, 7)}
    bad = spark.createDataFrame([("b", "n/d", "7")], "k string, x string, n string")
    with pytest.raises(Exception, match="column x"):
        tables.upsert_by_key(target, bad, "k").collect()


def test_one_bad_amount_costs_itself_only(spark, tmp_path):
    rows = [f"L-{i};S-1;Ganadora;{i},5;1;1;x" for i in range(1, 100)]
    write_csv(tmp_path / "a", "1.csv", HEADER, *rows, "L-100;S-1;Ganadora;n/d;1;1;x", "L-101;S-1;Ganadora;7;1;1;x;surplus", "L-102;S-2")
    table, log = str(tmp_path / "clean"), str(tmp_path / "log")
    ingest_offers(spark, [str(tmp_path / "a")], table, log)
    clean = tables.read_snapshot(spark, table)
    assert clean.count() == 102 and clean.filter("offer_total IS NULL").count() == 2
    assert clean.filter("tender_id = 'L-7'").first()["offer_total"] == 7.5
    entry = tables.read_log(spark, log, "ingestion").first()
    assert entry["state"] == "with_losses"
    assert json.loads(entry["detail"]) == {"misfit_rows": 2, "unreadable_numbers": {"offer_total": 1}}


def test_rows_of_a_split_file_keep_their_order(spark, tmp_path):
    rows = [f"L-{i};S-1;Ganadora;{i};1;1;x" for i in range(20_000)]
    write_csv(tmp_path / "a", "1.csv", HEADER, *rows)
    write_csv(tmp_path / "a", "2.csv", HEADER, *[f"M-{i};S-1;Ganadora;{i};1;1;x" for i in range(5_000)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40k")
    try:
        df = offers_csv.read_all_offers(spark, [str(tmp_path / "a")])
        assert df.rdd.getNumPartitions() > 5
        got = [r["NroLicitacion"] for r in df.orderBy("row_id").select("NroLicitacion").collect()]
        assert df.select("row_id").distinct().count() == 25_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [f"L-{i}" for i in range(20_000)] + [f"M-{i}" for i in range(5_000)]


def test_embedding_cache_holds_each_text_once(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = lambda *keys: spark.createDataFrame([(k, "m", [1.0]) for k in keys] + [("a", "other", [2.0])], tables.EMBEDDING_SCHEMA)
    tables.append_embeddings(rows("a", "b", "b"), path)
    tables.append_embeddings(rows("b", "c"), path)
    assert sorted(r["text_hash"] for r in tables.read_embeddings(spark, path, "m").collect()) == ["a", "b", "c"]
    assert tables.read_embeddings(spark, path, "other").count() == 1


def test_old_versions_go(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in range(4):
        tables.write_snapshot(spark.range(n).toDF("n"), path)
    tables.drop_old_versions(spark, path)
    assert not tables.has_version(spark, path, 1) and tables.has_version(spark, path, 2)
    assert tables.read_snapshot(spark, path).count() == 3


def test_barriers_are_deleted(spark):
    from pathlib import Path

    from tenderlens.session import barriers, stored

    with barriers(spark):
        df = stored(spark.range(3))
        folder = Path(df.inputFiles()[0].removeprefix("file://")).parent
        assert folder.exists() and df.count() == 3
    assert not folder.exists()


def test_daily_partitions_replace_only_their_day(spark, tmp_path):
    path = str(tmp_path / "days")
    assert tables.last_synced_day(spark, path) is None
    rows = [(date(2024, 1, 1), 1), (date(2024, 1, 2), 2)]
    tables.write_days(spark.createDataFrame(rows, "day date, n int"), path)
    for _ in range(2):
        tables.write_days(spark.createDataFrame([(date(2024, 1, 2), 5)], "day date, n int"), path)
    got = {(r["day"], r["n"]) for r in spark.read.parquet(path).collect()}
    assert got == {(date(2024, 1, 1), 1), (date(2024, 1, 2), 5)}
    assert tables.last_synced_day(spark, path) == date(2024, 1, 2)
    assert tables.days_to_sync(date(2024, 1, 2), date(2024, 1, 5)) == [date(2024, 1, d) for d in (3, 4, 5)]
    assert tables.days_to_sync(None, date(2024, 1, 5)) == [date(2024, 1, 4), date(2024, 1, 5)]


def test_catalog_probes(spark):
    spark.range(1).createOrReplaceTempView("probe_me")
    assert tables.table_exists(spark, "probe_me") and tables.table_columns(spark, "probe_me") == ["id"]
    assert not tables.table_exists(spark, "absent_table") and tables.table_columns(spark, "absent_table") == []


@pytest.fixture()
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def quoted(cell):
    return '"' + cell.replace('"', '""') + '"' if any(c in cell for c in '";\n') else cell


def test_cells_with_line_breaks_over_many_splits(spark, tmp_path, small_splits):
    """Splits that begin inside and outside cells, and records over several splits, read as one pass over the file would."""
    import random

    rng = random.Random(11)
    cells = ["x", 'a "b" c', 'n\n\nm;"', "Ñ" * 30, "", 'long\n' * 40, '5" pipe', '"', "\n", ";", "plain text"]
    rows = [(f"L-{i}", rng.choice(cells), rng.choice(cells), "end") for i in range(150)]
    lines = "".join(";".join(quoted(c) for c in r) + "\n" for r in rows)
    (tmp_path / "f.csv").write_bytes(("id;one;two;last\n" + lines).encode("latin-1"))
    (tmp_path / "g.csv").write_bytes(("id;one;two;last\r\n" + 'G-1;"a\r\nb";u" x;end\r\n').encode("latin-1"))
    (frame,) = offers_csv.read_offers_csv(spark, [str(tmp_path)])
    got = [tuple(r[:4]) for r in frame.filter("misfit_row IS NULL").orderBy("row_id").collect()]
    assert got == [(a, b or None, c or None, d) for a, b, c, d in rows] + [("G-1", "a\r\nb", 'u" x', "end")]
    assert frame.select("row_id.start").distinct().count() > 20


def test_an_unclosed_cell_and_a_misfit_record(spark, tmp_path):
    (tmp_path / "f.csv").write_text('id;one\nA;"x\ny";too many\nB;"z\n"\n')
    (frame,) = offers_csv.read_offers_csv(spark, [str(tmp_path)])
    rows = {r["id"]: r for r in frame.collect()}
    assert rows["A"]["misfit_row"] == 'A;"x\ny";too many' and rows["B"]["one"] == "z\n" and rows["B"]["misfit_row"] is None
    (tmp_path / "f.csv").write_text('id;one\nA;"x\ny\n')
    with pytest.raises(ValueError, match="never closed"):
        offers_csv.read_offers_csv(spark, [str(tmp_path)])


def test_records_with_line_breaks_are_found_once(spark, tmp_path):
    from tenderlens.sources import offers_csv

    (tmp_path / "a.csv").write_text('NroLicitacion;DescripcionItem\nT-1;"two\nlines"\nT-2;plain\n', encoding="ISO-8859-1")
    read = offers_csv.read_all_offers(spark, [str(tmp_path)])
    assert sorted((r["NroLicitacion"], r["DescripcionItem"]) for r in read.collect()) == [("T-1", "two\nlines"), ("T-2", "plain")]
    # What is read later is the stored records, not the files, which would be cut and sorted anew each time.
    assert all(f.endswith(".parquet") for f in read.inputFiles())
