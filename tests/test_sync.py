import json

from tenderlens.sources import tables
from tenderlens.streaming import sync


def listing(path, name, **states):
    path.mkdir(exist_ok=True)
    (path / f"{name}.json").write_text(json.dumps({"Listado": [{"CodigoExterno": c, "CodigoEstado": s} for c, s in states.items()]}))


def detail(path, code, organisation="MUNICIPALIDAD DE X", status="Publicada"):
    path.mkdir(exist_ok=True)
    payload = {"CodigoExterno": code, "Estado": status, "Comprador": {"NombreOrganismo": organisation, "RutUnidad": "1-9"}}
    (path / f"{code}.json").write_text(json.dumps({"Listado": [payload]}))


def state(spark, paths):
    return {r["code"]: r["state"] for r in tables.read_state(spark, paths.state).collect()}


def test_sync_batches_and_redelivery(spark, tmp_path):
    landed, lists = tmp_path / "details", tmp_path / "lists"
    paths = sync.SyncPaths(str(landed), *(str(tmp_path / n) for n in ("bulk", "updates", "state", "log")))
    detail(landed, "A"), detail(landed, "B", organisation="MINISTERIO"), detail(landed, "C")
    (landed / "D.json").write_text("{broken")
    listing(lists, "1", A=5, B=5, D=5, E=5)
    sync.start_sync(spark, str(lists), paths, str(tmp_path / "cp")).awaitTermination()
    assert state(spark, paths) == {"A": 5, "B": 5}  # D failed, E has no detail: both stay unknown
    clean = sync.current_offers(spark, paths)
    assert [(r["tender_id"], r["institution"]) for r in clean.collect()] == [("A", "MUNICIPALIDAD DE X")]
    log = tables.read_log(spark, paths.log, "sync").first()
    assert (log["n_listed"], log["n_queried"], log["n_upserted"], log["n_failed"]) == (4, 4, 1, 1)

    detail(landed, "A", status="Cerrada")
    listing(lists, "2", B=5, C=5)
    sync.start_sync(spark, str(lists), paths, str(tmp_path / "cp")).awaitTermination()
    assert state(spark, paths) == {"A": tables.GONE, "B": 5, "C": 5}
    got = {r["tender_id"]: r["status"] for r in sync.current_offers(spark, paths).collect()}
    assert got == {"A": "Cerrada", "C": "Publicada"}

    seen = spark.createDataFrame([("B", 5), ("C", 5)], "code string, state int")
    logged = [r["detail"] for r in tables.read_log(spark, paths.log, "sync").orderBy("id").collect()]
    assert len(logged) == 2 and "/2.json@" in logged[1]
    assert sync.apply_listing(spark, seen, logged[1], paths) is False
    # A new checkpoint counts its batches from 0 again: old listings are known, a new one is not skipped.
    listing(lists, "3", B=5, C=6)
    sync.start_sync(spark, str(lists), paths, str(tmp_path / "cp2")).awaitTermination()
    assert state(spark, paths)["C"] == 6
    assert tables.read_log(spark, paths.log, "sync").count() == 3


def test_cap_leaves_the_rest_for_the_next_run(spark, tmp_path):
    landed = tmp_path / "details"
    paths = sync.SyncPaths(str(landed), *(str(tmp_path / n) for n in ("bulk", "updates", "state", "log")))
    codes = ["A", "B", "C", "D", "E"]
    for c in codes:
        detail(landed, c)
    seen = spark.createDataFrame([(c, 5) for c in codes], "code string, state int")
    for version, done in enumerate((2, 4, 5)):
        assert sync.apply_listing(spark, seen, f"l{version}", paths, cap=2)
        assert sorted(state(spark, paths)) == codes[:done]
    assert sync.current_offers(spark, paths).count() == 5


def test_codes_without_an_answer_do_not_starve_others(spark, tmp_path):
    landed = tmp_path / "details"
    paths = sync.SyncPaths(str(landed), *(str(tmp_path / n) for n in ("bulk", "updates", "state", "log")))
    detail(landed, "C"), detail(landed, "D")
    seen = spark.createDataFrame([(c, 5) for c in "ABCD"], "code string, state int")
    for run in range(2):
        assert sync.apply_listing(spark, seen, f"l{run}", paths, cap=2)
    assert sorted(state(spark, paths)) == ["C", "D"]
    detail(landed, "A")
    assert sync.apply_listing(spark, seen, "l2", paths, cap=2)
    assert sorted(state(spark, paths)) == ["A", "C", "D"]


def test_changed_vanished_pending(spark):
    known = spark.createDataFrame([("a", 1), ("b", 2), ("n", None), ("gone", -1)], "code string, state int")
    seen = spark.createDataFrame([("a", 1), ("b", 3), ("c", 1), ("n", None)], "code string, state int")
    active = spark.createDataFrame([("a",), ("z",), ("z",)], "code string")
    assert {r["code"] for r in sync.changed_or_new(seen, known).collect()} == {"b", "c"}
    assert [r["code"] for r in sync.vanished_codes(active, seen).collect()] == ["z"]
    assert [r["code"] for r in sync.pending_codes(seen, known, active, cap=2).collect()] == ["b", "c"]


def test_updates_lie_over_the_bulk(spark, tmp_path):
    landed = tmp_path / "details"
    paths = sync.SyncPaths(str(landed), *(str(tmp_path / n) for n in ("bulk", "updates", "state", "log")))
    bulk = spark.createDataFrame(
        [("A", "s1", "Publicada"), ("A", "s2", "Publicada"), ("B", "s1", "Cerrada"), ("C", "s1", "Publicada")],
        "tender_id string, supplier_id string, status string",
    )
    tables.write_snapshot(bulk, paths.bulk)
    detail(landed, "A", status="Adjudicada"), detail(landed, "C"), detail(landed, "Z")
    seen = spark.createDataFrame([("C", 5)], "code string, state int")
    assert sync.apply_listing(spark, seen, "first", paths)
    assert state(spark, paths) == {"A": tables.GONE, "C": 5}  # A is active in the bulk but no longer listed
    replaced = {tuple(r) for r in sync.current_offers(spark, paths).collect()}
    assert replaced == {("A", None, "Adjudicada"), ("B", "s1", "Cerrada"), ("C", None, "Publicada")}
    kept = {tuple(r) for r in sync.current_offers(spark, paths, keep_bids=True).collect()}
    assert kept == {("A", "s1", "Adjudicada"), ("A", "s2", "Adjudicada"), ("B", "s1", "Cerrada"), ("C", "s1", "Publicada")}
    assert sync.apply_listing(spark, seen, "second", paths)
    log = tables.read_log(spark, paths.log, "sync").orderBy("id").collect()
    assert [r["n_queried"] for r in log] == [2, 0]
