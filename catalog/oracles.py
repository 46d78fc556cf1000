"""The registered queries as plain SQL, built from shared named subqueries."""

from __future__ import annotations

import re

from tenderlens.config import BASE_FEATURES
from tenderlens.sources.columns import COLUMN_NAMES
from tenderlens.sources.tender_json import DATE_FIELDS, TOP_FIELDS

CTES: dict[str, str] = {}
ORACLES: dict[str, str] = {}


def up(e: str, digits: int = 4) -> str:
    scale = f"{10**digits}.0::double"
    return f"floor(({e}) * {scale} + 0.5) / {scale}"


def with_ctes(sql: str) -> str:
    """Prefix the subqueries a statement names, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for word in re.findall(r"\b[a-z_0-9]+\b", text):
            if word in CTES and word not in needed:
                visit(CTES[word])
                if word not in needed:
                    needed.append(word)

    visit(sql)
    if not needed:
        return sql
    return "WITH " + ", ".join(f"{n} AS ({CTES[n]})" for n in needed) + " " + sql


FLAGS = (
    "single_bidder", "short_window", "express_evaluation", "weekend_publication",
    "round_amount", "ratio_near_one", "empty_justification",
)

# --- offers to tenders ------------------------------------------------------------------

CTES["s_offers"] = """
SELECT o_orderkey AS tender_id, l.l_linenumber AS line_no, l.l_suppkey AS supplier_id, s_name AS supplier_name,
  CASE WHEN s_acctbal > 5000 THEN 'Grande' WHEN s_acctbal IS NOT NULL THEN 'MiPyme' END AS supplier_size,
  'sector ' || s_nationkey AS supplier_activity,
  CASE l_returnflag WHEN 'A' THEN 'won' WHEN 'R' THEN 'lost' WHEN 'N' THEN 'other' END AS outcome,
  floor(l_extendedprice + 0.5)::double AS offer_total, l_partkey::varchar AS item_name, l_quantity AS item_qty,
  c_nationkey::bigint AS buyer_id, n_name AS institution, o_totalprice AS estimate,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'No' ELSE 'Si' END AS estimate_visible,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Sin información' ELSE o_orderpriority END AS justification,
  o_orderdate AS published_at, span.closed_at, span.awarded_at,
  CASE WHEN o_orderstatus = 'O' THEN 'Publicada' ELSE 'Adjudicada' END AS status
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS closed_at, max(l_shipdate) AS awarded_at
           FROM lineitem GROUP BY l_orderkey) span ON o_orderkey = span.l_orderkey
LEFT JOIN lineitem l ON o_orderkey = l.l_orderkey
LEFT JOIN supplier ON l.l_suppkey = s_suppkey
"""
CTES["s_ordered"] = """
SELECT *, row_number() OVER (PARTITION BY tender_id ORDER BY line_no, supplier_id, item_name, offer_total) AS pos,
  row_number() OVER (PARTITION BY tender_id, outcome ORDER BY line_no, supplier_id, item_name, offer_total) AS pos_outcome
FROM s_offers
"""
CTES["s_tenders"] = """
SELECT tender_id,
  any_value(estimate) FILTER (WHERE pos = 1) AS estimate,
  any_value(estimate_visible) FILTER (WHERE pos = 1) AS estimate_visible,
  any_value(justification) FILTER (WHERE pos = 1) AS justification,
  any_value(published_at) FILTER (WHERE pos = 1) AS published_at,
  any_value(closed_at) FILTER (WHERE pos = 1) AS closed_at,
  any_value(awarded_at) FILTER (WHERE pos = 1) AS awarded_at,
  any_value(status) FILTER (WHERE pos = 1) AS status,
  any_value(buyer_id) FILTER (WHERE pos = 1) AS buyer_id,
  any_value(institution) FILTER (WHERE pos = 1) AS institution,
  count(DISTINCT supplier_id) AS n_bidders,
  count(DISTINCT item_name) + max((item_name IS NULL)::int)::bigint AS n_items,
  coalesce(sum(item_qty), 0.0) AS total_qty,
  any_value(supplier_id) FILTER (WHERE outcome = 'won' AND pos_outcome = 1) AS winner_id,
  any_value(supplier_name) FILTER (WHERE outcome = 'won' AND pos_outcome = 1) AS winner_name,
  any_value(supplier_size) FILTER (WHERE outcome = 'won' AND pos_outcome = 1) AS winner_size,
  any_value(supplier_activity) FILTER (WHERE outcome = 'won' AND pos_outcome = 1) AS winner_activity,
  sum(offer_total) FILTER (WHERE outcome = 'won') AS awarded_amount,
  min(offer_total) FILTER (WHERE outcome = 'lost' AND offer_total > 0) AS runner_up_amount,
  avg(offer_total) FILTER (WHERE outcome = 'lost' AND offer_total > 0) AS losing_mean_amount
FROM s_ordered GROUP BY tender_id
"""
ORACLES["tender_assembly"] = f"SELECT * REPLACE ({up('losing_mean_amount')} AS losing_mean_amount) FROM s_tenders"
ORACLES["bidders_counting_null"] = """
SELECT tender_id, count(DISTINCT supplier_id) + max((supplier_id IS NULL)::int)::bigint AS n_bidders,
  count(DISTINCT item_name) + max((item_name IS NULL)::int)::bigint AS n_items FROM s_offers GROUP BY tender_id
"""
ORACLES["parse_timestamps"] = """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 IN (0, 1) THEN date_trunc('second', o_orderdate) END AS published_at FROM orders
"""
ORACLES["timestamp_failures"] = "SELECT count(*) FILTER (WHERE o_orderkey % 3 = 0) AS published_at FROM orders"

CTES["s_timed"] = """
SELECT *, (epoch_us(closed_at) - epoch_us(published_at)) // 1000000 / 86400.0::double AS days_open,
  (epoch_us(awarded_at) - epoch_us(closed_at)) // 1000000 / 86400.0::double AS days_to_award,
  isodow(published_at)::int AS pub_weekday, month(published_at)::int AS pub_month, year(published_at)::int AS pub_year,
  CASE WHEN estimate_visible = 'Si' AND estimate > 0 THEN awarded_amount / estimate END AS award_ratio,
  CASE WHEN runner_up_amount IS NOT NULL AND awarded_amount > 0
    THEN (runner_up_amount - awarded_amount) / awarded_amount END AS runner_up_margin
FROM s_tenders
"""
CTES["s_tier1"] = """
SELECT *, (n_bidders = 1)::int AS single_bidder, (days_open < 5)::int AS short_window,
  (days_to_award < 1)::int AS express_evaluation, (pub_weekday >= 6)::int AS weekend_publication,
  CASE WHEN awarded_amount > 0 THEN (awarded_amount % 10 = 0)::int ELSE 0 END AS round_amount,
  CASE WHEN award_ratio BETWEEN 0.99 AND 1.01 THEN 1 ELSE 0 END AS ratio_near_one,
  (justification IS NULL OR justification IN ('Sin información', 'Sin fecha', ''))::int AS empty_justification
FROM s_timed
"""
ORACLES["tier1_flags"] = f"""
SELECT tender_id, {up('days_open')} AS days_open, {up('days_to_award')} AS days_to_award, pub_weekday, pub_month, pub_year,
  {up('award_ratio')} AS award_ratio, {up('runner_up_margin')} AS runner_up_margin, {', '.join(FLAGS)} FROM s_tier1
"""
CTES["s_history"] = """
SELECT tender_id, prior_pair, prior_supplier, prior_buyer,
  CASE WHEN prior_supplier > 0 THEN prior_pair::double / prior_supplier ELSE 0.0 END AS supplier_share,
  CASE WHEN prior_buyer > 0 THEN prior_pair::double / prior_buyer ELSE 0.0 END AS buyer_share
FROM (SELECT tender_id,
  row_number() OVER (PARTITION BY buyer_id, winner_id ORDER BY published_at, tender_id) - 1 AS prior_pair,
  row_number() OVER (PARTITION BY winner_id ORDER BY published_at, tender_id) - 1 AS prior_supplier,
  row_number() OVER (PARTITION BY buyer_id ORDER BY published_at, tender_id) - 1 AS prior_buyer
  FROM s_tenders WHERE winner_id IS NOT NULL) h
"""
ORACLES["prior_concentration"] = f"""
SELECT tender_id, prior_pair, prior_supplier, prior_buyer, {up('supplier_share')} AS supplier_share,
  {up('buyer_share')} AS buyer_share FROM s_history
"""
ORACLES["prior_concentration_hot_keys"] = ORACLES["prior_concentration"]
CTES["s_features"] = """
SELECT t.*, h.prior_pair, h.prior_supplier, h.prior_buyer, h.supplier_share, h.buyer_share
FROM s_tier1 t LEFT JOIN s_history h USING (tender_id)
"""
CTES["s_ruled"] = """
SELECT *, 3.0 * coalesce(single_bidder, 0) + 2.0 * coalesce(short_window, 0) + 1.0 * coalesce(express_evaluation, 0)
  + 1.0 * coalesce(weekend_publication, 0) + 0.5 * coalesce(round_amount, 0) + 2.5 * coalesce(ratio_near_one, 0)
  + 0.5 * coalesce(empty_justification, 0) + flag_captive_supplier + flag_intense_relation AS rule_score
FROM (SELECT *, CASE WHEN supplier_share > 0.8 THEN 2.0::double ELSE 0.0::double END AS flag_captive_supplier,
  CASE WHEN prior_pair >= 10 THEN 1.5::double ELSE 0.0::double END AS flag_intense_relation FROM s_features) f
"""
ORACLES["rule_score"] = f"""
SELECT tender_id, {', '.join(FLAGS)}, flag_captive_supplier, flag_intense_relation, rule_score::double AS rule_score FROM s_ruled
"""
CTES["s_regional"] = """
SELECT r.*, n_regionkey AS community_id FROM s_ruled r JOIN nation ON buyer_id = n_nationkey
"""
CTES["s_region_stats"] = """
SELECT community_id, avg(rule_score) AS community_mean_score FROM s_regional GROUP BY community_id
"""
ORACLES["rule_score_community"] = """
SELECT tender_id, community_id, flag_hot_community, (rule_score + flag_hot_community)::double AS rule_score FROM (
  SELECT r.*, CASE WHEN s.community_mean_score > (
    SELECT avg(m) + stddev_samp(m) FROM (
      SELECT s2.community_mean_score AS m FROM s_regional r2 JOIN s_region_stats s2 USING (community_id)) x)
    THEN 1.5::double ELSE 0.0::double END AS flag_hot_community
  FROM s_regional r JOIN s_region_stats s USING (community_id)) y
"""

# --- read queries ---------------------------------------------------------------------------

CTES["s_scored"] = """
SELECT *, round_even(rule_part / (CASE WHEN max(rule_part) OVER () > 0 THEN max(rule_part) OVER () ELSE 1.0 END) * 100 * 100, 0)
    / 100.0::double AS risk_score
FROM (SELECT *, 0.6::double * ((rule_score - min(rule_score) OVER ()) / (max(rule_score) OVER () - min(rule_score) OVER ()))::double
  AS rule_part FROM s_regional) p
"""
ORACLES["institution_ranking"] = f"""
SELECT institution, count(*) AS n_tenders, {up('avg(risk_score)', 1)} AS mean_score,
  count(*) FILTER (WHERE risk_score >= 70) AS n_high, {up('avg(single_bidder) * 100', 1)} AS pct_single_bidder,
  {up('avg(short_window) * 100', 1)} AS pct_short_window
FROM s_scored GROUP BY institution HAVING count(*) >= 10 ORDER BY mean_score DESC, institution
"""
_PAIR = f"""count(*) AS n_awards, sum(awarded_amount) AS amount, {up('avg(risk_score)', 1)} AS mean_score,
  {up('max(supplier_share)', 3)} AS share"""
ORACLES["pair_ranking"] = f"""
SELECT institution, winner_name AS supplier, {_PAIR} FROM s_scored WHERE winner_id IS NOT NULL
GROUP BY institution, winner_name HAVING count(*) >= 5
"""
ORACLES["pair_ranking_by_id"] = f"""
SELECT buyer_id, winner_id, arg_min(institution, tender_id) AS institution, arg_min(winner_name, tender_id) AS supplier, {_PAIR}
FROM s_scored WHERE winner_id IS NOT NULL GROUP BY buyer_id, winner_id HAVING count(*) >= 5
"""
CTES["s_edges"] = f"""
SELECT 'I:' || buyer_id AS source, 'P:' || winner_id AS target, institution AS buyer_label, winner_name AS supplier_label,
  n_awards, coalesce(amount, 0.0) AS amount, coalesce(mean_score, 0.0) AS mean_score, community_id
FROM (SELECT buyer_id, institution, winner_id, winner_name, count(*) AS n_awards, sum(awarded_amount) AS amount,
    {up('avg(risk_score)', 1)} AS mean_score, max(community_id) AS community_id
  FROM s_scored WHERE winner_id IS NOT NULL AND buyer_id IS NOT NULL
  GROUP BY buyer_id, institution, winner_id, winner_name HAVING count(*) >= 3
  ORDER BY n_awards DESC, buyer_id, winner_id, institution, winner_name LIMIT 200) e
"""
ORACLES["network_edges"] = "SELECT * FROM s_edges"
CTES["s_nodes"] = """
SELECT id, kind, arg_min(label, pos) AS label, any_value(community_id) AS community_id, sum(n_awards)::bigint AS n_awards
FROM (
  SELECT source AS id, 'buyer' AS kind, buyer_label AS label, community_id, n_awards, pos FROM s_ranked_edges
  UNION ALL
  SELECT target, 'supplier', supplier_label, NULL, n_awards, pos FROM s_ranked_edges) u
GROUP BY id, kind
"""
CTES["s_ranked_edges"] = """
SELECT *, row_number() OVER (ORDER BY n_awards DESC, source, target, buyer_label, supplier_label) AS pos FROM s_edges
"""
ORACLES["network_nodes"] = "SELECT * FROM s_nodes"
ORACLES["top_communities"] = """
SELECT slot, sum(n_buyers)::bigint AS n_buyers FROM (
  SELECT n_buyers, CASE WHEN row_number() OVER (ORDER BY n_buyers DESC, community_id) <= 3 THEN community_id ELSE -1 END AS slot
  FROM (SELECT community_id, count(*) AS n_buyers FROM s_nodes WHERE kind = 'buyer' AND community_id >= 0 GROUP BY community_id) c
) s GROUP BY slot
"""
_PAGE = "tender_id, institution, winner_name, awarded_amount, n_bidders, risk_score"
ORACLES["ranked_page"] = f"""
SELECT {_PAGE} FROM s_scored WHERE institution ILIKE '%nation_1%' AND risk_score >= 20 AND status = 'Publicada'
ORDER BY risk_score DESC, tender_id LIMIT 50 OFFSET 10
"""
ORACLES["ranked_page_year"] = f"""
SELECT {_PAGE} FROM s_scored WHERE pub_year = 1998 ORDER BY risk_score DESC, tender_id LIMIT 500
"""
ORACLES["reverse_page"] = f"""
SELECT * FROM (SELECT {_PAGE} FROM s_scored WHERE status = 'Publicada' ORDER BY risk_score DESC, tender_id LIMIT 8) p
ORDER BY risk_score, tender_id DESC
"""
ORACLES["raw_page"] = """
SELECT tender_id, line_no, supplier_id, offer_total FROM s_offers
WHERE institution ILIKE '%NATION_2%%' AND year(published_at) = 1997
ORDER BY tender_id, line_no NULLS FIRST, supplier_id NULLS FIRST, item_name NULLS FIRST, offer_total NULLS FIRST LIMIT 100 OFFSET 20
"""
ORACLES["filtered_count"] = "SELECT count(*) AS total FROM s_scored WHERE risk_score >= 50 AND status = 'Publicada'"
ORACLES["page_count"] = """
SELECT n_pages, ceil(n_pages / 10.0)::bigint AS n_blocks
FROM (SELECT greatest(ceil(count(*) / 8.0), 1)::bigint AS n_pages FROM s_scored WHERE status = 'Publicada') p
"""
ORACLES["point_lookup"] = f"SELECT {_PAGE} FROM s_scored WHERE tender_id = 77"
ORACLES["risk_bands"] = """
SELECT tender_id, risk_score, CASE WHEN risk_score >= 80 THEN 'high' WHEN risk_score >= 60 THEN 'medium' ELSE 'low' END AS band
FROM s_scored
"""
_LABELS = dict(zip(FLAGS, (
    "Oferente único", "Plazo corto", "Eval. express", "Pub. finde", "Monto redondo", "Ratio ≈ 1", "Just. vacía",
)))


def _flag_list(pairs: dict[str, str]) -> str:
    items = ", ".join(f"CASE WHEN coalesce({c}, 0) <> 0 THEN '{label}' END" for c, label in pairs.items())
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


ORACLES["active_flags"] = f"""
SELECT tender_id, array_to_string(l, '|') AS flags, len(l)::int AS n_flags, floor(len(l) * 100.0::double / 7 + 0.5)::bigint AS flags_pct
FROM (SELECT tender_id, {_flag_list(_LABELS)} AS l FROM s_scored) f
"""
ORACLES["flag_badges"] = f"""
SELECT tender_id, array_to_string(l[1:2], '|') AS badges, greatest(len(l) - 2, 0)::int AS n_more
FROM (SELECT tender_id, {_flag_list({
    "single_bidder": "Oferente único", "short_window": "Plazo corto", "flag_captive_supplier": "Proveedor cautivo",
    "ratio_near_one": "Ratio ≈ 1"})} AS l FROM s_scored) f
"""
ORACLES["highlights"] = """
SELECT tender_id, coalesce(n_bidders = 1, false) AS one_bidder, coalesce(days_open < 5, false) AS few_days,
  coalesce(award_ratio >= 0.98, false) AS high_ratio, coalesce(supplier_share > 0.8, false) AS captive,
  coalesce(supplier_share > 0.6 AND supplier_share <= 0.8, false) AS nearly_captive FROM s_scored
"""
_MILLIONS = up("awarded_amount / 1e6", 1)
ORACLES["labels"] = f"""
SELECT tender_id, replace(institution, 'NATION_', 'Mun. ') AS institution_short,
  CASE WHEN length(coalesce(winner_name, '')) > 12 THEN left(winner_name, 12) || '…' ELSE coalesce(winner_name, '') END AS supplier_short,
  left(institution, 50) AS node_label, {_MILLIONS} AS amount_millions, {up('awarded_amount / 1e9', 2)} AS amount_billions,
  CASE WHEN awarded_amount IS NULL THEN '—' ELSE '$' || printf('%.1f', {_MILLIONS}) || 'M' END AS amount_label FROM s_scored
"""
ORACLES["page_kpis"] = """
SELECT count(*) AS n_rows, count(*) FILTER (WHERE risk_score >= 70) AS n_high,
  floor(count(*) FILTER (WHERE risk_score >= 70) * 100.0 / count(*) + 0.5)::bigint AS pct_high,
  count(*) FILTER (WHERE single_bidder = 1) AS n_single_bidder,
  floor(count(*) FILTER (WHERE single_bidder = 1) * 100.0 / count(*) + 0.5)::bigint AS pct_single_bidder,
  count(*) FILTER (WHERE flag_captive_supplier > 0) AS n_captive FROM s_scored
"""
ORACLES["json_safe_records"] = """
SELECT tender_id, strftime(published_at, '%Y-%m-%dT%H:%M:%S') AS published_at,
  CASE WHEN n_bidders IN (1, 2) THEN NULL ELSE risk_score END AS shaky, runner_up_amount, winner_name FROM s_scored
"""
ORACLES["last_runs"] = """
SELECT event_id AS id, ts AS run_at, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 10
"""

# --- cleaning --------------------------------------------------------------------------------

CTES["s_raw"] = """
SELECT 'T-' || l_orderkey AS "NroLicitacion",
  CASE WHEN l_linenumber % 7 <> 0 THEN 'S-' || l_suppkey END AS "ProveedorRUT",
  CASE WHEN l_linenumber % 7 <> 0 THEN l_quantity END AS "CantidadItem",
  CASE WHEN l_linenumber % 7 <> 0 THEN CASE WHEN l_quantity = 50 THEN 0.0::double ELSE l_extendedprice END END AS total,
  l_tax AS "MontoNetoOferta",
  CASE WHEN l_partkey % 11 <> 0 THEN strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') END AS "FechaCierre",
  l_returnflag AS "ResultadoOferta", CASE WHEN l_partkey % 25 = 0 THEN 'nota' END AS "Observacion", l_linenumber
FROM lineitem
"""
# The text amounts are shown by their value: one decimal at least, comma for the dot.
_TOTAL_TEXT = "replace(CASE WHEN total = floor(total) THEN printf('%.1f', total) ELSE total::varchar END, '.', ',')"
CTES["s_first_raw"] = f"""
SELECT "NroLicitacion", "ProveedorRUT", "CantidadItem", {_TOTAL_TEXT} AS "MontoTotalOferta", "MontoNetoOferta", "FechaCierre",
  "ResultadoOferta", "Observacion" FROM s_raw
"""
CTES["s_union"] = f"""
SELECT * FROM s_first_raw UNION ALL
SELECT "NroLicitacion", "ProveedorRUT", "CantidadItem", {_TOTAL_TEXT}, "MontoNetoOferta", "FechaCierre",
  "ResultadoOferta", NULL FROM s_raw WHERE l_linenumber = 1
"""
_RAW_COLUMNS = (
    "NroLicitacion", "ProveedorRUT", "CantidadItem", "MontoTotalOferta", "MontoNetoOferta", "FechaCierre",
    "ResultadoOferta", "Observacion",
)
ORACLES["union_by_name"] = "SELECT * FROM s_union"
ORACLES["null_profile"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(*) FILTER (WHERE "{c}" IS NULL) AS n_null,
    {up(f'count(*) FILTER (WHERE "{c}" IS NULL)::double / count(*) * 100')} AS null_pct FROM s_union"""
    for c in _RAW_COLUMNS
)
ORACLES["drop_sparse_columns"] = 'SELECT * EXCLUDE ("Observacion") FROM s_union'
_IMPUTED = """
  coalesce("ProveedorRUT", 'Sin información') AS "ProveedorRUT",
  coalesce("CantidadItem", (SELECT median("CantidadItem") FROM {src})) AS "CantidadItem",
  coalesce("MontoTotalOferta", 'Sin información') AS "MontoTotalOferta",
  coalesce("FechaCierre", 'Sin fecha') AS "FechaCierre"
"""
ORACLES["impute_nulls"] = f"""
SELECT * EXCLUDE ("Observacion") REPLACE ({_IMPUTED.format(src='s_first_raw')}) FROM s_first_raw
"""
ORACLES["drop_duplicates"] = 'SELECT DISTINCT * EXCLUDE ("Observacion") FROM s_union'
ORACLES["duplicate_keys"] = 'SELECT count(*) - count(DISTINCT "NroLicitacion") AS duplicate_keys FROM s_union'
CTES["s_typed"] = """
SELECT "NroLicitacion", "ProveedorRUT", "CantidadItem", coalesce(total, 0.0) AS "MontoTotalOferta", "MontoNetoOferta",
  "FechaCierre", "ResultadoOferta", "Observacion" FROM s_raw
"""
ORACLES["retype_text"] = "SELECT * FROM s_typed"
ORACLES["exclude_zero_amounts"] = 'SELECT * FROM s_typed WHERE "MontoTotalOferta" <> 0 AND "MontoNetoOferta" <> 0'
CTES["s_deduped"] = f"""
SELECT DISTINCT * EXCLUDE ("Observacion") REPLACE ({_IMPUTED.format(src='s_union')}) FROM s_union
"""
CTES["s_clean"] = """
SELECT * REPLACE (CASE WHEN "MontoTotalOferta" = 'Sin información' THEN 0.0::double
  ELSE replace("MontoTotalOferta", ',', '.')::double END AS "MontoTotalOferta") FROM s_deduped
"""
ORACLES["clean_offers"] = 'SELECT * FROM s_clean WHERE "MontoTotalOferta" <> 0 AND "MontoNetoOferta" <> 0'
ORACLES["clean_metrics"] = """
SELECT (SELECT count(*) FROM s_union) AS rows_in, 8 AS columns_in, 'Observacion' AS dropped,
  (SELECT median("CantidadItem") FROM s_union) AS median_qty, 'ProveedorRUT|MontoTotalOferta' AS text_imputed,
  'FechaCierre' AS date_imputed, (SELECT count(*) - count(DISTINCT "NroLicitacion") FROM s_union) AS duplicate_keys,
  'MontoTotalOferta' AS retyped,
  (SELECT count(*) FROM s_clean WHERE "MontoTotalOferta" = 0 OR "MontoNetoOferta" = 0) AS zero_rows,
  (SELECT count(*) FROM s_clean WHERE "MontoTotalOferta" <> 0 AND "MontoNetoOferta" <> 0) AS rows_out, 7 AS columns_out
"""
ORACLES["exact_medians"] = """
SELECT median(l_quantity) AS l_quantity, median(l_extendedprice) AS l_extendedprice, median(l_discount) AS l_discount FROM lineitem
"""

# --- text --------------------------------------------------------------------------------------

CTES["s_lines"] = """
SELECT d.doc_id // 4 AS tender_id, d.doc_id,
  CASE d.doc_id % 3 WHEN 0 THEN 'won' WHEN 1 THEN 'lost' ELSE 'other' END AS outcome,
  sha256(coalesce(d.text, '')) AS a, sha256(coalesce(e.text, '')) AS b
FROM documents d LEFT JOIN documents e ON e.doc_id = d.doc_id + 1
"""
CTES["s_texts"] = """
SELECT h, count(*) AS copies FROM (
  SELECT DISTINCT a AS h, 1 AS side FROM s_lines UNION ALL SELECT DISTINCT b, 2 FROM s_lines) u GROUP BY h
"""
CTES["s_tokens"] = """
SELECT h, copies, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}_]{2,}') AS t
FROM s_texts JOIN (SELECT DISTINCT text, sha256(text) AS h FROM documents) d USING (h)
"""
CTES["s_terms"] = """
SELECT h, copies, term, count(*) AS tf FROM (
  SELECT h, copies, unnest(t) AS term FROM s_tokens
  UNION ALL
  SELECT h, copies, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM s_tokens) g
GROUP BY h, copies, term
"""
CTES["s_vocab"] = """
SELECT row_number() OVER (ORDER BY occurrences DESC, term) - 1 AS term_id, term, n_texts, occurrences,
  ln((1 + (SELECT sum(copies) FROM s_texts))::double / (1 + n_texts)) + 1 AS idf
FROM (SELECT term, sum(copies)::bigint AS n_texts, sum(tf * copies)::bigint AS occurrences FROM s_terms GROUP BY term
  HAVING sum(copies) >= 3 ORDER BY occurrences DESC, term LIMIT 30000) v
"""
ORACLES["tfidf_vocab"] = f"SELECT term_id::int AS term_id, term, n_texts, occurrences, {up('idf')} AS idf FROM s_vocab"
CTES["s_weights"] = "SELECT h, term_id, tf * idf AS w FROM s_terms JOIN s_vocab USING (term)"
CTES["s_norms"] = "SELECT h, sqrt(sum(w * w)) AS norm FROM s_weights GROUP BY h"
CTES["s_text_pairs"] = "SELECT DISTINCT a, b FROM s_lines"
CTES["s_cosines"] = """
SELECT p.a, p.b, coalesce(c.dot / (na.norm * nb.norm), 0.0) AS similarity
FROM s_text_pairs p
LEFT JOIN (SELECT q.a, q.b, sum(x.w * y.w) AS dot FROM s_text_pairs q
  JOIN s_weights x ON x.h = q.a JOIN s_weights y ON y.h = q.b AND y.term_id = x.term_id GROUP BY q.a, q.b) c
  ON c.a = p.a AND c.b = p.b
LEFT JOIN s_norms na ON na.h = p.a LEFT JOIN s_norms nb ON nb.h = p.b
"""
ORACLES["tfidf_pair_similarity"] = f"""
SELECT a AS a_hash, b AS b_hash, {up('similarity')} AS similarity FROM s_cosines
"""
ORACLES["delta_similarity"] = f"""
SELECT tender_id, {up('w')} AS sim_won_tfidf, {up('l')} AS sim_lost_tfidf, {up('w - l')} AS delta_sim_tfidf FROM (
  SELECT tender_id, avg(similarity) FILTER (WHERE outcome = 'won') AS w, avg(similarity) FILTER (WHERE outcome = 'lost') AS l
  FROM s_lines JOIN s_cosines USING (a, b) WHERE outcome IN ('won', 'lost') GROUP BY tender_id) m
"""
ORACLES["text_hashes"] = "SELECT doc_id, sha256(coalesce(text, '')) AS text_hash FROM documents"
ORACLES["cache_probe"] = """
SELECT sha256(text) AS text_hash, bool_or(lang = 'en') AS hit FROM documents GROUP BY text
"""
CTES["s_dots"] = """
SELECT a.vec_id, a.label, list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::double * b.embedding[i]::double)) AS dot
FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1
"""
ORACLES["dense_similarity"] = f"""
SELECT vec_id::varchar AS a_hash, (vec_id + 1)::varchar AS b_hash, {up('dot')} AS similarity FROM s_dots
"""
ORACLES["delta_similarity_dense"] = f"""
SELECT tender_id, {up('w')} AS sim_won_dense, {up('l')} AS sim_lost_dense, {up('w - l')} AS delta_sim_dense FROM (
  SELECT label AS tender_id, avg(dot) FILTER (WHERE vec_id % 3 = 0) AS w, avg(dot) FILTER (WHERE vec_id % 3 <> 0) AS l
  FROM s_dots WHERE dot IS NOT NULL GROUP BY label) m
"""

# --- graph ---------------------------------------------------------------------------------------

CTES["s_pairs"] = """
SELECT buyer_id, winner_id, count(*) AS n_awards, coalesce(sum(awarded_amount), 0.0) AS amount, avg({score}) AS mean_score,
  left(arg_min(institution, tender_id), 50) AS buyer_label, left(arg_min(winner_name, tender_id), 50) AS supplier_label
FROM s_scored WHERE winner_id IS NOT NULL AND buyer_id IS NOT NULL GROUP BY buyer_id, winner_id
""".format(score="rule_score")
ORACLES["pair_edges"] = f"SELECT * REPLACE ({up('mean_score')} AS mean_score) FROM s_pairs"
ORACLES["graph_edges"] = f"""
SELECT 'I:' || buyer_id AS src, 'P:' || winner_id AS dst, n_awards::double AS weight, amount, {up('mean_score')} AS score FROM s_pairs
"""
ORACLES["graph_vertices"] = """
SELECT 'I:' || buyer_id AS id, 'buyer' AS kind, arg_min(buyer_label, winner_id::varchar) AS label FROM s_pairs GROUP BY buyer_id
UNION ALL
SELECT 'P:' || winner_id, 'supplier', arg_min(supplier_label, buyer_id::varchar) FROM s_pairs GROUP BY winner_id
"""
ORACLES["graph_summary"] = f"""
SELECT n_nodes, n_edges, {up('2.0 * n_edges / (n_nodes * (n_nodes - 1.0))')} AS density FROM (
  SELECT count(DISTINCT buyer_id) + count(DISTINCT winner_id) AS n_nodes, count(*) AS n_edges FROM s_pairs) s
"""
ORACLES["community_stats"] = f"""
SELECT community_id, count(tender_id) AS n_tenders, {up('avg(rule_score)')} AS community_mean_score,
  {up('avg(single_bidder)')} AS community_single_bidder_rate FROM s_scored WHERE community_id >= 0 GROUP BY community_id
"""
ORACLES["number_by_size"] = """
SELECT 'I:' || c_custkey AS id, (dense_rank() OVER (ORDER BY size DESC, least) - 1)::int AS community
FROM (SELECT c_custkey, count(*) OVER w AS size, min(c_custkey) OVER w AS least FROM customer
  WINDOW w AS (PARTITION BY c_nationkey, c_mktsegment)) s
"""

# --- forest and final score ------------------------------------------------------------------------

_SCALED = BASE_FEATURES
CTES["s_split"] = """
SELECT *, CASE WHEN year(published_at) < 1999 THEN 'train' WHEN year(published_at) >= 1999 THEN 'test' END AS split FROM s_features
"""
CTES["s_fill"] = "SELECT " + ", ".join(
    f"coalesce(median({c}), 0)::double AS {c}" for c in _SCALED
) + " FROM s_split WHERE split = 'train'"
CTES["s_filled"] = "SELECT tender_id, split, " + ", ".join(
    f"coalesce(s.{c}::double, f.{c}) AS {c}" for c in _SCALED
) + " FROM s_split s, s_fill f"
CTES["s_moments"] = "SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_pop({c}) AS d_{c}" for c in _SCALED
) + " FROM s_filled WHERE split = 'train'"
ORACLES["split_impute_scale"] = "SELECT tender_id, split, " + ", ".join(
    up(f"({c} - m_{c}) / d_{c}") + f" AS {c}" for c in _SCALED
) + " FROM s_filled, s_moments"
ORACLES["combined_score"] = f"""
SELECT tender_id, {up('rule_part')} AS rule_part, {up('anomaly_part')} AS anomaly_part,
  round_even((rule_part + anomaly_part) / max(rule_part + anomaly_part) OVER () * 100 * 100, 0) / 100.0::double AS risk_score
FROM (SELECT tender_id,
  0.6::double * ((rule_score - min(rule_score) OVER ()) / (max(rule_score) OVER () - min(rule_score) OVER ()))::double AS rule_part,
  0.4::double * coalesce((runner_up_amount - min(runner_up_amount) OVER ())
    / (max(runner_up_amount) OVER () - min(runner_up_amount) OVER ()), 0.0) AS anomaly_part FROM s_ruled) p
"""
ORACLES["score_contributions"] = f"""
SELECT tender_id, risk_score, {up('risk_score * share')} AS rule_points, {up('risk_score - risk_score * share')} AS anomaly_points
FROM (SELECT *, CASE WHEN rule_part > 0 THEN 1.0::double ELSE 0.0::double END AS share FROM s_scored) s
"""
ORACLES["score_summary"] = f"""
SELECT count(*) AS n_tenders, 11 AS n_features, false AS dense, {up('avg(risk_score)')} AS mean_score, max(risk_score) AS max_score FROM s_scored
"""

# --- incremental --------------------------------------------------------------------------------------

CTES["s_codes"] = """
SELECT user_id || '|' || event_type AS code, (floor(value)::bigint % 5)::int AS state, ts, event_id FROM events
"""
CTES["s_known"] = """
SELECT code, arg_max(state, (ts, event_id)) AS state FROM s_codes WHERE ts < TIMESTAMP '2024-01-29' GROUP BY code
"""
CTES["s_listed"] = """
SELECT code, arg_max(state, (ts, event_id)) AS state FROM s_codes WHERE ts >= TIMESTAMP '2024-01-29' GROUP BY code
"""
ORACLES["latest_per_key"] = """
SELECT code, state, ts, event_id FROM s_codes QUALIFY row_number() OVER (PARTITION BY code ORDER BY ts DESC, event_id DESC) = 1
"""
ORACLES["active_listing"] = """
SELECT code, arg_max(state, event_id) AS state FROM s_codes WHERE state <> 4 GROUP BY code
"""
CTES["s_changed"] = """
SELECT l.code FROM s_listed l LEFT JOIN s_known k ON k.code = l.code WHERE k.state IS DISTINCT FROM l.state
"""
CTES["s_vanished"] = "SELECT code FROM s_known WHERE code NOT IN (SELECT code FROM s_listed)"
ORACLES["changed_codes"] = "SELECT * FROM s_changed"
ORACLES["vanished_codes"] = "SELECT * FROM s_vanished"
ORACLES["pending_codes"] = """
SELECT code FROM (SELECT code FROM s_changed UNION SELECT code FROM s_vanished) p
"""
ORACLES["state_advance"] = """
SELECT coalesce(l.code, k.code) AS code, CASE WHEN l.code IS NOT NULL THEN l.state ELSE k.state END AS state
FROM s_known k FULL JOIN s_listed l ON l.code = k.code
"""
ORACLES["upsert_by_key"] = """
SELECT o_orderkey, CASE WHEN n THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN n THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
  CASE WHEN n THEN NULL ELSE o_orderpriority END AS o_orderpriority
FROM (SELECT *, o_orderdate >= TIMESTAMP '2000-01-01' AS n FROM orders) o
"""
ORACLES["overlay_offers"] = """
SELECT o_orderkey AS tender_id, l_linenumber AS line_no, o_orderstatus AS status, l_quantity AS item_qty
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
"""
_NAMED = "CASE WHEN c_mktsegment <> 'MACHINERY' THEN {} END AS {}"
_PLAIN = [(f, COLUMN_NAMES[c]) for c, f in TOP_FIELDS.items() if f not in ("CodigoExterno", "Estado", "MontoEstimado")]
CTES["s_details"] = f"""
SELECT 'O-' || o_orderkey AS tender_id, o_orderstatus AS status, o_totalprice AS estimate,
  {", ".join(f"CASE WHEN o_orderkey % 13 <> {i % 13} THEN '{f} ' || o_orderkey % 1000 END AS {name}" for i, (f, name) in enumerate(_PLAIN))},
  CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END AS estimate_visible,
  {", ".join(f"CASE WHEN o_orderkey % 11 <> {i} THEN strftime(o_orderdate + INTERVAL {i} DAY, '%Y-%m-%dT%H:%M:%S') END AS {COLUMN_NAMES[c]}" for i, c in enumerate(DATE_FIELDS))},
  {_NAMED.format("'Municipalidad de ' || c_mktsegment", "institution")}, {_NAMED.format("c_name", "buyer_name")},
  {_NAMED.format("c_custkey::varchar", "buyer_id")}, {_NAMED.format("c_nationkey::varchar", "entity_code")}, 'Municipalidades' AS sector,
  'part ' || i.l_partkey AS item_name, i.l_returnflag AS item_text, i.l_linestatus AS unit, i.l_quantity AS item_qty
FROM orders JOIN customer ON o_custkey = c_custkey
LEFT JOIN (SELECT * FROM lineitem QUALIFY row_number() OVER (
    PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice) = 1) i ON i.l_orderkey = o_orderkey
"""
ORACLES["flatten_details"] = "SELECT * FROM s_details"
ORACLES["detail_items"] = """
SELECT 'O-' || o_orderkey AS tender_id, l_linenumber IS NOT NULL AS has_item, 'part ' || l_partkey AS item_name, l_returnflag AS item_text,
  l_linestatus AS unit, l_quantity AS item_qty,
  row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice) AS item_no
FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey
"""
ORACLES["sector_filter"] = "SELECT tender_id, institution FROM s_details WHERE upper(institution) LIKE '%DE AUTOMOBILE%'"
ORACLES["event_json"] = """
SELECT event_type, count(*) AS n, sum(json_extract(props, '$.k')::int)::bigint AS total FROM events GROUP BY event_type
"""
ORACLES["days_with_events"] = "SELECT ts::date AS day, count(*) AS n_rows FROM events GROUP BY 1"
