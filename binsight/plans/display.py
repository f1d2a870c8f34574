"""Display order of the reports.

Reports return unordered DataFrames: a total sort is a full shuffle and is
only worth paying for when a person reads the result.  ``sort_like_original``
applies the original ORDER BY of a report, with PostgreSQL's NULL placement
(NULLs last when ascending, first when descending -- the reverse of Spark's
default).  A caller that shows only the first rows writes ``.limit`` itself
(sort + limit is planned as a top-k, not a full sort).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------
# report function -> original ORDER BY as (column, descending).  Reports whose
# original had no ORDER BY (or sorted on a column they no longer output) are absent.
ORDER_BY: dict[str, list[tuple[str, bool]]] = {
    "station_restart_history": [("data", True)],
    "duplicate_deposits": [("dataora", True)],
    "power_changes": [("stazione", False), ("orario", True)],
    "power_changes_asof": [("dataora", True)],
    "households_without_form": [("codicenucleo", False)],
    "silent_stations": [("idcomune", False), ("idstazione", False)],
    "battery_phases": [("data", True)],
    "operator_log": [("stazione", False), ("data", True)],
    "operator_log_filtered": [("stazione", False), ("data", True)],
    "deposit_listing": [("data|[0-9]{4}-.*", True)],
    "repeat_deposits": [("data", True), ("ora", True)],
    "deposits_with_household": [("data", True), ("ora", True)],
    "heavy_deposits": [("data", False), ("ora", True)],
    "per_station_tag": [("codicetag", False)],
    "zero_weight_deposits": [("dataora", True)],
    "admin_tester_log": [("data", True)],
    "lid_openings": [("data", True), ("ora", True)],
    "label_rolls": [("__order_idcomune", False), ("stazione", False)],
    "station_sheet": [("comune", False), ("numerostazione", False)],
    "station_list": [("idcomune", False), ("stazione", False)],
    "bin_accumulation": [("data", True), ("ora", True)],
    "multi_tag_households": [("codicenucleo", False)],
    "households_without_tag": [("cognome", False)],
    "latest_household": [("idcomune", True)],
    "tags_per_municipality": [("idcomune", False)],
    "tags_with_households": [("codicetag", False)],
    "all_tags": [("idcomune", False), ("codicetag", False)],
    "unassociated_tags": [("codicetag", False)],
    "duplicate_usernames": [("ndoppi", True)],
    "web_users": [("id", False)],
    "type_variety": [("tipi", False)],
    "annual_sheet_allowlist": [("indirizzo", False), ("cognome", False), ("nome", False)],
    "annual_sheet": [("cognome", False), ("nome", False), ("indirizzo", True)],
    "household_sheet": [("__order_totale", True), ("percentualedifferenziata", False)],
    "household_sheet_rollup": [("__order_totale", True), ("percentualedifferenziata", False)],
    "clock_repair": [("idcomune", False), ("codicestazione", False), ("idn", False)],
    "per_capita_by_type": [("idcomune", False), ("tiporifiuto", False)],
    "stale_stations": [("nome", False), ("codicestazione", False)],
    "per_capita_totals": [("idcomune", False)],
}
# ------------------------------------------------------------------------------


def _column(term: str) -> str:
    return term.partition("|")[0]


def pg_order(term: str, descending: bool = False):
    """One ORDER BY term with PostgreSQL's NULL placement.  ``column|pattern``
    sorts on the part of a text that the pattern finds."""
    column, _, pattern = term.partition("|")
    c = F.regexp_extract(F.col(column), pattern, 0) if pattern else F.col(column)
    return c.desc_nulls_first() if descending else c.asc_nulls_last()


def sort_like_original(df: DataFrame, report: str) -> DataFrame:
    """``df`` (the result of report function ``report``) in the original
    display order; unchanged if the original had none.  Columns that a report
    carries only for its order (``keep_order=True``, names starting with
    ``__order_``) are dropped afterwards."""
    spec = ORDER_BY.get(report)
    if report == "deposits_with_household" and "stazione" not in df.columns:
        spec = [("data", False), ("ora", True)]          # one station: days ascending
    if not spec:
        return df
    out = df.orderBy(*[pg_order(c, d) for c, d in spec if _column(c) in df.columns])
    return out.drop(*[c for c in df.columns if c.startswith("__order_")])
