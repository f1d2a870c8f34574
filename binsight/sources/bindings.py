"""Driver tables -> domain tables.

The reports work on the collection-domain schema (deposits, station events,
households, tags, stations ...).  The test/benchmark data are TPC-H-like
tables, so each domain table is *derived* from them by one SQL text that is
valid in both Spark SQL and DuckDB (the correctness oracle).  Keeping a single
text for both engines is what makes the oracle comparison meaningful: the only
thing that differs between the two sides is the report itself.

All derived tables grow with the scale factor of the input (they are
projections / joins of the fact tables), except the handful of small
dimensions that are fanned out from `nation`, `region` or `supplier`.

Domain model (column names as used by the reports):

  conferimenti       deposits, volume source (lineitem)
  conferimenti_seq   deposits with a unique increasing id (orders x customer)
  conferimenti_evt   deposits at event time (events of type purchase)
  conferimenti_coarse, conferimenti_seq_fewtags
                     the same facts with coarse values (few tags, whole days,
                     rounded weights) so that exact duplicates (R04) and
                     back-to-back repeats (R17) occur in the test data
  eventi             station events (events)
  infocomune         municipalities (nation)
  infostazioni, datistazione, alimentazione   stations (supplier, region)
  inforifiuti, infocassonetti                 waste types, bins
  datinuclei, associazionenuclei, infonuclei, utentiweb, datiform  households, tags
  logoperatore, infooperatori, logfalliti, logadmintesters,
  eventi_dense, conferimenti_dense, infocassonetti_dense
                     events, deposits and bins within a few hours (R19)
  infotesters, infoamministratori, cumulopesi, eventimanutenzione,
  infointerventi, stato, cal_svuotamenti, cal_logoperatore
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
                 "lineitem", "events")

# Waste type codes used by the deposit bindings and the waste-type dimension.
WASTE_CODES = (0, 1, 2, 3, 4, 5, 6, 7, 9, 15, 16, 17)


def _waste_code(row: str) -> str:
    """A waste code for a whole-number expression: all of them occur."""
    at = f"({row}) % {len(WASTE_CODES)}"
    return "CAST(CASE " + " ".join(f"WHEN {at} = {i} THEN {c}" for i, c in enumerate(WASTE_CODES)) + " END AS INT)"


def _household_code(key: str) -> str:
    """Every third household has a well-formed code."""
    return (f"CASE WHEN {key} % 3 = 0 THEN 'AB.' || lpad(CAST({key} % 10000 AS STRING), 4, '0') || '.' "
            f"|| lpad(CAST(CAST(floor({key} / 10000) AS BIGINT) AS STRING), 4, '0') ELSE 'N' || CAST({key} AS STRING) END")


def _tag_code(col: str) -> str:
    # 8-character codes for even keys, 7-character for odd ones, so the
    # tag-length check (R39) has both outcomes.
    return f"lpad(CAST({col} AS STRING), CAST(8 - {col} % 2 AS INT), '0')"


def _waste_name(col: str) -> str:
    return (f"CASE {col} WHEN 0 THEN 'INDIFFERENZIATO' WHEN 1 THEN 'CARTA' "
            f"WHEN 2 THEN 'VETRO E LATTINE' WHEN 3 THEN 'PLASTICA' WHEN 4 THEN 'ORGANICO' "
            f"WHEN 15 THEN 'VETRO' WHEN 16 THEN 'BARATTOLAME' WHEN 17 THEN 'PANNOLINI' "
            f"ELSE 'TIPO ' || CAST({col} AS STRING) END")


def _props_k(dialect: str) -> str:
    return "CAST(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS INT)"


def _explode(values: Iterable[int], dialect: str) -> str:
    vals = ", ".join(str(v) for v in values)
    if dialect == "spark":
        return f"explode(array({vals}))"
    return f"unnest([{vals}])"


def binding_sql(dialect: str = "spark") -> dict[str, str]:
    """Return {domain table: SQL over driver tables} for ``dialect``."""
    k = _props_k(dialect)
    return {
        "infocomune": "SELECT n_nationkey AS id, n_name AS nome FROM nation",
        # every 40th order's deposits were sent twice, under a second id
        "conferimenti": f"""
            SELECT l_orderkey * 16 + l_linenumber * 2 + again AS id,
                   CAST(l_suppkey % 5 + 1 AS INT) AS idcomune,
                   CAST(l_suppkey AS INT) AS codicestazione,
                   {_tag_code('l_partkey')} AS codicetag,
                   l_shipdate + INTERVAL 1 SECOND * ((l_orderkey * 7919 + l_linenumber * 3607) % 86400) AS dataora,
                   l_quantity - 1.0 AS peso,
                   {_waste_code('l_orderkey + l_linenumber')} AS tiporifiuto,
                   CAST(l_linenumber % 3 AS INT) AS codiceanomalia,
                   CAST(l_shipdate AS DATE) AS data,
                   CAST(l_linenumber AS INT) AS componenti
            FROM (SELECT *, {_explode((0, 1), dialect)} AS again FROM lineitem) l WHERE again = 0 OR l_orderkey % 40 = 0""",
        # every 25th deposit is repeated at once
        "conferimenti_seq": f"""
            SELECT o_orderkey * 2 + again AS id,
                   CAST(c_nationkey % 5 + 1 AS INT) AS idcomune,
                   CAST(o_orderkey % 4 AS INT) AS codicestazione,
                   CAST(o_custkey AS STRING) AS codicetag,
                   o_orderdate + INTERVAL 1 SECOND * (o_orderkey % 86400) AS dataora,
                   round(o_totalprice / 100000) AS peso,
                   CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS tiporifiuto,
                   CAST(o_orderkey % 2 AS INT) AS codiceanomalia,
                   CAST(o_orderdate AS DATE) AS data,
                   CAST(1 AS INT) AS componenti
            FROM (SELECT *, {_explode((0, 1), dialect)} AS again FROM orders) o JOIN customer ON o_custkey = c_custkey
            WHERE again = 0 OR o_orderkey % 25 = 0""",
        # Coarse variants: few tags, whole days and rounded weights, so exact
        # duplicates and back-to-back repeats occur in the test data.
        "conferimenti_coarse": f"""
            SELECT l_orderkey * 8 + l_linenumber AS id,
                   CAST(l_suppkey % 5 + 1 AS INT) AS idcomune,
                   CAST(l_suppkey % 10 AS INT) AS codicestazione,
                   {_tag_code('l_partkey % 20')} AS codicetag,
                   l_shipdate AS dataora,
                   round(l_quantity / 10) AS peso,
                   CAST(l_linenumber % 3 AS INT) AS tiporifiuto,
                   CAST(0 AS INT) AS codiceanomalia,
                   CAST(l_shipdate AS DATE) AS data,
                   CAST(1 AS INT) AS componenti
            FROM lineitem""",
        "conferimenti_seq_fewtags": """
            SELECT o_orderkey AS id,
                   CAST(c_nationkey % 5 + 1 AS INT) AS idcomune,
                   CAST(o_orderkey % 4 AS INT) AS codicestazione,
                   CAST(o_custkey % 3 AS STRING) AS codicetag,
                   o_orderdate + INTERVAL 1 SECOND * (o_orderkey % 86400) AS dataora,
                   round(o_totalprice / 100000) AS peso,
                   CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS tiporifiuto,
                   CAST(o_orderkey % 2 AS INT) AS codiceanomalia,
                   CAST(o_orderdate AS DATE) AS data,
                   CAST(1 AS INT) AS componenti
            FROM orders JOIN customer ON o_custkey = c_custkey""",
        "conferimenti_evt": f"""
            SELECT event_id AS id,
                   CAST(user_id % 5 + 1 AS INT) AS idcomune,
                   CAST(user_id AS INT) AS codicestazione,
                   CAST(user_id AS STRING) AS codicetag,
                   ts AS dataora,
                   value AS peso,
                   CAST({k} % 5 AS INT) AS tiporifiuto,
                   CAST(0 AS INT) AS codiceanomalia,
                   CAST(ts AS DATE) AS data,
                   CAST(1 AS INT) AS componenti
            FROM events WHERE event_type = 'purchase'""",
        "eventi": f"""
            SELECT event_id AS id,
                   CAST(user_id % 5 + 1 AS INT) AS idcomune,
                   CAST(user_id AS INT) AS idstazione,
                   CASE event_type WHEN 'error' THEN 'RESET'
                                   WHEN 'signup' THEN 'TENSIONE_RETE'
                                   WHEN 'click' THEN 'APERTURA'
                                   WHEN 'view' THEN 'CHIUSURA'
                                   ELSE CASE WHEN value >= 100 THEN 'ETICHETTE TERMINATE'
                                             ELSE 'ETICHETTE INCEPPATE' END END AS idevento,
                   ts AS dataora,
                   CASE WHEN event_type IN ('click', 'view') THEN CAST({k} % 4 AS STRING)
                        WHEN value >= 50 THEN 'ON' ELSE 'OFF' END AS note
            FROM events""",
        # the same events and deposits packed into a few hours and few stations, so
        # lid cycles fall within seconds (R19 with its own tolerances)
        "eventi_dense": f"""
            SELECT event_id AS id,
                   CAST(user_id % 2 + 1 AS INT) AS idcomune,
                   CAST(user_id % 6 AS INT) AS idstazione,
                   CASE WHEN event_type IN ('click', 'signup') THEN 'APERTURA' ELSE 'CHIUSURA' END AS idevento,
                   TIMESTAMP '2024-01-05 00:00:00' + INTERVAL 1 SECOND * (event_id * 37 % 80000) AS dataora,
                   CAST({k} % 4 AS STRING) AS note
            FROM events""",
        "conferimenti_dense": f"""
            SELECT event_id AS id,
                   CAST(user_id % 2 + 1 AS INT) AS idcomune,
                   CAST(user_id % 6 AS INT) AS codicestazione,
                   CAST(user_id AS STRING) AS codicetag,
                   TIMESTAMP '2024-01-05 00:00:00' + INTERVAL 1 SECOND * (event_id * 41 % 80000) AS dataora,
                   value AS peso,
                   CAST({k} % 5 AS INT) AS tiporifiuto,
                   CAST(0 AS INT) AS codiceanomalia,
                   CAST(ts AS DATE) AS data,
                   CAST(1 AS INT) AS componenti
            FROM events WHERE event_type = 'purchase'""",
        "infocassonetti_dense": f"""
            SELECT DISTINCT idcomune, codicestazione, tiporifiuto, CAST((tiporifiuto + codicestazione) % 4 AS SMALLINT) AS inputplc1
            FROM (SELECT CAST(s_suppkey % 2 + 1 AS INT) AS idcomune, CAST(s_suppkey % 6 AS INT) AS codicestazione,
                         {_explode((0, 1, 2, 3, 4), dialect)} AS tiporifiuto
                  FROM supplier) b""",
        "infostazioni": """
            SELECT CAST(s_suppkey % 5 + 1 AS INT) AS idcomune,
                   CAST(s_suppkey AS INT) AS codicestazione,
                   s_name AS nome,
                   CAST(s_nationkey % 5 AS INT) AS alimentazione,
                   CAST(s_nationkey AS STRING) AS latitudine,
                   CAST(s_suppkey AS STRING) AS longitudine
            FROM supplier""",
        "alimentazione": "SELECT r_regionkey AS id, r_name AS tipo FROM region",
        "datistazione": """
            SELECT CAST(s_suppkey % 5 + 1 AS INT) AS idcomune,
                   CAST(s_suppkey AS INT) AS idstazione,
                   CAST(s_suppkey * 37 % 1700 AS INT) AS numeroetichette,
                   CAST(500 + (s_nationkey % 3) * 250 AS INT) AS maxetichette,
                   CAST(s_suppkey % 2 AS INT) AS secondari,
                   CAST(s_suppkey % 3 % 2 AS INT) AS voltometer485,
                   CAST(s_nationkey % 2 AS INT) AS scontrini,
                   CAST(s_suppkey % 5 % 2 AS INT) AS gps,
                   CAST(s_suppkey % 7 % 2 AS INT) AS sbarra,
                   'v' || CAST(s_nationkey % 4 AS STRING) AS versione,
                   '10.8.' || CAST(s_suppkey % 250 AS STRING) || '.1' AS ipvpn,
                   'PLC-' || CAST(s_nationkey AS STRING) AS controllerplc,
                   'R' || CAST(s_suppkey % 3 AS STRING) AS router,
                   'P' || CAST(s_suppkey % 4 AS STRING) AS stampante,
                   'V' || CAST(s_suppkey % 2 AS STRING) AS visore,
                   'D' || CAST(s_suppkey % 5 AS STRING) AS dvr
            FROM supplier""",
        "inforifiuti": f"""
            SELECT idcomune, codicerifiuto, {_waste_name('codicerifiuto')} AS descrizione
            FROM (SELECT n_nationkey AS idcomune, {_explode(WASTE_CODES, dialect)} AS codicerifiuto
                  FROM nation) w""",
        "infocassonetti": f"""
            SELECT idcomune, codicestazione, tiporifiuto,
                   CAST((tiporifiuto + codicestazione) % 4 AS SMALLINT) AS inputplc1
            FROM (SELECT CAST(s_suppkey % 5 + 1 AS INT) AS idcomune,
                         CAST(s_suppkey AS INT) AS codicestazione,
                         {_explode((0, 1, 2, 3, 4), dialect)} AS tiporifiuto
                  FROM supplier) b""",
        "datinuclei": f"""
            SELECT c_custkey AS id,
                   CAST(c_nationkey % 5 + 1 AS INT) AS idcomune,
                   {_household_code('c_custkey')} AS codicenucleo,
                   c_name AS nome,
                   c_mktsegment AS cognome,
                   'VIA ' || c_mktsegment || ' ' || CAST(c_custkey % 97 AS STRING) AS indirizzo,
                   'VIA ' || c_mktsegment || ' ' || CAST(c_custkey % 89 AS STRING) AS indirizzoutenza,
                   CASE WHEN c_custkey % 7 = 0 THEN '0' ELSE '071' || CAST(c_custkey AS STRING) END AS telefono,
                   CASE WHEN c_custkey % 5 = 0 THEN '0' ELSE '333' || CAST(c_custkey AS STRING) END AS cellulare,
                   CASE WHEN c_custkey % 3 = 0 THEN '@'
                        ELSE lower(c_mktsegment) || CAST(c_custkey AS STRING) || '@mail.test' END AS mail,
                   upper(substr(c_mktsegment, 1, 3)) || upper(substr(c_mktsegment, 4, 3))
                     || lpad(CAST(c_custkey % 100 AS STRING), 2, '0') || 'A'
                     || lpad(CAST(c_nationkey AS STRING), 2, '0') || 'XYZ'
                     || CASE WHEN c_custkey % 4 = 0 THEN '1' ELSE 'W' END AS codicefiscale,
                   c_mktsegment AS tiponucleo,
                   CAST(c_custkey % 5 + 1 AS INT) AS ncomponenti
            FROM customer""",
        "associazionenuclei": f"""
            SELECT p_partkey AS id,
                   CAST(c_nationkey % 5 + 1 AS INT) AS idcomune,
                   {_household_code('c_custkey')} AS codicenucleo,
                   {_tag_code('p_partkey')} AS codicetag,
                   p_type AS info,
                   p_size AS progressivo
            FROM part JOIN customer ON c_custkey = CAST(floor(p_partkey * 3 / 4) AS BIGINT)
            WHERE p_brand <> 'Brand#2'""",
        "infonuclei": f"""
            SELECT p_partkey AS id,
                   CAST(c_nationkey % 5 + 1 AS INT) AS idcomune,
                   {_tag_code('p_partkey')} AS codicetag,
                   CASE WHEN p_brand = 'Brand#2' AND p_size % 2 = 0 THEN NULL ELSE c_custkey END AS idnucleo,
                   p_size AS progressivo,
                   p_size % 2 = 0 AS attivata
            FROM part JOIN customer ON c_custkey = CAST(floor(p_partkey * 3 / 4) AS BIGINT)""",
        "utentiweb": """
            SELECT c_custkey AS id,
                   lower(c_mktsegment) || CAST(c_custkey % 50 AS STRING) AS username,
                   CAST(c_nationkey % 5 AS INT) AS usertype,
                   c_custkey AS idnucleo,
                   c_acctbal > 0 AS attivato,
                   o.last_order AS ultimoaccesso
            FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_order
                                     FROM orders GROUP BY o_custkey) o ON o.o_custkey = c_custkey""",
        "datiform": f"""
            SELECT CAST(c_nationkey % 5 + 1 AS INT) AS idcomune,
                   {_household_code('c_custkey')} AS codicenucleo,
                   c_mktsegment AS lotto
            FROM customer WHERE c_acctbal > 1000""",
        "logoperatore": """
            SELECT CAST(user_id % 5 + 1 AS INT) AS idcomune,
                   CAST(user_id AS INT) AS codicestazione,
                   CAST(event_id % 150 AS STRING) AS codicetag,
                   ts AS dataora,
                   CASE event_type WHEN 'signup' THEN 'login operatore'
                                   WHEN 'error' THEN 'timeout sessione'
                                   WHEN 'view' THEN 'logout'
                                   ELSE event_type || ' ' || props END AS info
            FROM events""",
        "infooperatori": "SELECT CAST(s_suppkey AS STRING) AS codicetag, s_name AS nome FROM supplier",
        "logfalliti": """
            SELECT CAST(user_id % 5 + 1 AS INT) AS idcomune, CAST(user_id AS INT) AS idstazione,
                   CAST(event_id AS STRING) AS codicetag, ts AS dataora
            FROM events WHERE event_type = 'error'""",
        "logadmintesters": """
            SELECT CAST(user_id % 5 + 1 AS INT) AS idcomune, CAST(user_id AS INT) AS codicestazione,
                   CAST(user_id % 40 AS STRING) AS codicetag, event_type AS tipologiautente, ts AS dataora
            FROM events WHERE event_type IN ('signup', 'click')""",
        "infotesters": "SELECT CAST(s_suppkey AS STRING) AS codicetag, s_name AS nome FROM supplier",
        # tags 0..24 are both tester and administrator tags (people holding both roles)
        "infoamministratori": "SELECT CAST(n_nationkey AS STRING) AS codicetag, n_name AS nome FROM nation",
        "cumulopesi": f"""
            SELECT CAST(l_suppkey % 5 + 1 AS INT) AS idcomune,
                   CAST(l_suppkey AS INT) AS codicestazione,
                   CAST(l_linenumber - 1 AS INT) AS idrifiuto,
                   {_waste_name('(l_linenumber - 1)')} AS nomerifiuto,
                   l_quantity AS peso,
                   CAST(l_linenumber AS INT) AS numerosacchetti,
                   CAST(l_partkey % 3 AS INT) AS idbidone,
                   l_shipdate AS dataora
            FROM lineitem""",
        "eventimanutenzione": """
            SELECT o_orderkey AS id,
                   CAST(o_custkey % 100 % 5 + 1 AS INT) AS idcomune,
                   CAST(o_custkey % 100 AS INT) AS codicestazione,
                   o_orderdate AS dataoraproblema,
                   CAST(o_orderkey % 5 AS INT) AS codiceproblema,
                   o_orderpriority AS descrizione,
                   CAST(o_orderkey % 3 AS INT) AS stato,
                   o_orderstatus AS commento1,
                   CASE WHEN o_orderstatus = 'F' THEN 'risolto' END AS commento2,
                   CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS dataorarisoluzione,
                   'squadra ' || CAST(o_orderkey % 4 AS STRING) AS manutentore,
                   CAST(o_custkey AS STRING) AS utente
            FROM orders""",
        "infointerventi": "SELECT r_regionkey AS id, upper(substr(r_name, 1, 3)) AS sigla, r_name AS descrizione FROM region",
        "stato": "SELECT id, stato FROM (VALUES (0, 'aperto'), (1, 'in lavorazione'), (2, 'chiuso')) AS s(id, stato)",
        "cal_svuotamenti": """
            SELECT CAST(user_id % 5 + 1 AS INT) AS idcomune, CAST(user_id AS INT) AS codicestazione,
                   ts AS dataora, CAST(event_id AS STRING) AS codicetag
            FROM events WHERE event_type = 'view'""",
        "cal_logoperatore": """
            SELECT CAST(user_id % 5 + 1 AS INT) AS idcomune, CAST(user_id AS INT) AS codicestazione,
                   CAST(event_id % 150 AS STRING) AS codicetag, ts AS dataora, event_type AS info
            FROM events WHERE event_type IN ('view', 'click')""",
    }


class Tables(dict):
    """Name -> DataFrame mapping handed to every report.

    ``Tables.from_catalog(spark, names)`` wraps tables already registered in
    the session catalog (the production case); ``bind_driver_tables`` builds
    the domain tables from the driver's parquet files (tests, benchmarks).
    """

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self[name]
        except KeyError as exc:
            raise AttributeError(name) from exc

    @classmethod
    def from_catalog(cls, spark: SparkSession, names: Iterable[str]) -> "Tables":
        return cls({n: spark.table(n) for n in names})


def driver_sql(sf_dir: str, body: str) -> str:
    """``body`` over the driver's files of one folder.  The files are named in the
    text itself, so no view of the session can be mistaken for them."""
    used = [n for n in DRIVER_TABLES if re.search(rf"\b{n}\b", body)]
    if not used:
        return body
    return "WITH " + ",\n".join(f"{n} AS (SELECT * FROM parquet.`{sf_dir}/{n}.parquet`)" for n in used) + "\n" + body


class _LazyTables(Tables):
    """Domain tables built on first access (only what a report touches is parsed)."""

    def __init__(self, spark: SparkSession, sql: dict[str, str]):
        super().__init__()
        self._spark, self._sql = spark, sql

    def __missing__(self, name: str) -> DataFrame:
        if name not in self._sql:
            raise KeyError(name)
        df = self._spark.sql(self._sql[name])
        self[name] = df
        return df

    def __iter__(self):
        return iter(self._sql)

    def keys(self):
        return self._sql.keys()

    def items(self):
        return [(n, self[n]) for n in self._sql]

    def __contains__(self, name) -> bool:
        return name in self._sql


def bind_driver_tables(spark: SparkSession, sf_dir: str,
                       names: Iterable[str] | None = None) -> Tables:
    """Domain tables over the driver parquet files (lazy; nothing is read)."""
    sql = {n: driver_sql(sf_dir, body) for n, body in binding_sql("spark").items()}
    if names is not None:
        sql = {n: sql[n] for n in names}
    return _LazyTables(spark, sql)


def duckdb_with_clause(names: Iterable[str]) -> str:
    """``WITH`` prefix defining the named domain tables for the DuckDB oracle."""
    sql = binding_sql("duckdb")
    parts = [f"{n} AS ({sql[n].strip()})" for n in names]
    return "WITH " + ",\n".join(parts) + "\n"
