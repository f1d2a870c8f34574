"""Registered queries (one per report) and their DuckDB oracle SQL.

Every entry binds the driver tables to the domain tables (the same SQL text
on both sides, see :mod:`binsight.sources.bindings`), runs one report with
fixed parameters over the whole tables, and has an oracle written directly in
SQL from the report's definition.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binsight.functions.pg import WEEKDAYS_ACCENTED, WEEKDAYS_PLAIN, WEEKDAYS_SHORT
from binsight.plans import deposits as D
from binsight.plans import events as E
from binsight.plans import households as H
from binsight.plans import stations as S
from binsight.operators import filters as FI
from binsight.operators import quality as Q
from binsight.operators import sequence as SQ
from binsight.operators import totals as T
from binsight.operators.asof import asof_join
from binsight.operators.repair import clock_repair
from binsight.operators.sink import read_ordered_rows, write_ordered_rows_json
from binsight.plans.display import pg_order
from binsight.sources.bindings import Tables, bind_driver_tables, duckdb_with_clause

# Parameters of the registered queries (chosen for the driver tables' time ranges).
C = 1                                   # municipality
EV = ("2024-01-05", "2024-01-20")       # event period (events span 2024-01)
DEP = ("1997-01-01", "1997-03-31")      # deposit period (lineitem ship dates 1995-2001)
YEAR = ("1997-01-01", "1997-12-31")
STATION_EV = 5                          # an event station of municipality 1
STATION_DEP = 5                         # a deposit station of municipality 1


def _tables(spark: SparkSession, sf_dir: str) -> Tables:
    return bind_driver_tables(spark, sf_dir)


def _wd(labels) -> str:
    """DuckDB weekday label expression builder (Sunday first, 1-based list)."""
    arr = "[" + ", ".join(f"'{x}'" for x in labels) + "]"
    return lambda e: f"{arr}[dayofweek({e}) + 1]"


WD_ACC, WD_PLAIN, WD_SHORT = _wd(WEEKDAYS_ACCENTED), _wd(WEEKDAYS_PLAIN), _wd(WEEKDAYS_SHORT)


def _days(col: str, a: str, b: str) -> str:
    return f"CAST({col} AS DATE) BETWEEN DATE '{a}' AND DATE '{b}'"


def _inst(col: str, a: str, b: str) -> str:
    return f"{col} BETWEEN TIMESTAMP '{a} 00:00:00' AND TIMESTAMP '{b} 00:00:00'"


def _sql(names, body: str) -> str:
    """Oracle text: binding CTEs for ``names`` then ``body`` (which may start
    with further ``, name AS (...)`` CTEs)."""
    return duckdb_with_clause(names) + body


def _cat_sums(val: str = "peso", cat: str = "tiporifiuto", mapping=None, else0: bool = False) -> str:
    from binsight.operators.totals import CATEGORY_COLUMNS
    mapping = mapping or CATEGORY_COLUMNS
    e = " ELSE 0" if else0 else ""
    return ", ".join(f"sum(CASE WHEN {cat} = {k} THEN {val}{e} END) AS {n}" for k, n in mapping.items())


RESTART = "(idevento LIKE '%AVVIO%' OR idevento LIKE '%RESET%')"
NIGHT_R = "CAST(dataora AS TIME) NOT BETWEEN TIME '02:59:59' AND TIME '04:00:00'"


# ---------------------------------------------------------------------------------------------
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Record the oracle SQL (if any) now; the returned decorator records the query."""
    if sql is not None:
        ORACLE[name] = sql

    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


class _Swapped(Tables):
    def __init__(self, base: Tables, alias: dict[str, str]):
        super().__init__()
        self._base, self._alias = base, alias

    def __missing__(self, name):
        return self._base[self._alias.get(name, name)]


def _deposits_from(t: Tables, name: str) -> Tables:
    """The same tables with ``conferimenti`` taken from another deposit binding."""
    return _Swapped(t, {"conferimenti": name})


register("r01_restarts", _sql(["eventi", "infocomune"], f""",
ev AS (SELECT * FROM eventi WHERE {RESTART} AND idcomune = {C} AND {_days('dataora', *EV)} AND {NIGHT_R}),
l AS (SELECT *, lag(dataora) OVER (PARTITION BY idcomune, idstazione ORDER BY dataora, id) AS ultimadata FROM ev)
SELECT concat(i.nome, ' ', CAST(l.idstazione AS VARCHAR)) AS nomestazione,
       CAST(count(CASE WHEN ultimadata IS NULL OR dataora > ultimadata + INTERVAL 30 SECOND THEN 1 END) AS BIGINT) AS riavvii
FROM l JOIN infocomune i ON i.id = l.idcomune GROUP BY 1"""))(
    lambda s, d: E.restarts(_tables(s, d), C, *EV))

register("r01_restarts_literal", _sql(["eventi", "infocomune"], f""",
ev AS (SELECT * FROM eventi WHERE {RESTART} AND idcomune = {C} AND {_days('dataora', *EV)} AND {NIGHT_R})
SELECT concat(i.nome, ' ', CAST(ev.idstazione AS VARCHAR)) AS nomestazione, CAST(count(*) AS BIGINT) AS riavvii
FROM ev JOIN infocomune i ON i.id = ev.idcomune GROUP BY 1"""))(
    lambda s, d: E.restarts(_tables(s, d), C, *EV, literal=True))

register("r02_station_restart_history", _sql(["eventi"], f"""
SELECT DISTINCT note AS numeroevento, idevento AS tipoevento, dataora AS data FROM eventi
WHERE {RESTART} AND idcomune = {C} AND idstazione = {STATION_EV} AND {_days('dataora', *EV)} AND {NIGHT_R}"""))(
    lambda s, d: E.station_restart_history(_tables(s, d), C, STATION_EV, *EV))

register("r03_emptying_calendar", _sql(["cal_svuotamenti"], "SELECT * FROM cal_svuotamenti"))(
    lambda s, d: E.emptying_calendar(_tables(s, d)))

register("r04_duplicate_deposits", _sql(["conferimenti", "infocomune"], """
SELECT DISTINCT i.nome, d.codicestazione, d.codicetag, d.dataora, d.peso, d.stringaid, d.conteggio FROM (
  SELECT idcomune, codicestazione, codicetag, dataora, peso, tiporifiuto,
         string_agg(CAST(id AS VARCHAR), ' ' ORDER BY id) AS stringaid, count(id) AS conteggio
  FROM conferimenti WHERE dataora >= TIMESTAMP '1995-01-01 00:00:00'
  GROUP BY idcomune, codicestazione, codicetag, dataora, peso, tiporifiuto HAVING count(id) > 1) d
JOIN infocomune i ON i.id = d.idcomune"""))(
    lambda s, d: D.duplicate_deposits(_tables(s, d), "1995-01-01"))

register("r04_duplicate_deposits_coarse", _sql(["conferimenti_coarse", "infocomune"], """
SELECT DISTINCT i.nome, d.codicestazione, d.codicetag, d.dataora, d.peso, d.stringaid, d.conteggio FROM (
  SELECT idcomune, codicestazione, codicetag, dataora, peso, tiporifiuto,
         string_agg(CAST(id AS VARCHAR), ' ' ORDER BY id) AS stringaid, count(id) AS conteggio
  FROM conferimenti_coarse WHERE dataora >= TIMESTAMP '1995-01-01 00:00:00'
  GROUP BY idcomune, codicestazione, codicetag, dataora, peso, tiporifiuto HAVING count(id) > 1) d
JOIN infocomune i ON i.id = d.idcomune"""))(
    lambda s, d: D.duplicate_deposits(_deposits_from(_tables(s, d), "conferimenti_coarse"), "1995-01-01"))

register("r05_stuck_weights", _sql(["conferimenti_seq", "infocomune"], """,
l AS (SELECT idcomune, codicestazione, peso, dataora,
             lag(peso) OVER (PARTITION BY idcomune, codicestazione ORDER BY dataora, id) AS pp FROM conferimenti_seq)
SELECT concat(i.nome, ' ', CAST(l.codicestazione AS VARCHAR)) AS identificativo, l.peso,
       count(DISTINCT l.dataora) AS numeroconferimenti, max(l.dataora) AS ultimodato
FROM l JOIN infocomune i ON i.id = l.idcomune
WHERE l.dataora >= TIMESTAMP '1997-12-30 00:00:00' AND l.peso = l.pp
GROUP BY l.idcomune, i.nome, l.codicestazione, l.peso HAVING count(DISTINCT l.dataora) > 3"""))(
    lambda s, d: D.stuck_weights(_deposits_from(_tables(s, d), "conferimenti_seq"), "1998-01-01"))

register("r05_stuck_weights_literal", _sql(["conferimenti_seq", "infocomune"], """,
l AS (SELECT idcomune, codicestazione, peso, dataora,
             lag(peso) OVER (ORDER BY idcomune, codicestazione, dataora, id) AS pp FROM conferimenti_seq)
SELECT concat(i.nome, ' ', CAST(l.codicestazione AS VARCHAR)) AS identificativo, l.peso,
       count(DISTINCT l.dataora) AS numeroconferimenti, max(l.dataora) AS ultimodato
FROM l JOIN infocomune i ON i.id = l.idcomune
WHERE l.dataora >= TIMESTAMP '1997-12-30 00:00:00' AND l.peso = l.pp
GROUP BY l.idcomune, i.nome, l.codicestazione, l.peso HAVING count(DISTINCT l.dataora) > 3"""))(
    lambda s, d: D.stuck_weights(_deposits_from(_tables(s, d), "conferimenti_seq"), "1998-01-01", literal=True))

register("r06_deposit_crosstab", _sql(["conferimenti"], "SELECT idcomune, codicestazione, " + ", ".join(
    f"sum(CASE WHEN tiporifiuto = {k} THEN peso END) AS t{k}" for k in (0, 1, 2, 3, 4, 15, 16, 17)) +
    ", sum(CASE WHEN coalesce(tiporifiuto IN (0, 1, 2, 3, 4, 15, 16, 17), false) THEN NULL ELSE peso END) AS altri"
    " FROM conferimenti GROUP BY idcomune, codicestazione"))(
    lambda s, d: D.deposit_crosstab(_tables(s, d), codes=(0, 1, 2, 3, 4, 15, 16, 17)))

register("r07_label_alarms", _sql(["eventi", "infocomune"], f""",
l AS (SELECT *, lag(dataora) OVER (ORDER BY dataora, id) AS ultimadata FROM eventi
      WHERE idevento LIKE '%ETICHETTE%' AND dataora BETWEEN TIMESTAMP '{EV[0]} 00:00:00' AND TIMESTAMP '2024-01-21 00:00:00'),
per AS (SELECT idcomune, idstazione, ultimadata,
               count(CASE WHEN idevento = 'ETICHETTE TERMINATE' THEN 1 END) AS terminate,
               count(CASE WHEN idevento = 'ETICHETTE INCEPPATE' THEN 1 END) AS inceppate
        FROM l WHERE ultimadata IS NOT NULL AND idevento ILIKE '%etichette%' GROUP BY idcomune, idstazione, ultimadata)
SELECT i.nome, per.idstazione,
       CASE WHEN sum(terminate) > sum(inceppate) THEN 'ETICHETTE TERMINATE' ELSE 'ETICHETTE INCEPPATE' END AS avviso,
       CAST(CASE WHEN sum(terminate) > sum(inceppate) THEN sum(terminate) ELSE sum(inceppate) END AS BIGINT) AS segnalazioni,
       concat({WD_ACC('max(CAST(ultimadata AS DATE))')}, ' ', CAST(max(CAST(ultimadata AS DATE)) AS VARCHAR)) AS ultimoinvio
FROM per JOIN infocomune i ON i.id = per.idcomune GROUP BY i.nome, per.idstazione"""))(
    lambda s, d: E.label_alarms(_tables(s, d), *EV))

register("r07_label_alarms_literal", _sql(["eventi", "infocomune"], f""",
l AS (SELECT *, lag(dataora) OVER (ORDER BY dataora, id) AS ultimadata FROM eventi
      WHERE idevento LIKE '%ETICHETTE%' AND dataora BETWEEN TIMESTAMP '{EV[0]} 00:00:00' AND TIMESTAMP '2024-01-21 00:00:00'),
per AS (SELECT idcomune, idstazione, ultimadata,
               count(CASE WHEN idevento = 'ETICHETTE TERMINATE' THEN 1 END) AS terminate,
               count(CASE WHEN idevento = 'ETICHETTE INCEPPATE' THEN 1 END) AS inceppate
        FROM l WHERE ultimadata IS NOT NULL AND idevento ILIKE '%etichette%' GROUP BY idcomune, idstazione, ultimadata)
SELECT i.nome, per.idstazione,
       CASE WHEN count(terminate) > count(inceppate) THEN 'ETICHETTE TERMINATE' ELSE 'ETICHETTE INCEPPATE' END AS avviso,
       CAST(CASE WHEN count(terminate) > count(inceppate) THEN sum(terminate) ELSE sum(inceppate) END AS BIGINT) AS segnalazioni,
       concat({WD_ACC('max(CAST(ultimadata AS DATE))')}, ' ', CAST(max(CAST(ultimadata AS DATE)) AS VARCHAR)) AS ultimoinvio
FROM per JOIN infocomune i ON i.id = per.idcomune GROUP BY i.nome, per.idstazione"""))(
    lambda s, d: E.label_alarms(_tables(s, d), *EV, literal=True))

register("r08_power_changes", _sql(["eventi", "infostazioni", "infocomune"], f""",
e AS (SELECT DISTINCT e.idcomune, e.idstazione, e.idevento, e.note, e.dataora FROM eventi e
      WHERE e.idevento LIKE '%TENSIONE_RETE%' AND e.idcomune = {C} AND {_days('e.dataora', *EV)}
        AND CAST(e.dataora AS TIME) NOT BETWEEN TIME '02:50:00' AND TIME '03:50:00'
        AND EXISTS (SELECT 1 FROM infostazioni s WHERE s.idcomune = e.idcomune AND s.codicestazione = e.idstazione)),
l AS (SELECT *, concat(idevento, ' ', note) AS evento,
             concat(idevento, ' ', lag(note) OVER (PARTITION BY idcomune, idstazione ORDER BY dataora, note, idevento)) AS evento2 FROM e)
SELECT DISTINCT i.nome, l.idstazione AS stazione, l.evento, {WD_ACC('l.dataora')} AS giorno, l.dataora AS orario
FROM l JOIN infocomune i ON i.id = l.idcomune WHERE l.evento <> l.evento2"""))(
    lambda s, d: E.power_changes(_tables(s, d), C, *EV))

register("r08_power_changes_literal", _sql(["eventi", "infostazioni", "infocomune"], f""",
e AS (SELECT DISTINCT e.idcomune, e.idstazione, e.idevento, e.note, e.dataora FROM eventi e
      WHERE e.idevento LIKE '%TENSIONE_RETE%' AND e.idcomune = {C} AND {_days('e.dataora', *EV)}
        AND CAST(e.dataora AS TIME) NOT BETWEEN TIME '02:50:00' AND TIME '03:50:00'
        AND EXISTS (SELECT 1 FROM infostazioni s WHERE s.idcomune = e.idcomune AND s.codicestazione = e.idstazione)),
l AS (SELECT *, concat(idevento, ' ', note) AS evento,
             concat(idevento, ' ', lag(note) OVER (ORDER BY idstazione, dataora, note, idevento)) AS evento2 FROM e)
SELECT DISTINCT i.nome, l.idstazione AS stazione, l.evento, {WD_ACC('l.dataora')} AS giorno, l.dataora AS orario
FROM l JOIN infocomune i ON i.id = l.idcomune WHERE l.evento <> l.evento2"""))(
    lambda s, d: E.power_changes(_tables(s, d), C, *EV, literal=True))

register("r09_power_changes_asof", _sql(["eventi"], f""",
istanti AS (SELECT idcomune, idstazione, dataora, arg_max(note, id) AS nota FROM eventi WHERE idcomune = {C} GROUP BY ALL),
precedenti AS (SELECT idcomune, idstazione, dataora, lag(nota) OVER (PARTITION BY idcomune, idstazione ORDER BY dataora) AS prima
               FROM istanti)
SELECT idevento, dataora, idstazione, note FROM eventi JOIN precedenti USING (idcomune, idstazione, dataora)
WHERE idevento = 'TENSIONE_RETE' AND note <> prima AND {_days('dataora', *EV)}"""))(
    lambda s, d: E.power_changes_asof(_tables(s, d), C, *EV))

register("r10_households_without_form", _sql(["datinuclei", "datiform"], f"""
SELECT DISTINCT codicenucleo FROM datinuclei WHERE idcomune = {C}
  AND codicenucleo NOT IN (SELECT DISTINCT codicenucleo FROM datiform WHERE idcomune = {C})"""))(
    lambda s, d: H.households_without_form(_tables(s, d), C))


def _form_with_null(t: Tables) -> DataFrame:
    return t.datiform.withColumn("codicenucleo", F.when(F.col("lotto") != "AUTOMOBILE", F.col("codicenucleo")))


register("r10_households_without_form_nullkey", _sql(["datinuclei", "datiform"], f""",
df2 AS (SELECT idcomune, CASE WHEN lotto <> 'AUTOMOBILE' THEN codicenucleo END AS codicenucleo, lotto FROM datiform)
SELECT DISTINCT codicenucleo FROM datinuclei WHERE idcomune = {C}
  AND codicenucleo NOT IN (SELECT DISTINCT codicenucleo FROM df2 WHERE idcomune = {C})"""))(
    lambda s, d: H.households_without_form(_tables(s, d), C, form=_form_with_null(_tables(s, d))))

register("r11_silent_stations", _sql(["eventi"], """
SELECT idcomune, idstazione, note AS stato, max(dataora) AS ultimavolta FROM eventi a
WHERE idcomune > 0 AND idcomune < 7 AND idevento = 'TENSIONE_RETE'
  AND NOT EXISTS (SELECT 1 FROM eventi b WHERE CAST(b.dataora AS DATE) BETWEEN DATE '2024-01-30' AND DATE '2024-01-30'
                  AND b.idcomune = a.idcomune AND b.idstazione = a.idstazione)
GROUP BY idcomune, idstazione, note"""))(
    lambda s, d: E.silent_stations(_tables(s, d), "2024-01-30", "2024-01-30", municipalities=range(1, 7)))

register("r12_battery_phases", _sql(["eventi", "infocomune"], f""",
e AS (SELECT * FROM eventi WHERE idcomune = {C} AND idstazione = {STATION_EV}
      AND (idevento LIKE '%TENSIONE_RETE%' OR idevento LIKE '%AVVIO%')),
l AS (SELECT *, lag(concat(idevento, ' ', note)) OVER (ORDER BY dataora, id) AS evento2,
             lag(dataora) OVER (ORDER BY dataora, id) AS ultimadata FROM e),
x AS (SELECT DISTINCT idcomune, idstazione, dataora AS data, concat(idevento, ' ', note) AS evento FROM l
      WHERE idevento LIKE '%TENSIONE_RETE%' AND NOT (dataora BETWEEN ultimadata AND ultimadata + INTERVAL 50 SECOND)
        AND concat(idevento, ' ', note) <> evento2 AND CAST(dataora AS VARCHAR) NOT LIKE '%2016-10%'),
y AS (SELECT *, lag(data) OVER (ORDER BY data, evento) AS prev, row_number() OVER (ORDER BY data, evento) AS rn FROM x)
SELECT i.nome, y.idstazione, {WD_PLAIN('y.data')} AS giorno,
       CASE y.evento WHEN 'TENSIONE_RETE OFF' THEN concat(CAST((date_diff('second', prev, data) // 3600) % 24 AS VARCHAR), ' ORE DI CARICA')
                     WHEN 'TENSIONE_RETE ON' THEN concat(CAST((date_diff('second', prev, data) // 3600) % 24 AS VARCHAR), ' ORE DI SCARICA') END AS batteria,
       CAST(CASE WHEN y.evento = 'TENSIONE_RETE ON' THEN rn - rn // 2 END AS BIGINT) AS ciclo, CAST(y.data AS DATE) AS data
FROM y JOIN infocomune i ON i.id = y.idcomune"""))(
    lambda s, d: E.battery_phases(_tables(s, d), C, STATION_EV, skip_month="2016-10"))

_OPLOG = f"""
SELECT i.nome, l.codicestazione AS stazione, {WD_ACC('l.dataora')} AS giorno, l.dataora AS data, o.codicetag,
       o.nome AS operatore, l.info
FROM logoperatore l JOIN infocomune i ON i.id = l.idcomune LEFT JOIN infooperatori o ON o.codicetag = l.codicetag
WHERE l.idcomune = {C} AND {_inst('l.dataora', *EV)}"""
register("r13_operator_log", _sql(["logoperatore", "infocomune", "infooperatori"], _OPLOG))(
    lambda s, d: E.operator_log(_tables(s, d), C, *EV))
register("r14_operator_log_filtered", _sql(["logoperatore", "infocomune", "infooperatori"], _OPLOG +
         " AND l.info NOT LIKE '%timeout%' AND l.info NOT LIKE '%logout%' AND l.info NOT LIKE '%login%'"))(
    lambda s, d: E.operator_log_filtered(_tables(s, d), C, *EV))

register("r15_deposit_listing", _sql(["conferimenti", "infocomune", "inforifiuti"], f"""
SELECT DISTINCT i.nome AS comune, c.codicestazione AS stazione, c.codicetag,
       {WD_PLAIN('c.dataora')} || ' ' || strftime(c.dataora, ' %Y-%m-%d %H:%M:%S') AS data,
       c.peso, c.tiporifiuto, r.descrizione, c.codiceanomalia
FROM conferimenti c JOIN infocomune i ON i.id = c.idcomune
JOIN inforifiuti r ON r.codicerifiuto = c.tiporifiuto AND r.idcomune = c.idcomune
WHERE c.idcomune = {C} AND {_days('c.dataora', *DEP)}"""))(
    lambda s, d: D.deposit_listing(_tables(s, d), C, *DEP))

register("r15_deposit_listing_literal", _sql(["conferimenti", "infocomune", "inforifiuti"], f"""
SELECT DISTINCT i.nome AS comune, c.codicestazione AS stazione, c.codicetag,
       {WD_PLAIN('c.dataora')} || ' ' || strftime(c.dataora, ' %Y-%m-%d %H:%m:%S') AS data,
       c.peso, c.tiporifiuto, r.descrizione, c.codiceanomalia
FROM conferimenti c JOIN infocomune i ON i.id = c.idcomune
JOIN inforifiuti r ON r.codicerifiuto = c.tiporifiuto AND r.idcomune = c.idcomune
WHERE c.idcomune = {C} AND {_days('c.dataora', *DEP)}"""))(
    lambda s, d: D.deposit_listing(_tables(s, d), C, *DEP, literal=True))

register("r16_failed_reads", _sql(["logfalliti", "infocomune"], f"""
SELECT i.nome AS comune, f.idstazione AS numerostazione, f.codicetag, count(f.codicetag) AS numerofallimenti,
       max(f.dataora) AS ultimodatoricevuto
FROM logfalliti f LEFT JOIN infocomune i ON i.id = f.idcomune
WHERE f.idcomune = {C} AND f.dataora >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY i.nome, f.idstazione, f.codicetag"""))(
    lambda s, d: E.failed_reads(_tables(s, d), C, "2024-01-10"))

register("r16_failed_reads_text", _sql(["logfalliti", "infocomune"], f"""
SELECT i.nome AS comune, f.idstazione AS numerostazione, count(f.codicetag) AS numerofallimenti,
       string_agg(f.codicetag, ' ' ORDER BY f.codicetag) AS letturefallite, max(f.dataora) AS ultimodatoricevuto
FROM logfalliti f LEFT JOIN infocomune i ON i.id = f.idcomune
WHERE f.idcomune = {C} AND f.dataora >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY i.nome, f.idstazione"""))(
    lambda s, d: E.failed_reads(_tables(s, d), C, "2024-01-10", as_text=True))

register("r16_failed_reads_chunks", _sql(["logfalliti", "infocomune"], f""",
r AS (SELECT i.nome AS comune, f.idstazione AS st, CAST(f.codicetag AS VARCHAR) AS tag, row_number() OVER (PARTITION BY f.idstazione, f.codicetag) - 1 AS k
      FROM logfalliti f LEFT JOIN infocomune i ON i.id = f.idcomune
      WHERE f.idcomune = {C} AND f.dataora >= TIMESTAMP '2024-01-10 00:00:00' AND f.codicetag IS NOT NULL),
b AS (SELECT comune, st, tag, k // greatest(64 // (length(tag) + 1), 1) AS piece FROM r),
p AS (SELECT comune, st, tag, piece, count(*) AS n, sum(length(tag) + 1) AS size FROM b GROUP BY comune, st, tag, piece),
l AS (SELECT *, sum(size) OVER (PARTITION BY comune, st ORDER BY tag, piece) - size AS begins FROM p)
SELECT comune, st AS numerostazione, CAST(begins // 64 AS BIGINT) AS parte, CAST(sum(n) AS BIGINT) AS letture,
       string_agg(rtrim(repeat(tag || ' ', n)), ' ' ORDER BY tag, piece) AS letturefallite
FROM l GROUP BY comune, st, begins // 64"""))(
    lambda s, d: E.failed_reads_chunks(_tables(s, d), C, "2024-01-10", limit=64))

register("r17_repeat_deposits", _sql(["conferimenti_seq"], f""",
l AS (SELECT codicetag, lag(codicetag) OVER w AS codicep, codiceanomalia, dataora, idcomune, codicestazione,
             peso - lag(peso) OVER w AS pesop, tiporifiuto, tiporifiuto - lag(tiporifiuto) OVER w AS flag
      FROM conferimenti_seq WHERE dataora > TIMESTAMP '1995-01-01 00:00:00' WINDOW w AS (ORDER BY dataora, id))
SELECT codicetag, CAST(dataora AS DATE) AS data, CAST(CAST(dataora AS TIME) AS VARCHAR) AS ora, tiporifiuto, flag,
       abs(pesop) AS diffpeso, codiceanomalia, codicestazione
FROM l WHERE idcomune = {C} AND {_days('dataora', *YEAR)} AND flag = 0 AND codicetag = codicep AND abs(pesop) < 1"""))(
    lambda s, d: D.repeat_deposits(_deposits_from(_tables(s, d), "conferimenti_seq"), C, *YEAR, since="1995-01-01"))

register("r17_repeat_deposits_fewtags", _sql(["conferimenti_seq_fewtags"], f""",
l AS (SELECT codicetag, lag(codicetag) OVER w AS codicep, codiceanomalia, dataora, idcomune, codicestazione,
             peso - lag(peso) OVER w AS pesop, tiporifiuto, tiporifiuto - lag(tiporifiuto) OVER w AS flag
      FROM conferimenti_seq_fewtags WHERE dataora > TIMESTAMP '1995-01-01 00:00:00' WINDOW w AS (ORDER BY dataora, id))
SELECT codicetag, CAST(dataora AS DATE) AS data, CAST(CAST(dataora AS TIME) AS VARCHAR) AS ora, tiporifiuto, flag,
       abs(pesop) AS diffpeso, codiceanomalia, codicestazione
FROM l WHERE idcomune = {C} AND {_days('dataora', *YEAR)} AND flag = 0 AND codicetag = codicep AND abs(pesop) < 1"""))(
    lambda s, d: D.repeat_deposits(_deposits_from(_tables(s, d), "conferimenti_seq_fewtags"), C, *YEAR,
                                   since="1995-01-01"))

_LISTING = f"""{WD_SHORT('c.dataora')} AS gg, CAST(c.dataora AS DATE) AS data, CAST(CAST(c.dataora AS TIME) AS VARCHAR) AS ora,
       r.descrizione, c.peso, c.tiporifiuto, c.codiceanomalia
FROM conferimenti c JOIN inforifiuti r ON c.tiporifiuto = r.codicerifiuto AND r.idcomune = c.idcomune
LEFT JOIN associazionenuclei a ON c.codicetag = a.codicetag
WHERE c.idcomune = {C} AND {_days('c.dataora', *DEP)}"""
register("r18_deposits_with_household", _sql(["conferimenti", "inforifiuti", "associazionenuclei"],
         "SELECT c.codicestazione AS stazione, c.codicetag, a.codicenucleo, " + _LISTING))(
    lambda s, d: D.deposits_with_household(_tables(s, d), C, *DEP))
register("r18_deposits_with_household_station", _sql(["conferimenti", "inforifiuti", "associazionenuclei"],
         "SELECT c.codicetag, a.codicenucleo, " + _LISTING + f" AND c.codicestazione = {STATION_DEP}"))(
    lambda s, d: D.deposits_with_household(_tables(s, d), C, *DEP, station=STATION_DEP))

R19 = dict(start="2024-01-01", end="2024-01-31", open_before=86400.0, close_after=172800.0, pair_window=172800.0)
_OB, _CA = int(R19["open_before"]), int(R19["close_after"])
_SN = "CASE WHEN strlen({0}) BETWEEN 1 AND 3 THEN {0} END"  # strlen = bytes
register("r19_wrong_bin", _sql(["conferimenti_evt", "eventi", "infocassonetti", "inforifiuti", "infocomune"], f""",
dati AS (SELECT DISTINCT d.idcomune, d.codicestazione, d.tiporifiuto, d.codiceanomalia, d.dataora, b.inputplc1 AS input
         FROM (SELECT DISTINCT idcomune, codicestazione, tiporifiuto, codiceanomalia, dataora FROM conferimenti_evt
               WHERE {_inst('dataora', '2024-01-01', '2024-01-31')}) d
         JOIN infocassonetti b ON b.idcomune = d.idcomune AND b.codicestazione = d.codicestazione AND b.tiporifiuto = d.tiporifiuto),
cl AS (SELECT DISTINCT idcomune, idstazione, idevento, note, dataora FROM eventi WHERE idevento = 'CHIUSURA'),
c2 AS (SELECT idcomune, idstazione, idevento, lag(dataora) OVER w AS data2, lag({_SN.format('note')}) OVER w AS snote2,
              lag(note) OVER w AS note2
       FROM cl WINDOW w AS (PARTITION BY idcomune, idstazione ORDER BY dataora, note)),
c3 AS (SELECT idcomune, idstazione, data2, snote2, note2, concat(idevento, ' ', snote2) AS evento2 FROM c2 WHERE data2 IS NOT NULL),
op AS (SELECT idcomune AS comune, idstazione AS stazione, idevento, note, dataora AS data FROM eventi
       WHERE idevento = 'APERTURA' AND {_days('dataora', '2024-01-01', '2024-01-31')}),
pairs AS (SELECT DISTINCT op.comune, op.stazione, concat(op.idevento, ' ', {_SN.format('op.note')}) AS evento, op.data, c3.data2,
                 c3.evento2, TRY_CAST({_SN.format('op.note')} AS SMALLINT) AS in1, TRY_CAST(c3.snote2 AS SMALLINT) AS in2
          FROM op JOIN c3 ON c3.idcomune = op.comune AND c3.idstazione = op.stazione
           AND c3.data2 BETWEEN op.data AND op.data + INTERVAL {_CA} SECOND),
ev2c AS (SELECT p.*, b.inputplc1 FROM pairs p
         JOIN (SELECT DISTINCT idcomune, codicestazione, inputplc1 FROM infocassonetti) b
           ON b.idcomune = p.comune AND b.codicestazione = p.stazione AND (b.inputplc1 = p.in1 OR b.inputplc1 = p.in2)),
ev2 AS (SELECT comune, stazione, data, data2, min(inputplc1) AS inputplc1, arg_min(evento, inputplc1) AS evento,
               arg_min(evento2, inputplc1) AS evento2, arg_min(in2, inputplc1) AS in2
        FROM ev2c GROUP BY comune, stazione, data, data2),
m AS (SELECT d.*, e.data, e.data2, e.in2,
             CASE WHEN coalesce(e.in2 = d.input, false) THEN 'OK' ELSE 'ANOMALIA' END AS anomalia
      FROM dati d JOIN ev2 e ON e.comune = d.idcomune AND e.stazione = d.codicestazione AND e.inputplc1 = d.input
      WHERE e.data2 BETWEEN d.dataora AND d.dataora + INTERVAL {_CA} SECOND
        AND e.data BETWEEN d.dataora - INTERVAL {_OB} SECOND AND d.dataora),
one AS (SELECT idcomune AS comune, codicestazione AS stazione, dataora, tiporifiuto, anomalia FROM m
        QUALIFY row_number() OVER (PARTITION BY idcomune, codicestazione, dataora ORDER BY data, data2, tiporifiuto) = 1)
SELECT concat(i.nome, ' ', CAST(one.stazione AS VARCHAR)) AS identificativo, concat('Cassonetto ', r.descrizione) AS rifiuto,
       count(CASE WHEN anomalia = 'ANOMALIA' THEN 1 END) AS numeroanomalie
FROM one JOIN inforifiuti r ON r.idcomune = one.comune AND r.codicerifiuto = one.tiporifiuto
JOIN infocomune i ON i.id = one.comune
GROUP BY i.nome, one.stazione, r.descrizione HAVING count(CASE WHEN anomalia = 'ANOMALIA' THEN 1 END) <> 0"""))(
    lambda s, d: D.wrong_bin(_tables(s, d), deposits="conferimenti_evt", **R19))

register("r19_wrong_bin_literal", _sql(["conferimenti_evt", "eventi", "infocassonetti", "inforifiuti", "infocomune"], f""",
dati AS (SELECT DISTINCT d.idcomune, d.codicestazione, d.tiporifiuto, d.codiceanomalia, d.dataora, b.inputplc1 AS input
         FROM (SELECT DISTINCT idcomune, codicestazione, tiporifiuto, codiceanomalia, dataora FROM conferimenti_evt
               WHERE {_inst('dataora', '2024-01-01', '2024-01-31')}) d
         JOIN infocassonetti b ON b.idcomune = d.idcomune AND b.codicestazione = d.codicestazione AND b.tiporifiuto = d.tiporifiuto),
cl AS (SELECT DISTINCT idcomune, idstazione, idevento, note, dataora FROM eventi WHERE idevento = 'CHIUSURA'),
c2 AS (SELECT idcomune, idstazione, idevento, lag(dataora) OVER w AS data2, lag({_SN.format('note')}) OVER w AS snote2,
              lag(note) OVER w AS note2
       FROM cl WINDOW w AS (PARTITION BY idcomune, idstazione ORDER BY dataora, note)),
c3 AS (SELECT idcomune, idstazione, data2, snote2, note2, concat(idevento, ' ', snote2) AS evento2 FROM c2 WHERE data2 IS NOT NULL),
op AS (SELECT idcomune AS comune, idstazione AS stazione, idevento, note, dataora AS data FROM eventi
       WHERE idevento = 'APERTURA' AND {_days('dataora', '2024-01-01', '2024-01-31')}),
pairs AS (SELECT DISTINCT op.comune, op.stazione, concat(op.idevento, ' ', {_SN.format('op.note')}) AS evento, op.data, c3.data2,
                 c3.evento2, TRY_CAST({_SN.format('op.note')} AS SMALLINT) AS in1, TRY_CAST(c3.snote2 AS SMALLINT) AS in2
          FROM op JOIN c3 ON c3.idcomune = op.comune AND c3.idstazione = op.stazione
           AND c3.data2 BETWEEN op.data AND op.data + INTERVAL {_CA} SECOND),
ev2c AS (SELECT p.*, b.inputplc1 FROM pairs p
         JOIN (SELECT DISTINCT idcomune, codicestazione, inputplc1 FROM infocassonetti) b
           ON b.idcomune = p.comune AND b.codicestazione = p.stazione AND (b.inputplc1 = p.in1 OR b.inputplc1 = p.in2)),
ev2 AS (SELECT comune, stazione, data, data2, inputplc1, evento, evento2, in2 FROM ev2c
        QUALIFY row_number() OVER (PARTITION BY data, data2 ORDER BY comune, stazione, inputplc1) = 1),
m AS (SELECT d.*, e.data, e.data2, e.in2,
             CASE WHEN e.evento2 NOT ILIKE '%' || CAST(d.input AS VARCHAR) || '%' THEN 'ANOMALIA' ELSE 'OK' END AS anomalia
      FROM dati d JOIN ev2 e ON e.comune = d.idcomune AND e.stazione = d.codicestazione AND e.inputplc1 = d.input
      WHERE e.data2 BETWEEN d.dataora AND d.dataora + INTERVAL {_CA} SECOND
        AND e.data BETWEEN d.dataora - INTERVAL {_OB} SECOND AND d.dataora),
one AS (SELECT idcomune AS comune, codicestazione AS stazione, dataora, tiporifiuto, anomalia FROM m
        QUALIFY row_number() OVER (PARTITION BY dataora ORDER BY idcomune, codicestazione, data, data2, tiporifiuto) = 1)
SELECT concat(i.nome, ' ', CAST(one.stazione AS VARCHAR)) AS identificativo, concat('Cassonetto ', r.descrizione) AS rifiuto,
       count(CASE WHEN anomalia = 'ANOMALIA' THEN 1 END) AS numeroanomalie
FROM one JOIN inforifiuti r ON r.idcomune = one.comune AND r.codicerifiuto = one.tiporifiuto
JOIN infocomune i ON i.id = one.comune
GROUP BY i.nome, one.stazione, r.descrizione HAVING count(CASE WHEN anomalia = 'ANOMALIA' THEN 1 END) <> 0"""))(
    lambda s, d: D.wrong_bin(_tables(s, d), deposits="conferimenti_evt", literal=True, **R19))


R19_DENSE = dict(start="2024-01-05", end="2024-01-06")
ORACLE["r19_wrong_bin_dense"] = (ORACLE["r19_wrong_bin"]
    .replace("conferimenti_evt", "conferimenti_dense").replace(f"INTERVAL {_CA} SECOND", "INTERVAL 120 SECOND")
    .replace(f"INTERVAL {_OB} SECOND", "INTERVAL 10 SECOND").replace("2024-01-31", "2024-01-06").replace("2024-01-01", "2024-01-05"))
ORACLE["r19_wrong_bin_dense"] = _sql(["conferimenti_dense", "eventi_dense", "infocassonetti_dense", "inforifiuti", "infocomune"],
    ", eventi AS (SELECT * FROM eventi_dense), infocassonetti AS (SELECT * FROM infocassonetti_dense)"
    + ORACLE["r19_wrong_bin_dense"][ORACLE["r19_wrong_bin_dense"].index(",\ndati AS"):])


@register("r19_wrong_bin_dense")
def _r19_dense(s, d):
    """The tolerances of the report itself (10 and 120 seconds)."""
    t = _Swapped(_tables(s, d), {"eventi": "eventi_dense", "infocassonetti": "infocassonetti_dense"})
    return D.wrong_bin(t, deposits="conferimenti_dense", **R19_DENSE)


_R20 = f"count(id) AS numconferimenti, max(dataora) AS ultimaora, {_cat_sums()}, " \
       "sum(CASE WHEN tiporifiuto > 0 THEN peso END) AS diff, sum(peso) AS totpeso FROM conferimenti"
register("r20_recent_totals", _sql(["conferimenti"], f"""
SELECT idcomune, codicestazione, {_R20} WHERE idcomune = {C} AND {_days('dataora', *DEP)}
GROUP BY idcomune, codicestazione"""))(
    lambda s, d: D.recent_totals(_tables(s, d), C, *DEP))
register("r20_recent_totals_station", _sql(["conferimenti"], f"""
SELECT idcomune, {_R20} WHERE idcomune = {C} AND codicestazione = {STATION_DEP} AND {_days('dataora', *DEP)}
GROUP BY idcomune"""))(
    lambda s, d: D.recent_totals(_tables(s, d), C, *DEP, station=STATION_DEP))

register("r21_per_station_tag", _sql(["conferimenti"], f"""
SELECT codicetag, idcomune, codicestazione, count(*) AS conferimenti, sum(peso) AS totpeso, max(dataora) AS ultimo
FROM conferimenti WHERE {_days('dataora', *DEP)} GROUP BY idcomune, codicestazione, codicetag"""))(
    lambda s, d: D.per_station_tag(_tables(s, d), *DEP))

register("r22_heavy_deposits", _sql(["conferimenti", "inforifiuti", "associazionenuclei"],
         "SELECT c.codicestazione, c.codicetag, a.codicenucleo, " + _LISTING + " AND c.peso >= 30"))(
    lambda s, d: D.heavy_deposits(_tables(s, d), C, *DEP, min_weight=30))

register("r23_zero_weight_deposits", _sql(["conferimenti", "inforifiuti"], f"""
SELECT c.idcomune, c.codicestazione, c.codicetag, c.dataora, c.peso, c.tiporifiuto, r.nome, c.codiceanomalia, c.data, c.componenti
FROM conferimenti c JOIN (SELECT codicerifiuto, min(descrizione) AS nome FROM inforifiuti GROUP BY codicerifiuto) r
  ON c.tiporifiuto = r.codicerifiuto
WHERE {_days('c.dataora', *DEP)} AND c.peso = 0"""))(
    lambda s, d: D.zero_weight_deposits(_tables(s, d), *DEP))

register("r24_admin_tester_log", _sql(["infotesters", "infoamministratori", "logadmintesters", "infocomune"], f"""
SELECT i.nome, l.codicestazione, p.nome AS descrizione, l.tipologiautente AS tipologia, l.dataora AS data,
       p.codicetag AS codicetessera
FROM (SELECT codicetag, nome FROM infotesters UNION ALL SELECT codicetag, nome FROM infoamministratori) p
JOIN logadmintesters l ON l.codicetag = p.codicetag JOIN infocomune i ON l.idcomune = i.id
WHERE l.idcomune = {C} AND {_inst('l.dataora', *EV)}"""))(
    lambda s, d: E.admin_tester_log(_tables(s, d), C, *EV))

JAN97 = ("1997-01-01", "1997-01-31")
register("r25_idle_tags", _sql(["associazionenuclei", "conferimenti", "infonuclei", "utentiweb", "datinuclei",
                                "datiform"], f""",
busy AS (SELECT codicetag FROM conferimenti WHERE idcomune = {C} AND {_days('dataora', *JAN97)}),
j AS (SELECT count(*) AS conteggio, codicetag, min(dataora) AS primo, max(dataora) AS ultimo FROM conferimenti
      WHERE idcomune = {C} GROUP BY codicetag)
SELECT a.codicenucleo, a.idcomune, df.lotto, string_agg(DISTINCT a.codicetag, ', ' ORDER BY a.codicetag) AS codicitag,
       string_agg(DISTINCT CAST(i.progressivo AS VARCHAR), ', ' ORDER BY CAST(i.progressivo AS VARCHAR)) AS progressivi,
       CAST(coalesce(count(c.id), 0) AS BIGINT) AS conferimenti, min(j.primo) AS primo, max(j.ultimo) AS ultimo,
       CAST(DATE '2001-12-31' - max(CAST(j.ultimo AS DATE)) AS BIGINT) AS giorni, u.attivato, a.info,
       trim(d.cognome) AS cognome, trim(d.nome) AS nome, d.indirizzo, d.telefono, d.cellulare, d.mail
FROM associazionenuclei a LEFT JOIN conferimenti c ON a.codicetag = c.codicetag
JOIN infonuclei i ON a.codicetag = i.codicetag JOIN utentiweb u ON a.id = u.idnucleo
JOIN datinuclei d ON a.codicenucleo = d.codicenucleo AND a.idcomune = d.idcomune
LEFT JOIN j ON a.codicetag = j.codicetag LEFT JOIN datiform df ON a.codicenucleo = df.codicenucleo AND a.idcomune = df.idcomune
WHERE a.idcomune = {C} AND i.idcomune = {C} AND a.codicetag NOT IN (SELECT codicetag FROM busy)
GROUP BY df.lotto, a.codicenucleo, a.idcomune, u.attivato, a.info, d.cognome, d.nome, d.indirizzo, d.telefono, d.cellulare, d.mail"""))(
    lambda s, d: H.idle_tags(_tables(s, d), C, *JAN97, as_of="2001-12-31"))

register("r26_idle_households", _sql(["associazionenuclei", "conferimenti"], f"""
SELECT a.codicenucleo, a.idcomune, string_agg(DISTINCT a.codicetag, ', ' ORDER BY a.codicetag) AS codicitag,
       CAST(coalesce(count(c.id), 0) AS BIGINT) AS conferimenti
FROM associazionenuclei a LEFT JOIN conferimenti c ON a.codicetag = c.codicetag AND {_days('c.dataora', *JAN97)}
WHERE a.idcomune = {C} GROUP BY a.idcomune, a.codicenucleo HAVING coalesce(count(c.id), 0) = 0"""))(
    lambda s, d: H.idle_households(_tables(s, d), C, *JAN97))

register("r27_lid_openings", _sql(["eventi"], f"""
SELECT idevento, {WD_SHORT('dataora')} AS gg, CAST(dataora AS DATE) AS data, CAST(CAST(dataora AS TIME) AS VARCHAR) AS ora,
       idstazione AS stazione, note
FROM eventi WHERE idevento = 'APERTURA' AND idcomune = {C} AND {_days('dataora', *EV)}"""))(
    lambda s, d: E.lid_openings(_tables(s, d), C, *EV))

register("r28_label_rolls", _sql(["conferimenti", "datistazione", "infocomune"], """,
seven AS (SELECT idcomune, codicestazione, count(peso) AS primasettimana FROM conferimenti
          WHERE CAST(dataora AS DATE) BETWEEN DATE '1997-06-23' AND DATE '1997-06-30' GROUP BY idcomune, codicestazione),
fourteen AS (SELECT idcomune, codicestazione, count(peso) AS secondasettimana FROM conferimenti
          WHERE CAST(dataora AS DATE) BETWEEN DATE '1997-06-16' AND DATE '1997-06-23' GROUP BY idcomune, codicestazione)
SELECT i.nome AS comune, s.idstazione AS stazione, primasettimana, secondasettimana,
       CASE WHEN s.numeroetichette // s.maxetichette < 1 THEN s.maxetichette - s.numeroetichette
            ELSE s.maxetichette - (s.numeroetichette - (s.numeroetichette // s.maxetichette) * s.maxetichette) END AS restanti,
       CASE WHEN s.numeroetichette // s.maxetichette < 1 THEN s.numeroetichette
            ELSE s.numeroetichette - (s.numeroetichette // s.maxetichette) * s.maxetichette END AS stampate,
       s.maxetichette
FROM infocomune i JOIN datistazione s ON s.idcomune = i.id
JOIN seven ON seven.idcomune = s.idcomune AND seven.codicestazione = s.idstazione
JOIN fourteen ON fourteen.idcomune = seven.idcomune AND fourteen.codicestazione = seven.codicestazione
WHERE s.idcomune > 0 AND s.idstazione > 0"""))(
    lambda s, d: D.label_rolls(_tables(s, d), "1997-06-30"))

_F = "CASE {0} WHEN 0 THEN 'NO' WHEN 1 THEN 'SI' END"
register("r29_station_sheet", _sql(["infocomune", "datistazione", "infostazioni", "alimentazione"], f"""
SELECT i.nome AS comune, s.idstazione AS numerostazione, {_F.format('s.secondari')} AS rifiutisecondari, s.versione,
       s.ipvpn AS indirizzovpn, st.nome, a.tipo AS alimentazione, s.controllerplc AS plc,
       {_F.format('s.voltometer485')} AS voltometro485, s.router, s.stampante, {_F.format('s.scontrini')} AS scontrini,
       {_F.format('s.gps')} AS gps, s.visore AS visore_bilancia, s.dvr AS sorveglianza, {_F.format('s.sbarra')} AS sbarra
FROM infocomune i JOIN datistazione s ON s.idcomune = i.id
JOIN infostazioni st ON st.idcomune = s.idcomune AND st.codicestazione = s.idstazione
JOIN alimentazione a ON st.alimentazione = a.id"""))(
    lambda s, d: S.station_sheet(_tables(s, d)))

register("r30_station_list", _sql(["infostazioni", "alimentazione"], """
SELECT s.idcomune, s.codicestazione AS stazione, s.nome, a.tipo AS alimentazione
FROM infostazioni s JOIN alimentazione a ON s.alimentazione = a.id WHERE s.idcomune > 0 AND s.codicestazione > 0"""))(
    lambda s, d: S.station_list(_tables(s, d)))

register("r31_bin_accumulation", _sql(["cumulopesi"], f"""
SELECT {WD_SHORT('dataora')} AS gg, CAST(dataora AS DATE) AS data, CAST(CAST(dataora AS TIME) AS VARCHAR) AS ora, codicestazione,
       idrifiuto, nomerifiuto, peso, numerosacchetti, idbidone
FROM cumulopesi WHERE idcomune = {C} AND {_days('dataora', *DEP)}"""))(
    lambda s, d: D.bin_accumulation(_tables(s, d), C, *DEP))

register("r32_bin_averages", _sql(["cumulopesi"], """
SELECT idcomune, codicestazione, nomerifiuto, CAST(avg(peso) AS DECIMAL(6,3)) AS mediapeso,
       CAST(avg(numerosacchetti) AS DECIMAL(6,3)) AS mediasacchetti, max(dataora) AS aggiornato
FROM cumulopesi GROUP BY idcomune, codicestazione, nomerifiuto"""))(
    lambda s, d: D.bin_averages(_tables(s, d)))

register("r33_multi_tag_households", _sql(["associazionenuclei"], """
SELECT count(*) AS ntag, codicenucleo, idcomune FROM associazionenuclei GROUP BY codicenucleo, idcomune
HAVING count(codicetag) > 1"""))(lambda s, d: H.multi_tag_households(_tables(s, d)))

register("r34_households_without_tag", _sql(["datinuclei", "associazionenuclei"], """
SELECT idcomune, cognome, nome, codicenucleo, telefono, cellulare, mail FROM datinuclei
WHERE codicenucleo NOT IN (SELECT DISTINCT codicenucleo FROM associazionenuclei)"""))(
    lambda s, d: H.households_without_tag(_tables(s, d)))

register("r35_latest_household", _sql(["datinuclei", "utentiweb"], """,
ultimi AS (SELECT * FROM datinuclei WHERE idcomune > 0 QUALIFY row_number() OVER (PARTITION BY idcomune ORDER BY id DESC) = 1)
SELECT ultimi.id, codicenucleo, cognome, nome, username, idcomune FROM utentiweb JOIN ultimi ON idnucleo = ultimi.id"""))(
    lambda s, d: H.latest_household(_tables(s, d)))

register("r36_tags_per_municipality", _sql(["infonuclei"], """
SELECT idcomune, count(*) AS numtag FROM infonuclei WHERE idcomune > 0 GROUP BY idcomune"""))(
    lambda s, d: H.tags_per_municipality(_tables(s, d)))

register("r37_tags_with_households", _sql(["infonuclei", "associazionenuclei", "datinuclei"], """,
titolari AS (SELECT codicetag, codicenucleo, cognome, nome
             FROM associazionenuclei LEFT JOIN (SELECT codicenucleo, cognome, nome FROM datinuclei) USING (codicenucleo))
SELECT idcomune, id, codicetag, codicenucleo, cognome, nome, attivata FROM infonuclei LEFT JOIN titolari USING (codicetag)"""))(
    lambda s, d: H.tags_with_households(_tables(s, d)))

register("r38_all_tags", _sql(["infonuclei"], "SELECT codicetag, idcomune, attivata FROM infonuclei"))(
    lambda s, d: H.all_tags(_tables(s, d)))

register("r39_bad_length_tags", _sql(["associazionenuclei", "datinuclei"], """
SELECT idcomune, codicetag, CAST(length(codicetag) AS INTEGER) AS ncar, codicenucleo, info, progressivo
FROM associazionenuclei WHERE length(codicetag) <> 8 AND codicenucleo IN (SELECT codicenucleo FROM datinuclei)"""))(
    lambda s, d: H.bad_length_tags(_tables(s, d)))

register("r40_unassociated_tags", _sql(["infonuclei", "associazionenuclei"], f"""
SELECT * FROM infonuclei WHERE codicetag NOT IN (SELECT codicetag FROM associazionenuclei)
  AND idnucleo IS NULL AND idcomune = {C}"""))(
    lambda s, d: H.unassociated_tags(_tables(s, d), C))

register("r41_duplicate_usernames", _sql(["utentiweb"], """
SELECT count(username) AS ndoppi, username, min(idnucleo) AS primoid, max(idnucleo) AS ultimoid,
       min(ultimoaccesso) AS primoaccesso, max(ultimoaccesso) AS ultimoaccesso FROM utentiweb GROUP BY username"""))(
    lambda s, d: H.duplicate_usernames(_tables(s, d)))

register("r42_web_users", _sql(["utentiweb"], "SELECT id, username, usertype, idnucleo, attivato, ultimoaccesso FROM utentiweb"))(
    lambda s, d: H.web_users(_tables(s, d)))

register("r43_emptying_log", _sql(["cal_logoperatore"], f"""
SELECT * FROM cal_logoperatore WHERE idcomune = {C} AND {_inst('dataora', *EV)}"""))(
    lambda s, d: E.emptying_log(_tables(s, d), C, *EV))

register("r44_type_variety", _sql(["conferimenti", "associazionenuclei", "datinuclei"], f""",
uso AS (SELECT codicetag, count(*) AS num, count(DISTINCT tiporifiuto) FILTER (idcomune = {C}) AS tipi FROM conferimenti
        WHERE dataora > TIMESTAMP '1999-01-01 00:00:00' GROUP BY codicetag HAVING count(*) FILTER (idcomune = {C}) > 0)
SELECT codicetag, tipi, num, codicenucleo, rtrim(nome) AS nome, rtrim(cognome) AS cognome, rtrim(indirizzo) AS indirizzo
FROM datinuclei JOIN associazionenuclei USING (codicenucleo) JOIN uso USING (codicetag)"""))(
    lambda s, d: H.type_variety(_tables(s, d), C, since="1999-01-01"))

def _regex(similar: str) -> str:
    """The report's own pattern as a regular expression: only the dot needs an escape."""
    return similar.replace(".", r"\.")


register("r45_bad_household_codes", _sql(["datinuclei"], f"""
SELECT * FROM datinuclei WHERE idcomune = {C} AND NOT regexp_full_match(codicenucleo, '{_regex(H.HOUSEHOLD_CODE_PATTERN)}')"""))(
    lambda s, d: H.bad_household_codes(_tables(s, d), C))

register("r46_bad_tax_codes", _sql(["datinuclei"], f"""
SELECT * FROM datinuclei WHERE idcomune = {C} AND NOT regexp_full_match(codicefiscale, '{_regex(H.TAX_CODE_PATTERN)}')"""))(
    lambda s, d: H.bad_tax_codes(_tables(s, d), C))

register("r47_households_on_street", _sql(["datinuclei"], "SELECT * FROM datinuclei WHERE indirizzo LIKE '%BUILDING%'"))(
    lambda s, d: H.households_on_street(_tables(s, d), "BUILDING"))

_RD = f""",
pt AS (SELECT codicetag, tiporifiuto, sum(peso) AS kg FROM conferimenti WHERE {_days('dataora', *YEAR)}
       GROUP BY codicetag, tiporifiuto),
hh AS (SELECT d.idcomune, d.cognome, d.nome, d.indirizzo, d.codicenucleo, pt.tiporifiuto,
              CAST(sum(pt.kg) AS DECIMAL(12,3)) AS somma
       FROM pt JOIN associazionenuclei a ON a.codicetag = pt.codicetag JOIN datinuclei d ON d.codicenucleo = a.codicenucleo
       GROUP BY d.idcomune, d.cognome, d.nome, d.indirizzo, d.codicenucleo, pt.tiporifiuto),
tt AS (SELECT idcomune, codicenucleo, CAST(sum(somma) AS DECIMAL(12,3)) AS tot FROM hh GROUP BY idcomune, codicenucleo),
rif AS (SELECT codicerifiuto, min(descrizione) AS rifiuto FROM inforifiuti GROUP BY codicerifiuto),
rdannuale AS (SELECT hh.*, tt.tot, rif.rifiuto,
                     CAST(CASE WHEN tt.tot <> 0 THEN hh.somma / tt.tot * 100 END AS DECIMAL(9,4)) AS percent
              FROM hh JOIN tt ON tt.idcomune = hh.idcomune AND tt.codicenucleo = hh.codicenucleo
              LEFT JOIN rif ON rif.codicerifiuto = hh.tiporifiuto)"""
_ANN = H.ANNUAL_COLUMNS
register("r48a_annual_sheet_allowlist", _sql(["conferimenti", "associazionenuclei", "datinuclei", "inforifiuti"], _RD + f"""
SELECT cognome, nome, indirizzo, codicenucleo, """ + ", ".join(f"CAST(sum({n}) AS DECIMAL(38,3)) AS {n}" for n in _ANN.values()) + f""",
       CAST(sum(CASE WHEN tiporifiuto <> 0 THEN percent END) AS DECIMAL(38,4)) AS rd, count(*) AS coef,
       CAST(sum(DISTINCT tot) AS DECIMAL(38,3)) AS tot
FROM (SELECT cognome, nome, indirizzo, codicenucleo, """ + ", ".join(
    f"sum(CASE WHEN tiporifiuto = {k} THEN somma END) AS {n}" for k, n in _ANN.items()) + f""", tiporifiuto, percent, tot
      FROM rdannuale WHERE idcomune = {C}
        AND cognome || ' ' || nome IN (SELECT cognome || ' ' || nome FROM datinuclei WHERE cognome = 'BUILDING')
      GROUP BY cognome, nome, indirizzo, codicenucleo, tiporifiuto, rifiuto, percent, tot) z
GROUP BY cognome, nome, indirizzo, codicenucleo"""))


@register("r48a_annual_sheet_allowlist")
def _r48a(s, d):
    t = _tables(s, d)
    table = H.annual_sheet_table(t, *YEAR)
    allow = t.datinuclei.filter(F.col("cognome") == "BUILDING").select(
        F.concat(F.col("cognome"), F.lit(" "), F.col("nome")).alias("nominativo"))
    return H.annual_sheet_allowlist(t, C, allow, table=table)


register("r48b_annual_sheet", _sql(["conferimenti", "inforifiuti", "associazionenuclei", "datinuclei"], f""",
quote AS (SELECT idcomune, codicetag, tiporifiuto, sum(peso) AS kg, sum(sum(peso)) OVER (PARTITION BY codicetag) AS kg_tag
          FROM conferimenti WHERE {_days('dataora', *YEAR)} GROUP BY idcomune, codicetag, tiporifiuto),
case_ AS (SELECT quote.idcomune, rtrim(n.nome) AS nome, rtrim(n.cognome) AS cognome, n.indirizzo, codicenucleo, tiporifiuto,
                 sum(kg) AS kg, sum(kg_tag) AS tot
          FROM datinuclei n JOIN associazionenuclei USING (codicenucleo) JOIN quote USING (codicetag)
          WHERE tiporifiuto NOT IN {H.EXCLUDED_ANNUAL_CODES} AND tiporifiuto IN (FROM inforifiuti SELECT codicerifiuto) GROUP BY ALL)
SELECT c.idcomune, c.cognome, c.nome, c.indirizzo, c.codicenucleo, """ + ", ".join(
    f"sum(kg) FILTER (tiporifiuto = {k}) AS {n}" for k, n in _ANN.items()) + f""",
       count(*) AS coef, sum(DISTINCT tot) AS tot, telefono, cellulare, mail
FROM datinuclei n JOIN case_ c ON c.codicenucleo = n.codicenucleo AND n.idcomune = {C}
GROUP BY c.idcomune, c.cognome, c.nome, c.codicenucleo, c.indirizzo, telefono, cellulare, mail"""))(
    lambda s, d: H.annual_sheet(_tables(s, d), C, *YEAR))

_SHEET = H.SHEET_COLUMNS
_HHC = "tiponucleo, codicenucleo, componenti, tag, nominativo, indirizzoutenza, codicefiscale, telefono, cellulare, mail"
_HALVES = f""",
hh AS (SELECT d.tiponucleo, d.codicenucleo, d.ncomponenti AS componenti, i.codicetag AS tag,
              concat(d.nome, ' ', d.cognome) AS nominativo, d.indirizzoutenza, d.codicefiscale,
              CASE d.telefono WHEN '0' THEN '' ELSE d.telefono END AS telefono,
              CASE d.cellulare WHEN '0' THEN '' ELSE d.cellulare END AS cellulare,
              CASE d.mail WHEN '@' THEN '' ELSE d.mail END AS mail
       FROM datinuclei d LEFT JOIN infonuclei i ON i.idnucleo = d.id WHERE d.idcomune = {C}),
act AS (SELECT {', '.join('hh.' + c.strip() for c in _HHC.split(','))}, max(c.dataora) AS ultimo,
               count(c.peso) AS numero_conferimenti, {_cat_sums('c.peso', 'c.tiporifiuto', _SHEET, else0=True)},
               sum(c.peso) AS totale,
               string_agg(DISTINCT CAST(c.codicestazione AS VARCHAR), '|' ORDER BY CAST(c.codicestazione AS VARCHAR)) AS stazioni
        FROM hh JOIN conferimenti c ON c.codicetag = hh.tag
        WHERE c.dataora BETWEEN TIMESTAMP '{DEP[0]} 00:00:00' AND TIMESTAMP '1997-04-01 00:00:00'
        GROUP BY {', '.join('hh.' + c.strip() for c in _HHC.split(','))}),
inact AS (SELECT {', '.join('hh.' + c.strip() for c in _HHC.split(','))}, max(c.dataora) AS ultimo,
                 CAST(0 AS BIGINT) AS numero_conferimenti, {', '.join(f'0.0 AS {n}' for n in _SHEET.values())},
                 0.0 AS totale, '0' AS stazioni
          FROM hh LEFT JOIN conferimenti c ON c.codicetag = hh.tag
          GROUP BY {', '.join('hh.' + c.strip() for c in _HHC.split(','))} {{having}}),
u AS (SELECT * FROM act UNION SELECT * FROM inact)"""


def _sheet_select(src: str) -> str:
    """Weights are multiples of a thousandth: shares are computed on whole numbers."""
    text = lambda n: f"CASE WHEN {n} = 0 THEN '0' ELSE CAST(CAST({n} AS DECIMAL(38,3)) AS VARCHAR) END"
    kg = ", ".join(f"concat({text(n)}, ' kg') AS {n}" for n in _SHEET.values())
    whole = lambda n: f"CAST(round({n} * 1000) AS BIGINT)"
    rest = f"({whole('totale')} - {whole('indifferenziato')})"
    pct = (f"concat(CASE WHEN {rest} = 0 OR {rest} * 10000 // {whole('totale')} = 0 THEN '0' "
           f"ELSE CAST(CAST({rest} * 10000 // {whole('totale')} AS DECIMAL(18,2)) / 100 AS DECIMAL(38,2))::VARCHAR END, ' %')")
    return f"""
SELECT tiponucleo, CAST(codicenucleo AS VARCHAR) AS codicenucleo, tag, componenti, max(ultimo) AS ultimoconferimento,
       nominativo, indirizzoutenza, codicefiscale, CAST(telefono AS VARCHAR) AS telefono, cellulare, mail, {kg},
       concat({text('totale')}, ' kg') AS totalerifiuti, {pct} AS percentualedifferenziata,
       max(stazioni) AS stazioni
FROM {src}
GROUP BY tiponucleo, codicenucleo, tag, nominativo, indirizzoutenza, codicefiscale, telefono, cellulare, mail, componenti,
         totale, {', '.join(_SHEET.values())}"""


_HH_TABLES = ["datinuclei", "infonuclei", "conferimenti"]
register("r49_household_sheet", _sql(_HH_TABLES, _HALVES.format(
    having=f"HAVING max(c.dataora) < TIMESTAMP '{DEP[0]} 00:00:00' OR max(c.dataora) IS NULL") + _sheet_select("u")))(
    lambda s, d: H.household_sheet(_tables(s, d), C, *DEP))

register("r50_household_sheet_rollup", _sql(_HH_TABLES, _HALVES.format(having="") + f""",
t AS (SELECT tiponucleo, codicenucleo, componenti, string_agg(DISTINCT tag, ' | ' ORDER BY tag) AS tag,
             string_agg(DISTINCT CAST(ultimo AS VARCHAR), ' | ' ORDER BY CAST(ultimo AS VARCHAR)) AS ultimo,
             string_agg(DISTINCT stazioni, ' - ' ORDER BY stazioni) AS stazioni, nominativo, indirizzoutenza,
             codicefiscale, telefono, cellulare, mail, sum(numero_conferimenti) AS numero_conferimenti,
             {', '.join(f'sum({n}) AS {n}' for n in _SHEET.values())}, sum(totale) AS totale
      FROM u GROUP BY tiponucleo, codicenucleo, componenti, nominativo, indirizzoutenza, codicefiscale, telefono,
                      cellulare, mail)""" + _sheet_select("t")))(
    lambda s, d: H.household_sheet_rollup(_tables(s, d), C, *DEP))

R51 = dict(cutoff="1998-07-01")
R51_STATION = {"idcomune": 2, "codicestazione": 1}
register("r51_clock_repair", _sql(["conferimenti_seq"], """,
x AS (SELECT *, CASE WHEN dataora > TIMESTAMP '1998-07-01 00:00:00' THEN 1
                     WHEN dataora < TIMESTAMP '1998-07-01 00:00:00' THEN -1 ELSE 0 END AS side
      FROM conferimenti_seq WHERE idcomune > 1 AND data > DATE '1900-01-01'),
l1 AS (SELECT *, lag(dataora) OVER (PARTITION BY idcomune, codicestazione ORDER BY id) AS pts,
              lag(dataora) OVER (PARTITION BY idcomune, codicestazione, side ORDER BY id) AS psts FROM x),
l2 AS (SELECT *, date_diff('microsecond', pts, dataora) / 1000000.0 AS dall,
              date_diff('microsecond', psts, dataora) / 1000000.0 AS dside FROM l1),
cl AS (SELECT *, CASE WHEN dall < 0 THEN 1 WHEN side = 1 AND dside > 0 THEN 0 WHEN side = -1 AND dside > 0 THEN 2 END AS riavvio FROM l2),
c AS (SELECT idcomune, codicestazione, codicetag, dataora, id, data, riavvio,
             CASE WHEN riavvio = 1 THEN dall ELSE dside END AS delta_dataora, riavvio = 1 AS flag
      FROM cl WHERE riavvio IS NOT NULL),
g AS (SELECT *, count(CASE WHEN flag THEN 1 END) OVER (PARTITION BY idcomune, codicestazione ORDER BY id) AS conteggio,
             lag(riavvio) OVER w AS pr, lag(dataora) OVER w AS pts2, lag(delta_dataora) OVER w AS pdelta
      FROM c WINDOW w AS (PARTITION BY idcomune, codicestazione ORDER BY id)),
n AS (SELECT *, CASE WHEN riavvio = 1 AND pr = 0 THEN pts2 + INTERVAL 30 SECOND
                     WHEN riavvio = 2 AND pr = 1 THEN pts2 - to_microseconds(CAST(round(pdelta * 1000000) AS BIGINT)) END AS nuovadataora
      FROM g),
m AS (SELECT *, lag(nuovadataora) OVER (PARTITION BY idcomune, codicestazione, conteggio ORDER BY id) AS pnuova,
             first_value(nuovadataora) OVER (PARTITION BY idcomune, codicestazione, riavvio, conteggio ORDER BY id) AS fv,
             sum(CASE WHEN delta_dataora > 0 THEN delta_dataora END) OVER (PARTITION BY idcomune, codicestazione, conteggio ORDER BY id) AS possum
      FROM n)
SELECT idcomune, codicestazione, codicetag, dataora, id AS idn, data, delta_dataora, riavvio, nuovadataora, flag, conteggio,
       CASE WHEN riavvio = 2 AND pr = 1 THEN pnuova + to_microseconds(CAST(round(delta_dataora * 1000000) AS BIGINT))
            WHEN riavvio = 2 AND pr = 2 THEN fv + to_microseconds(CAST(round(possum * 1000000) AS BIGINT)) END AS nuovadataora2
FROM m WHERE idcomune = 2 AND codicestazione = 1"""))


@register("r51_clock_repair")
def _r51(s, d):
    t = _tables(s, d)
    out = clock_repair(t.conferimenti_seq, valid=(F.col("idcomune") > 1) & (F.col("data") > F.lit("1900-01-01").cast("date")),
                       only=R51_STATION, **R51)
    return out.select("idcomune", "codicestazione", "codicetag", "dataora", "idn", "data", "delta_dataora", "riavvio",
                      "nuovadataora", "flag", "conteggio", "nuovadataora2")


register("r51_clock_repair_literal", _sql(["conferimenti_seq"], """,
letti AS (SELECT *, CASE WHEN dataora > TIMESTAMP '1998-07-01 00:00:00' THEN 1
                         WHEN dataora < TIMESTAMP '1998-07-01 00:00:00' THEN -1 END AS lato
          FROM conferimenti_seq WHERE idcomune > 1 AND data > DATE '1900-01-01'),
passi AS (SELECT *, date_diff('microsecond', lag(dataora) OVER tutti, dataora) AS passo,
                 date_diff('microsecond', lag(dataora) OVER (PARTITION BY lato ORDER BY idcomune, codicestazione, id), dataora) AS passo_lato
          FROM letti WINDOW tutti AS (ORDER BY idcomune, codicestazione, id)),
casi AS (SELECT *, unnest(list_filter([CASE WHEN passo < 0 THEN 1 END, CASE WHEN lato = 1 AND passo_lato > 0 THEN 0 END,
                                       CASE WHEN lato = -1 AND passo_lato > 0 THEN 2 END], lambda c: c IS NOT NULL)) AS riavvio
         FROM passi),
misurati AS (SELECT *, CASE riavvio WHEN 1 THEN passo ELSE passo_lato END AS us FROM casi),
isole AS (SELECT *, count(*) FILTER (riavvio = 1) OVER (ORDER BY idcomune, codicestazione, id) AS conteggio,
                 lag(riavvio) OVER fila AS caso_prima, lag(dataora) OVER fila AS ora_prima, lag(us) OVER fila AS us_prima
          FROM misurati WINDOW fila AS (ORDER BY idcomune, codicestazione, id, riavvio)),
rifatti AS (SELECT *, CASE WHEN riavvio = 1 AND caso_prima = 0 THEN ora_prima + INTERVAL 30 SECOND
                           WHEN riavvio = 2 AND caso_prima = 1 THEN ora_prima - to_microseconds(us_prima) END AS nuovadataora
            FROM isole WHERE idcomune = 2 AND codicestazione = 1),
stazione AS (SELECT *, lag(riavvio) OVER (ORDER BY id, riavvio) AS caso, lag(nuovadataora) OVER (PARTITION BY conteggio ORDER BY id, riavvio) AS nuova_prima,
                    first_value(nuovadataora) OVER (PARTITION BY riavvio, conteggio ORDER BY id) AS nuova_isola,
                    sum(greatest(us, 0)) FILTER (us > 0) OVER (PARTITION BY conteggio ORDER BY id) AS us_isola
             FROM rifatti)
SELECT idcomune, codicestazione, codicetag, dataora, id AS idn, data, us / 1000000.0 AS delta_dataora, riavvio, nuovadataora, riavvio = 1 AS flag,
       conteggio, CASE WHEN riavvio = 2 AND caso = 1 THEN nuova_prima + to_microseconds(us)
                       WHEN riavvio = 2 AND caso = 2 THEN nuova_isola + to_microseconds(CAST(us_isola AS BIGINT)) END AS nuovadataora2
FROM stazione"""))


@register("r51_clock_repair_literal")
def _r51_literal(s, d):
    # the columns it returns, so that no step has others to carry
    x = _tables(s, d).conferimenti_seq.select("id", "idcomune", "codicestazione", "codicetag", "dataora", "data")
    out = clock_repair(x, valid=(F.col("idcomune") > 1) & (F.col("data") > F.lit("1900-01-01").cast("date")),
                       only=R51_STATION, literal=True, **R51)
    return out.select("idcomune", "codicestazione", "codicetag", "dataora", "idn", "data", "delta_dataora", "riavvio",
                      "nuovadataora", "flag", "conteggio", "nuovadataora2")


register("r52_per_capita_by_type", _sql(["associazionenuclei", "conferimenti", "datinuclei", "inforifiuti"], f""",
per_tag AS (SELECT codicetag, tiporifiuto, max(dataora) AS ultimo, count(id) AS n, sum(peso) AS kg FROM conferimenti
            WHERE {_inst('dataora', *DEP)} GROUP BY ALL),
soci AS (SELECT idcomune, codicetag, codicenucleo FROM associazionenuclei WHERE idcomune = {C}),
famiglie AS (SELECT codicenucleo, tiporifiuto, max(ultimo) AS ultimo, sum(n) AS n, sum(kg) AS kg
             FROM soci JOIN per_tag USING (codicetag) GROUP BY ALL)
SELECT soci.idcomune, f.tiporifiuto, r.descrizione, count(*) AS nuclei, CAST(sum(h.ncomponenti) AS BIGINT) AS componenti,
       CAST(sum(f.n) AS BIGINT) AS conferimenti, sum(f.kg) AS chili, max(f.ultimo) AS "max"
FROM famiglie f JOIN inforifiuti r ON r.codicerifiuto = f.tiporifiuto AND r.idcomune = {C}
JOIN datinuclei h ON h.codicenucleo = f.codicenucleo JOIN soci ON soci.codicenucleo = f.codicenucleo
GROUP BY soci.idcomune, f.tiporifiuto, r.descrizione"""))(
    lambda s, d: H.per_capita_by_type(_tables(s, d), C, *DEP))

register("r53_stale_stations", _sql(["conferimenti_evt", "eventi", "logoperatore", "infostazioni", "infocomune"], """,
last AS (SELECT idcomune, codicestazione, max(dataora) AS ultimoinvio FROM (
           SELECT idcomune, codicestazione, dataora FROM conferimenti_evt
           UNION ALL SELECT idcomune, idstazione, dataora FROM eventi
           UNION ALL SELECT idcomune, codicestazione, dataora FROM logoperatore) z GROUP BY idcomune, codicestazione)
SELECT DISTINCT i.nome, s.codicestazione, l.ultimoinvio
FROM infocomune i JOIN infostazioni s ON s.idcomune = i.id
JOIN last l ON l.idcomune = s.idcomune AND l.codicestazione = s.codicestazione
WHERE CAST(l.ultimoinvio AS DATE) <> DATE '2024-01-30'
  AND l.ultimoinvio NOT BETWEEN TIMESTAMP '2024-01-30 00:00:00' AND TIMESTAMP '2024-01-30 12:00:00'
  AND s.idcomune IS NOT NULL AND s.codicestazione IS NOT NULL"""))(
    lambda s, d: D.stale_stations(_tables(s, d), "2024-01-30 12:00:00", deposits="conferimenti_evt"))

register("r53_stale_stations_literal", _sql(["conferimenti_evt", "eventi", "logoperatore", "infostazioni", "infocomune"], """,
dep AS (SELECT idcomune, codicestazione, max(dataora) AS t FROM conferimenti_evt GROUP BY ALL),
evt AS (SELECT idcomune, idstazione AS codicestazione, max(dataora) AS t FROM eventi GROUP BY ALL),
ops AS (SELECT idcomune, codicestazione, max(dataora) AS t FROM logoperatore GROUP BY ALL),
visti AS (SELECT dep.idcomune, dep.codicestazione, dep.t AS a, evt.t AS b, ops.t AS c
          FROM ops LEFT JOIN evt USING (idcomune, codicestazione)
          LEFT JOIN dep ON dep.idcomune = evt.idcomune AND dep.codicestazione = evt.codicestazione),
invii AS (SELECT idcomune, codicestazione, if(a > b, if(a > c, a, c), if(b > c, b, c)) AS ultimoinvio FROM visti)
SELECT DISTINCT nome, codicestazione, ultimoinvio
FROM (SELECT idcomune, codicestazione FROM infostazioni) JOIN invii USING (idcomune, codicestazione)
JOIN (SELECT id AS idcomune, nome FROM infocomune) USING (idcomune)
WHERE ultimoinvio::DATE <> DATE '2024-01-30'
  AND NOT (ultimoinvio >= TIMESTAMP '2024-01-30 00:00:00' AND ultimoinvio <= TIMESTAMP '2024-01-30 12:00:00')"""))(
    lambda s, d: D.stale_stations(_tables(s, d), "2024-01-30 12:00:00", deposits="conferimenti_evt", literal=True))

P54 = ("1999-06-01", "2001-12-31")
register("r54_per_capita_totals", _sql(["associazionenuclei", "conferimenti", "datinuclei"], f""",
per_tag AS (SELECT codicetag, max(dataora) AS ultimo, count(id) AS n FROM conferimenti GROUP BY ALL),
famiglie AS (SELECT codicenucleo, max(ultimo) AS ultimo, sum(n) AS n FROM per_tag JOIN associazionenuclei USING (codicetag)
             GROUP BY codicenucleo HAVING {_inst('max(ultimo)', *P54)})
SELECT s.idcomune, count(*) AS nuclei, CAST(sum(ncomponenti) AS BIGINT) AS componenti, CAST(sum(n) AS BIGINT) AS conferimenti,
       max(ultimo) AS "max"
FROM famiglie JOIN datinuclei USING (codicenucleo) JOIN associazionenuclei s USING (codicenucleo)
WHERE s.idcomune = {C} GROUP BY s.idcomune"""))(
    lambda s, d: H.per_capita_totals(_tables(s, d), C, *P54))

_R55 = f"""
SELECT em.id AS codice, concat(s.latitudine, ' , ', s.longitudine) AS coordinate,
       concat(i.nome, ' ', CAST(s.codicestazione AS VARCHAR)) AS postazione, concat(ii.sigla, ' ', ii.descrizione) AS problema,
       em.descrizione, st.stato, em.manutentore, em.commento1 AS commentoesecuzione, em.commento2 AS commentorisoluzione,
       em.dataorarisoluzione AS dataintervento, em.utente
FROM infocomune i LEFT JOIN infostazioni s ON s.idcomune = i.id
LEFT JOIN eventimanutenzione em ON em.idcomune = s.idcomune AND em.codicestazione = s.codicestazione
LEFT JOIN infointerventi ii ON ii.id = em.codiceproblema LEFT JOIN stato st ON st.id = em.stato
WHERE em.idcomune = {C}"""
_R55T = ["infocomune", "infostazioni", "eventimanutenzione", "infointerventi", "stato"]
register("r55_maintenance_tickets", _sql(_R55T, _R55))(
    lambda s, d: S.maintenance_tickets(_tables(s, d), C))
register("r55_maintenance_tickets_open", _sql(_R55T, _R55 + " AND st.stato NOT LIKE '%chiuso%'"))(
    lambda s, d: S.maintenance_tickets(_tables(s, d), C, hide_closed=True))


# ---------------------------------------------------------------------------------------------
# The generic operators that no report's query shows on its own.
_ST = ["idcomune", "idstazione"]

register("o06_debounce", _sql(["eventi"], """,
l AS (SELECT id, dataora, lag(dataora) OVER (PARTITION BY idcomune, idstazione ORDER BY dataora, id) AS prima FROM eventi)
SELECT id, dataora FROM l WHERE prima IS NULL OR dataora > prima + INTERVAL 3600 SECOND"""))(
    lambda s, d: SQ.debounce(_tables(s, d).eventi, _ST, "dataora", 3600).select("id", "dataora"))

register("o07_state_changes", _sql(["eventi"], """,
l AS (SELECT id, note, lag(note) OVER w AS prev_state, row_number() OVER w AS n FROM eventi WHERE idevento = 'TENSIONE_RETE'
      WINDOW w AS (PARTITION BY idcomune, idstazione ORDER BY dataora, id))
SELECT id, note, prev_state FROM l WHERE n = 1 OR note IS DISTINCT FROM prev_state"""))(
    lambda s, d: SQ.state_changes(_tables(s, d).eventi.filter(F.col("idevento") == "TENSIONE_RETE"), _ST, "dataora", "note")
    .select("id", "note", "prev_state"))

register("o08_stuck_values", _sql(["conferimenti_seq"], """,
l AS (SELECT *, lag(peso) OVER (PARTITION BY idcomune, codicestazione ORDER BY dataora, id) AS prima FROM conferimenti_seq)
SELECT idcomune, codicestazione, peso, count(*) AS repeats, max(dataora) AS last_ts FROM l
WHERE peso = prima AND dataora >= TIMESTAMP '1998-01-01 00:00:00' GROUP BY ALL HAVING count(*) > 1"""))(
    lambda s, d: SQ.stuck_values(_tables(s, d).conferimenti_seq, ["idcomune", "codicestazione"], "dataora", "peso", 1, since="1998-01-01"))

register("o09_repeat_records", _sql(["conferimenti_seq_fewtags"], """,
l AS (SELECT *, lag(codicetag) OVER w AS tag, peso - lag(peso) OVER w AS diff_peso FROM conferimenti_seq_fewtags
      WINDOW w AS (PARTITION BY idcomune ORDER BY dataora, id))
SELECT id, diff_peso FROM l WHERE codicetag = tag AND abs(diff_peso) < 1"""))(
    lambda s, d: SQ.repeat_records(_tables(s, d).conferimenti_seq_fewtags, ["dataora", "id"], ["codicetag"], {"peso": 1.0}, by=["idcomune"])
    .select("id", "diff_peso"))

register("o13_pct_of_total", _sql(["conferimenti"], """,
k AS (SELECT idcomune, tiporifiuto, CAST(sum(peso) AS DECIMAL(12,3)) AS kg FROM conferimenti GROUP BY ALL)
SELECT idcomune, tiporifiuto, kg, CAST(sum(kg) OVER (PARTITION BY idcomune) AS DECIMAL(12,3)) AS tot,
       CAST(kg / sum(kg) OVER (PARTITION BY idcomune) * 100 AS DECIMAL(9,4)) AS percent FROM k"""))(
    lambda s, d: T.pct_of_total(_tables(s, d).conferimenti.groupBy("idcomune", "tiporifiuto").agg(F.sum("peso").cast("decimal(12,3)").alias("kg")),
                                ["idcomune"], "kg", type_="decimal(12,3)").withColumn("percent", F.col("percent").cast("decimal(9,4)")))

register("o19_phase_durations", _sql(["eventi"], """,
l AS (SELECT *, lag(note) OVER w AS prima, row_number() OVER w AS n FROM eventi WHERE idevento = 'TENSIONE_RETE'
      WINDOW w AS (PARTITION BY idcomune, idstazione ORDER BY dataora, id)),
c AS (SELECT * FROM l WHERE n = 1 OR note IS DISTINCT FROM prima)
SELECT id, row_number() OVER v AS phase, date_diff('microsecond', lag(dataora) OVER v, dataora) / 1000000.0 AS phase_seconds
FROM c WINDOW v AS (PARTITION BY idcomune, idstazione ORDER BY dataora, id)"""))(
    lambda s, d: SQ.phase_durations(_tables(s, d).eventi.filter(F.col("idevento") == "TENSIONE_RETE"), _ST, "dataora", "note")
    .select("id", "phase", "phase_seconds"))

def _scratch(spark) -> str:
    """A new folder that the executors share: under the cluster's checkpoint folder, or
    a temporary one in a local session."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the cluster shares")
    return f"{(shared or tempfile.mkdtemp(prefix='binsight-rows-')).rstrip('/')}/rows-{uuid.uuid4().hex}"


@register("o33_ordered_rows", _sql(["eventi"], """
SELECT row_number() OVER (ORDER BY note DESC NULLS FIRST, idstazione, dataora DESC, id) - 1 AS position, CAST(id AS VARCHAR) AS id,
       CAST(idstazione AS VARCHAR) AS idstazione, note FROM eventi"""))
def _ordered_rows(s, d):
    """Events written as JSON rows in display order, and read back with their positions."""
    path = _scratch(s)
    rows = _tables(s, d).eventi.select("id", "idstazione", "note", "dataora")
    write_ordered_rows_json(rows, path, [pg_order("note", True), pg_order("idstazione"), pg_order("dataora", True)])
    row = F.col("row")
    return read_ordered_rows(s, path).select("position", row[0].alias("id"), row[1].alias("idstazione"), row[2].alias("note"))


def _asof_entry(s, d, direction, **kw):
    t = _tables(s, d)
    dep = t.conferimenti_evt.select("id", "idcomune", "codicestazione", "dataora")
    ev = t.eventi.select("idcomune", F.col("idstazione").alias("codicestazione"), F.col("dataora").alias("ora"), "note")
    return asof_join(dep, ev, ["idcomune", "codicestazione"], "dataora", "ora", ["note", "ora"], direction, **kw)


_ASOF_EVENTS = "(SELECT idcomune, idstazione, dataora AS ora, max(note) AS note FROM eventi GROUP BY ALL)"
register("j_asof_last_event", _sql(["conferimenti_evt", "eventi"], f"""
SELECT d.id, d.idcomune, d.codicestazione, d.dataora, e.note, e.ora FROM conferimenti_evt d ASOF LEFT JOIN {_ASOF_EVENTS} e
ON e.idcomune = d.idcomune AND e.idstazione = d.codicestazione AND d.dataora >= e.ora"""))(
    lambda s, d: _asof_entry(s, d, "backward"))
register("j_asof_next_event", _sql(["conferimenti_evt", "eventi"], f"""
SELECT d.id, d.idcomune, d.codicestazione, d.dataora, CASE WHEN e.ora <= d.dataora + INTERVAL 12 HOUR THEN e.note END AS note,
       CASE WHEN e.ora <= d.dataora + INTERVAL 12 HOUR THEN e.ora END AS ora
FROM conferimenti_evt d ASOF LEFT JOIN {_ASOF_EVENTS} e
ON e.idcomune = d.idcomune AND e.idstazione = d.codicestazione AND d.dataora < e.ora"""))(
    lambda s, d: _asof_entry(s, d, "forward", allow_equal=False, tolerance_seconds=12 * 3600))

register("o21_first_per_key", _sql(["eventi"], """
SELECT idcomune, idstazione, id, idevento, dataora FROM eventi
QUALIFY row_number() OVER (PARTITION BY idcomune, idstazione ORDER BY dataora, id) = 1"""))(
    lambda s, d: SQ.first_per_key(_tables(s, d).eventi.select(*_ST, "id", "idevento", "dataora"), _ST, ["dataora", "id"]))

register("o23_period_counts", _sql(["eventi"], f"""
SELECT idcomune, idstazione, count(note) FILTER ({_days('dataora', '2024-01-05', '2024-01-09')}) AS prima,
       count(note) FILTER ({_days('dataora', '2024-01-09', '2024-01-14')}) AS dopo
FROM eventi WHERE {_days('dataora', '2024-01-05', '2024-01-14')} GROUP BY idcomune, idstazione"""))(
    lambda s, d: T.period_counts(_tables(s, d).eventi, _ST, "dataora", {"prima": ("2024-01-05", "2024-01-09"), "dopo": ("2024-01-09", "2024-01-14")}, "note"))

register("o24_bad_format", _sql(["infonuclei"], "SELECT id, codicetag FROM infonuclei WHERE NOT regexp_full_match(codicetag, '0+[1-9][0-9]*')"))(
    lambda s, d: FI.bad_format(_tables(s, d).infonuclei, "codicetag", "0+[1-9][0-9]*").select("id", "codicetag"))
register("o24_bad_length", _sql(["infonuclei"], "SELECT id, codicetag FROM infonuclei WHERE length(codicetag) <> 8"))(
    lambda s, d: FI.bad_length(_tables(s, d).infonuclei, "codicetag", 8).select("id", "codicetag"))

register("o25_duplicate_summary", _sql(["conferimenti"], """
SELECT codicetag, tiporifiuto, count(*) AS n, min(dataora) AS primo, max(peso) AS massimo FROM conferimenti
GROUP BY codicetag, tiporifiuto HAVING count(*) >= 4"""))(
    lambda s, d: Q.duplicate_summary(_tables(s, d).conferimenti, ["codicetag", "tiporifiuto"], {"primo": F.min("dataora"), "massimo": F.max("peso")}, min_count=4))

register("o26_active_inactive", _sql(["infonuclei", "conferimenti"], f""",
dim AS (SELECT id, codicetag FROM infonuclei),
tutti AS (SELECT dim.id, dim.codicetag, c.dataora, c.peso,
                 c.dataora BETWEEN TIMESTAMP '{DEP[0]} 00:00:00' AND TIMESTAMP '1997-04-01 00:00:00' AS dentro
          FROM dim LEFT JOIN (SELECT codicetag, dataora, peso FROM conferimenti) c USING (codicetag))
SELECT id, codicetag, max(dataora) AS last_ts, count(peso) AS n, sum(peso) AS kg FROM tutti WHERE dentro GROUP BY ALL
UNION SELECT id, codicetag, max(dataora), 0, 0.0 FROM tutti GROUP BY ALL
HAVING max(dataora) IS NULL OR max(dataora) < TIMESTAMP '{DEP[0]} 00:00:00'"""))(
    lambda s, d: T.active_inactive(_tables(s, d).infonuclei.select("id", "codicetag"), _tables(s, d).conferimenti, "codicetag", "dataora", *DEP,
                                   measures={"n": F.count("peso"), "kg": F.sum("peso")}, zero={"n": F.lit(0).cast("long"), "kg": F.lit(0.0)}))

register("o27_dominant_signal", _sql(["eventi"], """,
n AS (SELECT idcomune, idstazione, count(*) FILTER (idevento = 'APERTURA') AS a, count(*) FILTER (idevento = 'CHIUSURA') AS b
      FROM eventi GROUP BY ALL)
SELECT idcomune, idstazione, if(a > b, 'APERTURA', 'CHIUSURA') AS avviso, greatest(a, b) AS segnalazioni FROM n"""))(
    lambda s, d: T.dominant_signal(_tables(s, d).eventi, _ST, "idevento", ["APERTURA", "CHIUSURA"]))

register("o29_per_group_population", _sql(["conferimenti", "infonuclei"], """
SELECT idcomune, CAST(count(DISTINCT codicetag) AS BIGINT) AS tag, count(*) AS conferimenti, max(dataora) AS ultimo
FROM (SELECT codicetag, dataora FROM conferimenti) JOIN infonuclei USING (codicetag) GROUP BY idcomune"""))(
    lambda s, d: T.per_group_population(_tables(s, d).conferimenti, _tables(s, d).infonuclei.select("codicetag", "idcomune"), "codicetag", ["idcomune"],
                                        {"__n": F.count(F.lit(1)), "__u": F.max("dataora")},
                                        {"tag": F.count(F.lit(1)), "conferimenti": F.sum("__n"), "ultimo": F.max("__u")}))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
