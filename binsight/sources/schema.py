"""Domain table schemas (as inferred in FIXTURES.md) and a load-time check.

The check is by *kind* (integral, numeric, text, timestamp, date, boolean),
so a weight stored as DOUBLE or DECIMAL(12,3) and an id stored as INT or
BIGINT are both accepted; missing columns and wrong kinds are reported
together.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_I, _L, _S = T.IntegerType(), T.LongType(), T.StringType()
_TS, _D, _B = T.TimestampNTZType(), T.DateType(), T.BooleanType()
_W = T.DecimalType(12, 3)


def _st(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SCHEMAS: dict[str, T.StructType] = {
    "infocomune": _st(("id", _I), ("nome", _S)),
    "eventi": _st(("id", _L), ("idcomune", _I), ("idstazione", _I), ("idevento", _S), ("dataora", _TS), ("note", _S)),
    "conferimenti": _st(("id", _L), ("idcomune", _I), ("codicestazione", _I), ("codicetag", _S), ("dataora", _TS),
                        ("peso", _W), ("tiporifiuto", _I), ("codiceanomalia", _I), ("data", _D), ("componenti", _I)),
    "inforifiuti": _st(("idcomune", _I), ("codicerifiuto", _I), ("descrizione", _S)),
    "infocassonetti": _st(("idcomune", _I), ("codicestazione", _I), ("tiporifiuto", _I), ("inputplc1", T.ShortType())),
    "infostazioni": _st(("idcomune", _I), ("codicestazione", _I), ("nome", _S), ("alimentazione", _I),
                        ("latitudine", _S), ("longitudine", _S)),
    "datistazione": _st(("idcomune", _I), ("idstazione", _I), ("numeroetichette", _I), ("maxetichette", _I),
                        ("secondari", _I), ("voltometer485", _I), ("scontrini", _I), ("gps", _I), ("sbarra", _I),
                        ("versione", _S), ("ipvpn", _S), ("controllerplc", _S), ("router", _S), ("stampante", _S),
                        ("visore", _S), ("dvr", _S)),
    "alimentazione": _st(("id", _I), ("tipo", _S)),
    "datinuclei": _st(("id", _L), ("idcomune", _I), ("codicenucleo", _S), ("nome", _S), ("cognome", _S),
                      ("indirizzo", _S), ("indirizzoutenza", _S), ("telefono", _S), ("cellulare", _S), ("mail", _S),
                      ("codicefiscale", _S), ("tiponucleo", _S), ("ncomponenti", _I)),
    "associazionenuclei": _st(("id", _L), ("idcomune", _I), ("codicenucleo", _S), ("codicetag", _S), ("info", _S),
                              ("progressivo", _I)),
    "infonuclei": _st(("id", _L), ("idcomune", _I), ("codicetag", _S), ("idnucleo", _L), ("progressivo", _I),
                      ("attivata", _B)),
    "utentiweb": _st(("id", _L), ("username", _S), ("usertype", _I), ("idnucleo", _L), ("attivato", _B),
                     ("ultimoaccesso", _TS)),
    "datiform": _st(("idcomune", _I), ("codicenucleo", _S), ("lotto", _S)),
    "logoperatore": _st(("idcomune", _I), ("codicestazione", _I), ("codicetag", _S), ("dataora", _TS), ("info", _S)),
    "infooperatori": _st(("codicetag", _S), ("nome", _S)),
    "logfalliti": _st(("idcomune", _I), ("idstazione", _I), ("codicetag", _S), ("dataora", _TS)),
    "logadmintesters": _st(("idcomune", _I), ("codicestazione", _I), ("codicetag", _S), ("tipologiautente", _S),
                           ("dataora", _TS)),
    "infotesters": _st(("codicetag", _S), ("nome", _S)),
    "infoamministratori": _st(("codicetag", _S), ("nome", _S)),
    "cumulopesi": _st(("idcomune", _I), ("codicestazione", _I), ("idrifiuto", _I), ("nomerifiuto", _S), ("peso", _W),
                      ("numerosacchetti", _I), ("idbidone", _I), ("dataora", _TS)),
    "rdannuale": _st(("idcomune", _I), ("cognome", _S), ("nome", _S), ("indirizzo", _S), ("codicenucleo", _S),
                     ("tiporifiuto", _I), ("rifiuto", _S), ("somma", _W), ("percent", T.DecimalType(9, 4)), ("tot", _W)),
    "eventimanutenzione": _st(("id", _L), ("idcomune", _I), ("codicestazione", _I), ("dataoraproblema", _TS),
                              ("codiceproblema", _I), ("descrizione", _S), ("stato", _I), ("commento1", _S),
                              ("commento2", _S), ("dataorarisoluzione", _TS), ("manutentore", _S), ("utente", _S)),
    "infointerventi": _st(("id", _I), ("sigla", _S), ("descrizione", _S)),
    "stato": _st(("id", _I), ("stato", _S)),
}


def _kind(t: T.DataType) -> str:
    if isinstance(t, T.IntegralType):
        return "integral"
    if isinstance(t, (T.FractionalType,)):
        return "numeric"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    return type(t).__name__


def _compatible(expected: T.DataType, actual: T.DataType) -> bool:
    e, a = _kind(expected), _kind(actual)
    if e == a:
        return True
    return e == "numeric" and a == "integral"   # whole-number weights are fine


def check_table(name: str, df: DataFrame, required: Iterable[str] | None = None) -> list[str]:
    """Problems of ``df`` against the domain schema of ``name`` (empty = ok).
    ``required`` restricts the check to the columns a caller needs."""
    schema = SCHEMAS[name]
    want = {f.name: f.dataType for f in schema.fields}
    cols = list(required) if required is not None else list(want)
    have = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for c in cols:
        if c not in have:
            out.append(f"{name}.{c}: missing")
        elif not _compatible(want[c], have[c]):
            out.append(f"{name}.{c}: {have[c].simpleString()} is not {want[c].simpleString()}")
    return out


def check_tables(tables: Mapping[str, DataFrame], names: Iterable[str] | None = None) -> None:
    """Raise ``ValueError`` listing every schema problem of the given tables."""
    problems = []
    for n in (names if names is not None else [k for k in tables if k in SCHEMAS]):
        problems += check_table(n, tables[n])
    if problems:
        raise ValueError("domain schema check failed:\n  " + "\n  ".join(problems))
