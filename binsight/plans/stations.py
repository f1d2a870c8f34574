"""Station sheets and maintenance tickets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binsight.functions.pg import decode_flag, pg_concat
from binsight.sources.bindings import Tables

CLOSED_PATTERN = "%chiuso%"  # fixed value: status text of a closed ticket


def station_sheet(t: Tables) -> DataFrame:
    """Equipment sheet per station, 0/1 flags decoded to NO/SI."""
    c = t.infocomune.select(F.col("id").alias("__cid"), F.col("nome").alias("comune"))
    s = t.datistazione
    i = t.infostazioni.select(F.col("idcomune").alias("__ic"), F.col("codicestazione").alias("__is"), "nome",
                              F.col("alimentazione").alias("__al"))
    a = t.alimentazione.select(F.col("id").alias("__aid"), "tipo")
    j = (s.join(c, s.idcomune == c.__cid)
          .join(i, (i.__ic == s.idcomune) & (i.__is == s.idstazione))
          .join(a, F.col("__al") == a.__aid))
    return j.select("comune", F.col("idstazione").alias("numerostazione"),
                    decode_flag("secondari").alias("rifiutisecondari"), "versione",
                    F.col("ipvpn").alias("indirizzovpn"), "nome", F.col("tipo").alias("alimentazione"),
                    F.col("controllerplc").alias("plc"), decode_flag("voltometer485").alias("voltometro485"),
                    "router", "stampante", decode_flag("scontrini").alias("scontrini"),
                    decode_flag("gps").alias("gps"), F.col("visore").alias("visore_bilancia"),
                    F.col("dvr").alias("sorveglianza"), decode_flag("sbarra").alias("sbarra"))


def station_list(t: Tables) -> DataFrame:
    """Stations with their power supply type (ids > 0)."""
    s = t.infostazioni.filter((F.col("idcomune") > 0) & (F.col("codicestazione") > 0))
    a = t.alimentazione.select(F.col("id").alias("__aid"), "tipo")
    j = s.join(a, s.alimentazione == a.__aid)
    return j.select("idcomune", F.col("codicestazione").alias("stazione"), "nome", F.col("tipo").alias("alimentazione"))


def maintenance_tickets(t: Tables, municipality: int, hide_closed: bool = False) -> DataFrame:
    """Maintenance tickets of a municipality with coordinates, place,
    problem and status text; ``hide_closed`` drops closed tickets (and, as a
    ``NOT LIKE`` on a nullable column, tickets without a status)."""
    em = t.eventimanutenzione.filter(F.col("idcomune") == municipality)
    c = t.infocomune.select(F.col("id").alias("__cid"), "nome")
    s = t.infostazioni.select(F.col("idcomune").alias("__sc"), F.col("codicestazione").alias("stazione"),
                              "latitudine", "longitudine")
    ii = t.infointerventi.select(F.col("id").alias("__iid"), "sigla", F.col("descrizione").alias("__idesc"))
    st = t.stato.select(F.col("id").alias("__stid"), F.col("stato").alias("__stato"))
    j = (em.join(s, (em.idcomune == s.__sc) & (em.codicestazione == s.stazione))
           .join(c, em.idcomune == c.__cid)
           .join(ii, em.codiceproblema == ii.__iid, "left")
           .join(st, em.stato == st.__stid, "left"))
    if hide_closed:
        j = j.filter(~F.col("__stato").like(CLOSED_PATTERN))
    return j.select(F.col("id").alias("codice"),
                    pg_concat("latitudine", F.lit(" , "), "longitudine").alias("coordinate"),
                    pg_concat("nome", F.lit(" "), "stazione").alias("postazione"),
                    pg_concat("sigla", F.lit(" "), "__idesc").alias("problema"),
                    "descrizione", F.col("__stato").alias("stato"), "manutentore",
                    F.col("commento1").alias("commentoesecuzione"), F.col("commento2").alias("commentorisoluzione"),
                    F.col("dataorarisoluzione").alias("dataintervento"), "utente")
