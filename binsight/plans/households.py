"""Household and tag reports: missing forms, idle tags, tag registry checks,
code-format checks, annual and per-household sorting sheets, per-capita
averages.

Facts (deposits) are reduced to the tags a report asks for (semi join) and
aggregated per tag *before* they meet the household tables, so the household
joins work on one row per tag instead of one row per deposit, and a join
fan-out never multiplies deposit rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binsight.functions.pg import as_ts, blank_sentinel, num_text, pg_concat
from binsight.operators.filters import bad_format, bad_length, in_days_expr, in_instants_expr
from binsight.operators.presence import absent, absent_in_period
from binsight.operators.quality import duplicate_summary
from binsight.operators.totals import active_inactive, pct_of_total, per_group_population, sorted_share
from binsight.sources.bindings import Tables

# --- fixed values -------------------------------------------------------------
HOUSEHOLD_CODE_PATTERN = "[A-Z]{2,3}.[0-9]{4}.[0-9]{4}"
TAX_CODE_PATTERN = "[A-Z]{6}[0-9]{2}[A-Z][0-9]{2}[A-Z]{3}[A-Z]"
TAG_LENGTH = 8
EXCLUDED_ANNUAL_CODES = (6, 7, 9)
# annual sheet columns (no glass+cans column), in report order
ANNUAL_COLUMNS = {0: "indifferenziato", 17: "pannolini", 16: "barattolame", 3: "plastica",
                  1: "carta", 15: "vetro", 4: "organico"}
# full sheet columns (R49/R50), in report order
SHEET_COLUMNS = {0: "indifferenziato", 17: "pannolini", 16: "barattolame", 3: "plastica",
                 1: "carta", 15: "vetro", 2: "vetrobarattolame", 4: "organico"}
PHONE_BLANK, MAIL_BLANK = "0", "@"
# ------------------------------------------------------------------------------


def _sorted_agg(c: Column | str, sep: str, distinct: bool = True) -> Column:
    """``string_agg([DISTINCT] c, sep)`` in text order; NULL when no value."""
    c = F.col(c) if isinstance(c, str) else c
    arr = F.collect_set(c.cast("string")) if distinct else F.collect_list(c.cast("string"))
    return F.when(F.size(arr) > 0, F.array_join(F.array_sort(arr), sep))


def households_without_form(t: Tables, municipality: int, form: DataFrame | None = None) -> DataFrame:
    """Household codes of a municipality missing from the form table
    (``NOT IN``: a NULL code in the form table empties the result)."""
    form = t.datiform if form is None else form
    hh = t.datinuclei.filter(F.col("idcomune") == municipality).select("codicenucleo").distinct()
    f = form.filter(F.col("idcomune") == municipality).select("codicenucleo")
    return absent(hh, f, "codicenucleo", null_aware=True)


def idle_tags(t: Tables, municipality: int, start, end, as_of) -> DataFrame:
    """Tags of a municipality with no deposit in the period, grouped by
    household: tag list, first/last deposit ever (in the municipality), days
    since the last one at ``as_of``, the web-user flag and contacts.

    ``conferimenti`` counts all deposits of the listed tags (any
    municipality), multiplied by the join fan-out exactly as the row-level
    join would, but computed from per-tag counts.
    """
    a = t.associazionenuclei.filter(F.col("idcomune") == municipality)
    dep = t.conferimenti
    busy = dep.filter((F.col("idcomune") == municipality) & in_days_expr("dataora", start, end)).select("codicetag")
    a = absent(a, busy, "codicetag", null_aware=True)
    # one pass over the deposits: all-time count (any municipality) and
    # first / last deposit in the municipality, per tag
    in_c = F.col("idcomune") == municipality
    wanted = a.select("codicetag").distinct()
    stats = dep.join(wanted, "codicetag", "left_semi").groupBy("codicetag").agg(F.count("id").alias("__ndep"),
                                         F.min(F.when(in_c, F.col("dataora"))).alias("primo"),
                                         F.max(F.when(in_c, F.col("dataora"))).alias("ultimo"))
    i = t.infonuclei.filter(F.col("idcomune") == municipality).select(F.col("codicetag").alias("__itag"),
                                                                      F.col("progressivo").alias("__iprog"))
    u = t.utentiweb.select(F.col("idnucleo").alias("__uid"), "attivato")
    d = t.datinuclei.select(F.col("codicenucleo").alias("__dn"), F.col("idcomune").alias("__dc"), "cognome", "nome",
                            "indirizzo", "telefono", "cellulare", "mail")
    df = t.datiform.select(F.col("codicenucleo").alias("__fn"), F.col("idcomune").alias("__fc"), "lotto")
    x = (a.join(i, a.codicetag == i.__itag)
          .join(u, a.id == u.__uid)
          .join(d, (a.codicenucleo == d.__dn) & (a.idcomune == d.__dc))
          .join(stats, "codicetag", "left")
          .join(df, (a.codicenucleo == df.__fn) & (a.idcomune == df.__fc), "left"))
    keys = ["lotto", "codicenucleo", "idcomune", "attivato", "info", "cognome", "nome", "indirizzo", "telefono",
            "cellulare", "mail"]
    g = x.groupBy(*keys).agg(
        _sorted_agg("codicetag", ", ").alias("codicitag"),
        _sorted_agg("__iprog", ", ").alias("progressivi"),
        F.coalesce(F.sum("__ndep"), F.lit(0)).cast("long").alias("conferimenti"),
        F.min("primo").alias("primo"), F.max("ultimo").alias("ultimo"))
    as_of_day = F.to_date(as_ts(as_of))
    return g.select("codicenucleo", "idcomune", "lotto", "codicitag", "progressivi", "conferimenti", "primo", "ultimo",
                    F.datediff(as_of_day, F.to_date("ultimo")).cast("long").alias("giorni"), "attivato", "info",
                    F.trim("cognome").alias("cognome"), F.trim("nome").alias("nome"), "indirizzo", "telefono",
                    "cellulare", "mail")


def idle_households(t: Tables, municipality: int, start, end) -> DataFrame:
    """Households of a municipality none of whose tags made a deposit
    in the period (any municipality), with their tags."""
    a = t.associazionenuclei.filter(F.col("idcomune") == municipality)
    idle = absent_in_period(a, t.conferimenti, "codicetag", "dataora", start, end, ["idcomune", "codicenucleo"])
    return (idle.groupBy("idcomune", "codicenucleo")
                .agg(_sorted_agg("codicetag", ", ").alias("codicitag"))
                .select("codicenucleo", "idcomune", "codicitag", F.lit(0).cast("long").alias("conferimenti")))


def multi_tag_households(t: Tables) -> DataFrame:
    """Households with more than one tag."""
    out = duplicate_summary(t.associazionenuclei, ["codicenucleo", "idcomune"], {"__n": F.count("codicetag")}, count_name="ntag")
    return out.filter(F.col("__n") > 1).select("ntag", "codicenucleo", "idcomune")


def households_without_tag(t: Tables) -> DataFrame:
    """Households with no tag (``NOT IN``, any municipality)."""
    d = t.datinuclei
    return absent(d, t.associazionenuclei.select("codicenucleo"), "codicenucleo", null_aware=True).select(
        "idcomune", "cognome", "nome", "codicenucleo", "telefono", "cellulare", "mail")


def latest_household(t: Tables) -> DataFrame:
    """The newest household (largest id) of each municipality, with its
    web user name."""
    d = t.datinuclei
    newest = d.filter(F.col("idcomune") > 0).groupBy("idcomune").agg(F.max("id").alias("__mid"))
    top = d.join(newest.select(F.col("__mid").alias("id")), "id", "left_semi")
    u = t.utentiweb.select("username", "idnucleo")
    return (top.join(u, top.id == u.idnucleo)
               .select("id", "codicenucleo", "cognome", "nome", "username", "idcomune"))


def tags_per_municipality(t: Tables) -> DataFrame:
    """Number of tags per municipality."""
    return t.infonuclei.filter(F.col("idcomune") > 0).groupBy("idcomune").agg(F.count(F.lit(1)).alias("numtag"))


def tags_with_households(t: Tables) -> DataFrame:
    """Every tag with its household's names, if any."""
    i = t.infonuclei
    a = t.associazionenuclei.select(F.col("codicetag").alias("__atag"), "codicenucleo")
    d = t.datinuclei.select(F.col("codicenucleo").alias("__dn"), "cognome", "nome")
    j = i.join(a, i.codicetag == a.__atag, "left").join(d, F.col("codicenucleo") == d.__dn, "left")
    return j.select(i.idcomune, i.id, i.codicetag, "codicenucleo", "cognome", "nome", "attivata")


def all_tags(t: Tables) -> DataFrame:
    """All tags."""
    return t.infonuclei.select("codicetag", "idcomune", "attivata")


def bad_length_tags(t: Tables, length: int = TAG_LENGTH) -> DataFrame:
    """Associated tags whose code is not ``length`` characters, for
    known households."""
    a = bad_length(t.associazionenuclei, "codicetag", length)
    a = a.join(t.datinuclei.select("codicenucleo"), "codicenucleo", "left_semi")
    return a.select("idcomune", "codicetag", F.char_length("codicetag").alias("ncar"), "codicenucleo", "info",
                    "progressivo")


def unassociated_tags(t: Tables, municipality: int) -> DataFrame:
    """Tags of a municipality with no association and no household."""
    i = t.infonuclei.filter(F.col("idnucleo").isNull() & (F.col("idcomune") == municipality))
    return absent(i, t.associazionenuclei.select("codicetag"), "codicetag", null_aware=True)


def duplicate_usernames(t: Tables) -> DataFrame:
    """Per user name: how many, first/last household id and access."""
    out = duplicate_summary(t.utentiweb, "username", {
        "ndoppi": F.count("username"), "primoid": F.min("idnucleo"), "ultimoid": F.max("idnucleo"),
        "primoaccesso": F.min("ultimoaccesso"), "ultimoaccesso": F.max("ultimoaccesso")})
    return out.select("ndoppi", "username", "primoid", "ultimoid", "primoaccesso", "ultimoaccesso")


def web_users(t: Tables) -> DataFrame:
    """Web users."""
    return t.utentiweb.select("id", "username", "usertype", "idnucleo", "attivato", "ultimoaccesso")


def type_variety(t: Tables, municipality: int, since) -> DataFrame:
    """Per tag of the municipality, the number of distinct waste types
    used and of deposits (any municipality) after ``since``, with household."""
    dep = t.conferimenti.filter(F.col("dataora") > as_ts(since))
    # distinct types over the municipality's rows only (a scan that municipality
    # partitioning prunes); the deposit count per tag is a plain hash aggregate
    a = (dep.filter(F.col("idcomune") == municipality).groupBy("codicetag")
            .agg(F.count_distinct("tiporifiuto").alias("tipi")))
    n = dep.join(a.select("codicetag"), "codicetag", "left_semi").groupBy("codicetag").agg(F.count(F.lit(1)).alias("num"))
    b = t.associazionenuclei.select(F.col("codicetag").alias("__btag"), "codicenucleo")
    c = t.datinuclei.select(F.col("codicenucleo").alias("__cn"), "nome", "cognome", "indirizzo")
    j = a.join(b, a.codicetag == b.__btag).join(c, F.col("codicenucleo") == c.__cn).join(n, "codicetag")
    return j.select("codicetag", "tipi", "num", "codicenucleo", F.rtrim("nome").alias("nome"),
                    F.rtrim("cognome").alias("cognome"), F.rtrim("indirizzo").alias("indirizzo"))


def bad_household_codes(t: Tables, municipality: int, pattern: str = HOUSEHOLD_CODE_PATTERN) -> DataFrame:
    """Households whose code does not match ``pattern`` (SIMILAR TO)."""
    d = t.datinuclei.filter(F.col("idcomune") == municipality)
    return bad_format(d, "codicenucleo", pattern)


def bad_tax_codes(t: Tables, municipality: int, pattern: str = TAX_CODE_PATTERN) -> DataFrame:
    """Households whose tax code does not match ``pattern``."""
    d = t.datinuclei.filter(F.col("idcomune") == municipality)
    return bad_format(d, "codicefiscale", pattern)


def households_on_street(t: Tables, word: str) -> DataFrame:
    """Households whose address contains ``word``."""
    return t.datinuclei.filter(F.col("indirizzo").like(f"%{word}%"))


def annual_sheet_table(t: Tables, start, end, id_below: int | None = None) -> DataFrame:
    """The per-household, per-type annual table (``rdannuale``): kg per type
    (``somma``), the household's total (``tot``) and the type's share of it
    (``percent``), as fixed-scale decimals.  Built from per-tag aggregates."""
    dep = t.conferimenti.filter(in_days_expr("dataora", start, end))
    if id_below is not None:
        dep = dep.filter(F.col("id") < id_below)
    per_tag = dep.groupBy("codicetag", "tiporifiuto").agg(F.sum("peso").alias("__kg"))
    a = t.associazionenuclei.select("codicetag", "codicenucleo")
    d = t.datinuclei.select("codicenucleo", "idcomune", "cognome", "nome", "indirizzo")
    hh = (per_tag.join(a, "codicetag").join(d, "codicenucleo")
                 .groupBy("idcomune", "cognome", "nome", "indirizzo", "codicenucleo", "tiporifiuto")
                 .agg(F.sum("__kg").cast("decimal(12,3)").alias("somma")))
    j = pct_of_total(hh, ["idcomune", "codicenucleo"], "somma", type_="decimal(12,3)")
    rif = t.inforifiuti.groupBy("codicerifiuto").agg(F.min("descrizione").alias("rifiuto"))
    j = j.join(rif, j.tiporifiuto == rif.codicerifiuto, "left").drop("codicerifiuto")
    return j.withColumn("percent", F.col("percent").cast("decimal(9,4)"))


def annual_sheet_allowlist(t: Tables, municipality: int, allow: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Annual sorting sheet for an allow-list of people (``allow`` has
    one column ``nominativo`` = surname + ' ' + name): kg per type, the sum of
    the shares of sorted types, the row count and ``SUM(DISTINCT tot)``."""
    rd = t.rdannuale if table is None else table
    rd = rd.filter(F.col("idcomune") == municipality)
    full = F.concat(F.col("cognome"), F.lit(" "), F.col("nome"))
    rd = rd.join(allow.select(F.col("nominativo").alias("__who")), full == F.col("__who"), "left_semi")
    inner_keys = ["cognome", "nome", "indirizzo", "codicenucleo", "tiporifiuto", "rifiuto", "percent", "tot"]
    inner = rd.groupBy(*inner_keys).agg(*[F.sum(F.when(F.col("tiporifiuto") == code, F.col("somma"))).alias(name)
                                          for code, name in ANNUAL_COLUMNS.items()])
    return inner.groupBy("cognome", "nome", "indirizzo", "codicenucleo").agg(
        *[F.sum(name).cast("decimal(38,3)").alias(name) for name in ANNUAL_COLUMNS.values()],
        F.sum(F.when(F.col("tiporifiuto") != 0, F.col("percent"))).cast("decimal(38,4)").alias("rd"),
        F.count(F.lit(1)).alias("coef"),
        F.sum_distinct("tot").cast("decimal(38,3)").alias("tot"))


def annual_sheet(t: Tables, municipality: int, start, end, id_below: int | None = None,
                 excluded_codes: Sequence[int] = EXCLUDED_ANNUAL_CODES) -> DataFrame:
    """Annual sorting sheet from raw deposits: per tag x type and per
    tag totals are pre-aggregated, attached to households (by household code
    only, as in the original), and rolled up per household of the
    municipality with ``SUM(DISTINCT tot)``."""
    dep = t.conferimenti.filter(in_days_expr("dataora", start, end))
    if id_below is not None:
        dep = dep.filter(F.col("id") < id_below)
    # one pass over the deposits: per (municipality, tag, type) sums, and the
    # tag's total over all types and municipalities as a window over those
    # few aggregated rows per tag; the excluded types go after the window
    base = dep.groupBy("idcomune", "codicetag", "tiporifiuto").agg(F.sum("peso").alias("somma"))
    a = (base.withColumn("tot", F.sum("somma").over(Window.partitionBy("codicetag")))
             .filter(~F.col("tiporifiuto").isin(list(excluded_codes))))
    c = t.inforifiuti.groupBy("codicerifiuto").agg(F.min("descrizione").alias("rifiuto"))
    d = t.associazionenuclei.select(F.col("codicetag").alias("__dtag"), "codicenucleo")
    e = t.datinuclei.select(F.col("codicenucleo").alias("__en"), "nome", "cognome", "indirizzo")
    j = (a.join(c, a.tiporifiuto == c.codicerifiuto)
          .join(d, a.codicetag == d.__dtag).join(e, F.col("codicenucleo") == e.__en))
    rd = (j.groupBy("idcomune", "nome", "cognome", "indirizzo", "codicenucleo", "tiporifiuto", "rifiuto")
           .agg(F.sum("somma").alias("somma"), F.sum("tot").alias("tot"))
           .withColumn("nome", F.rtrim("nome")).withColumn("cognome", F.rtrim("cognome")))
    dati = t.datinuclei.filter(F.col("idcomune") == municipality).select(
        F.col("codicenucleo").alias("__hn"), "telefono", "cellulare", "mail")
    x = rd.join(dati, rd.codicenucleo == dati.__hn)
    return (x.groupBy("idcomune", "cognome", "nome", "codicenucleo", "indirizzo", "telefono", "cellulare", "mail")
             .agg(*[F.sum(F.when(F.col("tiporifiuto") == code, F.col("somma"))).alias(name)
                    for code, name in ANNUAL_COLUMNS.items()],
                  F.count(F.lit(1)).alias("coef"), F.sum_distinct("tot").alias("tot"))
             .select("idcomune", "cognome", "nome", "indirizzo", "codicenucleo", *ANNUAL_COLUMNS.values(),
                     "coef", "tot", "telefono", "cellulare", "mail"))


def _household_tags(t: Tables, municipality: int) -> DataFrame:
    d = t.datinuclei.filter(F.col("idcomune") == municipality)
    i = t.infonuclei.select(F.col("idnucleo").alias("__hid"), F.col("codicetag").alias("tag"))
    h = d.join(i, d.id == i.__hid, "left")
    return h.select(
        "tiponucleo", "codicenucleo", F.col("ncomponenti").alias("componenti"), "tag",
        pg_concat("nome", F.lit(" "), "cognome").alias("nominativo"), "indirizzoutenza", "codicefiscale",
        blank_sentinel("telefono", PHONE_BLANK).alias("telefono"),
        blank_sentinel("cellulare", PHONE_BLANK).alias("cellulare"),
        blank_sentinel("mail", MAIL_BLANK).alias("mail"))


def _sheet_halves(t: Tables, municipality: int, start, end, always_idle: bool) -> DataFrame:
    """Rows per (household, tag): the active half (deposits in [start, end+1
    day]) UNION the inactive half (zeros), see ``active_inactive``."""
    dep = t.conferimenti.withColumnRenamed("codicetag", "tag")
    kg = {name: F.sum(F.when(F.col("tiporifiuto") == code, F.col("peso")).otherwise(F.lit(0.0)))
          for code, name in SHEET_COLUMNS.items()}
    measures = {"numero_conferimenti": F.count("peso"), **kg, "totale": F.sum("peso"),
                "stazioni": _sorted_agg("codicestazione", "|")}
    zero = {"numero_conferimenti": F.lit(0).cast("long"), **{n: F.lit(0.0) for n in [*kg, "totale"]}, "stazioni": F.lit("0")}
    rows = active_inactive(_household_tags(t, municipality), dep, "tag", "dataora", start, end, measures, zero, always_idle)
    return rows.withColumnRenamed("last_ts", "ultimo")


def _sheet_output(x: DataFrame, ultimo_col: Column, keep_order: bool) -> DataFrame:
    keys = ["tiponucleo", "codicenucleo", "tag", "nominativo", "indirizzoutenza", "codicefiscale", "telefono",
            "cellulare", "mail", "componenti", "totale", *SHEET_COLUMNS.values()]
    g = x.groupBy(*keys).agg(F.max(ultimo_col).alias("ultimoconferimento"), F.max("stazioni").alias("stazioni"))
    kg = [pg_concat(num_text(n), F.lit(" kg")).alias(n) for n in SHEET_COLUMNS.values()]
    g = g.withColumn("__share", sorted_share("totale", "indifferenziato"))
    share = F.when(F.col("__share") == 0, F.lit("0")).otherwise(F.col("__share").cast("string"))
    order = [F.col("totale").alias("__order_totale")] if keep_order else []
    return g.select("tiponucleo", F.col("codicenucleo").cast("string").alias("codicenucleo"), "tag", "componenti",
                    "ultimoconferimento", "nominativo", "indirizzoutenza", "codicefiscale",
                    F.col("telefono").cast("string").alias("telefono"), "cellulare", "mail", *kg,
                    pg_concat(num_text("totale"), F.lit(" kg")).alias("totalerifiuti"),
                    pg_concat(share, F.lit(" %")).alias("percentualedifferenziata"), "stazioni", *order)


def household_sheet(t: Tables, municipality: int, start, end, keep_order: bool = False) -> DataFrame:
    """Full sheet per household and tag -- kg per type, total, sorted
    share (truncated %), stations; tags idle since before ``start`` appear
    with zeros.  ``keep_order`` carries the total for the display order."""
    return _sheet_output(_sheet_halves(t, municipality, start, end, always_idle=False), F.col("ultimo"), keep_order)


def household_sheet_rollup(t: Tables, municipality: int, start, end, keep_order: bool = False) -> DataFrame:
    """R49 rolled up per household: tags, last-deposit times and station
    lists concatenated (sorted, distinct); every tag also contributes a zero
    row, as in the original."""
    x = _sheet_halves(t, municipality, start, end, always_idle=True)
    hkeys = ["tiponucleo", "codicenucleo", "componenti", "nominativo", "indirizzoutenza", "codicefiscale",
             "telefono", "cellulare", "mail"]
    numeric = ["numero_conferimenti", *SHEET_COLUMNS.values(), "totale"]
    r = x.groupBy(*hkeys).agg(
        _sorted_agg("tag", " | ").alias("tag"),
        _sorted_agg(F.col("ultimo").cast("string"), " | ").alias("ultimo"),
        _sorted_agg("stazioni", " - ").alias("stazioni"),
        *[F.sum(n).alias(n) for n in numeric])
    return _sheet_output(r, F.col("ultimo"), keep_order)


def _per_household(t: Tables, dep: DataFrame, tags: DataFrame, by: list[str]) -> DataFrame:
    """Last time, deposits and kg per household (and ``by``): deposits of the
    wanted tags are summed per tag first, then over a household's tags."""
    wanted = tags.select("codicetag").distinct()
    return per_group_population(
        dep.join(wanted, "codicetag", "left_semi"), tags.select("codicetag", F.col("codicenucleo").alias("__cn")), ["codicetag", *by], ["__cn", *by],
        {"__l": F.max("dataora"), "__c": F.count("id"), "__w": F.sum("peso")},
        {"__last": F.max("__l"), "__conf": F.sum("__c"), "__kg": F.sum("__w")})


def per_capita_by_type(t: Tables, municipality: int, start, end) -> DataFrame:
    """Per waste type: households, members, deposits, kg and last time,
    over households (via tag associations) with deposits in [start, end]."""
    a = t.associazionenuclei.filter(F.col("idcomune") == municipality)
    c = _per_household(t, t.conferimenti.filter(in_instants_expr("dataora", start, end)), a, ["tiporifiuto"])
    d = t.datinuclei.select(F.col("codicenucleo").alias("__dn"), "ncomponenti")
    rif = t.inforifiuti.select(F.col("idcomune").alias("__rc"), F.col("codicerifiuto").alias("__code"), "descrizione")
    j = (a.join(d, a.codicenucleo == d.__dn).join(c, a.codicenucleo == c.__cn)
          .join(rif, (a.idcomune == rif.__rc) & (c.tiporifiuto == rif.__code)))
    return j.groupBy("idcomune", "tiporifiuto", "descrizione").agg(
        F.count("codicenucleo").alias("nuclei"), F.sum("ncomponenti").alias("componenti"),
        F.sum("__conf").alias("conferimenti"), F.sum("__kg").alias("chili"), F.max("__last").alias("max"))


def per_capita_totals(t: Tables, municipality: int, start, end) -> DataFrame:
    """Households whose last deposit ever is in [start, end]: count,
    members, deposits and last time, per municipality.  A household's tags of
    any municipality count, so those of its listed associations are taken."""
    a = t.associazionenuclei.filter(F.col("idcomune") == municipality)
    tags = t.associazionenuclei.join(a.select("codicenucleo").distinct(), "codicenucleo", "left_semi")
    c = _per_household(t, t.conferimenti, tags, []).filter(in_instants_expr("__last", start, end))
    d = t.datinuclei.select(F.col("codicenucleo").alias("__dn"), "ncomponenti")
    j = a.join(d, a.codicenucleo == d.__dn).join(c, a.codicenucleo == c.__cn)
    return j.groupBy("idcomune").agg(F.count("codicenucleo").alias("nuclei"), F.sum("ncomponenti").alias("componenti"),
                                     F.sum("__conf").alias("conferimenti"), F.max("__last").alias("max"))
