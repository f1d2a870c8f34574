"""Registered queries of the subpackage: one thin query per operator over its
whole table, and DuckDB SQL where SQL expresses the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binsight.llm import (
    additive_quality,
    chat_format,
    curve_packing,
    host_reputation,
    language_codes,
    license_notices,
    minmax_dedup,
    orchard_codes,
    phrase_index,
    sorted_projections,
    spelling_variants,
    token_counts,
    trie_dedup,
)
from binsight.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return keep


@query("op1_curve_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return curve_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op3_chat_format", r"""
    WITH c AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
    e AS (
        SELECT *, len(role) + len(text) + 9 + 7 + 7
            + len(list_filter(range(1, len(role) + 1), lambda i: role[i] = '\' OR role[i] = '<' AND (i = len(role) OR role[i + 1] IN ('|', '/', 's', 'S', '<'))
                              OR role[i] = '[' AND (i = len(role) OR role[i + 1] IN ('/', 'I'))))
            + len(list_filter(range(1, len(text) + 1), lambda i: text[i] = '\' OR text[i] = '<' AND (i = len(text) OR text[i + 1] IN ('|', '/', 's', 'S', '<'))
                              OR text[i] = '[' AND (i = len(text) OR text[i + 1] IN ('/', 'I')))) AS chars
        FROM c)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(sum(CASE WHEN role = 'assistant' THEN len(text) ELSE 0 END) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(chars) AS BIGINT) AS formatted_chars
    FROM e GROUP BY conv_id
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    messages = turns.unionByName(probe).withColumn("parts", chat_format.text_part(F.col("text")))
    return chat_format.digests(chat_format.format_conversations(messages))


_RULE_SQL = "CASE " + " ".join(
    f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.text}'"
    for r in sorted(host_reputation.RULES, key=lambda r: -len(r.text))) + " END"
_VERDICT_SQL = "CASE rule " + " ".join(f"WHEN '{r.text}' THEN '{r.verdict}'" for r in host_reputation.RULES) + " END"


def _strength_sql(groups: str) -> str:
    """Moment estimate of the prior strength among the rows (n, good) of a table."""
    return f"""SELECT CASE WHEN k < 2 OR g <= 0 OR g >= n THEN 1000.0 ELSE
        CASE WHEN rho > 0 THEN least(greatest(1 / rho - 1, 2.0), 1000.0) ELSE 1000.0 END END FROM (
        SELECT k, n, g, (gg - n * m * m - (k - 1) * m * (1 - m)) / nullif(m * (1 - m) * (n - nn / n - (k - 1)), 0) AS rho
        FROM (SELECT *, g / n AS m FROM (SELECT count(*) AS k, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(good) AS DOUBLE) AS g,
              sum(CAST(n AS DOUBLE) * n) AS nn, sum(CAST(good AS DOUBLE) * good / n) AS gg FROM {groups})))"""


@query("op4_host_reputation", rf"""
    WITH p AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
    o AS (SELECT host, regexp_extract(host, '[^.]*\.?[^.]*$') AS domain, regexp_extract(host, '[^.]*$') AS suffix, count(*) AS n, sum(quality) AS good
          FROM p JOIN labels ON doc_id = try_cast(regexp_extract(path, '/([0-9]+)', 1) AS BIGINT) WHERE quality IS NOT NULL GROUP BY ALL),
    d AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM o GROUP BY ALL),
    s AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM d GROUP BY ALL),
    k AS (SELECT ({_strength_sql('o')}) AS kh, ({_strength_sql('d')}) AS kd, ({_strength_sql('s')}) AS ks,
                 (SELECT coalesce((sum(good) + 1) / (sum(n) + 1), 1.0) FROM s) AS whole),
    ms AS (SELECT suffix, (good + ks * whole) / (n + ks) AS m FROM s, k),
    md AS (SELECT domain, (good + kd * m) / (n + kd) AS m FROM d JOIN ms USING (suffix), k),
    h AS (SELECT p.*, coalesce(o.n, 0) AS n, coalesce(o.good, 0) AS good, coalesce(md.m, ms.m, whole) AS prior, kh
          FROM p LEFT JOIN o USING (host) LEFT JOIN md ON md.domain = regexp_extract(p.host, '[^.]*\.?[^.]*$')
          LEFT JOIN ms ON ms.suffix = regexp_extract(p.host, '[^.]*$'), k),
    b AS (SELECT *, (good + kh * prior) / (n + kh) AS mean FROM h),
    r AS (SELECT *, {_RULE_SQL} AS rule, least(1.0, mean + 1.645 * sqrt(mean * (1 - mean) / (n + kh + 1))) AS upper FROM b)
    SELECT page_id, host, path, rule, coalesce({_VERDICT_SQL}, CASE WHEN upper < 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
           n AS n_labelled, round(mean, 6) AS reputation, round(upper, 6) AS upper FROM r
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: the quality label of the document that a page's path names."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, path = host_reputation.host_of(F.col("url")), host_reputation.path_of(F.col("url"))
    named = pages.select(host.alias("host"), F.regexp_extract(path, "/([0-9]+)", 1).try_cast("long").alias("doc_id"))
    outcomes = named.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("good")), "doc_id")
    return host_reputation.judge(pages, outcomes).select("page_id", "host", "path", "rule", "verdict", "n_labelled",
                                                         F.round("reputation", 6).alias("reputation"), F.round("upper", 6).alias("upper"))


@query("op5_language_codes")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_codes.identify(table(spark, sf_dir, "documents"))


@query("op6_sorted_projections", """
    WITH RECURSIVE v AS (
        SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
    r AS (SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT p.b, r.c FROM r JOIN p ON r.id = p.a AND r.c < p.b),
    m AS (SELECT id, min(c) AS c FROM r GROUP BY id),
    n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
    SELECT vec_id, coalesce(n.n, 0) AS n_links, m.c AS component_id, m.c = vec_id AS kept
    FROM embeddings JOIN m ON m.id = vec_id LEFT JOIN n ON n.a = vec_id
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorted_projections.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op7_license_notices")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_notices.scan(table(spark, sf_dir, "documents")).drop("spans")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op8_phrase_index", f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
    i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    win AS (SELECT item_id, least(10, len(w)) AS n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS g
            FROM i, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(s) WHERE len(w) > 0),
    lens AS (SELECT DISTINCT n FROM win),
    dwin AS (SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS g
             FROM d, lens, unnest(range(1, greatest(len(w) - n + 2, 1))) AS t(s)),
    met AS (SELECT r, s, n, item_id FROM dwin JOIN win USING (n, g)),
    hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM met, unnest(range(s, s + n)) AS t(p) GROUP BY r),
    its AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
            FROM (SELECT DISTINCT r, item_id FROM met) GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


@query("op9_minmax_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_additive_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive_quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_spelling_variants", r"""
    WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
            lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
    runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents)
            WHERE len(run) >= 7 GROUP BY ALL),
    points AS (SELECT *, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c: CAST(unicode(c) AS BIGINT)) AS p FROM runs),
    hashed AS (SELECT run, n, xor(list_reduce(list_concat([4294967295], flatten(list_transform(p, lambda c: CASE WHEN c < 128 THEN [c] ELSE [192 + (c >> 6), 128 + (c & 63)] END))),
            lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS h FROM points, tab),
    words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 31 = 0 THEN left(run, h % len(run)) || substr(run, h % len(run) + 2) ELSE run END AS word FROM hashed)
            WHERE len(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
    shorter AS MATERIALIZED (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS s FROM words, unnest(range(len(word))) AS t(i)),
    pairs AS (SELECT a.word AS a, b.word AS b, b.n AS nb FROM shorter a JOIN shorter b USING (i, s) WHERE a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM shorter a JOIN words b ON a.s = b.word
        UNION SELECT b.word, a.word, a.n FROM shorter a JOIN words b ON a.s = b.word),
    near AS (SELECT a AS word, count(*) AS n_near, min((-nb, b)) AS best FROM pairs GROUP BY a),
    forms AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 10 * n THEN best[2] END AS form, CASE WHEN -best[1] >= 10 * n THEN -best[1] END AS form_n
              FROM words LEFT JOIN near USING (word)),
    chain AS (SELECT word, word AS final, form AS next FROM forms UNION ALL SELECT chain.word, chain.next, forms.form FROM chain JOIN forms ON forms.word = chain.next)
    SELECT forms.word, form, final AS root, n, n_near, form_n FROM forms JOIN chain ON chain.word = forms.word AND chain.next IS NULL
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(table(spark, sf_dir, "documents"))


@query("op12_trie_dedup", r"""
    SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
           doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
    FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_dedup.exact_copies(table(spark, sf_dir, "documents"))


def _codes_sql(rounds: int) -> str:
    """Rounds of assignment and floored means, in doubles that hold integers."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, part, min((d, entry)) AS m FROM (SELECT vec_id, p.part, entry,
            list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.x) + list_inner_product(b.x, b.x) AS d FROM p JOIN b{i} b ON p.part = b.part) GROUP BY ALL)""")
        if i < rounds:
            steps.append(f"""b{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(u.x, b.x) AS x FROM b{i} b LEFT JOIN (
                SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY k) AS x FROM (
                    SELECT part, entry, k, count(*) AS n, sum(CAST(x[k] AS BIGINT)) AS s
                    FROM (SELECT p.part, a.m[2] AS entry, x FROM a{i} a JOIN p USING (vec_id, part)), unnest(range(1, len(x) + 1)) AS t(k) GROUP BY ALL) GROUP BY ALL) u
                USING (part, entry))""")
    return f"""
    WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS MATERIALIZED (SELECT vec_id, part, e[part * len(e) // 4 + 1:(part + 1) * len(e) // 4] AS x FROM v, range(4) AS t(part)),
    b0 AS MATERIALIZED (SELECT part, entry, x FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v
        QUALIFY row_number() OVER (ORDER BY vec_id) <= 256) USING (vec_id)),
    {", ".join(steps)},
    c AS (SELECT vec_id, string_agg(format('{{:02x}}', m[2]), '' ORDER BY part) AS code, CAST(sum(m[1]) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
    h AS (SELECT sha256(string_agg(CAST(CAST(x[k] AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, k)) AS codebooks_sha256
          FROM b{rounds}, unnest(range(1, len(x) + 1)) AS t(k))
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN v USING (vec_id), h
"""


@query("op13_orchard_codes", _codes_sql(orchard_codes.ROUNDS))
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orchard_codes.codes(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
