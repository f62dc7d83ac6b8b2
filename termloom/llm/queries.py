"""The opN_<name> queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, fingerprints, langid, mixing, neardup, packing, pii, quality, runs, secrets, urls, warc, whitening
from .common import shared_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


#: Phrases and symbols as literals of the oracle.
_PHRASES = " OR ".join(f"contains(lower(line), '{p}')" for p in quality.BOILERPLATE)
_W = r"[^\x20\x09-\x0D]+"


@query(
    "op9_quality_rules",
    rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
    w AS (SELECT rid, u.w, u.i FROM d, LATERAL (SELECT unnest(regexp_extract_all(text, '{_W}')) AS w, generate_subscripts(regexp_extract_all(text, '{_W}'), 1) AS i) u),
    t AS (SELECT rid, i, w, lead(w, 1) OVER p AS w1, lead(w, 2) OVER p AS w2 FROM w WINDOW p AS (PARTITION BY rid ORDER BY i)),
    r AS (SELECT rid, i FROM t WHERE w2 IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, w, w1, w2) > 1),
    rep AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, i + k AS p FROM r, (SELECT unnest([0, 1, 2]) AS k)) GROUP BY rid),
    l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
    m AS (SELECT rid, line, len(regexp_extract_all(line, '{_W}')) AS n, len(regexp_extract_all(line, '[|»›•]')) AS seps,
            len(regexp_extract_all(line, '[#*$%&|<>=+_~^{{}}\[\]\\@/]')) AS syms FROM l),
    lw AS (SELECT rid, count(*) - count(DISTINCT line) AS dup,
            sum(CASE WHEN syms > 0.3 * length(line) OR (seps >= 3 AND 2 * seps >= n - seps) OR ({_PHRASES})
                  OR (n < 3 AND right(rtrim(line, concat(' ', chr(9), chr(11), chr(12), chr(13))), 1) NOT IN ('.', '!', '?', '…', ':', ';', ',', '"', '''', ')', '»', '”')) THEN n ELSE 0 END) AS lost
          FROM m WHERE n > 0 GROUP BY rid),
    a AS (SELECT doc_id, CAST(len(regexp_extract_all(text, '{_W}')) AS BIGINT) AS n_words, CAST(length(array_to_string(regexp_extract_all(text, '{_W}'), '')) AS BIGINT) AS word_chars,
            CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines,
            CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost, 0) AS BIGINT) AS words_lost
          FROM d LEFT JOIN rep USING (rid) LEFT JOIN lw USING (rid))
    SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
           NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND words_lost <= 0.5 * n_words AS kept FROM a
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules over every whole document."""
    return quality.judge(table(spark, sf_dir, "documents"))


@query(
    "op4_source_mixing",
    rf"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_W}')) AS size,
                      md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':1') AS key FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM d GROUP BY source),
    w AS (SELECT *, (rn - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s),
    o AS (SELECT *, row_number() OVER z AS k, sum(cap) OVER (z ROWS UNBOUNDED PRECEDING) AS cc, sum(weight) OVER (z ROWS UNBOUNDED PRECEDING) AS cw
          FROM w WINDOW z AS (ORDER BY cap / weight, rn)),
    tot AS (SELECT sum(source_size) AS t, sum(weight) AS tw FROM w),
    lv AS (SELECT 0 AS k, CAST(t AS DOUBLE) / tw AS level FROM tot
           UNION ALL SELECT k, CAST(t - cc AS DOUBLE) / (tw - cw) FROM o, tot WHERE tw > cw),
    pick AS (SELECT level FROM lv JOIN o ON o.k = lv.k + 1 WHERE o.cap >= o.weight * level ORDER BY lv.k LIMIT 1),
    g AS (SELECT source, source_size, CASE WHEN cap < weight * level THEN CAST(cap AS DOUBLE) ELSE weight * level END AS target FROM w, pick),
    e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM g),
    r AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, floor(e.target - e.epochs * e.source_size) AS rest,
                 sum(size) OVER (PARTITION BY d.source ORDER BY key) AS upto, sum(size) OVER (PARTITION BY d.source, key) AS tied
          FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
    SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
           CAST(epochs * size + CASE WHEN upto <= rest THEN size WHEN upto - tied <= rest THEN floor(size * (rest - (upto - tied)) / tied) ELSE 0 END AS BIGINT) AS taken FROM r
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix every document of every source to the target weights."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op5_secret_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole document, decoded layers included."""
    return secrets.digests(table(spark, sf_dir, "documents"))


@query("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole document."""
    return langid.identify(table(spark, sf_dir, "documents"))


#: The rules of the query, (action, host, path).
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


@query(
    "op10_url_filter",
    r"""
    WITH p AS (SELECT page_id, row_number() OVER () AS rid,
                 translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
    r(verdict, h, pre) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
    m AS (SELECT rid, h || pre AS rule, verdict FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre)
          QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length(h || pre) DESC) = 1)
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (rid)
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return urls.judge(table(spark, sf_dir, "pages"), urls.rule_table(spark, URL_RULES))


def tokenizer_path() -> str:
    """The tokenizer file, from the package that every node has installed."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack every whole document into sequences of 2048 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query(
    "op7_warc",
    r"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    b AS (SELECT *, sha1(h) AS sha, min(page_id) OVER (PARTITION BY h) AS first FROM p),
    d AS (SELECT *, (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(sha, 10 * k + 1, 10) AS BIGINT) // CAST(pow(32, 7 - i) AS BIGINT)) % 32 AS INTEGER) + 1, 1), '' ORDER BY k, i)
                     FROM (SELECT unnest(range(4)) AS k), (SELECT unnest(range(8)) AS i)) AS digest FROM b)
    SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, digest AS payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d
    """,
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page and read the archive back."""
    return warc.round_trip(table(spark, sf_dir, "pages"), shared_folder(spark))


@query("op3_fingerprints")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole document and its edited text."""
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


@query("op6_near_duplicates")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every whole document."""
    return neardup.classes(table(spark, sf_dir, "documents"))


@query("op2_pii_surrogates")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document with its personal data replaced by surrogates."""
    return pii.replace(table(spark, sf_dir, "documents").select("doc_id", "text"))


_V = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op11_decontamination",
    rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '{_V}') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_V}') AS w FROM benchmark),
    bw AS (SELECT item_id, least(len(w), 10) AS n, unnest(range(len(w) - least(len(w), 10) + 1)) AS i, w FROM b WHERE len(w) > 0),
    win AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1 : i + n], ' ') AS t FROM bw),
    dw AS (SELECT rid, n, unnest(range(len(w) - n + 1)) AS i, w FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
    hit AS (SELECT rid, i, dw.n, item_id FROM dw JOIN win ON dw.n = win.n AND array_to_string(w[i + 1 : i + dw.n], ' ') = t),
    places AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM hit)) GROUP BY rid),
    lists AS (SELECT rid, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS sha
              FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN places USING (rid) LEFT JOIN lists USING (rid)
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in every whole document."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_embedding_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every usable embedding."""
    return whitening.components(table(spark, sf_dir, "embeddings"))


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every whole document."""
    return runs.digests(table(spark, sf_dir, "documents"))
