r"""Quality rules by cross-document line frequency.

Lines are normalised (ASCII white space stripped at both ends, lower-cased) and hashed. For every host the number of
distinct documents that hold a line is counted: distinct doc_ids (count="documents", as op10 does), or distinct texts
(count="texts"), where exact copies count once. Lines above the limit, the same for a small and a large host, are
boilerplate and are removed; a document of which too small a share of words is left is rejected.
Beside this verdict stand plain per-document rules on word count and on repeated word windows. DataFrame functions only.

Per-document features never leave their row. The line counts shuffle hashes, aggregated before the shuffle; the
boilerplate table comes back by a broadcast when its counted size allows. A larger one is parted by frequency: its most
frequent lines, as many as may be broadcast, come by a broadcast, the others by a shuffled join, in which no key is then
more frequent than any of those.

Defined cases: a null text has no words and fails; a very long one is split and counted whole, within its row; a null host
is a host of its own; a null doc_id is an id like any other; repeated rows each get their own row back; extra columns pass through, and an input column named like a result
is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, WS_RE, documents, let, settle, sql_string

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: A line is boilerplate when it stands in more than this many distinct documents of its host.
MIN_DOCS = 20
#: The share of a host's documents that the SQL also asks for; it tells only in hosts of over MIN_DOCS / MAX_SHARE documents.
MAX_SHARE = 0.02
#: Documents keep at least this share of their words when boilerplate goes.
MIN_LEFT = 0.3
#: Rows of a boilerplate table small enough to broadcast (24 bytes each).
BROADCAST_ROWS = 200_000

RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_lines", "n_left_words", "kept"]


def _sql_words(text: str) -> str:
    return f"filter(split({text}, {sql_string(WS_RE)}, -1), w -> w <> '')"


def base_features(text: str) -> str:
    """SQL struct of the per-document features of the (non-null) string expression `text`."""
    # positions of windows whose hash occurs elsewhere, then the words that they cover
    marks = "filter(transform(s, (x, j) -> IF((j > 0 AND s[j - 1].h = x.h) OR (j < size(s) - 1 AND s[j + 1].h = x.h), x.i, -1)), p -> p >= 0)"
    covered = f"aggregate(transform(r, (p, j) -> IF(j < size(r) - 1, least({WINDOW}, r[j + 1] - p), {WINDOW})), 0L, (a, x) -> a + x)"
    repeated = let("array_sort(transform(g, (h, i) -> struct(h, i)))", "s", let(f"array_sort({marks})", "r", covered))
    grams = f"transform(sequence(1, size(w) - {WINDOW - 1}), i -> xxhash64(slice(v, i, {WINDOW})))"
    windows = let("transform(w, x -> xxhash64(x))", "v", let(grams, "g", f"IF(size(array_distinct(g)) = size(g), 0L, {repeated})"))
    lines = f"filter(split({text}, '\\n', -1), x -> length(btrim(x, {sql_string(WS)})) > 0)"
    body = f"""struct(
        cast(size(w) AS bigint) AS n_words,
        cast(length(array_join(w, '')) AS bigint) AS word_chars,
        cast(length({text}) - length(translate({text}, '{SYMBOLS}', '')) AS bigint) AS n_symbols,
        cast({let(lines, 'l', 'size(l) - size(array_distinct(l))')} AS bigint) AS n_dup_lines,
        IF(size(w) < {WINDOW}, 0L, {windows}) AS n_repeat_words)"""
    return let(_sql_words(text), "w", body)


def line_hash(line: str) -> str:
    return f"xxhash64(lower(btrim({line}, {sql_string(WS)})))"


def boilerplate(docs: DataFrame, *, host: str = "source", min_docs: int = MIN_DOCS, max_share: float | None = None, count: str = "texts") -> DataFrame:
    """(host, h, n): hashes of the lines that stand in n > min_docs distinct documents (or texts) of a host.

    With max_share also in more than this share of them, which lets lines of large hosts stay."""
    unit = {"documents": F.col("doc_id"), "texts": F.xxhash64("text")}[count]
    own = docs.select("doc_id", F.col(host).cast("string").alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    hashes = f"array_distinct(transform(filter(split(text, '\\n', -1), x -> length(btrim(x, {sql_string(WS)})) > 0), x -> {line_hash('x')}))"
    lines = own.select("host", unit.alias("t"), F.explode(F.expr(hashes)).alias("h"))
    # distinct (host, line, document), then a count: both aggregates combine before their shuffles
    counts = lines.distinct().groupBy("host", "h").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.filter(F.col("n") > min_docs)
    if max_share is None:
        return counts.select("host", "h", "n")
    texts = own.select("host", unit.alias("t")).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"))
    counts = counts.join(texts.withColumnRenamed("host", "host2"), F.col("host").eqNullSafe(F.col("host2")))
    return counts.filter(F.col("n") > F.col("n_docs") * max_share).select("host", "h", "n")


def _with_boilerplate(lines: DataFrame, common: DataFrame, broadcast_rows: int) -> DataFrame:
    """The rows of lines that common names."""
    on = ["__qr_host", "__qr_null", "__qr_h"]
    names, total = common.select(*on), common.count()
    if total <= broadcast_rows:
        return lines.join(F.broadcast(names), on)
    limit = common.agg(F.percentile_approx("__qr_n", 1 - broadcast_rows / total, 10_000)).first()[0]
    frequent = common.filter(F.col("__qr_n") > limit).select(*on)
    if not 0 < frequent.count() <= 2 * broadcast_rows:  # none above, or the percentile is off: plain shuffle
        return lines.join(names, on)
    others = lines.join(F.broadcast(frequent), on, "left_anti").join(common.filter(F.col("__qr_n") <= limit).select(*on), on)
    return lines.join(F.broadcast(frequent), on).unionByName(others)


def quality_rules(
    docs: DataFrame,
    *,
    host: str = "source",
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
    min_docs: int = MIN_DOCS,
    max_share: float | None = None,
    min_left: float = MIN_LEFT,
    broadcast_rows: int = BROADCAST_ROWS,
    count: str = "texts",
) -> DataFrame:
    """docs with the features, base_failed, n_removed_lines, n_left_words and kept."""
    common = settle(boilerplate(docs, host=host, min_docs=min_docs, max_share=max_share, count=count), "boilerplate")
    common = common.select(F.coalesce("host", F.lit("")).alias("__qr_host"), F.col("host").isNull().alias("__qr_null"), F.col("h").alias("__qr_h"), F.col("n").alias("__qr_n"))
    body = docs.select("doc_id", F.col(host).cast("string").alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    key = {"__qr_k": F.col("doc_id"), "__qr_t": F.xxhash64("text")}
    size = f"size({_sql_words('x')})"
    lines = (
        body.withColumns(key)
        .select(
            "__qr_k", "__qr_t", "host",
            F.posexplode(F.expr(f"transform(filter(split(text, '\\n', -1), x -> length(btrim(x, {sql_string(WS)})) > 0), x -> struct({line_hash('x')} AS h, {size} AS n))")).alias("pos", "z"),
        )
        .select("__qr_k", "__qr_t", "pos", F.coalesce("host", F.lit("")).alias("__qr_host"), F.col("host").isNull().alias("__qr_null"), F.col("z.h").alias("__qr_h"), F.col("z.n").alias("n"))
    )
    hit = _with_boilerplate(lines, common, broadcast_rows)
    # a repeated row repeats its lines: (k, t, host, pos) holds each once
    gone = (
        hit.groupBy("__qr_k", "__qr_t", "__qr_host", "__qr_null", "pos").agg(F.max("n").alias("n"))
        .groupBy("__qr_k", "__qr_t", "__qr_host", "__qr_null").agg(F.count(F.lit(1)).alias("__qr_lines"), F.sum("n").alias("__qr_words"))
    )
    gone = gone.withColumns({"__qr_k": F.coalesce("__qr_k", F.lit(0)), "__qr_nk": F.col("__qr_k").isNull()})
    text = F.coalesce("text", F.lit(""))
    own = docs.withColumns(
        {
            "__qr_t": F.xxhash64(text), "__qr_k": F.coalesce("doc_id", F.lit(0)), "__qr_nk": F.col("doc_id").isNull(),
            "__qr_host": F.coalesce(F.col(host).cast("string"), F.lit("")), "__qr_null": F.col(host).isNull(),
            "__qr_base": F.expr(base_features("coalesce(text, '')")),
        }
    )
    out = own.join(gone, ["__qr_k", "__qr_nk", "__qr_t", "__qr_host", "__qr_null"], "left").withColumns(
        {f: F.col(f"__qr_base.{f}") for f in RESULTS[:5]}
        | {"n_removed_lines": F.coalesce("__qr_lines", F.lit(0)).cast("long"), "__qr_gone": F.coalesce("__qr_words", F.lit(0)).cast("long")}
    )
    out = out.withColumns({"n_left_words": F.col("n_words") - F.col("__qr_gone"), "base_failed": (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))})
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("n_left_words") >= F.col("n_words") * min_left))
    return out.select(*dict.fromkeys([*docs.columns, *RESULTS]))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir).select("doc_id", "text", "source"), count="documents").select("doc_id", *RESULTS)


#: A limit so low that lines and documents go in small tables too.
LOW_LIMIT = 1


def quality_rules_low_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line rule alone, with every line boilerplate that stands in two documents of a host."""
    out = quality_rules(documents(spark, sf_dir).select("doc_id", "text", "source"), min_docs=LOW_LIMIT, count="documents")
    return out.select("doc_id", "n_words", "n_removed_lines", "n_left_words", (F.col("n_left_words") < F.col("n_words") * MIN_LEFT).alias("depleted"))


LOW_LIMIT_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS ws FROM documents
), lk AS (
  SELECT doc_id, source, lower(trim(line, ws)) AS key, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT doc_id, source, ws, unnest(string_split(text, chr(10))) AS line FROM d) WHERE trim(line, ws) <> ''
), common AS (
  SELECT source, key FROM lk GROUP BY source, key HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) > {LOW_LIMIT}
), gone AS (
  SELECT doc_id, count(*) AS nl, sum(n) AS nw FROM lk JOIN common c ON lk.source IS NOT DISTINCT FROM c.source AND lk.key = c.key GROUP BY doc_id
), counts AS (
  SELECT d.doc_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n_words, coalesce(nl, 0) AS n_removed_lines, coalesce(nw, 0) AS nw
  FROM d LEFT JOIN gone ON gone.doc_id = d.doc_id
)
SELECT doc_id, n_words, n_removed_lines, CAST(n_words - nw AS BIGINT) AS n_left_words, n_words - nw < n_words * {MIN_LEFT} AS depleted FROM counts
"""

ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS ws FROM documents
), w AS (
  SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d
), flat AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM w
), win AS (
  SELECT doc_id, i, CASE WHEN count(*) OVER f = 8 THEN string_agg(word, ' ') OVER f END AS g
  FROM flat WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)
), rep AS (
  SELECT doc_id, i, g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 AS r FROM win
), cov AS (
  SELECT doc_id, max(r) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c FROM rep
), nrep AS (SELECT doc_id, count(*) FILTER (WHERE c) AS n_repeat_words FROM cov GROUP BY doc_id
), l AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, ws FROM d
), lk AS (
  SELECT doc_id, source, text, line, lower(trim(line, ws)) AS key, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l WHERE trim(line, ws) <> ''
), dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lk GROUP BY doc_id
), hosts AS (SELECT source, count(DISTINCT text) AS nd FROM d GROUP BY source
), common AS (
  SELECT lk.source, key FROM lk JOIN hosts ON lk.source IS NOT DISTINCT FROM hosts.source
  GROUP BY lk.source, key HAVING count(DISTINCT text) > {MIN_DOCS} AND count(DISTINCT text) > max(nd) * {MAX_SHARE}
), gone AS (
  SELECT doc_id, count(*) AS nl, sum(n) AS nw FROM lk JOIN common c ON lk.source IS NOT DISTINCT FROM c.source AND lk.key = c.key GROUP BY doc_id
), base AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(text) - length(translate(text, '{SYMBOLS}', '')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(nl, 0) AS n_removed_lines, CAST(len(w) - coalesce(nw, 0) AS BIGINT) AS n_left_words
  FROM d JOIN w USING (doc_id) LEFT JOIN nrep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id)
), failed AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND n_left_words >= n_words * {MIN_LEFT} AS kept FROM failed
"""
