"""Line deduplication with levelled sorted runs of line hashes.

Documents come in batches of ascending doc_id. A batch's distinct line hashes are anti-joined with every run that
earlier batches left; what remains is written, bucketed and sorted by hash, as the batch's own run. When a level holds
`fanout` runs they are compacted into one run of the next level. A line survives where its batch's run says that its
document is the first to hold it; this join's key holds the document too, so that a line found everywhere is dealt over
all tasks, at the price of shuffling the run. Everything is DataFrame code; each shuffle carries hashes, never texts, but
for the last join that brings the decisions to the texts. The decisions are written, and the runs removed, before that.

Defined cases: a null or empty text is one empty line; a very long text is split and joined whole, within its row; a null
doc_id orders after all others and stands for the id 2^63 - 1; rows that share a doc_id
count as one document, so a line does not repeat "across documents" within them; extra columns pass through, and an
input column named like a result is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MAX_LONG, WS, ascii_lower, discard, documents, let, settle, shared_path

MIN_KEY_CHARS = 10
BATCHES = 4
FANOUT = 2


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WS)))


class LineRuns:
    """Runs of (h1, h2, first): two independent 64-bit hashes of a line's key and the smallest document that holds it.

    The runs are bucketed tables in the shared folder, so that anti-joins on (h1, h2) shuffle the new side only.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def _write(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = shared_path(self.spark, "run")
        (
            df.repartition(self.buckets, "h1", "h2")
            .write.bucketBy(self.buckets, "h1", "h2")
            .sortBy("h1", "h2")
            .option("path", self.paths[name])
            .format("parquet")
            .saveAsTable(name)
        )
        return name

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of keys that no run holds."""
        for name in (n for level in self.levels for n in level):
            keys = keys.join(self.spark.table(name).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return keys

    def add(self, keys: DataFrame) -> DataFrame:
        """Anti-join a batch's keys (h1, h2, first) with the runs, keep the rest as a run and return that run."""
        name = self._write(self.unseen(keys))
        self._place(name, 0)
        return self.spark.table(name)

    def _place(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fanout:
            merged = self.spark.table(self.levels[level][0])
            for other in self.levels[level][1:]:
                merged = merged.unionAll(self.spark.table(other))
            self.levels[level] = []
            self._place(self._write(merged), level + 1)

    def drop(self) -> None:
        """Remove all runs, those that were compacted among them, and their files."""
        for name, path in self.paths.items():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            discard(self.spark, path)
        self.levels, self.paths = [], {}


def dedup_lines(docs: DataFrame, *, min_chars: int = MIN_KEY_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """docs with text cut down to its kept lines, and n_lines, n_dropped (long) beside it.

    Lines whose key has at least min_chars code points and occurs in several documents stay only in the smallest one.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col("text"), F.lit(""))
    key = docs.select(F.coalesce("doc_id", F.lit(MAX_LONG)).cast("long").alias("k"), F.xxhash64(body).alias("t"), body.alias("body"))
    cuts = key.agg(F.percentile_approx("k", [i / batches for i in range(1, batches)], 10000).alias("c")).first()["c"] if batches > 1 else []
    cuts = sorted(set(cuts or []))
    batch = sum((F.when(F.col("k") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    lines = (
        key.select("k", "t", batch.alias("batch"), F.posexplode(F.split("body", "\n", -1)).alias("pos", "line"))
        .select("k", "t", "batch", "pos", line_key(F.col("line")).alias("key"))
        .filter(F.length("key") >= min_chars)
        .select("k", "t", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"), "batch")
    )
    lines = settle(lines, "lines", "batch")
    runs, dropped = LineRuns(spark, fanout), None
    for i in range(len(cuts) + 1):
        own = lines.filter(F.col("batch") == i)
        run = runs.add(own.groupBy("h1", "h2").agg(F.min("k").alias("first"))).alias("run")
        own = own.alias("own")
        gone = own.join(
            run, (F.col("own.h1") == F.col("run.h1")) & (F.col("own.h2") == F.col("run.h2")) & (F.col("own.k") == F.col("run.first")), "left_anti"
        ).select("k", "t", "pos")
        dropped = gone if dropped is None else dropped.unionAll(gone)
    # a document's own lines only: as long as the document at most
    cut = settle(dropped.groupBy("k", "t").agg(F.array_sort(F.collect_set("pos")).alias("__ld_gone")), "dropped_lines")
    runs.drop()
    n = "size(g)"
    pieces = f"transform(sequence(0, {n}), i -> slice(l, IF(i = 0, 0, g[i - 1] + 1) + 1, IF(i = {n}, size(l), g[i]) - IF(i = 0, 0, g[i - 1] + 1)))"
    kept = let("split(__ld_body, '\\n', -1)", "l", let("__ld_gone", "g", f"array_join(flatten({pieces}), '\\n')"))
    out = (
        docs.withColumns({"__ld_k": F.coalesce("doc_id", F.lit(MAX_LONG)).cast("long"), "__ld_t": F.xxhash64(body), "__ld_body": body})
        .join(cut.withColumnsRenamed({"k": "__ld_k", "t": "__ld_t"}), ["__ld_k", "__ld_t"], "left")
        .withColumns(
            {
                "n_lines": (F.length("__ld_body") - F.length(F.replace("__ld_body", F.lit("\n"), F.lit(""))) + 1).cast("long"),
                "n_dropped": F.coalesce(F.size("__ld_gone"), F.lit(0)).cast("long"),
                "text": F.when(F.col("__ld_gone").isNull(), F.col("__ld_body")).otherwise(F.expr(kept)),
            }
        )
    )
    return out.select(*dict.fromkeys([*docs.columns, "n_lines", "n_dropped"]))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, coalesce(doc_id, 9223372036854775807) AS k, unnest(list_zip(range(len(l)), l)) AS z
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT doc_id, k, z[1] AS pos, z[2] AS line,
         translate(trim(z[2], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), marked AS (
  SELECT *, length(key) >= 10 AND k > min(k) OVER (PARTITION BY key) AS gone FROM keyed
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
