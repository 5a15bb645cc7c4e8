"""Near-duplicate detection by min-max hashing, confirmed on full shingle sets.

1. Every document's set of distinct word shingles is hashed under PERMUTATIONS permutations, of which both minimum and
   maximum are kept: twice as many signature entries as hash evaluations. The signature is cut into bands; documents
   with equal sets form a class, and only classes go on.
2. Classes that share a band's value are candidates. A band's bucket is never expanded into pairs: its members meet one
   pivot, the member with the most collisions overall, and each such link is confirmed on the full sets. Large stars are
   cut into parts, whose numbers reach the members by a broadcast behind a count.
3. Connected components of the confirmed links (large-star / small-star, each round written to the shared folder).
4. Buckets whose members are not yet in one component are examined block against block: signatures first (with the
   pair left to the first band it shares), then, for members with a partner left, the full sets. What leaves a block is
   links between components, not pairs.
5. Components again; every class, and with it every document, gets the smallest doc_id of its component.

The number of bands follows from the threshold: a pair exactly at it is missed with a probability under MAX_MISS.

Defined cases: a document without words is linked with nothing; a very long text is cut into shingles alone and whole; with fewer words than a shingle has, the whole sequence
is its one shingle; a null doc_id orders after all others and stands
for the id 2^63 - 1; rows that share a doc_id are looked at text by text and all
kept or dropped by the same rule; extra columns pass through, and an input column named like a result is replaced; an
empty table gives an empty result. Shingles are compared by 64-bit hashes, classes by 128-bit digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MAX_LONG, documents, map_texts, settle, text_slices

PERMUTATIONS = 64
MAX_MISS = 1e-6
#: Estimated similarity may fall short of the threshold by this much (over six standard deviations of 128 entries).
SLACK = 0.22
#: Members of a star's part; members of a block, and their shingles, at most about.
STAR, BLOCK, BLOCK_SHINGLES = 200, 512, 2_000_000
#: Classes whose texts are fetched by a broadcast of their ids (24 bytes each); beyond, by a shuffled join.
BROADCAST_ROWS = 500_000

_random = np.random.default_rng(20240607)
MULTIPLIERS = (_random.integers(0, 1 << 32, PERMUTATIONS, np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
BAND_KEYS = _random.integers(0, 1 << 63, (2 * PERMUTATIONS, 2 * PERMUTATIONS), np.uint64) | np.uint64(1)


def band_rows(percent: int) -> int:
    """Rows of a band: as many as keep the chance to miss a pair at the threshold under MAX_MISS."""
    s = percent / 100
    return max([r for r in range(1, 17) if (1 - s**r) ** (2 * PERMUTATIONS // r) <= MAX_MISS], default=1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; ASCII letters lower-cased, words cut at ASCII white space."""
    import xxhash

    w = np.fromiter(map(xxhash.xxh3_64_intdigest, text.encode().lower().split()), np.uint64)
    if not len(w):
        return w
    n = min(words, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h = (h ^ w[i : len(w) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03)
        h ^= h >> np.uint64(29)
    return np.unique(_mix(h))


def digest(sets: np.ndarray) -> bytes:
    return hashlib.blake2b(sets.tobytes(), digest_size=16).digest()


def signature(sets: np.ndarray) -> np.ndarray:
    """Minimum and maximum under each permutation (multiplication by an odd number is one of 32-bit numbers)."""
    x = (sets >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(PERMUTATIONS, 2**32 - 1, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    for i in range(0, len(x), 4096):
        y = MULTIPLIERS * x[i : i + 4096]
        low, high = np.minimum(low, y.min(1)), np.maximum(high, y.max(1))
    return np.concatenate([low, high])


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    n = len(sig) // rows
    keys = BAND_KEYS[:n, :rows]
    return _mix((sig[: n * rows].reshape(n, rows).astype(np.uint64) * keys).sum(1, dtype=np.uint64) + BAND_KEYS[:n, -1]).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = int(np.isin(a, b, assume_unique=True, kind="sort").sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


class _Groups:
    """Sizes of small sets under union."""

    def __init__(self):
        self.above: dict = {}

    def find(self, x):
        above = self.above
        while above.setdefault(x, x) != x:
            above[x] = x = above[above[x]]
        return x

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        self.above[a] = b
        return a != b


def _stars_only(edges: DataFrame) -> bool:
    """Whether every node is either a centre (v) or has a single edge to one (u)."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("n"), F.lit(0).alias("centre")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("n").alias("n"), F.max("centre").alias("centre")).filter("n + centre > 1").isEmpty()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) for the nodes of edges (a, b): label is the smallest node of the connected component.

    Alternating large-star and small-star steps until nothing changes; each round is a table in the shared folder."""
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = settle(edges, name)
    while not _stars_only(edges):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = settle(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), name)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


class NearDuplicates:
    def __init__(self, docs: DataFrame, *, words: int, percent: int, text: str = "text"):
        self.words, self.percent, self.rows = words, percent, band_rows(percent)
        self.docs = docs
        body = docs.select(F.coalesce("doc_id", F.lit(MAX_LONG)).cast("long").alias("k"), F.col(text).alias("text"))
        self.texts = body
        self.sketches = settle(self._sketch(body), "sketches")
        full = self.sketches.filter("n > 0")
        classes = full.groupBy("c").agg(F.min("k").alias("k"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
        self.classes = settle(classes, "classes")
        self.members = settle(self._members(), "members")
        self.links = settle(self._stars(), "links")
        labels = components(self.links)
        rest = settle(self._rest(labels), "links")
        self.links = self.links.unionByName(rest)
        self.labels = components(labels.toDF("a", "b").unionAll(rest))

    def _sketch(self, body: DataFrame) -> DataFrame:
        words, rows = self.words, self.rows

        def kernel(texts: list[str]) -> dict:
            out: dict[str, list] = {"n": [], "c": [], "bands": [], "sig": []}
            for t in texts:
                s = shingles(t, words)
                sig = signature(s) if len(s) else None
                out["n"].append(len(s))
                out["c"].append(digest(s) if len(s) else None)
                out["bands"].append(bands(sig, rows) if len(s) else None)
                out["sig"].append(sig.astype(np.uint8).tobytes() if len(s) else None)
            return out

        return map_texts(body, lambda: kernel, "n long, c binary, bands array<long>, sig binary", ["k"])

    def _members(self) -> DataFrame:
        """(b, c, n, size): classes in buckets of at least two."""
        each = self.classes.select("c", "n", F.explode("bands").alias("b"))
        sizes = each.groupBy("b").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        return each.join(sizes, "b")

    def _stars(self) -> DataFrame:
        """Confirmed links (a, b) of members with their bucket's pivot."""
        weight = self.members.groupBy("c").agg(F.sum("size").alias("weight"))
        best = F.max(F.struct("weight", "n", "c")).alias("p")
        pivots = self.members.join(weight, "c").groupBy("b").agg(best).select("b", F.col("p.c").alias("p"), F.col("p.n").alias("pn"))
        pairs = self.members.join(pivots, "b").filter("c <> p")
        pairs = pairs.filter(100 * F.least("n", "pn") >= self.percent * F.greatest("n", "pn")).select("p", "c").distinct()
        pairs = settle(pairs, "pairs")
        parts = pairs.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / STAR).alias("parts"))
        # only pivots of several parts need the join: one row for STAR pairs at least
        hot = settle(parts.filter("parts > 1"), "hot_pivots")
        hot = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot
        pairs = pairs.join(hot, "p", "left").withColumn("part", F.pmod(F.xxhash64("c"), F.coalesce("parts", F.lit(1).cast("long"))))
        centres = parts.select("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("p").alias("c"))
        rows = centres.withColumn("member", F.lit(0)).unionByName(pairs.select("p", "part", "c").withColumn("member", F.lit(1)))
        words, percent = self.words, self.percent

        def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centre, of = None, None
            for batch in batches:
                p, part, c = (batch.column(i).to_pylist() for i in range(3))
                found: list[tuple[bytes, bytes]] = []
                for start, texts in text_slices(batch.column(4)):
                    for i, t in enumerate(texts, start):
                        s = shingles(t, words)
                        if digest(s) != c[i]:  # another text of a repeated doc_id
                            continue
                        if p[i] == c[i]:
                            centre, of = s, (p[i], part[i])
                        elif of == (p[i], part[i]) and similar(s, centre, percent):
                            found.append((p[i], c[i]))
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], pa.binary()) for j in (0, 1)], names=["a", "b"])

        n = int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ready = self._with_text(rows).select("p", "part", "c", "member", "text").repartition(n, "p", "part").sortWithinPartitions("p", "part", "member")
        return ready.mapInArrow(confirm, "a binary, b binary").distinct()

    def _with_text(self, rows: DataFrame) -> DataFrame:
        """rows (with c) beside the text of a document of class c (and perhaps other texts of its doc_id)."""
        need = rows.select("c").distinct().join(self.classes.select("c", "k"), "c")
        need = settle(need, "needed")
        small = need.count() <= BROADCAST_ROWS
        found = self.texts.join(F.broadcast(need) if small else need, "k").select("c", "text")
        return rows.join(found, "c")

    def _rest(self, labels: DataFrame) -> DataFrame:
        """Links that buckets not yet in one component still lack."""
        known = self.members.select("b", "c", "n").join(labels, F.col("c") == F.col("node"), "left").select("b", "c", "n", F.coalesce("label", "c").alias("label"))
        parts = known.groupBy("b", "label").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("w"))
        open_ = parts.groupBy("b").agg(F.max(F.struct("k", "w", "label")).alias("top"), F.sum("k").alias("k"), F.sum("w").alias("w")).filter("k > top.k")
        blocks_of = lambda k, w: F.greatest(F.ceil(k / BLOCK), F.ceil(w / BLOCK_SHINGLES))
        open_ = open_.select("b", F.col("top.label").alias("most"), blocks_of(F.col("k") - F.col("top.k"), F.col("w") - F.col("top.w")).alias("few"), blocks_of(F.col("top.k"), F.col("top.w")).alias("many"))
        # the largest component's blocks meet the others' only; the others' meet each other too
        rows, of_most = known.join(open_, "b"), F.col("label") == F.col("most")
        rows = rows.withColumn("own", F.when(of_most, F.col("few") + F.pmod(F.xxhash64("c"), F.col("many"))).otherwise(F.pmod(F.xxhash64("c"), F.col("few"))))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(of_most, F.col("few") - 1).otherwise(F.col("few") + F.col("many") - 1))))
        rows = rows.select("b", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "c", "label")
        rows = settle(rows, "blocks")
        percent, band, words = self.percent, self.rows, self.words
        n = int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

        def pairs(b, block, own, label, sig, band_values, size):
            """Index pairs of a block that are left to bucket b, have two labels and may be similar, likely ones first."""
            need = int((percent / 100 - SLACK) * sig.shape[1])
            found = []
            for x in range(len(label) - 1):
                ys = np.arange(x + 1, len(label))
                if block[0] != block[1]:
                    ys = ys[own[ys] != own[x]]
                ys = ys[label[ys] != label[x]]
                ys = ys[100 * np.minimum(size[ys], size[x]) >= percent * np.maximum(size[ys], size[x])]
                alike = (sig[ys] == sig[x]).sum(1)
                ys, alike = ys[alike >= need], alike[alike >= need]
                if len(ys):
                    shared = band_values[ys] == band_values[x]
                    first = band_values[x][shared.argmax(1)] == b
                    found += zip(alike[first].tolist(), [x] * int(first.sum()), ys[first].tolist())
            return [(x, y) for _, x, y in sorted(found, key=lambda f: -f[0])]

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
            key, rows = None, []
            for batch in batches:
                for row in batch.to_pylist():
                    if (now := (row["b"], row["i"], row["j"])) != key:
                        if rows:
                            yield key, rows
                        key, rows = now, []
                    rows.append(row)
            if rows:
                yield key, rows

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: dict[str, list] = {x: [] for x in ("b", "i", "j", "own", "c", "label")}
            for key, rows in blocks(batches):
                labels_ = np.array([r["label"] for r in rows], object)
                sig = np.frombuffer(b"".join(r["sig"] for r in rows), np.uint8).reshape(len(rows), -1)
                got = pairs(key[0], key[1:], np.array([r["own"] for r in rows]), labels_, sig, np.array([r["bands"] for r in rows]), np.array([r["n"] for r in rows]))
                for x in sorted({x for pair in got for x in pair}):
                    for name in out:
                        out[name].append(rows[x][name])
                if len(out["b"]) > 5000:
                    yield pa.RecordBatch.from_pydict(out, schema=schema)
                    out = {x: [] for x in out}
            yield pa.RecordBatch.from_pydict(out, schema=schema)

        schema = pa.schema([("b", pa.int64()), ("i", pa.int64()), ("j", pa.int64()), ("own", pa.int64()), ("c", pa.binary()), ("label", pa.binary())])
        fields = "b long, i long, j long, own long, c binary, label binary"
        signed = rows.join(self.classes.select("c", "n", "sig", "bands"), "c")
        left = settle(signed.repartition(n, "b", "i", "j").sortWithinPartitions("b", "i", "j").mapInArrow(look, fields), "left")

        def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for key, rows in blocks(batches):
                sets, keep = {}, []
                for r in rows:
                    s = shingles(r["text"] or "", words)
                    if digest(s) == r["c"] and r["c"] not in sets:
                        sets[r["c"]] = s
                        keep.append(r)
                sigs = [signature(sets[r["c"]]) for r in keep]
                if len(keep) < 2:
                    continue
                arrays = (np.stack(sigs).astype(np.uint8), np.stack([bands(s, band) for s in sigs]), np.array([len(sets[r["c"]]) for r in keep]))
                one, found = _Groups(), []
                for x, y in pairs(key[0], key[1:], np.array([r["own"] for r in keep]), np.array([r["label"] for r in keep], object), *arrays):
                    a, b = keep[x], keep[y]
                    if one.find(a["label"]) != one.find(b["label"]) and similar(sets[a["c"]], sets[b["c"]], percent):
                        one.join(a["label"], b["label"])
                        found.append((a["c"], b["c"]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], pa.binary()) for j in (0, 1)], names=["a", "b"])

        ready = self._with_text(left).select("b", "i", "j", "own", "c", "label", "text").repartition(n, "b", "i", "j").sortWithinPartitions("b", "i", "j", "c")
        return ready.mapInArrow(confirm, "a binary, b binary").distinct()

    @property
    def documents(self) -> DataFrame:
        """(k, c, n_shingles, component): a row per row of the documents."""
        named = self.classes.select("c", "k").join(self.labels, F.col("c") == F.col("node"), "left").select("c", "k", F.coalesce("label", "c").alias("label"))
        least = named.groupBy("label").agg(F.min("k").alias("component"))
        of = named.join(least, "label").select("c", "component")
        return self.sketches.select("k", "c", F.col("n").alias("n_shingles")).join(of, "c", "left").withColumn("component", F.coalesce("component", "k"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = NearDuplicates(documents(spark, sf_dir).select("doc_id", "text"), words=3, percent=85).documents
    doc_id, component = F.expr(f"nullif(k, {MAX_LONG}L)"), F.expr(f"nullif(component, {MAX_LONG}L)")
    return out.select(doc_id.alias("doc_id"), "n_shingles", component.alias("component_id"), (F.col("k") == F.col("component")).alias("kept"))


def keep_first(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id."""
    out = NearDuplicates(docs, words=words, percent=percent).documents
    keep = out.filter(F.col("k") == F.col("component")).select(F.expr(f"nullif(k, {MAX_LONG}L)").alias("__nd_id")).distinct()
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["__nd_id"]), "left_semi")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * i >= 85 * (na.n + nb.n - i)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
