"""Mixing sources to target weights.

Documents of a source are packed end to end into blocks of `block_words` words. Every output shard draws, for each of
its slots, a source by the target shares: multinomial counts per shard, and these draws alone say how many blocks of a
source the mix reads. A source's draws are numbered across shards; draw number k of a source reads block perm(k mod
blocks) of pass k div blocks, where perm is a keyed Feistel permutation of the source's block numbers, so that no block
is read a second time before all were read once. Draws beyond max_repeats passes are drawn again among the sources that
have room. Blocks join the documents by (source, block).

As draws are random, a source's words differ from its target T by a standard deviation of sqrt(T block_words) at most
(and by a block), whatever the size of the table.

Positions and draw numbers come from two-level prefix sums (documents within hashed chunks of a source, then chunks;
shards within groups of shards, then groups), so that no task holds a whole source. Only the table of sources, a row
each, is ordered in one task. DataFrame code only; the same input gives the same mix, as all draws are hashes of a seed.

Defined cases: a null or blank text has size 0 and is never taken; a null source is a source of its own, last in
order; rows that share a doc_id are packed one after another and get a row each, with work in proportion to their
number; very long texts lie in many blocks like any run of documents; extra columns pass through, and an input column
named like a result is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WS, WS_RE, documents, let, settle, sql_string, word_count

BLOCK_WORDS = 16
SHARD_SLOTS = 1024
#: Shards in a group of the first level of numbering; slots that a task handles, about.
GROUP_SHARDS, TASK_SLOTS = 1024, 500_000
MAX_REPEATS = 3
#: Sources whose table (some 40 bytes each) joins by a broadcast; beyond, by a shuffle.
BROADCAST_SOURCES = 100_000
SEED = 17
#: Documents in a chunk of the first level of prefix sums, about; at most this many chunks of a source.
CHUNK_DOCS, MAX_CHUNKS = 256, 65536


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size) to targets: shares by weight of all words, none above max_repeats times its size; what is
    cut off goes to the others by weight until none is above. Solved in one pass over sources by limit per weight."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("weight", w).withColumn("cap", (F.col("source_size") * max_repeats).cast("double"))
    ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = ratio.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(1))
    t = t.withColumns({"total": F.sum("source_size").over(every), "used": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "open": F.sum("weight").over(after)})
    # with the sources before this one at their limits, the others get `level` per weight
    t = t.withColumn("level", (F.col("total") - F.col("used")) / F.col("open"))
    t = t.withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    t = t.withColumn("level", F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(every).getField("level"))
    return t.select("source", "source_size", "weight", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def permuted_sql(x: str, n: str, key: str) -> str:
    """SQL for a keyed pseudorandom permutation of [0, n) at x: a Feistel network over two digits, walked until it
    lands inside. Digits have bases a = ceil(sqrt n) and b = ceil(n / a), so at most a - 1 < 33 values (n < 1000) or
    under one in thirty (else) lie outside, and 33 steps end every walk (for large n but for odds under 1e-45)."""

    def step(v: str) -> str:
        out = f"struct(CAST({v} DIV pq.b AS BIGINT) AS l, CAST({v} % pq.b AS BIGINT) AS r)"
        for i in range(3):
            half = f"transform(array({out}), z{i} -> struct(pmod(z{i}.l + pmod(xxhash64({key}, {2 * i}, z{i}.r), pq.a), pq.a) AS l, z{i}.r AS r))[0]"
            out = f"transform(array({half}), y{i} -> struct(y{i}.l AS l, pmod(y{i}.r + pmod(xxhash64({key}, {2 * i + 1}, y{i}.l), pq.b), pq.b) AS r))[0]"
        return f"transform(array({out}), e -> e.l * pq.b + e.r)[0]"

    first = step(x)
    walk = f"aggregate(sequence(1, 33), s0, (acc, i) -> IF(acc < {n}, acc, {step('acc')}))"
    body = f"transform(array({first}), s0 -> IF(s0 < {n}, s0, {walk}))[0]"
    base = f"transform(array(CAST(ceil(sqrt(CAST({n} AS DOUBLE))) AS BIGINT)), a -> struct(a AS a, CAST(({n} + a - 1) DIV a AS BIGINT) AS b))"
    return f"transform({base}, pq -> {body})[0]"


def mix(
    docs: DataFrame,
    *,
    weights: tuple[int, ...] = (1, 2, 3),
    max_repeats: int = MAX_REPEATS,
    block_words: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS,
    seed: int = SEED,
    draw_seed: int | None = None,
) -> Mix:
    """seed keys the permutations and, unless draw_seed is given, the draws."""
    return Mix(docs, weights, max_repeats, block_words, shard_slots, seed, seed if draw_seed is None else draw_seed)


class Mix:
    """The plan of a mix: `sources`, `runs` (draws by shard), `slots` (shard, source, k, pass, block), `placed`
    (documents in their source's stream) and `taken` (what is read of each document)."""

    def __init__(self, docs: DataFrame, weights, max_repeats: int, block_words: int, shard_slots: int, seed: int, draw_seed: int):
        self.docs, self.block_words, self.seed, self.draw_seed, self.shard_slots = docs, block_words, seed, draw_seed, shard_slots
        body = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), word_count(F.col("text")).alias("size"))
        body = body.groupBy("doc_id", "source", "t", "size").agg(F.count(F.lit(1)).alias("rows"))  # repeated rows stand side by side
        body = settle(body, "sizes")
        n = body.count()
        chunks = max(64, min(MAX_CHUNKS, n // CHUNK_DOCS))
        body = body.withColumns({"chunk": F.pmod(F.xxhash64("doc_id", "t", F.lit(seed)), F.lit(chunks)), "words": F.col("size") * F.col("rows")})
        sums = body.groupBy("source", "chunk").agg(F.sum("words").alias("words"))
        sums = settle(sums, "chunks")
        base = sums.select("source", "chunk", (F.sum("words").over(Window.partitionBy("source").orderBy("chunk")) - F.col("words")).alias("base"))
        sizes = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
        targets = source_targets(sizes, weights=weights, max_repeats=max_repeats)
        blocks = F.ceil(F.col("source_size") / F.lit(block_words)).cast("long")
        share = F.when(F.col("source_size") > 0, F.col("target") * blocks / F.col("source_size")).otherwise(0.0)  # in blocks
        order = Window.orderBy(F.col("source").asc_nulls_last())
        sources = targets.withColumns({"blocks": blocks, "most": blocks * max_repeats, "share": share, "no": F.row_number().over(order)})
        self.sources = settle(sources, "sources")
        self.small = self.sources.count() <= BROADCAST_SOURCES
        within = Window.partitionBy("source", "chunk").orderBy("doc_id", "t")
        placed = body.withColumn("pos", F.sum("words").over(within) - F.col("words"))
        base = base.withColumnsRenamed({"source": "s2", "chunk": "c2"})
        placed = placed.join(base, (F.col("chunk") == F.col("c2")) & F.col("source").eqNullSafe(F.col("s2"))).withColumn("start", F.col("base") + F.col("pos"))
        names = self.sources.select("no", F.col("source").alias("s3"))
        placed = placed.join(self._side(names), F.col("source").eqNullSafe(F.col("s3")))
        #: (no, start) tells documents that have words apart.
        self.placed = placed.select("doc_id", "source", "no", "t", "size", "rows", "start")
        self.runs = self._runs()

    def _drawn(self, sources: DataFrame, total: int, first_shard: int, turn: int) -> DataFrame:
        """(no, shard, n): `total` slots in shards from first_shard on, each a draw of a source by share."""
        spark, n = self.docs.sparkSession, self.shard_slots
        shards = -(-total // n)
        scale = 1 << 40  # draws are integers below it
        order = Window.orderBy("no")
        upto = F.sum("share").over(order) / F.sum("share").over(Window.partitionBy(F.lit(1)))
        ends = sources.filter("share > 0").select("no", F.round(upto * scale).cast("long").alias("hi"))
        intervals = ends.withColumn("lo", F.coalesce(F.lag("hi").over(order), F.lit(0).cast("long"))).filter("hi > lo")
        # a draw meets the intervals in cells of equal width, by an equi-join whose other side has a few rows a source
        cell = scale // 1024
        intervals = intervals.withColumn("cell", F.explode(F.expr(f"sequence(lo DIV {cell}, (hi - 1) DIV {cell})")))
        slots = spark.range(0, shards, 1, self._tasks(total)).select(
            (F.col("id") + first_shard).alias("shard"), F.explode(F.sequence(F.lit(0), F.least(F.lit(n), F.lit(total) - F.col("id") * n).cast("int") - 1)).alias("slot")
        )
        draw = F.shiftrightunsigned(F.xxhash64(F.lit(self.draw_seed), F.lit("draw"), F.lit(turn), "shard", "slot"), 24)
        slots = slots.withColumn("draw", draw).withColumn("cell", F.expr(f"draw DIV {cell}"))
        return slots.join(intervals, "cell").filter("draw >= lo AND draw < hi").groupBy("no", "shard").agg(F.count(F.lit(1)).alias("n"))

    def _side(self, sources: DataFrame) -> DataFrame:
        """A table of sources as the other side of a join."""
        return F.broadcast(sources) if self.small else sources

    def _tasks(self, slots: int) -> int:
        return max(int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-slots // TASK_SLOTS))

    def _runs(self) -> DataFrame:
        """(no, shard, k0, n): a shard's draws of a source have the numbers k0 to k0 + n - 1."""
        total = self.sources.agg(F.coalesce(F.round(F.sum("share")), F.lit(0)).cast("long")).first()[0]
        runs, shard, turn, sources = None, 0, 0, self.sources.withColumn("before", F.lit(0).cast("long"))
        while total:
            drawn = settle(self._drawn(sources, total, shard, turn), "draws").withColumn("group", F.expr(f"shard DIV {GROUP_SHARDS}"))
            # two-level prefix sums: shards within groups, then groups
            groups = drawn.groupBy("no", "group").agg(F.sum("n").alias("sum"))
            base = groups.select("no", "group", (F.sum("sum").over(Window.partitionBy("no").orderBy("group")) - F.col("sum")).alias("base"))
            within = F.sum("n").over(Window.partitionBy("no", "group").orderBy("shard")) - F.col("n")
            numbered = drawn.withColumn("within", within).join(base, ["no", "group"]).join(self._side(sources.select("no", "most", "before")), "no")
            k0 = F.col("before") + F.col("base") + F.col("within")
            new = numbered.select("no", "shard", k0.alias("k0"), F.least(F.col("n"), F.col("most") - k0).alias("n")).filter("n > 0")
            runs = new if runs is None else runs.unionAll(new)
            sums = drawn.groupBy("no").agg(F.sum("n").alias("sum"))
            after = sources.join(sums, "no", "left").withColumn("wanted", F.col("before") + F.coalesce("sum", F.lit(0)))
            # what is above a source's passes is drawn again among those with room
            left = after.agg(F.sum(F.greatest(F.lit(0), F.col("wanted") - F.col("most"))), F.sum(F.greatest(F.lit(0), F.col("most") - F.col("wanted")))).first()
            sources = settle(after.select(*self.sources.columns, F.least("wanted", "most").alias("before")).withColumn("share", F.when(F.col("before") < F.col("most"), F.col("share")).otherwise(0.0)), "sources")
            shard, turn, total = shard + -(-total // self.shard_slots), turn + 1, min(left[0], left[1])
            if sources.filter("share > 0").isEmpty():
                break
        if runs is None:
            runs = self.docs.sparkSession.range(0).selectExpr("CAST(id AS INT) AS no", "id AS shard", "id AS k0", "id AS n")
        return settle(runs, "runs")

    @property
    def slots(self) -> DataFrame:
        """(shard, source, k, pass, block, at): `at` packs the source's number and the block into one key."""
        total = self.runs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        runs = self.runs.repartition(self._tasks(total), "no", "shard").join(self._side(self.sources.select("no", "source", "blocks")), "no")
        runs = runs.select("no", "shard", "source", "blocks", F.explode(F.expr("sequence(k0, k0 + n - 1)")).alias("k"))
        perm = permuted_sql("(k % blocks)", "blocks", f"{self.seed}, source, k DIV blocks")
        return runs.select("no", "shard", "source", "k", F.expr("k DIV blocks").alias("pass"), F.expr(perm).alias("block")).withColumn("at", _at("block"))

    @property
    def stretches(self) -> DataFrame:
        """(at, no, start, copy, first, upto): words [first, upto) of a row lie in a block.

        Of rows that share everything only those meet a block that lie in it, by their places in the stream."""
        w, start, size = self.block_words, F.col("start"), F.col("size")
        blocks = F.sequence(F.floor(start / w), F.floor((start + size * F.col("rows") - 1) / w))
        each = self.placed.filter("size > 0").select("no", "start", "size", "rows", F.explode(blocks).alias("block"))
        begin = F.col("block") * w - start
        first, last = F.floor(F.greatest(begin, F.lit(0)) / size), F.least(F.floor((begin + w - 1) / size), F.col("rows") - 1)
        each = each.withColumn("copy", F.explode(F.sequence(first, last)))
        begin = begin - F.col("copy") * size
        return each.select(_at("block").alias("at"), "no", "start", "copy", F.greatest(F.lit(0), begin).alias("first"), F.least(size, begin + w).alias("upto"))

    @property
    def read(self) -> DataFrame:
        """stretches that the mix reads, and how many times; nothing but keys and numbers is shuffled."""
        return self.stretches.join(self.slots.groupBy("at").agg(F.count(F.lit(1)).alias("times")), "at")

    @property
    def rows(self) -> DataFrame:
        """placed with a row for each row of the documents, and the key (no, start, copy) of those that have words."""
        copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))
        return self.placed.withColumn("copy", copies).withColumn("start", F.when(F.col("size") > 0, F.col("start")))

    @property
    def taken(self) -> DataFrame:
        """A row for each row of the documents: doc_id, source, size, source_size, target, taken."""
        got = self.read.groupBy("no", "start", "copy").agg(F.sum((F.col("upto") - F.col("first")) * F.col("times")).alias("taken"))
        out = self.rows.join(got, ["no", "start", "copy"], "left").join(self._side(self.sources.select("no", "source_size", "target")), "no")
        return out.select("doc_id", "source", "t", "copy", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _at(block: str) -> Column:
    return F.shiftleft(F.col("no").cast("long"), 40) + F.col(block)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: for every pass up to the repeats allowed, what the mix reads of each document at least that
    often, with the columns of docs (n_chars, where there is one, is the new text's length).

    A text read whole is kept as it is; of others the words read are joined by blanks. Of rows that share doc_id, source
    and text the other columns of one, that of the smallest hash, stand for all."""
    text = F.coalesce("text", F.lit(""))
    key = {
        "__mx_id": F.coalesce("doc_id", F.lit(0)), "__mx_no_id": F.col("doc_id").isNull(),
        "__mx_no_source": F.col("source").isNull(), "__mx_source": F.coalesce(F.col("source").cast("string"), F.lit("")),
    }
    plan = mix(docs, **options)
    read = plan.read.groupBy("no", "start", "copy").agg(F.array_sort(F.collect_list(F.struct("first", "upto", "times"))).alias("__mx_read"), F.max("times").alias("most"))
    rows = plan.rows.withColumns(key).select(*key, F.col("t").alias("__mx_t"), "no", "start", "copy", "size")
    read = rows.join(read, ["no", "start", "copy"]).drop("no", "start")
    read = read.withColumn("pass", F.explode(F.sequence(F.lit(1).cast("long"), F.col("most")))).withColumn("__mx_read", F.expr("filter(__mx_read, x -> x.times >= pass)"))
    read = read.withColumn("__mx_whole", F.expr("aggregate(__mx_read, 0L, (a, x) -> a + x.upto - x.first)") == F.col("size")).drop("copy", "most", "pass", "size")
    keys = [*key, "__mx_t"]
    own = docs.withColumns(key | {"__mx_t": F.xxhash64(text)}).groupBy(*keys).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("__mx_row")).select(*keys, "__mx_row.*")
    words = f"split(btrim(text, {sql_string(WS)}), {sql_string(WS_RE)}, -1)"
    part = F.expr(let(words, "w", "array_join(flatten(transform(__mx_read, x -> slice(w, CAST(x.first AS INT) + 1, CAST(x.upto - x.first AS INT)))), ' ')"))
    out = own.join(read, keys).withColumn("text", F.when(F.col("__mx_whole"), F.col("text")).otherwise(part))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir).select("doc_id", "text", "source")).taken.select("doc_id", "size", "source_size", "target", "taken")
