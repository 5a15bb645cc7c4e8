"""Language identification by compression: the language whose dictionary compresses a text best.

Every language has a zstandard raw-content dictionary: the words and word pairs that most of its training documents
hold, the most common last, where they are cheapest to refer to. A whole text, lower-cased and with letters only, is
compressed with each dictionary, texts of all lengths alike; the smallest output names the language. A narrow margin
between the best and the second language is a rejection.

Learning takes at most FIT_DOCS labelled documents of a language, of any length and whole, chosen by a hash of doc_id and
text from all of them; nothing of them reaches the driver but the dictionaries. Texts are filtered before any shuffle.
Predictions cover all rows and whole texts.

Defined cases: a null text, or one without a letter, is `und` with score 0 and counts as rejected; ties go to the
language first in code-point order and count as rejected; rows without a language teach nothing; repeated rows teach
once; very long texts are compressed whole, one at a time; null ids and extra columns pass through, and an input column
named like a result is replaced; an empty table gives an empty result; without any labelled row every text is `und`;
more than MAX_LANGS distinct labels raise ValueError.
"""

from __future__ import annotations

import json
import math

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import MAX_LONG, documents, map_texts, mapped_file, put_file, settle, shared_path, worker_kernel

FIT_DOCS = 800
MAX_LANGS = 1000
DICT_BYTES = 1 << 18
#: A binary-tree search over a window of 512 KB, whatever the text's size: as exact as zstandard's level 15 on short
#: texts, and without the tables of many megabytes that a level takes for long ones.
COMPRESSION = {"window_log": 19, "chain_log": 17, "hash_log": 17, "search_log": 5, "min_match": 4, "target_length": 32, "strategy": 6}
#: (second - best) / second below which a prediction is rejected.
MIN_MARGIN = 0.005

NOT_LETTERS = regex.compile(r"[^\p{L}]+")


def normalised(text: str) -> str:
    """Lower-case runs of letters with a blank before and behind each; empty without a letter."""
    words = NOT_LETTERS.sub(" ", text.lower()).strip()
    return f" {words} " if words else ""


def held_out(doc_id: Column, of: int, value: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(of)) == value, F.lit(False))


def sampled(docs: DataFrame, lang: str, text: str, fit_docs: int) -> DataFrame:
    """(lang, h, text): at most fit_docs distinct labelled documents of each language, those of the smallest hashes."""
    spark = docs.sparkSession
    rows = docs.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.shiftrightunsigned(F.xxhash64("doc_id", text), 1).alias("h"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGS + 1).collect()
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    # hashes below a language's share: some more than fit_docs documents are expected, cut to fit_docs below
    share = {r["lang"]: min(1.0, (1.2 * fit_docs + 50) / r["n"]) for r in counts}
    limit = spark.createDataFrame([(x, min(MAX_LONG, int(v * MAX_LONG))) for x, v in share.items()], "l2 string, upto long")
    near = rows.join(F.broadcast(limit), F.col("lang") == F.col("l2")).filter("h <= upto").select("lang", "h", "text")
    near = settle(near.groupBy("lang", "h").agg(F.first("text").alias("text")), "sample")
    last = near.groupBy("lang").agg(F.element_at(F.slice(F.array_sort(F.collect_list("h")), 1, fit_docs), -1).alias("last")).withColumnRenamed("lang", "l2")
    return near.join(F.broadcast(last), F.col("lang") == F.col("l2")).filter("h <= last").select("lang", "h", "text")  # a row a language


def fit(docs: DataFrame, *, lang: str = "lang", text: str = "text", fit_docs: int = FIT_DOCS, dict_bytes: int = DICT_BYTES) -> str:
    """Dictionaries from the labelled rows of docs, written to the shared folder; returns their path.

    The driver gets at most dict_bytes of terms a language."""
    kernel = lambda texts: {"body": [normalised(t).strip() for t in texts]}
    bodies = map_texts(sampled(docs, lang, text, fit_docs), lambda: kernel, "body string", ["lang"]).filter("body <> ''")
    words = bodies.select("lang", F.split("body", " ", -1).alias("w"))
    pairs = "IF(size(w) < 2, CAST(array() AS array<string>), zip_with(slice(w, 1, size(w) - 1), slice(w, 2, size(w) - 1), (a, b) -> concat(a, ' ', b)))"
    terms = words.select("lang", F.explode(F.expr(f"array_distinct(concat(w, {pairs}))")).alias("term"))
    counts = terms.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | ~F.contains("term", F.lit(" ")))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "term")  # a language's sampled terms
    upto = counts.select("lang", "term", F.sum(F.octet_length("term") + 1).over(first.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    found: dict[str, list[tuple[int, str]]] = {}
    for row in upto.filter(F.col("upto") < dict_bytes).collect():
        found.setdefault(row["lang"], []).append((row["upto"], row["term"]))
    path = shared_path(docs.sparkSession, "langid")
    data = {x: (" " + " ".join(t for _, t in sorted(found[x], reverse=True)) + " ").encode() for x in sorted(found)}
    data = {x: d * -(-8 // len(d)) for x, d in data.items()}  # zstandard takes eight bytes at least
    langs = list(data)
    put_file(path, "langs", [json.dumps(langs).encode()])
    for i, x in enumerate(langs):
        put_file(path, f"{i}.dict", [data[x]])
    return path


class Identifier:
    def __init__(self, path: str):
        import zstandard as z

        self.langs: list[str] = json.loads(mapped_file(path, "langs", "u1").tobytes())

        how = z.ZstdCompressionParameters(**COMPRESSION, write_checksum=False, write_content_size=False, write_dict_id=False)

        def compressor(data: bytes):
            d = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            return z.ZstdCompressor(dict_data=d, compression_params=how)

        self.compressors = [compressor(mapped_file(path, f"{i}.dict", "u1").tobytes()) for i in range(len(self.langs))]

    def sizes(self, text: str) -> np.ndarray:
        body = normalised(text).encode()
        return np.array([len(c.compress(body)) for c in self.compressors if body])

    def __call__(self, text: str) -> tuple[str, float, float]:
        """(language, score, margin)."""
        sizes = self.sizes(text)
        if not len(sizes):
            return "und", 0.0, 0.0
        best = int(sizes.argmin())
        score = 1 / float(np.exp(np.maximum(-60, (sizes[best] - sizes) * math.log(2))).sum())
        second = np.partition(sizes, 1)[1] if len(sizes) > 1 else sizes[best] * 2
        return self.langs[best], score, float((second - sizes[best]) / second)


def identify(docs: DataFrame, model: str, *, text: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """docs with lang_pred, score, margin and rejected, by the dictionaries at model."""
    names = ("lang_pred", "score", "margin")

    def make():
        identifier = worker_kernel(("langid", model), lambda: Identifier(model))
        return lambda texts: dict(zip(names, map(list, zip(*map(identifier, texts)))))

    out = map_texts(docs, make, "lang_pred string, score double, margin double", [c for c in docs.columns if c not in (*names, "rejected")], text)
    return out.withColumn("rejected", (F.col("lang_pred") == "und") | (F.col("margin") < min_margin))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 4, 2)
    model = fit(docs.filter(~out))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score", "margin", "rejected")
