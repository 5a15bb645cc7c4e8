"""Token-ID output: flat unsigned integer files plus 64-bit document offsets, read back by memory map.

Documents are range-partitioned by doc_id, so that partition p of the output holds smaller ids than partition p + 1.
Each task encodes its documents and writes three files: NNNNN.ids (flat little-endian unsigned integers, two bytes each
when the vocabulary allows, else four), NNNNN.off (n + 1 64-bit token offsets within the partition) and NNNNN.doc
(64-bit doc_ids). Ids go to their file slice by slice, so that a task holds a slice and 16 bytes a document whatever its
partition's size; the number of partitions follows from the bytes of the texts. The driver never sees tokens: a partition's base, the number of ids before it, is a prefix sum over
one row per partition. Files appear whole or not at all, so that a lost executor's tasks may run again.

The tokenizer drops white space, so a text's ids are those of its white-space separated chunks in order; each distinct
chunk is encoded by the library once per worker, within a bounded memo.

Defined cases: a null or empty text has the end id alone; a very long text is encoded alone and whole; a null doc_id comes
last and is read back as null; rows that share a doc_id stand side by side in the order of their texts' hashes; extra columns are ignored; an empty table gives
no files and an empty result.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WS, arrow_slices, documents, mapped_file, put_file, settle, shared_path

#: Bytes of text in a partition of the files, at most about.
PARTITION_BYTES = 256_000_000
#: Distinct chunks, and distinct pieces, that a worker keeps with their ids.
MEMO_CHUNKS, MEMO_PIECES = 500_000, 800_000
#: Bytes encoded at once; more at once means fewer distinct chunks to look at.
SLICE_BYTES = 6_000_000


class Memo(dict):
    """A dictionary that stops growing at `most` entries; what comes later is found in `extra` until the next refill."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.extra = most, {}

    def __missing__(self, key):
        return self.extra[key]

    def refill(self, keys: list, values: list) -> None:
        room = max(0, self.most - len(self))
        self.update(zip(keys[:room], values[:room]))
        self.extra = dict(zip(keys[room:], values[room:]))


class ChunkEncoder:
    """Ids of texts by the tokenizers library, through bounded memos of white-space separated chunks and of their pieces.

    For byte-pair tokenizers with word ends whose normaliser composes, lower-cases and drops white space, and whose
    pieces are contractions, runs of letters, single numbers and runs of other characters. Pieces of Latin letters are
    cut here and encoded by the library many at once (each ends with one word-end token); a chunk with other characters
    or with the string of an added token goes to the library as it stands.
    """

    PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
    #: Below the first combining character composition changes nothing.
    PLAIN = regex.compile(r"[\x00-\u012f\u0131-\u024f]*")

    def __init__(self, path: str, chunks: int = MEMO_CHUNKS, pieces: int = MEMO_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        size = max(vocab.values()) + 1
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.ends = np.zeros(size, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = os.path.commonprefix(self.added) if self.added else "\0"
        self.chunks, self.pieces = Memo(chunks), Memo(pieces)

    def _cut(self, chunk: bytes) -> list[str] | None:
        text = chunk.decode()
        if chunk.isalpha():
            return [text.lower()]
        if not self.PLAIN.fullmatch(text) or self.mark in text and any(a in text for a in self.added):
            return None
        text = text.lower()
        if text.isalpha():
            return [text]
        if text[:-1].isalpha() and text[-1] in ".,;:?!":
            return [text[:-1], text[-1]]
        return self.PIECES.findall(text)

    def _encode(self, pieces: list[str]) -> list[bytes]:
        out: list[bytes] = []
        lots = [pieces[i : i + 64] for i in range(0, len(pieces), 64)]
        for lot, e in zip(lots, self.tokenizer.encode_batch_fast([" ".join(x) for x in lots], add_special_tokens=False)):
            ids = np.array(e.ids, self.dtype)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(lot):  # not one word end each: one by one
                out += [np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, self.dtype).tobytes() for x in lot]
                continue
            data, w = ids.tobytes(), self.dtype.itemsize
            out += [data[a * w : b * w] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist())]
        return out

    def _ids(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of distinct chunks."""
        new = [c for c in chunks if c not in self.chunks]
        cut = [self._cut(c) for c in new]
        pieces = list(set(itertools.chain.from_iterable(filter(None, cut))).difference(self.pieces))
        self.pieces.refill(pieces, self._encode(pieces))
        whole = [c.decode() for c, p in zip(new, cut) if p is None]
        rest = iter(self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)) if whole else None
        piece = self.pieces.__getitem__
        self.chunks.refill(new, [np.array(next(rest).ids, self.dtype).tobytes() if p is None else piece(p[0]) if len(p) == 1 else b"".join(map(piece, p)) for p in cut])
        return list(map(self.chunks.__getitem__, chunks))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, their number per text); null counts as empty.

        Texts are cut, and their chunks numbered, by Arrow's kernels; only distinct chunks become Python objects."""
        texts = pc.fill_null(texts, "")
        # lower-casing ASCII letters, and cutting at ASCII white space, commute with what the normaliser does
        texts = pc.if_else(pc.match_substring(texts, self.mark), texts, pc.ascii_lower(texts))
        for c in WS[1:]:  # all white space as blanks; empty chunks between them have no ids
            if pc.any(pc.match_substring(texts, c)).as_py():
                texts = pc.replace_substring(texts, c, " ")
        # a sign that ends a chunk after a letter is a piece of its own: fewer distinct chunks
        texts = pc.replace_substring_regex(texts, r"([a-z])([.,;:?!])( |$)", r"\1 \2\3")
        words = pc.split_pattern(texts, " ")
        flat = words.flatten().dictionary_encode()
        values = self._ids(flat.dictionary.cast(pa.binary()).to_pylist())
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // self.dtype.itemsize
        starts = np.cumsum(sizes) - sizes
        table = np.frombuffer(b"".join(values), self.dtype)
        word = flat.indices.to_numpy()
        n = sizes[word]
        upto = np.cumsum(n)
        ids = table[np.repeat(starts[word] - upto + n, n) + np.arange(upto[-1] if len(upto) else 0)]
        cuts = np.concatenate([[0], upto])[words.offsets.to_numpy() - words.offsets[0].as_py()]
        return ids, np.diff(cuts)


_encoders: dict[str, ChunkEncoder] = {}


def chunk_encoder(path: str) -> ChunkEncoder:
    """This worker's encoder: its memos serve all tasks that the worker runs."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, *, partitions: int | None = None, path: str | None = None) -> tuple[str, DataFrame]:
    """Write docs' ids below path (default: a fresh one in the shared folder), each document closed by end_id.

    partitions: default one for PARTITION_BYTES of text, and no fewer than the session's shuffle setting.
    Returns the path and a table of its partitions: part, n_docs, n_null (documents without an id, its last ones), n_tokens,
    base (ids in all partitions before), width.
    """
    spark = docs.sparkSession
    path = path or shared_path(spark, "tokens")
    if not partitions:
        n_bytes = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // PARTITION_BYTES))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    # the hash lets the rows of one doc_id lie in several partitions
    ordered = docs.select("doc_id", "text").repartitionByRange(partitions, *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = chunk_encoder(tokenizer), TaskContext.get().partitionId()
        lengths, names, n_null = [], [], 0

        def blocks() -> Iterator[np.ndarray]:
            nonlocal n_null
            for batch in itertools.chain(filled, batches):
                names.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                n_null += batch.column(0).null_count
                for texts in arrow_slices(batch.column(1), SLICE_BYTES):
                    ids, n = encoder(texts)
                    lengths.append(n + 1)
                    yield np.insert(ids, np.cumsum(n), encoder.dtype.type(end_id))

        filled = list(itertools.islice((b for b in batches if b.num_rows), 1))
        if not filled:
            return
        put_file(path, f"{part:05d}.ids", blocks())
        sizes = np.concatenate(lengths)
        offsets = np.zeros(len(sizes) + 1, "<i8")
        np.cumsum(sizes, out=offsets[1:])
        put_file(path, f"{part:05d}.off", [offsets])
        put_file(path, f"{part:05d}.doc", names)
        row = {"part": part, "n_docs": len(sizes), "n_null": n_null, "n_tokens": int(offsets[-1]), "width": encoder.dtype.itemsize}
        yield pa.RecordBatch.from_pylist([row])

    parts = settle(ordered.mapInArrow(write, "part long, n_docs long, n_null long, n_tokens long, width long"), "token_parts")
    base = F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens")  # one row a partition
    return path, parts.withColumn("base", base)


def read_token_files(path: str, parts: DataFrame) -> DataFrame:
    """A row per document from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as unsigned 32-bit little-endian)."""
    n = max(1, parts.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{row['part']:05d}"
                ids = mapped_file(path, f"{name}.ids", f"<u{row['width']}")
                offsets = mapped_file(path, f"{name}.off", "<i8")
                names = mapped_file(path, f"{name}.doc", "<i8")
                for i in range(0, len(names), 10_000):
                    upto = min(i + 10_000, len(names))
                    crc = [zlib.crc32(ids[offsets[j] : offsets[j + 1]].astype("<u4")) for j in range(i, upto)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.asarray(names[i:upto]), pa.int64(), mask=np.arange(i, upto) >= len(names) - row["n_null"]),
                            pa.array(row["base"] + offsets[i:upto]), pa.array(np.diff(offsets[i : upto + 1])), pa.array(crc, pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return parts.repartition(n, "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


END_ID = 1


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(*write_token_files(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), END_ID))
