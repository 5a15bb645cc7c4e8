"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Frequent words of the whole corpus are compiled, with their ids as outputs, into a minimal deterministic acyclic
automaton: equal suffixes share states, and the numbers that a path adds up give the word's place in the table of
outputs. Driver-built files in the shared folder hold the automaton; workers memory-map them and walk all distinct
pre-tokens of a slice through it at once. Pre-tokens that the lexicon lacks are merged exactly. Which words the lexicon
holds changes the speed, never a result.

Defined cases: a null or empty text has no tokens and decodes to the empty text; strings of added tokens become their
ids, as the library's default is; ids that don't form UTF-8 decode with replacement characters; repeated rows, null ids
and extra columns pass through, and an input column named like a result is replaced; an empty table gives an empty
result and an empty lexicon.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Bpe
from .common import documents, map_texts, mapped_file, put_file, settle, shared_path, worker_kernel
from .token_files import tokenizer_path

#: Words in the lexicon, and how often a word must occur to be one of them.
LEXICON_WORDS = 65_536
MIN_COUNT = 16
#: Bytes encoded at once: what a task holds beside its Arrow batch is some hundred times this at most.
SLICE_BYTES = 1_000_000


class Transducer:
    """A minimal acyclic automaton over byte strings; its outputs are sequences of ids."""

    #: Arcs in order of (state, byte): key = 256 state + byte, the state they lead to, and what they add to a word's number.
    FILES = {"key": "<i8", "to": "<i4", "add": "<i4", "final": "u1", "offsets": "<i8", "ids": "<u4"}

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @staticmethod
    def build(outputs: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
        """Arrays of the minimal automaton of outputs' keys, added in sorted order with a register of finished states."""
        words = sorted(outputs)
        edges: list[dict[int, int]] = [{}]
        final = [False]
        register: dict[tuple, int] = {}
        path: list[tuple[int, int]] = []  # (state, byte) of the last word, not yet replaced
        last = b""

        def finish(upto: int) -> None:
            while len(path) > upto:
                state, byte = path.pop()
                child = edges[state][byte]
                key = (final[child], tuple(edges[child].items()))
                if (known := register.setdefault(key, child)) != child:
                    edges[state][byte] = known
                    free.append(child)

        free: list[int] = []
        for word in words:
            common = 0
            while common < min(len(word), len(last)) and word[common] == last[common]:
                common += 1
            finish(common)
            state = edges[path[-1][0]][path[-1][1]] if path else 0
            for byte in word[common:]:
                if free:
                    new = free.pop()
                    edges[new], final[new] = {}, False
                else:
                    new = len(edges)
                    edges.append({})
                    final.append(False)
                edges[state][byte] = new
                path.append((state, byte))
                state = new
            final[state] = True
            last = word
        finish(0)
        # keep reachable states, children before parents, and count the words below each
        order, seen, stack = [], {0}, [(0, iter(edges[0].values()))]
        while stack:
            state, children = stack[-1]
            for child in children:
                if child not in seen:
                    seen.add(child)
                    stack.append((child, iter(edges[child].values())))
                    break
            else:
                order.append(state)
                stack.pop()
        number = {s: i for i, s in enumerate(reversed(order))}
        fin, below, arcs = np.zeros(len(order), np.uint8), {}, []
        for s in order:
            total = int(final[s])
            for byte, child in sorted(edges[s].items()):
                arcs.append((number[s] << 8 | byte, number[child], total))
                total += below[child]
            below[s], fin[number[s]] = total, final[s]
        table = np.array(sorted(arcs), np.int64).reshape(-1, 3)
        offsets = np.zeros(len(words) + 1, np.int64)
        np.cumsum([len(outputs[w]) for w in words], out=offsets[1:])
        ids = np.array(list(itertools.chain.from_iterable(outputs[w] for w in words)), np.uint32)
        return {"key": table[:, 0], "to": table[:, 1], "add": table[:, 2], "final": fin, "offsets": offsets, "ids": ids}

    @staticmethod
    def save(arrays: dict[str, np.ndarray], path: str) -> None:
        for name, kind in Transducer.FILES.items():
            put_file(path, name, [np.ascontiguousarray(arrays[name], kind)])

    @classmethod
    def open(cls, path: str) -> Transducer:
        return cls({name: mapped_file(path, name, kind) for name, kind in cls.FILES.items()})

    def find(self, words: list[bytes]) -> np.ndarray:
        """Each word's number among the lexicon's words, or -1; all words walk at once."""
        lengths = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        found = np.full(len(words), -1, np.int64)
        who, state, number = np.arange(len(words)), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        step = 0
        while len(who):
            done = lengths[who] == step
            if done.any():
                ends = done & (self.final[state] == 1)
                found[who[ends]] = number[ends]
                who, state, number = who[~done], state[~done], number[~done]
            arc = state << 8 | data[starts[who] + step]
            at = np.searchsorted(self.key, arc)
            on = at < len(self.key)
            on[on] = self.key[at[on]] == arc[on]
            at = at[on]
            who, state, number = who[on], self.to[at].astype(np.int64), number[on] + self.add[at]
            step += 1
        return found


def frequent_words(docs: DataFrame, *, text: str = "text", words: int = LEXICON_WORDS, min_count: int = MIN_COUNT) -> list[str]:
    """The most frequent words of all texts: at most `words` strings, so the driver may hold them."""
    split = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D.,;:?!|]+", -1)
    counts = docs.select(F.explode(split).alias("word")).filter("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = settle(counts.filter(F.col("n") >= min_count), "words")
    # the smallest count whose words, with all more frequent ones, still fit
    histogram = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    upto = histogram.select("n", F.sum("words").over(Window.orderBy(F.desc("n"))).alias("upto"))
    least = upto.filter(F.col("upto") <= words).agg(F.min("n")).first()[0]
    return [] if least is None else [r["word"] for r in counts.filter(F.col("n") >= least).select("word").collect()]


def build_lexicon(spark: SparkSession, words: list[str], tokenizer: str) -> str:
    """Compile words, as they stand after a space, into a transducer in the shared folder; returns its path."""
    bpe = Bpe(tokenizer)
    pieces = sorted({p for w in words for p in bpe.pieces(" " + w)})
    ids, n = bpe.merge([p.encode() for p in pieces])
    cuts = np.cumsum(n)
    outputs = {p.encode(): ids[b - k : b].tolist() for p, b, k in zip(pieces, cuts.tolist(), n.tolist())}
    path = shared_path(spark, "lexicon")
    Transducer.save(Transducer.build(outputs), path)
    return path


class Codec:
    def __init__(self, tokenizer: str, lexicon: str):
        self.bpe, self.lexicon = Bpe(tokenizer), Transducer.open(lexicon)
        tokens = self.bpe.token_bytes
        self.token_size = np.array([len(t) for t in tokens], np.int64)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.token_data = np.frombuffer(b"".join(tokens), np.uint8)

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order as unsigned 32-bit integers, the texts' offsets among them)."""
        chunks, word, offsets = self.bpe.numbered(texts)
        values = self._ids(chunks)
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        table = np.frombuffer(b"".join(values), "<u4")
        n = sizes[word]
        return gathered(table, (np.cumsum(sizes) - sizes)[word], n), np.concatenate([[0], np.cumsum(n)])[offsets]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, cuts = self.encode_flat(texts)
        return [ids[x:y].tobytes() for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def decode_flat(self, ids: np.ndarray, cuts: np.ndarray) -> Iterator[memoryview]:
        """The bytes that each text's ids stand for."""
        size = self.token_size[ids]
        data = memoryview(gathered(self.token_data, self.token_start[ids], size))
        upto = np.concatenate([[0], np.cumsum(size)])[cuts].tolist()
        return (data[x:y] for x, y in zip(upto, upto[1:]))

    def _ids(self, chunks: list[str | int]) -> list[bytes]:
        """Ids of distinct chunks."""
        cut = [[] if isinstance(c, int) else self.bpe.pieces(c) for c in chunks]
        pieces = list(set(itertools.chain.from_iterable(cut)))
        raw = [p.encode() for p in pieces]
        number = self.lexicon.find(raw)
        ids = {}
        known = np.flatnonzero(number >= 0)
        table, at = self.lexicon.ids, self.lexicon.offsets
        for i, a, b in zip(known.tolist(), at[number[known]].tolist(), at[number[known] + 1].tolist()):
            ids[pieces[i]] = table[a:b].tobytes()
        unseen = np.flatnonzero(number < 0).tolist()
        flat, n = self.bpe.merge([raw[i] for i in unseen])
        data, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(n)).tolist()
        for i, a, b in zip(unseen, [0, *ends[:-1]] if ends else [], ends):
            ids[pieces[i]] = data[a:b]
        of = ids.__getitem__
        return [c.to_bytes(4, "little") if isinstance(c, int) else of(p[0]) if len(p) == 1 else b"".join(map(of, p)) for c, p in zip(chunks, cut)]

    def decode(self, ids: bytes) -> str:
        one = np.frombuffer(ids, "<u4")
        return str(next(self.decode_flat(one, np.array([0, len(one)]))), "utf-8", "replace")


def gathered(table: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs table[start : start + size], end to end."""
    upto = np.cumsum(sizes)
    return table[np.repeat(starts - upto + sizes, sizes) + np.arange(upto[-1] if len(upto) else 0)]


def worker_codec(tokenizer: str, lexicon: str) -> Codec:
    """This worker's codec: read once, whatever number of tasks the worker runs."""
    return worker_kernel(("lexicon", tokenizer, lexicon), lambda: Codec(tokenizer, lexicon))


def encode_decode(docs: DataFrame, tokenizer: str, *, text: str = "text", ids: bool = True, decoded: bool = True, lexicon: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs (or their columns keep) with ids (binary, unsigned 32-bit little-endian), decoded (string), n_tokens, ids_sha256 and decoded_sha256.

    ids and decoded are left out on request, as they are as large as the texts. The lexicon is built from docs unless
    the path of one is given."""
    lexicon = lexicon or build_lexicon(docs.sparkSession, frequent_words(docs, text=text), tokenizer)
    fields = ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"] + ["ids binary"] * ids + ["decoded string"] * decoded
    names = [f.split()[0] for f in fields]

    def make():
        codec = worker_codec(tokenizer, lexicon)

        def kernel(texts: pa.Array) -> dict:
            flat, cuts = codec.encode_flat(texts)
            out: dict[str, list] = {n: [] for n in names}
            data = memoryview(flat).cast("B") if len(flat) else memoryview(b"")
            for a, b, raw in zip(cuts[:-1].tolist(), cuts[1:].tolist(), codec.decode_flat(flat, cuts)):
                back = str(raw, "utf-8", "replace")  # what doesn't form UTF-8 is replaced
                out["n_tokens"].append(b - a)
                out["ids_sha256"].append(hashlib.sha256(data[4 * a : 4 * b]).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(back.encode()).hexdigest())
                if ids:
                    out["ids"].append(data[4 * a : 4 * b])
                if decoded:
                    out["decoded"].append(back)
            return out

        return kernel

    return map_texts(docs, make, ", ".join(fields), [c for c in (docs.columns if keep is None else keep) if c not in names], text, SLICE_BYTES, arrow=True)


def op6_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"), ids=False, decoded=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
