"""Byte-level byte-pair encoding in numpy: rank-synchronous merging of many pre-tokens at once.

A batch of pre-tokens is one ragged array of symbols. In each round every pre-token applies its lowest-rank pair
wherever it stands, all pre-tokens simultaneously; those without a pair left are done.
"""

from __future__ import annotations

import itertools
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: The pre-tokens of this family of tokenizers (a fixed public pattern), and a coarser cut at the same boundaries:
#: a chunk is a run of non-space with the space before it, or a run of white space as the pattern would leave it.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
CHUNKS = regex.compile(r" ?\S+|\s+(?!\S)|\s+")

#: Up to here (the end of Latin Extended-B) all Unicode versions agree on letters and numbers.
LATIN_END = "\u0250"
#: Stands before a chunk that has no blank before it.
GLUE = "\x01"
_SPACE = r"[ \t-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Texts where cutting at every blank would not give chunks: a blank beside white space, or the mark itself.
UNEVEN = rf" {_SPACE}|{_SPACE} |\x01"
#: A sign that ends a chunk after a letter is a pre-token of its own.
END_SIGN = r"([A-Za-z])([.,;:?!])( |$)"
NEVER = np.int32(2**31 - 1)
EMPTY = np.uint32(2**32 - 1)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes stand for
    themselves, the others for the code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Bpe:
    """A tokenizers .json file of a byte-level model without normaliser, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, symbols = whole["model"], byte_symbols()
        vocab = model["vocab"]
        self.byte_id = np.array([vocab[c] for c in symbols], np.int32)
        back = {c: b for b, c in enumerate(symbols)}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        # strings of added tokens are cut out of the text before anything else
        self.added = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        size = max([*vocab.values(), *self.added.values()]) + 1
        if size > 1 << 16:
            raise ValueError("vocabularies over 65,536 ids need wider pair keys")
        self.token_bytes = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in token)
        for token, i in self.added.items():
            self.token_bytes[i] = token.encode()
        self.cutter = None
        self._table(left << 16 | right)

    def _table(self, pairs: np.ndarray) -> None:
        """Ranks by pair in an open-addressing table."""
        self.bits = max(8, int(len(pairs) * 4).bit_length())
        keys, ranks = np.full(1 << self.bits, EMPTY, np.uint32), np.full(1 << self.bits, NEVER, np.int32)
        first: dict[int, int] = {}
        for rank, pair in enumerate(pairs.tolist()):
            first[pair] = rank  # of a pair listed twice the later rank counts
        for pair, rank in first.items():
            at = (pair * 2654435769 & 0xFFFFFFFF) >> (32 - self.bits)
            while keys[at] != EMPTY:
                at = (at + 1) & ((1 << self.bits) - 1)
            keys[at], ranks[at] = pair, rank
        self.keys, self.ranks = keys, ranks

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left.astype(np.uint32) << np.uint32(16) | right.astype(np.uint32)
        at = (pair * np.uint32(2654435769) >> np.uint32(32 - self.bits)).astype(np.int64)
        out = np.full(len(pair), NEVER, np.int32)
        todo = np.arange(len(pair))
        while len(todo):
            k = self.keys[at]
            hit = k == pair
            out[todo[hit]] = self.ranks[at[hit]]
            on = ~hit & (k != EMPTY)
            todo, pair, at = todo[on], pair[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, their number per word)."""
        lengths = np.array([len(w) for w in words], np.int64)
        symbols = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words), dtype=np.int64), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        ranks = np.full(len(symbols), NEVER, np.int32)  # of a symbol with the next one
        if len(symbols) > 1:
            same = np.flatnonzero(word[:-1] == word[1:])
            ranks[same] = self.rank(symbols[same], symbols[same + 1])
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.append(starts, len(symbols)))
            least = np.minimum.reduceat(ranks, starts)
            open_ = least != NEVER
            if not open_.all():
                on = np.repeat(open_, sizes)
                done.append((word[~on], symbols[~on]))
                symbols, word, ranks = symbols[on], word[on], ranks[on]
                least, sizes = least[open_], sizes[open_]
                if not len(symbols):
                    break
            hit = ranks == np.repeat(least, sizes)
            at = np.flatnonzero(hit)
            if len(at) > 1 and (np.diff(at) == 1).any():  # runs like aaa: every other one, from the left
                new_run = np.concatenate([[True], np.diff(at) != 1])
                run_start = np.flatnonzero(new_run)[np.cumsum(new_run) - 1]
                at = at[(np.arange(len(at)) - run_start) % 2 == 0]
            symbols[at] = self.merged[ranks[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            symbols, word, ranks = symbols[keep], word[keep], ranks[keep]
            near = np.zeros(len(symbols), bool)  # merged symbols and those before them
            near[place[at]] = True
            near[:-1] |= near[1:]
            changed = np.flatnonzero(near)
            ranks[changed] = NEVER
            inner = changed[changed < len(symbols) - 1]
            inner = inner[word[inner] == word[inner + 1]]
            ranks[inner] = self.rank(symbols[inner], symbols[inner + 1])
        owner = np.concatenate([w for w, _ in done]) if done else np.zeros(0, np.int64)
        ids = np.concatenate([s for _, s in done]) if done else np.zeros(0, np.int32)
        # words leave whole and in order, so a stable sort by owner restores the text's order
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(words)).astype(np.int64)

    def chunked(self, texts: list[str]) -> list[list[str | int]]:
        """Each text's chunks in order, with added tokens as ids."""
        out = []
        for text in texts:
            if self.special is None or not any(t in text for t in self.added):
                out.append(CHUNKS.findall(text))
                continue
            chunks: list[str | int] = []
            at = 0
            for m in self.special.finditer(text):
                chunks += CHUNKS.findall(text[at : m.start()])
                chunks.append(self.added[m.group()])
                at = m.end()
            out.append(chunks + CHUNKS.findall(text[at:]))
        return out

    def pieces(self, chunk: str) -> list[str]:
        """A chunk's pre-tokens."""
        if not chunk:
            return []
        if chunk.isascii() or max(chunk) < LATIN_END:
            body = chunk[1:] if chunk[0] == " " else chunk
            if body.isalpha():
                return [chunk]
            if body[:-1].isalpha() and body[-1] in ".,;:?!":
                return [chunk[:-1], chunk[-1]]
            return PATTERN.findall(chunk)
        # letters of other scripts: the library's own tables decide, as Unicode versions differ
        if self.cutter is None:
            from tokenizers import Regex, pre_tokenizers

            self.cutter = pre_tokenizers.Split(Regex(PATTERN.pattern), "isolated")
        return [p for p, _ in self.cutter.pre_tokenize_str(chunk)]

    def numbered(self, texts: pa.Array) -> tuple[list[str | int], np.ndarray, np.ndarray]:
        """(distinct chunks, the numbers of all texts' chunks in order, the texts' offsets among them).

        Most texts are cut and numbered by Arrow's kernels, so that only distinct chunks become Python objects; those
        with uneven white space or strings of added tokens by the regular expression."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, UNEVEN)
        for token in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        odd = odd.to_numpy(zero_copy_only=False)
        even = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        even = pc.replace_substring_regex(pc.binary_join_element_wise(GLUE, even, ""), END_SIGN, r"\1 " + GLUE + r"\2\3")
        words = pc.split_pattern(even, " ")
        flat = words.flatten().dictionary_encode()
        chunks: list[str | int] = [w[1:] if w[:1] == GLUE else " " + w for w in flat.dictionary.to_pylist()]
        number, offsets = flat.indices.to_numpy().astype(np.int64), (words.offsets.to_numpy() - words.offsets[0].as_py()).astype(np.int64)
        if odd.any():
            at = np.flatnonzero(odd)
            known: dict[str | int, int] = {}
            own = [[known.setdefault(c, len(known)) for c in x] for x in self.chunked(texts.take(pa.array(at)).to_pylist())]
            parts = np.split(number, offsets[1:-1])
            for i, x in zip(at.tolist(), own):
                parts[i] = np.array(x, np.int64) + len(chunks)
            chunks += known
            number, offsets = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return chunks, number, offsets
