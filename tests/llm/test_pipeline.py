"""The pipeline's rows against plain Python: every stage on what the one before it kept, and the whole run."""

import hashlib
import math
import random
from collections import Counter

import tokenizers
import xxhash
import zstandard
from test_model_ops import brute
from test_native_ops import kept_lines, targets

import corpus_pipeline
from crosscut.llm import langid, mixing
from crosscut.llm.token_files import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
NO_ID = 2**63 - 1


def corpus():
    """Three languages, repeated lines and rows, near copies, texts of no language, odd texts and ids."""
    rng, rows = random.Random(11), []
    words = {x: ["".join(rng.choices(letters, k=rng.randrange(2, 8))) for _ in range(90)] for x, letters in (("aa", "aeioubdg"), ("bb", "aeioukst"), ("cc", "éèàmnprl"))}
    line = lambda x, n: " ".join(rng.choices(words[x], k=n))
    common = {x: line(x, 8) for x in words}
    for i in range(150):
        x = rng.choice(list(words))
        text = line(x, 120) if i < 10 else "\n".join(line(x, rng.randrange(5, 40)) for _ in range(rng.randrange(1, 5)))
        if i % 6 == 5:
            text = f"{common[x].upper()} \n{text}"
        rows.append((i, text, x if i % 7 else None, None if i % 11 == 0 else f"s{i % 4}"))
    for i in range(150, 200):  # near copies, a few words apart
        _, text, x, s = rows[rng.randrange(10)]
        w = text.split(" ")
        if i % 2:
            w[rng.randrange(len(w))] += "x"
        rows.append((i, " ".join(w), x, s))
    rows += [(200, None, "aa", "s1"), (201, "", "bb", None), (202, " \t12 34\n", "cc", "s2"), (203, "ЖЖЖЖ ЩЩЩ", None, "s1"), (204, "ωψ", None, "s3"), (205, common["aa"], "aa", "s1")]
    rows += [(None, line("bb", 30), "bb", "s2"), (206, line("aa", 3000), "aa", "s0")] + [(207, line("cc", 25), "cc", "s3")] * 3
    return [(*r, len(r[1] or "")) for r in rows]


def spark_hash(*values):
    """The engine's 64-bit hash of several columns: numbers as bytes, nulls left out."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v, h)
    return h


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def i4(x):
    return x.to_bytes(4, "little", signed=True)


def i8(x):
    return None if x is None else x.to_bytes(8, "little", signed=True)


def identified(rows):
    bodies: dict[str, list] = {}
    for _, text, lang in {r[:3] for r in rows if r[2] is not None}:
        if body := langid.normalised(text or "").split():
            bodies.setdefault(lang, []).append(body)
    how = zstandard.ZstdCompressionParameters(**langid.COMPRESSION, write_checksum=False, write_content_size=False, write_dict_id=False)
    dictionaries = []
    for lang in sorted(bodies):
        n = Counter()
        for w in bodies[lang]:
            n.update({*w, *map(" ".join, zip(w, w[1:]))})
        terms = sorted((t for t in n if n[t] > 1 or " " not in t), key=lambda t: (-n[t], t.encode()))
        assert sum(len(t.encode()) + 1 for t in terms) < langid.DICT_BYTES
        dictionaries.append(zstandard.ZstdCompressionDict(f" {' '.join(reversed(terms))} ".encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
        dictionaries[-1].precompute_compress(compression_params=how)

    def clear(text):
        body = langid.normalised(text or "").encode()
        if not body:
            return False
        sizes = sorted(len(zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress(body)) for d in dictionaries)
        return (sizes[1] - sizes[0]) / sizes[1] >= 0.005

    return [r for r in rows if clear(r[1])]


def without_repeated_lines(rows):
    kept = ["\n".join(lines) for _, lines, _ in kept_lines([r[:2] for r in rows])]
    return [(r[0], t, *r[2:4], len(t)) for r, t in zip(rows, kept)]


def without_near_copies(rows):
    key = lambda r: NO_ID if r[0] is None else r[0]
    component, _ = brute([(key(r), r[1]) for r in rows], 5, 80)
    return [r for r in rows if component[key(r)] == key(r)]


def permuted(x, n, key):
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    while True:
        left, right = divmod(x, b)
        for i in range(3):
            left = (left + signed(spark_hash(*key, i4(2 * i), i8(right)))) % a
            right = (right + signed(spark_hash(*key, i4(2 * i + 1), i8(left)))) % b
        if (x := left * b + right) < n:
            return x


def mixed(rows, width=64, seed=mixing.SEED):
    words = lambda t: [w.decode() for w in t.encode().split()]
    sizes: Counter = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    blocks = {s: -(-sizes[s] // width) for s in names}
    share = {s: t * blocks[s] / sizes[s] for s, t in targets(sizes).items()}
    drawn, total, shard, turn = Counter(), round(sum(share.values())), 0, 0
    while total:
        ends, upto = [], 0.0
        for s in names:
            upto += share[s]
            ends.append((round(upto / sum(share.values()) * 2**40), s))
        for slot in range(total):
            draw = spark_hash(i4(seed), "draw", i4(turn), i8(shard + slot // 1024), i4(slot % 1024)) >> 24
            drawn[next(s for end, s in ends if draw < end)] += 1
        above = sum(max(0, drawn[s] - 3 * blocks[s]) for s in names)
        shard, turn, total = shard + -(-total // 1024), turn + 1, min(above, sum(max(0, 3 * blocks[s] - drawn[s]) for s in names))
        drawn = Counter({s: min(drawn[s], 3 * blocks[s]) for s in names})
        share = {s: share[s] if drawn[s] < 3 * blocks[s] else 0.0 for s in names}
    times = Counter((s, permuted(k % blocks[s], blocks[s], (i4(seed), s, i8(k // blocks[s])))) for s in names for k in range(drawn[s]))
    groups, out = Counter(rows), []
    t = lambda r: signed(spark_hash(r[1]))
    place = lambda r: (signed(spark_hash(i8(r[0]), i8(t(r)), i4(seed))) % 64, r[0] is not None, r[0] or 0, t(r))
    for s in names:
        start = 0
        for r in sorted((r for r in groups if r[3] == s), key=place):
            w = words(r[1])
            for _ in range(groups[r] if w else 0):
                cuts = [(max(0, b * width - start), min(len(w), (b + 1) * width - start), times[s, b]) for b in range(start // width, (start + len(w) - 1) // width + 1)]
                start += len(w)
                for n in range(1, max(c[2] for c in cuts) + 1):
                    read = [x for first, last, k in cuts if k >= n for x in w[first:last]]
                    text = r[1] if len(read) == len(w) else " ".join(read)
                    out.append((r[0], text, r[2], s, len(text)))
    return out


def encoded(rows):
    tokenizer = tokenizers.Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    out = []
    for doc_id, text, lang, source, n_chars in rows:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        raw, back = b"".join(x.to_bytes(4, "little") for x in ids), tokenizer.decode(ids, skip_special_tokens=False)
        out.append((doc_id, lang, source, n_chars, len(ids), raw, hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    return out


PLAIN = [identified, without_repeated_lines, without_near_copies, mixed, encoded]


def plain(rows):
    return [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in rows]


def test_run_against_brute_force(spark, tmp_path):
    docs = corpus()
    spark.createDataFrame(docs, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    sizes = [len(docs)]
    now, want = spark.read.parquet(f"{tmp_path}/documents.parquet"), docs
    for i, ((name, stage), by_hand) in enumerate(zip(corpus_pipeline.STAGES, PLAIN, strict=True)):
        before, want = want, by_hand(want)
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        now = spark.read.parquet(f"{tmp_path}/{i}")
        assert Counter(plain(now.collect())) == Counter(want), name
        assert i == 4 or Counter(want) != Counter(before), f"{name} has nothing to do"
        sizes.append(len(want))
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] and sizes[4] == sizes[5]
    # narrow margins and texts without letters go, and no more than a few others with them
    assert sizes[1] >= 0.9 * sizes[0]
    assert Counter(plain(corpus_pipeline.run(spark, str(tmp_path)).collect())) == Counter(want)


def test_run_on_odd_tables(spark, odd, tmp_path):
    """An empty table gives an empty result; nulls, repeated rows and columns named like results do no harm."""
    odd.filter("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    odd.write.parquet(f"{tmp_path}/odd/documents.parquet")
    got = plain(corpus_pipeline.run(spark, f"{tmp_path}/odd").collect())
    rows = [tuple(r) for r in odd.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert {r[0] for r in got} <= {r[0] for r in identified(rows)}
    assert all(len(r[5]) == 4 * r[4] and r[6] == hashlib.sha256(r[5]).hexdigest() for r in got)
