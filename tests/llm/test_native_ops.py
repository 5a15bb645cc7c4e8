"""Line dedup, mixing and quality rules against brute force."""


from collections import Counter, defaultdict

import pytest

from crosscut.llm import line_dedup, mixing, quality_rules

WS = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def kept_lines(rows):
    key = lambda line: lower(line.strip(WS))
    order = lambda d: (d is None, d or 0)
    first = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                first[key(line)] = min(first.get(key(line), (True, 1 << 70)), order(d))
    return [(d, [x for x in (t or "").split("\n") if len(key(x)) < 10 or first[key(x)] == order(d)], len((t or "").split("\n"))) for d, t in rows]


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (4, 2), (7, 3)])
def test_line_dedup(odd, batches, fanout):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    got = line_dedup.dedup_lines(odd, batches=batches, fanout=fanout).collect()
    want = [(str(d), "\n".join(k), n, n - len(k)) for d, k, n in kept_lines(rows)]
    assert sorted((str(r["doc_id"]), r["text"], r["n_lines"], r["n_dropped"]) for r in got) == sorted(want)
    assert {"score", "k", "lang"} <= set(got[0].asDict())


def test_line_dedup_empty(empty):
    assert line_dedup.dedup_lines(empty).count() == 0


def base(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    grams = defaultdict(list)
    for i in range(len(words) - 7):
        grams[tuple(words[i : i + 8])].append(i)
    covered = {j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if x.strip(WS)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(odd, empty):
    extra = "one two three four five six seven eight nine " * 4 + "\nsame\nsame\n ## $"
    df = odd.unionByName(odd.sparkSession.createDataFrame([(50 + i, f"Cookie notice for all pages\n{extra if i % 2 else f'text {i}'}", "h") for i in range(30)], "doc_id long, text string, source string"), allowMissingColumns=True)
    rows = quality_rules.quality_rules(df, min_docs=20, max_share=0.5).collect()
    assert len(rows) == df.count()
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base(r["text"])
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    # half of the host's texts are copies of one: 16 distinct texts don't reach the limit of 20
    assert sum(r["n_removed_lines"] for r in rows) == 0
    many = df.sparkSession.createDataFrame([(i, f"Cookie notice for all pages\nown words of document {i} " + " ".join(f"w{i}x{j}" for j in range(30)), "h") for i in range(30)] + [(99, "Cookie notice for all pages\n" * 5, "h")], "doc_id long, text string, source string")
    for small in (0, 10):
        got = {r["doc_id"]: r for r in quality_rules.quality_rules(many, min_docs=20, broadcast_rows=small).collect()}
        assert all(got[i]["n_removed_lines"] == 1 and got[i]["n_left_words"] == got[i]["n_words"] - 5 and got[i]["kept"] for i in range(30))
        assert got[99]["n_removed_lines"] == 5 and not got[99]["kept"]
    assert quality_rules.quality_rules(empty).count() == 0


def test_quality_rules_in_a_small_and_a_hot_host(spark):
    """The same line in the same number of documents goes in either host, and stays at the limit."""
    own = lambda h, i: " ".join(f"{h}{i}x{j}" for j in range(30))
    line = lambda i: "Cookie notice for all pages\n" if i < 25 else "Line at the limit here\n" if i < 45 else ""
    rows = [(h * 10_000 + i, f"{line(i)}{own(h, i)}", f"host{h}") for h, n in enumerate((60, 2000)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = quality_rules.quality_rules(df).select("doc_id", "n_removed_lines").collect()
    assert {r["doc_id"] for r in got if r["n_removed_lines"]} == {h * 10_000 + i for h in (0, 1) for i in range(25)}
    shared = quality_rules.quality_rules(df, max_share=0.02).filter("n_removed_lines > 0").collect()
    assert {r["doc_id"] for r in shared} == set(range(25))


def test_quality_rules_count_documents_or_texts(spark):
    """Copies are documents of their own, rows of one doc_id are one document; more lines than a broadcast takes change nothing."""
    copy = "A line of the copied page\n" + " ".join(f"c{j}" for j in range(30))
    rows = [(i, copy, "h") for i in range(25)] + [(100, f"One document many rows\nand row {i}", "h") for i in range(25)] + [(200 + i, copy, "other") for i in range(20)]
    rows += [(300 + i, f"Cookie notice for all pages\n{'rarer line of some' if i < 22 else ''}\n" + " ".join(f"w{i}x{j}" for j in range(30)), "h") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for broadcast_rows in (0, 1, 2, 10):
        got = quality_rules.quality_rules(df, count="documents", broadcast_rows=broadcast_rows).collect()
        assert len(got) == len(rows)
        for r in got:
            i = r["doc_id"]
            assert r["n_removed_lines"] == (2 if i < 25 or 300 <= i < 322 else 1 if i >= 322 else 0), (broadcast_rows, i)
            assert r["kept"] == (not r["base_failed"] and i >= 25)
    texts = quality_rules.quality_rules(df).filter("n_removed_lines > 0").select("doc_id").collect()
    assert {r["doc_id"] for r in texts} == {100} | {300 + i for i in range(40)}  # the rows of 100 differ


def test_line_dedup_leaves_no_tables(spark, odd):
    before = {t.name for t in spark.catalog.listTables()}
    assert line_dedup.dedup_lines(odd, batches=7).count() == odd.count()
    assert {t.name for t in spark.catalog.listTables()} == before


def targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, left = sum(sizes.values()), {}, dict(w)
    while left:
        rest = total - sum(out.values())
        share = {s: rest * w[s] / sum(left.values()) for s in left}
        above = [s for s in left if share[s] > most * sizes[s]]
        if not above:
            return out | share
        for s in above:
            out[s] = most * sizes[s]
            del left[s]
    return out


def test_mix(spark, odd, empty):
    text = lambda i: " ".join(f"{chr(97 + i % 26)}{j}" for j in range(30 + i % 50))
    df = spark.createDataFrame([(i, text(i), f"s{i % 7}" if i % 9 else None) for i in range(800)], "doc_id long, text string, source string").unionByName(odd.select("doc_id", "text", "source"))
    plan = mixing.mix(df, block_words=16)
    rows = plan.taken.collect()
    assert len(rows) == df.count()
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    want, taken = targets(sizes), Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
    for s, n in taken.items():  # five standard deviations of the draws, and a block
        assert abs(n - want[s]) <= 16 + 5 * (want[s] * 16) ** 0.5, s
    assert abs(sum(taken.values()) - sum(sizes.values())) <= 16 * len(sizes)
    again = mixing.mix(df.repartition(5), block_words=16).taken.collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    # every slot once, every source's passes complete before the next
    slots = plan.slots.collect()
    assert len({(s["source"], s["k"]) for s in slots}) == len(slots)
    per = Counter((s["source"], s["pass"], s["block"]) for s in slots)
    assert max(per.values()) == 1
    assert mixing.mix(empty).taken.count() == 0
    # other draws alone, under the same permutations, read other words
    other = {(r["doc_id"], r["t"], r["copy"]): r["taken"] for r in mixing.mix(df, block_words=16, draw_seed=99).taken.collect()}
    assert sum(other[r["doc_id"], r["t"], r["copy"]] != r["taken"] for r in rows) > 20
    counts = Counter()
    for r in plan.runs.collect():
        counts[r["no"]] += r["n"]
    blocks = {r["no"]: r for r in plan.sources.collect()}
    assert all(n <= 3 * blocks[no]["blocks"] for no, n in counts.items())


def test_mix_of_equal_rows(spark):
    """Thousands of equal rows take work in proportion to their number, and a small source stops at three passes."""
    rows = [(7, "a b c d e", "x")] * 5000 + [(i, "w " * 40, "y") for i in range(8, 12)]
    plan = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4))
    assert plan.stretches.count() <= 2 * (5000 + 25_160 // 16 + 20)
    got = plan.taken.collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert sum(r["taken"] for r in got if r["source"] == "y") == 3 * 160


def test_mixed_documents_hold_what_is_taken(odd):
    taken = {}
    for r in mixing.mix(odd, block_words=4).taken.collect():
        taken[str(r["doc_id"])] = taken.get(str(r["doc_id"]), 0) + r["taken"]
    out = mixing.mixed_documents(odd, block_words=4)
    assert out.columns == odd.columns
    got = Counter()
    for r in out.collect():
        got[str(r["doc_id"])] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    assert {k: v for k, v in taken.items() if v} == dict(got)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation(spark, n):
    from pyspark.sql import functions as F

    got = [r[0] for r in spark.range(n).select(F.expr(mixing.permuted_sql("id", f"{n}L", "7, 'x'"))).collect()]
    assert sorted(got) == list(range(n))


