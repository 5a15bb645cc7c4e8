"""What Python workers are sent and what they keep."""

import pyarrow as pa

import corpus_pipeline
from crosscut.llm import common


def sent(df):
    """The columns that MapInArrow nodes of df's plan get."""
    node, found = df._jdf.queryExecution().optimizedPlan(), []
    while node.children().nonEmpty():
        child = node.children().head()
        if "MapInArrow" in node.nodeName():
            found.append([child.output().apply(i).name() for i in range(child.output().size())])
        node = child
    return found


def test_texts_are_sent_once(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "y"), (3, "c", None)], "id long, text string, other string")
    make = lambda: lambda texts: {"n": [len(t) for t in texts]}
    for keep, columns in ((["other", "text", "id"], ["other", "text", "id"]), (["id"], ["id", "__text"]), ([], ["__text"])):
        out = common.map_texts(df, make, "n long", keep)
        assert out.columns == [*keep, "n"] and sent(out) == [columns]
        want = [{"id": 1, "text": "a b", "other": "x", "n": 3}, {"id": 2, "text": None, "other": "y", "n": 0}, {"id": 3, "text": "c", "other": None, "n": 1}]
        assert sorted(map(str, (r.asDict() for r in out.collect()))) == sorted(str({c: r[c] for c in [*keep, "n"]}) for r in want)


def test_pipeline_sends_texts_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"some words here {i}", "en" if i % 2 else "de", "s", 0) for i in range(9)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sent(corpus_pipeline.identify_language(spark, docs, "")) == [docs.columns]
    assert sent(corpus_pipeline.encode_tokens(spark, docs, "")) == [["doc_id", "lang", "source", "n_chars", "__text"]]


def test_a_worker_keeps_one_kernel():
    made = []
    get = lambda k: common.worker_kernel((k,), lambda: made.append(k) or k)
    assert [get("a"), get("a"), get("b"), get("a")] == ["a", "a", "b", "a"] and made == ["a", "b", "a"] and list(common._kernels) == [("a",)]


def test_freed_memory_goes_back():
    pool = pa.default_memory_pool()
    x = pa.array(range(2_000_000))
    held = pool.bytes_allocated()
    del x
    common.give_back()
    assert pool.bytes_allocated() < held


def test_batches_are_bounded_in_bytes(spark):
    """Long rows come in small batches, which end with the row that reaches the limit, and none is lost; a lower limit of the session stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    df = spark.range(0, 40, 1, 1).selectExpr("id", "repeat('x', IF(id = 7, 9000000, 300000)) AS text")
    out = common.map_texts(df, lambda: lambda texts: {"n": [len(t) for t in texts]}, "n long", ["id"])

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "size": [b.nbytes]})

    got = df.mapInArrow(sizes, "rows long, size long").collect()
    assert sum(r[0] for r in got) == 40 and sum(r[1] > 1.2 * common.BATCH_BYTES for r in got) == 1 and max(r[1] for r in got) < common.BATCH_BYTES + 9_500_000
    assert {r["id"]: r["n"] for r in out.collect()} == {i: 9000000 if i == 7 else 300000 for i in range(40)}
    spark.conf.set(name, "1m")
    common.small_batches(spark)
    assert spark.conf.get(name) == "1m"
    spark.conf.unset(name)
