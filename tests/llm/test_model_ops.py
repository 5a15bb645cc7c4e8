"""Language ID, quality model, transport streams, near-duplicates and the pipeline."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest

from crosscut.llm import langid, near_dup, quality_model, registry, transport
from crosscut.llm.common import documents, table

SF = "/root/testdata/sf0.01"
data = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 2880, 2881, 23040, 23041, 300_001])
def test_transport_round_trip(n):
    payload = transport.pad(random.Random(n).randbytes(n))
    assert len(payload) % 576 == 0 and payload
    media = transport.mux(payload)
    got = transport.demux(media)
    assert got["payload"] == payload and got["continuity_errors"] == 0
    assert len(got["pts"]) == -(-len(payload) // transport.UNIT)
    packets = np.frombuffer(media, np.uint8).reshape(-1, 188)
    for pts, at in zip(got["point_pts"], got["point_packets"]):
        assert packets[at, 5] & 0x40 and pts in got["pts"]


def test_transport_reports_losses_and_rejects_broken_tables(spark):
    payload = transport.pad(random.Random(1).randbytes(50_000))
    media = np.frombuffer(transport.mux(payload), np.uint8).reshape(-1, 188)
    pids = (media[:, 1] & 0x1F).astype(int) << 8 | media[:, 2]
    es = np.flatnonzero(pids == transport.ES_PID)
    starts = es[media[es, 1] & 0x40 > 0]
    faults = lambda m: {f: v for f, v in transport.demux(m.tobytes()).items() if f in transport.FAULTS and v}
    assert faults(media) == {}
    without = lambda rows: faults(np.delete(media, rows, 0))
    assert without(20)["continuity_errors"] == 1 and without(20)["length_errors"] == 1
    assert without(es[0])["length_errors"] == 1 and without(es[0])["missing_units"] == 1
    assert without(es[-1])["length_errors"] == 1 and without(es[-1])["missing_bytes"] > 0
    first = es[es < starts[1]]
    assert without(first)["missing_units"] == 1 and without(first)["missing_bytes"] == transport.UNIT
    within = es[(es >= starts[2] + 3)][:16]  # the counter comes round
    assert without(within)["missing_units"] == 1 and without(within)["missing_bytes"] == transport.UNIT
    middle = es[(es >= starts[2]) & (es < starts[3])]
    assert without(middle)["missing_units"] == 1
    tables = np.flatnonzero(pids == transport.PMT_PID)
    assert without(tables[1])["continuity_errors"] == 1 and set(without(tables[1])) == {"continuity_errors"}
    twice = np.insert(media, 20, media[20], 0)
    assert faults(twice) == {"repeated_packets": 1} and transport.demux(twice.tobytes())["payload"] == payload
    broken = media.copy()
    broken[tables, 20] ^= 1
    with pytest.raises(ValueError, match="broken table"):
        transport.demux(broken.tobytes())
    rows = [(1, media.tobytes()), (2, None), (3, broken.tobytes()), (4, b"G" * 187), (5, b"")]
    got = {r["id"]: r for r in transport.read_media(spark.createDataFrame(rows, "id long, media binary")).collect()}
    assert got[1]["error"] is None and got[1]["payload_bytes"] == len(payload) and got[1]["point_pts"] and len(got[1]["point_pts"]) == len(got[1]["point_packets"])
    assert [got[i]["error"] for i in (2, 4, 5)] == ["no media", "not whole packets", "not whole packets"] and "broken table" in got[3]["error"]


def test_transport_contract(odd):
    """The contract's columns against hashlib and zlib, with null, empty and long texts."""
    rows = transport.read_media(transport.store_media(odd.withColumn("body", odd["text"]))).collect()
    for r in rows:
        raw = (r["body"] or "").encode()
        want = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(want[-32:]) and r["error"] is None and all(r[f] == 0 for f in transport.FAULTS)
        media = transport.mux(want)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        assert len(r["pts"]) == -(-len(want) // transport.UNIT) and set(r["point_pts"]) == set(r["pts"][:: transport.UNITS_PER_POINT])


def test_odd_tables(odd, empty):
    stored = transport.read_media(transport.store_media(odd))
    assert stored.count() == odd.count() and stored.agg({"continuity_errors": "max"}).first()[0] == 0
    model = langid.fit(odd)
    rows = langid.identify(odd, model).collect()
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) or r["lang_pred"] == "und" for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows) and len(rows) == odd.count()
    labels = odd.select("doc_id").distinct().selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality")
    scored = quality_model.score(odd, quality_model.fit(odd, labels)).collect()
    assert len(scored) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in scored)
    assert langid.identify(empty, langid.fit(empty)).count() == 0
    assert quality_model.score(empty, quality_model.fit(empty, labels.filter("false"))).count() == 0
    assert transport.read_media(transport.store_media(empty)).count() == 0
    assert near_dup.keep_first(empty).count() == 0


@data
def test_held_out_accuracy(spark):
    got = registry.QUERIES["op5_language_id"](spark, SF).join(documents(spark, SF).select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95
    got = registry.QUERIES["op2_quality_classifier"](spark, SF).join(table(spark, SF, "labels"), "doc_id").filter("held_out").collect()
    assert np.mean([r["quality"] == r["predicted"] for r in got]) > 0.85


def test_ftrl_follows_the_plain_updates():
    """The array updates against the published per-coordinate rule, place by place."""
    rng, q = np.random.default_rng(5), quality_model
    rows = [(np.sort(rng.choice(40, 6, replace=False)), rng.random(6), int(rng.random() < 0.4)) for _ in range(300)]
    model, z, n, bias = q.Ftrl(40), [0.0] * 40, [0.0] * 40, [0.0, 0.0]

    def weight(i):
        return 0.0 if abs(z[i]) <= q.L1 else -(z[i] - (q.L1 if z[i] > 0 else -q.L1)) / ((q.BETA + n[i] ** 0.5) / q.ALPHA + q.L2)

    for places, values, label in rows:
        model.update(places, values, label)
        w, b = {i: weight(i) for i in places}, -bias[0] / ((q.BETA + bias[1] ** 0.5) / q.ALPHA)
        g = 1 / (1 + np.exp(-(sum(w[i] * v for i, v in zip(places, values)) + b))) - label
        for i, v in zip(places, values):
            z[i] += g * v - ((n[i] + (g * v) ** 2) ** 0.5 - n[i] ** 0.5) / q.ALPHA * w[i]
            n[i] += (g * v) ** 2
        bias = [bias[0] + g - ((bias[1] + g * g) ** 0.5 - bias[1] ** 0.5) / q.ALPHA * b, bias[1] + g * g]
    assert np.allclose(model.weights, [weight(i) for i in range(40)]) and np.count_nonzero(model.weights)
    assert np.isclose(model.bias, -bias[0] / ((q.BETA + bias[1] ** 0.5) / q.ALPHA))


def test_quality_learns_from_long_texts(spark):
    """Labelled texts of any length teach, and scores order held-out texts."""
    good, bad = "a calm and careful account of the matter ", "buy now click here win big prizes "
    rows = [(i, (good if i % 2 else bad) * (700 if i < 20 else 3), i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    for known in ("doc_id < 20", "doc_id >= 20"):
        model = quality_model.fit(df.select("doc_id", "text"), df.filter(known).select("doc_id", "quality"))
        got = quality_model.score(df, model).collect()
        assert min(r["score"] for r in got if r["quality"]) > 0.5 > max(r["score"] for r in got if not r["quality"])


@data
def test_quality_ranks_held_out_rows(spark):
    got = registry.QUERIES["op2_quality_classifier"](spark, SF).join(table(spark, SF, "labels"), "doc_id").filter("held_out").collect()
    good, bad = ([r["score"] for r in got if r["quality"] == y] for y in (1, 0))
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.95


def brute(rows, words, percent):
    sets = {}
    for d, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets[d] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    near = {d: {e for e in sets if e != d and sets[d] and sets[e] and 100 * len(sets[d] & sets[e]) >= percent * len(sets[d] | sets[e])} for d in sets}
    out = {}
    for d in sets:
        seen, todo = {d}, [d]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        out[d] = min(seen)
    return out, {d: len(s) for d, s in sets.items()}


@pytest.mark.parametrize(("words", "percent", "block"), [(3, 85, 512), (5, 80, 8)])
def test_near_duplicates(spark, monkeypatch, words, percent, block):
    """Chains, copies, a group without a centre, and odd texts, in blocks small enough to meet each other."""
    monkeypatch.setattr(near_dup, "BLOCK", block)
    monkeypatch.setattr(near_dup, "STAR", 5)
    rng, rows = random.Random(3), [(1000, None), (1001, ""), (1002, "one two"), (1003, "ONE  two"), (1004, "two one"), (1005, " ")]
    for g in range(12):
        text = [f"g{g}w{rng.randrange(500)}" for _ in range(150)]
        for i in range(14):
            if g % 3 == 0:
                text = list(text)  # a chain: each copy starts from the one before
                own = text
            else:
                own = list(text)
            for _ in range(rng.randrange(5)):
                own[rng.randrange(150)] = f"new{rng.randrange(10**6)}"
            rows.append((g * 20 + i, " ".join(own)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = near_dup.NearDuplicates(df, words=words, percent=percent).documents.collect()
    component, sizes = brute(rows, words, percent)
    assert {r["k"]: r["component"] for r in got} == component
    assert {r["k"]: r["n_shingles"] for r in got} == sizes


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (200, 201)]
    got = near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["label"] for r in got} == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 200: 200, 201: 200}


def test_pipeline_stages(spark, odd):
    import corpus_pipeline as p

    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    names = [n for n, _ in p.STAGES]
    assert len(names) == 5
    for name, stage in p.STAGES:
        new = stage(spark, docs, None).cache()
        if name != names[-1]:
            assert new.columns == docs.columns
        if name == "language ID":
            assert all(any(c.isalpha() for c in r["text"]) for r in new.collect())
        docs = new
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in docs.collect())
