"""Every registered query of the training-data operators, and each stage of the pipeline, at the smallest scale."""

import collections
import glob
import hashlib
import math
import os
import zlib

import duckdb
import numpy as np
import pytest

import brute
import corpus_pipeline
from emberlake.llm import decontam, queries, runtime


SF = "/root/testdata/sf0.001"


def rows(spark, name):
    return [r.asDict() for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()]


@pytest.fixture(scope="module")
def documents(spark):
    return rows(spark, "documents")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    df = queries.QUERIES[name](spark, SF)
    cur = c.execute(queries.ORACLE_SQL[name])
    columns = sorted(d[0] for d in cur.description)
    at = [[d[0] for d in cur.description].index(x) for x in columns]
    assert sorted(df.columns) == columns
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert got == sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=repr)


def test_op2(spark):
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in rows(spark, "embeddings")}
    got = collections.defaultdict(list)
    for r in queries.op2_ann(spark, SF).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == {i for i in vectors if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        true = sorted(((-float((vectors[q] * v).sum()), i) for i, v in vectors.items() if i != q))[:20]
        assert len(found) == min(20, len(vectors) - 1) and all(abs(s - (vectors[q] * vectors[i]).sum()) < 1e-12 for i, s in found)
        hits += len({i for _, i in true} & {i for i, _ in found})
    assert hits >= 0.9 * sum(map(len, got.values()))


def check_packing(got, texts):
    """texts: doc_id and text of every row; ids are unique."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary_path())
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert set(by) == set(texts)
    total = 0
    for i, t in texts.items():
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        total += len(ids)
        want = [(n, s, min(4096, len(ids) - s), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for n, s in enumerate(range(0, len(ids), 4096))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by[i]) == want
    packed = collections.defaultdict(list)
    for r in got:
        packed[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in packed.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(packed) <= math.ceil(total / 4096 * 1.02) + 1


def test_op3(spark, documents):
    check_packing(queries.op3_packing(spark, SF).collect(), {d["doc_id"]: d["text"] for d in documents})


def test_op5(spark, documents):
    raw, gone = brute.repeated_bytes([d["text"] for d in documents])
    got = {r["doc_id"]: r for r in queries.op5_suffix_dedup(spark, SF).collect()}
    assert len(got) == len(documents) and any(g.any() for g in gone)
    for d, b, g in zip(documents, raw, gone):
        r = got[d["doc_id"]]
        spans = int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum())
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(b), int(g.sum()), spans)
        assert r["kept_sha256"] == hashlib.sha256(np.frombuffer(b, np.uint8)[~g].tobytes()).hexdigest()


def test_op6(spark, documents):
    got = {r["doc_id"]: r for r in queries.op6_language_id(spark, SF).collect()}
    assert len(got) == len(documents)
    held = [d for d in documents if brute.fold(d["doc_id"], 4) == 2]
    assert {i for i, r in got.items() if r["held_out"]} == {d["doc_id"] for d in held}
    for d in documents:
        r = got[d["doc_id"]]
        bare = not any(c.isalpha() for c in d["text"] or "")
        assert (r["lang_pred"] == "und") == bare and 0 <= r["score"] <= 1
    judged = [d for d in held if d["lang"] is not None and got[d["doc_id"]]["lang_pred"] != "und"]
    assert judged and sum(got[d["doc_id"]]["lang_pred"] == d["lang"] for d in judged) >= 0.95 * len(judged)


def test_op7(spark, documents):
    tests = rows(spark, "benchmark")
    got = {(r["doc_id"], r["item_id"]) for r in queries.op7_decontamination(spark, SF).collect()}
    want = brute.leaks([d["text"] for d in documents], [t["text"] for t in tests], decontam.SeedParams())
    assert got == {(documents[i]["doc_id"], tests[j]["item_id"]) for i, j in want} and got


def test_op8(spark, documents):
    texts = sorted(documents, key=lambda d: d["doc_id"])
    group, sizes = brute.near_groups([d["text"] for d in texts], 4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in queries.op8_near_duplicates(spark, SF).collect()}
    assert got == {d["doc_id"]: (n, texts[g]["doc_id"], texts[g]["doc_id"] == d["doc_id"]) for d, g, n in zip(texts, group, sizes)}


def test_op9(spark, documents):
    label = {r["doc_id"]: r["quality"] for r in rows(spark, "labels")}
    got = {r["doc_id"]: r for r in queries.op9_quality(spark, SF).collect()}
    assert len(got) == len(documents)
    assert all(r["held_out"] == (brute.fold(i, 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for i, r in got.items())
    scored = [(got[i]["score"], y) for i, y in label.items() if i in got and y is not None]
    good, bad = [s for s, y in scored if y], [s for s, y in scored if not y]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.9


def test_op10(spark, documents):
    got = {r["doc_id"]: r for r in queries.op10_hmm(spark, SF).collect()}
    counts, tokens = collections.Counter(), {}
    for d in documents:
        tokens[d["doc_id"]] = [*brute.words(d["text"]), None]
        if brute.fold(d["doc_id"], 5) != 1:
            counts.update(tokens[d["doc_id"]])
    n, v = sum(counts.values()), len(counts)
    for i, w in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (brute.fold(i, 5) == 1, len(w), sum(counts[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), abs=1e-6)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # better than words alone


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's rows, by its name; 'in' the documents."""
    runtime.prepare(spark)
    scratch, docs = runtime.Scratch(spark), runtime.table(spark, SF, "documents")
    out = {"in": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.write(stage(spark, docs, SF), name)
        out[name] = docs
    return {n: [r.asDict() for r in d.collect()] for n, d in out.items()} | {"columns": {n: d.columns for n, d in out.items()}}


def test_stage_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "repeated_passages", "decontamination", "packing"]
    assert all(stages["columns"][n] == stages["columns"]["in"] for n in names[:-1])


def test_stage_language(stages, spark):
    kept = {d["doc_id"] for d in stages["language_id"]}
    for d in stages["in"]:
        if not any(c.isalpha() for c in d["text"] or ""):
            assert d["doc_id"] not in kept
    labelled = [d for d in stages["in"] if d["lang"] is not None and any(c.isalpha() for c in d["text"] or "")]
    assert sum(d["doc_id"] in kept for d in labelled) >= 0.98 * len(labelled)
    assert [d for d in stages["in"] if d["doc_id"] in kept] == sorted(stages["language_id"], key=lambda d: [x["doc_id"] for x in stages["in"]].index(d["doc_id"]))


def test_stage_near_duplicates(stages):
    texts = sorted(stages["language_id"], key=lambda d: d["doc_id"])
    group, _ = brute.near_groups([d["text"] for d in texts], 5)
    want = [d for i, d in enumerate(texts) if group[i] == i]
    assert sorted(stages["near_duplicates"], key=lambda d: d["doc_id"]) == want and len(want) < len(texts)


def test_stage_passages(stages):
    texts = stages["near_duplicates"]
    raw, gone = brute.repeated_bytes([d["text"] for d in texts])
    want = {}
    for d, b, g in zip(texts, raw, gone):
        left = np.frombuffer(b, np.uint8)[~g].tobytes().decode("utf-8", "ignore")
        if not g.any() or left.strip(" "):
            want[d["doc_id"]] = d | ({"text": left, "n_chars": len(left)} if g.any() else {})
    assert {d["doc_id"]: d for d in stages["repeated_passages"]} == want and any(g.any() for g in gone)


def test_stage_decontamination(stages, spark):
    texts, tests = stages["repeated_passages"], rows(spark, "benchmark")
    hit = {i for i, _ in brute.leaks([d["text"] for d in texts], [t["text"] for t in tests], decontam.SeedParams())}
    assert sorted(d["doc_id"] for d in stages["decontamination"]) == sorted(d["doc_id"] for i, d in enumerate(texts) if i not in hit)


def test_stage_packing(stages, spark):
    check_packing(stages["packing"], {d["doc_id"]: d["text"] for d in stages["decontamination"]})
    whole = corpus_pipeline.run(spark, SF).select("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(map(tuple, whole.collect())) == sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in stages["packing"])
