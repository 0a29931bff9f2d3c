"""Registered queries on the smallest tables: against SQL where there is some, else against plain Python."""

import zlib

import brute
import pytest
from compare import differences

from codeloom.llm import pieces, quality, registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert differences(spark, registry.QUERIES[name], registry.SQL[name], sf_dir) == []


def _docs(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def _pipeline(docs, items):
    """The texts that the pipeline keeps, by doc_id, made by plain Python."""
    docs = [d for d in docs if brute.quality(d[1], quality.MIN_REPEAT, quality.MAX_COVERED, quality.MAX_LONGEST)["kept"]]
    docs = [d for d, (n, c) in zip(docs, brute.components(docs), strict=True) if n == 0 or c == d[0]]
    docs = [(k, b" ".join(kept).decode() if len(kept) < len(w) else t) for (k, t), (w, kept) in zip(docs, brute.substrings([t for _, t in docs]), strict=True)]
    return {k: brute.cut(t, items) for k, t in docs}


def test_pipeline_equals_brute_force(spark, sf_dir):
    import corpus_pipeline
    import sentencepiece

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.model_file())
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    want = _pipeline(_docs(spark, sf_dir), items)
    assert set(out) == set(want)
    for k, t in want.items():
        assert out[k].ids == [1, *model.encode(t), 2] and out[k].decoded == t and out[k].n_tokens == len(out[k].ids)


def test_pipeline_on_odd_tables(spark, sf_dir, tmp_path):
    """No rows; null ids, texts and columns, repeated rows, and columns with clashing names."""
    import corpus_pipeline

    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    few = docs.orderBy("doc_id").limit(30)
    odd = few.union(few.limit(5)).union(spark.createDataFrame([(None, few.first().text + " more words", None, None, None), (999, None, "en", "x", None), (998, "", "en", "x", 0)], docs.schema))
    for name, table in (("none", docs.limit(0)), ("odd", odd.selectExpr("*", "1 kept", "2 ids", "3 row", "4 inner0"))):
        table.coalesce(1).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        items.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
    got = {r.doc_id: r.decoded for r in corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()}
    rows = list(dict.fromkeys((r.doc_id, r.text) for r in odd.collect()))
    assert got == _pipeline(rows, [(r.item_id, r.text) for r in items.collect()])


def test_pieces_query_on_a_whole_table(spark, sf_dir):
    import struct

    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.model_file())
    got = {r.doc_id: r for r in registry.QUERIES["op8_pieces"](spark, sf_dir).collect()}
    docs = _docs(spark, sf_dir)
    assert len(got) == len(docs)
    for k, t in docs:
        ids = [1, *model.encode(t or ""), 2]
        assert got[k].n_tokens == len(ids) and got[k].ids_sha256 == brute.sha(struct.pack(f"<{len(ids)}I", *ids)) and got[k].decoded_sha256 == brute.sha(model.decode(ids).encode())


def test_lm_query_equals_plain_counting(spark, sf_dir):
    import math

    from codeloom.llm import lm

    docs = _docs(spark, sf_dir)
    held = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k, _ in docs}
    model = brute.Trigrams([t for k, t in docs if not held[k]], lm.ADD, lm.WEIGHTS)
    got = {r.doc_id: r for r in registry.QUERIES["op10_lm"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    total = sum(model.c[1].values())
    for k, t in docs:
        assert got[k].held_out == held[k] and got[k].train_tokens == total
        assert math.isclose(got[k].score, model.score(t), rel_tol=1e-9)


def test_toxicity_on_held_out_documents(spark):
    rows = {r.doc_id: r for r in registry.QUERIES["op3_toxicity"](spark, "/root/testdata/sf0.01").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in rows.items())
    held = [(rows[k].score, y) for k, y in labels.items() if k in rows and rows[k].held_out]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    assert sum(p > n for p in pos for n in neg) > 0.9 * len(pos) * len(neg)


def test_lm_beats_its_unigrams(spark):
    held = [r for r in registry.QUERIES["op10_lm"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.2 * sum(r.n_tokens for r in held)


def test_toxicity_factors_lower_the_held_out_loss():
    """With its pair factors set to zero the machine is worse on the labelled rows that it never saw."""
    import numpy as np
    import pyarrow.parquet as pq

    from codeloom.llm import toxicity

    folder = "/root/testdata/sf0.1"
    labels = pq.read_table(f"{folder}/labels.parquet").to_pydict()
    toxic = {k: float(v) for k, v in zip(labels["doc_id"], labels["toxic"], strict=True) if v is not None}
    docs = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    rows = [(k, t.encode()) for k, t in zip(docs["doc_id"], docs["text"], strict=True) if k in toxic and t is not None]
    held = [zlib.crc32(str(k).encode()) % 4 == 2 for k, _ in rows]

    def side(which):
        some = [r for r, h in zip(rows, held, strict=True) if h == which]
        return *toxicity.text_terms([t for _, t in some]), np.array([toxic[k] for k, _ in some])

    machine = toxicity.fit(*side(False))
    terms, first, y = side(True)

    def loss(m):
        p = np.clip(m.score(terms, first), 1e-9, 1 - 1e-9)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    linear = toxicity.FactorizationMachine(machine.bias, machine.w, np.zeros_like(machine.v), machine.known)
    assert loss(machine) < 0.8 * loss(linear)
    score = machine.score(terms, first)
    assert brute.auc(score, y) > 0.97 and brute.auc(score, y) > brute.auc(linear.score(terms, first), y)
    assert (score[y > 0] >= toxicity.THRESHOLD).mean() > 0.8 and y[score >= toxicity.THRESHOLD].mean() > 0.9
