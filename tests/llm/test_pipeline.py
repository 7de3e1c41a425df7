"""The pipeline stage by stage on a small corpus, each against a plain version."""

import collections
import hashlib
import random

import numpy as np
import pytest

from paperloom.llm import mixing
from paperloom.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(11)
    words = [f"w{i}" for i in range(500)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    data = [text(r.randint(20, 120)) + (" you moron idiot" if i % 5 == 0 else "") for i in range(300)]
    clean = [t for i, t in enumerate(data) if i % 5]
    data += clean[:20] * 2
    near = [clean[30].split() for _ in range(10)]
    for k, w in enumerate(near):
        w[0] = f"n{k}"
        data.append(" ".join(w))
    data += [None, "", ""]
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(data)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, corpus, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    rows = [docs.collect()]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, corpus)
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        rows.append(docs.collect())
    toxic = lambda r: r.doc_id < 300 and r.doc_id % 5 == 0
    assert {r.doc_id for r in rows[1]} == {r.doc_id for r in rows[0] if not toxic(r)}
    best = {}
    for r in rows[1]:
        best[r.text or ""] = max(best.get(r.text or "", -1), r.doc_id)
    assert sorted(r.doc_id for r in rows[2]) == sorted(best.values())
    assert {r.doc_id for r in rows[3]} == kept_of_near(rows[2])
    size, taken = collections.Counter(), collections.Counter()
    for r in rows[3]:
        size[r.source] += len((r.text or "").split())
    for r in rows[4]:
        taken[r.source] += len(r.text.split())
        assert r.n_chars == len(r.text)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = mixing.targets([size[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5, 2)
    assert all(abs(taken[s] - t) <= 0.02 * t + 64 for s, t in zip(order, want, strict=True))
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    encoded = lambda t: hashlib.sha256(np.array(lib.encode(t, add_bos=True, add_eos=True), "<u4").tobytes()).hexdigest()
    assert collections.Counter((r.doc_id, r.ids_sha256) for r in rows[5]) == collections.Counter((r.doc_id, encoded(r.text)) for r in rows[4])


def kept_of_near(rows):
    sets = {}
    for r in rows:
        w = (r.text or "").split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    gone, root = set(), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and both >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    gone = {i for i in ids if find(i) != i}
    return set(ids) - gone


def test_stages_use_small_batches(spark, corpus):
    """What a stage hands to a Python worker at a time stays small, in rows and in bytes; a session
    that asks for less keeps that."""
    pipeline = pytest.importorskip("corpus_pipeline")
    keys = [f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes")]

    def sizes(batches):
        for batch in batches:
            yield batch.from_pydict({"n": [batch.num_rows], "size": [batch.nbytes]})

    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for key in keys:
        spark.conf.unset(key)
    for name, stage in pipeline.STAGES[1:]:
        stage(spark, docs.limit(0), corpus)
        assert [int(spark.conf.get(key)) for key in keys] == [1_000, 4 << 20], name
    rows = spark.range(0, 5_000, 1, 1)
    assert max(r.n for r in rows.mapInArrow(sizes, "n long, size long").collect()) <= 1_000
    long = spark.range(0, 300, 1, 1).selectExpr("repeat('x', 100000) AS text")
    assert max(r.size for r in long.mapInArrow(sizes, "n long, size long").collect()) <= 5 << 20
    spark.conf.set(keys[0], "100")
    pipeline.encode(spark, docs, corpus)
    assert spark.conf.get(keys[0]) == "100"
    spark.conf.unset(keys[0])


def test_stages_give_heap_back(spark, corpus, monkeypatch):
    """A stage begins with little heap, not with what work before it grew the heap by."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    at = []

    class Begun(Exception):
        pass

    def begun(spark):
        at.append(heap.totalMemory())
        raise Begun

    monkeypatch.setattr(pipeline, "small_batches", begun)
    for name, stage in pipeline.STAGES:
        spark.range(0, 8, 1, 4).selectExpr("sum(length(repeat('x', cast(400000000 + id AS int))))").collect()
        grown = heap.totalMemory()
        assert grown >= 1 << 30
        with pytest.raises(Begun):
            stage(spark, docs, corpus)
        assert at[-1] <= grown - (500 << 20), name
