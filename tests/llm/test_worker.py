"""What Python workers keep from one operator's tasks to the next."""

from __future__ import annotations

import gc
import os
import weakref

import pyarrow as pa

import corpus_pipeline
from foliary.llm import neardup, tokenfiles, worker
from foliary.llm.scratch import save
from tests.conftest import SF


def encoders(batches):
    """The encoders alive in the worker, by its process."""
    for _ in batches:
        pass
    gc.collect()
    yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([sum(type(x).__name__ == "Encoder" for x in gc.get_objects())])], ["pid", "n"])


def test_encoders_go_when_another_task_begins(spark):
    import public_tokenizers

    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(16)
    assert tokenfiles.write(docs, public_tokenizers.path("byte_bpe_50k.json"), 2).parts.count()
    alive = lambda f: [r["n"] for r in spark.range(0, 32, 1, 16).mapInArrow(f, "pid long, n long").collect()]
    assert any(alive(encoders))  # they stay from task to task
    assert not any(alive(worker.task(encoders)))


def test_every_stage_gives_back(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, plain = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *a, **b: seen.append(f) or plain(self, f, *a, **b))
    for name, stage in corpus_pipeline.STAGES:
        seen.clear()
        docs = save(stage(spark, docs, SF), "test-worker")
        assert all(getattr(f, "func", None) is worker._task for f in seen) and (seen or name == "mixing")


def test_kept_until_another_owner():
    class Thing:
        pass

    made = worker.keep("a", "x", Thing)
    assert worker.keep("a", "x", Thing) is made
    assert list(worker.task(iter, "a")([1, 2])) == [1, 2] and worker.keep("a", "x", Thing) is made
    known = weakref.ref(made)
    del made
    assert list(worker.task(iter)([3])) == [3]
    gc.collect()
    assert known() is None
    worker.trim()


def test_full_sets_in_parts(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(map(tuple, neardup.find(docs).collect()))
    monkeypatch.setattr(neardup, "SETS", 7)
    assert sorted(map(tuple, neardup.find(docs).collect())) == want


def test_encoder_is_small_and_takes_any_text(monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    e = tokenfiles.Encoder(path)
    assert e.keys.nbytes + e.slot_of.nbytes <= 32 << 20
    monkeypatch.setattr(tokenfiles, "CACHE_MOST", 4)  # a text has more distinct pieces than the table has slots
    e = tokenfiles.Encoder(path)
    texts = [" ".join(f"w{i} x" for i in range(300)), "a few words", " ".join(f"y{i}" for i in range(50)), ""]
    for t in texts:
        assert e.encode([t])[0].tolist() == e.whole([t])[0]
    assert e.known <= 64 and len(e.keys) <= 512
