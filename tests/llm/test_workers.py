"""What a worker keeps: the things of one step, and only those."""

import pickle
import weakref

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from searchloom.llm import hashing, language_id, near_dup
from searchloom.llm import tokenizer as tok

VOCABULARY = tok.resolve("byte_bpe_multi_50k.tiktoken")


class Direct:
    """A table whose tasks run here."""

    def mapInArrow(self, task, schema):  # noqa: N802
        rows = pa.table({"doc_id": [1, 2], "text": ["a b c d e f", None]})
        return pa.Table.from_batches(task(iter(rows.to_batches()))).to_pylist()


def test_another_step_lets_go():
    pieces = weakref.ref(language_id.pieces(VOCABULARY))
    assert pieces() is language_id.pieces(VOCABULARY)  # kept from task to task
    encoder = weakref.ref(tok.encoder("word_bpe_49k.json"))
    assert pieces() is None
    assert encoder() is tok.encoder("word_bpe_49k.json")
    assert [r["n_shingles"] for r in near_dup._features(Direct(), 5, 35, 5)] == [2, 0]
    assert encoder() is None
    assert len(hashing.powers(70_000)[0]) == 70_001
    pieces = weakref.ref(language_id.pieces(VOCABULARY))
    assert [len(r["shingles"]) for r in near_dup._sets(Direct(), 5)] == [2, 0]
    assert pieces() is None
    assert len(hashing.powers(1)[0]) == 1 << 16  # the long tables went


def _held(batches):
    """Whether this worker has models or vocabularies, after a task."""
    import gc
    import os

    import pyarrow as pa

    for _ in batches:
        kinds = [type(x).__name__ for x in gc.get_objects() if type(x).__module__ == "searchloom.llm.language_id"]
        yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "models": [kinds.count("Model")], "tables": [kinds.count("Pieces")]})


def test_workers_of_a_session(spark):
    """One model in a worker, however many tasks and calls it has had; none once it has done another step's."""
    n = language_id.pieces(VOCABULARY).n
    p = np.full((n + 1, 2), 1 / n)
    p[-1] = 0
    texts = spark.range(0, 4000, 1, 16).select("id", F.concat(F.lit("word "), F.col("id")).alias("text"))
    for _ in range(2):
        guess = language_id.predictor(spark, pickle.loads(pickle.dumps(language_id.Model(["a", "b"], p, VOCABULARY))))
        assert {r.g.lang_pred for r in texts.select(guess("text").alias("g")).collect()} == {"a"}
    probe = lambda: spark.range(0, 64, 1, 64).mapInArrow(_held, "pid long, models long, tables long").collect()
    assert max(r.models for r in probe()) == 1
    for _ in range(3):  # every worker is to have its turn
        assert near_dup._features(texts, 5, 35, 5).count() == 4000
    assert {(r.models, r.tables) for r in probe()} == {(0, 0)}
