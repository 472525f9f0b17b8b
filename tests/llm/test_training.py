"""What the language model is trained on, and its copies' average."""

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from shelfwright.llm import lm


def test_every_position_is_trained_on_once(spark, monkeypatch):
    docs = spark.createDataFrame([(" ".join(f"w{(i * j) % 97}" for j in range(40 * i)),) for i in range(60)], "text string").repartition(3)
    vocab = lm.vocabulary(lm.count(docs))
    met, plain = [], lm._averaged

    def seen(copies, *more):
        copies = copies.cache()
        if len(more) > 1 and isinstance(more[1], type(F.lit(0))) and len(more) == 2:
            met.append(copies.where("block = 0").agg(F.sum("pairs")).first()[0])
        return plain(copies, *more)

    monkeypatch.setattr(lm, "_averaged", seen)
    lm.train(docs, vocab)
    assert len(met) == lm.ROUNDS and sum(met) == vocab.total == sum(40 * i + 1 for i in range(60))


def test_copies_are_averaged_by_what_they_met(spark):
    one = lambda block, task, met, x: (block, task, sum(met), np.array(met, np.int64).tobytes(), np.array(x, np.float32).tobytes())
    rows = [one(0, 0, [1, 0, 0], [[1, 1], [5, 5], [7, -np.inf]]), one(0, 1, [3, 2, 0], [[5, 5], [9, 9], [7, -np.inf]])]
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*[(r[0], 0, *r[2:]) for r in rows]), lm._COPY)], schema=lm._COPY)
    (out,) = lm._average(iter([batch]), 2)
    r = out.to_pylist()[0]
    assert r["pairs"] == 6 and np.frombuffer(r["met"], np.int64).tolist() == [4, 2, 0]
    assert np.frombuffer(r["values"], np.float32).reshape(-1, 2).tolist() == [[4, 4], [9, 9], [7, -np.inf]]
