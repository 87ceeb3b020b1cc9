"""What a worker holds at once: an executor's memory is shared by the JVM and all its workers."""

import random
import tracemalloc

import pyarrow as pa

from cellsift.llm import ngram_join
from cellsift.llm.common import filtered


def test_a_filter_sees_few_rows_at_once(spark):
    df = spark.range(0, 3000, 1, 1).selectExpr("id", "cast(id as string) as text")
    assert filtered(df, {"text": "string"}, lambda text: [len(text) <= 256] * len(text)).count() == 3000


def test_a_chunk_of_the_join_is_small(monkeypatch):
    class Context:
        get = staticmethod(lambda: Context)
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(ngram_join, "TaskContext", Context)
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(50_000)}" for _ in range(700)) for _ in range(3200)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    tracemalloc.start()
    sent = sum(b.num_rows for b in ngram_join.send(5, 12)(iter([rows])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sent and peak < 100e6, peak
