import pyarrow as pa
from pyspark.sql import functions as F

from tesserae.llm import shared


def test_slices_keep_every_row_and_bound_the_text():
    texts = ["x" * (i % 7) for i in range(50)] + [None, "y" * 100, "", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["i", "t"])
    parts = list(shared.slices(iter([batch]), 1, 20))
    assert [r for p in parts for r in p.column(1).to_pylist()] == texts and len(parts) > 5
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 20 for p in parts)


def test_sieve_lets_every_key_through(spark):
    keys = spark.range(0, 5000, 7).toDF("k")
    among = shared.sieve(keys, "k")
    got = spark.range(-200, 5200).withColumn("in", among(F.col("id"))).collect()
    assert all(r["in"] for r in got if 0 <= r.id < 5000 and r.id % 7 == 0)
    assert sum(r["in"] for r in got) < 5000 / 7 * 1.2
    none = shared.sieve(keys.limit(0), "k")
    assert not any(r[0] for r in spark.range(50).select(none(F.col("id"))).collect())
