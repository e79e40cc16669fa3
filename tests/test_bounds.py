"""What Python workers and micro-batches hold at once does not follow the size of a table."""
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from packetloom.operators import pdf, structure
from packetloom.operators.forest import IsolationForest
from packetloom.plans.registry import QUERIES, query
from packetloom.session import BATCH_BYTES
from packetloom.sources import derived as dv

LIMIT = 4 << 20


@pytest.fixture
def plain(spark):
    """A session as others build it, without settings of this library."""
    own = spark.newSession()
    for key in (BATCH_BYTES[0], "spark.sql.execution.arrow.maxRecordsPerBatch"):
        own.conf.unset(key)
    return own


def test_batches_of_named_queries_are_bounded_by_bytes(spark, plain):
    def sizes(session, sf_dir):
        def measure(batches):
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"size": [batch.nbytes]})
        files = session.range(0, 1500, 1, 1).select(F.expr("cast(repeat('a', 10000) as binary)").alias("payload"))
        return files.mapInArrow(measure, "size long")

    query("_batch_sizes")(sizes)
    try:
        assert max(r.size for r in sizes(plain, "").collect()) > 2 * LIMIT
        found = [r.size for r in QUERIES["_batch_sizes"](plain, "").collect()]
        assert sum(found) >= 1500 * 10_000 and max(found) < 2 * LIMIT
        # A bound that the session brings along is kept.
        plain.conf.set(BATCH_BYTES[0], "1m")
        assert max(r.size for r in QUERIES["_batch_sizes"](plain, "").collect()) < LIMIT // 2
    finally:
        del QUERIES["_batch_sizes"]


def test_forest_scores_few_rows_at_once():
    rng = np.random.default_rng(1)
    trees, nodes = 200, 511
    feature = np.full((trees, nodes), -1, dtype=np.int64)
    feature[:, :255] = rng.integers(0, 15, (trees, 255))
    forest = IsolationForest(feature, rng.random((trees, nodes)), rng.random((trees, nodes)) * 8, 256)
    data = rng.random((10_000, 15))
    tracemalloc.start()
    scores = forest.anomaly(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20
    one_by_one = np.concatenate([forest.anomaly(data[i:i + 1]) for i in (0, 255, 256, 9_999)])
    assert np.allclose(scores[[0, 255, 256, 9_999]], one_by_one)
    assert len(forest.anomaly(data[:0])) == 0


def test_containers_and_pdf_files_are_read_by_one_worker(spark):
    files = spark.createDataFrame([(bytearray(b"PK\x03\x04"),), (bytearray(b"%PDF-1.4"),), (None,)], "payload binary")
    read = files.select(structure.container_entries(F.col("payload")).alias("e"), pdf.pdf_parts(F.col("payload")).alias("p"))
    assert read._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [(r.e, r.p and r.p.text) for r in read.collect()] == [(None, None), (None, ""), (None, None)]


def test_many_small_files_are_few_micro_batches(spark, tmp_path):
    spark.range(0, 90, 1, 9).selectExpr("id AS event_id").write.parquet(str(tmp_path / "events.parquet"))
    seen = []
    stream = dv.table_stream(spark, str(tmp_path), "events").writeStream.option("checkpointLocation", str(tmp_path / "state"))
    stream.trigger(availableNow=True).foreachBatch(lambda batch, _: seen.append(batch.count())).start().awaitTermination()
    assert seen == [90]


def test_files_of_short_lines_leave_in_small_frames(monkeypatch):
    class Documents:
        def select(self, *_):
            return self

        def mapInPandas(self, pack, schema):
            return pack

    monkeypatch.setattr(dv, "texts", lambda *_: Documents())
    docs = pd.DataFrame({"doc_id": range(60), "text": [None, "", *["a\n" * 2000] * 58]})
    frames = list(dv.packed_pdf_files(None, "")(iter([docs, docs[:0]])))
    sizes = [frame["payload"].map(len).sum() for frame in frames]
    assert sum(sizes) > 3 * LIMIT and max(sizes) < 2 * LIMIT
    assert [i for frame in frames for i in frame["doc_id"]] == list(range(60))
    assert b"".join(pdf.packed_objects(pdf.written_objects(frames[0]["payload"][2])).values()).count(b" 0 R") == 2001 + 2


def test_functions_of_columns_get_few_bytes_at_once(spark, plain):
    @F.arrow_udf("long")
    def together(payload: pa.Array) -> pa.Array:
        return pa.array([payload.nbytes] * len(payload), pa.int64())

    def sizes(session, sf_dir):
        return session.range(0, 1500, 1, 1).select(together(F.expr("cast(repeat('a', 10000 + id % 2) as binary)")).alias("size"))

    query("_column_sizes")(sizes)
    try:
        assert max(r.size for r in sizes(plain, "").collect()) > 2 * LIMIT
        assert max(r.size for r in QUERIES["_column_sizes"](plain, "").collect()) < 2 * LIMIT
    finally:
        del QUERIES["_column_sizes"]
