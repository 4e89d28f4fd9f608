"""Cutting of texts in pieces of bounded size."""

import pyarrow as pa

from skeinlake.functions import chunking
from skeinlake.operators import curation


def test_what_is_cut_is_handed_on_in_bounded_pieces(spark, monkeypatch):
    texts = {i: f"word{i}. " * 3000 for i in range(6)} | {6: "", 7: None}
    want = {(i, k): x for i, t in texts.items() if t is not None for k, x in enumerate(chunking.chunks(t))}
    got = curation.chunked(spark.createDataFrame(list(texts.items()), "id long, body string").coalesce(1)).collect()
    assert {(r["id"], r["seq"]): (r["pos"], r["chunk"]) for r in got} == want

    monkeypatch.setattr(curation, "HELD", 20000)
    kinds = pa.schema([("id", pa.int64()), ("seq", pa.int64()), ("pos", pa.int64()), ("chunk", pa.string())])
    batch = pa.RecordBatch.from_arrays([pa.array(list(texts)), pa.array(list(texts.values()))], ["id", "body"])
    some = [p.to_pylist() for p in curation.pieces(batch, chunking.chunks, kinds)]
    assert {(r["id"], r["seq"]): (r["pos"], r["chunk"]) for p in some for r in p} == want
    assert len(some) > 6 and max(sum(len(r["chunk"]) for r in p) for p in some) < 20000 + chunking.CHUNK_CHARS
