"""Memory of Python workers: rows of a batch, and words that the encoder keeps."""

import public_tokenizers
import pyarrow as pa

from tablewright.llm import common, encoding, packing


def test_texts_reach_python_in_small_batches(spark, monkeypatch):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    before = spark.conf.get(common.BATCH)
    rows = spark.range(0, 3000, 1, 1).mapInArrow(sizes, "n long")
    seen = [r["n"] for r in common.stored_in_batches(rows, "sizes", packing.BATCH_ROWS).collect()]
    assert sum(seen) == 3000 and max(seen) <= packing.BATCH_ROWS
    assert spark.conf.get(common.BATCH) == before
    used = []
    monkeypatch.setattr(common, "stored_in_batches", lambda df, label, n: used.append((label, n)) or common.stored(df, label))
    assert packing.packed_documents(spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")).count() == 2
    assert used == [("pieces", packing.BATCH_ROWS)]


def test_words_that_leave_the_cache_are_encoded_alike():
    coder = encoding.Encoder(public_tokenizers.path("byte_bpe_50k.json"), "spaces")
    for at in range(0, 1_000_000, 100_000):
        coder.encode([" ".join(map(str, range(at, at + 100_000)))])
        assert len(coder.cache) + len(coder.old) <= 500_000
    text = "7 42 999999 word7"
    assert coder.encode([text])[0].tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids
