import numpy as np
import pyarrow as pa

from wirebook.llm import near_dup


def test_every_common_shingle_counts_over_all_documents(spark, monkeypatch):
    """no shingle above RARE is missed, whatever ids its documents have."""
    monkeypatch.setattr(near_dup, "LOOKED_AT", 20, raising=False)  # before, a sample of so many documents decided
    texts = [f"alpha beta gamma delta group{n % 90} word{n} tail{n} end{n}" for n in range(900)] + [None, ""]
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id BIGINT, text STRING")
    weights = near_dup.common_weights(docs, "text")
    hashes, ends = near_dup.shingles(pa.array([t or "" for t in texts]))
    found, df = np.unique(np.concatenate([np.unique(hashes[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]), return_counts=True)
    total = 901
    common = df > near_dup.RARE * total
    assert common.sum() == 90
    assert np.array_equal(weights.shingles, found[common])
    expected = np.maximum(near_dup.COMMON_WEIGHT, np.log(total / df[common]) / np.log(1 / near_dup.RARE))
    assert np.allclose(weights.weights, expected)
