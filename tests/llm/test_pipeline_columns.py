"""The pipeline's stages on columns that share names with what operators add, and on awkward rows."""

import collections

import corpus_pipeline

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_values int, copies int, size int, target double, source_size int, document string, carried string, lang_pred string, _key int"
OWN = (777, 777, -5, -1.0, 3, "d", "c", "xx", 9)




def rows():
    texts = ["mail a.b@x.org now, " + "some common words of a text " * 9, "quite another text with other words in it " * 8, None, "", "mail a.b@x.org now, " + "some common words of a text " * 9]
    return [(i, t, "en", ["a", None][i % 2], None if t is None else len(t), *OWN) for i, t in enumerate(texts)] + [(None,) * 14] + [(7, "word " * 250_000, "en", "a", 1_250_000, *OWN)] * 2


def test_stages_keep_columns(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    before = collections.Counter(map(tuple, docs.drop("text", "n_chars").collect()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, None)
        assert out.columns == docs.columns, name
        got = collections.Counter(map(tuple, out.drop("text", "n_chars").collect()))
        assert set(got) <= set(before), name
        assert stage(spark, docs.limit(0), None).count() == 0, name
        if name == "pii":
            assert got == before
            assert not any("a.b@x.org" in (r.text or "") for r in out.collect())
            assert {r.n_chars for r in out.collect() if r.doc_id == 7} == {1_250_000}
        if name in ("language", "near_duplicates"):
            kept = collections.Counter(r.doc_id for r in out.collect())
            assert kept[1] == 1 and kept[0] == 1
            assert kept[4] == (1 if name == "language" else 0) and kept[7] == (2 if name == "language" else 1)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, None)
    assert last.count() == docs.count() and last.where("doc_id = 7").select("n_tokens").distinct().count() == 1
