"""Operators of the training-data folder against brute force, and on awkward input."""

import collections
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wirebook.llm import byte_bpe, language, mixing, near_dup, neighbours, pii, quality, queries, shards, token_files, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string, _size int, slot int, node string, least string"
AWKWARD = [None, "", " \n\t", "one two", "ü ñ 日本", "x" * 70_000, "word " * 9_000, "same text here for two rows of it", "same text here for two rows of it", "###"]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, ["en", None][i % 2], ["a", None, "b"][i % 3], None, "e", 1, 2, "n", "l") for i, t in enumerate(AWKWARD)]
    rows += [rows[7], (None, None, None, None, None, None, None, None, None, None), (None, "no id at all in this row here", "en", "a", 3, "e", 1, 2, "n", "l")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(tmp_path, name):
    return f"file://{tmp_path}/{name}"


def test_pseudonyms(spark, awkward, empty):
    values = ["a.b7@x.org", "+1 (988) 555-2485", "4041894974608795", "42.144.35.254", "2024-02-29", "12/31/1999", "31.12.1999", "123-45-6789"]
    kept = ["4041894974608796", "999.1.1.1", "02/30/2000", "1850-01-01"]
    docs = spark.createDataFrame([(i, f"see {v}, {v}!") for i, v in enumerate(values + kept)], "doc_id int, text string")
    out = [r["text"] for r in pii.pseudonymise(docs, "k").orderBy("doc_id").collect()]
    for value, text in zip(values, out, strict=False):
        a, b = re.fullmatch(r"see (.*), (.*)!", text).groups()
        assert a == b != value and value not in text
        assert re.sub(r"\d", "9", a).replace("9", "") == re.sub(r"\d", "9", value).replace("9", "") or "@" in value
    assert out[len(values) :] == [f"see {v}, {v}!" for v in kept]
    digits = [int(c) for c in re.search(r"\d{16}", out[2])[0][::-1]]
    assert sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0
    # Permutations: nothing collides.
    four = spark.range(10_000).select(pii.permuted_text(F.lpad(F.col("id").cast("string"), 4, "0"), "k", "ssn").alias("x"))
    assert four.distinct().count() == 10_000
    days = spark.range(72_900).select(pii.permuted_number(F.col("id"), 270, "k", "date").alias("x")).agg(F.countDistinct("x"), F.max("x")).first()
    assert tuple(days) == (72_900, 72_899)
    same = pii.pseudonymise(awkward, "k")
    assert sorted(map(str, same.select("doc_id", "text", "slot").collect())) == sorted(map(str, awkward.select("doc_id", "text", "slot").collect()))
    assert pii.pseudonymise(empty, "k").count() == 0


def test_token_files(spark, awkward, empty, documents, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    extra = spark.createDataFrame([(10**6, "A <|endoftext|> b. Don't, e.g. ... İstanbul É ＡＢ.,"), (10**6 + 1, "<|EndOfText|> ΣΑΣ. x"), (10**6 + 2, "a.́ b́, c")], "doc_id bigint, text string")
    for name, docs in (("a", awkward.select("doc_id", "text")), ("d", documents.select("doc_id", "text").union(extra)), ("e", empty)):
        token_files.write_token_files(docs, fresh(tmp_path, name), path, 2)
        got = token_files.read_token_files(spark, fresh(tmp_path, name)).toPandas()
        texts = collections.Counter((-1 if r["doc_id"] is None else r["doc_id"], np.array([*whole.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for r in docs.collect())
        assert collections.Counter(zip(got["doc_id"].fillna(-1).astype(int), map(bytes, got["ids"]), strict=True)) == texts
        got = got.sort_values("start")
        assert (got["start"].to_numpy() == np.cumsum(got["n_tokens"]) - got["n_tokens"]).all()
        assert got["doc_id"].fillna(-1).is_monotonic_increasing
    one = token_files.read_token_files(spark, fresh(tmp_path, "d"), 10**6).collect()
    assert len(one) == 1 and bytes(one[0]["ids"]) == np.array([*whole.encode(extra.first()["text"], add_special_tokens=False).ids, 2], "<u4").tobytes()


def test_shards(spark, awkward, empty, documents, tmp_path):
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 8
    hot = documents.unionByName(documents.limit(1).crossJoin(spark.range(100)).withColumn("doc_id", F.col("id") + 10**6).drop("id"))
    for name, docs, n in (("d", documents, 24), ("h", hot, 7), ("a", awkward, 3)):
        out = shards.write_shards(docs, fresh(tmp_path, name), n, size, ["text"], ["doc_id"])
        got = out.withColumn("_s", size).select("shard", "slot", "_s", "doc_id").toPandas()
        assert len(got) == docs.count() and out.columns == [c for c in docs.columns if c != "slot"] + ["shard", "slot"]
        sums = got.groupby("shard")["_s"].sum().reindex(range(n), fill_value=0)
        assert (sums - got["_s"].sum() / n).abs().max() <= got["_s"].max()
        for _, own in got.groupby("shard"):
            assert sorted(own["slot"]) == list(range(len(own)))
    assert shards.write_shards(empty, fresh(tmp_path, "e"), 3, size, ["text"], ["doc_id"]).count() == 0


def filled(sizes, weights, budget, most):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    stopped, left = {}, budget * sum(sizes.values())
    while len(stopped) < len(names):
        free = sum(w for s, w in weight.items() if s not in stopped)
        above = [s for s in names if s not in stopped and left * weight[s] / free > most * sizes[s] * (1 + 1e-12)]
        if not above:
            break
        for s in above:
            stopped[s] = most * sizes[s]
        left = budget * sum(sizes.values()) - sum(stopped.values())
    return {s: stopped.get(s, left * weight[s] / max(1, sum(w for x, w in weight.items() if x not in stopped))) for s in names}


def test_mixing(spark, awkward, empty, documents):
    for docs in (documents, awkward):
        got = mixing.mix(docs, [3, 1, 2], 1.5, 2.0).toPandas()
        sizes = collections.Counter()
        for r in docs.collect():
            sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        expected = filled(sizes, [3, 1, 2], 1.5, 2.0)
        assert len(got) == docs.count()
        for r in got.itertuples():
            source = r.source if isinstance(r.source, str) else None
            assert r.source_size == sizes[source] and math.isclose(r.target, expected[source], rel_tol=1e-9, abs_tol=1e-9)
            rate = r.target / r.source_size if r.source_size else 0
            assert math.floor(rate) <= r.copies <= math.ceil(rate) <= 2
        mixed = mixing.mix(docs, [3, 1, 2], 1.5, 2.0)
        assert mixing.emit(mixed, docs.columns).count() == got["copies"].sum()
        assert sorted(map(str, mixed.select("doc_id", "copies").collect())) == sorted(map(str, mixing.mix(docs, [3, 1, 2], 1.5, 2.0).select("doc_id", "copies").collect()))
    assert mixing.mix(empty, [3, 1, 2], 1.5, 2.0).count() == 0


def test_quality(spark, awkward, empty, documents, sf_dir):
    for docs in (documents, awkward):
        for r in quality.measures(docs).select("*").join(docs.select("doc_id", "text"), "doc_id").collect():
            text = r["text"] or ""
            w = re.findall(r"[^\x20\x09-\x0D]+", text)
            counts = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
            covered = {k for i in range(len(w) - 7) if counts[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
            lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
            assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
    cases = [(0, 10), (0, 5000), (3, 1000), (12, 3000), (900, 100), (40, 50_000)]
    got = spark.createDataFrame(cases, "k bigint, n bigint").select(quality.binomial_tail(F.col("k"), F.col("n"), 0.004).alias("p")).collect()
    for (k, n), r in zip(cases, got, strict=True):
        exact = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(0.004) + (n - j) * math.log(0.996)) for j in range(k + 1)) if k <= n * 0.004 else 1
        assert math.isclose(r["p"], exact, rel_tol=1e-6)
    # 5000 good documents without symbols certify cutoffs; a stratum with few labels certifies none.
    text = " ".join(f"w{i}" for i in range(30))
    many = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 7, text + " " + "#" * 60).otherwise(text).alias("text"), F.when(F.col("id") < 5900, "en").otherwise("de").alias("lang"))
    labels = many.select("doc_id", F.when(F.col("doc_id") % 100 == 7, 0).otherwise(1).alias("quality"))
    judged = quality.judge(many, labels).toPandas()
    dirty = judged["n_symbols"] > 0
    assert not judged[dirty & (judged["stratum"] == "en")]["kept"].any() and judged[~dirty]["kept"].all() and judged[judged["stratum"] == "de"]["kept"].all()
    nothing = labels.limit(0)
    assert quality.judge(awkward, nothing).count() == awkward.count() and quality.judge(empty, nothing).count() == 0


def test_byte_bpe(spark, awkward, empty, documents, monkeypatch):
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    bpe = byte_bpe.coder(path, pattern)
    draw = random.Random(1)
    for leaf in (1, 3, 7, 20):
        monkeypatch.setattr(byte_bpe, "LEAF", leaf)
        monkeypatch.setattr(byte_bpe, "WINDOW", 2)
        for _ in range(500):
            text = "".join(draw.choice("abcE's't12é ü日\n\t   　\xa0!?#.-\x1c\x85 the ing 're") for _ in range(draw.randint(0, 60)))
            assert list(bpe.encode(text)) == bpe.coder.encode_ordinary(text)
            assert bpe.decode(bpe.encode(text)).decode() == text
    monkeypatch.undo()
    long = "a b" + " " * 1_200_000 + "c" + "\n" * 120_000
    assert bpe.decode(bpe.encode(long)).decode() == long
    for docs in (documents, awkward):
        for r in byte_bpe.encode_documents(docs, path, pattern).join(docs.select("doc_id", "text"), "doc_id").collect():
            assert np.frombuffer(r["ids"], "<u4").tolist() == bpe.coder.encode_ordinary(r["text"] or "")
            assert bytes(r["decoded"]).decode() == (r["text"] or "")
    assert byte_bpe.encode_documents(empty, path, pattern).count() == 0


def test_toxicity(spark, awkward, empty):
    draw = random.Random(2)
    plain, bad = [f"w{draw.choice('abcdefgh')}{draw.choice('klmnop')}or" for _ in range(40)], ["wretch", "villain", "zounds", "quagmire"]
    rows = []
    for i in range(900):
        words = [draw.choice(plain) for _ in range(40)]
        if i % 6 == 0:
            for _ in range(4):
                words.insert(draw.randrange(40), draw.choice(bad))
        rows.append((i, " ".join(words), int(i % 6 == 0)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.fit(docs.filter("doc_id < 600"))
    got = docs.filter("doc_id >= 600").select("toxic", toxicity.score("text", model).alias("score")).toPandas()
    assert ((got["score"] >= 0.7).astype(int) == got["toxic"]).mean() > 0.97
    scores = awkward.select(toxicity.score("text", model).alias("s")).toPandas()["s"]
    assert len(scores) == awkward.count() and scores.between(0, 1).all()
    labels = docs.select("doc_id", "toxic")
    learned = toxicity.learned_from(docs.withColumns({"toxic": F.lit(9), "_id": F.lit(1)}), labels.union(labels).union(labels.selectExpr("null", "1")).union(labels.selectExpr("doc_id", "7")))
    assert learned.columns == ["doc_id", "text", "toxic"] and sorted(learned.collect()) == sorted(docs.collect())
    assert toxicity.learned_from(docs, labels.limit(0)).count() == 0 == toxicity.learned_from(empty, labels).count()
    none = toxicity.fit(empty.withColumn("toxic", F.lit(1)))
    assert awkward.select(toxicity.score("text", none).alias("s")).filter("s < 0.5").count() == awkward.count()


def test_toxicity_learns_from_a_bounded_sample(spark, monkeypatch):
    """A table far above FIT_ROWS gives about that many rows, hot ids and all, and moves no other text."""
    monkeypatch.setattr(toxicity, "FIT_ROWS", {1: 300, 0: 600})
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("toxic"))
    learned = toxicity.learned_from(docs, labels.union(labels.filter("doc_id < 50")))
    counts = {r["toxic"]: r["count"] for r in learned.groupBy("toxic").count().collect()}
    assert 220 < counts[1] < 380 and 500 < counts[0] < 700
    assert learned.count() == learned.distinct().count()


def test_dictionary_sample_with_a_hot_id(spark):
    """Rows of one id give no more pieces than one document."""
    rows = spark.range(3_000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("some words "), F.col("id") % 50).alias("text"))
    seen = []

    def train(size, samples):
        seen.append(len(samples))
        raise token_files.zstandard.ZstdError

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(token_files.zstandard, "train_dictionary", train)
        content = token_files.train_dictionary(rows, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"), 2, 2)
    assert seen[0] <= token_files.SAMPLE_DOCS and len(content) == 1 << 15


def test_language(spark, awkward, empty, documents):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = language.fit(documents.filter(~held))
    got = documents.filter(held).select("lang", "n_chars", language.predict("text", model).alias("p")).select("*", "p.*").toPandas()
    assert (got[got["n_chars"] > 100]["lang"] == got[got["n_chars"] > 100]["lang_pred"]).mean() > 0.9
    told = {r["text"]: r["p"] for r in awkward.select("text", language.predict("text", model).alias("p")).collect()}
    assert all(told[t]["lang_pred"] == "und" for t in (None, "", " \n\t", "###")) and told["x" * 70_000]["lang_pred"] != "und"
    assert all(0 <= p["score"] <= 1 for p in told.values())
    none = language.fit(empty)
    assert {r["p"]["lang_pred"] for r in documents.select(language.predict("text", none).alias("p")).collect()} == {"und"}


def bag(text):
    words = [w for w in (re.sub(r"^\W+|\W+$", "", w) for w in (text or "").lower().split()) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_duplicates(spark, awkward, empty, documents):
    draw = random.Random(3)
    base = [" ".join(f"v{draw.randrange(5000)}" for _ in range(120)) for _ in range(30)]
    rows = []
    for k, text in enumerate(base):
        rows.append(text)
        for _ in range(k % 5):
            words = text.split()
            words[draw.randrange(120)] = "changed"
            rows.append(" ".join(words))
        rows.append(text)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(docs).collect()}
    sets, expected = [bag(t) for t in rows], list(range(len(rows)))
    for _ in range(3):
        for i in range(len(rows)):
            for j in range(i):
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    expected[i] = expected[j] = min(expected[i], expected[j])
    assert [got[i] for i in range(len(rows))] == expected
    assert near_dup.one_of_each(docs).count() == len(set(expected))
    odd = near_dup.near_duplicates(awkward).collect()
    assert len(odd) == awkward.count()
    assert {r["class_id"] for r in odd if r["doc_id"] in (7, 8)} == {7}
    kept = near_dup.one_of_each(awkward)
    assert kept.columns == awkward.columns and kept.filter("text like 'same text%'").count() == 1 and kept.filter("text is null").count() == 2
    assert near_dup.near_duplicates(empty).count() == 0


def test_neighbours(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in table.collect()}
    odd = spark.createDataFrame([(10_000, None), (10_100, [0.0] * 64), (10_200, [float("nan")] * 64), (10_300, [1.0]), (None, [1.0] * 64), *[(20_001 + i, vectors[0].tolist()) for i in range(30)]], "vec_id bigint, embedding array<float>")
    got = neighbours.nearest(table.union(odd), "vec_id % 100 = 0", 10).toPandas()
    all_vectors = vectors | {20_001 + i: vectors[0].astype(np.float32).astype(float) for i in range(30)}
    hits = total = 0
    for query, own in got.groupby("query_id"):
        own = own.sort_values("rank")
        exact = sorted((float(np.sqrt(((v - vectors[query]) ** 2).sum())), i) for i, v in all_vectors.items() if i != query)[:10]
        assert own["rank"].tolist() == list(range(1, 11))
        assert all(math.isclose(s, np.sqrt(((all_vectors[i] - vectors[query]) ** 2).sum()), rel_tol=1e-12, abs_tol=1e-12) for i, s in zip(own["vec_id"], own["score"], strict=True))
        assert own["score"].is_monotonic_increasing
        hits, total = hits + len({i for _, i in exact} & set(own["vec_id"])), total + 10
    assert set(got["query_id"]) == {i for i in vectors if i % 100 == 0} and hits / total >= 0.9
    assert got[got["query_id"] == 0]["vec_id"].tolist() == list(range(20_001, 20_011))
    assert neighbours.nearest(table.limit(0), "vec_id % 100 = 0", 10).count() == 0
    assert neighbours.nearest(table.limit(3), "true", 10).count() == 6


def test_neighbours_of_many_vectors(spark, sf_dir):
    """So many that a query looks at a small part of them: candidates grow with the table, so recall stays."""
    given = np.array([r["embedding"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("embedding").collect()], float)
    draw = np.random.default_rng(1)
    vectors = given[draw.integers(0, len(given), 60_000)] + draw.normal(0, given.std() / 2, (60_000, given.shape[1]))
    table = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "vec_id bigint, embedding array<double>").repartition(8)
    got = neighbours.nearest(table, "vec_id % 1000 = 0", 10).toPandas()
    hits = 0
    for query, own in got.groupby("query_id"):
        distance = ((vectors - vectors[query]) ** 2).sum(axis=1)
        distance[query] = np.inf
        hits += len(set(np.argsort(distance, kind="stable")[:10].tolist()) & set(own["vec_id"]))
    assert len(got) == 600 and hits / 600 >= 0.9


def test_leaves_that_a_query_needs():
    draw = np.random.default_rng(2)
    points = draw.normal(size=(500, 6))
    forest = [neighbours.grow(points, seed) for seed in range(3)]
    sizes = collections.Counter((t, leaf) for t, tree in enumerate(forest) for leaf in tree.leaves(points).tolist())
    near = points[:20]
    for query in points[:5]:
        for vector, wanted in zip(near, neighbours.needed(forest, sizes, query, near), strict=True):
            place = [int(t.leaves(vector[None])[0]) for t in forest]
            assert any(place[t] == leaf for t, leaf in neighbours.probes(forest, sizes, query, wanted))
            assert not any(place[t] == leaf for t, leaf in neighbours.probes(forest, sizes, query, wanted)[:-1])


def test_sql_of_the_mix(spark, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    expected = con.execute(queries.SQL["op4_source_mix"]).df()
    got = queries.QUERIES["op4_source_mix"](spark, sf_dir).toPandas()[expected.columns.tolist()]
    key = lambda df: sorted(map(tuple, df.to_numpy().tolist()))
    assert key(got) == key(expected)


def test_digests(spark, sf_dir, documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    for r in queries.QUERIES["op3_sampled_shards"](spark, sf_dir).collect():
        raw = texts[r["doc_id"]].encode()
        assert r["text_crc32"] == zlib.crc32(raw) and r["size"] == len(raw) + 8


def test_pipeline(spark, sf_dir, documents):
    """Each stage against what its operator does, over all that the stage before kept."""
    model = language.fit(documents)
    known = {r["doc_id"] for r in documents.select("doc_id", language.predict("text", model).alias("p")).filter("p.lang_pred != 'und'").collect()}
    rows = [r for r in documents.collect() if r["doc_id"] in known]
    classes = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(documents.filter(F.col("doc_id").isin(list(known)))).collect()}
    kept = documents.filter(F.col("doc_id").isin([r["doc_id"] for r in rows if classes[r["doc_id"]] == r["doc_id"]]))
    private = pii.pseudonymise(kept, queries.KEY).drop("n_values")
    taken = {r["doc_id"]: (r["copies"], r["text"]) for r in mixing.mix(private, queries.WEIGHTS, queries.BUDGET, queries.MOST).collect()}
    got = collections.Counter((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, sf_dir).collect())
    import hashlib

    bpe = byte_bpe.coder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    expected = {(d, len(bpe.coder.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()): n for d, (n, t) in taken.items() if n}
    assert got == collections.Counter(expected)


@pytest.mark.parametrize("name", ["awkward", "empty"])
def test_stages_on_awkward_input(spark, sf_dir, request, name):
    docs = request.getfixturevalue(name).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()
