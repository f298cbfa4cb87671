"""Source divergence, hard negatives and packing against brute force, and on awkward input."""

import collections
import itertools
import math
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wirebook.llm import divergence, hard_negatives, packing, queries

DOCS = "doc_id bigint, text string, lang string, source string, term string, `rank` int, at int, ids string, length int, key string"


@pytest.fixture(scope="module")
def awkward(spark):
    texts = [None, "", " \n\t", "one two", "ü ñ 日本 Éa", "x" * 70_000, "word " * 9_000, "same text", "same text", "###", "A<|endoftext|>  <|endoftext|> b", "Word WORD wOrd's"]
    rows = [(i, t, ["en", None, ""][i % 3], ["a", None, "b"][i % 2], "t", 1, 2, "i", 4, "k") for i, t in enumerate(texts)]
    rows += [rows[7], (None,) * 10, (None, "no id at all", "en", "a", "t", 1, 2, "i", 4, "k")]
    return spark.createDataFrame(rows, DOCS)


# Source divergence

def audited(docs, least, top):
    """The audit by its definition, over all terms and pairs."""
    words = [((r["lang"] or ""), (r["source"] or ""), [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r["text"] or "")]) for r in docs]
    out = set()
    for lang in {lang for lang, _, _ in words}:
        df = collections.Counter(t for own, _, ws in words if own == lang for t in set(ws))
        kept = {t for t, n in df.items() if n >= least}
        counts = {s: collections.Counter(t for own, source, ws in words if (own, source) == (lang, s) for t in ws if t in kept) for s in {s for own, s, _ in words if own == lang}}
        whole = sum(counts.values(), collections.Counter())
        p = {s: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept} for s, c in counts.items()}
        q = {t: 1 + 10**9 * (whole[t] + 5) // (sum(whole.values()) + 5 * len(kept)) for t in kept}
        for s in counts:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in counts if o != s))
            out |= {(lang, s, "pair", o.decode(), -v, k) for k, (v, o) in enumerate(pairs, 1)}
            above = sorted((q[t] - p[s][t], t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t])[:top]
            out |= {(lang, s, "term", t.decode(), -v, k) for k, (v, t) in enumerate(above, 1)}
    return out


def rows_of(frame):
    got = [tuple(r) for r in frame.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_divergence(spark, awkward, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for docs, least, top in ((documents, 5, 7), (awkward, 1, 50), (awkward, 2, 1), (awkward, 99, 3)):
        assert rows_of(divergence.audit(docs, least_docs=least, top_terms=top)) == audited(docs.collect(), least, top)
    assert divergence.audit(awkward.limit(0)).count() == 0
    assert divergence.audit(documents).columns == ["lang", "source", "part", "item", "value", "rank"]


def test_divergence_over_spilled_runs_and_tiles(spark):
    """Small blocks, slices, shards and tiles give the same rows, also for many sources and one that holds a third."""
    random.seed(3)
    words = ["alpha", "beta", "Gamma", "ünder", "日本", "x", "yy", "zzz"]
    rows = [(i, " ".join(random.choices(words, k=random.randint(0, 40))), "en" if i % 5 else "de", "hot" if i % 3 == 0 else f"s{i % 11}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string, source string").repartition(9)
    expected = audited(docs.collect(), 3, 50)
    limits = divergence.Limits(text_bytes=60, block_bytes=2000, slice=3, merged=10, splits=2, tile=4, tile_bytes=100)
    assert rows_of(divergence.audit(docs, least_docs=3, limits=limits)) == expected
    text = pa.array([r[1] for r in rows])
    offsets, data = np.frombuffer(text.buffers()[1], np.int32).astype(np.int64), np.frombuffer(text.buffers()[2], np.uint8)
    found = collections.Counter()
    for table in divergence._per_document(offsets, data, 60):
        for r in table.to_pylist():
            assert (r["doc"], r["term"]) not in found
            found[r["doc"], r["term"]] = r["tf"]
    lowered = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r[1].replace("Gamma", "gamma")) for r in rows]
    assert found == collections.Counter({(i, t): n for i, ws in enumerate(lowered) for t, n in collections.Counter(ws).items()})
    block = divergence._compacted([pa.table({"group": pa.array([0, 1] * 30, pa.int32()), "term": [f"t{i % 17}" for i in range(60)], "tf": [1] * 60, "df": [1] * 60})])
    spilled = pa.Table.from_batches(divergence._spilled(block, [("b", "s"), ("a", "s")], 4, 3)).to_pylist()
    assert all(r["term"] == sorted(r["term"]) and len(r["term"]) <= 3 and r["first"] == r["term"][0] and r["source"] == "s" for r in spilled)
    assert sum(n for r in spilled for n in r["tf"]) == 60
    assert len({(r["shard"], t) for r in spilled for t in r["term"]}) == 17


def test_tiles_of_pairs():
    draw = np.random.default_rng(5)
    counts = draw.integers(0, 4, (30, 7))
    p = 10 + counts * draw.integers(3, 9, 7)
    base = np.full(7, 10) + draw.integers(0, 5, 7)
    p = np.where(counts > 0, p, base)
    for rows, columns in ((slice(0, 7), slice(0, 7)), (slice(0, 4), slice(4, 7))):
        tile = divergence.Tile(base[rows], base[columns])
        for part in np.array_split(np.arange(30), 4):
            tile.add((p[part][:, rows], p[part][:, columns]), ((counts > 0)[part][:, rows], (counts > 0)[part][:, columns]))
        expected = np.abs(p[:, rows][:, :, None] - p[:, columns][:, None, :]).sum(axis=0)
        assert (tile.sums + 30 * tile.apart == expected).all()


# Hard negatives

def mined(rows, every, k=5, kn=5, least=80):
    out = set()
    for anchor, label, v in rows:
        if anchor % every:
            continue
        score = {i: (sum(a * b for a, b in zip(v, w, strict=True)), own) for i, own, w in rows if i != anchor}
        order = sorted(score, key=lambda i: (-score[i][0], i))
        for positive in [i for i in order if score[i][1] == label][:k]:
            limit = score[positive][0]
            near = [i for i in order if score[i][1] != label and least * limit <= 100 * score[i][0] <= 100 * limit][:kn]
            out |= {(anchor, positive, n, i, limit, score[i][0]) for n, i in enumerate(near, 1)}
    return out


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, slot int, score string")


@pytest.mark.parametrize("spread", [1, 3, 40])
def test_hard_negatives(spark, spread):
    """Few different scores make ties and positives of equal score; one label holds most rows."""
    random.seed(spread)
    rows = [(i, [random.randint(-spread, spread) for _ in range(6)], random.choice([0, 0, 0, 1, 2])) for i in range(240)]
    table = vectors(spark, [(i, [x / 256 for x in v], label, 1, "s") for i, v, label in rows]).repartition(5)
    got = rows_of(hard_negatives.mine(table, "vec_id % 6 = 0", F.col("label")))
    assert got == mined([(i, label, v) for i, v, label in rows], 6)
    assert got


def test_hard_negatives_of_awkward_rows(spark):
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 1.9], 2), (3, [1.0, 2.0], 2), (4, [9.0], 2), (5, None, 1), (6, [1.0, None], 1), (7, [math.nan, 1.0], 2), (8, [math.inf, 1.0], 2)]
    rows += [(9, [1.0, 2.0], None), (None, [1.0, 2.0], 2), (3, [1.0, 2.0], 2), (10, [-1.0, -2.0], 1), (11, [1e300, 1.0], 2), (12, [0.0, 0.0], 3), (13, [], 2)]
    table = vectors(spark, [(*r, 1, "s") for r in rows])
    got = rows_of(hard_negatives.mine(table, "vec_id = 0 OR vec_id = 12", F.col("label")))
    five = 256 * 256 * 5
    assert got == {(0, 1, 1, 3, five, five), (0, 1, 2, 2, five, 256 * 256 + 512 * 486)}
    assert hard_negatives.mine(table.limit(0), "vec_id % 2 = 0", F.col("label")).count() == 0
    assert hard_negatives.mine(table, "vec_id < 0", F.col("label")).count() == 0


def test_products_are_exact():
    for size in (3, 1 << 11, 1 << 23):
        draw = np.random.default_rng(size)
        own, other = (draw.integers(-size, size, (4, 50)).astype(np.int32) for _ in range(2))
        block = lambda v: hard_negatives.Block(np.arange(4), np.zeros(4, np.int64), v)
        exact = [[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in other] for x in own]
        assert block(own).scores(block(other), 0, 4).tolist() == exact


# Packing

@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_bins(lengths):
    bins = packing.pack_lengths(lengths, 64)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(0 < sum(lengths[i] for i in b) <= 64 for b in bins)
    assert len(bins) <= len(packing.best_fit(lengths, 64)) <= max(1, 2 * sum(lengths) / 64 + 1)


def test_search_empties_bins():
    """Best fit alone needs more bins; few are left above the sum of all lengths."""
    random.seed(1)
    lengths = [random.randint(250, 420) for _ in range(5000)]
    found = len(packing.pack_lengths(lengths, 1024))
    assert found < 0.97 * len(packing.best_fit(lengths, 1024))
    small = [min(1023, 1 + int(random.expovariate(1 / 200))) for _ in range(5000)]
    assert len(packing.pack_lengths(small, 1024)) == math.ceil(sum(small) / 1024)


def test_ids_are_those_of_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    whole, own = Tokenizer.from_file(path), packing.TextEncoder(path)
    assert own.ranked is not None
    random.seed(2)
    alphabet = ["a", "Zed", " ", "  ", "\n", "\t", " \n ", "\xa0", "\u2003", "\u3000", "\u0085", "é", "日本", "ß", "'s", "'", "12", "<|endoftext|>", "<|", "<", "...", "-", "😀", "\u0301", "\x00", "\x1c", "\r\n"]
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 30))) for _ in range(5000)] + ["", "x" * 5000, " " * 300, "w " * 3000, " " * 150_000 + "x", "\n" * 150_000]
    # Every character that Unicode assigns, between a letter and a number.
    texts += ["".join(f"a{chr(c)}1 {chr(c)}{chr(c)} " for c in range(at, at + 64) if not 0xD800 <= c < 0xE000) for at in range(0, 0x32000, 64)]
    differing = [t for t in texts if own.encode(t).tolist() != whole.encode(t, add_special_tokens=False).ids]
    assert not differing, differing[:3]
    # A tokenizer of another kind goes through the library.
    other = packing.TextEncoder(public_tokenizers.path("word_bpe_49k.json"))
    assert other.ranked is None and other.encode("Some words").tolist() == Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode("Some words", add_special_tokens=False).ids


def packed_rows(packed, docs, size):
    """Checks what has to hold of any packing; returns the number of sequences."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = collections.Counter((r["doc_id"], tuple([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2])) for r in docs.collect())
    rows = packed.collect()
    of_sequence = collections.defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), "<u4")
        assert len(ids) == r["length"] <= size and r["length"] > 0
        of_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in of_sequence.values():
        places.sort()
        assert [a for a, _ in places] == [0, *itertools.accumulate(n for _, n in places)][:-1]
        assert sum(n for _, n in places) <= size
    # Documents whose id and text come once: their pieces make the whole text.
    once = {doc for doc, n in collections.Counter(doc for doc, _ in texts.elements()).items() if n == 1}
    for doc in once:
        own = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and all(r["length"] == size for r in own[1:])
        assert [r["start"] for r in own] == [0, *itertools.accumulate(r["length"] for r in own)][:-1]
        assert (doc, tuple(np.frombuffer(b"".join(bytes(r["ids"]) for r in own), "<u4").tolist())) in texts
    assert sum(r["length"] for r in rows) == sum(len(ids) for _, ids in texts.elements())
    return len(of_sequence), sum(r["length"] for r in rows)


def test_packing(spark, awkward, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for docs, size in ((documents, 1024), (documents, 100), (awkward, 64)):
        found, tokens = packed_rows(packing.pack(docs, path, 2, size), docs, size)
        assert found <= math.ceil(tokens / size) * 1.01 + 1
    assert packing.pack(awkward.limit(0), path, 2, 64).count() == 0
    hot = awkward.where("doc_id = 7").crossJoin(spark.range(500)).drop("id")
    rows = packing.pack(hot, path, 2, 64).collect()
    assert len(rows) == 500 * awkward.where("doc_id = 7").count() and len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


def test_chunks_meet_again(spark):
    lengths = spark.range(4000).select(F.col("id").alias("key"), (F.pmod(F.xxhash64("id"), F.lit(300)) + 1).alias("length"))
    got = packing.assign(lengths, 1024, chunk=300).join(lengths, "key").groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.count("*")).toPandas()
    assert (got["n"] == got["end"]).all() and got["n"].max() <= 1024 and got.iloc[:, 3].sum() == 4000
    assert len(got) <= math.ceil(got["n"].sum() / 1024) + 1


def test_digests_of_packed_pieces(spark, sf_dir):
    out = queries.op13_packed_sequences(spark, sf_dir)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert dict(out.dtypes)["ids_crc32"] == "bigint"
