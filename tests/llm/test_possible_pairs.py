import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa

from wirebook.llm import near_dup


def test_no_similar_pair_is_left_out(spark):
    """of a mixed bucket every pair that is similar enough is among those to be compared."""
    draw = random.Random(5)
    passage = [f"shared{n}" for n in range(12)]
    texts = []
    for n in range(24):
        own = passage + [f"w{draw.randrange(10_000)}" for _ in range(draw.choice((0, 10, 60)))]
        texts.append(" ".join(own))
        own[-1] = f"other{n}"
        texts.append(" ".join(own))
    texts = sorted(set(texts))
    keys = [hashlib.md5(t.encode()).digest() for t in texts]
    hashes, ends = near_dup.shingles(pa.array(texts))
    common = np.sort(np.unique(hashes)[::9])
    weights = near_dup.Weights(common, np.full(len(common), 0.35))
    bags = [weights.bag(hashes[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    nodes = spark.createDataFrame([(k, bytes(k)) for k in keys], "node BINARY, c BINARY")
    bodies = spark.createDataFrame(list(zip(keys, texts, strict=True)), "node BINARY, text STRING")
    got = {(bytes(r.a), bytes(r.b)) for r in near_dup.possible_pairs(nodes, bodies, weights).collect()}
    alike = {tuple(sorted((keys[x], keys[y]))) for x, y in itertools.combinations(range(len(texts)), 2) if near_dup.similarity(bags[x], bags[y]) >= near_dup.LEAST}
    assert len(alike) >= 10 and alike <= got
    assert len(got) < len(texts) * (len(texts) - 1) / 2
    one_class = nodes.select("node", near_dup.F.lit(b"c").alias("c"))
    assert near_dup.possible_pairs(one_class, bodies, weights).count() == 0


def test_texts_of_one_family_that_differ_are_not_paired(spark):
    """Near copies that are all too different: they share most shingles, and still only pairs about as near as LEAST are compared."""
    draw = random.Random(7)
    base = [f"base{n}" for n in range(150)]
    texts = []
    for n in range(120):
        own = list(base)
        for k in draw.sample(range(150), 2 if n % 12 == 0 else draw.choice((4, 5, 6))):
            own[k] = f"own{n}x{k}"
        texts.append(" ".join(own))
    keys = [hashlib.md5(t.encode()).digest() for t in texts]
    hashes, ends = near_dup.shingles(pa.array(texts))
    found, df = np.unique(hashes, return_counts=True)
    for weights in (near_dup.Weights(found[:0], np.zeros(0)), near_dup.Weights(found[df > 5], np.full((df > 5).sum(), 0.6))):
        bags = [weights.bag(hashes[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        nodes = spark.createDataFrame([(k, bytes(k)) for k in keys], "node BINARY, c BINARY")
        bodies = spark.createDataFrame(list(zip(keys, texts, strict=True)), "node BINARY, text STRING")
        got = {(bytes(r.a), bytes(r.b)) for r in near_dup.possible_pairs(nodes, bodies, weights).collect()}
        alike = {tuple(sorted((keys[x], keys[y]))) for x, y in itertools.combinations(range(len(texts)), 2) if near_dup.similarity(bags[x], bags[y]) >= near_dup.LEAST}
        assert len(alike) >= 10 and alike <= got
        assert len(got) < 0.05 * len(texts) * (len(texts) - 1) / 2


def test_bounds_hold_for_bags_with_counts_and_weights():
    """Of any two LEAST similar bags, the first shared shingle in the common order leads in both and meets the bounds."""
    draw = np.random.default_rng(3)
    least = near_dup.LEAST / (1 + near_dup.LEAST)
    universe = draw.integers(1, 1 << 63, 400).astype(np.uint64)
    common = np.sort(universe[:150])
    weights = near_dup.Weights(common, draw.uniform(0.35, 0.9, 150))
    level = draw.integers(0, 5, 1 << 10).astype(np.int8)
    crowd = near_dup.Crowd(level)
    alike = 0
    for _ in range(2_000):
        words = universe[draw.choice(400, draw.integers(1, 60))]
        other = words.copy()
        other[: draw.integers(0, 1 + len(words) // 6)] = universe[draw.integers(0, 400)]
        a, b = weights.bag(words), weights.bag(np.concatenate([other, words[: draw.integers(0, 3)]]))
        if near_dup.similarity(a, b) < near_dup.LEAST:
            continue
        alike += 1
        lead, bits = [], []
        for found, weight in (a, b):
            at, behind = near_dup.leading(found, weight, weights.of(found), crowd.of(found))
            lead.append({int(s): (w, len(found) - k) for k, (s, w) in enumerate(zip(found[at], behind, strict=True))})
            bits.append(near_dup.bitmaps(found, weights.of(found)).view(np.uint64))
        apart = [int(np.bitwise_count(x).sum()) for x in np.split(bits[0] ^ bits[1], 2)]
        n, w = len(a[0]) + len(b[0]), a[1].sum() + b[1].sum()
        assert any(
            (min(lead[0][s][1], lead[1][s][1]) >= least * n - 1e-6 and sum(apart) <= n * (1 - 2 * least) + 1e-6)
            or (min(lead[0][s][0], lead[1][s][0]) >= least * w - 1e-6 and apart[0] + 0.35 * apart[1] <= w * (1 - 2 * least) + 1e-6)
            for s in lead[0].keys() & lead[1].keys()
        )
    assert alike >= 300
