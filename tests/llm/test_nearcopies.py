"""Near copies by Jaccard similarity of five-word shingles, against all pairs."""

import itertools
import random

import numpy as np
import pytest

import corpus_pipeline
from quern.llm import nearcopies


def brute_gone(rows):
    """doc_ids linked to a smaller one, by all pairs of shingle sets."""
    sets = [(i, {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set()) for i, t in rows]
    root = {i: i for i, _ in sets}
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if len(a & b) >= 0.8 * len(a | b):
            x, y = sorted((root[i], root[j]))
            root = {k: x if r == y else r for k, r in root.items()}
    return {i for i, r in root.items() if r != i}


def near_copies(rnd, lengths, changes):
    """Pairs of random-word texts, the second with a share of its words changed."""
    for n in lengths:
        words = [f"w{rnd.randrange(5000)}" for _ in range(n)]
        other = list(words)
        for p in rnd.sample(range(n), max(1, round(n * changes))):
            other[p] = f"x{rnd.randrange(5000)}"
        yield " ".join(words), " ".join(other)


@pytest.mark.parametrize("group", [256, 4])
def test_near_copies(spark, odd, none, group, monkeypatch):
    monkeypatch.setattr(nearcopies, "GROUP", group)
    monkeypatch.setattr(nearcopies, "BLOCK", 4 * group)
    monkeypatch.setattr(nearcopies, "SMALL", 24 if group > 4 else 3)
    rnd = random.Random(11)
    texts = [t for c in (0.01, 0.02, 0.03, 0.2) for pair in near_copies(rnd, [30, 100, 200, 200, 500, 1000], c) for t in pair]
    base = [f"v{rnd.randrange(5000)}" for _ in range(150)]
    texts += [" ".join(base[:p] + [f"y{p}"] + base[p + 1 :]) for p in range(20, 40)] + [" ".join(base[k:] + [f"z{i}" for i in range(k)]) for k in range(0, 90, 9)]
    rows = list(enumerate(texts)) + [(300, None), (301, " "), (302, "A b"), (303, "a B")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS node").repartition(3)
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").collect()}
    assert {i for i, _ in rows} - kept == brute_gone(rows)
    assert {1, 3, 5, 7, 9, 11} <= {i for i, _ in rows} - kept
    assert nearcopies.deduplicated(odd).columns == odd.columns and nearcopies.deduplicated(none).count() == 0


def test_recall_of_the_radius():
    """Share of pairs at the similarity, or a little over it, whose fingerprints are within the radius."""
    rnd, found = random.Random(12), []
    for n in [5, 8, 12, 20, 50, 100, 400] * 60:
        shared = [f"w{i} {rnd.random()}" for i in range(-(-8 * n // 10))]
        one, two = (nearcopies_bits(shared + [f"{x} {rnd.random()}" for _ in range((n - len(shared)) // 2)]) for x in "ab")
        found.append(np.bitwise_count(one ^ two).sum() <= (nearcopies.RADIUS if n > nearcopies.SHORT else nearcopies.SHORT_RADIUS))
    assert np.mean(found) >= 0.99


def nearcopies_bits(values):
    """SimHash of a set whose shingles are the given values."""
    own = np.frombuffer(b"".join(nearcopies.xxhash.xxh3_128_digest(v.encode(), nearcopies.SEED) for v in values), np.uint8).reshape(-1, 16)
    return np.packbits(2 * np.unpackbits(own, axis=1).sum(0, dtype=np.int64) > len(own)).view(np.uint64)


def test_thresholds_of_parts():
    """Each text probes the parts of its SimHash that fewest share, one more than shingles may differ."""
    rnd = random.Random(13)
    for n in (5, 12, 40, 120, 600):
        one = nearcopies.shingles(" ".join(f"w{rnd.randrange(10**6)}" for _ in range(n + 4)))
        for c in nearcopies.classes(len(one)):
            parts, indexed, many = nearcopies.layout(c)
            keys = nearcopies.keys_of(one, c)
            assert len(keys) == indexed and many < indexed <= min(parts, nearcopies.KEYS)
            counts = np.ones((nearcopies.KEYS, 1 << nearcopies.BUCKET_BITS))
            hot = sorted(rnd.sample(range(indexed), indexed - many))
            counts[hot, nearcopies.bucket(keys)[hot]] = 1000
            assert (~nearcopies.probed(c, keys[None], counts)[0]).nonzero()[0].tolist() == hot
        # without one shingle only the SimHash of that shingle's part changes, and a pair at the similarity has a probed part in common
        c = nearcopies.classes(len(one))[0]
        if nearcopies.layout(c)[0]:
            assert (nearcopies.keys_of(one, c) != nearcopies.keys_of(one[1:], c)).sum() <= 1
            fewer = one[rnd.sample(range(len(one)), -(-8 * len(one) // 10))]
            same = nearcopies.keys_of(one, c) == nearcopies.keys_of(fewer[np.argsort(fewer[:, 0])], c)
            assert (same & nearcopies.probed(c, nearcopies.keys_of(one, c)[None], np.ones(counts.shape))[0]).any()
