"""Operators over all documents: near-dedup, top-k, pages, language model, repeated strings."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import hmm, mtree, pages, simhash, suffixes
from quern.llm.components import components

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """{doc_id: (fingerprint, component)} by all pairs."""
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    root = {i: i for i, _ in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 3:
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i: (f, find(i)) for i, f in fps}


def test_simhash(spark, odd, none):
    rnd = random.Random(1)
    base = [" ".join(rnd.choice("abcdefgh") * 3 for _ in range(60)) for _ in range(15)]
    rows = []
    for i in range(220):
        words = rnd.choice(base).split()
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 30])):
            words[rnd.randrange(len(words))] = rnd.choice("xyz")
        rows.append((i, " ".join(words)))
    rows += [(300, None), (301, " "), (302, "A b"), (303, "a B")]
    want = brute_components(rows)
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS node")).collect()
    assert {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in got} == want
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == odd.count() and simhash.near_duplicates(none).count() == 0
    assert simhash.deduplicated(odd).columns == odd.columns


def test_simhash_large_groups(spark, monkeypatch):
    """Random fingerprints near a few centres: hot values are dealt out in blocks."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rnd = random.Random(2)
    centres = [rnd.getrandbits(64) for _ in range(4)]
    values = {rnd.choice(centres) ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(5))) for _ in range(400)} | {rnd.getrandbits(64) for _ in range(100)}
    fps = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    df = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "node long, fp long")
    parts = simhash.widths(len(fps), 3)
    dealt = simhash.deal_bits(simhash.correlations(df), parts)
    price = simhash.costs(simhash.histogram(df, dealt), parts, 3)
    roots = {r["node"]: r["root"] for r in components(simhash.verify(simhash.meetings(df, dealt, price, 3), 3)).collect()}
    root = list(range(len(fps)))
    for i, j in itertools.combinations(range(len(fps)), 2):
        if ((fps[i] ^ fps[j]) % (1 << 64)).bit_count() <= 3:
            a, b = sorted((root[i], root[j]))
            root = [a if x == b else x for x in root]
    assert [roots.get(i, i) for i in range(len(fps))] == root


def test_simhash_values_without_probes(spark):
    """Rows of a value that nothing probes reach no task."""
    rnd = random.Random(3)
    df = spark.createDataFrame([(i, (rnd.getrandbits(31) << 32) | 77) for i in range(4000)], "node long, fp long")
    rows = df.select((F.col("fp") % 4294967296).alias("key"), "node", "fp", F.lit(1).cast("long").alias("role"))
    rows = rows.union(df.select(F.shiftright("fp", 32), "node", "fp", F.lit(3).cast("long")))
    assert simhash.verify(rows, 3).count() == 0


def brute_top(rows, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(ok):
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for m, (j, v) in enumerate(ok) if m != n)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("tree", [2048, 24])
def test_top_k(spark, tree, monkeypatch):
    monkeypatch.setattr(mtree, "TREE", tree)
    rnd = np.random.Generator(np.random.PCG64(4))
    centres = rnd.normal(size=(5, 8))
    rows = [(i, (centres[i % 5] * (1 if i % 3 else 2) + (0 if i % 7 == 0 else rnd.normal(size=8) * 0.2)).tolist()) for i in range(400)]
    rows += [(50, rows[1][1]), (1000, None), (1050, [1.0, None]), (1100, [math.nan]), (1150, [math.inf]), (1200, []), (1250, [0.5]), (None, [1.0]), (-50, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS row", "2 AS v", "3 AS tree")
    vectors = mtree.cut(mtree.whole_vectors(df))
    got = sorted(tuple(r) for r in mtree.top_k(vectors, vectors.where("vec_id % 50 = 0")).collect())
    assert got == brute_top(rows)
    assert mtree.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_top_k_of_large_components(spark):
    """Scores that doubles don't hold."""
    rnd = random.Random(6)
    rows = [(i, [float((1 << 22) + rnd.randrange(3)), float(rnd.randrange(5))]) for i in range(120)] + [(500, [float(-(1 << 22)), 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = mtree.cut(mtree.whole_vectors(df))
    got = sorted(tuple(r) for r in mtree.top_k(vectors, vectors.where("vec_id % 50 = 0")).collect())
    assert got == brute_top(rows) and max(r[3] for r in got) > 1 << 60


def test_tree_skips_distances():
    """Far clusters are never computed."""
    rnd = np.random.Generator(np.random.PCG64(5))
    v = np.concatenate([rnd.normal(size=(500, 4)) * 5 + c for c in ([900, 0, 0, 0], [0, 900, 0, 0], [-900, 0, 0, 0])]).astype(np.int64)
    most = float((v * v).sum(1).max())
    t, best, seen = mtree.Tree.unpack(mtree.Tree(np.arange(1500), np.arange(1500), v, most).pack(), True), [], []
    t.pages = [Watched(p, seen) for p in t.pages]
    t.search(v[0].astype(float), 0, best, 5, most)
    assert len(best) == 5 and len(seen) < len(t.pages) / 2


class Watched(tuple):
    def __new__(cls, page, seen):
        self = super().__new__(cls, page)
        self.seen = seen
        return self

    def __iter__(self):
        self.seen.append(1)
        return super().__iter__()


def test_language_model(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text")).union(spark.sql("SELECT 10001L, 'UNSEEN words only'"))
    rows = [(r["doc_id"], re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")) + ["\n"]) for r in docs.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, ws in rows if not held(i) for w in ws)
    n, v = counts.total(), len(counts)
    want = sorted((repr(i), held(i), len(ws), sum(w in counts for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in rows)
    got = hmm.score(docs.selectExpr("*", "1 AS word", "2 AS chunk"), rounds=3, chunk=5_000).toPandas().astype({"doc_id": object})
    mine = sorted((repr(None if x.doc_id != x.doc_id else int(x.doc_id)), x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got.itertuples())
    assert mine == want
    some = got[got.held_out]
    assert some.score.sum() > some.base_score.sum() and (got.score <= 0).all()
    assert hmm.score(none).count() == 0


def small_model(rnd):
    return hmm.Model(rnd.dirichlet(np.ones(3)), rnd.dirichlet(np.ones(3), 3), rnd.dirichlet(np.ones(5), 3).T)


def test_forward_and_baum_welch():
    rnd = np.random.Generator(np.random.PCG64(8))
    model = small_model(rnd)
    seqs = [rnd.integers(0, 5, n).astype(np.uint16) for n in (1, 4, 6, 6, 2)]
    want, starts, moves, emits = [], np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5))
    for x in seqs:
        paths = {}
        for path in itertools.product(range(3), repeat=len(x)):
            p = model.start[path[0]] * math.prod(model.move[a, b] for a, b in zip(path, path[1:])) * math.prod(model.emit[c, s] for c, s in zip(x, path))
            paths[path] = p
        total = sum(paths.values())
        want.append(math.log10(total))
        for path, p in paths.items():
            starts[path[0]] += p / total
            for a, b in zip(path, path[1:]):
                moves[a, b] += p / total
            for c, s in zip(x, path):
                emits[s, c] += p / total
    assert np.allclose(hmm.log10_likelihoods(model, seqs), want)
    for got, expect in zip(hmm.expected(model, seqs), (starts, moves, emits)):
        assert np.allclose(got, expect, rtol=1e-4, atol=1e-5)


def plain_counts(model, seqs):
    """Expected counts, one text and one token after the other."""
    starts, moves, emits = np.zeros(len(model.start)), np.zeros_like(model.move), np.zeros(model.emit.T.shape)
    for x in seqs:
        x = x.astype(int)
        a, b, c = np.zeros((len(x), len(starts))), np.ones((len(x), len(starts))), np.zeros(len(x))
        for t, k in enumerate(x):
            v = (model.start if t == 0 else a[t - 1] @ model.move) * model.emit[k]
            a[t], c[t] = v / v.sum(), v.sum()
        for t in range(len(x) - 2, -1, -1):
            b[t] = model.move @ (model.emit[x[t + 1]] * b[t + 1]) / c[t + 1]
        starts += a[0] * b[0]
        for t, k in enumerate(x):
            emits[:, k] += a[t] * b[t]
            if t:
                moves += a[t - 1][:, None] * model.move * (model.emit[k] * b[t] / c[t])[None]
    return starts, moves, emits


@pytest.mark.parametrize("long,run,tokens", [(2048, 128, 500_000), (3, 4, 50), (10, 3, 30), (0, 1, 20), (0, 128, 10), (5, 2, 4)])
def test_whole_texts_in_training(long, run, tokens, monkeypatch):
    """Runs of long texts count as the texts they are cut from."""
    for name, value in (("LONG", long), ("RUN", run), ("TOKENS", tokens)):
        monkeypatch.setattr(hmm, name, value)
    rnd = np.random.Generator(np.random.PCG64(9))
    model, seqs = small_model(rnd), [rnd.integers(0, 5, n).astype(np.uint16) for n in (1, 4, 6, 6, 2, 30, 17, 8, 9, 3, 25)]
    for got, expect in zip(hmm.expected(model, seqs), plain_counts(model, seqs)):
        assert np.allclose(got, expect, rtol=1e-4, atol=1e-5)


def test_scores_against_a_plain_model(spark):
    """The score column: training, forward recursion and words given their classes, from plain versions."""
    rnd = random.Random(10)
    rows = [(i, " ".join(rnd.choice(["sun", "Moon", "star", "run", "ran", "sat", f"w{rnd.randrange(40)}"]) for _ in range(rnd.randrange(0, 40)))) for i in range(60)]
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    tokens = lambda t: [w.encode() for w in t.lower().split()] + [hmm.END]
    seqs = [np.array([hmm.class_of(w) for w in tokens(t)], np.uint16) for t in train]
    words = Counter(w for t in train for w in tokens(t))
    of_class, kinds = np.bincount(np.concatenate(seqs), minlength=hmm.CLASSES), np.bincount([hmm.class_of(w) for w in words], minlength=hmm.CLASSES)
    model = hmm.Model.first(of_class.astype(float))
    for _ in range(2):
        starts, moves, emits = plain_counts(model, seqs)
        model = hmm.Model.of_counts(starts, moves, emits.T)
    got = {r["doc_id"]: r["score"] for r in hmm.score(spark.createDataFrame(rows, "doc_id long, text string"), rounds=2, chunk=200).collect()}
    for i, text in rows:
        alpha, want = None, 0.0
        for w in tokens(text):
            k = hmm.class_of(w)
            alpha = (model.start if alpha is None else alpha @ model.move) * model.emit[k]
            want += math.log10(alpha.sum()) + math.log10((words[w] + 1) / (of_class[k] + kinds[k] + 1))
            alpha = alpha / alpha.sum()
        assert abs(got[i] - want) < 1e-3 * max(1, abs(want))


def brute_repeats(rows):
    first = {}
    for i, t in rows:
        t = (t or "").encode()
        for p in range(len(t) - 49 if i is not None else 0):
            first[t[p : p + 50]] = min(i, first.get(t[p : p + 50], i))
    out = []
    for i, t in rows:
        t = (t or "").encode()
        gone = bytearray(len(t))
        for p in range(len(t) - 49 if i is not None else 0):
            if first[t[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), sum(bool(g) and not h for g, h in zip(gone, b"\0" + gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [(6_000_000, 8_000_000, 1 << 16), (700, 900, 64), (700, 900, 64, 3), (6_000_000, 8_000_000, 1 << 16, 1)])
def test_repeated_strings(spark, odd, none, sizes):
    rnd = random.Random(sizes[0])
    base = ["".join(rnd.choice("ab é\0") for _ in range(300)) for _ in range(6)]
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for i in range(120):
        s, b = rnd.randrange(250), rnd.choice(base)
        rows.append((rnd.choice([rnd.randrange(100), i]), rnd.choice([b, rnd.choice("xyz") * rnd.randrange(60) + b[s : s + rnd.randrange(30, 120)] + "q" * rnd.randrange(120), b[:100] + "#" + b[101:200], "a" * 49, "a" * 50, "abc" * 40])))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS chunk", "2 AS bucket").repartition(3)
    got = sorted((tuple(r)[:5] for r in suffixes.without_repeats(df, False, *sizes).collect()), key=repr)
    assert got == brute_repeats(rows)
    assert suffixes.without_repeats(none).count() == 0


def met_with(hot):
    return lambda table: suffixes.meet(table, hot)


def test_a_phrase_in_many_contexts(spark):
    """The strings around a phrase that all documents hold spread over all buckets, and are removed as ever."""
    rnd = random.Random(12)
    phrase = "Copyright by the authors of this"
    rows = [(i, "".join(rnd.choice("abcdef ") for _ in range(60)) + phrase + "".join(rnd.choice("abcdef ") for _ in range(60))) for i in range(300)]
    rows += [(1000 + i, rows[i * 7][1][: 100 + i]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sizes = {}
    for hot in (1 << 15, 20):
        got = sorted((tuple(r)[:5] for r in suffixes.without_repeats(df, False, 10_000, 4_000, 64, hot).collect()), key=repr)
        assert got == brute_repeats(rows)
        stored = suffixes.cut(suffixes.chunks(df, 10_000))
        met = suffixes.send_keys(stored, 12).groupBy("bucket").applyInArrow(met_with(hot), "chunk long, bucket long, bits binary")
        sent = stored.groupBy("chunk").cogroup(met.groupBy("chunk")).applyInArrow(lambda a, b: suffixes.send_contexts(a, b, 12), "chunk long, bucket long, blob binary")
        judged = suffixes.cut(sent).where("bucket >= 0").groupBy("bucket").agg(F.sum(F.length("blob")).alias("n")).collect()
        sizes[hot] = max(r["n"] for r in judged) / sum(r["n"] for r in judged)
    assert sizes[1 << 15] > 0.3 and sizes[20] < 0.2
