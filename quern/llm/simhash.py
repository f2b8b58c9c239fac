"""SimHash near-duplicates, found by the generalised pigeonhole principle.

A text's ASCII letters are lower-cased, its words are ``[^\\x20\\x09-\\x0D]+`` and its shingles runs of three words
joined by spaces (fewer words: all of them; none: fingerprint zero). A bit of the fingerprint is set if over half
of the shingles' XXH64 values (seed 42) have it. Fingerprints that differ in ``RADIUS`` or fewer bits are linked.

The 64 bits are dealt into parts, correlated bits together. If two fingerprints differ in at most r bits and each
part i has a threshold t_i of -1 or more with the sum of (t_i + 1) equal to r + 1, some part differs in at most
t_i bits. Each distinct fingerprint gets its own thresholds: a dynamic programme over the parts minimises probes
plus estimated candidates, the estimate being a histogram of the part's values over all fingerprints (2^12 buckets
a part). It is indexed once in each part and probes every value within t_i of its own; what meets in a value is
verified over all 64 bits. The number of parts follows from the number of fingerprints by the same cost.

Skew: only distinct fingerprints take part, so exact copies never meet. Values that nothing probes, and those of one row,
go before rows are sorted by value. A probed value with more than 2 ``BLOCK`` rows is dealt out as blocks of index rows
against blocks of probes. A group emits the edges of a spanning forest, not its
pairs. Components are found by large-star and small-star steps.

Defined results: a null text counts as empty; rows of one doc_id count as one document; a null doc_id links
nothing and has the component of its fingerprint, or null; repeated rows stay; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.arrow import cut, map_rows, read_table
from quern.llm.components import components

RADIUS, SEED, SHINGLE = 3, 42, 3
BUCKET_BITS, BLOCK, SMALL = 12, 1024, 24


def fingerprint(text: str | None) -> int:
    """SimHash of a whole text as a signed 64-bit integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], np.uint64)
    counts = sum(np.unpackbits(hashes[i : i + 50_000].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64) for i in range(0, len(hashes), 50_000))
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    run = lambda rows: {"doc_id": rows["doc_id"], "fp": [fingerprint(t) for t in rows["text"]]}
    return map_rows(docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text"), run, "doc_id long, fp long")


def widths(n: int, radius: int) -> list[int]:
    """Widths of the parts for n fingerprints: the number of parts of the least probes plus candidates, were bits random."""

    def cost(m: int) -> float:
        w, extra = 64 // m, radius + 1 - m
        each = [sum(comb(w, j) for j in range(1 + extra // m + (i < extra % m))) for i in range(m)]
        return sum(p + p * n / 2.0**w for p in each)

    m = min(range(2, radius + 2), key=cost) if radius > 0 else 1
    return [64 // m + (i < 64 % m) for i in range(m)]


def correlations(fps: DataFrame) -> np.ndarray:
    """Absolute correlation of each two bits over all fingerprints; sums of 64 x 64 counts, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((64, 64)), 0
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(x), 20_000):
                bits = np.unpackbits(np.ascontiguousarray(x[i : i + 20_000]).view(np.uint8), bitorder="little").reshape(-1, 64).astype(np.float32)
                both += bits.T @ bits
                n += len(bits)
        if n:
            i, j = np.triu_indices(64)
            yield pa.RecordBatch.from_pydict({"i": np.append(i, 64), "j": np.append(j, 64), "n": np.append(both[i, j], n).astype(np.int64)})

    both = np.zeros((65, 65))
    for i, j, n in fps.select("fp").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n")).collect():
        both[i, j] = both[j, i] = n
    n, both = max(1.0, both[64, 64]), both[:64, :64]
    p = both.diagonal() / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return np.abs((both / n - np.outer(p, p)) / np.outer(spread, spread))


def deal_bits(related: np.ndarray, parts: list[int]) -> list[list[int]]:
    """Bits of each part: the free bit most related to all others starts one, then the most related to those in it join."""
    free, dealt = set(range(64)), []
    for width in parts:
        own: list[int] = []
        while len(own) < width:
            rest = sorted(free)
            score = related[np.ix_(rest, own or rest)].sum(1)
            own.append(rest[int(score.argmax())])
            free.remove(own[-1])
        dealt.append(sorted(own))
    return dealt


def project(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The value that a part's bits form, the first bit highest."""
    fp, out = fp.view(np.uint64), np.zeros(len(fp), np.int64)
    for b in bits:
        out = out << 1 | (fp >> np.uint64(b) & np.uint64(1)).astype(np.int64)
    return out


def histogram(fps: DataFrame, dealt: list[list[int]]) -> np.ndarray:
    """Counts of (part, leading BUCKET_BITS bits of its value) over all fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((len(dealt), 1 << BUCKET_BITS), np.int64)
        for batch in batches:
            fp = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False))
            for i, bits in enumerate(dealt):
                own[i] += np.bincount(project(fp, bits[:BUCKET_BITS]), minlength=1 << BUCKET_BITS)
        i, v = own.nonzero()
        yield pa.RecordBatch.from_pydict({"i": i, "v": v, "n": own[i, v]})

    counts = np.zeros((len(dealt), 1 << BUCKET_BITS))
    for i, v, n in fps.select("fp").mapInArrow(run, "i long, v long, n long").groupBy("i", "v").agg(F.sum("n")).collect():
        counts[i, v] = n
    return counts


def costs(counts: np.ndarray, parts: list[int], radius: int) -> np.ndarray:
    """[part, bucket, t + 1]: probes plus estimated candidates at threshold t, from -1 to ``radius``."""
    out = np.zeros((*counts.shape, radius + 2))
    places = np.arange(counts.shape[1])
    for i, width in enumerate(parts):
        low = width - min(width, BUCKET_BITS)
        around = lambda x: sum(x[places ^ (1 << k)] for k in range(min(width, BUCKET_BITS)))  # noqa: B023, E731
        exact = [counts[i]]
        for j in range(1, radius + 1):  # buckets that differ in exactly j leading bits
            exact.append((around(exact[-1]) - ((min(width, BUCKET_BITS) - j + 2) * exact[-2] if j > 1 else 0)) / j)
        for t in range(radius + 1):
            found = sum(exact[j] * comb(low, k) for j in range(t + 1) for k in range(t + 1 - j)) / 2.0**low
            out[i, :, t + 1] = found + sum(comb(width, j) for j in range(t + 1))
    return out


def thresholds(price: np.ndarray, radius: int) -> np.ndarray:
    """Cheapest thresholds of each row by dynamic programming; price: [row, part, t + 1], for thresholds up to the last that has one."""
    rows, m, _ = price.shape
    best = np.full((rows, radius + 2), np.inf)
    best[:, 0] = 0
    chosen = np.zeros((m, rows, radius + 2), np.int16)
    for i in range(m):
        after = np.full_like(best, np.inf)
        for t in range(min(radius + 2, price.shape[2])):
            cost = best[:, : radius + 2 - t] + price[:, i, t, None]
            better = cost < after[:, t:]
            after[:, t:][better], chosen[i, :, t:][better] = cost[better], t
        best = after
    out, left, every = np.zeros((rows, m), np.int64), np.full(rows, radius + 1), np.arange(rows)
    for i in reversed(range(m)):
        out[:, i] = chosen[i, every, left]
        left = left - out[:, i]
    return out - 1


def meetings(fps: DataFrame, dealt: list[list[int]], price: np.ndarray, radius: int) -> DataFrame:
    """(key, node, fp, role) rows: role 1 an index entry, 2 a probe, 3 both in one."""
    parts = [len(b) for b in dealt]
    flips = [[np.array([sum(1 << k for k in c) for c in combinations(range(w), j)], np.int64) for j in range(radius + 1)] for w in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 5_000):
                node, fp = (np.ascontiguousarray(batch.column(c).slice(k, 5_000).to_numpy(zero_copy_only=False)) for c in (0, 1))
                values = [project(fp, b) for b in dealt]
                buckets = [v >> (w - min(w, BUCKET_BITS)) for v, w in zip(values, parts, strict=True)]
                limit = thresholds(np.stack([price[i][b] for i, b in enumerate(buckets)], 1), radius)
                for i, value in enumerate(values):
                    key = value | i << 33
                    yield pa.RecordBatch.from_pydict({"key": key, "node": node, "fp": fp, "role": np.where(limit[:, i] >= 0, 3, 1)})
                    for j in range(1, radius + 1):
                        own = np.flatnonzero(limit[:, i] >= j)
                        for at in range(0, len(own), max(1, 200_000 // len(flips[i][j]))):
                            some = own[at : at + max(1, 200_000 // len(flips[i][j]))]
                            probes = (key[some, None] ^ flips[i][j][None]).ravel()
                            each = len(flips[i][j])
                            yield pa.RecordBatch.from_pydict({"key": probes, "node": np.repeat(node[some], each), "fp": np.repeat(fp[some], each), "role": np.full(len(probes), 2)})

    return fps.select("node", "fp").mapInArrow(run, "key long, node long, fp long, role long")


def forest(node: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join those nodes of one group that links within it connect: each to the first of its tree."""
    left, other, rest = [], [], np.arange(len(fp))
    while len(rest) > 1:
        root, front, rest = rest[0], rest[:1], rest[1:]
        while len(front) and len(rest):
            near = np.zeros(len(rest), bool)
            for k in range(0, len(front), 256):
                near |= (np.bitwise_count(fp[front[k : k + 256], None] ^ fp[None, rest]) <= radius).any(0)
            front, rest = rest[near], rest[~near]
            left.append(np.full(len(front), node[root]))
            other.append(node[front])
    return (np.concatenate(left), np.concatenate(other)) if left else (np.zeros(0, np.int64),) * 2


def verify(rows: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) between fingerprints that meet in a key and differ in at most ``radius`` bits."""
    counts = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("role") % 2).alias("n_index"), F.sum((F.col("role") > 1).cast("long")).alias("n_probe"))
    blocks = lambda n: F.when(F.col("n_index") + F.col("n_probe") > 2 * BLOCK, F.ceil(F.col(n) / BLOCK)).otherwise(1)
    met = counts.where("n > 1 AND n_index > 0 AND n_probe > 0").select(F.col("key").alias("of"), blocks("n_index").alias("wide"), blocks("n_probe").alias("high"))
    put = lambda n, salt: F.pmod(F.xxhash64("fp", F.lit(salt)), n)
    every = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    joined = rows.join(met, F.col("key") == F.col("of")).drop("of")
    whole = joined.where("wide = 1 AND high = 1").select("key", F.lit(0).cast("long").alias("block"), "node", "fp", "role")
    big = joined.where("wide > 1 OR high > 1")
    index = big.where("role <> 2").select("key", F.explode(F.transform(every(F.col("high")), lambda h: put(F.col("wide"), 1) * F.col("high") + h)).alias("block"), "node", "fp", F.lit(1).cast("long").alias("role"))
    probe = big.where("role > 1").select("key", F.explode(F.transform(every(F.col("wide")), lambda w: w * F.col("high") + put(F.col("high"), 2))).alias("block"), "node", "fp", F.lit(2).cast("long").alias("role"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            now = [np.concatenate(x) for x in zip(held, now, strict=True)] if held else now
            new = np.flatnonzero((now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])) + 1
            done = int(new[-1]) if len(new) else 0
            held = [c[done:] for c in now]
            if done:
                yield from edges([c[:done] for c in now], np.concatenate([[0], new]))
        if held and len(held[0]):
            yield from edges(held, np.array([0, len(held[0])]))

    def edges(now: list[np.ndarray], bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, fp, role = now[2], now[3].view(np.uint64), now[4]
        size = np.diff(bounds)
        last = np.repeat(bounds[1:], size)
        last[np.repeat(size > SMALL, size)] = 0  # large groups: below
        at = np.arange(len(node))
        for d in range(1, SMALL):
            at = at[at + d < last[at]]
            if not len(at):
                break
            one, two = role[at], role[at + d]
            hit = at[((one & 1 & two >> 1) | (one >> 1 & two & 1)).astype(bool) & (np.bitwise_count(fp[at] ^ fp[at + d]) <= radius)]
            yield pa.RecordBatch.from_pydict({"a": node[hit], "b": node[hit + d]})
        for k in np.flatnonzero(size > SMALL):
            own = slice(bounds[k], bounds[k + 1])
            _, first = np.unique(fp[own], return_index=True)
            if (role[own] > 1).any():
                a, b = forest(node[own][first], fp[own][first], radius)
                yield pa.RecordBatch.from_pydict({"a": a, "b": b})

    grouped = whole.unionByName(index).unionByName(probe).repartition("key", "block").sortWithinPartitions("key", "block")
    return grouped.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs`` (doc_id, text)."""
    made = cut(fingerprints(docs))
    fps = cut(made.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node")))
    parts = widths(max(1, fps.count()), radius)
    dealt = deal_bits(correlations(fps), parts)
    price = costs(histogram(fps, dealt), parts, radius)
    roots = components(verify(cut(meetings(fps, dealt, price, radius)), radius))
    known = cut(fps.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select(F.col("fp").alias("known_fp"), F.coalesce("root", "node").alias("component_id")))
    return made.join(known, F.col("fp") == F.col("known_fp"), "left").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Rows of ``docs``, all columns, without the documents linked to one of a smaller id. A null doc_id stays."""
    gone = cut(near_duplicates(docs, radius).where("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
