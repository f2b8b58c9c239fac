"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of ``SIMILAR`` or more.

Words are those of ``simhash``; a shingle is a run of ``SHINGLE`` words (fewer words: all of them), held as its XXH3
value of 128 bits. Candidates are found as in ``simhash``, by SimHashes and the generalised pigeonhole with thresholds
for each text. A pair of similarity 0.8 differs in 15 % of the bits of one SimHash over all shingles, and at that radius
parts of its bits exclude next to nothing. So shingles are dealt into parts by their hash, and a text's fingerprint is
the SimHash of each part, 64 bits that depend on the same shingles and are one part of the pigeonhole. Sets of up to n
shingles and the similarity differ in at most r = (1 - SIMILAR) / (1 + SIMILAR) * 2 n shingles, and so in at most r of
somewhat more than r + 1 parts. If each part i has a threshold t_i of -1 or 0 with the sum of (t_i + 1) equal to r + 1,
some part of threshold 0 has the same SimHash. (Higher thresholds would probe a part's SimHash with any shingle added.)
Each text gets its own thresholds: the dynamic programme of ``simhash`` minimises the estimated candidates, the
estimate being a histogram of the parts' values over all texts (2^``BUCKET_BITS`` buckets a part). A text is indexed in
each part and probes those of threshold 0; so parts that hold no shingle, or one that many texts have, are seldom probed.
Sizes are in classes that grow by 25/16; a text near the lower end of the next class is dealt by that one, too.
Of over ``KEYS`` parts the first ``KEYS`` are indexed and ``PROBED`` of them probed: each is in common with a chance
of 0.37 or more, so that all are missed once in 10^9 pairs at the similarity itself.

What meets in a part and differs in at most ``RADIUS`` of the 128 bits of the SimHash over all shingles (``SHORT_RADIUS``
with ``SHORT`` or fewer) is a candidate. What candidates connect is verified: the shingle sets of a connected group meet and exact
similarities are taken, pair by pair, but for pairs already linked.

Skew: texts of the same shingle set are one node. Values that nothing probes, and those of one row, go before rows are sorted. A part that over ``BLOCK`` nodes have is dealt out as pairs of blocks.
A group of more than ``GROUP`` sets is dealt into blocks that each also hold the group's first set; only if that
doesn't link all of them do blocks meet each other.

Defined results: a null text counts as empty, and empty texts are copies of each other; rows of one doc_id count as
one document; a null doc_id links nothing and stays; repeated rows stay.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.arrow import cut, map_rows
from quern.llm.components import components
from quern.llm.simhash import thresholds

SIMILAR, SHINGLE, SEED = 0.8, 5, 42
RADIUS, SHORT, SHORT_RADIUS = 34, 16, 42
KEYS, PROBED, BUCKET_BITS, BLOCK, SMALL, GROUP = 56, 48, 10, 4096, 24, 256
ODD = np.uint64(0x9E3779B97F4A7C15)


def class_bounds(most: int = 1 << 40) -> list[int]:
    """Least sizes of the classes."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, out[-1] * 25 // 16))
    return out


BOUNDS = class_bounds()


def shingles(text: str | None) -> np.ndarray:
    """[shingle, half] of the distinct shingles' values, by their first halves."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros((0, 2), np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
    digest = xxhash.xxh3_128_digest
    found = np.frombuffer(b"".join({digest(s, SEED) for s in runs}), np.uint64).reshape(-1, 2)
    return found[np.argsort(found[:, 0])]


def classes(n: int) -> list[int]:
    """Classes by which a set of n shingles is dealt: its own, and the next where that may hold its like."""
    c = bisect_right(BOUNDS, n) - 1
    return [] if n == 0 else [c, c + 1] if n >= SIMILAR * BOUNDS[c + 1] - 1e-9 else [c]


def layout(c: int) -> tuple[int, int, int]:
    """(parts, parts indexed, parts probed) of a class; none where only equal sets are that similar."""
    r = int((1 - SIMILAR) / (1 + SIMILAR) * 2 * (BOUNDS[c + 1] - 1) + 1e-9)
    parts = -(-12 * (r + 1) // 10) + 2
    return (0, 0, 0) if not r else (parts, parts, r + 1) if parts <= KEYS else (parts, KEYS, min(PROBED, r + 1))


def part_keys(own: np.ndarray) -> np.ndarray:
    """Keys of all parts that are indexed, class by class."""
    return np.concatenate([np.zeros(0, np.uint64), *(keys_of(own, c) for c in classes(len(own)))])


def keys_of(own: np.ndarray, c: int) -> np.ndarray:
    """The SimHash of each part, as one value with the number of the part and the class."""
    parts, indexed, _ = layout(c)
    if not parts:
        return np.zeros(0, np.uint64)
    part = (own[:, 1] % np.uint64(parts)).astype(np.int64)
    use = np.flatnonzero(part < indexed)
    use = use[np.argsort(part[use], kind="stable")]
    size = np.bincount(part[use], minlength=indexed)
    upto = np.zeros((len(use) + 1, 64), np.int32)
    np.cumsum(np.unpackbits(own[use, :1].view(np.uint8), axis=1), axis=0, dtype=np.int32, out=upto[1:])
    last = np.cumsum(size)
    bits = upto[last] - upto[last - size]
    held = np.packbits(2 * bits > size[:, None], axis=1).view(np.uint64)[:, 0]
    key = (held ^ (np.arange(indexed, dtype=np.uint64) + np.uint64(c << 32) + np.uint64(1)) * ODD) * ODD
    return key ^ (key >> np.uint64(29))


def signature(text: str | None) -> tuple[int, int, int, int, bytes]:
    """(size, two halves of the SimHash, XXH64 of the set, keys of its parts), signed."""
    own = shingles(text)
    counts = sum((np.unpackbits(own[i : i + 50_000].view(np.uint8), axis=1).sum(0, dtype=np.int64) for i in range(0, len(own), 50_000)), np.zeros(128, np.int64))
    low, high = np.packbits(2 * counts > len(own)).view(np.int64)
    key = np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).astype(np.int64)
    return len(own), int(low), int(high), int(key), part_keys(own).tobytes()


def signatures(docs: DataFrame) -> DataFrame:
    def run(rows: dict) -> dict:
        size, low, high, key, parts = zip(*map(signature, rows["text"]), strict=True)
        return {"doc_id": rows["doc_id"], "size": size, "low": low, "high": high, "key": key, "parts": parts}

    return map_rows(docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text"), run, "doc_id long, size long, low long, high long, key long, parts binary")


class Trees:
    """Least member of each connected part of 0 .. n - 1."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.label[a], self.label[b]
        for x, y in {(int(x), int(y)) for x, y in np.unique(np.stack([a, b], 1)[a != b], axis=0)}:
            x, y = sorted((int(self.label[x]), int(self.label[y])))
            self.label[self.label == y] = x

    def edges(self, node: np.ndarray) -> pa.RecordBatch:
        own = np.flatnonzero(self.label != np.arange(len(self.label)))
        return pa.RecordBatch.from_pydict({"a": node[self.label[own]], "b": node[own]})


def grouped(fn: Callable[[list[np.ndarray]], pa.RecordBatch], keys: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fn`` over the other columns of each run of rows that are equal in the first ``keys``; the rows are sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            now = [np.concatenate(x) for x in zip(held, now, strict=True)] if held else now
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in now[:keys]], axis=0)) + 1
            for s, e in zip([0, *new[:-1]], new, strict=False):
                yield fn([c[s:e] for c in now[keys:]])
            held = [c[new[-1] if len(new) else 0 :] for c in now]
        if held and len(held[0]):
            yield fn(held[keys:])

    return run


def close(size: np.ndarray, low: np.ndarray, high: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) may have the similarity."""
    differ = np.bitwise_count(low[i] ^ low[j]) + np.bitwise_count(high[i] ^ high[j])
    small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
    return (differ <= np.where(small <= SHORT, SHORT_RADIUS, RADIUS)) & (small >= SIMILAR * large - 1e-9)


def meet(columns: list[np.ndarray]) -> pa.RecordBatch:
    """Edges that connect what the candidate pairs of one large group do. side: 0 and 1 meet, 2 meets all of its own."""
    side, node, size, low, high = columns
    low, high = low.view(np.uint64), high.view(np.uint64)
    one, two = (np.flatnonzero(side != k) for k in (1, 0))
    trees = Trees(len(node))
    for k in range(0, len(one), 32):
        i, j = (x.ravel() for x in np.meshgrid(one[k : k + 32], two, indexing="ij"))
        apart = trees.label[i] != trees.label[j]
        i, j = i[apart], j[apart]
        hit = close(size, low, high, i, j)
        trees.link(i[hit], j[hit])
    return trees.edges(node)


def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of the groups (met, block) in sorted rows; small groups all at once."""
    held = None
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        now = [np.concatenate(x) for x in zip(held, now, strict=True)] if held else now
        new = np.flatnonzero((now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])) + 1
        done = int(new[-1]) if len(new) else 0
        held = [c[done:] for c in now]
        if done:
            yield from groups([c[:done] for c in now], np.concatenate([[0], new]))
    if held and len(held[0]):
        yield from groups(held, np.array([0, len(held[0])]))


def groups(now: list[np.ndarray], bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    side, node, size, low, high = now[2:]
    many = np.diff(bounds)
    last = np.repeat(bounds[1:], many)
    last[np.repeat((many > SMALL), many) | (side != 2)] = 0  # below
    at = np.arange(len(node))
    one, two = low.view(np.uint64), high.view(np.uint64)
    for d in range(1, SMALL):
        at = at[at + d < last[at]]
        if not len(at):
            break
        hit = at[close(size, one, two, at, at + d)]
        yield pa.RecordBatch.from_pydict({"a": node[hit], "b": node[hit + d]})
    for k in np.flatnonzero((many > SMALL) | (side[bounds[:-1]] != 2)):
        yield meet([c[bounds[k] : bounds[k + 1]] for c in now[2:]])


def by_class(size: list[int], parts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(class, rows, [row, part] keys) of sets with the given sizes and keys."""
    rows: dict[int, list] = {}
    for i, (n, held) in enumerate(zip(size, parts, strict=True)):
        at = 0
        for c in classes(n):
            if end := layout(c)[1]:
                rows.setdefault(c, []).append((i, np.frombuffer(held, np.uint64)[at : at + end]))
                at += end
    for c, found in rows.items():
        yield c, np.array([i for i, _ in found]), np.stack([k for _, k in found])


def bucket(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def histogram(nodes: DataFrame) -> np.ndarray:
    """[part, bucket]: how many values of a part, over all sets and classes, are in a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(KEYS << BUCKET_BITS, np.int64)
        for batch in batches:
            for _, _, keys in by_class(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own += np.bincount((bucket(keys) + (np.arange(keys.shape[1]) << BUCKET_BITS)).ravel(), minlength=len(own))
        at = own.nonzero()[0]
        yield pa.RecordBatch.from_pydict({"at": at, "n": own[at]})

    counts = np.zeros(KEYS << BUCKET_BITS)
    found = nodes.select("size", "parts").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts[found["at"].to_numpy()] = found["n"].to_numpy()
    return counts.reshape(KEYS, -1)


def probed(c: int, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """[row, part]: whether the threshold of the part is 0 and not -1."""
    price = np.zeros((*keys.shape, 2))
    price[:, :, 1] = counts[np.arange(keys.shape[1]), bucket(keys)]
    return thresholds(price, layout(c)[2] - 1) == 0


def candidates(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) that connect nodes (node, size, low, high, parts) that meet in a part and whose fingerprints are close."""
    counts = histogram(nodes)

    def run(batches: Iterator[pa.RecordBatch], probes: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2_000):
                part = batch.slice(k, 2_000)
                for c, own, keys in by_class(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    met, rows = keys.ravel().view(np.int64), pa.array(np.repeat(own, keys.shape[1]))
                    kept = {"probe": probed(c, keys, counts).ravel().astype(np.int8)} if probes else {n: part.column(n).take(rows) for n in ("node", "size", "low", "high")}
                    yield pa.RecordBatch.from_pydict({"met": met, **kept})

    some = nodes.where("size > 0")
    probes = some.select("size", "parts").mapInArrow(lambda batches: run(batches, True), "met long, probe byte")
    rows = some.select("size", "parts", "node", "low", "high").mapInArrow(lambda batches: run(batches, False), "met long, node long, size long, low long, high long")
    often = probes.groupBy("met").agg(F.count("*").alias("n"), F.max("probe").alias("probe")).where("n > 1 AND probe > 0").select(F.col("met").alias("of"), F.when(F.col("n") > BLOCK, F.ceil(F.col("n") / (BLOCK // 2))).otherwise(1).alias("blocks"))
    found = rows.join(often, F.col("met") == F.col("of"))
    whole = found.where("blocks = 1").select("met", F.lit(0).cast("long").alias("block"), F.lit(2).cast("long").alias("side"), "node", "size", "low", "high")
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    dealt = found.where("blocks > 1").withColumn("own", own).select("*", F.explode(every).alias("other"))
    side = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int")).cast("long")
    pairs = dealt.select("met", (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other") + 1).alias("block"), side.alias("side"), "node", "size", "low", "high")
    return whole.unionByName(pairs).repartition("met", "block").sortWithinPartitions("met", "block").mapInArrow(meetings, "a long, b long").distinct()


def alike(one: np.ndarray, two: np.ndarray) -> bool:
    """Whether two sorted sets have the similarity."""
    small, large = sorted((len(one), len(two)))
    if small < SIMILAR * large - 1e-9:
        return False
    both = len(np.intersect1d(one, two, assume_unique=True))
    return both >= SIMILAR * (small + large - both) - 1e-9


def similar(columns: list[np.ndarray]) -> pa.RecordBatch:
    """Edges that connect what exact similarities do. side: as in ``close``."""
    side, node, sets = columns
    sets, trees = [np.frombuffer(s, np.uint64) for s in sets], Trees(len(node))
    one, two = (np.flatnonzero(side != k) for k in (1, 0))
    for i in one:
        for j in two[two > i] if side[i] == 2 else two:
            if trees.label[i] != trees.label[j] and alike(sets[i], sets[j]):
                trees.link(np.array([i]), np.array([j]))
    return trees.edges(node)


def verified(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges (a, b) between nodes of a group (node, root) that connect what exact similarities do."""
    run = lambda rows: {"root": rows["root"], "node": rows["node"], "held": [shingles(t)[:, 0].tobytes() for t in rows["text"]]}
    every = groups.select("node", "root").union(groups.select(F.col("root").alias("node"), "root")).distinct()
    texts = docs.selectExpr("CAST(doc_id AS BIGINT) AS node", "text").join(every, "node").select("root", "node", "text")
    counts = every.groupBy("root").agg(F.ceil(F.count("*") / GROUP).alias("blocks"))
    sets = map_rows(texts, run, "root long, node long, held binary").join(counts, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    spread = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    together = lambda rows: rows.repartition("root", "block").sortWithinPartitions("root", "block").mapInArrow(grouped(similar, 2), "a long, b long")
    own = sets.where("node <> root OR blocks = 1").select("root", "block", F.lit(2).cast("long").alias("side"), "node", "held")
    first = sets.where("node = root AND blocks > 1").select("root", F.explode(spread(F.col("blocks"))).alias("block"), F.lit(2).cast("long").alias("side"), "node", "held")
    edges = cut(together(own.unionByName(first)))
    large = cut(every.join(counts.where("blocks > 1"), "root"))
    if large.isEmpty():
        return edges
    parts = components(edges)
    apart = large.join(parts.withColumnsRenamed({"node": "of", "root": "part"}), F.col("node") == F.col("of"), "left").groupBy("root").agg(F.count_distinct(F.coalesce("part", "node")).alias("parts")).where("parts > 1").select("root")
    rest = sets.join(cut(apart), "root").select("root", F.explode(spread(F.col("blocks"))).alias("other"), "block", "blocks", "node", "held").where("other <> block")
    pairs = rest.select("root", (F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")).alias("block"), (F.col("block") > F.col("other")).cast("long").alias("side"), "node", "held")
    return edges.union(cut(together(pairs)))


def linked(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) for each row of ``docs`` (doc_id, text) with a doc_id."""
    made = cut(signatures(docs).where("doc_id IS NOT NULL"))
    nodes = cut(made.groupBy("key", "size").agg(F.min("doc_id").alias("node"), *(F.first(c).alias(c) for c in ("low", "high", "parts"))))
    roots = components(cut(verified(docs, components(cut(candidates(nodes))))))
    known = cut(nodes.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select(F.col("key").alias("known"), F.coalesce("root", "node").alias("component_id")))
    return made.join(known, F.col("key") == F.col("known")).select("doc_id", "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, without the documents linked to one of a smaller id. A null doc_id stays."""
    gone = cut(linked(docs).where("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")
