"""Benchmark decontamination: a BM25 index of test items, block-max WAND, and a check of the overlap.

Items are normalised to lower-case words ``\\w+``. Postings hold BM25 weights divided by the item's score against
itself, so that a passage's score of an item lies near 0 to 1 and one threshold serves all. Every document is cut
into passages of two chunks, each step one chunk on; a chunk is as long as the longest item (a power of two of 64
words or more, items of other lengths having their own index), so that some passage holds any copy whole.

Each passage is a query. All passages of a slice of documents first add up block maxima: a term's postings lie in
blocks of ``BLOCK`` items, a term in over a quarter of the blocks counts with its largest weight instead, and a
(passage, block) below the threshold is skipped. What is left goes through WAND proper: cursors sorted by item, a
pivot by term maxima, a second test by block maxima with a jump past the block, and a score if both pass.

Every item above the threshold is verified: at least ``OVERLAP`` of the word shingles of five of its question (all
lines but the last), and as much of those of its answer (the last line, if there are several), must occur in the
passage. A question or answer of fewer than five words must occur whole, as a run of words.

Document frequencies, the number of items and their mean length are those of all items. An index is built on the
driver from about ``SHARD_CHARS`` characters of items; more items make more shards. Each is run over all documents
and its result written before the next is built, so the driver holds one shard at a time.

Defined results: items without a word, null items and null or empty texts match nothing; equal item texts share the
verdict, each under its item_id; repeated rows stay; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.arrow import cut, read_table, slices
from quern.llm.kept import Kept

K1, B = 1.2, 0.75
THRESHOLD, OVERLAP, SHINGLE = 0.5, 0.8, 5
BLOCK, CHUNK, SHARD_CHARS, CELLS = 8, 64, 2_000_000, 4_000_000

words_of = re.compile(r"\w+").findall


def shingles(words: list[str], n: int = SHINGLE) -> set[tuple[str, ...]]:
    """Runs of n words; fewer words: all of them, none: none."""
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


class Statistics:
    """Number and mean length of all distinct items, and in how many of them a word is."""

    def __init__(self, n: int, mean: float, df: dict[str, int]):
        self.n, self.mean, self.df = n, max(mean, 1e-9), df

    @staticmethod
    def of(texts: Iterable[str]) -> Statistics:
        bags = [words_of(t.lower()) for t in texts]
        return Statistics(len(bags), sum(map(len, bags)) / max(1, len(bags)), Counter(w for bag in bags for w in set(bag)))

    def weight(self, word: str, count: int, length: int) -> float:
        """BM25 weight of a word in an item."""
        df = self.df[word]
        return math.log(1 + (self.n - df + 0.5) / (df + 0.5)) * count * (K1 + 1) / (count + K1 * (1 - B + B * length / self.mean))


class Index:
    """An inverted index of items of one length class."""

    def __init__(self, texts: dict[str, list[int]], chunk: int, statistics: Statistics):
        """texts: distinct item texts and the ids that have them."""
        self.chunk = chunk
        self.items = list(texts.items())
        lines = [t.lower().rstrip().rsplit("\n", 1) for t, _ in self.items]
        self.question = [shingles(words_of(p[0])) for p in lines]
        self.answer = [shingles(words_of(p[1])) if len(p) > 1 else set() for p in lines]
        bags = [Counter(words_of(t.lower())) for t, _ in self.items]
        n = len(bags)
        self.terms = {w: i + 1 for i, w in enumerate(sorted({w for bag in bags for w in bag}))}
        posts: list[list[tuple[int, float]]] = [[] for _ in range(len(self.terms) + 1)]
        for k, bag in enumerate(bags):
            weight = {w: statistics.weight(w, c, bag.total()) for w, c in bag.items()}
            whole = sum(weight.values())
            for w, x in weight.items():
                posts[self.terms[w]].append((k, x / whole))
        self.posts = [(np.array([k for k, _ in p], np.int64), np.array([x for _, x in p])) for p in posts]
        # block maxima: (block, largest weight) of each term, and the largest of all
        self.most = np.array([x.max() if len(x) else 0.0 for _, x in self.posts])
        self.blocks = []
        for items, x in self.posts:
            top: dict[int, float] = defaultdict(float)
            for k, v in zip((items // BLOCK).tolist(), x.tolist(), strict=True):
                top[k] = max(top[k], v)
            self.blocks.append(top)
        self.n_blocks = n // BLOCK + 1
        often = np.array([len(b) > max(4, self.n_blocks / 4) for b in self.blocks])
        self.flat = np.where(often, self.most, 0.0)
        # no item gets more from those terms than it holds of them
        common = np.zeros(n + BLOCK)
        for t in np.flatnonzero(often):
            common[self.posts[t][0]] += self.posts[t][1]
        self.common = common[:n]
        self.cap = common[: self.n_blocks * BLOCK].reshape(-1, BLOCK).max(1) if n else np.zeros(1)
        sparse = [() if o else tuple(b.items()) for b, o in zip(self.blocks, often, strict=True)]
        self.first = np.concatenate([[0], np.cumsum([len(s) for s in sparse])])
        self.at_block = np.array([k for s in sparse for k, _ in s], np.int64)
        self.at_most = np.array([v for s in sparse for _, v in s])
        # the postings of each (term, block) of the sparse terms
        rare = [p for p, o in zip(self.posts, often, strict=True) if not o and len(p[0])]
        self.item = np.concatenate([p[0] for p in rare] or [np.zeros(0, np.int64)])
        self.weight = np.concatenate([p[1] for p in rare] or [np.zeros(0)])
        owner = np.repeat(np.arange(len(rare)), [len(p[0]) for p in rare])
        new = np.flatnonzero(np.diff(owner * self.n_blocks + self.item // BLOCK, prepend=-1))
        self.post_first = np.append(new, len(self.item))

    def promising(self, chunk: np.ndarray, term: np.ndarray, n_chunks: int) -> np.ndarray:
        """Chunks c whose passage (c, c + 1) can reach the threshold for some item. chunk, term: distinct pairs, sorted.

        First by block maxima, for all passages and blocks at once; in the blocks left, by the items' own weights.
        What an item can get from frequent terms is at most what it holds of them.
        """
        flat = np.bincount(chunk, self.flat[term], n_chunks + 1)
        flat = flat[:-1] + flat[1:]
        size = self.first[term + 1] - self.first[term]
        owner = np.repeat(chunk, size)
        place = np.repeat(self.first[term] - np.cumsum(size) + size, size) + np.arange(size.sum())
        block, need = self.at_block[place], THRESHOLD - 1e-9
        out = [np.flatnonzero(np.minimum(flat, self.common.max(initial=0.0)) >= need)]
        step = max(1, CELLS // self.n_blocks)
        for low in range(0, n_chunks, step):
            n = min(step, n_chunks - low)
            s, e = np.searchsorted(owner, [low, low + n + 1])
            o, b, at = owner[s:e] - low, block[s:e], place[s:e]
            bound = np.bincount(o * self.n_blocks + b, self.at_most[at], (n + 1) * self.n_blocks).reshape(n + 1, self.n_blocks)
            live = bound[:-1] + bound[1:] + np.minimum(flat[low : low + n, None], self.cap[None]) >= need
            if not live.any():
                continue
            one = np.flatnonzero(live[np.minimum(o, n - 1), b] & (o < n))
            two = np.flatnonzero(live[np.maximum(o - 1, 0), b] & (o > 0))
            entries = len(self.at_block)
            key = np.unique(np.concatenate([o[one] * entries + at[one], (o[two] - 1) * entries + at[two]]))
            passage, entry = key // entries, key % entries
            size = self.post_first[entry + 1] - self.post_first[entry]
            post = np.repeat(self.post_first[entry] - np.cumsum(size) + size, size) + np.arange(size.sum())
            pair = np.repeat(passage, size) * len(self.items) + self.item[post]
            order = np.argsort(pair, kind="stable")
            pair = pair[order]
            new = np.flatnonzero(np.diff(pair, prepend=-1))
            score = np.add.reduceat(self.weight[post][order], new) if len(new) else np.zeros(0)
            passage, item = pair[new] // len(self.items), pair[new] % len(self.items)
            out.append(passage[score + np.minimum(flat[low + passage], self.common[item]) >= need] + low)
        return np.unique(np.concatenate(out))

    def wand(self, terms: list[int], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """Every (item, score) of at least the threshold for a query of distinct terms, by block-max WAND."""
        end = len(self.items)
        cursors = [[int(self.posts[t][0][0]), t, 0] for t in terms if len(self.posts[t][0])]
        found = []

        def advance(c: list[int], to: int) -> None:
            items = self.posts[c[1]][0]
            c[2] += int(np.searchsorted(items[c[2] :], to))
            c[0] = int(items[c[2]]) if c[2] < len(items) else end

        while True:
            cursors = sorted(c for c in cursors if c[0] < end)
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                bound += self.most[c[1]]
                if bound >= threshold - 1e-12:
                    pivot = i
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK
            if sum(self.blocks[c[1]].get(block, 0.0) for c in cursors[: pivot + 1]) < threshold - 1e-12:
                to = (block + 1) * BLOCK
                if pivot + 1 < len(cursors):
                    to = min(to, cursors[pivot + 1][0])
                for c in cursors[: pivot + 1]:
                    advance(c, max(to, item + 1))
            elif cursors[0][0] == item:
                score = sum(float(self.posts[c[1]][1][c[2]]) for c in cursors[: pivot + 1])
                if score >= threshold - 1e-12:
                    found.append((item, score))
                for c in cursors[: pivot + 1]:
                    advance(c, item + 1)
            else:
                for c in cursors[:pivot]:
                    if c[0] < item:
                        advance(c, item)

    def verified(self, words: list[str]) -> list[tuple[int, float, float, float, float]]:
        """(item, score, overlap, of the question, of the answer) of each item that a passage holds."""
        out = []
        hits = self.wand(sorted({self.terms[w] for w in words if w in self.terms}))
        own = shingles(words) if hits else set()
        for item, score in hits:
            q, a = self.question[item], self.answer[item]
            short = {s for s in q | a if len(s) < SHINGLE}
            here = own | {s for n in {len(s) for s in short} for s in shingles(words, n)} if short else own
            shared = len(q & here), len(a & here)
            if shared[0] >= OVERLAP * len(q) and shared[1] >= OVERLAP * len(a):
                out.append((item, score, sum(shared) / (len(q) + len(a)), shared[0] / len(q) if q else 1.0, shared[1] / len(a) if a else 1.0))
        return out


def build(items: list[tuple[int, str]], statistics: Statistics | None = None) -> list[Index]:
    """An index for each length class of (item_id, text). statistics: of all items, if these are but some."""
    classes: dict[int, dict[str, list[int]]] = defaultdict(dict)
    for item_id, text in items:
        if n := len(words_of(text.lower())):
            classes[max(CHUNK, 1 << (n - 1).bit_length())].setdefault(text, []).append(item_id)
    statistics = statistics or Statistics.of({t for texts in classes.values() for t in texts})
    return [Index(texts, chunk, statistics) for chunk, texts in sorted(classes.items())]


class Scanner:
    """Applies one index to slices of documents."""

    def __init__(self, index: Index):
        self.index, self.several = index, []
        self.of_run = Kept(self.numbered, 100_000)

    def numbered(self, run: str) -> int:
        """The term of a run without white space (0: none of the index); below 0: its place among those of several words."""
        words = words_of(run)
        if len(words) == 1:
            return self.index.terms.get(words[0], 0)
        self.several.append([self.index.terms.get(w, 0) for w in words])
        return -len(self.several)

    def scan(self, texts: list[str | None]) -> list[list[tuple[int, float, float, float, float]]]:
        """For each text, its verified items, each with its best passage."""
        index, out = self.index, [[] for _ in texts]
        terms, chunks, starts, n_chunks = [], [], [], 0
        if len(self.several) > 200_000:
            self.several, self.of_run = [], Kept(self.numbered, 100_000)
        for text in texts:
            ids = np.array(list(map(self.of_run.__getitem__, (text or "").lower().split())), np.int64)
            if len(ids) and ids.min() < 0:
                ids = np.array([t for i in ids.tolist() for t in (self.several[-i - 1] if i < 0 else (i,))], np.int64)
            terms.append(ids)
            chunks.append(np.arange(len(ids)) // index.chunk + n_chunks)
            starts.append(n_chunks)
            n_chunks += len(ids) // index.chunk + 2  # one empty chunk parts two documents
        term, chunk = np.concatenate(terms), np.concatenate(chunks)
        pairs = np.unique((chunk * len(index.posts) + term)[term > 0])
        at = index.promising(pairs // len(index.posts), pairs % len(index.posts), n_chunks)
        owner = np.searchsorted(np.array(starts), at, side="right") - 1
        for k in np.unique(owner).tolist():
            words = words_of(texts[k].lower()) if texts[k] else []
            best: dict[int, tuple] = {}
            for c in (at[owner == k] - starts[k]).tolist():
                for hit in index.verified(words[c * index.chunk : (c + 2) * index.chunk]):
                    best[hit[0]] = max(best.get(hit[0], hit), hit, key=lambda h: h[1:])
            out[k] = sorted(best.values())
        return out


def frequencies(items: DataFrame) -> DataFrame:
    """(word, n, total) over distinct item texts: in how many a word is; the null word: how many texts with a word, and of how many words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 256, 1_500_000):
                bags = [b for t in part.column(0).to_pylist() if (b := words_of(t.lower()))]
                words = [w for b in bags for w in set(b)]
                yield pa.RecordBatch.from_pydict({"word": pa.array([None] * len(bags) + words, pa.string()), "n": pa.array([1] * (len(bags) + len(words)), pa.int64()), "total": pa.array([len(b) for b in bags] + [0] * len(words), pa.int64())})

    return items.select("text").distinct().mapInArrow(run, "word string, n long, total long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def indexes(benchmark: DataFrame) -> tuple[int, Iterator[list[Index]]]:
    """The number of shards, and the indexes of one after the other."""
    items = benchmark.where("text IS NOT NULL").selectExpr("CAST(item_id AS BIGINT) AS item_id", "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, math.ceil(chars / SHARD_CHARS))
    in_order = lambda df: sorted(((r["item_id"], r["text"]) for r in df.collect()), key=lambda x: (x[1], x[0] is None, x[0]))

    def each() -> Iterator[list[Index]]:
        if shards == 1:
            yield build(in_order(items))
            return
        counts = cut(frequencies(items))
        n, total = counts.where("word IS NULL").select("n", "total").first()
        for k in range(shards):
            own = in_order(items.where(F.pmod(F.xxhash64("text"), F.lit(shards)) == k))
            words = items.sparkSession.createDataFrame([(w,) for w in sorted({w for _, t in own for w in words_of(t.lower())})], "own string")
            df = {r["word"]: r["n"] for r in counts.join(words, F.col("word") == F.col("own")).select("word", "n").collect()}
            yield build(own, Statistics(n, total / max(1, n), df))

    return shards, each()


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, overlap, question_overlap, answer_overlap): every item that a document holds."""
    schema = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"
    whole = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    shards, each = indexes(benchmark)
    found = None
    for shard in each:

        def run(batches: Iterator[pa.RecordBatch], shard: list[Index] = shard) -> Iterator[pa.RecordBatch]:
            scanners = [Scanner(index) for index in shard]
            for batch in batches:
                for part in slices(batch, 256, 1_500_000):
                    ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                    rows = [(i, item_id, *hit[1:]) for s in scanners for i, hits in zip(ids, s.scan(texts), strict=True) for hit in hits for item_id in s.index.items[hit[0]][1]]
                    if rows:
                        yield pa.RecordBatch.from_pydict(dict(zip(("doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"), zip(*rows, strict=True), strict=True)))

        one = whole.mapInArrow(run, schema)
        one = cut(one) if shards > 1 else one
        found = one if found is None else found.unionByName(one)
    return found


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold an item."""
    shards, each = indexes(benchmark)
    for shard in each:
        place = docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch], shard: list[Index] = shard, place: int = place) -> Iterator[pa.RecordBatch]:
            scanners = [Scanner(index) for index in shard]
            for batch in batches:
                for part in slices(batch, 256, 1_500_000):
                    texts = part.column(place).to_pylist()
                    hits = [s.scan(texts) for s in scanners]
                    yield part.filter(pa.array([not any(h[i] for h in hits) for i in range(len(texts))]))

        docs = docs.mapInArrow(run, docs.schema)
        docs = cut(docs) if shards > 1 else docs
    return docs


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
