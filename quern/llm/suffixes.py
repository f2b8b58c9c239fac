"""Removal of repeated 50-byte strings with a logarithmic family of suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller id. Texts are
cut into chunks of about ``CHUNK`` bytes; the strings are judged where their content sends them:

1. Each string has an anchor: of its ``WORD``-byte words, the one of the least hash. Equal strings have equal anchors,
   and neighbouring strings mostly share one, so about one byte in 18 is an anchor. A chunk sends the distinct hashes
   of its anchors, as sorted arrays, to buckets by range of hash; a bucket answers with one bit for each: met in
   another chunk or not. It also adds up how many different contexts each has (2.) in the chunks, and answers which
   have more than ``HOT``.
2. For each anchor that has met another (or another document of the chunk), the chunk sends its context, the
   bytes of all strings that have the anchor, once for each distinct context, with the smallest id. A document that
   holds a context which a smaller id of its chunk has too needs no answer. The strings of a hot anchor, a phrase amid
   ever other text, are sent one by one instead, each to the bucket of its own hash.
3. A bucket takes contexts by ascending id, in batches of documents. A batch gets a suffix array: its places sorted by
   the ``LENGTH`` bytes that start there. It is scanned against the sorted levels of all batches before it, whose ids
   are smaller, string after string from where the last one was found by bisection, and what neither a level nor a smaller id of the batch has becomes a level. Levels of
   one size class merge, so that n strings are in O(log n) levels. A chunk gets one bit for each string it sent.
4. The chunk marks the bytes and returns its documents.

Shuffles hold 4 bytes for each anchor, compressed contexts of met anchors, bits, and the compressed texts twice (to meet the
answers). A text that a third of all rows share travels once for each chunk, not for each row. A bucket holds the
anchors of about ``BUCKET`` bytes of text, and no anchor fills one, as the hot are split. Hashes only choose places; strings are compared byte by byte.

Defined results: a null text counts as empty; rows of one id are one document's parts, which remove nothing from each
other; a null id removes nothing and loses nothing; repeated rows stay; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.arrow import cut, read_table

LENGTH, WORD = 50, 16
SPAN = LENGTH - WORD + 1
WIDEST = LENGTH + SPAN - 1
CHUNK, BUCKET, BATCH, HOT, LEVEL = 6_000_000, 8_000_000, 1 << 16, 1 << 15, 5
OFTEN, BLOCK = 4, 1 << 15


def pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)


def chunks(docs: DataFrame, most: int = CHUNK) -> DataFrame:
    """(chunk, n_docs, n_bytes, ids, null_ids, sizes, text): documents of one task, about ``most`` bytes a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def row() -> pa.RecordBatch:
            ids = [i for i, _ in held]
            return pa.RecordBatch.from_pydict(
                {
                    "chunk": pa.array([number], pa.int64()), "n_docs": pa.array([len(held)], pa.int64()), "n_bytes": pa.array([size], pa.int64()),
                    "ids": [pack(np.array([i or 0 for i in ids], np.int64))], "null_ids": [pack(np.array([i is None for i in ids], bool))],
                    "sizes": [pack(np.array([len(t) for _, t in held], np.int64))], "text": [zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(t for _, t in held))],
                }
            )

        for batch in batches:
            texts = batch.column(1)
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                text = texts[i].as_py() or b""
                if held and size + len(text) > most:
                    yield row()
                    number, held, size = number + 1, [], 0
                held.append((doc_id, text))
                size += len(text)
        if held:
            yield row()

    raw = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS BINARY) AS text")
    return raw.mapInArrow(run, "chunk long, n_docs long, n_bytes long, ids binary, null_ids binary, sizes binary, text binary")


class Chunk:
    """A chunk's bytes and the anchors of its strings."""

    def __init__(self, row: dict):
        self.ids = unpack(row["ids"]).view(np.int64)
        self.null_ids = unpack(row["null_ids"]).view(bool)
        self.sizes = unpack(row["sizes"]).view(np.int64)
        self.text = unpack(row["text"])
        self.ends = np.cumsum(self.sizes)

    def anchor(self) -> None:
        """first, last: the strings that have an anchor in a document; doc; key: of the anchor's word."""
        first, last, at = anchors(self.text)
        # runs of strings end with their document
        doc = np.searchsorted(self.ends, first, side="right")
        stop = self.ends[np.minimum(doc, len(self.ends) - 1)] - LENGTH
        parts = [(first, np.minimum(last, stop), at, doc)]
        over = np.flatnonzero(last > stop)
        while len(over):  # a run over a boundary goes on in the next document
            f, e, a, d = first[over], last[over], at[over], doc[over]
            d = d + 1
            ok = d < len(self.ends)
            f, e, a, d = f[ok], e[ok], a[ok], d[ok]
            begin = self.ends[d] - self.sizes[d]
            f = np.maximum(f, begin)
            parts.append((f, np.minimum(e, self.ends[d] - LENGTH), a, d))
            first, last, at, doc = f, e, a, d
            over = np.flatnonzero(last > self.ends[d] - LENGTH)
        first, last, at, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
        ok = first <= last
        ok[ok] = ~self.null_ids[doc[ok]]
        self.first, self.last, self.doc = first[ok], last[ok], doc[ok]
        self.key = scattered(word_hashes(self.text, at[ok]))
        order = np.argsort(self.key, kind="stable")
        ranked = self.key[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, bool)
        self.keys = ranked[new]
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(new) - 1
        own = self.ids[self.doc[order]]
        differs = np.concatenate([[False], ~new[1:] & (own[1:] != own[:-1])]) if len(order) else np.zeros(0, bool)
        self.met_here = np.zeros(len(self.keys), bool)
        self.met_here[(np.cumsum(new) - 1)[differs]] = True


    def contexts(self) -> np.ndarray:
        """How many different contexts each key has; up to ``OFTEN`` places, copies are not looked for."""
        times = np.bincount(self.number, minlength=len(self.keys))
        some = np.flatnonzero(times[self.number] > OFTEN)
        if len(some):
            both = string_hashes(self.text, self.first[some]) * C3 + string_hashes(self.text, self.last[some])
            number = self.number[some]
            order = np.lexsort((both, number))
            number, both = number[order], both[order]
            new = np.concatenate([[True], (number[1:] != number[:-1]) | (both[1:] != both[:-1])])
            times[number] = 0
            np.add.at(times, number[new], 1)
        return times


C1, C2, C3, C4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0xFF51AFD7ED558CCD))


def hashed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * C1
    h ^= h >> np.uint64(32)
    h += b
    h *= C2
    h ^= h >> np.uint64(29)
    h *= C3
    h ^= h >> np.uint64(32)
    return h


def eights(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as one integer."""
    return np.ndarray((max(0, len(text) - 7),), np.dtype("<u8"), text, 0, (1,))


def word_hashes(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    w = eights(text)
    return hashed(w[at], w[at + 8]) if len(at) else np.zeros(0, np.uint64)


def string_hashes(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the ``LENGTH`` bytes from each place."""
    w, h = eights(text), np.zeros(len(at), np.uint64)
    for k in (0, 16, 32):
        h = hashed(h ^ w[at + k], w[at + k + 8]) if len(at) else h
    return scattered(hashed(h, w[at + LENGTH - 8])) if len(at) else h


def scattered(h: np.ndarray) -> np.ndarray:
    """Least hashes are small; keys are even over all 64 bits."""
    h = (h ^ (h >> np.uint64(31))) * C4
    return h ^ (h >> np.uint64(33))


def anchors(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first string, last string, place of the word) of each run of strings with one anchor."""
    n = len(text) - LENGTH + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    w, places = eights(text), np.arange(BLOCK + SPAN, dtype=np.uint64)
    found = []
    for start in range(0, n, BLOCK):
        m = min(BLOCK, n - start)
        h = hashed(w[start : start + m + SPAN - 1], w[start + 8 : start + m + SPAN + 7])
        h &= ~np.uint64(0xFFFF)
        h |= places[: len(h)]  # the place breaks ties and survives the minimum
        step = 1
        while 2 * step <= SPAN:
            h = np.minimum(h[:-step], h[step:])
            step *= 2
        h = np.minimum(h[:m], h[SPAN - step : SPAN - step + m]) if SPAN > step else h[:m]
        found.append((h & np.uint64(0xFFFF)).astype(np.int32)[:m] + np.int32(start))
    at = np.concatenate(found)
    begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return begin, np.append(begin[1:], n) - 1, at[begin].astype(np.int64)


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return (((keys >> np.uint64(40)) * np.uint64(n)) >> np.uint64(24)).astype(np.int64)


def send_keys(stored: DataFrame, n: int) -> DataFrame:
    """(chunk, bucket, blob, many): 32 bits of each distinct key, enough within a bucket; what meets by chance is compared later.

    many: places in blob of the keys that have over ``OFTEN`` different contexts in the chunk, and how many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row)
                c.anchor()
                bucket = bucket_of(c.keys, n)
                starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
                low = (c.keys >> np.uint64(8)).astype(np.uint32)
                stops = np.append(starts[1:], len(bucket))
                blobs = [low[s:e].tobytes() for s, e in zip(starts, stops, strict=False)]
                times = c.contexts()
                often = [np.flatnonzero(times[s:e] > OFTEN) for s, e in zip(starts, stops, strict=False)]
                many = [np.stack([o, times[s:][o]]).astype(np.uint32).tobytes() for o, s in zip(often, starts, strict=True)]
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([row["chunk"]] * len(blobs), pa.int64()), "bucket": bucket[starts], "blob": pa.array(blobs, pa.binary()), "many": pa.array(many, pa.binary())})

    return stored.mapInArrow(run, "chunk long, bucket long, blob binary, many binary")


def meet(table: pa.Table, hot: int = HOT) -> pa.Table:
    """One bucket: for each chunk's keys, whether another chunk has them; if any of them is hot, the same for that."""
    own = [np.frombuffer(b, np.uint32) for b in table.column("blob").to_pylist()]
    kinds, met = np.unique(np.concatenate(own), return_counts=True)
    times = met.astype(np.int64)
    for keys, many in zip(own, table.column("many").to_pylist(), strict=True):
        place, often = np.frombuffer(many, np.uint32).reshape(2, -1)
        times[np.searchsorted(kinds, keys[place])] += often - 1
    bits = []
    for keys in own:
        at = np.searchsorted(kinds, keys)
        bits.append(np.packbits(met[at] > 1).tobytes() + (np.packbits(times[at] > hot).tobytes() if (times[at] > hot).any() else b""))
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})


def rows_of(text: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Contexts as fixed rows: the bytes, zeros, and the size."""
    padded = np.concatenate([text, np.zeros(WIDEST, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, WIDEST)[first].copy()
    out[np.arange(WIDEST)[None] >= size[:, None]] = 0
    return np.hstack([out, size[:, None].astype(np.uint8)])


def as_strings(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}")[:, 0]


def send_contexts(left: pa.Table, right: pa.Table, n: int) -> pa.Table:
    """One chunk and its answers: (chunk, bucket, blob) of the contexts; bucket -1: what the chunk keeps for itself."""
    out: dict[str, list] = {"chunk": [], "bucket": [], "blob": []}
    for row in left.to_pylist():
        c = Chunk(row)
        c.anchor()
        bucket = bucket_of(c.keys, n)
        met, hot = c.met_here.copy(), np.zeros(len(c.keys), bool)
        for b, bits in sorted(zip(right.column("bucket").to_pylist(), right.column("bits").to_pylist(), strict=True)):
            s, e = np.searchsorted(bucket, [b, b + 1])
            size = (int(e - s) + 7) // 8
            met[s:e] |= np.unpackbits(np.frombuffer(bits[:size], np.uint8), count=int(e - s)).astype(bool)
            if len(bits) > size:
                hot[s:e] = np.unpackbits(np.frombuffer(bits[size:], np.uint8), count=int(e - s)).astype(bool)
        use = np.flatnonzero(met[c.number])
        first, size, ids, dest = c.first[use], c.last[use] - c.first[use] + LENGTH, c.ids[c.doc[use]], bucket[c.number[use]]
        if (split := hot[c.number[use]]).any():  # strings one by one
            each = size[split] - LENGTH + 1
            single = np.repeat(first[split] - np.cumsum(each) + each, each) + np.arange(int(each.sum()))
            first, size, ids, dest = (np.concatenate(x) for x in ((first[~split], single), (size[~split], np.full(len(single), LENGTH)), (ids[~split], np.repeat(ids[split], each)), (dest[~split], bucket_of(string_hashes(c.text, single), n))))
        order = np.argsort(ids, kind="stable")
        first, size, ids, dest = first[order], size[order], ids[order], dest[order]
        strings = as_strings(rows_of(c.text, first, size))
        _, lead, which = np.unique(strings, return_index=True, return_inverse=True)
        here = dest[lead]
        order = np.argsort(here, kind="stable")
        lead, here = lead[order], here[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        sent = place[which]
        gone = ids > ids[lead[sent]] if len(first) else np.zeros(0, bool)
        out["chunk"].append(row["chunk"])
        out["bucket"].append(-1)
        starts = np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1]])).tolist() if len(here) else []
        stops = [*starts[1:], len(here)][: len(starts)]
        counts = np.array([e - s for s, e in zip(starts, stops, strict=True)], np.int64)
        out["blob"].append(pack(np.array([len(first), len(lead), len(counts)], np.int64), counts, *(a.astype(np.uint32) for a in (first, sent)), *(a.astype(np.uint8) for a in (size, size[lead], gone))))
        for s, e in zip(starts, stops, strict=True):
            own = lead[s:e]
            text = np.concatenate([c.text[f : f + z] for f, z in zip(first[own].tolist(), size[own].tolist(), strict=True)])
            out["chunk"].append(row["chunk"])
            out["bucket"].append(int(here[s]))
            kinds, which_id = np.unique(ids[own], return_inverse=True)
            out["blob"].append(pack(np.array([e - s, len(kinds)], np.int64), kinds, which_id.astype(np.uint32), size[own].astype(np.uint8), text))
    return pa.table({"chunk": pa.array(out["chunk"], pa.int64()), "bucket": pa.array(out["bucket"], pa.int64()), "blob": pa.array(out["blob"], pa.binary())})


class Family:
    """Sorted arrays of strings in levels whose sizes grow geometrically."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def scan(self, batch: np.ndarray) -> np.ndarray:
        """Which of the sorted strings of a batch a level has; both are in order, so bisection goes on from what was found last."""
        hit = np.zeros(len(batch), bool)
        for level in self.levels:
            at = np.searchsorted(level, batch)
            at[at == len(level)] = 0
            hit |= level[at] == batch
        return hit

    def add(self, new: np.ndarray) -> None:
        """The sorted strings of a batch that no level has."""
        while self.levels and self.levels[-1].size.bit_length() <= new.size.bit_length():
            new = np.sort(np.concatenate([self.levels.pop(), new]), kind="stable")  # two runs: merged
        if len(new):
            self.levels.append(new)


def seen_before(text: np.ndarray, first: np.ndarray, docs: np.ndarray, most: int = BATCH) -> np.ndarray:
    """For each place ``first`` of ``text``, whether its string starts in a smaller document. docs: ascending."""
    out = np.zeros(len(first), bool)
    windows = np.lib.stride_tricks.sliding_window_view(text, LENGTH) if len(text) >= LENGTH else np.zeros((0, LENGTH), np.uint8)
    family, start = Family(), 0
    while start < len(first):
        stop = min(start + most, len(first))
        stop = int(np.searchsorted(docs, docs[stop - 1], side="right"))  # whole documents
        strings = as_strings(windows[first[start:stop]])
        order = np.argsort(strings, kind="stable")  # the batch's suffix array
        ranked, own = strings[order], docs[start:stop][order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        group = np.cumsum(new) - 1
        known = family.scan(ranked[new])
        out[start:stop][order] = known[group] | (own > own[new][group])
        family.add(ranked[new][~known])
        start = stop
    return out


def judge(table: pa.Table, batch: int = BATCH) -> pa.Table:
    """One bucket: for each string of each context that a chunk sent, whether a smaller document has it."""
    ids, sizes, texts, counts = [], [], [], []
    for blob in table.column("blob").to_pylist():
        raw = unpack(blob)
        n, k = raw[:16].view(np.int64).tolist()
        ids.append(raw[16 : 16 + 8 * k].view(np.int64)[raw[16 + 8 * k : 16 + 8 * k + 4 * n].view(np.uint32)])
        sizes.append(raw[16 + 8 * k + 4 * n : 16 + 8 * k + 5 * n].astype(np.int64))
        texts.append(raw[16 + 8 * k + 5 * n :])
        counts.append(n)
    ids, sizes, text = np.concatenate(ids), np.concatenate(sizes), np.concatenate(texts)
    first = np.cumsum(sizes) - sizes
    order = np.argsort(ids, kind="stable")
    strings = as_strings(rows_of(text, first[order], sizes[order]))
    _, lead, which = np.unique(strings, return_index=True, return_inverse=True)
    lead = order[lead]  # of each distinct context, one of the smallest id
    by_id = np.argsort(ids[lead], kind="stable")
    each = sizes[lead[by_id]] - LENGTH + 1
    at = np.repeat(first[lead[by_id]] - np.cumsum(each) + each, each) + np.arange(each.sum())
    seen = seen_before(text, at, np.repeat(ids[lead[by_id]], each), batch)
    of_lead = np.empty(len(lead), np.int64)
    of_lead[by_id] = np.cumsum(each) - each
    mine = np.empty(len(ids), np.int64)
    mine[order] = which
    n_each = sizes - LENGTH + 1
    place = np.repeat(of_lead[mine] - np.cumsum(n_each) + n_each, n_each) + np.arange(n_each.sum())
    flags = seen[place] | np.repeat(ids > ids[lead[mine]], n_each)
    ends = np.cumsum(n_each)
    bits, at = [], 0
    for stop in np.cumsum(counts):
        end = int(ends[stop - 1]) if stop else 0
        bits.append(np.packbits(flags[at:end]).tobytes())
        at = end
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "blob": pa.array(bits, pa.binary())})


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove(left: pa.Table, right: pa.Table, texts: bool) -> pa.Table:
    """One chunk and its answers: its documents without what goes."""
    out: dict[str, list] = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
    for row in left.to_pylist():
        c = Chunk(row)
        change = np.zeros(len(c.text) + 1, np.int8)  # of how many strings cover a byte: LENGTH at most
        answers = sorted(zip(right.column("bucket").to_pylist(), right.column("blob").to_pylist(), strict=True))
        if answers and answers[0][0] == -1:
            raw = unpack(answers[0][1]).copy()
            n, m, k = raw[:24].view(np.int64).tolist()
            counts, raw = raw[24 : 24 + 8 * k].view(np.int64), raw[24 + 8 * k :]
            first, sent = raw[: 8 * n].view(np.uint32).astype(np.int64).reshape(2, n)
            size, lead_size, gone = np.split(raw[8 * n :], [n, n + m])
            size, lead_size, gone = size.astype(np.int64), lead_size.astype(np.int64), gone.astype(bool)
            windows = lead_size - LENGTH + 1
            upto = np.cumsum(windows)
            stops = upto[np.cumsum(counts) - 1]  # answers come in the order in which the chunk sent
            seen = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=int(e - s)) for (_, b), s, e in zip(answers[1:], np.append(0, stops), stops, strict=False)] or [np.zeros(0, bool)]).astype(bool)
            begin = upto - windows
            each = size - LENGTH + 1
            inside = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
            marked = seen[np.repeat(begin[sent], each) + inside] | np.repeat(gone, each)
            starts = (np.repeat(first, each) + inside)[marked]
            change[starts] += 1
            change[starts + LENGTH] -= 1
        removed = np.cumsum(change[:-1], dtype=np.int8) > 0
        at = 0
        for doc_id, none, end in zip(c.ids.tolist(), c.null_ids.tolist(), c.ends.tolist(), strict=True):
            own, text = removed[at:end], c.text[at:end]
            n = int(own.sum())
            kept = (text[~own] if n else text).tobytes()
            out["doc_id"].append(None if none else doc_id)
            out["n_bytes"].append(end - at)
            out["n_removed"].append(n)
            out["n_spans"].append(int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if n else 0)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept if texts else None)
            at = end
    types = {"kept_sha256": pa.string(), "kept": pa.binary()}
    return pa.table({k: pa.array(v, types.get(k, pa.int64())) for k, v in out.items()})


def without_repeats(docs: DataFrame, texts: bool = True, chunk: int = CHUNK, bucket: int = BUCKET, batch: int = BATCH, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of each row of ``docs``; kept: the bytes left, or null."""
    stored = cut(chunks(docs, chunk))
    n = max(1, min(1 << 24, -(-int(stored.agg(F.sum("n_bytes")).first()[0] or 0) // bucket)))
    met = send_keys(stored, n).groupBy("bucket").applyInArrow(lambda t: meet(t, hot), "chunk long, bucket long, bits binary")
    sent = cut(stored.groupBy("chunk").cogroup(met.groupBy("chunk")).applyInArrow(lambda a, b: send_contexts(a, b, n), "chunk long, bucket long, blob binary"))
    answers = sent.where("bucket >= 0").groupBy("bucket").applyInArrow(lambda t: judge(t, batch), "chunk long, bucket long, blob binary")
    back = sent.where("bucket < 0").unionByName(answers)
    return stored.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(lambda a, b: remove(a, b, texts), CUT)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(read_table(spark, sf_dir, "documents"), texts=False).drop("kept")
