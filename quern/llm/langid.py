"""Language ID by hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point and ``SEED``. A trigram of letters (a run
of anything else counts as one space) binds its letters' vectors: the first rotated twice, the second once, the
third not at all, multiplied. A text bundles its trigrams' vectors, each as often as it occurs; a language's
prototype bundles its training texts, each scaled by the length of its count vector. The prediction is the
prototype of the largest cosine, and the score that cosine, 0 at least.

Training adds up over all labelled training rows: tasks bundle what they read and emit one row for each language
and dimension, which Spark sums. What reaches the driver is one vector for each language. Counts are kept for pairs of
a text and a trigram of it, and dense for ``GRAMS`` trigrams at a time, so a worker's memory follows the slice of texts.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is every text if there is
nothing to learn from; equal cosines go to the language that sorts first; whole texts are read; repeated rows
stay; only doc_id, text and lang are used, and lang only in training.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.arrow import held_out, map_rows, read_table, slices

DIMENSIONS, SEED, UNKNOWN = 1024, 20_090, "und"
ROWS, CHARS, GRAMS, CELLS = 256, 1_500_000, 4096, 4_000_000

_letters: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


def letter_vector(code: int, dimensions: int) -> np.ndarray:
    """The random vector of a letter (0: the space)."""
    bits = np.random.Generator(np.random.PCG64([SEED, code])).integers(0, 2, dimensions, dtype=np.int8)
    return (bits * 2 - 1).astype(np.int8)


def letters_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(code points with one 0 for each run of anything but letters, the text of each)."""
    parts, rows = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for k, text in enumerate(texts):
        codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
        codes = np.where(is_letter()[codes], codes, 0)
        keep = codes != 0
        if keep.any():
            keep[1:] |= keep[:-1]  # a space stays only after a letter
            parts += [np.zeros(1, np.int32), codes[keep]] + ([np.zeros(1, np.int32)] if keep[-1] and codes[-1] else [])
            rows.append(np.full(sum(map(len, parts)) - sum(map(len, rows)), k, np.int32))
    return np.concatenate(parts), np.concatenate(rows)


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, trigram, count) of each distinct pair, by trigram then text; trigrams as three indices into the last result, the letters' code points."""
    codes, row = letters_of(texts)
    seen = np.zeros(0x110000, bool)
    seen[codes] = True
    alphabet = np.flatnonzero(seen)
    place = np.zeros(0x110000, np.int32)
    place[alphabet] = np.arange(len(alphabet))
    a, size = place[codes].astype(np.int64), max(1, len(alphabet))
    inside = row[:-2] == row[2:]
    gram, text = ((a[:-2] * size + a[1:-1]) * size + a[2:])[inside], row[:-2][inside].astype(np.int64)
    several = lambda kinds: np.stack([kinds // size**2, kinds // size % size, kinds % size], 1)
    if size**3 <= CELLS:
        present = np.zeros(size**3, bool)
        present[gram] = True
        kinds = np.flatnonzero(present)
        if len(kinds) * len(texts) <= CELLS:  # few letters: counted in place
            number = np.zeros(size**3, np.int64)
            number[kinds] = np.arange(len(kinds))
            counts = np.bincount(number[gram] * len(texts) + text, minlength=1)
            pair = np.flatnonzero(counts)
            which, text = np.divmod(pair, max(1, len(texts)))
            return text, which, counts[pair], several(kinds), alphabet
    pair = gram * len(texts) + text
    pair.sort()
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    count = np.diff(first, append=len(pair))
    gram, text = np.divmod(pair[first], max(1, len(texts)))
    new = np.diff(gram, prepend=-1) != 0
    return text, np.cumsum(new) - 1, count, several(gram[new]), alphabet


class Letters:
    """Vectors of the letters met so far, each in three rotations."""

    def __init__(self, dimensions: int):
        self.dimensions, self.known = dimensions, {}

    def bundle(self, rows: int, row: np.ndarray, gram: np.ndarray, weight: np.ndarray, grams: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
        """[row, dimension]: sums of the trigrams' vectors by weight. (row, gram, weight) are by gram; ``GRAMS`` trigrams are bound at a time."""
        for c in alphabet.tolist():
            if c not in self.known:
                self.known[c] = letter_vector(c, self.dimensions)
        third = np.stack([self.known[c] for c in alphabet.tolist()]) if len(alphabet) else np.zeros((0, self.dimensions), np.int8)
        second, first = np.roll(third, 1, axis=1), np.roll(third, 2, axis=1)
        out = np.zeros((rows, self.dimensions), np.float32)
        for at in range(0, len(grams), GRAMS):
            one, two, three = grams[at : at + GRAMS].T
            s, e = np.searchsorted(gram, [at, at + len(one)])
            bound = (first[one] * second[two] * third[three]).astype(np.float32)
            if e - s > 2 * len(one):
                weights = np.zeros((rows, len(one)), np.float32)
                weights[row[s:e], gram[s:e] - at] = weight[s:e]
                out += weights @ bound
            elif e > s:  # most trigrams are in one text only
                order = np.argsort(row[s:e], kind="stable") + s
                starts = np.flatnonzero(np.diff(row[order], prepend=-1))
                out[row[order[starts]]] += np.add.reduceat(bound[gram[order] - at] * weight[order, None].astype(np.float32), starts, axis=0)
        return out


def prototypes(docs: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """One unit vector for each language of ``docs`` (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, sums = Letters(dimensions), {}
        for batch in batches:
            for part in slices(batch, ROWS, CHARS):
                text, gram, count, grams, alphabet = trigrams(part.column(0).to_pylist())
                if not len(gram):
                    continue
                length = np.sqrt(np.bincount(text, count.astype(np.float64) ** 2, part.num_rows))
                langs = np.array(part.column(1).to_pylist(), object)
                kinds = {k: i for i, k in enumerate(sorted(set(langs[length > 0].tolist())))}
                number = np.array([kinds.get(k, -1) for k in langs.tolist()])[text]
                pair, which = np.unique(gram * len(kinds) + number, return_inverse=True)
                weight = np.bincount(which, count / length[text])
                for lang, v in zip(kinds, letters.bundle(len(kinds), pair % len(kinds), pair // len(kinds), weight, grams, alphabet), strict=True):
                    sums[lang] = sums.get(lang, 0) + v.astype(np.float64)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * dimensions, "dim": np.arange(dimensions, dtype=np.int32), "v": v})

    each = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").mapInArrow(run, "lang string, dim int, v double")
    summed = each.groupBy("lang", "dim").agg(F.sum("v").alias("v")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("dim", "v"))).alias("v"))
    found = summed.select("lang", F.transform("v", lambda x: x["v"]).alias("v")).collect()  # one row for each language
    vectors = {r["lang"]: np.array(r["v"]) for r in found}
    return {k: (v / n).astype(np.float32) for k, v in sorted(vectors.items()) if (n := np.linalg.norm(v)) > 0}


def identify(texts: list[str | None], names: list[str], matrix: np.ndarray, letters: Letters) -> tuple[list[str], list[float]]:
    """Predicted language and cosine of each text; ``matrix``: a row for each name."""
    text, gram, count, grams, alphabet = trigrams(texts)
    pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if not len(grams) or not names:
        return pred, score
    bundle = letters.bundle(len(texts), text, gram, count, grams, alphabet)
    cosine = (bundle @ matrix.T) / np.maximum(np.sqrt((bundle * bundle).sum(1, keepdims=True)), 1e-9)
    best = cosine.argmax(1)
    for i in np.unique(text).tolist():
        pred[i], score[i] = names[best[i]], float(min(1.0, max(0.0, cosine[i, best[i]])))
    return pred, score


def predict(docs: DataFrame, learnt: dict[str, np.ndarray], keep: str) -> DataFrame:
    """The column ``keep`` of ``docs``, and the prediction for its ``text``."""
    names = list(learnt)
    matrix = np.stack([learnt[n] for n in names]) if names else np.zeros((0, DIMENSIONS), np.float32)

    def run(rows: dict) -> dict:
        pred, score = identify(rows["text"], names, matrix, Letters(matrix.shape[1]))
        return {keep: rows[keep], "lang_pred": pred, "score": score}

    return map_rows(docs.select(keep, "text"), run, f"{keep} long, lang_pred string, score double", ROWS, CHARS)


def training(docs: DataFrame) -> DataFrame:
    """The rows to learn from: crc32 of the id as text leaves anything but 1 divided by 3."""
    return docs.where(~F.coalesce(held_out("doc_id", 3, 1), F.lit(False)))


def accepted(docs: DataFrame, learnt: dict[str, np.ndarray], sigmas: float = 3.0) -> DataFrame:
    """Rows of ``docs``, all columns, whose text has a known language.

    Rejected: texts without a letter, and those whose best cosine is below ``sigmas`` standard deviations of the
    cosine of random vectors, as of a text in letters that no prototype has met.
    """
    names = list(learnt)
    matrix = np.stack([learnt[n] for n in names]) if names else np.zeros((0, DIMENSIONS), np.float32)
    floor, place = sigmas / DIMENSIONS**0.5, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters(matrix.shape[1])
        for batch in batches:
            for part in slices(batch, ROWS, CHARS):
                pred, score = identify(part.column(place).to_pylist(), names, matrix, letters)
                yield part.filter(pa.array([p != UNKNOWN and s >= floor for p, s in zip(pred, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text", "lang")
    learnt = prototypes(training(docs))
    out = predict(docs, learnt, "doc_id")
    return out.select("doc_id", F.coalesce(held_out("doc_id", 3, 1), F.lit(False)).alias("held_out"), "lang_pred", "score")
