"""BPE encoding and decoding with a priority queue of merge ranks over a doubly linked symbol list.

Reads the public ``tokenizers`` JSON format for vocabularies whose normaliser is NFC, white space to one space
and lower case, whose pre-tokeniser is a Split pattern followed by byte symbols, and whose model is BPE with an
end-of-word suffix. Each word starts as its byte symbols in a doubly linked list. Every adjacent pair that has a
merge enters a heap as (rank, position); the least is taken, skipped if one of its symbols has changed since,
and otherwise merged, which enters at most two new pairs. Decoding joins vocabulary strings by one space, as
the library does for a file that names no decoder.

Letters, digits, lower case and composition are those of the Unicode tables of Python and ``regex``. These agree with
the library's own on all code points but those that Python's tables don't assign yet; a text that has one is
normalised and split into words by the library's functions for that.

Words recur, so each Python worker keeps the encodings of the words, and of the runs between white space, that it
has met, in two generations of bounded size; a text is then its runs' byte strings joined.

Defined results: a null text counts as empty (no ids, empty decoded text); texts are encoded whole; special
tokens' strings found in a text become their ids, as in the library; repeated rows stay; other columns are
ignored; a null doc_id stays null. The vocabulary's path is a parameter and must exist on the executors.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata

import regex
from pyspark.sql import DataFrame, SparkSession

from quern.llm.arrow import map_rows, read_table
from quern.llm.kept import Kept

PIECES_KEPT, RUNS_KEPT = 100_000, 150_000
#: White space as the vocabulary's own pattern engine defines it (Unicode White_Space).
SPACE = r"\t-\r\x20\x85\xa0  -     　"


def byte_symbols() -> list[str]:
    """One printable character for each byte: itself where printable, else the next code point from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in shown:
            shown[b] = chr(256 + len(shown) - len(plain))
    return [shown[b] for b in range(256)]


#: Finds a code point after the first that Unicode leaves out, U+0378.
beyond = re.compile("[^\0-\u0377]").search


class WordBpe:
    """One vocabulary file, ready to encode and decode."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        ids = self.vocab
        self.ranks = {ids[a] << 32 | ids[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.made = [ids[a + b] for a, b in pairs]
        self.strings = {i: s for s, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings |= {i: s for s, i in self.special.items()}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern.replace(r"^\s", f"^{SPACE}")).findall
        by_length = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")") if by_length else None
        symbols = byte_symbols()
        self.inner = [self.vocab[s] for s in symbols]
        self.last = [self.vocab[s + self.end] for s in symbols]
        self.spaces = regex.compile(f"[{SPACE}]+")
        self.controls = regex.compile(r"[\x1c-\x1f]").search
        self.pattern, self.path, self.library = pattern, path, None
        self.assigned: set[str] = set()  # code points met that Python's tables have
        self.of_piece, self.of_run = Kept(self.packed, PIECES_KEPT), Kept(self.joined, RUNS_KEPT)

    def word(self, piece: str) -> list[int]:
        """Ids of one piece."""
        raw = piece.encode("utf-8")
        inner = self.inner
        ids = [inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        n = len(ids)
        rank_of, made, push, pop = self.ranks.get, self.made, heapq.heappush, heapq.heappop
        shift = n.bit_length()
        places = (1 << shift) - 1
        heap = [r << shift | i for i in range(n - 1) if (r := rank_of(ids[i] << 32 | ids[i + 1])) is not None]
        if not heap:
            return ids
        heapq.heapify(heap)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        while heap:
            x = pop(heap)
            i, rank = x & places, x >> shift
            j = after[i]
            if j < 0 or rank_of(ids[i] << 32 | ids[j]) != rank:
                continue  # stale: one of the two has been merged since
            new = ids[i] = made[rank]
            ids[j] = -1
            k = after[i] = after[j]
            after[j] = -1
            if k >= 0:
                before[k] = i
                if (r := rank_of(new << 32 | ids[k])) is not None:
                    push(heap, r << shift | i)
            h = before[i]
            if h >= 0 and (r := rank_of(ids[h] << 32 | new)) is not None:
                push(heap, r << shift | h)
        return [x for x in ids if x >= 0]

    def packed(self, piece: str) -> tuple[bytes, str]:
        ids = self.word(piece)
        return struct.pack(f"<{len(ids)}I", *ids), " ".join([self.strings[i] for i in ids])

    def joined(self, run: str) -> tuple[bytes, str]:
        """A run without white space: its pieces, one after the other."""
        pieces = self.pieces(run)
        if len(pieces) == 1:
            return self.packed(run) if pieces[0] == run else self.of_piece[pieces[0]]
        made = [self.of_piece[p] for p in pieces]
        return b"".join([m[0] for m in made]), " ".join([m[1] for m in made])

    def lacks(self, part: str) -> bool:
        """Whether Python's tables lack a code point of the part."""
        if self.assigned.issuperset(part):
            return False
        new = set(part) - self.assigned
        known = {c for c in new if unicodedata.category(c) != "Cn"}
        self.assigned |= known
        return len(known) < len(new)

    def words_of_library(self, part: str) -> list[str]:
        """The words of a part with code points that Python's tables lack."""
        if self.library is None:
            from tokenizers import Regex, Tokenizer, pre_tokenizers

            self.library = Tokenizer.from_file(self.path).normalizer.normalize_str, pre_tokenizers.Split(Regex(self.pattern), "removed", invert=True).pre_tokenize_str
        normalize, split = self.library
        return [w for w, _ in split(normalize(part))]

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of a whole text."""
        made: list[tuple[bytes, str]] = []
        for k, part in enumerate(self.cut.split(text or "") if self.cut else [text or ""]):
            if k % 2:
                made.append((struct.pack("<I", self.special[part]), part))
                continue
            if not part.isascii():
                if beyond(part) and self.lacks(part):
                    made += map(self.packed, self.words_of_library(part))
                    continue
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            # str.split() also parts at the four separator controls, which are symbols here
            runs = self.spaces.split(part.lower()) if self.controls(part) else part.lower().split()
            made += map(self.of_run.__getitem__, runs)
        return b"".join([m[0] for m in made]), " ".join([m[1] for m in made if m[1]])


_loaded: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, digest: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids binary, decoded string), or with ``digest`` both as SHA-256 hex strings."""

    def run(rows: dict) -> dict:
        bpe = loaded(path)
        out = [bpe.encode(t) for t in rows["text"]]
        ids, decoded = [x[0] for x in out], [x[1] for x in out]
        n = [len(x) // 4 for x in ids]
        if digest:
            return {"doc_id": rows["doc_id"], "n_tokens": n, "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids], "decoded_sha256": [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in decoded]}
        return {"doc_id": rows["doc_id"], "n_tokens": n, "ids": ids, "decoded": decoded}

    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids binary, decoded string")
    return map_rows(docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text"), run, schema)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read_table(spark, sf_dir, "documents"), default_path(), digest=True)
