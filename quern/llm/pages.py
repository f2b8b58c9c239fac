"""Main text of HTML pages by nearest-URL page differencing.

A page is cut into lines: the text of its block elements, in order, with where it stands. The distinct pages of a host
are put in the order of their URL paths, and each is paired with the page before it or after it, whichever shares more
of its path (both, if they share as much). All lines of a pair, menus included, are aligned by their longest common
subsequence; what is shared is the site's own, and deleted. If a pair leaves one of the two pages without a line, the
one is a copy of the other or holds nothing but the frame: then only those lines go that the pages on both sides share,
each of which has lines of its own.

Markup decides the rest. A page that marks its text by ``<article>`` or ``<main>`` has its text there: it is returned
whole, as a site may well print one sentence in two articles, and what stands outside goes. Lines go that elements
or class names give to menus, headers and footers outside an article, sidebars, notices, adverts, forms, reader
comments, scripts and styles, since such lines need not be shared.

Tags are read by the rules of HTML for attributes, comments and raw text, in time linear in the page, so that stray
quotes and unclosed tags neither put markup into the text nor stop a task.

Host and path order are found by a range sort, so a host with most of all pages is spread over many tasks: sorted
rows get their rank from the row counts of the partitions, and blocks of ``BLOCK`` ranks with one more page at
each end are aligned together. Only hashes of lines travel; texts are read again and meet the deletions. Copies within
a host are one page there.

Defined results: a null html counts as empty (no text); a null url, or one without a host, has no partner;
white space within a block becomes one space, ``<br>`` too; repeated rows stay (rows are told apart by a 64-bit
hash); other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.arrow import cut, map_rows, read_table

BLOCK, CELLS = 64, 200_000_000
NAMED, OUTSIDE, INSIDE = 0, 1, 2

# Elements by what they hold.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
SILENT = frozenset("noscript template svg math object canvas audio video head select option button".split())
BOILERPLATE = frozenset("nav aside form dialog menu".split())
EDGES = frozenset("header footer".split())
MAIN = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
# Names of classes, ids and roles of what isn't text, alone or with the words for parts of a page.
NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr popup modal newsletter subscribe signup comment comments commentlist disqus respond sidebar widget widgets menu navbar nav navigation breadcrumb breadcrumbs pagination pager footer masthead toolbar complementary contentinfo alertdialog".split())
NAMES_OF_PARTS = frozenset("notice notices share sharing social related recommended search header alert dialog".split())
PARTS = frozenset("area bar block body bottom box btn button buttons cell col column container content form group holder icons inner item items left link links list main menu nav page panel posts primary right row secondary section side site top unit widget wrap wrapper".split())

_space = re.compile(r"[\s/]*")
_opening = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--|[!?/])")
_attribute = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_comment_end = re.compile(r"--!?>")
_closing = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in RAW}
_digits = re.compile(r"\d+$")


def attributes(page: str, at: int) -> tuple[dict[str, str], bool, int]:
    """(names and values, whether the tag closes itself, where it ends) of a tag whose name ends at ``at``; unclosed: at the page's end."""
    end = page.find(">", at)
    if end >= 0 and not page[at:end].strip("/ \n\t\r\f"):
        return {}, page[end - 1] == "/", end + 1
    found: dict[str, str] = {}
    while True:
        skipped = _space.match(page, at).end()
        if skipped >= len(page):
            return found, False, len(page)
        if page[skipped] == ">":
            return found, page[skipped - 1] == "/" and skipped > at, skipped + 1
        m = _attribute.match(page, at)
        found.setdefault(m[1].lower(), next((v for v in m.groups()[1:] if v is not None), ""))
        at = m.end()


def names_boilerplate(value: str, inside: bool) -> bool:
    """Whether a class, id or role names what isn't text. ``inside``: in an article, which has a header of its own."""
    for token in value.lower().split():
        parts = [_digits.sub("", p) for p in token.replace("_", "-").split("-")]
        own = [p for p in parts if p in NAMES or (p in NAMES_OF_PARTS and (len(parts) > 1 or p == "header"))]
        if own and not (inside and own == ["header"]) and all(p in NAMES or p in NAMES_OF_PARTS or p in PARTS or not p for p in parts):
            return True
    return False


def hides(found: dict[str, str]) -> bool:
    return "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in "".join(found.get("style", "").lower().split())


class Open:
    """The open elements that count: blocks, and others that name what isn't text."""

    def __init__(self):
        self.stack: list[tuple[str, int, int]] = []  # name, no text or not, article or not
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []
        self.bad = self.inside = 0

    def push(self, name: str, bad: int, inside: int) -> None:
        self.places[name].append(len(self.stack))
        if name in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append((name, bad, inside))
        self.bad, self.inside = self.bad + bad, self.inside + inside

    def close(self, name: str) -> bool:
        """Closes the last of a name and all in it; an inline element doesn't close blocks. False: none is open."""
        if not self.places[name] or (name not in BLOCKS and self.blocks and self.places[name][-1] < self.blocks[-1]):
            return False
        to = self.places[name][-1]
        while len(self.stack) > to:
            last, bad, inside = self.stack.pop()
            self.places[last].pop()
            if last in BLOCKS:
                self.blocks.pop()
            self.bad, self.inside = self.bad - bad, self.inside - inside
        return True


def lines(page: str | None) -> list[tuple[str, int]]:
    """(text, place) of each block; place: NAMED as no text, OUTSIDE any article, INSIDE one."""
    page = page or ""
    out: list[tuple[str, int]] = []
    words: list[str] = []
    now, at = Open(), 0

    def flush() -> None:
        if words:
            text = "".join(words)
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            words.clear()
            if text:
                out.append((text, NAMED if now.bad else INSIDE if now.inside else OUTSIDE))

    while m := _opening.search(page, at):
        if m.start() > at:
            words.append(page[at : m.start()])
        at, name = m.end(), (m[2] or "").lower()
        if m[0] == "<!--":
            end = None if page.startswith((">", "->"), at) else _comment_end.search(page, at)
            at = end.end() if end else page.find(">", at) + 1 if page.startswith((">", "->"), at) else len(page)
        elif not name:
            at = page.find(">", at) + 1 or len(page)
        elif m[1]:
            _, _, at = attributes(page, at)
            if name in BLOCKS:
                flush()
                now.close(name)
            elif now.places[name] and now.bad:
                flush()
                now.close(name)
        else:
            found, closed, at = attributes(page, at)
            if name in RAW:
                end = _closing[name].search(page, at)
                at = attributes(page, end.end())[2] if end else len(page)
                words.append(" ")
                continue
            if name == "br":
                words.append(" ")
            if name in BLOCKS:
                flush()
                if now.stack and now.stack[-1][0] == "p":
                    now.close("p")
            if name in VOID:
                continue
            bad = name in SILENT or name in BOILERPLATE or (name in EDGES and not now.inside)
            if not bad and found and name not in ("html", "body"):
                bad = hides(found) or (name not in MAIN and any(names_boilerplate(found[k], now.inside > 0) for k in ("class", "id", "role") if k in found))
            if closed and name not in BLOCKS:
                continue
            if name in BLOCKS or bad:
                if bad:
                    flush()
                now.push(name, int(bad), int(name in MAIN))
    if at < len(page):
        words.append(page[at:])
    flush()
    return out


def alignment(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of two lists, by bit-parallel dynamic programming.

    Row i of the table is one integer whose zero bits are the places where its length grows; over ``CELLS`` bits the
    longer list is halved where a best alignment parts the other.
    """
    if not a or not b:
        return []
    if len(a) < len(b):
        return [(i, j) for j, i in alignment(b, a)]
    if len(a) * len(b) > CELLS and len(a) > 1:
        half = len(a) // 2
        before, after = lengths(a[:half], b), lengths(a[half:][::-1], b[::-1])[::-1]
        part = int((before + after).argmax())
        return alignment(a[:half], b[:part]) + [(half + i, part + j) for i, j in alignment(a[half:], b[part:])]
    rows = table(a, b)
    i, j, out = len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif rows[i] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
    return out[::-1]


def table(a: list[int], b: list[int], last: bool = False) -> list[int]:
    where: dict[int, int] = defaultdict(int)
    for j, x in enumerate(b):
        where[x] |= 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, [full]
    for x in a:
        both = row & where.get(x, 0)
        row = ((row + both) | (row - both)) & full
        if last:
            rows.clear()
        rows.append(row)
    return rows


def lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of a longest common subsequence of ``a`` and each prefix of ``b``."""
    row = table(a, b, True)[-1]
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def shared(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of two lists of line hashes."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    both = set(a[head : len(a) - tail]) & set(b[head : len(b) - tail])  # other lines are in no alignment
    one, two = ([i for i in range(head, len(x) - tail) if x[i] in both] for x in (a, b))
    middle = [(one[i], two[j]) for i, j in alignment([a[i] for i in one], [b[j] for j in two])]
    return [(i, i) for i in range(head)] + middle + [(len(a) - tail + i, len(b) - tail + i) for i in range(tail)]


def nearness(one: str, two: str) -> int:
    """How many leading segments two paths share."""
    n = 0
    for a, b in zip(one.split("/"), two.split("/"), strict=False):
        if a != b:
            break
        n += 1
    return n


def deletions(page: dict, others: list[dict]) -> set[int]:
    """Places of ``page``'s lines that go, by the pages before and after it."""
    same = [shared(page["hashes"], o["hashes"]) for o in others]
    mine = [{i for i, _ in s} for s in same]
    own = lambda p, gone: any(k != NAMED and i not in gone for i, k in enumerate(p["places"]))
    near = [nearness(page["path"], o["path"]) for o in others]
    theirs = [own(o, {j for _, j in s}) for o, s in zip(others, same, strict=True)]
    gone = set()
    for both, n, other in zip(mine, near, theirs, strict=True):
        if n == max(near) and other and own(page, both):
            gone |= both
    if len(others) == 2 and all(theirs):
        gone |= mine[0] & mine[1]
    return gone


def text_of(found: list[tuple[str, int]], gone: set[int]) -> str:
    """A page's lines without those deleted: of its article, if it marks one."""
    marked = any(k == INSIDE for _, k in found)
    return "\n".join(t for i, (t, k) in enumerate(found) if (k == INSIDE if marked else k == OUTSIDE and i not in gone))


SIGNED = "row long, page_id long, host string, path string, whole long, hashes array<long>, places array<int>"


def signatures(pages: DataFrame) -> DataFrame:
    """All lines of each page with a host, as hashes; ``whole`` is that of all of them."""
    url = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1)
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+", ""), r"[?#].*$|/$", "")
    keyed = pages.select("row", "page_id", F.lower(url).alias("host"), path.alias("path"), "html").where("host IS NOT NULL AND host <> ''")
    digest = lambda raw: xxhash.xxh3_64_intdigest(raw) - (1 << 63)

    def run(rows: dict) -> dict:
        found = [lines(h) for h in rows["html"]]
        return {
            **{n: rows[n] for n in ("row", "page_id", "host", "path")},
            "whole": [digest("\0".join(f"{k}{t}" for t, k in x).encode("utf-8", "surrogatepass")) for x in found],
            "hashes": [[digest(t.encode("utf-8", "surrogatepass")) for t, _ in x] for x in found],
            "places": [[k for _, k in x] for x in found],
        }

    return map_rows(keyed, run, SIGNED, 256, 2_000_000)


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition and the place in it."""
    from pyspark import TaskContext

    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64())], names=[*batch.schema.names, "part", "at"])
        at += n


def shared_lines(signed: DataFrame) -> DataFrame:
    """(host, whole, gone array<int>): places of the lines that go from a page of a host; none: no row."""
    distinct = signed.groupBy("host", "whole").agg(F.min(F.struct("path", "page_id", "row", "hashes", "places")).alias("x")).select("host", "whole", "x.path", "x.page_id", "x.row", "x.hashes", "x.places")
    ordered = cut(distinct.repartitionByRange("host", "path", "page_id", "row").sortWithinPartitions("host", "path", "page_id", "row").mapInArrow(numbered, "host string, whole long, path string, page_id long, row long, hashes array<long>, places array<int>, part int, at long"))
    counts, start, total = ordered.groupBy("part").count().collect(), {}, 0  # one number for each partition
    for part, n in sorted((r["part"], r["count"]) for r in counts):
        start[part] = total
        total += n
    if not start:
        return ordered.select("host", "whole", F.array().cast("array<int>").alias("gone")).limit(0)
    rank = F.create_map([F.lit(x) for p, s in start.items() for x in (p, s)])[F.col("part")] + F.col("at")
    blocks = F.array_distinct(F.array(F.floor((F.col("rank") - 1) / BLOCK), F.floor(F.col("rank") / BLOCK), F.floor((F.col("rank") + 1) / BLOCK)))
    dealt = ordered.withColumn("rank", rank).select(F.explode(blocks).alias("block"), "rank", "host", "whole", "path", "hashes", "places")

    def align(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["rank"])
        out: dict[str, list] = {"host": [], "whole": [], "gone": []}
        for k, page in enumerate(rows):
            if page["rank"] // BLOCK == page["block"]:
                others = [o for o in (*rows[max(0, k - 1) : k], *rows[k + 1 : k + 2]) if o["host"] == page["host"] and abs(o["rank"] - page["rank"]) == 1]
                if gone := deletions(page, others) if others else None:
                    for n, v in (("host", page["host"]), ("whole", page["whole"]), ("gone", sorted(gone))):
                        out[n].append(v)
        return pa.table({"host": pa.array(out["host"], pa.string()), "whole": pa.array(out["whole"], pa.int64()), "gone": pa.array(out["gone"], pa.list_(pa.int32()))})

    return dealt.groupBy("block").applyInArrow(align, "host string, whole long, gone array<int>")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_shared) of each row of ``pages`` (page_id, url, html); n_shared: lines deleted as shared."""
    ids = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("row", F.xxhash64("page_id", "url", "html"))
    signed = cut(signatures(ids))
    gone = cut(shared_lines(signed)).withColumnsRenamed({"host": "at", "whole": "of"})
    of_row = signed.join(gone, (F.col("host") == F.col("at")) & (F.col("whole") == F.col("of"))).select(F.col("row").alias("of_row"), "gone").dropDuplicates(["of_row"])
    joined = ids.join(of_row, F.col("row") == F.col("of_row"), "left")

    def run(rows: dict) -> dict:
        text = [text_of(lines(page), set(out or ())) for page, out in zip(rows["html"], rows["gone"], strict=True)]
        return {"page_id": rows["page_id"], "url": rows["url"], "text": text, "n_chars": [len(t) for t in text], "n_shared": [len(g or ()) for g in rows["gone"]]}

    return map_rows(joined.select("page_id", "url", "html", "gone"), run, "page_id long, url string, text string, n_chars long, n_shared long", 256, 2_000_000)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
