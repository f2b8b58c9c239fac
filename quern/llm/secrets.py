"""Secret scans: pattern spans, and strings in sensitive contexts that a primed zstandard can't compress.

Base spans, leftmost and not overlapping within a kind: ``assign`` (a keyword, a separator and a value; the span
is the whole match), ``access`` and ``hex``. The method adds ``novel`` spans. A candidate is a run of 16 or more
characters of a key's alphabet, with a letter, that has a sensitive word in the ``CONTEXT`` characters before it or
follows a reported one within ``NEXT`` (the lines of a long key), and touches no base span but ``hex`` within it. Its
novelty is the marginal number of bytes: what zstandard, primed with a dictionary, needs for a text with the candidate
appended, less what it needs without. For that, candidates are cut into words, as identifiers are written (signs, changes
of case, digits), in lower case. The dictionary holds the words of the running Python's library code, those used most
last, and some of code and prose around keys; it is made on the driver and sent to the tasks.

A candidate is reported if it needs as many bytes as random strings do. First ``FLOOR`` random strings of its classes of
characters (hexadecimal letters, others, upper case, digits, each sign) and its length are packed after the same
ordinary text; one that needs less than ``CLOSE`` of what the least of them needs is none. Then it is packed after the text around it, and must need
``SHARE`` of what random strings need there. Copies of the candidate, whole or in part, are taken out of that text, and
so are other runs that are novel to the dictionary (the other lines of a key, or other keys). Each distinct candidate of
a text is judged once, where it first stands, and reported wherever it occurs.

Defined results: a null text counts as empty (no spans); offsets are code points, ends exclusive; texts are
scanned whole; repeated rows stay; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from functools import lru_cache
from random import Random

import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession

from quern.llm.arrow import map_rows, read_table

KINDS = ("assign", "access", "hex", "novel")
CONTEXT, AROUND, NEXT, SHORTEST = 64, 512, 8, 16
FLOOR, CLOSE, SOME, SHARE, WORD_BYTES = 200, 0.97, 8, 0.6, 60_000
MASK = "[SECRET]"

# Words that make a context sensitive.
SENSITIVE = r"password|passwd|passphrase|secret|token|api.?key|access.?key|private.?key|credential|bearer|authorization|signature|client.?id|aws|ssh-"
# Identifiers and words that code and prose around keys use.
IDENTIFIERS = """
access_key_id aws_secret_access_key aws_session_token api_key apikey api-key auth_token authorization bearer basic
client_id client_secret connection_string const credential credentials database_url default endpoint environ export
function getenv github_token host import localhost password passphrase private_key process.env public_key return
secret secret_key self service session_id settings signature ssh-rsa string token username value version
development production staging testing example placeholder changeme your_key_here insert_your_token_here
application/json content-type https://www.example.com/index.html org.apache.commons.lang3 java.util.concurrent
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000000000000000000000000000 xxxxxxxxxxxxxxxxxxxxxxxx
/path/to/some/directory/file.txt /usr/local/bin /home/user/config application settings email template reset page
account admin authentication backup cache client config create customer data database delete document error event
example_file group handler header image index input internal item library list login main manager message method model
module name network number object option order output package parameter parser password_reset process product project
property query report request resource response result route schema script server service source status storage store
stream string system table target task template test_case thread time_stamp title tracker update upload user_id util view
2020-01-01T00:00:00.000Z 2021-12-31 2022-06-30 2023-03-15 2024-10-20 2025-05-05 the-and-for-with-over-under
deadbeefdeadbeefdeadbeef 1234567890abcdef 123456789012345678901234567890
"""

# Modules of Python's library whose words the dictionary takes.
MODULES = """
argparse ast base64 calendar cmd codecs configparser csv datetime decimal difflib email/message ftplib getpass gettext
hashlib hmac http/client http/cookies http/server imaplib inspect json/decoder logging/__init__ logging/config mailbox
mimetypes netrc optparse os pathlib/__init__ pdb pickle platform poplib random secrets shutil smtplib socket socketserver
sqlite3/dump ssl statistics string subprocess tarfile tempfile threading tokenize unittest/case unittest/mock urllib/parse
urllib/request urllib/robotparser uuid webbrowser xml/dom/minidom zipfile/__init__
""".split()
# Ordinary text, after which random strings are packed.
ORDINARY = """
def connect(host, port, timeout=30):
    # Open a connection and return a client for it.
    client = Client(host, port, timeout=timeout)
    client.login(os.environ["USER_NAME"], settings.get("PASSWORD_FILE"))
    if not client.is_open:
        raise ConnectionError("could not reach the service at %s:%d" % (host, port))
    return client.session(retries=3, user="admin")

The configuration of each service is kept in a file; its path is given by the option --config, e.g. /etc/service/config.yaml.
"""

_assign = regex.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", regex.I | regex.A)
_access = re.compile(r"AKIA[A-Z0-9]+")
_hex = re.compile(r"[0-9a-f]{16,}")
_sensitive = regex.compile(SENSITIVE, regex.I | regex.A)
_run = re.compile(r"[A-Za-z0-9+/_=.-]{%d,}" % SHORTEST)
_letter = re.compile(r"[A-Za-z]")
_classes = [(re.compile(f"[{c}]"), c) for c in ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ")]
_signs = re.compile(r"[+/_=.-]+")
_joints = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Z])(?=[A-Z][a-z])")


def base_spans(text: str, sensitive: bool) -> list[tuple[int, int, int]]:
    """(start, index of kind, end). ``sensitive``: False only if no assign keyword can be in the text."""
    found = [(m.start(), 0, m.end()) for m in _assign.finditer(text) if m.end(2) - m.start(2) >= 12] if sensitive else []
    found += [(m.start(), 1, m.end()) for m in _access.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in _hex.finditer(text)]
    return sorted(found)


def words(candidate: str) -> str:
    """An identifier's words, in lower case."""
    return _joints.sub(" ", _signs.sub(" ", candidate)).lower()


@lru_cache(1)
def dictionary() -> str:
    """Words of library code by how often they are used, and those of ``IDENTIFIERS``: what is used most stands last."""
    found: Counter[str] = Counter()
    for name in MODULES:
        try:
            with open(f"{os.path.dirname(os.__file__)}/{name}.py", encoding="utf-8") as f:
                found.update(w.lower() for w in re.findall(r"[A-Z]?[a-z]{2,}|[A-Z]{3,}", f.read()))
        except OSError:
            continue  # a library without its sources
    common = sorted((w for w, n in found.items() if len(w) >= 4 and n >= 2), key=lambda w: (found[w], w))
    return f"{' '.join(common)[-WORD_BYTES:]} {IDENTIFIERS}"


class Novelty:
    """A zstandard compressor primed with a dictionary; made once for a worker."""

    def __init__(self, primed: str):
        self.primed = primed
        known = zstandard.ZstdCompressionDict(primed.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_BTULTRA2, window_log=18, chain_log=17, hash_log=17, search_log=6, min_match=3, target_length=256, write_checksum=False, write_content_size=False, write_dict_id=False)
        self.pack = zstandard.ZstdCompressor(dict_data=known, compression_params=how).compress
        self.size, self.floor = lru_cache(256)(self.size_of), lru_cache(10_000)(self.floor_of)

    def size_of(self, around: bytes) -> int:
        return len(self.pack(around))

    def marginal(self, around: str, candidate: str) -> int:
        """Bytes that ``candidate`` needs after ordinary text and ``around``."""
        known = (ORDINARY + around).encode("utf-8", "replace") + b"\n"
        return len(self.pack(known + words(candidate).encode())) - self.size(known)

    def floor_of(self, alphabet: str, length: int) -> int:
        """The least that random strings of an alphabet need."""
        return min(self.marginal("", r) for r in random_strings(alphabet, length, FLOOR))

    def high(self, candidate: str) -> bool:
        """Whether the candidate needs what random strings of its classes need, or close to it. Lengths over 40 are taken in steps."""
        step = max(1, len(candidate) // 16) if len(candidate) > 40 else 1
        length = len(candidate) // step * step
        return self.marginal("", candidate) >= CLOSE * self.floor(alphabet_of(candidate), length)

    def high_in(self, candidate: str, around: str) -> bool:
        """The same after ``around``, with fewer strings and a margin."""
        if not around:
            return True
        usual = sorted(self.marginal(around, r) for r in random_strings(alphabet_of(candidate), len(candidate), SOME))[SOME // 2]
        return self.marginal(around, candidate) >= SHARE * usual


def alphabet_of(candidate: str) -> str:
    return "".join(chars for one, chars in _classes if one.search(candidate)) + "".join(sorted(set("+/_=.-").intersection(candidate)))


def random_strings(alphabet: str, length: int, n: int) -> list[str]:
    rnd = Random(f"{alphabet}{length}")
    return ["".join(rnd.choices(alphabet, k=length)) for _ in range(n)]


_novelty: list[Novelty] = []


def novelty(primed: str | None = None) -> Novelty:
    """This worker's compressor; ``primed``: the driver's dictionary."""
    if not _novelty or (primed is not None and _novelty[0].primed != primed):
        _novelty[:] = [Novelty(dictionary() if primed is None else primed)]
    return _novelty[0]


def surroundings(text: str, start: int, end: int) -> str:
    """The text around a candidate, without what it has in common with the candidate over ``SHORTEST`` or more characters."""
    own = {text[i : i + SHORTEST] for i in range(start, end - SHORTEST + 1)}
    out = []
    for part in (text[max(0, start - AROUND) : start], text[end : end + AROUND]):
        at = 0
        for i in range(len(part) - SHORTEST + 1):
            if part[i : i + SHORTEST] in own:
                out.append(part[at:i])
                at = i + SHORTEST
        out.append(part[at:])
    return "".join(out)


def known(start: int, end: int, base: list[tuple[int, int, int]]) -> bool:
    """Whether base spans have this place: all but a hex one that is only a part of it."""
    return any(b[0] < end and start < b[2] and (b[1] != 2 or (b[0] <= start and end <= b[2])) for b in base)


def occurrences(text: str, candidates: list[str], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Every place of each candidate in the text that base spans don't cover and that lies in no longer one."""
    found = set()
    for c in candidates:
        s = text.find(c)
        while s >= 0:
            found.add((s, -s - len(c)))
            s = text.find(c, s + len(c))
    out, last = [], 0
    for s, e in sorted(found):
        if -e > last:
            last = -e
            if not known(s, -e, base):
                out.append((s, 3, -e))
    return out


def novel_spans(text: str, sensitive: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates after each sensitive word (start, end) whose novelty is high, wherever they occur."""
    judge = novelty()
    novel: dict[str, bool] = {}
    looks = lru_cache(1024)(judge.high)
    seen = 0
    for _, after in sensitive:
        stop = after + CONTEXT
        for m in _run.finditer(text, max(after, seen)):
            if m.start() >= stop:
                break
            seen = m.end()
            s, e = m.start(), m.end()
            if m.group() not in novel and _letter.search(text, s, e) and not known(s, e, base):
                novel[m.group()] = looks(m.group()) and judge.high_in(m.group(), _run.sub(lambda r: "" if looks(r[0]) else r[0], surroundings(text, s, e)))
            if novel.get(m.group()):
                stop = max(stop, e + NEXT)
    return occurrences(text, [c for c, high in novel.items() if high], base)


def all_spans(text: str | None) -> list[tuple[int, int, int]]:
    """Every span of a text by start, then kind as listed."""
    text = text or ""
    sensitive = [m.span() for m in _sensitive.finditer(text)]
    base = base_spans(text, bool(sensitive))
    return sorted(base + novel_spans(text, sensitive, base)) if sensitive else base


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each run of overlapping or touching spans replaced by one mask."""
    out, at = [], 0
    for s, _, e in spans:
        if s > at or not out:
            out += [text[at:s], MASK]
        at = max(at, e)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame) -> DataFrame:
    """One row for each document with its spans."""
    primed = dictionary()

    def run(rows: dict) -> dict:
        novelty(primed)
        spans = [all_spans(t) for t in rows["text"]]
        base = [[x for x in xs if x[1] < 3] for xs in spans]
        return {
            "doc_id": rows["doc_id"],
            **{f"n_{KINDS[k]}": [sum(x[1] == k for x in xs) for xs in spans] for k in range(3)},
            "base_sha256": [hashlib.sha256(shown(xs).encode()).hexdigest() for xs in base],
            "spans": [shown(xs) for xs in spans],
        }

    return map_rows(docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text"), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the same columns, each secret in ``text`` masked and ``n_chars`` counted anew. Null texts stay null."""
    primed = dictionary()

    def run(rows: dict) -> dict:
        novelty(primed)
        text = [t if t is None else masked(t, all_spans(t)) for t in rows["text"]]
        return rows | {"text": text} | ({"n_chars": [n if t is None else len(t) for t, n in zip(text, rows["n_chars"], strict=True)]} if "n_chars" in rows else {})

    return map_rows(docs, run, docs.schema)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))
