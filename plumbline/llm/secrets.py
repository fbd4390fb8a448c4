"""Secret scans: patterns, and novelty of unusual strings under dictionary-primed zstandard."""

from __future__ import annotations

import hashlib
import re
from collections import deque

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Strings worth measuring: unbroken runs of 16 characters or more.
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
_PART = re.compile(r"[A-Za-z]+")
_CONSONANTS = re.compile(r"[b-df-hj-np-tv-xz]{6}", re.I)
_SENSITIVE = re.compile(r"passw|passphrase|pwd|secret|token|api.?key|credential|auth|bearer|private.?key|access.?key|signing|encrypt|certificate|-----BEGIN", re.I)
_LONGEST = 16
_PEM = re.compile(r"-----(BEGIN|END)\b")

#: What code and configuration around a string commonly says; primes the compressor so that ordinary names cost little.
IDENTIFIERS = (
    "import from return def class self function const let var public private static final void string int float double boolean true false null None "
    "password passwd secret token api_key apikey access_key secret_key private_key client_id client_secret auth authorization bearer credential username user "
    "account session cookie header request response status error message config configuration settings environment variable default value name type key index "
    "http https www com org net localhost example.com path file directory upload download version release build test debug info warning database connection "
    "host port server client timeout retry cache queue worker thread process memory buffer length size count number total average minimum maximum "
    "created_at updated_at deleted_at first_name last_name email_address phone_number get_value set_value get_item set_item add_item remove_item "
    "getElementById addEventListener innerHTML className toString valueOf hasOwnProperty prototype constructor undefined "
    "00000000 11111111 12345678 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789abcdef 2020-01-01 2024-12-31 00:00:00 "
)
CONTEXT = 256
#: Marginal compressed bytes per character from which a string is reported. Random base 64 costs 0.75, random
#: hexadecimal 0.5 and names made of common parts well below.
NOVELTY = 0.45


def wordlike(run: str) -> bool:
    """Whether a run is made as names and words are, so that its being new says nothing.

    Without letters it is a number or a rule. Without digits its letters decide: words join in camel case at most at every fifth letter, a quarter
    of their letters or more are vowels, and six consonants do not follow one another. Most runs of random letters fail one of these.
    """
    letters = "".join(_PART.findall(run))
    if not letters:
        return True
    if any(c.isdigit() for c in run):
        return False
    humps = sum(a.islower() and b.isupper() for a, b in zip(letters, letters[1:]))
    return 5 * humps < len(letters) and 4 * sum(c in "aeiouyAEIOUY" for c in letters) >= len(letters) and not _CONSONANTS.search(letters)


class Novelty:
    """Marginal compressed bytes of a string after its surroundings and the identifier dictionary."""

    def __init__(self, identifiers: str = IDENTIFIERS, level: int = 3):
        data = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.compressor = zstandard.ZstdCompressor(dict_data=data, compression_params=params)

    def marginal(self, around: str, candidate: str) -> float:
        without = around.encode("utf-8", "surrogatepass")
        extra = candidate.encode("utf-8", "surrogatepass")
        return (len(self.compressor.compress(without + b" " + extra)) - len(self.compressor.compress(without + b" "))) / max(len(extra), 1)


def _before(text: str, at: int, word: str) -> str:
    """The last ``CONTEXT`` characters before ``at`` beside copies of ``word``."""
    pieces: list[str] = []
    need = CONTEXT
    while need > 0 and at > 0:
        copy = text.rfind(word, max(0, at - need - len(word)), at)
        low = max(0, at - need) if copy < 0 else max(copy + len(word), at - need)
        pieces.append(text[low:at])
        need -= at - low
        at = copy
    return "".join(reversed(pieces))


def _after(text: str, at: int, word: str) -> str:
    """The first ``CONTEXT`` characters from ``at`` beside copies of ``word``."""
    pieces: list[str] = []
    need = CONTEXT
    while need > 0 and at < len(text):
        copy = text.find(word, at, at + need + len(word))
        high = at + need if copy < 0 else min(copy, at + need)
        pieces.append(text[at:high])
        need -= high - at
        at = copy + len(word) if copy >= 0 else len(text)
    return "".join(pieces)


class _Sensitive:
    """Whether a string, asked for from left to right, stands in a sensitive context; no part of the text is searched twice."""

    def __init__(self, text: str):
        self.text = text
        self.hits: deque[tuple[int, int]] = deque()
        self.scanned = 0
        self.marks: list[re.Match] | None = None
        self.mark = 0
        self.block = -1  # where the open PEM block ends, or how far it reaches without another string

    def __call__(self, start: int, end: int) -> bool:
        low, high = max(0, start - CONTEXT), min(len(self.text), end + CONTEXT)
        while self.hits and self.hits[0][0] < low:
            self.hits.popleft()
        if high > self.scanned:
            self.hits.extend(m.span() for m in _SENSITIVE.finditer(self.text, max(low, self.scanned - _LONGEST), high))
            self.scanned = high
        name = self.text.find("=", start, end - 1)
        own = start if name < 0 else name
        in_block = self._in_block(start, end)
        return in_block or any(e <= own or s >= end for s, e in self.hits)

    def _in_block(self, start: int, end: int) -> bool:
        if self.marks is None:
            self.marks = list(_PEM.finditer(self.text))
        while self.mark < len(self.marks) and self.marks[self.mark].start() < start:
            m = self.marks[self.mark]
            self.mark += 1
            after = self.marks[self.mark] if self.mark < len(self.marks) else None
            if m[1] == "END":
                self.block = -1
            else:
                self.block = after.start() if after and after[1] == "END" else m.end() + CONTEXT
        if start >= self.block:
            return False
        self.block = max(self.block, end + CONTEXT)
        return True


def scan(text: str | None, novelty: Novelty) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans) of a text as (kind, start, end), by start, then kind in the order of ``KINDS``.

    An unbroken run in a sensitive context that overlaps no base span and is not :func:`wordlike` is reported as ``novel`` if it costs at least
    ``NOVELTY`` compressed bytes a character beyond its surroundings: the ``CONTEXT`` characters on either side, not
    counting other copies of it. The context is sensitive if a sensitive word lies in those of the text, or before a ``=`` in the
    string, or if a PEM block is open; a block without an end goes on while strings follow within ``CONTEXT`` characters."""
    text = text or ""
    base = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    base += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    order = lambda s: (s[1], KINDS.index(s[0]))
    base.sort(key=order)
    more = []
    taken = iter(sorted((s, e) for _, s, e in base))
    now = next(taken, None)
    reach = -1
    sensitive = _Sensitive(text)
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        while now and now[0] < end:
            reach = max(reach, now[1])
            now = next(taken, None)
        if reach > start:
            continue
        if not sensitive(start, end) or wordlike(m[0]):
            continue
        around = _before(text, start, m[0]) + _after(text, end, m[0])
        if novelty.marginal(around, m[0]) >= NOVELTY:
            more.append(("novel", start, end))
    return base, sorted(base + more, key=order)


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _scans(batches):
    novelty = Novelty()
    for batch in batches:
        counts: dict[str, list[int]] = {k: [] for k in KINDS}
        digests, all_spans = [], []
        for text in batch.column("text").to_pylist():
            base, spans = scan(text, novelty)
            for k in KINDS:
                counts[k].append(sum(s[0] == k for s in spans))
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            all_spans.append(joined(spans))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(counts[k], pa.int64()) for k in KINDS], pa.array(digests, pa.string()), pa.array(all_spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """Secrets of every row of ``docs`` (doc_id, text), found in whole texts without a shuffle.

    Returns doc_id, n_assign, n_access, n_hex, n_novel, base_sha256 and spans ('kind:start:end', code points, end
    exclusive, comma-joined). Null and empty texts have no spans. Repeated rows give repeated rows. Null doc_id
    is kept; other columns are ignored. Empty input: no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scans, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
