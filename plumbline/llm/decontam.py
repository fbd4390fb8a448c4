"""Benchmark decontamination by template canonicalisation."""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

WINDOW = 5
#: Share of an item's windows that a document must hold to count as contaminated.
CONTAINED = 0.5
#: Words of a window that must not be placeholders.
LITERAL = 2
#: Most keys, and most characters of items, of a benchmark that is broadcast; a larger one is joined by shuffling.
BROADCAST_KEYS, BROADCAST_CHARS = 1_000_000, 32_000_000
#: Most digests of contaminated texts that are broadcast to drop their rows.
BROADCAST_DIGESTS = 1_000_000
#: Tokens of a whole template by which it is looked up.
SPAN = 8

#: Shortest item, in tokens, that is looked for inside longer documents; one or two words are no sign of a leak.
SHORTEST = 3

#: Scripts written without spaces (Thai, Lao, Myanmar, Khmer, kana, Han): each letter is a token.
_UNSPACED = "\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_TOKEN = re.compile(rf"\d+(?:[.,]\d+)*|[^\W\d_{_UNSPACED}]+|[^\W\d_]|[%$€£¥°]")
_SENTENCE_END = re.compile(r"(?:^|[.!?:;\n\"“(])\s*$")
UNITS = frozenset(
    "% $ € £ ¥ ° mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces oz pound pounds lb lbs ton tons tonnes "
    "ml cl l litre litres liter liters gallon gallons cup cups second seconds sec minute minutes min hour hours day days week weeks month months year years "
    "dollar dollars euro euros cent cents usd eur gbp percent mph kph hz khz mhz ghz kb mb gb tb w kw mw j kj cal kcal n pa bar v a".split()
)
_NUMBER, _UNIT, _NAME, _FIRST = 1, 2, 3, 4
_MULTIPLIER = np.int64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))


def tokens(text: str | None) -> tuple[list[str], list[bool]]:
    """Tokens of a text and which of them are names: capitalised words that do not open a sentence."""
    text = text or ""
    words, names = [], []
    for m in _TOKEN.finditer(text):
        word = m[0]
        words.append(word.lower())
        names.append(word[0].isupper() and len(word) > 1 and not word.isupper() and not _SENTENCE_END.search(text, max(0, m.start() - 6), m.start()))
    return words, names


class _Words(dict):
    """Word ids; unknown numbers have the number's placeholder and unknown words 0."""

    def __missing__(self, word: str) -> int:
        return _NUMBER if word[0].isdigit() else 0


def _typed(ids: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Put the unit placeholder where a unit stands beside a number."""
    number = ids == _NUMBER
    beside = np.zeros(len(ids), bool)
    beside[1:] |= number[:-1]
    beside[:-1] |= number[1:]
    return np.where(units & beside, _UNIT, ids)


def _windows(ids: np.ndarray) -> np.ndarray:
    n = len(ids) - WINDOW + 1
    out = np.zeros(max(n, 0), np.int64)
    with np.errstate(over="ignore"):
        for j in range(WINDOW):
            out = out * _MULTIPLIER + ids[j : j + n]
    return out


def _spans(ids: np.ndarray, lengths: list[int]):
    """For each length the places whose ``length`` ids are all known, and the hashes of those ids."""
    powers = np.cumprod(np.full(len(ids), _MULTIPLIER.view(np.uint64)))
    back = np.cumprod(np.full(len(ids), _INVERSE))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(ids.astype(np.uint64) * powers)))
    gaps = np.concatenate((np.zeros(1, np.int64), np.cumsum(ids == 0)))
    for n in lengths:
        if n <= len(ids):
            place = np.flatnonzero(gaps[n:] == gaps[:-n])
            yield n, place, (sums[place + n] - sums[place]) * back[place]


class Index:
    """The windows of benchmark items, with literal and with name placeholders, and whole templates of items that have no window."""

    def __init__(self, items: list[tuple[int, str]]):
        self.words = _Words()
        self.unit_ids: list[int] = []
        self.items = [i for i, _ in items]
        self.tokens: list[list[str]] = []
        self.forms: list[np.ndarray] = []
        self.whole: dict[tuple[str, ...], list[int]] = {}
        self.total = np.zeros(len(items), np.int64)
        self.templates: dict[bool, dict[int, list[tuple[int, int]]]] = {False: {}, True: {}}
        self.named = False
        keys, owners, places = [], [], []
        for at, (_, text) in enumerate(items):
            words, names = tokens(text)
            self.tokens.append(words)
            ids = np.array([self._id(w) for w in words], np.int64)
            ids = _typed(ids, np.array([w in UNITS for w in words], bool)) if words else ids
            named = np.where(np.array(names, bool), _NAME, ids) if words else ids
            self.named |= bool(np.any(named == _NAME))
            self.forms.append(named)
            usable = False
            for form in (ids, named):
                literal = np.convolve(form >= _FIRST, np.ones(WINDOW, int), "valid") if len(form) >= WINDOW else np.empty(0)
                place = np.flatnonzero(literal >= LITERAL)
                if form is ids:
                    self.total[at] = len(place)
                    usable = bool(len(place))
                if len(place):
                    keys.append(_windows(form)[place])
                    owners.append(np.full(len(place), at))
                    places.append(place)
            if not usable and words:
                if len(words) < SHORTEST:
                    self.whole.setdefault(tuple(words), []).append(at)
                else:
                    self._template(at, ids, named)
        self.keys = np.concatenate(keys) if keys else np.empty(0, np.int64)
        owner, place = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (owners, places))
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.owner, self.place = self.keys[order], owner[order], place[order]
        self.names = np.unique(self.keys)
        self.units = np.array(sorted(i for w, i in self.words.items() if w in UNITS), np.int64)
        self._lengths = {named: sorted(t) for named, t in self.templates.items()}
        self._keys = {named: {n: np.array(sorted({k for k, _ in rows}), np.uint64) for n, rows in t.items()} for named, t in self.templates.items()}
        for unit in UNITS:  # a unit beside a number is a placeholder even if no item says it
            self.words.setdefault(unit, -1)

    def _id(self, word: str) -> int:
        if word[0].isdigit():
            return _NUMBER
        if word not in self.words:
            self.words[word] = _FIRST + len(self.words)
        return self.words[word]

    def _template(self, at: int, ids: np.ndarray, named: np.ndarray) -> None:
        """Keep an item's whole template. Units are placeholders wherever they stand, as a text may put a number beside
        the item's first or last word; :meth:`_stands` compares those that the item does not have beside a number."""
        units = np.array([w in UNITS for w in self.tokens[at]], bool)
        for is_named, form in ((False, ids), (True, named)):
            if is_named and (np.array_equal(ids, named) or np.sum(form >= _FIRST) < LITERAL):
                continue
            loose = np.where(units & (form != _NAME), _UNIT, form)
            [(n, _, key)] = _spans(loose, [len(loose)])
            self.templates[is_named].setdefault(n, []).append((int(key[0]), at))

    def _stands(self, at: int, named: bool, words: list[str]) -> tuple[int, int] | None:
        """Slots and changed slots if ``words`` are the item's template, its slots filled consistently; with fewer than ``LITERAL``
        words beside the slots, if they are the item's own words."""
        form, own = self.forms[at], self.tokens[at]
        if not named:
            form = np.where(form == _NAME, _FIRST, form)
        if np.sum(form >= _FIRST) < LITERAL:
            if words != own:
                return None
        slots: dict[tuple[int, str], str] = {}
        for kind, mine, word in zip(form.tolist(), own, words):
            if kind >= _FIRST:
                if word != mine:
                    return None
            elif slots.setdefault((kind, mine), word) != word:
                return None
        return len(slots), sum(v != k[1] for k, v in slots.items())

    def _whole_hits(self, ids: np.ndarray, named: bool):
        """(place, length, item) where ids with every unit as placeholder have the hash of a whole template."""
        for n, place, key in _spans(ids, self._lengths[named]):
            names = self._keys[named][n]
            at = np.minimum(np.searchsorted(names, key), len(names) - 1)
            rows: dict[int, list[int]] = {}
            for k, item in self.templates[named][n]:
                rows.setdefault(k, []).append(item)
            for p in np.flatnonzero(names[at] == key).tolist():
                for item in rows[int(key[p])]:
                    yield int(place[p]), n, item

    def ids(self, words: list[str], every_unit: bool = False) -> np.ndarray:
        out = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        unit = (out == -1) | np.isin(out, self.units)
        out = np.where(unit, _UNIT, out) if every_unit else _typed(out, unit)
        return np.maximum(out, 0)

    def hits(self, ids: np.ndarray) -> np.ndarray:
        """Positions of windows of ``ids`` that are windows of an item."""
        if len(ids) < WINDOW or not len(self.names):
            return np.empty(0, np.int64)
        known = np.convolve(ids > 0, np.ones(WINDOW, np.int64), "valid") == WINDOW
        place = np.flatnonzero(known)
        if not len(place):
            return place
        value = _windows(ids)[place]
        at = np.minimum(np.searchsorted(self.names, value), len(self.names) - 1)
        return place[self.names[at] == value]

    def search(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int, int]]]:
        """For each text its contaminated items: (place in ``items``, windows, windows found, slots, changed slots)."""
        out: list[list] = [[] for _ in texts]
        split, all_ids, bounds = [], [], [0]
        for text in texts:
            words = _TOKEN.findall((text or "").lower())
            split.append(words)
            all_ids += [self.ids(words), np.zeros(WINDOW, np.int64)]
            bounds.append(bounds[-1] + len(words) + WINDOW)
        flat = np.concatenate(all_ids) if all_ids else np.empty(0, np.int64)
        doc = np.searchsorted(bounds, self.hits(flat), "right") - 1
        suspects = set(doc.tolist())
        if self.named:
            suspects |= {i for i, t in enumerate(texts) if t and self._named_hits(t)}
        for i in suspects:
            out[i] = self._verify(texts[i], split[i])
        if self.whole:
            for i, words in enumerate(split):
                out[i] += [(at, 0, 0, 0, 0) for at in self.whole.get(tuple(words), [])]
        for named in (False, True):
            if self.templates[named]:
                for i, (text, words) in enumerate(zip(texts, split)):
                    out[i] = self._templates_in(out[i], text, words, named)
        return out

    def _templates_in(self, found: list, text: str | None, words: list[str], named: bool) -> list:
        """``found`` with the items whose whole template is in the text; of several places the least changed counts."""
        best = {f[0]: f for f in found}
        ids = self._named(text or "", True) if named else self.ids(words, True)
        for p, n, at in self._whole_hits(ids, named):
            slots = self._stands(at, named, words[p : p + n])
            if slots and (at not in best or slots[1] < best[at][4]):
                best[at] = (at, 1, 1, *slots)
        return sorted(best.values())

    def _named(self, text: str, every_unit: bool = False) -> np.ndarray:
        words, names = tokens(text)
        ids = self.ids(words, every_unit)
        return np.where(np.array(names, bool), _NAME, ids) if words else ids

    def _named_hits(self, text: str) -> bool:
        return bool(len(self.hits(self._named(text))))

    def _verify(self, text: str | None, words: list[str]) -> list[tuple[int, int, int, int, int]]:
        found: dict[int, set[tuple[int, int]]] = {}
        forms = [self.ids(words)] + ([self._named(text)] if self.named else [])
        for ids in forms:
            value = _windows(ids)
            for p in self.hits(ids).tolist():
                i, j = np.searchsorted(self.keys, value[p], "left"), np.searchsorted(self.keys, value[p], "right")
                for k in range(i, j):
                    found.setdefault(int(self.owner[k]), set()).add((p, int(self.place[k])))
        out = []
        for at, pairs in found.items():
            need = math.ceil(CONTAINED * self.total[at])
            if len({q for _, q in pairs}) < need:
                continue
            best, good = self._assigned(at, pairs, words, need)
            if len(good) >= need:
                out.append((at, int(self.total[at]), len(good), len(best), sum(v != s[1] for s, v in best.items())))
        return sorted(out)

    def _assigned(self, at: int, pairs: set[tuple[int, int]], words: list[str], need: int) -> tuple[dict, set[int]]:
        """The values of an item's slots and its windows that agree with them. The commonest values of the whole text are tried first;
        if they do not bring ``need`` windows, each passage by itself: windows whose place in the text less their place in the item
        is nearly the same, where values at just that distance go before those of its neighbours."""
        form, own = self.forms[at], self.tokens[at]
        slots = [(int(f), w) if f < _FIRST else None for f, w in zip(form.tolist(), own)]

        def votes(chosen) -> dict:
            count: dict[tuple[int, str], Counter] = {}
            for p, q in chosen:
                for j in range(WINDOW):
                    if slots[q + j]:
                        count.setdefault(slots[q + j], Counter())[words[p + j]] += 1
            return {slot: min(c.items(), key=lambda x: (-x[1], x[0]))[0] for slot, c in count.items()}

        def agreeing(chosen, best) -> set[int]:
            return {q for p, q in chosen if all(not slots[q + j] or words[p + j] == best[slots[q + j]] for j in range(WINDOW))}

        best = votes(pairs)
        good = agreeing(pairs, best)
        if len(good) >= need or not best:
            return best, good
        lines: dict[int, list[tuple[int, int]]] = {}
        for p, q in pairs:
            lines.setdefault(p - q, []).append((p, q))
        slack = max(2, len(own) // 4)
        order = sorted(lines)
        first = last = 0
        for d in order:
            while order[first] < d - slack:
                first += 1
            while last < len(order) and order[last] <= d + slack:
                last += 1
            near = [x for e in order[first:last] for x in lines[e]]
            if len({q for _, q in near}) < need:
                continue
            here = votes(near) | votes(lines[d])
            found = agreeing(near, here)
            if len(found) > len(good):
                best, good = here, found
        return best, good


# ---------------------------------------------------------------------------------------------------------
# Keys by which documents and items are joined: hashes of canonical windows, and of the beginnings of whole templates.

_SPAN_SALT, _SHORT_SALT = np.int64(0x1B873593CC9E2D51), np.int64(0x2545F4914F6CDD1D)


#: A word that parts the texts of a batch.
_BREAK = "\0"


def _word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) - (1 << 63)


class _Hashes(dict):
    """64-bit ids of words: breaks 0, numbers all alike, others hashes with bit 4 set, so that they are no placeholder's, and bit 5 telling units.
    Kept small by starting anew."""

    MOST = 1 << 20

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        value = 0 if word == _BREAK else _NUMBER if word[0].isdigit() else _word_hash(word) & ~48 | 16 | 32 * (word in UNITS)
        self[word] = value
        return value


_hashes = _Hashes()


def _ids(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    ids = np.fromiter(map(_hashes.__getitem__, words), np.int64, len(words))
    return ids, ids & 48 == 48


def _window_keys(form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the windows of a canonical form with ``LITERAL`` words or more beside placeholders, and their hashes."""
    if len(form) < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    literal, gaps = (np.concatenate(([0], np.cumsum(x))) for x in ((form < 0) | (form >= _FIRST), form == 0))
    place = np.flatnonzero((literal[WINDOW:] - literal[:-WINDOW] >= LITERAL) & (gaps[WINDOW:] == gaps[:-WINDOW]))
    return place, _windows(form)[place]


def _span_keys(form: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` ids from every place."""
    out = np.full(max(len(form) - n + 1, 0), _SPAN_SALT + np.int64(n))
    with np.errstate(over="ignore"):
        for j in range(n):
            out = out * _MULTIPLIER + form[j : j + len(out)]
    return out


def _short_key(words: list[str]) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _span_keys(np.array([_word_hash(w) for w in words], np.int64), len(words)) * _SHORT_SALT


def _forms(words: list[str], names: list[bool]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Canonical forms of words (units beside numbers as placeholders) and loose ones (all units), the second of each with names."""
    if not words:
        return [], []
    ids, units = _ids(words)
    plain, loose = [_typed(ids, units)], [np.where(units, _UNIT, ids)]
    if any(names):
        mark = np.array(names, bool)
        plain.append(np.where(mark, _NAME, plain[0]))
        loose.append(np.where(mark, _NAME, loose[0]))
    return plain, loose


class Known:
    """The sorted keys of all items, with a table of their low bits that answers most questions."""

    BITS = 20

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.table = np.zeros(1 << self.BITS, bool)
        self.table[self.keys & ((1 << self.BITS) - 1)] = True

    def among(self, keys: np.ndarray) -> np.ndarray:
        """Places of ``keys`` that are an item's."""
        place = np.flatnonzero(self.table[keys & ((1 << self.BITS) - 1)])
        at = np.minimum(np.searchsorted(self.keys, keys[place]), len(self.keys) - 1)
        return place[self.keys[at] == keys[place]] if len(self.keys) else place[:0]


def document_keys(texts: list[str | None], named: bool, spans: list[int], known: Known | None) -> list[np.ndarray]:
    """The distinct keys of each whole text: its windows, spans of the given lengths and, if it has one or two words only, all of it;
    of these only the known ones, if given."""
    words, names, bounds, found = [], [], [0], []

    def take(keys: np.ndarray, place: np.ndarray) -> None:
        if known is not None:
            hit = known.among(keys)
            keys, place = keys[hit], place[hit]
        found.append((np.searchsorted(bounds, place, "right") - 1, keys))

    short = []
    for i, text in enumerate(texts):
        own, flags = tokens(text) if named else (_TOKEN.findall((text or "").lower()), [])
        if 0 < len(own) < SHORTEST:
            short.append((i, _short_key(own)))
        words += own
        words += [_BREAK] * SPAN
        if named:
            names += flags
            names += [False] * SPAN
        bounds.append(len(words))
    plain, loose = _forms(words, names)
    for form in plain:
        place, keys = _window_keys(form)
        take(keys, place)
    for form in loose:
        gaps = np.concatenate(([0], np.cumsum(form == 0)))
        for n in spans:
            place = np.flatnonzero(gaps[n:] == gaps[:-n])
            take(_span_keys(form, n)[place], place)
    for i, keys in short:
        take(keys, np.array([bounds[i]]))
    doc, keys = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2
    order = np.lexsort((keys, doc))
    doc, keys = doc[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])
    doc, keys = doc[new], keys[new]
    ends = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [keys[i:j] for i, j in zip(ends, ends[1:])]


def item_keys(text: str) -> tuple[list[int], list[int], int, int, bool]:
    """(probes, keys, least, span, named) of an item.

    A document that holds enough of the item's windows has ``least`` of ``keys`` at least and one of ``probes``: with need of n
    windows found, one lies among any n - need + 1. An item without a window is looked up by the first ``span`` tokens of its template.
    """
    words, names = tokens(text)
    if not words:
        return [], [], 1, 0, False
    plain, loose = _forms(words, names)
    total = len(_window_keys(plain[0])[0])
    named = len(plain) > 1
    if total:
        at: dict[int, set[int]] = {}
        for form in plain:
            for place, key in zip(*(x.tolist() for x in _window_keys(form))):
                at.setdefault(place, set()).add(key)
        need = math.ceil(CONTAINED * total)
        order = sorted(at, key=lambda p: (min(at[p]), p))
        probes = set().union(*(at[p] for p in order[: len(at) - need + 1]))
        cover = Counter(k for ks in at.values() for k in ks)
        least, covered = 0, 0
        for n in sorted(cover.values(), reverse=True):
            if covered >= need:
                break
            least, covered = least + 1, covered + n
        return sorted(probes), sorted(cover), least, 0, named
    if len(words) < SHORTEST:
        keys = _short_key(words).tolist()
        return keys, keys, 1, 0, False
    span = min(len(words), SPAN)
    keys = sorted({int(_span_keys(f[:span], span)[0]) for f in loose})
    return keys, keys, 1, span, named


_ITEM = "item_id long, item string, probes array<long>, keys array<long>, least int, span int, named boolean"


def _item_rows(batches):
    for batch in batches:
        rows = [item_keys(t) for t in batch.column("item").to_pylist()]
        kinds = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("item"), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], ["item_id", "item", "probes", "keys", "least", "span", "named"])


def _keyed(named: bool, spans: list[int], known, others: list[str]):
    def run(batches):
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                keys = document_keys(batch.column("text").to_pylist(), named, spans, known.value if known is not None else None)
                ends = np.cumsum([0] + [len(k) for k in keys])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys), pa.int64()))
                out = pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], lists], [*others, "keys_of"])
                yield out.filter(pa.array(np.diff(ends) > 0))

    return run


@lru_cache(4096)
def _index(item: str) -> Index:
    return Index([(0, item)])


def _verified(kept: list[str]):
    def run(batches):
        for batch in batches:
            at, rest = [], []
            for i, (text, item) in enumerate(zip(batch.column("text").to_pylist(), batch.column("item").to_pylist())):
                for f in _index(item).search([text])[0]:
                    at.append(i)
                    rest.append(f[1:])
            columns = [batch.column(c).take(pa.array(at, pa.int64())) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array([r[k] for r in rest], pa.int64()) for k in range(4)]], [*kept, "n_windows", "n_found", "n_slots", "n_changed"])

    return run


def _pairs(docs: DataFrame, benchmark: DataFrame, kept: str) -> DataFrame:
    """``kept`` of the documents, item_id and what was found, for every document and item that it holds."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item"))
    items = checkpoint(items.mapInArrow(_item_rows, _ITEM).where("size(keys) > 0").withColumn("ref", F.monotonically_increasing_id()))
    facts = items.agg(F.collect_set("span").alias("spans"), F.max("named").alias("named"), F.sum(F.size("keys")).alias("n"), F.sum(F.length("item")).alias("chars")).first()
    small = (facts["n"] or 0) <= BROADCAST_KEYS and (facts["chars"] or 0) <= BROADCAST_CHARS
    send = F.broadcast if small else lambda x: x

    kind = docs.schema[kept].dataType.simpleString()
    spans = sorted(n for n in facts["spans"] if n)  # SPAN lengths at most
    others = [kept, "text"]
    known = None
    if small:  # then a document's other keys need not leave its batch
        keys = items.select(F.explode("keys").alias("key")).distinct().toPandas()["key"].to_numpy(np.int64)
        known = docs.sparkSession.sparkContext.broadcast(Known(keys))
    keyed = docs.select(*others).mapInArrow(_keyed(bool(facts["named"]), spans, known, others), f"{kept} {kind}, text string, keys_of array<long>")
    probes = items.select(F.explode("probes").alias("probe"), F.col("ref").alias("of"))
    hits = keyed.select(*others, "keys_of", F.explode_outer("keys_of").alias("at")).join(send(probes), F.col("at") == F.col("probe"))
    hits = hits.join(send(items.select("item_id", "item", "probes", "keys", "least", "ref")), F.col("of") == F.col("ref"))
    # of the probes that a document and an item share, the least one speaks for all; then enough keys must be shared
    hits = hits.where(F.col("at").eqNullSafe(F.array_min(F.array_intersect("keys_of", "probes")))).where(F.size(F.array_intersect("keys_of", "keys")) >= F.col("least"))
    return hits.select(kept, "text", "item_id", "item").mapInArrow(_verified([kept, "item_id"]), f"{kept} {kind}, item_id long, n_windows long, n_found long, n_slots long, n_changed long")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id) pairs where a document holds a benchmark item, verbatim or with other numbers, names or units.

    Tokens are numbers, words and currency or unit signs, in lower case. Numbers, units beside numbers and (in a
    second form) names inside sentences become typed placeholders; windows of five tokens, two of them literal at
    least, are hashed and joined. A pair counts if at least half of the item's windows are found and each value
    of the item's slots stands for one value throughout the document, or throughout one passage of it; windows that
    contradict the commonest assignment there are not counted. An item without such a window is found where its whole template stands, of any length and anywhere
    in a document, with consistent slots, or with its own numbers if it has fewer than two literal tokens; it counts as one
    window. Letters of scripts without spaces are tokens each. Items of one or two tokens match only documents that are nothing else.

    Returns doc_id, item_id, n_windows, n_found, n_slots, n_changed. Null or empty texts match nothing; null doc_id
    is kept. Repeated documents give repeated rows; two items with one id give a row each. Empty tables: no rows.
    Other columns are ignored.

    Plan: documents and items become arrays of window hashes in Arrow batches; the documents' hashes are joined with the items' probes;
    pairs that share enough hashes, counted in arrays, are checked for consistent slots in Arrow batches. If the items' hashes are
    measured to be few (``BROADCAST_KEYS``), they are sent to the documents' batches, so that no other hash leaves them, and the joins broadcast;
    else the joins shuffle. No item's or document's text reaches the driver.
    """
    return _pairs(docs, benchmark, "doc_id")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose texts :func:`contaminated` has no pair for.

    Rows go by a digest of their text, so ids may be null or repeated; rows of equal text share their fate. Null texts stay. Empty tables:
    nothing goes. The digests of contaminated texts are broadcast if their measured number is small, else the rows are shuffled by digest.
    """
    texts = docs.select(F.md5("text").alias("__digest"), "text").where("text is not null")
    bad = checkpoint(_pairs(texts, benchmark, "__digest").select("__digest").distinct())
    bad = F.broadcast(bad) if bad.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS else bad
    return docs.withColumn("__digest", F.md5("text")).join(bad, "__digest", "left_anti").select(*docs.columns)


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
