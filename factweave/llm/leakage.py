"""Evaluation texts that leak into training text (problem 7).

A distributed positional inverted index. Items are a table: their tokens, the wording that several of
them share, and their phrases of five words are found by aggregations, so that their number may grow.

* The corpus is read once, whatever the number of items. The pass stores postings (term, document,
  positions) of test terms where five words in a row are linked in pairs as in some item, and an item's
  length around; what it takes along are bitmaps of pairs and terms of a fixed size, which can store a
  posting too much but never miss one.
* Each phrase looks up the list of its rarest term, the one with the shortest list; shifted by the term's
  offset, the positions are where the phrase would start. With each position stand the hashes of the five
  phrases that it is part of, so that the lists of the other terms are intersected without being fetched.
  Then the lists of those documents are, which gives exact phrases; each is extended on both sides over the
  lists of its neighbours, across changed words, to a match by proximity.

A stretch of twelve words with at most one word in eight changed, left out or added always keeps five
neighbouring words, so nothing is lost.
"""

from __future__ import annotations

import html
import itertools
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.tables import cut_lineage, spread

#: Bits of each bitmap that travels to the executors (2 MiB), whatever the number of items.
BITMAP_BITS = 1 << 24
#: Items with at most this many words in all are held by the driver and travel to the executors whole; larger
#: sets stay tables and are joined.
CARRIED_WORDS = 200_000
#: A stretch is this many words; a Chinese character counts as 12/30 of a word.
STRETCH_WORDS = 12.0
CJK_WEIGHT = 0.4
#: Words of an exact phrase that every stretch keeps.
PHRASE = 5
#: One word in this many may be changed.
CHANGED = 8
#: Runs of this many words that occur in several items are shared wording.
SHARED_RUN = 6
#: Least words of a stretch that are not shared wording.
OWN_WORDS = 6.0

_TOKEN = re.compile(r"[㐀-䶿一-鿿豈-﫿]|[^\W_㐀-䶿一-鿿豈-﫿]+")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]*>|<!--.*?-->")
_ASCII_TOKEN = re.compile(r"[a-z0-9]+")
_WORD_TOKEN = re.compile(r"[^\W_]+")
_HAS_CJK = re.compile(r"[㐀-䶿一-鿿豈-﫿]")
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|([nrtbfv])|(.))", re.S)
_INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤﻿︀-️]")
_BROKEN = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t]*(?=[^\W\d_])")


def _unescape(m: re.Match) -> str:
    if m[1] or m[2]:
        c = chr(int(m[1] or m[2], 16))
        return c if not "\ud800" <= c <= "\udfff" else " "
    return " " if m[3] else m[4]


def tokens_of(text: str | None) -> list[str]:
    """Words in lower case and single Chinese characters, without markup, escapes and invisible signs."""
    if not text:
        return []
    if "\\" in text:
        text = _ESCAPE.sub(_unescape, text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    if "-\n" in text or "-\r" in text:
        text = _BROKEN.sub("", text)
    text = text.lower()
    if text.isascii():
        return _ASCII_TOKEN.findall(text)
    return (_TOKEN if _HAS_CJK.search(text) else _WORD_TOKEN).findall(text)


def _weight(token: str) -> float:
    return CJK_WEIGHT if _HAS_CJK.match(token) else 1.0


class Item:
    """An item's tokens, their weights, and which of them are wording of its own; ``shared`` are the places
    of runs of ``SHARED_RUN`` words that other items hold too."""

    def __init__(self, tokens: Sequence[str], shared: Sequence[int] = ()):
        self.tokens = list(tokens)
        self.weights = [_weight(t) for t in self.tokens]
        self.own = [True] * len(self.tokens)
        for i in shared:
            self.own[i : i + SHARED_RUN] = [False] * SHARED_RUN
        if sum(w for w, o in zip(self.weights, self.own, strict=True) if o) < OWN_WORDS and sum(self.weights) < STRETCH_WORDS:
            self.own = [True] * len(self.tokens)  # a short item of common wording can only be found whole
        #: Running weights of all words and of the item's own.
        self.total, self.mine = [0.0], [0.0]
        for w, x in zip(self.weights, self.own, strict=True):
            self.total.append(self.total[-1] + w)
            self.mine.append(self.mine[-1] + (w if x else 0.0))

    def phrases(self) -> list[tuple[int, list[str]]]:
        """Offsets and words of the phrases with a word of the item's own; of a short item, itself."""
        n = min(PHRASE, len(self.tokens))
        return [(i, self.tokens[i : i + n]) for i in range(len(self.tokens) - n + 1) if any(self.own[i : i + n])]


def _run(tokens: list[str], at: dict[int, str], o: int, p: int, step: int) -> int:
    k = 0
    n = len(tokens)
    while 0 <= o < n and at.get(p) == tokens[o]:
        o += step
        p += step
        k += 1
    return k


#: Ways over a change: words of the item and of the document that are skipped, the cheapest first. Longer
#: ones need no way: of a stretch with four changes in a row, what is on one side is a stretch by itself.
_STEPS = [(1, 1), (1, 0), (0, 1), (2, 2), (2, 1), (1, 2), (2, 0), (0, 2), (3, 3), (3, 2), (2, 3)]


def _extend(item: Item, at: dict[int, str], o: int, p: int, step: int) -> list[tuple[int, float]]:
    """Ends (offset in the item, changes so far) of a match that is carried on from (o, p)."""
    ends = []
    changes = 0.0
    tokens = item.tokens
    while True:
        best = None
        for skip, gap in _STEPS:
            k = _run(tokens, at, o + step * skip, p + step * gap, step)
            if k and (best is None or k - 3 * max(skip, gap) > best[0]):
                best = (k - 3 * max(skip, gap), skip, gap, k)
        if best is None:
            break
        _, skip, gap, k = best
        lost = item.weights[o : o + skip] if step > 0 else item.weights[max(0, o - skip + 1) : o + 1]
        masked = skip and not any(item.own[o : o + skip] if step > 0 else item.own[max(0, o - skip + 1) : o + 1])
        extra = (gap - skip) * item.weights[min(max(o, 0), len(tokens) - 1)] if gap > skip else 0.0
        changes += 0.0 if masked else sum(lost) + extra
        o += step * (skip + k)
        p += step * (gap + k)
        ends.append((o, changes))
    return ends


def repeats(item: Item, at: dict[int, str], o: int, p: int, k: int) -> bool:
    """Whether the document words ``at`` their positions, which repeat ``k`` words of the item from
    offset ``o`` at position ``p``, make up a stretch of the item there.

    The stretch must be long enough with the changed words it takes in, hold enough words of the
    item's own, and have at most one change in eight of those.
    """
    whole = item.total[-1]
    need = min(STRETCH_WORDS, whole) - 1e-9
    need_own = min(OWN_WORDS, item.mine[-1], whole) - 1e-9
    lefts = [(o, 0.0)] + [(e + 1, c) for e, c in _extend(item, at, o - 1, p - 1, -1)]
    rights = [(o + k, 0.0)] + _extend(item, at, o + k, p + k, 1)
    for a, lost in lefts:
        for b, more in rights:
            own = item.mine[b] - item.mine[a]
            if item.total[b] - item.total[a] >= need and own >= need_own and own >= CHANGED * (lost + more) - 1e-9:
                return True
    return False


class _Hashes(dict):
    """Hashes of tokens, kept for those that recur."""

    def __missing__(self, token: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        h = self[token] = zlib.crc32(token.encode("utf-8", "surrogatepass"))
        return h

    def of(self, tokens: Sequence[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def _mixed(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` neighbouring hashes."""
    size = max(len(hashes) - n + 1, 0)
    mixed = np.full(size, n, np.uint64)
    for k in range(n):
        mixed = (mixed ^ hashes[k : k + size]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def _slots(hashes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The place in a bitmap of each ``n`` neighbouring hashes."""
    return (_mixed(hashes, n) & np.uint64(bits - 1)).astype(np.int64)


def _grams(hashes: np.ndarray) -> np.ndarray:
    """The hash of each five neighbouring words, as it is stored."""
    return (_mixed(hashes, PHRASE) >> np.uint64(32)).astype(np.uint32).view(np.int32)


class Filter(NamedTuple):
    """What decides which postings are stored: bitmaps, packed, of the items' terms, of pairs of
    neighbouring words within phrases, and of whole items shorter than a phrase by their length; and how
    many words around a phrase are stored."""

    bits: int
    terms: bytes
    pairs: bytes
    short: dict[int, bytes]
    reach: int


class Texts(NamedTuple):
    """The different texts of the items: ``text_key, tokens, shared``, the most words of one of them, and the
    same rows on the driver if they are few."""

    rows: DataFrame
    longest: int
    carried: pa.Table | None

    def flat_map(self, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, types: pa.Schema) -> DataFrame:
        """What ``f`` makes of the rows, on the executors or, of few rows, here."""
        if self.carried is None:
            return self.rows.mapInArrow(f, schema)
        out = pa.Table.from_batches(f(iter(self.carried.to_batches())), types)
        spark = self.rows.sparkSession
        return spark.createDataFrame(out) if out.num_rows else spark.createDataFrame([], schema)


def phrase_filter(texts: Texts, bits: int = BITMAP_BITS) -> Filter:
    """The filter of prepared items. The driver gets the numbers of the bits that are set, each once, at
    most ``bits`` for each of six bitmaps."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in batches:
            found: set[tuple[int, int]] = set()
            for tokens, shared in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                h = hashes.of(tokens)
                found.update((0, x) for x in _slots(h, 1, bits).tolist())
                pairs, n = _slots(h, 2, bits).tolist(), len(tokens)
                for offset, _ in Item(tokens, shared or ()).phrases():
                    if n < PHRASE:
                        found.add((n, int(_slots(h, n, bits)[0])))
                    else:
                        found.update((PHRASE, x) for x in pairs[offset : offset + PHRASE - 1])
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([x for _, x in found], pa.int32())], names=["kind", "slot"])

    types = pa.schema([("kind", pa.int32()), ("slot", pa.int32())])
    if texts.carried is None:
        held = texts.rows.mapInArrow(slots, "kind int, slot int").distinct().toArrow()
    else:
        held = pa.Table.from_batches(slots(iter(texts.carried.to_batches())), types)
    kinds, places = held.column("kind").to_numpy(), held.column("slot").to_numpy()

    def bitmap(kind: int) -> bytes:
        on = np.zeros(bits, bool)
        on[places[kinds == kind]] = True
        return np.packbits(on).tobytes()

    return Filter(bits, bitmap(0), bitmap(PHRASE), {n: bitmap(n) for n in range(1, PHRASE) if (kinds == n).any()}, texts.longest * 5 // 4 + 16)


def postings(documents: DataFrame, key: str, text: str, keep: Filter) -> DataFrame:
    """``term, <key>, positions, grams``: the index, of every document, in one narrow pass. ``grams`` has
    five numbers for each position: the hashes of the phrases in which it has place 0 to 4."""
    kind = documents.schema[key].dataType.simpleString()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = lambda packed: np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        terms, pairs, short = unpack(keep.terms), unpack(keep.pairs), {n: unpack(x) for n, x in keep.short.items()}
        hashes = _Hashes()
        for b in batches:
            docs = [tokens_of(t) for t in b.column(1).to_pylist()]
            ends = np.cumsum([len(d) for d in docs])
            flat = list(itertools.chain.from_iterable(docs))
            h = hashes.of(flat)
            total = len(flat)
            linked = pairs[_slots(h, 2, keep.bits)]
            linked[ends[(ends > 0) & (ends < total)] - 1] = False  # not from one document to the next
            starts = linked[: max(total - PHRASE + 1, 0)].copy()
            for k in range(1, PHRASE - 1):
                starts &= linked[k : k + len(starts)]
            found = [np.nonzero(starts)[0]]
            for n, whole in short.items():
                at = np.nonzero(whole[_slots(h, n, keep.bits)])[0]
                found.append(at[np.searchsorted(ends, at, "right") == np.searchsorted(ends, at + n - 1, "right")])
            at = np.concatenate(found)
            owner = np.searchsorted(ends, at, "right")
            first = np.concatenate([[0], ends])[owner]
            cover = np.zeros(total + 1, np.int64)
            np.add.at(cover, np.maximum(first, at - keep.reach), 1)
            np.add.at(cover, np.minimum(ends[owner], at + PHRASE + keep.reach), -1)
            stored = np.nonzero((np.cumsum(cover[:total]) > 0) & terms[_slots(h, 1, keep.bits)])[0]
            owner = np.searchsorted(ends, stored, "right")
            lists: dict[tuple[int, str], list[int]] = defaultdict(list)  # of places in ``stored``
            for n, (d, i) in enumerate(zip(owner.tolist(), stored.tolist(), strict=True)):
                lists[d, flat[i]].append(n)
            order = np.fromiter(itertools.chain.from_iterable(lists.values()), np.int64, len(stored))
            offsets = np.zeros(len(lists) + 1, np.int32)
            np.cumsum(list(map(len, lists.values())), out=offsets[1:])
            padded = np.concatenate([np.zeros(PHRASE - 1, np.int32), _grams(h), np.zeros(PHRASE, np.int32)])
            positions = (stored - np.concatenate([[0], ends])[owner])[order].astype(np.int32)
            grams = padded[stored[order][:, None] + (PHRASE - 1 - np.arange(PHRASE))].ravel()
            columns = [pa.array([t for _, t in lists], pa.string()), b.column(0).take(pa.array([d for d, _ in lists], pa.int64())), pa.ListArray.from_arrays(pa.array(offsets), pa.array(positions)), pa.ListArray.from_arrays(pa.array(offsets * np.int32(PHRASE)), pa.array(grams))]
            yield pa.RecordBatch.from_arrays(columns, names=["term", key, "positions", "grams"])

    rows = documents.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(key, text)
    return spread(rows).mapInArrow(index, f"term string, `{key}` {kind}, positions array<int>, grams array<int>")


def prepared_items(items: DataFrame, item_key: str, item_text: str, carried_words: int = CARRIED_WORDS) -> tuple[DataFrame, Texts]:
    """``item, text_key`` of all items with a word, and their different texts.

    Wording is shared if a run of ``SHARED_RUN`` words stands in two different texts: one aggregation over
    all runs. Items of the same words count as one, or none of them could ever be found.
    """
    kind = items.schema[item_key].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([tokens_of(t) for t in b.column(1).to_pylist()], pa.list_(pa.string()))], names=["item", "tokens"])

    source = items.where(F.col(item_text).isNotNull() & F.col(item_key).isNotNull()).select(F.col(item_key).alias("item"), F.col(item_text).alias("t")).distinct()
    parsed = source.mapInArrow(parse, f"item {kind}, tokens array<string>").where(F.size("tokens") > 0)
    parsed = cut_lineage(parsed.withColumn("text_key", F.sha2(F.concat_ws(" ", "tokens"), 256)))
    texts = parsed.groupBy("text_key").agg(F.any_value("tokens").alias("tokens"))
    last = F.size("tokens") - SHARED_RUN
    runs = texts.where(last >= 0).select("text_key", F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda i: F.concat_ws(" ", F.slice("tokens", i + 1, SHARED_RUN)))).alias("at", "run"))
    twice = runs.groupBy("run").agg(F.min("text_key").alias("lo"), F.max("text_key").alias("hi")).where("lo <> hi")
    shared = runs.join(twice, "run", "left_semi").groupBy("text_key").agg(F.collect_list("at").alias("shared"))  # of one item
    rows = cut_lineage(texts.join(shared, "text_key", "left").select("text_key", "tokens", "shared"))
    size = rows.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("words"), F.coalesce(F.max(F.size("tokens")), F.lit(0)).alias("longest")).first()
    return parsed.select("item", "text_key").distinct(), Texts(rows, size["longest"], rows.toArrow() if size["words"] <= carried_words else None)


def lookups(texts: Texts, index: DataFrame) -> DataFrame:
    """``term, text_key, offset, place, gram``: of each phrase whose terms are all in the index, the rarest
    of them by the length of its list, its place in the phrase, and the phrase's hash, null for a short item."""

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in batches:
            out = []
            for k, t, shared in zip(*[c.to_pylist() for c in b.columns], strict=True):
                grams = _grams(hashes.of(t)).tolist()  # none of a short item
                out += [(k, o, p, grams[o] if grams else None) for o, p in Item(t, shared or ()).phrases()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.list_(pa.string())), pa.array([x[3] for x in out], pa.int32())], names=["text_key", "offset", "terms", "gram"])

    frequency = index.groupBy("term").agg(F.count("*").alias("n"))
    types = pa.schema([("text_key", pa.string()), ("offset", pa.int32()), ("terms", pa.list_(pa.string())), ("gram", pa.int32())])
    each = texts.flat_map(phrases, "text_key string, offset int, terms array<string>, gram int", types).select("text_key", "offset", "gram", F.size("terms").alias("size"), F.posexplode("terms").alias("place", "term"))
    held = each.join(frequency, "term").groupBy("text_key", "offset", "gram", "size").agg(F.count("*").alias("held"), F.min_by(F.struct("term", "place"), F.struct("n", "term", "place")).alias("x"))
    return held.where("held = size").select("x.term", "text_key", "offset", "x.place", "gram")


def intersect(index: DataFrame, key: str, entries: DataFrame, texts: Texts) -> DataFrame:
    """``<key>, text_key``: documents whose shifted posting lists meet in an exact phrase that extends to a
    stretch of the item.

    The lists that the entries name are fetched by term. A document's lists, and what may be in it, come
    together in one row, bounded by its own length. Terms of long lists have no more entries than others,
    and a list's rows are one per document, so that a skewed join can be split.
    """
    kind = index.schema[key].dataType.simpleString()
    at = F.transform("positions", lambda p, i: F.when(F.col("gram").isNull() | (F.get("grams", i * PHRASE + F.col("place")) == F.col("gram")), p - F.col("place")))
    met = index.join(entries, "term").select(key, "text_key", "offset", F.filter(at, lambda p: p >= 0).alias("starts")).where(F.size("starts") > 0)
    hits = met.groupBy(key, "text_key").agg(F.collect_list(F.struct("offset", "starts")).alias("hits"))
    known = {r["text_key"]: (r["tokens"], r["shared"] or ()) for r in texts.carried.to_pylist()} if texts.carried is not None else {}
    if texts.carried is None:
        hits = hits.join(texts.rows, "text_key")
    sought = hits.groupBy(key).agg(F.collect_list(F.struct(*[c for c in hits.columns if c != key])).alias("sought"))
    lists = index.groupBy(key).agg(F.collect_list(F.struct("term", "positions")).alias("lists"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: dict[str, Item] = {}
        for b in batches:
            rows, keys = [], []
            seek, held = b.column(1).flatten(), b.column(2).flatten()
            columns = {n: seek.field(n) for n in seek.type.names}
            text_keys, hits = columns["text_key"].to_pylist(), columns["hits"].to_pylist()
            terms, positions = held.field("term").to_pylist(), held.field("positions").to_pylist()
            sought_until, lists_until = np.cumsum(pc.list_value_length(b.column(1))), np.cumsum(pc.list_value_length(b.column(2)))
            i = j = 0
            for n in range(b.num_rows):
                at: dict[int, str] = {}
                for x in range(j, lists_until[n]):
                    at.update(dict.fromkeys(positions[x], terms[x]))
                for x in range(i, sought_until[n]):
                    item = items.get(text_keys[x])
                    if item is None:
                        if len(items) >= 10_000:
                            items.clear()
                        words = known[text_keys[x]] if known else (columns["tokens"][x].as_py(), columns["shared"][x].as_py() or ())
                        item = items[text_keys[x]] = Item(*words)
                    if _found(item, at, sorted({(h["offset"], p) for h in hits[x] for p in h["starts"]})):
                        rows.append(n)
                        keys.append(text_keys[x])
                i, j = sought_until[n], lists_until[n]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(keys, pa.string())], names=[key, "text_key"])

    return sought.join(lists, key).select(key, "sought", "lists").mapInArrow(meet, f"`{key}` {kind}, text_key string")


def _found(item: Item, at: dict[int, str], hits: list[tuple[int, int]]) -> bool:
    tried: dict[int, int] = {}  # shift -> offset up to which the item is known not to extend
    size = min(PHRASE, len(item.tokens))
    for offset, start in hits:
        shift = start - offset
        if tried.get(shift, -1) > offset or any(at.get(shift + x) != item.tokens[x] for x in range(offset, offset + size)):
            continue
        left = _run(item.tokens, at, offset - 1, start - 1, -1)
        k = left + _run(item.tokens, at, offset, start, 1)
        tried[shift] = offset - left + k
        if repeats(item, at, offset - left, start - left, k):
            return True
    return False


def leaked_items(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", bits: int = BITMAP_BITS, carried_words: int = CARRIED_WORDS) -> DataFrame:
    """``key, item_key`` of every document that repeats a passage of an item, each pair once.

    A passage is a stretch of at least 12 words (30 Chinese characters), or the whole of a shorter
    item, with at most one word in eight changed, left out or added; case, punctuation, markup,
    escapes and layout play no part. At least half of the twelve words must not be wording that
    several items share. Null and empty texts and null keys on either side match nothing; items with one text are
    all reported; repeated rows are one, and a key names one text. Texts and items of any length and number.
    """
    named, texts = prepared_items(items, item_key, item_text, carried_words)
    index = cut_lineage(postings(documents, key, text, phrase_filter(texts, bits)))
    found = intersect(index, key, lookups(texts, index), texts)
    return found.join(named, "text_key").select(key, F.col("item").alias(item_key)).distinct()
