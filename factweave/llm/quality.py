"""Per-document text quality statistics and the form of a text (problem 8).

One pass over the corpus, no shuffle: every text is split into lines, each line gets a kind by its
own shape, lines without a clear shape take that of their neighbours, repeated lines and words are
counted, and the shares of characters by kind decide the form. Common words of all languages are
one set: the language columns of a corpus are unreliable.

A word is a whitespace run; Han text has no blanks, so a run that holds Han characters is cut further
(``Form.split``): the longest common word that starts at a character is one word, any other Han
character is a word of its own, and what stands between is a word from its first to its last letter or digit. Word
count, mean length, common words and pairs all count these words. The kinds of lines go by layout and
keep whitespace runs, and fixed function words for Han lines.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.tables import spread

#: Bound of the word list that travels to the executors (the shipped table is fixed and small).
MAX_COMMON_WORDS = 100_000
#: Words of the longest phrase whose coverage is counted; a longer one is seen by its first 16 words.
MAX_PHRASE = 16
#: Words of the texts whose phrases are counted together; a longer text is counted alone.
WORDS_AT_ONCE = 300_000

_CJK = re.compile(r"[㐀-鿿豈-﫿]")
_HAN_CHARS = "\u3005\u3007\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_HAN = re.compile(f"[{_HAN_CHARS}]")
_HAN_PIECE = re.compile(f"[{_HAN_CHARS}]+|[^{_HAN_CHARS}]+")
_SYMBOL = re.compile(r"[^\w\s]")
_WIDE_SYMBOL = re.compile(r"[^\w\s\x00-\x7f]")
_NOT_ASCII_SYMBOL = bytes(c for c in range(256) if c >= 128 or chr(c).isalnum() or chr(c).isspace() or c == 95)
_BORDER = re.compile(r"[+|\-=:\s]{5,}$")
_MARKED = re.compile(r"</?(?:table|tr|td|th|thead|tbody)\b", re.I)
_WORD = re.compile(r"[^\W\d_]{3}")
_NAV_MARK = re.compile(r"[|·»›•→]| [/>] ")
_CLOSING = re.compile(r"[\[\](){}<>,;:\"'\s]+$")
_SEPARATOR = re.compile(r"\s*[|·»›•/>→]\s*")
_NAV_WORD = re.compile(r"[^\W\d_a-z][^\W\d_]{1,14}(?: [a-z]{1,10})?$")
_NUMBER = re.compile(r"[-+$€]?\d{1,3}(?:[.,]\d{3})+(?:[.,]\d+)?%?$|[-+$€]?\d+(?:[.,]\d+)?%?$|\d+(?:[-:/]\d+)+$")
_BULLET = re.compile(r"^(?:[-*+•→–—‣◦·▪●○■►>»]\s+(?:\[[ xX]?\]\s*)?|\(?\d{1,4}[.)\]:]\s+|\[\d{1,4}\]\s+|\(?[a-zA-Z][.)]\s+|\[[ xX]?\]\s+|\d{1,4}[.)、]\s*)")
_HEX = re.compile(r"^(?:0x)?[0-9a-f]{6,16}:?\s+(?:[0-9a-f]{2,4}\s+){4}|^(?:[0-9a-f]{2}\s+){7}", re.I)
_HEX_DIGITS = "0123456789abcdefABCDEF"
_BLOB = re.compile(r"[A-Za-z0-9+/=_-]{36,}")
_NUMERIC = re.compile(r"^[\d.,:%+$€/-]+$")
_GAPS = re.compile(r"\S {2,}(?=\S)")
_KV = re.compile(r"^(?:- )?['\"]?([^\W\d][\w .$/{}-]*?)['\"]?\s*[:：]\s+(.*)$")
_ROUTE = re.compile(r"^(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS) /\S*$")
_COMMENT = re.compile(r"^(?://|#(?![#\s]*$)|--\s|/\*|\*/|<!--|\"\"\"|''')")
_CODE = re.compile(
    r"""^(?:func|def|class|async|function|const|let|var|switch|case|import|package|struct|interface|public|private|static)\s+[\w('"{*$]
    |^(?:return|break|continue|pass|else|try|finally|default|defer|raise|throw|await|yield)\b(?:$|[\s:;{(].*)
    |^(?:if|for|while|elif|except|with)\b.*[:{]$
    |^(?:SELECT|INSERT\s+INTO|UPDATE|DELETE\s+FROM|CREATE|ALTER|DROP|WITH|FROM|WHERE|GROUP\ BY|ORDER\ BY|JOIN|LEFT\ JOIN)\s.*(?:[=*;(),]|\bFROM\b)
    |^(?:export|set)\s+\w+=|^(?:\$|>>>|sudo|curl|git|docker|kubectl|npm|pip|cd|make|chmod|echo|RUN|COPY|ENV)\s+[\w./$-]
    |^@\w+|^\#!|^\#include|^<\?|^<!|^</?[A-Za-z][\w:-]*(?:\s[^<>]*)?/?>.*
    |[{};]$|^[\]})]+[,;)]*$|[\[({]$|:=|[=!]==?|=>|->|\+=|&&|\|\||\$\{|\$ref
    |^[\w.$\[\]'"]+\s*=\s*\S|[\w\])]\([^()\s]*(?:[,\s(].*)?\)[;:,{]?$|^\w[\w.]*\(.*\)
    |^["'][^"']*["']\s*:|^[\[{]+\s*["']|"[\w$-]+"\s*:\s*["\[{\d]|^[\w$./{}~-]+:$|^-\s[\w$-]+:(?:\s|$)|^["'].*["'],?$|^--?[\w-]+=""",
    re.X,
)
_ZH_FUNCTION = re.compile("我们|他们|它们|因为|所以|但是|如果|没有|可以|必须|应当|已经|以前|之后|之前|之所以|大家|对于|这样|这个|那个|什么|仍然|然后|只有|自己|不|也|会|就|都|了|是|在|又|再|把|被(?!截)|将|让|向|从|并|而|与|和|这|那|你|我|他|她|它")
_CONTROL = re.compile("[\u0080-\u009f]")
_VOWEL = re.compile("[aeiouyáéíóúàèìòùâêîôûäëïöüœæåø]")
_LETTER = re.compile(r"[^\W\d_]")
_SPOKEN = re.compile(r"[^\W_](?:.*[^\W_])?")


def _latin_kind(s: str, tokens: list[str], common: int) -> str:
    """The kind of one line by its own shape; ``short`` and ``comment`` wait for their neighbours."""
    n = len(tokens)
    if not s.isascii() and (s.count("�") * 12 > len(s) or len(_CONTROL.findall(s)) * 14 > len(s)):
        return "junk"
    first = s[0]
    if common * 4 >= n and n >= 5 and (first.isalpha() and not _CODE.search(s) or first == "<" and n >= 8 and not _MARKED.search(s)):
        return "prose"
    if "<" in s and _MARKED.search(s) or s[0] in "+|-=" and _BORDER.match(s):
        return "table"
    if not _WORD.search(s) and len(set(s)) > 3:
        symbols = len(_SYMBOL.findall(s))
        if (symbols > 6 or symbols * 2 > len(s)) and (len(s) - symbols - s.count(" ")) * 2 < symbols and not _CLOSING.match(s):
            return "junk"
    if _COMMENT.match(s):
        return "comment"
    inner_tab = s.count("\t")
    pipes = s.count("|")
    if not first.isalpha():
        numeric = sum(1 for t in tokens if _NUMERIC.match(t))
        if numeric and numeric * 10 >= 8 * n:
            return "num" if sum(1 for t in tokens if _NUMBER.match(t)) * 10 >= 9 * numeric else "junk"
    if (n >= 5 or len(s) > 40) and _NAV_MARK.search(s):
        cells = _SEPARATOR.split(s.strip("|·»›•/>→ "))
        if len(cells) >= 5 and sum(1 for c in cells if _NAV_WORD.match(c)) * 100 >= 85 * len(cells):
            return "junk"
    if first in _HEX_DIGITS and _HEX.match(s):
        return "junk"
    if max(map(len, tokens)) >= 36:
        blobs = "".join(_BLOB.findall(s))
        if len(blobs) * 2 > len(s) and re.search(r"[A-Z].*\d|\d.*[A-Z]|[a-z][A-Z]", blobs) and not (first == "/" and blobs.islower()):
            return "junk"
    if inner_tab and common * 3 < n:
        return "table"
    if pipes >= 2 and "||" not in s and not s.endswith((";", "{")):
        return "table"
    if common * 5 >= n and n >= 5 and not _CODE.search(s):
        return "prose"
    if _ROUTE.match(s):
        return "list"
    b = _BULLET.match(s)
    if b:
        rest = s[b.end() :]
        if n >= 6 and common * 6 >= n:
            return "prose"
        if not re.match(r"[\w$-]+:(?:\s|$)", rest) or " " in rest.split(":")[0]:
            if len(rest) < 90:
                return "list"
    if s.count(";") >= 2 and not _CODE.search(s.replace(";", " ")) and "; " not in s:
        return "table"
    if s.count(",") >= 2 and ", " not in s and " = " not in s and not re.search(r"[(){}=]", s):
        return "table"
    gaps = len(_GAPS.findall(s)) if "  " in s else 0
    if gaps >= 2 and common * 4 < n and (gaps < n - 1 or "   " in s) and not _CODE.search(s):
        return "table"
    if _CODE.search(s):
        return "code"
    kv = _KV.match(s)
    if kv and common * 4 < n:
        key, value = kv[1], kv[2]
        if " " in key or (" " in value and not value[:1] in "\"'[{"):
            return "list"
        return "kv"
    if gaps == 1 and n <= 6:
        return "gap"
    if n >= 5:
        letters = len(_LETTER.findall(s))
        if letters >= 24 and common * 8 < n and len(_VOWEL.findall(s.lower())) * 100 < 31 * letters:
            return "junk"
        if max(Counter(tokens).values()) * 2 > n and n >= 8:
            return "junk"
        if common * 8 >= n:
            return "prose"
        if s.count(", ") * 5 >= n or s.count("; ") * 5 >= n or s.count(" / ") * 5 >= n:
            return "list"
        return "short" if n <= 8 else "list"
    return "short"


def _cjk_kind(s: str, cjk: int) -> str:
    if s.count("�") * 12 > len(s):
        return "junk"
    if _COMMENT.match(s):
        return "comment"
    words = len(_ZH_FUNCTION.findall(s))
    if cjk >= 8 and words * 14 >= cjk:
        return "prose"
    if "\t" in s or s.count("|") >= 2 or "<" in s and _MARKED.search(s):
        return "table"
    if _BULLET.match(s):
        return "list"
    if (s.count(";") >= 2 or s.count(",") >= 2) and not re.search("[，。{}]", s):
        return "table" if "; " not in s and ", " not in s else "list"
    if re.search(r"^[\w$-]+:\s|[{}=;]|^\"", s) and cjk * 2 < len(s):
        return "code"
    if len(_GAPS.findall(s)) >= 2:
        return "table"
    if cjk <= 16:
        return "short"
    if re.search("[、，;；:：]", s):
        return "list"
    return "prose" if words * 25 >= cjk else "list"


def phrase_coverage(texts: Sequence[Sequence[str]]) -> list[tuple[int, int]]:
    """Per text, given as its words: most characters that one repeated phrase of 2 to ``MAX_PHRASE`` words
    covers, counted without overlap; and the same of the phrases that come four times or more.

    All texts together are grouped by sorting, one length of phrase after the other; only what is
    repeated within its text goes on to the next. A phrase that overlaps itself is counted from the left.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    number = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(texts)))}
    width = max(len(number), 1)
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
    ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, number), np.int64, len(number))[ids])]) if len(ids) else np.zeros(1, np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    stop = np.cumsum(sizes)[owner]
    best, loop = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    at = np.nonzero(np.arange(len(ids)) + 1 < stop)[0]
    code = (owner[at] * width + ids[at]) * width + ids[at + 1]
    for n in range(2, MAX_PHRASE + 1):
        order = np.argsort(code, kind="stable")  # places of one phrase stay in order
        code, at = code[order], at[order]
        first = np.concatenate([[True], code[1:] != code[:-1]])[: len(code)]
        group = np.cumsum(first) - 1
        keep = np.bincount(group)[group] > 1 if len(group) else first
        at, first = at[keep], first[keep]
        if not len(at):
            break
        group = np.cumsum(first) - 1
        count = np.bincount(group)
        begin = np.nonzero(first)[0]
        size = ends[at[begin] + n] - ends[at[begin]]
        doc = owner[at[begin]]
        close = group[1:][(np.diff(at) < n) & ~first[1:]]
        times = count.copy()
        for k in np.unique(close):
            if count[k] * size[k] > best[doc[k]] or count[k] > 3 and count[k] * size[k] > loop[doc[k]]:
                times[k] = free = 0
                for i in at[begin[k] : begin[k] + count[k]].tolist():
                    if i >= free:
                        times[k], free = times[k] + 1, i + n
            else:
                times[k] = 0
        for found, least in ((best, 2), (loop, 4)):
            often = times >= least
            np.maximum.at(found, doc[often], (times * size)[often])
        more = at + n < stop[at]
        at, group = at[more], group[more]
        code = group * width + ids[at + n]
    return list(zip(best.tolist(), loop.tolist(), strict=True))


class Form:
    """Reads texts; ``words`` are the common words of all languages."""

    def __init__(self, words: frozenset[str]):
        self.words = words
        self._longer: dict[str, list[str]] = {}  # common Han words of several characters by their first
        for w in sorted(words, key=len, reverse=True):
            if len(w) > 1 and all(map(_HAN.match, w)):
                self._longer.setdefault(w[0], []).append(w)
        self._kinds: dict[str, str] = {}  # of short lines, which recur; emptied when full

    def split(self, tokens: list[str]) -> list[str]:
        """The words of whitespace runs: runs without Han characters as they are, others cut."""
        words = []
        for token in tokens:
            if token.isascii() or not _HAN.search(token):
                words.append(token)
                continue
            for piece in _HAN_PIECE.findall(token):
                if not _HAN.match(piece):
                    if spoken := _SPOKEN.search(piece):
                        words.append(spoken[0])
                    continue
                at = 0
                while at < len(piece):
                    word = next((w for w in self._longer.get(piece[at], ()) if piece.startswith(w, at)), piece[at])
                    words.append(word)
                    at += len(word)
        return words

    def read(self, text: str | None) -> tuple:
        """The statistics of ``STATISTICS`` in order. Null, empty and blank texts have no form."""
        return next(self.read_all([text]))

    def read_all(self, texts: Sequence[str | None]) -> Iterator[tuple]:
        """The statistics of each text; phrases are counted for some texts at once, as many as have
        ``WORDS_AT_ONCE`` words, which bounds the memory."""
        begun: list[tuple] = []
        words = 0
        for k, text in enumerate(texts):
            begun.append(self._lines(text or ""))
            words += len(begun[-1][-1])
            if words >= WORDS_AT_ONCE or k + 1 == len(texts):
                for part, (most, looped) in zip(begun, phrase_coverage([x[-1] if len(x[-1]) > 3 else () for x in begun]), strict=True):
                    yield self._statistics(*part[:-1], most, looped)
                begun, words = [], 0

    def _lines(self, text: str) -> tuple:
        """What the lines of a text give, its words last."""
        has = self.words.__contains__
        cached = self._kinds
        kinds: list[list] = []  # [kind, visible characters, paragraph]
        seen: Counter = Counter()
        paragraphs: Counter = Counter()
        paragraph = n_words = n_common = n_ends = word_chars = 0
        block: list[str] = []
        all_words: list[str] = []
        for line in text.split("\n"):
            s = line.strip()
            if not s:
                paragraph += 1
                if block:
                    paragraphs["\n".join(block)] += 1
                    block = []
                continue
            block.append(s)
            tokens = s.lower().split()
            common = sum(map(has, tokens))
            n = len(tokens)
            visible = len("".join(tokens))
            words = tokens if s.isascii() else self.split(tokens)
            n_words += len(words)
            n_common += common if words is tokens else sum(map(has, words))
            word_chars += visible if words is tokens else sum(map(len, words))
            seen[s] += 1
            all_words += words
            if s[-1] in ".!?:;。！？：；…":
                n_ends += 1
            if n >= 8 and common * 4 >= n and s[0].isalpha() and s[-1] not in "{};" and "=" not in s:
                kind = "prose"
            elif s.isascii():
                kind = cached.get(s)
                if kind is None:
                    kind = _latin_kind(s, tokens, common)
                    if visible < 48:
                        if len(cached) >= 200_000:
                            cached.clear()
                        cached[s] = kind
            elif (cjk := len(_CJK.findall(s))) * 10 < 3 * visible:
                kind = _latin_kind(s, tokens, common)
            else:
                kind = _cjk_kind(s, cjk)
            kinds.append([kind, visible, paragraph, s])
        if block:
            paragraphs["\n".join(block)] += 1
        return text, kinds, seen, paragraphs, n_words, n_common, n_ends, word_chars, all_words

    def _statistics(self, text: str, kinds: list[list], seen: Counter, paragraphs: Counter, n_words: int, n_common: int, n_ends: int, word_chars: int, most: int, looped: int) -> tuple:
        if not kinds:
            return (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, None)
        n_lines = len(kinds)
        repeated = {s for s, k in seen.items() if k >= 4 and k * 2 > n_lines}
        self._settle(kinds, repeated)
        total = sum(k[1] for k in kinds) or 1
        shares = dict.fromkeys(("prose", "list", "table", "code", "junk"), 0)
        for kind, chars, _, _ in kinds:
            shares[kind] += chars
        coverage = most / total
        duplicate = sum(k - 1 for k in seen.values()) / n_lines
        n_paragraphs = sum(paragraphs.values())
        twice = sum(k - 1 for k in paragraphs.values()) / n_paragraphs
        form = None
        again = sum((k - 1) * len("".join(s.split())) for s, k in seen.items())
        if n_words >= 8 and (looped > 0.8 * total or n_lines >= 8 and min(duplicate, again / total) > 0.8 or n_paragraphs >= 8 and twice > 0.8):
            form = "junk"  # a phrase, lines or paragraphs over and over, whatever they say
        elif shares["prose"] * 2 < total:
            form = max(("junk", "table", "code", "list"), key=lambda k: shares[k])
        symbols = len(text.encode("utf-8", "replace").translate(None, _NOT_ASCII_SYMBOL)) + (0 if text.isascii() else len(_WIDE_SYMBOL.findall(text)))
        return (n_words, word_chars / n_words, symbols / total, n_ends / n_lines, n_common / n_words, duplicate, twice, coverage, *(shares[k] / total for k in ("prose", "list", "table", "code", "junk")), form)

    @staticmethod
    def _settle(kinds: list[list], repeated: set[str]) -> None:
        """Gives lines without a shape of their own the kind of their surroundings."""
        count = Counter(k[0] for k in kinds)
        code = count["code"] > 0
        nested = any(k[0] == "code" and k[3].endswith(":") for k in kinds)
        listed = count["list"] > count["code"]
        columns = Counter(k[3].count(" ") for k in kinds if k[0] == "num")
        even = columns and max(columns.values()) * 10 >= 6 * sum(columns.values()) and max(columns, key=columns.get) >= 1
        for k in kinds:
            if k[3] in repeated:
                k[0] = "junk"
            elif k[0] == "num":
                k[0] = "table" if even or count["table"] > count["junk"] else "list" if count["list"] else "junk"
            elif k[0] == "kv":
                k[0] = "list" if listed and not nested else "code"
            elif k[0] == "comment":
                if code and count["code"] * 2 > count["prose"]:
                    k[0] = "code"
                elif k[3].startswith("#"):
                    k[0] = "prose" if count["prose"] or count["list"] == 0 else "short"
                else:
                    k[0] = "prose" if len(k[3]) > 40 else "short"
        n = len(kinds)
        single = n >= 6 and sum(1 for k in kinds if k[0] == "short" and " " not in k[3] and k[3][:1].isupper()) * 10 >= 8 * n
        distinct = len({k[3] for k in kinds})
        for i, k in enumerate(kinds):
            if k[0] not in ("short", "gap"):
                continue
            before = kinds[i - 1] if i else None
            after = kinds[i + 1] if i + 1 < n else None
            near = [x for x in (before, after) if x and x[2] == k[2]]
            if single and k[0] == "short" and distinct * 3 < 2 * n:
                k[0] = "junk"  # navigation, one word a line
            elif k[0] == "gap":
                k[0] = "table" if any(x[0] in ("table", "gap") for x in near) else "list"
            elif near and before in near and before[0] == "prose" and (after not in near or after[0] == "prose"):
                k[0] = "prose"  # the end of a wrapped sentence
            elif near and all(x[0] == "code" for x in near):
                k[0] = "code"
            elif near and any(x[0] in ("table", "gap") for x in near) and not any(x[0] in ("short", "list") for x in near):
                k[0] = "table"
            elif not near and any(x and x[0] == "prose" for x in (before, after)):
                k[0] = "prose"  # a heading
            else:
                k[0] = "list"


STATISTICS = "word_count long, mean_word_length double, symbol_ratio double, punctuated_line_share double, common_word_share double, duplicate_line_share double, duplicate_paragraph_share double, top_ngram_coverage double, prose_share double, list_share double, table_share double, code_share double, junk_share double, form string"


def quality_statistics(documents: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``STATISTICS`` of every text.

    ``form`` is list, table, code or junk where less than half of the visible characters are natural
    prose, else null; null, empty and blank texts have zeros and no form. Words are whitespace runs, in
    Han text common words and else single characters; ``common_word_share`` is within 0..1. ``top_ngram_coverage`` is
    the greatest share of visible characters that one phrase of 2 to 16 words, repeated, covers without overlap. Repeated rows give repeated rows.
    """
    rows = common_words.select(F.lower("word").alias("w")).where("w IS NOT NULL").distinct().limit(MAX_COMMON_WORDS + 1).collect()
    if len(rows) > MAX_COMMON_WORDS:
        raise ValueError(f"more than {MAX_COMMON_WORDS} common words")
    words = frozenset(r.w for r in rows)
    kind = documents.schema[key].dataType.simpleString()
    names = [x.split()[0] for x in STATISTICS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = Form(words)
        types = [pa.int64(), *[pa.float64()] * 12, pa.string()]
        for b in batches:
            columns = list(zip(*form.read_all(b.column(1).to_pylist()), strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=[key, *names])

    return spread(documents.select(key, text)).mapInArrow(run, f"`{key}` {kind}, {STATISTICS}")
