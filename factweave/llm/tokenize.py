"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 6).

Every text is read as overlapping chunks of ``chunk_chars`` characters. The overlap of two neighbours is
pre-tokenised twice, as the left chunk reads it and as the right one does, and the text is cut where both
have a boundary that holds whatever stands before it; then the pieces between the cuts are encoded, those
of a very long text on several threads. Pre-tokens are found from left to right and depend only on the
text from their start on, so that from a boundary on all readings agree, and a pre-token's bytes are
merged alone: the ids of the pieces are the ids of the text. Where an overlap has no such boundary the
chunks are read as one. The corpus is read once and not shuffled.
"""

from __future__ import annotations

import base64
import functools
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factweave.tables import spread

CHUNK_CHARS = 1_024
OVERLAP_CHARS = 96
#: Pieces of one text from which on they are encoded by so many threads.
MANY_PIECES, THREADS = 512, 4


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """Path of a vocabulary file: in ``folder``, else ``$TOKENIZER_DIR``, else the installed package."""
    folder = folder or os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


#: Fixed value: the pattern that splits text into pre-tokens for the rank files of 50k ids.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    """The tokenizer of a rank file, loaded once per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=1)
def _pretokens():
    import regex

    return regex.compile(PATTERN)


def decode(ids: list[int], path: str | None = None) -> str:
    """The text of ids: the concatenated raw bytes of the tokens, read as UTF-8."""
    return encoder(path or vocabulary_path()).decode_bytes(ids).decode("utf-8")


@functools.lru_cache(maxsize=1)
def _certain():
    import regex

    return regex.compile(r"(?<=\p{L})\P{L}|(?<=\p{N})\P{N}|(?<=\S)\s")


def _settled(c: str) -> bool:
    """Whether all versions of Unicode and of white space agree on what a character is."""
    return unicodedata.ucd_3_2_0.category(c) not in ("Cn", "Cc") or c in "\t\n\r"


def boundaries(text: str, start: int, end: int) -> list[int]:
    """Starts of the pre-tokens of a reading from ``start`` that sees the text up to ``end``."""
    return [m.start() for m in _pretokens().finditer(text, start, end)]


def certain(text: str, start: int, end: int) -> list[int]:
    """Boundaries that every reading has: the ends of runs of letters, of digits, and of what is no white
    space. No pre-token holds a letter or digit and then another sign, or white space after a sign."""
    return [m.start() for m in _certain().finditer(text, start, end) if _settled(text[m.start() - 1]) and _settled(text[m.start()])]


def cuts(text: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> list[int]:
    """Where neighbouring chunks are stitched: for each overlap the first boundary of both readings that is
    certain; none where there is none. A text of one chunk has no overlap."""
    found: list[int] = []
    last = 0
    for at in range(chunk_chars, len(text) - overlap_chars, chunk_chars):
        end = at + overlap_chars
        known = certain(text, at, end)
        if not known:
            continue
        before = certain(text, max(last + 1, at - overlap_chars), at)
        left = boundaries(text, before[-1] if before else last, end)
        both = set(left).intersection(boundaries(text, at, end), known)
        if both:
            last = min(both)
            found.append(last)
    return found


def encode_text(text: str, path: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> tuple[list[int] | np.ndarray, int]:
    """The ids of a text, and how many pieces it was stitched of."""
    encoding = encoder(path)
    at = [0, *cuts(text, chunk_chars, overlap_chars), len(text)]
    n = len(at) - 1
    if n == 1:
        return encoding.encode_ordinary(text), 1
    if n < MANY_PIECES:
        return [i for a, b in zip(at, at[1:], strict=False) for i in encoding.encode_ordinary(text[a:b])], n
    parts = []
    for k in range(0, n, MANY_PIECES):  # ids are packed as they come: a list of Python numbers takes nine times the room
        some = [text[a:b] for a, b in zip(at[k : k + MANY_PIECES], at[k + 1 : k + MANY_PIECES + 1], strict=False)]
        parts += [np.array(x, np.int32) for x in encoding.encode_ordinary_batch(some, num_threads=THREADS)]
    return np.concatenate(parts), n


def token_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """``key, ids, pieces``: the token ids of every text, without special tokens, and the number of pieces
    it was stitched of (0 for a null or empty text).

    Marker-like strings are ordinary text. Null and empty texts give an empty list, a blank text is
    encoded like any other. Each input row gives one row; keys may be null or repeated. A text and its
    ids are one cell each, so that one task holds them; texts may have any length that a cell may have.
    """
    if not 0 < 2 * overlap_chars <= chunk_chars:
        raise ValueError("the overlap must be at most half a chunk")
    path = path or vocabulary_path()
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [encode_text(t, path, chunk_chars, overlap_chars) if t else ([], 0) for t in b.column(1).to_pylist()]
            offsets = np.zeros(len(done) + 1, np.int32)
            np.cumsum([len(ids) for ids, _ in done], out=offsets[1:])
            flat = np.concatenate([np.asarray(ids, np.int32) for ids, _ in done]) if done else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array([n for _, n in done], pa.int32())], names=[key, "ids", "pieces"])

    return spread(documents.select(key, text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>, pieces int")
