"""Words of texts as 64-bit tokens, in Arrow batches.

*Words* are the maximal runs of letters and digits of the lower-cased text, once soft hyphens and zero-width characters
are removed. For comparing multisets, the k-th occurrence of a word in a text is a token of its own, so that the
similarity of two multisets is the Jaccard similarity of two sets of tokens.
"""

from __future__ import annotations

import re
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

WORD = re.compile(r"[^\W_]+")
#: Characters removed before words are taken.
INVISIBLE = "\u00ad\u200b\u200c\u200d\ufeff"
_DROP = re.compile(f"[{INVISIBLE}]+")
_CACHED = 500_000


def words(text: str | None) -> list[str]:
    """The words of a text in order; none for a null."""
    if not text:
        return []
    return WORD.findall(visible(text.lower()))


def visible(text: str) -> str:
    """The text without invisible characters."""
    return text if text.isascii() else _DROP.sub("", text)


class WordCodes(dict):
    """word -> 64-bit hash; a bounded memo, emptied when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHED:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values (multiply and xor-shift rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _table(lower: bool) -> np.ndarray:
    """What every byte of an ASCII text becomes: letters and digits stay (or are lower-cased), all else is a blank."""
    return np.array([ord(chr(c).lower() if lower else chr(c)) if c < 128 and chr(c).isalnum() else 32 for c in range(256)], dtype=np.uint8)


_TABLES = {lower: _table(lower) for lower in (False, True)}


def tokenise(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The words of a column of texts: for each word, text by text, its place in a list of the distinct words, the number of
    words of each text, and that list. Nulls have no words. With ``lower`` false words are given as they are written,
    lower-cased where that changes more than single letters.

    ASCII texts are cut by table and by Arrow, without a Python object per word; the others by the pattern."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int32)
    data = texts.buffers()[2]
    held = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    plain = pa.StringArray.from_buffers(n, pa.py_buffer(offsets - offsets[0]), pa.py_buffer(_TABLES[lower][held]))
    other = pc.invert(pc.fill_null(pc.string_is_ascii(texts), True))
    rest = []
    for text in texts.filter(other).to_pylist():
        text = visible(text)
        rest.append(" ".join(words(text) if lower or len(text.lower()) != len(text) or "\u03a3" in text else WORD.findall(text)))
    cleaned = pc.replace_with_mask(plain, other, pa.array(rest, pa.string())) if rest else plain
    cleaned = pc.ascii_trim_whitespace(cleaned)
    lists = pc.ascii_split_whitespace(cleaned)
    counts = np.where(pc.binary_length(cleaned).to_numpy() > 0, np.diff(lists.offsets.to_numpy()), 0).astype(np.int64)
    flat = lists.flatten()
    coded = flat.filter(pc.not_equal(flat, "")).dictionary_encode()
    return coded.indices.to_numpy(), counts, coded.dictionary.to_pylist()


def flat_words(texts: pa.Array, codes: WordCodes) -> tuple[np.ndarray, np.ndarray]:
    """Word codes of all texts one after the other, and the number of words of each text."""
    at, counts, known = tokenise(texts)
    return np.array([codes[w] for w in known], dtype=np.uint64)[at], counts


def multiset_tokens(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Tokens of the multisets, sorted within each text: the k-th occurrence of a word differs from the first."""
    row = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((flat, row))
    flat, row = flat[order], row[order]
    if not len(flat):
        return flat
    new = np.empty(len(flat), dtype=bool)
    new[0] = True
    new[1:] = (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(flat)), 0))
    nth = (np.arange(len(flat)) - start).astype(np.uint64)
    tokens = np.where(nth == 0, flat, mix(flat + nth * np.uint64(0xA24BAED4963EE407)))
    order = np.lexsort((tokens, row))
    return tokens[order]


def row_digest(tokens: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A 128-bit digest of each row's tokens, whatever their order (sums of two scramblings, with the count)."""
    ends = np.cumsum(counts)
    halves = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(mix(tokens) ^ np.uint64(salt)), dtype=np.uint64)])
        halves.append(mix(total[ends] - total[ends - counts] + mix(counts.astype(np.uint64))))
    return binaries(np.stack(halves, axis=1))


def binaries(words: np.ndarray) -> pa.Array:
    """Rows of 64-bit words as binary values."""
    offsets = np.arange(len(words) + 1, dtype=np.int32) * (8 * words.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(words))])


def longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def long_lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Arrow lists of longs from flat values and row lengths."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), longs(values))


def keep_rows(values: np.ndarray, counts: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and lengths of the rows marked in ``keep``."""
    return values[np.repeat(keep, counts)], counts[keep]
