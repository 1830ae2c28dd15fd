"""Problem 7: evaluation texts that leaked into documents, fully or partly.

Method: template canonicalisation. Numbers, units and names become typed placeholders, windows of twelve template words
are hashed, the windows of documents meet those of evaluation items in a hash join, and for each hit the slots are
compared: equal slots are a verbatim leak; slots that differ but map one to one over a stretch of at least a window are a
re-parameterised item.

What a placeholder stands for is decided by rule from the texts themselves. A word with a digit is a number. A word of
the items is a unit if at least half of its occurrences follow a number, and a name if it is more often written with a
capital than without, counted over all documents and items. These classes depend on the lower-cased word alone, so equal
words always meet. A word that no item uses cannot be part of a verbatim leak; it is judged where it stands: a name if
it is written with a capital or its text has no letter case, a unit if it follows a number.

The classes and the hashes of the items' windows are spread as bitmaps of fixed size (a word or window is looked up by
some bits of its hash; both sides use the same bitmaps, so a chance hit cannot separate equal words). The bitmap of windows
only keeps windows that cannot match out of the join; the join is exact whatever the number of items.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import text as T
from quillon.session import stage

_DIGIT = re.compile(r"\d")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_NUMBER, _UNIT, _NAME = (xxhash.xxh3_64_intdigest(x) for x in ("<number>", "<unit>", "<name>"))
_STRANGE = xxhash.xxh3_64_intdigest("<strange>")  # a word that is in no item's template
#: Bits of the bitmaps, as powers of two: words, windows.
WORD_BITS, WINDOW_BITS = 24, 25
_MEMO = 500_000


def bitmap(cells: DataFrame, bits: int) -> np.ndarray:
    """The set of ``cells(cell long)`` below 2**bits as packed 64-bit words. What reaches the driver is at most
    2**(bits - 6) rows, whatever the number of cells."""
    words = cells.groupBy(F.shiftright("cell", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(cell % 64))")).alias("v"))
    held = words.toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[held.column("w").to_numpy()] = held.column("v").to_numpy().view(np.uint64)
    return out


def marked(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the hashes are in a bitmap."""
    cell = keys & np.uint64(len(table) * 64 - 1)
    return (table[cell >> np.uint64(6)] >> (cell & np.uint64(63)) & np.uint64(1)).astype(bool)


def has(table: np.ndarray, key: int) -> bool:
    cell = key & (len(table) * 64 - 1)
    return bool(int(table[cell >> 6]) >> (cell & 63) & 1)


def cased(texts: pa.Array) -> np.ndarray:
    """Which texts have both capitals and small letters, so that their letter case tells something."""
    return pc.and_(pc.match_substring_regex(texts, r"\p{Lu}"), pc.match_substring_regex(texts, r"\p{Ll}")).fill_null(False).to_numpy(zero_copy_only=False)


def _capital(word: str) -> bool:
    return word[0].isupper() and (len(word) == 1 or not word.isupper())


def word_statistics(texts: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """(word, n, after_number, capital, small) of the words in the vocabulary, by hash, over all of ``texts(text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, counts, written = T.tokenise(batch.column(0), lower=False)
            keys = np.array([xxhash.xxh3_64_intdigest(w.lower()) for w in written], dtype=np.uint64)
            number = np.array([bool(_DIGIT.search(w)) for w in written], dtype=bool)
            case = np.array([1 if _capital(w) else 2 if w.islower() else 0 for w in written], dtype=np.int8)
            after = np.concatenate([[False], number[at[:-1]]]) if len(at) else np.zeros(0, bool)
            after[(np.cumsum(counts) - counts)[counts > 0]] = False  # the first words of texts
            told = np.where(np.repeat(cased(batch.column(0)), counts), case[at], 0)
            found = [np.bincount(x, minlength=len(written)) for x in (at, at[after], at[told == 1], at[told == 2])]
            keep = marked(vocabulary.value, keys) & ~number
            yield pa.RecordBatch.from_arrays([T.longs(keys[keep]), *[pa.array(x[keep]) for x in found]], names=["word", "n", "after_number", "capital", "small"])

    partial = texts.select("text").mapInArrow(run, "word long, n long, after_number long, capital long, small long")
    return partial.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "after_number", "capital", "small")])


class Templates(dict):
    """written word -> code of its template form; numbers, units and names share one code each, 0 is a word that no item
    uses and that is judged where it stands. A bounded memo."""

    def __init__(self, vocabulary: np.ndarray, units: np.ndarray, names: np.ndarray) -> None:
        super().__init__()
        self.tables = vocabulary, units, names

    def __missing__(self, written: str) -> int:
        if len(self) >= _MEMO:
            self.clear()
        key = xxhash.xxh3_64_intdigest(written.lower())
        vocabulary, units, names = self.tables
        if _DIGIT.search(written):
            code = _NUMBER
        elif has(vocabulary, key):
            code = _UNIT if has(units, key) else _NAME if has(names, key) else key
        else:
            code = _NAME if _capital(written) else 0
        self[written] = code
        return code

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Template codes of all texts one after the other, then the words themselves as ``tokenise`` gives them."""
        at, counts, written = T.tokenise(texts, lower=False)
        out = np.array([self[w] for w in written], dtype=np.uint64)[at]
        strange = out == 0
        after = np.concatenate([[False], out[:-1] == np.uint64(_NUMBER)]) if len(out) else strange
        after[(np.cumsum(counts) - counts)[counts > 0]] = False
        out[strange] = np.where(np.repeat(cased(texts), counts), np.where(after, np.uint64(_UNIT), np.uint64(_STRANGE)), np.uint64(_NAME))[strange]
        return out, at, counts, written


def rolling(codes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` codes (fewer than the codes by width - 1)."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = codes[:n].copy()
    for k in range(1, width):
        h *= _FACTOR
        h += codes[k : k + n]
    return T.mix(h ^ np.uint64(width))


def _windows(tables: Broadcast, width: int, sizes: list[int] | None, wanted: Broadcast | None):
    """Template windows as rows (id, at, size, key, words, n_words): of items all windows of their one size, of documents
    (``sizes`` given) those of every size that the bitmap ``wanted`` lets through."""
    names = ["id", "at", "size", "key", "words", "n_words"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates(*tables.value)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            codes, place, counts, written = templates.flat(batch.column(1))
            ends = np.cumsum(counts)
            for size in sizes if sizes is not None else range(1, width + 1):
                h = rolling(codes, size)
                at = np.flatnonzero(marked(wanted.value, h)) if wanted is not None else np.arange(len(h))
                row = np.searchsorted(ends, at, side="right")
                keep = at + size <= ends[row]
                if sizes is None:
                    keep &= np.minimum(counts[row], width) == size
                at, row = at[keep], row[keep]
                for k in range(0, len(at), 50_000):
                    a, r = at[k : k + 50_000], row[k : k + 50_000]
                    start = a - (ends[r] - counts[r])
                    text = [" ".join([written[w] for w in place[p : p + size].tolist()]).lower() for p in a.tolist()]
                    columns = [[ids[i] for i in r.tolist()], start, np.full(len(a), size), h[a].view(np.int64), text, counts[r]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return run


def template_hits(
    documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "eval_id", item_text_col: str = "text", width: int = 12
) -> DataFrame:
    """(doc_id, eval_id, at, start, size, doc_window, item_window, item_words): every template window of a document that
    is one of an item: where it starts on both sides, its number of words and the words themselves."""
    spark: SparkSession = documents.sparkSession
    schema = "id long, at int, size int, key long, words string, n_words int"
    source = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    texts = items.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    spread = spark.sparkContext.broadcast
    cell = lambda c, bits: c.bitwiseAND(F.lit((1 << bits) - 1)).alias("cell")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {xxhash.xxh3_64_intdigest(w) for text in batch.column(0).to_pylist() for w in T.words(text)}
            yield pa.RecordBatch.from_arrays([T.longs(np.array(list(found), dtype=np.uint64))], names=["word"])

    used = texts.select("text").mapInArrow(hashed, "word long")
    vocabulary = bitmap(used.select(cell(F.col("word"), WORD_BITS)), WORD_BITS)
    statistics = stage(word_statistics(source.select("text").unionByName(texts.select("text")), spread(vocabulary)), "p7-words")
    units = statistics.where("2 * after_number >= n")
    names = statistics.where("capital > small and 2 * after_number < n")
    tables = spread((vocabulary, *[bitmap(c.select(cell(F.col("word"), WORD_BITS)), WORD_BITS) for c in (units, names)]))

    held = stage(texts.mapInArrow(_windows(tables, width, None, None), schema), "p7-items")
    sizes = sorted(r.size for r in held.select("size").distinct().collect())  # at most ``width`` numbers
    wanted = spread(bitmap(held.select(cell(F.col("key"), WINDOW_BITS)), WINDOW_BITS))
    found = source.mapInArrow(_windows(tables, width, sizes, wanted), schema)
    return found.select(F.col("id").alias("doc_id"), "at", "size", "key", F.col("words").alias("doc_window")).join(
        held.select(F.col("id").alias("eval_id"), F.col("at").alias("start"), "size", "key", F.col("words").alias("item_window"), F.col("n_words").alias("item_words")),
        ["size", "key"],
    )


def consistent_stretch(item: list[str], doc: list[str], least: int) -> tuple[int, int]:
    """(length, same words) of the longest stretch of two aligned texts whose words map one to one, if it has ``least``
    words of which at least half are the same; else (0, 0)."""
    there: dict[str, str] = {}
    back: dict[str, str] = {}
    held: dict[tuple[str, str], int] = defaultdict(int)
    best, first, same = (0, 0), 0, 0
    for last, (a, b) in enumerate(zip(item, doc)):
        while there.get(a, b) != b or back.get(b, a) != a:
            x, y = item[first], doc[first]
            held[x, y] -= 1
            if not held[x, y]:
                del there[x], back[y]
            same -= x == y
            first += 1
        there[a], back[b] = b, a
        held[a, b] += 1
        same += a == b
        length = last - first + 1
        if length >= least and 2 * same >= length:
            best = max(best, (length, same))
    return best


def _slots(width: int):
    names = ["doc_id", "eval_id", "n_exact", "n_windows", "longest", "same_words", "item_words", "consistent"]
    kinds = [pa.int64()] * 2 + [pa.int32()] * 5 + [pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, item, item_words, hits in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "eval_id", "item_words", "hits"))):
                diagonals: dict[int, dict[int, tuple[str, str]]] = defaultdict(dict)
                exact = 0
                for hit in hits:
                    exact += hit["doc_window"] == hit["item_window"]
                    diagonals[hit["at"] - hit["start"]][hit["start"]] = hit["item_window"].split(), hit["doc_window"].split()
                best = (0, 0)
                for windows in diagonals.values():
                    a: list[str] = []
                    b: list[str] = []
                    end = None
                    for start in sorted(windows):
                        x, y = windows[start]
                        if end is None or start > end:
                            best = max(best, consistent_stretch(a, b, min(width, item_words)))
                            a, b, end = [], [], start
                        a += x[end - start :]
                        b += y[end - start :]
                        end = start + len(x)
                    best = max(best, consistent_stretch(a, b, min(width, item_words)))
                out.append((doc, item, exact, len(hits), *best, item_words, best[0] > 0))
            columns = list(zip(*out)) if out else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return run


def verbatim_leaks(hits: DataFrame) -> DataFrame:
    """(doc_id, eval_id) of the hits whose slots are equal."""
    return hits.where("doc_window = item_window").select("doc_id", "eval_id").distinct()


def leaked_items(hits: DataFrame, width: int = 12) -> DataFrame:
    """One row per document and item of which at least one template window (``width`` words, or all words of a shorter
    item) occurs in it: windows that agree word by word (n_exact), template windows, the longest stretch whose words map
    one to one with at least half of them equal (0: none of a window's length), how many of its words are the same, the
    item's words, and whether there is such a stretch.

    Items and documents without words match nothing; repeated documents each count; equal items are each reported; an
    empty table on either side gives an empty result.
    """
    grouped = hits.groupBy("doc_id", "eval_id", "item_words").agg(F.collect_list(F.struct("at", "start", "doc_window", "item_window")).alias("hits"))  # of one document and item
    return grouped.mapInArrow(_slots(width), "doc_id long, eval_id long, n_exact int, n_windows int, longest int, same_words int, item_words int, consistent boolean")
