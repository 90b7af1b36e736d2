"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Words are ``[0-9a-z]`` and non-ASCII characters in runs, A-Z lower-cased. The automaton's patterns are the windows
of ``width`` consecutive words of every item (an item of fewer words, but not none, is one pattern). Its letters are word
numbers: each word of an item has one, all other words share one that no pattern has. So a window is ``width`` nodes at
most. A text becomes such a string and is scanned once; a hit ends at a word, and words keep their place in the original.

Texts are numbered many at a time: Arrow finds the distinct words of some megabytes of text, and each of those is looked up once.

Items reach the driver as a stream and fill blocks of at most ``block_words`` windows and ``BLOCK_NAMES`` different words (a long item is cut
into overlapping parts): each block is one automaton, sent to the tasks with the code that scans and kept by their Python workers. A full block of
150,000 windows of 13 words, all different, has 1.94 million nodes and takes a worker 190 MB (measured). There is one block unless
the items outgrow that; then texts are scanned once a block, one block after the other, and hits are merged by row.
Results don't depend on the number of blocks.

Null and empty texts have no words and no hits; null or wordless items match nothing, as do items without an id; repeated
item ids count once per document; repeated or null document ids stay separate rows, each judged by its own text; empty tables
give no rows, or no hits. Ids may be of any type. Other columns are kept by ``decontaminate`` and not read by ``contamination``.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import flat_bytes, stash, utf8

WIDTH = 13
BLOCK_WORDS = 150_000
#: Different words of a block; an automaton's letters are code points, of which there are some 1,112,000.
BLOCK_NAMES = 1_000_000
#: Bytes of text that are numbered at once (and one text at least).
AT_ONCE = 8_000_000

#: Every byte that ends a word, as a space; A-Z as a-z; all others as they are.
_NORMAL = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def normal_words(text: str | None) -> list[bytes]:
    return utf8(text).translate(_NORMAL).split()


_NORMAL_BYTES = np.frombuffer(_NORMAL, np.uint8)


def letter(k: int) -> int:
    """The code point of word number ``k``; surrogates, which no text may hold, are left out. 0 is every word that no item has."""
    return k + 1 if k + 1 < 0xD800 else k + 0x801


class Scanner:
    """The automaton of a block of items, each an id and words. It is built where it is used."""

    def __init__(self, items: list[tuple], width: int = WIDTH) -> None:
        import ahocorasick

        windows: dict[tuple, set] = {}
        for item, words in items:
            for i in range(max(1, len(words) - width + 1) if words else 0):
                windows.setdefault(tuple(words[i : i + width]), set()).add(item)
        names = sorted({w for words in windows for w in words})
        self.letters = {w: letter(k) for k, w in enumerate(names)}
        self.automaton = ahocorasick.Automaton()
        for words, ids in windows.items():
            self.automaton.add_word("".join(chr(self.letters[w]) for w in words), (len(words), tuple(ids)))
        self.empty = not windows
        if windows:
            self.automaton.make_automaton()

    def scan(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, set]]:
        """For each text its words, the numbers of hit ones, and the items that occur."""
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + AT_ONCE, "right")))
            yield from self._some(texts.slice(at, to - at))
            at = to

    def _some(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, set]]:
        data, at = flat_bytes(texts)
        data = _NORMAL_BYTES[data]
        inside = data != 32
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        heads = at[:-1][at[:-1] < len(data)]
        begins[heads] = inside[heads]  # a text's first byte begins a word, whatever the text before ends with
        first = np.flatnonzero(begins)
        before = np.searchsorted(first, at)
        none = np.empty(0, np.int64)
        if self.empty or not len(first):
            yield from ((int(n), none, set()) for n in np.diff(before))
            return
        dense = np.r_[0, np.cumsum(inside)]
        offsets = np.r_[dense[first], dense[-1]].astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
        names = words.dictionary.to_pylist()
        own = np.fromiter(map(self.letters.get, names, itertools.repeat(0)), "<u4", len(names))
        numbers = own[words.indices.to_numpy()]
        some = np.r_[0, np.cumsum(numbers != 0)]
        for a, b in zip(before[:-1].tolist(), before[1:].tolist()):
            if some[a] == some[b]:
                yield b - a, none, set()
                continue
            hit, found = np.zeros(b - a, bool), set()
            for end, (n, ids) in self.automaton.iter(numbers[a:b].tobytes().decode("utf-32-le")):
                hit[end + 1 - n : end + 1] = True
                found.update(ids)
            yield b - a, np.flatnonzero(hit), found


def word_spans(text: str) -> np.ndarray:
    """(begin, end) in characters of the original text, for each word."""
    raw = utf8(text)
    flag = np.frombuffer(raw.translate(_NORMAL), np.uint8) != 32
    edge = np.diff(np.r_[False, flag, False].astype(np.int8))
    # bytes that begin a character, counted up to each place
    chars = np.r_[0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)]
    return np.stack([chars[np.flatnonzero(edge == 1)], chars[np.flatnonzero(edge == -1)]], 1)


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int, width: int, block_names: int = BLOCK_NAMES) -> Iterator[list[tuple]]:
    """Items (id, words) in blocks of at most ``block_words`` windows and ``block_names`` different words (but for a single part that has more of
    those), made one at a time; an empty table gives one empty block."""
    rows = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null and t is not null")
    block, size, names, none = [], 0, set(), True
    for r in rows.toLocalIterator():
        words = normal_words(r.t)
        for at in range(0, max(1, len(words) - width + 1) if words else 0, max(1, block_words)):
            part = words[at : at + block_words + width - 1]
            n = max(1, len(part) - width + 1)
            own = set(part)
            if block and (size + n > block_words or len(names) + len(own - names) > block_names):
                yield block
                block, size, names, none = [], 0, set(), False
            block.append((r.i, part))
            names |= own
            size += n
    if block or none:
        yield block


#: The automaton that a Python worker used last, by the name of its block.
_LAST: dict[str, Scanner] = {}


def _scanning(items: list[tuple], width: int, do: Callable) -> Callable:
    """A function of batches; a worker builds the automaton once for all its tasks."""
    name = uuid.uuid4().hex

    def run(batches):
        if name not in _LAST:
            _LAST.clear()
            _LAST[name] = Scanner(items, width)
        scanner = _LAST[name]
        for batch in batches:
            yield do(scanner, batch)

    return run


def _hits(rows: DataFrame, blocks: Iterator[list[tuple]], width: int, item_type, first: list[tuple]) -> DataFrame:
    """row, n_words, words (numbers of hit ones), items, of ``rows`` (row, text); rows without a hit may be absent from
    all but the first block. ``first``: the block that was read already."""
    kind = to_arrow_type(item_type)
    schema = f"row long, n_words long, words array<int>, items array<{item_type.simpleString()}>"

    def scan(whole: bool) -> Callable:
        def do(scanner: Scanner, batch: pa.RecordBatch) -> pa.RecordBatch:
            at, ns, words, found = [], [], [], []
            for k, (n, hit, items) in enumerate(scanner.scan(batch.column(1))):
                if whole or items:
                    at.append(k)
                    ns.append(n)
                    words.append(hit)
                    found.append(sorted(items, key=str))
            return pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), pa.array(ns, pa.int64()), pa.array(words, pa.list_(pa.int32())), pa.array(found, pa.list_(kind))], names=["row", "n_words", "words", "items"])

        return do

    out = rows.mapInArrow(_scanning(first, width, scan(True)), schema)
    more = [stash(rows.mapInArrow(_scanning(items, width, scan(False)), schema), "decontaminate-hits") for items in blocks]
    if not more:
        return out
    for m in more:
        out = out.unionByName(m)
    flat = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    out = out.groupBy("row").agg(F.max("n_words").alias("n_words"), F.array_sort(flat("words")).alias("words"), flat("items").alias("items"))
    by_text = F.array_sort(F.transform("items", lambda x: F.struct(x.cast("string").alias("s"), x.alias("x"))))
    return out.withColumn("items", F.transform(by_text, lambda x: x["x"]))


def _numbered(docs: DataFrame, several: bool) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, written down where it is used more than once."""
    name = "row"
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    rows = docs.withColumn(name, F.monotonically_increasing_id())
    return (stash(rows, "decontaminate-rows") if several else rows), name


def _contaminated(n_words: Column, n_hit: Column, share: tuple[int, int]) -> Column:
    return (n_hit > 0) & (share[1] * n_hit >= share[0] * n_words)


def _first_of(blocks: Iterator[list[tuple]]) -> tuple[list[tuple], Iterator[list[tuple]], bool]:
    """The first block, all the others, and whether there are others."""
    first = next(blocks)
    second = next(blocks, None)
    return first, itertools.chain([second], blocks) if second is not None else iter(()), second is not None


def contamination(docs: DataFrame, benchmark: DataFrame, *, width: int = WIDTH, share: tuple[int, int] = (1, 20), block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: its id as doc_id, n_words, n_hit, n_items, items (ids, sorted as strings), spans (character ranges
    of hit words) and contaminated (at least ``share`` of its words are hit)."""
    first, others, several = _first_of(item_blocks(benchmark, item_col, item_text_col, block_words, width))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    item_type = benchmark.schema[item_col].dataType
    kinds = f"n_words long, words array<int>, items array<{item_type.simpleString()}>, begins array<int>, ends array<int>"
    id_type = docs.schema[id_col].dataType.simpleString()

    def placed(words: list, texts: pa.Array) -> list[pa.Array]:
        spans = [word_spans(texts[k].as_py())[w] if len(w) else np.empty((0, 2), int) for k, w in enumerate(words)]
        return [pa.array([x[:, k] for x in spans], pa.list_(pa.int32())) for k in (0, 1)]

    if several:
        rows, _ = _numbered(rows, True)
        hits = _hits(rows.select("row", "text"), others, width, item_type, first)

        def place(batches):
            for batch in batches:
                words = [np.array(w or [], int) for w in batch.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(c) for c in (2, 3, 4)), *placed(words, batch.column(1))], names=["doc_id", "n_words", "words", "items", "begins", "ends"])

        out = rows.join(hits, "row").select("doc_id", "text", "n_words", "words", "items").mapInArrow(place, f"doc_id {id_type}, {kinds}")
    else:
        kind = to_arrow_type(item_type)

        def do(scanner: Scanner, batch: pa.RecordBatch) -> pa.RecordBatch:
            found = list(scanner.scan(batch.column(1)))
            words = [hit for _, hit, _ in found]
            cols = [pa.array([n for n, _, _ in found], pa.int64()), pa.array(words, pa.list_(pa.int32())), pa.array([sorted(i, key=str) for _, _, i in found], pa.list_(kind))]
            return pa.RecordBatch.from_arrays([batch.column(0), *cols, *placed(words, batch.column(1))], names=["doc_id", "n_words", "words", "items", "begins", "ends"])

        out = rows.mapInArrow(_scanning(first, width, do), f"doc_id {id_type}, {kinds}")
    n_hit = F.size("words").cast("long")
    out = out.withColumns({"n_hit": n_hit, "n_items": F.size("items").cast("long"), "contaminated": _contaminated(F.col("n_words"), n_hit, share)})
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items", F.arrays_zip("begins", "ends").alias("spans"), "contaminated")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, width: int = WIDTH, share: tuple[int, int] = (1, 20), block_words: int = BLOCK_WORDS, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    first, others, several = _first_of(item_blocks(benchmark, item_col, item_text_col, block_words, width))
    if several:
        rows, row = _numbered(docs, True)
        hits = _hits(rows.select(F.col(row).alias("row"), F.col(text_col).cast("string").alias("text")), others, width, benchmark.schema[item_col].dataType, first)
        bad = hits.where(_contaminated(F.col("n_words"), F.size("words").cast("long"), share)).select(F.col("row").alias(row))
        return rows.join(bad, row, "left_anti").drop(row)
    at, (low, high) = docs.columns.index(text_col), share

    def keep(scanner: Scanner, batch: pa.RecordBatch) -> pa.RecordBatch:
        flags = [not (len(hit) and high * len(hit) >= low * n) for n, hit, _ in scanner.scan(batch.column(at).cast(pa.string()))]
        return batch.filter(pa.array(flags, pa.bool_()))

    return docs.mapInArrow(_scanning(first, width, keep), docs.schema)


def items_sha256(items: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, items)).encode()).hexdigest()
