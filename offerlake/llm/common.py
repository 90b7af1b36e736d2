"""What the training-data operators share: words, hashes and a tokenizer front."""

from __future__ import annotations

import gc
import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..operators.shared import fresh_path, remove, shared_dir, stash, unstash

__all__ = ["Encoder", "encoder", "fresh_path", "remove", "shared_dir", "stash", "table", "unstash"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: str | None) -> bytes:
    """UTF-8 of a text; a null has none."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; bytes.split() and bytes.lower() know ASCII only, as is wanted."""
    raw = utf8(text)
    return (raw.lower() if lower else raw).split()


class WordHashes(dict):
    """word -> 64-bit hash, kept per Python worker and emptied when it holds ``most`` words."""

    def __init__(self, most: int = 400_000) -> None:
        super().__init__()
        import xxhash

        self._hash, self._most = xxhash.xxh64_intdigest, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self._most:
            self.clear()
        h = self[word] = self._hash(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` words; the sum over places, each with an odd multiplier, is then mixed."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        # Horner's rule by doubling: a run of 2m words is the run of m words times base**m plus the next run.
        total, have, rest = hashes.copy(), 1, width
        power = base
        out, done, shift = np.zeros(len(hashes), np.uint64), 0, np.uint64(1)
        while rest:
            if rest & 1:
                m = len(total) - done if done else len(total)
                out = out[: m] * power + total[done : done + m] if done else total.copy()
                done += have
            rest >>= 1
            if rest:
                m = len(total) - have
                if m <= 0:
                    break
                total = total[:m] * power + total[have : have + m]
                have, power = have * 2, power * power
        return mix64(out[:n] + np.uint64(width))


# Bytes of "plain" text, whose classes and case every Unicode version and regex library agrees on: tab, line ends, printable
# ASCII and the two-byte characters U+00A1 to U+017F but for those in _ODD. Texts with others go to the tokenizer whole.
_ODD = "\xad\xb2\xb3\xb9\xbc\xbd\xbe\u0130"
_SPACE, _LETTER, _DIGIT, _SIGN = range(4)


def _class(c: str) -> int:
    return _SPACE if c.isspace() else _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _SIGN


_BYTE_CLASS = np.array([_class(chr(b)) for b in range(128)] + [_LETTER] * 128, np.uint8)
_BYTE_ODD = np.array([not (b in b"\t\n\r" or 32 <= b < 127 or 0x80 <= b < 0xC0 or 0xC2 <= b <= 0xC5) for b in range(256)])
_PAIR_ODD = np.array([chr(c) in _ODD or c <= 0xA0 for c in range(0x180)])
_PAIR_CLASS = np.array([_class(chr(c)) for c in range(0x180)], np.uint8)
_PAIR_LOWER = np.array([c if chr(c) in _ODD else ord(chr(c).lower()) for c in range(0x180)], np.int64)
_BYTE_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
#: The byte-level alphabet: printable bytes stand for themselves, the others for characters from U+0100 on, in order.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = np.zeros(256, "<u4")
_ALPHABET[_SHOWN] = _SHOWN
_ALPHABET[[b for b in range(256) if b not in _SHOWN]] = 256 + np.arange(256 - len(_SHOWN))
_ENDS_BY_LETTER = np.isin(np.arange(256), list(b"stmd"))


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 of all texts, one after another, and where each begins (and the last ends). Nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8))[at[0] : at[-1]], at - at[0]


def runs_of(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places of many runs, each ``count`` long from ``first``, one after another."""
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """A ``tokenizers`` file for whole batches of texts.

    The texts' bytes are cut, all at once, where the file's own pre-tokenizer cuts them: into runs of letters, digits or
    signs. Arrow finds the distinct runs; those not met lately go to the file's model, and the ids of all runs are then
    gathered from one pool. Texts that are not plain (above) or hold an added token's string, and files
    whose rules are not known here, are encoded whole.
    """

    def __init__(self, path: str, most: int = 500_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.size, self.kind, self._most = self.tok.get_vocab_size(), self._kind(spec), most
        self._added = [t["content"].lower().encode() for t in spec.get("added_tokens") or []]
        self._tokenize = self.tok.model.tokenize
        self._clear()

    @staticmethod
    def _kind(spec: dict) -> str:
        pre, norm, model = spec.get("pre_tokenizer") or {}, spec.get("normalizer"), spec["model"]
        added = [t["content"] for t in spec.get("added_tokens") or []]
        if spec.get("truncation") or spec.get("padding") or model.get("type") != "BPE" or model.get("dropout") or not all(a.isascii() and a for a in added):
            return "whole"
        # The two rules of cutting that are known.
        if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and norm is None:
            return "bytes"
        words = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        cuts = [(p.get("type"), (p.get("pattern") or {}).get("Regex"), p.get("invert"), p.get("use_regex"), p.get("add_prefix_space")) for p in pre.get("pretokenizers", [])]
        norms = [(n.get("type"), (n.get("pattern") or {}).get("Regex"), n.get("content")) for n in (norm or {}).get("normalizers", [])]
        if cuts == [("Split", words, True, None, None), ("ByteLevel", None, None, False, False)] and norms == [("NFC", None, None), ("Replace", r"\s+", " "), ("Lowercase", None, None)]:
            return "words"
        return "whole"

    def _clear(self) -> None:
        self._at: dict[bytes, int] = {}
        self._ids, self._first, self._count = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        encode = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        return [np.array(e.ids, np.uint32) for e in encode(texts, add_special_tokens=False)]

    def _odd(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A flag for each text that must be encoded whole."""
        odd = [np.flatnonzero(_BYTE_ODD[data])]
        lead = np.flatnonzero(data >= 0xC2)
        lead = lead[(data[lead] <= 0xC5) & (lead + 1 < len(data))]
        odd.append(lead[_PAIR_ODD[((data[lead] & 31).astype(np.int64) << 6) | (data[lead + 1] & 63)]])
        lower = data.tobytes().lower() if self._added else b""
        for token in self._added:
            k = lower.find(token)
            while k >= 0:
                odd.append(np.array([k]))
                k = lower.find(token, k + 1)
        out = np.zeros(len(at) - 1, bool)
        out[np.searchsorted(at, np.concatenate(odd), "right") - 1] = True
        return out

    def _cut(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of plain texts: the bytes that are encoded, where each run of them begins, and the runs before each text."""
        words, n = self.kind == "words", len(data)
        lead = np.flatnonzero(data >= 0xC2)
        pair = ((data[lead] & 31).astype(np.int64) << 6) | (data[lead + 1] & 63)
        if words:
            data = _BYTE_LOWER[data]
            low = _PAIR_LOWER[pair]
            data[lead], data[lead + 1] = 0xC0 | (low >> 6), 0x80 | (low & 63)
        kind = _BYTE_CLASS[data]
        kind[lead] = kind[lead + 1] = _PAIR_CLASS[pair]
        blank = kind == _SPACE
        begins = np.zeros(n + 1, bool)
        begins[at[:-1]] = True
        heads = begins.copy()
        begins[1:n] |= kind[1:] != kind[:-1]
        begins[n] = True
        if words:
            begins[:n] |= kind == _DIGIT
        else:
            # the last blank before other text is on its own, and a space goes with what follows
            last = np.flatnonzero(blank[:-1] & ~blank[1:])
            last = last[~heads[last + 1]]
            begins[last] = True
            begins[last[data[last] == 32] + 1] = False
        mark = np.flatnonzero((data == 39) & begins[:n])
        if len(mark):
            end = at[np.searchsorted(at, mark, "right")]
            after = np.r_[data, 0, 0]
            one, two = after[mark + 1], after[mark + 2]
            short = _ENDS_BY_LETTER[one] & (mark + 1 < end)
            long = (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)) & (mark + 2 < end)
            begins[mark[short | long] + 1] = False
            begins[mark[short] + 2] = True
            begins[mark[long] + 3] = True
        begins = begins[:n]
        if words:
            begins &= ~blank
            before = np.searchsorted(np.flatnonzero(begins), at)
            return data[~blank], np.flatnonzero(begins[~blank]), before
        first = np.flatnonzero(begins)
        return data, first, np.searchsorted(first, at)

    def _learn(self, runs: list[bytes]) -> None:
        """Put the ids of runs that are not known into the pool. A zero byte, which plain text has not, keeps them apart."""
        text = _ALPHABET[np.frombuffer(b"\0".join(runs), np.uint8)]
        gap = int(_ALPHABET[0])
        tokenize = self._tokenize
        ids = [[t.id for t in tokenize(r)] for r in text.tobytes().decode("utf-32-le").split(chr(gap))]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(count.sum()))
        self._at.update(zip(runs, range(len(self._count), len(self._count) + len(runs))))
        self._first = np.r_[self._first, len(self._ids) + np.cumsum(count) - count]
        self._ids, self._count = np.r_[self._ids, flat], np.r_[self._count, count]

    def _plain_ids(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all plain texts, and how many each has."""
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(at) - 1, np.int64)
        data, first, before = self._cut(data, at)
        if not len(first):
            return np.empty(0, np.uint32), np.zeros(len(at) - 1, np.int64)
        offsets = np.r_[first, len(data)].astype(np.int64)
        runs = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        names = runs.dictionary.to_pylist()
        if unknown := [r for r in names if r not in self._at]:
            self._learn(unknown)
        where = np.fromiter(map(self._at.__getitem__, names), np.int64, len(names))
        own = where[runs.indices.to_numpy()]
        count = self._count[own]
        ids = self._ids[runs_of(self._first[own], count)]
        sums = np.r_[0, np.cumsum(count)]
        if len(self._at) > self._most:  # keep what this batch has
            first, count = self._first[where], self._count[where]
            self._ids, self._count, self._first = self._ids[runs_of(first, count)], count, np.cumsum(count) - count
            self._at = dict(zip(names, range(len(names))))
        return ids, np.diff(sums[before])

    def encode_some(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids (unsigned, 32 bits) of all texts, one after another, and how many each has; nulls have none."""
        data, at = flat_bytes(texts)
        sizes = np.diff(at)
        odd = self._odd(data, at) if self.kind != "whole" and len(data) else sizes > 0
        if odd.any():
            data = data[np.repeat(~odd, sizes)]
            at = np.r_[0, np.cumsum(np.where(odd, 0, sizes))]
        collects = gc.isenabled()
        gc.disable()  # many small lists live shortly and none is in a cycle: the collector would only walk them
        try:
            ids, counts = self._plain_ids(data, at)
        finally:
            if collects:
                gc.enable()
        if odd.any():
            sums, parts, done = np.r_[0, np.cumsum(counts)], [], 0
            rows = np.flatnonzero(odd)
            for k, got in zip(rows, self._whole([texts[int(k)].as_py() for k in rows])):
                parts += [ids[done : sums[k]], got]
                done = sums[k]
                counts[k] = len(got)
            ids = np.concatenate([*parts, ids[done:]])
        return ids, counts

    def encode_column(self, texts: pa.Array, end: int | None = None, at_once: int = 8_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same for slices of a column, some ``at_once`` bytes together (and one text at least). ``end`` closes every text."""
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + at_once, "right")))
            ids, counts = self.encode_some(texts.slice(at, to - at))
            if end is not None:
                counts = counts + 1
                ends = np.cumsum(counts) - 1
                with_ends = np.full(int(counts.sum()), end, np.uint32)
                inside = np.ones(len(with_ends), bool)
                inside[ends] = False
                with_ends[inside] = ids
                ids = with_ends
            yield ids, counts
            at = to


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def crc32(data) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
