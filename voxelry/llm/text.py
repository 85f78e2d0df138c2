"""Vectorised word helpers for Arrow batches: words are maximal runs of ``[^\\x20\\x09-\\x0D]``."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are worked on at once within an Arrow batch; longer single texts are taken whole.
SLICE_BYTES = 16 << 20
#: The same where every token has a place in memory.
TOKEN_BYTES = 4 << 20


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The column as large_string, nulls as empty texts."""
    return pc.fill_null(batch.column(column).cast(pa.large_string()), "")


def trimmed() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other systems than GNU have no such call
        ctypes.CDLL(None).malloc_trim(0)


def released(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` that gives freed memory back to the system after each batch: a Python worker that waits for its next stage
    keeps all that it holds beside the executor's heap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in work(batches):
            yield out
            trimmed()

    return run


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes of text each, or a single longer text."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at, base = 0, 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield at, to
        base, at = int(ends[to - 1]), to


def cut_long(texts: pa.Array, limit: int) -> tuple[pa.Array, np.ndarray]:
    """The texts, those of more than ``limit`` bytes in parts cut at white space where there is any, and each part's text."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    if not len(sizes) or sizes.max() <= limit:
        return texts, np.arange(len(texts))
    parts, of, step = [], [], max(1, limit // 8)  # at most four bytes a character
    for i, text in enumerate(texts.to_pylist()):
        at = 0
        while len(text) - at > 2 * step and sizes[i] > limit:
            m = SPACE.search(text, at + step, at + 2 * step)
            to = m.start() if m else at + 2 * step
            parts.append(text[at:to]), of.append(i)
            at = to
        parts.append(text[at:]), of.append(i)
    return pa.array(parts, pa.large_string()), np.array(of)


SPACE = re.compile(r"[ \t-\r]")


@dataclass
class Words:
    """Words of some texts: ``codes`` point into ``unique``; text i has codes[starts[i]:starts[i + 1]]."""

    codes: np.ndarray
    starts: np.ndarray
    unique: pa.Array

    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), self.counts())


def encode(parts: pa.Array) -> Words:
    """Dictionary-encode a list array of words, leaving empty ones out."""
    flat = parts.flatten()
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(parts)), sizes)[full]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum(np.bincount(rows, minlength=len(parts)), out=starts[1:])
    return Words(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), starts, coded.dictionary)


def split_words(texts: pa.Array, lower: bool = False) -> Words:
    """Words of each text; ``lower`` maps A-Z alone to a-z first."""
    return encode(pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts))


def word_hashes(unique: pa.Array) -> np.ndarray:
    """64-bit hashes of the words' bytes."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(x) for x in unique.cast(pa.large_binary()).to_pylist()), np.uint64, len(unique))


def byte_hashes(unique: pa.Array) -> np.ndarray:
    """64-bit hashes of the words' bytes by sums of a mixed value for each byte and place: as ``word_hashes``, for many words
    at once."""
    words = pa.concat_arrays([unique.cast(pa.large_binary())])
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].astype(np.uint64)
    starts, lengths = ends[:-1] - ends[0], np.diff(ends)
    place = (np.arange(len(raw)) - np.repeat(starts, lengths)).astype(np.uint64)
    x = (raw + (place << np.uint64(8)) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)])
    out = (sums[starts + lengths] - sums[starts]) * np.uint64(0xC2B2AE3D27D4EB4F)
    return out ^ (out >> np.uint64(31))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


#: Letters below U+0180 that no normalisation changes but lower case, then plain punctuation.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+)([.,;:!?]*)")


class WordEncoder:
    """Token ids of whole texts through the tokenizers library, each distinct word once.

    The vocabulary's normaliser and splitter never join characters across white space, so a text's ids are its words'
    ids one after another; nor do they join letters with the punctuation behind them. A run of plain letters is one
    pre-token, which goes to the library's model at once, mapped to its byte alphabet; all else goes through the whole
    encoder. Words seen before are kept, somewhat above ``keep`` of them; then the store starts afresh.
    """

    def __init__(self, path: str, keep: int = 550_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.model = self.tokenizer.model
        mapped = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        letters = [chr(c) for c in range(0xC0, 0x180)]
        self.alphabet = str.maketrans({c: mapped(c)[0][0] for c in letters})
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, words: list[str]) -> None:
        """Take in distinct words that are not known yet."""
        match, tokenize, alphabet = PLAIN.fullmatch, self.model.tokenize, self.alphabet
        found = list(map(match, words))
        other = [w for w, m in zip(words, found, strict=True) if not m] + list({m[2] for m in found if m})
        known = {w: x.ids for w, x in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True)}
        flat, lengths = [], []
        for w, m in zip(words, found, strict=True):
            if m:
                head = m[1].lower()
                if (ids := known.get(head)) is None:
                    ids = known[head] = [t.id for t in tokenize(head if head.isascii() else head.translate(alphabet))]
                if m[2]:
                    ids = ids + known[m[2]]
            else:
                ids = known[w]
            flat += ids
            lengths.append(len(ids))
        lengths = np.array(lengths, np.int64)
        self.index.update(zip(words, range(len(self.lengths), len(self.lengths) + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.flat, self.lengths = np.concatenate([self.flat, np.array(flat, np.uint32)]), np.concatenate([self.lengths, lengths])

    def ids(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by ``end``, as uint32, and where each text starts (one more at the end)."""
        words = split_words(texts)
        unique = words.unique.to_pylist()
        if len(self.index) > self.keep:
            self.clear()
        get = self.index.get
        gc.disable()  # the lists made here hold no cycles
        if missing := [w for w in unique if get(w) is None]:
            self.learn(missing)
        gc.enable()
        known = np.fromiter(map(self.index.__getitem__, unique), np.int64, len(unique))
        # the words of these texts, and the end id as one more word behind each text
        lengths = np.append(self.lengths[known], 1)
        local = np.append(self.flat[spread(self.starts[known], lengths[:-1])], np.uint32(end))
        first = np.cumsum(lengths) - lengths
        coded = np.full(len(words.codes) + len(texts), len(unique), np.int64)
        coded[np.arange(len(words.codes)) + words.rows()] = words.codes
        sizes = lengths[coded]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return local[spread(first[coded], sizes)], ends[words.starts + np.arange(len(words.starts))]


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker."""
    return WordEncoder(path)
