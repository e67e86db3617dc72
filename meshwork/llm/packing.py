"""Packing token sequences: non-negative least squares over window patterns.

Documents are cut into chunks of a full window and one tail. A task gathers a
shard of tails (bounded in tokens), counts them by length bin, enumerates the
multisets of at most ``DEPTH`` bins that nearly fill a window, solves
``min |A x - histogram|, x >= 0`` for how often each pattern is used, scales
the solution to what the bins hold, rounds down, solves again for what is left
(at most ``SOLVES`` times) and fills those windows. Tails that no pattern took form a stream from
which the holes of pattern windows and then whole windows are filled greedily,
cutting where a window ends. What is left of a shard goes into windows whose
lengths are powers of two, which need no padding.

Every shard stands alone, so packing is one narrow stage: no shuffle, nothing
gathered, and memory bounded by the shard however large a partition is. A shard
is wholly made by one task attempt, so a retried task stays consistent.

Defined results: null text counts as empty (only the end id); repeated rows are
packed once each; an empty table gives no rows; extra columns are ignored.
Texts of any length are encoded whole and cut where sequences end.
"""

from __future__ import annotations

import functools
import os
import string
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, read_table

WINDOW = 4096
END_ID = 2
DEPTH = 8
BINS = 16
SOLVES = 8
SHARD_TOKENS = 2_000_000
#: Words whose ids a worker keeps in each of two generations.
CACHE_WORDS = 400_000
JOINED_WORDS = 1_000
#: Texts that are encoded together.
TEXTS = 200
#: How the vocabulary marks a word's last piece, and ASCII punctuation, which never joins a letter before it.
WORD_END = "</w>"
MARKS = string.punctuation.encode()
#: What the vocabulary's special tokens begin with.
SPECIAL = b"<|"
PIECES_SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
)


class WordEncoder:
    """Ids of whole texts, as little-endian uint32 bytes, word by word.

    The vocabulary's pre-tokenizer never joins what ASCII white space parts, so
    a text's ids are those of its words. A worker keeps ids of words in two
    generations of bounded size: a full young one becomes the old one, and what
    is met again comes back from there, so frequent words stay. Ending
    punctuation is its own pre-token and is looked up apart; words of letters
    alone are encoded many at a time and parted at their last pieces.
    """

    def __init__(self, path: str, cache_words: int | None = None):
        self.cache_words = cache_words or CACHE_WORDS
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # for lower-case words of letters in composed form, all that normalizing and splitting at classes of characters do is part them
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.words: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith(WORD_END)]] = True

    def _letters(self, words: list[bytes]) -> np.ndarray:
        """Ids of words of letters, one after the other."""
        text = b" ".join(words).decode()
        low = text.lower()
        # lower-casing may depend on what stands around a letter, take one apart, or leave room for composition
        if "Σ" in text or not low.replace(" ", "").isalpha() or not unicodedata.is_normalized("NFC", low):
            return self._ids([text])[0]
        return np.array(self.plain.encode_batch_fast([low], add_special_tokens=False)[0].ids, dtype="<u4")

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of each word."""
        texts = [w.decode() for w in words]
        found: dict[bytes, bytes] = {}
        letters = [w for w, t in zip(words, texts) if t.isalpha()]
        rest = [(w, t) for w, t in zip(words, texts) if not t.isalpha()]
        for at in range(0, len(letters), JOINED_WORDS):
            some = letters[at : at + JOINED_WORDS]
            ids = self._letters(some)
            ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(ends) == len(some):
                data, start = ids.tobytes(), 0
                for word, end in zip(some, ends.tolist()):
                    found[word] = data[start:end]
                    start = end
            else:  # lower-casing took a letter apart
                rest += [(w, w.decode()) for w in some]
        found.update((w, ids.tobytes()) for (w, _), ids in zip(rest, self._ids([t for _, t in rest])))
        return found

    def _learn(self, unknown: set[bytes]) -> None:
        """Adds ids of words not yet known."""
        split = []
        plain = set()
        for word in unknown:
            stem = word.rstrip(MARKS)
            # a special token of the vocabulary may end in a mark, and a letter in lower case may end in one that joins others
            last = unicodedata.normalize("NFC", stem[-4:].decode(errors="ignore")[-1:].lower())
            if len(stem) < len(word) and SPECIAL not in word and last.isalpha():
                split.append((word, stem, word[len(stem) :]))
            else:
                plain.add(word)
        parts = {s for _, s, _ in split} | {m for _, _, m in split}
        self._recall(parts)
        self.words.update(self._encode(list(plain | parts.difference(self.words))))
        known = self.words
        known.update([(word, known[stem] + known[marks]) for word, stem, marks in split])

    def _recall(self, words: set[bytes]) -> None:
        old = self.old
        self.words.update([(w, old[w]) for w in words if w in old])

    def encode_many(self, texts: list[str | bytes]) -> list[bytes]:
        """Ids of each text (UTF-8 where it is bytes); unknown words of all texts are encoded in one batch."""
        split = [_words(t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass")) for t in texts]
        if len(self.words) > self.cache_words:
            self.words, self.old = {}, self.words
        unknown = set().union(*split).difference(self.words)
        self._recall(unknown)
        self._learn(unknown.difference(self.words))
        get = self.words.__getitem__
        return [b"".join(map(get, words)) for words in split]


def _words(text: bytes) -> list[bytes]:
    """Words with ASCII letters in lower case; special tokens are matched as they are written, so words that may hold one keep their case."""
    if SPECIAL not in text:
        return text.lower().split()
    return [w if SPECIAL in w else w.lower() for w in text.split()]


def _multisets(size: int, total: int, most: int) -> Iterator[list[int]]:
    """Multisets of ``size`` numbers from 0 to ``most`` with this sum, largest first."""
    if size == 0:
        if total == 0:
            yield []
        return
    for first in range(min(most, total), -(-total // size) - 1, -1):
        for rest in _multisets(size - 1, total - first, first):
            yield [first, *rest]


def patterns(bins: int = BINS, depth: int = DEPTH) -> np.ndarray:
    """Multisets of at most ``depth`` bins that fill a window, as count columns.

    Bin b holds lengths from b to b + 1 of ``bins`` parts of a window, so lengths
    of a multiset are expected to sum to its lower ends and half its size; this
    lies within a part of the window.
    """
    rows = []
    for size in range(2, depth + 1):
        for total in range(bins - 1 - size // 2, bins + 1 - (size + 1) // 2 + 1):
            rows += [np.bincount(chosen, minlength=bins) for chosen in _multisets(size, total, bins - 1)]
    return np.array(rows, dtype=float).T


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 1_000, close: float = 0.0) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradient steps, until the residual is ``close`` to none of b."""
    step = 1.0 / max(np.linalg.norm(a @ a.T, 2), 1e-9)
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for k in range(rounds):
        if k % 50 == 49 and np.abs(a @ x - b).sum() <= close * b.sum():
            break
        new = np.maximum(0.0, y - step * (a.T @ (a @ y - b)))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


@functools.cache
def _patterns() -> np.ndarray:
    return patterns()


def repeats(counts: np.ndarray) -> np.ndarray:
    """How often each pattern is used: solved, scaled to what each bin holds, rounded; then the same for what is left.

    The solution is spread over many similar patterns, most below one, so
    fractions are carried from a pattern to the next, which differs little.
    """
    columns = _patterns()
    total = np.zeros(columns.shape[1], dtype=np.int64)
    left = counts.astype(np.int64)
    for _ in range(SOLVES):
        x = nnls(columns, left.astype(float), close=0.02)
        over = columns @ x / np.maximum(left, 1e-9)
        x /= np.maximum(1.0, np.where(columns > 0, over[:, None], 0.0).max(0))
        times = np.diff(np.floor(np.cumsum(x) + 1e-9), prepend=0.0).astype(np.int64)
        used = 0
        for column in np.flatnonzero(times):
            need = columns[:, column].astype(np.int64)
            held = need > 0
            n = min(int(times[column]), int((left[held] // need[held]).min()))
            total[column] += n
            left -= n * need
            used += n
        if not used:
            break
    return total


def pattern_windows(lengths: np.ndarray, window: int = WINDOW) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Windows that patterns make of tails, and the pieces that are left over."""
    bins = np.minimum(lengths * BINS // window, BINS - 1)
    stacks = [list(np.flatnonzero(bins == b)) for b in range(BINS)]
    counts = np.array([len(s) for s in stacks])
    windows: list[list[tuple[int, int, int]]] = []
    stream: list[tuple[int, int, int]] = []
    if counts.sum() >= 2:
        times = repeats(counts)
        for column in np.flatnonzero(times):
            chosen = np.repeat(np.arange(BINS), _patterns()[:, column].astype(int))[::-1]
            for _ in range(times[column]):
                room, content = window, []
                for tail in [stacks[b].pop() for b in chosen]:
                    size = int(lengths[tail])
                    taken = min(size, room)
                    if taken:
                        content.append((int(tail), 0, taken))
                    if taken < size:
                        stream.append((int(tail), taken, size - taken))
                    room -= taken
                windows.append(content)
    stream += [(int(tail), 0, int(lengths[tail])) for stack in stacks for tail in stack]
    return windows, stream


def pack_tails(lengths: np.ndarray, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Windows of (tail, start in the tail, length); each tail token lies in one."""
    windows, stream = pattern_windows(lengths, window)
    stream.reverse()

    def fill(content: list[tuple[int, int, int]], room: int) -> None:
        while room and stream:
            tail, start, size = stream.pop()
            taken = min(size, room)
            content.append((tail, start, taken))
            if taken < size:
                stream.append((tail, start + taken, size - taken))
            room -= taken

    for content in windows:
        fill(content, window - sum(piece[2] for piece in content))
    left = sum(piece[2] for piece in stream)
    while left:
        # a last window that would not be full becomes powers of two
        room = window if left >= window else 1 << (left.bit_length() - 1)
        fill(content := [], room)
        windows.append(content)
        left -= room
    # windows of patterns whose holes the stream could not fill end as powers of two
    short = [w for w in windows if (n := sum(p[2] for p in w)) != window and n & (n - 1)]
    if short:
        windows = [w for w in windows if not ((n := sum(p[2] for p in w)) != window and n & (n - 1))]
        stream = [piece for w in short for piece in w][::-1]
        left = sum(piece[2] for piece in stream)
        while left:
            room = window if left >= window else 1 << (left.bit_length() - 1)
            fill(content := [], room)
            windows.append(content)
            left -= room
    return windows


def _pieces(ids: list[int], data: list[bytes], first_sequence: int, window: int) -> tuple[list[tuple], int]:
    rows: list[tuple] = []
    sequence = first_sequence
    tails: list[tuple[int, int]] = []
    for k, buffer in enumerate(data):
        n = len(buffer) // 4
        full = n - n % window
        for start in range(0, full, window):
            rows.append((ids[k], start, window, zlib.crc32(buffer[4 * start : 4 * (start + window)]), n, sequence, 0))
            sequence += 1
        if full < n:
            tails.append((k, full))
    lengths = np.array([len(data[k]) // 4 - full for k, full in tails], dtype=np.int64)
    for content in pack_tails(lengths, window) if tails else []:
        offset = 0
        for tail, start, size in content:
            k, full = tails[tail]
            at = full + start
            crc = zlib.crc32(data[k][4 * at : 4 * (at + size)])
            rows.append((ids[k], at, size, crc, len(data[k]) // 4, sequence, offset))
            offset += size
        sequence += 1
    return rows, sequence


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def _encoder(vocabulary: str, cache_words: int) -> WordEncoder:
    """The worker's encoder, which keeps its tables from task to task."""
    if (vocabulary, cache_words) not in _ENCODERS:
        _ENCODERS[vocabulary, cache_words] = WordEncoder(vocabulary, cache_words)
    return _ENCODERS[vocabulary, cache_words]


def pack_documents(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) packed into sequences of ``window`` ids.

    Returns one row per piece; see the module text. ``cache_words`` only trades
    a worker's memory (some 400 bytes each) against time. sequence_id is unique over
    the result: the task's partition in its high bits, a counter in the low 36.
    """
    end = np.array([end_id], dtype="<u4").tobytes()
    names = [f.split()[0] for f in PIECES_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, cache_words)
        sequence = TaskContext.get().partitionId() << 36
        ids: list[int] = []
        data: list[bytes] = []
        size = 0

        def flush():
            nonlocal sequence, ids, data, size
            rows, sequence = _pieces(ids, data, sequence, window)
            ids, data, size = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                found = encoder.encode_many([t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()])
                for doc_id, buffer in zip(part.column(0).to_pylist(), found):
                    ids.append(doc_id)
                    data.append(buffer + end)
                    size += len(buffer) // 4 + 1
                    if size >= SHARD_TOKENS:
                        yield flush()
        if ids:
            yield flush()

    return map_batches(docs.select("doc_id", F.col("text").cast("string")), run, PIECES_SCHEMA)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
