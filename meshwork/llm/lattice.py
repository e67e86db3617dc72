"""Language-model scores by the subword lattice.

The pieces of an existing vocabulary span a lattice over each word: every way
to cut the word into pieces is a path. A piece's probability comes from its
rank in the vocabulary and from how often the training words use it. The
forward recursion in log space sums all paths, so a word's score is its
marginal probability, and a document's is the product over its words and one
end. Pieces never cross white space, so the document's lattice is the chain of
its words' lattices and each distinct word needs to be solved once.

Words are counted over the whole corpus with sums in each task before the
shuffle. The ``HEAD_WORDS`` most frequent words (a fixed bound) are broadcast;
what other words add to a document is joined by word and summed per row.

Defined results: null and empty texts are one end token; rows that repeat a
doc_id are scored apart; without training rows counts are 0 and piece
probabilities come from the vocabulary's ranks alone; an empty table gives no rows.
Texts and words of any length are scored whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, map_batches, read_table, written

HEAD_WORDS = 200_000
#: Distinct words that a task gathers before it passes its counts on.
TASK_WORDS = 400_000
#: Weight of the vocabulary's ranks against one use of a piece in training.
RANK_WEIGHT = 1_000.0
SMOOTH = 0.1
_SPACE = "▁"


class Lattice:
    """Marginal log10 probabilities of words under piece probabilities."""

    def __init__(self, pieces: list[str], scores: list[float], counts: dict[int, int] | None = None):
        """``scores``: the vocabulary's, higher for likelier pieces; ``counts``: uses in training by piece id."""
        usable = [i for i, p in enumerate(pieces) if p and not (p.startswith("<") and p.endswith(">") and len(p) > 2) or p.startswith("<0x")]
        rank = {i: r for r, i in enumerate(sorted(usable, key=lambda i: (-scores[i], i)))}
        weight = np.array([1.0 / (rank[i] + 10.0) for i in usable])
        weight *= RANK_WEIGHT / weight.sum()
        if counts:
            weight += np.array([counts.get(i, 0) for i in usable], dtype=float)
        logs = np.log10(weight / weight.sum())
        table = {pieces[i]: float(x) for i, x in zip(usable, logs)}
        floor = float(logs.min())
        self.bytes = [table.get(f"<0x{b:02X}>", floor) for b in range(256)]
        self.pieces = {p: x for p, x in table.items() if not p.startswith("<0x")}
        self.longest = max(map(len, self.pieces))

    def word(self, word: str) -> float:
        """log10 of the summed probability of all segmentations of the word and its leading space."""
        text = _SPACE + word
        get, longest, n = self.pieces.get, self.longest, len(text)
        total = [0.0] + [-math.inf] * n
        for a in range(n):
            base = total[a]
            if base == -math.inf:
                continue
            for b in range(a + 1, min(n, a + longest) + 1):
                x = get(text[a:b])
                if x is None:
                    if b != a + 1:
                        continue
                    # a character that the vocabulary lacks is spelt in bytes
                    x = sum(self.bytes[c] for c in text[a].encode("utf-8", "surrogatepass"))
                x += base
                y = total[b]
                if y == -math.inf:
                    total[b] = x
                else:
                    high, low = (x, y) if x > y else (y, x)
                    total[b] = high + math.log10(1.0 + 10.0 ** (low - high)) if high - low < 17 else high
        return total[n]


def _tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c_train) of every distinct word of docs (text, training); c_train is 0 for words outside training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train: Counter = Counter()
        other: set[bytes] = set()

        def flush() -> pa.RecordBatch:
            words = [*train, *(w for w in other if w not in train)]
            out = pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()).cast(pa.string()), pa.array([train.get(w, 0) for w in words], pa.int64())], names=["word", "c"]
            )
            train.clear()
            other.clear()
            return out

        for batch in batches:
            for text, training in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = _tokens(text)
                train.update(words) if training else other.update(words)
                if len(train) + len(other) > TASK_WORDS:
                    yield flush()
        if train or other:
            yield flush()

    parts = map_batches(docs.select(F.col("text").cast("string"), "training"), run, "word string, c bigint")
    return parts.groupBy("word").agg(F.sum("c").alias("c"))


def count_pieces(words: DataFrame, vocabulary: str) -> DataFrame:
    """(piece, uses): how often the vocabulary's own segmentation of the training words uses each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        uses = np.zeros(model.get_piece_size(), dtype=np.int64)
        for batch in batches:
            counts = batch.column(1).to_numpy(zero_copy_only=False)
            for at in range(0, batch.num_rows, 2000):
                found = model.encode(batch.column(0).slice(at, 2000).to_pylist(), num_threads=1)
                lengths = np.array([len(f) for f in found])
                ids = np.fromiter((i for f in found for i in f), dtype=np.int64, count=int(lengths.sum()))
                np.add.at(uses, ids, np.repeat(counts[at : at + 2000], lengths))
        some = np.flatnonzero(uses)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(uses[some])], names=["piece", "uses"])

    parts = map_batches(words.where("c > 0").select("word", "c"), run, "piece bigint, uses bigint")
    return parts.groupBy("piece").agg(F.sum("uses").alias("uses"))


def _lattice(vocabulary: str, uses: dict[int, int]) -> Lattice:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    ids = range(model.get_piece_size())
    return Lattice([model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids], uses)


def score_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Scores of every row of ``docs`` (doc_id, text, training); learned from rows with training true.

    Returns doc_id, n_tokens, n_known, train_tokens, base_score and score.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce("training", F.lit(False)).alias("training"))
    words = written(count_words(docs), "words")
    n_train = docs.where("training").count()
    sums = words.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    train_tokens = (sums.n or 0) + n_train
    distinct = sums.v + (1 if n_train else 0)
    uses = {r.piece: r.uses for r in count_pieces(words, vocabulary).collect()}  # at most one row a piece

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(vocabulary, uses)
        for batch in batches:
            logs = [lattice.word(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logs, pa.float64())], names=["word", "c", "lattice"])

    solved = written(map_batches(words, solve, "word string, c bigint, lattice double"), "solved")
    # the bound of the head: the count that the HEAD_WORDS-th word has, from a histogram of counts
    histogram = solved.groupBy(F.least("c", F.lit(100_000).cast("bigint")).alias("c")).count().collect()
    least, room = 100_001, HEAD_WORDS
    for r in sorted(histogram, key=lambda r: -r.c):
        if r["count"] > room:
            break
        room -= r["count"]
        least = r.c
    head = {
        r.word.encode("utf-8", "surrogatepass"): (r.c, r.lattice)
        for r in solved.where(F.col("c") >= F.lit(max(least, 1))).limit(HEAD_WORDS).toLocalIterator(prefetchPartitions=True)
    }
    end_lattice = math.log10((n_train + 1.0) / (train_tokens + 2.0))
    stay = math.log10(max(1e-12, 1.0 - 10.0**end_lattice))
    table = {w: (math.log10(c + SMOOTH), x + stay) for w, (c, x) in head.items()}
    shared = spark.sparkContext.broadcast(table)
    del head

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document with what head words give, and one for each of its other words."""
        known = shared.value
        get = known.get
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows, ids, tokens, hits, base, marginal = [], [], [], [], [], []
                tail_rows, tail_words, tail_times = [], [], []
                part = batch.slice(at, 500)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found = _tokens(text)
                    n, b, m = 0, 0.0, 0.0
                    rest = []
                    for w, x in zip(found, map(get, found)):
                        if x is None:
                            rest.append(w)
                        else:
                            n += 1
                            b += x[0]
                            m += x[1]
                    for w, times in Counter(rest).items():
                        tail_rows.append(row)
                        tail_words.append(w)
                        tail_times.append(times)
                    rows.append(row)
                    ids.append(doc_id)
                    tokens.append(len(found) + 1)
                    hits.append(n)
                    base.append(b)
                    marginal.append(m)
                    row += 1
                none = len(tail_rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows + tail_rows, pa.int64()),
                        pa.array(ids + [None] * none, pa.int64()),
                        pa.array(tokens + [None] * none, pa.int64()),
                        pa.array(hits + [None] * none, pa.int64()),
                        pa.array(base + [None] * none, pa.float64()),
                        pa.array(marginal + [None] * none, pa.float64()),
                        pa.array([None] * len(rows) + tail_words, pa.binary()).cast(pa.string()),
                        pa.array([None] * len(rows) + tail_times, pa.int64()),
                    ],
                    names=["row", "doc_id", "n_tokens", "n_head", "base", "marginal", "word", "times"],
                )

    schema = "row bigint, doc_id bigint, n_tokens bigint, n_head bigint, base double, marginal double, word string, times bigint"
    parts = map_batches(docs.select("doc_id", "text"), split, schema)
    parts = parts.withColumn("kind", F.when(F.col("word").isNull(), "doc").otherwise("word"))
    parts = written(parts, "parts")
    tail = parts.where("kind = 'word'").select("row", "word", "times").join(solved, "word")
    per_row = tail.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("t_known"),
        F.sum(F.col("times") * F.log10(F.col("c") + F.lit(SMOOTH))).alias("t_base"),
        F.sum(F.col("times") * (F.col("lattice") + F.lit(stay))).alias("t_marginal"),
    )
    zero = lambda name: F.coalesce(name, F.lit(0))
    total = math.log10(train_tokens + SMOOTH * (distinct + 1))
    end_base = math.log10(n_train + SMOOTH)
    joined = parts.where("kind = 'doc'").select("row", "doc_id", "n_tokens", "n_head", "base", "marginal").join(per_row, "row", "left")
    return joined.select(
        "doc_id",
        "n_tokens",
        (F.col("n_head") + zero("t_known") + F.lit(1 if n_train else 0)).cast("bigint").alias("n_known"),
        F.lit(train_tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + zero("t_base") + F.lit(end_base) - F.col("n_tokens") * F.lit(total)).alias("base_score"),
        (F.col("marginal") + zero("t_marginal") + F.lit(end_lattice)).alias("score"),
    )


def op10_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    held = F.coalesce(crc_mod(F.col("doc_id"), 10) == 0, F.lit(False))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", (~held).alias("training"))
    scored = score_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
