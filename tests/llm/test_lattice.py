import math
import zlib
from collections import Counter

import pytest

from meshwork.llm import lattice

PIECES = ["<unk>", "<0x61>", "<0xC3>", "<0xA9>", "▁", "a", "b", "▁a", "ab", "▁ab", "bb"]


def all_paths(model, text):
    if not text:
        return 1.0
    total = 0.0
    for k in range(1, len(text) + 1):
        x = model.pieces.get(text[:k])
        if x is None and k == 1:
            x = sum(model.bytes[c] for c in text[0].encode())
        if x is not None:
            total += 10**x * all_paths(model, text[k:])
    return total


def test_forward_sum_equals_all_segmentations():
    model = lattice.Lattice(PIECES, [-float(i) for i in range(len(PIECES))], {5: 10, 8: 3})
    for word in ("a", "ab", "abba", "bbb", "aéb", "abababb"):
        assert model.word(word) == pytest.approx(math.log10(all_paths(model, "▁" + word)))
    assert math.isfinite(model.word("ab" * 20_000))


def brute_base(docs):
    train = Counter()
    for i, t in docs:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            train.update([*(t or "").encode().lower().split(), None])
    n, v = sum(train.values()), len(train)
    out = {}
    for i, t in docs:
        tokens = [*(t or "").encode().lower().split(), None]
        out[i] = (len(tokens), sum(train[w] > 0 for w in tokens), n, sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens))
    return out


@pytest.mark.parametrize("head", [200_000, 50])
def test_query_against_brute_force(spark, monkeypatch, head):
    monkeypatch.setattr(lattice, "HEAD_WORDS", head)
    monkeypatch.setattr(lattice, "TASK_WORDS", 3000)
    d = "/root/testdata/sf0.001"
    expected = brute_base([(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()])
    rows = lattice.op10_lattice(spark, d).collect()
    assert len(rows) == len(expected)
    for r in rows:
        tokens, known, n, base = expected[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)


def test_edges(spark):
    import public_tokenizers

    rows = [(1, None, True), (2, "", False), (3, "a b a", True), (3, "a b a", True), (4, "É " * 1000, None), (5, "x" * 50_000, False)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, training boolean, word int")
    found = lattice.score_documents(df, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert sorted(r.n_tokens for r in found) == [1, 1, 2, 4, 4, 1001]
    assert all(math.isfinite(r.score) for r in found)
    assert lattice.score_documents(df.where("false"), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


@pytest.mark.parametrize("head", [200_000, 30])
def test_scores_against_a_plain_sum(spark, monkeypatch, head):
    import public_tokenizers
    import sentencepiece

    monkeypatch.setattr(lattice, "HEAD_WORDS", head)
    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    docs = [(i, t, k) for i, (t, k) in enumerate([("The cat sat on the mat. The END", True), ("É cat é", True), (None, True), ("the unknown 新羅 word", False), ("", False), ("The cat sat on the mat. The END", True)] + [(f"word{j} the cat {j}", j % 3 > 0) for j in range(40)])]
    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    uses, tokens, ends = Counter(), 0, 0
    for _, text, training in docs:
        if training:
            ends += 1
            for word in (text or "").encode().lower().split():
                tokens += 1
                uses.update(model.encode(word.decode()))
    plain = lattice._lattice(vocabulary, uses)
    end = math.log10((ends + 1) / (tokens + ends + 2))
    found = {r.doc_id: r.score for r in lattice.score_documents(spark.createDataFrame(docs, "doc_id long, text string, training boolean").repartition(3), vocabulary).collect()}
    for i, text, _ in docs:
        words = (text or "").encode().lower().split()
        assert found[i] == pytest.approx(sum(plain.word(w.decode()) + math.log10(1 - 10**end) for w in words) + end, rel=1e-9)
