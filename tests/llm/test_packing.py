import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from meshwork.llm.packing import BINS, WordEncoder, _patterns, nnls, op2_packing, pack_documents, pack_tails, pattern_windows, repeats

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def brute_ids(texts):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def check_pieces(rows, by_doc):
    seen = {}
    windows = {}
    for r in rows:
        ids = by_doc[r.doc_id]
        assert r.doc_tokens == len(ids)
        part = np.array(ids[r.start : r.start + r.length], dtype="<u4")
        assert len(part) == r.length > 0
        assert r.ids_crc32 == zlib.crc32(part.tobytes())
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen.keys() == by_doc.keys()
    for doc, pieces in seen.items():
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
        assert at == len(by_doc[doc])
    padding = 0
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    return padding


def test_words_encode_as_the_tokenizer_does():
    texts = ["It's a Test, isn't it?!", "İstanbul Σίγμας É é ﬁ", "a<|endoftext|>. b...c ''s", "\x1c x\xa0y z ...", "don't!! 12.5", "", " \n", "word " * 50]
    encoder = WordEncoder(VOCABULARY)
    for _ in range(2):
        assert [np.frombuffer(b, dtype="<u4").tolist() + [2] for b in encoder.encode_many(texts)] == brute_ids(texts)


def test_special_tokens_and_letters_that_lower_case_takes_apart():
    texts = ["<|ENDOFTEXT|>", "x<|STARTOFTEXT|>y", "x<|startoftext|>Y <|EndOfText|> <|endoftext|>", "ALİ.", "ALİ, VELİ!", "İ'", "İİ...", "\u0958.", "\u0958!\u0958", "A<|", "Ǆ.", "ẞ!"]
    encoder = WordEncoder(VOCABULARY)
    for _ in range(2):
        assert [np.frombuffer(b, dtype="<u4").tolist() + [2] for b in encoder.encode_many(texts)] == brute_ids(texts)


def test_random_strings_of_mixed_scripts():
    rng = np.random.default_rng(20)
    pieces = [*"aAzZİıßẞΣσςЖжéÉ漢字ﬁǄ09.,!?'<|>-_ \t\n\xa0", "\u0301", "\u0327", "\u0958", "\u093c", "\u0338", "<|endoftext|>", "<|EndOfText|>", "'s", "'LL", "ab", "Word ", "😀", "\u200d", "\u212b", "\u1e9b\u0323", "각", "\u1100\u1161"]
    texts = ["".join(rng.choice(pieces, rng.integers(1, 14))) for _ in range(20_000)]
    encoder = WordEncoder(VOCABULARY)
    got = encoder.encode_many(texts)
    wrong = [t for t, b, ids in zip(texts, got, brute_ids(texts)) if np.frombuffer(b, dtype="<u4").tolist() + [2] != ids]
    assert not wrong, (len(wrong), wrong[:10])


def test_words_survive_generations(monkeypatch):
    monkeypatch.setattr("meshwork.llm.packing.CACHE_WORDS", 20)
    rng = np.random.default_rng(1)
    encoder = WordEncoder(VOCABULARY)
    letters = list("aeioußéštn")
    for _ in range(20):
        texts = [" ".join("".join(rng.choice(letters, rng.integers(1, 9))) + rng.choice(["", ".", "--", "'s", "9", "##!"]) for _ in range(15)) for _ in range(3)]
        assert [np.frombuffer(b, dtype="<u4").tolist() + [2] for b in encoder.encode_many(texts)] == brute_ids(texts)


def test_patterns_take_what_bins_hold():
    rng = np.random.default_rng(2)
    for lengths in (rng.integers(1, 4096, 3000), rng.lognormal(6.3, 1.0, 3000).astype(int) % 4095 + 1, np.full(500, 700)):
        counts = np.bincount(lengths * BINS // 4096, minlength=BINS)
        times = repeats(counts)
        assert (_patterns() @ times <= counts).all() and times.min() >= 0
        windows, stream = pattern_windows(lengths)
        placed = sum(p[2] for w in windows for p in w)
        assert placed + sum(p[2] for p in stream) == lengths.sum()
        assert placed >= 0.9 * lengths.sum()


def test_tails_fill_windows():
    rng = np.random.default_rng(0)
    for n in (1, 2, 30, 2000):
        lengths = rng.integers(1, 4096, n)
        windows = pack_tails(lengths)
        assert sum(p[2] for w in windows for p in w) == lengths.sum()
        for w in windows:
            size = sum(p[2] for p in w)
            assert size == 4096 or size & (size - 1) == 0


def test_nnls_finds_exact_mix():
    a = np.array([[1.0, 0, 2], [0, 1, 1]])
    assert np.allclose(nnls(a, np.array([5.0, 3.0])) @ a.T, [5, 3], atol=1e-3)


def test_edges(spark):
    texts = {1: None, 2: "", 3: "abc " * 9000, 4: "one two", 5: "one two"}
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in texts.items()], "doc_id long, text string, start int, length string")
    rows = pack_documents(df.repartition(2), VOCABULARY).collect()
    assert check_pieces(rows, dict(zip(texts, brute_ids(texts.values())))) == 0
    assert pack_documents(df.where("false"), VOCABULARY).count() == 0


def test_query_against_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows = op2_packing(spark, "/root/testdata/sf0.001").collect()
    assert check_pieces(rows, dict(zip([d.doc_id for d in docs], brute_ids([d.text for d in docs])))) == 0
