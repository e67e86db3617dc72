from collections import Counter, defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from meshwork.llm import mixing, pii, toxicity
from tests.llm.test_near_duplicates import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_stage_on_its_own_input(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    inputs = []
    for name, stage in corpus_pipeline.STAGES:
        out = f"{tmp_path}/{name}"
        stage(spark, docs, d).write.parquet(out)
        inputs.append((docs.collect(), spark.read.parquet(out)))
        docs = inputs[-1][1]
    for _, out in inputs[:-1]:
        assert out.columns == COLUMNS
    given = [{r.doc_id: r for r in i} for i, _ in inputs]
    made = [o.collect() for _, o in inputs]

    labels = toxicity.training_labels(spark.read.parquet(f"{d}/labels.parquet"))
    scores = {r.doc_id: r.predicted for r in toxicity.score_documents(spark.read.parquet(f"{d}/documents.parquet"), labels).collect()}
    assert sorted(r.doc_id for r in made[0]) == sorted(i for i in given[0] if not scores[i])

    expected = sorted({c for _, _, c in brute([(r.doc_id, r.text) for r in given[1].values()], 5, 80, 100)})
    assert sorted(r.doc_id for r in made[1]) == expected

    for r in made[2]:
        assert not any(pii.find_spans(r.text, pii._automaton()).values()) and r.n_chars == len(r.text)
    assert len(made[2]) == len(given[2])

    words, sizes, taken = {}, defaultdict(int), defaultdict(int)
    for r in given[3].values():
        words[r.doc_id] = len(r.text.encode().split())
        sizes["s" + r.source] += words[r.doc_id]
    for doc, times in Counter(r.doc_id for r in made[3]).items():
        assert times <= 3
        taken["s" + given[3][doc].source] += times * words[doc]
    targets = mixing.source_targets(sizes)
    assert sum(abs(taken[s] - t) for s, t in targets.items()) < 0.2 * sum(targets.values())

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc = {i: tokenizer.encode(r.text, add_special_tokens=False).ids + [2] for i, r in given[4].items()}
    copies = Counter(r.doc_id for r in inputs[4][0])
    single = {i for i, n in copies.items() if n == 1}
    rows = made[4]
    assert sum(r.length for r in rows) == sum(len(by_doc[i]) * n for i, n in copies.items())
    assert {r.doc_id for r in rows} == set(by_doc) and single


def test_edges(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "some words here again and more", "en", "a", 30), (3, "some words here again and more", "en", "a", 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    given = [(r.doc_id, r.text) for r in docs.collect()]
    for df, ids in ((docs, [1, 2, 3]), (docs.where("false"), [])):
        out = df
        for name, stage in corpus_pipeline.STAGES[:3]:
            out = stage(spark, out, "/root/testdata/sf0.001")
            assert out.columns == COLUMNS
        assert sorted(r.doc_id for r in out.collect()) == ids
        for r in out.collect():
            assert (r.doc_id, r.text) in given
        mixed = corpus_pipeline.mix(spark, out, "")
        assert {r.doc_id for r in mixed.collect()} <= {3}  # texts without words are never taken
        packed = corpus_pipeline.pack(spark, out, "").collect()
        assert sorted({r.doc_id for r in packed}) == ids
    assert corpus_pipeline.drop_near_duplicates(spark, docs, "").count() == 3


def test_extra_columns_with_clashing_names_come_through(spark):
    extra = ["score", "predicted", "mix_repeats", "mix_copy", "mix_size", "component_id", "n_rows", "pattern", "size", "row", "document", "class", "key", "spans"]
    text = "a few plain words that stand alone in text number"
    rows = [(i, f"{text} {i} {i * 7} {i * 11} {i * 13} mail a{i}@example.com", "en", "s", 50, *[f"{c}{i}" for c in extra]) for i in range(40)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra)
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        found = out.collect()
        assert found and all(r[c] == f"{c}{r.doc_id}" for r in found for c in extra), name
    assert {r.doc_id for r in corpus_pipeline.pack(spark, docs, "").collect()} == set(range(40))
