import hashlib
import random
import re

import duckdb

from meshwork.llm import content_sort, oracles

SF = "/root/testdata/sf0.01"


def plain(rows):
    """Groups by dictionary: (id, keep_id, size, digest) of each row, and how many rows of a group stay."""
    groups = {}
    for i, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(i)
    out = []
    for body, ids in groups.items():
        known = [i for i in ids if i is not None]
        out += [(i, min(known) if known else None, len(ids), hashlib.sha256(body.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def check(df, rows):
    got = content_sort.mark_copies(df).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=repr) == plain(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in kept)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    names = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    theirs = sorted(con.execute(f"select {', '.join(names)} from ({oracles.COPIES})").fetchall())
    assert sorted(tuple(r[n] for n in names) for r in content_sort.op12_content_sort(spark, SF).collect()) == theirs


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "\t\n"), (5, "a b"), (6, "a\x0b \r\nb"), (7, "a\u00a0b"), (None, "a b"), (None, "z"), (None, "z"), (8, "A b")]
    rows += [(9, "x" * 3_000_000), (10, "x" * 3_000_000), (11, "x" * 2_999_999 + "y"), (5, "a b"), (0, " a b "), (12, "a  b\x1f")]
    random.Random(3).shuffle(rows)
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)
    assert content_sort.mark_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_third_of_all_rows_is_one_text(spark, monkeypatch):
    monkeypatch.setattr(content_sort, "SLOT_ROWS", 20)
    rows = [(i * 7 % 3001, "one  text" if i % 3 == 0 else f"text {i % 500}\n") for i in range(3000)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), rows)
    marks = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("xxhash64(text) as mark")
    assert max(r.slots for r in content_sort._slots(marks).collect()) == 50


def test_equal_marks_are_not_equal_texts(spark, monkeypatch):
    monkeypatch.setattr(content_sort, "SLOT_ROWS", 5)
    monkeypatch.setattr(content_sort.F, "xxhash64", lambda *c: content_sort.F.lit(7).cast("bigint"))
    rows = [(i, f"same beginning, whatever follows here {i % 9}") for i in range(200)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_rows_that_stay_keep_their_columns(spark):
    rows = [(2, "a b", "x", 1), (1, "a  b", "y", 2), (1, "a\tb", "y", 3), (3, "b", None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark string, group_size int")
    kept = content_sort.drop_copies(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]
