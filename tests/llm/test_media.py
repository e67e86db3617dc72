import pytest

import hashlib
import tarfile
import zlib

from meshwork.llm import media


def test_pictures_round_trip():
    for text in (None, "", "a", "é" * 288, "x" * 577, "z" * 300_000):
        payload, n = media.payload_of(text)
        data = media.encode_picture(payload)
        assert media.decode_picture(data) == payload and payload[:n] == (text or "").encode() and len(payload) % 576 == 0
        assert media.picture_header(data[:33]) == (576, len(payload) // 576, 8)


def test_query_against_texts_and_shards(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = media.op7_media(spark, d).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        payload, n = media.payload_of(docs[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


def test_shards_are_tar_files_and_equal_texts_share_an_address(spark, tmp_path):
    texts = ["one", None, "", "one", "two", "x" * 200_000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, digest int").repartition(2)
    folder = f"file://{tmp_path}/media"
    rows = {r.doc_id: r for r in media.media_columns(df, folder).collect()}
    assert len(rows) == 6
    same = lambda a, b: rows[a].asDict() | {"doc_id": 0} == rows[b].asDict() | {"doc_id": 0}
    assert same(0, 3) and same(1, 2) and not same(0, 4)
    for r in rows.values():
        with tarfile.open(tmp_path / "media" / r.shard) as tar:
            stored = tar.extractfile(f"{r.digest}.png").read()
        assert hashlib.sha256(stored).hexdigest() == r.media_sha256 and len(stored) == r.media_bytes == r.length
    index = media.addresses(media.store_payloads(df, folder + "2"))
    heads = media.header_columns(index, folder + "2").collect()
    assert {(r.width, r.bits) for r in heads} == {(576, 8)} and len(heads) == 4
    assert media.media_columns(df.where("false"), folder + "3").count() == 0


def test_metadata_comes_from_headers_and_disagreement_is_found(spark, tmp_path):
    texts = ["", None, "a" * 576, "b" * 577, "é" * 2000] + ["same"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    rows = media.media_columns(docs, f"file://{tmp_path}/m").collect()
    assert len(rows) == len(texts)
    for r in rows:
        data, _ = media.payload_of(texts[r.doc_id])
        assert (r.width, r.height, r.bits) == (576, len(data) // 576, 8) and r.feature == media.features(data, (576, len(data) // 576, 8))
    picture = media.encode_picture(b"x" * 576)
    digest = media.hashlib.sha256(b"x" * 576).digest()
    assert media._measure(picture, (digest, "s", 0, len(picture), 576, 1, 8))[0] == 576
    with pytest.raises(ValueError, match="header"):
        media._measure(picture, (digest, "s", 0, len(picture), 576, 2, 8))


def test_one_payload_of_very_many_rows(spark, tmp_path, monkeypatch):
    from meshwork.llm import common

    monkeypatch.setattr(common, "LEAST_HOT", 50)
    docs = spark.createDataFrame([(i, None if i % 3 == 0 else "" if i % 3 == 1 else f"t{i}") for i in range(600)], "doc_id long, text string").repartition(3)
    rows = media.media_columns(docs, f"file://{tmp_path}/m").collect()
    assert sorted(r.doc_id for r in rows) == list(range(600)) and len({r.digest for r in rows if r.doc_id % 3 < 2}) == 1
