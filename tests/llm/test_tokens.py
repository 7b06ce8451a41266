import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from typeflow.llm import bpe, token_files, tokens

WHOLE = Tokenizer.from_file(tokens.default_path())
with open(tokens.default_path(), encoding="utf-8") as f:
    ENCODER = tokens.WordEncoder(f.read())


def ids_of(text):
    return np.array(WHOLE.encode(text or "", add_special_tokens=False).ids, dtype="<u4")


pieces = st.one_of(st.text(max_size=5), st.sampled_from(["<|endoftext|>", "<|ENDOFTEXT|>", "'s", "İ", "ΑΣ ", "\x1c", "\x85", "é", "word.", "ab,"]))


@settings(max_examples=300, deadline=None)
@given(st.lists(pieces, max_size=8).map("".join))
def test_words_give_the_librarys_ids(text):
    assert tokens.WordIds(ENCODER, limit=50).texts([text]) == [ids_of(text).tobytes()]


def test_every_low_code_point_is_split_as_the_library_does():
    texts = [f"ab{chr(c)}Cd{chr(c)} {chr(c)}" for c in range(0x3000)]
    assert tokens.WordIds(ENCODER).texts(texts) == [ids_of(t).tobytes() for t in texts]
    assert tokens.WordIds(ENCODER).texts(["", " \t", "<|endoftext|>"])[:2] == [b"", b""]


def brute(rows):
    return sorted((str(i), len(x := ids_of(t)), hashlib.sha256(x.tobytes()).hexdigest(), hashlib.sha256(WHOLE.decode(x.tolist(), skip_special_tokens=False).encode()).hexdigest()) for i, t in rows)


def test_bpe(spark, docs, empty, monkeypatch):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    table = docs.checkpoint()
    assert sorted((str(r.doc_id), *r[1:]) for r in bpe.digests(table).collect()) == brute(rows)
    monkeypatch.setattr(bpe, "CHUNK_WORDS", 5)  # many chunks
    assert sorted((str(r.doc_id), *r[1:]) for r in bpe.digests(table).collect()) == brute(rows)
    assert bpe.digests(empty).collect() == []


def test_parts_grow_with_the_input():
    assert [bpe.parts_for(n) for n in (0, 1, 128, 129, 1000, 10**6)] == [512, 512, 512, 1024, 4096, 1 << 14]


def test_many_parts_and_forgotten_words(spark, docs, monkeypatch):
    monkeypatch.setattr(bpe, "LEAST_PARTS", 4096)
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 3)
    table = docs.checkpoint()
    assert sorted((str(r.doc_id), *r[1:]) for r in bpe.digests(table).collect()) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_chunks_of_different_readings_are_never_mixed(spark, monkeypatch):
    """The second reading has other words, as many as the first and of the same parts."""
    monkeypatch.setattr(bpe, "LEAST_PARTS", 1)
    monkeypatch.setattr(bpe, "parts_for", lambda splits: 1)
    docs = spark.createDataFrame([(1, "one two three")], "doc_id long, text string").coalesce(1).checkpoint()
    other = spark.createDataFrame([(1, "one two four")], "doc_id long, text string").coalesce(1).checkpoint()
    words = bpe._words
    monkeypatch.setattr(bpe, "_words", lambda docs, spec, parts: words(other, spec, parts))
    with pytest.raises(Exception, match="changed between two readings"):
        bpe.digests(docs).collect()


def test_bpe_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted((str(r.doc_id), *r[1:]) for r in bpe.op1_bpe(spark, sf_dir).collect()) == brute(rows)


def test_planes():
    for n in (0, 1, 65_535, 65_536, 200_000):
        ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
        assert (token_files.unpack(token_files.pack(ids)) == ids).all()


def test_token_files(spark, docs, empty, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "CHUNK_IDS", 300)
    token_files.write(docs, str(tmp_path / "a"), shards=3)
    got = token_files.read(spark, str(tmp_path / "a")).orderBy("start").collect()
    want = [np.append(ids_of(r.text), 1).astype("<u4") for r in docs.collect()]
    assert sorted(bytes(r.ids) for r in got) == sorted(x.tobytes() for x in want)
    at = 0
    for r in got:
        assert r.start == at
        at += len(r.ids) // 4
    known = [r.doc_id for r in got if r.doc_id is not None]
    assert [r.doc_id for r in got[:2]] == [None, None] and known == sorted(known)
    index = spark.read.parquet(str(tmp_path / "a" / "index")).orderBy("first_id").collect()
    assert len(index) > 3 and [r.first_id for r in index] == [0, *np.cumsum([r.n_ids for r in index]).tolist()[:-1]]
    token_files.write(empty, str(tmp_path / "b"))
    assert token_files.read(spark, str(tmp_path / "b")).collect() == []
    assert token_files.read_documents(spark, str(tmp_path / "b"), [1]).collect() == []


def test_documents_are_read_from_their_chunks_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "CHUNK_IDS", 40)
    path = str(tmp_path / "files")
    rows = [(i, f"word{i} " * 10) for i in range(200)] + [(None, "no id"), (None, None), (7, "another seven")]
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, shards=4)
    whole = {(r.doc_id, r.start): bytes(r.ids) for r in token_files.read(spark, path).collect()}
    chunks = spark.read.parquet(f"{path}/chunks").count()
    assert chunks > 20
    for wanted in ([7, 150], [None], [None, 3], [10_000], []):
        got = {(r.doc_id, r.start): bytes(r.ids) for r in token_files.read_documents(spark, path, wanted).collect()}
        assert got == {k: v for k, v in whole.items() if k[0] in wanted}
        assert token_files.wanted_chunks(spark, path, wanted).count() <= 2 * len(wanted) < chunks


def test_rows_of_one_doc_id_are_in_hash_order_over_all_shards(spark, tmp_path):
    rows = [(5, f"text {i % 150} x") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    token_files.write(df, str(tmp_path / "ties"), shards=4)
    hashes = {ids_of(r.text).tobytes() + b"\1\0\0\0": r.h for r in df.selectExpr("text", "xxhash64(text) AS h").collect()}
    found = token_files.read(spark, str(tmp_path / "ties")).orderBy("start").collect()
    order = [hashes[bytes(r.ids)] for r in found]
    assert len(order) == 200 and order == sorted(order)
    assert spark.read.parquet(str(tmp_path / "ties" / "chunks")).select("shard").distinct().count() > 1


def test_token_files_query(spark, sf_dir):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    at, want = 0, []
    for i, t in rows:
        ids = np.append(ids_of(t), 1).astype("<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, token_files.op3_token_files(spark, sf_dir).collect())) == want
