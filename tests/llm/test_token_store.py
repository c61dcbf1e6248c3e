"""The token store: an exact round trip, the order of documents, damaged and odd inputs."""

import struct
import zlib

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from earlywarn.llm import token_store
from earlywarn.llm.byte_level import ByteLevelIds, column_ids
from earlywarn.llm.queries import QUERIES
from earlywarn.llm.token_store import StoreSpec, read_tokens, write_tokens

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_query_equals_encoding_one_by_one(spark, sf_dir, tokenizer):
    rows = {r.doc_id: r for r in QUERIES["op11_token_store"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    start = 0
    for d in docs:
        ids, r = ids_of(tokenizer, d.text), rows[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    assert len(rows) == len(docs)


ODD = ["a", "Bé", "'s", "'", " ", "  ", "\n", "\t", "7", "٣", "ª", "\xa0", " ", "!", "<|endoftext|>", "漢",
       "\x1c", "\x85", "\U0001f600", "'ll", "re", "²", "ß", "×", "\x00"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(ODD), max_size=14), st.booleans())
def test_pieces_give_the_ids_of_the_text(parts, plain):
    memory = MEMORIES[plain]
    text = "".join(parts)
    assert "".join(memory.pieces(text)) == text
    expected = memory.encode([text])[0]
    assert list(memory.texts([text.encode()])) == [expected]
    whole = memory.encode([text + " a", "b " + text])
    assert column_ids(pa.array([text, "", text + " a", "b " + text]), memory) == [expected, b"", *whole]


MEMORIES = [ByteLevelIds(VOCABULARY, plain_specials=p, limit=50) for p in (False, True)]

ROWS = [
    (5, "one two  three"), (None, "without an id"), (3, None), (3, ""), (3, "three again"), (-2, "é<|endoftext|> x"),
    (9, "long " * 30_000), (5, "one two  three"), (7, " \n\t"), (None, None),
]


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame([(i, t, "r", 1) for i, t in ROWS], "doc_id long, text string, range string, before int").repartition(3)


@pytest.mark.parametrize("spec", [StoreSpec(), StoreSpec(shard_bytes=1, sample_documents=1, dictionary_bytes=300)])
def test_messy_rows_come_back_whole(spark, messy, tokenizer, tmp_path, spec):
    path = str(tmp_path / "store")
    write_tokens(messy, path, spec)
    got = sorted(read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, -2, 3, 3, 3, 5, 5, 7, 9]
    start = 0
    for r in got:
        ids = list(struct.unpack(f"<{r.n_tokens}I", r.ids))
        assert r.start == start and r.ids_crc32 == crc(ids)
        start += len(ids)
    expected = sorted((-1e9 if i is None else i, ids_of(tokenizer, t)) for i, t in ROWS)
    back = [(-1e9 if r.doc_id is None else r.doc_id, list(struct.unpack(f"<{r.n_tokens}I", r.ids))) for r in got]
    assert sorted(back) == expected


def test_empty_table(spark, messy, tmp_path):
    path = str(tmp_path / "store")
    write_tokens(messy.limit(0), path)
    assert read_tokens(spark, path).collect() == []


def test_wanted_documents_only_read_their_shards(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = str(tmp_path / "store")
    write_tokens(docs, path, StoreSpec(shard_bytes=20_000))
    every = {r.doc_id: r for r in read_tokens(spark, path).collect()}
    some = sorted(every)[10:13]
    found = read_tokens(spark, path, wanted=[*some, -5])
    assert {r.doc_id: r for r in found.collect()} == {d: every[d] for d in some}
    assert "PushedFilters: [Or(" in found._jdf.queryExecution().toString()
    assert read_tokens(spark, path, wanted=[]).collect() == []


def test_short_documents_gain_from_the_dictionary(spark, sf_dir):
    import zstandard

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    content = token_store.fit_dictionary(docs, StoreSpec())
    memory = ByteLevelIds(VOCABULARY)
    short = [b for b in memory.texts([r.text.encode() for r in docs.collect() if r.text and len(r.text) < 2000])]
    plain = zstandard.ZstdCompressor(level=3)
    shared = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(content))
    assert sum(len(shared.compress(b)) for b in short) < 0.9 * sum(len(plain.compress(b)) for b in short)


def test_a_shard_of_another_dictionary_is_refused(spark, messy, tmp_path):
    path = str(tmp_path / "store")
    write_tokens(messy, path)
    shard = bytes(spark.read.parquet(f"{path}/shards").first().content)
    with pytest.raises(ValueError):
        token_store.open_shard(shard, b"another")
