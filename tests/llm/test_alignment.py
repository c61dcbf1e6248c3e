"""Alignment against a brute-force reading of the definition."""

import collections
import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from earlywarn.llm.alignment import AlignSpec, ChunkMemory, align_tokens, chunks_of, group_labels
from earlywarn.llm.queries import QUERIES

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_map():
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


BYTES = byte_map()


def bytes_b(i):
    return bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()


def groups_of(text):
    """Pairs of id lists, or None for a text without tokens."""
    if not text:
        return None
    encoded = A.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(BYTES[c] for c in t)) for i, t in zip(encoded.ids, encoded.tokens)]
    b = [(i, bytes_b(i)) for i in B.encode(text)]
    whole = (" " + text).encode()
    if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
        return None
    ends = []
    for tokens in (a, b):
        at, own = 0, []
        for _, x in tokens:
            at += len(x)
            own.append(at)
        ends.append(own)
    groups = [([], []) for _ in set(ends[0]) & set(ends[1])]
    cuts = sorted(set(ends[0]) & set(ends[1]))
    for side, tokens in enumerate((a, b)):
        k = 0
        for (i, _), end in zip(tokens, ends[side]):
            groups[k][side].append(i)
            k += end == cuts[k]
    return groups


def brute(texts):
    """A tuple for each text: n_a, n_b, n_groups, n_links, n_best, count_sum, digest."""
    found = [groups_of(t) for t in texts]
    docs, links = collections.Counter(), []
    for groups in found:
        own = collections.Counter((x, y) for a, b in groups or [] for x in a for y in b)
        links.append(own)
        docs.update(own.keys())
    most = collections.Counter()
    for (x, _), n in docs.items():
        most[x] = max(most[x], n)
    out = []
    for groups, own in zip(found, links):
        shown = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups or [])
        out.append((
            sum(len(a) for a, _ in groups or []), sum(len(b) for _, b in groups or []), len(groups or []), sum(own.values()),
            sum(m for p, m in own.items() if docs[p] == most[p[0]]), sum(m * docs[p] for p, m in own.items()),
            hashlib.sha256(shown.encode()).hexdigest() if groups else "",
        ))
    return out


def values(r):
    return (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = {r.doc_id: values(r) for r in QUERIES["op13_alignment"](spark, sf_dir).collect()}
    assert rows == dict(zip([d.doc_id for d in docs], brute([d.text for d in docs])))


ROWS = [
    (1, "one two three"), (2, None), (3, ""), (4, " "), (None, "one two three"), (5, "  two  spaces\n and tabs\t x "),
    (5, "one two three"), (6, "漢字 <|endoftext|> <s> <0x41> \U0001f600"), (7, "lost ▁ mark"), (8, "word " * 20_000), (9, "ab" * 3_000),
    (None, None), (10, "’quoted”   naïve ́"), (11, "x\x00y"), (12, "a  b   c ▁"),
]


@pytest.mark.parametrize("hot", [0, 3, 1 << 18])
def test_messy_rows_equal_brute_force_whatever_is_sent_to_tasks(spark, hot):
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in ROWS], "doc_id long, text string, row int, key string").repartition(3)
    got = align_tokens(df, AlignSpec(hot_pairs=hot)).collect()
    expected = brute([t for _, t in ROWS])
    assert sorted(map(str, ((r.doc_id, values(r)) for r in got))) == sorted(str((i, v)) for (i, _), v in zip(ROWS, expected))
    assert any(v[0] == 0 for v in expected) and align_tokens(df.limit(0)).collect() == []


MEMORY = ChunkMemory(AlignSpec(cache_chunks=60))
PARTS = ["a", "the", " ", "  ", "\n", "\t", "é", "1987", "'s", ".", "漢", "▁", "\U0001f600", " ", "’", "<s>", "<|endoftext|>", "\x00", "́", "=="]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12))
def test_chunks_align_like_their_text(parts):
    text = "".join(parts)
    assert b" ".join(chunks_of(text.encode())) == text.encode()
    counts, digest, keys, times = next(MEMORY.align([text.encode()]))
    n_a, n_b, n_groups, n_links, _, _, expected = brute([text])[0]
    assert (counts.tolist(), digest) == ([n_a, n_b, n_groups, n_links], expected)
    assert int(times.sum()) == n_links and len(set(keys.tolist())) == len(keys)


def test_pointers_double_instead_of_walking():
    n = 5_000
    ends_a, ends_b = np.arange(2, 2 * n + 1, 2), np.array([*range(1, 2 * n, 2), 2 * n])  # they only meet at the end
    in_a, in_b, rounds = group_labels(ends_a, ends_b)
    assert not in_a.any() and not in_b.any() and rounds <= 15
    in_a, in_b, _ = group_labels(np.array([1, 3, 4, 9]), np.array([2, 3, 4, 5, 9]))
    assert in_a.tolist() == [0, 0, 1, 2] and in_b.tolist() == [0, 0, 1, 2, 2]
