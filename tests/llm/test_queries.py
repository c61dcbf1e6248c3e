"""The registered corpus queries: against their SQL where there is one, else against brute force."""

import collections
import hashlib
import math
import re
import struct
import zlib

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from earlywarn.llm.licenses import find_labels_plainly
from earlywarn.llm.queries import ORACLES, QUERIES
from tools.check import kind, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in rows}


def run(spark, sf_dir, name):
    return {r.doc_id: r for r in QUERIES[name](spark, sf_dir).collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    df, cur = QUERIES[name](spark, sf_dir), con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert {d[0]: kind(str(d[1])) for d in cur.description} == {c: kind(t) for c, t in df.dtypes}
    assert rows_of(df.columns, df.collect()) == rows_of(names, cur.fetchall())


def test_thirteen_operators_are_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


def test_line_quality_on_held_out_documents(spark, sf_dir, docs):
    rows = run(spark, sf_dir, "op1_line_quality")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert rows.keys() == docs.keys()
    for d, r in rows.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [(labels[d], r.predicted) for d, r in rows.items() if r.held_out and d in labels]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)


def test_passages_find_every_long_exact_repeat(spark, sf_dir, docs):
    rows = run(spark, sf_dir, "op2_passages")
    assert rows.keys() == docs.keys()
    where = collections.defaultdict(set)
    for d, text in docs.items():
        words = WORD.findall(text)
        for i in range(len(words) - 50):
            where[tuple(words[i : i + 51])].add(d)
    for ids in where.values():
        if len(ids) > 1:
            assert len({rows[d].component_id for d in ids}) == 1
            assert all(rows[d].n_passages and rows[d].n_links for d in ids)
            assert all(rows[d].removed for d in ids - {min(ids)})
    alone = [r for r in rows.values() if not r.n_passages]
    assert all(r.component_id == r.doc_id and r.removed == "" for r in alone if not r.n_links)


def test_language_model_counts_and_beats_the_base(spark, sf_dir, docs):
    rows = run(spark, sf_dir, "op4_language_model")
    tokens = {d: WORD.findall(t.translate(LOWER)) + [None] for d, t in docs.items()}
    held = {d for d in docs if zlib.crc32(str(d).encode()) % 7 == 2}
    counts = collections.Counter(w for d, t in tokens.items() if d not in held for w in t)
    space = sum(counts.values()) + len(counts) + 1
    for d, r in rows.items():
        base = sum(math.log10((counts[w] + 1) / space) for w in tokens[d])
        known = sum(counts[w] > 0 for w in tokens[d])
        assert (r.held_out, r.n_tokens, r.n_known) == (d in held, len(tokens[d]), known)
        assert r.train_tokens == sum(counts.values())
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert r.score < 0
    assert sum(r.score for r in rows.values()) > sum(r.base_score for r in rows.values())


def test_quality_rules_base(spark, sf_dir, docs):
    rows = run(spark, sf_dir, "op7_quality_rules")
    for d, text in docs.items():
        words, r = WORD.findall(text), rows[d]
        windows = collections.defaultdict(list)
        for i in range(len(words) - 4):
            windows[tuple(words[i : i + 5])].append(i)
        repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
        lines = [line for line in text.split("\n") if WORD.search(line)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(repeated),
        )
        assert r.base_failed == (len(words) < 10 or 100 * len(repeated) > 20 * len(words))
        assert not (r.kept and r.base_failed)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    judged = [(labels[d], rows[d].kept) for d in docs if d in labels and not rows[d].base_failed]
    assert sum(bool(a) == b for a, b in judged) >= 0.95 * len(judged)


def test_packing_cuts_every_id_once(spark, sf_dir, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = QUERIES["op8_packing"](spark, sf_dir).collect()
    of, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        of[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    assert of.keys() == docs.keys()
    for d, text in docs.items():
        ids, at = tokenizer.encode(text, add_special_tokens=False).ids + [2], 0
        for p in sorted(of[d], key=lambda p: p.start):
            part = ids[p.start : p.start + p.length]
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += p.length
        assert at == len(ids)
    for members in sequences.values():
        at = 0
        for p in sorted(members, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        # A sequence below the longest context is full, and has a power of two of tokens: no padding.
        (context,) = {p.context for p in members}
        assert context in (512, 1024, 2048, 4096) and (at <= context if context == 4096 else at == context)
    total = sum(p.length for p in pieces)
    assert sum(members[0].context for members in sequences.values()) < 1.05 * total + 4096


def test_licenses_equal_a_plain_scan(spark, sf_dir, docs):
    rows = run(spark, sf_dir, "op9_licenses")
    for d, text in docs.items():
        n, base, labels = find_labels_plainly(text)
        places = [at for at, _ in base]
        r = rows[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (
            n, len(base), places[0] if places else None, places[-1] if places else None
        )
        assert r.base_labels == ",".join(sorted({label for _, label in base}))
        assert r.labels == ",".join(sorted(labels)) and 0 <= r.score <= 1


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(t - 9 if t > 9 else t for t in twice) % 10 == 0


def base_of(text):
    out = []
    for name, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True, "ip": name != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15,
            }[name]
            if good:
                out.append(f"{name}:{m.start()}:{m.end()}")
    return out


def test_personal_data_equals_the_patterns(spark, sf_dir, docs):
    rows = run(spark, sf_dir, "op10_personal")
    for d, text in docs.items():
        spans, r = base_of(text), rows[d]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("term")] == spans
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(
            sum(s.startswith(f"{k}:") for s in spans) for k in PATTERNS
        )
