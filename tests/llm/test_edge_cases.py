"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import random
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from earlywarn.llm import common, exact_dedup, hashing, language_model, licenses, line_quality, mixing, ngram_join, packing, passages, personal, rules
from earlywarn.llm.components import components
from earlywarn.llm.ngram_join import JoinSpec, keep_one_per_group, similar_groups
from test_queries import base_of

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, row long, key string, size long, "
    "start long, band long, label string, n_words long, positions string"
)
WORDS = [f"w{i:05d}" for i in range(40_000)]


def prose(seed, n):
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) for _ in range(n))


SHARED = prose(7, 60)
ROWS = [
    (1, prose(1, 200), "a"), (2, None, "a"), (3, "", "b"), (4, " \t\n", None), (None, prose(1, 200), None),
    (5, prose(5, 120_000), "b"), (6, prose(1, 200) + "  ", "c"), (6, prose(1, 200) + "  ", "c"),
    (8, "one two", "c"), (9, "two words here \U0001f600", "a"), (10, prose(10, 80) + " " + SHARED, "a"),
    (11, prose(11, 50) + "\n" + SHARED + " " + prose(12, 30), "b"),
    (12, "mail a@b.co +1 (555) 123-4567 4111 1111 1111 1111 1.2.3.4 Released under the MIT License.", "b"),
]


@pytest.fixture(scope="module")
def messy(spark):
    rows = [(i, t, None, s, None, 1, "k", 2, 3, 4, "l", 5, "p") for i, t, s in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, None), (None, 1, 1), (5, None, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "exact": exact_dedup.exact_groups,
    "mixing": mixing.mix_plan,
    "licenses": licenses.scan_licenses,
    "personal": personal.find_personal,
    "packing": packing.pack_documents,
    "join": similar_groups,
    "passages": passages.repeated_passages,
    "model": lambda df: language_model.score_texts(df, F.lit(True)),
    "lines": lambda df: line_quality.score_quality(df, line_quality.LineModel.blank(), with_lines=True),
    "rules": lambda df: rules.judge(df, []),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_messy_rows_all_get_a_row(messy, name):
    got = sorted(str(r.doc_id) for r in OPERATORS[name](messy).select("doc_id").distinct().collect())
    assert got == sorted({str(i) for i, _, _ in ROWS})
    if name != "packing":
        assert OPERATORS[name](messy).count() == len(ROWS)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables(nothing, name):
    assert OPERATORS[name](nothing).collect() == []


def test_models_without_labels(nothing, messy, labels):
    none = labels.limit(0)
    assert rules.fit_rules(messy, none) == [] and rules.fit_rules(nothing, labels) == []
    assert line_quality.fit_lines(nothing, labels).weights.any() == np.False_
    scores = line_quality.score_quality(messy, line_quality.fit_lines(messy, labels)).collect()
    assert len(scores) == len(ROWS) and all(0 <= r.score <= 1 for r in scores)


@pytest.mark.parametrize("step", range(len(corpus_pipeline.STAGES)))
def test_stages_on_messy_and_empty_tables(spark, messy, nothing, labels, tmp_path, step):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    name, stage = corpus_pipeline.STAGES[step]
    for df in (messy, nothing):
        out = stage(spark, df, str(tmp_path))
        if name != "packing":
            assert out.columns == df.columns and out.dtypes == df.dtypes
        out.write.format("noop").mode("overwrite").save()


def test_exact_keeps_longest_then_smallest(messy):
    rows = exact_dedup.exact_groups(messy).where("group_size > 1").collect()
    copies = [r for r in rows if r.group_size == 4]
    assert {r.keep_id for r in copies} == {6} and sum(r.kept for r in copies) == 1
    blank = [r for r in rows if r.group_size == 3]
    assert {r.doc_id for r in blank} == {2, 3, 4} and {r.keep_id for r in blank} == {4}
    kept = exact_dedup.drop_exact(messy)
    assert kept.columns == messy.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [4, 5, 6, 8, 9, 10, 11, 12]


def test_exact_survives_hash_collisions(messy):
    weak = exact_dedup.exact_groups(messy, content_hash=lambda t: F.substring(F.md5(t), 1, 1).cast("binary"))
    key = lambda r: (str(r.doc_id), r.keep_id, r.group_size, r.text_sha256)
    assert sorted(map(key, weak.collect())) == sorted(map(key, exact_dedup.exact_groups(messy).collect()))


def test_mix_meets_targets_and_repeats_agree(spark):
    rows = [(i, prose(i, 20 + i % 70), ["x", "y", None][min(i % 5, 2)]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.mix_plan(docs).collect()
    again = mixing.mix_plan(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken, r.positions) for r in plan) == sorted((r.doc_id, r.taken, r.positions) for r in again)
    for source in ("x", "y", None):
        own = [r for r in plan if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.5
        assert own[0].target <= 3 * own[0].source_size and all(r.taken <= 3 * r.size for r in own)
    assert abs(sum({r.source: r.target for r in plan}.values()) - sum(r.size for r in plan)) < 1e-6
    mixed = mixing.mixed_documents(docs).collect()
    assert sum(len(r.text.split()) for r in mixed) == sum(r.taken for r in plan)
    texts = {i: t for i, t, _ in rows}
    assert all(texts[r.doc_id].startswith(r.text) for r in mixed)


def test_packing_follows_the_order_of_the_mix(spark, tmp_path):
    rows = [(i, prose(i, 30 + i % 900), ["x", "y"][i % 4 == 0]) for i in range(300)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, source string")
    mixed = mixing.mixed_documents(docs)
    mixed.write.parquet(str(tmp_path / "mixed"))
    order = [(r.doc_id, r.text) for r in mixed.collect()]
    reread = spark.read.parquet(str(tmp_path / "mixed"))
    spec = packing.PackSpec(group_pieces=64, step_sequences=2)
    pieces = packing.pack_documents(reread, spec, with_ids=True, in_order=True).orderBy("place").collect()
    assert [p.place for p in pieces] == list(range(len(pieces)))
    assert [p.doc_id for p in pieces if p.start == 0] == [d for d, _ in order]
    # Steps of later pieces never come before those of an earlier range, and ids of a copy come out whole.
    for a, b in zip(pieces, pieces[64:]):
        assert a.step < b.step and a.sequence_id < b.sequence_id
    copies = {}
    for p in pieces:
        copies.setdefault(p.copy, []).append(p)
    ids = [b"".join(p.ids for p in copies[c]) for c in sorted(copies)]
    texts = spark.createDataFrame([(t,) for _, t in order], "text string").coalesce(1).toArrow()["text"]
    assert ids == [b for chunk in texts.chunks for b in packing.token_blobs(chunk, spec)]


def test_packing_follows_the_order_inside_a_group(spark, tmp_path):
    rows = [(i, prose(i, 30 + 7 * i % 900)) for i in range(400)]
    spec = packing.PackSpec(step_sequences=2, order_pieces=16)
    steps = []
    for name, some in (("forth", rows), ("back", rows[::-1])):
        spark.createDataFrame(some, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / name))
        reread = spark.read.parquet(str(tmp_path / name))
        pieces = packing.pack_documents(reread, spec, in_order=True).orderBy("place").collect()
        # All are in one group, and still sequences and steps follow the rows.
        assert {p.sequence_id >> 24 for p in pieces} == {0}
        assert all(a.sequence_id < b.sequence_id for a, b in zip(pieces, pieces[32:]))
        assert all(a.step < b.step for a, b in zip(pieces, pieces[96:]))
        steps.append({p.doc_id: p.step for p in pieces})
        sequences = {}
        for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
            at = sequences.get(p.sequence_id, 0)
            assert p.offset == at and at + p.length <= p.context
            sequences[p.sequence_id] = at + p.length
        for k in range(max(p.step for p in pieces) + 1):
            assert 1 <= len({p.sequence_id for p in pieces if p.step == k}) <= 2
    assert steps[0][0] < steps[0][399] and steps[1][0] > steps[1][399]


def test_one_row_of_each_group_stays_whatever_its_id(spark, tmp_path):
    near, other, third = prose(1, 80), prose(2, 80), prose(3, 80)
    rows = [(1, near), (2, near + " tail"), (2, other), (None, third), (None, third + " end"), (7, ""), (7, None), (8, near)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(1, near), (2, other), (7, ""), (7, None)]
    docs.write.parquet(str(tmp_path / "docs"))
    for df, straight in ((docs, False), (spark.read.parquet(str(tmp_path / "docs")), True)):
        kept = keep_one_per_group(df, JoinSpec(words=5, percent=80), from_files=straight).collect()
        named = [(r.doc_id, r.text) for r in kept if r.doc_id is not None]
        unnamed = [r.text for r in kept if r.doc_id is None]
        assert sorted(named, key=str) == sorted(want, key=str)
        assert len(unnamed) == 1 and unnamed[0].startswith(third)


def test_no_pair_is_compared_twice(spark):
    base = prose(5, 60).split()
    texts = []
    for i in range(80):
        words = list(base)
        for k in range(i % 5):
            words[(7 * i + 11 * k) % 60] = f"x{i}y{k}"
        texts.append((i, " ".join(words)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    join = ngram_join._Join(docs, JoinSpec(), "doc_id", "text")
    ngram_join._groups(join)
    pairs = join.compared
    assert pairs.count() == pairs.distinct().count() > 0
    want = brute_groups(dict(texts), 3, 90)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_groups(docs).collect()}
    assert got == want


@given(st.sets(st.integers(0, 60)), st.sets(st.integers(0, 60)), st.integers(0, 40), st.integers(0, 6))
def test_suffix_filter_never_says_too_much(a, b, most, depth):
    x, y = (np.array(sorted(s), "uint64") for s in (a, b))
    assert ngram_join.apart_at_least(x, y, most, depth) <= len(a ^ b)
    if a and b:
        assert ngram_join.linked(x, y, 80, depth) == (100 * len(a & b) >= 80 * len(a | b))


def test_suffix_filter_parts_sets_that_share_a_few():
    x, y = np.arange(0, 200, 2, dtype="uint64"), np.arange(1, 201, 2, dtype="uint64")
    assert ngram_join.apart_at_least(x, y, 20, 6) > 20
    assert ngram_join.apart_at_least(x, x, 20, 6) == 0


def test_schedule_is_met_at_every_time(spark):
    share = [i / 50 for i in range(51)]
    df = spark.createDataFrame([(s, a) for s in share for a in (-1.0, -0.5, 0.0, 0.5, 1.0)], "share double, slope double")
    for r in df.select("share", "slope", mixing.position(F.col("share"), F.col("slope")).alias("t")).collect():
        assert abs((1 - r.slope) * r.t + r.slope * r.t**2 - r.share) < 1e-9


def brute_groups(texts, words, percent):
    sets = {}
    for d, t in texts.items():
        w = t.lower().split()
        sets[d] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_sets_are_paired_at_their_first_shared_shingle_only(spark):
    base = prose(5, 100).split()
    texts = [(i, " ".join([*base[:90], *prose(200 + i, 10).split()])) for i in range(12)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    spec = JoinSpec(percent=70)
    join = ngram_join._Join(docs, spec, "doc_id", "text")
    entries = join.named(None)
    assert entries.groupBy("token").count().count() > 5
    met = join.met_once(entries).select(F.col("x.sig").alias("a"), F.col("y.sig").alias("b"))
    assert met.count() == met.distinct().count() == 66


def test_near_copies_that_cannot_link_are_hardly_paired(spark):
    rng, base = np.random.RandomState(7), prose(5, 150).split()
    texts = []
    for i in range(120):
        words = list(base)
        for k in rng.choice(150, 2 + i % 7, replace=False):
            words[k] = f"x{i}y{k}"
        texts.append((i, " ".join(words)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(146)} for _, t in texts]
    links = sum(5 * len(a & b) >= 4 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    spec = JoinSpec(words=5, percent=80)
    join = ngram_join._Join(docs, spec, "doc_id", "text")
    assert links <= join.met_once(join.named(None)).count() <= 2 * links  # more than 6 times by cells alone
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_groups(docs, spec).collect()}
    assert got == brute_groups(dict(texts), 5, 80)


@given(st.sets(st.integers(0, 1 << 40), max_size=80), st.sets(st.integers(0, 1 << 40), max_size=80))
def test_parities_never_say_too_much(a, b):
    x, y = (np.array(sorted(hashing.mix(np.array(list(s), "uint64"))), "uint64") for s in (a, b))
    p, q = (ngram_join._parities(s, JoinSpec()) for s in (x, y))
    assert sum(bin(int(v) & (1 << 64) - 1).count("1") for v in p ^ q) <= len(a ^ b)


@given(st.lists(st.text(st.sampled_from("abA \t\n\v\f\r\x1c\x85\u00e9\u3000"), max_size=30), max_size=8), st.sampled_from([1, 2, 3, 5]))
def test_word_sequences_are_hashed_as_sets(texts, size):
    for at_once in (4, 1 << 15):
        found = list(hashing.SequenceHashes(at_once).shingles([t.encode() for t in texts], size))
        assert len(found) == len(texts)
        for text, hashes in zip(texts, found):
            words = text.encode().lower().split()
            runs = {tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, min(len(words), 1)))}
            assert len(hashes) == len(runs) and (hashes[1:] > hashes[:-1]).all()
        assert len({h.tobytes() for h in found}) == len(
            {frozenset(tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, min(len(w), 1)))) for w in (t.encode().lower().split() for t in texts)}
        )


def test_words_hashed_together_have_the_hashes_of_each():
    pick = random.Random(2)
    words = [bytes(pick.choice(b"abz\xc3\xff") for _ in range(pick.choice([1, 2, 9]))) for _ in range(500)]
    each = [language_model.word_hash(w, 32) for w in words]
    assert language_model.word_hashes(words, 32).tolist() == each
    known = np.array(sorted(set(each))[::2])
    seen = language_model.Vocabulary(known, np.ones(len(known)), known[:0], np.ones(32), 1, 1)
    coder = language_model.Coder(seen, language_model.ModelSpec(heads=1), limit=7)
    places = {h: i for i, h in enumerate(known.tolist())}
    for at in range(0, 500, 11):
        some = words[at : at + 11]
        assert coder.codes(iter(some), len(some)).tolist() == [places.get(h, h) for h in each[at : at + 11]]


def test_batches_of_long_texts_are_small(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.range(3_000, numPartitions=1).select(F.repeat(F.lit("word "), 1_000).alias("text"))
    rows = "n long"

    def sizes(batches):
        import pyarrow as pa
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    with common.small_batches(spark, "1m"):
        assert max(r.n for r in docs.mapInArrow(sizes, rows).collect()) < 400
    assert spark.conf.get(key) == before


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80), (1, 50)])
def test_join_equals_all_pairs(spark, words, percent):
    pick = random.Random(3)
    texts = {}
    for family in range(12):
        base = prose(100 + family, pick.choice([4, 12, 40, 150])).split()
        for k in range(pick.choice([1, 2, 12])):
            w = list(base)
            for _ in range(pick.randrange(0, 1 + len(w) // 12)):
                w[pick.randrange(len(w))] = pick.choice(WORDS)
            texts[len(texts)] = " ".join(w)
    texts[len(texts)] = "A"
    texts[len(texts)] = "a"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    spec = JoinSpec(words=words, percent=percent, buckets=1 << 10)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_groups(docs, spec).collect()}
    assert got == brute_groups(texts, words, percent)
    kept = sorted(r.doc_id for r in keep_one_per_group(docs, spec).collect())
    assert kept == sorted({c for _, c in got.values()})
    by_shuffle = JoinSpec(words=words, percent=percent, buckets=1 << 10, broadcast_ids=0)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in similar_groups(docs, by_shuffle).collect()} == got


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


def test_passage_spans_are_exact(messy):
    rows = {r.doc_id: r for r in passages.repeated_passages(messy).collect()}
    assert rows[10].component_id == rows[11].component_id == 10
    assert (rows[10].removed, rows[11].removed) == ("", "50:110")
    assert rows[6].component_id == 1 and rows[6].removed == "0:200"
    assert rows[5].n_passages == rows[12].n_passages == 0


def test_near_passages_are_found(spark):
    pick, rows, near = random.Random(5), [], 0
    while near < 60:
        passage = [pick.choice(WORDS) for _ in range(60)]
        edited = [w if pick.random() > 0.02 else "edit" for w in passage]
        if passages._jaccard(np.array(passage), np.array(edited), 5) < 0.8:
            continue
        before, after = prose(2 * near, 50), prose(500 + near, 50)
        rows += [(2 * near, before + " " + " ".join(passage)), (2 * near + 1, " ".join(edited) + " " + after)]
        near += 1
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    got = [(r.doc_id, r.component_id) for r in got.where("component_id <> doc_id").collect()]
    assert all(d == c + 1 for d, c in got) and len(got) >= 0.9 * near


def test_frequent_run_in_many_surroundings(spark):
    pick = random.Random(9)
    word = lambda: "".join(pick.choices("abcdefghijklmnop", k=6))
    some = lambda n: " ".join(word() for _ in range(n))
    loose = passages.PassageSpec(paragraph=8)
    run = min((some(8) for _ in range(20_000)), key=lambda r: passages._anchors(
        r.encode().split(), loose, passages.WordHashes())[0][1][0])
    text = lambda: f"{some(20)} {run} {some(20)}"
    pair, three, place, left, right = text(), text(), text(), some(27), some(27)
    rows = [(0, f"{text()} {place}"), (900, text()), (100, place), *[(i, text()) for i in range(500, 530)]]
    rows += [(10, pair), (11, pair), *[(i, three) for i in (20, 21, 22)]]
    rows += [(30, f"{left} {run} {some(27)}"), (31, f"{left} {run} {right}"), (32, f"{some(27)} {run} {right}")]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    rows = {r.doc_id: r for r in got.collect()}
    root = {d: r.component_id for d, r in rows.items() if r.n_links}
    assert root == {0: 0, 100: 0, 10: 10, 11: 10, 20: 20, 21: 20, 22: 20, 30: 30, 31: 30, 32: 30}
    assert all(rows[d].n_passages == 1 for d in root if d != 31)
    assert [rows[d].removed for d in (100, 10, 11, 21, 22)] == ["0:48", "", "0:48", "0:48", "0:48"]
    assert (rows[31].removed, rows[32].removed) == ("0:35", "27:62")


def test_terms_that_give_a_person_away(spark):
    pick = random.Random(2)
    rows = [(i, f"{prose(i, 30)} {pick.choice(WORDS)} Zebulon bob@site.org {pick.choice(WORDS)} {prose(i + 99, 30)}") for i in range(8)]
    rows += [(50, "a note on Zebulon without an address"), (51, prose(51, 400))]
    rows += [(1000 + i, prose(1000 + i, 5)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in personal.find_personal(docs).collect()}
    assert [(s.kind, s.start, s.end) for s in found[50]] == [("term", 10, 17)] and found[51] == []
    assert all([s.kind for s in found[i]] == ["email", "term"] for i in range(8))
    clean = {r.doc_id: r.text for r in personal.sanitised(docs).collect()}
    assert clean[50] == "a note on  without an address" and clean[51] == dict(rows)[51]
    assert "<email>" in clean[0] and "bob@" not in clean[0]


def test_patterns_on_hard_texts(spark):
    texts = [
        "a@b.co_x@y.com a@b a.b@c.d.e-f. x@@y.z", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4 9.9.9", "é+1 22 33 44 55x+12345678901234567",
        "4111-1111 1111-1111 4111 1111 1111 1112 4111  1111 1111 1111", "1" * 5000 + " " + "9 " * 3000, "a" * 50_000 + "@" + "b." * 50 + "c",
        "\U0001f600 x@y.zz", "+1(2)3.4-5 67890 +", "5-4-3", "+" * 50 + "1234567890",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in personal.find_personal(docs).collect():
        assert [f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind != "term"] == base_of(texts[r.doc_id])


def test_model_sums_to_one(spark):
    train = [(i, prose(i % 5, 40)) for i in range(30)]
    vocabulary = sorted({w for _, t in train for w in t.split()})
    tests = [(1000 + i, f"{vocabulary[0]} {w}") for i, w in enumerate(vocabulary)]
    docs = spark.createDataFrame(train + tests, "doc_id long, text string")
    spec = language_model.ModelSpec(heads=4, tails=2, frequent=64, features=256)
    got = {r.doc_id: r.score for r in language_model.score_texts(docs, F.col("doc_id") < 1000, spec).collect()}
    # P(w0) P(w | w0) P(end | w0 w) over all w adds up to less than P(w0), and no model's score is above 0.
    assert all(s < 0 for s in got.values()) and sum(10**got[1000 + i] for i in range(len(vocabulary))) < 1


def test_scores_do_not_depend_on_what_is_sent_to_tasks(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    train = F.col("doc_id") % 7 != 2
    spec = language_model.ModelSpec(heads=8, tails=4, features=1024, rounds=1)
    all_rows = []
    for frequent in (1, 60, 1 << 17):
        scored = language_model.score_texts(docs, train, replace(spec, frequent=frequent))
        all_rows.append(scored.orderBy("doc_id").toPandas())
    for other in all_rows[1:]:
        pd.testing.assert_frame_equal(all_rows[0], other, rtol=1e-9)


def test_contexts_tell_pairs_and_rare_words_apart():
    spec = language_model.ModelSpec()
    empty = np.empty(0, "int64")
    seen = language_model.Vocabulary(empty, empty, empty, np.ones(spec.classes), 0, 0)
    coder = language_model.Coder(seen, spec)
    texts = [b"ab ab zz", b"ab cab zz", b"cab ab zz", b"cab cab zz"]
    e = language_model.encode([t.split() for t in texts], coder, spec)
    # What foretells the third word: all are rare and of one class, but no two contexts are the same.
    third = e.rows[:, e.first + 2]
    assert [len(set(r.tolist())) for r in third] == [2, 2, 4, 1]


def test_sums_of_rows_with_few_and_many_members():
    rng = np.random.default_rng(3)
    values = rng.normal(size=(3000, 8)).astype("float32")
    of = np.minimum(rng.geometric(0.02, 3000), 400)
    of[:700] = 5
    order = np.argsort(of, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(of[order]) != 0))
    sizes = np.diff(np.append(starts, len(of)))
    assert sizes.max() > 700 and sizes.min() < 16
    want = np.add.reduceat(values[order], starts, axis=0)
    assert np.array_equal(language_model.sums_by_row(values, order, starts, sizes), want)
    few = np.flatnonzero(sizes <= 8)
    assert len(few) > 5  # short and long runs both


def test_small_tasks_learn_together(spark, monkeypatch):
    docs = spark.createDataFrame([(i, prose(i, 40)) for i in range(300)], "doc_id long, text string").repartition(40)
    tasks, averaged = [], language_model._averaged

    def noted(blocks, spec, start):
        tasks.append(blocks.rdd.getNumPartitions())
        return averaged(blocks, spec, start)

    monkeypatch.setattr(language_model, "_averaged", noted)
    spec = language_model.ModelSpec(features=256, rounds=2)
    got = language_model.score_texts(docs, F.col("doc_id") % 7 != 2, spec).collect()
    assert len(got) == 300 and all(r.score < 0 for r in got)
    assert tasks == [spark.sparkContext.defaultParallelism] * 2
    tasks.clear()
    language_model.score_texts(docs, F.col("doc_id") % 7 != 2, replace(spec, task_tokens=100)).collect()
    assert min(tasks) == 40  # every task has enough


def test_gradient_steps_raise_the_likelihood():
    rng = np.random.default_rng(1)
    spec = language_model.ModelSpec(features=64)
    rows, truth = rng.integers(0, 64, (3, 5000)), None
    truth = rows[0] % 8
    weights, bias, often = np.zeros((64, 64), "float32"), np.zeros(64, "float32"), np.ones(64)
    likelihood = lambda: language_model.log_classes(weights, bias, rows)[np.arange(5000), truth].mean()
    before = likelihood()
    for _ in range(5):
        language_model.gradient_step(weights, bias, often, rows, truth, spec.rate)
    assert likelihood() > before + 1


def test_chain_equals_enumeration():
    rng = np.random.default_rng(4)
    moves, counts = rng.normal(size=(2, 2)), np.array([3, 1, 5, 2])
    unary = rng.normal(size=counts.sum())
    good, expected, norm = line_quality.chain(unary, counts, moves)
    at, total, want_norm = 0, np.zeros((2, 2)), 0.0
    for n in counts:
        u, weights, marginal, pairs = unary[at : at + n], [], np.zeros(n), np.zeros((2, 2))
        for code in range(1 << n):
            y = [code >> i & 1 for i in range(n)]
            p = np.exp(sum(u[i] * y[i] for i in range(n)) + sum(moves[a, b] for a, b in zip(y, y[1:])))
            weights.append(p)
            marginal += p * np.array(y)
            for a, b in zip(y, y[1:]):
                pairs[a, b] += p
        np.testing.assert_allclose(good[at : at + n], marginal / sum(weights))
        total, want_norm, at = total + pairs / sum(weights), want_norm + np.log(sum(weights)), at + n
    np.testing.assert_allclose(expected, total)
    assert np.isclose(norm, want_norm)


TIERS = (4096, 2048, 1024, 512)


@pytest.mark.parametrize("tiers", [TIERS, (4096,), (64, 8)])
def test_windows_are_filled_to_the_brim(tiers):
    pick = random.Random(1)
    lengths = [pick.randrange(1, max(tiers)) for _ in range(500)]
    windows = packing.fill_windows(lengths, tiers)
    assert sorted(i for _, w in windows for i in w) == list(range(500))
    for size, w in windows:
        total = sum(lengths[i] for i in w)
        assert total <= max(tiers) if size == max(tiers) else total == size
    assert sum(size for size, _ in windows) <= sum(lengths) * 1.05 + max(tiers)


def test_short_pieces_form_short_windows_and_long_gaps_are_filled_first():
    windows = packing.fill_windows([4000, 96, 500, 12, 1000, 24, 3, 2000, 40], TIERS)
    assert sorted((size, sorted(w)) for size, w in windows) == [
        (512, [2, 3]), (1024, [4, 5]), (4096, [0, 1]), (4096, [6, 7, 8])
    ]
    assert packing.fill_windows([], TIERS) == [] and packing.fill_windows([7], TIERS) == [(4096, [0])]
    pick = random.Random(2)
    lengths = [int(pick.lognormvariate(6, 1)) % 4096 + 1 for _ in range(2000)]
    by_size = {size for size, _ in packing.fill_windows(lengths, TIERS)}
    assert by_size == set(TIERS) and {size for size, _ in packing.fill_windows(lengths, (4096,))} == {4096}


def test_rules_find_planted_conditions():
    rng = np.random.default_rng(2)
    x = {n: rng.random(3000) for n in rules.FEATURES}
    bad = (x["symbol_share"] > 0.8) | ((x["upper_share"] > 0.7) & (x["mean_word"] <= 0.4))
    found = rules.learn_rules(x, bad, rng.random(3000) < 0.67, rules.RuleSpec())
    hit = np.zeros(3000, bool)
    for rule in found:
        hit |= rules._covers(rule, x, 3000)
    assert (hit == bad).mean() > 0.97 and 1 < len(found) <= 12
