import random

import pytest

from tests.llm.brute import jaccard, repeats, shingle_set
from tracelake.llm import jaccard as J
from tracelake.llm import suffixes as S

SCHEMA = "note string, doc_id long, text string, ids string"


def corpus(seed):
    """Copies, near copies, shared passages, runs, nulls, short and empty texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, passage = text(150), text(40)
    out = [None, "", " \n\t ", "one", "one two", "One TWO", "a " * 400, "ab" * 300, "ab" * 300, base, base, base.upper()]
    for _ in range(25):
        w = base.split(" ")
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = word()
        out.append(" ".join(w))
    for _ in range(10):
        out.append(f"{text(30)} {passage}\n{text(r.randint(0, 60))} {passage[: r.randint(50, 150)]}")
    out += [text(r.randint(1, 80)) for _ in range(20)] + ["\0" * 150, "\0" * 120 + "x", text(3000)]
    r.shuffle(out)
    return [(None if i == 17 else i, t) for i, t in enumerate(out)]


def frame(spark, rows):
    return spark.createDataFrame([("n", d, t, "x") for d, t in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("k,per_cent", [(3, 90), (5, 80), (2, 60)])
def test_join_equals_brute_force(spark, k, per_cent, monkeypatch):
    rows = corpus(k)
    got = J.join(spark, frame(spark, rows + [(3, rows[9][1]), (3, rows[9][1])]), k, per_cent).collect()
    assert sorted((tuple(r) for r in got), key=str) == jaccard(rows + [(3, rows[9][1])] * 2, k, per_cent)


def stage_kept(rows, k=5, per_cent=80):
    """(doc_id, text) rows -> those that the pipeline's stage keeps, but which of equal shingles."""
    sets, groups = [shingle_set(t, k) for _, t in rows], []
    for i, s in enumerate(sets):
        near = [g for g in groups if any(s and sets[j] and 100 * len(s & sets[j]) >= per_cent * len(s | sets[j]) for j in g)]
        groups = [g for g in groups if g not in near] + [sum(near, [i])]
    return groups


def test_pipeline_keeps_one_row_of_each_group(spark):
    """Repeated and null ids: every group of near copies keeps a row of its least id, every other row stays."""
    import corpus_pipeline

    def check(rows, parts):
        df = spark.createDataFrame([("n", d, t, "x") for d, t in rows], SCHEMA).repartition(parts)
        kept = corpus_pipeline.near_duplicates(spark, df, "")
        assert kept.columns == df.columns
        got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
        left = list(got)
        for g in stage_kept(rows):
            ids = [rows[i][0] for i in g]
            least = min((d for d in ids if d is not None), default=None)
            found = next(rows[i] for i in g if rows[i][0] == least and rows[i] in left)
            left.remove(found)
        assert not left
        return got

    long = [(d, t) for d, t in corpus(6) if d is not None]
    ids = [None, None, None, 5, 5, 5, 5, 90, 90, 7]
    rows = [(ids[i % len(ids)], t) for i, (_, t) in enumerate(long)]
    rows += [(5, rows[7][1]), (7, rows[3][1]), (None, ""), (None, ""), (5, None), (5, "")]
    assert check(rows, 5) == check(rows[::-1], 3)
    check(long, 4)
    apart = [(None, "one two three four five six"), (None, "seven eight nine ten eleven twelve"), (4, "a b c d e f g"), (4, "h i j k l m n")]
    assert check(apart, 2) == sorted(apart, key=str)


def test_join_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 4)
    rows = corpus(11)
    got = J.join(spark, frame(spark, rows), 3, 80).collect()
    assert sorted((tuple(r) for r in got), key=str) == jaccard(rows, 3, 80)


def test_repeats_equal_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        got = S.removed(spark, frame(spark, rows), 100).collect()
        assert sorted((tuple(r) for r in got), key=str) == repeats(rows, 100)


def test_wholly_equal_rows_count_once(spark):
    text = "x y z " * 3 + "".join(chr(97 + i * i % 26) for i in range(200))
    got = S.removed(spark, frame(spark, [(1, text), (1, text), (2, text)]), 100).orderBy("doc_id").collect()
    assert [(r.n_removed == r.n_bytes) for r in got] == [False, False, True]


def test_empty(spark):
    none = frame(spark, []) if False else spark.createDataFrame([], SCHEMA)
    assert J.join(spark, none, 3, 90).count() == 0
    assert S.removed(spark, none, 100).count() == 0


def test_multikey_quicksort():
    import numpy as np

    r = np.random.default_rng(1)
    for n, width in ((500, 5), (1, 3), (0, 2), (40, 1)):
        words = r.integers(0, 3, (n, width)).astype(np.uint64)
        order = S.multikey_quicksort(words)
        rows = [tuple(x) for x in words[order].tolist()]
        assert sorted(order.tolist()) == list(range(n)) and rows == sorted(rows)
        for a, b, shared in zip(rows, rows[1:], S.shared_words(words, order)[1:]):
            assert shared == next((i for i in range(width) if a[i] != b[i]), width)


def similar(seed, n=40):
    """Texts that share 40 to 99 bytes, or more, with others, amid words of their own."""
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("abcdefghij klmnop") for _ in range(n))
    shared = [text(r.randint(40, 99) if seed % 3 == 0 else r.randint(40, 160)) for _ in range(4)]
    return [(i, text(r.randint(0, 90)) + r.choice(shared) + text(r.randint(0, 90)) + (r.choice(shared) if r.random() < 0.3 else "")) for i in range(n)]


@pytest.mark.parametrize("bucket, most", [(1 << 20, 16_384), (7, 16_384), (7, 2)])
def test_similar_texts_in_many_buckets(spark, monkeypatch, bucket, most):
    monkeypatch.setattr(S, "BUCKET", bucket)
    monkeypatch.setattr(S, "MOST_CLASSES", most)
    for seed in range(4):
        rows = similar(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert sorted((tuple(r) for r in S.removed(spark, df, 100).collect()), key=str) == repeats(rows, 100)
    two = [(1, "x" * 60 + "one sentence that both of them share, of eighty-one bytes, and not a byte more" + "y" * 70), (2, "p" * 60 + "one sentence that both of them share, of eighty-one bytes, and not a byte more" + "q" * 70)]
    df = spark.createDataFrame(two, "doc_id long, text string")
    assert sorted((tuple(r) for r in S.removed(spark, df, 100).collect()), key=str) == repeats(two, 100)


def test_equal_rows_with_a_map(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.sql(f"SELECT 1L AS doc_id, '{text}' AS text, map('a', x) AS m, array(x) AS l FROM VALUES (2), (1), (1) AS t(x)")
    out = J.survivors(spark, df, 5, 80).collect()
    assert [(r.doc_id, r.m) for r in out] == [(1, {"a": 1})]


def test_windows_of_an_anchor_in_two_chunks():
    """An anchor at the border of two chunks has a place for its windows in each; a hot seed's windows are given once each."""
    import numpy as np
    import pyarrow as pa

    r = random.Random(5)
    text = "".join(r.choice("abcdefghij klmnop") for _ in range(S.CHUNK + 300)).encode()
    at, _, _, first, last = S.anchors(text, np.array([len(text)]), 100)
    i = next(i for i in range(len(at) - 1) if at[i] == at[i + 1])
    assert first[i + 1] == last[i] + 1 == S.CHUNK
    places = S.pack(at, at - last, at - first)
    for some in ([i, i + 1], [i - 1, i, i + 1], [i, i + 1, i + 2]):
        rows = pa.record_batch({"doc_id": [1], "key": [2], "text": [text.decode()], "places": [places[some]]})
        out = pa.Table.from_batches(S._windowed(100)(iter([rows])))
        assert out.column("lo").to_pylist() == list(range(first[some[0]], last[some[-1]] + 1))
        assert len(set(out.column("h").to_pylist())) == len(set(at[some].tolist()))


def ring(n):
    """Texts that share most of their words with all others and a passage with two of them, but link with none."""
    r = random.Random(n)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(7)) for _ in range(n))
    common, own = text(100), [text(12) for _ in range(n)]
    return [(i, f"{own[i]} {common} {own[(i + 1) % n]}") for i in range(n)]


def test_texts_that_share_a_min_hash_ask_few_others(spark, monkeypatch):
    """Classes meet by the narrow rows of the matrix that they stand in, not as all members of a loose group."""
    monkeypatch.setattr(J, "BLOCK", 4)
    asked, real = [], J.reaching

    def counted(queries, per_cent):
        asked.append(queries.count())
        return real(queries, per_cent)

    monkeypatch.setattr(J, "reaching", counted)
    rows = ring(60)
    got = J.join(spark, frame(spark, rows), 3, 90).collect()
    assert sorted((tuple(r) for r in got), key=str) == jaccard(rows, 3, 90)
    assert 0 < asked[0] <= 2 * len(rows)


def test_wide_rows_equal_brute_force(spark, monkeypatch):
    for name, value in (("BLOCK", 4), ("WIDE", 2), ("LOOKED_AT", 1), ("PIVOTS", 1)):
        monkeypatch.setattr(J, name, value)
    for rows in (corpus(11), corpus(12) + [(1000 + i, t) for i, t in ring(20)]):
        got = J.join(spark, frame(spark, rows), 3, 80).collect()
        assert sorted((tuple(r) for r in got), key=str) == jaccard(rows, 3, 80)
