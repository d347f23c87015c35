"""The pipeline's stages against plain versions, clashing column names, very long texts, ties and repeated rows."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.brute import repeats, shingle_set
from tracelake.llm import bpe, jaccard, language, mixing, quality, suffixes, topk, toxicity, warc, wavelet
from tracelake.llm.common import clean_up

CLASH = (
    "id long, h long, c long, a long, b long, m long, lo long, hi long, mark long, key long, want long, copy long, shard long, score double, predicted int, "
    "row long, gone long, stays long, whole long, places long, span_id long, size long, source_size long, rank int, block long, drawn_row long, "
    "held_out boolean, y int, x double, part int, nth int, fp binary, label string, tokens string, n_tokens long, ids string, g long, i int, j int, "
    "bucket long, place double, quota long, target double, taken long, shards string, words string, lines string, t string, n_words long, bits string"
)
NAMES = [c.split()[0] for c in CLASH.split(", ")]


def word(r):
    return "".join(r.choice("abcdeghinorstu") for _ in range(r.randint(2, 7)))


def corpus(seed=1):
    """(doc_id, text, source) rows: copies, near copies, shared passages, toxic texts, nulls, empty texts."""
    r = random.Random(seed)
    text = lambda n: " ".join(word(r) for _ in range(n))
    base, passage = text(120), text(60)
    out = [None, "", " \n", base, base, base.upper(), "déjà " * 90]
    for _ in range(6):
        w = base.split(" ")
        w[r.randrange(len(w))] = word(r)
        out.append(" ".join(w))
    out += [f"{text(20)} {passage} {text(15)}" for _ in range(4)] + [passage]
    out += [f"{text(10)} you vilescum {text(10)}" for _ in range(12)]
    out += [text(r.randint(5, 90)) for _ in range(40)]
    r.shuffle(out)
    return [(i, t, [None, "web", "book", "é"][i % 4]) for i, t in enumerate(out)]


def frame(spark, rows, clash=False, parts=3):
    data = [(d, t, "en", s, len(t or "")) for d, t, s in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(data, schema).repartition(parts)
    if clash:
        for spec in CLASH.split(", "):
            name, kind = spec.split()
            df = df.withColumn(name, F.col("doc_id").cast(kind) if kind in ("long", "string") else F.lit(None).cast(kind))
    return df


def brute_jaccard_stage(rows, k=5, per_cent=80):
    """Indices of the rows that stay: of each group the one of the least doc_id."""
    sets, groups = [shingle_set(t, k) for _, t, _ in rows], []
    for i, s in enumerate(sets):
        near = [g for g in groups if any(s and sets[j] and 100 * len(s & sets[j]) >= per_cent * len(s | sets[j]) for j in g)]
        groups = [g for g in groups if g not in near] + [sum(near, [i])]
    return {min(g, key=lambda i: rows[i][0]) for g in groups}


def brute_passages(rows, length=100):
    """doc_id -> text without repeated passages (None: the row goes)."""
    seen, out = set(), {}
    for d, t, _ in sorted(rows, key=lambda x: x[0]):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        kept = bytes(c for c, g in zip(data, gone) if not g).decode("utf-8", "ignore")
        out[d] = (t if t is None else kept) if not any(gone) or kept else "gone"
    return out


def test_pipeline_equals_plain_stages(spark, tmp_path):
    """run() over tables on disk: each stage's input is its predecessor's output, worked out plainly."""
    import tiktoken

    rows = corpus()
    df = frame(spark, rows, clash=True)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(d, int("vilescum" in (t or "")), None) for d, t, _ in rows]
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    model = toxicity.fit(df, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    score = dict(zip([d for d, _, _ in rows], model.score([(t or "").encode() for _, t, _ in rows])))
    stage = dict(corpus_pipeline.STAGES)
    names = df.columns

    clean = stage["toxicity"](spark, df, str(tmp_path))
    assert clean.columns == names
    left = [x for x in rows if score[x[0]] < 0.7]
    assert sorted(r.doc_id for r in clean.collect()) == sorted(x[0] for x in left)
    assert len(left) < len(rows) and all("vilescum" in (t or "") for d, t, _ in rows if score[d] >= 0.7)

    kept = stage["ngram_jaccard"](spark, clean, str(tmp_path))
    assert kept.columns == names
    left = [left[i] for i in sorted(brute_jaccard_stage(left))]
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted((d, t or "") for d, t, _ in left)

    passages = stage["suffix_dedup"](spark, kept, str(tmp_path))
    want = {d: t for d, t in brute_passages(left).items() if t != "gone"}
    got = passages.collect()
    assert passages.columns == names and {r.doc_id: r.text for r in got} == want and len(got) == len(want)
    assert all(r.n_chars == len(r.text or "") and (r.id is None or r.id == r.doc_id) for r in got)
    assert any(t != u for (d, u, _) in left for t in [want.get(d)])

    left = [(d, want[d], s) for d, _, s in left if d in want]
    plan = {r.doc_id: r for r in mixing.taken(spark, passages).collect()}
    mix = stage["mixing"](spark, passages, str(tmp_path))
    assert mix.columns == names
    count = collections.Counter((r.doc_id, r.text) for r in mix.collect())
    size = {d: len((t or "").split()) for d, t, _ in left}
    whole = {d: plan[d].taken // size[d] + (2 * (plan[d].taken % size[d]) >= size[d]) if size[d] else 0 for d in size}
    assert {d: n for (d, _), n in count.items()} == {d: n for d, n in whole.items() if n}
    assert all(t == want[d] for d, t in count)

    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    ids = collections.Counter()
    for (d, t), n in count.items():
        ids[d, hashlib.sha256(",".join(map(str, coder.encode_ordinary(t))).encode()).hexdigest()] += n
    assert collections.Counter((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == ids
    clean_up(spark)


def test_repeated_and_null_ids_with_clashing_names(spark):
    """Rows that share an id or have none keep their texts apart in every operator; reruns agree."""
    rows = [(None if i % 3 == 0 else i % 5, t, s) for i, t, s in corpus(2)]
    rows += rows[:4]
    one, two = frame(spark, rows, clash=True), frame(spark, rows[::-1], clash=True, parts=5)
    texts = collections.Counter((d, t or "") for d, t, _ in rows)

    for op in (lambda x: mixing.taken(spark, x), lambda x: suffixes.removed(spark, x, 100), lambda x: jaccard.join(spark, x, 3, 90)):
        a, b = (sorted(map(str, op(x).collect())) for x in (one, two))
        assert a == b and len(a) == len(rows)
    took = mixing.taken(spark, one).collect()
    assert all(r.taken <= 3 * r["size"] for r in took)
    for op in (lambda x: mixing.mixed(spark, x), lambda x: suffixes.cleaned(spark, x, 100, gone="cut_off")):
        a = sorted(map(str, op(one).drop("cut_off").collect()))
        assert a == sorted(map(str, op(two).drop("cut_off").collect()))
    near = collections.Counter((r.doc_id, r.text or "") for r in corpus_pipeline.near_duplicates(spark, one, "").collect())
    assert all(n <= texts[x] for x, n in near.items())
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(5)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(one, labels)
    assert toxicity.scored(one, model).count() == len(rows) and language.predict(one, language.fit(one)).count() == len(rows)
    assert quality.judged(one).count() == len(rows)
    ids = collections.Counter((r.doc_id, r.decoded_sha256) for r in bpe.encode(one, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect())
    assert ids == collections.Counter((d, hashlib.sha256((t or "").encode()).hexdigest()) for d, t, _ in rows)
    back = wavelet.read(spark, wavelet.write(spark, one, P.path("byte_bpe_50k.json")))
    assert collections.Counter(r.doc_id for r in back.collect()) == collections.Counter(d for d, _, _ in rows)
    pages = one.selectExpr("doc_id AS page_id", "source AS url", "text AS html", *[c for c in NAMES])
    assert warc.records(spark, pages).count() == len(rows)
    vectors = one.selectExpr("doc_id AS vec_id", "array(n_chars, 1.0D) AS embedding", *[c for c in NAMES])
    found = collections.defaultdict(list)
    for x in topk.top_k(spark, vectors, "id % 20 = 0", k=2).collect():
        found[x.query_id].append((x.rank, x.vec_id, x.score))
    use = [(x.vec_id, [int(64 * c) for c in x.embedding]) for x in vectors.collect() if x.vec_id is not None and None not in x.embedding]
    for i in {d for d, _ in use if d % 20 == 0}:
        best = sorted((-sum(a * b for a, b in zip(q, c)), j) for d, q in use if d == i for j, c in use if j != i)[:2]
        assert sorted(found[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
    clean_up(spark)


def test_very_long_texts(spark):
    """Texts of more than a megabyte: equal ones, one within another, one without any space."""
    r = random.Random(5)
    long = " ".join(word(r) for _ in range(200_000))
    rows = [(1, long, "a"), (2, long, "a"), (3, long[:600_000], "b"), (4, "q" * 1_100_000, None), (5, "short text", "b"), (6, "日本" * 200_000, "b")]
    df = frame(spark, rows, clash=True, parts=2)
    got = {r.doc_id: r for r in suffixes.removed(spark, df, 100).collect()}
    assert [tuple(got[d]) for d in (1, 2, 3)] == repeats([(d, t) for d, t, _ in rows[:3]], 100)
    assert (got[4].n_removed, got[4].n_spans, got[6].n_removed) == (1_100_000 - 1, 1, 1_200_000 - 6)
    assert {x.doc_id: x.component_id for x in jaccard.join(spark, df, 3, 90).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}
    ids = {x.doc_id: x for x in bpe.encode(df, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()}
    assert all(ids[d].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for d, t, _ in rows)
    back = wavelet.read(spark, wavelet.write(spark, df, P.path("byte_bpe_50k.json"))).orderBy("start").collect()
    assert [x.doc_id for x in back] == [1, 2, 3, 4, 5, 6] and back[0].ids_crc32 == back[1].ids_crc32
    words = {x.doc_id: (x.n_words, x.word_chars) for x in quality.judged(df).collect()}
    assert words == {d: (len(t.split()), sum(map(len, t.split()))) for d, t, _ in rows}
    assert toxicity.scored(df, None).count() == 6 and language.predict(df, language.fit(df)).count() == 6
    took = {x.doc_id: x for x in mixing.taken(spark, df).collect()}
    assert all(took[d]["size"] == len(t.split()) for d, t, _ in rows)
    clean_up(spark)


def test_quotas_of_the_tree(spark):
    """Leaves add up to every source's blocks, halves are as large as they should be, and counts are spread as the
    hypergeometric distribution says."""
    n = [37, 5, 120, 1]
    blocks = spark.createDataFrame([(i + 1, x) for i, x in enumerate(n)], "rank int, n long")
    sums, first = collections.Counter(), []
    for seed in range(12):
        q = mixing.quotas(spark, blocks, 3, seed).collect()
        per = collections.Counter()
        for r in q:
            per[r["rank"]] += r.quota
            sums[r["rank"]] += r.quota
        shard = collections.Counter()
        for r in q:
            shard[r.shard] += r.quota
        assert [per[i + 1] for i in range(4)] == n and sum(shard.values()) == sum(n)
        assert max(shard.values()) - min(shard.values()) <= 3  # every node is halved
        first += [sum(r.quota for r in q if r["rank"] == 1 and r.shard < 4)]
    mean, var = 37 * 81 / 163, 81 * (37 / 163) * (1 - 37 / 163) * (163 - 81) / 162
    assert abs(np.mean(first) - mean) < 4 * (var / len(first)) ** 0.5 and np.std(first) > 0


def test_kept_equals_its_rules(spark):
    """op9's verdict, line by line."""
    import re

    lines = ["home | about | contact", "- item", "Accept our cookie settings now please", "Alle Rechte vorbehalten.", "too short", "This is a whole sentence of some words.", "- A sentence as a list entry.", "« Bonjour », dit-elle.", "- see (above)", "A long line of words without an end mark here", "ok."]
    r = random.Random(4)
    rows = [(i, "\n".join(f"{r.choice(lines)} {word(r)}" if r.random() < 0.3 else r.choice(lines) + " " + " ".join(word(r) for _ in range(r.randint(0, 12))) for _ in range(r.randint(8, 14))), "a") for i in range(60)]
    got = {x.doc_id: x for x in quality.judged(frame(spark, rows)).collect()}
    end = re.compile(r"[.!?:;…\"'”»)][ \t-\r]*$")
    seen = set()
    for d, t, _ in rows:
        stay = []
        for x in t.split("\n"):
            nav = re.search(r"\|.*\||»|›|^\s*[-*•]\s", x)
            bad = any(re.search(p, x.lower()) for p in quality.BOILERPLATE) and len(x.split()) < quality.PHRASE_LINE
            if x.split() and not bad and (end.search(x) or not nav and len(x.split()) >= quality.SHORT_LINE):
                stay.append(x)
        chars, words = sum(len(w) for x in stay for w in x.split()), t.split()
        want = not got[d].base_failed and 100 * chars >= 50 * sum(map(len, words))
        assert (got[d].kept, got[d].kept_chars, got[d].clean_text) == (want, chars, "\n".join(stay))
        seen.add((got[d].base_failed, want))
    assert {(False, True), (False, False)} <= seen


def test_prose_is_no_boilerplate(spark):
    """A phrase of boilerplate in a paragraph, and sentences that are written as a list, are kept."""
    r = random.Random(9)
    said = lambda n: " ".join(word(r) for _ in range(n))
    prose = f"{said(90)} and chocolate cookies."
    entries = "\n".join(f"- {said(8)}." for _ in range(20))
    notes = "\n".join(["we use cookies on this site", "all rights reserved."] * 3)
    rows = [(1, prose, "a"), (2, entries, "a"), (3, f"{said(60)}.\n{notes}", "a"), (4, "\n".join(f"- {said(8)}" for _ in range(20)), "a")]
    got = {x.doc_id: x for x in quality.judged(frame(spark, rows)).collect()}
    assert {d: x.kept for d, x in got.items()} == {1: True, 2: True, 3: True, 4: False}
    assert got[1].clean_text == prose and got[2].clean_text == entries and "cookies" not in got[3].clean_text


def test_a_cluster_must_name_its_shared_folder(monkeypatch):
    from tracelake.llm.common import shared_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(ValueError):
        shared_dir(Session())


def test_remembered_chunks_are_bounded():
    from tracelake.llm.chunks import Table
    import pyarrow as pa

    table = Table(lambda words: (np.concatenate([np.frombuffer(w.encode(), np.uint8).astype(np.uint32) for w in words] or [np.zeros(0, np.uint32)]), np.cumsum([0] + [len(w.encode()) for w in words])[:-1], np.array([len(w.encode()) for w in words], np.int64)), 100)
    size = []
    for turn in range(6):
        texts = [f"{turn}{i}" * 10_000 for i in range(20)] + [f"w{turn}x{i}" for i in range(60)]
        got = table.packed(pa.array(texts, pa.string()))
        assert got == [np.frombuffer(t.encode(), np.uint8).astype("<u4").tobytes() for t in texts]
        size.append(table.held())
    assert size[-1] == size[2] and len(table.known) <= 100
