import collections
import hashlib
import io
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracelake.llm import bpe, language, mixing, quality, topk, toxicity, warc, wavelet
from tracelake.llm.chunks import Table

DOCS = "note string, doc_id long, text string, source string, lang string, ids string, score string"
ODD = [
    None, "", " ", "a" * 3000, "don't  stop \n\n x1y2 日本語 \U0001f600", "<|endoftext|> x", "one. two\none. two\nhome | about", "é" * 700,
    " ".join(["same words again"] * 40), "The quick brown fox. " * 30, "\x85 a\x1c b", "x　y",
]


def docs(spark, texts=ODD):
    rows = [("n", None if i == 3 else i, t, [None, "a", "b", "é"][i % 4], ["en", "de", None][i % 3], "i", "s") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[-1:] if rows else [], DOCS).repartition(3)


def test_bpe_equals_tiktoken(spark):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    r = random.Random(1)
    texts = ODD + ["".join(r.choice("anatheis é\n 1'!") for _ in range(200)) for _ in range(60)]
    got = bpe.encode(docs(spark, texts), path, P.PATTERN).collect()
    assert len(got) == len(texts) + 1
    for row in got:
        if row.doc_id is not None:
            ids = coder.encode_ordinary(texts[row.doc_id] or "")
            assert row.ids == ids and row.n_tokens == len(ids)
            assert row.decoded_sha256 == hashlib.sha256((texts[row.doc_id] or "").encode()).hexdigest()
            assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_wavelet_matrix():
    ids = np.random.default_rng(2).integers(0, 700, 1500).astype(np.uint32)
    m = wavelet.WaveletMatrix(wavelet.build(ids, np.array([0, 1500]), [None]))
    assert (m.tokens() == ids).all() and m.doc_ids == [None]
    for i in (0, 1, 511, 512, 1499):
        t = int(ids[i])
        assert m.access(i) == t
        assert m.count(t, 0, i) == (ids[:i] == t).sum()
        assert m.select(t, m.count(t, 0, i)) == i
    assert m.count(70_000) == 0


def test_wavelet_files(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    coder = Tokenizer.from_file(path)
    coder.encode_special_tokens = True
    got = wavelet.read(spark, wavelet.write(spark, docs(spark), path, most_tokens=700)).orderBy("start").collect()
    at, order = 0, []
    for row in got:
        assert row.start == at
        at += row.n_tokens
        order.append(-1 if row.doc_id is None else row.doc_id)
        if row.doc_id is not None:
            ids = coder.encode(ODD[row.doc_id] or "", add_special_tokens=False).ids + [0]
            assert row.n_tokens == len(ids) and row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert order == sorted(order) and len(got) == len(ODD) + 1


def test_chunk_table_equals_the_library():
    """Any white space beside symbols, digits, letters and contractions; known and unknown chunks."""
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        coder = wavelet.Coder(file.read())
    r = random.Random(9)
    marks = [" ", " ", "\n", "\n\n", "\r\n", "\t", "\u00a0", "\u3000", "\u200b", "\x01", "\x1c", "\x85", ".", ",", "'", "'s", "’", "_", "$$", "é", "ß", "a", "The", "1", "²", "x\u0301", "日", "\U0001f600"]
    some = [["".join(r.choice(marks if r.random() < 0.5 else marks[:3] + marks[12:]) for _ in range(r.randint(0, 40))) for _ in range(300)] for _ in range(3)]
    some.append([None, "", " ", "a " * 4000, *ODD])
    for limit in (0, 50, 100_000):
        table = Table(coder.encode, limit)
        for texts in some:
            want = [np.array(coder.coder.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
            assert table.packed(pa.array(texts, pa.string())) == want
            assert table.packed(pa.array(texts[:0], pa.string())) == []


def test_op8_finds_added_tokens(spark, tmp_path):
    """The query's ids are those of the unmodified library."""
    from tokenizers import Tokenizer

    from tracelake.llm.queries import QUERIES

    coder = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = ODD + ["a <|endoftext|> b", end, f"{end}{end} x", f" a b {end}c\n{end} ", f"x\t{end}\u3000", "<|endof text|>", "<|endoftext|", f" word{end}"]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op8_wavelet"](spark, str(tmp_path)).orderBy("start").collect()
    at = 0
    for row in got:
        assert row.start == at
        at += row.n_tokens
        if row.doc_id is not None:
            ids = coder.encode(texts[row.doc_id] or "", add_special_tokens=False).ids + [0]
            assert (row.n_tokens, row.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert len(got) == len(texts) + 1 and coder.encode(texts[len(ODD)], add_special_tokens=False).ids == [64, 220, 50256, 275]


def test_warc(spark):
    pages = [(None, None, "x"), (1, "http://a/", "same"), (2, "http://b/ c", "same"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 400_000), (6, "u", "x"), (6, "u", "x")]
    df = spark.createDataFrame([("n", *p) for p in pages], "data string, page_id long, url string, html string").repartition(3)
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.records(spark, df).collect()}
    digest = lambda t: warc.base32(hashlib.sha1(t.encode()).hexdigest())
    last = {t: max((i for i, _, u in pages if (u or "") == t and i is not None)) for t in {u or "" for _, _, u in pages}}
    want = set()
    for i, _, t in pages:
        t = t or ""
        first = i == last[t]
        want.add((i, "response" if first else "revisit", None if first else last[t], len(t.encode()), digest(t)))
    assert got == want
    chunks = warc.read(spark, warc.write(spark, df)).where("page_id = 5").orderBy("chunk").collect()
    assert len(chunks) > 2 and b"".join(bytes(c.data) for c in chunks).decode() == pages[5][2]


def test_broken_archive():
    with pytest.raises(ValueError):
        list(warc.chunks_of(io.BytesIO(zlib.compress(b"WARC/1.1\r\nWARC-Type: response", wbits=31))))


def test_mixing(spark):
    r = random.Random(4)
    rows = [("n", i, " ".join("w" for _ in range(r.randint(0, 90))), s, "en", "", "") for i, s in enumerate(["b"] * 300 + ["a"] * 40 + [None] * 60 + ["é"] * 9)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.taken(spark, df).collect()
    assert sorted(got) == sorted(mixing.taken(spark, df.repartition(7)).collect())
    size, weights = collections.Counter(), {s: w for s, w in zip(["a", "b", "é", None], (5, 2, 1, 5))}
    for row in rows:
        size[row[3]] += len(row[2].split())
    total, target, free = sum(size.values()), {}, set(size)
    while True:
        left = total - sum(target.values())
        level = left / sum(weights[s] for s in free)
        over = [s for s in free if level * weights[s] > 3 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * size[s]
            free.remove(s)
    target |= {s: level * weights[s] for s in free}
    took = collections.Counter()
    for row in got:
        s = rows[row.doc_id][3]
        took[s] += row.taken
        assert row.taken <= 3 * row["size"] and row.source_size == size[s] and abs(row.target - target[s]) < 1e-6
    assert all(abs(took[s] - target[s]) <= 1 for s in size)
    mixed = mixing.mixed(spark, df)
    assert mixed.columns == df.columns and mixed.count() > 0


def test_quality(spark):
    got = {r.doc_id: r for r in quality.judged(docs(spark)).collect() if r.doc_id is not None}
    for i, t in enumerate(ODD):
        if i == 3:
            continue
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        tri = collections.Counter(zip(words, words[1:], words[2:]))
        again = {j for k in range(len(words) - 2) if tri[tuple(words[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars) == (len(words), sum(map(len, words)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t) and r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == len(again) and r.base_failed == (len(words) < 50 or 2 * len(again) > len(words))


def test_topk(spark):
    r = np.random.default_rng(5)
    rows = [(i, (r.integers(-3, 4, 6) / 64).tolist(), "x") for i in range(90)] + [(100, None, "x"), (120, [1.0, float("nan")], "x"), (140, [None], "x")]
    rows += [(160, [], "x"), (None, [1.0], "x"), (7, [0.5] * 6, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(4)
    got = collections.defaultdict(list)
    for row in topk.top_k(spark, df, "id % 20 = 0", k=5).orderBy("query_id", "rank").collect():
        got[row.query_id].append((-row.score, row.vec_id))
    use = [(i, [int(np.floor(64 * x)) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for i, q in use:
        if i % 20 == 0:
            want = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in use if j != i)[:5]
            assert got[i] == want


def test_topk_of_large_components(spark):
    r = np.random.default_rng(6)
    rows = [(i, [float(x) for x in r.integers(-(1 << 22), 1 << 22, 3)]) for i in range(60)]
    rows += [(60 + i, [float((-1) ** i * 2**25), float(i), 0.0]) for i in range(60)] + [(200, [float(2**50), 1.0, 0.0]), (220, [0.0, 2.0**25, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = collections.defaultdict(list)
    use = [(i, [int(64 * x) for x in v]) for i, v in rows if i != 200]
    for row in topk.top_k(spark, df.where("vec_id <> 200"), "id % 20 = 0", k=5).orderBy("query_id", "rank").collect():
        got[row.query_id].append((-row.score, row.vec_id))
    for i, q in use:
        if i % 20 == 0:
            assert got[i] == sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in use if j != i)[:5]
    alone = topk.top_k(spark, df.where("vec_id IN (200, 220)"), "id = 200", k=5).collect()
    assert [(r.vec_id, r.score) for r in alone] == [(220, 2**37)]


def test_topk_beyond_64_bits(spark):
    """One row of huge components changes nothing for the others, and exact scores give the ranks."""
    big = [[1e18, 0.0], [-1e18, 1.0], [1e300, -1e300], [1e300, -1e301], [3.0, 1e9], [1e9, 1e9], [1.5e308, 1.0], [2.0**63, -(2.0**63)]]
    rows = [(i, [float(i % 7), float(-i)]) for i in range(40)] + [(100 + i, v) for i, v in enumerate(big)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    use = [(i, [int(64 * x) if abs(x) < 2.0**47 else int(x) * 64 for x in v]) for i, v in rows if i != 106]
    got = collections.defaultdict(list)
    for row in topk.top_k(spark, df, "id % 20 = 0 OR id >= 100", k=6).orderBy("query_id", "rank").collect():
        got[row.query_id].append((row.vec_id, row.score))
    want = {}
    for i, q in use:
        if i % 20 == 0 or i >= 100:
            best = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in use if j != i)[:6]
            want[i] = [(j, min(2**63 - 1, max(-(2**63), -s))) for s, j in best]
    assert got == want


def test_topk_of_blocks_by_size(spark, monkeypatch):
    """Blocks hold fewer of wider vectors; the result is the same."""
    r = np.random.default_rng(8)
    rows = [(i, r.integers(-9, 9, 3 + 5 * (i % 3)).astype(float).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    want = topk.top_k(spark, df, "id % 20 = 0", k=7).collect()
    monkeypatch.setattr(topk, "CELLS", 64)
    assert sorted(topk.top_k(spark, df, "id % 20 = 0", k=7).collect()) == sorted(want)


def test_models_take_odd_rows(spark):
    df = docs(spark)
    labels = spark.createDataFrame([(i, int(i % 2), None) for i in range(12)], "doc_id long, toxic int, quality int")
    scores = toxicity.scored(df, toxicity.fit(df, labels)).collect()
    assert len(scores) == len(ODD) + 1 and all(0 <= r.score <= 1 for r in scores)
    langs = language.predict(df, language.fit(df)).collect()
    assert {r.lang_pred for r in langs if r.doc_id in (0, 1, 2)} == {"und"} and all(0 <= r.score <= 1 for r in langs)


def test_held_out_accuracy(spark, small):
    d = spark.read.parquet(small.replace("0.001", "0.01") + "/documents.parquet")
    labels = spark.read.parquet(small.replace("0.001", "0.01") + "/labels.parquet")
    right = language.predict(d, language.fit(d)).where("held_out").join(d, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98
    t = toxicity.scored(d, toxicity.fit(d, labels)).where("held_out").join(labels, "doc_id")
    assert t.where("predicted = 1 AND toxic = 0").count() == 0 and t.where("predicted = 1 AND toxic = 1").count() >= 8


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert bpe.encode(none, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0
    assert wavelet.read(spark, wavelet.write(spark, none, P.path("byte_bpe_50k.json"))).count() == 0
    assert mixing.taken(spark, none).count() == 0 and mixing.mixed(spark, none).count() == 0
    assert quality.judged(none).count() == 0
    assert toxicity.scored(none, toxicity.fit(none, labels)).count() == 0
    assert language.predict(none, language.fit(none)).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.records(spark, pages).count() == 0
    assert topk.top_k(spark, spark.createDataFrame([], "vec_id long, embedding array<float>"), "id % 20 = 0").count() == 0
