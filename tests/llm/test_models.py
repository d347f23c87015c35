"""The learned operators against plain versions."""

import math
import random

import numpy as np

from tracelake.llm import language as L
from tracelake.llm import toxicity as T


def plain_strength(word, weights):
    text = word.decode("utf-8", "ignore")
    found = [weights.get(word, 0.0)] + [weights.get(b"^" + text[:n].encode(), 0.0) for n in (4, 5, 6) if len(text) > n]
    return min(15, int(max(found) * 2))


def plain_features(text, weights):
    """Features of a text, word by word."""
    words = text.split()
    if not words:
        return [0.0] * len(T.FEATURES)
    power, second, caps, masked, hidden, stretched = [], [], [], [], [], []
    for w in words:
        bare = w.lower().strip(b".,;:!?\"'()[]{}<>-_*~")
        p, hid = plain_strength(bare, weights), False
        clear, mask = T.unmask(w.lower())
        if mask and plain_strength(clear, weights):
            p, hid = max(p, plain_strength(clear, weights)), True
        runs = any(bare[i : i + 1] * 3 == bare[i : i + 3] for i in range(len(bare) - 2))
        if runs and not p:
            once = b"".join(bare[i : i + 1] for i in range(len(bare)) if not i or bare[i] != bare[i - 1])
            p = plain_strength(once, weights)
            hid = hid or p > 0
        power.append(p)
        second.append(bare in T.SECOND_PERSON)
        caps.append(len(bare) > 2 and w.isupper())
        masked.append(mask)
        hidden.append(hid)
        stretched.append(runs)
    n, size = len(words), len(text)
    hits = [i for i, p in enumerate(power) if p]
    near = sum(any(second[j] for j in range(max(0, i - 5), min(n, i + 6))) for i in hits)
    upper, lower = sum(65 <= c <= 90 for c in text), sum(97 <= c <= 122 for c in text)
    punct = sum(chr(c) in "!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~" for c in text)
    return [
        len(hits) / n, len(hits), sum(p >= 8 for p in power), max(power), sum(power) / n, len({power[i] for i in hits}), sum(hidden),
        sum(second) / n, near, upper / max(1, upper + lower), sum(caps) / n, text.count(b"!") / n, punct / size,
        sum(48 <= c <= 57 for c in text) / size, sum(masked) / n, sum(stretched) / n, math.log1p(n),
    ]


def test_features_equal_plain_ones():
    r = random.Random(3)
    weights = {b"idiot": 4.2, b"^scum": 2.6, b"fool": 3.0, b"^nast": 9.0}
    some = ["idiot", "1d1ot", "IDIOT!", "i-d-i-o-t", "idiooot", "fool", "FOOOL", "you", "Your", "du", "scumbag", "nasty", "hello", "a", "é", "123", "4-5", "$$", "f@@l", "don't", "x_y", "()", "...", "AAA", "tú"]
    texts = ["", " ", "x" * 1_200_000, "you idiot " * 120_000]
    texts += [" ".join(r.choice(some) for _ in range(r.randint(1, 60))) + r.choice(["", "!", " \n"]) for _ in range(200)]
    lexicon = T.Lexicon(weights)
    for t in texts:
        assert np.allclose(T.features(t.encode(), lexicon), plain_features(t.encode(), weights), rtol=1e-12, atol=0)


def test_trees_equal_plain_ones():
    """Each split is the best one that an exhaustive search finds, and margins are those of a walk down the trees."""
    r = np.random.default_rng(5)
    x = r.integers(0, 6, (90, 4)).astype(float)
    y = ((x[:, 0] + x[:, 2] > 6) ^ (r.random(90) < 0.1)).astype(float)
    trees = T.Trees(x, y, rounds=4, depth=2, rate=0.3)
    b = trees.binned(x)
    assert (b == [[sum(v >= e for e in trees.edges[c]) for c, v in enumerate(row)] for row in x]).all()
    f = np.full(len(y), trees.base)
    for feature, at, value in trees.trees:
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        node = {0: list(range(len(y)))}
        for k in range(3):
            rows, best = node.get(k, []), (1e-3, -1, 0)
            for c in range(4) if len(rows) >= 8 else ():
                for t in range(int(b[rows, c].max()) if rows else 0):
                    left, right = [i for i in rows if b[i, c] <= t], [i for i in rows if b[i, c] > t]
                    if len(left) >= 4 and len(right) >= 4:
                        gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, right)) - g[rows].sum() ** 2 / (h[rows].sum() + 1)
                        if gain > best[0] + 1e-12:
                            best = (gain, c, t)
            assert feature[k] == best[1] and (best[1] < 0 or at[k] == best[2])
            goes = [best[1] >= 0 and b[i, best[1]] > best[2] for i in rows]
            node[2 * k + 1], node[2 * k + 2] = [i for i, s in zip(rows, goes) if not s], [i for i, s in zip(rows, goes) if s]
        for leaf in range(4):
            rows = node[3 + leaf]
            want = 0.3 * g[rows].sum() / (h[rows].sum() + 1) if rows else 0.0
            assert abs(value[leaf] - want) < 1e-12
            f[rows] += value[leaf]
    assert np.allclose(trees.margin(x), f)


def test_isotonic_equals_the_minimax_form():
    r = np.random.default_rng(6)
    for ties in (False, True):
        x = r.integers(0, 25, 60).astype(float) if ties else r.permutation(60).astype(float)
        y = (r.random(60) < x / x.max()).astype(float)
        at, n = np.unique(x), [np.sum(x == v) for v in np.unique(x)]
        s = [y[x == v].sum() for v in at]
        mean = lambda a, b: sum(s[a : b + 1]) / sum(n[a : b + 1])
        want = [max(min(mean(a, b) for b in range(i, len(at))) for a in range(i + 1)) for i in range(len(at))]
        knots = T.isotonic(x, y)
        assert np.allclose(np.interp(at, *knots), want)


def plain_cells(data):
    """Cells of the n-grams, one by one."""
    folded = [c if c >= 128 else (c | 32 if 65 <= c <= 90 or 97 <= c <= 122 else 32) for c in data]
    out = set()
    for n in (1, 2, 3):
        for i in range(len(folded) - n + 1):
            h = n
            for c in folded[i : i + n]:
                h = ((h ^ c) * 0x9E3779B1) % 2**32
                h ^= h >> 15
            out.add(h >> 17)
    return out


def test_language_kernel_equals_plain_loops():
    r = random.Random(8)
    texts = [b"", b"a", b"A1", "the quick brown fox é".encode(), "日本語".encode()] + [bytes(r.randrange(256) for _ in range(300)) for _ in range(4)]
    for t in texts:
        assert L.grams(t).tolist() == sorted(plain_cells(t))
    words = {"en": "the of and to in that was his with for".split(), "de": "der die und das nicht ein ist mit auf für".split(), "fr": "le les des est dans une pour que qui sur".split()}
    data = [(c, " ".join(r.choice(words[c]) for _ in range(30))) for c in words for _ in range(40)]
    sets, langs = [L.grams(t.encode()) for _, t in data], [c for c, _ in data]
    model = L.Model(sets, langs, per_class=6)
    marks = [[s for s, y in zip(sets, langs) if y == c][:6] for c in model.langs]
    marks = [set(s.tolist()) for group in marks for s in group]
    kernel = lambda a, b: len(a & b) / math.sqrt(max(1, len(a)) * max(1, len(b)))
    some = [plain_cells(t) for t in (b"the of and", "der die für".encode(), b"les des une", b"", b"\xff\xfe" * 50_000, ("und das " * 200_000).encode())]
    k = np.array([[kernel(s, m) for m in marks] for s in some])
    assert np.allclose(model.kernel([np.array(sorted(s), np.int64) for s in some]), k, atol=1e-5)
    landmark = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(landmark)
    root = vectors / np.sqrt(np.maximum(values, 1e-6 * values.max())) @ vectors.T
    phi = np.array([[kernel(set(s.tolist()), m) for m in marks] for s in sets]) @ root
    y = np.where(np.array(langs)[:, None] == np.array(model.langs), 1.0, -1.0)
    w = np.linalg.solve(phi.T @ phi + 0.01 * len(sets) / len(marks) * np.eye(len(marks)), phi.T @ y)
    margin = 4 * (k @ root @ w)
    best, score = model.predict([np.array(sorted(s), np.int64) for s in some])
    assert [model.langs[i] for i in best[[0, 1, 2, 5]]] == ["en", "de", "fr", "de"]
    assert np.allclose(score, [math.exp(m[i]) / np.exp(m).sum() for m, i in zip(margin, best)], atol=1e-2)
    assert (best == margin.argmax(1)).all()


def test_training_rows_are_bounded_for_repeated_ids(spark, monkeypatch):
    """20 ids over many rows: no more rows are learned than the parameter says, and the same ones each time."""
    sizes = []
    monkeypatch.setattr(L, "Model", lambda sets, langs: sizes.append((len(sets), sorted(set(langs)), [s.tolist() for s in sets])))
    rows = [(i % 20, f"wort {i} eins zwei" if i % 2 else f"word {i} one two", "de" if i % 2 else "en") for i in range(4000)]
    df = spark.createDataFrame([*rows, *rows], "doc_id long, text string, lang string").repartition(4)
    L.fit(df, per_lang=30)
    L.fit(df.repartition(7), per_lang=30)
    assert sizes[0][:2] == (60, ["de", "en"]) and sizes[0] == sizes[1]

    seen = []
    monkeypatch.setattr(T, "_count", lambda rows: seen.append(rows.count()) or {})
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(20)], "doc_id long, toxic int, quality int")
    T.fit(df, labels, most=5)
    assert seen[0] <= 10
