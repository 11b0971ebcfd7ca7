import random
from collections import Counter

import numpy as np

from scoreloom.llm import decontaminate as dc
from scoreloom.llm.words import shingle_hashes, word_hashes, words


def test_multi_index_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(0)
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 500, 20))) for i in range(40)]
    weights, rare = dc.shingle_weights(items)
    index = dc.Index(items, weights, rare)
    f = index.prints[rng.integers(0, 40, 300)].copy()
    for i in range(len(f)):
        for b in rng.choice(64, rng.integers(0, 22), replace=False):
            f[i] ^= np.uint64(1) << np.uint64(b)
    want = {(w, i) for w in range(len(f)) for i in range(40) if int(f[w] ^ index.prints[i]).bit_count() <= dc.RADIUS}
    assert set(zip(*map(lambda a: a.tolist(), index.near(20, f)))) == want


def brute(items, text, least, k=5):
    """Best weighted similarity of every window of an item's length."""
    weights, rare = dc.shingle_weights(items, k)
    h = word_hashes(words(text))
    out = {}
    for i, t in items:
        ih = word_hashes(words(t))
        mine = Counter(shingle_hashes(ih, k).tolist())
        for p in range(len(h) - len(ih) + 1) if len(ih) else ():
            other = Counter(shingle_hashes(h[p : p + len(ih)], k).tolist())
            up = sum(weights.get(x, rare) * min(mine[x], other[x]) for x in mine | other)
            down = sum(weights.get(x, rare) * max(mine[x], other[x]) for x in mine | other)
            if up / down >= least:
                out[i] = max(out.get(i, 0), up / down)
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([2, 4, 5, 14, 20, 40])))) for i in range(30)] + [(90, ""), (91, None)]
    rows = []
    for d in range(60):
        text = rng.choices(vocab, k=rng.randrange(0, 120))
        if d % 2:
            leak = (rng.choice(items[:30])[1]).split()
            if d % 3 == 0 and len(leak) > 30:
                leak[-1] = "changed"
            text[10:10] = leak
        rows.append((d, "  ".join(text)))
    rows += [(60, None), (61, ""), (None, items[5][1])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for r in dc.leaks(docs, bench).collect():
        got.setdefault(r.doc_id, {})[r.item_id] = round(r.similarity, 9)
    clean = [(i, t or "") for i, t in items]
    want = {d: {i: round(s, 9) for i, s in brute(clean, t or "", 0.8).items()} for d, t in rows}
    assert got == {d: w for d, w in want.items() if w}
    kept = {r.doc_id for r in dc.without_leaks(docs, bench).collect()}
    assert kept == {d for d, w in want.items() if not w}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert dc.leaks(docs.limit(0), bench).count() == 0
    assert dc.leaks(docs, bench.limit(0)).count() == 0
    assert dc.without_leaks(docs, bench.limit(0)).count() == 1


def test_documents_shorter_than_an_item(spark):
    rng = random.Random(9)
    items = [(i, " ".join(f"v{rng.randrange(400)}" for _ in range(n))) for i, n in enumerate([59, 59, 20, 6, 5, 3])]
    texts = [" ".join(items[0][1].split()[:58]), " ".join(items[0][1].split()[4:]), " ".join(items[1][1].split()[:30]), " ".join(items[2][1].split()[1:19]), " ".join(items[3][1].split()[:5]), "v1"]
    weights, rare = dc.shingle_weights(items)
    want = {}
    for d, text in enumerate(texts):
        mine = Counter(shingle_hashes(word_hashes(words(text)), 5).tolist())
        for i, t in items:
            n = len(text.split())
            if n < len(t.split()):
                other = Counter(shingle_hashes(word_hashes(words(t)), 5).tolist())
                up, down = (sum(weights.get(x, rare) * f(mine[x], other[x]) for x in mine | other) for f in (min, max))
                if up / down >= 0.8:
                    want[d, i] = (round(up / down, 9), 0, n, 1)
    assert {d for d, _ in want} == {0, 1, 3}
    docs, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start_word, r.n_words, r.n_windows) for r in dc.leaks(docs, bench).collect()}
    assert got == want
    assert {r.doc_id for r in dc.without_leaks(docs, bench).collect()} == {2, 4, 5}


def test_edits_near_the_least_similarity_are_found():
    rng = random.Random(2)
    items = [(i, " ".join(f"v{rng.randrange(3000)}" for _ in range(n))) for i, n in enumerate([60, 100, 104, 150] * 10)]
    # Parts that many items share weigh less than the rest.
    items = [(i, "a b c d e f g h i j k l m n o p q r s t " + t if i % 2 else t) for i, t in items]
    index = dc.Index(items, *dc.shingle_weights(items))
    missed = tried = 0
    for i, t in items:
        ws = t.split()
        for _ in range(400):
            if tried >= 2000:
                break
            new = list(ws)
            for p in rng.sample(range(len(ws)), rng.randrange(1, 4)):
                new[p] = f"new{rng.random()}"
            window = Counter(shingle_hashes(word_hashes(words(" ".join(new))), 5).tolist())
            if 0.8 <= index.similarity(window, i) <= 0.85:
                tried += 1
                found = {m[0]: m for m in index.matches("x y z " + " ".join(new) + " u v w", 0.8)}
                missed += i not in found or abs(found[i][1] - index.similarity(window, i)) > 1e-9 and found[i][1] < index.similarity(window, i)
    assert tried > 500 and missed == 0
