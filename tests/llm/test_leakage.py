import random

import numpy as np

from quirework.llm import leakage as K


def _brute(docs, items, n):
    runs = {}
    for k, t in items:
        w = K.words_of(t)
        for i in range(len(w) - n + 1):
            runs.setdefault(tuple(w[i : i + n]), set()).add(k)
    return sorted({(d, k) for d, t in docs for w in [K.words_of(t)] for i in range(len(w) - n + 1) for k in runs.get(tuple(w[i : i + n]), ())})


def test_against_brute_force(spark, rows):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(60)}"
    items = [(i, " ".join(word() for _ in range(rng.randint(5, 60)))) for i in range(30)] + [(90, None), (91, ""), (92, "short one")]
    docs = []
    for d in range(150):
        w = [word() for _ in range(rng.randint(0, 120))]
        source = items[rng.randrange(30)][1].split()
        n = rng.choice((11, 12, 13, 14, 20))
        at = rng.randint(0, max(0, len(source) - n))
        cut = rng.randint(0, len(w))
        w[cut:cut] = source[at : at + n]
        docs.append((d, " ".join(w)))
    docs += [(500, None), (501, ""), (502, items[0][1].upper().replace(" ", "!<b> ") + "​"), (503, "x " * 5000)]
    items.append((93, items[0][1]))
    want = _brute(docs, items, 13)
    assert 30 < len(want)
    d = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id bigint, text string, item_id int")
    i = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id bigint, text string, doc_id int")
    assert sorted(rows(K.find_leaks(d, i))) == want
    assert sorted(rows(K.find_leaks(d, i, K.Settings(items=7)))) == want
    assert rows(K.find_leaks(d.limit(0), i)) == [] and rows(K.find_leaks(d, i.limit(0))) == []


def test_latent_axes_are_the_leading_ones(spark):
    s = K.Settings(features=64, rank=4, passage=4)
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a b", "c d", "e f"]) for _ in range(20)) for _ in range(60)]
    df = K.tokenised(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(5))
    weight = K.inverse_frequency(df, s)
    axes = K.latent_axes(df, weight, s, parts=4)
    deeper = K.latent_axes(df, weight, K.Settings(features=64, rank=4, passage=4, added=2), parts=4)
    assert np.allclose(abs((axes * deeper).sum(axis=0))[:3], 1, atol=1e-3)
    h = K.Hashes()
    rows = np.concatenate([K._blocks(K._slots(K.hashed(t, h), s), 4, 2) for t in texts])
    m = np.zeros((len(rows), 64))
    for r, line in zip(m, rows, strict=True):
        np.add.at(r, line, weight[line])
    _, _, right = np.linalg.svd(m, full_matrices=False)
    lost = m - m @ axes @ axes.T
    best = m - m @ right[:3].T @ right[:3]
    assert np.linalg.norm(lost) <= np.linalg.norm(best) * 1.05 + 1e-3


def test_passage_sums():
    s = K.Settings(features=32, rank=3, passage=4)
    drawn = np.random.default_rng(1).standard_normal((32, 3))
    docs = [np.array(x, np.uint32) for x in ([1, 2, 3, 4, 5, 6, 7], [8, 9], [1] * 4)]
    slots, sums = K._passage_sums(docs, drawn, s)
    want = []
    for h in docs:
        own = np.zeros((len(h), 3))
        for i in range(0, max(len(h) - 4, 0) + 1, 2):
            own[i : i + 4] += drawn[h[i : i + 4]].sum(axis=0)
        want.append(own)
    assert slots.tolist() == [x for h in docs for x in h.tolist()] and np.allclose(sums, np.concatenate(want))


def test_planted_paraphrases_at_every_offset_with_the_registered_parameters(spark, rows):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [words(rng.randint(45, 70)) for _ in range(26)]
    docs, want = [], set()
    for i, item in enumerate(items):
        said = list(item)
        for at in range(3, len(said), 9):  # a word in nine is another, some are swapped
            said[at] = rng.choice(vocabulary)
            if at % 2 and at + 2 < len(said):
                said[at + 1], said[at + 2] = said[at + 2], said[at + 1]
        docs.append((i, " ".join(words(i) + said + words(20))))
        want.add((i, i))
    docs += [(100 + i, " ".join(words(80))) for i in range(60)]
    docs += [(200, " ".join(words(9) + items[3][:14] + words(9))), (201, None), (202, ""), (203, "short"), (204, " ".join(items[5][:20]))]
    d = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id bigint, text string, item_id int")
    listed = [(i, " ".join(x)) for i, x in enumerate(items)] + [(80, ""), (81, None), (82, "short"), (83, " ".join(items[5][:20]))]
    i = spark.createDataFrame(listed, "item_id bigint, text string")
    got = {r[:2]: r[2] for r in rows(K.find_paraphrases(d, i))}
    exact = set(rows(K.find_leaks(d, i)))
    assert exact >= {(200, 3), (204, 5), (204, 83)} and {p for p in exact if got.get(p) != 1.0} == set()
    assert len(want & set(got)) >= 0.9 * len(want) and not {p for p in set(got) - want - exact if p[1] < 80}
    assert rows(K.find_paraphrases(d, i.limit(0))) == [] and rows(K.find_paraphrases(d.limit(0), i)) == []


def test_common_subsequence():
    a, b = np.array([1, 2, 3, 4, 5, 9]), np.array([2, 9, 4, 3, 5, 7, 9])
    assert K.common_subsequence(a, b) == 4 and K.common_subsequence(a, a) == 6 and K.common_subsequence(a, b[:0]) == 0
