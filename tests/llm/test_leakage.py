import random

import numpy as np

from swaplens.llm import leakage

RNG = random.Random(11)
VOCABULARY = [a + b + c for a in ("bra", "klo", "mip", "tur", "wex", "zan", "dof", "gel") for b in ("lo", "mi", "ra", "su", "ve") for c in ("n", "st", "rd", "x", "l")]
COMMON = "the of and to in a is that for it was on with as by at from".split()


def sentence(n):
    return " ".join(RNG.choice(VOCABULARY) if k % 2 else RNG.choice(COMMON) for k in range(n))


ITEMS = [(i, sentence(60), "answer", "x") for i in range(30)] + [(30, None, None, "x"), (31, "too short", None, "x"), (32, sentence(12), None, "x")]
INSTRUCTION = "Read the passage with care and then answer in one short phrase only. "
ITEMS = [(i, INSTRUCTION + t if t and 0 <= i < 20 else t, a, x) for i, t, a, x in ITEMS]


def documents():
    text = {i: t for i, t, _, _ in ITEMS if t}
    words = {i: t.split() for i, t in text.items()}
    filler = lambda: " ".join(f"plain{RNG.randrange(400)}" if k % 2 else RNG.choice(COMMON) for k in range(80))
    noisy = words[5][20:48]
    noisy[4], noisy[11], noisy[17] = "other", noisy[11][:-1] + "q", "thing"
    docs = [(k, filler()) for k in range(60)]
    docs += [(100, filler() + " " + text[3] + " " + filler()), (101, " ".join(words[4][20:46]).upper().replace(" ", ",  ")), (102, filler() + " " + " ".join(noisy)), (103, "<p>" + " <b>x</b> ".join([" ".join(words[6][15:40])]) + "</p>"), (104, text[32]), (105, filler() + text[7] + filler() + " " + text[8])]
    docs += [(200, " ".join(words[9][20:30]) + " " + filler()), (201, INSTRUCTION * 3), (202, sentence(200)), (203, None), (204, ""), (205, filler() * 400), (101, " ".join(words[4][20:46]))]
    return docs


def test_leaks(spark):
    docs = spark.createDataFrame(documents(), "doc_id long, text string").repartition(3).selectExpr("*", "1 matched")
    evals = spark.createDataFrame(ITEMS, "item_id long, text string, answer string, codes string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaked(leakage.candidates(docs, "doc_id", "text", evals, "item_id", "text", "answer")).collect()}
    assert got == {(100, 3), (101, 4), (102, 5), (103, 6), (104, 32), (105, 7), (105, 8)}


def test_empty_tables(spark):
    docs = spark.createDataFrame(documents()[:5], "doc_id long, text string")
    evals = spark.createDataFrame(ITEMS[:3], "item_id long, text string, answer string, codes string")
    for d, e in ((docs.limit(0), evals), (docs, evals.limit(0)), (docs, evals.where("item_id > 99"))):
        assert leakage.candidates(d, "doc_id", "text", e, "item_id", "text", "answer").count() == 0


def by_hand(words, item):
    """The best local alignment, cell by cell: its score."""
    score = [[0.0] * (len(item) + 1) for _ in range(len(words) + 1)]
    for i, w in enumerate(words, 1):
        for j, x in enumerate(item, 1):
            score[i][j] = max(0.0, score[i - 1][j - 1] + (1.0 if w == x else -1.2), score[i - 1][j] - 0.8, score[i][j - 1] - 0.8)
    return max(max(row) for row in score)


def path_score(path):
    """The score of a path of matches: what lies between two matches is replaced as far as it can be, else dropped."""
    total = float(len(path))
    for (i, j), (k, m) in zip(path, path[1:], strict=False):
        a, b = k - i - 1, m - j - 1
        total -= 1.2 * min(a, b) + 0.8 * abs(a - b) if min(a, b) else 0.8 * (a + b)
    return total


def test_alignments_match_brute_force():
    pairs = [([RNG.randrange(6) for _ in range(RNG.randrange(1, 25))], [RNG.randrange(6) for _ in range(RNG.randrange(1, 20))]) for _ in range(200)]
    texts, items = [np.array([[c, -1] for c in w], np.int32) for w, _ in pairs], [np.array(x) for _, x in pairs]
    for (w, x), score, path in zip(pairs, leakage.best_scores(texts, items), leakage.paths(texts, items), strict=True):
        assert abs(score - by_hand(w, x)) < 1e-3
        assert all(w[i] == x[j] for i, j in path) and sorted(path) == path
        assert abs(path_score(path) - score) < 1e-3


def test_the_latent_vectors_are_those_of_the_matrix():
    rng = np.random.default_rng(3)
    matrix = rng.standard_normal((300, 60)) @ np.diag(np.r_[20.0, 12.0, 9.0, 7.0, np.full(56, 0.05)])
    gram = matrix.T @ matrix
    test = np.linalg.qr(rng.standard_normal((60, 12)))[0]
    vectors, values = leakage.nystroem(gram @ test, test, 4)
    want = np.linalg.svd(matrix)
    assert np.allclose(values, want[1][:4], rtol=0.01)
    assert np.allclose(np.abs((vectors * want[2][:4].T).sum(0)), 1.0, atol=0.01)


def spoilt(part, kind, k, others):
    part = list(part)
    for at in RNG.sample(range(1, len(part) - 1), 4):
        part[at] = {"unseen": f"unseen{k}x{at}", "other": RNG.choice(others), "misspelt": part[at][:-1] + "q" if len(part[at]) > 3 else part[at]}[kind]
    return part


def test_changed_words_do_not_hide_a_passage_in_a_large_corpus(spark):
    """Passages of 24 words with four of them replaced by new words or words of other items, or misspelt."""
    rows = [(i, t, a) for i, t, a, _ in ITEMS]
    others = [w for _, t, _ in rows if t for w in t.split()]
    texts, want = documents(), set()
    for k in range(90):
        i = RNG.randrange(20, 30)
        part = spoilt(ITEMS[i][1].split()[10 + k % 20 :][:24], ("unseen", "other", "misspelt")[k % 3], k, others)
        texts.append((300 + k, " ".join(f"plain{n}" for n in range(40)) + " " + " ".join(part)))
        want.add((300 + k, i))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    items = leakage.prepare_items(rows)
    gathered = leakage.gather(docs, "doc_id", "text", items)
    for million in (False, True):
        items = leakage.with_weights(items, gathered)
        if million:  # as if each word of the items were in 20,000 times as many documents
            counts = gathered.where("kind = 'count' and code >= 0").groupBy("code").sum("n").toPandas()
            many = np.zeros(items.size)
            many[counts["code"]] = counts["sum(n)"] * 20_000
            items = leakage.weighted(items, many, len(texts) * 20_000)
        items = leakage.build_index(items, leakage.latent_basis(gathered, items)[0])
        found = leakage.search(gathered, items)
        got = {(r.doc_id, r.item_id) for r in found.collect()}
        assert len(got & want) >= 0.97 * len(want)
        got = {(r.doc_id, r.item_id) for r in leakage.leaked(found).collect()}
        assert len(got & want) >= 0.9 * len(want)


def test_the_index_finds_what_all_pairs_give():
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(VOCABULARY, 90)) for _ in range(400)]
    items = leakage.prepare_items([(i, t, None) for i, t in enumerate(texts)])
    items = leakage.weighted(items, np.full(items.size, 3.0), 1000)
    items = leakage.build_index(items, np.linalg.qr(rng.standard_normal((items.size, 64)))[0])
    queries = items.windows[rng.permutation(len(items.windows))[:300]] + 0.03 * rng.standard_normal((300, 64)).astype(np.float32)
    queries /= np.linalg.norm(queries, axis=1, keepdims=True)
    pairs = lambda probes: set(zip(*(x.tolist() for x in leakage.nearest_items(queries, items, 0.65, probes)[:2]), strict=True))
    exact = pairs(len(items.centres))
    assert len(pairs(leakage.PROBES) & exact) >= 0.9 * len(exact) > 0


def test_every_connected_passage_is_judged(spark):
    filler = " ".join(f"plain{k}" for k in range(40))
    words = {i: ITEMS[i][1].split() for i in (21, 22, 23, 25)}
    words[24] = [f"{VOCABULARY[k * 7 % len(VOCABULARY)]}{k}" for k in range(75)]
    loose = [w if k % 5 < 3 else f"other{k}" for k, w in enumerate(words[24][:45])]
    items = [(i, " ".join(w), None) for i, w in words.items()]
    items.append((26, " ".join(f"w{k}" for k in range(75)), None))
    left_out = [f"w{k}" for k in range(75) if not 25 <= k < 47]
    replaced = [f"w{k}" if not 28 <= k < 47 else f"new{k}" for k in range(75)]
    docs = [(k, filler) for k in range(40)]
    docs += [(100, " ".join([filler, *left_out, filler])), (101, " ".join([filler, *replaced, filler]))]
    docs += [(102, " ".join([filler, *loose, filler, filler, filler, filler, *words[24][50:70], filler]))]
    docs += [(103, " ".join([filler, *loose, filler]))]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    evals = spark.createDataFrame(items, "item_id long, text string, answer string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaked(leakage.candidates(docs, "doc_id", "text", evals, "item_id", "text", "answer")).collect()}
    assert got == {(100, 26), (101, 26), (102, 24)}
