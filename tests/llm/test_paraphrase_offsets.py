"""Paraphrases are found with the production thresholds wherever the copy starts."""

import random

import numpy as np

from chainlake.llm import leaks


def test_copies_at_every_offset(spark):
    item = [f"word{chr(97 + k)}" for k in range(26)]
    item = [w[4:] * 3 for w in item]
    item[1], item[24] = "k222", "nyx5"  # figures at both ends
    copy = ["roughly" if k in (8, 17) else w for k, w in enumerate(item)]
    wrong = ["k223" if w == "k222" else w for w in copy]
    rows = [(n, " ".join(["before"] * n + copy + ["after"] * 30)) for n in range(13)] + [(100 + n, " ".join(["before"] * n + wrong + ["after"] * 30)) for n in range(13)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = leaks.leaking_documents(docs, spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.kind) for r in got) == [(n, "paraphrase") for n in range(13)]


def _words(rng, n, vocabulary):
    return [rng.choice(vocabulary) for _ in range(n)]


def _changed(rng, w):
    """A paraphrase: some words replaced, dropped or added, figures kept."""
    out = []
    for x in w:
        r = rng.random()
        if x[-1].isdigit() or r > 0.2:
            out.append(x)
        elif r > 0.1:
            out.append(rng.choice(["roughly", "about", "then"]))
        if r < 0.04:
            out.append("also")
    return out


def test_paraphrase_recall_against_brute_force(spark):
    rng = random.Random(12)
    vocabulary = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(500)]
    items = [(k, [x + str(k) if rng.random() < 0.08 else x for x in _words(rng, rng.randrange(14, 60), vocabulary)]) for k in range(40)]
    documents = []
    for d in range(160):
        body = _words(rng, rng.randrange(20, 250), vocabulary + ["other", "the"] * 40)
        if d % 2:
            w = items[rng.randrange(40)][1]
            at = rng.randrange(len(body))
            body[at:at] = _changed(rng, w)
        documents.append((d, body))
    got = leaks.leaking_documents(
        spark.createDataFrame([(d, " ".join(b)) for d, b in documents], "doc_id bigint, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")
    ).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    every = leaks.Items([(i, " ".join(w)) for i, w in items], 13)
    want = set()  # every passage of every item against the surroundings of every passage of every document
    for d, b in documents:
        terms = np.array([every.vocabulary.get(x, -1) for x in b])
        for s, e in leaks.windows(len(terms), 13):
            around = terms[max(0, s - 13) : e + 13]
            for p, o in zip(every.passages, every.owner, strict=True):
                if len(np.intersect1d(p, around)) and all(x in around for x in p[every.answer[p]]) and leaks.common_subsequence(around, p) >= 0.7 * len(p):
                    want.add((d, int(every.ids[o])))
    assert len(want) > 50
    assert found <= want
    assert len(found) >= 0.9 * len(want)


def test_items_do_not_depend_on_each_other(spark):
    long = [f"q{chr(97 + k)}z" for k in range(15)]
    copy = [x for k, x in enumerate(long) if k not in (4, 9, 12)]  # 12 of the 15 words, in order
    docs = spark.createDataFrame([(1, " ".join(["before"] * 40 + copy + ["after"] * 40)), (2, "nothing at all")], "doc_id bigint, text string")
    for others in ([], [(2, "an item of eight words on other things")]):
        got = leaks.leaking_documents(docs, spark.createDataFrame([(1, " ".join(long)), *others], "item_id bigint, text string")).collect()
        assert [(r.doc_id, r.item_id, r.kind) for r in got] == [(1, 1, "paraphrase")]


def test_blocks_of_items_share_one_space(spark):
    rng = random.Random(5)
    vocabulary = [f"v{k}" for k in range(300)]
    items = [(k, " ".join(_words(rng, 40, vocabulary))) for k in range(12)]
    docs = [(k, " ".join(_words(rng, 60, vocabulary) + items[k % 12][1].split()[:30] + _words(rng, 60, vocabulary))) for k in range(30)]
    tables = (spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    one, many = (sorted(tuple(r) for r in leaks.leaking_documents(*tables, block_items=n).collect()) for n in (2000, 5))
    assert len(one) >= 30
    assert [r[:2] + r[3:] for r in one] == [r[:2] + r[3:] for r in many]
    assert np.allclose([r[2] for r in one], [r[2] for r in many], atol=2e-4)


def test_subsequences_of_many_pairs():
    rng = np.random.default_rng(2)
    a, b = rng.integers(-1, 6, (200, 12)), rng.integers(0, 6, (200, 7))
    assert leaks.common_subsequences(a, b).tolist() == [leaks.common_subsequence(x, y) for x, y in zip(a, b, strict=True)]
