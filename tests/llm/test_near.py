"""Near copies by five-word Jaccard similarity, against all pairs compared."""

import random

import corpus_pipeline
import pytest
from strandwork.llm import near, simhash
from strandwork.llm.shared import read


def brute(docs):
    """{id: smallest id reached} over links of similarity 0.8 or more (and between empty texts), for ids that reach a smaller one."""
    sets = []
    for i, text in docs:
        w = (text or "").lower().split()
        if i is not None:
            sets.append((i, {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    links = [(i, j) for k, (i, x) in enumerate(sets) for j, y in sets[:k] if i != j and (5 * len(x & y) >= 4 * len(x | y) if x and y else x == y)]
    root = {i: i for pair in links for i in pair}
    for _ in root:
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    return {i: r for i, r in root.items() if i != r}


def found(spark, docs):
    rows = near.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(r.id for r in rows) == sorted(i for i, _ in docs if i is not None)
    return {r.id: r.component for r in rows if r.id != r.component}


@pytest.mark.parametrize("share", [0.002, 0.3])
def test_near_copies(spark, share, monkeypatch):
    monkeypatch.setattr(near, "SHARE", share)
    monkeypatch.setattr(near, "OFTEN", 3 if share < 0.1 else 8)
    rng = random.Random(5)
    words = lambda n: [rng.choice("abcdefghijklmnop") * 2 for _ in range(n)]
    docs = []
    for _ in range(12):
        base = words(rng.choice([6, 30, 60, 200]))
        for _ in range(8):  # copies with some words changed or left out, so that similarities lie on either side of 0.8
            text = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                text[rng.randrange(len(text))] = rng.choice(["x", "y"])
            docs.append((len(docs), " ".join(text[: len(text) - rng.choice([0, 0, 1, 5])])))
    common = " ".join(words(15))
    docs += [(200 + k, common + " " + " ".join(words(4 + k))) for k in range(20)]
    docs += [(300, ""), (301, None), (302, "a b"), (303, "A  b"), (None, docs[0][1]), (5, docs[5][1]), (304, "a b c"), (304, docs[40][1])]
    want = brute(docs)
    assert len(set(want.values())) > 5 and want[303] == 302 and want[301] == 300
    assert found(spark, docs) == want
    assert found(spark, []) == {}


def test_stage_drops_what_fingerprints_keep(spark, sf):
    """Documents 177 and 145 of the smallest tables are copies (0.83) of 1 and 6, at 11 and 7 bits."""
    docs = read(spark, sf, "documents")
    root = brute([(r.doc_id, r.text) for r in docs.collect()])
    after = corpus_pipeline.without_near_copies(spark, docs, sf)
    assert after.columns == docs.columns
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in docs.collect() if r.doc_id not in root}
    assert root[177] == 1 and root[145] == 6


def test_stage_keeps_texts_of_one_id(spark, sf):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    rows = [(1, text(1), "b"), (1, text(1), "a"), (1, text(2), "a"), (2, text(3), "a"), (3, text(3), "a"), (None, text(3), "a"), (4, text(2), "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k1 string")
    got = corpus_pipeline.without_near_copies(spark, docs, sf).collect()
    assert sorted(map(tuple, got), key=str) == sorted([rows[1], rows[2], rows[3], rows[5]], key=str)


def test_hot_groups_are_broadcast(spark):
    rows = spark.createDataFrame([(k, k % 3) for k in range(90)] + [(99, 7)], "id long, fp long")
    groups = spark.createDataFrame([(0, 30, 5), (1, 30, 6), (2, 30, 7)], "fp long, n long, component long")
    want = sorted((k, k % 3 + 5) for k in range(90)) + [(99, None)]
    for hot in (10, 1000):
        got = simhash.with_groups(rows, groups, ["fp"], "n", hot)
        assert sorted((r.id, r.component) for r in got.collect()) == want
