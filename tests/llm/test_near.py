import random

import numpy as np

import corpus_pipeline
from tests.llm.conftest import DOCS
from tidelog.llm import near


def text(seed, n=200, edits=()):
    words = [f"w{seed}x{i}" for i in range(n)]
    for k in edits:
        words[k] = f"new{k}"
    return " ".join(words)


def kept(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS).repartition(5)
    return corpus_pipeline.drop_near_duplicates(spark, docs, "")


def test_edited_copies_go_and_others_stay(spark):
    """An edit changes five of 196 shingles: 3 edits give 0.86, 12 give 0.53."""
    rows = [(1, text(1)), (2, text(1, edits=(30, 90, 150))), (3, text(2)), (4, text(2, edits=range(5, 185, 15))), (5, text(3))]
    assert near.similarity(near.shingles(near.normal(rows[0][1])), near.shingles(near.normal(rows[1][1]))) > 0.8
    assert sorted(r.doc_id for r in kept(spark, rows).collect()) == [1, 3, 4, 5]


def test_a_large_group_of_near_copies_is_one(spark):
    rows = [(i, text(7, edits=(i % 200, (i * 7) % 200))) for i in range(1, 300)] + [(1000, text(8))]
    assert sorted(r.doc_id for r in kept(spark, rows).collect()) == [1, 1000]


def test_repeated_and_null_ids(spark):
    """Rows with one id and different texts all stay, whatever the task order; rows without an id are deduplicated too."""
    rows = [(1, text(1)), (1, text(2)), (1, text(1)), (None, text(3)), (None, text(3)), (None, text(2)), (2, text(3, edits=(9,)))]
    out = [(r.doc_id, r.text) for r in kept(spark, rows).collect()]
    assert sorted(out) == sorted([(1, text(1)), (1, text(2)), (2, text(3, edits=(9,)))])
    nulls = [(None, text(4)), (None, text(4))]
    assert [(r.doc_id, r.text) for r in kept(spark, nulls).collect()] == [(None, text(4))]


def test_against_all_pairs(spark):
    """Texts of shared words and many edits: the rows that stay are one of each component of the exact pairs, for pairs that are candidates."""
    rng = random.Random(2)
    rows, base = [], [[f"w{rng.randrange(400)}" for _ in range(rng.randint(90, 250))] for _ in range(12)]
    for i in range(240):
        words = list(base[i % 12])
        for _ in range(rng.randint(0, 7)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(50)}"
        rows.append((i, " ".join(words)))
    cut = [near.shingles(near.normal(t)) for _, t in rows]
    hashes = near.WordHashes()
    fps = np.array([near.word_fingerprints(near.normal(t), hashes) for _, t in rows])
    to, true, met = list(range(len(rows))), 0, 0

    def root(i):
        while to[i] != i:
            i = to[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if near.similarity(cut[i], cut[j]) >= near.SIMILAR:
                candidate = bool((np.bitwise_count(fps[i] ^ fps[j]) <= near.RADIUS).any())
                true, met = true + 1, met + candidate
                if candidate:
                    a, b = sorted((root(i), root(j)))
                    to[b] = a
    assert true > 300 and met / true > 0.95
    assert sorted(r.doc_id for r in kept(spark, rows).collect()) == sorted({root(i) for i in range(len(rows))})


def test_bound_rules_out_no_similar_pair():
    """Pairs of every similarity around the threshold, short, empty and long texts: what is ruled out is below it, and much is."""
    rng = random.Random(5)
    cut = [near.shingles(near.normal(t)) for t in ("", "one two", text(0, 3000), text(0, 3000, range(0, 600, 20)))]
    for n in (6, 60, 300):
        cut += [near.shingles(near.normal(text(n, n, [rng.randrange(n) for _ in range(k)]))) for k in range(12)]
    size, bits = np.array([len(c) for c in cut]), np.array([near.sketch(c) for c in cut])
    i, j = (x.ravel() for x in np.indices((len(cut), len(cut))))
    may = near.may_be_similar(size, bits, i, j)
    similar = np.array([near.similarity(cut[a], cut[b]) >= near.SIMILAR for a, b in zip(i, j, strict=True)])
    assert not (similar & ~may).any() and similar.sum() > len(cut) and (~similar & ~may).sum() > 0.8 * (~similar).sum()
