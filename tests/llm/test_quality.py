from collections import Counter

import numpy as np

from tidelog.llm import quality


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(0)
    k = len(quality.LABELLERS)
    truth = rng.random(6000) < 0.7
    accuracy = np.array([0.9, 0.85, 0.8, 0.75, 0.95, 0.7] + [0.8] * (k - 6))
    patterns = Counter()
    for t in truth:
        patterns["".join("-" if rng.random() < 0.3 else "bg"[int(t if rng.random() < a else not t)] for a in accuracy)] += 1
    model = quality.fit_label_model(patterns)
    assert np.abs(np.array(list(model.accuracies().values())) - accuracy).max() < 0.05 and abs(model.prior[1] - 0.7) < 0.05
    assert quality.fit_label_model({}).posterior("g" * k) == 0.5


def test_held_out_accuracy(spark, sf, documents):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = quality.quality_report(documents).collect()
    assert len(rows) == documents.count()
    right = [(r.keep, labels[r.doc_id] == 1) for r in rows if r.doc_id in labels]
    assert np.mean([a == b for a, b in right]) > 0.97 and all(a for a, b in right if b)


def test_odd_rows(odd, nothing):
    rows = quality.quality_report(odd).collect()
    assert len(rows) == odd.count() and not any(r.keep for r in rows if r.doc_id in (3, 4, 5))
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and {1, 2, 6, 7} <= {r.doc_id for r in kept.collect()}
    assert quality.quality_report(nothing).count() == 0


def plain_em(patterns, rounds):
    """The posterior of each document by expectation-maximisation document by document, with the documented beliefs."""
    k = len(quality.LABELLERS)
    good = [(p.count("g") + 1) / (p.count("g") + 3 * p.count("b") + 2) for p in patterns]
    for _ in range(rounds):
        prior = [sum(1 - x for x in good) + quality.CLASSES_BEFORE[0], sum(good) + quality.CLASSES_BEFORE[1]]
        seen = [[{v: quality.VOTES_BEFORE[c]["bg-".index(v)] for v in "bg-"} for c in range(2)] for _ in range(k)]
        for p, x in zip(patterns, good, strict=True):
            for j, v in enumerate(p):
                seen[j][0][v] += 1 - x
                seen[j][1][v] += x
        out = []
        for p in patterns:
            odds = [prior[c] / sum(prior) for c in range(2)]
            for c in range(2):
                for j, v in enumerate(p):
                    odds[c] *= seen[j][c][v] / sum(seen[j][c].values())
            out.append(odds[1] / sum(odds))
        good = out
    return good


def test_label_model_against_plain_em():
    rng = np.random.default_rng(1)
    truth = rng.random(300) < 0.6
    patterns = ["".join("-" if rng.random() < 0.4 else "bg"[int(t if rng.random() < 0.8 else not t)] for _ in quality.LABELLERS) for t in truth]
    model = quality.fit_label_model(Counter(patterns))
    want = plain_em(patterns, quality.ROUNDS)
    assert max(abs(model.posterior(p) - x) for p, x in zip(patterns, want, strict=True)) < 1e-6


def test_labellers_overlap(documents):
    """Every kind of junk is seen by two labellers or more, and most texts get three votes."""
    seen = Counter(quality.votes(quality.facts(r.text or "", (r.text or "").split())) for r in documents.collect())
    assert all(p.count("b") >= 2 for p in seen if "b" in p)
    assert sum(n for p, n in seen.items() if len(p) - p.count("-") >= 3) > 0.9 * sum(seen.values())


def test_a_column_of_that_name(spark, documents):
    own = documents.limit(50).selectExpr("*", "'mine' as quality_result", "1 as quality_result_0")
    kept = quality.keep_good(own)
    assert kept.columns == own.columns and {r.quality_result for r in kept.collect()} == {"mine"}


def test_copies_do_not_fill_the_sample(spark):
    """A third of the rows are one text without an id: it is drawn once."""
    rows = [(None, "The same text. Again and again, it is said here.", "en", "a", 1)] * 500 + [(i, f"Text {i} is a sentence of its own, number {i}.", "en", "a", 1) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert all(r.keep for r in quality.quality_report(docs).collect())
