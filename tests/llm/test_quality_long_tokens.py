import numpy as np

from tidelog.llm import quality


def test_all_of_a_long_token_counts():
    head, tail = "a" * 64, "b" * 64
    assert quality._slot("w:" + tail) in quality.features(head + tail)
    weights = np.zeros(quality.DIMENSIONS, np.float32)
    weights[quality._slot("w:" + tail)] = 4
    score = quality.make_scorer(weights, 0.0)
    facts = quality.facts(head, [head])
    assert score("", [head + tail], facts) > score("", [head + "c" * 64], facts)
    assert quality.pieces(["x", head]) == ["x", head]
