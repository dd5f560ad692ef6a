import hashlib
import math
from collections import Counter

from tests.oracle import connect, rows_of, rows_of_sql
from tidelog.llm import mixing, queries


def expected_counts(rows, weights=None, seed=17):
    sizes = Counter(r.source or "" for r in rows)
    w = {s: (math.sqrt(n) if weights is None else weights.get(s, 0.0)) for s, n in sizes.items()}
    total = sum(w.values())
    rates = {s: round(min(8.0, w[s] * len(rows) / total / n), 3) for s, n in sizes.items()}
    out = Counter()
    for r in rows:
        rate, u = rates[r.source or ""], int(hashlib.md5(f"{seed}:{'null' if r.doc_id is None else r.doc_id}:count".encode()).hexdigest()[:13], 16) / 2**52
        k, term = 0, math.exp(-rate)
        cdf = term
        while cdf <= u and k < 100:
            k += 1
            term *= rate / k
            cdf += term
        out[r.doc_id, r.text] += k
    return +out


def test_counts(odd, nothing, documents):
    for df in (odd, documents):
        mixed = mixing.poisson_mix(df)
        assert Counter((r.doc_id, r.text) for r in mixed.collect()) == expected_counts(df.collect())
    assert mixing.poisson_mix(nothing).count() == 0


def test_clashing_columns_stay(odd):
    mixed = mixing.poisson_mix(odd)
    assert mixed.columns == [*odd.columns, "mix_copy", "n_copies", "shuffle_key"] and {r.copy for r in mixed.collect()} == {"own"}


def test_weights(spark, documents):
    rows = documents.collect()
    weights = {"src0": 3.0, "src1": 1.0}
    mixed = mixing.poisson_mix(documents, weights=weights, size=40).collect()
    assert {r.source for r in mixed} <= set(weights)
    n = Counter(r.source for r in rows)
    rate = min(8.0, 3 * 40 / 4 / n["src0"])
    got = sum(r.source == "src0" for r in mixed)
    assert abs(got - rate * n["src0"]) < 6 * math.sqrt(rate * n["src0"]) + 1


def test_quantile_table_is_exact():
    steps = mixing.poisson_steps(1.5)
    cdf = [sum(math.exp(-1.5) * 1.5**i / math.factorial(i) for i in range(k + 1)) for k in range(12)]
    assert all(abs(s / 2**52 - c) < 1e-12 for s, c in zip(steps, cdf, strict=False)) and mixing.poisson_steps(0.0)[0] == 2**52


def test_sql(spark, sf):
    name = "op6_poisson_mixing"
    assert rows_of(queries.QUERIES[name](spark, sf)) == rows_of_sql(connect(sf), queries.ORACLE_SQL[name])
