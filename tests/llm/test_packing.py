import gc
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidelog.llm import packing, wordbpe


def expected(rows, length=4096):
    t = Tokenizer.from_file(packing.default_tokenizer())
    out = []
    for r in rows:
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), length)):
            own = np.array(ids[a : a + length], "<u4")
            out.append((r.doc_id, k, a, len(own), zlib.crc32(own.tobytes())))
    return sorted(out, key=repr)


def check(df, **options):
    rows = packing.pack_documents(df, **options).collect()
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == expected(df.collect(), **options)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]] and sum(n for _, n in own) <= options.get("length", 4096)
    return len(places), sum(r.length for r in rows)


def test_rows(odd, nothing, documents):
    check(odd)
    check(odd, length=16)
    sequences, ids = check(documents)
    assert sequences <= -(-ids // 4096) + 1
    assert packing.pack_documents(nothing).count() == 0


def test_ids_are_those_of_the_library():
    t = packing._tokenizer(packing.default_tokenizer())
    texts = ["İI ſt ŉ Ω'S don'T 'LL''d x\x85y a b ​ ć <|startoftext|><|endoftext|> 12.5½ " + chr(c) * 3 for c in range(1, 0x3000, 37)]
    assert list(t.ids(texts)) == t.whole(texts)


def test_every_plain_character_and_its_neighbours():
    """Each character alone, doubled, and next to a letter, a digit and a sign; then random Latin words."""
    t = packing._tokenizer(packing.default_tokenizer())
    plain = [c for c in map(chr, range(0x21, 0x250)) if wordbpe.PLAIN.match(c)]
    texts = [x for c in plain for x in (c, c + c, f"a{c}", f"{c}a", f"a{c}b", f"1{c}", f"{c}1", f"-{c}", f"{c}'s", f"é{c}ö", f"x{c}-{c}y")]
    assert len(plain) > 200 and list(t.ids(texts)) == t.whole(texts)
    rng = random.Random(5)
    texts = ["".join(rng.choice(plain + [" ", "'s"]) for _ in range(rng.randint(1, 60))) for _ in range(4000)] + ["un cœur simple, la sœur et l'œuvre: Bœuf manœuvre ŧŦ"]
    assert list(t.ids(texts)) == t.whole(texts)
    assert gc.isenabled()


def plain_best_two_fit(lengths, capacity):
    """Total lengths of the bins, by lists alone: greedy largest fit, then one piece against the best pair, again and again."""
    left, bins = sorted(lengths), []
    while left:
        own = []
        while True:
            fits = [x for x in left if x <= capacity - sum(own)]
            if not fits:
                break
            own.append(max(fits))
            left.remove(max(fits))
        while sum(own) < capacity and len(own) > 1 and left:
            small, room = min(own), capacity - sum(own) + min(own)
            pairs = [left[i] + left[j] for i in range(len(left)) for j in range(i) if small < left[i] + left[j] <= room]
            if not pairs:
                break
            i, j = next((i, j) for i in range(len(left)) for j in range(len(left)) if i != j and left[i] + left[j] == max(pairs))
            a, b = left[i], left[j]
            own.remove(small)
            own += [a, b]
            left.remove(a)
            left.remove(b)
            left = sorted([*left, small])
        bins.append(sum(own))
    return bins


@pytest.mark.parametrize("seed", range(8))
def test_against_plain_best_two_fit(seed):
    """Bins may differ where pairs tie, so the first bins' fill and the number of bins are compared."""
    rng = np.random.default_rng(100 + seed)
    lengths = rng.integers(1, 60, int(rng.integers(2, 60)))
    number, _ = packing.best_two_fit(lengths, 100)
    want = plain_best_two_fit(lengths.tolist(), 100)
    fill = np.bincount(number, lengths)
    assert fill[0] == want[0] and abs(len(fill) - len(want)) <= 1 and fill.sum() == sum(want)


@pytest.mark.parametrize("seed", range(6))
def test_best_two_fit(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(100, 1 + rng.geometric([0.02, 0.1, 0.5][seed % 3], int(rng.integers(1, 400))))
    number, offset = packing.best_two_fit(lengths, 100)
    fill = np.bincount(number, lengths)
    assert fill.max() <= 100 and set(number) == set(range(number.max() + 1))
    for k in range(number.max() + 1):
        own = np.flatnonzero(number == k)
        own = own[np.argsort(offset[own])]
        assert list(offset[own]) == [0, *np.cumsum(lengths[own])[:-1]]
    greedy = 0
    left = sorted(lengths, reverse=True)
    while left:
        gap, rest = 100, []
        for x in left:
            if x <= gap:
                gap -= x
            else:
                rest.append(x)
        left, greedy = rest, greedy + 1
    assert number.max() + 1 <= greedy


def test_the_swap_of_one_for_two():
    number, _ = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert sorted(np.bincount(number, [6, 3, 2, 2])) == [3, 10] and packing.best_two_fit(np.array([], int), 10)[0].size == 0


def test_small_shards(spark):
    pieces = spark.createDataFrame([(i, 1 + i % 50) for i in range(1000)], "id long, length long")
    rows = packing.pack_pieces(pieces, length=50, shard_pieces=100).collect()
    assert len(rows) == 1000 and len({r.sequence_id >> 32 for r in rows}) == 10
