import numpy as np
import pytest
import xxhash

from tidelog.llm import vptree
from tidelog.llm.graph import connected_components


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, radius=2):
    """Smallest id per fingerprint's component, by comparing all pairs."""
    fps = sorted({f for _, f in nodes})
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if bin(a ^ b).count("1") <= radius:
                parent[root(b)] = root(a)
    least = {}
    for i, f in nodes:
        if i is not None:
            least[root(f)] = min(least.get(root(f), i), i)
    return {f: least.get(root(f)) for f in fps}


def check(df):
    nodes = [(r.doc_id, plain_fingerprint(r.text)) for r in df.collect()]
    least = components(nodes)
    want = sorted(((i, f"{f:016x}", least[f]) for i, f in nodes), key=repr)
    assert sorted((tuple(r) for r in vptree.near_duplicates(df).collect()), key=repr) == want


def test_rows(odd, nothing, documents):
    check(odd)
    check(documents)
    assert vptree.near_duplicates(nothing).count() == 0


def clustered(n, seed):
    """Random fingerprints, chains of close ones, and one dense cluster."""
    rng = np.random.default_rng(seed)
    out = list(rng.integers(0, 1 << 63, n, dtype=np.uint64))
    for start in out[:20]:
        f = int(start)
        for _ in range(10):
            f ^= 1 << int(rng.integers(64))
            out.append(np.uint64(f))
    centre = int(out[0])
    for _ in range(n):
        f = centre
        for b in rng.integers(0, 64, int(rng.integers(1, 6))):
            f ^= 1 << int(b)
        out.append(np.uint64(f))
    return np.unique(np.array(out, np.uint64))


@pytest.mark.parametrize("sample", [0, 20, 400])
def test_no_pair_is_lost_by_the_tree(sample):
    fps = clustered(700, sample)
    nodes = vptree.build_tree(fps[:: max(1, len(fps) // sample)] if sample else fps[:0], len(fps), 8)
    shard, row, home = vptree.route(nodes, fps)
    assert sorted(row[home]) == list(range(len(fps)))
    homes = dict(zip(row[home].tolist(), shard[home].tolist(), strict=True))
    seen = set(zip(row.tolist(), shard.tolist(), strict=True))
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 2
    for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
        assert (i, homes[j]) in seen or (j, homes[i]) in seen
    assert np.bincount(np.unique(shard[home], return_inverse=True)[1]).max() <= (len(fps) if not sample else 400)


def test_links_on_clusters(spark):
    fps = clustered(400, 5)
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    links = vptree.hamming_links(df, sample=64, rows=40)
    got = {r.node: r.component for r in connected_components(links).collect()}
    want = components([(k, int(f)) for k, f in enumerate(fps)])
    groups = {}
    for f in fps:
        key = int(f.view(np.int64))
        groups.setdefault(got.get(key, key), set()).add(want[int(f)])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))
    assert links.count() < 40 * len(fps)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(200)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_in_a_shard(seed):
    """Against all pairs: the forest joins up the same, with and without labels; highest() pairs every row; apart() finds every pair."""
    fps = clustered(900, seed)
    home = np.arange(len(fps)) % 5 > 0
    near = (np.bitwise_count(fps[:, None] ^ fps[None]) <= 3) & (home[:, None] | home[None])
    rank = np.arange(len(fps)) % 7
    a, b = vptree.highest(fps, home, 3, rank)
    every = {(i, j) for i, j in np.argwhere(near).tolist() if i != j}
    best = {}
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        assert (i, j) in every
        best[i] = max(best.get(i, -1), rank[j])
    assert best == {i: max(rank[j] for k, j in every if k == i) for i in {i for i, _ in every}}
    dense = np.where(np.bitwise_count(fps ^ fps[0]) < 6, 0, np.arange(len(fps)))
    for label in (np.arange(len(fps)), np.arange(len(fps)) // 3, dense):
        for keep in (lambda i, j: np.ones(len(i), bool), lambda i, j: (i + j) % 3 > 0):
            want = {(i, j) for i, j in np.argwhere(near).tolist() if label[i] != label[j] and keep(np.array([i]), np.array([j]))[0]}
            a, b = vptree.apart(fps, home, 3, label, keep)
            got = set(zip(a.tolist(), b.tolist(), strict=True))
            assert got | {(j, i) for i, j in got} == want
            x, y = vptree.forest(fps, home, 3, label, keep)
            links = set(zip(x.tolist(), y.tolist(), strict=True))
            assert links <= want and partition(label, want) == partition(label, links)


def partition(label, pairs):
    """The smallest label of each label's group."""
    to = {k: k for k in label.tolist()}

    def root(k):
        while to[k] != k:
            k = to[k]
        return k

    for i, j in pairs:
        a, b = sorted((root(label[i]), root(label[j])))
        to[b] = a
    return {k: root(k) for k in to}


def test_copies_of_a_fingerprint_stay_few():
    """What is shuffled for random fingerprints, by the tree for so many: flat up to SHARDS * SHARD_ROWS[1], then slowly more."""
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 64, 4000, dtype=np.uint64)
    copies = {}
    for total in (200_000, 2_000_000, 20_000_000, 200_000_000):
        nodes = vptree.build_tree(rng.integers(0, 1 << 64, 8192, dtype=np.uint64), total, vptree.shard_rows(total))
        copies[total] = len(vptree.route(nodes, fps)[0]) / len(fps)
    assert copies[200_000] < 4 and copies[20_000_000] < 6 and copies[200_000_000] < 12


def test_a_dense_group_keeps_its_shards_small():
    """A third of all within a few bits of one: bits that vary in the group divide it, and copies stay few."""
    rng = np.random.default_rng(4)
    centre = int(rng.integers(0, 1 << 63))
    dense = np.array([centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 9), replace=False)) for _ in range(20_000)], np.uint64)
    fps = np.unique(np.r_[rng.integers(0, 1 << 64, 40_000, dtype=np.uint64), dense])
    nodes = vptree.build_tree(rng.permutation(fps)[:8192], len(fps), 1000)
    shard, _, home = vptree.route(nodes, fps)
    _, at = np.unique(shard, return_inverse=True)
    assert np.bincount(at[home]).max() < 6000 and len(shard) < 12 * len(fps)


def keys(fps, radius):
    return [fps & np.uint64(sum(1 << b for b in range(k, 64, radius + 1))) for k in range(radius + 1)]


@pytest.mark.parametrize("run", [8, 4096])
def test_pairs_of_one_key(monkeypatch, run):
    """Over all runs of bits every pair is met, in small groups and in ones that a tree divides; what is linked is within the radius."""
    monkeypatch.setattr(vptree, "RUN", run)
    monkeypatch.setattr(vptree, "LEAF", 8)
    fps = clustered(700, 6)
    home, label, rank = np.ones(len(fps), bool), np.arange(len(fps)), np.arange(len(fps)) % 7
    near = {(i, j) for i, j in np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None]) <= 4, 1)).tolist()}
    every, links, best = set(), set(), {}
    for key in keys(fps, 4):
        a, b = vptree.apart(fps, home, 4, label, lambda i, j: np.ones(len(i), bool), key)
        every |= {(min(x), max(x)) for x in zip(a.tolist(), b.tolist(), strict=True)}
        a, b = vptree.forest(fps, home, 4, label, None, key)
        links |= set(zip(a.tolist(), b.tolist(), strict=True))
        a, b = vptree.highest(fps, home, 4, rank, key)
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            assert i != j and (min(i, j), max(i, j)) in near
            best[i] = max(best.get(i, -1), rank[j])
    assert every == near and partition(label, near) == partition(label, links)
    assert best == {i: max(rank[b if a == i else a] for a, b in near if i in (a, b)) for i in {x for pair in near for x in pair}}


@pytest.mark.parametrize("shards", [1, 5])
def test_items_dealt_by_runs(spark, shards):
    """Two tables: as many copies of each item at any size, and pairs of one table within the radius have a shard and a key in common."""
    fps = clustered(150, 7)
    for some in (fps[:40], fps):
        rows = [(t, int(f.view(np.int64)) + t, int(f.view(np.int64))) for t in range(2) for f in some[:-1]]
        dealt = vptree.alike(spark.createDataFrame(rows, "t int, node long, fp long"), 4, shards)
        assert dealt.columns == ["shard", "key", "node", "fp"] and dealt.count() == 5 * len(rows)
    met = {}
    for r in dealt.collect():
        met.setdefault((r.shard, r.key), []).append(r.fp)
    assert len({s for s, _ in met}) == 10 * shards
    got = {(t, a, b) for (s, _), own in met.items() for a in own for b in own if (t := s // (5 * shards)) < 2 and a < b}
    own = sorted(int(f.view(np.int64)) for f in fps[:-1])
    want = {(t, a, b) for t in range(2) for k, a in enumerate(own) for b in own[k + 1 :] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 4}
    assert want and want <= got


def test_search_by_runs_finds_what_the_tree_finds(spark, monkeypatch):
    monkeypatch.setattr(vptree, "ALIKE_ROWS", 100)
    fps = clustered(200, 8)
    df = spark.createDataFrame([(t, int(f), int(f)) for t in range(2) for f in fps.view(np.int64)[t:]], "t int, node long, fp long")

    def linker(key):
        def link(f, mark, _):
            home = np.ones(len(f), bool) if key else mark
            return vptree.apart(f, home, 4, np.arange(len(f)), lambda i, j: np.ones(len(i), bool), mark if key else None)

        return link

    pairs = [{(min(r), max(r)) for r in found.collect()} for found in (vptree.search_alike(df, 4, linker(True), tables=2), vptree.search(df, 4, linker(False), tables=2))]
    assert pairs[0] == pairs[1] and len(pairs[0]) > 200
