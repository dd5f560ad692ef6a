"""SimHash near-duplicates by a vantage-point tree over Hamming distance."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import materialize
from tidelog.llm.graph import connected_components

SEED, SHINGLE, RADIUS = 42, 3, 2
#: Fingerprints from which a tree is fitted, at most; one in so many may be among them.
SAMPLE, SAMPLE_RATE = 8_192, 4
#: A shard holds a SHARDSth of all fingerprints, but no fewer than the first and no more than the second of these numbers, so
#: up to SHARDS * SHARD_ROWS[1] fingerprints the tree's depth, and with it the copies of each, stay the same.
SHARDS, SHARD_ROWS = 64, (16_384, 1 << 19)
#: Fingerprints in a leaf of the tree that a task builds over its shard.
LEAF = 512
#: Rows of one key that are compared with each other before a tree divides them, and rows of a shard of search_alike.
RUN, ALIKE_ROWS = 4_096, 16_384


def shard_rows(total: int) -> int:
    return max(SHARD_ROWS[0], min(SHARD_ROWS[1], total // SHARDS))


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of the word shingles, repeats included; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.r_[0, ends[:-1] + 1]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    total = np.zeros(64, np.int64)
    raw = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    for lo in range(0, len(raw), 8192):
        total += np.unpackbits(raw[lo : lo + 8192], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): bytes A-Z are lower-cased, words are runs of anything but ASCII white space. fp holds the unsigned bits in a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


@dataclass
class Node:
    """Inside: at most `cut` bits from the vantage point, counted over the bits of `mask`. A node without a mask is a shard."""

    mask: int = 0
    vantage: int = 0
    cut: int = 0
    inside: int = -1
    outside: int = -1
    #: For a shard: how often it is halved again, unseen by the sample, and the bits left for that.
    deeper: int = 0
    free: list[int] = field(default_factory=list)


def build_tree(sample: np.ndarray, total: int, leaf: int) -> list[Node]:
    """A vantage-point tree fitted on a sample of `total` fingerprints.

    Distances between 64-bit fingerprints crowd around 32, so whole-width rings of radius 2 overlap nearly everywhere.
    Each node therefore measures the distance to its vantage point over bits that no node above it has used. Such
    distances bound the whole distance from below and those of one path add up, so the gaps to all ring borders that a
    query crosses are taken from one radius, and few branches remain.
    """
    scale = total / max(1, len(sample))
    nodes: list[Node] = [Node()]
    todo = [(0, np.asarray(sample, np.uint64), list(range(64)))]
    while todo:
        at, own, free = todo.pop()
        need = int(np.ceil(np.log2(max(1.0, len(own) * scale / leaf))))
        node = nodes[at]
        split = _best_split(own, free, need) if need and len(own) > 1 else None
        if split is None:
            node.deeper, node.free = min(need, len(free)), free
            continue
        bits, vantage, cut, near = split
        node.mask, node.vantage, node.cut = _mask(bits), vantage, cut
        node.inside, node.outside = len(nodes), len(nodes) + 1
        nodes += [Node(), Node()]
        rest = [b for b in free if b not in bits]
        todo += [(node.inside, own[near], rest), (node.outside, own[~near], rest)]
    return nodes


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _best_split(own: np.ndarray, free: list[int], need: int):
    """(bits, vantage, cut, inside) that halve the sample best; None if no bit left divides it."""
    ones = np.array([((own >> np.uint64(b)) & np.uint64(1)).mean() for b in free]) if free else np.zeros(0)
    varied = [free[k] for k in np.argsort(np.abs(ones - 0.5), kind="stable") if 0 < ones[k] < 1]
    if not varied:
        return None
    width = max(1, len(free) // need - (len(free) // need + 1) % 2)
    best = None
    for w in sorted({1, width // 2 | 1, width}):
        bits = varied[:w]
        vantage = int(own[0])
        apart = np.bitwise_count((own ^ np.uint64(vantage)) & np.uint64(_mask(bits)))
        for cut in range(len(bits)):
            near = apart <= cut
            share = near.mean()
            edge = np.mean((apart == cut) | (apart == cut + 1)) + 0.5 * np.mean((apart == cut - 1) | (apart == cut + 2))
            if 0 < share < 1:
                score = abs(share - 0.5) + 0.25 * edge
                if best is None or score < best[0]:
                    best = (score, bits, vantage, cut, near)
    return best[1:] if best else None


def route(nodes: list[Node], fps: np.ndarray, radius: int = RADIUS, home: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, row, home): each fingerprint's home shard, and the shards beyond a border within its radius.

    Of two fingerprints at most radius apart, one meets the other in the other's home: where their paths part, the one
    inside crosses to the outside, and from there it goes wherever its radius left allows. Those not marked in `home`, if
    it is given, are guests everywhere.
    """
    out: list[tuple[int, np.ndarray, np.ndarray]] = []
    rows = np.arange(len(fps))
    todo = [(0, rows, np.full(len(fps), radius, np.int64), np.ones(len(fps), bool) if home is None else home)]
    while todo:
        at, idx, left, home = todo.pop()
        node = nodes[at]
        if not node.mask:
            _halve(out, at, node, fps, idx, left, home)
            continue
        sides = _sides(fps, idx, left, home, node.mask, node.vantage, node.cut)
        todo += [(child, *s) for child, s in zip((node.inside, node.outside), sides, strict=True) if len(s[0])]
    if not out:
        return np.zeros(0, np.int64), rows, np.zeros(0, bool)
    shard = np.concatenate([np.full(len(i), s, np.int64) for s, i, _ in out])
    return shard, np.concatenate([i for _, i, _ in out]), np.concatenate([h for _, _, h in out])


def _sides(fps, idx, left, home, mask: int, vantage: int, cut: int):
    apart = np.bitwise_count((fps[idx] ^ np.uint64(vantage)) & np.uint64(mask)).astype(np.int64)
    inside = apart <= cut
    gap = np.where(inside, cut + 1 - apart, apart - cut)
    cross = (gap <= left) & (inside | ~home)
    for here in (inside, ~inside):
        over = cross & ~here
        yield np.r_[idx[here], idx[over]], np.r_[left[here], (left - gap)[over]], np.r_[home[here], np.zeros(int(over.sum()), bool)]


def _halve(out, at: int, node: Node, fps, idx, left, home) -> None:
    """Shards that the sample is too small to divide are halved by rule: equal runs of the free bits, cut in the middle."""
    width = max(1, len(node.free) // max(1, node.deeper))
    todo = [(0, 1, idx, left, home)]
    while todo:
        level, path, idx, left, home = todo.pop()
        if level == node.deeper:
            out.append((at << 32 | path, idx, home))
            continue
        bits = node.free[level * width : (level + 1) * width]
        sides = _sides(fps, idx, left, home, _mask(bits), node.vantage, (len(bits) - 1) // 2)
        todo += [(level + 1, path << 1 | k, *s) for k, s in enumerate(sides) if len(s[0])]


def leaves(fps: np.ndarray, home: np.ndarray, radius: int, key: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(home rows, all rows with the home ones first) of each leaf of a tree over one shard's fingerprints.

    If keys are given, all rows are at home and only those of one key need to meet: small groups come many to a leaf, and
    those of over RUN rows have a tree each.
    """
    if key is not None:
        yield from _runs(fps, radius, key)
        return
    own = fps[home]
    if len(own):
        nodes = build_tree(own[:: max(1, len(own) // SAMPLE)][:SAMPLE], len(own), LEAF)
        shard, row, at_home = route(nodes, fps, radius, home)
        order = np.lexsort((row, ~at_home, shard))
        shard, row, at_home = shard[order], row[order], at_home[order]
        edges = np.r_[0, np.flatnonzero(shard[1:] != shard[:-1]) + 1, len(shard)]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if n := int(at_home[a:b].sum()):
                yield row[a : a + n], row[a:b]


def _runs(fps: np.ndarray, radius: int, key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    order = np.argsort(key, kind="stable")
    edges = np.r_[0, np.flatnonzero(np.diff(key[order])) + 1, len(key)]
    size = np.diff(edges)
    order, size = order[np.repeat(size > 1, size)], size[size > 1]
    lo = at = 0
    for n in [*size.tolist(), LEAF + 1]:  # the last one ends the last run
        if at > lo and at + n - lo > LEAF:
            rows = order[lo:at]
            if len(rows) <= RUN:
                yield rows, rows
            else:
                for a, b in leaves(fps[rows], np.ones(len(rows), bool), radius):
                    yield rows[a], rows[b]
            lo = at
        at += n


def near_blocks(fps: np.ndarray, rows: np.ndarray, every: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(offset, i, j), in blocks of rows: every[j] is within radius of rows[offset + i]. A fingerprint is near itself."""
    step = max(1, (1 << 21) // max(1, len(every)))
    for lo in range(0, len(rows), step):
        i, j = np.nonzero(np.bitwise_count(fps[rows[lo : lo + step], None] ^ fps[None, every]) <= radius)
        yield lo, i, j


#: Tells which of the pairs (i, j) of a shard's rows are worth a link.
Keep = Callable[[np.ndarray, np.ndarray], np.ndarray]


def forest(fps: np.ndarray, home: np.ndarray, radius: int = RADIUS, label: np.ndarray | None = None, keep: Keep | None = None, key: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows a, b of one shard: links that join up whatever lies within radius (and passes `keep`), home to home and home to guest.

    In each leaf they are a forest, not all pairs. Rows of one label, if labels are given, count as joined already.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for rows, every in leaves(fps, home, radius, key):
        same = np.arange(len(every)) if label is None else np.unique(label[every], return_inverse=True)[1]
        for lo, i, j in near_blocks(fps, rows, every, radius):
            i = lo + i
            apart = np.flatnonzero(same[i] != same[j])
            if keep:
                apart = apart[keep(rows[i[apart]], every[j[apart]])]
            while len(apart):
                a, b = same[i[apart]], same[j[apart]]
                low, high = np.minimum(a, b), np.maximum(a, b)
                top, first = np.unique(high, return_index=True)  # one link for each label: no circles, since the other is smaller
                found.append((rows[i[apart[first]]], every[j[apart[first]]]))
                to = np.arange(len(every))
                to[top] = low[first]
                while (to[to] != to).any():
                    to = to[to]
                same = to[same]
                apart = apart[same[i[apart]] != same[j[apart]]]
    return _joined(found)


def highest(fps: np.ndarray, home: np.ndarray, radius: int, rank: np.ndarray, key: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows a, b of one shard: in each block of a leaf a row, home or guest, with the one of highest rank near it, itself not counted."""
    found = []
    for rows, every in leaves(fps, home, radius, key):
        for lo, i, j in near_blocks(fps, rows, every, radius):
            a, b = rows[lo + i], every[j]
            apart = a != b
            for x, y in ((a[apart], b[apart]), (b[apart], a[apart])):
                order = np.lexsort((y, -rank[y], x))
                own, first = np.unique(x[order], return_index=True)
                found.append((own, y[order[first]]))
    return _joined(found)


def apart(fps: np.ndarray, home: np.ndarray, radius: int, label: np.ndarray, keep: Keep, key: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows a, b of one shard: all pairs of different labels within radius that pass `keep`.

    The rows of a leaf's commonest label are compared with those of other labels alone, so a dense group that is joined up
    costs as many comparisons as there are rows that are not of it.
    """
    found = []
    for rows, every in leaves(fps, home, radius, key):
        values, at, count = np.unique(label[every], return_inverse=True, return_counts=True)
        main = count.argmax()
        of_main = label[rows] == values[main]
        for own, others in ((rows[~of_main], every), (rows[of_main], every[at != main])):
            for lo, i, j in near_blocks(fps, own, others, radius):
                a, b = own[lo + i], others[j]
                unlike = label[a] != label[b]
                a, b = a[unlike], b[unlike]
                kept = keep(a, b)
                found.append((a[kept], b[kept]))
    return _joined(found)


def _joined(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(x for x, _ in found)]), np.concatenate([none, *(x for _, x in found)])


#: Rows a, b to link in one shard, of its fingerprints, a mark at those that are at home in it (their keys, of search_alike), and its table.
Linker = Callable[[np.ndarray, np.ndarray, pa.Table], tuple[np.ndarray, np.ndarray]]


def search(items: DataFrame, radius: int, linker: Linker, *, tables: int = 1, sample: int = SAMPLE, rows: int | None = None) -> DataFrame:
    """(a, b), nodes of items (t: table, node, fp, and what else `linker` needs; a written table) that `linker` links.

    Each table has a vantage-point tree of its own, fitted on at most `sample` items; every fingerprint is routed through
    it, to its home shard and as a guest to those that its radius reaches into, so any two of one table within radius meet
    in a shard. A shard is one group of a shuffle, in which a task searches by a tree of its own.
    """
    total = items.count() // tables
    chosen = items.where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLE_RATE)) == 0).select("t", "fp", F.xxhash64(F.lit(7), "fp").alias("h"))
    drawn = [[] for _ in range(tables)]
    for t in range(tables):
        drawn[t] = [r.fp for r in chosen.where(F.col("t") == t).orderBy("h", "fp").limit(sample).collect()]
    trees = [build_tree(np.array(x, np.int64).view(np.uint64), total, rows or shard_rows(total)) for x in drawn]
    carried = [c for c in items.columns if c != "t"]
    walked = items.select(F.lit(0).cast("long").alias("shard"), F.lit(True).alias("home"), *carried).schema

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _gathered(batches, 1 << 16):
            table, fp, part = part.column("t").to_numpy(), part.column("fp").to_numpy(), part.select(carried)
            for t, tree in enumerate(trees):
                own = np.flatnonzero(table == t)
                shard, row, home = route(tree, fp[own].view(np.uint64), radius)
                for lo in range(0, len(shard), 1 << 16):
                    at = slice(lo, lo + (1 << 16))
                    moved = part.take(pa.array(own[row[at]])).combine_chunks()
                    moved = moved.add_column(0, "home", pa.array(home[at])).add_column(0, "shard", pa.array(shard[at] | (t << 56)))
                    yield from moved.to_batches()

    return _linked(items.select("t", *carried).mapInArrow(walk, walked), "home", linker)


def search_alike(items: DataFrame, radius: int, linker: Linker, *, tables: int = 1) -> DataFrame:
    """(a, b) as search gives them, for radii so wide that a tree's rings all overlap and most items are guests of some shards.

    An item has radius + 1 copies however many there are, shards are as many as the items ask for, and what meets in a shard is
    few enough to be searched at once, or by a tree where very many have the same bits.
    """
    return _linked(alike(items, radius, max(1, items.count() // tables // ALIKE_ROWS)), "key", linker)


def alike(items: DataFrame, radius: int, shards: int) -> DataFrame:
    """shard, key and the columns of items but t: each item once for each of radius + 1 runs of bits, whose bits are its key.

    Two fingerprints within radius differ in at most that many bits, so in one run they differ in none and have one key. A shard
    has whole keys of one table and one run.
    """
    masks = [_mask(list(range(k, 64, radius + 1))) for k in range(radius + 1)]
    bits = F.array(*[F.col("fp").bitwiseAND(F.lit(m - (m >> 63 << 64))) for m in masks])
    carried = [c for c in items.columns if c != "t"]
    shard = (F.col("t") * len(masks) + F.col("run")).cast("long") * shards + F.pmod(F.xxhash64("key"), F.lit(shards))
    return items.select("t", *carried, F.posexplode(bits).alias("run", "key")).select(shard.alias("shard"), "key", *carried)


def _linked(dealt: DataFrame, mark: str, linker: Linker) -> DataFrame:
    def link(table: pa.Table) -> pa.Table:
        table = table.sort_by([("node", "ascending"), ("fp", "ascending")])
        node, fps = table.column("node").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
        a, b = linker(fps, table.column(mark).to_numpy(), table)
        return pa.table({"a": pa.array(node[a]), "b": pa.array(node[b])})

    return dealt.groupBy("shard").applyInArrow(link, "a long, b long")


def hamming_links(unique: DataFrame, radius: int = RADIUS, sample: int = SAMPLE, rows: int | None = None) -> DataFrame:
    """(a, b) over distinct fingerprints (column fp, a written table): joins up all that are within radius, exactly.

    The tree is as deep as the number of fingerprints asks for (see shard_rows): what is shuffled is some 3 to 12 rows a
    fingerprint at radius 2 for up to 2e8 of them (tests). A dense group makes a shard larger but not its links.
    """
    items = unique.select(F.lit(0).alias("t"), F.col("fp").alias("node"), "fp")
    return search(items, radius, lambda fps, home, _: forest(fps, home, radius), sample=sample, rows=rows)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    own: list[pa.RecordBatch] = []
    for batch in batches:
        own.append(batch)
        if sum(b.num_rows for b in own) >= rows:
            yield pa.Table.from_batches(own)
            own = []
    if own:
        yield pa.Table.from_batches(own)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links of at most `radius` bits.

    Null and blank texts have fingerprint zero and link like any other. A null doc_id is kept; it takes part in links and
    has the smallest id of its component, null if there is none. Rows that repeat are returned as often as they occur.
    """
    fps = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    unique = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "unique")
    links = materialize(hamming_links(unique, radius), "links")
    component = connected_components(links)
    named = unique.join(component.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialize(named.select("fp", "component"), "named")
    classes = materialize(named.join(materialize(least, "least").hint("merge"), "component").select("fp", "component_id"), "classes")
    return fps.join(classes.hint("merge"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
