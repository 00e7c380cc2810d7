"""Near-duplicate search over sets: banded signatures, families of candidates, exact links and connected components.

Nodes are distinct sets. Nodes that share a band's key are in one bucket; within a bucket, pairs whose estimated
similarity leaves a link possible connect. The connected components of that graph, families, hold every link, and each
family is searched exactly: a large one in blocks of rows, every block against every other. No step emits all
pairs of a group: buckets and families give spanning forests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Scratch, lean
from .setsketch import mix, shingle_sets, word_hashes

#: A bucket of more nodes isn't compared within; all its nodes go to one family, which is searched exactly.
BUCKET_ROWS = 1024
#: Blocks of a family: at least so many rows, a 64th of the family beyond that, and never more words than this.
BLOCK_ROWS, BLOCKS, BLOCK_WORDS = 128, 64, 4_000_000
#: Buckets of at most so many sets are compared many at a time.
SMALL = 64
#: Two agreeing parts of so many elements together are a key by themselves; smaller ones only with a hot key that the sets share.
TELLING = 4


def groups(batches: Iterator[pa.RecordBatch], keys: list[str], most: int = 4096) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows sorted by keys, many at a time: a table and where its groups begin, with its length at the end."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def cut(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for k in keys:
            c = t.column(k).to_numpy()
            new[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(new)

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows >= most:
            t = pa.Table.from_batches(held).combine_chunks()
            at = cut(t)
            if len(at) > 1:
                yield t.slice(0, at[-1]), at
                held, rows = t.slice(at[-1]).to_batches(), t.num_rows - int(at[-1])
            most = max(most, 2 * rows) if len(at) == 1 else most
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, np.append(cut(t), t.num_rows)


class Forest:
    """Labels of a group's rows; join() says if it joined two trees."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: int, b: int) -> bool:
        x, y = self.label[a], self.label[b]
        if x == y:
            return False
        self.label[self.label == y] = x
        return True


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node of edges (a, b), component being the least node reachable. Alternates large and small stars until each component is a star."""
    e = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    while True:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        # written, so that the join has an exchange on either side and Spark can split the neighbours of a hot node
        least = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = scratch.keep(both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        low = scratch.keep(large.groupBy("hi").agg(F.min("lo").alias("m")))
        nxt = scratch.keep(large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(low.select("hi", F.col("m").alias("lo"))).distinct())
        scratch.free(e, large, least, low)
        e = nxt
        centre_and_leaf = e.join(e.select(F.col("hi").alias("lo")).distinct(), "lo", "left_semi").select("lo")
        two_centres = e.groupBy("hi").count().where("count > 1").select("hi")
        if not centre_and_leaf.union(two_centres).limit(1).count():
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def candidate_edges(signatures: DataFrame, bands: int, band_bytes: int, possible: Callable, scratch: Scratch) -> DataFrame:
    """Edges (a, b) whose connected components hold every pair that shares a band and for which possible(sig, sig, n, n) is true.

    signatures: node, n (size of its set), sig (bands of band_bytes each). possible gets two uint8 matrices and two arrays of sizes.
    """
    node_type = signatures.schema["node"].dataType.simpleString()
    keyed = signatures.select("node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substring("sig", i * band_bytes + 1, F.lit(band_bytes))))).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("k"), F.min("node").alias("first")).where("k > 1")
    members = scratch.keep(keyed.join(shared, "key"))
    stars = members.where((F.col("k") > BUCKET_ROWS) & (F.col("node") != F.col("first"))).select(F.col("node").alias("a"), F.col("first").alias("b"))
    small = members.where(F.col("k") <= BUCKET_ROWS).select("key", "node").join(signatures, "node").select("key", "node", "n", "sig").repartition("key").sortWithinPartitions("key")

    @lean
    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in groups(batches, ["key"]):
            n = t.column("n").to_numpy()
            raw = t.column("sig").combine_chunks()
            sig = np.frombuffer(b"".join(raw.to_pylist()), np.uint8).reshape(len(n), bands * band_bytes)
            size = np.diff(at)
            two = at[:-1][size == 2]
            ok = possible(sig[two], sig[two + 1], n[two], n[two + 1]) if len(two) else np.zeros(0, bool)
            left, right = [two[ok]], [two[ok] + 1]
            for lo, k in zip(at[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
                f = Forest(k)
                for x in range(k - 1):
                    others = x + 1 + np.flatnonzero(f.label[x + 1 :] != f.label[x])
                    if len(others):
                        hit = others[possible(np.broadcast_to(sig[lo + x], (len(others), sig.shape[1])), sig[lo + others], np.broadcast_to(n[lo + x], len(others)), n[lo + others])]
                        made = [y for y in hit.tolist() if f.join(x, y)]
                        left.append(np.full(len(made), lo + x))
                        right.append(lo + np.array(made, np.int64))
            i, j = np.concatenate(left).astype(np.int64), np.concatenate(right).astype(np.int64)
            node = t.column("node").combine_chunks()
            yield pa.RecordBatch.from_arrays([node.take(pa.array(i)), node.take(pa.array(j))], ["a", "b"])

    return small.mapInArrow(connect, f"a {node_type}, b {node_type}").union(stars)


def links_within(sets: np.ndarray, begin: np.ndarray, lo: int, hi: int, left: np.ndarray, right: np.ndarray, linked: Callable) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links between a left and a right one of the sets lo to hi - 1, of which begin tells where each begins and ends."""
    f = Forest(hi - lo)
    n = np.diff(begin)
    near = np.arange(lo, hi)
    base = begin[lo]
    names, local = np.unique(sets[base : begin[hi]], return_inverse=True)
    mark = np.zeros(len(names), bool)
    for x in range(lo, hi):
        if not left[x]:
            continue
        others = near[right[lo:hi] & (f.label != f.label[x - lo]) & ((near > x) | ~left[lo:hi])]
        others = others[linked(np.minimum(n[x], n[others]), n[x], n[others])]
        if not len(others):
            continue
        mine = local[begin[x] - base : begin[x + 1] - base]
        mark[mine] = True
        each = n[others]
        first = np.cumsum(each) - each
        idx = np.repeat(begin[others] - base - first, each) + np.arange(int(each.sum()))
        shared = np.add.reduceat(mark[local[idx]].astype(np.int64), first)
        mark[mine] = False
        for y in others[linked(shared, n[x], each)].tolist():
            if f.join(x - lo, y - lo):
                yield x, y


def links_among(sets: np.ndarray, begin: np.ndarray, lo: np.ndarray, hi: np.ndarray, linked: Callable) -> tuple[np.ndarray, np.ndarray]:
    """links_within() each of many small buckets, sets lo to hi - 1: a round compares one set of each bucket with the later ones of other trees."""
    none = np.zeros(0, np.int64)
    if not len(lo):
        return none, none
    size, n = hi - lo, np.diff(begin)
    bucket = np.repeat(np.arange(len(lo)), size)
    rows = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(len(bucket))
    name = np.zeros(len(sets), np.int64)  # of an element in its bucket
    inside = np.repeat(begin[rows] - (np.cumsum(n[rows]) - n[rows]), n[rows]) + np.arange(int(n[rows].sum()))
    ids = np.unique(sets[inside], return_inverse=True)[1]
    name[inside] = np.unique(np.repeat(bucket, n[rows]) * (int(ids.max(initial=0)) + 1) + ids, return_inverse=True)[1]
    mark = np.full(len(inside), -1)
    label = np.arange(len(n))
    a, b = [none], [none]
    for r in range(int(size.max()) - 1):
        x = lo[size > r + 1] + r
        later = hi[size > r + 1] - x - 1
        y = np.repeat(x + 1 - (np.cumsum(later) - later), later) + np.arange(int(later.sum()))
        of = np.repeat(np.arange(len(x)), later)
        open_ = label[y] != label[x[of]]
        y, of = y[open_], of[open_]
        open_ = linked(np.minimum(n[x[of]], n[y]), n[x[of]], n[y])
        y, of = y[open_], of[open_]
        if not len(y):
            continue
        mine = np.repeat(begin[x] - (np.cumsum(n[x]) - n[x]), n[x]) + np.arange(int(n[x].sum()))
        mark[name[mine]] = r
        first = np.cumsum(n[y]) - n[y]
        idx = np.repeat(begin[y] - first, n[y]) + np.arange(int(n[y].sum()))
        hit = linked(np.add.reduceat((mark[name[idx]] == r).astype(np.int64), first), n[x[of]], n[y])
        y, of = y[hit], of[hit]
        old, at = np.unique(label[y], return_index=True)
        a.append(x[of[at]])
        b.append(y[at])
        to = np.arange(len(n))
        to[old] = label[x[of[at]]]
        label[rows] = to[label[rows]]
    return np.concatenate(a), np.concatenate(b)


def stored_sets(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sets of a table's column `set` (8 bytes an element), and where each begins, with the end."""
    raw = pa.concat_arrays([t.column("set").combine_chunks()])
    ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    return np.frombuffer(raw.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.uint64), (ends - ends[0]) // 8


def agreeing_parts(elements: np.ndarray, begin: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of sets, the set of each, and how many elements it has in both parts (0 for keys of one part): sets with 100 * |intersection| >= percent * |union| have one in common.

    Two such sets of at most x elements differ in d = 2 * x * (100 - percent) / (100 + percent) elements at most. If all elements are dealt to d + 2 parts, the two sets have equal elements in
    two parts at least, so what a set has in each two parts is a key. Where d is large, d + 1 parts and a key for each will do.

    x goes through the upper bounds of classes of sizes. Each is 100 / percent times the one below, so the larger size of a pair is in a set's own class or the next one, and a set
    has keys for these two only.
    """
    n = np.diff(begin)
    owner = np.repeat(np.arange(len(n)), n)
    keys, sets, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    bounds = [0, 1]
    while bounds[-2] < n.max(initial=0):
        bounds.append(max(bounds[-1] + 1, 100 * bounds[-1] // percent))
    for below, x in zip([0, *bounds[:-2]], bounds[1:], strict=True):
        mine = (n <= x) & (n > below)
        if not mine.any():
            continue
        d = 2 * x * (100 - percent) // (100 + percent)
        m = d + (2 if d <= 8 else 1)
        at = np.flatnonzero(mine)
        place = np.cumsum(mine) - 1
        inside = mine[owner]
        h = mix(elements[inside] ^ np.uint64(x))
        held, count = np.zeros((len(at), m), np.uint64), np.zeros((len(at), m), np.int64)
        where = place[owner[inside]], (h >> np.uint64(32)).astype(np.int64) % m
        np.add.at(held, where, h)
        np.add.at(count, where, 1)
        for i in range(m):
            for j in range(i + 1, m) if d <= 8 else (i,):
                keys.append(mix(held[:, i] + mix(held[:, j] + np.uint64((x * 4096 + i) * 4096 + j))))
                sets.append(at)
                sizes.append(count[:, i] + count[:, j] if i != j else np.zeros(len(at), np.int64))
    return np.concatenate(keys), np.concatenate(sets), np.concatenate(sizes)


def set_links(classes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, scratch: Scratch) -> DataFrame:
    """Spanning forests (a, b) of links between sets, 100 * |intersection| >= percent * |union|, over bands of one least hash each.

    classes: node, n (size of its set), keys (its bands: the n - ceil(percent * n / 100) + 1 least hashes of the set). sets_of gives (node, set) of a table of nodes. Sets that link share a
    key. sets_of is called once, after the last look at classes, which may go then. Nodes of a hot key, one with more than BUCKET_ROWS, are in buckets by that key and another one: two sets that link share two hashes at least if they differ, and the least two they share
    are among the n - ceil(percent * n / 100) + 2 least of either. Nodes of a hot pair are in buckets by agreeing_parts, which tell near copies with edits apart; what is still larger is searched in blocks.
    Buckets of the same nodes, of which near copies have one for each key they share, are searched once.
    """
    bands = classes.select("node", F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("k")).where("k > 1")
    members = scratch.keep(bands.join(shared.hint("shuffle_hash"), "key"))  # shared keys are few, and each stands once
    sets = scratch.keep(sets_of(members.select("node").distinct()))

    @lean
    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each hot key of a node with the hashes that may follow it among those shared."""
        for b in batches:
            for at in range(0, len(b), 2048):
                t = pa.Table.from_batches([b.slice(at, 2048)])
                elements, begin = stored_sets(t)
                hot = t.column("hot").combine_chunks()
                each = pa.compute.list_value_length(hot).to_numpy().astype(np.int64)
                which = np.repeat(np.arange(len(each)), each)
                first = hot.flatten().to_numpy().astype(np.uint64)
                n = np.diff(begin)
                least = np.minimum(n, n - (percent * n + 99) // 100 + 2)[which]
                e = elements[np.repeat(begin[which] - (np.cumsum(least) - least), least) + np.arange(int(least.sum()))]
                of = np.repeat(np.arange(len(which)), least)
                # at a percentage of 50 or less, sets of one common hash can link
                later = e > first[of] if percent > 50 else e >= first[of]
                e, of = e[later], of[later]
                keys = mix(mix(first[of]) + e)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(first[of].astype(np.int64)), t.column("node").combine_chunks().take(pa.array(which[of]))], ["key", "hot", "node"])

    @lean
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 2048):
                t = pa.Table.from_batches([b.slice(at, 2048)])
                keys, which, size = agreeing_parts(*stored_sets(t), percent)
                alone = size >= TELLING
                own_keys, own, keys, which = keys[alone], which[alone], keys[~alone], which[~alone]
                # others with each of the node's hot keys, as parts may be empty
                hot = t.column("hot").combine_chunks()
                each = pa.compute.list_value_length(hot).to_numpy().astype(np.int64)
                n = each[which]
                other = hot.flatten().to_numpy()[np.repeat((np.cumsum(each) - each)[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
                keys = np.concatenate([own_keys, mix(np.repeat(keys, n) ^ other.astype(np.uint64))])
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), t.column("node").combine_chunks().take(pa.array(np.concatenate([own, np.repeat(which, n)])))], ["key", "node"])

    node_type = classes.schema["node"].dataType.simpleString()
    hot_nodes = members.where(F.col("k") > BUCKET_ROWS).groupBy("node").agg(F.collect_list("key").alias("hot"))
    pairs = scratch.keep(sets.join(hot_nodes, "node").select("node", "set", "hot").mapInArrow(pair, f"key long, hot long, node {node_type}"))  # read twice
    pairs = scratch.keep(pairs.join(pairs.groupBy("key").agg(F.count("*").alias("k")).where("k > 1"), "key"))
    hot_nodes = pairs.where(F.col("k") > BUCKET_ROWS).groupBy("node").agg(F.collect_set("hot").alias("hot"))
    dealt = scratch.keep(sets.join(hot_nodes, "node").select("node", "set", "hot").mapInArrow(deal, f"key long, node {node_type}"))  # read twice
    hot = scratch.keep(dealt.join(dealt.groupBy("key").agg(F.count("*").alias("k")).where("k > 1"), "key"))
    both = members.where(F.col("k") <= BUCKET_ROWS).select("key", "node").union(pairs.where(F.col("k") <= BUCKET_ROWS).select("key", "node")).union(hot.where(F.col("k") <= BUCKET_ROWS).select("key", "node"))
    # sums of 52 bits, as a bucket's rows are few
    h1, h2 = (F.shiftright(F.xxhash64("node", F.lit(seed)), 12) for seed in (1, 2))
    alike = both.groupBy("key").agg(F.count("*").alias("k"), F.min("node").alias("low"), F.max("node").alias("high"), F.sum(h1).alias("s1"), F.sum(h2).alias("s2")).groupBy("k", "low", "high", "s1", "s2").agg(F.min("key").alias("key"))
    work = both.join(alike.select("key"), "key").join(sets, "node").select("key", "node", "set").repartition("key").sortWithinPartitions("key")
    linked = lambda shared, nx, ny: 100 * shared >= percent * (nx + ny - shared)

    @lean
    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in groups(batches, ["key"], 8192):
            elements, begin = stored_sets(t)
            size, n = np.diff(at), np.diff(begin)
            # buckets of two, all at once: elements of a pair that stand twice
            two = at[:-1][size == 2]
            owner = np.repeat(np.arange(len(two)), begin[two + 2] - begin[two])
            width = begin[two + 2] - begin[two]
            e = elements[np.repeat(begin[two] - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))]
            order = np.lexsort((e, owner))
            e, owner = e[order], owner[order]
            again = np.bincount(owner[1:][(e[1:] == e[:-1]) & (owner[1:] == owner[:-1])], minlength=len(two))
            ok = two[linked(again, n[two], n[two + 1])]
            some = (size > 2) & (size <= SMALL)
            x, y = links_among(elements, begin, at[:-1][some], at[1:][some], linked)
            a, b = np.append(ok, x).tolist(), np.append(ok + 1, y).tolist()
            every = np.ones(len(n), bool)
            for lo, hi in zip(at[:-1][size > SMALL].tolist(), at[1:][size > SMALL].tolist(), strict=True):
                for x, y in links_within(elements, begin, lo, hi, every, every, linked):
                    a.append(x)
                    b.append(y)
            node = t.column("node").combine_chunks()
            yield pa.RecordBatch.from_arrays([node.take(pa.array(a, pa.int64())), node.take(pa.array(b, pa.int64()))], ["a", "b"])

    found = scratch.keep(work.mapInArrow(connect, f"a {node_type}, b {node_type}"))
    large = hot.where(F.col("k") > BUCKET_ROWS).select(F.col("key").alias("family"), "node").join(sets, "node").withColumn("n", F.shiftright(F.octet_length("set"), 3))
    links = found.union(exact_links(large, linked, scratch, stored_sets))
    scratch.free(members, sets, pairs, dealt, hot)
    return links


def text_sets(shingle: int, lower: bool = True) -> Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]:
    """A reader of the sets of word shingles of a table's column `text`, like stored_sets."""

    def read(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        sets, ends = shingle_sets(*word_hashes(t.column("text").combine_chunks(), lower), shingle)
        return sets, np.concatenate([[0], ends]).astype(np.int64)

    return read


def exact_links(members: DataFrame, linked: Callable, scratch: Scratch, sets_of: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Spanning forests (a, b) of the links within families.

    members: family, node, n (size of its set), and what sets_of reads the sets from. linked(shared, n, n) tells from the size of the intersection and the sizes of the sets, elementwise.
    """
    node_type = members.schema["node"].dataType.simpleString()
    held = "set" if "set" in members.columns else "text"
    members = scratch.keep(members)  # read twice, and so that Spark can split a large family's rows in the join below
    weight = scratch.keep(members.groupBy("family").agg(F.count("*").alias("rows"), F.sum("n").alias("words")))
    rows = F.greatest(F.lit(BLOCK_ROWS), F.ceil(F.col("rows") / BLOCKS))
    m = members.join(weight, "family").withColumn("blocks", F.greatest(F.ceil(F.col("rows") / rows), F.ceil(F.col("words") / BLOCK_WORDS)).cast("int"))
    m = m.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    m = m.select(F.xxhash64("family", F.least("block", "other"), F.greatest("block", "other")).alias("k1"), F.xxhash64(F.lit(1), "family", F.least("block", "other"), F.greatest("block", "other")).alias("k2"), (F.col("block") <= F.col("other")).alias("left"), (F.col("block") >= F.col("other")).alias("right"), "node", held)
    m = m.repartition("k1", "k2").sortWithinPartitions("k1", "k2")

    @lean
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in groups(batches, ["k1", "k2"], 512):
            sets, begin = sets_of(t)
            is_left, is_right = t.column("left").to_numpy(), t.column("right").to_numpy()
            a: list[int] = []
            b: list[int] = []
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                for x, y in links_within(sets, begin, lo, hi, is_left, is_right, linked):
                    a.append(x)
                    b.append(y)
            node = t.column("node").combine_chunks()
            yield pa.RecordBatch.from_arrays([node.take(pa.array(a, pa.int64())), node.take(pa.array(b, pa.int64()))], ["a", "b"])

    return scratch.keep(m.mapInArrow(search, f"a {node_type}, b {node_type}"))
