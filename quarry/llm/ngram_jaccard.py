"""Join of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, by a MinHash LSH forest.

Each text has `TREES` MinHash signatures of `DEPTH` values; each is its path in one prefix trie. The paths of all trees
are kept sorted (tree, path), so that the texts below a node of a trie, of whatever depth, lie side by side, and one pass
over the sorted paths, with the lengths of the prefixes that neighbours share, gives the nodes of every depth. Texts
below the same node are candidates.

The match begins with prefixes of DEPTH values and is shortened value by value, for all texts alike. After each step the
candidates are verified exactly, on whole shingle sets. A link of similarity s is found at depth d with probability
1 - (1 - s ** d) ** TREES; the match is shortened until the weakest link that was verified so far is found with
probability `RECALL` at the depth reached, and at most to the depth at which a link of just the least similarity is.

Texts with equal sets are one class, formed by partial aggregation; only classes go on. Only pairs that share a node are
verified, each once: a pair belongs to the deepest level, and there to the first tree, in which it meets. Nodes of at
most `SMALL` classes are dealt to tasks as they are, and those with the same members as an earlier node are left out. The
classes of larger nodes would be sent once per tree, so those that are connected by such nodes form a group, which is
dealt into blocks of about `BLOCK` shingles or `BLOCK_ROWS` classes; each pair of blocks is a task's work. A group of
more than `MOST_BLOCKS` blocks goes back to its single nodes, dealt into blocks likewise. A task returns one row per
class (links, and one link that keeps it connected), never the pairs; nothing is capped.

Scale: two passes over the texts. Between them narrow rows are shuffled (a path per tree and class, sorted by range, so
that a node with a large share of all classes is spread over tasks); the second pass reads one text of each class that
has a candidate. The list of those is broadcast up to `BROADCAST_ROWS` rows and joined by shuffle beyond.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, fresh, hold_batches, mixed, ngrams, slices, word_hashes
from ._graph import components, salted

WORDS, SIMILARITY = 5, 0.8
TREES, DEPTH, RECALL = 20, 7, 0.999
#: Most classes of a node that is dealt as it is.
SMALL = 16
#: Most shingles and most classes of a block, on average, and most blocks of a group.
BLOCK, BLOCK_ROWS, MOST_BLOCKS = 400_000, 2000, 40
#: Sorted paths of one task beyond which more tasks are asked for.
PATHS = 500_000
BROADCAST_ROWS = 200_000
SEED = 20240301


def depth_for(similarity: float = SIMILARITY, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The prefix length at which a pair of this similarity meets in some tree with probability `recall`: none is
    shortened further."""
    while depth > 1 and found_at(similarity, depth, trees) < recall:
        depth -= 1
    return depth


def found_at(similarity, depth: int, trees: int = TREES):
    """Probability that a pair of this similarity shares a node of this depth."""
    return 1 - (1 - similarity**depth) ** trees


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, as (starts, hashes)."""
    starts, h = ngrams(*word_hashes(texts), words)
    parts = [np.unique(h[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    return np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64), np.concatenate([*parts, np.empty(0, np.uint64)])


def paths(starts: np.ndarray, hashes: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> np.ndarray:
    """The MinHash values of each set (texts x trees x depth), each folded to 16 bits; zeros for an empty set."""
    rng = np.random.default_rng(SEED)
    flips = rng.integers(0, 1 << 32, trees * depth, np.uint32)
    factors = rng.integers(0, 1 << 31, trees * depth, np.uint32) * np.uint32(2) + np.uint32(1)
    short = ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(starts) - 1, trees * depth), np.uint16)
    full = np.flatnonzero(np.diff(starts))
    ends = np.searchsorted(starts[full], np.arange(0, len(short) + 32768, 32768), "left") if len(full) else np.empty(0, np.int64)
    bounds = sorted({0, len(full), *ends[(ends > 0) & (ends < len(full))].tolist()})
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):  # pieces that stay in the processor's cache
        some = short[starts[full[a]] : starts[full[b - 1] + 1]]
        at = starts[full[a:b]] - starts[full[a]]
        for k in range(trees * depth):
            low = np.minimum.reduceat((some ^ flips[k]) * factors[k], at)
            out[full[a:b], k] = (low * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out.reshape(-1, trees, depth)


def _signed(rows: DataFrame, words: int) -> DataFrame:
    """id, t, class (digest of the shingle set), size, paths of each row; class is null without a word."""

    def sign(batches):
        for part in slices(batches):
            starts, hashes = shingle_sets(part.column(2), words)
            ways = paths(starts, hashes).astype(">u2")
            raw = hashes.tobytes()
            digests = [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if b > a else None for a, b in zip(starts[:-1], starts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(digests, pa.binary()), pa.array(np.diff(starts)), pa.array([w.tobytes() for w in ways], pa.binary())],
                ["id", "t", "class", "size", "paths"],
            )

    return rows.mapInArrow(sign, "id long, t long, class binary, size long, paths binary")


def _classes(signed: DataFrame) -> DataFrame:
    """class, id and t of its least row (null ids last), rows, size, paths."""
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t"))
    return (
        signed.filter("class is not null")
        .groupBy("class")
        .agg(first.alias("r"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("paths").alias("paths"))
        .select("class", "r.id", "r.t", "copies", "size", "paths")
    )


def _fixed(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _node_keys(values: np.ndarray, tree: np.ndarray | int, depth: int) -> np.ndarray:
    """A hash of the first `depth` values of each path, and of the tree and depth."""
    h = mixed(np.full(len(values), depth, np.uint64) * np.uint64(1 << 32) + np.asarray(tree).astype(np.uint64))
    for k in range(depth):
        h = mixed(h * np.uint64(0x100000001B3) + values[:, k].astype(np.uint64))
    return h


def _runs(shared: np.ndarray, level: int, leaf: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, after last, whether it is at an edge) of the runs of neighbours that share `level` values or more, of those that branch there or
    may go on in another task."""
    cuts = np.flatnonzero(np.concatenate(([True], shared < level, [True])))
    first, last = cuts[:-1], cuts[1:]
    edge = (first == 0) | (last == len(shared) + 1)
    if leaf:
        branch = last - first > 1
    else:
        here = np.concatenate(([0], np.cumsum(shared == level)))  # where neighbours part after `level` values
        branch = here[last - 1] > here[first]
    return first[branch | edge], last[branch | edge], edge[branch | edge]


def _nodes(classes: DataFrame, floor: int) -> DataFrame:
    """(level, tree, key, class, size, n, print, edge): the classes below each node that branches, from the sorted paths.

    n: classes of the node, print: a hash of their set; both are of the task's part only where a node reaches its
    edge. Pairs below a branch of the node have met at a deeper level."""
    n = classes.count() * TREES
    step = 2 * DEPTH
    trees = classes.select("class", F.col("size").cast("int").alias("size"), "paths", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    ways = trees.select("tree", F.substring("paths", F.col("tree") * step + 1, F.lit(step)).alias("path"), "class", "size")
    at_least = -(-n // PATHS)
    more = () if at_least <= int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")) else (at_least,)
    tries = ways.repartitionByRange(*more, "tree", "path", "class").sortWithinPartitions("tree", "path", "class")

    def read(batches):
        parts = [(np.asarray(b.column(0), np.int64), _fixed(b.column(1), step), _fixed(b.column(2), 16), np.asarray(b.column(3))) for b in batches if b.num_rows]
        if not parts:
            return
        tree, path, name, size = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        values = path.view(">u2").astype(np.uint16)
        same = (values[1:] == values[:-1]) & (tree[1:] == tree[:-1])[:, None]
        shared = np.cumprod(same, axis=1, dtype=np.int8).sum(axis=1)
        half = name.view(">u8").astype(np.uint64)
        mark = mixed(half[:, 0] ^ mixed(half[:, 1]))
        for level in range(DEPTH, floor - 1, -1):
            first, last, edge = _runs(shared, level, level == DEPTH)
            if not len(first):
                continue
            count = last - first
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - first, count)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mark[at])))
            ends = np.cumsum(count)
            prints = sums[ends] - sums[ends - count]
            keys = _node_keys(values[first], tree[first], level)
            of = np.repeat(np.arange(len(first)), count)
            for some in range(0, len(at), 50_000):
                a, o = at[some : some + 50_000], of[some : some + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(a), level, np.int32)), pa.array(tree[a].astype(np.int32)), pa.array(keys[o].astype(np.int64)),
                        pa.array([x.tobytes() for x in name[a]], pa.binary()), pa.array(size[a].astype(np.int32)), pa.array(count[o]),
                        pa.array(prints[o].astype(np.int64)), pa.array(edge[o]),
                    ],
                    ["level", "tree", "key", "class", "size", "n", "print", "edge"],
                )

    return tries.mapInArrow(read, "level int, tree int, key long, class binary, size int, n long, print long, edge boolean")


def _members(nodes: DataFrame) -> DataFrame:
    """(level, tree, key, class, size, n): nodes of two classes and more, but for small ones with the members of one
    that comes before (of a deeper level, or of the same level and an earlier tree)."""
    columns = ["level", "tree", "key", "class", "size", "n"]
    nodes = cut(nodes)
    inner, edge = nodes.filter("not edge"), nodes.filter("edge")
    whole = edge.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    edge = salted(edge.drop("n"), whole, "key", F.col("class"))
    few, many = inner.filter(F.col("n") <= SMALL), inner.filter(F.col("n") > SMALL)
    place = F.struct(-F.col("level"), "tree")
    before = few.groupBy("print", "n").agg(F.min(place).alias("place"))
    few = few.join(before, ["print", "n"]).filter(place == F.col("place"))
    return few.select(columns).union(many.select(columns)).union(edge.select(columns))


def _sets_of(rows: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """class, copies, paths, shingles of `classes`, from the text of each class's first row."""
    wanted = classes.select(F.col("id").alias("m_id"), F.col("t").alias("m_t"), "class", "copies", "paths")
    if classes.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = rows.join(wanted, (F.col("t") == F.col("m_t")) & F.col("id").eqNullSafe(F.col("m_id")))

    def shingle(batches):
        seen: set[bytes] = set()  # rows that repeat are read once
        for part in slices(batches):
            names = part.column(1).to_pylist()
            new = [i for i, c in enumerate(names) if not (c in seen or seen.add(c))]
            part = part.take(pa.array(new, pa.int64()))
            starts, hashes = shingle_sets(part.column(0), words)
            sets = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(hashes.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*part.columns[1:], sets], ["class", "copies", "paths", "shingles"])

    sets = texts.select("text", "class", "copies", "paths").mapInArrow(shingle, "class binary, copies long, paths binary, shingles array<long>")
    return cut(sets.dropDuplicates(["class"]))


def _shared(starts: np.ndarray, flat: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values the sets a[k] and b[k] share, for each k: bits of both, counted."""
    n, out = len(starts) - 1, np.zeros(len(a), np.int64)
    values, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.cumsum(count > 1) - 1  # what only one set has is in no intersection
    width = int((count > 1).sum())
    kept = count[code] > 1
    owner, code = np.repeat(np.arange(n), np.diff(starts))[kept], place[code[kept]]
    strip = max(64, min(-(-width // 64) * 64, 32_000_000 // max(1, n) // 64 * 64))
    for low in range(0, width, strip):
        on = (code >= low) & (code < low + strip)
        bits = np.zeros((n, strip), np.uint8)
        bits[owner[on], code[on] - low] = 1
        bits = np.packbits(bits, axis=1).view(np.uint64)
        step = max(1, 2_000_000 // bits.shape[1])
        for k in range(0, len(a), step):
            out[k : k + step] += np.bitwise_count(bits[a[k : k + step]] & bits[b[k : k + step]]).sum(axis=1, dtype=np.int64)
    return out


def _pairs(group: np.ndarray, block: np.ndarray, crossing: bool, strip: int = 1_000_000):
    """(a, b) in pieces: the pairs of rows of one group (`crossing`: of different blocks). Rows are sorted by group."""
    cuts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    kept, total = [], 0
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        n = high - low
        rows = max(1, strip // n)
        for first in range(low, high - 1, rows):
            last = min(high - 1, first + rows)
            count = high - 1 - np.arange(first, last)
            a = np.repeat(np.arange(first, last), count)
            b = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + a + 1
            if crossing:
                cross = block[a] != block[b]
                a, b = a[cross], b[cross]
            kept.append((a, b))
            total += len(a)
            if total >= strip:
                yield tuple(np.concatenate(x) for x in zip(*kept, strict=True))
                kept, total = [], 0
    if total:
        yield tuple(np.concatenate(x) for x in zip(*kept, strict=True))


def _meet(a, b, tree, comp, here: np.ndarray, deeper: np.ndarray | None) -> np.ndarray:
    """Places of the pairs that are to be verified: those that share a node of this level and met at none deeper, where
    they have been verified. In a single node (tree 0 or more) the node's tree must be the first in which they meet,
    and they must not be of one group (comp 0 or more), which has its own turn. `here`, `deeper`: node keys by tree and row."""
    left = np.arange(len(a))
    in_node = tree[a[left]] >= 0
    left = left[~in_node | (comp[a[left]] < 0) | (comp[a[left]] != comp[b[left]])]
    if deeper is not None:
        for keys in deeper:
            left = left[keys[a[left]] != keys[b[left]]]
    node = left[tree[a[left]] >= 0]
    for t, keys in enumerate(here):
        node = node[(tree[a[node]] <= t) | (keys[a[node]] != keys[b[node]])]
    whole = left[tree[a[left]] < 0]
    met = np.zeros(len(whole), bool)
    for keys in here:
        met |= keys[a[whole]] == keys[b[whole]]
    return np.concatenate((node, whole[met]))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place that each of n places is connected with by the links (a, b)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verified(level: int, similarity: float):
    """Function of the rows of one task's groups: per class its links there, one class that it is connected with, and
    the similarity of its weakest link."""

    def verify(rows: pa.Table) -> pa.Table:
        group, name = np.asarray(rows["group"]), rows["class"].combine_chunks().dictionary_encode()
        order = np.argsort(group, kind="stable")
        column = lambda c: np.asarray(rows[c])[order]
        group, block, tree, copies = group[order], column("block"), column("tree"), column("copies").astype(np.float64)
        comp = np.asarray(rows["comp"].fill_null(-1))[order]
        code, names = np.asarray(name.indices)[order], name.dictionary
        values = _fixed(rows["paths"], 2 * TREES * DEPTH).view(">u2").reshape(-1, TREES, DEPTH).astype(np.uint16)[order]
        keys = lambda d: np.stack([_node_keys(values[:, t], t, d) for t in range(TREES)])
        here, deeper = keys(level), keys(level + 1) if level < DEPTH else None
        lists = rows["shingles"].combine_chunks()
        lists = lists.take(pa.array(order))
        starts, flat = np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths(), np.int64)))), np.asarray(lists.flatten())
        sizes = np.diff(starts)
        crossing = rows["i"][0].as_py() != rows["j"][0].as_py() and rows["j"][0].as_py() >= 0
        links, weakest = np.zeros(len(names)), np.full(len(names), np.inf)
        linked_a, linked_b = [], []
        for a, b in _pairs(group, block, crossing):
            met = _meet(a, b, tree, comp, here, deeper)
            a, b = a[met], b[met]
            if not len(a):
                continue
            both = _shared(starts, flat, a, b)
            union = sizes[a] + sizes[b] - both
            good = both >= similarity * union - 1e-9
            a, b, alike = a[good], b[good], both[good] / union[good]
            ca, cb = code[a], code[b]
            links += np.bincount(ca, copies[b], len(names)) + np.bincount(cb, copies[a], len(names))
            np.minimum.at(weakest, ca, alike)
            np.minimum.at(weakest, cb, alike)
            root = _roots(len(names), ca, cb)  # what connects is enough: at most one link per class is kept
            linked_a.append(np.flatnonzero(root != np.arange(len(names))))
            linked_b.append(root[linked_a[-1]])
        if not linked_a:
            kinds = (pa.binary(), pa.binary(), pa.int64(), pa.float64())
            return pa.table({c: pa.array([], t) for c, t in zip(("class", "root", "links", "weakest"), kinds, strict=True)})
        root = _roots(len(names), np.concatenate(linked_a), np.concatenate(linked_b))
        on = np.flatnonzero(weakest < np.inf)
        return pa.table(
            {"class": names.take(pa.array(on)), "root": names.take(pa.array(root[on])), "links": pa.array(np.rint(links[on]).astype(np.int64)), "weakest": pa.array(weakest[on])}
        )

    return verify


def _thick(members: DataFrame) -> DataFrame:
    """(class, comp): classes that larger nodes, of whatever level, connect."""
    thick = members.filter(F.col("n") > SMALL).select("key", "class")
    least = thick.groupBy("key").agg(F.min("class").alias("least"))
    stars = salted(thick, least, "key", F.col("class")).filter("class <> least")
    comps = components(stars.select(F.col("class").alias("a"), F.col("least").alias("b")))
    return comps.select(F.col("node").alias("class"), F.shiftrightunsigned(F.xxhash64("label"), 1).alias("comp"))


def _groups(here: DataFrame) -> DataFrame:
    """(group, tree, comp, class, size): what is verified together. tree is -1 for a group of classes that larger
    nodes connect; in a single node, comp says which classes have such a group."""
    rest = ["class", "size"]
    inside = here.filter("comp is not null").select("comp", *rest).distinct()
    blocks = F.greatest(F.sum("size") / BLOCK, F.count("*") / BLOCK_ROWS)
    whole = inside.groupBy("comp").agg(blocks.alias("blocks")).filter(F.col("blocks") <= MOST_BLOCKS).select("comp", F.lit(True).alias("whole"))
    joined = salted(here, whole, "comp", F.col("class"), "left").withColumn("comp", F.when(F.col("whole"), F.col("comp")))
    single = joined.filter((F.col("n") <= SMALL) | F.col("comp").isNull())
    several = single.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count_if(F.col("comp").isNull()).alias("out"))
    several = several.filter("out > 0 or low <> high").select("key")  # in others, all are of one group
    single = salted(single, several, "key", F.col("class"))
    return single.select(F.col("key").alias("group"), "tree", "comp", *rest).union(
        joined.filter("comp is not null").select(F.col("comp").alias("group"), F.lit(-1).alias("tree"), F.lit(None).cast("long").alias("comp"), *rest).distinct()
    )


def _links_at(here: DataFrame, sets: DataFrame, level: int, similarity: float) -> DataFrame:
    """class, root, links, weakest: the links found at one level."""
    groups = cut(_groups(here))
    needed = F.ceil(F.greatest(F.sum("size") / BLOCK, F.count("*") / BLOCK_ROWS)).cast("int")
    large = groups.groupBy("group").agg(needed.alias("blocks")).filter("blocks > 1")
    total = groups.agg(F.sum("size").alias("w"), F.count("*").alias("rows")).first()
    units = max(1, math.ceil((total["w"] or 0) / BLOCK), math.ceil(total["rows"] / BLOCK_ROWS))
    groups = salted(groups, large, "group", F.col("class"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    groups = groups.withColumn("block", F.pmod(F.xxhash64("class", F.lit(1)), F.col("blocks")).cast("int"))
    alone = F.col("blocks") == 1
    # a group of one block goes to a unit with others, a larger one to a unit per pair of its blocks
    spread = groups.withColumn("other", F.explode(F.when(alone, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    dealt = spread.select(
        F.when(~alone, F.col("group")).alias("unit"),
        F.when(alone, F.pmod(F.xxhash64("group", F.lit(2)), F.lit(units)).cast("int")).otherwise(F.least("block", "other")).alias("i"),
        F.when(alone, F.lit(-1)).otherwise(F.greatest("block", "other")).alias("j"),
        "group", "tree", "comp", "block", "class",
    )
    return (
        dealt.join(sets, "class")
        .groupBy("unit", "i", "j")
        .applyInArrow(_verified(level, similarity), "class binary, root binary, links long, weakest double")
    )


def _linked(rows: DataFrame, classes: DataFrame, words: int, similarity: float, recall: float) -> DataFrame:
    """class, label, links: classes with a verified link to another class."""
    floor = depth_for(similarity, recall)
    members = cut(_members(_nodes(classes, floor)))
    sets = _sets_of(rows, members.select("class").distinct().join(classes, "class"), words)
    members = members.join(_thick(members), "class", "left")
    found, weakest = None, math.inf
    for level in range(DEPTH, floor - 1, -1):
        new = cut(_links_at(members.filter(F.col("level") == level), sets, level, similarity))
        least = new.agg(F.min("weakest")).first()[0]
        found = new if found is None else found.union(new)
        weakest = weakest if least is None else min(weakest, least)
        if weakest < math.inf and found_at(weakest, level) >= recall:
            break
    labels = components(found.select(F.col("class").alias("a"), F.col("root").alias("b")).filter("a <> b"))
    sums = found.groupBy("class").agg(F.sum("links").alias("links"))
    return sums.join(labels.select(F.col("node").alias("class"), "label"), "class")


def _resolved(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float, recall: float):
    """(signed rows, classes with the id and t of their component's first row, and links)."""
    hold_batches(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("t"), F.col(text_col).cast("string").alias("text"))
    signed = cut(_signed(rows, words))
    classes = cut(_classes(signed))
    linked = _linked(rows, classes, words, similarity, recall)
    known = classes.select("class", "id", "t", "copies").join(linked, "class", "left")
    known = cut(known.withColumn("label", F.coalesce("label", "class")))
    first = known.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t")).alias("f"))
    found = salted(known, first, "label", F.col("class")).select(
        "class", F.col("f.id").alias("first_id"), F.col("f.t").alias("first_t"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    return signed.drop("paths"), found


def join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL
) -> DataFrame:
    """One row per row of `docs`: id, class_id, n_links.

    class_id is the least id among the rows that are connected with it by links; n_links is the number of other rows
    whose similarity with it is `similarity` or more, like rows included. Words are lower-cased and stand between
    white space. Texts of fewer than `words` words are one shingle; texts without a word (null or empty) have no
    links and are their own class. Null ids count as rows; their class_id is null only if no linked row has an id.
    """
    signed, found = _resolved(docs, id_col, text_col, words, similarity, recall)
    joined = salted(signed.select("id", "class"), found, "class", F.monotonically_increasing_id(), "left")
    return joined.select(
        F.col("id").alias(id_col),
        F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("first_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
    )


def unique(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL
) -> DataFrame:
    """`docs` with one row of each group of linked rows, that of the least id (null ids last); texts without a word
    stay. Of rows that repeat wholly, one stays."""
    signed, found = _resolved(docs, id_col, text_col, words, similarity, recall)
    every = signed.filter("class is not null").groupBy("class", "id", "t").agg(F.count("*").alias("times"))
    judged = salted(every, found, "class", F.struct("id", "t")).withColumn("keep", F.col("id").eqNullSafe(F.col("first_id")) & (F.col("t") == F.col("first_t")))
    other = cut(judged.filter("not keep or times > 1").select("id", "t", "keep"))
    c_t, c_id, c_t2, c_keep = fresh(docs, "t", "other_id", "other_t", "keep")
    marked = docs.withColumn(c_t, F.xxhash64(F.col(text_col)))
    marks = other.toDF(c_id, c_t2, c_keep)
    if other.count() <= BROADCAST_ROWS:
        marks = F.broadcast(marks)
    marked = marked.join(marks, (F.col(c_t) == F.col(c_t2)) & F.col(id_col).cast("long").eqNullSafe(F.col(c_id)), "left")
    single = marked.filter(F.col(c_keep).isNull())
    repeated = marked.filter(c_keep).dropDuplicates([id_col, c_t])
    return single.unionByName(repeated).select(*docs.columns)
