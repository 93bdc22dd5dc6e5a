"""Near duplicates by an LSH forest of MinHash signatures (operator 2).

Texts with equal shingle sets are one node. Each tree of the forest is an order of the nodes by a
run of their MinHash values. Nodes that share a first prefix make a region; regions too full are
taken apart at deeper prefixes, and neighbours in the order of such a stretch are candidates. A
first round tests a maximum spanning forest of each stretch by the whole shingle sets. A second
round compares the whole sets of every region, however full, whose nodes are still in different
components and returns the components that a link joins, fewer rows than it read; so no link is lost
to the first round's economy, and copies are never expanded into all pairs. The comparison of a full
region is split over tasks by pairs of its parts. A pair of just PERCENT shares a region in one of
the trees with a chance of 0.9998.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

#: Words of a shingle, and percent of similarity from which texts are linked.
WORDS, PERCENT = 2, 80
#: Trees, MinHash values of a label, and of the shallowest prefix.
TREES, DEPTH, FIRST = 12, 8, 3
#: Nodes that are compared at once; larger regions go deeper.
STRETCH = 256
#: Nodes and shingles of a part of a full region, about.
PART, PART_ITEMS = 1024, 2_000_000
#: Least estimated similarity of a candidate: 3.5 standard deviations of the estimate below 0.8.
CANDIDATE = 0.7
#: Nodes up to which a list of them is broadcast (16 bytes each); beyond, the join is shuffled.
BROADCAST_NODES = 1_000_000

#: MinHash values of a signature: those of the labels, and as many again that sharpen the estimate.
_HASHES = 2 * TREES * DEPTH
_rng = np.random.RandomState(97)
_MUL = _rng.randint(0, 1 << 31, _HASHES).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.randint(0, 1 << 31, _HASHES).astype(np.uint32)


def shingles(data: np.ndarray, at: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's distinct shingles, sorted by row and hash, and how many each row has.

    A row with fewer words than size has one shingle, of all its words; without words none.
    """
    words, rows, _ = common.hashed_words(data, at, common.word_bytes())
    n = len(at) - 1
    many = np.bincount(rows, minlength=n)
    begins = np.cumsum(many) - many
    rank = np.arange(len(words)) - begins[rows]
    whole = many[rows] >= size
    code = words.copy()
    for k in range(1, size):
        after = np.concatenate([words[k:], np.zeros(min(k, len(words)), np.uint64)])
        inside = rank + k < many[rows]
        code = np.where(inside, common.mix(code * np.uint64(0x9E3779B97F4A7C15) + after), code)
    keep = np.where(whole, rank + size <= many[rows], rank == 0)
    code, rows = common.mix(code[keep] ^ np.where(whole[keep], np.uint64(size), np.uint64(0))), rows[keep]
    order = np.lexsort((code, rows))
    code, rows = code[order], rows[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (rows[1:] != rows[:-1])
    return code[new], np.bincount(rows[new], minlength=n)


def _node(code: np.ndarray, many: np.ndarray) -> np.ndarray:
    """A hash of each row's set; 0 for empty sets."""
    out = np.zeros(len(many), np.uint64)
    full = many > 0
    if len(code):
        out[full] = common.mix(np.add.reduceat(common.mix(code), (np.cumsum(many) - many)[full]) + many[full].astype(np.uint64))
    return out.view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, twin (a hash of the text), n_shingles, node (a hash of the set), labels (TREES of DEPTH 16-bit values; null for empty sets), marks (a byte of each MinHash value)."""

    def run(block: pa.RecordBatch) -> pa.RecordBatch:
        code, many = shingles(*common.raw(block.column(2)))
        signature = np.zeros((block.num_rows, _HASHES), ">u2")
        full = many > 0
        if len(code):
            starts, low = (np.cumsum(many) - many)[full], (code >> np.uint64(16)).astype(np.uint32)
            for k in range(_HASHES):
                least = np.minimum.reduceat(low * _MUL[k] + _ADD[k], starts)
                signature[full, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
        cells = lambda x: pa.array([r.tobytes() if f else None for r, f in zip(x, full.tolist(), strict=True)], pa.binary())
        columns = [block.column(0), block.column(1), pa.array(many, pa.int64()), pa.array(_node(code, many)), cells(signature[:, : TREES * DEPTH]), cells(signature.astype(np.uint8))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "twin", "n_shingles", "node", "labels", "marks"])

    source = docs.select("doc_id", F.xxhash64("text").alias("twin"), F.col("text").cast("binary").alias("text"))
    return common.map_blocks(source, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, twin long, n_shingles long, node long, labels binary, marks binary")


def packed_sets(docs: DataFrame) -> DataFrame:
    """node, items: the sorted set as 8 bytes of each shingle's hash."""

    def run(block: pa.RecordBatch) -> pa.RecordBatch:
        code, many = shingles(*common.raw(block.column(0)))
        flat, ends = code.astype("<u8").tobytes(), np.cumsum(many) * 8
        items = [flat[b - 8 * m : b] for b, m in zip(ends.tolist(), many.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(_node(code, many)), pa.array(items, pa.binary())], names=["node", "items"])

    return common.map_blocks(docs.select(F.col("text").cast("binary").alias("text")), run, "node long, items binary")


def stretches(labels: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of sorted labels (rows of DEPTH values after the tree's number) to be compared, each of STRETCH at most.

    A region shares the tree and FIRST values. If it is too full it is taken apart by one value
    more, and so on; nodes that are alike at full depth are compared in halves that overlap.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(labels), FIRST, True)]
    while todo:
        low, high, depth, fresh = todo.pop()
        if high - low < 2:
            continue
        if not fresh and high - low <= STRETCH:
            out.append((low, high))
        elif not fresh and depth == DEPTH:
            out += [(i, min(i + STRETCH, high)) for i in range(low, high - STRETCH // 2, STRETCH // 2)]
        else:
            depth += not fresh
            part = labels[low:high, : depth + 1]
            cuts = np.flatnonzero((part[1:] != part[:-1]).any(1)) + 1 + low
            todo += [(a, b, depth, False) for a, b in zip([low, *cuts.tolist()], [*cuts.tolist(), high], strict=True) if b - a > 1]
            if not fresh:  # neighbours across the cuts share the shallower prefix
                out += [(max(low, c - 2), min(high, c + 2)) for c in cuts.tolist()]
    return out


def likeness(marks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Estimated similarity of all pairs in a stretch, 0 where sizes alone keep a pair below the limit."""
    n = len(marks)
    out = np.zeros((n, n), np.float32)
    for i in range(n):
        out[i] = (marks[i] == marks).mean(1)
    out[100 * np.minimum(sizes[:, None], sizes) < PERCENT * np.maximum(sizes[:, None], sizes)] = 0
    np.fill_diagonal(out, 0)
    return out


def spanning(like: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a maximum spanning forest over pairs of at least CANDIDATE."""
    n, out = len(like), []
    best, link = np.full(n, -1.0), np.zeros(n, np.int64)
    left = np.ones(n, bool)
    for _ in range(n):
        i = int(np.where(left, best, -2).argmax())
        if best[i] >= CANDIDATE:
            out.append((int(link[i]), i))
        left[i] = False
        nearer = left & (like[i] > best)
        best[nearer], link[nearer] = like[i][nearer], i
    return out


def _cells(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """Binary cells of one width as a matrix."""
    flat = np.frombuffer(b"".join(column.to_pylist()), kind)
    return flat.reshape(len(column), -1)


def candidates(rows: DataFrame) -> DataFrame:
    """Distinct pairs a < b of rows (tree, label, node, n, marks): spanning forests of the stretches, so fewer pairs than rows in each."""

    def run(batches):
        got = pa.Table.from_batches(list(batches))
        if got.num_rows < 2:
            return
        labels = np.concatenate([got.column("tree").to_numpy()[:, None], _cells(got.column("label"), ">u2")], 1).astype(np.int32)
        marks, nodes, sizes = _cells(got.column("marks"), "u1"), got.column("node").to_numpy(), got.column("n").to_numpy()
        pairs: set[tuple[int, int]] = set()
        for low, high in stretches(labels):
            for i, j in spanning(likeness(marks[low:high], sizes[low:high])):
                a, b = int(nodes[low + i]), int(nodes[low + j])
                pairs.add((min(a, b), max(a, b)))
            if len(pairs) > 200_000:
                yield _pairs(pairs)
        yield _pairs(pairs)

    common.small_batches(rows.sparkSession, 5_000)
    ordered = rows.repartitionByRange("tree", "label", "node").sortWithinPartitions("tree", "label", "node")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def _region(label: Column, tree: Column | None = None) -> Column:
    """The region of a label, or of one tree's label among all, within its tree."""
    return F.substring(label, F.lit(1) if tree is None else tree * (2 * DEPTH) + 1, F.lit(2 * FIRST))


def unsettled(rows: DataFrame) -> DataFrame:
    """tree, region, node, root: those rows (tree, region, node, root, n, marks) of regions of STRETCH nodes at most that are likely to be linked to another root. Every region is in one task."""

    def run(batches):
        got = pa.Table.from_batches(list(batches))
        if got.num_rows < 2:
            return
        regions = np.concatenate([got.column("tree").to_numpy()[:, None], _cells(got.column("region"), ">u2")], 1)
        cuts = np.flatnonzero((regions[1:] != regions[:-1]).any(1)) + 1
        marks, roots, sizes = _cells(got.column("marks"), "u1"), got.column("root").to_numpy(), got.column("n").to_numpy()
        keep = np.zeros(got.num_rows, bool)
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), got.num_rows], strict=True):
            root = roots[low:high]
            if (root == root[0]).all():
                continue
            like = likeness(marks[low:high], sizes[low:high])
            like[root[:, None] == root] = 0
            keep[low:high] = (like >= CANDIDATE).any(1)
        yield from got.select(["tree", "region", "node", "root"]).filter(pa.array(keep)).combine_chunks().to_batches()

    common.small_batches(rows.sparkSession, 5_000)
    ordered = rows.repartitionByRange("tree", "region").sortWithinPartitions("tree", "region", "node")
    return ordered.mapInArrow(run, "tree int, region binary, node long, root long")


def joined(roots: np.ndarray, side: np.ndarray, sets: list[np.ndarray], within: bool) -> list[tuple[int, int]]:
    """Pairs of roots that a link of two sets joins, by whole sets; fewer than there are rows.

    Linked sets share one at least of their rarest items, as many as PERCENT leaves to differ and one
    more, so only rows that meet in one are compared; rows that are already joined are not. Without
    within, only rows of different sides are.
    """
    order = np.argsort([len(x) for x in sets], kind="stable")
    roots, side, sets = roots[order], side[order], [sets[k] for k in order.tolist()]
    n, sizes = len(sets), np.array([len(x) for x in sets])
    starts = np.cumsum(sizes) - sizes
    _, items, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    row, items = np.repeat(np.arange(n), sizes), rank[items]
    items = items[np.lexsort((items, row))]  # each row's items, the rarest first
    few = sizes - -(-PERCENT * sizes // 100) + 1
    head = np.flatnonzero((np.arange(len(items)) - starts[row]) < few[row])
    head = head[np.argsort(items[head], kind="stable")]
    holders = row[head]
    begin, end = np.searchsorted(items[head], np.arange(len(often))), np.searchsorted(items[head], np.arange(len(often)), side="right")
    label, held, out = roots.copy(), np.zeros(len(often), bool), []
    for i in range(n - 1):
        own = items[starts[i] : starts[i] + few[i]]
        own = own[end[own] - begin[own] > 1]
        if not len(own):
            continue
        met = np.unique(np.concatenate([holders[a:b] for a, b in zip(begin[own].tolist(), end[own].tolist(), strict=True)]))
        met = met[(met > i) & (label[met] != label[i]) & (100 * sizes[i] >= PERCENT * sizes[met])]
        if not within:
            met = met[side[met] != side[i]]
        if not len(met):
            continue
        held[items[starts[i] : starts[i] + sizes[i]]] = True
        firsts = np.cumsum(sizes[met]) - sizes[met]
        place = np.arange(int(sizes[met].sum())) + np.repeat(starts[met] - firsts, sizes[met])
        both = np.add.reduceat(held[items[place]], firsts, dtype=np.int64)
        held[items[starts[i] : starts[i] + sizes[i]]] = False
        for j in met[100 * both >= PERCENT * (sizes[i] + sizes[met] - both)].tolist():
            if label[j] != label[i]:
                out.append((int(roots[i]), int(roots[j])))
                label[label == label[j]] = label[i]
    return out


def between_parts(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Distinct pairs of roots linked within a region: rows (tree, region, node, root, parts). Each of a region's parts meets each in one task."""

    def run(key: tuple[pa.Scalar, ...], got: pa.Table) -> pa.Table:
        each = [np.frombuffer(x, "<u8") for x in got.column("items").to_pylist()]
        pairs = joined(got.column("root").to_numpy(), got.column("part").to_numpy(), each, key[2].as_py() == key[3].as_py())
        a, b = zip(*pairs, strict=True) if pairs else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    dealt = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).join(sets, "node")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("tree", "region", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "root", "items")
    return dealt.groupBy("tree", "region", "i", "j").applyInArrow(run, "a long, b long").distinct()


def _pairs(pairs: set[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    pairs.clear()
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose whole sets reach PERCENT."""

    def run(batches):
        for block in common.blocks(batches, 4 * common.BLOCK_BYTES):
            good = []
            for x, y in zip(block.column(2).to_pylist(), block.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                good.append(100 * shared >= PERCENT * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays(block.columns[:2], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    one = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    common.small_batches(pairs.sparkSession, 256)
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def sets_of(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, items: the set of each of nodes (node, first), read from the texts of the rows with doc_id first."""
    nodes = common.sized(nodes, BROADCAST_NODES)
    texts = docs.select("doc_id", "text").join(nodes, F.col("doc_id").eqNullSafe(F.col("first")), "left_semi")
    return packed_sets(texts).join(nodes, "node", "left_semi").groupBy("node").agg(F.first("items").alias("items"))


def roots_of(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, root for all linked of classes (node, first, n, labels, marks)."""
    keys = classes.select("node", "labels", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    keys = keys.select("node", "tree", _region(F.col("labels"), F.col("tree")).alias("region"))
    shared = keys.groupBy("tree", "region").agg(F.count("*").alias("c")).where("c > 1").select("tree", "region")
    member = common.staged(keys.join(shared, ["tree", "region"], "left_semi").select("tree", "node"))
    label = F.substring(F.col("labels"), F.col("tree") * (2 * DEPTH) + 1, F.lit(2 * DEPTH))
    forest = common.staged(member.join(classes, "node").select("tree", label.alias("label"), "node", "n", "marks"))
    tested = common.staged(candidates(forest))
    sets = common.staged(sets_of(common.staged(forest.select("node").distinct().join(classes.select("node", "first"), "node")), docs))
    roots = components(common.staged(confirmed(tested, sets)))
    rooted = forest.withColumn("region", _region(F.col("label"))).drop("label").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = common.staged(rooted)
    by_region = rooted.groupBy("tree", "region").agg(F.count("*").alias("c"), F.sum("n").alias("size"), (F.min("root") < F.max("root")).alias("apart"))
    parts = F.when(F.col("c") > STRETCH, F.ceil(F.greatest(F.col("c") / PART, F.col("size") / PART_ITEMS)).cast("int"))
    by_region = common.staged(by_region.where("apart").select("tree", "region", parts.alias("parts")))
    apart = rooted.join(common.sized(by_region, BROADCAST_NODES // 4), ["tree", "region"])
    small = unsettled(apart.where("parts IS NULL")).withColumn("parts", F.lit(1))
    more = common.staged(between_parts(small.unionByName(apart.where("parts IS NOT NULL").select(*small.columns)), sets))
    if more.isEmpty():
        return roots
    top = common.staged(components(more))
    named = roots.join(top.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return named.unionByName(top.join(roots, "node", "left_anti").select("node", "root"))


def groups(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, twin, n_shingles, root (of its group; null without shingles), component_id."""
    sketch = common.staged(sketches(docs))
    full = sketch.where("n_shingles > 0")
    classes = common.staged(full.groupBy("node").agg(F.min("doc_id").alias("first"), F.max("n_shingles").alias("n"), F.first("labels").alias("labels"), F.first("marks").alias("marks"), F.count("*").alias("c")))
    roots = common.staged(roots_of(classes, docs))
    least = roots.join(classes.select("node", "first"), "node").groupBy("root").agg(F.min("first").alias("component_id"))
    named = classes.select("node", "first", "c").join(roots.join(least, "root").select("node", "root", "component_id"), "node", "left")
    named = common.staged(named.select("node", "c", F.coalesce("root", "node").alias("root"), F.coalesce("component_id", "first").alias("component_id")))
    # sets of more than a thousandth of the rows are fewer than a thousand; their rows don't meet at one key
    total = sketch.count()
    heavy = named.where(F.col("c") * 1000 > total).drop("c")
    columns = ["doc_id", "twin", "n_shingles", "root", "component_id"]
    rows = full.select("doc_id", "twin", "n_shingles", "node")
    many = rows.join(F.broadcast(heavy), "node")
    others = rows.join(F.broadcast(heavy.select("node")), "node", "left_anti").join(named.where(F.col("c") * 1000 <= total).drop("c"), "node")
    none = sketch.where("n_shingles = 0").select("doc_id", "twin", "n_shingles", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id"))
    return many.select(*columns).unionByName(others.select(*columns)).unionByName(none)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Groups whole texts whose shingle sets reach PERCENT of similarity, directly or through others.

    One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable; null
    where no row of the group has one), kept (doc_id = component_id). A null, empty or blank text has
    no shingles and is alone; repeated rows each give a row; a null doc_id is never kept, but its text
    links others; an empty table gives no rows. Other columns are left out.
    """
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")
    return groups(docs).select("doc_id", "n_shingles", "component_id", kept)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, of which one stays of each group: that of the smallest doc_id (nulls last, then by a hash of the text).

    Rows without shingles are in no group and all stay. Of rows that repeat a doc_id and its text one
    stays; two texts with one doc_id are judged apart. An empty table stays empty; columns of any
    name pass through.
    """
    judged = common.staged(groups(docs).where("n_shingles > 0").select("doc_id", "twin", "root"))
    best = judged.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "twin")).alias("b"))
    best = common.staged(best.select(F.col("b.doc_id").alias("_id"), F.col("b.twin").alias("_twin")))
    twin = common.fresh("twin", docs.columns)
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    gone = common.staged(judged.join(best, same & (F.col("twin") == F.col("_twin")), "left_anti").select(F.col("doc_id").alias("_id"), F.col("twin").alias("_twin")).distinct())
    here = docs.withColumn(twin, F.xxhash64("text"))
    on = lambda other: here["doc_id"].eqNullSafe(other["_id"]) & (here[twin] == other["_twin"])
    here = here.join(other := common.sized(gone, BROADCAST_NODES), on(other), "left_anti")
    again = common.staged(judged.join(best, same & (F.col("twin") == F.col("_twin")), "left_semi").groupBy(F.col("doc_id").alias("_id"), F.col("twin").alias("_twin")).agg(F.count("*").alias("c")).where("c > 1").drop("c"))
    if again.isEmpty():
        return here.select(*docs.columns)
    once = here.join(again, on(again), "left_semi").dropDuplicates(["doc_id", twin])
    return here.join(again, on(again), "left_anti").unionByName(once).select(*docs.columns)


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
