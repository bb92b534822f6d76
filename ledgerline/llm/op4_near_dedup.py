"""Near-duplicates by a chosen-path set similarity join.

Documents with the same shingle set form a class, and one representative of each class goes on. Its set has a
signature of minwise values. In each of several independent trees the representatives are branched by a minwise value
chosen by the tree; a node that holds more than `limit` of them branches again, each member going to the children that
two further values chosen by the node's path lead to. Nodes that are small are compared exhaustively.

Branching no longer parts a tight family of different texts. Such a node is dealt into blocks that all hold the same
few of its members, its pivots, so that what is alike joins up around them. Once those links are merged, only members
outside the node's largest component are left over, few in a family; they are compared with all members of the node, block
by block. So a family costs rows in proportion to its members and to those left over, and loses no pair.

A comparison first asks short sketches (a byte of each minwise value) whether two members can be similar enough, which
leaves the clusters of a node; clusters that several trees find alike are kept once. The clusters then get the full
shingle sets, made again from the whole texts, and a pair counts as a link only if its full sets say so. A cluster
returns its members with the smallest one linked to them, never its pairs; its sets are read in ranges of their values, so that
a task holds one range of them (about RANGE elements) and a table of counts, whatever the lengths of the texts. Components
follow by star rounds.

A pair at the threshold falls into one node of a tree with probability of at least 0.82. All trees ask the same sketch, which
misses such a pair with probability sketch_miss() (below 0.00002). The number of trees is the least that finds the pair with
probability `recall` in spite of both; tests measure it on pairs at the threshold.

Cases: texts without words, and null texts, have an empty set and are linked with nothing. Rows with a null identifier are
returned alone with a null component_id, kept. Rows that share an identifier are one document: it is linked with whatever any of
its texts is, and all its rows have one component_id. Ties do not arise: the smallest identifier names a component. Very long
texts are read whole, for which a worker needs about 33 bytes a character. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import mix64, shingle_set, staged, table
from ledgerline.llm.components import components

COORDINATES = 64
#: Sketch bytes that may disagree for a pair to be compared in full: as many standard deviations from what the threshold expects.
SLACK = 4.5
#: Chance that a pair at the threshold shares a node of one tree (0.85 at the root, 0.96 over all further levels).
TREE_CHANCE = 0.82
#: A node that keeps more than this share of the node above is a tight family; and the most branchings of any node.
TIGHT, MOST_LEVELS = 0.8, 30
#: Members of a tight family that all its blocks hold, and elements of a cluster's sets that are compared at a time.
PIVOTS, RANGE = 64, 1 << 22
_SEEDS = mix64(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_ADD = mix64(np.arange(1001, COORDINATES + 1001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def minwise(shingles: np.ndarray) -> np.ndarray:
    """COORDINATES minwise values of a non-empty set."""
    least = None
    for at in range(0, len(shingles), 4096):
        part = (shingles[at : at + 4096, None] * _SEEDS + _ADD).min(axis=0)
        least = part if least is None else np.minimum(least, part)
    return least


def digest_of(shingles: np.ndarray) -> bytes:
    """What names a set: sets with the same digest are equal."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(doc_id, n_shingles, digest, signature, sketch) of every row; digest and the rest are null for an empty set."""
    read = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = T.StructType(
        [
            T.StructField("doc_id", read.schema["doc_id"].dataType),
            T.StructField("n_shingles", T.LongType()),
            T.StructField("digest", T.BinaryType()),
            T.StructField("signature", T.ArrayType(T.LongType(), False)),
            T.StructField("sketch", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, values, sketches = [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), words)
                sizes.append(len(s))
                if len(s):
                    v = minwise(s)
                    digests.append(digest_of(s))
                    values.append(v.view(np.int64))
                    sketches.append((mix64(v) & np.uint64(255)).astype(np.uint8).tobytes())
                else:
                    digests.append(None)
                    values.append(None)
                    sketches.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(values, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=schema.names)

    return read.mapInArrow(run, schema)


# --- the trees -----------------------------------------------------------------------------------------------------------


def _sized(rows: DataFrame) -> DataFrame:
    """Rows (node, rep, parent) whose node has at least two members, with that number.

    The numbers are staged: both sides of the join are then plain shuffles, of which Spark can split the rows of a hot node.
    """
    sizes = staged(rows.groupBy("node").agg(F.count("*").alias("members")).where("members > 1"))
    return rows.join(sizes, "node")


def _root(classes: DataFrame, trees: int) -> DataFrame:
    """Level one: in tree r, the node of a representative is its r-th minwise value. parent is the size of the node above, null here."""
    nodes = [F.xxhash64(F.lit(r), F.element_at("signature", r + 1)) for r in range(trees)]
    return classes.select(F.explode(F.array(*nodes)).alias("node"), "rep", F.lit(None).cast("long").alias("parent"))


def _children(large: DataFrame, classes: DataFrame, branches: int) -> DataFrame:
    """The next level below large nodes: the path so far chooses which minwise values a node branches by."""
    at = [F.pmod(F.xxhash64("node", F.lit(b)), F.lit(COORDINATES)).cast("int") + 1 for b in range(branches)]
    nodes = [F.xxhash64("node", F.lit(b), F.element_at("signature", c)) for b, c in enumerate(at)]
    met = large.select("node", "rep", F.col("members").alias("parent")).join(classes.select("rep", "signature"), "rep")
    return met.select(F.explode(F.array(*nodes)).alias("node"), "rep", "parent").distinct()


def leaves(classes: DataFrame, trees: int, limit: int, levels: int, branches: int = 2) -> tuple[DataFrame, DataFrame | None]:
    """(node, rep) of all small nodes, and (node, rep, members) of all tight families, if any; classes has (rep, signature) and is materialised.

    From `levels` branchings on, a large node that kept more than TIGHT of the members of the node above is a family whose
    members are alike. All other large nodes, such as those of different texts with a common passage, branch on until they are
    small, at most MOST_LEVELS times.
    """
    rows, small, tight = _root(classes, trees), None, None
    for level in range(MOST_LEVELS + 1):
        sized = staged(_sized(rows))
        done, large = sized.where(F.col("members") <= limit).select("node", "rep"), sized.where(F.col("members") > limit)
        small = done if small is None else small.unionByName(done)
        if level >= levels:
            stuck = F.lit(level == MOST_LEVELS) | F.coalesce(F.col("members") > TIGHT * F.col("parent"), F.lit(False))
            family = large.where(stuck).select("node", "rep", "members")
            if not family.isEmpty():
                tight = family if tight is None else tight.unionByName(family)
            large = large.where(~stuck)
        if large.isEmpty():
            break
        rows = staged(_children(large, classes, branches))
    return small, tight


def _dealt(rows: DataFrame, size: int, count: str = "members") -> DataFrame:
    """rows with n, the number of blocks of about size members that its node is dealt into, and own, the block of the row."""
    n = F.ceil(F.col(count) / F.lit(size)).cast("int")
    return rows.withColumn("n", n).withColumn("own", F.pmod(F.xxhash64("rep", "node", F.lit("block")), F.col("n")).cast("int"))


def pivot_blocks(tight: DataFrame, limit: int, pivots: int) -> DataFrame:
    """(node, rep): every family as blocks of about half of limit members, and its pivots, about `pivots` members picked by a hash, in each of them."""
    rows = _dealt(tight, max(1, limit // 2))
    chance = F.pmod(F.xxhash64("rep", "node", F.lit("pivot")), F.lit(1 << 40))
    near = rows.where(chance < F.lit(float(1 << 40)) * F.lit(pivots) / F.col("members"))
    everywhere = near.withColumn("own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return rows.unionByName(everywhere).select(F.xxhash64("node", "own").alias("node"), "rep").distinct()


def left_over_blocks(tight: DataFrame, member: DataFrame, limit: int) -> DataFrame:
    """(node, rep): blocks in which every member of a family that is outside its node's largest component meets every member.

    member has (node, component) for all representatives that are not the smallest of their component.
    """
    named = member.select(F.col("node").alias("rep"), "component")
    rows = tight.join(named, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    sizes = rows.groupBy("node", "component").agg(F.count("*").alias("size"), F.first("members").alias("members"))
    main = sizes.groupBy("node").agg(F.max(F.struct("size", "component")).alias("main"), F.first("members").alias("members"))
    main = staged(main.select("node", F.col("main.component").alias("main"), (F.col("members") - F.col("main.size")).alias("rest")).where("rest > 0"))
    rows = staged(rows.join(main, "node"))
    half = max(1, limit // 2)
    every = _dealt(rows, half).withColumn("blocks", F.ceil(F.col("rest") / F.lit(half)).cast("int"))
    outside = _dealt(rows.where("component <> main"), half, "rest").withColumn("blocks", F.ceil(F.col("members") / F.lit(half)).cast("int"))
    every = every.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("node", "rep", "own", "other")
    outside = outside.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("node", "rep", F.col("other").alias("own"), F.col("own").alias("other"))
    return every.unionByName(outside).select(F.xxhash64("node", "own", "other", F.lit("left over")).alias("node"), "rep").distinct()


# --- comparison within nodes ---------------------------------------------------------------------------------------------


def _runs(batches: Iterator[pa.RecordBatch], most_rows: int) -> Iterator[pa.Table]:
    """Tables of whole runs of equal first columns, of about most_rows rows; the input is sorted by that column."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < most_rows:
            continue
        whole = pa.Table.from_batches(held)
        key = whole.column(0).to_numpy()
        last = int(np.searchsorted(key, key[-1]))
        if last:
            yield whole.slice(0, last)
        held = whole.slice(last).to_batches()
        rows = whole.num_rows - last
    if held:
        yield pa.Table.from_batches(held)


def _labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """label (the smallest index that each item is connected to) after pairs (i, j) connect more of them."""
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if np.array_equal(label, before):
            return label


def _bytes_matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def least_agreeing(percent: int) -> int:
    """Bytes of two sketches that have to agree for the pair to be compared in full."""
    share = percent / 100
    return max(0, math.floor(COORDINATES * share - SLACK * math.sqrt(COORDINATES * share * (1 - share))))


def sketch_miss(percent: int) -> float:
    """The chance that a pair at the threshold has fewer agreeing minwise values than that (bytes that agree by chance only help)."""
    share = percent / 100
    return sum(math.comb(COORDINATES, k) * share**k * (1 - share) ** (COORDINATES - k) for k in range(least_agreeing(percent)))


def trees_for(recall: float, percent: int) -> int:
    """The least number of trees that finds a pair at the threshold with that probability, sketch included."""
    lost = 1 - recall - sketch_miss(percent)
    trees = max(1, math.ceil(math.log(lost) / math.log(1 - TREE_CHANCE))) if lost > 0 else COORDINATES + 1
    if trees > COORDINATES:
        raise ValueError("this recall is beyond what the sketch and the minwise values can give")
    return trees


def sketch_clusters(members: DataFrame, percent: int) -> DataFrame:
    """(cluster, rep): in each node of (node, rep, n_shingles, sketch), the members that sketches connect to another one."""
    least = least_agreeing(percent)
    schema = T.StructType([T.StructField("cluster", T.LongType()), T.StructField("rep", members.schema["rep"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches, 16_384):
            node, size = part.column("node").to_numpy(), part.column("n_shingles").to_numpy()
            sketch = _bytes_matrix(part.column("sketch"), COORDINATES)
            at, step, label = np.arange(len(node) - 1), 1, np.arange(len(node))
            while len(at):
                at = at[at + step < len(node)]
                at = at[node[at] == node[at + step]]
                pair = at[label[at] != label[at + step]]  # what is connected already needs no comparison
                a, b = size[pair], size[pair + step]
                pair = pair[100 * np.minimum(a, b) >= percent * np.maximum(a, b)]
                pair = pair[(sketch[pair] == sketch[pair + step]).sum(axis=1) >= least]
                if len(pair):
                    label = _labels(label, pair, pair + step)
                step += 1
            many = np.bincount(label, minlength=len(node))[label] > 1
            rep = part.column("rep").combine_chunks().filter(pa.array(many))
            label = np.unique(label[many], return_inverse=True)[1]
            name = np.zeros(int(label.max()) + 1 if len(label) else 0, np.uint64)
            np.add.at(name, label, mix64(rep.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) + np.uint64(1)))
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)[label]), rep], names=schema.names)

    sorted_rows = members.select("node", "rep", "n_shingles", "sketch").repartition("node").sortWithinPartitions("node", "rep")
    return sorted_rows.mapInArrow(run, schema).distinct()


def add_intersections(sets: list[np.ndarray], out: np.ndarray, width: int = 1 << 14) -> None:
    """Adds the sizes of the pairwise intersections (above the diagonal) of sorted distinct sets to out, exactly.

    The elements that several sets share are the columns of a bit matrix, of which `width` are worked on at a time.
    """
    m = len(sets)
    if m == 2:
        out[0, 1] += len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return
    owner = np.repeat(np.arange(m), [len(x) for x in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    column, keep = (np.cumsum(shared) - 1)[place], shared[place]
    owner, column = owner[keep], column[keep]
    for low in range(0, int(shared.sum()), width):
        inside = (column >= low) & (column < low + width)
        bits = np.zeros((m, width), bool)
        bits[owner[inside], column[inside] - low] = True
        packed = np.packbits(bits, axis=1).view(np.uint64)
        for i in range(m - 1):
            out[i, i + 1 :] += np.bitwise_count(packed[i + 1 :] & packed[i]).sum(axis=1, dtype=np.int64)


def in_ranges(clusters: DataFrame, sets: DataFrame, n_range: int = RANGE) -> DataFrame:
    """(cluster, part, rep, size, shingles): the sets (digest, shingles) in each cluster (cluster, rep, n_shingles, digest), cut into ranges of values.

    A cluster has as many ranges as give about n_range elements each: all its sets are cut at the same values.
    """
    total = staged(clusters.groupBy("cluster").agg(F.sum("n_shingles").alias("total")))
    parts = F.ceil(F.col("total") / F.lit(n_range)).cast("int")
    met = clusters.select("cluster", "rep", "digest").join(total.select("cluster", parts.alias("parts")), "cluster").join(sets, "digest")
    schema = T.StructType([met.schema["cluster"], T.StructField("part", T.IntegerType()), met.schema["rep"], T.StructField("size", T.LongType()), met.schema["shingles"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, part, size, out = [], [], [], []
            for k, (n, shingles) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2))):
                held = np.frombuffer(shingles.as_buffer(), np.uint64)
                cuts = np.array([(i << 64) // n for i in range(1, n)], np.uint64)
                ends = [0, *np.searchsorted(held, cuts), len(held)]
                row.extend([k] * n)
                part.extend(range(n))
                size.extend([len(held)] * n)
                out.extend(held[a:b].tobytes() for a, b in zip(ends, ends[1:]))
            taken = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), pa.array(part, pa.int32()), batch.column(3).take(taken), pa.array(size, pa.int64()), pa.array(out, pa.binary())], names=schema.names)

    return met.select("cluster", "parts", "shingles", "rep").mapInArrow(run, schema)


def confirmed_links(clusters: DataFrame, percent: int) -> DataFrame:
    """(u, v) for the rows of in_ranges: each member with the smallest one that links of full sets connect it to.

    The ranges of a cluster follow one another; only the counts of its pairs are kept from one to the next.
    """
    kind = clusters.schema["rep"].dataType
    schema = T.StructType([T.StructField("u", kind), T.StructField("v", kind)])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, np.ndarray, list[np.ndarray]]]:
        """(cluster, members, their sizes, their sets) of each range, in order."""
        now, reps, sizes, sets = None, [], [], []
        for batch in batches:
            names, parts, own, whole = (batch.column(k).to_pylist() for k in range(4))
            for k, key in enumerate(zip(names, parts)):
                if key != now:
                    if reps:
                        yield now[0], reps, np.array(sizes), sets
                    now, reps, sizes, sets = key, [], [], []
                reps.append(own[k])
                sizes.append(whole[k])
                sets.append(np.frombuffer(batch.column(4)[k].as_py(), np.uint64))
        if reps:
            yield now[0], reps, np.array(sizes), sets

    def linked(reps: list, size: np.ndarray, both: np.ndarray) -> tuple[list, list]:
        i, j = np.nonzero(np.triu(100 * both >= percent * (size[:, None] + size[None, :] - both), 1))
        low = _labels(np.arange(len(reps)), i, j)
        moved = np.flatnonzero(low != np.arange(len(reps)))
        return [reps[k] for k in moved], [reps[low[k]] for k in moved]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, u, v = None, None, [], []
        for name, reps, size, sets in groups(batches):
            if name != now:
                if held is not None:
                    for out, found in zip((u, v), linked(*held)):
                        out.extend(found)
                now, held = name, (reps, size, np.zeros((len(reps), len(reps)), np.int64))
            add_intersections(sets, held[2])
            if len(u) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=schema.names)
                u, v = [], []
        if held is not None:
            for out, found in zip((u, v), linked(*held)):
                out.extend(found)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=schema.names)

    ordered = clusters.select("cluster", "part", "rep", "size", "shingles").repartition("cluster").sortWithinPartitions("cluster", "part", "rep")
    return ordered.mapInArrow(run, schema)


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(digest, shingles) of the classes (doc_id, digest), made from the whole texts of the documents that hold them.

    wanted grows with the corpus, so it is never broadcast, on small inputs either.
    """
    read = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    met = read.join(staged(wanted.select("doc_id").distinct()).hint("merge"), "doc_id", "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for t in batch.column(0) if len(s := shingle_set(t.as_py(), words))]
            yield pa.RecordBatch.from_arrays([pa.array([digest_of(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["digest", "shingles"])

    return met.mapInArrow(run, "digest binary, shingles binary").dropDuplicates(["digest"])


def links_in(nodes: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, id_col: str, text_col: str, words: int) -> DataFrame:
    """(u, v): links of full sets between members of the same node of (node, rep), as spanning links of what is connected."""
    found = nodes.join(classes.select("rep", "n_shingles", "sketch"), "rep")
    clusters = staged(sketch_clusters(found, percent).join(classes.select("rep", "n_shingles", "digest", "doc_id"), "rep"))
    sets = staged(full_sets(docs, clusters.select("doc_id"), id_col, text_col, words))
    return staged(confirmed_links(in_ranges(clusters, sets), percent))


def shared_ids(named: DataFrame, classes: DataFrame) -> DataFrame:
    """(u, v): the classes that the texts of one identifier lie in, each with the first of them."""
    several = named.groupBy("doc_id").agg(F.min("digest").alias("one"), F.max("digest").alias("other")).where("one <> other").select("doc_id")
    held = named.select("doc_id", "digest").join(several, "doc_id").distinct().join(classes.select("digest", "rep"), "digest").select("doc_id", "rep")
    least = staged(held.groupBy("doc_id").agg(F.min("rep").alias("v")))
    return held.join(least, "doc_id").where("rep > v").select(F.col("rep").alias("u"), "v")


def named_components(classes: DataFrame, member: DataFrame) -> DataFrame:
    """(digest, component_id) of every class: the smallest identifier that its component holds."""
    own = classes.select("digest", "doc_id", "rep").join(member.withColumnRenamed("node", "rep"), "rep", "left")
    own = staged(own.select("digest", "doc_id", F.coalesce("component", "rep").alias("component")))
    names = staged(own.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    return own.select("digest", "component").join(names, "component").select("digest", "component_id")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, percent: int = 85, words: int = 5, recall: float = 0.9999, limit: int = 2048, levels: int = 5, pivots: int = PIVOTS
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of docs, whose identifiers are integers."""
    trees = trees_for(recall, percent)
    rows = staged(signatures(docs, id_col, text_col, words).withColumn("row", F.monotonically_increasing_id()))
    named = rows.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    # A class is named by its first row, since one identifier may be the smallest of several classes.
    about = (F.min("row").alias("rep"), F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("n_shingles", "signature", "sketch")))
    classes = staged(named.groupBy("digest").agg(*about))
    small, tight = leaves(classes, trees, limit, levels)
    if tight is not None:
        tight = staged(tight)
        small = small.unionByName(pivot_blocks(tight, limit, pivots))
    links = links_in(small, classes, docs, percent, id_col, text_col, words).unionByName(shared_ids(named, classes))
    member = components(links)
    if tight is not None:
        rest = staged(left_over_blocks(tight, member, limit))
        if not rest.isEmpty():
            member = components(links.unionByName(links_in(rest, classes, docs, percent, id_col, text_col, words)))

    of_class = staged(named_components(classes, member))
    of_id = named.select("doc_id", "digest").join(of_class, "digest").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    known = rows.where("doc_id IS NOT NULL").select("doc_id", "n_shingles").join(staged(of_id), "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    unnamed = rows.where("doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return known.unionByName(unnamed).select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
