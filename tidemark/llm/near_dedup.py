"""Near-duplicate groups by a MinHash LSH forest, confirmed on full shingle sets.

Signatures of TREES trees with DEPTH values each are computed once per document; documents with the same shingle set are one node
from there on. Each tree sorts the nodes by its values. Nodes that share a tree's first values (root_depth of them) are a region of
its order; inside, a node's candidates are the neighbours before it with which its common prefix is longest:

* The depth adapts to the region. In one of at most WIDTH nodes, every node before is a candidate, whatever lies below the root depth.
  In a denser one a node goes as deep as the prefix that it shares with its nearest neighbour, and takes the NEAR nearest that share it.
* Families of copies with edits of their own are like their original, not like one another, so in dense regions the node with the
  fewest shingles of its own is a candidate for all, at the root depth, at full depth and between. And a node with more shingles of its
  own than the threshold leaves room for can't be linked in dense regions (its similarity with any set is at most the share of its
  other shingles), so it leaves them.
* What is cut off so is found exactly: where a dense region still holds several components, the nodes outside its largest one look for
  all others that they could be linked with through their rarest shingles.

Candidates are confirmed on the full sets: all from small regions, and from dense ones of each node the neighbour and the original that
most trees name. So no partner is lost to a cap, and a family of thousands of copies costs a few comparisons a node.
An order of a dense region is cut into lanes of some LANE nodes, drawn by hash and anew in each tree, so none is sorted by one task.

With 16 trees and root depth 4, a pair at similarity 0.85 shares no region with probability 7e-6; with depth 3 at 0.8, 1e-5.

Defined cases: null text and text without words have an empty set and are linked with nothing; a text with fewer words than a shingle
has the whole sequence as its one shingle; a node all of whose ids are null isn't linked; rows that repeat an id and a text share the
component; an empty table gives an empty table; other columns are not read, and kept_rows returns them whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import words
from tidemark.llm.common import cut, join_small, rows_with, shield, small_side, unshield
from tidemark.llm.components import components, with_links

TREES, DEPTH = 16, 8
#: Nodes of a region in which all are candidates of one another; nearest neighbours in a denser one; nodes of a lane.
WIDTH, NEAR, LANE = 8, 2, 1000

_draw = np.random.Generator(np.random.PCG64(7))
_FACTOR = _draw.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32) | np.uint32(1)
_SHIFT = _draw.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)


def root_depth(percent: int) -> int:
    return 4 if percent >= 85 else 3


def signature(s: np.ndarray) -> np.ndarray:
    """TREES * DEPTH minima over a set's hashes."""
    low, high = s.astype(np.uint32), (s >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    out = np.full(TREES * DEPTH, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(s), 1024):
        x, y = low[at : at + 1024], high[at : at + 1024]
        h = np.multiply.outer(_FACTOR, x)
        h += _SHIFT[:, None]
        h ^= h >> np.uint32(15)
        h *= y[None, :]
        np.minimum(out, h.min(axis=1), out=out)
    return out


def fingerprint(s: np.ndarray) -> bytes:
    """128 bits of a set."""
    with np.errstate(over="ignore"):
        return int(words.mixed(s).sum(dtype=np.uint64)).to_bytes(8, "big") + int(words.mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)).to_bytes(8, "big")


def signatures(docs: DataFrame, n: int, *, id: str, text: str) -> DataFrame:
    """_id, _digest (of the text), _size (of the set), _node (fingerprint of the set, null if it is empty), _signature."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, many in words.by_text(batch.column(2), words.SPACED):
                sets = [words.shingles(w, n) for w in many]
                full = [len(s) > 0 for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(first, len(many)) for i in (0, 1)), pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) if f else None for s, f in zip(sets, full)], pa.binary()), pa.array([signature(s).view(np.int32) if f else None for s, f in zip(sets, full)], pa.list_(pa.int32()))],
                    names=["_id", "_digest", "_size", "_node", "_signature"],
                )

    return docs.select(F.col(id).cast("long"), text_digest(text), F.col(text).cast("string")).mapInArrow(read, "_id long, _digest binary, _size long, _node binary, _signature array<int>")


def text_digest(text: str):
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))


def full_sets(docs: DataFrame, nodes: DataFrame, n: int, *, id: str, text: str) -> DataFrame:
    """_n, _set (sorted hashes) of the given nodes (_n, _node, _of: the id of one document of each); only those texts are read again."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, many in words.by_text(batch.column(0), words.SPACED):
                sets = [words.shingles(w, n) for w in many]
                yield pa.RecordBatch.from_arrays([pa.array([fingerprint(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["_node", "_set"])

    texts = rows_with(docs.select(F.col(id).cast("long").alias("_of"), F.col(text).cast("string").alias("_text")), nodes, "_of")
    nodes = small_side(nodes)
    sets = texts.select("_text").mapInArrow(read, "_node binary, _set array<long>")
    return sets.join(nodes.select("_node", "_n"), "_node").select("_n", "_set").dropDuplicates(["_n"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (_a, _b), which are cut already, whose sets are similar enough."""
    pairs = small_side(pairs)
    a, b = (sets.select(F.col("_n").alias(f"_{k}"), F.col("_set").alias(f"_set_{k}")) for k in "ab")
    needed = b.join(pairs.select("_b"), "_b", "left_semi")
    both = a.join(pairs, "_a").join(needed, "_b").withColumn("_common", F.size(F.array_intersect("_set_a", "_set_b")))
    return both.where(100 * F.col("_common") >= percent * (F.size("_set_a") + F.size("_set_b") - F.col("_common"))).select("_a", "_b")


def by_prefix(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Every pair (_a, _b) of nodes (_n, _root, _outside) of different roots, at least one of them outside, that can be similar
    enough: with shingles in one order, rare ones first, both have a common shingle among their first |set| - need + 1, and what
    follows the first common one leaves room for the overlap. This is exact, and copies of one text that differ too much to be linked
    begin with their own edits, so they hardly meet."""
    tokens = nodes.join(sets, "_n").select("_n", "_root", "_outside", F.size("_set").alias("_size"), F.explode("_set").alias("_hash"))
    counts = tokens.groupBy("_hash").agg(F.count("*").alias("_df"))
    listed = tokens.join(counts, "_hash").groupBy("_n", "_root", "_outside", "_size").agg(F.array_sort(F.collect_set(F.struct("_df", "_hash"))).alias("_order"))
    length = F.col("_size") - F.ceil(F.col("_size") * percent / 100) + 1
    prefix = cut(listed.select("_n", "_root", "_outside", "_size", F.posexplode(F.slice("_order", F.lit(1), length.cast("int"))).alias("_at", "_t")).where("_t._df > 1").select("_n", "_root", "_outside", "_size", "_at", F.col("_t._hash").alias("_hash")))
    x = prefix.where("_outside").select("_hash", *[F.col(c).alias(f"{c}x") for c in ("_n", "_root", "_size", "_at")])
    room = F.least(F.col("_size") - F.col("_at"), F.col("_sizex") - F.col("_atx"))
    can = (F.col("_root") != F.col("_rootx")) & (100 * room >= percent * (F.col("_size") + F.col("_sizex") - room))
    return x.join(prefix, "_hash").where(can).select(*_pair("_n", "_nx")).distinct()


def _pair(x: str, y: str):
    return F.least(x, y).alias("_a"), F.greatest(x, y).alias("_b")


def common_prefix(a, b, length: int):
    """How many of the first values of two arrays of this length agree."""
    out = F.lit(length)
    for i in reversed(range(length)):
        out = F.when(F.get(a, F.lit(i)) != F.get(b, F.lit(i)), i).otherwise(out)
    return out


def neighbours(rows: DataFrame, length: int) -> DataFrame:
    """_x, _y, _kind: the candidates _y of the nodes _x from the orders of all trees, of rows (_key, _many, _n, _rest: the values below
    the root depth); _kind is 1 in dense regions, else 0."""
    lane = F.pmod(F.xxhash64("_key", "_n"), F.ceil(F.col("_many") / LANE))
    order = Window.partitionBy("_key", "_lane").orderBy("_rest", "_n")
    before = [F.lag(F.struct("_n", "_rest"), k).over(order).alias(f"_b{k}") for k in range(1, WIDTH)]
    seen = rows.withColumn("_lane", lane).select("_many", "_n", "_rest", *before)
    depth = common_prefix(F.col("_rest"), F.col("_b1._rest"), length)
    near = [F.col(f"_b{k}._n") if k <= NEAR else F.when(F.col("_many") <= WIDTH, F.col(f"_b{k}._n")) for k in range(1, WIDTH)]
    deep = [F.when((F.col("_many") <= WIDTH) | (common_prefix(F.col("_rest"), F.col(f"_b{k}._rest"), length) >= depth), near[k - 1]) for k in range(1, WIDTH)]
    return seen.select(F.col("_n").alias("_x"), F.explode(F.array(*deep)).alias("_y"), (F.col("_many") > WIDTH).cast("int").alias("_kind")).where("_y is not null")


def links(nodes: DataFrame, docs: DataFrame, n: int, percent: int, *, id: str, text: str) -> DataFrame:
    """(_node, _root) of the nodes (_n, _node, _of, _size, _signature) that are linked."""
    depth = root_depth(percent)
    length = DEPTH - depth
    values = lambda first, many: F.slice("_signature", F.col("_tree") * DEPTH + first, many)
    exploded = nodes.where("_of is not null").select("_n", "_signature", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("_tree"))
    trees = exploded.select("_n", F.xxhash64("_tree", values(1, depth)).alias("_key"), values(1 + depth, length).alias("_rest"))
    counts = cut(trees.groupBy("_key").agg(F.count("*").alias("_many")).where("_many > 1"))
    members = cut(join_small(trees, counts, "_key"))
    met = cut(members.groupBy("_n").agg(F.max("_many").alias("_most")))
    everyone = cut(join_small(nodes.select("_n", "_node", "_of", "_size"), met, "_n"))
    # Own shingles of the nodes of dense regions.
    crowd_sets = cut(full_sets(docs, everyone.where(F.col("_most") > WIDTH), n, id=id, text=text))
    alone = crowd_sets.select("_n", F.explode("_set").alias("_hash")).groupBy("_hash").agg(F.count("*").alias("_in"), F.min("_n").alias("_n")).where("_in = 1").groupBy("_n").agg(F.count("*").alias("_own"))
    crowd = everyone.where(F.col("_most") > WIDTH).join(alone, "_n", "left").select("_n", "_size", F.coalesce("_own", F.lit(0)).alias("_own"))
    # A node that leaves the dense regions stays in the others: its partners there needn't be of the crowd.
    crowd = cut(crowd.where(100 * (F.col("_size") - F.col("_own")) >= percent * F.col("_size")).select("_n", "_own"))
    dense = cut(join_small(members.where(F.col("_many") > WIDTH), crowd, "_n"))
    sorted_rows = members.where(F.col("_many") <= WIDTH).select("_key", "_many", "_n", "_rest").unionByName(dense.select("_key", "_many", "_n", "_rest"))
    level = [F.xxhash64("_key", F.slice("_rest", 1, k)) for k in sorted({0, length // 2, length})]
    levelled = dense.select("_n", "_own", F.explode(F.array(*level)).alias("_part"))
    centres = cut(levelled.groupBy("_part").agg(F.min(F.struct("_own", "_n")).alias("_best"), F.count("*").alias("_many")).where("_many > 1").select("_part", F.col("_best._n").alias("_y")))
    central = join_small(levelled, centres, "_part").where("_n <> _y").select(F.col("_n").alias("_x"), "_y", F.lit(2).alias("_kind"))
    candidates = cut(neighbours(sorted_rows, length).unionByName(central).groupBy("_x", "_y", "_kind").agg(F.count("*").alias("_trees")))
    best = candidates.where("_kind > 0").groupBy("_x", "_kind").agg(F.max(F.struct("_trees", "_y")).alias("_best")).select(*_pair("_x", "_best._y"))
    pairs = cut(candidates.where("_kind = 0").select(*_pair("_x", "_y")).union(best).distinct())
    ends = pairs.select(F.col("_a").alias("_n")).union(pairs.select(F.col("_b").alias("_n"))).distinct()
    rest = cut(ends.join(crowd_sets.select("_n"), "_n", "left_anti").join(everyone, "_n"))
    sets = cut(crowd_sets.unionByName(full_sets(docs, rest, n, id=id, text=text)))
    roots = components(cut(confirmed(pairs, sets, percent)))
    # What the neighbours didn't reach: the nodes outside the largest component of a dense region, against all others of dense regions
    # that still hold several components.
    rooted = cut(join_small(dense.select("_key", "_n"), roots.withColumnRenamed("_node", "_n"), "_n", "left").select("_key", "_n", F.coalesce("_root", "_n").alias("_root")))
    by_root = rooted.groupBy("_key", "_root").agg(F.count("*").alias("_many"))
    main = cut(by_root.groupBy("_key").agg(F.max(F.struct("_many", "_root")).alias("_main"), F.count("*").alias("_roots")).where("_roots > 1").select("_key", F.col("_main._root").alias("_main")))
    if main.isEmpty():
        return roots
    split = cut(join_small(rooted, main, "_key").groupBy("_n").agg(F.first("_root").alias("_root"), F.max(F.col("_root") != F.col("_main")).alias("_outside")))
    more = cut(join_small(by_prefix(split, sets, percent), pairs, ["_a", "_b"], "left_anti"))
    more = more if more.isEmpty() else cut(confirmed(more, sets, percent))
    return roots if more.isEmpty() else with_links(roots, more)


def near_groups(docs: DataFrame, *, shingle: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept, _node (the set's fingerprint), _digest (of the text)."""
    slim = cut(signatures(docs, shingle, id=id, text=text))
    nodes = cut(slim.where("_node is not null").groupBy("_node").agg(F.min("_id").alias("_of"), F.first("_size").alias("_size"), F.first("_signature").alias("_signature"), F.count("*").alias("_rows")))
    nodes = nodes.withColumn("_n", F.monotonically_increasing_id())  # of files that are written, so always the same
    roots = links(nodes, docs, shingle, percent, id=id, text=text)
    rooted = join_small(nodes.select(F.col("_n").alias("_node"), "_of", F.col("_node").alias("_print")), roots, "_node")
    firsts = rooted.groupBy("_root").agg(F.min("_of").alias("_first"))
    # Sets of several rows or with a link; every other document is its own component.
    of = rooted.join(firsts, "_root").select(F.col("_print").alias("_node"), "_first")
    shared = nodes.where("_rows > 1").select("_node", "_of")
    named = cut(shared.join(of, "_node", "full").select("_node", F.coalesce("_first", "_of").alias("_component")))
    out = join_small(slim.select("_id", "_digest", "_size", "_node"), named, "_node", "left")
    component = F.coalesce("_component", "_id")
    return out.select(F.col("_id").alias(id), F.col("_size").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("_id")).alias("kept"), "_node", "_digest")


def kept_rows(docs: DataFrame, *, shingle: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay: of each group, the one with the smallest id; of rows that repeat it with its set, any one. A row is
    known by its id and its text, so rows that share an id but not a text don't fall together, and a null id is an id like others.
    Texts move only if there are too many dropped rows to broadcast their keys."""
    own, names = shield(docs)
    key, body = names[id], names[text]
    groups = cut(near_groups(own, shingle=shingle, percent=percent, id=key, text=body).withColumnRenamed(key, "_id"))
    keyed = own.withColumn("_digest", text_digest(body))
    of = lambda rows, what: cut(rows.select(F.col("_id").alias(f"_{what}_id"), F.col("_digest").alias(f"_{what}_digest")).distinct())
    same = lambda rows, what: F.col(key).cast("long").eqNullSafe(rows[f"_{what}_id"]) & F.col("_digest").eqNullSafe(rows[f"_{what}_digest"])
    gone = of(groups.where("not kept"), "gone")
    kept = join_small(keyed, gone, same(gone, "gone"), "left_anti")
    again = cut(groups.where("kept and _node is not null").groupBy("_id", "_node").agg(F.count("*").alias("_many"), F.min("_digest").alias("_digest")).where("_many > 1"))
    if again.isEmpty():
        return unshield(kept, names)
    # Repeated rows: of those with the id and the set, the rows of one text, and of these one.
    twice = of(join_small(groups.where("kept").select("_id", "_node", "_digest"), again.select(F.col("_id").alias("_again"), F.col("_node").alias("_set")), F.col("_id").eqNullSafe(F.col("_again")) & (F.col("_node") == F.col("_set"))), "twice")
    stay = of(again, "stay")
    once = join_small(join_small(kept, twice, same(twice, "twice"), "left_semi"), stay, same(stay, "stay"), "left_semi").dropDuplicates([key, "_digest"])
    return unshield(join_small(kept, twice, same(twice, "twice"), "left_anti").unionByName(once), names)
