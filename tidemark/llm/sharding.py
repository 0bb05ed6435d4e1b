"""Sharding by balanced label propagation.

Groups of equal texts are the pieces; only a group that outgrows a shard's quota is dealt by id into several. Documents start in
shards drawn from their ids, whatever the size of their group. In each round a linked document looks at its neighbours' shards and wants
the one that more than half of them (by weight) are in; a shard takes no more than its free room and what leaves it, and of those that
want in, the pieces with small hashes. Rounds go on until no document wants to move, or none may. At last the shards settle: linked
documents stay as far as their shard's quota goes, and all others, in one order, fill the shards up, so sizes are even whatever the
labels are, and a piece is split only where it meets the end of a quota. cut_links counts the links between shards. Positions are running sums over lanes plus a sort inside
each lane; no shard is ever sorted whole, and a large piece is dealt over lanes of its own.

Links of a group are stars of bounded size, whose centres hang on the centre of their piece, and that on the group's, so a group that
holds a third of all rows doesn't meet in one task, and no link between its parts is lost.

Laws: `rows` (counts at most one apart) or `bytes` (cut by running bytes; a shard is off by one document at most).
Defined cases: null text has no bytes and equals the empty text; null ids are ids like others; repeated rows are rows of their own;
more shards than rows leave shards empty; an empty table gives an empty table.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, gathered, join_small, text_or_empty

#: Lanes of a shard in the final order.
LANES = 256
#: Most leaves of a centre.
STAR_ROWS = 1000
#: Rounds without a move, one after another, that end the propagation.
BARREN = 3
#: Rounds in which pieces without room move on.
ROUNDS = 12


def quotas(total: int, shards: int) -> list[int]:
    """Whole parts of total, at most one apart."""
    ends = [-(-s * total // shards) for s in range(shards + 1)]
    return [b - a for a, b in zip(ends, ends[1:])]


def text_nodes(docs: DataFrame, shards: int, *, law: str = "rows", id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, int]:
    """Nodes (id, size, text_crc32, _load, _node, _piece, _linked), links (_a, _b, _weight, _piece) of equal texts and the whole load."""
    if law not in ("rows", "bytes"):
        raise ValueError(f"law: {law}")
    body = text_or_empty(text).cast("binary")
    slim = cut(docs.select(F.col(id), (F.octet_length(text_or_empty(text)) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.unhex(F.md5(body)).alias("_group")).withColumn("_load", F.col("size") if law == "bytes" else F.lit(1).cast("long")))
    groups = cut(slim.groupBy("_group").agg(F.count("*").alias("_rows"), F.sum("_load").alias("_all")).where("_rows > 1"))
    rows, total = slim.agg(F.count("*"), F.coalesce(F.sum("_load"), F.lit(0))).first()
    star = max(16, min(STAR_ROWS, rows // (12 * shards)))
    parts = F.ceil(F.col("_all") / F.lit(max(1, total // shards)))
    stars = F.ceil(F.col("_rows") / parts / star)
    of = lambda n, salt: F.pmod(F.xxhash64(F.col(id), F.lit(salt)), n)
    piece = F.when(F.col("_rows").isNull() | (parts <= 1), F.xxhash64("_group")).otherwise(F.xxhash64(F.col("_group"), of(parts, "piece")))
    nodes = join_small(slim, groups, "_group", "left").select(id, "size", "text_crc32", "_load", F.xxhash64(F.col(id), F.col("_group")).alias("_node"), piece.alias("_piece"), F.col("_rows").isNotNull().alias("_linked"), F.xxhash64("_group").alias("_whole"), F.when(F.col("_rows").isNotNull(), of(stars, "star")).alias("_star"))
    nodes = cut(nodes)
    # A leaf hangs on its star's centre, that on its piece's, that on its group's. A link weighs as much as what hangs on it, so that
    # a centre follows its own centre and not its leaves.
    ends = nodes.where("_linked").groupBy("_whole", "_piece", "_star", "_node").agg(F.lit(1).cast("long").alias("_weight"))
    links = None
    for level in (["_whole", "_piece", "_star"], ["_whole", "_piece"], ["_whole"]):
        centres = cut(ends.groupBy(*level).agg(F.min("_node").alias("_b"), F.sum("_weight").alias("_all")))
        hung = ends.join(centres, level).where("_node <> _b").select(F.col("_node").alias("_a"), "_b", "_weight", "_piece")
        links = hung if links is None else links.unionByName(hung)
        ends = centres.select(*level, F.col("_b").alias("_node"), F.col("_all").alias("_weight")).withColumn("_piece", F.col("_piece") if "_piece" in level else F.lit(None).cast("long"))
    return nodes.drop("_whole", "_star"), links, total


def share_of(loads: list[int], at: Column) -> Column:
    """The index of the load that the position falls in, if the loads lie one after another."""
    ends = [int(x) for x in accumulate(loads)]
    return F.least(F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in ends]), lambda end: end <= at)), F.lit(len(loads) - 1)).cast("int")


def accepted(loads: list[float], flows: dict[tuple[int, int], float], quota: list[float]) -> list[float]:
    """The share of those who want in that each shard takes, so that no shard ends above its quota (or above where it was): the largest
    shares for which what comes in is at most the free room plus what leaves. Works on one number per pair of shards."""
    share = [1.0] * len(loads)
    for _ in range(60):
        leaving, coming = [0.0] * len(loads), [0.0] * len(loads)
        for (a, b), load in flows.items():
            leaving[a] += load * share[b]
            coming[b] += load
        share = [1.0 if c <= 0 else max(0.0, min(1.0, (max(most - have, 0.0) + out) / c)) for most, have, out, c in zip(quota, loads, leaving, coming)]
    return share


def propagate(nodes: DataFrame, links: DataFrame, rooms: list[int], *, rounds: int | None = None, slack: float = 0.05) -> DataFrame:
    """Labels (_node, _label) of the nodes (_node, _piece, _load); rooms are the loads that the labels may take.

    Of neighbours that both want to move, the one with fewer links moves first: the leaves of a star before its centre, all in one
    round. No two neighbours move at once, so each move lessens the weight of the links between labels, and the rounds end when no node
    wants to move or the quotas let none for BARREN rounds. rounds: a bound, None for no other end."""
    shards, quota = len(rooms), [room * (1 + slack) for room in rooms]
    start = share_of(rooms, F.pmod(F.xxhash64(F.col("_node"), F.lit(0)), F.lit(max(1, sum(rooms)))))
    both = links.select("_a", "_b", "_weight").union(links.select("_b", "_a", "_weight"))
    both = cut(gathered(both, 2 * nodes.count()))  # a node hangs on one other at most, and its centres on theirs
    turns = both.groupBy(F.col("_a").alias("_node")).agg(F.count("*").alias("_links"))
    labels = nodes.groupBy("_node").agg(F.sum("_load").alias("_load"), F.min("_piece").alias("_piece")).withColumn("_label", start).join(turns, "_node", "left")
    labels = cut(labels.select("_node", "_load", "_piece", F.struct("_links", F.xxhash64("_node", F.lit("turn")), "_node").alias("_turn"), "_label"))
    few = labels.count()  # every round writes at most so many rows, in as few files as hold them
    r = barren = 0
    while barren < BARREN and (rounds is None or r < rounds):
        votes = both.join(labels.select(F.col("_node").alias("_b"), "_label"), "_b").groupBy("_a", "_label").agg(F.sum("_weight").alias("_votes"))
        wants = votes.groupBy("_a").agg(F.max(F.struct("_votes", "_label")).alias("_best"), F.sum("_votes").alias("_sum")).where(2 * F.col("_best._votes") > F.col("_sum")).select(F.col("_a").alias("_node"), F.col("_best._label").alias("_want"))
        ask = cut(gathered(labels.join(wants, "_node").where("_want <> _label"), few))
        if ask.isEmpty():
            break
        first = both.join(ask.select(F.col("_node").alias("_b"), F.col("_turn").alias("_other")), "_b").groupBy(F.col("_a").alias("_node")).agg(F.min("_other").alias("_first"))
        go = cut(gathered(ask.join(first, "_node", "left").where(F.col("_first").isNull() | (F.col("_turn") < F.col("_first"))).drop("_first"), few))
        loads, flows = [0.0] * shards, {}
        for row in labels.groupBy("_label").agg(F.sum("_load").alias("_load")).collect():
            loads[row["_label"]] += row["_load"]
        for row in go.groupBy("_label", "_want").agg(F.sum("_load").alias("_load")).collect():
            flows[row["_label"], row["_want"]] = row["_load"]
        chance = accepted(loads, flows, quota)
        # Nodes of a piece that want the same shard are taken or refused together.
        draw = F.pmod(F.xxhash64(F.col("_piece"), F.lit(-1 - r)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        moved = cut(gathered(go.where(draw < F.get(F.array(*map(F.lit, chance)), F.col("_want"))).select("_node", "_want"), few))
        barren = barren + 1 if moved.isEmpty() else 0
        labels = cut(gathered(labels.join(moved, "_node", "left").withColumn("_label", F.coalesce("_want", "_label")).drop("_want"), few))
        r += 1
    return labels.select("_node", "_label")


def ordered(rows: DataFrame, lane: list[str], id: str) -> DataFrame:
    """rows with _at and _upto, the rows and the load before a row, in the order of lane, piece and id."""
    lanes = rows.groupBy(*lane).agg(F.count("*").alias("_n"), F.sum("_load").alias("_l"))
    before = Window.orderBy(*lane).rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(lanes.select(*lane, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_l").over(before), F.lit(0)).alias("_l0")))
    inside = Window.partitionBy(*lane).orderBy("_piece", F.col(id), "_node", "size")
    upto = F.coalesce(F.sum("_load").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut(join_small(rows, offsets, lane).withColumns({"_at": F.col("_n0") + F.row_number().over(inside) - 1, "_upto": F.col("_l0") + upto}).drop("_n0", "_l0"))


def whole_pieces(nodes: DataFrame, labels: DataFrame, caps: list[int], *, rounds: int = ROUNDS) -> DataFrame:
    """(_piece, _home, _size): each piece with the shard that most of it is in, and its load. Pieces are the nodes from here on: the
    largest of a shard stay as far as its quota goes, and those without room move on to a shard drawn by the room that is left, until
    all have room or `rounds` are over."""
    shares = nodes.join(labels, "_node").groupBy("_piece", "_label").agg(F.sum("_load").alias("_l"))
    pieces = shares.groupBy("_piece").agg(F.max(F.struct("_l", "_label")).alias("_m"), F.sum("_l").alias("_load")).select("_piece", F.col("_m._label").alias("_home"), "_load")
    pieces = cut(gathered(pieces.withColumns({"_kind": size_class("_load"), "_block": F.pmod("_piece", F.lit(LANES)).cast("long"), "_node": F.col("_piece"), "size": F.col("_load")}), nodes.count()))
    for r in range(rounds):
        lined = ordered(pieces, ["_home", "_kind", "_block"], "_node")
        loads = [0] * len(caps)
        for row in pieces.groupBy("_home").agg(F.sum("_load").alias("_l")).collect():
            loads[row["_home"]] = row["_l"]
        ends = F.col("_upto") + F.col("_load") - F.get(F.array(*[F.lit(int(x)).cast("long") for x in accumulate([0, *loads[:-1]])]), F.col("_home"))
        lined = lined.withColumn("_stays", ends <= F.get(F.array(*[F.lit(int(c)).cast("long") for c in caps]), F.col("_home"))).drop("_at", "_upto")
        kept = [0] * len(caps)
        for row in lined.where("_stays").groupBy("_home").agg(F.sum("_load").alias("_l")).collect():
            kept[row["_home"]] = row["_l"]
        free = [max(0, c - k) for c, k in zip(caps, kept)]
        if lined.where("not _stays").isEmpty() or not sum(free):
            break
        drawn = share_of(free, F.pmod(F.xxhash64("_piece", F.lit(r)), F.lit(sum(free))))
        pieces = cut(gathered(lined.withColumn("_home", F.when(F.col("_stays"), F.col("_home")).otherwise(drawn)).drop("_stays"), lined.count()))
    return pieces.select("_piece", "_home", F.col("_load").alias("_size"))


def size_class(load: str) -> Column:
    """Larger pieces first: 0 for loads of 2^62, 62 for a load of 1."""
    return (F.lit(62) - F.floor(F.log2(F.greatest(F.col(load), F.lit(1)).cast("double")))).cast("int")


def cut_links(links: DataFrame, placed: DataFrame) -> DataFrame:
    """One row: links, cut (links whose ends lie in different shards) and weight_cut, for links (_a, _b, _weight) and placed (_node, shard)."""
    end = lambda c: placed.select(F.col("_node").alias(c), F.col("shard").alias(f"_at{c}"))
    apart = F.col("_at_a") != F.col("_at_b")
    return links.join(end("_a"), "_a").join(end("_b"), "_b").agg(F.count("*").alias("links"), F.count_if(apart).alias("cut"), F.coalesce(F.sum(F.when(apart, F.col("_weight"))), F.lit(0)).alias("weight_cut"))


def settle(placed: DataFrame, shards: int, total: int, *, id: str = "doc_id") -> DataFrame:
    """placed (nodes with _home, -1 for none, and _kind, _block, _deal, which make the order) with shard and slot. Rows stay in their
    home as far as its quota goes; the others fill up the shards in one order."""
    caps = quotas(total, shards)
    at = lambda values, key: F.get(F.array(*[F.lit(int(v)).cast("long") for v in values]), F.col(key))

    def sums(rows: DataFrame, key: str) -> tuple[list[int], list[int]]:
        n, load = [0] * shards, [0] * shards
        for r in rows.groupBy(key).agg(F.count("*").alias("_n"), F.sum("_load").alias("_l")).collect():
            n[r[key]], load[r[key]] = r["_n"], r["_l"]
        return n, load

    homed = placed.where("_home >= 0")
    n, load = sums(homed, "_home")
    homed = ordered(homed, ["_home", "_kind", "_block", "_deal"], id)
    ends = F.col("_upto") - at(accumulate([0, *load[:-1]]), "_home") + F.col("_load")
    stays = ends <= at(caps, "_home")
    kept = homed.where(stays).select("*", F.col("_home").alias("shard"), (F.col("_at") - at(accumulate([0, *n[:-1]]), "_home")).alias("slot"))
    kept_n, kept_load = sums(kept, "_home")
    rest = homed.where(~stays).drop("_at", "_upto").unionByName(placed.where("_home < 0"))
    rest = ordered(rest, ["_kind", "_home", "_block", "_deal"], id)
    rest = rest.withColumn("shard", share_of([c - k for c, k in zip(caps, kept_load)], F.col("_upto")))
    firsts = [0] * shards
    for r in rest.groupBy("shard").agg(F.min("_at").alias("_first")).collect():
        firsts[r["shard"]] = r["_first"]
    rest = rest.withColumn("slot", F.col("_at") - at(firsts, "shard") + at(kept_n, "shard"))
    return kept.unionByName(rest)


def shard_documents(docs: DataFrame, shards: int = 24, *, law: str = "rows", id: str = "doc_id", text: str = "text", rounds: int | None = None) -> DataFrame:
    """One row per row of docs: the id, size, text_crc32, shard, slot. Documents with equal texts are linked."""
    nodes, links, total = text_nodes(docs, shards, law=law, id=id, text=text)
    rooms = quotas(total, shards)
    linked = nodes.where("_linked")
    labels = propagate(linked, links, rooms, rounds=rounds)
    lane_rows = max(1, nodes.count() // (LANES * shards))
    pieces = cut(whole_pieces(linked, labels, rooms))
    # In the order of whole_pieces; a large piece takes several lanes, one after another.
    deals = F.ceil(F.col("_size") / F.greatest(F.lit(lane_rows), F.ceil(F.lit(total / max(1, LANES * shards)))))
    joined = join_small(linked, pieces, "_piece").select(*nodes.columns, "_home", size_class("_size").alias("_kind"), F.pmod("_piece", F.lit(LANES)).cast("long").alias("_block"), F.when(deals > 1, F.pmod(F.xxhash64("_piece"), F.lit(1 << 40)) * 1024 + F.pmod(F.xxhash64(F.col(id), F.lit("deal")), F.least(deals, F.lit(1024)))).otherwise(-1).cast("long").alias("_deal"))
    single = nodes.where("not _linked").select("*", F.lit(-1).alias("_home"), F.lit(63).alias("_kind"), F.pmod("_piece", F.lit(LANES * shards)).cast("long").alias("_block"), F.lit(0).cast("long").alias("_deal"))
    placed = cut(joined.unionByName(single))
    return settle(placed, shards, total, id=id).select(id, "size", "text_crc32", "shard", "slot")
