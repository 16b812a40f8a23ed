"""Graph operators on edge tables ``source, target``: rank, importance, roles, neighbourhoods, closure, cycles, communities."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import classify as C

#: A graph up to this size is ranked, or parted into communities, in one task.
SMALL_NODES, SMALL_LINKS = 200_000, 1_000_000
#: Up to this many nodes every task holds the communities' labels (four bytes each, and twelve a node while links are numbered).
HELD_NODES = 10_000_000
#: Links that are sorted in one piece, and rows numbered at once; so many pairs of labels are parted one by one.
BLOCK_LINKS, DEAL_ROWS, FEW_PAIRS = 1 << 19, 1 << 19, 10_000


_made: list[tuple[SparkSession, str]] = []


def _sweep() -> None:
    for spark, path in _made:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone: the folder's owner sweeps it
            return


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only a local master that sets none gets one of its own."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="cairn-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iteration: a table in the shared folder. The tables go when the driver's process ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cairn/step-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_sweep)
    _made.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def link_weights(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``source, target, share``: edges between known, different nodes; parallel edges add up."""
    known = nodes.select("id")
    links = edges.select("source", "target").filter("source <> target")
    links = links.join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi")
    pairs = links.groupBy("source", "target").agg(F.count("*").alias("k"))
    out = pairs.groupBy("source").agg(F.sum("k").alias("out"))
    return pairs.join(out, "source").select("source", "target", (F.col("k") / F.col("out")).alias("share"))


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 40, damping: float = 0.85, tolerance: float | None = 1e-6, seeds: DataFrame | None = None) -> DataFrame:
    """GR-01 and GR-02: ``id, rank`` with the largest rank 1. Sinks spread over all nodes. With ``seeds(id, weight)`` the jump goes to them in proportion.

    With ``tolerance=None`` exactly ``iterations`` steps run; else they end when the L1 change is below it."""
    count = nodes.select("id").distinct().count()
    if not count:
        return nodes.select("id").withColumn("rank", F.lit(0.0))
    links = cut(link_weights(nodes, edges))
    has_out = links.select(F.col("source").alias("id")).distinct().withColumn("out", F.lit(True))
    base = nodes.select("id").distinct().join(has_out, "id", "left")
    if seeds is None:
        base = base.withColumn("jump", F.lit(1.0 / count))
    else:
        total = seeds.agg(F.sum("weight")).first()[0] or 0
        jump = F.coalesce(F.col("weight") / F.lit(float(total or 1)), F.lit(0.0)) if total else F.lit(1.0 / count)
        base = base.join(seeds.groupBy("id").agg(F.sum("weight").alias("weight")), "id", "left").withColumn("jump", jump).drop("weight")
    if count <= SMALL_NODES and links.count() <= SMALL_LINKS:
        return _rank_in_one_task(base, links, count, iterations, damping, tolerance)
    sink = lambda rank: F.coalesce(F.sum(F.when(F.col("out").isNull(), rank)), F.lit(0.0))
    seen = Observation()
    rank = cut(base.withColumn("rank", F.lit(1.0 / count)).observe(seen, sink(F.col("rank")).alias("lost"), F.max("rank").alias("most")))
    for _ in range(iterations):
        lost = seen.get["lost"]  # what the sinks spread, measured while the last step was written
        into = links.join(rank.select(F.col("id").alias("source"), "rank"), "source").groupBy(F.col("target").alias("id")).agg(F.sum(F.col("share") * F.col("rank")).alias("into"))
        value = (1 - damping) * F.col("jump") + damping * (F.lit(lost / count) + F.coalesce("into", F.lit(0.0)))
        new = rank.withColumnRenamed("rank", "old").join(into, "id", "left").select("id", "out", "jump", "old", value.alias("rank"))
        seen = Observation()
        new = cut(new.observe(seen, sink(F.col("rank")).alias("lost"), F.max("rank").alias("most"), F.sum(F.abs(F.col("rank") - F.col("old"))).alias("moved")))
        rank = new.drop("old")
        if tolerance is not None and seen.get["moved"] < tolerance:
            break
    most = seen.get["most"]
    return rank.select("id", (F.col("rank") / most if most > 0 else F.lit(0.0)).alias("rank"))


def _rank_in_one_task(base: DataFrame, links: DataFrame, count: int, iterations: int, damping: float, tolerance: float | None) -> DataFrame:
    """The same steps on a graph of a checked size: one task holds it as arrays, and no step is a job of its own."""
    kind = base.schema["id"].dataType.simpleString()

    def run(nodes: pa.Table, edges: pa.Table) -> pa.Table:
        ids, jump = nodes.column("id").combine_chunks(), nodes.column("jump").to_numpy()
        at = {x: i for i, x in enumerate(ids.to_pylist())}
        source = np.fromiter((at[x] for x in edges.column("source").to_pylist()), np.int64, edges.num_rows)
        target = np.fromiter((at[x] for x in edges.column("target").to_pylist()), np.int64, edges.num_rows)
        share, sink = edges.column("share").to_numpy(), ~np.isin(np.arange(count), source)
        rank = np.full(count, 1.0 / count)
        for _ in range(iterations):
            new = (1 - damping) * jump + damping * (rank[sink].sum() / count + np.bincount(target, share * rank[source], count))
            moved, rank = np.abs(new - rank).sum(), new
            if tolerance is not None and moved < tolerance:
                break
        most = rank.max()
        return pa.table({"id": ids, "rank": rank / most if most > 0 else rank})

    one = F.lit(1).alias("_one")
    return base.select("id", "jump", one).groupBy("_one").cogroup(links.select("source", "target", "share", one).groupBy("_one")).applyInArrow(run, f"id {kind}, rank double")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GR-07: ``id, indegree, outdegree``, 0 for nodes without edges."""
    i = edges.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("indegree"))
    o = edges.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("outdegree"))
    rows = nodes.select("id").join(i, "id", "left").join(o, "id", "left")
    return rows.withColumns({"indegree": F.coalesce("indegree", F.lit(0)), "outdegree": F.coalesce("outdegree", F.lit(0))})


def roles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """AG-13."""
    return degrees(nodes, edges).withColumn("role", C.role(F.col("indegree"), F.col("outdegree")))


def importance(nodes: DataFrame, edges: DataFrame, precise: bool = True) -> DataFrame:
    """AG-01: of files ``id, lines, symbols, pagerank``; the maxima are one aggregate row joined back, not a window over all rows."""
    rows = nodes.join(degrees(nodes, edges), "id").withColumn("degree", F.col("indegree") + F.col("outdegree"))
    top = rows.agg(*[F.max(c).alias(f"most_{c}") for c in ("degree", "lines", "symbols")])
    share = lambda c: F.when(F.col(f"most_{c}") > 0, F.col(c) / F.col(f"most_{c}")).otherwise(0.0)
    if precise:
        value = 0.7 * F.col("pagerank") + 0.2 * share("degree") + 0.1 * share("symbols")
    else:
        value = 0.6 * share("degree") + 0.3 * share("lines") + 0.1 * share("symbols")
    return rows.crossJoin(F.broadcast(top)).select("id", "degree", F.round(value, 4).alias("importance"))


def symbol_degrees(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """AG-02: calls in and out, local ones and all, named imports and importing files of each symbol. Edges carry ``kind, source_file``."""
    call, local, named = F.col("kind").startswith("calls-symbol"), F.col("kind") == "calls-symbol-local", F.col("kind") == "imports-symbol"
    into = edges.groupBy(F.col("target").alias("id")).agg(F.count_if(call).alias("inbound_calls"), F.count_if(local).alias("inbound_calls_local"), F.count_if(named).alias("named_imports"), F.countDistinct(F.when(named, F.col("source_file"))).alias("incoming_file_imports"))
    out = edges.groupBy(F.col("source").alias("id")).agg(F.count_if(call).alias("outbound_calls"), F.count_if(local).alias("outbound_calls_local"))
    rows = symbols.join(into, "id", "left").join(out, "id", "left")
    counts = ("inbound_calls", "inbound_calls_local", "named_imports", "incoming_file_imports", "outbound_calls", "outbound_calls_local")
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})


def symbol_rank(file_rank: Column, exported: Column, imports: Column, calls: Column) -> Column:
    """AG-03."""
    return F.round(0.50 * file_rank + 0.20 * exported.cast("int") + 0.10 * F.least(imports, F.lit(5)) / 5 + 0.20 * F.least(calls, F.lit(8)) / 8, 6)


def neighborhood(edges: DataFrame, start: DataFrame, hops: int = 2) -> DataFrame:
    """GR-05: ``start, id, hop, direction, via`` of callers and callees up to ``hops`` steps from ``start(id)``; the shortest way stays, then the smallest via."""
    out = None
    for direction, a, b in (("callees", "source", "target"), ("callers", "target", "source")):
        front = start.select(F.col("id").alias("start"), F.col("id"), F.lit(None).cast("string").alias("via"))
        seen = start.select(F.col("id").alias("start"), F.col("id"))
        for hop in range(1, hops + 1):
            step = front.select("start", F.col("id").alias(a)).join(edges.select(a, b).distinct(), a).select("start", F.col(b).alias("id"), F.col(a).cast("string").alias("via"))
            step = step.groupBy("start", "id").agg(F.min("via").alias("via")).join(seen, ["start", "id"], "left_anti")
            seen = seen.unionByName(step.select("start", "id"))
            found = step.select("start", "id", F.lit(hop).alias("hop"), F.lit(direction).alias("direction"), F.when(F.lit(hop) > 1, F.col("via")).alias("via"))
            out = found if out is None else out.unionByName(found)
            front = step
    return out


def closure(direct: DataFrame, forwards: DataFrame, rounds: int = 30) -> DataFrame:
    """JN-11 and GR-06: names a file offers, following re-exports to a fixpoint.

    ``direct(file, name, symbol)``, ``forwards(file, target, imported, exported)`` with ``imported = '*'`` for all names.
    A name a file has already is never replaced; of several new ones the smallest symbol wins."""
    have = cut(direct.groupBy("file", "name").agg(F.min("symbol").alias("symbol")))
    for _ in range(rounds):
        offers = have.select(F.col("file").alias("target"), "name", "symbol")
        named = forwards.filter("imported <> '*'").join(offers, (forwards["target"] == offers["target"]) & (F.col("imported") == F.col("name"))).select("file", F.col("exported").alias("name"), "symbol")
        star = forwards.filter("imported = '*'").join(offers, "target").filter("name <> 'default'").select("file", "name", "symbol")
        new = named.withColumn("p", F.lit(0)).unionByName(star.withColumn("p", F.lit(1))).join(have.select("file", "name"), ["file", "name"], "left_anti")
        new = cut(new.groupBy("file", "name").agg(F.min(F.struct("p", "symbol")).alias("x")).select("file", "name", F.col("x.symbol").alias("symbol")))
        if new.isEmpty():
            return have
        have = cut(have.unionByName(new))
    raise RuntimeError("re-exports did not settle")


def cyclic_core(edges: DataFrame) -> DataFrame:
    """Edges on no cycle are peeled off: an edge stays while its ends have edges in and out. Self edges are left out."""
    now = cut(edges.filter("source <> target").select("source", "target").distinct())
    size = now.count()
    while size:
        ins, outs = now.select(F.col("target").alias("source")).distinct(), now.select(F.col("source").alias("target")).distinct()
        now = cut(now.join(ins, "source", "left_semi").join(outs, "target", "left_semi").select("source", "target"))
        left = now.count()
        if left == size:
            break
        size = left
    return now


def _spread(label: DataFrame, edges: DataFrame) -> DataFrame:
    """Each node takes the smallest ``label`` that can reach it, to a fixpoint. Only labels that changed are sent on."""
    moved = label
    while True:
        sent = edges.join(moved.select(F.col("id").alias("source"), "label"), "source").groupBy(F.col("target").alias("id")).agg(F.min("label").alias("sent"))
        both = label.join(sent, "id", "left")
        both = cut(both.select("id", F.least("label", "sent").alias("label"), (F.col("sent") < F.col("label")).alias("less")))
        label, moved = both.drop("less"), both.filter("less")
        if moved.isEmpty():
            return label


def strong_edges(edges: DataFrame) -> DataFrame:
    """``source, target, group``: the edges that lie on a cycle, with the smallest node of their strongly connected component.

    The smallest label that reaches a node colours it; what reaches a colour's own node within the colour is its component.
    Components are taken out and the rest is coloured again, so the rounds follow the depth of the graph, not its size."""
    left, found = cyclic_core(edges), None
    while not left.isEmpty():
        nodes = left.select(F.col("source").alias("id")).unionByName(left.select(F.col("target").alias("id"))).distinct()
        colour = _spread(nodes.select("id", F.col("id").alias("label")), left)
        ends = left.join(colour.select(F.col("id").alias("source"), F.col("label").alias("a")), "source").join(colour.select(F.col("id").alias("target"), F.col("label").alias("b")), "target")
        inner = cut(ends.filter("a = b").select("source", "target", "a"))
        seen = front = cut(colour.filter("id = label").select("id", F.col("label").alias("a")))
        while not front.isEmpty():
            step = inner.join(front.select(F.col("id").alias("target"), "a"), ["target", "a"]).select(F.col("source").alias("id"), "a").distinct()
            front = cut(step.join(seen, ["id", "a"], "left_anti"))
            seen = cut(seen.unionByName(front))
        strong = inner.join(seen.select(F.col("id").alias("source"), "a"), ["source", "a"], "left_semi").join(seen.select(F.col("id").alias("target"), "a"), ["target", "a"], "left_semi")
        strong = cut(strong.select("source", "target", F.col("a").alias("group")))
        found = strong if found is None else found.unionByName(strong)
        left = cut(left.join(seen.select(F.col("id").alias("source")), "source", "left_anti").join(seen.select(F.col("id").alias("target")), "target", "left_anti"))
        left = cyclic_core(left)
    return found if found is not None else left.select("source", "target", F.col("source").alias("group"))


def cycles(edges: DataFrame) -> DataFrame:
    """GR-04: the shortest cycle through each edge that lies on one, of any length, each once from its smallest node: ``cycle, length``.

    So every cycle has all its edges among those shown, and an edge that closes a new cycle shows a new one. Of several
    shortest ones the first in the order of their nodes stands. Self edges are cycles of one."""
    own = edges.filter("source = target").select(F.concat_ws(" -> ", "source", "target").alias("cycle"), F.lit(1).alias("length")).distinct()
    strong = cut(strong_edges(edges))
    wanted = strong.select(F.col("target").alias("start"), F.col("source").alias("node"))  # the way back from an edge's end to its beginning
    front = strong.select(F.col("source").alias("node"), "group").distinct()
    front = cut(front.select(F.col("node").alias("start"), "node", "group", F.array("node").alias("path")))
    seen, out, length = front.select("start", "node"), own, 1
    while not front.isEmpty():
        length += 1
        step = front.join(strong.withColumnRenamed("source", "node").withColumnRenamed("target", "next"), ["node", "group"])
        step = step.select("start", F.col("next").alias("node"), "group", F.concat("path", F.array("next")).alias("path"))
        step = step.groupBy("start", "node", "group").agg(F.min("path").alias("path")).join(seen, ["start", "node"], "left_anti")
        step = cut(step)
        back = step.join(wanted, ["start", "node"], "left_semi")
        turned = lambda i: F.concat(F.slice(F.col("path"), i, F.lit(length)), F.slice(F.col("path"), F.lit(1), i - 1))
        first = F.array_position("path", F.array_min("path")).cast("int")
        nodes = F.concat(turned(first), F.array(F.array_min("path")))
        out = out.unionByName(back.select(F.array_join(nodes, " -> ").alias("cycle"), F.lit(length).alias("length")))
        seen = cut(seen.unionByName(step.select("start", "node")))
        wanted = cut(wanted.join(back.select("start", "node"), ["start", "node"], "left_anti"))
        front = step.join(wanted.select("start").distinct(), "start", "left_semi")
    return out.distinct()


def communities(nodes: DataFrame, edges: DataFrame, smallest: int = 3) -> DataFrame:
    """GR-03: ``community, id``. Nodes move to the label most of their neighbours have, on a strict gain, the smallest label on ties,
    until none gains; parallel edges and directions count once. A graph of a checked size settles in one task, node by node. In a larger one
    nodes move by rounds, in each only from one half of the labels to the other: nobody leaves a label that is moved to, so each move keeps
    its gain, the edges within communities grow and the rounds end. Up to ``HELD_NODES`` nodes the labels are an array that each task
    gets, and links stay where they are; beyond, both are joined as tables. Groups under ``smallest`` are left out."""
    known = cut(nodes.select("id").filter("id is not null").distinct())
    count, most = known.count(), 2 * edges.count()
    links = edges.filter("source <> target").select("source", "target")
    small = count <= SMALL_NODES and most <= SMALL_LINKS
    if not small and 0 < count <= HELD_NODES:
        return _settle_in_blocks(known, links, most, smallest)
    around = cut(links.unionByName(links.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct())
    label = known.withColumn("label", F.col("id"))
    label = cut(_settle_in_one_task(label, around)) if small else _settle_by_joins(label, around)
    size = label.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") >= smallest)
    return label.join(size, "label").select(F.col("label").alias("community"), "id")


def _settle_by_joins(label: DataFrame, around: DataFrame) -> DataFrame:
    """The rounds as joins, for any number of nodes. The halves go by a new hash of the labels every other round, and change places between."""
    step = 0
    while True:
        votes = around.join(label.select(F.col("id").alias("target"), "label"), "target").groupBy(F.col("source").alias("id"), "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("b"))
        own = label.join(votes.withColumnRenamed("n", "own"), ["id", "label"], "left").join(best, "id")
        wants = cut(own.filter(-F.col("b.n") > F.coalesce("own", F.lit(0))).select("id", "label", F.col("b.label").alias("to")))
        if wants.isEmpty():
            return label
        half = lambda c: F.pmod(F.xxhash64(c, F.lit(step // 2)), F.lit(2))  # noqa: B023, E731
        moves = wants.filter((half("label") == step % 2) & (half("to") == 1 - step % 2)).select("id", "to")
        label = cut(label.join(moves, "id", "left").select("id", F.coalesce("to", "label").alias("label")))
        step += 1


def _numbered(ids: DataFrame) -> DataFrame:
    """``id, no``: the ids numbered from 0 in their order."""
    rows = cut(ids.repartitionByRange("id").sortWithinPartitions("id").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    counts = {r.part: r.n for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    before = [0]
    for k in range(max(counts)):
        before.append(before[-1] + counts.get(k, 0))
    start = F.array(*map(F.lit, before))[part.cast("int")]
    return rows.select("id", (start + F.col("at").bitwiseAND(F.lit(2**33 - 1))).cast("int").alias("no"))


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _wishes(nodes: np.ndarray, degree: np.ndarray, near: np.ndarray, label: np.ndarray, moved: np.ndarray, waits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of nodes with ``degree`` neighbours each, one after the other in ``near``: those that gain by a move, and the labels they move to.
    Looked at are nodes that wait for a move or have moved, and those with a neighbour that has."""
    look = waits[nodes] | moved[nodes] | np.logical_or.reduceat(moved[near], np.cumsum(degree) - degree)
    if not look.all():
        near, nodes, degree = near[np.repeat(look, degree)], nodes[look], degree[look]
    if not len(nodes):
        return nodes, nodes
    votes = np.sort(np.repeat(np.arange(len(nodes)), degree) << 32 | label[near])
    first = np.flatnonzero(np.concatenate([[True], votes[1:] != votes[:-1]]))
    n, who, what = np.diff(np.append(first, len(votes))), votes[first] >> 32, votes[first] & 0xFFFFFFFF
    own = np.zeros(len(nodes), np.int64)
    same = what == label[nodes[who]]
    own[who[same]] = n[same]
    best = np.maximum.reduceat(n << 32 | (0xFFFFFFFF - what), np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])))
    gains = (best >> 32) > own
    return nodes[gains], (0xFFFFFFFF - (best[gains] & 0xFFFFFFFF)).astype(np.int32)


def _across(old: np.ndarray, new: np.ndarray, step: int) -> np.ndarray:
    """Which of the moves from ``old`` to ``new`` labels a round makes: those from one part of the labels to the other. Few pairs of labels
    are parted by the heaviest first, so one moves at least; many by the best of some hashes."""
    pairs, at, n = np.unique(old.astype(np.int64) << 32 | new, return_inverse=True, return_counts=True)
    if len(pairs) <= FEW_PAIRS:
        side: dict[int, int] = {}
        taken = np.zeros(len(pairs), bool)
        for i in np.argsort(-n, kind="stable").tolist():
            a, b = int(pairs[i]) >> 32, int(pairs[i]) & 0xFFFFFFFF
            if side.get(a, 0) == 0 and side.get(b, 1) == 1:
                side[a], side[b], taken[i] = 0, 1, True
        return taken[at]
    best = None
    for salt in range(4 * step + 1, 4 * step + 5):
        seed = np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)
        z = [(x.astype(np.uint64) + seed) * np.uint64(0xBF58476D1CE4E5B9) for x in (old, new)]
        a, b = (((x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(63) == 1 for x in z)
        for moves in (a & ~b, b & ~a):
            if best is None or moves.sum() > best.sum():
                best = moves
    return best


def _settle_in_blocks(ids: DataFrame, links: DataFrame, most: int, smallest: int) -> DataFrame:
    """The rounds over arrays. Nodes are numbered in the order of their ids, and the links of a node are one row, sorted and once
    each. A round is one job: tasks get the labels and give the moves that gain; of those the driver makes the ones ``_across``."""
    spark = ids.sparkSession
    share = spark.sparkContext.broadcast
    named = cut(_numbered(ids))
    salt = 0
    while True:  # links name their ends by hashes that tell all nodes apart
        key = lambda c: F.xxhash64(F.col(c).cast("string"), F.lit(salt))  # noqa: B023, E731
        got = named.select(key("id").alias("h"), "no").toArrow()
        hashes, numbers = got.column("h").to_numpy(), got.column("no").to_numpy()
        if len(_distinct(hashes)) == len(hashes):
            break
        salt += 1
    order = np.argsort(hashes)
    count = len(order)
    held = share((hashes[order], numbers[order]))
    blocks = -(-most // BLOCK_LINKS)

    def numbered(h: np.ndarray) -> np.ndarray:
        hashes, numbers = held.value
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        return np.where(hashes[at] == h, numbers[at], -1).astype(np.int64)

    def dealt(batches: list) -> pa.RecordBatch:
        a, b = (numbered(np.concatenate([x.column(c).to_numpy() for x in batches])) for c in (0, 1))
        known = (a >= 0) & (b >= 0)
        a, b = a[known], b[known]
        pairs = _distinct(np.concatenate([a << 32 | b, b << 32 | a]))
        block = (pairs >> 32) % blocks
        order = np.argsort(block, kind="stable")
        here, first = np.unique(block[order], return_index=True)
        pairs = np.split(pairs[order], first[1:]) if len(here) else []
        return pa.RecordBatch.from_arrays([pa.array(here, pa.int64()), pa.array([x.tobytes() for x in pairs], pa.binary())], ["block", "pairs"])

    def deal(batches):
        rest, n = [], 0
        for batch in batches:
            rest.append(batch)
            n += batch.num_rows
            if n >= DEAL_ROWS:
                yield dealt(rest)
                rest, n = [], 0
        if n:
            yield dealt(rest)

    def build(block: pa.Table) -> pa.Table:
        pairs = _distinct(np.frombuffer(b"".join(block.column("pairs").to_pylist()), np.int64))
        nodes, first = np.unique(pairs >> 32, return_index=True)
        ends, near = (np.append(first, len(pairs)) * 4).astype(np.int32), pairs.astype(np.int32)
        rows = pa.Array.from_buffers(pa.binary(), len(nodes), [None, pa.py_buffer(ends), pa.py_buffer(near)])
        return pa.table({"node": pa.array(nodes, pa.int32()), "near": rows})

    hashed = links.select(key("source").alias("a"), key("target").alias("b")).mapInArrow(deal, "block long, pairs binary")
    files = max(2 * spark.sparkContext.defaultParallelism, blocks // 8)
    around = cut(hashed.repartition(files, "block").groupBy("block").applyInArrow(build, "node int, near binary"))
    held.destroy()

    label, moved, waits, step = np.arange(count, dtype=np.int32), np.zeros(count, bool), np.ones(count, bool), 0
    while True:
        state = share((label, moved, waits))

        def wishes(batches, state=state):
            for batch in batches:
                nodes, near = batch.column("node").to_numpy(), batch.column("near")
                degree = pc.binary_length(near).to_numpy() // 4
                if len(nodes):  # the bytes of all rows lie side by side
                    found = _wishes(nodes, degree, np.frombuffer(near.buffers()[2], np.int32, degree.sum()), *state.value)
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in found], ["who", "to"])

        got = around.mapInArrow(wishes, "who binary, to binary").toArrow()
        state.destroy()
        who, to = (np.frombuffer(b"".join(got.column(c).to_pylist()), np.int32) for c in ("who", "to"))
        if not len(who):
            break
        order = np.argsort(who)
        who, to = who[order], to[order]
        go = _across(label[who], to, step)
        label, moved, waits = label.copy(), np.zeros(count, bool), np.zeros(count, bool)
        label[who[go]], moved[who[go]], waits[who[~go]] = to[go], True, True
        step += 1

    final = share((label, np.bincount(label, minlength=count) >= smallest))

    def named_by(batches):
        label, large = final.value
        for batch in batches:
            mine = label[batch.column("no").to_numpy()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(mine)], ["id", "no"]).filter(pa.array(large[mine]))

    members = cut(named.mapInArrow(named_by, named.schema))
    final.destroy()
    return members.join(named.withColumnRenamed("id", "community"), "no").select("community", "id")


def _settle_in_one_task(label: DataFrame, around: DataFrame) -> DataFrame:
    """The same moves on a graph of a checked size, one node after the other in the order of their ids, until none gains."""
    kind = label.schema["id"].dataType.simpleString()

    def run(nodes: pa.Table, edges: pa.Table) -> pa.Table:
        ids = sorted(nodes.column("id").to_pylist())
        own = {x: x for x in ids}
        near: dict = {}
        for a, b in zip(edges.column("source").to_pylist(), edges.column("target").to_pylist(), strict=True):
            if a in own and b in own:
                near.setdefault(a, []).append(b)
        moved = True
        while moved:
            moved = False
            for x in ids:
                if x not in near:
                    continue
                votes = Counter(map(own.__getitem__, near[x]))
                most = max(votes.values())
                if most > votes.get(own[x], 0):
                    own[x] = min(k for k, n in votes.items() if n == most)
                    moved = True
        return pa.table({"id": pa.array(ids, nodes.column("id").type), "label": pa.array([own[x] for x in ids], nodes.column("id").type)})

    one = F.lit(1).alias("_one")
    return label.select("id", one).groupBy("_one").cogroup(around.select("source", "target", one).groupBy("_one")).applyInArrow(run, f"id {kind}, label {kind}")


def community_labels(members: DataFrame) -> DataFrame:
    """AG-16: ``community, label``: a parent folder has one vote a file, a telling base name two; the smallest on ties; doubles get a number."""
    parts = F.split(F.regexp_replace("id", "/+$", ""), "/")
    parent = members.filter(F.size(parts) >= 2).select("community", F.element_at(parts, -2).alias("label"), F.lit(1).alias("v"))
    base = members.select("community", F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "").alias("label"), F.lit(2).alias("v")).filter(~F.col("label").isin("index", "main", "__init__", "__main__"))
    votes = parent.unionByName(base).groupBy("community", "label").agg(F.sum("v").alias("v"))
    best = votes.groupBy("community").agg(F.min(F.struct((-F.col("v")).alias("v"), "label")).alias("b")).select("community", F.col("b.label").alias("label"))
    every = members.select("community").distinct().join(best, "community", "left").withColumn("label", F.coalesce("label", F.lit("module")))
    again = F.row_number().over(Window.partitionBy("label").orderBy("community"))
    return every.withColumn("_r", again).withColumn("label", F.when(F.col("_r") > 1, F.concat_ws("_", "label", F.col("_r"))).otherwise(F.col("label"))).drop("_r")
