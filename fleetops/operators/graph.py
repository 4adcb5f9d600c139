"""Dependency graphs as edge tables, walked by DataFrame rounds.

An edge src -> dst says that dst needs src. Each round is a join or two and is cut by a checkpoint in the shared folder;
the driver sees counts only. Nulls in edges are dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetops.operators.windows import latest
from fleetops.session import saved, written


def build_edges(batches: DataFrame, tasks: DataFrame, names: DataFrame, exact: DataFrame) -> DataFrame:
    """src, dst, kind of the whole fleet. A batch's tasks wait for its gate, the gate for what the batch depends on, and
    the batch is there when its tasks are. Names resolve to the newest batch of that name as of now; exact sources are
    frozen tasks.

    batches: id, name, created, row_seq; tasks: batch_id, task_id; names: batch, source (a name); exact: batch, source
    batch_id, source task_id."""
    node = lambda kind, *cols: F.concat(F.lit(f"{kind}:"), F.concat_ws("/", *[F.col(c).cast("string") for c in cols]))
    newest = latest(batches, ["name"], ["created", "row_seq"]).select(F.col("name").alias("source"), F.col("id").alias("_id"))
    by_name = names.join(newest, "source").select(node("batch", "_id").alias("src"), node("gate", "batch").alias("dst"), F.lit("name").alias("kind"))
    by_task = exact.select(node("task", "batch_id", "task_id").alias("src"), node("gate", "batch").alias("dst"), F.lit("exact").alias("kind"))
    t = tasks.select("batch_id", "task_id").distinct()
    gates = t.select(node("gate", "batch_id").alias("src"), node("task", "batch_id", "task_id").alias("dst"), F.lit("gate").alias("kind"))
    ends = t.select(node("task", "batch_id", "task_id").alias("src"), node("batch", "batch_id").alias("dst"), F.lit("gate").alias("kind"))
    return by_name.unionByName(by_task).unionByName(gates).unionByName(ends)


def cyclic_edges(edges: DataFrame) -> DataFrame:
    """The edges that lie on cycles or on ways from one cycle to another; empty if there is no cycle.

    Each round drops edges out of nodes that nothing leads to and into nodes that lead nowhere. In the first one and
    whenever that has dropped edges three times in a row, whole chains go at once: a node with one way on (or back)
    goes if that leads, over nodes with one way, to an end; pointers are doubled, so a chain of n edges takes log n
    steps."""
    now, before, rounds = saved(edges.select("src", "dst").dropna().distinct()), -1, 0
    while (n := now.count()) != before and n:
        before = n
        if rounds % 4 == 0:
            now = _without_chains(_without_chains(now, "src", "dst"), "dst", "src")
        fed, feeding = now.select(F.col("dst").alias("src")).distinct(), now.select(F.col("src").alias("dst")).distinct()
        now = saved(now.join(fed, "src", "left_semi").join(feeding, "dst", "left_semi").select("src", "dst"))
        rounds += 1
    return now


def _without_chains(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Edges but for those of nodes whose only way, from a to b and on, ends at a node without a way on."""
    ways = edges.groupBy(F.col(a).alias("n")).agg(F.count("*").alias("ways"), F.min(b).alias("to"))
    nodes = ways.unionByName(edges.select(F.col(b).alias("n"), F.lit(0).cast("long").alias("ways"), F.lit(None).cast(edges.schema[b].dataType).alias("to")))
    nodes = saved(nodes.groupBy("n").agg(F.max("ways").alias("ways"), F.max("to").alias("to")))
    ends = lineage_root(nodes.select("n", F.when(F.col("ways") == 1, F.col("to")).alias("to")), "n", "to")
    gone = ends.join(nodes.filter("ways = 0").select(F.col("n").alias("root")), "root", "left_semi").select(F.col("n").alias(a))
    return saved(edges.join(gone, a, "left_anti").select("src", "dst"))


def has_cycle(edges: DataFrame) -> bool:
    return bool(cyclic_edges(edges).limit(1).count())


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of all nodes that lie on cycles: the strongly connected components.

    Forward and backward colouring: each node takes the smallest node that reaches it as its colour; what reaches that node
    back over its own colour is a component. Components go, the rest is trimmed, and so on: as many rounds as components
    lie behind one another in such an order at worst. Colours run along pointers that are doubled beside the edges, so a
    long ring takes the logarithm of its length."""
    left, parts = cyclic_edges(edges), []
    alone = left.filter("src = dst").select("src").distinct()
    while left.limit(1).count():
        nodes = left.select(F.col("src").alias("n")).union(left.select("dst")).distinct()
        colour = _spread(left, nodes.withColumn("mark", F.col("n")))
        inside = left.join(colour.select(F.col("n").alias("src"), F.col("mark").alias("_a")), "src").join(colour.select(F.col("n").alias("dst"), F.col("mark").alias("_b")), "dst").filter("_a = _b")
        back = _spread(saved(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), colour.select("n", F.when(F.col("n") == F.col("mark"), F.col("n")).alias("mark")))
        found = saved(back.filter("mark is not null").select(F.col("n").alias("node"), F.col("mark").alias("component")))
        parts.append(found)
        gone = found.select(F.col("node").alias("src"))
        rest = saved(left.join(gone, "src", "left_anti").join(gone.withColumnRenamed("src", "dst"), "dst", "left_anti").select("src", "dst"))
        left = cyclic_edges(rest) if rest.limit(1).count() else rest
    if not parts:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    all_of = _all(parts)
    several = all_of.groupBy("component").agg(F.count("*").alias("_n")).filter("_n > 1").select("component")
    return all_of.join(several.unionByName(alone.select(F.col("src").alias("component"))).distinct(), "component", "left_semi").select("node", "component")


def _spread(edges: DataFrame, marks: DataFrame) -> DataFrame:
    """n, mark: the smallest mark of all nodes that reach n, its own included; null if none has one. Beside the edges, each
    node looks to one that reaches it over a growing number of edges."""
    look = edges.groupBy(F.col("dst").alias("n")).agg(F.min("src").alias("look"))
    now = saved(marks.join(look, "n", "left"))
    while True:
        known = now.select(F.col("n").alias("src"), F.col("mark").alias("_m"))
        near = edges.join(known, "src").groupBy(F.col("dst").alias("n")).agg(F.min("_m").alias("_near"))
        far = now.select(F.col("n").alias("look"), F.col("mark").alias("_far"), F.col("look").alias("_next"))
        step = now.join(near, "n", "left").join(far, "look", "left")
        best = F.least("mark", "_near", "_far")
        step = saved(step.select("n", best.alias("mark"), F.coalesce("_next", "look").alias("look"), (~best.eqNullSafe(F.col("mark"))).alias("moved")))
        if not step.filter("moved").limit(1).count():
            return step.select("n", "mark")
        now = step.drop("moved")


def cycles(edges: DataFrame) -> DataFrame:
    """component, place (from 0), node: one cycle of each component, in order, from its smallest node on; each node needs
    nothing but the next one to need it, and the first one needs the last.

    Each node points to its smallest successor in the component. Pointers are doubled until each node has looked as many
    steps ahead as there are nodes: where it stands then lies on a cycle, and it knows the smallest node on its way and how
    far off that is. Of several cycles of a component the one with the smallest node is shown."""
    member = written(components(edges))
    a, b = (member.select(F.col("node").alias(c), F.col("component").alias(f"_{c}")) for c in ("src", "dst"))
    inside = edges.select("src", "dst").dropna().distinct().join(a, "src").join(b, "dst").filter("_src = _dst")
    first = inside.groupBy(F.col("src").alias("n")).agg(F.min("dst").alias("to"), F.first("_src").alias("component"))
    far, n, reach = written(first.select("n", "to", "component", F.col("to").alias("least"), F.lit(1).cast("long").alias("steps"))), member.count(), 1
    while reach < n:
        on = far.select(F.col("n").alias("to"), F.col("to").alias("_to"), F.col("least").alias("_least"), (F.col("steps") + reach).alias("_steps"))
        later = F.col("_least") < F.col("least")
        step = far.join(on, "to").select("n", F.col("_to").alias("to"), "component", F.least("least", "_least").alias("least"), F.when(later, F.col("_steps")).otherwise(F.col("steps")).alias("steps"))
        far, reach = written(step), 2 * reach
    ring = far.join(far.select(F.col("to").alias("n")).distinct(), "n", "left_semi")
    shown = ring.groupBy("component", "least").agg(F.count("*").alias("size")).groupBy("component").agg(F.min(F.struct("least", "size")).alias("of"))
    ring = ring.join(shown, "component").filter(F.col("least") == F.col("of.least"))
    return ring.select("component", ((F.col("of.size") - F.col("steps")) % F.col("of.size")).alias("place"), F.col("n").alias("node"))


def blocking_paths(roots: DataFrame, edges: DataFrame, status: DataFrame, success: tuple[str, ...] = ("done", "skip"), depth: int = 32) -> DataFrame:
    """root, source, status, reason (source_ and the status, binding_mismatch without one), hops and path for each unmet node
    upstream of each root, each once, by the shortest and then the smallest path. A met node isn't passed. `truncated` marks nodes at the depth limit that need unmet ones still.

    roots: node; status: node, status (a node without one is unmet)."""
    open_ = edges.select("src", "dst").dropna().distinct().join(status.select(F.col("node").alias("src"), "status"), "src", "left")
    open_ = saved(open_.filter(~F.coalesce(F.col("status").isin(*success), F.lit(False))))
    text = lambda c: F.col(c).cast("string")
    front = roots.select(F.col("node").alias("root"), F.col("node"), F.array(text("node")).alias("path")).distinct()
    seen = saved(front.select("root", "node", F.lit(None).cast("string").alias("status"), F.lit(0).alias("hops"), "path"))
    front, parts = seen, [seen]
    for hop in range(1, depth + 1):
        step = front.select("root", "node", "path").join(open_, F.col("node") == F.col("dst")).select("root", F.col("src").alias("node"), open_["status"], F.concat("path", F.array(text("src"))).alias("path"))
        step = step.join(_all(parts).select("root", "node"), ["root", "node"], "left_anti")
        front = saved(step.groupBy("root", "node").agg(F.min("path").alias("path"), F.first("status").alias("status")).select("root", "node", "status", F.lit(hop).alias("hops"), "path"))
        if not front.limit(1).count():
            break
        parts.append(front)
    seen = _all(parts)
    more = seen.filter(F.col("hops") == depth).join(open_.select(F.col("dst").alias("node")).distinct(), "node", "left_semi").select("root", "node", F.lit(True).alias("truncated"))
    out = seen.filter("hops > 0").join(more, ["root", "node"], "left")
    reason = F.coalesce(F.concat(F.lit("source_"), "status"), F.lit("binding_mismatch"))
    return out.select("root", F.col("node").alias("source"), "status", reason.alias("reason"), "hops", "path", F.coalesce("truncated", F.lit(False)).alias("truncated"))


def _all(parts: list[DataFrame]) -> DataFrame:
    """The fronts so far, each written once."""
    return reduce(DataFrame.unionByName, parts)


def lineage_root(links: DataFrame, node: str, parent: str) -> DataFrame:
    """root and hops of each node by its chain of parents, by pointer jumping: rounds grow with the logarithm of the
    longest chain. Every node has one row; a null parent, or one that isn't a node, ends the chain. Nodes on a cycle
    have no root: null."""
    known = links.select(F.col(node).alias("p"))
    rows = links.select(F.col(node).alias("n"), F.col(parent).alias("p")).join(known.distinct().withColumn("_in", F.lit(True)), "p", "left")
    rows = saved(rows.select("n", F.when(F.col("_in"), F.col("p")).alias("p"), F.when(F.col("_in"), 1).otherwise(0).cast("long").alias("hops")))
    before = -1
    while (open_rows := rows.filter("p is not null").count()) not in (0, before):  # no change: all that is left leads to cycles
        before = open_rows
        jump = rows.select(F.col("n").alias("p"), F.col("p").alias("pp"), F.col("hops").alias("more"), F.coalesce("root", "n").alias("_r") if "root" in rows.columns else F.col("n").alias("_r"))
        last = F.when(F.col("p").isNotNull() & F.col("pp").isNull(), F.col("_r"))
        kept = F.coalesce(F.col("root"), last) if "root" in rows.columns else last
        rows = saved(rows.join(jump, "p", "left").select("n", F.col("pp").alias("p"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), kept.alias("root")))
    root = F.coalesce("root", "n") if "root" in rows.columns else F.col("n")
    open_ = F.col("p").isNotNull()
    return rows.select(F.col("n").alias(node), F.when(~open_, root).alias("root"), F.when(~open_, F.col("hops")).alias("hops"))


def ready_nodes(nodes: DataFrame, edges: DataFrame, success: tuple[str, ...] = ("done", "skip")) -> DataFrame:
    """Adds `ready` to nodes (node, status): all they need is met; a node without needs is ready, an unknown need is unmet."""
    status = nodes.select(F.col("node").alias("src"), F.col("status").alias("_s"))
    met = F.coalesce(F.col("_s").isin(*success), F.lit(False))
    needs = edges.join(status, "src", "left").groupBy("dst").agg(F.bool_and(met).alias("_met"))
    out = nodes.join(needs, F.col("node") == F.col("dst"), "left")
    return out.select(*nodes.columns, F.coalesce("_met", F.lit(True)).alias("ready"))


def process_tree(parents: DataFrame, roots: DataFrame) -> DataFrame:
    """owner, pid and depth of each root and all its descendants, each once for an owner, whatever loops the samples hold.

    parents: pid, ppid; roots: owner, pid."""
    seen = saved(roots.select("owner", "pid").distinct().withColumn("depth", F.lit(0)))
    front, parts, hop = seen, [seen], 0
    while front.limit(1).count():
        hop += 1
        step = front.select("owner", F.col("pid").alias("ppid")).join(parents.select("pid", "ppid"), "ppid").select("owner", "pid").distinct()
        front = saved(step.join(_all(parts).select("owner", "pid"), ["owner", "pid"], "left_anti").withColumn("depth", F.lit(hop)))
        parts.append(front)
    return _all(parts)
