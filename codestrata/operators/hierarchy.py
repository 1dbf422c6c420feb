"""Parent-child links to full hierarchies: ancestors with distance, paths, roots, descendants, cycles."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.session import Stage

#: A component of at most so many links is walked in one task; larger ones by joins over all executors.
MAX_COMPONENT_LINKS = 50_000
#: Links that one task of the walk aims at.
LINKS_PER_BUCKET = 20_000
#: A stated number of partitions keeps buckets from being merged into few long tasks.
MAX_TASKS = 10_000
#: The starts of a component with more links are spread over tasks, one for each so many links.
LINKS_PER_SLICE = 2_000
#: Rows that a walk holds before it hands them on, and ancestors that it remembers for nodes still to come.
ROWS_PER_BATCH, MAX_REMEMBERED = 100_000, 1_000_000


#: Links that a task contracts at once.
LINKS_PER_CHUNK = 500_000


def _contracted(u: np.ndarray, v: np.ndarray) -> pd.DataFrame:
    """(node, root) of the nodes of the given links that are not the least of their connected part."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u):]
    label = np.arange(len(ids))
    while not np.array_equal(label[a], label[b]):
        low = np.minimum(label[a], label[b])
        for end in (label[a], label[b]):
            np.minimum.at(label, end, low)
        while not np.array_equal(label[label], label):
            label = label[label]
    rest = label != np.arange(len(ids))
    return pd.DataFrame({"node": ids[rest], "root": ids[label[rest]]})


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Contracts links (node, root) in chunks; rows of one node that stand together stay together."""
    held, size = [], 0
    for pdf in batches:
        held.append(pdf)
        size += len(pdf)
        if size >= LINKS_PER_CHUNK:
            rows = pd.concat(held)
            last = (rows["node"] == rows["node"].iloc[-1]).to_numpy()
            cut = len(rows) if last.all() else len(rows) - int(last[::-1].argmin())
            yield _contracted(rows["node"].to_numpy()[:cut], rows["root"].to_numpy()[:cut])
            held, size = [rows.iloc[cut:]], len(rows) - cut
    if size:
        rows = pd.concat(held)
        yield _contracted(rows["node"].to_numpy(), rows["root"].to_numpy())


def components(links: DataFrame, stage: Stage) -> DataFrame:
    """(node, component) of the undirected graph of ``links`` (child, parent).

    The component is its least node. Links are contracted to stars where they
    lie, before anything is shuffled, so a node of any degree sends one row a
    chunk. Each round then brings the stars of a node together, contracts them
    again, and lets roots that have a root of their own jump to it, until no
    node has two roots and no root jumps.
    """
    schema = "node long, root long"
    stars = links.where("child <> parent").select(F.col("child").alias("node"), F.col("parent").alias("root")).mapInPandas(_contract, schema)
    while True:
        met = stage.keep(stars.repartition("node").sortWithinPartitions("node").mapInPandas(_contract, schema))
        least = met.groupBy("node").agg(F.min("root").alias("up"), F.max("root").alias("other"))
        jumped = stage.keep(
            met.join(least.select(F.col("node").alias("root"), "up"), "root", "left")
            .select("node", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved"))
        )
        stage.drop(met)
        label = stage.keep(jumped.groupBy("node").agg(F.min("root").alias("root"), (F.bool_or("moved") | (F.min("root") != F.max("root"))).alias("open")))
        if not label.where("open").limit(1).count():
            break
        stars = jumped.select("node", "root").distinct()
    nodes = links.select(F.col("child").alias("node")).union(links.select("parent")).distinct()
    return nodes.join(label, "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def _colour_walk(parents: dict[int, list[int]]) -> tuple[list[list[int]], list[tuple[int, int]]]:
    """Iterative depth-first walk towards the parents, with white, grey and black nodes.

    Returns the strongly connected parts in the order they turn black (a part
    after all parts above it) and the back edges (child, grey parent).
    """
    number: dict[int, int] = {}
    low: dict[int, int] = {}
    grey: set[int] = set()
    unsettled: list[int] = []
    waiting: set[int] = set()
    parts, back = [], []

    def enter(node: int) -> tuple[int, Iterator[int]]:
        number[node] = low[node] = len(number)
        grey.add(node)
        unsettled.append(node)
        waiting.add(node)
        return node, iter(parents.get(node, ()))

    for start in parents:
        if start in number:
            continue
        stack = [enter(start)]
        while stack:
            node, rest = stack[-1]
            for up in rest:
                if up not in number:
                    stack.append(enter(up))
                    break
                if up in grey:
                    back.append((node, up))
                if up in waiting:
                    low[node] = min(low[node], number[up])
            else:
                stack.pop()
                grey.discard(node)
                if stack:
                    low[stack[-1][0]] = min(low[stack[-1][0]], low[node])
                if low[node] == number[node]:
                    at = len(unsettled) - 1
                    while unsettled[at] != node:
                        at -= 1
                    parts.append(unsettled[at:])
                    waiting.difference_update(unsettled[at:])
                    del unsettled[at:]
    return parts, back


def _nearest(parents: dict[int, list[int]], node: int, inside=None) -> dict[int, int]:
    """Least number of steps from ``node`` to each ancestor, by breadth; only through nodes of ``inside`` if given."""
    reached: dict[int, int] = {}
    queue = deque([(node, 0)])
    while queue:
        at, far = queue.popleft()
        for up in parents.get(at, ()):
            if up not in reached and (inside is None or up in inside):
                reached[up] = far + 1
                queue.append((up, far + 1))
    return reached


def _over(parents: dict[int, list[int]], node: int, above: dict[int, dict[int, int]], inside=()) -> dict[int, int]:
    """Least steps from ``node`` through its parents outside of ``inside``, whose own ancestors are known."""
    own: dict[int, int] = {}
    for up in parents.get(node, ()):
        if up in inside:
            continue
        if own.get(up, 2) > 1:
            own[up] = 1
        for far_up, far in above[up].items():
            if own.get(far_up, far + 2) > far + 1:
                own[far_up] = far + 1
    return own


def _around(parents: dict[int, list[int]], part: list[int], above: dict[int, dict[int, int]]) -> Iterator[tuple[int, dict[int, int]]]:
    """(node, least steps to each ancestor) of a part with a cycle: around it, then out of it at the best node."""
    inside = set(part)
    exits = {node: _over(parents, node, above, inside) for node in part}
    for node in part:
        around = _nearest(parents, node, inside)
        own = dict(around)
        for at, far in (around | {node: 0}).items():
            for up, rest in exits[at].items():
                if own.get(up, far + rest + 1) > far + rest:
                    own[up] = far + rest
        yield node, own


def _reached(parents: dict[int, list[int]], remember: int = MAX_REMEMBERED, share: int = 0, shares: int = 1) -> Iterator[tuple[int, dict[int, int]]]:
    """(node, least steps to each ancestor) of one component, node by node, and no more kept than is needed.

    Parts are taken in the order they turn black, so a node finds its
    ancestors in those of its parents, which are forgotten once all children
    are black. Of ``shares`` equal runs of parts only run ``share`` is walked; for
    parents of other runs, and beyond ``remember`` kept ancestors, a node is
    searched by breadth.
    """
    parts, _ = _colour_walk(parents)
    parts = parts[len(parts) * share // shares:len(parts) * (share + 1) // shares]
    waiting: dict[int, int] = {}
    for part in parts:
        for node in part:
            for up in parents.get(node, ()):
                waiting[up] = waiting.get(up, 0) + 1
    above: dict[int, dict[int, int]] = {}
    held = 0
    for part in parts:
        inside = set(part) if len(part) > 1 or part[0] in parents.get(part[0], ()) else ()
        if not all(up in above or up in inside for node in part for up in parents.get(node, ())):
            found = ((node, _nearest(parents, node)) for node in part)
        elif inside:
            found = _around(parents, part, above)
        else:
            found = [(part[0], _over(parents, part[0], above))]
        kept = []
        for node, own in found:
            if waiting.get(node) and held + len(own) <= remember:
                kept.append((node, own))
                held += len(own)
            if own:
                yield node, own
        above.update(kept)
        for node in part:
            for up in parents.get(node, ()):
                waiting[up] -= 1
                if not waiting[up]:
                    held -= len(above.pop(up, ()))


def _component_rows(parents: dict[int, list[int]]) -> tuple[list, list]:
    """(node, ancestor, distance) rows and back edges of one component."""
    return [(node, up, far) for node, own in _reached(parents) for up, far in own.items()], _colour_walk(parents)[1]


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, int, dict[int, list[int]]]]:
    """(slice, number of slices, parents) of each run of links with equal component and slice."""
    at, slices, parents = None, 1, {}
    for pdf in batches:
        for component, part, of, child, parent in zip(*(pdf[c].tolist() for c in ("component", "slice", "slices", "child", "parent"))):
            if at != (component, part):
                if parents:
                    yield at[1], slices, parents
                at, slices, parents = (component, part), of, {}
            parents.setdefault(child, []).append(parent)
    if parents:
        yield at[1], slices, parents


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of the components of a partition, in frames of a bounded number of rows.

    The links are sorted by component and slice. A slice of a component sees
    all of its links and walks its share of the nodes.
    """
    nodes, ups, fars, size = [], [], [], 0

    def frame() -> pd.DataFrame:
        return pd.DataFrame({"node": np.concatenate(nodes), "ancestor": np.concatenate(ups), "distance": np.concatenate(fars)})

    for part, slices, parents in _parts(batches):
        for node, own in _reached(parents, share=part, shares=slices):
            n = len(own)
            nodes.append(np.full(n, node, "int64"))
            ups.append(np.fromiter(own.keys(), "int64", n))
            fars.append(np.fromiter(own.values(), "int32", n))
            size += n
            if size >= ROWS_PER_BATCH:
                yield frame()
                nodes, ups, fars, size = [], [], [], 0
    if size:
        yield frame()


def _grow(links: DataFrame, stage: Stage) -> DataFrame:
    """(node, ancestor, distance) by joins, for components of any size.

    What is known up to a distance d doubles each round: a least way of d + k
    steps is one of exactly d and one of k, so only pairs at distance d meet
    the known ones, and the rounds follow the logarithm of the longest way.
    """
    known = stage.keep(links.select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).distinct().withColumn("distance", F.lit(1)))
    far = 1
    while True:
        ends = known.where(F.col("distance") == far).select("node", F.col("ancestor").alias("mid"))
        onward = known.select(F.col("node").alias("mid"), "ancestor", F.col("distance").alias("rest"))
        further = ends.join(onward, "mid").groupBy("node", "ancestor").agg((F.min("rest") + far).alias("distance"))
        fresh = stage.keep(further.join(known.select("node", "ancestor"), ["node", "ancestor"], "left_anti"))
        far *= 2
        if not fresh.limit(1).count():
            return known
        known = stage.keep(known.unionByName(fresh))


def ancestors(links: DataFrame, max_component: int = MAX_COMPONENT_LINKS, stage: Stage | None = None) -> tuple[DataFrame, DataFrame]:
    """Ancestors and loops of the directed graph of ``links`` (child LONG, parent LONG).

    Returns (node, ancestor, distance), one row for each ancestor reached in
    one or more steps with the least number of steps, and (child, parent) of
    the links that lie on a cycle, whatever the size. A node on a cycle is its own ancestor. Null
    ends and repeated links count for nothing; no links give empty results.

    Components are found first and each is co-located: tasks walk buckets of
    whole components depth-first with node colours, condense cycles to one
    part, and hand on rows as they find them. The nodes of a component above
    ``LINKS_PER_SLICE`` links are spread over tasks. Components above
    ``max_component`` links are never brought together: they grow by joins.
    """
    stage = stage or Stage(links.sparkSession, "hierarchy")
    links = stage.keep(links.select("child", "parent").where("child is not null and parent is not null").distinct())
    named = stage.keep(
        links.join(components(links, stage).withColumnRenamed("node", "child"), "child").select("child", "parent", "component")
    )
    sizes = stage.keep(
        named.groupBy("component").agg(F.count(F.lit(1)).alias("links"))
        .withColumn("slices", F.ceil(F.col("links") / LINKS_PER_SLICE).cast("int"))
    )
    large = sizes.where(F.col("links") > max_component).select("component")
    small = named.join(sizes.where(F.col("links") <= max_component), "component")
    total, many_large = sizes.agg(F.sum(F.when(F.col("links") <= max_component, F.col("links") * F.col("slices"))),
                                  F.count_if(F.col("links") > max_component)).first()
    buckets = min(max(1, -(-(total or 0) // LINKS_PER_BUCKET)), MAX_TASKS)
    sliced = small.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    rows = stage.keep(
        sliced.repartition(buckets, "component", "slice").sortWithinPartitions("component", "slice", "child", "parent")
        .select("component", "slice", "slices", "child", "parent").mapInPandas(_walk, "node long, ancestor long, distance int")
    )
    if many_large:
        rows = rows.unionByName(_grow(stage.keep(named.join(large, "component", "left_semi").select("child", "parent")), stage))
    return rows, loop_links(rows, links)


def loop_links(closure: DataFrame, links: DataFrame) -> DataFrame:
    """(child, parent) of the links that lie on a loop: those whose parent has the child as an ancestor."""
    ways_back = closure.select(F.col("node").alias("parent"), F.col("ancestor").alias("child"))
    return links.select("child", "parent").distinct().join(ways_back, ["child", "parent"], "left_semi")


def cycles(loops: DataFrame, stage: Stage) -> DataFrame:
    """(cycle, child, parent): the links on loops by strongly connected component, named by its least node.

    Both ends of a link on a loop reach each other, so the components of these
    links, whatever their direction, are the strongly connected ones.
    """
    loops = stage.keep(loops)
    named = components(loops, stage).select(F.col("node").alias("child"), F.col("component").alias("cycle"))
    return loops.join(named, "child").select("cycle", "child", "parent")


def hierarchy(closure: DataFrame, links: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, depth, root, descendants, is_cyclic), a row for each root of every node of ``links`` and of ``nodes``.

    depth is the greatest least-distance to any ancestor, 0 for a root; roots
    are the nodes without parents above, a node without parents is its own;
    root is null where a node stands only below cycles; descendants counts
    distinct nodes below.
    """
    every = links.select(F.col("child").alias("node")).union(links.select("parent"))
    every = (every if nodes is None else every.union(nodes.select("node"))).where("node is not null").distinct()
    children = links.where("child is not null and parent is not null").select(F.col("child").alias("node"))
    top = every.join(children, "node", "left_anti")
    above = closure.groupBy("node").agg(F.max("distance").alias("depth"), F.max((F.col("node") == F.col("ancestor")).cast("int")).alias("_loop"))
    roots = (
        closure.join(top.select(F.col("node").alias("ancestor")), "ancestor", "left_semi").select("node", F.col("ancestor").alias("root"))
        .union(top.select("node", F.col("node").alias("root")))
    )
    below = closure.groupBy(F.col("ancestor").alias("node")).agg(F.count(F.lit(1)).alias("descendants"))
    return (
        every.join(above, "node", "left").join(below, "node", "left").join(roots, "node", "left")
        .select("node", F.coalesce("depth", F.lit(0)).alias("depth"), "root", F.coalesce("descendants", F.lit(0)).alias("descendants"),
                (F.coalesce("_loop", F.lit(0)) == 1).alias("is_cyclic"))
    )


def path_ends(closure: DataFrame) -> DataFrame:
    """(ancestor): where the ways up end: ancestors without parents, and the least node of each cycle with no way out.

    Each ancestor of such an end has it as an ancestor too, and none is less.
    """
    back = closure.select(F.col("ancestor").alias("node"), F.col("node").alias("ancestor"), F.lit(True).alias("mutual"))
    above = closure.join(back, ["node", "ancestor"], "left").groupBy("node").agg(
        F.count("mutual").alias("around"), F.count(F.lit(1)).alias("all"), F.min("ancestor").alias("least"))
    below = above.where((F.col("around") < F.col("all")) | (F.col("least") < F.col("node"))).select(F.col("node").alias("ancestor"))
    return closure.select("ancestor").distinct().join(below, "ancestor", "left_anti")


def root_paths(steps: DataFrame, ends: DataFrame, stage: Stage) -> DataFrame:
    """(node, root, distance, path): a shortest path, node first and root last, to each of ``ends`` above a node.

    ``steps`` are the rows of ``shortest_paths``, ``ends`` those of
    ``path_ends``. A path takes the least parent
    at each step. Each round joins every unfinished path with the one that
    begins where it ends, so paths double and the rounds follow the logarithm
    of the greatest depth.
    """
    rooted = steps.join(ends, "ancestor", "left_semi").where("node <> ancestor")
    paths = stage.keep(rooted.select("node", F.col("ancestor").alias("root"), "distance", F.array("node", "next").alias("path")))
    while paths.where("element_at(path, -1) <> root").limit(1).count():
        onward = paths.select(F.col("node").alias("end"), "root", F.slice("path", 2, F.size("path")).alias("rest"))
        longer = paths.withColumn("end", F.element_at("path", -1)).join(onward, ["end", "root"], "left")
        paths = stage.keep(longer.select("node", "root", "distance", F.concat("path", F.coalesce("rest", F.array().cast("array<long>"))).alias("path")))
    return paths


def shortest_paths(closure: DataFrame, links: DataFrame) -> DataFrame:
    """(node, ancestor, distance, next): the least parent of ``node`` on a shortest way to ``ancestor``.

    Following ``next`` step by step gives the full path without storing it once per pair.
    """
    first = links.select(F.col("child").alias("node"), F.col("parent").alias("next")).distinct()
    inner = closure.select(F.col("node").alias("next"), F.col("ancestor"), F.col("distance").alias("_rest"))
    step = first.join(inner, "next").select("node", "ancestor", "next", (F.col("_rest") + 1).alias("distance"))
    direct = first.select("node", F.col("next").alias("ancestor"), "next", F.lit(1).alias("distance"))
    ways = step.unionByName(direct).groupBy("node", "ancestor", "distance").agg(F.min("next").alias("next"))
    return closure.join(ways, ["node", "ancestor", "distance"])


def base_class_links(classes: DataFrame) -> DataFrame:
    """(child, parent) class_ids: the classes of the same project named by a base_classes entry.

    Type arguments and qualifiers are left out of an entry; entries that name
    no class of the project are ignored, as are null and empty lists.
    """
    bare = F.regexp_replace(F.col("entry"), r"[\[<({].*$", "")
    last = F.trim(F.element_at(F.split(F.replace(bare, F.lit("::"), F.lit(".")), r"\."), -1))
    wanted = (
        classes.select(F.col("class_id").alias("child"), "project", F.explode("base_classes").alias("entry"))
        .select("child", "project", last.alias("name")).where("name <> ''").distinct()
    )
    owners = classes.select(F.col("class_id").alias("parent"), "project", "name")
    return wanted.join(owners, ["project", "name"]).select("child", "parent").distinct()
