"""Hierarchies from parent-child rows by tree contraction.

Rounds alternate unary-chain compression and leaf raking.  Each round records what it removed and onto which
surviving node; replaying the records backwards gives every node its root, depth and path.  What never contracts
is a cycle.  A round costs a few shuffles of what is left, and what is left shrinks by a constant share, so the
number of rounds grows with the logarithm of the node count, not with the depth.

Every input goes through distributed rounds, whatever its size.  They end when nothing is left to contract; once
they have shrunk the core to ``local_core`` rows (counted, never assumed), its last rounds, the same rakes and
compressions, are run inside one task instead of one job each.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worldloom.session import count_rows, materialize

#: Rows of a contracted core whose last rounds fit one task (about 1 MB; paths add the nodes compressed into them).
LOCAL_CORE = 20_000


def first_existing_parent(objects: DataFrame, key: str = "id", parents: str = "parents") -> DataFrame:
    """``id, p``: the first number in ``parents`` that is itself an object, null for roots.

    ``objects`` has one row per key.  Null keys are left out: nothing can refer to them.  Null elements, numbers
    that do not exist and repeated links are skipped.
    """
    ids = objects.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(parents).alias("ps"))
    links = ids.select("id", F.posexplode("ps").alias("pos", "p")).filter(F.col("p").isNotNull())
    real = links.join(ids.select(F.col("id").alias("p")), "p", "left_semi")
    first = real.groupBy("id").agg(F.min_by("p", "pos").alias("p"))
    return ids.select("id").join(first, "id", "left")


def _coin(c: Column, round_: int) -> Column:
    return (F.xxhash64(c, F.lit(round_)) % 2) == 0


def _contract(up: dict[int, tuple], join) -> tuple[list[tuple], int]:
    """Contract the forest ``up`` (node to parent and carry) down to its roots and self-loops.

    Returns what was removed, in order, as node, surviving node and carry, and the number of rounds.  ``up`` keeps
    what is left.  A round looks only at nodes with a parent, so its cost shrinks with them.
    """
    coin = random.Random(5)
    records: list[tuple] = []
    rounds = 0
    inner = [x for x, (p, _) in up.items() if p is not None and p != x]
    while inner:
        rounds += 1
        kids: dict[int, int] = {}
        child: dict[int, int] = {}
        for x in inner:
            p = up[x][0]
            kids[p] = kids.get(p, 0) + 1
            child[p] = x
        heads = {x: coin.random() < 0.5 for x in inner}
        # Compress: no two neighbours go in the same round (roots count as tails).
        gone = [x for x in inner if kids.get(x) == 1 and heads[x] and not heads.get(up[x][0], False)]
        for x in gone:
            p, carry = up.pop(x)
            records.append((x, p, carry))
            up[child[x]] = (p, join(carry, x, up[child[x]][1]))
        # Rake: leaves hang on nodes that stay.
        for x in inner:
            if x not in kids:
                records.append((x, *up.pop(x)))
        inner = [x for x in inner if x in up and up[x][0] != x]
    return records, rounds


def _finish_forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Contract a bounded core in one task; rows id, p (null for roots), seg (nodes between p and id)."""
    parts = list(batches)
    core = pd.concat(parts) if parts else pd.DataFrame({"id": [], "p": [], "seg": []})
    up = {int(i): (None if pd.isna(p) else int(p), list(s)) for i, p, s in zip(core["id"], core["p"], core["seg"])}
    records, _ = _contract(up, lambda upper, x, lower: upper + [x] + lower)
    done: dict[int, tuple[int, int, list | None]] = {x: (x, 0, [x]) if p is None else (-1, -1, None) for x, (p, _) in up.items()}
    for x, p, seg in reversed(records):
        root, depth, path = done[p]
        done[x] = (-1, -1, None) if path is None else (root, depth + len(seg) + 1, path + seg + [x])
    rows = [(i, r, d, p) for i, (r, d, p) in done.items()]
    yield pd.DataFrame(rows, columns=["id", "root_id", "depth", "path"])


def _finish_forest_narrow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """As ``_finish_forest`` with step counts in place of paths: rows id, p, w."""
    parts = list(batches)
    core = pd.concat(parts) if parts else pd.DataFrame({"id": [], "p": [], "w": []})
    up = {int(i): (None if pd.isna(p) else int(p), int(w)) for i, p, w in zip(core["id"], core["p"], core["w"])}
    records, _ = _contract(up, lambda upper, _, lower: upper + lower)
    done: dict[int, tuple[int, int]] = {x: (x, 0) if p is None else (-1, -1) for x, (p, _) in up.items()}
    for x, p, w in reversed(records):
        root, depth = done[p]
        done[x] = (root, depth + w) if depth >= 0 else (-1, -1)
    yield pd.DataFrame([(i, r, d) for i, (r, d) in done.items()], columns=["id", "root_id", "depth"])


def contract_forest(links: DataFrame, with_paths: bool = False, local_core: int = LOCAL_CORE, trace: list[int] | None = None) -> DataFrame:
    """Root and depth of every node of ``links(id, p)`` (``p`` null for roots, else an id in the table).

    Columns ``id, root_id, depth`` and, with ``with_paths``, ``path`` (root to node).  Nodes whose walk never ends
    get -1, -1 and a null path.  One row per id is expected; an empty table gives an empty result.  ``trace``
    receives the number of nodes left after each distributed round.
    """
    carry = F.array().cast("array<bigint>").alias("seg") if with_paths else F.lit(1).cast("bigint").alias("w")
    c = "seg" if with_paths else "w"
    inner = F.col("p").isNotNull() & (F.col("p") != F.col("id"))

    def joined(upper: Column, node: Column, lower: Column) -> Column:
        return F.concat(upper, F.array(node), lower) if with_paths else upper + lower

    state = links.select("id", "p", carry)
    steps: list[DataFrame] = []
    while True:
        r = len(steps)
        # Children of each node, without the node itself where it is its own parent.
        kids = state.filter(inner).groupBy("p").agg(F.count(F.lit(1)).alias("n_kids")).withColumnRenamed("p", "id")
        # Compress: a node with one child hands that child its own parent; no two neighbours go in the same round.
        splice = inner & (F.col("n_kids") == 1) & _coin(F.col("id"), r) & ~_coin(F.col("p"), r)
        marked = state.join(kids, "id", "left").select("id", "p", c, F.coalesce(F.col("n_kids"), F.lit(0)).alias("n_kids"), F.coalesce(splice, F.lit(False)).alias("splice"))
        gone = marked.filter("splice").select(F.col("id").alias("p"), F.col("p").alias("__pp"), F.col(c).alias("__pc"))
        moved = marked.join(gone, "p", "left").select(
            "id",
            F.coalesce("__pp", "p").alias("p"),
            F.when(F.col("__pp").isNull(), F.col(c)).otherwise(joined(F.col("__pc"), F.col("p"), F.col(c))).alias(c),
            # Rake: leaves go, now pointing at a node that stays.  Roots and self-loops without children are settled.
            F.when(F.col("splice"), "record")
            .when(F.col("n_kids") > 0, "keep")
            .when(F.col("p").isNull() | (F.col("p") == F.col("id")), "settled")
            .otherwise("record")
            .alias("role"),
        )
        step = materialize(moved, f"forest-{r + 1}")
        steps.append(step)
        state = step.filter("role = 'keep'").drop("role")
        # A node with children is kept, so what is left is nothing, or a smaller forest, or rings that still shrink.
        left = state.agg(F.count(F.lit(1)).alias("n"), F.count_if(inner).alias("inner")).collect()[0]
        if trace is not None:
            trace.append(left.n)
        if left.n <= local_core or left.inner == 0:
            break
    if left.n <= local_core:
        fn, schema = (_finish_forest, "id bigint, root_id bigint, depth int, path array<bigint>") if with_paths else (_finish_forest_narrow, "id bigint, root_id bigint, depth int")
        solved = state.repartition(1).mapInPandas(fn, schema)
    else:
        solved = _ends(state, with_paths)
    # Replay: each round's records hang on nodes that were still there after it, so they are known by now.
    known = materialize(solved, "forest-core")
    for r in range(len(steps) - 1, -1, -1):
        got = _hung(steps[r].filter("role = 'record'"), known, with_paths)
        known = known.unionByName(got).unionByName(_ends(steps[r].filter("role = 'settled'"), with_paths))
        if r:
            known = materialize(known, f"forest-back-{r}")
    return known


def _ends(rows: DataFrame, with_paths: bool) -> DataFrame:
    """What is known of roots and of self-loops, where walks end or never do."""
    is_root = F.col("p").isNull()
    path = [F.when(is_root, F.array("id")).alias("path")] if with_paths else []
    return rows.select("id", F.when(is_root, F.col("id")).otherwise(-1).alias("root_id"), F.when(is_root, 0).otherwise(-1).cast("int").alias("depth"), *path)


def _hung(records: DataFrame, known: DataFrame, with_paths: bool) -> DataFrame:
    """Records completed from the nodes they were hung on."""
    ends = F.col("depth") >= 0
    steps = (F.size("seg") + 1) if with_paths else F.col("w")
    path = [F.when(ends, F.concat("path", "seg", F.array("id"))).alias("path")] if with_paths else []
    return records.join(known.withColumnRenamed("id", "p"), "p").select("id", "root_id", F.when(ends, F.col("depth") + steps).otherwise(-1).cast("int").alias("depth"), *path)


def _contract_edges(edges: Iterable[tuple[int, int]]) -> tuple[dict[int, set[int]], set[int], list[tuple[int, int, int]]]:
    """Rake and splice a bounded graph without self-loops until neither applies.

    Returns the ways out of the nodes of the core that is left, nodes on a ring that closed on them, and the
    spliced nodes in order with the ends of their chain.
    """
    out: dict[int, set[int]] = {}
    into: dict[int, set[int]] = {}
    for u, v in edges:
        for x in (u, v):
            out.setdefault(x, set())
            into.setdefault(x, set())
        out[u].add(v)
        into[v].add(u)
    closed: set[int] = set()
    records: list[tuple[int, int, int]] = []
    todo = list(out)
    while todo:
        x = todo.pop()
        if x not in out:
            continue
        a, b = into[x], out[x]
        if a and b and not len(a) == len(b) == 1:
            continue
        del into[x], out[x]
        for i in a:
            out[i].discard(x)
        for o in b:
            into[o].discard(x)
        if a and b:
            (i,), (o,) = a, b
            records.append((x, i, o))
            if i == o:
                closed.add(i)
            else:
                out[i].add(o)
                into[o].add(i)
        todo += a | b
    return out, closed, records


def _finish_cycles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Contract a bounded core in one task; rows id, scc (the least id) for nodes on a cycle."""
    parts = list(batches)
    e = pd.concat(parts) if parts else pd.DataFrame({"u": [], "v": []})
    out, closed, records = _contract_edges(zip(e["u"].astype("int64").tolist(), e["v"].astype("int64").tolist()))
    label = {x: x for x in closed} | dict(_tarjan(out))
    for x, i, o in reversed(records):
        if i in label and label[i] == label.get(o):
            label[x] = label[i]
    least: dict[int, int] = {}
    for x, c in label.items():
        least[c] = min(x, least.get(c, x))
    yield pd.DataFrame([(x, least[c]) for x, c in label.items()], columns=["id", "scc"]).astype("int64")


def _tarjan(out: dict[int, set[int]]) -> list[tuple[int, int]]:
    """Strongly connected components of what never contracts: id and component of nodes in one of two or more."""
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    on, stack, rows = set(), [], []
    for start in out:
        if start in index:
            continue
        work = [(start, iter(out[start]))]
        index[start] = low[start] = len(index)
        stack.append(start)
        on.add(start)
        while work:
            v, it = work[-1]
            for w in it:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(out[w])))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    comp = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        comp.append(w)
                        if w == v:
                            break
                    if len(comp) > 1:
                        rows += [(x, min(comp)) for x in comp]
    return rows


def _colour_core(edges: DataFrame) -> DataFrame:
    """Components of a core too large for one task: spread the largest id forward, then walk back within its colour."""
    found: list[DataFrame] = []
    core = edges
    while True:
        r = len(found)
        nodes = core.select(F.col("u").alias("id")).union(core.select(F.col("v").alias("id"))).distinct()
        colour = materialize(nodes.select("id", F.col("id").alias("c")), f"scc-colour-{r}")
        while True:
            best = core.join(colour, core.u == colour.id).groupBy("v").agg(F.max("c").alias("up")).withColumnRenamed("v", "id")
            nxt = materialize(colour.join(best, "id", "left").select("id", F.greatest("c", F.coalesce("up", "c")).alias("c"), (F.coalesce("up", "c") > F.col("c")).alias("moved")), f"scc-colour-{r}")
            colour = nxt.select("id", "c")
            if nxt.filter("moved").isEmpty():
                break
        same = materialize(
            core.join(colour.withColumnsRenamed({"id": "u", "c": "cu"}), "u").join(colour.withColumnsRenamed({"id": "v", "c": "cv"}), "v").filter("cu = cv").select("u", "v", F.col("cu").alias("c")), f"scc-same-{r}"
        )
        reached = colour.filter("id = c").select("id", F.col("c").alias("scc"))
        frontier = reached
        while True:
            step = same.join(frontier.withColumnRenamed("id", "v"), "v").filter("c = scc").select(F.col("u").alias("id"), "scc").distinct()
            frontier = materialize(step.join(reached, "id", "left_anti"), f"scc-back-{r}")
            if frontier.isEmpty():
                break
            reached = materialize(reached.union(frontier), f"scc-reached-{r}")
        sizes = reached.groupBy("scc").count().filter("count > 1").select("scc")
        found.append(reached.join(sizes, "scc").select("id", "scc"))
        core = materialize(core.join(reached.withColumnRenamed("id", "u"), "u", "left_anti").join(reached.withColumnRenamed("id", "v"), "v", "left_anti").select("u", "v"), f"scc-rest-{r}")
        if core.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def cycle_members(edges: DataFrame, local_core: int = LOCAL_CORE, trace: list[int] | None = None) -> DataFrame:
    """``id, scc``: the nodes of ``edges(u, v)`` that are their own ancestor, with one label per cycle component.

    Nodes without ways in or out are raked, unary chains are compressed (a chain's node lies on a cycle exactly
    when both ends carry the same component), and only a core that never contracts is searched for components.
    Repeated edges are dropped, rows with nulls are ignored.  ``trace`` receives the edges left after each round.
    """
    state = materialize(edges.filter("u IS NOT NULL AND v IS NOT NULL").select("u", "v").distinct(), "cycle-0")
    loops = [state.filter("u = v").select(F.col("u").alias("id"))]
    records: list[DataFrame] = []
    while True:
        r = len(records)
        plain = state.filter("u <> v")
        ends = plain.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("o"), F.lit(None).cast("bigint").alias("i")), F.struct(F.col("v").alias("id"), F.lit(None).cast("bigint").alias("o"), F.col("u").alias("i")))).alias("e")).select("e.*")
        deg = ends.groupBy("id").agg(F.count("o").alias("n_out"), F.count("i").alias("n_in"), F.max("o").alias("o"), F.max("i").alias("i"))
        deg = deg.filter("n_out = 0 OR n_in = 0 OR (n_out = 1 AND n_in = 1)").select("id", "i", "o", ((F.col("n_out") == 0) | (F.col("n_in") == 0)).alias("rake"))
        go = F.col("rake") | (_coin(F.col("id"), r) & ~_coin(F.col("o"), r))
        marks = materialize(deg.withColumn("go", go), f"cycle-marks-{r}")
        cut = marks.filter("go").select("id")
        kept = plain.join(cut.withColumnRenamed("id", "u"), "u", "left_anti").join(cut.withColumnRenamed("id", "v"), "v", "left_anti").select("u", "v")
        spliced = marks.filter("go AND NOT rake").select("id", "i", "o")
        # A chain's new edge only stands where both its ends do.
        raked = marks.filter("rake").select("id")
        bridge = spliced.join(raked.withColumnRenamed("id", "i"), "i", "left_anti").join(raked.withColumnRenamed("id", "o"), "o", "left_anti").select(F.col("i").alias("u"), F.col("o").alias("v"))
        records.append(spliced)
        state = materialize(kept.union(bridge).distinct(), f"cycle-{r + 1}")
        loops.append(state.filter("u = v").select(F.col("u").alias("id")))
        left = count_rows(state)
        if trace is not None:
            trace.append(left)
        # Candidates that lost their coin try again in the next round; without candidates nothing contracts any more.
        if left <= local_core or marks.isEmpty():
            break
    core = state.filter("u <> v")
    comp = materialize(core.repartition(1).mapInPandas(_finish_cycles, "id bigint, scc bigint") if left <= local_core else _colour_core(core), "cycle-comp")
    alone = reduce(DataFrame.union, loops).distinct()
    known = comp.unionByName(alone.join(comp, "id", "left_anti").select("id", F.col("id").alias("scc")))
    for r in range(len(records) - 1, -1, -1):
        a = known.select(F.col("id").alias("i"), F.col("scc").alias("si"))
        b = known.select(F.col("id").alias("o"), F.col("scc").alias("so"))
        got = records[r].join(a, "i").join(b, "o").filter("si = so").select("id", F.col("si").alias("scc"))
        known = known.join(got, "id", "left_anti").unionByName(got)
        if r:
            known = materialize(known, f"cycle-back-{r}")
    return known


def hierarchy(objects: DataFrame, key: str = "id", parents: str = "parents", local_core: int = LOCAL_CORE, trace: dict[str, list[int]] | None = None) -> DataFrame:
    """``id, root_id, depth, on_cycle`` of every object; see ``contract_forest`` and ``cycle_members``.

    The walk goes to the first parent that exists; ``on_cycle`` looks at all parents.  ``trace`` receives what
    each round of the two contractions left.
    """
    trace = {} if trace is None else trace
    links = materialize(first_existing_parent(objects, key, parents), "links")
    ids = links.select("id")
    all_links = objects.filter(F.col(key).isNotNull()).select(F.col(key).alias("u"), F.explode(parents).alias("v")).filter("v IS NOT NULL").distinct()
    real = all_links.join(ids.withColumnRenamed("id", "v"), "v", "left_semi")
    with ThreadPoolExecutor(1) as pool:  # the two contractions do not depend on each other
        cycles = pool.submit(cycle_members, real, local_core, trace.setdefault("cycles", []))
        depth = contract_forest(links, local_core=local_core, trace=trace.setdefault("forest", []))
        cyc = cycles.result()
    return depth.join(cyc.select("id", F.lit(1).alias("c")), "id", "left").select("id", "root_id", "depth", F.coalesce("c", F.lit(0)).alias("on_cycle"))


def paths(objects: DataFrame, key: str = "id", parents: str = "parents", local_core: int = LOCAL_CORE) -> DataFrame:
    """``id, root_id, depth, path``: the full path from the root; null where the walk never ends."""
    return contract_forest(materialize(first_existing_parent(objects, key, parents), "links"), with_paths=True, local_core=local_core)


def descendants(path_rows: DataFrame) -> DataFrame:
    """``ancestor_id, id, distance``: every node below every node, from ``paths``.

    As many rows as the sum of all depths; they are exploded from each node's own path, so no ancestor's
    descendants are gathered in one place.
    """
    up = path_rows.filter("depth > 0").select("id", "depth", F.posexplode("path").alias("pos", "ancestor_id"))
    return up.filter(F.col("pos") < F.col("depth")).select("ancestor_id", "id", (F.col("depth") - F.col("pos")).cast("int").alias("distance"))
