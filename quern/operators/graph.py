"""Fixed points over edge tables: frontier loops whose state stays distributed, and per-procedure algorithms."""

from __future__ import annotations

import tempfile
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all runs on one machine."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not at:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="quern-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(at)
    return at.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder the cluster shares."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The rows as Parquet in the folder the cluster shares, for wide rows that several branches read: made once, columns read apart."""
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/rows-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def together(parts: list[DataFrame]) -> DataFrame:
    """The rounds' rows as one frame; nothing that was found before is written anew."""
    return reduce(DataFrame.union, parts)


def walked(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """The distinct edges (src, dst) that leave a seed or the end of another edge, written once: no round reads more than these."""
    starts = seeds.select(F.col("id").alias("_s")).union(edges.select("dst")).distinct()
    return cut_lineage(edges.select("src", "dst").join(dealt(starts), F.col("src") == F.col("_s"), "left_semi").distinct())


def dealt(df: DataFrame) -> DataFrame:
    """For the joins of a loop: both sides are dealt out by the key, so that no round sends a table to the driver."""
    return df.hint("merge")


def closure(seeds: DataFrame, edges: DataFrame, depth: int | None = None, emit_root: bool = False) -> DataFrame:
    """root, id, depth of everything reached from each seed over edges (src, dst), with the least number of steps.

    seeds has `id`. With emit_root, a seed that closes a cycle is returned once as reached from itself, though not
    expanded again (calls); without, it is never returned (hierarchies). Ends at depth or when nothing new is found.
    Each round writes its new rows alone; what was seen is the union of the rounds. A closure of a few steps reads the
    edges as they are, a longer one what `walked` leaves of them.
    """
    start = cut_lineage(seeds.select(F.col("id").alias("root"), "id").distinct().withColumn("depth", F.lit(0)))
    few = depth is not None and depth <= 3
    edges = edges.select("src", "dst").distinct() if few else dealt(walked(start, edges))
    rounds, frontier, step = [start], start, 0
    while depth is None or step < depth:
        step += 1
        found = frontier.join(edges, frontier["id"] == edges["src"]).select("root", F.col("dst").alias("id")).distinct()
        old = rounds[1:] if emit_root else rounds
        if old:
            seen = together(old).select("root", "id")
            found = found.join(seen if few else dealt(seen), ["root", "id"], "left_anti")
        new = cut_lineage(found.withColumn("depth", F.lit(step)))
        if new.isEmpty():
            break
        rounds.append(new)
        # A root that was reached again is emitted, not expanded.
        frontier = new.where(F.col("root") != F.col("id"))
    return together(rounds[1:]) if len(rounds) > 1 else start.where("depth > 0")


def reachable(seeds: DataFrame, edges: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """label, id, depth: labels spread along the edges from (label, id); blocked (label, id) are neither entered nor left."""
    walk = edges.select("src", "dst").distinct()
    frontier = seeds.select("label", "id").distinct()
    if blocked is not None:
        frontier = frontier.join(blocked, ["label", "id"], "left_anti")
    frontier = cut_lineage(frontier.withColumn("depth", F.lit(0)))
    rounds = [frontier]
    while True:
        found = frontier.join(walk, frontier["id"] == walk["src"]).select("label", F.col("dst").alias("id")).distinct()
        if blocked is not None:
            found = found.join(blocked, ["label", "id"], "left_anti")
        frontier = cut_lineage(found.join(together(rounds).select("label", "id"), ["label", "id"], "left_anti").withColumn("depth", F.lit(len(rounds))))
        if frontier.isEmpty():
            return together(rounds)
        rounds.append(frontier)


def dominated_out(rows: DataFrame) -> DataFrame:
    """Of the qualities (proven, complete) of a (node, fact), those that no other one of it is above."""
    both, either = F.col("proven") & F.col("complete"), F.col("proven") | F.col("complete")
    by = Window.partitionBy("node", "fact")  # four qualities at most
    best = rows.withColumn("_both", F.max(both).over(by)).withColumn("_either", F.max(either).over(by))
    return best.where(both | (~F.col("_both") & (either | ~F.col("_either")))).drop("_both", "_either")


def tabulate(seeds: DataFrame, flows: DataFrame) -> DataFrame:
    """node, fact, proven, complete, depth, from_node, from_fact: the facts that hold at nodes of an exploded graph.

    seeds: node, fact, entered proven and complete. flows: src, fact_in, dst, fact_out, proven, complete: a transfer along an edge, a
    call, a return or a summary alike. Qualities are conjoined along a path; a row that brings nothing above what its (node, fact) has is
    not followed. The loop is semi-naive: each round follows and writes its new rows alone, with the row each came from. The flows are
    written once."""
    columns = ["node", "fact", "proven", "complete", "depth", "from_node", "from_fact"]
    start = seeds.select("node", "fact").distinct().select("node", "fact", F.lit(True).alias("proven"), F.lit(True).alias("complete"), F.lit(0).alias("depth"), F.lit(None).cast(seeds.schema["node"].dataType).alias("from_node"), F.lit(None).cast(seeds.schema["fact"].dataType).alias("from_fact"))
    frontier = cut_lineage(start)
    rounds = [frontier]
    step = dealt(cut_lineage(flows.select("src", "fact_in", "dst", "fact_out", F.col("proven").alias("_p"), F.col("complete").alias("_c"))))
    while True:
        met = frontier.join(step, (F.col("node") == F.col("src")) & (F.col("fact") == F.col("fact_in")))
        found = met.select(F.col("dst").alias("n"), F.col("fact_out").alias("f"), (F.col("proven") & F.col("_p")).alias("p"), (F.col("complete") & F.col("_c")).alias("c"), F.col("node").alias("from_node"), F.col("fact").alias("from_fact"))
        found = found.groupBy(F.col("n").alias("node"), F.col("f").alias("fact"), F.col("p").alias("proven"), F.col("c").alias("complete")).agg(F.min(F.struct("from_node", "from_fact")).alias("by")).select("node", "fact", "proven", "complete", F.lit(len(rounds)).alias("depth"), "by.from_node", "by.from_fact")
        old = together(rounds).select(F.col("node").alias("_n"), F.col("fact").alias("_f"), F.col("proven").alias("_p"), F.col("complete").alias("_c"))
        above = (F.col("node") == F.col("_n")) & (F.col("fact") == F.col("_f")) & (F.col("_p") | ~F.col("proven")) & (F.col("_c") | ~F.col("complete"))
        frontier = cut_lineage(dominated_out(found.join(dealt(old), above, "left_anti").select(*columns)).select(*columns))
        if frontier.isEmpty():
            return dominated_out(together(rounds)).select(*columns)
        rounds.append(frontier)


def witnesses(reached: DataFrame, ends: DataFrame) -> DataFrame:
    """node, fact, path of each end (node, fact): the nodes from a seed to it, by the rows that each came from, one round for each hop."""
    by = reached.groupBy("node", "fact").agg(F.min(F.struct("depth", "from_node", "from_fact")).alias("b")).select(F.col("node").alias("_n"), F.col("fact").alias("_f"), F.col("b.from_node").alias("_fn"), F.col("b.from_fact").alias("_ff"))
    by = dealt(cut_lineage(by))
    now = ends.select("node", "fact", F.array("node").alias("path"), F.col("node").alias("at"), F.col("fact").alias("with"))
    done = []
    while True:
        met = cut_lineage(now.join(by, (F.col("at") == F.col("_n")) & (F.col("with") == F.col("_f"))))
        done.append(met.where("_fn is null").select("node", "fact", "path"))
        now = met.where("_fn is not null").select("node", "fact", F.concat(F.array("_fn"), "path").alias("path"), F.col("_fn").alias("at"), F.col("_ff").alias("with"))
        if now.isEmpty():
            return together(done)


def summaries(reached: DataFrame, exits: DataFrame) -> DataFrame:
    """entry_fact, exit, exit_fact, proven, complete of one procedure's tabulation from labelled seeds (fact is `entry>fact`): what may be
    put in a caller's graph as one flow, so that the procedure is not entered again."""
    parts = F.split(F.col("fact"), ">")
    return reached.join(exits.select("node"), "node", "left_semi").select(parts[0].alias("entry_fact"), F.col("node").alias("exit"), parts[1].alias("exit_fact"), "proven", "complete").distinct()


def rewrite_chase(starts: DataFrame, rules: DataFrame, bound: int) -> DataFrame:
    """id, steps, outcome, fixed_point of following the rules (src, dst) from each id: converged at an id without a
    rule or with itself as target, cycle, or exceeded_budget after `bound` steps."""
    now = starts.select("id", F.col("id").alias("at"), F.array("id").alias("path"), F.lit(None).cast("string").alias("outcome"))
    for _ in range(bound):
        moved = now.join(rules.select(F.col("src").alias("at"), "dst"), "at", "left")
        open_ = F.col("outcome").isNull()
        done = F.when(~open_, F.col("outcome")).when(F.col("dst").isNull() | (F.col("dst") == F.col("at")), "converged").when(F.array_contains("path", F.col("dst")), "cycle")
        goes = open_ & done.isNull()
        now = moved.select("id", F.when(goes, F.col("dst")).otherwise(F.col("at")).alias("at"), F.when(goes, F.concat("path", F.array("dst"))).otherwise(F.col("path")).alias("path"), done.alias("outcome"))
    last = now.join(rules.select(F.col("src").alias("at"), "dst"), "at", "left")
    done = F.when(F.col("outcome").isNotNull(), F.col("outcome")).when(F.col("dst").isNull() | (F.col("dst") == F.col("at")), "converged").when(F.array_contains("path", F.col("dst")), "cycle").otherwise("exceeded_budget")
    return last.select("id", (F.size("path") - 1).alias("steps"), done.alias("outcome"), F.when(done == "converged", F.col("at")).alias("fixed_point"))


def shortest_paths(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """root, id, path: a shortest path, the least one in the order of its nodes."""
    frontier = cut_lineage(seeds.select(F.col("id").alias("root"), "id", F.array("id").alias("path")).distinct())
    edges, rounds = dealt(walked(frontier, edges)), [frontier]
    for _ in range(depth):
        best = together(rounds)
        found = frontier.join(edges, frontier["id"] == edges["src"]).select("root", F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        frontier = cut_lineage(found.join(dealt(best.select("root", "id")), ["root", "id"], "left_anti").groupBy("root", "id").agg(F.min("path").alias("path")))
        if frontier.isEmpty():
            break
        rounds.append(frontier)
    return together(rounds)


def dominators(entry: int, edges: list[tuple[int, int]]) -> dict[int, set[int]]:
    """The dominators of each node that is reached from entry."""
    after, before = {}, {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
        before.setdefault(b, []).append(a)
    order, todo = [], [entry]
    while todo:
        v = todo.pop()
        if v not in order:
            order.append(v)
            todo += sorted(after.get(v, []), reverse=True)
    dom = {v: set(order) for v in order} | {entry: {entry}}
    changed = True
    while changed:
        changed = False
        for v in order[1:]:
            new = {v} | set.intersection(*(dom[p] for p in before[v] if p in dom))
            if new != dom[v]:
                dom[v], changed = new, True
    return dom


def strong_components(edges: list[tuple[int, int]]) -> dict[int, int]:
    """The least node of each node's strongly connected component (Tarjan without recursion)."""
    after: dict[int, list[int]] = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
    index, low, on, stack, out = {}, {}, set(), [], {}
    for root in sorted(after):
        work = [(root, iter(sorted(after[root])))] if root not in index else []
        while work:
            v, it = work[-1]
            if v not in index:
                index[v] = low[v] = len(index)
                stack.append(v)
                on.add(v)
            for w in it:
                if w not in index:
                    work.append((w, iter(sorted(after[w]))))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    part = []
                    while not part or part[-1] != v:
                        part.append(stack.pop())
                        on.discard(part[-1])
                    out |= dict.fromkeys(part, min(part))
    return out


def reaching(entry: int, edges: list[tuple[int, int]], events: list[tuple[int, str, str]]) -> list[tuple[str, int, int]]:
    """(subject, establishing point, reading point) of the definitions that reach reads; events: (point, class, subject)."""
    makes = {(p, s) for p, c, s in events if c == "establish"}
    kills = {(p, s) for p, c, s in events if c in ("establish", "kill")}
    points = {entry} | {x for e in edges for x in e}
    into = {p: set() for p in points}
    out = {p: set() for p in points}
    changed = True
    while changed:
        changed = False
        for p in sorted(points):
            got = set().union(*(out[a] for a, b in edges if b == p)) if edges else set()
            new = {(s, d) for s, d in got if (p, s) not in kills} | {(s, p) for q, s in makes if q == p}
            if got != into[p] or new != out[p]:
                into[p], out[p], changed = got, new, True
    return sorted((s, d, p) for p, c, s in events if c == "read" for t, d in into.get(p, ()) if t == s)


def postdominators(exits: list[int], edges: list[tuple[int, int]]) -> dict[int, set[int]]:
    """The postdominators of each node from which an exit is reached: dominators backwards from one end behind all exits."""
    end = min([v for e in edges for v in e] + exits, default=0) - 1
    back = [(b, a) for a, b in edges] + [(end, x) for x in exits]
    return {v: d - {end} for v, d in dominators(end, back).items() if v != end}


def control_dependence(exits: list[int], edges: list[tuple[int, int]]) -> set[tuple[int, int]]:
    """(node, branch): the node runs or not by which way the branch goes: it postdominates a successor of the branch, not the branch itself."""
    post = postdominators(exits, edges)
    return {(v, a) for a, b in edges for v in post.get(b, ()) if v not in post.get(a, set()) - {a}}


def loop_regions(entry: int, edges: list[tuple[int, int]]) -> dict[int, set[int]]:
    """header: the nodes of its natural loop, of all back edges to it."""
    dom = dominators(entry, edges)
    before: dict[int, list[int]] = {}
    for a, b in edges:
        before.setdefault(b, []).append(a)
    out: dict[int, set[int]] = {}
    for a, h in edges:
        if h in dom.get(a, ()):
            region, todo = out.setdefault(h, {h}), [a]
            while todo:
                v = todo.pop()
                if v not in region:
                    region.add(v)
                    todo += before.get(v, [])
    return out


def depth_first(entry: int, edges: list[tuple[int, int]]) -> list[int]:
    """The nodes in the order they are first seen, successors by number."""
    after: dict[int, list[int]] = {}
    for a, b in sorted(edges, reverse=True):
        after.setdefault(a, []).append(b)
    seen, order, todo = set(), [], [entry]
    while todo:
        v = todo.pop()
        if v not in seen:
            seen.add(v)
            order.append(v)
            todo += after.get(v, [])
    return order


def control_facts(points: DataFrame, edges: DataFrame) -> DataFrame:
    """procedure, relation, a, b of each procedure's control-flow graph: b dominates, postdominates or controls a, is the header of a's
    loop, the least node of a's strong component, or a's number in depth-first order. points: procedure, point,
    boundary; edges: procedure, src, dst. A graph is one row, bounded by the size of a source function."""
    kind = points.schema["procedure"].dataType.simpleString()

    def solve(entry: int, exits: list[int], own: list) -> list[tuple[str, int, int]]:
        out = [("dominates", v, d) for v, ds in dominators(entry, own).items() for d in ds]
        out += [("postdominates", v, d) for v, ds in postdominators(exits, own).items() for d in ds]
        out += [("controls", v, b) for v, b in control_dependence(exits, own)]
        out += [("loop", v, h) for h, vs in loop_regions(entry, own).items() for v in vs]
        out += [("component", v, c) for v, c in strong_components(own).items()]
        return out + [("depth_first", v, i) for i, v in enumerate(depth_first(entry, own))]

    def run(frames):
        for pdf in frames:
            rows = [(p, *r) for p, e, x, own in zip(pdf["procedure"], pdf["entry"], pdf["exits"], pdf["edges"]) for r in sorted(solve(int(e), [int(v) for v in x], [] if own is None else [(int(a), int(b)) for a, b in own]))]
            yield pd.DataFrame(rows, columns=["procedure", "relation", "a", "b"])

    entry, leaves = F.col("boundary") == "entry", F.col("boundary").like("%exit")
    packed = points.groupBy("procedure").agg(F.min(F.when(entry, F.col("point"))).alias("entry"), F.collect_list(F.when(leaves, F.col("point"))).alias("exits")).where("entry is not null")
    packed = packed.join(edges.groupBy("procedure").agg(F.array_sort(F.collect_list(F.array("src", "dst"))).alias("edges")), "procedure", "left")
    return packed.mapInPandas(run, f"procedure {kind}, relation string, a long, b long")


def relations_of(entry: int, own: list, seen: list) -> set[tuple]:
    """(relation, subject, source, target, certainty) of a procedure's reads; seen: (point, event, subject)."""
    dom = dominators(entry, own)
    out, reach = set(), reaching(entry, own, seen)
    for s, d, p in reach:
        single = sum(1 for t, _, q in reach if (t, q) == (s, p)) == 1
        out.add(("reaching", s, d, p, "exact" if single and d in dom.get(p, ()) else "may"))
    for p, c, s in seen:
        for q, k, t in seen:
            if c == "read" and k == "establish" and s == t:
                if q in dom.get(p, ()):
                    out.add(("dominates", s, q, p, "exact"))
                if q == p:
                    out.add(("same_evaluation", s, q, p, "exact"))
    return out


def spread(source: int, own: dict[int, list[int]], blocked: set[int]) -> dict[int, int]:
    """The points reached from one and the number of steps to them; blocked ones are neither entered nor left."""
    depth = {} if source in blocked else {source: 0}
    todo = list(depth)
    for v in todo:
        for w in own.get(v, ()):
            if w not in depth and w not in blocked:
                depth[w] = depth[v] + 1
                todo.append(w)
    return depth


def packed(points: DataFrame, edges: DataFrame, events: DataFrame) -> DataFrame:
    """One row for each procedure with an entry: procedure, entry, edges, events. points: id, procedure_id, boundary; edges: src, dst,
    and procedure where that is known; events: procedure_id, point, id, path and the text `code`. A procedure is bounded by the size of a source function."""
    entry = points.where("boundary = 'entry'").groupBy(F.col("procedure_id").alias("procedure")).agg(F.min("id").cast("long").alias("entry"))
    owned = edges.where("dst is not null")
    if "procedure" not in edges.columns:
        owned = owned.join(points.select(F.col("id").alias("src"), F.col("procedure_id").alias("procedure")), "src")
    own = owned.groupBy("procedure").agg(F.array_sort(F.collect_list(F.struct(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")))).alias("edges"))
    seen = events.where("point is not null and code is not null").groupBy(F.col("procedure_id").alias("procedure")).agg(F.array_sort(F.collect_list(F.struct(F.col("point").cast("long").alias("point"), "code", "id", "path"))).alias("events"))
    none = F.array().cast(own.schema["edges"].dataType)
    return entry.join(seen, "procedure").join(own, "procedure", "left").withColumn("edges", F.coalesce("edges", none))


def by_shape(graphs: DataFrame, solve, fields: str) -> DataFrame:
    """The pairs of events that `solve` finds in each of the packed procedures, with the columns beside the graph: source_id,
    source_point, target_id, target_point, path (the target's) and `fields`.

    Points are numbered within their procedure, so that procedures of one shape are solved once for each batch:
    solve(entry, [(src, dst)], [(point, code)]) gives [(number of the source event, of the target, *fields)]."""
    keep = [c for c in graphs.columns if c not in ("entry", "edges", "events")]
    kinds = {f.name: f.dataType.simpleString() for f in graphs.schema["events"].dataType.elementType}
    schema = ", ".join([f"`{c}` {graphs.schema[c].dataType.simpleString()}" for c in keep] + [f"source_id {kinds['id']}, source_point long, target_id {kinds['id']}, target_point long, path string", fields])
    types = [f.split()[1] for f in fields.split(", ")]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            n = b.num_rows
            edges, events = b.column("edges"), b.column("events")
            length = lambda lists: np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
            le, lv = length(edges), length(events)
            (src, dst), (point, code, ids, path) = edges.flatten().flatten(), events.flatten().flatten()
            coded = code.dictionary_encode()
            names, row = coded.dictionary.to_pylist(), np.arange(n)
            rows = np.concatenate([row, np.repeat(row, le), np.repeat(row, le), np.repeat(row, lv)])
            values = np.concatenate([b.column("entry").to_numpy(), src.to_numpy(), dst.to_numpy(), point.to_numpy()])
            order = np.lexsort((values, rows))
            r, v = rows[order], values[order]
            group = np.cumsum(np.r_[False, (r[1:] != r[:-1]) | (v[1:] != v[:-1])]) if n else r
            rank = np.empty(len(values), np.int64)
            rank[order] = group - group[np.searchsorted(r, row)][r]
            entry, e = rank[:n].tolist(), len(src)
            own = np.stack([rank[n : n + e], rank[n + e : n + 2 * e]], 1)
            seen = np.stack([rank[n + 2 * e :], coded.indices.to_numpy()], 1)
            eb, vb, eo, vo = own.tobytes(), seen.tobytes(), np.r_[0, np.cumsum(le)], np.r_[0, np.cumsum(lv)]
            shapes: dict[tuple, list[int]] = {}
            for k, (a, z, p, q) in enumerate(zip((16 * eo[:-1]).tolist(), (16 * eo[1:]).tolist(), (16 * vo[:-1]).tolist(), (16 * vo[1:]).tolist())):
                shapes.setdefault((entry[k], eb[a:z], vb[p:q]), []).append(k)
            owner, source, target, rest = [], [], [], [[] for _ in types]
            for (first, _, _), same in shapes.items():
                k = same[0]
                found = solve(first, [tuple(x) for x in own[eo[k] : eo[k + 1]].tolist()], [(x, names[c]) for x, c in seen[vo[k] : vo[k + 1]].tolist()])
                if found:
                    i, j, *more = zip(*found)
                    owner.append(np.repeat(same, len(i)))
                    source.append((vo[same][:, None] + np.array(i)).ravel())
                    target.append((vo[same][:, None] + np.array(j)).ravel())
                    for x, y in zip(rest, more):
                        x.extend(y * len(same))
            if owner:
                o, s, t = (pa.array(np.concatenate(x)) for x in (owner, source, target))
                columns = [b.column(c).take(o) for c in keep] + [ids.take(s), point.take(s), ids.take(t), point.take(t), path.take(t)]
                columns += [pa.array(x, pa.int32() if kind == "int" else pa.string()) for x, kind in zip(rest, types)]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "source_id", "source_point", "target_id", "target_point", "path", *(f.split()[0] for f in fields.split(", "))])

    return graphs.mapInArrow(run, schema)


def flow_pairs(graphs: DataFrame) -> DataFrame:
    """The packed procedures' pairs of an establishment and a read with relation and certainty; code is the event, a null byte, the subject."""

    def solve(entry: int, own: list, coded: list) -> list[tuple]:
        seen = [(p, *code.split("\0", 1)) for p, code in coded]
        at: dict[tuple, list[int]] = {}
        for i, event in enumerate(seen):
            at.setdefault(event, []).append(i)
        return [(i, j, relation, certainty) for relation, s, d, p, certainty in sorted(relations_of(entry, own, seen)) for i in at.get((d, "establish", s), ()) for j in at.get((p, "read", s), ())]

    return by_shape(graphs, solve, "relation string, certainty string")


def flow_relations(points: DataFrame, edges: DataFrame, events: DataFrame) -> DataFrame:
    """procedure, relation, subject, source, target, certainty: reaching and dominating establishments of each read.
    points: procedure, point, boundary; edges: procedure, src, dst; events: procedure, point, event, subject."""
    seen = events.select(F.col("procedure").alias("procedure_id"), "point", F.col("subject").alias("id"), F.lit("").alias("path"), F.concat("event", F.lit("\0"), "subject").alias("code"))
    found = flow_pairs(packed(points.select(F.col("point").alias("id"), F.col("procedure").alias("procedure_id"), "boundary"), edges, seen))
    return found.select("procedure", "relation", F.col("source_id").alias("subject"), F.col("source_point").alias("source"), F.col("target_point").alias("target"), "certainty").distinct()


def flows_between(graphs: DataFrame, classes: bool) -> DataFrame:
    """The packed procedures' pairs of a source and a sink it reaches, and the least number of steps, around the barriers; code is a 0 or 1
    each for source, sink and barrier, and the subject. With classes, sinks and barriers count for their own subject alone."""

    def solve(entry: int, own: list, coded: list) -> list[tuple]:
        after: dict[int, list[int]] = {}
        for a, b in own:
            after.setdefault(a, []).append(b)
        out = []
        for i, (start, code) in enumerate(coded):
            if code[0] == "1":
                met = [j for j, (_, c) in enumerate(coded) if j != i and (not classes or (c[3:] == code[3:] != ""))]
                depth = spread(start, after, {coded[j][0] for j in met if coded[j][1][2] == "1"})
                out += [(i, j, depth[coded[j][0]]) for j in met if coded[j][1][1] == "1" and coded[j][0] in depth]
        return out

    return by_shape(graphs, solve, "distance int")


def page_rank(spark: SparkSession, edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """id, rank after a fixed number of rounds; dangling nodes give nothing on."""
    nodes = cut_lineage(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct())
    n = nodes.count()
    edges = cut_lineage(edges.select("src", "dst"))
    degree = cut_lineage(edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree")))
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for k in range(rounds):
        given = edges.join(ranks, edges["src"] == ranks["id"]).join(degree, "src").groupBy("dst").agg(F.sum(F.col("rank") / F.col("degree")).alias("given"))
        ranks = nodes.join(given, nodes["id"] == given["dst"], "left").select("id", (F.lit((1 - damping) / max(n, 1)) + damping * F.coalesce("given", F.lit(0.0))).alias("rank"))
        if k % 5 == 4:
            ranks = cut_lineage(ranks)
    return ranks
