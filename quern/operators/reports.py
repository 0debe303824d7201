"""Analytic reports: hotspots, affinity, clones, similarity pairing, size roll-ups, dead code, diffs, dense search, smells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars


def hotspots(changes: DataFrame, complexity: DataFrame, churn_over: int = 10, complexity_over: int = 15, authors: int = 5) -> DataFrame:
    """file, churn, last_modified, complexity, category, top_authors; changes: file, commit, author, at. A file's
    authors are counted before they are ranked, so a window holds one row for each author."""
    churn = changes.groupBy("file").agg(F.count_distinct("commit").alias("churn"), F.max("at").alias("last_modified"))
    by = Window.partitionBy("file").orderBy(F.col("n").desc(), "author")
    top = changes.groupBy("file", "author").agg(F.count_distinct("commit").alias("n")).withColumn("k", F.row_number().over(by)).where(F.col("k") <= authors)
    named = top.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "author"))), lambda x: x["author"].cast("string")), ",").alias("top_authors"))
    hot, hard = F.col("churn") > churn_over, F.col("complexity") > complexity_over
    category = F.when(hot & hard, "HOTSPOT").when(~hot & hard, "ABANDONWARE").when(hot, "ACTIVE").otherwise("STABLE")
    return churn.join(complexity, "file").join(named, "file").select("file", "churn", "last_modified", "complexity", category.alias("category"), "top_authors")


def time_window(rows: DataFrame, at: str, since: str, until: str) -> DataFrame:
    """[since, until)."""
    return rows.where((F.col(at) >= F.lit(since).cast("timestamp")) & (F.col(at) < F.lit(until).cast("timestamp")))


def affinity(baskets: DataFrame, most: int = 40) -> DataFrame:
    """seed, other, score: sum of joint / freq(seed) * sqrt(1 + total / freq(other)); baskets (basket, item) with more than
    `most` items say nothing and are left out, which also bounds the pairs of one."""
    own = baskets.distinct()
    size = own.groupBy("basket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most)
    own = own.join(size, "basket").select("basket", "item")
    freq = own.groupBy("item").agg(F.count(F.lit(1)).alias("freq"))
    total = own.agg(F.count_distinct("basket").alias("total"))
    joint = own.select("basket", F.col("item").alias("seed")).join(own.select("basket", F.col("item").alias("other")), "basket").where("seed <> other").groupBy("seed", "other").agg(F.count(F.lit(1)).alias("joint"))
    both = joint.join(freq.select(F.col("item").alias("seed"), F.col("freq").alias("f1")), "seed").join(freq.select(F.col("item").alias("other"), F.col("freq").alias("f2")), "other")
    n = total.scalar() if hasattr(total, "scalar") else F.lit(total.head()[0])
    return both.select("seed", "other", (F.col("joint") / F.col("f1") * F.sqrt(1 + n / F.col("f2"))).alias("score"))


def cascade(items: DataFrame, tiers: list[Column], order: list[Column], limit: int) -> DataFrame:
    """Items by the first tier that holds, then by the given keys."""
    tier = reduce(lambda w, t: w.when(t[1], t[0]), enumerate(tiers[1:], 1), F.when(tiers[0], 0)).otherwise(len(tiers))
    return items.withColumn("tier", tier).orderBy("tier", *order).limit(limit)


def clones(documents: DataFrame, k: int, least_shared: int, least_score: int) -> DataFrame:
    """a, b (a < b), shared, score of all pairs of (id, text): Jaccard of word shingles in whole percent, half away from zero.

    Texts with one set of shingles are one class. Of a class's shingles, rarest first, only so many are indexed that a pair with the
    score must meet on one of them; what meets is worked out exactly on the whole sets. So a line that very many texts
    share makes no pairs by itself."""
    from .graph import cut_lineage

    bound = (least_score - 0.5) / 100
    sets = documents.select("id", scalars.shingle_hashes(F.col("text"), k).alias("s")).where("size(s) > 0")
    keyed = sets.select("id", "s", F.size("s").alias("n"), F.xxhash64(F.array_sort("s")).alias("g1"), F.hash(F.array_sort("s")).alias("g2"))
    # Written once: the sets are looked at five times.
    keyed = cut_lineage(keyed)
    classes = keyed.groupBy("n", "g1", "g2").agg(F.min("id").alias("c"), F.first("s").alias("s"))
    named = classes.select("c", "n", "s")
    tokens = named.select("c", "n", F.explode("s").alias("h"))
    df = tokens.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    common = tokens.join(df, "h")
    by = Window.partitionBy("c")
    # Shingles of one class alone come before all others and meet nothing.
    place = F.row_number().over(by.orderBy("df", "h")) + F.col("n") - F.count(F.lit(1)).over(by)
    indexed = common.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(bound * F.col("n")) + 1).select("c", "n", "h")
    x, y = (indexed.select(F.col("c").alias(c), F.col("n").alias(n), "h") for c, n in (("x", "n1"), ("y", "n2")))
    met = x.join(y, "h").where((F.col("x") < F.col("y")) & (F.least("n1", "n2") >= bound * F.greatest("n1", "n2"))).select("x", "y").distinct()
    of = lambda c: named.select(F.col("c").alias(c), F.col("s").alias(f"s_{c}"))
    judged = met.join(of("x"), "x").join(of("y"), "y").select("x", "y", F.size(F.array_intersect("s_x", "s_y")).cast("long").alias("shared"), (F.size("s_x") + F.size("s_y")).alias("both"))
    scored = judged.select("x", "y", "shared", F.round(100 * F.col("shared") / (F.col("both") - F.col("shared"))).cast("long").alias("score")).where((F.col("shared") >= least_shared) & (F.col("score") >= least_score))
    members = keyed.join(classes.select("n", "g1", "g2", "c"), ["n", "g1", "g2"]).select("id", "c", F.col("n").cast("long").alias("n"))
    of = lambda c, i: members.select(F.col("c").alias(c), F.col("id").alias(i))
    across = scored.join(of("x", "i"), "x").join(of("y", "j"), "y").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "shared", "score")
    within = members.select("c", F.col("id").alias("a"), F.col("n").alias("shared")).join(of("c", "b"), "c").where((F.col("a") < F.col("b")) & (F.col("shared") >= least_shared)).select("a", "b", "shared", F.lit(100).cast("long").alias("score"))
    return across.union(within)


#: Bags on each side of a block of pairs, and pairs of tokens that are added up at once.
BLOCK, CHUNK = 2048, 1 << 20


def bag_similarity(left: DataFrame, right: DataFrame, most_df: int | None = None, least: float = 0.0) -> DataFrame:
    """l, r, score: IDF-weighted bag Jaccard, sum w min / sum w max, of (id, token, n) bags. Pairs without a common
    token, or below `least`, are not made; most_df is the rarity gate, an option that leaves frequent tokens out of the pairing alone.

    All pairs are worked out, block by block: what is sent are bags, once for each block of the other side, and no pairs."""
    from .graph import cut_lineage

    bags = left.select("id", "token").union(right.select("id", "token"))
    n = bags.agg(F.count_distinct("id").alias("n")).head()[0]
    df = bags.groupBy("token").agg(F.count_distinct("id").alias("df"))
    idf = cut_lineage(df.select("token", "df", F.log((F.lit(n) + 1) / (F.col("df") + 0.5)).alias("w"), F.monotonically_increasing_id().alias("t")))
    paired = F.lit(True) if most_df is None else F.col("df") <= most_df

    def packed(bag: DataFrame, met: Column) -> DataFrame:
        own = F.struct("t", F.col("n").cast("double").alias("n"), "w")
        return bag.join(idf, "token").groupBy("id").agg(F.sum(F.col("w") * F.col("n")).alias("total"), F.collect_list(F.when(met, own)).alias("own"))

    def dealt(bag: DataFrame, at: str, other: str, mine: int, others: int) -> DataFrame:
        place = F.pmod(F.xxhash64("id"), F.lit(mine)).alias(at)
        return bag.select("id", "total", F.col("own.t").alias("t"), F.col("own.n").alias("n"), F.col("own.w").alias("w"), place, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))).alias(other))

    rows, columns = (max(1, -(-b.agg(F.count_distinct("id")).head()[0] // BLOCK)) for b in (left, right))
    x, y = dealt(packed(left, paired), "i", "j", rows, columns), dealt(packed(right, F.lit(True)), "j", "i", columns, rows)

    def block(a, b):
        import numpy as np
        import pyarrow as pa

        def flat(table):
            lists = table.column("t").combine_chunks()
            values = lambda c: table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            order = np.argsort(values("t"), kind="stable")
            return values("t")[order], owner[order], values("n")[order], values("w")[order]

        (ta, oa, na, wa), (tb, ob, nb, _) = flat(a), flat(b)
        low, width = np.zeros(len(a) * len(b)), len(b)
        first, count = np.searchsorted(tb, ta, "left"), np.searchsorted(tb, ta, "right") - np.searchsorted(tb, ta, "left")
        ends = np.cumsum(count)
        for start in range(0, int(ends[-1]) if len(ends) else 0, CHUNK):
            # The pairs of tokens from start on, by their numbers.
            k = np.arange(start, min(start + CHUNK, int(ends[-1])))
            p = np.searchsorted(ends, k, "right")
            q = first[p] + (k - (ends[p] - count[p]))
            np.add.at(low, oa[p] * width + ob[q], wa[p] * np.minimum(na[p], nb[q]))
        low = low.reshape(len(a), width)
        score = low / (a.column("total").to_numpy()[:, None] + b.column("total").to_numpy()[None, :] - low)
        l, r = np.nonzero((low > 0) & (score >= least))
        return pa.table({"l": a.column("id").take(pa.array(l)), "r": b.column("id").take(pa.array(r)), "score": score[l, r]})

    return x.groupBy("i", "j").cogroup(y.groupBy("i", "j")).applyInArrow(block, f"l {left.schema['id'].dataType.simpleString()}, r {right.schema['id'].dataType.simpleString()}, score double")


def greedy_pairs(scored: DataFrame, least: float) -> DataFrame:
    """One-to-one pairs by score from the top, ties by ids: in each round the pairs that are the best of both their ends
    are taken and the rest of those ends' pairs go; equal to the sequential greedy matching. Each end's best is an
    aggregate, so the pairs themselves are not sent to find it."""
    from .graph import cut_lineage

    left, taken = cut_lineage(scored.where(F.col("score") >= least).select("l", "r", "score")), []
    best = lambda end, other: left.groupBy(end).agg(F.min(F.struct((-F.col("score")).alias("s"), other)).alias("b"))
    while not left.isEmpty():
        ours, theirs = best("l", "r").select("l", "b.r", (-F.col("b.s")).alias("score")), best("r", "l").select("b.l", "r")
        taken.append(now := cut_lineage(ours.join(theirs, ["l", "r"])))
        left = cut_lineage(left.join(now.select("l"), "l", "left_anti").join(now.select("r"), "r", "left_anti").select("l", "r", "score"))
    return reduce(DataFrame.union, taken) if taken else scored.limit(0).select("l", "r", "score")


def line_context(documents: DataFrame, pattern: str, around: int) -> DataFrame:
    """id, line, text of the lines that match or lie within `around` lines of one that does; hit says which.

    Matching texts alone are cut into lines; whether a neighbour matches is looked up in the document's own array."""
    cut = documents.where(F.col("text").rlike(pattern)).select("id", F.split("text", "\n").alias("lines"))
    flagged = cut.select("id", F.transform("lines", lambda t: F.struct(t.alias("t"), t.rlike(pattern).alias("hit"))).alias("lines"))
    marked = F.transform("lines", lambda x, i: F.struct((i + 1).alias("line"), x["t"].alias("text"), x["hit"].alias("hit")))
    rows = flagged.select("id", F.explode(marked).alias("x")).select("id", "x.*")
    by = Window.partitionBy("id").orderBy("line").rowsBetween(-around, around)
    return rows.withColumn("near", F.max(F.col("hit").cast("int")).over(by)).where("near = 1").drop("near")


def dense_top_k(vectors: DataFrame, query: list[float] | Column, k: int) -> DataFrame:
    """id, score, normalized: the k largest cosines (ties by id) by TakeOrdered, and min-max over them, 0.01 at least, 1 where all are equal."""
    q = F.array(*map(F.lit, query)) if isinstance(query, list) else query
    top = vectors.select("id", scalars.cosine(F.col("vector"), q).alias("score")).orderBy(F.col("score").desc(), "id").limit(k)
    whole = Window.partitionBy(F.lit(1))  # k rows
    low, high = F.min("score").over(whole), F.max("score").over(whole)
    return top.select("id", "score", F.when(high == low, 1.0).otherwise(F.greatest(F.lit(0.01), (F.col("score") - low) / (high - low))).alias("normalized"))


def dead_code(declarations: DataFrame, usages: DataFrame, least: int = 8, most_usages: int = 1) -> DataFrame:
    """id, usages, score of the little used: 30 + min(lines/4, 20) unused, 12 + min(lines/8, 12) used."""
    n = usages.groupBy("id").agg(F.count(F.lit(1)).alias("usages"))
    score = F.when(F.col("usages") == 0, 30 + F.least(F.floor(F.col("lines") / 4), F.lit(20))).otherwise(12 + F.least(F.floor(F.col("lines") / 8), F.lit(12)))
    both = declarations.join(n, "id", "left").withColumn("usages", F.coalesce("usages", F.lit(0)))
    return both.where(F.col("usages") <= most_usages).select("id", "usages", score.cast("long").alias("score")).where(F.col("score") >= least)


def roll_up(nodes: DataFrame, edges: DataFrame, value: str) -> DataFrame:
    """id, total, below: a node's own and its descendants' values; edges: parent as src, child as dst."""
    from .graph import closure

    under = closure(nodes.select("id"), edges)
    sums = under.join(nodes.select("id", value), "id").groupBy("root").agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("below"))
    return nodes.join(sums, nodes["id"] == sums["root"], "left").select(nodes["id"], (F.col(value) + F.coalesce("s", F.lit(0))).alias("total"), F.coalesce("below", F.lit(0)).cast("long").alias("below"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, body: str) -> DataFrame:
    """key, state: introduced, deleted, edited, unchanged."""
    o, n = old.select(F.col(key), F.col(body).alias("_o"), F.lit(1).alias("_a")), new.select(F.col(key), F.col(body).alias("_n"), F.lit(1).alias("_b"))
    state = F.when(F.col("_a").isNull(), "introduced").when(F.col("_b").isNull(), "deleted").when(F.col("_o").eqNullSafe(F.col("_n")), "unchanged").otherwise("edited")
    return o.join(n, key, "full").select(key, state.alias("state"))


def review(findings: DataFrame, baseline: DataFrame, key: list[str]) -> DataFrame:
    """The findings' state against a baseline: new, existing, absent."""
    f, b = findings.select(*key).distinct().withColumn("_f", F.lit(1)), baseline.select(*key).distinct().withColumn("_b", F.lit(1))
    return f.join(b, key, "full").select(*key, F.when(F.col("_b").isNull(), "new").when(F.col("_f").isNull(), "absent").otherwise("existing").alias("state"))


def line_classes(documents: DataFrame, comment: str) -> DataFrame:
    """id, lines, comments, blank, density in whole percent."""
    lines = F.split("text", "\n")
    counts = lambda ls: F.struct(F.size(ls).alias("n"), F.size(F.filter(ls, lambda t: t.rlike(comment))).alias("c"), F.size(F.filter(ls, lambda t: F.trim(t) == "")).alias("b"))
    n, c, b = (F.col(f"_c.{x}") for x in "ncb")
    return documents.select("id", scalars.let(lines, counts).alias("_c")).select("id", n.cast("long").alias("lines"), c.cast("long").alias("comments"), b.cast("long").alias("blank"), F.round(100 * c / n).cast("long").alias("density"))


def protocol_run(events: DataFrame, by: str, order: list[str], symbol: str, transitions: dict[tuple[str, str], str], initial: str, accepting: list[str], errors: list[str]) -> DataFrame:
    """by, state, violations, ended_badly: a finite automaton folded over each subject's ordered events; an event
    without a transition leaves the state. One subject's events are one array."""
    seq = F.array_sort(F.collect_list(F.struct(*order, symbol)))
    return events.groupBy(by).agg(protocol_fold(seq, symbol, transitions, initial, errors).alias("r")).select(by, *protocol_end(F.col("r"), accepting))


def protocol_fold(seq: Column, symbol: str, transitions: dict[tuple[str, str], str], initial: str, errors: list[str]) -> Column:
    """The automaton's state (s) and violations (v) after the events of an array in order."""
    table = F.create_map(*(F.lit(x) for (s, e), t in transitions.items() for x in (f"{s}\0{e}", t)))
    step = lambda a, x: F.struct(F.coalesce(F.try_element_at(table, F.concat(a["s"], F.lit("\0"), x[symbol])), a["s"]).alias("s"), a["v"].alias("v"))
    count = lambda a: F.struct(a["s"].alias("s"), (a["v"] + F.when(a["s"].isin(*errors), 1).otherwise(0)).alias("v"))
    return F.aggregate(seq, F.struct(F.lit(initial).alias("s"), F.lit(0).alias("v")), lambda a, x: count(step(a, x)))


def protocol_end(run: Column, accepting: list[str]) -> list[Column]:
    return [run["s"].alias("state"), run["v"].cast("long").alias("violations"), (~run["s"].isin(*accepting)).alias("ended_badly")]


EXCEPTION_WEIGHTS = {"throwable": 5, "exception": 3, "runtime": 2, "empty": 5, "comment_only": 4, "small": 2, "log_only": 2}


def exception_smells(handlers: DataFrame, least: int = 4) -> DataFrame:
    """id, score: broad + empty + comment-only + small + log-only - one for each statement up to six; handlers: id, caught, statements, comment_only, log_only."""
    w = EXCEPTION_WEIGHTS
    broad = F.when(F.col("caught") == "Throwable", w["throwable"]).when(F.col("caught") == "Exception", w["exception"]).when(F.col("caught") == "RuntimeException", w["runtime"]).otherwise(0)
    empty = F.when((F.col("statements") == 0) & ~F.col("comment_only"), w["empty"]).otherwise(0)
    rest = F.when(F.col("comment_only"), w["comment_only"]).otherwise(0) + F.when(F.col("statements").between(1, 2), w["small"]).otherwise(0) + F.when(F.col("log_only"), w["log_only"]).otherwise(0)
    score = broad + empty + rest - F.least("statements", F.lit(6))
    return handlers.select("id", score.cast("long").alias("score")).where(F.col("score") >= least)


def size_smells(declarations: DataFrame, lines: int = 80, branches: int = 10, god_lines: int = 300, children: int = 20, functions: int = 15) -> DataFrame:
    """id, smell: long_method and god_object; declarations: id, kind, lines, complexity, children, functions."""
    method = F.col("kind").isin("function", "method", "constructor") & ((F.col("lines") > lines) | (F.col("complexity") > branches))
    god = (F.col("kind") == "class") & ((F.col("lines") > god_lines) | (F.col("children") > children) | (F.col("functions") > functions))
    return declarations.select("id", F.when(method, "long_method").when(god, "god_object").alias("smell")).where("smell is not null")


def symbol_search(declarations: DataFrame, term: str, limit: int = 20) -> DataFrame:
    """Declarations by how the term meets them: exact name, component, prefix of one, substring of name, of full name."""
    low, name, full = term.lower(), F.lower("short_name"), F.lower("fq_name")
    parts = scalars.camel_parts(F.col("short_name"))
    score = F.when(F.col("short_name") == term, 9).when(name == low, 8).when(full == low, 7).when(F.array_contains(parts, low), 6).when(F.exists(parts, lambda p: p.startswith(low)), 5).when(name.contains(low), 3).when(full.contains(low), 2)
    return declarations.select("*", score.alias("score")).where("score is not null").orderBy(F.col("score").desc(), "path", "id").limit(limit)


def test_files(files: DataFrame) -> DataFrame:
    return files.withColumn("is_test", F.col("path").rlike(r"(?i)(^|/)(tests?|__tests__|spec)/|(^|/)test_[^/]*$|[._-](test|spec)\.[^/]*$|Tests?\.[^/]*$"))


TEST_WEIGHTS = {"none": 5, "tautology": 6, "constant_truth": 4, "constant_equality": 4, "nullness": 2, "shallow": 2, "literal": 2}


def test_assertion_smells(tests: DataFrame, assertions: DataFrame, least: int = 4) -> DataFrame:
    """id, score: a test (id) without an assertion has 5; each assertion (test_id, kind) adds its kind's weight, `meaningful`
    ones nothing; where all are shallow, 2 less one for each meaningful one is added, at least 0."""
    w = F.create_map(*(F.lit(x) for k, v in TEST_WEIGHTS.items() for x in (k, v)))
    weight = F.when(F.col("kind") == "shallow", 0).otherwise(F.coalesce(F.try_element_at(w, F.col("kind")), F.lit(0)))
    per = assertions.groupBy(F.col("test_id").alias("id")).agg(F.sum(weight).alias("sum"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "shallow").alias("shallow"), F.count_if(F.col("kind") == "meaningful").alias("good"))
    shallow = F.when(F.col("shallow") + F.col("good") == F.col("n"), F.when(F.col("shallow") > 0, F.greatest(F.lit(0), F.lit(TEST_WEIGHTS["shallow"]) - F.least("good", F.lit(4)))).otherwise(0)).otherwise(0)
    score = F.when(F.col("n").isNull(), TEST_WEIGHTS["none"]).otherwise(F.col("sum") + shallow)
    return tests.select("id").join(per, "id", "left").select("id", score.cast("long").alias("score")).where(F.col("score") >= least)


#: Kinds whose nodes count one for themselves and one for each of them around.
NESTING = ("if", "for_loop", "while_loop", "loop", "catch", "conditional")


def cognitive(nodes: DataFrame, callables: DataFrame) -> DataFrame:
    """id, complexity of each callable (id, path, node_id, subtree_end): every branch or loop below it counts 1 and as much again
    as it is nested in others within the callable; an `else_if` and a `case` count 1."""
    c = callables.select(F.col("id").alias("callable"), F.col("path").alias("_p"), F.col("node_id").alias("_c"), F.col("subtree_end").alias("_e"))
    own = nodes.where(F.col("kind").isin(*NESTING, "else_if", "case"))
    inside = own.join(c, (F.col("path") == F.col("_p")) & (F.col("node_id") > F.col("_c")) & (F.col("node_id") < F.col("_e"))).select("callable", "path", "node_id", "kind")
    around = nodes.where(F.col("kind").isin(*NESTING)).join(c, (F.col("path") == F.col("_p")) & (F.col("node_id") > F.col("_c")) & (F.col("node_id") < F.col("_e"))).select(F.col("callable").alias("_q"), F.col("node_id").alias("_a"), F.col("subtree_end").alias("_z"))
    nested = inside.where(F.col("kind").isin(*NESTING)).join(around, (F.col("callable") == F.col("_q")) & (F.col("node_id") > F.col("_a")) & (F.col("node_id") < F.col("_z"))).groupBy("callable").agg(F.count(F.lit(1)).alias("deep"))
    flat = inside.groupBy("callable").agg(F.count(F.lit(1)).alias("flat"))
    return callables.select("id").join(flat, F.col("id") == F.col("callable"), "left").drop("callable").join(nested, F.col("id") == F.col("callable"), "left").select("id", (F.coalesce("flat", F.lit(0)) + F.coalesce("deep", F.lit(0))).alias("complexity"))


def label_similarity(pairs: DataFrame, labels: DataFrame, control: DataFrame) -> DataFrame:
    """a, b, score: (2 * labels + control flow) / 3 in whole percent, each the multisets' shared part of their union; labels and
    control: id, label, n."""

    def overlap(bags: DataFrame, name: str) -> DataFrame:
        x, y = (bags.select(F.col("id").alias(k), "label", F.col("n").alias(f"n_{k}")) for k in "ab")
        low = pairs.join(x, "a").join(y, ["b", "label"]).groupBy("a", "b").agg(F.sum(F.least("n_a", "n_b")).alias("low"))
        size = bags.groupBy("id").agg(F.sum("n").alias("s"))
        both = pairs.select("a", "b").join(size.select(F.col("id").alias("a"), F.col("s").alias("s_a")), "a", "left").join(size.select(F.col("id").alias("b"), F.col("s").alias("s_b")), "b", "left").join(low, ["a", "b"], "left")
        union = F.coalesce("s_a", F.lit(0)) + F.coalesce("s_b", F.lit(0)) - F.coalesce("low", F.lit(0))
        return both.select("a", "b", F.when(union == 0, 1.0).otherwise(F.coalesce("low", F.lit(0)) / union).alias(name))

    both = overlap(labels, "l").join(overlap(control, "c"), ["a", "b"])
    return both.select("a", "b", F.round(100 * (2 * F.col("l") + F.col("c")) / 3).cast("long").alias("score"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """key, state, was of declarations (key, name, kind, signature, body): introduced, deleted, edited, signature_changed, unchanged, or
    moved, with the old key: one declaration on each side without a partner and with the same name, kind and body."""
    o = old.select("key", *(F.col(c).alias(f"o_{c}") for c in ("name", "kind", "signature", "body")), F.lit(True).alias("o"))
    n = new.select("key", *(F.col(c).alias(f"n_{c}") for c in ("name", "kind", "signature", "body")), F.lit(True).alias("n"))
    both = o.join(n, "key", "full")
    kept = both.where("o and n").select("key", F.when(~F.col("o_signature").eqNullSafe(F.col("n_signature")), "signature_changed").when(~F.col("o_body").eqNullSafe(F.col("n_body")), "edited").otherwise("unchanged").alias("state"), F.col("key").alias("was"))
    gone = both.where("n is null").select(F.col("key").alias("was"), F.col("o_name").alias("name"), F.col("o_kind").alias("kind"), F.col("o_body").alias("body"))
    come = both.where("o is null").select("key", F.col("n_name").alias("name"), F.col("n_kind").alias("kind"), F.col("n_body").alias("body"))
    alone = lambda rows, key: rows.groupBy("name", "kind", "body").agg(F.min(key).alias(key), F.count(F.lit(1)).alias("c")).where("c = 1").drop("c")
    moved = alone(gone, "was").join(alone(come, "key"), ["name", "kind", "body"]).select("key", F.lit("moved").alias("state"), "was")
    deleted = gone.join(moved, "was", "left_anti").select(F.col("was").alias("key"), F.lit("deleted").alias("state"), "was")
    introduced = come.join(moved, "key", "left_anti").select("key", F.lit("introduced").alias("state"), F.lit(None).cast(old.schema["key"].dataType).alias("was"))
    return kept.unionByName(moved).unionByName(deleted).unionByName(introduced)


def edge_diff(old: DataFrame, new: DataFrame, moved: DataFrame) -> DataFrame:
    """src, dst, state of call or import edges (src, dst): added or removed, old ends renamed through moved (key, was) first."""
    name = lambda c: moved.select(F.col("was").alias(c), F.col("key").alias(f"_{c}"))
    renamed = old.join(name("src"), "src", "left").join(name("dst"), "dst", "left").select(F.coalesce("_src", "src").alias("src"), F.coalesce("_dst", "dst").alias("dst")).distinct()
    new = new.select("src", "dst").distinct()
    return new.join(renamed, ["src", "dst"], "left_anti").withColumn("state", F.lit("added")).union(renamed.join(new, ["src", "dst"], "left_anti").withColumn("state", F.lit("removed")))


def identified(findings: DataFrame, *parts: str) -> DataFrame:
    """The findings with their stable identity."""
    return findings.withColumn("finding_id", scalars.content_key("finding", *(F.col(p) for p in parts)))


def suppressed(findings: DataFrame, suppressions: DataFrame, today: str) -> DataFrame:
    """The findings with `state`: suppressed by one (finding_id, until) that has not run out, expired, or open."""
    s = suppressions.groupBy("finding_id").agg(F.max("until").alias("until"))
    return findings.join(s, "finding_id", "left").withColumn("state", F.when(F.col("until").isNull(), "open").when(F.col("until") >= F.lit(today).cast("timestamp"), "suppressed").otherwise("expired")).drop("until")


def near_misses(rows: DataFrame, tests: dict[str, Column], limit: int) -> DataFrame:
    """The rows that fail the fewest tests but fail one, with those they fail: why they are not in the answer."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests.items())))
    return rows.withColumn("failed", failed).where("size(failed) > 0").orderBy(F.size("failed"), "id").limit(limit)


def prefix_free(paths: DataFrame) -> DataFrame:
    """path, mirror: the path without layout segments and test affixes, which a file shares with its tests."""
    return paths.select("path", scalars.mirror_key(F.col("path")).alias("mirror"))
