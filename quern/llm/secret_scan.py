"""Secret scans by multipart credential linking, in DataFrame operations alone.

Strong kinds (assign, access, hex) are found by their patterns. Weak parts - identifiers, opaque keys and endpoints -
say little alone; an interval join within a scope of SCOPE code points reports one only where a complementary part
co-occurs: an identifier or an endpoint near a secret, a secret near an identifier or an endpoint. Strong findings count
as parts (access as identifier, assign as secret). Parts complement each other only if they share no character, and what
stands inside an endpoint is no key, so an ordinary URL is not its own complement.

The join is a running maximum, not a table of pairs: within a bin of positions, each weak part looks up the last complement that
ends before it and the next one that starts after it. Parts are sent to the bins within their scope, so a bin's rows are
bounded by its width, however many parts a text has.

A match's place is the length of what stands before it, from one split of the text by the same pattern; only
lengths are shuffled. Rows are told apart by doc_id and a hash of the text, so equal rows share a result.

Defined results: a null or empty text has no spans; a null doc_id is a value like others; repeated rows give a row each;
an empty table gives an empty result; `redacted` keeps the other columns.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import docs_only, free, let

SCOPE, BIN = 400, 4096
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ENDPOINT = r"""https?://[A-Za-z0-9.-]+(?::[0-9]+)?[^\s"'<>]*"""
Holds = Callable[[Column], Column]
always: Holds = lambda worth: F.lit(True)
opaque: Holds = lambda worth: worth.rlike("[0-9]") & worth.rlike("[A-Za-z]")
#: kind: pattern, the group that `holds` looks at, its class as a part.
STRONG: dict[str, tuple[str, int, Holds, str | None]] = {
    "assign": (ASSIGN, 2, lambda worth: F.char_length(worth) >= 12, "secret"),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, always, "identifier"),
    "hex": (r"[0-9a-f]{16,}", 0, always, None),
}
WEAK: dict[str, tuple[str, int, Holds, str | None]] = {
    "weak_id": (r"""(?i:client_?id|user(?:name)?|account|login|tenant)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}|\bA[SG]IA[A-Z0-9]{12,}""", 0, always, "identifier"),
    # An endpoint is taken as a whole, so that no key is found in it.
    "weak_key": (ENDPOINT + r"""|(?<![A-Za-z0-9+/=_-])([A-Za-z0-9+/_-]{24,}={0,2})""", 1, opaque, "secret"),
    "weak_endpoint": (ENDPOINT, 0, always, "endpoint"),
}
KINDS = STRONG | WEAK
NEEDS = {"identifier": ("secret",), "endpoint": ("secret",), "secret": ("identifier", "endpoint")}


def key() -> list[Column]:
    return [F.col("doc_id"), F.xxhash64("text").alias("h")]


def matches(texts: DataFrame) -> DataFrame:
    """doc_id, h, kind, start, end of all matches that hold, in code points."""

    def of(kind: str) -> Column:
        pattern, group, holds, _ = KINDS[kind]
        found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        worth = F.regexp_extract_all("text", F.lit(pattern), F.lit(group)) if group else F.array().cast("array<string>")
        once = F.struct(found.alias("found"), worth.alias("worth"), F.split("text", pattern, -1).alias("gaps"))

        def length(x: Column) -> Callable[[Column, Column], Column]:
            return lambda m, i: F.struct(i.alias("i"), F.char_length(F.get(x["gaps"], i)).alias("gap"), F.char_length(m).alias("n"), holds(F.get(x["worth"], i)).alias("ok"))

        lengths = let(once, lambda x: F.transform(x["found"], length(x)))
        return F.when(F.col("text").rlike(pattern), lengths)

    # Every kind's arrays are made once for a text, then unfolded together.
    arrays = texts.select(*key(), *(of(k).alias(k) for k in KINDS)).where(reduce(Column.__or__, (F.col(k).isNotNull() for k in KINDS))).distinct()
    none = F.array().cast("array<struct<i:int,gap:int,n:int,ok:boolean>>")
    label = lambda k: lambda m: F.struct(F.lit(k).alias("kind"), m.alias("m"))
    labelled = F.concat(*(F.transform(F.coalesce(F.col(k), none), label(k)) for k in KINDS))
    rows = arrays.select("doc_id", "h", F.explode(labelled).alias("x")).select("doc_id", "h", "x.kind", "x.m.*")
    upto = Window.partitionBy("doc_id", "h", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.col("n")).over(upto)
    return rows.withColumn("end", end).where("ok").select("doc_id", "h", "kind", (F.col("end") - F.col("n")).alias("start"), "end")


def linked(found: DataFrame) -> DataFrame:
    """The strong matches and the weak ones with a complementary part in their scope, one row for each span."""
    columns = ["doc_id", "h", "kind", "start", "end"]
    part = F.create_map(*(F.lit(x) for k, (*_, c) in KINDS.items() if c for x in (k, c)))
    parts = found.withColumn("part", part[F.col("kind")])
    here = lambda at: F.floor(at / BIN)
    start, end = F.col("start").cast("long"), F.col("end").cast("long")
    # Backwards (way 0) a part stands at its end and says its start; forwards (way 1) all signs are turned round.
    event = lambda asks, way, at, says: F.struct(F.lit(asks).alias("asks"), F.lit(way).alias("way"), at.alias("at"), says.alias("says"))
    ways = lambda asks, a, z, says: F.array(event(asks, 0, a, says), event(asks, 1, -z, -says))
    offered = parts.where("part is not null").select(*columns, "part", F.explode(F.array_distinct(F.array(here(start - SCOPE), here(start + SCOPE)))).alias("bin"), ways(False, end, start, start).alias("e"))
    asked = parts.where(F.col("kind").isin(*WEAK)).select(*columns, "part", here(start).alias("bin"), ways(True, start, end, start).alias("e"))
    events = offered.union(asked).select(*columns, "part", "bin", F.explode("e").alias("e")).select(*columns, "part", "bin", "e.*")
    upto = Window.partitionBy("doc_id", "h", "bin", "way").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    for c in NEEDS:
        events = events.withColumn(f"last_{c}", F.max(F.when(~F.col("asks") & (F.col("part") == c), F.col("says"))).over(upto))
    within = reduce(Column.__or__, ((F.col("part") == c) & F.coalesce(F.col("says") - F.col(f"last_{other}") <= SCOPE, F.lit(False)) for c, needs in NEEDS.items() for other in needs))
    return parts.where(F.col("kind").isin(*STRONG)).select(*columns).union(events.where(F.col("asks") & within).select(*columns).distinct())


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, h, kind, start, end of all findings, one set for each distinct row."""
    return linked(matches(docs_only(docs, "doc_id", "text")))


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of the strong kinds, base_sha256 and spans: one row for each row of docs."""
    order = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)))
    span = F.struct("start", order[F.col("kind")].alias("k"), "end", "kind")
    base = F.col("kind").isin(*STRONG)

    def joined(c: str) -> Column:
        return F.array_join(F.transform(F.array_sort(c), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    per_text = spans(docs).groupBy("doc_id", "h").agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in STRONG), F.collect_list(F.when(base, span)).alias("base"), F.collect_list(span).alias("all"))
    per_text = per_text.select("doc_id", "h", *(f"n_{k}" for k in STRONG), F.sha2(joined("base"), 256).alias("base_sha256"), joined("all").alias("spans"))
    rows = docs_only(docs, "doc_id", "text").select(*key()).alias("d")
    out = rows.join(per_text.alias("t"), F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("d.h") == F.col("t.h")), "left")
    return out.select("d.doc_id", *(F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in STRONG), F.coalesce("base_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every finding, overlapping ones as one, replaced by the mark; other columns stay."""
    by = Window.partitionBy("doc_id", "h").orderBy("start", "end")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans(docs).withColumn("new", F.when(F.col("start") >= before, 1).when(before.isNull(), 1).otherwise(0))
    runs = opened.withColumn("run", F.sum("new").over(by)).groupBy("doc_id", "h", "run").agg(F.min("start").alias("a"), F.max("end").alias("b"))
    name, whose, text_hash = (free(n, docs) for n in ("_cuts", "_whose", "_hash"))
    cuts = runs.groupBy(F.col("doc_id").alias(whose), F.col("h").alias(text_hash)).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias(name))
    text = F.coalesce("text", F.lit(""))
    both = docs.join(cuts, F.col("doc_id").eqNullSafe(F.col(whose)) & (F.xxhash64(text) == F.col(text_hash)), "left")

    def piece(i: Column) -> Column:
        start = F.coalesce(F.get(name, i - 1)["b"], F.lit(0))
        stop = F.coalesce(F.get(name, i)["a"], F.char_length("text").cast("long"))
        return F.substring("text", (start + 1).cast("int"), (stop - start).cast("int"))

    clean = F.array_join(F.transform(F.sequence(F.lit(0), F.size(name)), piece), mark)
    return both.withColumn("text", F.when(F.col(name).isNull(), F.col("text")).otherwise(clean)).select(*docs.columns)
