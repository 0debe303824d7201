"""Navigation over declarations and references: definitions by place, sources, owners, renaming, text look-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import glob_regex
from . import graph, joins


def definitions_at(places: DataFrame, refs: DataFrame, declarations: DataFrame) -> DataFrame:
    """place_id, and the declaration (its id, path, name) that the narrowest reference around the place (place_id, path, at) names."""
    at = places.select("place_id", F.col("path").alias("_p"), "at", F.col("at").alias("to"))
    r = refs.select("path", "start_byte", "end_byte", "target_id")
    hit = joins.narrowest(at, r, [("_p", "path")], "place_id", "at", "to", "start_byte", "end_byte")
    d = declarations.select(F.col("id").alias("declaration_id"), F.col("path").alias("declared_in"), "name")
    return hit.join(d, hit["target_id"] == d["declaration_id"]).select("place_id", "declaration_id", "declared_in", "name")


def symbol_sources(declarations: DataFrame, texts: DataFrame) -> DataFrame:
    """id, source: the text of each declaration's span; texts: path, text."""
    body = F.decode(F.substring(F.encode("text", "UTF-8"), (F.col("start_byte") + 1).cast("int"), (F.col("end_byte") - F.col("start_byte")).cast("int")), "UTF-8")
    return declarations.select("id", "path", "start_byte", "end_byte").join(texts.select("path", "text"), "path").select("id", body.alias("source"))


def ancestors(declarations: DataFrame, of: DataFrame) -> DataFrame:
    """id, ancestor, distance of all owners of the declarations `of`."""
    up = declarations.where("parent_id is not null").select(F.col("id").alias("src"), F.col("parent_id").alias("dst"))
    return graph.closure(of.select("id"), up).select(F.col("root").alias("id"), F.col("id").alias("ancestor"), F.col("depth").alias("distance"))


def rename(declarations: DataFrame, refs: DataFrame, renames: DataFrame) -> DataFrame:
    """path, start_byte, end_byte, text: the edits that give declarations (declaration_id) their new_name, references included; none
    for a declaration whose new name a sibling has already."""
    d = declarations.join(renames, declarations["id"] == renames["declaration_id"])
    taken = declarations.select(F.col("parent_id").alias("_up"), F.col("name").alias("_name"), F.col("id").alias("_id"))
    free = d.join(taken, d["parent_id"].eqNullSafe(F.col("_up")) & (F.col("_name") == F.col("new_name")) & (F.col("_id") != d["id"]), "left_anti")
    own = free.select("path", "start_byte", (F.col("start_byte") + F.octet_length("name")).alias("end_byte"), F.col("new_name").alias("text"))
    uses = refs.join(free.select(F.col("id").alias("_d"), "new_name"), refs["target_id"] == F.col("_d")).select("path", "start_byte", "end_byte", F.col("new_name").alias("text"))
    return own.union(uses).distinct()


def file_contents(texts: DataFrame, globs: list[str]) -> DataFrame:
    """path, text of the files that a glob matches."""
    return texts.where(reduce(Column.__or__, (F.col("path").rlike(glob_regex(g)) for g in globs)))


def files_containing(texts: DataFrame, pattern: str) -> DataFrame:
    """path, lines: how many lines of a file a pattern is found in."""
    lines = F.size(F.filter(F.split("text", "\n"), lambda line: line.rlike(pattern)))
    return texts.where(F.col("text").rlike(pattern)).select("path", lines.cast("long").alias("lines")).where("lines > 0")
