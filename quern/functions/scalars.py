"""Scalar functions as column expressions; rewrites of patterns that are made at plan time."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """`**` crosses folders, `*` and `?` stay in one; backslashes are slashes."""
    out, i, glob = "", 0, glob.replace("\\", "/")
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i])), i + 1
    return f"^{out}$"


def alternation(pattern: str, most: int = 16) -> list[str] | None:
    """The literals of `^(a|b)$`, which are tested with IN; None for any other pattern."""
    m = re.fullmatch(r"\^\(?:?([^()]*)\)\$|\^([^()|]*)\$", pattern)
    parts = (m[1] if m and m[1] is not None else m[2] if m else "").lstrip("?:").split("|")
    return parts if m and len(parts) <= most and all(re.fullmatch(r"[\w #-]+", p) for p in parts) else None


def matches(column: Column, pattern: str) -> Column:
    literals = alternation(pattern)
    return column.isin(*literals) if literals else column.rlike(pattern)


def anchors(pattern: str, least: int = 4) -> list[str]:
    """Literals that every match of the pattern contains, if it is a plain sequence; for a contains() before the regex."""
    if re.search(r"[|()\[\]{}?\\]", pattern):
        return []
    return [p for p in re.split(r"\.[*+]?|[$^]|.\*|\+", pattern) if len(p) >= least]


BRANCHES = ("if", "while", "for", "switch", "case", "catch")


def cyclomatic(text: Column, longest: int = 1 << 20) -> Column:
    """1 + branch keywords + `&&`, `||`, `?`; 1 where the source is too long. Words end where no ASCII letter, digit or _ follows,
    whatever the dialect of regular expressions takes for a boundary."""
    words = F.filter(F.split(text, "[^A-Za-z0-9_]+"), lambda w: w.isin(*BRANCHES))
    n = 1 + F.size(words) + F.regexp_count(text, F.lit(r"&&|\|\||\?"))
    return F.when(F.length(text) > longest, 1).otherwise(n).cast("long")


def stem(path: Column) -> Column:
    """File name without extension and test affixes; the folder's name for index files."""
    base = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    base = F.regexp_replace(F.regexp_replace(base, r"(?i)(^test_)|([._-]?(tests?|spec)$)", ""), r"(?<=[a-z])Tests?$", "")
    return F.lower(base)


def camel_parts(name: Column) -> Column:
    return F.filter(F.split(F.lower(F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])|_+|-+", " ")), " "), lambda p: p != "")


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores, or one other symbol."""
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+|[^\s\p{L}\p{N}_])"), F.lit(1))


def normalized(token: Column) -> Column:
    """STR, NUM, BOOL, OP or ID, so that clones with other names are equal."""
    return F.when(token.rlike(r"""^["'`]"""), "STR").when(token.rlike(r"^[0-9]"), "NUM").when(token.isin("true", "false", "True", "False"), "BOOL").when(token.rlike(r"^[\p{L}_]"), "ID").otherwise("OP")


def word_shingles(text: Column, k: int) -> Column:
    """The distinct runs of k blank-separated words, joined by one space."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    runs = lambda ws: F.transform(F.sequence(F.lit(1), F.size(ws) - (k - 1)), lambda i: F.array_join(F.slice(ws, i, F.lit(k)), " "))
    return let(words, lambda ws: F.when(F.size(ws) >= k, F.array_distinct(runs(ws))).otherwise(F.array().cast("array<string>")))


def shingle_hashes(text: Column, k: int) -> Column:
    """The distinct runs of k blank-separated words as 64-bit hashes."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    runs = lambda ws: F.transform(F.sequence(F.lit(1), F.size(ws) - (k - 1)), lambda i: F.xxhash64(F.slice(ws, i, F.lit(k))))
    return let(words, lambda ws: F.when(F.size(ws) >= k, F.array_distinct(runs(ws))).otherwise(F.array().cast("array<bigint>")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once for a row, not once for each element of a lambda that names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def content_key(domain: str, *parts: Column) -> Column:
    """A stable identity: SHA-256 of the domain and the parts, NUL between them."""
    return F.sha2(F.concat_ws("\0", F.lit(domain), *(p.cast("string") for p in parts)), 256)


def cell(text: Column) -> Column:
    """Text for a Markdown table."""
    return F.regexp_replace(F.regexp_replace(text, r"\s*\n\s*", " "), r"\|", "\\\\|")


#: Folders that say how a project is laid out, not what a file is about.
LAYOUT = ("src", "lib", "main", "test", "tests", "java", "python")


def mirror_key(path: Column) -> Column:
    """The folders that are not layout and the file's stem: equal for a file and its tests."""
    folders = F.filter(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), lambda p: ~p.isin(*LAYOUT))
    return F.array_join(F.concat(folders, F.array(stem(path))), "/")


def embedding_text(path: Column, name: Column, signature: Column, body: Column) -> Column:
    """The document that is embedded for a symbol: where it is, what it is, then its body."""
    return F.concat_ws("\n", F.concat(F.lit("path: "), path), F.concat(F.lit("symbol: "), name), F.concat(F.lit("signature: "), signature), body)
