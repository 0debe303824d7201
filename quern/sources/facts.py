"""Fact tables from sources: HTML pages and Python files become nodes, roles, declarations, calls, references, imports.

Parsing is the one place where rows go through Python, in Arrow batches, a file at a time; all else is relational.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NODES = "path string, language string, id string, node_id int, kind string, name string, text string, start_byte long, end_byte long, start_line int, end_line int, parent int, subtree_end int"
ROLES = "path string, node_id int, role string, ordinal int, keyword string, target_node int, name string"
#: Rows that a worker holds before it hands them on, and those of one page.
ROWS = 4096
VOID = set("area base br col embed hr img input link meta source track wbr".split())


class Tree(HTMLParser):
    """Elements in document order; unclosed ones end where their parent does."""

    def __init__(self, text: str):
        super().__init__(convert_charrefs=True)
        self.rows, self.open, self.size = [], [], len(text)
        self.lines = [0]
        for line in text.split("\n"):
            self.lines.append(self.lines[-1] + len(line) + 1)
        self.feed(text)
        self.close()
        while self.open:
            self.end(self.size)

    def place(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def end(self, at: int) -> None:
        row = self.rows[self.open.pop()]
        row[3], row[6] = at, len(self.rows)

    def handle_starttag(self, tag, attrs):
        start = self.place()
        self.rows.append([tag, dict(attrs), start, start + len(self.get_starttag_text() or ""), self.getpos()[0], self.open[-1] if self.open else None, 0])
        self.open.append(len(self.rows) - 1)
        if tag in VOID:
            self.end(self.rows[-1][3])

    def handle_endtag(self, tag):
        if any(self.rows[i][0] == tag for i in self.open):
            while self.rows[self.open[-1]][0] != tag:
                self.end(self.place())
            self.end(self.place() + len(tag) + 3)


def page_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The nodes of pages (path, html), some ROWS at a time, so that a batch of pages is not kept as rows all at once."""
    frame = lambda rows: pd.DataFrame(rows, columns=[c.split()[0] for c in NODES.split(", ")]).astype({"parent": "Int32"})
    for pdf in batches:
        out = []
        for path, html in zip(pdf.path, pdf.html):
            for i, (tag, attrs, a, z, line, parent, end) in enumerate(Tree(html or "").rows):
                out.append((path, "html", f"{path}#{i}", i, tag, attrs.get("id") or attrs.get("class"), attrs.get("href") or attrs.get("src"), a, z, line, line + (html or "")[a:z].count("\n"), parent, end))
            if len(out) >= ROWS:
                yield frame(out)
                out = []
        yield frame(out)


def html_nodes(pages: DataFrame) -> DataFrame:
    """path (the url), language html, pre-order node numbers, tag as kind, id attribute as name. A null page has none."""
    return pages.select(F.concat_ws("#", "url", "page_id").alias("path"), "html").mapInPandas(page_rows, NODES)


KIND = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.ClassDef: "class", ast.Lambda: "lambda", ast.Call: "call", ast.Import: "import", ast.ImportFrom: "import", ast.For: "for_loop", ast.While: "while_loop", ast.If: "if", ast.Assign: "assignment", ast.Attribute: "member_access", ast.Name: "identifier", ast.Return: "return"}


def python_rows(path: str, source: str) -> tuple[list, list, list, list, list, list]:
    """Nodes, roles, declarations, calls (callee still a name), references (target a name), imports of one file."""
    lines = [0]
    for line in source.split("\n"):
        lines.append(lines[-1] + len(line.encode()) + 1)
    nodes, roles, decls, calls, refs, imports, number = [], [], [], [], [], [], {}
    module = path.removesuffix(".py").replace("/", ".").removesuffix(".__init__")

    def place(n) -> tuple[int, int]:
        return lines[n.lineno - 1] + n.col_offset, lines[n.end_lineno - 1] + n.end_col_offset

    def kind_of(n, owner) -> str | None:
        if isinstance(n, ast.Constant):
            return "boolean_literal" if isinstance(n.value, bool) else "string_literal" if isinstance(n.value, str) else "null_literal" if n.value is None else "numeric_literal"
        kind = KIND.get(type(n))
        return ("constructor" if n.name == "__init__" else "method") if kind == "function" and owner and owner[1] == "class" else kind

    def name_of(n) -> str | None:
        return getattr(n, "name", None) or getattr(n, "id", None) or getattr(n, "attr", None) or (name_of(n.func) if isinstance(n, ast.Call) else None)

    def walk(n, parent, owner) -> None:
        kind, me = kind_of(n, owner), parent
        if kind:
            me = len(nodes)
            number[n] = me
            a, z = place(n)
            nodes.append([path, "python", f"{path}#{me}", me, kind, name_of(n), ast.get_source_segment(source, n), a, z, n.lineno, n.end_lineno, parent, 0])
            if kind in ("function", "method", "constructor", "class"):
                fq = f"{owner[0] if owner else module}.{n.name}"
                decls.append([fq, path, "python", kind, fq, n.name, a, z, n.lineno, n.end_lineno, owner[0] if owner else None, [b.id for b in getattr(n, "bases", []) if isinstance(b, ast.Name)], [p.arg for p in n.args.args] if hasattr(n, "args") else None])
                owner = (fq, kind)
            if kind == "import":
                for alias in n.names:
                    imports.append([path, (n.module if isinstance(n, ast.ImportFrom) else alias.name) or "", alias.name])
            if kind == "call":
                args = [{"position": i, "name": None, "text": ast.get_source_segment(source, x)} for i, x in enumerate(n.args)] + [{"position": len(n.args) + i, "name": k.arg, "text": ast.get_source_segment(source, k.value)} for i, k in enumerate(n.keywords)]
                calls.append([f"{path}#{me}", path, owner[0] if owner else None, name_of(n.func), ast.get_source_segment(source, n.func.value) if isinstance(n.func, ast.Attribute) else None, a, z, json.dumps(args)])
            if kind == "identifier" and isinstance(n.ctx, ast.Load):
                refs.append([f"{path}#{me}", path, n.id, owner[0] if owner else None, a, z])
        for child in ast.iter_child_nodes(n):
            walk(child, me, owner)
        if kind:
            nodes[me][-1] = len(nodes)
            if isinstance(n, ast.Call):
                edges = [("callee", 0, None, n.func)] + [("args", i, None, x) for i, x in enumerate(n.args)] + [("kwargs", i, k.arg, k.value) for i, k in enumerate(n.keywords)]
                edges += [("receiver", 0, None, n.func.value)] if isinstance(n.func, ast.Attribute) else []
                for role, i, word, target in edges:
                    roles.append([path, me, role, i, word, number.get(target), name_of(target)])
            for i, d in enumerate(getattr(n, "decorator_list", [])):
                roles.append([path, me, "decorators", i, None, number.get(d), name_of(d)])

    walk(ast.parse(source), None, None)
    return nodes, roles, decls, calls, refs, imports


def python_facts(spark: SparkSession, files: dict[str, str]) -> dict[str, DataFrame]:
    """Facts of an inline project; names are resolved to the one declaration in the project that has them."""
    rows: list[list] = [[] for _ in range(6)]
    for path, source in sorted(files.items()):
        for got, more in zip(rows, python_rows(path, source)):
            got += more
    nodes, roles, decls, calls, refs, imports = rows
    facts = {"nodes": spark.createDataFrame(nodes, NODES), "roles": spark.createDataFrame(roles, ROLES), "files": spark.createDataFrame([(p, p, "python") for p in sorted(files)], "id string, path string, language string")}
    facts["declarations"] = d = spark.createDataFrame([r[:11] for r in decls], "id string, path string, language string, kind string, fq_name string, short_name string, start_byte long, end_byte long, start_line int, end_line int, parent_id string").withColumn("name", F.col("short_name"))
    known = d.groupBy("short_name").agg(F.min("id").alias("target"), F.count(F.lit(1)).alias("n")).where("n = 1").select(F.col("short_name").alias("_s"), "target")
    facts["supertypes"] = spark.createDataFrame([(r[0], i, b) for r in decls for i, b in enumerate(r[11])], "declaration_id string, ordinal int, base string").join(known, F.col("base") == F.col("_s")).select("declaration_id", "ordinal", F.col("target").alias("supertype_id"))
    facts["parameters"] = spark.createDataFrame([(r[0], i, p) for r in decls for i, p in enumerate(x for x in r[12] or [] if x != "self")], "callee_id string, index int, label string")
    facts["signatures"] = spark.createDataFrame([(r[0] + "()", r[1], r[0], len(r[12]), len(r[12]), [(i, p) for i, p in enumerate(r[12])]) for r in decls if r[12] is not None], "id string, path string, declaration_id string, min_arity int, max_arity int, parameters array<struct<index:int,label:string>>")
    raw = spark.createDataFrame(calls, "id string, path string, caller_id string, name string, receiver string, start_byte long, end_byte long, args string").join(known, F.col("name") == F.col("_s"), "left")
    formals = facts["parameters"].groupBy(F.col("callee_id").alias("_c")).agg(F.array_sort(F.collect_list(F.struct("index", "label"))).alias("_f"))
    parsed = raw.withColumn("_a", F.from_json("args", "array<struct<position:int,name:string,text:string>>")).join(formals, F.col("target") == F.col("_c"), "left")
    formal = lambda a: F.get(F.filter("_f", lambda f: F.coalesce(a["name"] == f["label"], a["position"] == f["index"])), F.lit(0))
    arguments = F.transform("_a", lambda a: F.struct(a["position"].alias("position"), a["name"].alias("name"), a["text"].alias("text"), formal(a)["index"].alias("formal_index"), formal(a)["label"].alias("formal_name")))
    facts["calls"] = parsed.select("id", "path", "caller_id", F.col("target").alias("callee_id"), "receiver", "start_byte", "end_byte", F.when(F.col("target").isNull(), "unproven").otherwise("proven").alias("proof"), arguments.alias("arguments"))
    facts["refs"] = spark.createDataFrame(refs, "id string, path string, name string, enclosing_id string, start_byte long, end_byte long").join(known, F.col("name") == F.col("_s")).select("id", "path", "name", F.col("target").alias("target_id"), "enclosing_id", "start_byte", "end_byte", F.lit("proven").alias("proof"), F.lit("read").alias("usage_kind"), F.lit("value").alias("reference_kind"))
    modules = spark.createDataFrame([(p, p.removesuffix(".py").replace("/", ".")) for p in sorted(files)], "to_path string, module string")
    facts["imports"] = spark.createDataFrame(imports, "from_path string, module string, name string").join(modules, "module").select("from_path", "to_path").distinct()
    return facts


def load_queries(spark: SparkSession, path: str) -> DataFrame:
    """name and text of saved query files, .json or s-expressions."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^.]+$", 1).alias("name"), F.col("value").alias("query"))


def load_models(spark: SparkSession, path: str) -> DataFrame:
    """Effect and summary models from JSON lines: package, type, name, signature, input, output, kind, provenance."""
    return spark.read.schema("package string, type string, subtypes boolean, name string, signature string, ext string, input string, output string, kind string, provenance string").json(path)


def to_json_rows(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """path, start_line, value: a SARIF result for each finding (rule, message, path, start_line, end_line)."""
    region = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule").alias("ruleId"), F.struct(F.col("message").alias("text")).alias("message"), F.array(region).alias("locations"))
    return findings.select("path", "start_line", F.to_json(result).alias("value"))


def write_sarif(findings: DataFrame, tool: str, at: str) -> None:
    """One SARIF document in the folder `at`, a line for each result in order; the writer streams the lines, no cell holds them all."""
    spark = findings.sparkSession
    lines = sarif_results(findings).select(F.lit(1).alias("part"), "path", "start_line", "value")
    head = json.dumps({"version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool}}, "results": []}]}).removesuffix("]}]}")
    ends = spark.createDataFrame([(0, "", 0, head), (2, "", 0, "]}]}")], "part int, path string, start_line int, value string")
    every = lines.union(ends)
    before = F.lag("part").over(Window.orderBy("part", "path", "start_line", "value"))
    every.select(F.when((F.col("part") == 1) & (before == 1), F.concat(F.lit(","), "value")).otherwise(F.col("value")).alias("value")).write.text(at)


def read_facts(spark: SparkSession, at: str) -> dict[str, DataFrame]:
    """The fact tables of a folder: each subfolder is a Parquet table, bucketed or partitioned as it was written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return {f.getPath().getName(): spark.read.parquet(f.getPath().toString()) for f in found if f.isDirectory()}


def write_facts(facts: dict[str, DataFrame], at: str) -> None:
    """Writes fact tables sorted by path within their files, so that a path's rows are found by the files' statistics."""
    for name, rows in facts.items():
        (rows.sortWithinPartitions("path") if "path" in rows.columns else rows).write.parquet(f"{at}/{name}")
