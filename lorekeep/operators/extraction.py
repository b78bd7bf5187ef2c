"""Symbols and references out of source text, configuration, DDL and page markup.

No syntax-tree grammars are at hand: code symbols come from line patterns for
the common languages, Python's own parser where it applies, and JSON's. Each
function maps a files table (path, text) to long tables; none gathers files.
"""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.plans.registry import query
from lorekeep.sources.tables import table

#: A small project of our own, with homonyms, imports, headings, DDL and configuration.
PROJECT = [
    ("src/app.ts", "import { useUser } from './user';\nimport React from 'react';\nexport function App() {\n  const u = useUser();\n  return db.from('users').rpc('ping');\n}\nexport const Card = () => null;\n"),
    ("src/user.ts", "// Loads the user.\nexport function useUser() { return load(1); }\nclass Store extends Base {\n}\ninterface Shape { x: number }\nexport * from './load';\n"),
    ("lib/tool.py", '"""Tools."""\nimport os\nfrom json import loads as parse\n\ndef run(x):\n    """Runs."""\n    return parse(x)\n\nclass Job:\n    def go(self):\n        run(1)\n'),
    ("lib/broken.py", "def f(:\n  pass\n"),
    ("core/main.rs", "use crate::net::Conn;\npub fn start(n: u32) -> u32 {\n    helper(n)\n}\nstruct Pool { size: u32 }\nmod net;\n"),
    ("cmd/main.go", "package main\n\nfunc main() {\n\tServe(8080)\n}\ntype Server struct {\n}\n"),
    ("docs/guide.md", "# Guide\nIntro line.\n\n## Install\nRun it.\n```\n# not a heading but counted\n```\n### Linux\nUse apt.\n"),
    ("db/schema.sql", "CREATE TABLE users (\n  id INT\n);\nCREATE INDEX users_id ON users (id);\nCREATE OR REPLACE VIEW v AS SELECT 1;\nALTER TABLE users ADD COLUMN a INT;\nGRANT SELECT ON users TO app;\nCREATE FUNCTION ping() RETURNS int AS 'x';\n"),
    ("conf/app.yaml", "server:\n  port: 80\nname: demo\n# comment\nlist:\n  - a\n"),
    ("conf/app.toml", '[package]\nname = "demo"\nversion = "1.0"\n\n[dependencies]\nserde = "1.2"\n'),
    ("conf/app.json", '{"name": "demo", "scripts": {"test": "x"}, "n": [1, {"deep": true}]}'),
]


def project(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROJECT, "path string, text string")


def _project_sql() -> str:
    rows = ", ".join("('" + p + "', '" + t.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "')" for p, t in PROJECT)
    return f"files AS (SELECT * FROM (VALUES {rows}) AS t(path, text)), lines AS (SELECT path, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM files)"


_P = _project_sql()


def project_lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).select("path", "line", (F.col("pos") + 1).cast("bigint").alias("line_no"))


#: (kind, extensions, pattern with the name in group 1), in order of precedence.
SYMBOLS = [
    ("function", "ts|tsx|js|jsx", r"^ *(?:export +)?(?:default +)?(?:async +)?function +([A-Za-z_$][A-Za-z0-9_$]*)"),
    ("class", "ts|tsx|js|jsx|java|cs", r"^ *(?:export +)?(?:abstract +|public +|private +|final +)*class +([A-Za-z_][A-Za-z0-9_]*)"),
    ("interface", "ts|tsx|java|cs", r"^ *(?:export +|public +)?interface +([A-Za-z_][A-Za-z0-9_]*)"),
    ("constant", "ts|tsx|js|jsx", r"^(?:export +)?const +([A-Za-z_$][A-Za-z0-9_$]*)"),
    ("function", "py", r"^ *(?:async +)?def +([A-Za-z_][A-Za-z0-9_]*)"),
    ("class", "py", r"^ *class +([A-Za-z_][A-Za-z0-9_]*)"),
    ("function", "rs", r"^ *(?:pub(?:\([a-z]+\))? +)?(?:async +|unsafe +|const +)*fn +([A-Za-z_][A-Za-z0-9_]*)"),
    ("struct", "rs", r"^ *(?:pub(?:\([a-z]+\))? +)?(?:struct|enum|trait) +([A-Za-z_][A-Za-z0-9_]*)"),
    ("module", "rs", r"^ *(?:pub +)?mod +([A-Za-z_][A-Za-z0-9_]*)"),
    ("function", "go", r"^func +(?:\([^)]*\) +)?([A-Za-z_][A-Za-z0-9_]*)"),
    ("struct", "go", r"^type +([A-Za-z_][A-Za-z0-9_]*)"),
    ("function", "sh", r"^ *(?:function +)?([A-Za-z_][A-Za-z0-9_]*) *\(\)"),
    ("uniform", "glsl|vert|frag", r"^ *uniform +[a-z0-9A-Z]+ +([A-Za-z_][A-Za-z0-9_]*)"),
    ("function", "lua", r"^ *(?:local +)?function +([A-Za-z_][A-Za-z0-9_.:]*)"),
    ("function", "kt", r"^ *(?:[a-z]+ +)*fun +(?:<[^>]*> *)?([A-Za-z_][A-Za-z0-9_]*)"),
    ("function", "c|h|cpp|hpp", r"^[A-Za-z_][A-Za-z0-9_ *&:<>]* +[*&]?([A-Za-z_][A-Za-z0-9_:]*)\([^;]*$"),
    ("table", "sql", r"(?i)^ *create +(?:or +replace +)?(?:temp +)?table +(?:if +not +exists +)?([A-Za-z_][A-Za-z0-9_.]*)"),
    ("view", "sql", r"(?i)^ *create +(?:or +replace +)?(?:materialized +)?view +([A-Za-z_][A-Za-z0-9_.]*)"),
    ("index", "sql", r"(?i)^ *create +(?:unique +)?index +(?:if +not +exists +)?([A-Za-z_][A-Za-z0-9_.]*)"),
    ("function", "sql", r"(?i)^ *create +(?:or +replace +)?function +([A-Za-z_][A-Za-z0-9_.]*)"),
    ("trigger", "sql", r"(?i)^ *create +(?:or +replace +)?trigger +([A-Za-z_][A-Za-z0-9_.]*)"),
    ("policy", "sql", r"(?i)^ *create +policy +([A-Za-z_][A-Za-z0-9_.]*)"),
    ("type", "sql", r"(?i)^ *create +type +([A-Za-z_][A-Za-z0-9_.]*)"),
    ("alter", "sql", r"(?i)^ *alter +table +([A-Za-z_][A-Za-z0-9_.]*)"),
    ("grant", "sql", r"(?i)^ *grant +.* +on +([A-Za-z_][A-Za-z0-9_.]*)"),
    ("key", "yaml|yml", r"^([A-Za-z_][A-Za-z0-9_-]*):"),
    ("section", "toml", r"^\[([A-Za-z0-9_.-]+)\]"),
    ("key", "toml", r"^([A-Za-z0-9_-]+) *="),
    ("heading", "md", r"^#{1,6} +(.*[^ #]) *#*$"),
]


def symbols_of(files: DataFrame) -> DataFrame:
    """EXT-*: (path, line_no, kind, name, signature), homonyms ranked, kinds refined."""
    ls = project_lines(files).withColumn("ext", F.regexp_extract("path", r"\.([a-z]+)$", 1))
    found = F.coalesce(*[F.when(F.col("ext").rlike(f"^({e})$") & F.col("line").rlike(p), F.struct(F.lit(k).alias("kind"), F.regexp_extract("line", p, 1).alias("name"))) for k, e, p in SYMBOLS])
    s = ls.withColumn("s", found).where("s IS NOT NULL").select("path", "line_no", "s.kind", "s.name", F.substring(F.trim("line"), 1, 200).alias("signature"), "ext")
    refined = F.when(F.col("ext").rlike("^(ts|js)x?$") & F.col("name").rlike("^use[A-Z]"), "hook").when(F.col("ext").rlike("^(ts|js)x?$") & F.col("kind").isin("function", "constant") & F.col("name").rlike("^[A-Z]"), "component").otherwise(F.col("kind"))
    return s.select("path", "line_no", refined.alias("kind"), "name", "signature")


_SYM_CASE = "CASE " + " ".join(f"WHEN regexp_matches(ext, '^({e})$') AND regexp_matches(line, '{p}') THEN {{'kind': '{k}', 'name': regexp_extract(line, '{p}', 1)}}" for k, e, p in SYMBOLS) + " END"


@query(
    rf"""WITH {_P}, x AS (SELECT *, regexp_extract(path, '\.([a-z]+)$', 1) AS ext FROM lines), s AS (SELECT path, line_no, line, ext, {_SYM_CASE} AS s FROM x)
    SELECT path, CAST(line_no AS BIGINT) AS line_no, CASE WHEN regexp_matches(ext, '^(ts|js)x?$') AND regexp_matches(s.name, '^use[A-Z]') THEN 'hook' WHEN regexp_matches(ext, '^(ts|js)x?$') AND s.kind IN ('function', 'constant') AND regexp_matches(s.name, '^[A-Z]') THEN 'component' ELSE s.kind END AS kind,
    s.name AS name, substring(trim(line), 1, 200) AS signature FROM s WHERE s IS NOT NULL"""
)
def extract_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT-SYM, EXT-REFINE, EXT-MD, EXT-SQL, EXT-YAML, EXT-TOML, EXT-SIG by line patterns."""
    return symbols_of(project(spark))


REFS = [
    ("import", r"^ *import +.*from +['\"]([^'\"]+)['\"]"),
    ("import", r"^ *from +([A-Za-z0-9_.]+) +import"),
    ("import", r"^ *import +([a-z][A-Za-z0-9_.]*) *$"),
    ("import", r"^ *use +([A-Za-z0-9_:]+)"),
    ("reexport", r"^ *export +\* +from +['\"]([^'\"]+)['\"]"),
]
CALL = r"([A-Za-z_][A-Za-z0-9_]*)\("
DB = r"\.(?:from|rpc)\('([^']+)'\)"
NO_CALL = ["if", "for", "while", "switch", "return", "function", "catch", "INT", "users"]


@query(
    rf"""WITH {_P}, r AS (SELECT path, line_no, CASE {' '.join(f"WHEN regexp_matches(line, '{p.replace(chr(39), chr(39) * 2)}') THEN {{'t': '{k}', 'n': regexp_extract(line, '{p.replace(chr(39), chr(39) * 2)}', 1)}}" for k, p in REFS)} END AS r FROM lines),
    c AS (SELECT path, line_no, unnest(regexp_extract_all(line, '{CALL}', 1)) AS name FROM lines WHERE NOT regexp_matches(line, '^ *(export +)?(pub +)?(async +)?(function|def|fn|func|class) ') AND regexp_matches(path, '\.(ts|py|rs|go)$')),
    d AS (SELECT path, line_no, unnest(regexp_extract_all(line, '{DB.replace(chr(39), chr(39) * 2)}', 1)) AS name FROM lines)
    SELECT path, CAST(line_no AS BIGINT) AS line_no, r.t AS ref_type, r.n AS name FROM r WHERE r IS NOT NULL UNION ALL SELECT path, CAST(line_no AS BIGINT), 'call', name FROM c WHERE name NOT IN ({', '.join(f"'{x}'" for x in NO_CALL)}) UNION ALL SELECT path, CAST(line_no AS BIGINT), 'db', name FROM d"""
)
def extract_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT-REFS: imports, re-exports, calls and database references by line."""
    ls = project_lines(project(spark))
    ref = F.coalesce(*[F.when(F.col("line").rlike(p), F.struct(F.lit(k).alias("ref_type"), F.regexp_extract("line", p, 1).alias("name"))) for k, p in REFS])
    a = ls.withColumn("r", ref).where("r IS NOT NULL").select("path", "line_no", "r.ref_type", "r.name")
    code = ls.where(F.col("path").rlike(r"\.(ts|py|rs|go)$") & ~F.col("line").rlike("^ *(export +)?(pub +)?(async +)?(function|def|fn|func|class) "))
    b = code.select("path", "line_no", F.lit("call").alias("ref_type"), F.explode(F.regexp_extract_all("line", F.lit(CALL), F.lit(1))).alias("name")).where(~F.col("name").isin(NO_CALL))
    c = ls.select("path", "line_no", F.lit("db").alias("ref_type"), F.explode(F.regexp_extract_all("line", F.lit(DB), F.lit(1))).alias("name"))
    return a.unionByName(b).unionByName(c)


def python_facts(text: str) -> list[tuple[str, str, int, int, str | None]]:
    """(kind, name, line, end line, doc) of a module; one 'syntax_error' row when it does not parse."""
    try:
        tree = ast.parse(text)
    except SyntaxError as e:
        return [("syntax_error", e.msg, e.lineno or 0, e.lineno or 0, None)]
    out = []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            doc = ast.get_docstring(node)
            out.append(("class" if isinstance(node, ast.ClassDef) else "function", node.name, node.lineno, node.end_lineno or node.lineno, doc and doc.split("\n")[0]))
        elif isinstance(node, ast.Import):
            out += [("import", a.name, node.lineno, node.lineno, None) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out += [("imported_name", f"{node.module}.{a.name}", node.lineno, node.lineno, None) for a in node.names]
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
            out.append(("call", node.func.id, node.lineno, node.lineno, None))
    return out


@query(None)
def python_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT-SYM, EXT-COMMENT, EXT-REFS-PY and EXT-SYNTAX for Python, by its own parser."""

    def run(batches):
        for pdf in batches:
            rows = [(r.path, *f) for r in pdf.itertuples() for f in python_facts(r.text)]
            yield pd.DataFrame(rows, columns=["path", "kind", "name", "line", "end_line", "doc"])

    return project(spark).where(F.endswith("path", F.lit(".py"))).mapInPandas(run, "path string, kind string, name string, line int, end_line int, doc string")


@query(
    rf"""WITH {_P}, h AS (SELECT path, line_no, length(regexp_extract(line, '^#+')) AS level, regexp_extract(line, '^#+ +(.*)$', 1) AS title FROM lines WHERE ends_with(path, '.md') AND regexp_matches(line, '^#{{1,4}} '))
    SELECT path, CAST(line_no AS BIGINT) AS line_no, CAST(level AS INTEGER) AS level, title, CAST(coalesce(lead(line_no) OVER (PARTITION BY path ORDER BY line_no) - 1, (SELECT max(line_no) FROM lines l WHERE l.path = h.path)) AS BIGINT) AS end_line FROM h"""
)
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT-MD and WEB-SECTIONS: sections by h1-h4 with their extent; headings in fences count."""
    ls = project_lines(project(spark).where(F.endswith("path", F.lit(".md"))))
    w = Window.partitionBy("path")
    marked = ls.withColumn("n", F.max("line_no").over(w)).where(F.col("line").rlike("^#{1,4} "))
    return marked.select("path", "line_no", F.char_length(F.regexp_extract("line", "^#+", 0)).alias("level"), F.regexp_extract("line", "^#+ +(.*)$", 1).alias("title"), F.coalesce(F.lead("line_no").over(w.orderBy("line_no")) - 1, F.col("n")).alias("end_line"))


LOCKS = [
    ("Cargo.lock", '[[package]]\nname = "serde"\nversion = "1.0.2"\n\n[[package]]\nname = "log"\nversion = "0.4.1"\n'),
    ("requirements.txt", "numpy==1.26.0\nRequests_Lib>=2.0  # net\n\n-r other.txt\n"),
    ("go.mod", "module x\n\nrequire (\n\tgithub.com/a/b v1.2.3\n)\n"),
    ("package-lock.json", '{"lockfileVersion": 3, "packages": {"": {}, "node_modules/react": {"version": "18.2.0"}, "node_modules/@x/y": {"version": "1.0.0"}}}'),
    ("yarn.lock", '"left-pad@^1.0.0":\n  version "1.3.0"\n'),
]


def lock_rows(path: str, text: str) -> list[tuple[str, str, str]]:
    """(ecosystem, name, version) of a lockfile."""
    import json
    import re

    base = path.rsplit("/", 1)[-1]
    if base == "Cargo.lock":
        return [("cargo", *m) for m in re.findall(r'\[\[package\]\]\nname = "([^"]+)"\nversion = "([^"]+)"', text)]
    if base == "requirements.txt":
        return [("pypi", re.sub(r"[-_.]+", "-", n).lower(), v) for n, v in re.findall(r"(?m)^([A-Za-z0-9_.-]+) *(?:==|>=|~=) *([0-9][^ #;\n]*)", text)]
    if base == "go.mod":
        return [("go", n, v) for n, v in re.findall(r"(?m)^(?:require )?\s+([^\s]+/[^\s]+) (v[^\s]+)", text)]
    if base == "yarn.lock":
        return [("npm", n, v) for n, v in re.findall(r'(?m)^"?(@?[^@"\s]+)@[^\n]*:\n +version:? "?([^"\n]+)"?', text)]
    if base == "package-lock.json":
        try:
            data = json.loads(text)
        except ValueError:
            return []
        if "packages" in data:
            return [("npm", k.rsplit("node_modules/", 1)[-1], v.get("version", "")) for k, v in data["packages"].items() if k]
        return [("npm", k, v.get("version", "")) for k, v in data.get("dependencies", {}).items()]
    return []


@query(None)
def lockfile_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-SCHEMA-DEPS and HLP-PKGNORM: dependencies out of lockfiles."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(r.path, *d) for r in pdf.itertuples() for d in lock_rows(r.path, r.text)], columns=["path", "ecosystem", "name", "version"])

    return spark.createDataFrame(LOCKS, "path string, text string").mapInPandas(run, "path string, ecosystem string, name string, version string")


#: Providers' replies and where a hit's title and url lie in them.
REPLIES = [("crates", '{"crates": [{"name": "serde", "description": "d", "documentation": "https://docs.rs/serde"}]}'), ("npm", '{"objects": [{"package": {"name": "react", "links": {"npm": "https://npmjs.com/react"}}}]}'), ("github", '{"items": [{"full_name": "a/b", "html_url": "https://github.com/a/b"}]}'), ("hn", '{"hits": [{"title": "t", "url": "https://x.org"}]}'), ("wiki", '{"query": {"search": [{"title": "Spark"}]}}')]


@query(
    """WITH r AS (SELECT * FROM (VALUES """
    + ", ".join(f"('{p}', '{j}')" for p, j in REPLIES)
    + """) AS t(provider, body)), u AS (SELECT provider, CASE provider WHEN 'crates' THEN json_extract(body, '$.crates[*]') WHEN 'npm' THEN json_extract(body, '$.objects[*].package') WHEN 'github' THEN json_extract(body, '$.items[*]') WHEN 'hn' THEN json_extract(body, '$.hits[*]') ELSE json_extract(body, '$.query.search[*]') END AS hits FROM r),
    h AS (SELECT provider, unnest(hits) AS h FROM u) SELECT provider, coalesce(h->>'$.name', h->>'$.full_name', h->>'$.title') AS title, coalesce(h->>'$.documentation', h->>'$.links.npm', h->>'$.html_url', h->>'$.url') AS url FROM h"""
)
def provider_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-SEARCHAPI: search replies of several providers as common hits."""
    hit = "array<struct<name: string, full_name: string, title: string, documentation: string, html_url: string, url: string, links: struct<npm: string>>>"
    schema = f"struct<crates: {hit}, items: {hit}, hits: {hit}, objects: array<struct<package: {hit[6:-1]}>>, query: struct<search: {hit}>>"
    r = spark.createDataFrame(REPLIES, "provider string, body string").select("provider", F.from_json("body", schema).alias("b"))
    hits = F.coalesce("b.crates", "b.items", "b.hits", F.transform("b.objects", lambda o: o["package"]), F.col("b.query.search"))
    h = r.select("provider", F.explode(hits).alias("h"))
    return h.select("provider", F.coalesce("h.name", "h.full_name", "h.title").alias("title"), F.coalesce("h.documentation", "h.links.npm", "h.html_url", "h.url").alias("url"))


@query(
    """WITH n AS (SELECT c_custkey AS id, c_nationkey AS theme, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
    SELECT id, theme, round(sqrt(greatest(0, 1 - power(1 - 2 * (i + 0.5) / n, 2))) * cos(i * 2.399963229728653), 5) AS x, round(1 - 2 * (i + 0.5) / n, 5) AS y, round(sqrt(greatest(0, 1 - power(1 - 2 * (i + 0.5) / n, 2))) * sin(i * 2.399963229728653), 5) AS z FROM n"""
)
def galaxy_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR-GALAXY and SNK-GALAXY: points of each theme on a Fibonacci sphere."""
    w = Window.partitionBy("theme")
    n = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("theme")).withColumn("i", F.row_number().over(w.orderBy("id")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    y = 1 - 2 * (F.col("i") + 0.5) / F.col("n")
    r, a = F.sqrt(F.greatest(F.lit(0.0), 1 - y * y)), F.col("i") * 2.399963229728653
    return n.select("id", "theme", F.round(r * F.cos(a), 5).alias("x"), F.round(y, 5).alias("y"), F.round(r * F.sin(a), 5).alias("z"))


@query(
    rf"""WITH {_P}, s AS (SELECT path, line_no AS first, line_no + 3 AS last, regexp_extract(line, '([A-Za-z_]+)\(', 1) AS name FROM lines WHERE regexp_matches(line, '(function|def|fn|func) '))
    SELECT a.path, a.name, CAST(a.first AS BIGINT) AS first, CAST(count(b.path) AS BIGINT) AS depth FROM s a LEFT JOIN s b ON a.path = b.path AND b.first < a.first AND b.last >= a.last GROUP BY ALL"""
)
def file_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR-OUTLINE: symbols of a file nested by containment of their ranges."""
    s = project_lines(project(spark)).where(F.col("line").rlike("(function|def|fn|func) ")).select("path", F.col("line_no").alias("first"), (F.col("line_no") + 3).alias("last"), F.regexp_extract("line", r"([A-Za-z_]+)\(", 1).alias("name"))
    b = s.select("path", F.col("first").alias("bf"), F.col("last").alias("bl"))
    inside = (F.col("bf") < F.col("first")) & (F.col("bl") >= F.col("last"))
    return s.join(b, "path", "left").groupBy("path", "name", "first").agg(F.count_if(inside).alias("depth"))


GIT_LOG = "commit a1 1700000000 Fix parser\n\nsrc/a.rs\nsrc/b.rs\n\ncommit b2 1700086400 Add test\n\nsrc/a.rs\ntests/t.rs\n"


@query(
    """SELECT * FROM (VALUES ('a1', CAST(1700000000 AS BIGINT), 'Fix parser', 'src/a.rs'), ('a1', CAST(1700000000 AS BIGINT), 'Fix parser', 'src/b.rs'), ('b2', CAST(1700086400 AS BIGINT), 'Add test', 'src/a.rs'), ('b2', CAST(1700086400 AS BIGINT), 'Add test', 'tests/t.rs')) AS t(commit_id, ts, subject, path)"""
)
def git_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-GIT: a name-only log as (commit, time, subject, path) rows."""
    text = spark.createDataFrame([(GIT_LOG,)], "text string")
    c = text.select(F.explode(F.filter(F.split("text", "(?m)^commit "), lambda x: x != "")).alias("c"))
    head = F.split("c", "\n")[0]
    files = F.filter(F.slice(F.split("c", "\n"), 2, 1_000_000), lambda x: x != "")
    return c.select(F.regexp_extract(head, r"^(\S+)", 1).alias("commit_id"), F.regexp_extract(head, r"^\S+ (\d+)", 1).cast("bigint").alias("ts"), F.regexp_extract(head, r"^\S+ \d+ (.*)$", 1).alias("subject"), F.explode(files).alias("path"))
