"""Source trees, code blocks and their symbols."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Folders that a scan passes over.
EXCLUDED = r"/(?:node_modules|dist|build|\.git|\.venv|__pycache__|vendor)/|/\.[^/]+$"
_DEF = r"^([ \t]*)(?:export +)?(?:default +)?(?:async +)?(function|class|interface|type|enum|def|const)[ *]+([A-Za-z_$][A-Za-z0-9_$]*)"
_CALL = r"([A-Za-z_$][A-Za-z0-9_$.]*)\("


def scan_files(spark: SparkSession, root: str, glob: str = "*.{ts,tsx,js,jsx,py,go,rs,java}") -> DataFrame:
    """(path, modified, content) of the source files under `root`: by name, in all folders, without EXCLUDED ones and dot files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.where(~F.col("path").rlike(EXCLUDED)).select("path", F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("content"))


def code_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, block, lang, code): the fenced blocks of each text in order, from 1; a fence without an end gives no block."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"(?s)```([a-z]+)\n(.*?)```"), F.lit(0))
    blocks = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(found).alias("i", "b"))
    return blocks.select(key, (F.col("i") + 1).alias("block"), F.regexp_extract("b", r"^```([a-z]+)", 1).alias("lang"), F.regexp_extract("b", r"(?s)^```[a-z]+\n(.*)```$", 1).alias("code"))


def numbered_lines(df: DataFrame, text: str = "code") -> DataFrame:
    """One row a line, numbered from 1."""
    other = [c for c in df.columns if c != text]
    return df.select(*other, F.posexplode(F.split(F.col(text), "\n")).alias("_i", "content")).select(*other, (F.col("_i") + 1).alias("line"), "content")


def line_symbols(lines: DataFrame) -> DataFrame:
    """Definitions by pattern, one a line: kind, name and indent; for any of the languages that use these words."""
    d = lines.where(F.col("content").rlike(_DEF))
    return d.select(*(c for c in lines.columns if c != "content"), F.regexp_extract("content", _DEF, 2).alias("kind"), F.regexp_extract("content", _DEF, 3).alias("name"), F.length(F.regexp_extract("content", _DEF, 1)).alias("indent"))


# Definitions by language, each with the kind of symbol that it makes; the first group is the name.
_MODS = r"(?:public\s+|private\s+|protected\s+|static\s+|final\s+|synchronized\s+|abstract\s+)"
_CS = r"(?:public\s+|private\s+|internal\s+|protected\s+|static\s+|virtual\s+|override\s+|abstract\s+|async\s+|sealed\s+)"
PATTERNS = {
    "ts": [
        ("function", r"^\s*(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)"), ("function", r"^\s*(?:export\s+)?const\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\("), ("class", r"^\s*(?:export\s+(?:default\s+)?)?class\s+([A-Za-z_$][\w$]*)"),
        ("type", r"^\s*(?:export\s+)?(?:type|interface)\s+([A-Za-z_$][\w$]*)"), ("method", r"^\s*(?:public\s+|private\s+|protected\s+|static\s+)*(?:async\s+)?([A-Za-z_$][\w$]*)\s*\([^)]*\)\s*[:{]"),
    ],
    "py": [("function", r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)"), ("class", r"^\s*class\s+([A-Za-z_]\w*)")],
    "go": [("function", r"^\s*func\s+(?:\([^)]*\)\s+)?([A-Za-z_]\w*)\s*\("), ("type", r"^\s*type\s+([A-Za-z_]\w*)\s+(?:struct|interface|=)")],
    "rs": [("function", r"^(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+([A-Za-z_]\w*)"), ("type", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait|type)\s+([A-Za-z_]\w*)"), ("method", r"^\s+(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+([A-Za-z_]\w*)")],
    "java": [
        ("class", r"^\s*(?:public\s+|private\s+|protected\s+|abstract\s+|final\s+|static\s+)*class\s+([A-Za-z_]\w*)"), ("type", r"^\s*(?:public\s+|private\s+|protected\s+)*(?:interface|enum|@interface)\s+([A-Za-z_]\w*)"),
        ("method", r"^\s+" + _MODS + r"+(?:[A-Za-z_<>,\s\[\]?]+\s+)?([A-Za-z_]\w*)\s*\([^)]*\)\s*(?:throws[^{]+)?\{"),
    ],
    "rb": [("function", r"^\s*def\s+(?:self\.)?([A-Za-z_][\w!?=]*)"), ("class", r"^\s*class\s+([A-Z]\w*)"), ("module", r"^\s*module\s+([A-Z]\w*)")],
    "cs": [
        ("class", r"^\s*(?:public\s+|private\s+|internal\s+|protected\s+|abstract\s+|sealed\s+|static\s+|partial\s+)*class\s+([A-Za-z_]\w*)"), ("type", r"^\s*(?:public\s+|private\s+|internal\s+|protected\s+)*(?:interface|struct|enum|record)\s+([A-Za-z_]\w*)"),
        ("method", r"^\s+" + _CS + r"+(?:[A-Za-z_<>,\s\[\]?]+\s+)?([A-Za-z_]\w*)\s*\([^)]*\)\s*(?:where[^{]+)?\{"),
    ],
}
PATTERNS |= {"tsx": PATTERNS["ts"], "js": PATTERNS["ts"], "jsx": PATTERNS["ts"]}
# Words that are no names of symbols.
NO_NAMES = (
    "if for while switch case return throw catch typeof new await yield import export function class def do else try finally with in is not and or print len str int float list dict set tuple range "
    "True False None console require Error Promise Array Object Map Set JSON Math Date Number Boolean String Symbol RegExp"
).split()


def pattern_symbols(lines: DataFrame, unit: list[str]) -> DataFrame:
    """Definitions by the patterns of each line's `lang`: kind, name, container and qualified name, with the other columns of `lines` (lang, line, content).

    The container of a method is the nearest class above it in its `unit` (the columns of a file or block) that is indented less. Lines of other
    languages, and names that are key words, give nothing; a line may define more than one thing.
    """
    other = [c for c in lines.columns if c != "content"]
    made = []
    for lang, patterns in PATTERNS.items():
        for kind, rx in patterns:
            name = F.regexp_extract("content", rx, 1)
            fits = (F.col("lang") == lang) & (name != "") & ~name.isin(NO_NAMES)
            if kind == "method":
                fits = fits & ~F.col("content").rlike(r"^\s*(?:export\s+)?(?:async\s+)?function(?:\s|$)") & ~F.col("content").rlike(r"^\s*(?:export\s+)?const\s")
            made.append(F.when(fits, F.struct(F.lit(kind).alias("kind"), name.alias("name"))))
    indent = F.length(F.regexp_extract("content", r"^(\s*)", 1))
    s = lines.select(*other, indent.alias("indent"), F.explode(F.array_distinct(F.array_compact(F.array(*made)))).alias("d")).select(*other, "indent", "d.kind", "d.name")
    above = F.collect_list(F.when(F.col("kind") == "class", F.struct("line", "indent", "name"))).over(Window.partitionBy(*unit).orderBy("line").rangeBetween(Window.unboundedPreceding, -1))
    held = F.try_element_at(F.filter(above, lambda c: c["indent"] < F.col("indent")), F.lit(-1))["name"]
    s = s.withColumn("container", F.when(F.col("kind") == "method", held))
    return s.select(*other, "kind", "name", "container", F.concat_ws(".", "container", "name").alias("qualified_name"))


def line_calls(lines: DataFrame) -> DataFrame:
    """Calls by pattern, without definitions."""
    calls = F.regexp_extract_all("content", F.lit(_CALL), F.lit(1))
    return lines.where(~F.col("content").rlike(_DEF)).select(*(c for c in lines.columns if c != "content"), F.explode(calls).alias("callee"))


def python_symbols(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, block, name, qualified_name, kind, line, end_line, calls) of the Python `code` of each row, by the syntax tree.

    Code that does not parse gives no rows. Calls of self.x() are named by their class.
    """
    schema = pa.schema([(key, pa.int64()), ("block", pa.int32()), ("name", pa.string()), ("qualified_name", pa.string()), ("kind", pa.string()), ("line", pa.int32()), ("end_line", pa.int32()), ("calls", pa.list_(pa.string()))])

    def walk(node: ast.AST, inside: list[str], out: list) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if inside else "function"
                calls = []
                for c in ast.walk(child) if kind != "class" else ():
                    if isinstance(c, ast.Call):
                        f = c.func
                        if isinstance(f, ast.Name):
                            calls.append(f.id)
                        elif isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name):
                            owner = inside[-1] if f.value.id in ("self", "cls") and inside else f.value.id
                            calls.append(f"{owner}.{f.attr}")
                out.append((child.name, ".".join([*inside, child.name]), kind, child.lineno, child.end_lineno, sorted(set(calls))))
                walk(child, [*inside, child.name] if kind == "class" else inside, out)
            else:
                walk(child, inside, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, b, code in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found: list = []
                try:
                    walk(ast.parse(code), [], found)
                except (SyntaxError, ValueError):
                    continue
                rows += [(k, b, *f) for f in found]
            columns = list(zip(*rows)) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=schema.field(i).type) for i, c in enumerate(columns)], schema=schema)

    return blocks.select(key, "block", "code").mapInArrow(run, f"{key} bigint, block int, name string, qualified_name string, kind string, line int, end_line int, calls array<string>")


def todo_items(lines: DataFrame) -> DataFrame:
    """TODO, FIXME and XXX marks: symbol in brackets, if any, and the text."""
    rx = r"(?:^|[^A-Za-z0-9_])(TODO|FIXME|XXX)(?:\(([^)]*)\))?:? +(.+)$"
    return lines.where(F.col("content").rlike(rx)).select(*(c for c in lines.columns if c != "content"), F.regexp_extract("content", rx, 1).alias("mark"), F.nullif(F.regexp_extract("content", rx, 2), F.lit("")).alias("symbol"), F.trim(F.regexp_extract("content", rx, 3)).alias("text"))


def symbol_id(file: Column, qualified: Column, body: Column) -> Column:
    """file#qualified@hash: the identity of a symbol, which stays when its code moves."""
    return F.concat(file, F.lit("#"), qualified, F.lit("@"), F.substring(F.sha1(body), 1, 10))
