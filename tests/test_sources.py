import json

from pyspark.sql import functions as F

from knotwork.sources import code, diffs, records

DIFF = """diff --git a/src/a.ts b/src/a.ts
--- a/src/a.ts
+++ b/src/a.ts
@@ -1,2 +1,3 @@
 one
+two
+three
-old
@@ -10,0 +12 @@
+ten
diff --git a/gone.ts b/gone.ts
deleted file mode 100644
--- a/gone.ts
+++ /dev/null
@@ -1,2 +0,0 @@
-x
-y
diff --git a/pic.png b/pic.png
new file mode 100644
Binary files /dev/null and b/pic.png differ"""


def test_diff(spark, rows):
    df = spark.createDataFrame([("d", DIFF), ("n", None), ("e", "")], "key string, diff string")
    assert rows(diffs.diff_hunks(df, "key")) == [("d", "src/a.ts", 1, 3), ("d", "src/a.ts", 12, 12)]
    new = [(r.tag, r.new_line, r.content) for r in diffs.diff_lines(df, "key").where("key = 'd' AND file = 'src/a.ts'").orderBy("pos").collect()]
    assert new == [("ctx", 1, "one"), ("add", 2, "two"), ("add", 3, "three"), ("del", None, "old"), ("add", 12, "ten")]
    got = rows(diffs.file_changes(df, "key"), "file", "status", "binary", "added", "deleted")
    assert got == [("gone.ts", "deleted", False, 0, 2), ("pic.png", "added", True, 0, 0), ("src/a.ts", "modified", False, 3, 1)]


def test_scan_and_python_symbols(spark, rows, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.py").write_text("class A:\n    def f(self):\n        return self.g() + h()\n\ndef h():\n    pass\n")
    (tmp_path / "node_modules" / "b.py").write_text("def no(): pass\n")
    (tmp_path / "src" / "c.txt").write_text("def no(): pass\n")
    files = code.scan_files(spark, str(tmp_path))
    assert files.count() == 1
    blocks = files.select(F.lit(1).alias("doc_id"), F.lit(1).alias("block"), F.col("content").alias("code"))
    got = rows(code.python_symbols(blocks), "qualified_name", "kind", "line", "end_line", "calls")
    assert got == [("A", "class", 1, 3, []), ("A.f", "method", 2, 3, ["A.g", "h"]), ("h", "function", 5, 6, [])]
    bad = spark.createDataFrame([(1, 1, "def (:")], "doc_id bigint, block int, code string")
    assert rows(code.python_symbols(bad)) == []


def test_blocks_lines_and_todos(spark, rows):
    text = "x\n```ts\nexport async function f(n) {\n  return g(n);\n}\n```\n```py\ndef k():\n```\n```open\n"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id bigint, text string")
    lines = code.numbered_lines(code.code_blocks(docs))
    assert rows(code.line_symbols(lines), "block", "line", "kind", "name") == [(1, 1, "function", "f"), (2, 1, "def", "k")]
    assert rows(code.line_calls(lines), "callee") == [("g",)]
    marks = spark.createDataFrame([(1, "// TODO(foo): mend it "), (2, "x FIXME: now"), (3, "TODOS are fine"), (4, "nothing")], "line int, content string")
    assert rows(code.todo_items(marks)) == [(1, "TODO", "foo", "mend it"), (2, "FIXME", None, "now")]


def test_records(spark, rows, tmp_path):
    log = tmp_path / "log.jsonl"
    log.write_text('{"seq": 1, "m": "a"}\nnot json\n{"seq": 3, "m": "c"}\n{"seq": 2, "m": "b"}\n')
    df = records.json_lines(spark, str(log), "seq bigint, m string")
    assert rows(records.tail(df, 2)) == [(2, "b"), (3, "c")]
    (tmp_path / "e1.json").write_text(json.dumps([{"k": "x"}]))
    (tmp_path / "e2.json").write_text(json.dumps({"events": [{"k": "y"}, {"k": "z"}]}))
    assert rows(records.events_document(spark, str(tmp_path / "e*.json"), "k string")) == [("x",), ("y",), ("z",)]


def test_managed_block_round_trip(spark, rows):
    e = spark.createDataFrame([("r", "0123456789ab", "high", "Keep it.", "2026-01-02T03:04:05Z"), ("r", "00aa00aa00aa", "low", "Drop - it", "2026-02-02T00:00:00Z")], "k string, id string, severity string, lesson string, at string")
    e = e.select("k", "id", "severity", "lesson", F.to_timestamp("at").alias("recorded_at"))
    text = records.managed_block_text(e, "k")
    assert rows(records.managed_block(text, "k")) == rows(e)
    assert rows(records.managed_block(spark.createDataFrame([("q", "no block")], "k string, text string"), "k")) == []


def test_upsert_append_replace(spark, rows, tmp_path):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k int, v string")
    assert rows(records.upsert(old, new, "k")) == [(1, "a"), (2, "d"), (3, "e")]
    p = str(tmp_path / "t")
    records.append(old, p)
    records.append(new, p)
    assert spark.read.parquet(p).count() == 5
    records.replace(old, p, "k")
    assert spark.read.parquet(p).count() == 2


def test_long_diff_lines_are_whole(spark):
    name, line = "d/" * 2500 + "x.ts", "y" * 9000
    df = spark.createDataFrame([("d", f"--- a/{name}\n+++ b/{name}\n@@ -1,0 +1,1 @@\n+{line}")], "key string, diff string")
    assert [(r.file, r.content) for r in diffs.diff_lines(df, "key").collect()] == [(name, line)]


def test_pattern_symbols_and_containers(spark, rows):
    from knotwork.sources.code import numbered_lines, pattern_symbols

    ts = "export class Ledger {\n  async settle(row: Row): void {\n  }\n  if (x) {\n}\nexport const fold = async (a) => a\nfunction trim(a) {}\nexport interface Row {}\nclass Other {\n  get() {\n"
    go, rs, java = "func (l *Ledger) Settle(x int) {\ntype Row struct {\n", "pub fn fold() {}\nimpl X {\n    pub async fn settle() {}\n}\npub(crate) struct Row;\n", "public final class Ledger {\n    public static int fold(int a) throws IOException {\n    enum Kind {\n"
    rb, cs, py = "module Money\n  class Ledger\n    def self.settle!(x)\n", "internal sealed class Ledger\n{\n    public async Task<int> Fold(int a) {\n    record Row\n", "class A:\n    def b(self):\n"
    df = spark.createDataFrame(list(enumerate([("ts", ts), ("go", go), ("rs", rs), ("java", java), ("rb", rb), ("cs", cs), ("py", py), ("txt", ts)])), "doc_id int, x struct<lang: string, code: string>").select("doc_id", "x.*")
    got = rows(pattern_symbols(numbered_lines(df), ["doc_id"]), "doc_id", "line", "kind", "qualified_name")
    assert got == [
        (0, 1, "class", "Ledger"), (0, 2, "method", "Ledger.settle"), (0, 6, "function", "fold"), (0, 7, "function", "trim"), (0, 8, "type", "Row"), (0, 9, "class", "Other"), (0, 10, "method", "Other.get"),
        (1, 1, "function", "Settle"), (1, 2, "type", "Row"), (2, 1, "function", "fold"), (2, 3, "method", "settle"), (2, 5, "type", "Row"), (3, 1, "class", "Ledger"), (3, 2, "method", "Ledger.fold"), (3, 3, "type", "Kind"),
        (4, 1, "module", "Money"), (4, 2, "class", "Ledger"), (4, 3, "function", "settle!"), (5, 1, "class", "Ledger"), (5, 3, "method", "Ledger.Fold"), (5, 4, "type", "Row"), (6, 1, "class", "A"), (6, 2, "function", "b"),
    ]


def test_settings(spark, rows):
    from knotwork.sources.config import DEFAULTS, settings

    df = spark.createDataFrame([(1, "depth: 4 # deep\nstrands: ['tests', a]\nodd: x\nlanguages:\n- go\n- rust\n", "c"), (2, "", "c")], "k int, text string, option string")
    got = {(k, o): v for k, o, v in rows(settings(df, "k", "text"))}
    assert got[1, "depth"] == "4" and got[1, "strands"] == "tests,a" and got[1, "languages"] == "go,rust" and got[1, "capture"] == "auto"
    assert {o: v for (k, o), v in got.items() if k == 2} == DEFAULTS and len(got) == 2 * len(DEFAULTS)
