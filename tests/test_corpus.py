from pyspark.sql import functions as F

from codeloom.operators import build, corpus

MD = "intro\n# Title\na\n## Section A\nb\n### Sub\nc\n#### deeper\nd"
TS = '''import { log } from "./telemetry";
export interface Order { id: string }
export class OrderService {
  constructor(private repo: Repo) {
  }
  async process(order: Order): Promise<void> {
    logEvent("paid");
    this.repo.save(order);
  }
}
export function logEvent(name: string) {
  console.log(name);
}
'''
PY = '''from telemetry import log_event
class OrderService:
    def process(self, order):
        log_event("paid")
        self._save(order)
    def _save(self, order):
        pass
def main():
    OrderService().process(1)
'''
GO = '''package orders
import "fmt"
type OrderService struct {
}
func (s *OrderService) Process(id int) {
	logEvent(id)
}
func logEvent(id int) {
	fmt.Println(id)
}
'''


def test_sections(spark):
    docs = spark.createDataFrame([("a.md", MD), ("empty.md", ""), ("blank.md", " \n "), ("none.md", None)], "file_path string, text string")
    rows = corpus.section_chunks(docs).orderBy("start_line").collect()
    assert [(r.title, r.start_line, r.end_line) for r in rows] == [(None, 1, 1), ("Title", 2, 3), ("Section A", 4, 5), ("Sub", 6, 9)]
    assert rows[-1].text.endswith("#### deeper\nd")


def test_paths_and_lines(spark):
    r = spark.createDataFrame([("src/a/b.ts", "../c/./d", "x\ny\nz")], "f string, t string, s string").select(
        corpus.resolve_import(F.col("f"), F.col("t")), corpus.slice_lines(F.col("s"), F.lit(2), F.lit(9)), corpus.slice_lines(F.col("s"), F.lit(0), F.lit(1)), corpus.is_test_path(F.lit("a/x.test.ts")), corpus.is_test_path(F.lit("src/latest.ts")), corpus.is_example_path(F.lit("Examples/x.ts")), corpus.is_example_path(F.lit("fixtures/x.ts")), corpus.is_example_path(F.lit("a/sandbox/x.ts"))
    ).first()
    assert tuple(r) == ("src/c/d", "y\nz", "x", True, False, True, False, True)
    tests = {"src/test.ts": True, "a/b.SPEC.TSX": True, "Tests/a.go": True, "a/x_test.go": False, "spec/a.rb": False, "e2e/a.ts": False, "a/__tests__/b": True}
    rows = spark.createDataFrame([(p,) for p in tests], "p string").select("p", corpus.is_test_path(F.col("p")).alias("t")).collect()
    assert {x.p: x.t for x in rows} == tests


def test_code_chunks(spark):
    text = "\n".join(f"l{i}" for i in range(1, 401))
    files = spark.createDataFrame([("big", text), ("small", "a\nb"), ("bare", text)], "file_path string, text string")
    rows = [("big", "class", "big::A", "big", 1, 300), ("big", "function", "big::A::m", "big::A", 2, 20), ("big", "function", "big::f", None, 310, 320), ("big", "function", "big::t", None, 330, 331), ("small", "function", "small::g", None, 1, 2)]
    ents = spark.createDataFrame(rows, "file_path string, type string, qualified_name string, parent string, start_line int, end_line int")
    got = sorted((r.file_path, r.start_line, r.end_line, r.qualified_name or "") for r in corpus.chunk_code(files, ents).collect())
    assert got == [("bare", 1, 400, ""), ("big", 2, 20, "big::A::m"), ("big", 310, 320, "big::f"), ("small", 1, 2, "")]


def test_symbols(spark):
    files = spark.createDataFrame([("src/orders.ts", "typescript", TS), ("orders.py", "python", PY), ("orders.go", "go", GO)], "file_path string, language string, text string")
    symbols = corpus.extract_symbols(files)
    got = {(r.file_path, r.name): r for r in symbols.collect()}
    assert got["src/orders.ts", "OrderService"].type == "class" and got["src/orders.ts", "process"].parent == "src/orders.ts::OrderService"
    assert got["src/orders.ts", "logEvent"].visibility == "public" and got["src/orders.ts", "logEvent"].start_line == 11
    assert got["orders.py", "_save"].visibility == "private" and got["orders.py", "_save"].qualified_name == "orders.py::OrderService::_save" and got["orders.py", "_save"].end_line == 7
    assert got["orders.go", "Process"].visibility == "public" and got["orders.go", "logEvent"].visibility == "private"
    calls = {tuple(r) for r in corpus.extract_calls(files, symbols).collect()}
    assert {("src/orders.ts::OrderService::process", "logEvent"), ("orders.py::OrderService::process", "log_event"), ("orders.go::Process", "logEvent")} <= calls
    assert {tuple(r) for r in corpus.extract_imports(files).collect()} == {("src/orders.ts", "src/telemetry"), ("orders.py", "telemetry"), ("orders.go", "fmt")}


def test_tested_by(spark):
    imports = spark.createDataFrame([("t.test.ts", "src/orders"), ("t.test.ts", "lodash")], "test_file string, target string")
    ents = spark.createDataFrame([("a", "class", "src/orders/index.ts", "src/orders/index.ts::A"), ("b", "function", "src/orders/index.ts", "src/orders/index.ts::A::b"), ("c", "class", "src/orders.mts", "src/orders.mts::C"), ("t", "test", "src/orders.ts", "src/orders.ts::T")], "id string, type string, file_path string, qualified_name string")
    found = build.tested_by_edges(imports, ents)
    assert [tuple(r) for r in found.collect()] == [("a", "t.test.ts", "tested_by")]


def test_resolution_order(spark):
    paths = ["a/b", "a/b.go", "a/b/index.ts", "c.cjs", "c.vue", "d/index.py", "e.ts", "x::y.ts"]
    ents = spark.createDataFrame([(p, p, None, i) for i, p in enumerate([*paths, "from"])], "id string, qualified_name string, name string, seq long")
    edges = spark.createDataFrame([(i, "from", t, None, "imports") for i, t in enumerate(["a/b", "c", "d", "e", "f", "x::y"])], "seq long, from_qualified string, to_qualified string, to_name string, type string")
    assert {r.seq: (r.dst, r.how) for r in build.resolve_edges(edges, ents).collect()} == {0: ("a/b", "exact"), 1: ("c.cjs", "path"), 2: ("d/index.py", "path"), 3: ("e.ts", "path")}


def test_annotations(spark):
    rows = spark.createDataFrame([("OrderService", [("Order processing ", "q")], [("Service Layer", "high", "p")])], "entity_id string, concepts array<struct<name:string,evidence_quote:string>>, patterns array<struct<name:string,confidence:string,evidence_quote:string>>")
    assert {r.id for r in corpus.semantic_nodes(rows).collect()} == {"concept::order processing", "pattern::service layer"}
    assert {(r.dst, r.type, r.confidence) for r in corpus.semantic_edges(rows).collect()} == {("concept::order processing", "implements_concept", None), ("pattern::service layer", "follows_pattern", "high")}


def test_doc_tags(spark):
    comment = "/**\n * Pays an order.\n * @param {string} id - the order\n * @returns nothing\n * @deprecated\n * @since 2\n */"
    d = spark.createDataFrame([(comment,)], "c string").select(corpus.doc_tags(F.col("c")).alias("d"))
    r = d.first().d
    assert (r.description, r.params[0].name, r.params[0].text, r.returns, r.deprecated, [tuple(t) for t in r.tags]) == ("Pays an order.", "id", "the order", "nothing", "", [("since", "2")])
    assert d.select(corpus.author_docs(F.col("d"))).first()[0] == "Pays an order.\nParameters:\n  - id: the order\nReturns: nothing\nDeprecated"
    none = spark.createDataFrame([("/** */",), ("/**\n * @internal\n */",), (None,)], "c string").select(corpus.author_docs(corpus.doc_tags(F.col("c"))))
    assert [r[0] for r in none.collect()] == [None] * 3


def plain_scopes(rows, last):
    out = []
    for i, (line, indent) in enumerate(rows):
        up = next((rows[j][0] for j in range(i - 1, -1, -1) if rows[j][1] < indent), None)
        end = next((rows[j][0] - 1 for j in range(i + 1, len(rows)) if rows[j][1] <= indent), last)
        out.append((line, up and f"n{up}", end))
    return sorted(out)


def test_scopes_in_one_pass(spark):
    import random
    import time

    rnd = random.Random(1)
    struct = lambda rows: [(a, b, f"n{a}", "function", "python", "x") for a, b in rows]
    files = {k: [(3 * i + 1, 4 * rnd.randrange(5)) for i in range(n)] for k, n in (("a", 1), ("b", 700), ("c", corpus.SCOPE_BLOCK), ("d", 30))}
    df = spark.createDataFrame([(k, struct(rows), 9999) for k, rows in files.items()], "f string, all array<struct<line_no:int,indent:int,name:string,kind:string,language:string,line:string>>, last int")
    got = df.select("f", F.inline(corpus.nested_scopes(F.col("all"), F.col("last")))).collect()
    for k, rows in files.items():
        assert sorted((r.d.line_no, r.d.up, r.end_line) for r in got if r.f == k) == plain_scopes(rows, 9999)
    text = "\n".join(f"{'    ' * (i % 4)}def f{i}():" for i in range(50_000))
    big = spark.createDataFrame([("big.py", "python", text)], "file_path string, language string, text string")
    start = time.time()
    assert corpus.extract_symbols(big).filter("end_line >= start_line").count() == 50_000 and time.time() - start < 60


def test_evidence_of_odd_metadata(spark):
    from codeloom.operators import retrieval

    rows = [("1", "commit", "x", None), ("2", "commit", "x", "no json"), ("3", "thing", "x", "[1]"), ("4", "thing", "x", '{"a": null, "b": "", "c": {"d": 1.5}}'), ("5", "thing", "x", "{" + ",".join(f'"k{i}": {i}' for i in range(13)) + "}"),
            ("6", "person", "x", '{"commitCount": "9"}'), ("7", "file", "x", '{"hotness": 0}'), ("8", "commit", "x", '{"email": "a@b.c", "message": "m"}')]
    got = {r.id: r.block.split("\n")[1:] for r in retrieval.render_entities(spark.createDataFrame(rows, "id string, type string, name string, metadata string")).collect()}
    assert got == {"1": [], "2": [], "3": [], "4": ["- metadata:", '    - c: {"d":1.5}'], "5": [], "6": [], "7": ["- hotness: 0 modification(s) in last 90 days"], "8": ["- message:", "    m"]}


def test_evidence_reads_metadata_once(spark):
    from codeloom.operators import retrieval

    rows = spark.createDataFrame([("1", '{"sha": "1", "author": "a", "email": "e", "message": "m\\nn", "filesChanged": ["f", null, "g"], "diff": "+x", "diffTruncated": true}')], "id string, metadata string")
    found = retrieval.render_entities(rows.withColumn("type", F.lit("commit")).withColumn("name", F.lit("x")), files=2)
    assert found.first().block == "### [entity:1] x (commit)\n- sha: 1\n- author: a <e>\n- message:\n    m\n    n\n- files changed (3):\n    - f\n    - … and 1 more\n- diff (truncated):\n  ```diff\n  +x\n  ```"
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("parseJson"), plan.count("try_variant_get")) == (1, 1)
    docs = '{"docs": {"description": "d", "params": [{"name": "p", "description": "q"}, {"name": "r"}], "deprecated": %s}}'
    odd = [("1", "class", docs % "true"), ("2", "type", docs % '"false"'), ("3", "function", docs % '"since 2"'), ("4", "class", '{"docs": null, "a": 1}'), ("5", "class", '{"a": 1}'), ("6", None, '{"a": 1}'), ("7", "person", '{"email": "", "commitCount": 2.5}')]
    got = {r.id: r.block.split("\n")[1:] for r in retrieval.render_entities(spark.createDataFrame(odd, "id string, type string, metadata string").withColumn("name", F.lit("x"))).collect()}
    said = ["- jsdoc: d", "- jsdoc params:", "    - p: q"]
    assert got == {"1": [*said, "- deprecated"], "2": said, "3": [*said, "- deprecated: since 2"], "4": [], "5": ["- metadata:", "    - a: 1"], "6": ["    - a: 1"], "7": ["- commits: 2.5"]}


def test_budget(spark):
    rows = spark.createDataFrame([("a", i, 4) for i in range(5)] + [("b", 0, 4)], "g string, i int, c int")
    got = corpus.within_budget(rows, F.col("c"), 9, ["i"], ["g"]).collect()
    assert sorted((r.g, r.i, r.exhausted) for r in got) == [("a", 0, True), ("a", 1, True), ("a", 2, True), ("b", 0, False)]


def test_history(spark):
    commits = spark.createDataFrame([("1", "Tester", "t@example.com", "feat: add a", ["src/a.ts"]), ("2", "Tester", "t@example.com", "feat: b", ["src/a.ts", "src/b.ts"]), ("3", "tester", "T@example.com", "chore: a", ["src/a.ts", "gone"])], "sha string, author_name string, author_email string, message string, files_changed array<string>")
    files = spark.createDataFrame([("src/a.ts", "A"), ("src/b.ts", "B")], "path string, id string")
    assert [tuple(r) for r in build.author_counts(commits).collect()] == [("tester::t@example.com", 3)]
    assert build.history_edges(commits, files).count() == 3 + 4
    assert build.history_nodes(commits).count() == 4


def test_chunks_never_broadcast_texts(spark, tmp_path):
    spark.createDataFrame([("a", "x\ny")], "file_path string, text string").write.parquet(str(tmp_path / "files"))
    spark.createDataFrame([("a", "class", "A", None, 1, 300)], "file_path string, type string, qualified_name string, parent string, start_line int, end_line int").write.parquet(str(tmp_path / "spans"))
    found = corpus.chunk_code(spark.read.parquet(str(tmp_path / "files")), spark.read.parquet(str(tmp_path / "spans")))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r.start_line, r.end_line, r.text) for r in found.collect()] == [(1, 2, "x\ny")]
