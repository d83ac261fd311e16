"""Corpus build (C1-C14): chunking, sectioning, heuristic symbols, annotations and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.stem import let
from codeloom.runtime import checkpoint, top
from codeloom.sources.files import language_of

# Fixed names.
EXAMPLE_SEGMENTS = ("examples", "example", "samples", "sample", "demo", "demos", "sandbox", "playground")
TEST_SEGMENTS = ("__tests__", "tests", "test")
TEST_SUFFIX = r"(?i)(?:\.|/)(?:test|spec)\.(?:ts|tsx|js|jsx|mts|cts|mjs|cjs)$"
SMALL_FILE, LEAST_SPAN, LARGE_ENTITY = 150, 4, 200


def _segments(path: Column) -> Column:
    return F.transform(F.split(path, "/"), F.lower)


def is_example_path(path: Column) -> Column:
    """C4."""
    return F.arrays_overlap(_segments(path), F.array(*[F.lit(x) for x in EXAMPLE_SEGMENTS]))


def is_test_path(path: Column) -> Column:
    """C5."""
    return path.rlike(TEST_SUFFIX) | F.arrays_overlap(_segments(path), F.array(*[F.lit(x) for x in TEST_SEGMENTS]))


def slice_lines(text: Column, start: Column, end: Column) -> Column:
    """Lines start..end (from 1), clamped to the text."""
    lines = F.split(text, "\n", -1)
    first = F.greatest(start, F.lit(1))
    n = F.greatest(F.least(end, F.size(lines)) - first + 1, F.lit(0))
    return F.array_join(F.slice(lines, first.cast("int"), n.cast("int")), "\n")


def chunk_code(files: DataFrame, entities: DataFrame) -> DataFrame:
    """(file_path, start_line, end_line, qualified_name, text, entity_type, language, source_type) of each file.

    files: file_path, text. entities: file_path, type, qualified_name, parent, start_line, end_line
    (parent: qualified name of the enclosing entity; none, or the file itself, at the top). Small files and files without entities stay
    whole; otherwise one chunk for each top-level entity of LEAST_SPAN lines, a large one giving
    way to its children; a file that ends up without chunks stays whole.
    """
    spans = entities.filter(F.col("type") != "file").withColumn("span", F.col("end_line") - F.col("start_line") + 1)
    at_top = F.col("parent").isNull() | (F.col("parent") == F.col("file_path"))
    children = spans.filter(~at_top).select("file_path", F.col("parent").alias("p"), F.struct("start_line", "end_line", "qualified_name", "type").alias("child"))
    tops = spans.filter(at_top & (F.col("span") >= LEAST_SPAN))
    # Spark guesses long texts and computed spans to be small; a merge join never holds them in the driver.
    kids = tops.filter(F.col("span") > LARGE_ENTITY).join(children.withColumnRenamed("p", "qualified_name").hint("merge"), ["file_path", "qualified_name"])
    by_child = kids.select("file_path", "child.start_line", "child.end_line", "child.qualified_name", "child.type")
    replaced = kids.select("file_path", "qualified_name").distinct()
    by_top = tops.join(replaced.hint("merge"), ["file_path", "qualified_name"], "left_anti").select("file_path", "start_line", "end_line", "qualified_name", "type")
    picked = by_top.unionByName(by_child).groupBy("file_path").agg(F.collect_list(F.struct("start_line", "end_line", "qualified_name", "type")).alias("spans"))
    joined = files.join(picked.hint("merge"), "file_path", "left")

    def cut(lines: Column) -> Column:
        n, text = F.size(lines), lambda a, b: F.array_join(F.slice(lines, a, F.greatest(b - a + 1, F.lit(0))), "\n")
        chunk = lambda a, b, name, text, kind: F.struct(a.alias("start_line"), b.alias("end_line"), name.alias("qualified_name"), text.alias("text"), kind.alias("entity_type"))
        first, last = lambda x: F.greatest(x["start_line"], F.lit(1)).cast("int"), lambda x: F.least(x["end_line"], n).cast("int")
        none = F.lit(None).cast("string")
        own = F.transform("spans", lambda x: chunk(first(x), last(x), x["qualified_name"], text(first(x), last(x)), x["type"]))
        return F.when((n > SMALL_FILE) & F.col("spans").isNotNull(), own).otherwise(F.array(chunk(F.lit(1), n, none, F.col("text"), none)))

    kind = F.when(is_example_path(F.col("file_path")), "example").otherwise("code")
    chunks = joined.select("file_path", F.inline(let(F.split("text", "\n", -1), cut)))
    return chunks.withColumn("language", language_of(F.col("file_path"))).withColumn("source_type", kind)


def section_chunks(docs: DataFrame, key: str = "file_path", heading: str = r"^#{1,3}\s+\S") -> DataFrame:
    """(key, section, title, start_line, end_line, text): headings of levels 1 to 3 start a section.

    Text before the first heading is section 0; empty texts give none. Sections are cut within
    each text by array functions, so lines are never shuffled.
    """
    lines = docs.filter(F.col("text").rlike(r"\S")).select(key, F.split("text", "\n", -1).alias("lines"))
    n = F.size("lines")
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | F.element_at("lines", i).rlike(heading))
    cut = lines.select(key, "lines", F.posexplode(starts).alias("section", "start_line"), starts.alias("starts"))
    end = F.coalesce(F.try_element_at("starts", F.col("section") + 2) - 1, n)
    first = F.element_at("lines", F.col("start_line"))
    title = F.when(first.rlike(heading), F.trim(F.regexp_replace(first, r"^#+\s*", "")))
    body = F.array_join(F.slice("lines", F.col("start_line"), end - F.col("start_line") + 1), "\n")
    rows = cut.select(key, F.col("section").cast("int").alias("section"), title.alias("title"), "start_line", end.alias("end_line"), body.alias("text"))
    return rows.filter(F.col("text").rlike(r"\S"))


def resolve_import(from_path: Column, target: Column) -> Column:
    """A relative import against the importing file; `.` and `..` are folded."""
    base = F.filter(F.split(F.regexp_replace(from_path, r"[^/]*$", ""), "/"), lambda x: x != "")
    folded = F.aggregate(
        F.split(target, "/"), base,
        lambda acc, x: F.when(x.isin(".", ""), acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
    )
    return F.when(target.startswith("."), F.array_join(folded, "/")).otherwise(target)


#: (language, kind, pattern with the name in group 1). Heuristics by line, not a parser.
DECLARATIONS = (
    ("typescript", "class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"),
    ("typescript", "type", r"^\s*(?:export\s+)?(?:interface|type|enum)\s+(\w+)"),
    ("typescript", "function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"),
    ("typescript", "function", r"^\s*(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>"),
    ("typescript", "method", r"^\s+(?:public\s+|private\s+|protected\s+|static\s+|async\s+)*(?!if|for|while|switch|return|catch|function\b)(\w+)\s*\([^;]*\)\s*(?::[^{;]+)?\{\s*$"),
    ("python", "class", r"^\s*class\s+(\w+)"),
    ("python", "function", r"^\s*(?:async\s+)?def\s+(\w+)"),
    ("go", "type", r"^type\s+(\w+)\s+(?:struct|interface)"),
    ("go", "function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*\("),
)
IMPORTS = (
    ("typescript", r"""(?:import|export)\b[^'"]*?from\s*['"]([^'"]+)['"]"""), ("typescript", r"""^\s*import\s+['"]([^'"]+)['"]"""),
    ("python", r"^\s*from\s+([\w.]+)\s+import"), ("python", r"^\s*import\s+([\w.]+)"), ("go", r"""^\s*(?:import\s+)?(?:\w+\s+)?"([\w./\-]+)"\s*$"""),
)
CALL = r"\b([A-Za-z_]\w*)\s*\("
LINE_BLOCK = 64
CALL_WORDS = ("if", "for", "while", "switch", "return", "catch", "function", "def", "func", "class", "print", "range", "len", "super", "elif", "with", "and", "or", "not", "in")


def _by_language(rules, line: Column, language: Column) -> Column:
    """array<struct(kind, name)> of the rules that a line meets."""
    hits = [F.when((language == lang) & line.rlike(p), F.struct(F.lit(kind).alias("kind"), F.regexp_extract(line, p, 1).alias("name"))) for lang, kind, p in rules]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def source_lines(files: DataFrame) -> DataFrame:
    """(file_path, language, line_no, line); typescript stands for javascript too."""
    language = F.when(F.col("language") == "javascript", "typescript").otherwise(F.col("language"))
    return files.select("file_path", language.alias("language"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).select("file_path", "language", (F.col("pos") + 1).alias("line_no"), "line")


def visibility(language: Column, name: Column, line: Column) -> Column:
    """Export keyword, leading underscore, or capital letter, by language."""
    public = F.when(language == "typescript", line.rlike(r"^\s*export\b")).when(language == "python", ~name.startswith("_")).otherwise(name.rlike(r"^\p{Lu}"))
    return F.when(public, "public").otherwise("private")


SCOPE_BLOCK = 256
_OPEN = "struct<line_no:int,indent:int,name:string,kind:string,language:string,line:string,up:string>"
_CLOSED = "struct<d:" + _OPEN + ",end_line:int>"


def nested_scopes(declarations: Column, last_line: Column) -> Column:
    """Declarations (line_no, indent, name, kind, language, line), in order, as (d, end_line), where d.up names what they lie in.

    One pass with the stack of open scopes: a declaration closes the open ones of its indent or more, and what is
    left on top is its parent. Closed ones are gathered block by block, so that no long array is copied for each of them.
    """
    def closed(some: Column, end: Column) -> Column:
        return F.transform(some, lambda s: F.struct(s.alias("d"), end.cast("int").alias("end_line")))

    def step(acc: Column, x: Column) -> Column:
        left = F.filter(acc["open"], lambda s: s["indent"] < x["indent"])
        gone = F.filter(acc["open"], lambda s: s["indent"] >= x["indent"])

        def pushed(rest: Column) -> Column:
            own = F.struct(*[x[c].alias(c) for c in ("line_no", "indent", "name", "kind", "language", "line")], F.try_element_at(rest, F.lit(-1))["name"].alias("up"))
            return F.struct(F.concat(rest, F.array(own)).alias("open"), F.concat(acc["done"], closed(gone, x["line_no"] - 1)).alias("done"))

        return let(left, pushed)

    def block(acc: Column, b: Column) -> Column:
        start = F.struct(acc["open"].alias("open"), F.array().cast(f"array<{_CLOSED}>").alias("done"))
        folded = F.aggregate(F.slice(declarations, b * SCOPE_BLOCK + 1, SCOPE_BLOCK), start, step)
        return let(folded, lambda f: F.struct(f["open"].alias("open"), F.concat(acc["done"], F.array(f["done"])).alias("done")))

    start = F.struct(F.array().cast(f"array<{_OPEN}>").alias("open"), F.array().cast(f"array<array<{_CLOSED}>>").alias("done"))
    blocks = F.sequence(F.lit(0), F.floor((F.greatest(F.size(declarations), F.lit(1)) - 1) / SCOPE_BLOCK).cast("int"))
    return F.aggregate(blocks, start, block, lambda acc: F.flatten(F.concat(acc["done"], F.array(closed(acc["open"], last_line)))))


def extract_symbols(files: DataFrame) -> DataFrame:
    """(file_path, language, type, name, parent, qualified_name, start_line, end_line, visibility, signature).

    A declaration ends before the next one of its indent or less. In Python and TypeScript the nearest earlier
    declaration of smaller indent that still runs is the parent.
    """
    lines = source_lines(files)
    found = lines.withColumn("hit", F.try_element_at(_by_language(DECLARATIONS, F.col("line"), F.col("language")), F.lit(1))).withColumn("indent", F.length("line") - F.length(F.ltrim("line")))
    decl = found.filter("hit is not null").select("file_path", "language", "line_no", "line", "indent", "hit.kind", "hit.name")
    last = files.groupBy("file_path").agg(F.max(F.size(F.split("text", "\n", -1))).alias("last_line"))
    by_file = decl.groupBy("file_path").agg(F.sort_array(F.collect_list(F.struct("line_no", "indent", "name", "kind", "language", "line"))).alias("all"))
    rows = by_file.join(last, "file_path").select("file_path", F.inline(nested_scopes(F.col("all"), F.col("last_line")))).select("file_path", "d.*", "end_line")
    kind = F.when((F.col("kind") == "method") | ((F.col("language") == "python") & F.col("up").isNotNull()), "function").otherwise(F.col("kind"))
    parent = F.when(F.col("up").isNotNull(), F.concat_ws("::", "file_path", "up"))
    return rows.select(
        "file_path", "language", kind.alias("type"), "name", parent.alias("parent"), F.concat_ws("::", F.coalesce(parent, F.col("file_path")), "name").alias("qualified_name"),
        F.col("line_no").alias("start_line"), "end_line", visibility(F.col("language"), F.col("name"), F.col("line")).alias("visibility"), F.trim("line").alias("signature"),
    )


def extract_imports(files: DataFrame) -> DataFrame:
    """Distinct (file_path, target), relative targets resolved."""
    rules = [(lang, "import", p) for lang, p in IMPORTS]
    hits = source_lines(files).select("file_path", F.explode(_by_language(rules, F.col("line"), F.col("language"))).alias("h"))
    return hits.select("file_path", resolve_import(F.col("file_path"), F.col("h.name")).alias("target")).distinct()


def extract_calls(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct (src qualified_name, to_name) of the calls within each function's lines (its innermost owner)."""
    lines = source_lines(files).filter(~F.col("line").rlike(r"^\s*(?:def|func|class|export\s+(?:async\s+)?function|function)\b"))
    calls = lines.select("file_path", "line_no", F.explode(F.regexp_extract_all("line", F.lit(CALL), F.lit(1))).alias("to_name")).filter(~F.col("to_name").isin(list(CALL_WORDS)))
    owners = symbols.filter(F.col("type") == "function").select("file_path", "qualified_name", "start_line", "end_line")
    # A call meets the functions that cross its block of lines, not all of its file.
    block = lambda line: F.floor(line / LINE_BLOCK)
    owners = owners.withColumn("block", F.explode(F.sequence(block(F.col("start_line")), block(F.col("end_line")))))
    inside = calls.withColumn("block", block(F.col("line_no"))).join(owners, ["file_path", "block"]).filter((F.col("line_no") > F.col("start_line")) & (F.col("line_no") <= F.col("end_line")))
    own = inside.groupBy("file_path", "line_no", "to_name").agg(F.max_by("qualified_name", "start_line").alias("src"))
    return own.select("src", "to_name").distinct()


def doc_tags(comment: Column) -> Column:
    """struct(description, params, returns, examples, deprecated, tags) of a doc comment.

    A tag's text runs to the next tag. Of several returns or deprecations the last with a text counts; `deprecated` is null where
    there is none, and empty without a text. Other tags, as (name, text), need a text.
    """
    plain = F.regexp_replace(F.regexp_replace(comment, r"^\s*/\*\*|\*/\s*$", ""), r"(?m)^\s*\*[ \t]?", "")
    parts = F.split(plain, r"(?m)^[ \t]*@(?=\w)")
    blank = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    tags = F.transform(F.slice(parts, 2, F.size(parts)), lambda x: F.struct(F.regexp_extract(x, r"^(\w+)", 1).alias("name"), blank(F.regexp_replace(x, r"^\w+", "")).alias("text")))

    def split(tags: Column) -> Column:
        of = lambda *names: F.transform(F.filter(tags, lambda t: t["name"].isin(*names) & (t["text"] != "")), lambda t: t["text"])
        params = F.transform(of("param", "parameter"), lambda x: F.regexp_replace(x, r"^\{[^}]*\}\s*", ""))
        name = r"(?s)^(\S+)\s*-?\s*(.*)$"
        old = F.filter(tags, lambda t: t["name"] == "deprecated")
        return F.struct(
            blank(parts[0]).alias("description"),
            F.transform(F.filter(params, lambda x: x != ""), lambda x: F.struct(F.regexp_extract(x, name, 1).alias("name"), blank(F.regexp_extract(x, name, 2)).alias("text"))).alias("params"),
            F.try_element_at(of("returns", "return"), F.lit(-1)).alias("returns"), of("example").alias("examples"), F.try_element_at(old, F.lit(-1))["text"].alias("deprecated"),
            F.filter(tags, lambda t: ~t["name"].isin("param", "parameter", "returns", "return", "example", "deprecated") & (t["text"] != "")).alias("tags"),
        )

    return let(tags, split)


def annotation_candidates(entities: DataFrame, limit: int | None = 500, least: int = 8) -> DataFrame:
    """C10."""
    known = F.col("type").isin("class", "function", "module") & (F.col("end_line") - F.col("start_line") + 1 >= least)
    return top(entities.filter(known), limit, "file_path", "start_line", "id")


def within_budget(rows: DataFrame, cost: Column, budget: float, order: list[str], by: list[str]) -> DataFrame:
    """C11: rows in order while the cost spent before them is below the budget; `exhausted` tells the groups cut short.

    Rows are sorted in ranges over all tasks; a range starts from the sums of the ranges before it, so that a large group
    isn't one task.
    """
    ranged = checkpoint(rows.withColumn("_cost", cost).repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy(*by, "_range").agg(F.sum("_cost").alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    same = F.col("_range") == F.col("_r")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    w = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.col("_start") + F.coalesce(F.sum("_cost").over(w), F.lit(0))
    out = ranged.join(starts, same).withColumn("spent", spent).drop("_start", "_r", *[f"_{c}" for c in by])
    over = out.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.max("spent").alias("_most"))
    ends = F.lit(True)
    for c in by:
        ends = ends & F.col(c).eqNullSafe(F.col(f"_{c}"))
    kept = out.filter(F.col("spent") < budget).join(over, ends).withColumn("exhausted", F.col("_most") >= budget)
    return kept.select(*rows.columns, "spent", "exhausted")


def author_docs(docs: Column) -> Column:
    """A doc struct (C8) as text; null if there is nothing in it."""
    listed = F.transform(docs["params"], lambda p: F.concat(F.lit("  - "), p["name"], F.lit(": "), p["text"]))
    fenced = F.flatten(F.transform(docs["examples"], lambda x: F.array(F.lit("```"), x, F.lit("```"))))
    headed = lambda head, some: F.when(F.size(some) > 0, F.array_join(F.concat(F.array(F.lit(head)), some), "\n"))
    lines = F.concat_ws(
        "\n", F.nullif(docs["description"], F.lit("")), headed("Parameters:", listed), F.concat(F.lit("Returns: "), docs["returns"]),
        F.when(docs["deprecated"] == "", "Deprecated").otherwise(F.concat(F.lit("Deprecated: "), docs["deprecated"])), headed("Examples:", fenced),
    )
    return F.nullif(lines, F.lit(""))


def semantic_nodes(annotations: DataFrame) -> DataFrame:
    """Distinct (id, type, name, normalized_name) of the concepts and patterns of annotations (entity_id, concepts, patterns)."""
    key = F.lower(F.trim("name"))
    one = lambda c, kind: annotations.select(F.explode(c).alias("x")).select(F.lit(kind).alias("type"), F.trim("x.name").alias("name"))
    rows = one("concepts", "concept").unionByName(one("patterns", "pattern"))
    return rows.groupBy("type", key.alias("normalized_name")).agg(F.min("name").alias("name")).select(F.concat_ws("::", "type", "normalized_name").alias("id"), "type", "name", "normalized_name")


def semantic_edges(annotations: DataFrame) -> DataFrame:
    """(src, dst, type, evidence_quote, confidence)."""
    to = lambda kind: F.concat_ws("::", F.lit(kind), F.lower(F.trim("x.name")))
    c = annotations.select("entity_id", F.explode("concepts").alias("x")).select(F.col("entity_id").alias("src"), to("concept").alias("dst"), F.lit("implements_concept").alias("type"), "x.evidence_quote", F.lit(None).cast("string").alias("confidence"))
    p = annotations.select("entity_id", F.explode("patterns").alias("x")).select(F.col("entity_id").alias("src"), to("pattern").alias("dst"), F.lit("follows_pattern").alias("type"), "x.evidence_quote", "x.confidence")
    return c.unionByName(p).distinct()


def entity_code(entities: DataFrame, chunks: DataFrame, limit: int = 6000) -> DataFrame:
    """C14: (id, code): the start of the chunk with the entity's qualified name."""
    first = chunks.filter("qualified_name is not null").groupBy("qualified_name").agg(F.min_by("text", "chunk_id").alias("text"))
    return entities.join(first, "qualified_name").select("id", F.substring("text", 1, limit).alias("code"))
