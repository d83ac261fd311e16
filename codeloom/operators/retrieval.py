"""Vector and text retrieval."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from codeloom.functions import text as X
from codeloom.functions.blocks import SLACK, Block, exact, rough
from codeloom.functions.stem import STOP_WORDS, let, may_have_stem
from codeloom.functions.stem import stem as stem_of
from codeloom.functions.vectors import cosine
from codeloom.operators import neighbours
from codeloom.runtime import top, union

RRF_K = 60
ARM = 4
#: Vectors of queries that go to every task at once, and the sides of a task's matrix product.
BLOCK_BYTES = 32 << 20
QUERY_ROWS, CHUNK_ROWS = 1024, 4096
#: Fixed values of text ranking: the weight of a position, the last position, positions kept of a lexeme, the sum of all 1/i^2.
WEIGHT, LAST_POSITION, MAX_POSITIONS, ALL_SQUARES = 0.1, 16383, 256, 1.64493406685


class Term(NamedTuple):
    """A word, or the words of a phrase with their distances from its first one."""

    words: tuple[tuple[str, int], ...]
    negated: bool


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def tokens(text: Column, stop: tuple | list = STOP_WORDS) -> Column:
    """Words without stop words."""
    return F.filter(words(text), lambda w: ~w.isin(list(stop))) if stop else words(text)


def parse_query(query: str) -> list[list[Term]]:
    """Web-search syntax: alternatives (split at "or") of terms that must all hold; quotes make a phrase, a leading minus excludes.

    Stop words go, but keep their place within a phrase.
    """
    alternatives: list[list[Term]] = [[]]
    for i, piece in enumerate(query.split('"')):
        before = query.split('"')[i - 1] if i else ""
        for item in [piece] if i % 2 else piece.split():
            if not i % 2 and item.lower() == "or":
                alternatives.append([])
                continue
            split = "".join(c.lower() if c.isalnum() else " " for c in item).split()
            placed = [(w, at) for at, w in enumerate(split) if w not in STOP_WORDS]
            if placed:
                negated = before.endswith("-") if i % 2 else item.startswith("-")
                alternatives[-1].append(Term(tuple((w, at - placed[0][1]) for w, at in placed), negated))
    return [a for a in alternatives if a]


def stems_of(spark: SparkSession, some: list[str]) -> dict[str, str]:
    """Stems of a query's words, by the same columns that the table's words go through."""
    row = spark.range(1).select(*[stem_of(F.lit(w)).alias(f"w{i}") for i, w in enumerate(some)]).first() if some else ()
    return dict(zip(some, row))


def lexemes(text: Column, wanted: list[str], stem: bool = True) -> Column:
    """The wanted lexemes of a text with their places: array of (lexeme, place), places from 1 with stop words counted, up to the last one kept."""
    placed = F.transform(words(text), lambda w, i: F.struct(w.alias("lexeme"), F.least(i + 1, F.lit(LAST_POSITION)).alias("place")))
    if not stem:
        return F.filter(placed, lambda x: x["lexeme"].isin(wanted))
    near = F.filter(placed, lambda x: may_have_stem(x["lexeme"], wanted) & ~x["lexeme"].isin(STOP_WORDS))
    stemmed = F.transform(near, lambda x: F.struct(stem_of(x["lexeme"]).alias("lexeme"), x["place"].alias("place")))
    return F.filter(stemmed, lambda x: x["lexeme"].isin(wanted))


def _places(found: Column, lexeme: str) -> Column:
    """Distinct places of a lexeme, the first MAX_POSITIONS."""
    return F.slice(F.array_distinct(F.transform(F.filter(found, lambda x: x["lexeme"] == lexeme), lambda x: x["place"])), 1, MAX_POSITIONS)


def _holds(places: dict[str, Column], term: Term) -> Column:
    (first, _), *rest = term.words
    if not rest:
        return F.size(places[first]) > 0
    follows = lambda p: reduce(lambda a, b: a & b, [F.array_contains(places[w], p + at) for w, at in rest])
    return F.exists(places[first], follows)


def _closeness(places: dict[str, Column]) -> Column:
    """1 - product of (1 - weight) over all pairs of places of two lexemes; pairs of one place don't count."""
    lists = list(places.values())
    pairs = [(a, b) for i, b in enumerate(lists) for a in lists[:i]]

    def of(a: Column, b: Column) -> Column:
        each = lambda x: F.transform(b, lambda y: F.abs(x - y))
        return F.filter(F.flatten(F.transform(a, each)), lambda d: d > 0)

    far = F.concat(*[of(a, b) for a, b in pairs])
    weight = lambda d: F.when(d > 100, 1e-30).otherwise(1 / (1.005 + 0.05 * F.exp(d / 1.5 - 2)))
    left = F.aggregate(far, F.lit(1.0), lambda acc, d: acc * (1 - WEIGHT * F.sqrt(weight(d))))
    return let(far, lambda f: F.when(F.size(f) > 0, 1 - left).otherwise(1e-20))


def _frequency(places: dict[str, Column]) -> Column:
    """Mean over the lexemes of the weights of their places, the i-th worth 1/i^2."""
    of = lambda p: F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(p), F.lit(1))), F.lit(0.0), lambda acc, i: acc + F.when(i <= F.size(p), WEIGHT / (i * i)).otherwise(0.0))
    return reduce(lambda a, b: a + b, [of(p) for p in places.values()]) / ALL_SQUARES / len(places)


def text_rank(found: Column, alternatives: list[list[Term]]) -> Column:
    """V3: (match, score) of a text from its lexemes (see `lexemes`).

    Where the query is one alternative of several lexemes the score is their closeness; else it is the frequency of each. Lexemes that are
    excluded count as lexemes of the query.
    """
    names = sorted({w for a in alternatives for t in a for w, _ in t.words})

    def both(places: Column) -> Column:
        of = {w: places[f"p{i}"] for i, w in enumerate(names)}
        holds = [reduce(lambda x, y: x & y, [~_holds(of, t) if t.negated else _holds(of, t) for t in a]) for a in alternatives]
        one = len(alternatives) == 1 and (len(alternatives[0]) > 1 or len(alternatives[0][0].words) > 1 and not alternatives[0][0].negated)
        score = _closeness(of) if one and len(names) > 1 else _frequency(of)
        return F.struct(reduce(lambda x, y: x | y, holds).alias("match"), score.alias("score"))

    return let(F.struct(*[_places(found, w).alias(f"p{i}") for i, w in enumerate(names)]), both)


def prepared(spark: SparkSession, query: str, stem: bool = True) -> list[list[Term]]:
    """A parsed query over lexemes."""
    alternatives = parse_query(query)
    to = stems_of(spark, sorted({w for a in alternatives for t in a for w, _ in t.words})) if stem else {}
    return [[Term(tuple((to.get(w, w), at) for w, at in t.words), t.negated) for t in a] for a in alternatives]


def text_matches(chunks: DataFrame, query: str, stem: bool = True) -> DataFrame:
    """V3: (chunk_id, score) of all chunks that match. A text is read once; only words that can have a wanted stem are stemmed."""
    alternatives = prepared(chunks.sparkSession, query, stem)
    if not alternatives:
        return chunks.select("chunk_id", F.lit(0.0).alias("score")).limit(0)
    wanted = sorted({w for a in alternatives for t in a for w, _ in t.words})
    found = let(lexemes(F.coalesce("text", F.lit("")), wanted, stem), lambda f: text_rank(f, alternatives))
    # A generator, so that the filter isn't pushed below and the rank worked out twice.
    return chunks.select("chunk_id", F.inline(F.filter(F.array(found), lambda r: r["match"]))).select("chunk_id", "score")


def query_lexemes(spark: SparkSession, query: str) -> list[str]:
    return sorted({w for a in prepared(spark, query) for t in a for w, _ in t.words})


def text_index(chunks: DataFrame, only: list[str] | None = None) -> DataFrame:
    """(lexeme, chunk_id, places): the inverted index of a table. Each distinct word is stemmed once, whatever its number of uses.

    With `only`, the entries of these lexemes. A lexeme has as many words as there are endings to it, so they go to every task, and the
    words of the texts are shuffled neither for them nor for the places.
    """
    placed = chunks.select("chunk_id", F.posexplode(words(F.coalesce("text", F.lit("")))).alias("at", "word")).filter(~F.col("word").isin(STOP_WORDS))
    placed = placed.select("chunk_id", "word", F.least(F.col("at") + 1, F.lit(LAST_POSITION)).alias("place"))
    able = placed if only is None else placed.filter(may_have_stem(F.col("word"), only))
    stems = able.groupBy("word").agg(F.lit(1).alias("one")).select("word", stem_of(F.col("word")).alias("lexeme"))
    stems = stems if only is None else F.broadcast(stems.filter(F.col("lexeme").isin(only)))
    return placed.join(stems, "word").groupBy("lexeme", "chunk_id").agg(F.slice(F.sort_array(F.collect_set("place")), 1, MAX_POSITIONS).alias("places"))


def search_index(index: DataFrame, query: str) -> DataFrame:
    """V3 on an index: (chunk_id, score) of all chunks that match; only the query's lexemes are read.

    Every alternative needs a word that isn't excluded, as chunks without any of the words aren't in those rows.
    """
    alternatives = prepared(index.sparkSession, query)
    if any(all(t.negated for t in a) for a in alternatives):
        raise ValueError("a query of excluded words only can't be answered from an index")
    if not alternatives:
        return index.select("chunk_id", F.lit(0.0).alias("score")).limit(0)
    wanted = sorted({w for a in alternatives for t in a for w, _ in t.words})
    entry = F.explode(F.transform("places", lambda p: F.struct(F.col("lexeme").alias("lexeme"), p.alias("place"))))
    found = index.filter(F.col("lexeme").isin(wanted)).select("chunk_id", entry.alias("x")).groupBy("chunk_id").agg(F.sort_array(F.collect_list("x")).alias("found"))
    return found.select("chunk_id", F.inline(F.filter(F.array(text_rank(F.col("found"), alternatives)), lambda r: r["match"]))).select("chunk_id", "score")


def ranked(df: DataFrame, limit: int, *order) -> DataFrame:
    """The first rows with their rank: limited first, so the window sees `limit` rows, never the table."""
    return df.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def nearest(chunks: DataFrame, query: list[float] | Column, limit: int) -> DataFrame:
    """V2: (chunk_id, distance, rank) of the nearest embeddings; rows without one are skipped."""
    vector = query if isinstance(query, Column) else F.array(*[F.lit(float(x)) for x in query])
    scored = chunks.filter("embedding is not null").select("chunk_id", (1 - cosine(F.col("embedding"), vector)).alias("distance"))
    return ranked(scored, limit, "distance", "chunk_id")


def nearest_batch(chunks: DataFrame, queries: DataFrame, limit: int, max_queries: int | None = None) -> DataFrame:
    """V2 for a table of queries (query_id, vector): (query_id, chunk_id, distance, rank).

    Queries whose vectors take BLOCK_BYTES at most (or max_queries) go to every task: a task takes the matrix product of its chunks with
    them and keeps each query's best rows, so only tasks x queries x limit rows are shuffled. More of them stay in their
    table and meet the chunks by regions (neighbours.py). Ties go to the smaller chunk_id. Queries and
    chunks without a vector are left out.
    """
    by = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    held = chunks.filter("embedding is not null").select("chunk_id", "embedding")
    asked = queries.filter("vector is not null").select("query_id", "vector")
    n, width = asked.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    if n > (max_queries or BLOCK_BYTES // (8 * max(1, width or 0))):
        return neighbours.nearest(held, asked, limit)
    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, chunk_id {held.schema['chunk_id'].dataType.simpleString()}, distance double"
    block = asked.toPandas()  # its size has been checked
    best = held.mapInPandas(_best_of(block["query_id"].to_numpy(), list(block["vector"]), limit), schema)
    return best.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= limit)


def _best_of(query_ids, vectors: list, limit: int):
    """For mapInPandas over chunks: the best rows of each query among all of a task's."""
    import numpy as np
    import pandas as pd

    starts = range(0, len(vectors), QUERY_ROWS)

    def run(frames):
        blocks = [Block(vectors[a : a + QUERY_ROWS]) for a in starts]
        best: list = [None] * len(blocks)
        for whole in frames:
            for at in range(0, len(whole), CHUNK_ROWS):
                pdf = whole.iloc[at : at + CHUNK_ROWS]
                held, ids = Block(pdf["embedding"]), pdf["chunk_id"].to_numpy()
                for k, block in enumerate(blocks):
                    near = rough(block, held)
                    top = min(limit, len(ids))
                    least = np.partition(near, len(ids) - top, axis=1)[:, len(ids) - top]
                    if best[k] is not None:
                        least = np.maximum(least, best[k]["least"])
                    q, c = np.nonzero(near >= least[:, None] - SLACK)
                    rows = pd.DataFrame({"q": q, "chunk_id": ids[c], "distance": 1 - exact(block, held, q, c)})
                    if best[k] is not None:
                        rows = pd.concat([best[k]["rows"], rows], ignore_index=True)
                    rows = rows.sort_values(["q", "distance", "chunk_id"]).groupby("q", sort=False).head(limit)
                    full = rows.groupby("q")["distance"].agg(["size", "max"])
                    floor = np.full(block.n, -np.inf)
                    floor[full.index[full["size"] == limit]] = 1 - full["max"][full["size"] == limit]
                    best[k] = {"rows": rows, "least": floor}
        for a, kept in zip(starts, best):
            if kept is not None:
                yield pd.DataFrame({"query_id": query_ids[a + kept["rows"]["q"].to_numpy()], "chunk_id": kept["rows"]["chunk_id"].to_numpy(), "distance": kept["rows"]["distance"].to_numpy()})

    return run


def search_text(chunks: DataFrame, query: str, limit: int, stem: bool = True) -> DataFrame:
    """V3: (chunk_id, score, rank)."""
    scored = text_matches(chunks, query, stem).withColumn("score", F.round("score", 9))  # so that equal scores tie, in whatever order they were summed
    return ranked(scored, limit, F.desc("score"), "chunk_id")


def fuse(*lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """V4: (chunk_id, rrf) over ranked lists (chunk_id, rank)."""
    both = union([x.select("chunk_id", "rank") for x in lists])
    return both.groupBy("chunk_id").agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("rrf"))


def hybrid_search(chunks: DataFrame, query: str, vector: list[float] | Column | None, limit: int = 10, stem: bool = True) -> DataFrame:
    """K6: (chunk_id, rrf) by reciprocal rank over both arms; either may be empty."""
    arms = [search_text(chunks, query, ARM * limit, stem)]
    if vector is not None:
        arms.append(nearest(chunks, vector, ARM * limit))
    return top(fuse(*arms), limit, F.desc("rrf"), "chunk_id")


def search_docs(chunks: DataFrame, query: str, vector: list[float] | Column | None, limit: int = 12, stem: bool = True) -> DataFrame:
    """K7: hybrid search of documentation chunks; the filter reaches the scan."""
    return hybrid_search(chunks.filter(F.col("source_type") == "doc"), query, vector, limit, stem)


def embed_pending(rows: DataFrame, model: Callable[[list[str]], list[list[float]]], text: str = "text", batch: int = 64) -> DataFrame:
    """V5: rows with the null embeddings filled by a model, called in the tasks on batches of texts."""

    kind = rows.schema["embedding"].dataType

    @F.arrow_udf(kind)
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        to = to_arrow_type(kind)
        for part in parts:
            done = [pa.array(model([t or "" for t in part.slice(a, batch).to_pylist()]), to) for a in range(0, len(part), batch)]
            yield pa.concat_arrays(done) if done else pa.array([], to)

    # Only the texts go to Python, as Arrow, and only vectors come back.
    filled = rows.filter("embedding is null").withColumn("embedding", run(F.col(text)))
    return rows.filter("embedding is not null").unionByName(filled)


def assemble_context(pinned: DataFrame, results: list[DataFrame], fallback: DataFrame | None = None) -> DataFrame:
    """Items (id, kind, text) of the pinned list, then each result, first mention kept; chunks from `fallback` if there are none."""
    tagged = union([x.select("id", "kind", "text", F.lit(i).alias("source")) for i, x in enumerate([pinned, *results])])
    once = tagged.groupBy("id", "kind").agg(F.min_by("text", "source").alias("text"), F.min("source").alias("source"))
    if fallback is None:
        return once
    chunks = once.filter(F.col("kind") == "chunk").agg(F.count(F.lit(1)).alias("chunks"))  # one row
    extra = fallback.select("id", F.lit("chunk").alias("kind"), "text", F.lit(len(results) + 1).alias("source"))
    return once.unionByName(extra.crossJoin(F.broadcast(chunks)).filter("chunks = 0").drop("chunks"))


def render_entities(entities: DataFrame, files: int = 30) -> DataFrame:
    """(id, block): an entity as prompt lines: header, place, language, signature, description, and what its type's metadata says.

    entities: id, type, name and, where there, qualified_name, file_path, start_line, end_line, language, signature,
    description, metadata (variant or JSON text). Commits show author, date, message, files and diff; persons e-mail and
    commits; files hotness; functions, classes and types their docs; others up to 12 entries of metadata, keys in order.
    """
    col = lambda c: F.col(c) if c in entities.columns else F.lit(None).cast("string")
    meta = col("metadata") if dict(entities.dtypes).get("metadata") == "variant" else F.try_parse_json(col("metadata"))
    kind, documented = F.col("type"), F.col("type").isin("function", "class", "type")
    read = lambda when, path, schema: F.when(when, F.try_variant_get("meta", path, schema))
    seen = F.filter(F.map_entries(F.try_variant_get("meta", "$", "map<string,variant>")), lambda e: ~F.is_variant_null(e["value"]) & F.coalesce(e["value"].cast("string") != "", F.lit(True)))
    # Parsed once and read into columns, as an expression in a lambda is worked out again wherever it's named.
    parts = ("qualified_name", "file_path", "start_line", "end_line", "language", "signature", "description")
    parsed = entities.select("id", "type", "name", *[col(c).alias(c) for c in parts], meta.alias("meta"))
    rows = parsed.select(
        "id", "type", "name", *parts,
        read(kind == "commit", "$", "struct<sha:string,author:string,email:string,date:string,message:string,filesChanged:array<string>,diff:string,diffTruncated:boolean>").alias("commit"),
        read(kind == "person", "$", "struct<email:string,commitCount:variant>").alias("person"), read(kind == "file", "$", "struct<hotness:variant>").alias("file"),
        read(documented, "$.docs", "struct<description:string,params:array<struct<name:string,description:string>>,returns:string,examples:array<string>,deprecated:variant>").alias("docs"),
        F.when(kind.isin("commit", "person", "file") | (documented & F.try_variant_get("meta", "$.docs", "variant").isNotNull()), None).otherwise(seen).alias("entries"),
    )

    said = lambda path: F.nullif(F.col(path), F.lit(""))
    line = lambda label, path: F.concat(F.lit(f"- {label}: "), said(path))
    quoted = lambda label, x: F.concat(F.lit(f"- {label}: `"), x, F.lit("`"))
    several = lambda head, n, some: F.when(n > 0, F.array_join(F.concat(F.array(head), some), "\n"))
    indent = lambda x, by: F.concat(F.lit(by), F.replace(x, F.lit("\n"), F.lit("\n" + by)))
    fenced = lambda x, kind="": F.concat(F.lit(f"  ```{kind}\n"), indent(x, "  "), F.lit("\n  ```"))
    whole = lambda path, type="string": F.try_variant_get(path, "$", type)
    number = lambda label, path, end="": F.when(F.schema_of_variant(path).rlike("^(?:BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.concat(F.lit(f"- {label}: "), whole(path), F.lit(end)))
    span = F.when(F.col("start_line").cast("int") > 0, F.concat(F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.coalesce(F.col("end_line").cast("string"), F.col("start_line").cast("string"))))
    changed, entries = F.col("commit.filesChanged"), F.col("entries")
    more = F.when(F.size(changed) > files, F.array(F.concat(F.lit("    - … and "), (F.size(changed) - files).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    block = (
        F.concat(F.lit("### [entity:"), F.col("id"), F.lit("] "), F.col("name"), F.lit(" ("), kind, F.lit(")")),
        quoted("qualified", said("qualified_name")), quoted("location", F.concat(said("file_path"), F.coalesce(span, F.lit("")))), line("language", "language"),
        quoted("signature", F.left(said("signature"), F.lit(240))), line("description", "description"),
        # commits
        line("sha", "commit.sha"), F.concat(line("author", "commit.author"), F.coalesce(F.concat(F.lit(" <"), said("commit.email"), F.lit(">")), F.lit(""))), line("date", "commit.date"),
        F.concat(F.lit("- message:\n"), indent(said("commit.message"), "    ")),
        several(F.concat(F.lit("- files changed ("), F.size(changed).cast("string"), F.lit("):")), F.size(changed), F.concat(F.transform(F.slice(changed, 1, files), lambda f: F.concat(F.lit("    - "), f)), more)),
        F.concat(F.lit("- diff"), F.when(F.col("commit.diffTruncated"), " (truncated)").otherwise(""), F.lit(":\n"), fenced(said("commit.diff"), "diff")),
        # persons, files
        line("email", "person.email"), number("commits", "person.commitCount"), number("hotness", "file.hotness", " modification(s) in last 90 days"),
        # functions, classes and types
        line("jsdoc", "docs.description"), several(F.lit("- jsdoc params:"), F.size("docs.params"), F.transform("docs.params", lambda p: F.concat(F.lit("    - "), p["name"], F.lit(": "), p["description"]))),
        line("jsdoc returns", "docs.returns"), F.when(whole("docs.deprecated", "boolean"), "- deprecated").when(~whole("docs.deprecated").isin("", "false"), F.concat(F.lit("- deprecated: "), whole("docs.deprecated"))),
        several(F.lit("- jsdoc examples:"), F.size("docs.examples"), F.transform("docs.examples", lambda x: fenced(x))),
        # others
        several(F.lit("- metadata:"), F.when(F.size(entries) <= 12, F.size(entries)), F.transform(entries, lambda e: F.concat(F.lit("    - "), e["key"], F.lit(": "), F.left(F.coalesce(e["value"].cast("string"), F.to_json(e["value"])), F.lit(200))))),
    )
    return rows.select("id", F.concat_ws("\n", *block).alias("block"))


def unknown_citations(messages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(message_id, chunk_id) of the cited chunks that don't exist."""
    cited = messages.select("message_id", F.explode(X.extract_citations(F.col("content"))).alias("c")).filter(F.col("c").startswith("[chunk:"))
    return cited.select("message_id", F.regexp_extract("c", r"\[chunk:(.*)\]", 1).alias("chunk_id")).join(chunks.select("chunk_id"), "chunk_id", "left_anti")
