"""Personal data: base patterns, and terms that reveal a protected value by what the corpus says of both.

The protected entities are the values the base patterns find (an address, a card number), and the
attack is on a document in which they are masked: a reader who knows the corpus guesses a masked
value from the words left around it. Events are documents. For an entity c and a term t that stands
within WINDOW words of it in the same line,

    IC(c) = -log2 n(c)/N        PMI(c; t) = log2 N n(c, t) / (n(c) n(t))        IC(c) - PMI(c; t) = -log2 n(c, t)/n(t)

where n(t) counts the documents with the term anywhere. What remains unknown of c once t is read is IC - PMI
bits. A term that leaves at most REMOVE_BITS is removed, one that leaves at most GENERALISE_BITS, and tells more than
the kind of the entity would (PMI > IC of the kind), is generalised; both hold only where the two meet in at least
SUPPORT different surroundings, so that a passage copied many times is one witness. All occurrences of such a term in the
document with the entity are marked; documents without a protected value are left alone.

Everything is columns, joins and grouped counts. One pass finds base values and writes what later steps
need (texts of documents with a value only); one pass counts the documents of each term, combined before
the exchange. No table is held in one place, broadcast by hint or collected, but for the number of documents.

Patterns are the fixed ones below, spelled so that Java reads long texts in linear time and without
recursion: a run of address characters is tried from its start only, and groups give nothing back.

Defined results: null text is empty; repeated rows get equal results; spans of all kinds may overlap, but a
marked term never overlaps a base span. Terms are runs of three letters and more, case kept. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Kinds in their order, and patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

TERM = r"\p{L}{3,}"
WINDOW, SUPPORT = 10, 3
REMOVE_BITS, GENERALISE_BITS = 1.0, 2.0
MARKS = ("generalise", "remove")
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "generalise": "[TERM]", "remove": ""}

_SPAN = "array<struct<start:bigint,k:int,end:bigint,kind:string,value:string>>"


def _located(pieces: Column, found: Column | None, k: int, kind: Column, width: Column | None = None, value: Column | None = None) -> Column:
    """Spans of matches from the pieces between them and the matches (or one match's text and width)."""

    def step(acc: Column, i: Column) -> Column:
        start = acc["pos"] + F.length(F.get(pieces, i)).cast("long")
        match = F.get(found, i) if value is None else value
        end = start + (F.length(match).cast("long") if width is None else width)
        span = F.struct(start.alias("start"), F.lit(k).alias("k"), end.alias("end"), kind.alias("kind"), match.alias("value"))
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(span)).alias("out"))

    first = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast(_SPAN).alias("out"))
    n = F.size(pieces) - 1
    return F.when(n < 1, F.array().cast(_SPAN)).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), first, step, lambda acc: acc["out"]))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether digits pass Luhn's check."""

    def worth(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda acc, i: acc + worth(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return ~value.rlike(r"(?:^|\.)0*+(?:[0-9]{4,}|[3-9][0-9][0-9]|2[6-9][0-9]|25[6-9])(?:\.|$)")
    n = F.length(_digits(value))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(_digits(value))).otherwise(False)
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def _keeps(kind: str):
    return lambda span: _valid(kind, span["value"])


def base_spans(text: Column) -> Column:
    """Base spans (start, k, end, kind, value) of a text, by start, then kind. A cheap look decides whether a pattern runs at all."""
    looks = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), "phone": F.contains(text, F.lit("+"))}
    each = []
    for k, (kind, pattern) in enumerate(zip(KINDS, (EMAIL, IP, CARD, PHONE))):
        spans = _located(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), k, F.lit(kind))
        each.append(F.when(looks[kind], F.filter(spans, _keeps(kind))).otherwise(F.array().cast(_SPAN)))
    return F.array_sort(F.concat(*each))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def entity(span: Column) -> Column:
    """A protected value in one spelling."""
    return F.concat_ws(":", span["kind"], F.when(span["kind"] == "email", F.lower(span["value"])).when(span["kind"] == "ip", span["value"]).otherwise(_digits(span["value"])))


def with_base(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, spans, and for documents with a base span text and key (others: null, unless keep_text). Written once."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("spans", base_spans(F.col("text")))
    hit = F.size("spans") > 0
    text = F.col("text") if keep_text else F.when(hit, F.col("text"))
    return checkpoint(own.select("doc_id", "spans", text.alias("text"), F.when(hit, F.sha2("text", 256)).alias("key")))


def surroundings(hits: DataFrame) -> DataFrame:
    """(key, entity, context, term): the terms near each protected value, once for each value and document."""
    one = hits.select("key", "doc_id", "text", F.explode("spans").alias("s"))
    left = F.substring_index(F.substring(F.col("text"), F.lit(1), F.col("s.start")), "\n", -1)
    right = F.substring_index(F.substring(F.col("text"), F.col("s.end") + 1, F.length("text")), "\n", 1)
    one = one.select("key", entity(F.col("s")).alias("entity"), F.split(F.trim(left), r"\s+").alias("l"), F.slice(F.split(F.trim(right), r"\s+"), 1, WINDOW).alias("r"))
    near = F.concat_ws(" ", F.slice("l", F.greatest(F.size("l") - (WINDOW - 1), F.lit(1)), WINDOW), F.lit("\x00"), "r")
    one = one.select("key", "entity", near.alias("near"))
    return one.select("key", "entity", F.xxhash64("near").alias("context"), F.explode(F.array_distinct(F.regexp_extract_all("near", F.lit(TERM), F.lit(0)))).alias("term"))


def disclosing(docs: DataFrame, base: DataFrame, near: DataFrame) -> DataFrame:
    """(entity, term, action, ic, pmi) of the terms that reveal an entity beyond the thresholds."""
    total = base.count()
    hits = base.filter("key is not null").select("key", "spans")
    copies = hits.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.first("spans").alias("spans"))
    held = checkpoint(copies.select("copies", F.explode(F.array_distinct(F.transform("spans", lambda x: F.struct(entity(x).alias("entity"), x["kind"].alias("kind"))))).alias("e")).select("copies", "e.entity", "e.kind"))
    of_entity = held.groupBy("entity", "kind").agg(F.sum("copies").alias("n_c"))
    of_kind = copies.select("copies", F.explode(F.array_distinct(F.transform("spans", lambda x: x["kind"]))).alias("kind")).groupBy("kind").agg(F.sum("copies").alias("n_k"))
    pairs = near.join(copies.select("key", "copies"), "key")
    witnesses = pairs.groupBy("entity", "term", "context").agg(F.lit(1).alias("one")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= SUPPORT)
    together = pairs.groupBy("entity", "term", "key").agg(F.max("copies").alias("copies")).groupBy("entity", "term").agg(F.sum("copies").alias("n_ct"))
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(TERM), F.lit(0)))).alias("term"))
    of_term = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    told = witnesses.join(together, ["entity", "term"]).join(of_term, "term").join(of_entity, "entity").join(of_kind, "kind")
    exact = lambda *names: [F.col(n).cast("decimal(19,0)") for n in names]  # noqa: E731  products of counts fit 38 digits
    n_ct, n_c, n_t, n_k = exact("n_ct", "n_c", "n_t", "n_k")
    leaves = lambda bits: F.col("n_ct") * 2.0**bits >= F.col("n_t")  # noqa: E731  -log2(n_ct / n_t) <= bits
    told = told.withColumns({"ic": -F.log2(F.col("n_c") / F.lit(total)), "pmi": F.log2(F.col("n_ct") / F.col("n_c") * F.lit(total) / F.col("n_t"))})
    action = F.when(leaves(REMOVE_BITS), 1).when(leaves(GENERALISE_BITS) & (n_ct * n_k > n_c * n_t), 0)  # PMI > IC of the kind
    return told.withColumn("action", action).filter("action is not null").select("entity", "term", "action", "ic", "pmi")


def _term_spans(text: Column, base: Column, marks: Column) -> Column:
    """Spans of the marked terms in a text, without those that overlap a base span."""

    def of(mark: Column) -> Column:
        # letters only, so the term needs no escape in the pattern
        pieces = F.split(text, F.concat(F.lit(r"(?<!\p{L})"), mark["term"], F.lit(r"(?!\p{L})")), F.lit(-1))
        k = len(KINDS)
        kind = F.when(mark["action"] == 1, MARKS[1]).otherwise(MARKS[0])
        return _located(pieces, None, k, kind, F.length(mark["term"]).cast("long"), mark["term"])

    spans = F.flatten(F.transform(marks, of))
    return F.filter(spans, lambda x: ~F.exists(base, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))


def find(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, text (null without a base span, unless keep_text), base and spans (all of them), both arrays of (start, k, end, kind, value)."""
    base = with_base(docs, keep_text)
    hits = base.filter("key is not null")
    once = hits.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("spans").alias("spans"))
    near = checkpoint(surroundings(once))
    bad = disclosing(docs, base, near)
    marks = near.select("key", "entity", "term").distinct().join(bad.select("entity", "term", "action"), ["entity", "term"])
    marks = marks.groupBy("key", "term").agg(F.max("action").alias("action")).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("term", "action"))).alias("marks"))
    found = hits.join(marks, "key", "left")
    more = F.when(F.col("marks").isNull(), F.array().cast(_SPAN)).otherwise(_term_spans(F.col("text"), F.col("spans"), F.col("marks")))
    out = found.select("doc_id", "text", F.col("spans").alias("base"), F.array_sort(F.concat("spans", more)).alias("spans"))
    return out.unionByName(base.filter("key is null").select("doc_id", "text", F.col("spans").alias("base"), "spans"))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with base values masked by their kind, terms generalised or removed; of overlapping spans the first counts."""
    mask = F.create_map(*[F.lit(x) for kv in MASKS.items() for x in kv])

    def step(acc: Column, x: Column) -> Column:
        out = F.concat(acc["out"], F.substring(text, (acc["pos"] + 1).cast("int"), (x["start"] - acc["pos"]).cast("int")), F.element_at(mask, x["kind"]))
        return F.when(x["start"] >= acc["pos"], F.struct(x["end"].alias("pos"), out.alias("out"))).otherwise(acc)

    first = F.struct(F.lit(0).cast("long").alias("pos"), F.lit("").alias("out"))
    return F.aggregate(spans, first, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["pos"] + 1).cast("int"), F.length(text))))


def sanitise(docs: DataFrame) -> DataFrame:
    """doc_id, text (sanitised), and spans of what was masked, generalised or removed in it."""
    return find(docs, keep_text=True).select("doc_id", sanitised(F.col("text"), F.col("spans")).alias("text"), "spans")


def privacy_digest(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find(docs).select("doc_id", *map(count, KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
