"""Scalar text functions (F1-F22) as column expressions; only trim_result, which is recursive, runs Python."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns; values that callers rely on.
BACKTICK = r"`([^`\n]{2,80})`"
PATH_TOKEN = r"(?<![\w/])([a-zA-Z0-9_.-]+/[a-zA-Z0-9_./-]+\.(?:ts|tsx|js|jsx|py|go|rs|java|rb|md))"
CLOSING = r"(?i)(?:fix(?:es|ed)?|close[sd]?|resolve[sd]?)"
FIX_EDGES = {"index": r"\s+#(\d{1,7})", "commit": r"\s+#(\d+)(?!\d)", "pull": r"\s+#(\d+)\b"}
CONVENTIONAL = r"^(\w+)(?:\([^)]*\))?(!)?\s*:"
CITATION = r"(?i)\[(?:chunk|entity):[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\]"
ENTITY_CITATION = r"(?i)\[entity:([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})\]"
DIFF_PATHS = (r"(?m)^diff --git a/\S+ b/(\S+)", r"(?m)^\+\+\+ (?:b/)?(\S+)", r"(?m)^--- (?:a/)?(\S+)")
EXCLUDED_PATHS = (
    r"(?:^|/)node_modules/", r"(?:^|/)vendor/", r"(?:^|/)\.git/", r"(?:^|/)dist/", r"(?:^|/)build/", r"(?:^|/)\.next/", r"(?:^|/)\.nuxt/", r"\.min\.(?:js|css)$", r"\.lock$",
    r"(?i:(?:^|/)tests?/)", r"(?:^|/)__tests?__/", r"\.test\.[tj]sx?$", r"\.spec\.[tj]sx?$", r"_test\.go$", r"(?:^|/)test_[^/]+\.py$", r"(?:^|/)[^/]+\.config\.[tj]s$",
    r"(?i:(?:^|/)(?:package|tsconfig|pnpm-lock|yarn|composer)\.[a-z]+$)",
)
QUICKSTART = r"install|installation|quick.?start|getting.?started|setup|usage|development|running.?locally"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def _trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def extract_refs(text: Column) -> Column:
    """backtick tokens without double spaces, then path-like tokens, each once."""
    ticks = F.transform(_all(text, BACKTICK, 1), _trimmed)
    return F.array_distinct(F.concat(F.filter(ticks, lambda t: (F.length(t) >= 2) & ~t.rlike(r"\s{2,}")), _all(text, PATH_TOKEN, 1)))


def excerpt(text: Column, limit: int = 280) -> Column:
    """without fenced code and markdown marks, blank lines to a space, cut to `limit` with an ellipsis for the last three."""
    t = F.regexp_replace(text, r"(?s)```.*?```", "")
    t = F.regexp_replace(t, r"\n{2,}", " ")
    t = _trimmed(F.regexp_replace(t, r"[#*_`>]", ""))
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 3), F.lit("…"))).otherwise(t)


def fix_refs(text: Column, edge: str = "index") -> Column:
    """issue numbers after a closing keyword; `edge` picks the rule at the right end of the number."""
    return F.array_distinct(F.transform(_all(text, CLOSING + FIX_EDGES[edge], 1), lambda x: x.cast("long")))


def _subject(message: Column) -> Column:
    return _trimmed(F.substring_index(message, "\n", 1))


def conventional_type(message: Column) -> Column:
    """the commit's conventional type, lower-cased; '' without one."""
    return F.lower(F.regexp_extract(_subject(message), CONVENTIONAL, 1))


def is_breaking(message: Column) -> Column:
    """a `!` before the colon or a BREAKING CHANGE line."""
    return (F.regexp_extract(_subject(message), CONVENTIONAL, 2) == "!") | message.rlike(r"(?m)^BREAKING[- ]CHANGE:")


def month_utc(ts: Column) -> Column:
    """yyyy-MM (sessions run in UTC)."""
    return F.date_format(ts, "yyyy-MM")


def folder2(path: Column) -> Column:
    """the two leading path segments, else one, else the root."""
    two = F.regexp_extract(path, r"^([^/]+/[^/]+)", 1)
    one = F.regexp_extract(path, r"^([^/]+)", 1)
    return F.coalesce(F.nullif(two, F.lit("")), F.nullif(one, F.lit("")), F.lit("(root)"))


def sanitize_label(text: Column, limit: int = 48, default: str = "unknown") -> Column:
    """what is no ASCII letter, digit or underscore becomes an underscore; cut; a default when empty."""
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(text, r"[^A-Za-z0-9_]", "_"), 1, limit), F.lit("")), F.lit(default))


def truncate_marked(text: Column, limit: int) -> Column:
    """F8: the text, or its start and the number of characters taken off; null gives an empty text."""
    over = (F.length(text) - limit).cast("string")
    cut = F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("… [truncated "), over, F.lit(" chars]"))).otherwise(text)
    return F.coalesce(cut, F.lit(""))


def extract_citations(text: Column) -> Column:
    """citation marks in order of appearance, lower-cased, each once."""
    return F.array_distinct(F.transform(_all(text, CITATION), F.lower))


def cited_entity_ids(text: Column) -> Column:
    """ids of the cited entities."""
    return F.array_distinct(F.transform(_all(text, ENTITY_CITATION, 1), F.lower))


def diff_paths(text: Column, limit: int = 12) -> Column:
    """paths of a pasted diff, git headers first, then new and old sides; never /dev/null."""
    found = F.concat(*[_all(text, p, 1) for p in DIFF_PATHS])
    return F.slice(F.array_distinct(F.filter(found, lambda p: p != "/dev/null")), 1, limit)


def contains_diff(text: Column) -> Column:
    """whether a text holds a diff."""
    return text.rlike(r"(?m)^diff --git |^@@ -\d+(?:,\d+)? \+\d+|^\+\+\+ \S")


def escape_like(text: Column) -> Column:
    """a literal for LIKE; the operators here use contains() instead."""
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")


def clamp(value: Column, most: int, default: int, least: int = 1) -> Column:
    """an integer in [least, most]; what isn't a number gives the default."""
    return F.least(F.greatest(F.coalesce(value.try_cast("long"), F.lit(default)), F.lit(least)), F.lit(most))


def normalize_path(path: Column) -> Column:
    """without a leading ./ or /."""
    return F.regexp_replace(path, r"^\.?/", "")


def first_line(text: Column, limit: int = 200) -> Column:
    """F15."""
    return F.substring(F.trim(F.substring_index(text, "\n", 1)), 1, limit)


def make_targets(text: Column) -> Column:
    """F16: targets of a makefile in order, each once."""
    return F.array_distinct(_all(text, r"(?m)^([a-zA-Z_][a-zA-Z0-9_-]*):", 1))


def readme_quickstart(text: Column, limit: int = 800) -> Column:
    """F16: the section under the first heading that begins with a word for starting or using; null without one."""
    section = rf"(?im)^#{{1,3}}\s+(?:{QUICKSTART}).*$((?s:.*?))(?:^(#{{1,3}})\s+.+$|\z)"
    body, following = F.regexp_extract(text, section, 1), F.regexp_extract(text, section, 2)
    last = F.when(following == "", F.substring(body, 1, limit)).otherwise(body)
    return F.when(text.rlike(section), F.substring(_trimmed(last), 1, limit))


def package_manager(field: Column) -> Column:
    """F16: by the start of a manifest's packageManager field; npm without one."""
    named = F.lit("npm")
    for name in ("bun", "yarn", "pnpm"):
        named = F.when(field.startswith(name), name).otherwise(named)
    return named


def pick_script(scripts: Column, names: list[str]) -> Column:
    """F16: the first of the names that a map of scripts has with a command."""
    return F.coalesce(*[F.when(F.coalesce(scripts[n], F.lit("")) != "", F.lit(n)) for n in names])


def is_excluded_path(path: Column) -> Column:
    """vendored, built, test, lock and configuration files."""
    return path.rlike("|".join(EXCLUDED_PATHS))


def parse_sse(block: Column) -> Column:
    """struct(event, data, has_data) of one event block."""
    lines = F.split(block, r"\r?\n")
    value = lambda x, n: F.regexp_replace(F.substring(x, n, 1 << 30), "^ ", "")
    data = F.transform(F.filter(lines, lambda x: x.startswith("data:")), lambda x: value(x, 6))
    event = F.transform(F.filter(lines, lambda x: x.startswith("event:")), lambda x: value(x, 7))
    return F.struct(F.coalesce(F.try_element_at(event, F.lit(-1)), F.lit("message")).alias("event"), F.array_join(data, "\n").alias("data"), (F.size(data) > 0).alias("has_data"))


def relative_age(then: Column, now: Column) -> Column:
    """today, days, months of 30 days up to eleven, or years of 365 days ago, by whole spans of 24 hours."""
    days = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / 86_400_000_000)
    of = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return F.when(days < 1, "today").when(days < 30, of(days, "d ago")).when(F.floor(days / 30) < 12, of(F.floor(days / 30), "mo ago")).otherwise(of(F.floor(days / 365), "y ago"))


def trim_items(items: Column, limit: int = 30) -> Column:
    """arrays to their first items."""
    return F.slice(items, 1, limit)


def trim_result(document: Column, items: int = 30, chars: int = 4000) -> Column:
    """F20 on a JSON text of any depth: arrays to their first items, strings of objects to their first characters with a mark."""

    def trimmed(x):
        if isinstance(x, list):
            return [trimmed(v) for v in x[:items]]
        if isinstance(x, dict):
            return {k: v[:chars] + "… [truncated]" if isinstance(v, str) and len(v) > chars else trimmed(v) for k, v in x.items()}
        return x

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else json.dumps(trimmed(json.loads(t)), ensure_ascii=False, separators=(",", ":")))

    return run(F.when(F.try_parse_json(document).isNotNull(), document))


def strip_keys(metadata: Column, keys: list[str]) -> Column:
    """a map without some keys."""
    return F.map_filter(metadata, lambda k, _: ~k.isin(keys))


def json_field(document: Column, path: str, kind: str = "string", default=None) -> Column:
    """a field of a JSON text, cast where it can be, with a default."""
    value = F.get_json_object(document, path)
    value = value if kind == "string" else F.try_to_timestamp(value) if kind == "timestamp" else value.try_cast(kind)
    return value if default is None else F.coalesce(value, F.lit(default))
