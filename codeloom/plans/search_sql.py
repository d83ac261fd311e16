"""SQL twins of the stemmer and of text ranking, for DuckDB. A step of the stemmer is a subquery over the distinct words."""

from __future__ import annotations

from codeloom.functions import stem as S
from codeloom.operators import retrieval as R


def _list(some) -> str:
    return ", ".join(f"'{x}'" for x in some)


def _ending(endings) -> str:
    return f"regexp_extract(w, '(?:{'|'.join(endings)})$')"


def _map(rules: dict[str, str], value: str) -> str:
    return f"CASE {value} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.items())} END"


def stems(words: str) -> str:
    """A subquery (word, lexeme) over a subquery of distinct words."""
    start = f"^(?:{'|'.join(S.REGION_STARTS)}|.*?{S.VOWEL}{S.OTHER})"
    keep = "* EXCLUDE (w, e), w AS w0, e, left(w, length(w) - length(e)) AS rest"
    short = S.SHORT
    q = f"SELECT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '({S.VOWEL})y', '\\1Y', 'g') AS w FROM ({words})"
    q = f"SELECT *, coalesce(nullif(length(regexp_extract(w, '{start}')), 0), length(w)) AS r1 FROM ({q})"
    q = f"SELECT *, coalesce(r1 + nullif(length(regexp_extract(w[r1 + 1:], '^.*?{S.VOWEL}{S.OTHER}')), 0), length(w)) AS r2 FROM ({q})"
    last = "word, r1, r2, stays"

    def step(endings, becomes: str) -> None:
        nonlocal q
        q = f"SELECT {last}, {becomes} AS w FROM (SELECT {keep} FROM (SELECT *, {_ending(endings)} AS e FROM ({q})))"

    q = f"SELECT *, false AS stays FROM ({q})"
    step(["sses", "ied", "ies", "us", "ss", "s"], f"CASE WHEN e = 'sses' THEN rest || 'ss' WHEN e IN ('ied', 'ies') THEN rest || CASE WHEN length(rest) > 1 THEN 'i' ELSE 'ie' END WHEN e = 's' AND regexp_matches(left(w0, greatest(length(w0) - 2, 0)), '{S.VOWEL}') THEN rest ELSE w0 END")
    q = f"SELECT * EXCLUDE (stays), w IN ({_list(S.INVARIANT_THEN)}) AS stays FROM ({q})"
    tidied = f"""CASE WHEN regexp_matches(rest, '(?:at|bl|iz)$') THEN rest || 'e' WHEN regexp_matches(rest, '(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN rest[:-2] WHEN length(rest) <= r1 AND regexp_matches(rest, '{short}') THEN rest || 'e' ELSE rest END"""
    step(["eed", "eedly", "ed", "edly", "ing", "ingly"], f"CASE WHEN stays OR e = '' THEN w0 WHEN e IN ('eed', 'eedly') THEN CASE WHEN length(rest) >= r1 THEN rest || 'ee' ELSE w0 END WHEN regexp_matches(rest, '{S.VOWEL}') THEN {tidied} ELSE w0 END")
    q = f"SELECT * EXCLUDE (w), CASE WHEN NOT stays AND regexp_matches(w, '.{S.OTHER}[yY]$') THEN w[:-2] || 'i' ELSE w END AS w FROM ({q})"
    step(S.STEP_2, f"CASE WHEN NOT stays AND e <> '' AND length(rest) >= r1 AND CASE e WHEN 'ogi' THEN rest[-1] = 'l' WHEN 'li' THEN regexp_matches(rest, '[{S.LI_ENDING}]$') ELSE true END THEN rest || {_map(S.STEP_2, 'e')} ELSE w0 END")
    step(S.STEP_3, f"CASE WHEN NOT stays AND e <> '' AND length(rest) >= CASE e WHEN 'ative' THEN r2 ELSE r1 END THEN rest || {_map(S.STEP_3, 'e')} ELSE w0 END")
    step(S.STEP_4, "CASE WHEN NOT stays AND e <> '' AND length(rest) >= r2 AND (e <> 'ion' OR rest[-1] IN ('s', 't')) THEN rest ELSE w0 END")
    step(["e", "ll"], f"CASE WHEN NOT stays AND (e = 'e' AND (length(rest) >= r2 OR length(rest) >= r1 AND NOT regexp_matches(rest, '{short}')) OR e = 'll' AND length(w0) - 1 >= r2) THEN w0[:-2] ELSE w0 END")
    irregular = f"coalesce({_map(S.IRREGULAR, 'word')}, CASE WHEN length(word) <= 2 OR word IN ({_list(S.INVARIANT)}) THEN word END, translate(w, 'Y', 'y'))"
    return f"SELECT word, {irregular} AS lexeme FROM ({q})"


def found(lexemes: list[str], where: str = "true") -> str:
    """CTEs `tok` (chunk_id, place, word), `st` (word, lexeme) and `pl` (chunk_id, lexeme, places) of the documents."""
    return rf"""tok AS (SELECT chunk_id, row_number() OVER (PARTITION BY chunk_id ORDER BY i) AS place, word FROM (SELECT doc_id AS chunk_id, unnest(w) AS word, unnest(range(len(w))) AS i
          FROM (SELECT doc_id, string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+') AS w FROM documents WHERE {where})) WHERE word <> ''),
st AS MATERIALIZED ({stems(f"SELECT DISTINCT word FROM tok WHERE word NOT IN ({_list(S.STOP_WORDS)})")}),
pl AS MATERIALIZED (SELECT chunk_id, lexeme, list_slice(list(place ORDER BY place), 1, {R.MAX_POSITIONS}) AS places FROM (SELECT DISTINCT chunk_id, lexeme, least(place, {R.LAST_POSITION}) AS place
          FROM tok JOIN st USING (word) WHERE lexeme IN ({_list(lexemes)})) GROUP BY 1, 2)"""


def closeness(one: str, two: str) -> str:
    """A subquery (chunk_id, score) of the chunks that have both lexemes."""
    pairs = f"""SELECT chunk_id, p, unnest(q) AS q FROM (SELECT a.chunk_id, unnest(a.places) AS p, b.places AS q FROM pl a JOIN pl b ON a.chunk_id = b.chunk_id AND a.lexeme = '{one}' AND b.lexeme = '{two}')"""
    weight = "CASE WHEN abs(p - q) > 100 THEN 1e-30 ELSE 1 / (1.005 + 0.05 * exp(abs(p - q)::DOUBLE / 1.5 - 2)) END"
    return f"SELECT chunk_id, coalesce(1 - product(1 - {R.WEIGHT} * sqrt({weight})) FILTER (p <> q), 1e-20) AS score FROM ({pairs}) GROUP BY 1"


def frequency(lexemes: list[str]) -> str:
    """A subquery (chunk_id, score) of the chunks that have any of the lexemes."""
    return f"""SELECT chunk_id, sum(list_sum(list_transform(range(1, len(places) + 1), lambda i: {R.WEIGHT} / (i * i)))) / {R.ALL_SQUARES} / {len(lexemes)} AS score FROM pl GROUP BY 1"""
