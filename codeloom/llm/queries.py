"""One query for each operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import jaccard, langid, license_scan, lm_score, mixing, mpeg, negatives, packing, privacy, quality, repair, sharding, substring
from .common import read_table


def op1_karmarkar_karp_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"))


def op2_first_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op3_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_digest(read_table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_documents(read_table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.media_digest(read_table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(read_table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_digest(read_table(spark, sf_dir, "documents"))


def op9_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(read_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_documents(read_table(spark, sf_dir, "documents"))


def op11_angular_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.negatives_digest(read_table(spark, sf_dir, "embeddings"))


def op12_disclosure_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.privacy_digest(read_table(spark, sf_dir, "documents"))


def op13_glr_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_digest(read_table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_karmarkar_karp_sharding": op1_karmarkar_karp_sharding,
    "op2_first_fit_packing": op2_first_fit_packing,
    "op3_tokeniser_fertility": op3_tokeniser_fertility,
    "op4_license_scan": op4_license_scan,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_mpeg_audio": op6_mpeg_audio,
    "op7_mix_sources": op7_mix_sources,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_lattice_likelihood": op9_lattice_likelihood,
    "op10_language_id": op10_language_id,
    "op11_angular_negatives": op11_angular_negatives,
    "op12_disclosure_sanitisation": op12_disclosure_sanitisation,
    "op13_glr_repair": op13_glr_repair,
}

def _add(value: str, cost: int | str, letters: str) -> str:
    """SQL: a stack's (cost, audit), written as nine digits and letters so that the smaller string is the better one, with more of both."""
    return f"(lpad(({value}[1:9]::INT + {cost})::VARCHAR, 9, '0') || {value}[10:] || '{letters}')"


def _repair_step() -> str:
    """SQL: the columns e, sy, u, a (nothing yet, after a system row, after user, after assistant) once a row is read."""
    u0 = f"least(u, {_add('e', 3, 'I')}, {_add('sy', 3, 'I')}, {_add('a', 3, 'I')})"
    keep = lambda v, x: f"CASE WHEN fault IN ('', 't') AND initial = '{x}' THEN {_add(v, 'more', 'K')} END"
    other = lambda v: f"CASE WHEN fault IN ('', 't') THEN {_add(v, '3 + more', 'R')} END"
    return f"""SELECT conv_id, i, n, {_add('e', 4, 'D')} AS e, least({_add('sy', 4, 'D')}, {keep('e', 's')}) AS sy,
                  least({_add('u0', 4, 'D')}, {', '.join(f(v) for v in ('e', 'sy', 'a0') for f in (lambda v: keep(v, 'u'), other))}) AS u,
                  least({_add('a0', 4, 'D')}, {keep('u0', 'a')}, {other('u0')}) AS a
           FROM (SELECT *, least(a, {_add('u0', 3, 'I')}) AS a0 FROM (
                 SELECT f.conv_id, f.i, f.n, f.initial, f.fault, f.more, e, sy, a, {u0} AS u0
                 FROM s JOIN f ON s.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = s.i + 1))"""


#: CRC-32 of an ASCII string in DuckDB.
def _crc(key: str) -> str:
    step = "list_reduce([xor(acc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({key}, ''), lambda x: ord(x)::BIGINT)), lambda acc, byte: {step}), 4294967295)"


_BLANKS = r"\x20\x09-\x0D"

#: Kinds of personal data: number, name, pattern, and what a match must be.
_PERSONAL = (
    (0, "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    (1, "ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "list_max(list_transform(string_split(v, '.'), lambda x: least(length(ltrim(x, '0')), 4) * 1000 + right('000' || x, 3)::INT)) <= 3255"),
    (2, "card", r"[0-9](?:[\x20-]?[0-9])+", "length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(range(length(digits)), lambda j: CASE WHEN j % 2 = 0 THEN digits[length(digits) - j]::INT "
     "WHEN digits[length(digits) - j]::INT > 4 THEN 2 * digits[length(digits) - j]::INT - 9 ELSE 2 * digits[length(digits) - j]::INT END)) % 10 = 0"),
    (3, "phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(digits) BETWEEN 10 AND 15"),
)


def _matches(k: int, kind: str, pattern: str, valid: str) -> str:
    """SQL: a kind's valid matches with their places."""
    return f"""SELECT rid, {k} AS k, '{kind}' AS kind, v, digits, st, st + length(v) AS en FROM (
            SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS digits FROM (
            SELECT rid, found[i] AS v, (list_sum(list_transform(between[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0))::BIGINT AS st FROM (
            SELECT rid, found, between, unnest(range(1, len(found) + 1)) AS i FROM (
            SELECT rid, regexp_extract_all(text, '{pattern}') AS found, string_split_regex(text, '{pattern}') AS between FROM d)))) WHERE {valid}"""


#: Words of a document in DuckDB.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_LOWER_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

ORACLES = {
    "op5_ngram_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_LOWER_WORDS} AS w FROM documents),
        f AS (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 4),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS x FROM f
              UNION ALL SELECT doc_id, '#' || array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 3),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        r AS (SELECT doc_id AS node, doc_id AS origin FROM d UNION SELECT b, origin FROM r JOIN l ON a = node),
        m AS (SELECT node, min(origin) AS component_id FROM r GROUP BY 1)
        SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d JOIN m ON node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op7_mix_sources": f"""
        WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
        w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 2 * source_size AS cap FROM s),
        o AS (SELECT *, (sum(source_size) OVER ())::DOUBLE * 150 / 100 AS budget, coalesce(sum(cap) OVER q, 0)::DOUBLE AS cap_before,
                     (sum(w) OVER () - coalesce(sum(w) OVER q, 0))::DOUBLE AS w_left, cap / w AS ratio
              FROM w WINDOW q AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        v AS (SELECT *, (budget - cap_before) / w_left AS level FROM o),
        x AS (SELECT arg_min(level, ratio) FILTER (cap > level * w) AS level FROM v),
        t AS (SELECT v.source, source_size, CASE WHEN x.level IS NULL THEN cap ELSE least(cap, x.level * w) END::DOUBLE AS target FROM v, x),
        e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
        c AS (SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY ('0x' || md5('0:' || doc_id || ':' || size)[1:13])::BIGINT, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM d)
        SELECT doc_id, size, source_size, round(target, 6) AS target,
               (size * (whole + CASE WHEN 2 * upto - size <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM c JOIN e ON c.source IS NOT DISTINCT FROM e.source""",
    "op8_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        s AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
        k AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS x FROM s),
        m AS (SELECT x, min(doc_id) AS lo FROM k GROUP BY x),
        g AS (SELECT DISTINCT doc_id, i + j AS pos FROM k JOIN m USING (x), range(0, 13) t(j) WHERE lo < doc_id),
        p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM d),
        a AS (SELECT p.doc_id, count(*) AS n, sum((g.pos IS NOT NULL)::INT) AS r,
                     coalesce(string_agg(word, ' ' ORDER BY p.pos) FILTER (WHERE g.pos IS NULL), '') AS t
              FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.pos = g.pos GROUP BY 1)
        SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(r, 0)::BIGINT AS n_removed,
               sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN a USING (doc_id)""",
    "op11_angular_negatives": """
        WITH e AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
                   FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (SELECT a.vec_id AS a, a.label AS la, b.vec_id AS b, b.label AS lb, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::BIGINT AS s
              FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
        q AS (SELECT a, b AS p, s AS ps FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM p WHERE la = lb) WHERE r <= 5),
        n AS (SELECT q.a, q.p, ps, b, s, row_number() OVER (PARTITION BY q.a, q.p ORDER BY s DESC, b) AS r
              FROM q JOIN p ON q.a = p.a WHERE la <> lb AND 50 * ps <= 100 * s AND 100 * s <= 95 * ps)
        SELECT a AS anchor_id, p AS positive_id, r::INT AS rank, b AS negative_id, ps AS positive_score, s AS negative_score FROM n WHERE r <= 3""",
    "op12_disclosure_sanitisation": rf"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
        m AS MATERIALIZED ({" UNION ALL ".join(_matches(*x) for x in _PERSONAL)}),
        h AS MATERIALIZED (SELECT m.rid, k, kind, st, en, kind || ':' || CASE kind WHEN 'email' THEN lower(v) WHEN 'ip' THEN v ELSE digits END AS entity, text FROM m JOIN d ON d.rid = m.rid),
        g AS (SELECT rid, kind, entity, array_to_string(list_concat(list_concat(
                     list_slice(regexp_split_to_array(trim(string_split(text[1:st], chr(10))[-1]), '[ \t\n\x0B\f\r]+'), -10, -1), [chr(1)]),
                     list_slice(regexp_split_to_array(trim(string_split(text[en + 1:], chr(10))[1]), '[ \t\n\x0B\f\r]+'), 1, 10)), ' ') AS near FROM h),
        w AS MATERIALIZED (SELECT rid, kind, entity, near, unnest(list_distinct(regexp_extract_all(near, '\p{{L}}{{3,}}'))) AS term FROM g),
        ct AS (SELECT kind, entity, term, count(DISTINCT rid) AS n_ct FROM w GROUP BY ALL HAVING count(DISTINCT near) >= 3),
        t AS (SELECT term, count(*) AS n_t FROM (SELECT unnest(list_distinct(regexp_extract_all(text, '\p{{L}}{{3,}}'))) AS term FROM d) GROUP BY 1),
        c AS (SELECT entity, count(DISTINCT rid) AS n_c FROM h GROUP BY 1), kk AS (SELECT kind, count(DISTINCT rid) AS n_k FROM h GROUP BY 1),
        b AS (SELECT entity, term, CASE WHEN 2 * n_ct >= n_t THEN 1 WHEN 4 * n_ct >= n_t AND n_ct * n_k > n_c * n_t THEN 0 END AS act
              FROM ct JOIN t USING (term) JOIN c USING (entity) JOIN kk USING (kind)),
        mk AS (SELECT rid, term, max(act) AS act FROM w JOIN b USING (entity, term) WHERE act IS NOT NULL GROUP BY 1, 2),
        z AS (SELECT rid, regexp_extract_all(text, '\p{{L}}+') AS f, string_split_regex(text, '\p{{L}}+') AS s FROM d WHERE rid IN (SELECT rid FROM mk)),
        y AS (SELECT rid, unnest(range(1, len(f) + 1)) AS i, unnest(f) AS term, unnest(s[1:len(f)]) AS gap FROM z),
        x AS (SELECT rid, term, sum(length(gap) + length(term)) OVER (PARTITION BY rid ORDER BY i) - length(term) AS st FROM y),
        sp AS (SELECT rid, st, k, en, kind FROM h UNION ALL
               SELECT x.rid, st, 4, st + length(x.term), CASE act WHEN 1 THEN 'remove' ELSE 'generalise' END FROM x JOIN mk ON mk.rid = x.rid AND mk.term = x.term
               WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.rid = x.rid AND h.st < x.st + length(x.term) AND x.st < h.en)),
        r AS (SELECT rid, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2, count(*) FILTER (k = 3) AS n3,
                     string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, k) FILTER (k < 4) AS base, string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, k) AS spans FROM sp GROUP BY 1)
        SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_email, coalesce(n1, 0)::BIGINT AS n_ip, coalesce(n2, 0)::BIGINT AS n_card, coalesce(n3, 0)::BIGINT AS n_phone,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN r USING (rid)""",
    "op13_glr_repair": rf"""
        WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind FROM conversations),
        m AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                     unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM d),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, count(*) OVER (PARTITION BY conv_id) AS n, left(role, 1) AS initial,
                     CASE WHEN NOT regexp_matches(text, '[^{_BLANKS}]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 THEN 'd'
                          WHEN NOT regexp_matches(text, '[.!?][{_BLANKS}]*$') THEN 't' ELSE '' END AS fault FROM m),
        f AS MATERIALIZED (SELECT *, CASE fault WHEN 't' THEN 3 ELSE 0 END AS more, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM o),
        s AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, n, '000000000' AS e, NULL::VARCHAR AS sy, NULL::VARCHAR AS u, NULL::VARCHAR AS a FROM f UNION ALL {_repair_step()}),
        won AS (SELECT conv_id, least(e, a, {_add("least(u, " + ", ".join(_add(v, 3, "I") for v in ("e", "sy", "a")) + ")", 3, "I")}) AS best FROM s WHERE i = n),
        l AS (SELECT conv_id, j, best[9 + j] AS letter, length(regexp_replace(best[10:9 + j], 'I', '', 'g')) AS i, length(regexp_replace(best[10:9 + j], 'D', '', 'g')) AS place FROM (SELECT *, unnest(range(1, length(best) - 8)) AS j FROM won)),
        k AS (SELECT l.conv_id, j, letter, place, role, text, max(CASE WHEN place = 1 AND letter = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS sys
              FROM l LEFT JOIN f ON l.conv_id IS NOT DISTINCT FROM f.conv_id AND l.i = f.i AND letter <> 'I' WHERE letter <> 'D'),
        t AS (SELECT conv_id, string_agg(CASE letter WHEN 'K' THEN role ELSE CASE (place + sys) % 2 WHEN 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE letter WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS repaired FROM k GROUP BY 1),
        c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
                     count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1)
        SELECT x.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
               coalesce(best[1:9]::BIGINT, 0) AS cost, coalesce(best[10:], '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) x LEFT JOIN c ON x.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN won ON x.conv_id IS NOT DISTINCT FROM won.conv_id LEFT JOIN t ON x.conv_id IS NOT DISTINCT FROM t.conv_id""",
}
