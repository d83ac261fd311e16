import collections
import hashlib
import math
import random
import re
from fractions import Fraction

import pytest
import regex

from codeloom.llm import privacy as P

#: The patterns as they are asked for.
ASKED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def plain_base(text):
    out = []
    for k, (kind, p) in enumerate(ASKED.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")) or kind == "card" and 14 <= len(d) <= 19 and luhn(d) or kind == "phone" and 10 <= len(d) <= 15:
                out.append((m.start(), k, m.end(), kind, m.group()))
    return sorted(out)


def entity(kind, value):
    return f"{kind}:{value.lower() if kind == 'email' else value if kind == 'ip' else re.sub('[^0-9]', '', value)}"


def plain(rows):
    texts = ["" if r[1] is None else r[1] for r in rows]
    base = [plain_base(t) for t in texts]
    n_c, n_k, n_t = collections.Counter(), collections.Counter(), collections.Counter()
    together, witnesses, near = collections.defaultdict(set), collections.defaultdict(set), [collections.defaultdict(set) for _ in rows]
    for i, (t, spans) in enumerate(zip(texts, base)):
        n_t.update(set(regex.findall(r"\p{L}{3,}", t)))
        n_k.update({s[3] for s in spans})
        n_c.update({(entity(s[3], s[4]), s[3]) for s in spans})
        for s in spans:
            left = t[: s[0]].split("\n")[-1].strip(" ")
            right = t[s[2] :].split("\n")[0].strip(" ")
            around = " ".join([*re.split(r"[ \t\n\x0b\f\r]+", left)[-P.WINDOW :], "\0", *re.split(r"[ \t\n\x0b\f\r]+", right)[: P.WINDOW]])
            for w in set(regex.findall(r"\p{L}{3,}", around)):
                e = (entity(s[3], s[4]), s[3])
                together[e, w].add(i)
                witnesses[e, w].add(around)
                near[i][w].add(e)
    n, bad = len(rows), {}
    for (e, w), docs in together.items():
        if len(witnesses[e, w]) >= P.SUPPORT:
            left = -math.log2(len(docs) / n_t[w])
            more_than_kind = Fraction(n * len(docs), n_c[e] * n_t[w]) > Fraction(n, n_k[e[1]])
            if left <= P.REMOVE_BITS or left <= P.GENERALISE_BITS and more_than_kind:
                bad[e, w] = 1 if left <= P.REMOVE_BITS else 0
    out = []
    for i, (r, t, spans) in enumerate(zip(rows, texts, base)):
        more = []
        for w, es in near[i].items():
            if acts := [bad[e, w] for e in es if (e, w) in bad]:
                for m in regex.finditer(rf"(?<!\p{{L}}){w}(?!\p{{L}})", t):
                    if not any(s[0] < m.end() and m.start() < s[2] for s in spans):
                        more.append((m.start(), 4, m.end(), ("generalise", "remove")[max(acts)], w))
        said = lambda ss: ",".join(f"{k}:{a}:{b}" for a, _, b, k, _ in ss)
        out.append((r[0], *[sum(s[3] == k for s in spans) for k in P.KINDS], hashlib.sha256(said(spans).encode()).hexdigest(), said(sorted(spans + more))))
    return sorted(out, key=str)


CASES = [
    "a@b.c", "x@y.z_foo@bar.com", "..@a.b", "a@b", "é.ü@x.de mail me_at%+-@host-1.co.uk.", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "1.2.3", "256.1.1.1 0255.1.1.1 255.255.255.255", "01.02.03.04x",
    "4111 1111 1111 1111", "4111-1111--1111-1111", "41111111111111110000000000", "4111111111111111 4111111111111111", "+1 (212) 555-0199", "+1-2-3", "+49 (0)30 1234567890123", "++1 212 555 0199",
    "+1 212 555 0199 +1 212 555 0199", "call+12125550199now", "☃\U0001f600 a@b.cd 10.0.0.1", "9" * 300, "1." * 500, "1 " * 3000, "a" * 20000, "a.b@" * 500, "+1" + "(" * 500, "x@" + "y." * 2000 + "z", None, "", " \n",
]


def corpus():
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    text = lambda n: " ".join(rnd.choices(words, k=n))
    rows = []
    for i in range(60):
        rows.append((len(rows), f"{text(8)} Zorblax {text(3)} zed.one@mail.example.org {text(3)} Quux. {text(4)}\nZorblax again {text(4)}"))
        rows.append((len(rows), f"{text(20)} {'Quux' if i % 3 else 'other'} {text(5)}"))
    for i in range(12):
        rows.append((len(rows), f"{text(5)} Halfway 4111 1111 1111 1111 {text(5)}"))
        rows += [(len(rows) + k, f"{text(5)} Halfway {text(5)}") for k in range(2)]
    cards = [d for k in range(600) if luhn(d := str(5105105105100000 + k))]
    rows += [(len(rows) + k, f"{text(5)} {d} {text(5)}") for k, d in enumerate(cards)]
    rows += [(1000 + i, f"copied passage Snowdrop near 10.1.2.3 and end {i // 50}") for i in range(100)]
    return rows


def test_base_spans(spark):
    rows = [(i, t) for i, t in enumerate(CASES)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: [tuple(s) for s in r.s] for r in df.select("doc_id", P.base_spans(P.F.coalesce("text", P.F.lit(""))).alias("s")).collect()}
    for i, t in rows:
        assert got[i] == plain_base(t or ""), t


def test_base_spans_fuzz(spark):
    rnd = random.Random(9)
    rows = [(i, "".join(rnd.choice(["1", "23", "4", ".", "@", "+", " ", "-", "(", ")", "a", "Z", "_", "%", "\n", "é", "255", "4111111111111111"]) for _ in range(rnd.randrange(60)))) for i in range(3000)]
    got = {r.doc_id: [tuple(s) for s in r.s] for r in spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", P.base_spans(P.F.col("text")).alias("s")).collect()}
    assert all(got[i] == plain_base(t) for i, t in rows)


def test_digest_against_plain(spark):
    rows = corpus() + [(2000 + i, t) for i, t in enumerate(CASES)] + [(None, "null id a@b.cd"), (None, None), (5, "again 10.1.2.3 x"), (5, "again 10.1.2.3 x")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, spans string, key int")
    got = sorted(map(tuple, P.privacy_digest(df).collect()), key=str)
    assert got == plain(rows)
    marked = {k for r in got for k in re.findall("generalise|remove", r[6])}
    assert marked == {"generalise", "remove"}
    assert all(bool(r[6]) == (r[0] % 2 == 0) for r in got if r[0] is not None and r[0] < 120 and r[0] != 5)


def test_sanitise(spark):
    rows = corpus()
    got = {r.doc_id: r.text for r in P.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "[EMAIL]" in got[0] and "Zorblax" not in got[0] and "zed.one" not in got[0]
    assert got[1] == rows[1][1]
    assert "[CARD]" in got[120] and "Halfway" not in got[120] and "[TERM]" in got[120]
    assert got[1000] == rows[-100][1].replace("10.1.2.3", "[IP]")


def test_empty(spark):
    assert P.privacy_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_python_in_plan(spark):
    df = P.privacy_digest(spark.createDataFrame(corpus()[:50], "doc_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("digits,ok", [("4111111111111111", True), ("4111111111111112", False)])
def test_luhn(spark, digits, ok):
    assert spark.range(1).select(P.luhn(P.F.lit(digits))).first()[0] is ok
