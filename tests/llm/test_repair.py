import hashlib
import itertools
import re
import zlib

import pytest

from codeloom.llm import repair as R

SPACE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            out += [(c, t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def plain(rows):
    """Searches all edits of one conversation: every letter for each row and up to three inserts before each."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    faults, seen = [], set()
    for _, _, role, text in rows:
        t = text.rstrip(SPACE)
        faults.append("b" if not t else "d" if (role, text) in seen else "t" if t[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {}  # roles so far as (initials folded to what matters) -> (cost, audit, lines)

    def fold(s):
        if not s:
            return ""
        return "s" if s == "s" else "u" if s[-1] == "u" else "a"

    ok = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}

    def inserts(states):
        for _ in range(3):
            new = dict(states)
            for s, (c, a, lines) in states.items():
                for x, name in (("u", "user"), ("a", "assistant")):
                    if (s, x) in ok:
                        v = (c + 3, a + "I", [*lines, name + ":"])
                        if x not in new or v[:2] < new[x][:2]:
                            new[x] = v
            states = new
        return states

    best = {"": (0, "", [])}
    for (_, _, role, text), f in zip(rows, faults):
        before, best = inserts(best), {}

        def put(s, v):
            if s not in best or v[:2] < best[s][:2]:
                best[s] = v

        for s, (c, a, lines) in before.items():
            put(s, (c + 4, a + "D", lines))
            if f not in ("b", "d") or not f:
                more = 3 if f == "t" else 0
                if (s, role[:1]) in ok:
                    put(role[0], (c + more, a + "K", [*lines, f"{role}:{text}"]))
                for x, name in (("u", "user"), ("a", "assistant")):
                    if (s, x) in ok:
                        put(x, (c + more + 3, a + "R", [*lines, f"{name}:{text}"]))
    best = inserts(best)
    cost, audit, lines = min((v for s, v in best.items() if s in ("", "a")), key=lambda v: v[:2])
    turns = {r[1] for r in rows if r[1] is not None}
    pairs = [x[2][:1] + y[2][:1] for x, y in itertools.pairwise(rows)]
    return ((max(turns) - min(turns) + 1 - len(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def brute(rows):
    out = {c: [] for c, *_ in rows}
    for r in plain_damage(rows):
        out[r[0]].append(r)
    return sorted([(c, *plain(x)) for c, x in out.items()], key=str)


def exhaustive(initials, faults):
    """Cheapest (cost, audit) over all edit strings with at most two inserts in a row."""
    best = None
    for letters in itertools.product("DKRS", repeat=len(initials)):  # R: to user, S: to assistant
        if any(f in "bd" and f and x != "D" for x, f in zip(letters, faults)):
            continue
        for ins in itertools.product(["", "u", "a", "ua", "au"], repeat=len(initials) + 1):
            roles, audit, cost = ins[0], "I" * len(ins[0]), 3 * len(ins[0])
            for i, x in enumerate(letters):
                roles += {"D": "", "K": initials[i], "R": "u", "S": "a"}[x] + ins[i + 1]
                audit += x.replace("S", "R") + "I" * len(ins[i + 1])
                cost += {"D": 4, "K": 0}.get(x, 3) + (3 if x != "D" and faults[i] == "t" else 0) + 3 * len(ins[i + 1])
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


@pytest.mark.parametrize("initials", ["", "s", "a", "su", "us", "aa", "uu", "sa", "sua", "uas", "x", "suu"])
def test_machine_against_all_edits(initials):
    machine = R.Machine()
    for faults in itertools.product(["", "t", "b"], repeat=len(initials)):
        c = R.Conversation(machine)
        for i, (x, f) in enumerate(zip(initials, faults)):
            c.add(i, {"s": "system", "u": "user", "a": "assistant"}.get(x, x), f"text {i}", f == "b", False, f == "t")
        got = c.result(1)
        assert (got[6], got[7]) == exhaustive(initials, faults), (initials, faults)


def sample():
    rows, roles = [], ["system", "user", "assistant", "tool", None, ""]
    texts = ["Hello there.", "What is it?", "no end", "", None, " \n\t", "Hello there.", "ünï ☃!", "x" * 3000 + "."]
    for c in range(60):
        for t in range(c % 9):
            k = zlib.crc32(f"{c}/{t}".encode())
            rows.append((c, t * (1 + c % 2), roles[k % (3 if c % 3 else 6)], texts[(k >> 8) % len(texts)]))
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Yes."), (7, None, "user", "Null turn."), (7, None, "user", "Null turn."), (500, None, "system", "Only."), rows[40], rows[41]]
    return rows


def test_repair_against_plain(spark):
    rows = sample()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted([tuple(r) for r in R.repair_digest(df.selectExpr("*", "1 AS live_x", "turn AS position")).collect()], key=str)
    assert got == brute(rows)


def test_repaired_rows(spark):
    rows = sample()
    df = R.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    want = {r.conv_id: (r.repaired_sha256, r.n_repaired) for r in R.repair(df).collect()}
    parts = {}
    for r in sorted(R.repaired_rows(df).collect(), key=lambda r: (str(r.conv_id), r.position)):
        parts.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for c, (sha, n) in want.items():
        lines = parts.get(c, [])
        assert len(lines) == n and hashlib.sha256("\n".join(lines).encode()).hexdigest() == sha


def test_repair_long_and_empty(spark):
    df = spark.range(20000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('Turn ', id, '.') AS text")
    r = R.repair(df).first()
    assert (r.cost, r.audit, r.n_repaired) == (0, "K" * 20000, 20000)
    assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{'ua'[i % 2] == 'u' and 'user' or 'assistant'}:Turn {i}." for i in range(20000)).encode()).hexdigest()
    assert R.repair_digest(df.limit(0)).count() == 0
