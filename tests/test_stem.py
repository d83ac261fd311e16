import random

from pyspark.sql import functions as F

from codeloom.functions import stem as S

#: The public vocabulary sample of the stemmer: runs of words and their stems.
SAMPLE = """consign consigned consigning consignment:consign consist consisted consistency consistent consistently consisting consists:consist consolation consolations:consol
consolatory:consolatori console consoled consoles:consol consolidate consolidated consolidating:consolid consoling consolingly consols:consol consonant:conson consort consorted consorting:consort
conspicuous conspicuously:conspicu conspiracy:conspiraci conspirator conspirators conspire conspired conspiring:conspir constable constables:constabl constance constancy:constanc constant:constant
knack:knack knackeries:knackeri knacks:knack knag:knag knave knaves:knave knavish:knavish kneaded kneading:knead knee knees:knee kneel kneeled kneeling kneels:kneel knell:knell knelt:knelt knew:knew
knick:knick knif:knif knife:knife knight knights knightly:knight knit knits knitted knitting:knit knives:knive knob knobs:knob knock knocked knocking knocks:knock knocker knockers:knocker knopp:knopp knot knots:knot"""
#: Words that each rule of the description names.
RULES = {
    "caresses": "caress", "ponies": "poni", "ties": "tie", "cries": "cri", "gas": "gas", "this": "this", "gaps": "gap", "kiwis": "kiwi", "hopping": "hop", "hoped": "hope", "hopping ": "hopping ", "luxuriated": "luxuri",
    "cry": "cri", "by": "by", "say": "say", "rational": "ration", "generate": "generat", "generic": "generic", "communism": "communism", "arsenal": "arsenal", "skis": "ski", "skies": "sky", "dying": "die", "news": "news",
    "inning": "inning", "innings": "inning", "proceed": "proceed", "proceeds": "proceed", "agreed": "agre", "feed": "feed", "plastered": "plaster", "sing": "sing", "relational": "relat", "conditional": "condit",
    "valenci": "valenc", "digitizer": "digit", "radically": "radic", "differently": "differ", "vileli": "vile", "analogously": "analog", "vietnamization": "vietnam", "predication": "predic", "operator": "oper", "feudalism": "feudal",
    "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous", "formality": "formal", "sensitivity": "sensit", "sensibility": "sensibl", "triplicate": "triplic", "formative": "format", "formalize": "formal",
    "electricity": "electr", "electrical": "electr", "hopeful": "hope", "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin", "adjustable": "adjust", "defensible": "defens",
    "irritant": "irrit", "replacement": "replac", "adjustment": "adjust", "dependent": "depend", "adoption": "adopt", "activate": "activ", "homologous": "homolog", "effective": "effect", "probate": "probat", "rate": "rate",
    "cease": "ceas", "controll": "control", "roll": "roll", "beauty": "beauti", "beautiful": "beauti", "youth": "youth", "boyish": "boyish", "flying": "fli", "syzygy": "syzygi", "ax": "ax", "a": "a", "": "",
}


def plain(word):
    """The description followed step by step on a list of letters."""
    if len(word) <= 2:
        return word
    if word in S.IRREGULAR:
        return S.IRREGULAR[word]
    if word in S.INVARIANT:
        return word
    w = list(word)
    if w[0] == "y":
        w[0] = "Y"
    i = 1
    while i < len(w):
        if w[i] == "y" and w[i - 1] in "aeiouy":
            w[i] = "Y"
            i += 1
        i += 1
    w = "".join(w)
    vowel = lambda c: c in "aeiouy"

    def region(start):
        for i in range(start, len(w) - 1):
            if vowel(w[i]) and not vowel(w[i + 1]):
                return i + 2
        return len(w)

    r1 = next((len(x) for x in S.REGION_STARTS if w.startswith(x)), None)
    r1 = region(0) if r1 is None else r1
    r2 = region(r1)

    def short_end(x):
        if len(x) == 2:
            return vowel(x[0]) and not vowel(x[1])
        return len(x) > 2 and not vowel(x[-3]) and vowel(x[-2]) and not vowel(x[-1]) and x[-1] not in "wxY"

    def longest(x, endings):
        return max((e for e in endings if x.endswith(e)), key=len, default="")

    e = longest(w, ["sses", "ied", "ies", "us", "ss", "s"])
    if e == "sses":
        w = w[:-2]
    elif e in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif e == "s" and any(map(vowel, w[:-2])):
        w = w[:-1]
    if w in S.INVARIANT_THEN:
        return w
    e = longest(w, ["eed", "eedly", "ed", "edly", "ing", "ingly"])
    if e in ("eed", "eedly"):
        if len(w) - len(e) >= r1:
            w = w[: -len(e)] + "ee"
    elif e and any(map(vowel, w[: -len(e)])):
        w = w[: -len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
            w = w[:-1]
        elif short_end(w) and r1 >= len(w):
            w += "e"
    if w[-1] in "yY" and len(w) > 2 and not vowel(w[-2]):
        w = w[:-1] + "i"
    e = longest(w, S.STEP_2)
    if e and len(w) - len(e) >= r1 and (e != "ogi" or w[:-3].endswith("l")) and (e != "li" or w[-3] in S.LI_ENDING):
        w = w[: -len(e)] + S.STEP_2[e]
    e = longest(w, S.STEP_3)
    if e and len(w) - len(e) >= (r2 if e == "ative" else r1):
        w = w[: -len(e)] + S.STEP_3[e]
    e = longest(w, S.STEP_4)
    if e and len(w) - len(e) >= r2 and (e != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(e)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not short_end(w[:-1])) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def stems(spark, some):
    df = spark.createDataFrame([(w,) for w in some], "w string")
    return {r.w: r.s for r in df.select("w", S.stem(F.col("w")).alias("s")).collect()}


def test_public_sample(spark):
    want = dict(_pairs())
    got = stems(spark, want)
    assert {w: (got[w], s) for w, s in want.items() if got[w] != s} == {}


def _pairs():
    waiting = []
    for x in SAMPLE.split():
        word, _, stem = x.partition(":")
        waiting.append(word)
        if stem:
            yield from ((w, stem) for w in waiting)
            waiting = []
    yield from RULES.items()


def test_against_plain(spark):
    rnd = random.Random(2)
    endings = [*S.STEP_2, *S.STEP_3, *S.STEP_4, "ed", "ing", "s", "ies", "ied", "eed", "edly", "ingly", "eedly", "sses", "y", "e", "ll", "ly", ""]
    some = {"".join(rnd.choice("aeiouyybcdghlmnrstwxz") for _ in range(rnd.randrange(0, 7))) + rnd.choice(endings) + rnd.choice(["", "", "s", "e", "ly"]) for _ in range(6000)}
    some |= {w for w, _ in _pairs()}
    got = stems(spark, some)
    assert {w: (got[w], plain(w)) for w in some if got[w] != plain(w)} == {}
    # The cheap look never turns away a word that has the stem.
    df = spark.createDataFrame([(w, s) for w, s in got.items()], "w string, s string")
    for s in sorted(set(got.values()))[::60] + ["die", "ti", "a"]:
        assert df.filter((F.col("s") == s) & ~S.may_have_stem(F.col("w"), [s])).count() == 0


def test_apostrophes(spark):
    assert stems(spark, ["'tis", "dog's", "dogs'", "dogs's'"]) == {"'tis": "tis", "dog's": "dog", "dogs'": "dog", "dogs's'": "dog"}
