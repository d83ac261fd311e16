"""The Snowball English stemmer ("Porter 2") as column expressions, and the English stop list.

A word's regions R1 and R2 are kept as offsets from its start: steps only change its end, so they
stay valid. Every step looks for the longest of its endings first and only then asks whether
that ending lies in the region. `let` binds a value once, so that a step may use it several times
without the expression growing.

Words are expected in lower case. Words of one or two letters stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The stop list.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this "
    "that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into "
    "through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such "
    "no nor not only own same so than too very s t can will just don should now"
).split()

#: Whole words with a stem of their own, words that stay, and words that stay after the first step.
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
INVARIANT = "sky news howe atlas cosmos bias andes".split()
INVARIANT_THEN = "inning outing canning herring earring proceed exceed succeed".split()
#: Beginnings after which R1 starts.
REGION_STARTS = "gener commun arsen".split()
#: Endings and what they become. `li` and `ogi` go by the letter before them; `ative` needs R2.
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()
LI_ENDING = "cdeghkmnrt"

VOWEL, OTHER = "[aeiouy]", "[^aeiouy]"
#: A short syllable at the end of a word.
SHORT = f"(?:{OTHER}{VOWEL}[^aeiouywxY]|^{VOWEL}{OTHER})$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def _ending(w: Column, endings) -> Column:
    """The longest of the endings that the word has, or an empty string."""
    return F.regexp_extract(w, f"(?:{'|'.join(endings)})$", 0)


def _without(w: Column, end: Column, more: Column | str = "") -> Column:
    return F.concat(F.left(w, F.length(w) - F.length(end)), more if isinstance(more, Column) else F.lit(more))


def _has_vowel(x: Column) -> Column:
    return x.rlike(VOWEL)


def _mapped(rules: dict[str, str], end: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in rules.items() for x in kv]), end)


def _step_1a(w: Column) -> Column:
    def by(end: Column) -> Column:
        rest = _without(w, end)
        return (
            F.when(end == "sses", _without(w, end, "ss"))
            .when(end.isin("ied", "ies"), F.concat(rest, F.when(F.length(rest) > 1, "i").otherwise("ie")))
            .when((end == "s") & _has_vowel(F.left(w, F.length(w) - 2)), rest)
            .otherwise(w)
        )

    return let(_ending(w, ["sses", "ied", "ies", "us", "ss", "s"]), by)


def _step_1b(w: Column, r1: Column) -> Column:
    def tidied(x: Column) -> Column:
        short = (F.length(x) <= r1) & x.rlike(SHORT)
        return F.when(x.rlike("(?:at|bl|iz)$"), F.concat(x, F.lit("e"))).when(x.rlike(r"(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), _without(x, F.lit("."))).when(short, F.concat(x, F.lit("e"))).otherwise(x)

    def by(end: Column) -> Column:
        rest = _without(w, end)
        return (
            F.when(end.isin("eed", "eedly"), F.when(F.length(rest) >= r1, F.concat(rest, F.lit("ee"))).otherwise(w))
            .when((end != "") & _has_vowel(rest), let(rest, tidied))
            .otherwise(w)
        )

    return let(_ending(w, ["eed", "eedly", "ed", "edly", "ing", "ingly"]), by)


def _step_1c(w: Column) -> Column:
    return F.regexp_replace(w, f"(?<=.{OTHER})[yY]$", "i")


def _step_2(w: Column, r1: Column) -> Column:
    def by(end: Column) -> Column:
        rest = _without(w, end)
        fits = F.when(end == "ogi", rest.endswith("l")).when(end == "li", rest.rlike(f"[{LI_ENDING}]$")).otherwise(True)
        return F.when((end != "") & (F.length(rest) >= r1) & fits, F.concat(rest, _mapped(STEP_2, end))).otherwise(w)

    return let(_ending(w, STEP_2), by)


def _step_3(w: Column, r1: Column, r2: Column) -> Column:
    def by(end: Column) -> Column:
        rest = _without(w, end)
        region = F.when(end == "ative", r2).otherwise(r1)
        return F.when((end != "") & (F.length(rest) >= region), F.concat(rest, _mapped(STEP_3, end))).otherwise(w)

    return let(_ending(w, STEP_3), by)


def _step_4(w: Column, r2: Column) -> Column:
    def by(end: Column) -> Column:
        rest = _without(w, end)
        return F.when((end != "") & (F.length(rest) >= r2) & ((end != "ion") | rest.rlike("[st]$")), rest).otherwise(w)

    return let(_ending(w, STEP_4), by)


def _step_5(w: Column, r1: Column, r2: Column) -> Column:
    n = F.length(w) - 1
    e = w.endswith("e") & ((n >= r2) | ((n >= r1) & ~F.left(w, n).rlike(SHORT)))
    return F.when(e | (w.endswith("ll") & (n >= r2)), F.left(w, n)).otherwise(w)


def stem(word: Column) -> Column:
    """The stem of a lower-case word."""

    def regions(w: Column) -> Column:
        r1 = F.length(F.regexp_extract(w, f"^(?:{'|'.join(REGION_STARTS)}|.*?{VOWEL}{OTHER})", 0))
        return let(F.when(r1 > 0, r1).otherwise(F.length(w)), lambda r: let(_second(w, r), lambda q: steps(w, r, q)))

    def _second(w: Column, r1: Column) -> Column:
        more = F.length(F.regexp_extract(F.substring(w, r1 + 1, F.length(w)), f"^.*?{VOWEL}{OTHER}", 0))
        return F.when(more > 0, r1 + more).otherwise(F.length(w))

    def steps(w: Column, r1: Column, r2: Column) -> Column:
        def rest(x: Column) -> Column:
            for step in (lambda v: _step_1b(v, r1), _step_1c, lambda v: _step_2(v, r1), lambda v: _step_3(v, r1, r2), lambda v: _step_4(v, r2), lambda v: _step_5(v, r1, r2)):
                x = let(x, step)
            return x

        return let(_step_1a(w), lambda x: F.when(x.isin(INVARIANT_THEN), x).otherwise(rest(x)))

    def marked(w: Column) -> Column:
        """A y that is a consonant as Y: at the start, or after a vowel (of which a Y is none)."""
        return F.regexp_replace(F.regexp_replace(w, "^y", "Y"), f"({VOWEL})y", "$1Y")

    plain = F.regexp_replace(F.regexp_replace(word, "^'", ""), "'(?:s'?)?$", "")
    regular = let(marked(plain), lambda w: F.translate(regions(w), "Y", "y"))
    return F.when(F.length(word) <= 2, word).when(word.isin(INVARIANT), word).otherwise(F.coalesce(_mapped_or_null(word), regular))


def _mapped_or_null(word: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in IRREGULAR.items() for x in kv]), word)


def may_have_stem(word: Column, stems: list[str]) -> Column:
    """Whether a word can have one of the stems at all: a stem keeps the first two letters, but for y and i. Cheap, and never wrong in saying no."""
    first = F.translate(F.left(word, F.lit(2)), "y", "i")
    heads = sorted({s[:2].replace("y", "i") for s in stems})
    one, two = [h for h in heads if len(h) < 2], [h for h in heads if len(h) == 2]
    return first.isin(two) | F.left(first, F.lit(1)).isin(one) if one else first.isin(two)
