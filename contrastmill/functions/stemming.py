"""English stemming (the published Porter2 rules) as one column expression.

Apply it to words already counted, one row per group and word, so that it runs on vocabulary-sized
data. ``stem`` does so in Arrow batches. ``stem_expression`` is the same rules as an expression of
the JVM, which takes far longer, as Spark interprets it: each rule needs the word the one before it
made several times over, so intermediate words are bound to lambda variables. It remains for the
words in which its regular expressions see ends of lines or halves of characters.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from contrastmill.functions.binding import bind

# The word lists and suffix tables of the published algorithm.
WHOLE_WORDS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_PLURAL = (
    "inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed",
)
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent",
    "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous",
    "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic",
    "ical": "ic", "ful": "", "ness": "", "ative": "",
}
STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism",
    "ate", "iti", "ous", "ive", "ize", "ion",
)

_VOWEL = "[aeiouy]"
_OTHER = "[^aeiouy]"
_SHORT_END = f"({_OTHER}{_VOWEL}[^aeiouywxY]|^{_VOWEL}{_OTHER})$"


def _suffix(word: Column, endings) -> Column:
    """Longest of the endings the word has, else the empty string."""
    return F.regexp_extract(word, f"({'|'.join(endings)})$", 1)


def _cut(word: Column, suffix: Column) -> Column:
    return F.substr(word, F.lit(1), F.length(word) - F.length(suffix))


def _swap(suffix: Column, table: dict[str, str]) -> Column:
    chain = F.lit("")
    for ending, new in table.items():
        chain = F.when(suffix == ending, new).otherwise(chain)
    return chain


def _after_vowel_and_other(word: Column) -> Column:
    """How many letters up to the first vowel followed by another letter; all without one."""
    at = F.regexp_instr(word, F.lit(_VOWEL + _OTHER))
    return F.when(at > 0, at + 1).otherwise(F.length(word))


def _region1(word: Column) -> Column:
    fixed = F.length(F.regexp_extract(word, "^(gener|commun|arsen)", 1))
    return F.when(fixed > 0, fixed).otherwise(_after_vowel_and_other(word))


def _region2(word: Column, r1: Column) -> Column:
    return r1 + _after_vowel_and_other(F.substr(word, r1 + 1))


def _within(word: Column, suffix: Column, region: Column) -> Column:
    return F.length(word) - F.length(suffix) >= region


def _plural(w: Column) -> Column:
    """Steps 0 and 1a: possessives and plurals."""

    def rule(w: Column) -> Column:
        def ending(s: Column) -> Column:
            stem = _cut(w, s)
            return (
                F.when(s == "sses", F.concat(stem, F.lit("ss")))
                .when(s.isin("ied", "ies"), F.concat(stem, F.when(F.length(stem) > 1, "i").otherwise("ie")))
                .when((s == "s") & w.rlike(f"{_VOWEL}.+s$"), stem)
                .otherwise(w)
            )

        return bind(_suffix(w, ("sses", "ied", "ies", "us", "ss", "s")), ending)

    return bind(F.regexp_replace(w, "('s'|'s|')$", ""), rule)


def _past(w: Column, r1: Column) -> Column:
    """Step 1b: past and progressive forms."""

    def mended(stem: Column) -> Column:
        short = (r1 >= F.length(stem)) & stem.rlike(_SHORT_END)
        return (
            F.when(stem.rlike("(at|bl|iz)$"), F.concat(stem, F.lit("e")))
            .when(stem.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), F.substr(stem, F.lit(1), F.length(stem) - 1))
            .when(short, F.concat(stem, F.lit("e")))
            .otherwise(stem)
        )

    def ending(s: Column) -> Column:
        stem = _cut(w, s)
        return (
            F.when(s.isin("eed", "eedly"), F.when(_within(w, s, r1), F.concat(stem, F.lit("ee"))).otherwise(w))
            .when((s != "") & stem.rlike(_VOWEL), bind(stem, mended))
            .otherwise(w)
        )

    return bind(_suffix(w, ("eedly", "ingly", "edly", "eed", "ing", "ed")), ending)


def _final_y(w: Column) -> Column:
    """Step 1c."""
    return F.regexp_replace(w, f"^(.+{_OTHER})[yY]$", "$1i")


def _step2(w: Column, r1: Column) -> Column:
    def ending(s: Column) -> Column:
        stem = _cut(w, s)
        allowed = (
            F.when(s == "li", stem.rlike("[cdeghkmnrt]$")).when(s == "ogi", stem.rlike("l$")).otherwise(s != "")
        )
        return F.when(_within(w, s, r1) & allowed, F.concat(stem, _swap(s, STEP2))).otherwise(w)

    return bind(_suffix(w, STEP2), ending)


def _step3(w: Column, r1: Column, r2: Column) -> Column:
    def ending(s: Column) -> Column:
        allowed = F.when(s == "ative", _within(w, s, r2)).otherwise(s != "")
        return F.when(_within(w, s, r1) & allowed, F.concat(_cut(w, s), _swap(s, STEP3))).otherwise(w)

    return bind(_suffix(w, STEP3), ending)


def _step4(w: Column, r2: Column) -> Column:
    def ending(s: Column) -> Column:
        stem = _cut(w, s)
        allowed = F.when(s == "ion", stem.rlike("[st]$")).otherwise(s != "")
        return F.when(_within(w, s, r2) & allowed, stem).otherwise(w)

    return bind(_suffix(w, STEP4), ending)


def _step5(w: Column, r1: Column, r2: Column) -> Column:
    def ending(s: Column) -> Column:
        stem = _cut(w, s)
        drop_e = _within(w, s, r2) | (_within(w, s, r1) & ~stem.rlike(_SHORT_END))
        return (
            F.when((s == "e") & drop_e, stem)
            .when((s == "l") & _within(w, s, r2) & stem.rlike("l$"), stem)
            .otherwise(w)
        )

    return bind(_suffix(w, ("e", "l")), ending)


def _regular(word: Column) -> Column:
    # A y at the start or after a vowel is a consonant, written Y while the rules run.
    marked = F.regexp_replace(F.regexp_replace(word, "^'", ""), "^y", "Y")
    marked = F.regexp_replace(marked, "([aeiouy])y", "$1Y")

    def with_regions(w: Column, r1: Column, r2: Column) -> Column:
        def rest(w: Column) -> Column:
            steps = (
                lambda w: _past(w, r1), _final_y, lambda w: _step2(w, r1), lambda w: _step3(w, r1, r2),
                lambda w: _step4(w, r2), lambda w: _step5(w, r1, r2),
            )
            for step in steps:
                w = bind(w, step)
            return w

        return bind(_plural(w), lambda p: F.when(p.isin(*KEPT_AFTER_PLURAL), p).otherwise(rest(p)))

    stem = bind(
        marked,
        lambda w: bind(_region1(w), lambda r1: bind(_region2(w, r1), lambda r2: with_regions(w, r1, r2))),
    )
    return F.translate(stem, "Y", "y")


def stem_expression(word: Column) -> Column:
    """Stem of the lower-cased word, all in the JVM."""

    def choose(w: Column) -> Column:
        chain = F.when(F.length(w) <= 2, w)
        for whole, short in WHOLE_WORDS.items():
            chain = chain.when(w == whole, short)
        return chain.otherwise(_regular(w))

    return bind(F.lower(word), choose)


# Words with characters that end a line for Java, or that it counts as two.
_UNUSUAL = "[\\n\\r\\x{85}\\x{2028}\\x{2029}\\x{10000}-\\x{10FFFF}]"

_VOWEL_OTHER, _HAS_VOWEL = re.compile(_VOWEL + _OTHER), re.compile(_VOWEL)
_FIXED, _SHORT = re.compile("gener|commun|arsen"), re.compile(_SHORT_END)
_PLURAL_S, _VOWEL_Y = re.compile(f"{_VOWEL}.+s$"), re.compile("([aeiouy])y")
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")


def _by_length(endings) -> tuple[str, ...]:
    return tuple(sorted(endings, key=len, reverse=True))


_PAST, _ENDS2, _ENDS3, _ENDS4 = map(_by_length, (("eedly", "ingly", "edly", "eed", "ing", "ed"), STEP2, STEP3, STEP4))


def _ending(w: str, endings: tuple[str, ...]) -> str:
    return next((e for e in endings if w.endswith(e)), "") if w.endswith(endings) else ""


def _after(w: str, first: int) -> int:
    hit = _VOWEL_OTHER.search(w, first)
    return hit.end() if hit else len(w)


def stem_word(w: str) -> str:
    """Stem of a word in lower case, without the characters of ``_UNUSUAL``."""
    if len(w) <= 2:
        return w
    if w in WHOLE_WORDS:
        return WHOLE_WORDS[w]
    w = w.removeprefix("'")
    if w.startswith("y"):
        w = "Y" + w[1:]
    w = _VOWEL_Y.sub(r"\1Y", w)
    fixed = _FIXED.match(w)
    r1 = fixed.end() if fixed else _after(w, 0)
    r2 = _after(w, r1) if r1 < len(w) else r1
    w = w.removesuffix(_ending(w, ("'s'", "'s", "'")))
    # plurals
    if w.endswith(("s", "ied")):
        s = _ending(w, ("sses", "ied", "ies", "us", "ss", "s"))
        if s == "sses":
            w = w[:-2]
        elif s in ("ied", "ies"):
            w = w[:-2] if len(w) > 4 else w[:-1]
        elif s == "s" and _PLURAL_S.search(w):
            w = w[:-1]
    if w in KEPT_AFTER_PLURAL:
        return w.replace("Y", "y")
    # past and progressive
    s = _ending(w, _PAST)
    if s:
        part = w[: -len(s)]
        if s in ("eed", "eedly"):
            w = part + "ee" if len(part) >= r1 else w
        elif _HAS_VOWEL.search(part):
            if part.endswith(("at", "bl", "iz")):
                w = part + "e"
            elif part.endswith(_DOUBLES):
                w = part[:-1]
            else:
                w = part + "e" if r1 >= len(part) and _SHORT.search(part) else part
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    s = _ending(w, _ENDS2)
    if s:
        part = w[: -len(s)]
        allowed = part[-1:] in tuple("cdeghkmnrt") if s == "li" else part[-1:] == "l" if s == "ogi" else True
        if len(part) >= r1 and allowed:
            w = part + STEP2[s]
    s = _ending(w, _ENDS3)
    if s:
        part = w[: -len(s)]
        if len(part) >= r1 and (s != "ative" or len(part) >= r2):
            w = part + STEP3[s]
    s = _ending(w, _ENDS4)
    if s:
        part = w[: -len(s)]
        if len(part) >= r2 and (s != "ion" or part[-1:] in ("s", "t")):
            w = part
    if w.endswith(("e", "l")):
        part = w[:-1]
        if w[-1] == "e":
            if len(part) >= r2 or (len(part) >= r1 and not _SHORT.search(part)):
                w = part
        elif len(part) >= r2 and part.endswith("l"):
            w = part
    return w.replace("Y", "y")


def stem(word: Column) -> Column:
    """Stem of the lower-cased word.

    A filter on the result is not pushed below it, which would make the stems twice.
    """

    def stems(words: pa.Array) -> pa.Array:
        return pa.array([None if w is None else stem_word(w) for w in words.to_pylist()], pa.string())

    plain = F.arrow_udf(stems, "string").asNondeterministic()
    return F.when(word.rlike(_UNUSUAL), stem_expression(word)).otherwise(plain(F.lower(word)))
