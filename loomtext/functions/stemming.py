"""Stemmers from their published algorithms, applied to distinct vocabulary."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

_VOWELS = "aeiou"


def _consonant(w: str, i: int) -> bool:
    return w[i] not in _VOWELS and not (w[i] == "y" and i > 0 and _consonant(w, i - 1))


def _measure(stem: str) -> int:
    return len(re.findall("vc", re.sub(r"(.)\1+", r"\1", "".join("c" if _consonant(stem, i) else "v" for i in range(len(stem))))))


def _has_vowel(stem: str) -> bool:
    return any(not _consonant(stem, i) for i in range(len(stem)))


def _short_end(w: str) -> bool:
    return len(w) >= 3 and _consonant(w, len(w) - 1) and not _consonant(w, len(w) - 2) and _consonant(w, len(w) - 3) and w[-1] not in "wxy"


#: Suffixes of the steps 2 to 4 (fixed values of the published algorithm).
_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("fulli", "ful"), ("logi", "log"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou")


_IRREGULAR = {"skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}


@lru_cache(maxsize=100_000)
def porter(word: str) -> str:
    """Porter's stemmer with its later, widely used extensions (short -ies and
    -ied, -y after any consonant, -bli, -fulli, -logi); one or two letters stay."""
    w = word.lower()
    if len(w) <= 2:
        return w
    if w in _IRREGULAR:
        return _IRREGULAR[w]
    if w.endswith("ies"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("ied"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                stem = w[: -len(end)]
                if _has_vowel(stem):
                    w = stem
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif _measure(w) == 1 and _short_end(w):
                        w += "e"
                break
    if w.endswith("y") and len(w) > 2 and _consonant(w, len(w) - 2):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end, new in sorted(table, key=lambda x: -len(x[0])):
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + new
                break
    for end in _STEP4:
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


#: Snowball English (fixed values of the published algorithm).
_SB_SPECIAL = {"skis": "ski", "skies": "sky", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
_SB_STEP2 = (("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""))
_SB_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
_SB_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
_V = "aeiouy"


def _regions(w: str) -> tuple[int, int]:
    m = re.match(r"gener|commun|arsen", w)
    find = lambda s: (x.end() if (x := re.compile(r"[aeiouy][^aeiouy]").search(w, s)) else len(w))
    r1 = m.end() if m else find(0)
    return r1, find(r1)


def _sb_short(w: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", w) or re.fullmatch(r"[aeiouy][^aeiouy]", w))


@lru_cache(maxsize=100_000)
def snowball_english(word: str) -> str:
    """The Snowball English stemmer ("Porter2")."""
    w = word.lower().lstrip("'")
    if len(w) <= 2:
        return w
    if w in _SB_SPECIAL:
        return _SB_SPECIAL[w]
    w = re.sub(r"(^|[aeiouy])y", r"\1Y", w)
    r1, r2 = _regions(w)
    w = re.sub(r"('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(r"[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"):
        return w
    if m := re.search(r"(eedly|eed)$", w):
        w = w[: m.start()] + "ee" if m.start() >= r1 else w
    elif (m := re.search(r"(ingly|edly|ing|ed)$", w)) and re.search(r"[aeiouy]", w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif r1 >= len(w) and _sb_short(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    for end, new in _SB_STEP2:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1 and (end != "ogi" or w[at - 1] == "l") and (end != "li" or w[at - 1] in "cdeghkmnrt"):
                w = w[:at] + new
            break
    for end, new in _SB_STEP3:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1 and (end != "ative" or at >= r2):
                w = w[:at] + new
            break
    for end in _SB_STEP4:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r2 and (end != "ion" or w[at - 1] in "st"):
                w = w[:at]
            break
    if w.endswith("e"):
        at = len(w) - 1
        if at >= r2 or (at >= r1 and not _sb_short(w[:-1])):
            w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= r2 and w[-2] == "l":
        w = w[:-1]
    return w.lower()


#: The published rules of Paice and Husk (fixed values), in their order: the ending read backwards, * if
#: the word must be as it was, letters to remove, what to append, and > (go on) or . (stop).
_LANCASTER = """ai*2. a*1. bb1. city3s. ci2> cn1t> dd1. dei3y> deec2ss. dee1. de2> dooh4> e1> feil1v. fi2> gni3> gai3y. ga2> gg1.
ht*2. hsiug5ct. hsi3> i*1. i1y> ji1d. juf1s. ju1d. jo1d. jeh1r. jrev1t. jsim2t. jn1d. j1s. lbaifi6. lbai4y. lba3> lbi3. lib2l> lc1.
lufi4y. luf3> lu2. lai3> lau3> la2> ll1. mui3. mu*2. msi3> mm1. nois4j> noix4ct. noi3> nai3> na2> nee0. ne2> nn1. pihs4> pp1. re2>
rae0. ra2. ro2> ru2> rr1. rt1> rei3y> sei3y> sis2. si2> ssen4> ss0. suo3> su*2. s*1> s0. tacilp4y. ta2> tnem4> tne3> tna3> tpir2b.
tpro2b. tcud1. tpmus2. tpec2iv. tulo2v. tsis0. tsi3> tt1. uqi3. ugo1. vis3j> vie0. vi2> ylb1> yli3y> ylp0. yl2> ygo1. yhp1. ymo1.
ypo1. yti3> yte3> ytl2. yrtsi5. yra3> yro3> yfi3. ycn2t> yca3> zi2> zy1s.""".split()


@lru_cache(maxsize=1)
def _lancaster_rules() -> dict[str, list[tuple[str, bool, int, str, bool]]]:
    """By last letter: ending, whether the word must be intact, letters to remove, appended ones, whether to go on."""
    out: dict[str, list[tuple[str, bool, int, str, bool]]] = {}
    for rule in _LANCASTER:
        ending, intact, remove, append, after = re.fullmatch(r"([a-z]+)(\*?)(\d)([a-z]*)([>.])", rule).groups()
        out.setdefault(ending[0], []).append((ending[::-1], bool(intact), int(remove), append, after == ">"))
    return out


def lancaster(word: str) -> str:
    """The iterated rules of Paice and Husk: the first rule that fits is applied, until one
    says stop or none fits. What is left needs two letters after a vowel, or three with a vowel among
    the next two."""
    w = first = word.lower()

    def enough(remove: int) -> bool:
        left = len(w) - remove
        return left >= 2 if w[0] in "aeiouy" else left >= 3 and any(c in "aeiouy" for c in w[1:3])

    while True:
        letters = re.match(r"[^\W\d_]*", w)[0]
        for ending, intact, remove, append, goes in _lancaster_rules().get(letters[-1:], ()):
            if w.endswith(ending) and (not intact or w == first) and enough(remove):
                w = w[: len(w) - remove] + append
                if not goes:
                    return w
                break
        else:
            return w


STEMMERS = {"porter": porter, "snowball": snowball_english, "lancaster": lancaster}


def stem_vocabulary(vocabulary: DataFrame, word: str, stemmers: tuple[str, ...] = ("porter", "snowball")) -> DataFrame:
    """Adds a column for each stemmer; join it back to tokens by the word."""
    for name in stemmers:
        vocabulary = vocabulary.withColumn(name, _stem_column(STEMMERS[name])(F.col(word)))
    return vocabulary


def _stem_column(stem):
    @F.pandas_udf("string")
    def run(words: pd.Series) -> pd.Series:
        return words.map(lambda w: None if w is None else stem(w))

    return run
