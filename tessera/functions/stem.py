"""English stems by the published Porter2 rules, and the words that are left out of an index."""

from __future__ import annotations

import re
from functools import lru_cache

# Words that an English index leaves out.
STOP = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do
does did doing a an the and but if or because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where why how all any both each few more
most other some such no nor not only own same so than too very s t can will just don should now""".split()
)
# Words whose stems the rules would not give.
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    **dict.fromkeys(("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")),
}
KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
# Endings and what takes their place, where they stand behind the first region.
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
_REGION = re.compile("[aeiouy][^aeiouy]")
_SHORT = re.compile("(?:^|.*[^aeiouy])[aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$")
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")


def _regions(word: str) -> tuple[int, int]:
    first = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    if first is None:
        m = _REGION.search(word)
        first = m.end() if m else len(word)
    m = _REGION.search(word, first)
    return first, m.end() if m else len(word)


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _short(word: str, first: int) -> bool:
    """A word that ends in a short syllable and has nothing behind it."""
    return first >= len(word) and bool(re.search("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$", word))


@lru_cache(200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in WHOLE:
        return WHOLE[word] or word
    word = word.removeprefix("'")
    word = re.sub("^y|(?<=[aeiouy])y", "Y", word)
    first, second = _regions(word)
    word = re.sub("'s?'?$", "", word)
    # plural and third person
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search("[aeiouy].", word[:-1]):
        word = word[:-1]
    if word in KEPT:
        return word
    # past and progressive forms
    end = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        word = word[: -len(end)] + "ee" if len(word) - len(end) >= first else word
    elif end and re.search("[aeiouy]", word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(_DOUBLE):
            word = word[:-1]
        elif _short(word, first):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    # derived forms, from the outer ending inwards
    end = _longest(word, (*STEP_2, "ogi", "li"))
    if end and len(word) - len(end) >= first:
        if end in STEP_2:
            word = word[: -len(end)] + STEP_2[end]
        elif end == "ogi" and word.endswith("logi"):
            word = word[:-1]
        elif end == "li" and word[-3:-2] in tuple("cdeghkmnrt"):
            word = word[:-2]
    end = _longest(word, (*STEP_3, "ative"))
    if end and len(word) - len(end) >= first:
        if end in STEP_3:
            word = word[: -len(end)] + STEP_3[end]
        elif len(word) - 5 >= second:
            word = word[:-5]
    end = _longest(word, (*STEP_4, "ion"))
    if end and len(word) - len(end) >= second and (end != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(end)]
    if word.endswith("e") and (len(word) - 1 >= second or (len(word) - 1 >= first and not re.search("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$", word[:-1]))):
        word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= second:
        word = word[:-1]
    return word.lower()
