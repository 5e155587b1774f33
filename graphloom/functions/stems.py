"""English words to stems, by the published rules of the Snowball project's English stemmer."""

from __future__ import annotations

import functools

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# The usual list of English words that carry no search meaning.
STOP_WORDS = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having
do does did doing a an the and but if or because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where why how all any both each few more most
other some such no nor not only own same so than too very s t can will just don should now""".split()

# The stemmer's exceptions and its endings, the longest first.
_WHOLE = dict(skis="ski", skies="sky", dying="die", lying="lie", tying="tie", idly="idl", gently="gentl", ugly="ugli", early="earli", only="onli", singly="singl", sky="sky", news="news", howe="howe", atlas="atlas", cosmos="cosmos", bias="bias", andes="andes")
_KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_SECOND = dict(ization="ize", ational="ate", fulness="ful", ousness="ous", iveness="ive", tional="tion", biliti="ble", lessli="less", entli="ent", ation="ate", alism="al", aliti="al", ousli="ous", iviti="ive", fulli="ful", enci="ence", anci="ance", abli="able", izer="ize", ator="ate", alli="al", bli="ble", ogi="og", li="")
_THIRD = dict(ational="ate", tional="tion", alize="al", icate="ic", iciti="ic", ative="", ical="ic", ness="", ful="")
_FOURTH = "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic".split()
_VOWELS = "aeiouy"


def _after(word: str, start: int) -> int:
    """Where the region begins that follows the first consonant after a vowel, from ``start`` on."""
    for i in range(start + 1, len(word)):
        if word[i] not in _VOWELS and word[i - 1] in _VOWELS:
            return i + 1
    return len(word)


def _short_end(word: str) -> bool:
    if len(word) == 2:
        return word[0] in _VOWELS and word[1] not in _VOWELS
    return len(word) > 2 and word[-1] not in _VOWELS + "wxY" and word[-2] in _VOWELS and word[-3] not in _VOWELS


def _vowel(part: str) -> bool:
    return any(c in _VOWELS for c in part)


@functools.lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of a word in lower case."""
    if len(word) < 3:
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    w = "".join("Y" if c == "y" and (i == 0 or word[i - 1] in _VOWELS) else c for i, c in enumerate(word))
    first = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None) or _after(w, 0)
    second = _after(w, first)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _vowel(w[:-2]):
        w = w[:-1]
    if w in _KEPT:
        return w
    # past and progressive forms
    end = next((e for e in ("eedly", "ingly", "edly", "eed", "ing", "ed") if w.endswith(e)), "")
    if end in ("eed", "eedly"):
        w = w[: -len(end)] + "ee" if len(w) - len(end) >= first else w
    elif end and _vowel(w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
            w = w[:-1]
        elif _short_end(w) and len(w) <= first:
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    # derived forms
    end = next((e for e in _SECOND if w.endswith(e)), "")
    if end and len(w) - len(end) >= first and (end != "ogi" or w[-4:-3] == "l") and (end != "li" or w[-3:-2] in tuple("cdeghkmnrt")):
        w = w[: -len(end)] + _SECOND[end]
    end = next((e for e in _THIRD if w.endswith(e)), "")
    if end and len(w) - len(end) >= (second if end == "ative" else first):
        w = w[: -len(end)] + _THIRD[end]
    end = next((e for e in _FOURTH if w.endswith(e)), "")
    if end and len(w) - len(end) >= second and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e"):
        if len(w) - 1 >= second or (len(w) - 1 >= first and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= second:
        w = w[:-1]
    return w.lower()


@F.arrow_udf(ArrayType(StringType()))
def _stemmed(words: pa.Array) -> pa.Array:
    flat = words.flatten().dictionary_encode()
    stems = pa.array([stem(w) for w in flat.dictionary.to_pylist()], pa.string()).take(flat.indices)
    ends = pa.compute.cumulative_sum(pa.compute.fill_null(pa.compute.list_value_length(words), 0).cast(pa.int32()))
    return pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), stems)


def stemmed(words: Column) -> Column:
    """An array of words as stems; each different word of a batch is stemmed once."""
    return _stemmed(words)
