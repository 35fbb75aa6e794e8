"""English stemmer (the published Snowball "english" / Porter2 algorithm) for the ``english``
text-search analyser (H05).

Spark applies it to the *distinct* tokens of an Arrow batch (``stem_lists``) or of a column
(``stem_udf``); a worker remembers the stems of recent words, so the Python work grows with
the vocabulary, not with the number of token occurrences.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

VOWELS = set("aeiouy")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = set("cdeghkmnrt")

# fixed values of the algorithm: whole-word exceptions
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias",
    "andes": "andes",
}
AFTER_1A_INVARIANT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"),
    ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"),
    ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"),
    ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"),
    ("ogi", "og"), ("li", ""),
]
STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"),
         ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize",
         "ion", "al", "er", "ic"]
# each step's endings at once: most words have none of them
ENDINGS_1B, ENDINGS_2, ENDINGS_3, ENDINGS_4 = ("ed", "ing", "eed", "ly"), tuple(s for s, _ in STEP2), tuple(s for s, _ in STEP3), tuple(STEP4)


def _is_vowel(w: str, i: int) -> bool:
    return w[i] in VOWELS


def _region_after(w: str, start: int) -> int:
    for i in range(start + 1, len(w)):
        if not _is_vowel(w, i) and _is_vowel(w, i - 1):
            return i + 1
    return len(w)


def _regions(w: str) -> tuple[int, int]:
    for prefix in ("gener", "commun", "arsen"):
        if w.startswith(prefix):
            r1 = len(prefix)
            break
    else:
        r1 = _region_after(w, 0)
    return r1, _region_after(w, r1)


def _short_syllable_at_end(w: str) -> bool:
    n = len(w)
    if n == 2:
        return _is_vowel(w, 0) and not _is_vowel(w, 1)
    if n >= 3:
        return (not _is_vowel(w, n - 3) and _is_vowel(w, n - 2) and not _is_vowel(w, n - 1)
                and w[n - 1] not in "wxY")
    return False


def _is_short(w: str, r1: int) -> bool:
    return r1 >= len(w) and _short_syllable_at_end(w)


def _has_vowel(s: str) -> bool:
    return any(c in VOWELS for c in s)


def stem(word: str) -> str:
    if word is None:
        return None
    w = word
    if len(w) <= 2:
        return w
    if w in EXCEPTIONS:
        return EXCEPTIONS[w]
    if w.startswith("'"):
        w = w[1:]
    # y at the start or after a vowel is a consonant
    if "y" in w:
        chars = list(w)
        for i, c in enumerate(chars):
            if c == "y" and (i == 0 or chars[i - 1] in VOWELS):
                chars[i] = "Y"
        w = "".join(chars)
    r1, r2 = _regions(w)

    # step 0
    for suf in ("'s'", "'s", "'") if "'" in w else ():
        if w.endswith(suf):
            w = w[: -len(suf)]
            break
    # step 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ied") or w.endswith("ies"):
        w = w[:-3] + ("i" if len(w) > 4 else "ie")
    elif w.endswith("us") or w.endswith("ss"):
        pass
    elif w.endswith("s"):
        if _has_vowel(w[:-2]):
            w = w[:-1]
    if w in AFTER_1A_INVARIANT:
        return w
    # step 1b
    for suf in ("eedly", "ingly", "edly", "eed", "ing", "ed") if w.endswith(ENDINGS_1B) else ():
        if w.endswith(suf):
            if suf in ("eed", "eedly"):
                if len(w) - len(suf) >= r1:
                    w = w[: -len(suf)] + "ee"
            else:
                base = w[: -len(suf)]
                if _has_vowel(base):
                    w = base
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w.endswith(DOUBLES):
                        w = w[:-1]
                    elif _is_short(w, r1):
                        w += "e"
            break
    # step 1c
    if len(w) > 2 and w[-1] in "yY" and not _is_vowel(w, len(w) - 2):
        w = w[:-1] + "i"
    # step 2
    for suf, rep in STEP2 if w.endswith(ENDINGS_2) else ():
        if w.endswith(suf):
            if len(w) - len(suf) >= r1:
                if suf == "ogi":
                    if w[: -3].endswith("l"):
                        w = w[:-3] + rep
                elif suf == "li":
                    if len(w) >= 3 and w[-3] in LI_ENDINGS:
                        w = w[:-2]
                else:
                    w = w[: -len(suf)] + rep
            break
    # step 3
    for suf, rep in STEP3 if w.endswith(ENDINGS_3) else ():
        if w.endswith(suf):
            if len(w) - len(suf) >= r1:
                if suf == "ative":
                    if len(w) - len(suf) >= r2:
                        w = w[: -len(suf)]
                else:
                    w = w[: -len(suf)] + rep
            break
    # step 4
    for suf in STEP4 if w.endswith(ENDINGS_4) else ():
        if w.endswith(suf):
            if len(w) - len(suf) >= r2:
                if suf == "ion":
                    if len(w) >= 4 and w[-4] in "st":
                        w = w[:-3]
                else:
                    w = w[: -len(suf)]
            break
    # step 5
    if w.endswith("e"):
        base = w[:-1]
        if len(base) >= r2 or (len(base) >= r1 and not _short_syllable_at_end(base)):
            w = base
    elif w.endswith("l"):
        if len(w) - 1 >= r2 and w[:-1].endswith("l"):
            w = w[:-1]
    return w.replace("Y", "y")


#: Distinct words whose stems a Python worker remembers.
@functools.lru_cache(maxsize=1 << 19)
def stem_or_keep(t: str | None) -> str | None:
    # only words, hyphenated ones too, are stemmed; numbers, addresses and mixed tokens pass through
    return stem(t) if t is not None and t.replace("-", "").isalpha() else t


@F.pandas_udf(StringType())
def stem_udf(terms: pd.Series) -> pd.Series:
    return terms.map(stem_or_keep)


def stem_lists(stop: list[str]) -> Callable:
    """Function of a column of token lists: the stems in place, stop words as NULL; each distinct token of a batch is stemmed once."""
    gone = frozenset(stop)

    @F.arrow_udf("array<string>")
    def kernel(lists: pa.Array) -> pa.Array:
        tokens = lists.flatten().dictionary_encode()
        stems = pa.array([None if t in gone else stem_or_keep(t) for t in tokens.dictionary.to_pylist()], pa.string())
        ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), stems.take(tokens.indices))

    return kernel
