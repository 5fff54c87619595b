"""English stemming (the published Porter2 rules) of distinct terms, and stop-words."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Common English function words, in alphabetic order.
STOP_WORDS = frozenset(
    """a about above after again against all am an and any are as at be because been before being below between both but by can did do
    does doing don down during each few for from further had has have having he her here hers herself him himself his how i if in into
    is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own s same she
    should so some such t than that the their theirs them themselves then there these they this those through to too under until up very
    was we were what when where which while who whom why will with you your yours yourself yourselves""".split()
)
_V = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
# Exceptions and suffix replacements of the Porter2 stemmer.
_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
          "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
          "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
_KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"),
          ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"),
          ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"),
          ("bli", "ble")]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic"]


def _after(word: str, start: int) -> int:
    m = re.search(f"[{_V}][^{_V}]", word[start:])
    return start + m.end() if m else len(word)


def _short_syllable(w: str) -> bool:
    return bool(re.search(rf"(?:[^{_V}][{_V}][^{_V}wxY]|^[{_V}][^{_V}])$", w))


def porter2(word: str) -> str:
    """The stem of a lower-case word."""
    w = word.lstrip("'")
    if len(w) < 3:
        return w
    if w in _WHOLE:
        return _WHOLE[w]
    w = re.sub(rf"^y|(?<=[{_V}])y", "Y", w)
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = _after(w, 0) if r1 is None else r1
    r2 = _after(w, r1)
    w = re.sub(r"'s'$|'s$|'$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_V}].", w[:-1]):
        w = w[:-1]
    if w in _KEPT:
        return w
    m = re.search(r"(eedly|eed|ingly|edly|ing|ed)$", w)
    if m and m[1] in ("eed", "eedly"):
        w = w[: m.start()] + "ee" if m.start() >= r1 else w
    elif m and re.search(f"[{_V}]", w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and _short_syllable(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    for s, to in _STEP2:
        if w.endswith(s):
            w = w[: -len(s)] + to if len(w) - len(s) >= r1 else w
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    for s, to in _STEP3:
        if w.endswith(s):
            w = w[: -len(s)] + to if len(w) - len(s) >= r1 else w
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for s in _STEP4:
        if w.endswith(s):
            w = w[: -len(s)] if len(w) - len(s) >= r2 else w
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_syllable(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


class Stems(dict):
    """Stems by lower-case word, None for stop-words; so many are kept at most."""

    most = 200_000

    def __missing__(self, word: str) -> str | None:
        if len(self) >= self.most:
            self.clear()
        self[word] = stem = None if word in STOP_WORDS else porter2(word)
        return stem


def stem_terms(terms: DataFrame) -> DataFrame:
    """(term, stem) of distinct terms that are no stop-words."""

    @F.pandas_udf("string")
    def stem(words: pd.Series) -> pd.Series:
        return words.map(lambda w: None if w is None or w in STOP_WORDS else porter2(w))

    return terms.select("term").distinct().withColumn("stem", stem("term")).where("stem is not null")


def stem_postings(postings: DataFrame) -> DataFrame:
    """(term, chunk_id, tf) with stems as terms; stemming runs once per distinct term."""
    joined = postings.join(stem_terms(postings), "term")
    return joined.groupBy(F.col("stem").alias("term"), "chunk_id").agg(F.sum("tf").alias("tf"))
