"""English terms for ranked retrieval: no stop words, and words cut to their stems (the published Porter2 rules)."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import tokens

# Words that are not indexed.
STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then",
    "there", "these", "they", "this", "to", "was", "will", "with",
]

# Words with stems of their own, words that keep their form, and words that do so once a plural is off.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")

# Suffixes of the second, third and fourth step, and what takes their place.
SECOND = {
    "ational": "ate", "fulness": "ful", "iveness": "ive", "ization": "ize", "ousness": "ous", "biliti": "ble", "lessli": "less", "tional": "tion", "alism": "al", "aliti": "al",
    "ation": "ate", "entli": "ent", "fulli": "ful", "iviti": "ive", "ousli": "ous", "abli": "able", "alli": "al", "anci": "ance", "ator": "ate", "enci": "ence", "izer": "ize", "bli": "ble", "ogi": "og", "li": "",
}
THIRD = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
FOURTH = ["ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ion", "ism", "iti", "ive", "ize", "ous", "al", "er", "ic"]

_REGION = re.compile(r"[aeiouy][^aeiouy]")
_SHORT = re.compile(r"(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")


def _ending(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _regions(word: str) -> tuple[int, int]:
    """Where the parts after the first, and after the second, vowel and consonant begin."""
    head = re.match("gener|commun|arsen", word)
    found = head or _REGION.search(word)
    first = found.end() if found else len(word)
    later = _REGION.search(word, first)
    return first, later.end() if later else len(word)


def _past_forms(word: str, first: int) -> str:
    """Without -ed and -ing, mended at the end."""
    end = _ending(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        return word[: -len(end)] + "ee" if len(word) - len(end) >= first else word
    if end is None or not re.search("[aeiouy]", word[: -len(end)]):
        return word
    word = word[: -len(end)]
    if word.endswith(("at", "bl", "iz")):
        return word + "e"
    if re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", word):
        return word[:-1]
    return word + "e" if first >= len(word) and _SHORT.search(word) else word


@lru_cache(1 << 17)
def stem(word: str) -> str:
    """The stem of a word in lower case."""
    if len(word) <= 2 or word in IRREGULAR:
        return IRREGULAR.get(word, word)
    # A y that begins a word or follows a vowel is a consonant.
    word = re.sub(r"(^|(?<=[aeiouy]))y", "Y", word.removeprefix("'"))
    first, second = _regions(word)
    word = re.sub(r"'s?'?$", "", word)
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search("[aeiouy]", word[:-2]):
        word = word[:-1]
    if word in KEPT:
        return word
    word = _past_forms(word, first)
    if len(word) > 2 and re.search(r"[^aeiouy][yY]$", word):
        word = word[:-1] + "i"
    end = _ending(word, SECOND)
    if end and len(word) - len(end) >= first:
        before = word[: -len(end)]
        if end not in ("ogi", "li") or (end == "ogi" and before.endswith("l")) or (end == "li" and before.endswith(tuple("cdeghkmnrt"))):
            word = before + SECOND[end]
    end = _ending(word, THIRD)
    if end and len(word) - len(end) >= (second if end == "ative" else first):
        word = word[: -len(end)] + THIRD[end]
    end = _ending(word, FOURTH)
    if end and len(word) - len(end) >= second and (end != "ion" or word[:-3].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e"):
        at = len(word) - 1
        if at >= second or (at >= first and not _SHORT.search(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= second:
        word = word[:-1]
    return word.lower()


def stemmed(words: Column) -> Column:
    """Arrays of words as arrays of stems; each distinct word of a batch is cut once."""

    @F.arrow_udf("array<string>")
    def run(lists: pa.Array) -> pa.Array:
        coded = lists.flatten().dictionary_encode()
        stems = pa.array([stem(w) for w in coded.dictionary.to_pylist()], pa.string())
        sizes = pc.fill_null(lists.value_lengths(), 0).to_numpy()
        offsets = pa.array([0, *sizes.cumsum().tolist()], pa.int32())
        return pa.ListArray.from_arrays(offsets, stems.take(coded.indices))

    return run(words)


def english_terms(text: Column) -> Column:
    """Stems of the tokens of two letters and more that are no stop words."""
    return stemmed(F.filter(tokens(text), lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS)))
