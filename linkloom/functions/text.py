"""Text normalisation, tokens and keys as Column expressions, and the few functions that need Python."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions.address import LEGAL

# The words before a number that is no house number.
UNITS = (
    "unit", "apt", "apartment", "suite", "ste", "fl", "floor", "room", "rm", "bldg",
    "building", "no", "shop", "flat", "plot", "office", "door", "h", "hno", "sy", "sector",
    "block", "blk", "gala", "wing", "lot", "box", "po", "pmb", "dept", "level", "lvl",
)


def strip_to_words(text: Column, keep_marks: bool = False) -> Column:
    """Lower case; everything but letters, numbers, underscores (and marks) to spaces; spaces collapsed."""
    kept = r"[^\p{L}\p{N}\p{M}_\s]" if keep_marks else r"[^\p{L}\p{N}_\s]"
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), kept, " "), r"\s+", " "))


def normalise(text: Column, keep_marks: bool = False) -> Column:
    """strip_to_words of the composed text (NFC) without the token ``null``; a null text is empty."""
    parts = F.split(strip_to_words(nfc(F.coalesce(text, F.lit(""))), keep_marks), " ")
    return F.array_join(F.filter(parts, lambda t: (t != "null") & (t != "")), " ")


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


@F.pandas_udf(T.StringType())
def fold(text: pd.Series) -> pd.Series:
    """Without accents, in lower case."""
    return text.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower())


def ascii_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def core_tokens(tokens: Column, dropped=LEGAL) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*dropped))


def core_key(tokens: Column, dropped=LEGAL) -> Column:
    return F.array_join(F.array_sort(core_tokens(tokens, dropped)), " ")


def multiset_key(tokens: Column) -> Column:
    return F.array_join(F.array_sort(tokens), " ")


def char_grams(text: Column, n: int = 4) -> Column:
    """All n-grams; none for a text shorter than n."""
    none = F.array().cast("array<string>")
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n)))).otherwise(none)


def deletion_keys(tokens: Column) -> Column:
    """The token set without each of its tokens in turn."""
    return F.transform(tokens, lambda t: F.array_join(F.array_sort(F.array_except(tokens, F.array(t))), " "))


def acronym(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: F.left(t, F.lit(1))), "")




def ascii_digits(text: Column) -> Column:
    """Decimal digits of the major scripts to ASCII ones. Each script's zero is a fixed value of Unicode."""
    zeros = (0x0660, 0x06F0, 0x0966, 0x09E6, 0x0A66, 0x0AE6, 0x0B66, 0x0BE6, 0x0C66, 0x0CE6, 0x0D66, 0xFF10)
    return F.translate(text, "".join(chr(z + k) for z in zeros for k in range(10)), "0123456789" * len(zeros))


def numbers(text: Column) -> Column:
    """Digit runs in order, without leading zeros; a run of zeros is 0."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([0-9]+)"), F.lit(1))
    return F.transform(runs, lambda r: F.when(F.ltrim(r, F.lit("0")) == "", F.lit("0")).otherwise(F.ltrim(r, F.lit("0"))))


def parsed_numbers(text: Column) -> Column:
    """(digits, pure, prev) of every token with a digit: the number, whether the token is digits only, the token before."""
    tokens = ascii_tokens(ascii_digits(text))
    with_previous = F.transform(tokens, lambda t, i: F.struct(t.alias("t"), F.coalesce(F.get(tokens, i - 1), F.lit("")).alias("prev")))
    held = F.filter(with_previous, lambda x: x["t"].rlike("[0-9]"))
    return F.transform(held, lambda x: F.struct(F.get(numbers(x["t"]), F.lit(0)).alias("digits"), x["t"].rlike("^[0-9]+$").alias("pure"), x["prev"]))


def house_number(parsed: Column, units=UNITS) -> Column:
    """The first pure number that no unit word precedes."""
    return F.get(F.filter(parsed, lambda x: x["pure"] & ~x["prev"].isin(*units)), F.lit(0))["digits"]


def longest(values: Column) -> Column:
    """The longest string, the first of them on ties."""
    return F.aggregate(values, F.lit(None).cast("string"), lambda acc, x: F.when(acc.isNull() | (F.length(x) > F.length(acc)), x).otherwise(acc))


def consonant_key(text: Column) -> Column:
    """Phonetic key: aspirates and long vowels simplified, vowels after the first letter dropped, double letters single."""
    s = F.lower(text)
    for pattern, by in (("sh", "s"), ("ph", "f"), ("([bdgjkpt])h", "$1"), ("w", "v"), ("(?<=[a-z])[aeiouy]", ""), (r"([a-z])\1+", "$1")):
        s = F.regexp_replace(s, pattern, by)
    return s


def has_indic(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[ऀ-෿]"), F.lit(False))


# The Latin of vowels and of consonants that don't follow from their Unicode names.
VOWELS = {
    "A": "a", "AA": "aa", "I": "i", "II": "ii", "U": "u", "UU": "uu", "VOCALIC R": "ri",
    "VOCALIC RR": "ri", "VOCALIC L": "li", "VOCALIC LL": "li", "E": "e", "EE": "e", "AI": "ai",
    "O": "o", "OO": "o", "AU": "au", "SHORT E": "e", "SHORT O": "o", "CANDRA E": "e",
    "CANDRA O": "o", "OE": "o", "OOE": "o", "AW": "au", "UE": "u", "UUE": "u",
}
CONSONANTS = {
    "NNA": "na", "NNNA": "na", "TTA": "ta", "TTHA": "tha", "DDA": "da", "DDDHA": "dha",
    "DDHA": "dha", "LLA": "la", "LLLA": "la", "RRA": "ra", "SSA": "sha", "SHA": "sha",
    "NGA": "na", "NYA": "nya", "JNYA": "gya", "VA": "va", "YYA": "ya", "FA": "pha", "ZA": "ja",
    "QA": "ka", "KHHA": "kha", "GHHA": "gha", "DDDA": "da", "RHA": "dha", "NA": "na",
}
SCRIPTS = ("DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM")


@lru_cache(4096)
def letter_class(ch: str) -> tuple[str, str]:
    """(class, Latin) of a character by its Unicode name: vowel, consonant, sign, virama, nasal, literal, skip or other."""
    script, _, rest = unicodedata.name(ch, "").partition(" ")
    kind, _, key = rest.partition(" ")
    if script not in SCRIPTS:
        return "other", ch
    if kind == "LETTER":
        return ("vowel", VOWELS[key]) if key in VOWELS else ("consonant", CONSONANTS.get(key, key.lower()))
    if rest.startswith("VOWEL SIGN "):
        sign = rest.removeprefix("VOWEL SIGN ")
        return "sign", VOWELS.get(sign, sign.lower())
    if rest == "SIGN PULLI" or rest.endswith("VIRAMA"):
        return "virama", ""
    if rest in ("SIGN ANUSVARA", "SIGN CANDRABINDU", "SIGN TIPPI"):
        return "nasal", "n"
    if rest == "SIGN VISARGA":
        return "literal", "h"
    return ("literal", str(unicodedata.digit(ch))) if kind == "DIGIT" else ("skip", "")


def simplified(word: str) -> str:
    """Phonetic form of a Latin word: short vowels, no aspirates, sh as s, v as w, single letters for repeated ones."""
    for vowel in "aiueo":
        word = word.replace(2 * vowel, vowel)
    word = re.sub("([kgcjtdpb])h", r"\1", word).replace("sh", "s").replace("w", "v")
    return re.sub(r"(.)\1+", r"\1", word)


def skeleton(words: str) -> str:
    """Consonants of each word behind its first letter, voiced ones as unvoiced."""
    out = []
    for word in words.split():
        for letter, by in (("x", "ks"), ("q", "k"), ("z", "j"), ("f", "p"), ("c", "k"), ("b", "p"), ("d", "t"), ("g", "k")):
            word = word.replace(letter, by)
        out.append(word[:1] + re.sub("[aeiouy]", "", word[1:]))
    return " ".join(out)


def transliterate_text(text: str | None, simplify: bool = False) -> str | None:
    """Indic to Latin: consonants carry an inherent a; a sign replaces it, a virama or a word's end drops it, and a nukta or
    another mark leaves it open. simplify: with the phonetic form of each word that is ASCII by then."""
    if not has_indic_text(text):
        return text
    out, open_ = [], False
    for ch in text:
        kind, latin = letter_class(ch)
        if kind == "skip":
            continue
        if open_ and kind not in ("sign", "virama") and (kind != "other" or ch.isalnum()):
            out.append("a")
        open_ = kind == "consonant" and latin.endswith("a")
        out.append(latin[:-1] if open_ else latin)
    latin = "".join(out)
    return " ".join(simplified(w) if w.isascii() else w for w in latin.split(" ")) if simplify else latin


def has_indic_text(text: str | None) -> bool:
    return bool(text) and any(0x0900 <= ord(ch) <= 0x0DFF for ch in text)


@F.pandas_udf(T.StringType())
def transliterate(text: pd.Series) -> pd.Series:
    return text.map(transliterate_text)


@F.pandas_udf(T.StringType())
def phonetic(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else " ".join(map(simplified, s.split())))


@F.pandas_udf(T.StringType())
def consonants(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else skeleton(s))
