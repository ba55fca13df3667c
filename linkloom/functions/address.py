"""Parsed names and addresses: house numbers, street and locality keys, name and number relations, as Column expressions.

All functions take folded text: without accents, in lower case. A null or empty address has no number and no word.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists of the record-matching rules.
LEGAL = (
    "sarl", "sas", "sa", "sasu", "eurl", "sci", "snc", "scop", "scs", "sca", "gie", "selarl", "earl", "ei", "eirl",
    "llc", "inc", "co", "corp", "corporation", "company", "ltd", "limited", "private", "pvt", "pc", "plc", "lp", "llp", "pllc",
)
HONORIFIC = ("sri", "shri", "smt", "mr", "mrs", "ms", "dr", "m", "s")
STREET_TYPE = (
    "rue", "r", "avenue", "ave", "av", "bd", "boulevard", "blvd", "allee", "all", "chemin", "ch", "che", "place", "pl", "impasse", "imp", "quai", "route", "rte", "cours", "crs",
    "square", "sq", "residence", "res", "lotissement", "lot", "hameau", "ham", "voie", "passage", "pass", "sentier", "cite", "parvis", "esplanade", "promenade", "prom", "rond", "point",
    "street", "st", "road", "rd", "drive", "dr", "lane", "ln", "court", "ct", "circle", "cir", "way", "parkway", "pkwy", "trail", "highway", "hwy", "terrace", "ter", "plaza", "loop",
)
UNIT = (
    "appt", "appartement", "apt", "app", "unit", "suite", "ste", "fl", "floor", "etage", "bat", "batiment", "escalier", "esc", "porte", "bis", "ter", "bureau", "box", "po", "pmb", "no", "n", "num",
)
UNIT_LED = (*UNIT, "apartment", "flat", "residence", "floor")
UNIT_MORE = (
    *UNIT, "apartment", "room", "rm", "bldg", "building", "flat", "shop", "office", "plot", "block", "blk", "door", "house", "hno", "sno", "trailer", "level", "lvl", "wing", "gala",
    "sector", "ward", "dept", "department", "etage",
)
STOP = ("de", "du", "des", "la", "le", "les", "l", "d", "the", "of", "and", "et", "a", "au", "aux", "en")
STREET_STOP = ("de", "du", "des", "la", "le", "les", "l", "d", "et", "and", "the", "of", "a", "au", "aux", "en", "no", "n", "bis", "ter", "quater")
ABBREVIATION = {
    "r": "rue", "av": "avenue", "ave": "avenue", "avn": "avenue", "bd": "boulevard", "blvd": "boulevard", "boul": "boulevard",
    "bld": "boulevard", "pl": "place", "ch": "chemin", "chem": "chemin", "imp": "impasse", "all": "allee", "rte": "route",
    "sq": "square", "qu": "quai", "crs": "cours", "fg": "faubourg", "fbg": "faubourg", "pas": "passage", "pass": "passage",
    "st": "saint", "ste": "sainte", "res": "residence", "lot": "lotissement", "prom": "promenade", "sent": "sentier",
    "rpt": "rondpoint", "esp": "esplanade", "mte": "montee", "hle": "halle", "zi": "zone", "za": "zone", "zac": "zone",
}
ORDINALS = (
    "first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth",
    "eleventh", "twelfth", "thirteenth", "fourteenth", "fifteenth", "sixteenth", "seventeenth", "eighteenth", "nineteenth", "twentieth",
)
NAME_SUFFIX = (
    "llc", "inc", "co", "corp", "corporation", "company", "ltd", "limited", "private", "pvt", "pc", "plc", "lp", "llp", "group", "the", "center",
    "services", "service", "enterprises", "smt", "sri", "shri", "m", "s", "dba", "doing", "business", "as", "and",
)
DOMAIN = r"\.(com|in|net|org|co)\b"
ALIAS = r"\b(dba|doing business as|d/b/a|aka|t/a|trading as)\b"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def _without(tokens: Column, *dropped: str) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*dropped))


def _set(tokens: Column) -> Column:
    return F.array_sort(F.array_distinct(tokens))


def stripped(number: Column) -> Column:
    """Without leading zeros; zeros only are 0."""
    return F.when(F.ltrim(number, F.lit("0")) == "", F.lit("0")).otherwise(F.ltrim(number, F.lit("0")))


def tokens(folded: Column) -> Column:
    return _all(F.coalesce(folded, F.lit("")), "[a-z0-9]+")


def components(folded: Column) -> Column:
    """The parts between commas that aren't blank."""
    return F.filter(F.transform(F.split(F.coalesce(folded, F.lit("")), ","), lambda c: F.trim(c)), lambda c: c != "")


def words(folded: Column) -> Column:
    """Distinct words of three letters and more, without stop words."""
    return _set(_without(_all(F.coalesce(folded, F.lit("")), "[a-z]{3,}"), *STOP))


def core(folded: Column) -> Column:
    """Distinct name tokens without legal forms and honorifics."""
    return _set(_without(tokens(folded), *LEGAL, *HONORIFIC))


def _parts(parts: Column, pick: Column) -> Column:
    """Number, street tokens and other words, with the component at place pick (from 1, 0 for none) as the street."""
    chosen = F.get(parts, pick - 1)
    street = F.filter(_without(_all(chosen, "[a-z]+"), *STREET_TYPE, *UNIT, *STOP), lambda t: F.length(t) > 1)
    others = F.filter(parts, lambda c, i: i + 1 != pick)
    rest = _without(F.flatten(F.transform(others, lambda c: _all(c, "[a-z]{3,}"))), *STOP)
    none = F.array().cast("array<string>")
    number = F.when(pick > 0, stripped(F.regexp_extract(chosen, r"\d+", 0)))
    return F.struct(number.alias("number"), F.when(pick > 0, _set(street)).otherwise(none).alias("street"), _set(rest).alias("rest"))


def _first(parts: Column, fits) -> Column:
    return F.array_position(F.transform(parts, fits), True)


def street_parts(folded: Column) -> Column:
    """(number, street, rest) with the first component that has a digit as the street."""
    parts = components(folded)
    return _parts(parts, _first(parts, lambda c: c.rlike(r"\d")).cast("int"))


def street_parts_typed(folded: Column) -> Column:
    """As street_parts, but rather a component with a digit and a street type that no unit word leads."""
    parts = components(folded)

    def typed(c: Column) -> Column:
        found = _all(c, "[a-z]+")
        return c.rlike(r"\d") & F.exists(found, lambda w: w.isin(*STREET_TYPE)) & ~F.coalesce(F.get(found, F.lit(0)).isin(*UNIT_LED), F.lit(False))

    best, any_ = _first(parts, typed), _first(parts, lambda c: c.rlike(r"\d"))
    return _parts(parts, F.when(best > 0, best).otherwise(any_).cast("int"))


def house_and_street(folded: Column) -> Column:
    """(number, street): the first token that is a number of at most five digits, with a letter or without, and the other
    tokens of its component with abbreviations written out, without stop words and numbers. -1 and empty without one."""
    lists = F.transform(components(folded), lambda c: _all(c, "[a-z0-9]+"))
    number = lambda t: t.rlike("^[0-9]{1,5}[a-z]?$")
    chosen = F.get(F.filter(lists, lambda ts: F.exists(ts, number)), F.lit(0))
    at = _first(chosen, number)
    full = F.create_map(*[F.lit(x) for kv in ABBREVIATION.items() for x in kv])
    rest = F.transform(F.filter(chosen, lambda t, i: i + 1 != at), lambda t: F.coalesce(full[t], t))
    street = F.array_join(F.filter(_without(rest, *STREET_STOP), lambda t: ~t.rlike("^[0-9]+$")), " ")
    found = F.regexp_extract(F.get(chosen, (at - 1).cast("int")), "^[0-9]+", 0).cast("int")
    return F.struct(F.coalesce(found, F.lit(-1)).alias("number"), F.coalesce(street, F.lit("")).alias("street"))


def street_signatures(folded: Column) -> Column:
    """(numbers, key) of every component that names a street: ordinals as o11, whether written as 11th or eleventh; street
    types, unit and stop words go. Components without a street type need a number of fewer than five digits."""
    ordinal = F.create_map(*[x for k, w in enumerate(ORDINALS, 1) for x in (F.lit(w), F.lit(f"o{k}"))])

    def one(c: Column) -> Column:
        ts = _all(c, "[a-z0-9]+")
        nums = F.transform(F.filter(ts, lambda t: t.rlike("^[0-9]+[a-z]{0,2}$") & ~t.rlike("^[0-9]+(st|nd|rd|th)$")), lambda t: stripped(F.regexp_extract(t, "^[0-9]+", 0)))

        def word(t: Column) -> Column:
            nth = F.when(t.rlike("^[0-9]+(st|nd|rd|th)$"), F.concat(F.lit("o"), stripped(F.regexp_extract(t, "^[0-9]+", 0))))
            plain = F.when(~t.rlike("^[0-9]") & ~t.isin(*STREET_TYPE, *UNIT_MORE, *STOP) & (F.length(t) > 1), t)
            return F.coalesce(nth, ordinal[t], plain)

        street = _set(F.filter(F.transform(ts, word), lambda t: t.isNotNull()))
        return F.struct(_set(nums).alias("numbers"), F.array_join(street, " ").alias("key"), F.exists(ts, lambda t: t.isin(*STREET_TYPE) & ~t.rlike("^[0-9]")).alias("typed"))

    found = F.transform(F.when(F.trim(folded) == "null", F.array().cast("array<string>")).otherwise(components(folded)), one)
    fine = F.filter(found, lambda x: (x["key"] != "") & (x["typed"] | F.exists(x["numbers"], lambda n: F.length(n) < 5)))
    return F.transform(fine, lambda x: F.struct(x["numbers"], x["key"]))


def locality(folded: Column) -> Column:
    """Words of the last two components after the first one; null without any."""
    parts = components(folded)
    last = F.when(F.size(parts) >= 2, F.slice(parts, F.greatest(F.lit(2), F.size(parts) - 1), F.lit(2)))
    key = F.array_join(_set(_without(F.flatten(F.transform(last, lambda c: _all(c, "[a-z]{2,}"))), *STOP)), " ")
    return F.when(key != "", key)


def street_key(parts: Column) -> Column:
    """Number and street tokens of street_parts() as one key; null if one of them lacks."""
    return F.when(parts["number"].isNotNull() & (F.size(parts["street"]) > 0), F.concat_ws("|", parts["number"], F.array_join(parts["street"], " ")))


def name_tags(name: Column, addr: Column) -> list[Column]:
    low = F.lower(F.trim(name))
    return [
        (F.trim(F.coalesce(addr, F.lit(""))) == "").alias("addr_empty"), (low.rlike(DOMAIN) & ~low.contains(" ")).alias("domain"), low.startswith("#").alias("hashtag"),
        low.rlike("[ऀ-෿]").alias("indic"), low.rlike(ALIAS).alias("alias"), (F.coalesce(addr, F.lit("")).contains("<NULL>") | name.contains("<NULL>")).alias("null_token"),
    ]


def name_relation(record: Column, owner: Column) -> Column:
    """How the record's name stands to its owner's: indic, url, core_eq, overlap or fake."""
    low = F.lower(F.trim(record))
    a, b = (_set(_without(tokens(x), *NAME_SUFFIX)) for x in (low, F.lower(owner)))
    return (
        F.when(low.rlike("[ऀ-෿]"), "indic").when(low.rlike("^[#@]") | low.rlike(DOMAIN), "url").when(a == b, "core_eq").when(F.arrays_overlap(a, b), "overlap").otherwise("fake")
    )


def number_relation(owner: Column, numbers: Column) -> Column:
    """How an owner's first number stands to a record's numbers (without leading zeros, in order)."""
    first = F.get(numbers, F.lit(0))
    value = lambda s: F.when(s == "", None).otherwise(s).cast("decimal(38,0)")
    d = F.abs(value(first) - value(owner))
    places = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length(owner), F.lit(1))), lambda i: F.substr(owner, i, F.lit(1)) != F.substr(first, i, F.lit(1))))
    return (
        F.when(owner.isNull(), "s1_nonum").when(first.isNull(), "rec_nonum").when(F.array_contains(numbers, owner), "exact").when(d.isNull(), "other")
        .when(owner.startswith(first) | first.startswith(owner), "prefix").when((F.length(owner) == F.length(first)) & (places == 1), F.when(d <= 2, "d<=2").otherwise("1digit"))
        .when(d <= 2, "d<=2").when(d <= 20, "d<=20").otherwise("far")
    )


def legal_like(token: Column) -> Column:
    """A legal form, or of its length and one substitution or swap of neighbours away from one of three letters and more."""
    def near(x: str) -> Column:
        swaps = [x[:i] + x[i + 1] + x[i] + x[i + 2 :] for i in range(len(x) - 1)]
        return (F.length(token) == len(x)) & ((F.levenshtein(token, F.lit(x)) == 1) | token.isin(*swaps))

    out = token.isin(*LEGAL)
    for x in LEGAL:
        if len(x) >= 3:
            out = out | near(x)
    return out


def number_typology(a: Column, b: Column) -> Column:
    """How a house number differs from another: SAME, PERM, DIGSUB, DIGINDEL, D1, D2, EVEN, ODD or MISSING."""
    d = F.abs(a.cast("decimal(38,0)") - b.cast("decimal(38,0)"))
    digits = lambda s: F.array_join(F.array_sort(F.split(s, "")), "")
    edits = F.levenshtein(a, b)
    return (
        F.when(a.isNull() | b.isNull(), "MISSING").when(a == b, "SAME").when(d == 1, "D1").when(d == 2, "D2").when(digits(a) == digits(b), "PERM")
        .when((edits == 1) & (F.length(a) == F.length(b)), "DIGSUB").when(edits == 1, "DIGINDEL").when(d % 2 == 0, "EVEN").otherwise("ODD")
    )


def unit_numbers(folded: Column) -> Column:
    """The distinct numbers or single letters behind unit words, without leading zeros."""
    found = _all(F.coalesce(folded, F.lit("")), r"\b(?:" + "|".join(sorted(set(UNIT_MORE), key=lambda w: (-len(w), w))) + r")[ .#]+(?:[0-9]+|[a-z])\b")
    return _set(F.transform(found, lambda u: stripped(F.regexp_extract(u, "([0-9]+|[a-z])$", 1))))


def street_typology(a: Column, b: Column, ratio: Column, set_ratio: Column) -> Column:
    """How street tokens differ: S_SAME, S_TYPO, S_PARTIAL, S_DIFF, or S_NA where a side has none.

    ratio, set_ratio: similarities from 0 to 1 of both sides' sorted tokens, joined by a blank.
    """
    none = (F.coalesce(F.size(a), F.lit(0)) < 1) | (F.coalesce(F.size(b), F.lit(0)) < 1)
    partial = F.arrays_overlap(a, b) | (set_ratio >= 0.8)
    return F.when(none, "S_NA").when(a == b, "S_SAME").when(ratio >= 0.8, "S_TYPO").when(partial, "S_PARTIAL").otherwise("S_DIFF")


def place_typology(a: Column, b: Column) -> Column:
    """C_SAME if the words of both places meet, else C_DIFF; C_NA where a side has none."""
    return F.when((F.size(a) < 1) | (F.size(b) < 1), "C_NA").when(F.arrays_overlap(a, b), "C_SAME").otherwise("C_DIFF")


def unit_typology(a: Column, b: Column) -> Column:
    """U_NONE, U_RECDROP (only a has units), U_RECADD (only b), U_SAME (they meet) or U_CHANGE."""
    x, y = F.size(a) > 0, F.size(b) > 0
    return F.when(~x & ~y, "U_NONE").when(~y, "U_RECDROP").when(~x, "U_RECADD").when(F.arrays_overlap(a, b), "U_SAME").otherwise("U_CHANGE")
