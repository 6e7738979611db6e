"""Text functions as Columns: normalisers, tokenisers, similarities, keys.  Nulls give null or an empty array."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

from tessera.functions.geometry import once

#: Cyrillic letters and their Latin spelling.
LATIN = {"а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l",
         "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh",
         "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya"}
#: Cyrillic letters and the Latin letters they look like.
LOOKALIKE = ("авеёкмнорстухі", "abeekmhopctyxi")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_match_text(c) -> Column:
    """Lower case, ё as е, everything but letters and digits as single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.lower(col(c)), "ё", "е"), r"[^\p{L}\p{N}]+", " "))


def transliterate(c) -> Column:
    """Lower-cased Cyrillic in Latin letters: digraphs first, then one to one."""
    out = F.lower(col(c))
    for a, b in LATIN.items():
        if len(b) > 1:
            out = F.replace(out, F.lit(a), F.lit(b))
    one = [(a, b) for a, b in LATIN.items() if len(b) == 1]
    gone = "".join(a for a, b in LATIN.items() if not b)
    return F.translate(out, "".join(a for a, _ in one) + gone, "".join(b for _, b in one))


def normalized(c) -> Column:
    """Comparable text: tags out, character references decoded, compatibility forms folded (NFKC), case folded, Cyrillic in Latin letters, words of letters and digits by single spaces.
    Null is empty.  Unicode folding has no built-in function, so this runs in Arrow batches."""
    table = str.maketrans(LATIN)

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str:
            t = unicodedata.normalize("NFKC", html.unescape(re.sub(r"<[^>]+>", " ", t or ""))).casefold().replace("ё", "е")
            return " ".join(re.findall(r"[^\W_]+", t.translate(table)))
        return texts.map(one)
    return run(col(c))


def year_set(c) -> Column:
    """The distinct years of a text, sorted: four digits from 1900 to 2099 that no further digit touches."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])"), F.lit(1))))


def fold_lookalikes(c) -> Column:
    """Cyrillic letters that look Latin become Latin where most letters of the text are Latin, and the other way round."""
    c = col(c)
    latin = F.length(F.regexp_replace(c, r"[^A-Za-z]", ""))
    cyrillic = F.length(F.regexp_replace(c, r"[^\p{IsCyrillic}]", ""))
    return F.when(latin >= cyrillic, F.translate(c, *LOOKALIKE)).otherwise(F.translate(c, LOOKALIKE[1], LOOKALIKE[0]))


def tokens(c, least: int = 1, stop: Sequence[str] = ()) -> Column:
    """Distinct tokens of the normalised text in order, without stop words and short ones."""
    t = F.filter(F.split(normalize_match_text(c), " "), lambda x: F.length(x) >= max(1, least))
    t = F.array_distinct(t)
    return F.array_except(t, F.array(*[F.lit(s) for s in stop])) if stop else t


def years(c) -> Column:
    return F.array_distinct(F.regexp_extract_all(col(c), F.lit(r"\b((?:19|20)[0-9]{2})\b"), F.lit(1)))


def first_year(c) -> Column:
    return F.nullif(F.regexp_extract(col(c), r"\b((?:19|20)[0-9]{2})\b", 1), F.lit("")).cast("int")


def canonical(c, synonyms: dict[str, str]) -> Column:
    """Tokens replaced by their canonical form."""
    if not synonyms:
        return col(c)
    m = F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv])
    return F.array_distinct(F.transform(col(c), lambda t: F.coalesce(F.try_element_at(m, t), t)))


def edit_similarity(a, b) -> Column:
    a, b = col(a), col(b)
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / n)


def jaccard(a, b) -> Column:
    a, b = col(a), col(b)
    u = F.size(F.array_union(a, b))
    return F.when(u > 0, F.size(F.array_intersect(a, b)) / u).otherwise(F.lit(0.0))


def overlap_of_larger(a, b) -> Column:
    a, b = col(a), col(b)
    n = F.greatest(F.size(a), F.size(b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(F.lit(0.0))


def coverage(a, b) -> Column:
    """Share of a's tokens that b holds."""
    a, b = col(a), col(b)
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(0.0))


def bigrams(c) -> Column:
    c = col(c)
    return F.when(F.length(c) >= 2, F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2)))).otherwise(
        F.expr("cast(array() as array<string>)"))


def dice(a, b) -> Column:
    """Multiset Dice coefficient of character bigrams."""
    x, y = bigrams(a), bigrams(b)
    count = lambda arr, v: F.size(F.filter(arr, lambda z: z == v))
    both = F.aggregate(F.array_distinct(x), F.lit(0), lambda s, v: s + F.least(count(x, v), count(y, v)))
    n = F.size(x) + F.size(y)
    return F.when(n > 0, 2.0 * both / n).otherwise((col(a) == col(b)).cast("double"))


def prefix_similarity(a, b, score: float = 0.82) -> Column:
    a, b = col(a), col(b)
    return F.when(a == b, 1.0).when((F.least(F.length(a), F.length(b)) >= 3) & (a.startswith(b) | b.startswith(a)), score).otherwise(0.0)


def substring_score(a, b, generic: Column | None = None) -> Column:
    """1 for equal texts, .85 where one holds the other, .75 if that one is generic, else 0."""
    a, b = col(a), col(b)
    inside = (F.length(a) > 0) & (F.length(b) > 0) & (a.contains(b) | b.contains(a))
    partial = F.when(generic, 0.75).otherwise(0.85) if generic is not None else F.lit(0.85)
    return F.when((a == b) & (F.length(a) > 0), 1.0).when(inside, partial).otherwise(0.0)


def token_ngrams(t, low: int = 2, high: int = 3) -> Column:
    return once(col(t), lambda x: F.concat(*[_ngram(x, n) for n in range(low, high + 1)]))


def _ngram(t: Column, n: int) -> Column:
    def one(i: Column) -> Column:
        return F.array_join(F.slice(t, i, F.lit(n)), " ")
    return F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), one)).otherwise(F.expr("cast(array() as array<string>)"))


def keywords(c, stop: Sequence[str] = (), limit: int = 6) -> Column:
    """Longest tokens first, no stop words, no numbers under four digits."""
    t = F.filter(tokens(c, 1, stop), lambda x: ~x.rlike("^[0-9]{1,3}$"))
    keyed = F.array_sort(F.transform(t, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("t"))))
    return F.slice(F.transform(keyed, lambda x: x["t"]), 1, limit)


def basename(c) -> Column:
    """Last path part of a URL or file path, without query and fragment."""
    return F.regexp_extract(col(c), r"([^/\\?#]*)(?:[?#].*)?$", 1)


def filename_key(c) -> Column:
    """Normal key of a file name: no extension, number sign or ten-digit hash suffix; Latin letters; single dashes."""
    s = F.regexp_replace(basename(c), r"\.[A-Za-z0-9]{1,5}$", "")
    s = F.regexp_replace(F.replace(s, F.lit("№"), F.lit("")), r"[-_][0-9a-f]{10}$", "")
    return F.regexp_replace(F.regexp_replace(transliterate(s), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def fnv1a(c) -> Column:
    """32-bit FNV-1a over the characters (code points of the basic plane)."""
    chars = F.filter(F.split(col(c), ""), lambda x: x != "")
    return F.aggregate(chars, F.lit(2166136261).cast("bigint"), lambda h, x: (h.bitwiseXOR(F.ascii(x).cast("bigint")) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF)))


def split_of(c, train: int = 70, validation: int = 20) -> Column:
    """Deterministic split by hash: train, validation or test."""
    b = fnv1a(c) % 100
    return F.when(b < train, "train").when(b < train + validation, "validation").otherwise("test")


def row_digest(*cols) -> Column:
    """Digest of the named columns, the same for any order they are given in."""
    return F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256)


def deterministic_uuid(c) -> Column:
    h = F.md5(col(c))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def text_type(c) -> Column:
    """What a line of text is: (kind, confidence)."""
    t = F.lower(F.trim(col(c)))
    kind = lambda k, p: F.struct(F.lit(k).alias("kind"), F.lit(p).alias("confidence"))
    return (F.when(t.rlike(r"^(19|20)[0-9]{2}$"), kind("year", 0.95)).when(t.rlike(r"^[0-9]{8,14}$"), kind("barcode", 0.9))
            .when(t.rlike(r"[0-9]+([.,][0-9]+)?\s*%"), kind("percentage", 0.9)).when(t.rlike(r"[0-9]+([.,][0-9]+)?\s*(ml|l|мл|л)\b"), kind("volume", 0.85))
            .when(t.rlike(r"^[0-9\s.,-]+$"), kind("number", 0.6)).when(t.rlike(r"\p{L}"), kind("text", 0.5)).otherwise(kind("other", 0.1)))


#: Short tokens that are meant.
SHORT_TERMS = r"(?i)^(xo|vs|igp|doc|aoc|docg)$"


def observation_validity(c, confidence, width, height, line: Column) -> tuple[Column, Column, Column]:
    """(score, valid, reasons) of a recognised text: confidence in percent, its box and whether it is a line."""
    t, one, zero = col(c), F.lit(1.0), F.lit(0.0)
    chars = F.regexp_replace(t, r"\s", "")
    letters = F.regexp_replace(t, r"[^\p{L}\p{N}]", "")
    n = F.length(letters)
    distinct = F.size(F.array_distinct(F.filter(F.split(F.lower(letters), ""), lambda x: x != "")))
    conf = F.greatest(zero, F.least(one, F.coalesce(col(confidence), zero) / 100))
    share = F.when(F.length(chars) > 0, n / F.length(chars)).otherwise(zero)
    diversity = F.when(n > 0, distinct / n).otherwise(zero)
    aspect = col(width) / F.greatest(F.lit(0.0001), col(height))
    plausible = aspect.between(0.12, 35) & (col(height) >= 0.006)
    short = t.rlike(r"^(19|20)[0-9]{2}$") | t.rlike(r"^[0-9]{2,4}$") | t.rlike(SHORT_TERMS)
    score = F.round(conf * 0.4 + F.least(one, n / F.when(line, 10).otherwise(5)) * 0.18 + diversity * 0.14 + share * 0.16 + plausible.cast("double") * 0.12, 4)
    why = F.array_compact(F.array(
        F.when(n == 0, F.lit("NO_ALPHANUMERIC_CONTENT")), F.when((n <= 2) & (conf < 0.45) & ~short, F.lit("LOW_CONFIDENCE_SHORT_TEXT")),
        F.when(share < 0.5, F.lit("LOW_ALPHANUMERIC_RATIO")), F.when(~plausible, F.lit("IMPLAUSIBLE_BBOX_GEOMETRY"))))
    valid = short | ((F.size(why) == 0) & (score >= 0.38))
    none = F.expr("cast(array() as array<string>)")
    return score, valid, F.when(valid, none).when(F.size(why) > 0, why).otherwise(F.array(F.lit("LOW_VALIDITY_SCORE")))


def search_forms(*parts) -> Column:
    """All spellings under which a row is found: each part and its tokens as they are and with look-alike letters of either script."""
    none = F.expr("cast(array() as array<string>)")

    def spelled(letters: tuple[str, str]):
        return lambda x: F.translate(x, *letters)

    def of(c) -> Column:
        text = F.trim(F.regexp_replace(F.regexp_replace(F.translate(F.lower(col(c).cast("string")), "ё", "е"), r"[^\p{L}\p{N}\s-]", " "), r"\s+", " "))
        plain = F.concat(F.array(text), F.split(text, " "))
        latin, cyrillic = (F.transform(plain, spelled(m)) for m in (LOOKALIKE, LOOKALIKE[::-1]))
        return F.when(F.length(text) > 0, F.concat(plain, latin, cyrillic)).otherwise(none)

    return F.array_join(F.filter(F.array_distinct(F.concat(*[F.coalesce(of(p), none) for p in parts])), lambda x: F.length(x) >= 2), " ")


def aliases(title, maker, category, region, year, code, service: Sequence[str] = ()) -> Column:
    """array<struct<value, type, weight>>: the names under which an item is known, blank ones left out, without repeats."""
    words = F.filter(F.split(normalize_match_text(title), " "), lambda x: F.length(x) > 1)
    bare = F.array_join(F.filter(words, lambda x: ~x.isin(*service)) if service else words, " ")
    made = [(normalize_match_text(title), "normalized-title", 1.0), (bare, "title-without-service-words", 0.95), (normalize_match_text(maker), "manufacturer", 0.85),
            (normalize_match_text(category), "category", 0.45), (normalize_match_text(region), "region", 0.4),
            (normalize_match_text(col(year).cast("string")), "year", 0.25), (normalize_match_text(code), "barcode", 1.0)]
    every = F.array(*[F.when(F.length(v) > 0, F.struct(v.alias("value"), F.lit(k).alias("type"), F.lit(w).alias("weight"))) for v, k, w in made])
    return F.array_distinct(F.array_compact(every))


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two texts; 0 where one is null or empty.  For pairs that blocking has found."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)])


def ratio_bound(a, b) -> Column:
    """An upper bound of ``ratio`` without Python: common blocks hold no letter more often than either text does, so they are at most the common letters, and at most the shorter text."""
    a, b = col(a), col(b)
    count = lambda t, x: F.length(t) - F.length(F.replace(t, x, F.lit("")))
    letters = F.array_distinct(F.filter(F.split(a, ""), lambda x: x != ""))
    common = F.aggregate(letters, F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))
    return F.when((F.length(a) > 0) & (F.length(b) > 0), 2.0 * common / (F.length(a) + F.length(b))).otherwise(0.0)


def ratio_floor(a, b) -> Column:
    """A lower bound of ``ratio`` without Python: the longest word that both texts hold is part of a common block.  0 for a second text of 200 letters or more, in which the standard
    library passes over common letters."""
    a, b = col(a), col(b)
    words = F.array_intersect(F.split(a, " "), F.split(b, " "))
    most = F.coalesce(F.array_max(F.transform(words, lambda w: F.length(w))), F.lit(0))
    return F.when((F.length(a) > 0) & (F.length(b) > 0) & (F.length(b) < 200), 2.0 * most / (F.length(a) + F.length(b))).otherwise(0.0)


def phrase_spans(words: Sequence[str], lexicon: dict[str, list[tuple[str, ...]]]) -> list[tuple[int, int, str]]:
    """(begin, end, phrase) of the longest phrases from left to right; lexicon: first word -> phrases as word tuples."""
    out, i = [], 0
    while i < len(words):
        fits = [p for p in lexicon.get(words[i], ()) if tuple(words[i:i + len(p)]) == p]
        best = max(fits, key=lambda p: (len(p), p), default=None)
        if best:
            out.append((i, i + len(best), " ".join(best)))
        i += len(best) if best else 1
    return out


def recognise_phrases(tokens, phrases: Sequence[str]) -> Column:
    """array<struct<begin, end, phrase>> of the phrases (a lexicon in memory, at most a few thousand) in an array of words."""
    lexicon: dict[str, list[tuple[str, ...]]] = {}
    for p in phrases:
        lexicon.setdefault(p.split()[0], []).append(tuple(p.split()))

    @F.pandas_udf(ArrayType(StructType().add("begin", IntegerType()).add("end", IntegerType()).add("phrase", StringType())))
    def run(t: pd.Series) -> pd.Series:
        return pd.Series([[{"begin": b, "end": e, "phrase": p} for b, e, p in phrase_spans(list(x), lexicon)] if x is not None else None for x in t])
    return run(col(tokens))


def changed_paths(a, b) -> Column:
    """Sorted names whose values differ between two maps, missing ones included."""
    a, b = col(a), col(b)
    names = F.array_union(F.map_keys(a), F.map_keys(b))
    return F.array_sort(F.filter(names, lambda k: ~F.try_element_at(a, k).eqNullSafe(F.try_element_at(b, k))))


#: Words before a year that make it a vintage, and words near it that make it another event's year.
VINTAGE = (r"(?:год\s+)?урожа[йя](?:\s*,?\s*в\s+нашем\s+случае)?", r"винтажа?", "vintage")
NO_VINTAGE = ("наград", "медал", "конкурс", "award", "competition", "розлив", "разлив", "bottl", "публикац")


def phrase_years(c, phrases: Sequence[str] = VINTAGE, excluded: Sequence[str] = NO_VINTAGE, before: int = 60, after: int = 35) -> Column:
    """The distinct years (1900 to 2099) that follow one of ``phrases`` (regular expressions), sorted.

    A clause ends at ``! ? ;``, a line's end, or a full stop that touches no digit on one of its sides.  A year does not count where one of the words ``excluded`` stands whole in the
    ``before`` code points ahead of the phrase or the ``after`` behind the year, without a comma between, or where a part of a date or decimal follows.
    Both windows are bounded look-arounds, so whole texts stay in the JVM.  Null: no years."""
    longest = max(map(len, excluded))
    if longest > min(before, after):
        raise ValueError("a word that is longer than its window can't stand in it")
    ahead = "|".join(f"{w}[^,]{{0,{before - len(w)}}}" for w in excluded)
    behind = "|".join(f"[^,]{{0,{after - len(w)}}}{w}" for w in excluded)
    named = "|".join(phrases)
    # the phrase first: looking back costs a window of letters, so only where one stands
    found = rf"(?iuU)\b(?={named})(?<!год\s)(?<!{ahead})(?:{named})\s*[:–—,-]?\s*((?:19|20)[0-9]{{2}})\b(?![./][0-9])(?!{behind})"
    clauses = F.split(F.coalesce(col(c), F.lit("")), r"(?<![0-9])\.|\.(?![0-9])|[!?;\n]")
    return F.array_sort(F.array_distinct(F.flatten(F.transform(clauses, lambda x: F.regexp_extract_all(x, F.lit(found), F.lit(1))))))


#: Classes of a normalised text and the patterns that show them; of CATEGORY and SWEETNESS the first that fits counts, of COLOUR the only one.
CATEGORY = (("rose", "rozov|rose|pink"), ("red", "krasn|red"), ("white", "bel|white"), ("orange", "oranzh|orange"))
SWEETNESS = (("semi_sweet", "poluslad|semi sweet|semisweet"), ("semi_dry", "polusuh|semi dry|semidry"), ("extra_brut", "ekstra bryut|extra brut"), ("brut", "bryut|brut"),
             ("sweet", "sladk|sweet"), ("dry", "suhoe|suhoj|dry"))
COLOUR = (("rose", "rozov|rose|pink"), ("red", "krasn|rubin|granat|purpur|red|ruby"), ("white", "solom|zolot|zhelt|yantar|white|gold"))


def first_class(c, rules: Sequence[tuple[str, str]], otherwise: Column | None = None) -> Column:
    """The first class of ``rules`` whose pattern is in the text; ``otherwise`` (null) if there is none."""
    return F.coalesce(*(F.when(col(c).rlike(p), k) for k, p in rules), F.lit(None).cast("string") if otherwise is None else otherwise)


def sole_class(c, rules: Sequence[tuple[str, str]]) -> Column:
    """The class of ``rules`` that fits, if exactly one does; else null."""
    fits = F.array_compact(F.array(*(F.when(col(c).rlike(p), k) for k, p in rules)))
    return F.when(F.size(fits) == 1, fits[0])


#: Misread words of recognised texts and what they stand for, applied in this order.
MISREAD = (("fanag0ria", "fanagoria"), ("cabemet", "cabernet"), ("kaberne", "cabernet"), ("saperav1", "saperavi"), ("2o2([0-9])", "202$1"), ("202!", "2021"), ("abrau durso", "abrau-durso"))


def recognised_text(c, fixes: Sequence[tuple[str, str]] = MISREAD) -> Column:
    """Lower case, ё as е, letters, digits and hyphens in words by single spaces, then ``fixes`` (pattern, replacement) one after the other."""
    out = F.trim(F.regexp_replace(F.regexp_replace(F.replace(F.lower(col(c)), F.lit("ё"), F.lit("е")), r"[^\p{L}\p{N}\s-]", " "), r"\s+", " "))
    for pattern, replacement in fixes:
        out = F.regexp_replace(out, pattern, replacement)
    return out


#: The kind of text that a source field holds, and how well a region's kind fits another kind of field.
FIELD_KIND = {"color": "color", "region": "region", "manufacturer": "producer", "category": "classification", "title": "product-name", "alias": "product-name", "description": "free-text"}
FIT = {("product-name", "producer"): 0.78, ("producer", "product-name"): 0.72, ("classification", "product-name"): 0.68, ("region", "free-text"): 0.58,
       ("free-text", "product-name"): 0.55, ("free-text", "producer"): 0.55, ("free-text", "region"): 0.55}


def field_fit(kind, field) -> Column:
    """How well a region of ``kind`` can show a source ``field``: 1 for its own kind, 0.65 where one of the two is unknown, a fixed value for related kinds, else 0.18."""
    known = F.create_map(*(F.lit(x) for p in FIELD_KIND.items() for x in p))
    near = F.create_map(*(F.lit(x) for (a, b), v in FIT.items() for x in (f"{a}>{b}", v)))
    k, f = F.coalesce(col(kind), F.lit("unknown")), F.coalesce(F.try_element_at(known, F.coalesce(col(field), F.lit(""))), F.lit("unknown"))
    return F.when((k == "unknown") | (f == "unknown"), 0.65).when(k == f, 1.0).otherwise(F.coalesce(F.try_element_at(near, F.concat(k, F.lit(">"), f)), F.lit(0.18)))
