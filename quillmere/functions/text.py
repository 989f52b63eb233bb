"""Text functions as column expressions: tokens, stems, queries, snippets. All stay in the JVM.

Ids in brackets name the operators of the inventory that a function covers.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmere.functions import lexicon as L

TOKEN = r"[\p{L}\p{N}_]+(?:-[\p{L}\p{N}_]+)*"
_VOWELS = "aeiouyäåö"
_R1 = f"^[^{_VOWELS}]*[{_VOWELS}]+[^{_VOWELS}]"
#: The published Swedish Snowball suffixes. Anchored at the end, the leftmost match is the longest suffix.
_STEP1 = (
    "(heterna|hetens|anden|andes|andet|arens|arnas|ernas|heten|heter|ornas|ades|ande|aren|arna|arne|aste|erna|erns|orna|ade|are|ast|ens|ern|het|"
    "ad|ar|as|at|en|er|es|or|a|e)$"
)


def words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def any_of(column: Column, needles: list[str]) -> Column:
    """Whether the column contains any of the strings."""
    return reduce(lambda a, b: a | b, [column.contains(n) for n in needles])


def whole_word(phrases: list[str]) -> str:
    """A pattern for phrases as whole words, Unicode-aware without look-around."""
    return r"(^|[^\p{L}\p{N}_])(" + "|".join(phrases) + r")($|[^\p{L}\p{N}_])"


def tokenize(text: Column) -> Column:
    """Lower-cased words, hyphenated ones whole. [STR1]"""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def filter_tokens(tokens: Column, low: int = L.MIN_WORD, high: int = L.MAX_WORD) -> Column:
    """Tokens of a fitting length with a letter of a-z, å, ä, ö. [FLT5]"""
    return F.filter(tokens, lambda t: F.length(t).between(low, high) & t.rlike("[a-zåäöÅÄÖ]"))


def remove_stopwords(tokens: Column, stopwords: list[str] = L.STOPWORDS) -> Column:
    """[FLT4]"""
    return F.filter(tokens, lambda t: ~F.lower(t).isin(stopwords))  # a hash set, where an array would be gone through for each token


def terms(text: Column) -> Column:
    """The tokens that are indexed, before stemming. [STR3]"""
    return remove_stopwords(filter_tokens(tokenize(text)))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it and wherever the expression stands."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stem(word: Column) -> Column:
    """The published Swedish Snowball stemmer as one expression. [STR2]

    Each step names the one before several times, so each is bound; as nested expressions they would be computed hundreds of times a word.
    """

    def from_region(w: Column, at: Column) -> Column:
        def region(x: Column) -> Column:
            return F.substring(x, at + 1, F.length(x))

        def shorter(x: Column, n: Column | int) -> Column:
            return F.substring(x, F.lit(1), F.length(x) - n)

        def first(suffix: Column) -> Column:
            lone_s = region(w).endswith("s") & w.rlike("[bcdfghjklmnoprtvy]s$")
            return F.when(suffix != "", shorter(w, F.length(suffix))).when(lone_s, shorter(w, 1)).otherwise(w)

        def second(w1: Column) -> Column:
            return F.when(region(w1).rlike("(dd|gd|nn|dt|gt|kt|tt)$"), shorter(w1, 1)).otherwise(w1)

        def third(w2: Column) -> Column:
            cut = lambda last: F.when(last.isin("fullt", "löst"), shorter(w2, 1)).when(last != "", shorter(w2, F.length(last))).otherwise(w2)
            return bound(F.regexp_extract(region(w2), "(fullt|löst|els|lig|ig)$", 0), cut)

        return bound(bound(bound(F.regexp_extract(region(w), _STEP1, 0), first), second), third)

    start = lambda w: F.when(w.rlike(_R1), F.greatest(F.length(F.regexp_extract(w, _R1, 0)), F.lit(3))).otherwise(F.length(w))
    return bound(F.lower(word), lambda w: bound(start(w), lambda at: from_region(w, at)))


def stems(text: Column) -> Column:
    return F.transform(terms(text), stem)


def entities(text: Column) -> Column:
    """Map of capitalised words by kind; the first kind whose marks a word has. TIME is always empty. [STR18]"""
    found = F.filter(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda w: (F.length(w) > 2) & w.rlike(r"^\p{Lu}"))
    person = lambda w: any_of(F.lower(w), ["sson", "sen", "berg", "ström"])
    place = lambda w: any_of(F.lower(w), ["stad", "borg", "köping", "by"])
    body = lambda w: any_of(F.lower(w), ["verket", "myndigheten", "styrelsen"])
    return F.create_map(
        F.lit("PERSON"), F.filter(found, person), F.lit("PLACE"), F.filter(found, lambda w: ~person(w) & place(w)),
        F.lit("ORGANIZATION"), F.filter(found, lambda w: ~person(w) & ~place(w) & body(w)), F.lit("TIME"), F.array().cast("array<string>"),
    )


def term_frequencies(values: Column) -> Column:
    """Map of each value to its count. [AGG13]"""
    return F.map_from_entries(F.transform(F.array_distinct(values), lambda t: F.struct(t, F.size(F.filter(values, lambda x: x == t)))))


def synonyms(tokens: Column, table: dict[str, list[str]] = L.SYNONYMS) -> Column:
    """Each token and its synonyms, sorted. [STR8, SET4]"""
    lookup = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), words(v))])
    return F.array_sort(F.array_distinct(F.flatten(F.transform(tokens, lambda t: F.concat(F.array(t), F.coalesce(lookup[F.lower(t)], F.array().cast("array<string>")))))))


def expand_query(query: Column, table: dict[str, list[str]] = L.EXPANSIONS) -> Column:
    """Words of a query, each followed by its related words not seen before; related words lead back to their keys. [STR9]

    A related word is left out if it stood before; the query's own words are always kept.
    """
    # A key gives its list where it stands in the table, other keys that name the word give themselves.
    known = dict.fromkeys([*table, *(w for others in table.values() for w in others)])
    both = {w: [x for key, others in table.items() for x in (others if key == w else [key] if w in others else [])] for w in known}
    lookup = F.create_map(*[x for k, v in both.items() for x in (F.lit(k), words(v))])
    own = F.filter(F.transform(F.split(F.trim(F.regexp_replace(F.lower(query), r"\s+", " ")), " "), lambda w: F.regexp_replace(w, r"^[.,;:?!]+|[.,;:?!]+$", "")), lambda w: w != "")
    step = lambda acc, w: F.concat(acc, F.array(w), F.array_except(F.coalesce(lookup[w], F.array().cast("array<string>")), F.concat(acc, F.array(w))))
    return F.array_join(F.aggregate(own, F.array().cast("array<string>"), step), " ")


def reformulate_question(query: Column, starters: list[str] = L.STARTERS) -> Column:
    """The query lower-cased without its question mark and first matching starter. [STR10]"""
    q = F.trim(F.regexp_replace(F.trim(F.lower(query)), r"\?$", ""))
    return F.trim(F.regexp_replace(q, "^(?:" + "|".join(re.escape(s).replace(r"\ ", " ") for s in starters) + ")", ""))


def language_variants(query: Column) -> Column:
    """[STR11]"""
    reformulated = reformulate_question(query)
    return F.struct(query.alias("original"), reformulated.alias("reformulated"), expand_query(reformulated).alias("expanded"))


def alternate_terms(query: Column) -> Column:
    """(reformulated, tokens, filtered): the reformulated query's tokens, and those of letters only, longer than two, that are no stopwords. [STR12]

    What follows are ``swedish.split_all`` (balanced), ``stem`` and the distinct stems in order.
    """
    stop, reformulated = words(L.STOPWORDS), reformulate_question(query)
    tokens = tokenize(reformulated)
    kept = F.filter(tokens, lambda t: t.rlike(r"^\p{L}+$") & (F.length(t) > 2) & ~F.array_contains(stop, t))
    return F.struct(reformulated.alias("reformulated"), tokens.alias("tokens"), kept.alias("filtered"))


def question_type(query: Column, table: dict[str, list[str]] = L.QUESTION_TYPES) -> Column:
    """The last kind one of whose words begins the query or stands in it. [STR13]"""
    q = F.lower(query)
    hit = lambda ps: reduce(lambda a, b: a | b, [q.startswith(p) | q.contains(f" {p} ") for p in ps])
    return reduce(lambda case, kind: case.when(hit(table[kind]), kind), reversed(table), F).otherwise("STATEMENT")


def question_intent(query: Column, table: dict[str, list[str]] = L.QUESTION_INTENTS) -> Column:
    """The last intent one of whose strings the query contains. [STR14]"""
    q = F.lower(query)
    return reduce(lambda case, kind: case.when(any_of(q, table[kind]), kind), reversed(table), F).otherwise("GENERAL")


def detect_intent(query: Column) -> Column:
    """(intent, confidence). [STR15]"""
    q = F.lower(query)
    case = reduce(lambda case, kind: case.when(q.rlike(whole_word(L.INTENT_PHRASES[kind])), kind), L.INTENT_PHRASES, F)
    kind = case.when(any_of(q, L.INTENT_PLACES), "local").otherwise("information")
    confidence = F.when(q.rlike(whole_word([p for ps in L.INTENT_PHRASES.values() for p in ps])), 0.9).when(any_of(q, L.INTENT_PLACES), 0.7).when(any_of(q, L.INTENT_OFFICIAL), 0.8).otherwise(0.5)
    return F.struct(kind.alias("intent"), confidence.alias("confidence"))


def intent_boosts(intent: Column) -> Column:
    """Map of ranking boosts. [STR16]"""
    table = F.create_map(*[x for k, v in L.INTENT_BOOSTS.items() for x in (F.lit(k), F.create_map(*[y for n, b in v.items() for y in (F.lit(n), F.lit(b))]))])
    return table[intent]


def intent_query(query: Column) -> Column:
    """The query without question words. [STR17]"""
    q = F.lower(query)
    for removed in L.INTENT_REMOVED:
        q = F.regexp_replace(q, r"[?!]", "") if removed is None else F.regexp_replace(q, rf"(?U)\b{removed}\b", "")
    return F.trim(F.regexp_replace(q, r"\s+", " "))


def query_variants(query: Column) -> Column:
    """Variants of a query, the original first. [STR31]"""
    lowered = F.trim(F.lower(query))
    starter = "^(?:" + "|".join(L.VARIANT_STARTERS) + r")\s+"
    cleaned = F.trim(F.regexp_replace(lowered, starter, ""))
    normal = F.when(lowered.rlike(starter), cleaned).otherwise(lowered)
    parts = F.filter(F.split(F.regexp_replace(normal, r"\s+", " "), " "), lambda w: w != "")
    n = F.size(parts)
    empty = F.array().cast("array<string>")
    no_article = F.when((n > 1) & parts[0].isin(L.ARTICLES), F.array(F.array_join(F.slice(parts, 2, F.greatest(n - 1, F.lit(0))), " "))).otherwise(empty)
    one = F.try_element_at(parts, F.lit(1))
    cut = [F.when((n == 1) & (F.length(one) > 4) & one.endswith(s) & (F.length(one) > len(s) + 2), F.substring(one, F.lit(1), F.length(one) - len(s))) for s in L.DEFINITE_SUFFIXES]
    cut = F.filter(F.array(*cut), lambda x: x.isNotNull() & (F.length(x) > 2))
    hints = F.filter(F.array(*[F.when(normal.contains(h) & (n > 1), F.trim(F.replace(normal, F.lit(h), F.lit("")))) for h in L.COMPOUND_HINTS]), lambda x: x.isNotNull() & (x != ""))
    capital = F.when(n > 0, F.array(F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " "))).otherwise(empty)
    first = F.when(lowered.rlike(starter) & (cleaned != ""), F.array(cleaned)).otherwise(empty)
    return F.array_distinct(F.concat(F.array(query), first, no_article, cut, hints, capital))


def sanitize_query(query: Column, most: int = L.MAX_QUERY) -> Column:
    """The trimmed query without control characters, spaces collapsed; null where it is empty or too long. [STR27]"""
    q = F.trim(query)
    clean = F.trim(F.regexp_replace(F.regexp_replace(q, r"[\x00-\x08\x0B-\x1F\x7F]", ""), r"\s+", " "))
    return F.when((F.length(q) >= 1) & (F.length(q) <= most), clean)


def valid_query(query: Column) -> Column:
    """Why a query is refused, or ok. [FLT8]"""
    return F.when(query.isNull() | (F.trim(query) == ""), "empty").when(F.length(query) > L.MAX_QUERY, "too long").when(query.rlike(r"^[\p{L}\p{N}\s.\-_?!]*$"), "ok").otherwise("characters")


def escape_html(text: Column) -> Column:
    """[STR28]"""
    for old, new in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("/", "&#x2F;")]:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def strip_tags(text: Column) -> Column:
    """Tags are removed before script bodies, so a script's text stays. [STR29]"""
    return F.regexp_replace(F.regexp_replace(text, "<[^>]+>", ""), "(?is)<script[^>]*>.*?</script>", "")


def clean_html(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "<[^>]+>", ""))


def clean_snippet(text: Column, most: int = 200) -> Column:
    """Collapsed white space, cut at the last space within ``most`` characters. [STR30]"""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    head = F.substring(t, 1, most)
    whole = F.regexp_extract(head, "(?s)^(.*) ", 1)
    return F.when(F.length(t) > most, F.concat(F.when(head.contains(" "), whole).otherwise(head), F.lit("…"))).otherwise(t)


def slugify(text: Column) -> Column:
    """Letters and digits joined by hyphens; md5 of the text where nothing is left. [STR32]"""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", F.substring(F.md5(text), 1, 8)).otherwise(slug)


def cache_key(query: Column) -> Column:
    """[STR34]"""
    return F.md5(F.lower(F.trim(query)))


def password_hash(password: Column) -> Column:
    """[STR35]"""
    return F.sha2(password, 256)


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words, each with two spaces before and one after. [STR36]"""
    padded = F.transform(tokenize(text), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def matches_all(query: Column, text: Column) -> Column:
    """Whether every stem of the query is among the text's. [STR37]

    A word begins with its stem, so only those of the text's words that begin with a stem of the query are filtered and stemmed.
    """

    def held(wanted: Column) -> Column:
        near = F.array_distinct(F.filter(tokenize(text), lambda t: F.exists(wanted, lambda s: t.startswith(s))))
        return F.size(F.array_except(wanted, F.transform(remove_stopwords(filter_tokens(near)), stem))) == 0

    # By way of an array, so that the query is stemmed once a row and not once a token.
    return F.transform(F.array(F.array_distinct(stems(query))), held)[0]


def suggest(prefix: Column, values: list[str] = L.SUGGESTIONS, limit: int = 5) -> Column:
    """Up to ``limit`` (10 at most) values that begin with the prefix; none for a prefix of under two characters. [FLT9]"""
    found = F.filter(words(values), lambda s: F.lower(s).startswith(F.lower(prefix)))
    return F.when(F.length(prefix) >= 2, F.slice(found, 1, min(limit, 10))).otherwise(F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    """[PRJ7]"""
    return F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))


def search_terms(stem_list: Column, compounds: Column, expanded: Column, cap: int = L.TERM_CAP) -> Column:
    """The distinct union in order, or the first ``cap`` stems where it is longer. [SET1, COL8]"""
    union = F.array_distinct(F.concat(stem_list, compounds, expanded))
    return F.when(F.size(union) > cap, F.slice(stem_list, 1, cap)).otherwise(union)
