"""What a query is about: places, institutions, time and intent; and what that does to scores. Everything is a column expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.functions import lexicon as L
from quillmere.functions import swedish
from quillmere.functions import text as T
from quillmere.shared import quoted


def _found(q: Column, values: list[str]) -> Column:
    return F.filter(T.words(values), lambda v: q.contains(v))


def _strings() -> Column:
    return F.array().cast("array<string>")


def _table(rows: dict[str, object]) -> Column:
    return F.create_map(*[x for k, v in rows.items() for x in (F.lit(k), F.lit(v))])


def geography(query: Column) -> Column:
    """(scope, locations, boost): counties in order, the last one's scope; the first city overrides. [SEM1]"""
    q = F.lower(query)
    hits = F.filter(F.array(*[F.when(q.contains(k) | q.contains(v.lower()), F.lit(v)) for k, v in L.SCOPE_COUNTIES.items()]), lambda x: x.isNotNull())
    city = F.try_element_at(_found(q, list(L.SCOPE_CITIES)), F.lit(1))
    scope = F.coalesce(_table(L.SCOPE_CITIES)[city], F.try_element_at(hits, F.lit(-1)))
    places = F.concat(hits, F.when(city.isNotNull(), F.array(city)).otherwise(_strings()))
    return F.struct(scope.alias("scope"), places.alias("locations"), F.when(city.isNotNull(), 2.0).when(F.size(hits) > 0, 1.5).otherwise(1.0).alias("boost"))


def institutions(query: Column) -> Column:
    """(agencies, official, boost): official words set the boost to 2, also after an agency's 3. [SEM2]"""
    q = F.lower(query)
    agencies, word = _found(q, L.AGENCIES), T.any_of(q, L.OFFICIAL_WORDS)
    return F.struct(agencies.alias("agencies"), (word | (F.size(agencies) > 0)).alias("official"), F.when(word, 2.0).when(F.size(agencies) > 0, 3.0).otherwise(1.0).alias("boost"))


def temporal(query: Column) -> Column:
    """(holidays, expressions, boost, max_age_days): the last expression in order decides. [SEM3, DT4, DT8]"""
    q = F.lower(query)
    words = _found(q, list(L.FRESHNESS))
    last = F.try_element_at(words, F.lit(-1))
    return F.struct(
        _found(q, L.HOLIDAYS).alias("holidays"), words.alias("expressions"),
        F.coalesce(_table({k: b for k, (_, b) in L.FRESHNESS.items()})[last], F.lit(1.0)).alias("boost"),
        _table({k: d for k, (d, _) in L.FRESHNESS.items()})[last].alias("max_age_days"),
    )


def with_context(rows: DataFrame, query: str, name: str = "context") -> DataFrame:
    """Rows and everything known of their query in one struct. [SEM4, SEM5]

    Each part is a column of its own before others use it, so that it is worked out once.
    """
    q = F.col("_q")
    kept = [F.col(quoted(c)) for c in rows.columns]
    parts = rows.select(*kept, F.lower(F.col(query)).alias("_q")).select(*kept, "_q", geography(q).alias("_p"), institutions(q).alias("_b"), temporal(q).alias("_t"))
    place, body, time = F.col("_p"), F.col("_b"), F.col("_t")
    intent = (
        F.when(q.rlike(L.GUIDE_PATTERN), "GUIDE")
        .when(body["official"] | q.rlike(L.OFFICIAL_PATTERN), "OFFICIAL").when(q.rlike(L.NEWS_PATTERN), "NEWS")
        .when(q.rlike(L.DEFINITION_PATTERN), "DEFINITION")
        .when(q.rlike(L.PRACTICAL_PATTERN), "PRACTICAL_INFO").when(F.size(place["locations"]) > 0, "LOCAL").otherwise("GENERAL")
    )
    known = parts.select(*kept, "_p", "_b", "_t", intent.alias("_i"))
    intent = F.col("_i")
    confidence = F.when(intent == "DEFINITION", 0.85).when(intent == "LOCAL", 0.8).when(intent == "GENERAL", 0.0).otherwise(0.9)
    fresh = F.when(intent == "NEWS", 3.0).when(intent == "PRACTICAL_INFO", 2.0).otherwise(time["boost"])
    whole = F.struct(
        place["scope"].alias("scope"), place["locations"].alias("locations"), place["boost"].alias("region_boost"), body["agencies"].alias("agencies"),
        body["official"].alias("official"), body["boost"].alias("official_boost"), time["expressions"].alias("expressions"), time["holidays"].alias("holidays"),
        time["max_age_days"].alias("max_age_days"), fresh.alias("freshness_boost"), intent.alias("intent"), confidence.alias("confidence"),
        (place["boost"] * body["boost"] * fresh).alias("multiplier"),
    )
    return known.select(*kept, whole.alias(name))


def ranking_factors(c: Column) -> Column:
    """Factors of a context. The authority and length factors are given, not multiplied in. [MTH15]"""
    intent = _table(L.INTENT_MULTIPLIERS)[c["intent"]]
    authority = F.when(c["official"], 3.0).otherwise(1.0) * F.when(c["intent"] == "DEFINITION", 1.8).otherwise(1.0)
    return F.struct(intent.alias("intent_multiplier"), authority.alias("authority_boost"), _table(L.LENGTH_FACTORS)[c["intent"]].alias("content_length_factor"), (c["multiplier"] * intent).alias("combined"))


def answer_preferences(intent: Column) -> Column:
    """[SEM8]"""
    table = F.create_map(*[x for k, v in L.ANSWER_PREFERENCES.items() for x in (F.lit(k), F.struct(*[F.lit(y).alias(n) for y, n in zip(v, ("content_length", "source", "freshness_weight", "authority_weight"), strict=True)]))])
    return table[intent]


def document_signals(url: Column, title: Column, content: Column) -> Column:
    """(official, category, scope, institutions, compounds, authority_boost) of a document; compounds are the parts of the title's words. [SEM6]"""
    u, t, body = F.lower(url), F.lower(title), F.lower(content)
    official = T.any_of(u, L.OFFICIAL_URLS)
    category = (
        F.when(body.contains("guide") | t.contains("hur "), "GUIDE").when(body.contains("definition") | t.contains("vad är"), "DEFINITION")
        .when(u.contains("news") | u.contains("nyheter"), "NEWS").when(official, "OFFICIAL").otherwise("GENERAL")
    )
    return F.struct(official.alias("official"), category.alias("category"), geography(title)["scope"].alias("scope"), institutions(title)["agencies"].alias("institutions"), swedish.split_all(F.filter(F.split(t, r"\s+"), lambda w: w != ""), "known").alias("compounds"), F.when(official, 3.0).otherwise(1.0).alias("authority_boost"))


def relevance_boost(c: Column, d: Column) -> Column:
    """A document's boost (signals ``d``) under a query's context ``c``. [MTH16, JN15, SET5]"""
    same = F.coalesce(F.lower(c["scope"]) == F.lower(d["scope"]), F.lit(False))
    category = F.when(d["category"] == c["intent"], F.coalesce(_table(L.CATEGORY_BOOSTS)[c["intent"]], F.lit(1.0))).otherwise(1.0)
    official = F.when(c["official"] & d["official"], 3.0).otherwise(1.0)
    return official * F.when(same, 2.0).otherwise(1.0) * category * F.when(F.arrays_overlap(c["agencies"], d["institutions"]), 1.5).otherwise(1.0)


def semantic_terms(stems: Column, parts: Column, expanded: Column) -> Column:
    """[SEM7]"""
    return F.array_sort(F.array_union(F.array_union(stems, parts), expanded))


def reformulations(query: Column, intent: Column) -> Column:
    """[STR33] The patterns of guides are removed as literal text, so only plain ones match."""
    q = F.lower(query)
    guide = F.array(F.trim(F.replace(F.replace(q, F.lit("steg för steg"), F.lit("")), F.lit("instruktion"), F.lit(""))))
    pair = L.PAIR_PATTERN
    terms = F.when(q.rlike(pair), F.array(F.trim(F.regexp_extract(q, pair, 1)), F.trim(F.regexp_extract(q, pair, 2)))).otherwise(_strings())
    extra = lambda hit, values: F.when(hit, T.words(values)).otherwise(_strings())
    practical = F.concat(
        extra(q.contains("öppet"), L.REFORMULATED_HOURS), extra(q.contains("adress") | q.contains("lokalisering"), L.REFORMULATED_ADDRESS),
        extra(q.contains("telefon") | q.contains("nummer"), L.REFORMULATED_PHONE),
    )
    return F.when(intent == "GUIDE", guide).when(intent == "DEFINITION", terms).when(intent == "PRACTICAL_INFO", practical).otherwise(_strings())


def places_in(query: Column) -> Column:
    """Cities in order, then counties not found as cities. [JN7]"""
    q = F.lower(query)
    cities = _found(q, list(L.CITIES))
    return F.concat(cities, F.array_except(_found(q, L.COUNTIES), cities))


def query_place(query: Column) -> Column:
    """The known place that a pattern names: i X, från X, X kommun, X län. [SEM9]"""
    q, known = F.lower(query), [*L.CITIES, *L.COUNTIES]
    hits = [F.trim(F.regexp_extract(q, p, 1)) for p in L.PLACE_PATTERNS]
    return F.coalesce(*[F.when(h.isin(known), h) for h in hits])


def document_place(location: Column, url: Column, title: Column, content: Column) -> Column:
    """Given location, else a city or then a county in the URL, else a city in title and beginning of the content. [JN8]"""
    u, body = F.lower(url), F.concat_ws(" ", F.lower(title), F.substring(F.lower(content), 1, 500))
    first = lambda x, values: F.try_element_at(_found(x, values), F.lit(1))
    return F.coalesce(location, first(u, list(L.CITIES)), first(u, L.COUNTIES), first(body, list(L.CITIES)))


def county_of(place: Column) -> Column:
    """[JN14]"""
    p = F.lower(place)
    return F.coalesce(_table(L.CITIES)[p], F.when(p.isin(L.COUNTIES), p))


def regional_score(score: Column, doc: Column, query: Column, user: Column) -> Column:
    """[MTH14]"""
    def one(other: Column, same: float, near: float) -> Column:
        equal = F.coalesce(F.lower(other) == F.lower(doc), F.lit(False))
        county = F.coalesce(county_of(other) == county_of(doc), F.lit(False))
        return F.when(equal, same).when(county, near).otherwise(1.0)

    return F.least(F.lit(100.0), score * one(query, 2.0, 1.5) * one(user, 1.3, 1.2))


def boost_results(results: DataFrame, user_place: str | None = None) -> DataFrame:
    """Results (query, doc_id, score, url, title, content, location) with boosted scores and what led to them, best first. [SEM10, TOP5]"""
    user = F.lit(user_place).cast("string")
    placed = results.withColumn("query_place", query_place(F.col("query"))).withColumn("doc_place", document_place(F.col("location"), F.col("url"), F.col("title"), F.col("content")))
    boosted = placed.withColumn("original_score", F.col("score")).withColumn("score", regional_score(F.col("score"), F.col("doc_place"), F.col("query_place"), user))
    return boosted.withColumn("user_place", user).orderBy(F.desc("score"), F.asc("doc_id"))


def in_county(results: DataFrame, county: str, place: str = "doc_place") -> DataFrame:
    """[FLT12]"""
    return results.where(county_of(F.col(place)) == county.lower())


def in_city(results: DataFrame, city: str, place: str = "doc_place") -> DataFrame:
    """[FLT13]"""
    return results.where(F.lower(F.col(place)) == city.lower())


def month_number(name: Column) -> Column:
    """[DT4]"""
    return _table(L.MONTHS)[F.lower(name)]


def weekday_name(name: Column) -> Column:
    return _table(L.WEEKDAYS)[F.lower(name)]

