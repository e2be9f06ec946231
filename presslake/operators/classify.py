"""Topic classification: keyword rules, landed classifier responses, and a hook for an external scorer."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from presslake import dims
from presslake.functions.text import _col, is_empty, or_null
from presslake.operators.skew import anti_join, lookup_join
from presslake.operators.stage import computed

RESPONSE_DDL = "is_ai_topic BOOLEAN, confidence DOUBLE, topic STRING, explanation STRING, keywords ARRAY<STRING>"


def _terms(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _analysis(is_ai: Column, confidence: Column, topic: Column, explanation: Column, keywords: Column) -> Column:
    return F.struct(
        is_ai.alias("is_ai_topic"), confidence.cast("double").alias("confidence"), topic.cast("string").alias("topic"),
        explanation.alias("explanation"), keywords.alias("keywords"),
    )


def found_terms(body: Column | str, terms: list[str]) -> Column:
    """The terms that occur anywhere in the lower-case text, in list order. Each is searched once."""
    body = _col(body)
    return F.array_compact(F.array(*[F.when(body.contains(t), F.lit(t)) for t in terms]))


def keyword_analysis(found: Column | str, core: list[str] = dims.CORE_TERMS,
                     keywords: list[str] = dims.KEYWORD_TERMS,
                     rules: list[tuple[str, list[str]]] = dims.TOPIC_RULES, default_topic: str = dims.DEFAULT_TOPIC,
                     threshold: int = 3, max_keywords: int = 5) -> Column:
    """Verdict from the terms found in an article.

    `rules` are (topic, terms) pairs; the first pair with a term in the article names the topic. Confidence
    uses double arithmetic: 0.4 and a tenth per core term, at most 0.8.
    """
    found = _col(found)
    n = F.size(F.array_intersect(_terms(core), found))
    is_ai = n >= threshold
    topic = F.lit(default_topic)
    for name, terms in reversed(rules):
        topic = F.when(F.arrays_overlap(found, _terms(terms)), name).otherwise(topic)
    # The wording of the explanations is fixed.
    explanation = F.concat(
        F.lit("Fallback classification: "), n.cast("string"), F.lit(" AI terms found"),
        F.when(is_ai, "").otherwise(" - not sufficient for AI classification"),
    )
    return _analysis(
        is_ai, F.least(F.lit(0.8), F.lit(0.4) + n * F.lit(0.1)), F.when(is_ai, topic), explanation,
        F.slice(F.array_intersect(_terms(keywords), found), 1, max_keywords),
    )


def no_text_analysis() -> Column:
    return _analysis(
        F.lit(False), F.lit(0.0), F.lit(None), F.lit("No text content available"), F.array().cast("array<string>")
    )


def classify_keywords(df: DataFrame, text: str = "text", title: str = "title", core: list[str] = dims.CORE_TERMS,
                      keywords: list[str] = dims.KEYWORD_TERMS,
                      rules: list[tuple[str, list[str]]] = dims.TOPIC_RULES,
                      default_topic: str = dims.DEFAULT_TOPIC, threshold: int = 3) -> DataFrame:
    """Add `analysis` from keyword rules over title and text; a row without text is never a hit."""
    terms = list(dict.fromkeys([*core, *keywords, *(t for _, ts in rules for t in ts)]))
    body = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(text, F.lit(""))))
    # Two projections: the lowered text and the found terms are each computed once per row.
    staged = df.withColumn("__body", body).withColumn("__found", found_terms("__body", terms))
    verdict = keyword_analysis("__found", core, keywords, rules, default_topic, threshold)
    scored = staged.withColumn("analysis", F.when(is_empty(text), no_text_analysis()).otherwise(verdict))
    return computed(scored.drop("__body", "__found"), "classify_keywords")


def _json_kind(c: Column) -> Column:
    """'object' or 'other' for text that is exactly one JSON value, null for anything else.

    The JSON reader stops after the first value; inside brackets, trailing text makes the whole invalid.
    """
    boxed = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    single = (
        F.try_variant_get(boxed, "$[0]", "variant").isNotNull() & F.try_variant_get(boxed, "$[1]", "variant").isNull()
    )
    shape = F.schema_of_variant(boxed)
    return F.when(single & shape.startswith("ARRAY<OBJECT"), "object").when(single, "other")


def parse_responses(df: DataFrame, response: str = "response_text", text: str = "text", title: str = "title",
                    keywords: list[str] = dims.KEYWORD_TERMS, topics: list[str] = dims.TOPICS,
                    positive: list[str] = dims.POSITIVE_WORDS, default_topic: str = dims.DEFAULT_TOPIC) -> DataFrame:
    """Add `analysis` and `parsed_as` from classifier responses.

    A JSON object is read as it is (`json`); else the span from the first '{' to the last '}' (`embedded`);
    else the prose is searched for indicator words and topic names, and the keywords come from the article
    (`prose`). Any other JSON value is not an answer (`not_an_object`): its analysis is null.
    """
    reply = F.coalesce(response, F.lit(""))
    staged = df.withColumns({
        "__whole": _json_kind(reply),
        "__braces": or_null(F.regexp_extract(reply, r"(?s)\{.*\}", 0)),
    }).withColumn(
        "parsed_as",
        F.when(F.col("__whole") == "object", "json").when(F.col("__whole") == "other", "not_an_object")
        .when(_json_kind(F.col("__braces")) == "object", "embedded").otherwise("prose"),
    ).withColumn(
        "__json",
        F.from_json(
            F.when(F.col("parsed_as") == "json", reply).when(F.col("parsed_as") == "embedded", F.col("__braces")),
            RESPONSE_DDL,
        ),
    ).withColumns({
        "__lower": F.lower(reply),
        "__body": F.when(
            F.col("parsed_as") == "prose",
            F.lower(F.concat(F.lit("Title: "), F.coalesce(title, F.lit("")), F.lit("\n\nContent: "),
                             F.coalesce(text, F.lit("")))),
        ),
    })
    j = F.col("__json")
    from_json = _analysis(
        F.coalesce(j["is_ai_topic"], F.lit(False)), F.coalesce(j["confidence"], F.lit(0.5)), j["topic"],
        F.concat(F.lit(dims.EXPLANATION_PREFIX), F.coalesce(j["explanation"], F.lit("AI classification completed"))),
        F.coalesce(j["keywords"], F.array().cast("array<string>")),
    )
    is_ai = F.lit(False)
    for word in positive:
        is_ai = is_ai | F.col("__lower").contains(word)
    topic = F.lit(default_topic)
    for name in reversed(topics):
        topic = F.when(F.col("__lower").contains(name.lower()), name).otherwise(topic)
    from_prose = _analysis(
        is_ai, F.when(is_ai, F.lit(0.8)).otherwise(F.lit(0.7)), F.when(is_ai, topic),
        F.concat(F.lit("OpenAI manual parsing: "), F.substring(reply, 1, 100), F.lit("...")),
        F.slice(found_terms("__body", keywords), 1, 5),
    )
    parsed = staged.withColumn(
        "analysis",
        F.when(F.col("parsed_as") == "prose", from_prose).when(F.col("__json").isNotNull(), from_json),
    )
    return computed(parsed.drop("__whole", "__braces", "__json", "__lower", "__body"), "parse_responses")


def classify_mixed(df: DataFrame, responses: DataFrame, row_id: str = "url", **rules) -> DataFrame:
    """Landed response where there is one, keyword rules where there is none; `parsed_as` tells which.

    Of several answers for one address the last counts, by `landed_at` where `responses` has that column; equal times
    are settled by the text. `rules` are the parameters of `classify_keywords`.
    """
    order = [c for c in ("landed_at", "response_text") if c in responses.columns]
    answers = responses.groupBy("url").agg(F.max_by("response_text", F.struct(*order)).alias("response_text"))
    joined = lookup_join(df, answers, ["url"], [row_id])
    ruled = classify_keywords(joined, **rules).withColumnRenamed("analysis", "__ruled")
    parsed = parse_responses(
        ruled,
        keywords=rules.get("keywords", dims.KEYWORD_TERMS),
        default_topic=rules.get("default_topic", dims.DEFAULT_TOPIC),
    )
    landed = F.col("response_text").isNotNull() & F.col("analysis").isNotNull() & ~is_empty("text")
    return parsed.select(
        *df.columns,
        F.when(landed, F.col("analysis")).otherwise(F.col("__ruled")).alias("analysis"),
        F.when(landed, F.col("parsed_as")).otherwise("keywords").alias("parsed_as"),
    )


def flatten_analysis(df: DataFrame, keep: bool = False) -> DataFrame:
    """`analysis` as flat columns, with the English summary taken from its explanation."""
    a = F.col("analysis")
    replaced = {"ai_topic_detected", "ai_topic", "ai_confidence", "ai_keywords", "summary_en"}
    return df.select(
        *[c for c in df.columns if c not in replaced and (keep or c != "analysis")],
        F.coalesce(a["is_ai_topic"], F.lit(False)).alias("ai_topic_detected"),
        a["topic"].alias("ai_topic"),
        a["confidence"].alias("ai_confidence"),
        a["keywords"].alias("ai_keywords"),
        or_null(F.regexp_replace(a["explanation"], "^" + dims.EXPLANATION_PREFIX, "")).alias("summary_en"),
    )


def cache_key(url: str = "url", summary: str = "summary_en") -> Column:
    return F.coalesce(or_null(url), or_null(summary))


def fill_summaries(df: DataFrame, cache: DataFrame, force: bool = False, row_id: str = "url",
                   unique_urls: bool = False) -> DataFrame:
    """Second-language summary of hits from the cache, else the English text; `from_cache` tells which.

    Rows that are no hit get their English summary. `cache` has one row per `cache_key`; `force` ignores it.
    `unique_urls=True` states that every row has its own address, as after duplicate removal: no key can be
    frequent then, and the pass that looks for frequent keys is left out.
    """
    keyed = df.withColumn("cache_key", F.when(F.col("ai_topic_detected"), cache_key()))
    entries = cache.select("cache_key", F.col("summary").alias("__cached"))
    if force:
        cached = keyed.withColumn("__cached", F.lit(None).cast("string"))
    elif unique_urls:
        cached = keyed.join(entries, "cache_key", "left")
    else:
        cached = lookup_join(keyed, entries, ["cache_key"], [row_id])
    wanted = F.col("ai_topic_detected") & ~is_empty("summary_en")
    return cached.select(
        *[c for c in df.columns if c != "summary_da"],
        F.when(wanted, F.coalesce("__cached", "summary_en"))
        .when(F.col("ai_topic_detected"), "").otherwise(or_null("summary_en")).alias("summary_da"),
        (wanted & F.col("__cached").isNotNull()).alias("from_cache"),
    )


def missing_summaries(df: DataFrame, cache: DataFrame, row_id: str = "url") -> DataFrame:
    """Work-list for a translator: hits with an English summary and no cache entry."""
    wanted = df.filter(F.col("ai_topic_detected") & ~is_empty("summary_en")).withColumn("cache_key", cache_key())
    return anti_join(wanted, cache, ["cache_key"], [row_id]).select("cache_key", "url", "summary_en")


def translate_missing(df: DataFrame, cache: DataFrame, translator: Callable[[pd.DataFrame], pd.DataFrame], row_id: str = "url",
                      attempts: int = 3, backoff: float = 1.0) -> DataFrame:
    """(cache_key, summary) for the hits that the cache does not hold, from a translator of batches.

    `translator` gets batches of `cache_key, url, summary_en` and returns `cache_key, summary`. A failing batch is tried `attempts` times
    with doubling waits. What it then leaves out or gives empty keeps its English summary, which is cached as well.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            told: dict = {}
            for attempt in range(attempts):
                try:
                    result = translator(batch)
                    told = dict(zip(result["cache_key"], result["summary"]))
                except Exception:  # noqa: BLE001 - the service may fail in any way
                    if attempt + 1 < attempts:
                        time.sleep(backoff * 2**attempt)
                else:
                    break
            # An empty or missing answer is as good as none.
            texts = [t.strip() if isinstance(t := told.get(key), str) and t.strip() else english for key, english in zip(batch["cache_key"], batch["summary_en"])]
            yield pd.DataFrame({"cache_key": batch["cache_key"], "summary": texts})

    return missing_summaries(df, cache, row_id).mapInPandas(run, "cache_key string, summary string")


def merge_cache(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Cache with new entries; a new entry replaces an old one of the same key."""
    return (
        cache.select("cache_key", "summary", F.lit(0).alias("age"))
        .unionByName(new.select("cache_key", "summary", F.lit(1).alias("age")))
        .groupBy("cache_key").agg(F.max_by("summary", F.struct("age", "summary")).alias("summary"))
    )


def score_missing(df: DataFrame, scored: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType,
                  attempts: int = 3, backoff: float = 1.0) -> DataFrame:
    """Run an external batch scorer over the rows of `df` that `scored` does not hold yet.

    `scorer` gets a batch (`url` and whatever `df` carries) and returns rows of `schema`, which holds `url`. A failing
    batch is tried `attempts` times with doubling waits; when all fail, each of its rows comes back with nothing but its
    `url` and the message in `scorer_error`, so an incomplete result shows. `scored` may hold such rows: they stay
    on the work-list, and `classify_mixed` falls back to keyword rules for them. Land the result as a table: a
    re-run then only pays for what is missing.
    """
    done = scored.where("scorer_error IS NULL") if "scorer_error" in scored.columns else scored
    todo = anti_join(df, done, ["url"])
    out = T.StructType([*(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields]).add("scorer_error", T.StringType())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for attempt in range(attempts):
                try:
                    result = scorer(batch).assign(scorer_error=None)
                except Exception as error:  # noqa: BLE001 - the service may fail in any way
                    result = batch[["url"]].assign(scorer_error=f"{type(error).__name__}: {error}")
                    if attempt + 1 < attempts:
                        time.sleep(backoff * 2**attempt)
                else:
                    break
            result = result.reindex(columns=out.names).astype(object)
            yield result.where(result.notna(), None)

    return todo.mapInPandas(run, out)
