"""Duplicate removal: inside a batch, against stored articles, by canonical domain and by content.

Every function works on narrow key columns first and returns to the full rows by a join on a unique
column, so article text is never carried through the key shuffles. Groups are reduced with min/max
aggregates, which combine copies before the shuffle; no step gathers a whole group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from presslake.functions.text import content_hash, is_empty, or_null, title_key
from presslake.functions.urls import base_domain
from presslake.operators.skew import anti_join, hot_hashes, repeat_salts, with_salt
from presslake.session import staged

KEY = ["__base", "__title"]


def _article_key(domain: str, title: str, two_part_suffixes: list[str] | None = None) -> list[Column]:
    """(base domain, title key); both null unless the row has a domain and a title."""
    usable = ~is_empty(domain) & ~is_empty(title_key(title))
    return [
        F.when(usable, base_domain(domain, two_part_suffixes)).alias("__base"),
        F.when(usable, title_key(title)).alias("__title"),
    ]


def known_urls(processed: DataFrame, rejected: DataFrame) -> DataFrame:
    """Distinct addresses already stored, accepted or rejected."""
    return processed.select("url").union(rejected.select("url")).distinct()


def new_urls(df: DataFrame, known: DataFrame, row_id: str = "ingest_rank") -> DataFrame:
    """Rows whose address is not known yet. Rows without an address pass."""
    return anti_join(df, known.filter(~is_empty("url")), ["url"], [row_id])


def new_titles(df: DataFrame, stored: DataFrame, row_id: str = "ingest_rank",
               two_part_suffixes: list[str] | None = None) -> DataFrame:
    """Rows whose (base domain, title) is not stored yet. Rows without a domain or a title pass."""
    keyed = df.select("*", *_article_key("domain", "title", two_part_suffixes))
    seen = stored.select(*_article_key("domain", "title", two_part_suffixes))
    return anti_join(keyed, seen, KEY, [row_id]).drop(*KEY)


def dedup_cross_run(df: DataFrame, known: DataFrame | None, stored: DataFrame, row_id: str = "ingest_rank",
                    two_part_suffixes: list[str] | None = None) -> DataFrame:
    """Drop known addresses, then stored (base domain, title) keys, then keep the first row of each key.

    `known=None` states that known addresses are already gone. The last two steps are one aggregate over both sides: a key survives when no stored row carries it,
    and its smallest `row_id` is the row to keep.
    """
    narrow = df.select(row_id, or_null("url").alias("url"), *_article_key("domain", "title", two_part_suffixes))
    fresh = narrow if known is None else anti_join(narrow, known, ["url"], [row_id])
    stored_keys = stored.select(*_article_key("domain", "title", two_part_suffixes)).dropna()
    no_row = F.lit(None).cast(df.schema[row_id].dataType)
    kept = (
        fresh.select(*KEY, F.when(F.col("__base").isNull(), F.col(row_id)).alias("__alone"), F.col(row_id),
                     F.lit(0).alias("__stored"))
        .unionByName(
            stored_keys.select(*KEY, no_row.alias("__alone"), no_row.alias(row_id), F.lit(1).alias("__stored"))
        )
        .groupBy(*KEY, "__alone")
        .agg(F.min(row_id).alias(row_id), F.max("__stored").alias("__stored"))
        .filter("__stored = 0")
        .select(row_id)
    )
    return df.join(kept, row_id, "left_semi").select(*df.columns)


#: Rounds of plain first rows before chains are followed: batches without long chains end within them.
PLAIN_ROUNDS = 1


def _jump(chain: DataFrame) -> DataFrame:
    """`chain` (rank, before, odd) with each row led to the end of its chain, and whether that is an odd number of steps away.

    Rows point four times as far after each stage, so a chain of n rows takes log4(n) of them. Rows at their end are set aside.
    """
    def hop(rows: DataFrame, steps: DataFrame) -> DataFrame:
        next_ = steps.select(F.col("__rank").alias("__before"), F.col("__before").alias("__next"), F.col("__odd").alias("__more"))
        return rows.join(next_, "__before", "left").select(
            "__rank", F.coalesce("__next", "__before").alias("__before"),
            (F.col("__odd") != F.coalesce("__more", F.lit(False))).alias("__odd"), F.col("__next").isNotNull().alias("__moved"))

    done, open_ = [], chain
    while not open_.isEmpty():
        steps = reduce(DataFrame.unionByName, [*done, open_])
        told = staged(hop(hop(hop(open_, steps), steps), steps))
        done.append(told.where(~F.col("__moved")).drop("__moved"))
        open_ = told.where("__moved").drop("__moved")
    return reduce(DataFrame.unionByName, [*done, open_])


def _first_by_chains(left: DataFrame) -> DataFrame:
    """Ranks of rows that are certainly kept: first rows under address and key, and every second row of chains that start there.

    A row whose only earlier rivals are one single row is kept exactly if that row is not. Such rows point at their rival, and
    the parity of the way to a first row settles the whole chain. Chains that start at a row with several rivals wait.
    """
    url, key = F.concat(F.lit("u"), "url"), F.concat_ws("\n", F.lit("k"), *KEY)
    ends = left.where("url is not null").select("__rank", url.alias("__node")).unionByName(
        left.where("__base is not null").select("__rank", key.alias("__node")))
    first = ends.groupBy("__node").agg(F.min("__rank").alias("__rank"))
    later = ends.join(first, ["__node", "__rank"], "left_anti")
    second = later.groupBy("__node").agg(F.min("__rank").alias("__second"))
    rival = first.join(second, "__node").select(F.col("__second").alias("__rank"), F.col("__rank").alias("__before"))
    no = F.lit(None).cast(left.schema["__rank"].dataType)
    told = (
        ends.select("__rank", F.lit(1).alias("__ends"), F.lit(0).alias("__firsts"), no.alias("__before"))
        .unionByName(first.select("__rank", F.lit(0).alias("__ends"), F.lit(1).alias("__firsts"), no.alias("__before")))
        .unionByName(rival.select("__rank", F.lit(0).alias("__ends"), F.lit(0).alias("__firsts"), "__before"))
        .groupBy("__rank").agg(F.sum("__ends").alias("__ends"), F.sum("__firsts").alias("__firsts"), F.count("__before").alias("__rivals"), F.max("__before").alias("__before"))
    )
    told = staged(told.where("__firsts = __ends or (__rivals = 1 and __firsts = __ends - 1)"))
    heads = told.where("__firsts = __ends").select("__rank")
    chain = told.where("__firsts < __ends").select("__rank", "__before", F.lit(True).alias("__odd"))
    even = _jump(chain).where(~F.col("__odd")).join(heads.select(F.col("__rank").alias("__before")), "__before", "left_semi")
    return heads.unionByName(even.select("__rank"))


def dedup_batch(df: DataFrame, row_id: str = "ingest_rank", two_part_suffixes: list[str] | None = None,
                plain_rounds: int = PLAIN_ROUNDS) -> DataFrame:
    """Go through the rows in `row_id` order and keep a row unless a kept row shares its address or key.

    A dropped row hides nothing, so two independent "keep first" steps would drop too much. Each round
    keeps the rows that come first both under their address and under their key, removes every row those
    cover, and repeats on what is left. After `plain_rounds` such rounds, a round also follows the chains in which each row waits for one
    earlier row, so a chain of any length is settled in one round of logarithmically many stages. Copies of one (address, key)
    pair are merged beforehand: only the first of them can ever be kept.
    """
    free = F.col("url").isNull() & F.col("__base").isNull()
    rows = staged(
        df.select(row_id, or_null("url").alias("url"), *_article_key("domain", "title", two_part_suffixes))
        .groupBy("url", *KEY, F.when(free, F.col(row_id)).alias("__alone"))
        .agg(F.min(row_id).alias("__rank"))
        .drop("__alone")
    )
    kept = [rows.filter(free).select(F.col("__rank").alias(row_id))]
    # Rows only leave the set, so a key that is not frequent now can never become a hot group later.
    rows = rows.filter(~free)
    hot_url, hot_key = hot_hashes(rows, ["url"], KEY)
    left = with_salt(rows, ["url"], hot_url, ["__rank"], "__url_salt")
    left = with_salt(left, KEY, hot_key, ["__rank"], "__key_salt")
    tests = F.col("url").isNotNull().cast("int") + F.col("__base").isNotNull().cast("int")
    rounds = 0
    while not left.isEmpty():
        # Only numbers are aggregated: fixed-width state keeps these in hash aggregates, without a sort.
        if rounds < plain_rounds:
            firsts = (
                left.dropna(subset=["url"]).groupBy("url").agg(F.min("__rank").alias("__rank")).select("__rank")
                .unionByName(left.dropna(subset=KEY).groupBy(*KEY).agg(F.min("__rank").alias("__rank")).select("__rank"))
                .groupBy("__rank").agg(F.count(F.lit(1)).alias("__firsts"))
            )
            first = staged(left.join(firsts, "__rank").filter(F.col("__firsts") == tests).select("__rank", "url", *KEY))
        else:
            first = staged(left.join(_first_by_chains(left), "__rank", "left_semi").select("__rank", "url", *KEY))
        rounds += 1
        kept.append(first.select(F.col("__rank").alias(row_id)))
        urls = repeat_salts(first.select("url").dropna(), ["url"], hot_url, "__url_salt")
        keys = repeat_salts(first.select(*KEY).dropna(), KEY, hot_key, "__key_salt")
        left = staged(
            left.join(urls, ["url", "__url_salt"], "left_anti").join(keys, [*KEY, "__key_salt"], "left_anti")
        )
    return df.join(reduce(DataFrame.unionByName, kept), row_id, "left_semi").select(*df.columns)


def dedup_loss(before: DataFrame, after: DataFrame, danish: Column, row_id: str = "ingest_rank") -> DataFrame:
    """One row: how many rows a dedup step removed, Danish and other, and how many it kept."""
    marked = before.select(row_id, danish.alias("__danish")).join(
        after.select(row_id, F.lit(True).alias("__kept")), row_id, "left"
    )
    gone = F.col("__kept").isNull()
    return marked.agg(
        F.count_if(gone).alias("removed"),
        F.count_if(gone & F.col("__danish")).alias("removed_danish"),
        F.count_if(gone & ~F.col("__danish")).alias("removed_other"),
        F.count_if(~gone).alias("kept"),
    )


def canonical_articles(df: DataFrame, two_part_suffixes: list[str] | None = None) -> DataFrame:
    """One row per (base domain, title): the shortest domain, then the most recent, then the smallest address.

    `df` has unique addresses, as the stored table has.
    """
    order = F.struct(
        F.length(F.coalesce("domain", F.lit(""))).alias("length"),
        F.negative(F.unix_micros("processed_at")).alias("age"),
        F.col("url"),
    )
    best = (
        df.groupBy(
            F.coalesce(base_domain("domain", two_part_suffixes), F.lit("")).alias("__base"),
            F.coalesce(title_key("title"), F.lit("")).alias("__title"),
        )
        .agg(F.min(order).alias("best"))
        .select("best.url")
    )
    return df.join(best, "url", "left_semi").select(*df.columns)


def duplicate_texts(df: DataFrame, row_id: str, text: str = "text") -> DataFrame:
    """Content hashes carried by more than one row, with the copy count and the first row."""
    return (
        df.select(row_id, content_hash(text).alias("content_hash"))
        .dropna(subset=["content_hash"])
        .groupBy("content_hash")
        .agg(F.count(F.lit(1)).alias("copies"), F.min(row_id).alias("first_id"))
        .filter("copies > 1")
    )


def keep_first_text(df: DataFrame, row_id: str, text: str = "text") -> DataFrame:
    """Drop rows whose text equals that of an earlier row; rows without text stay."""
    narrow = df.select(row_id, content_hash(text).alias("__hash"))
    first = (
        narrow.groupBy("__hash", F.when(F.col("__hash").isNull(), F.col(row_id)).alias("__alone"))
        .agg(F.min(row_id).alias(row_id))
        .select(row_id)
    )
    return df.join(first, row_id, "left_semi").select(*df.columns)
