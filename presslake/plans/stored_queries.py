"""Registered queries of keyed tables, membership filters, incremental loads, sketches, rollups and stateful streams, next to their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F, types as T

from presslake import schemas
from presslake.operators import dedup, quality, rollup, sketches, substrings
from presslake.plans import standins as st
from presslake.plans.queries import TIME, query, scratch
from presslake.session import staged
from presslake.sources import keyed, marks, members, paged, readers, store
from presslake.streaming import failures as failing, ingest, progress

BUCKETS = 4

# ---- keyed tables ----------------------------------------------------------------------------------------

TWO_BATCHES = """SELECT url, title, 'b1' AS batch_id, processed_at FROM docs JOIN labels USING (doc_id)
    UNION ALL SELECT url, 'Update: ' || title, 'b2', processed_at + INTERVAL 40 DAYS FROM docs WHERE length(text) >= 700"""
NEWEST = f"SELECT * FROM ({TWO_BATCHES}) QUALIFY row_number() OVER (PARTITION BY url ORDER BY processed_at DESC) = 1"


def _two_batches(spark, sf_dir):
    """A keyed table of articles: those with a label, then later all long ones under a new title."""
    path = scratch(spark, "keyed")
    # A day holds 24 articles, and the tables span decades.
    keyed.create(spark, path, schemas.STORED, "url", BUCKETS, "decade")
    old = st.labelled(spark, sf_dir).drop("text").withColumn("batch_id", F.lit("b1"))
    keyed.append(old, path, batch_id="b1")
    new = quality.long_enough(st.articles(spark, sf_dir)).drop("text").withColumns({
        "title": F.concat(F.lit("Update: "), "title"), "batch_id": F.lit("b2"), "processed_at": F.col("processed_at") + F.expr("INTERVAL 40 DAYS")})
    keyed.append(new, path, batch_id="b2")
    return path


@query("docs", f"SELECT url, title, batch_id FROM ({NEWEST})")
def keyed_current(spark, sf_dir):
    return keyed.current(spark, _two_batches(spark, sf_dir)).select("url", "title", "batch_id")


@query("docs", f"SELECT url, title, strftime(processed_at, {TIME}) AS processed_at FROM ({NEWEST}) ORDER BY processed_at DESC, url LIMIT 10")
def keyed_recent(spark, sf_dir):
    """The ten newest articles after base and deltas were folded, and a batch ran again with the same rows."""
    path = _two_batches(spark, sf_dir)
    keyed.merge(spark, path)
    old = st.labelled(spark, sf_dir).drop("text").withColumn("batch_id", F.lit("b3"))
    keyed.append(old, path, batch_id="b3")
    newest = keyed.current(spark, path).orderBy(F.desc("processed_at"), "url").limit(10)
    return newest.select("url", "title", st.show_time("processed_at").alias("processed_at"))


# ---- membership filters ----------------------------------------------------------------------------------


@query("known docs", "SELECT doc_id FROM docs WHERE url NOT IN (SELECT url FROM known)")
def new_urls_filtered(spark, sf_dir):
    """As new_urls, with the known addresses in a stored table whose days are read only where their filters ask for it."""
    path = scratch(spark, "history")
    stored = st.labelled(spark, sf_dir).select("url", "title", "processed_at").withColumn("batch_id", F.lit("b1"))
    store.create(spark, path, "year")
    members.write(stored, path, batch_id="b1")
    store.append_batch(stored, path, batch_id="b1")
    rows = st.articles(spark, sf_dir).select("doc_id", "url", "ingest_rank")
    return members.new_rows(rows, path, schemas.STORED).select("doc_id")


# ---- duplicates ------------------------------------------------------------------------------------------


@query("docs", """SELECT doc_id FROM (SELECT doc_id, doc_id - min(doc_id) OVER (PARTITION BY run) AS place FROM (
    SELECT doc_id, doc_id - row_number() OVER (ORDER BY doc_id) AS run FROM (SELECT DISTINCT doc_id FROM docs))) WHERE place % 2 = 0""")
def dedup_long_chain(spark, sf_dir):
    """Each article shares its address with the one before or its title with the one behind, so all of them are one chain."""
    n = F.col("doc_id")
    rows = st.articles(spark, sf_dir).select(
        "doc_id", n.alias("ingest_rank"), F.concat(F.lit("u"), F.floor((n + 1) / 2).cast("string")).alias("url"),
        F.lit("example.com").alias("domain"), F.concat(F.lit("t"), F.floor(n / 2).cast("string")).alias("title"))
    return dedup.dedup_batch(rows).select("doc_id")


# ---- incremental loads -----------------------------------------------------------------------------------


@query("docs", "SELECT url, CASE WHEN processed_at < TIMESTAMP '2024-01-05' THEN 'b1' ELSE 'b2' END AS batch_id FROM docs")
def incremental_load(spark, sf_dir):
    """Two batches load what has landed since the one before; then the first one runs again and stores the same."""
    root = scratch(spark, "incremental")
    feed = st.articles(spark, sf_dir).select(
        "url", "title", F.col("published_at").alias("seendate"), "domain", "language", F.col("source_country").alias("sourcecountry"), "processed_at")
    # The first days land one by one; the decades after them, of 24 articles a day, in folders named by the last day of each year.
    for batch_id, landed, named in (("b1", "processed_at < '2024-01-05'", "yyyyMMdd"), ("b2", "processed_at >= '2024-01-05'", "yyyy'1231'"), ("b1", None, None)):
        if landed:
            rows = feed.where(landed).select(*schemas.FEED.names, F.date_format("processed_at", named).alias("landed"))
            rows.hint("rebalance", "landed").write.mode("append").partitionBy("landed").parquet(f"{root}/feed")
        span = marks.span_of(spark, f"{root}/feed", f"{root}/marks", batch_id)
        rows = marks.read_span(spark, f"{root}/feed", span, schemas.FEED)
        stored = rows.select("url", F.lit(batch_id).alias("batch_id"), F.lit("2024-01-01").cast("timestamp").alias("processed_at"))
        store.append_batch(stored, f"{root}/stored", batch_id=batch_id)
        marks.save_mark(spark, f"{root}/marks", batch_id, span)
    return readers.read_table(spark, f"{root}/stored", schemas.STORED).select("url", "batch_id")


# ---- sketches and rollups --------------------------------------------------------------------------------


@query("docs", """SELECT strftime(d, '%Y-%m-%d') AS day, count(*) AS rows, count(DISTINCT language) AS languages, count(DISTINCT domain) AS domains,
    true AS urls_close FROM (SELECT DISTINCT processed_at::DATE AS d FROM docs) JOIN docs ON processed_at::DATE BETWEEN d - 6 AND d GROUP BY 1""")
def distinct_last_days(spark, sf_dir):
    """Distinct values of the last seven days, each day, from stored sketches of single days; two writers of a day are united."""
    path, rows = scratch(spark, "sketches"), st.articles(spark, sf_dir)
    columns = ["language", "domain", "url"]
    for parity in (0, 1):
        sketches.day_sketches(rows.where(F.col("doc_id") % 2 == parity), columns).write.mode("append").parquet(path)
    kept = sketches.united(spark.read.parquet(path))
    told = sketches.distinct_trailing(kept, 7)
    # Each address is an article here, so rows are the exact count.
    close = F.abs(F.col("url") - F.col("rows")) <= 0.08 * F.col("rows")
    return told.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "rows", F.col("language").alias("languages"), F.col("domain").alias("domains"), close.alias("urls_close"))


ROLLED = """SELECT s.doc_id, s.domain_category, s.topic, s.language, s.is_ai AND coalesce(quality, 0) = 0 AS ai,
    CASE WHEN quality = 1 THEN 'fixed' ELSE s.topic END AS new_topic, s.processed_at FROM stored s LEFT JOIN labels USING (doc_id)"""


@query("stored", f"""SELECT domain_category, coalesce(new_topic, '') AS ai_topic, language, count(*) AS articles, count(*) FILTER (ai) AS ai_articles
    FROM ({ROLLED}) WHERE processed_at >= TIMESTAMP '2024-01-03' GROUP BY 1, 2, 3""")
def rolled_up_counts(spark, sf_dir):
    """Counts kept by changes: articles come in two batches, those with a good label are replaced, and two days leave."""
    path = scratch(spark, "rollup")
    rows = st.stored(spark, sf_dir).select("doc_id", "url", "processed_at", "domain_category", "ai_topic", "language", "domain", "ai_topic_detected")
    good = st.table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    fixed = rows.join(good, "doc_id", "left_semi").withColumns({"ai_topic": F.lit("fixed"), "ai_topic_detected": F.lit(False)})
    half = F.col("doc_id") % 2 == 0
    held = rows.where(half)
    for number, (before, batch) in enumerate([(rows.limit(0), held), (held, rows.where(~half)), (rows, fixed)]):
        rollup.changes(before, batch).write.parquet(f"{path}/batch={number}")
    kept = rollup.kept_days(rollup.merged(spark.read.parquet(path).drop("batch")), dt.datetime(2024, 2, 2), 30)
    out = rollup.distribution(kept.withColumn("ai_topic", F.coalesce("ai_topic", F.lit(""))), "domain_category", "ai_topic", "language")
    return out.select("domain_category", "ai_topic", "language", "articles", "ai_articles")


# ---- files of the older layout ---------------------------------------------------------------------------


@query("docs", """SELECT language, count(*) AS articles, sum(length(text))::BIGINT AS chars, count(DISTINCT md5(text)) AS texts FROM docs GROUP BY 1""")
def old_batch_files(spark, sf_dir):
    """Articles as indented JSON arrays, a file for each batch of 256, read back."""
    path = scratch(spark, "old-files")
    rows = st.articles(spark, sf_dir).select("url", "title", "text", "language", F.floor(F.col("doc_id") / 256).alias("batch"))
    arrays = rows.groupBy("batch").agg(F.to_json(F.collect_list(F.struct("url", "title", "text", "language")), {"pretty": "true"}).alias("value"))
    arrays.write.partitionBy("batch").text(path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("url", "title", "text", "language")])
    back = readers.read_batch_json(spark, path, schema)
    return back.groupBy("language").agg(F.count(F.lit(1)).alias("articles"), F.sum(F.length("text")).alias("chars"), F.count_distinct(F.md5("text")).alias("texts"))


# ---- lists and long lists of substrings -------------------------------------------------------------------


@query("stored", "SELECT url, title, domain FROM stored ORDER BY processed_at DESC, url LIMIT 10 OFFSET 130")
def browse_page_indexed(spark, sf_dir):
    """Page 14 of all articles, read from the one or two ranges of the list that hold it."""
    path = scratch(spark, "list")
    paged.write_index(st.stored(spark, sf_dir), path, 8)
    return paged.read_page(spark, path, 14).select("url", "title", "domain")


@query(sql="""SELECT p.page_id, count(DISTINCT part) AS parts FROM pages p JOIN (
    SELECT DISTINCT lower(split_part(text, ' ', 2)) AS part FROM documents WHERE length(split_part(text, ' ', 2)) > 0) ON contains(lower(p.url), part) GROUP BY 1""")
def substring_list(spark, sf_dir):
    """Which of a list as long as the documents (the second word of each) stand in an address, by an index of q-grams."""
    entries = st.table(spark, sf_dir, "documents").select(F.lower(F.split_part("text", F.lit(" "), F.lit(2))).alias("entry"))
    found = substrings.matches(st.table(spark, sf_dir, "pages"), F.lower("url"), entries, "page_id")
    return found.groupBy("page_id").agg(F.count(F.lit(1)).alias("parts"))


# ---- stateful streams ------------------------------------------------------------------------------------

FAILURE_DAYS = 7
OUTCOMES = """SELECT 'site' || user_id || '.example.com' AS domain, date_trunc('second', ts) AS seen, event_type = 'purchase' AS ok FROM events
    WHERE event_type IN ('error', 'purchase')"""


def _outcomes(rows):
    return rows.where("event_type IN ('error', 'purchase')").select(
        F.concat(F.lit("site"), F.col("user_id").cast("string"), F.lit(".example.com")).alias("domain"),
        F.date_trunc("second", "ts").cast("timestamp").alias("at"), (F.col("event_type") == "purchase").alias("ok"))


@query(sql=f"""WITH outcomes AS ({OUTCOMES}), now AS (SELECT max(seen) - INTERVAL 1 HOUR AS until FROM outcomes),
    past AS (SELECT *, max(CASE WHEN ok THEN seen END) OVER (PARTITION BY domain) AS reset FROM outcomes, now WHERE seen < until)
    SELECT domain, count(*) AS failures FROM past WHERE NOT ok AND (reset IS NULL OR seen > reset)
    AND date_trunc('day', seen) + INTERVAL {FAILURE_DAYS + 1} DAYS > until GROUP BY 1""")
def stream_failing_domains(spark, sf_dir):
    """Failures that a stream still counts per domain: a purchase resets them, and they expire after a week."""
    path = scratch(spark, "failing")
    schema = st.table(spark, sf_dir, "events").schema
    changes = failing.failing_domains(_outcomes(ingest.feed_stream(spark, f"{sf_dir}/events*.parquet", schema=schema)), FAILURE_DAYS)
    with failing.column_families(spark):
        stream = ingest.write_totals(changes, f"{path}/out", f"{path}/state")
    stream.awaitTermination()
    return ingest.read_totals(spark, f"{path}/out", ["domain"]).where("failures > 0").select("domain", "failures")


@query(sql="SELECT count(*) AS input_rows, true AS all_batches FROM events")
def stream_progress(spark, sf_dir):
    """Rows that a stream has read according to its logged progress, and whether every one of its micro-batches was logged."""
    path = scratch(spark, "progress")
    rows = st.table(spark, sf_dir, "events").select("event_id", "ts")
    rows.repartition(5).write.parquet(f"{path}/in")
    log = progress.ProgressLog(spark, f"{path}/log")
    spark.streams.addListener(log)
    try:
        landed = ingest.feed_stream(spark, f"{path}/in", schema=rows.schema, max_files=1)
        ingest.append_rows(landed, f"{path}/out", f"{path}/state").awaitTermination()
        log.settle()
    finally:
        spark.streams.removeListener(log)
    told = progress.logged_progress(spark, f"{path}/log")
    return told.agg(F.sum("input_rows").alias("input_rows"), (F.count(F.lit(1)) >= 5).alias("all_batches"))
