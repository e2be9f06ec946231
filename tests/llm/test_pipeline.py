"""Registered queries and the pipeline on the smallest tables."""

import collections
import random
import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from compare import check, connect
from presslake.llm import decontaminate, mixing, neardup, quality
from presslake.llm.queries import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_extract_html": "page_id url text n_chars", "op2_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op3_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated", "op4_mix_sources": "doc_id size source_size target taken",
    "op5_near_duplicates": "doc_id n_shingles component_id kept", "op6_url_filter": "page_id host path rule verdict",
    "op7_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op8_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op9_language": "doc_id held_out lang_pred score", "op10_shard": "doc_id size text_crc32 law shard slot grown_shard",
}


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_sql(spark, name):
    problems, _, _ = check(spark, connect(SF_DIR), name, QUERIES[name], ORACLE[name], SF_DIR)
    assert not problems


NEW_COLUMNS = {
    "op11_chat_format": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op12_centroid_clusters": "vec_id cluster distance cluster_inertia inertia centroid_sha256", "op13_ranked_search": "item_id rank doc_id score",
}


def test_all_are_registered(spark):
    assert set(COLUMNS) | set(NEW_COLUMNS) | {"pipeline"} <= set(entry.queries())
    assert all(set(columns.split()) <= set(QUERIES[name](spark, SF_DIR).columns) for name, columns in NEW_COLUMNS.items())


@pytest.mark.parametrize("name", list(COLUMNS))
def test_a_row_for_each_row(spark, name):
    told = QUERIES[name](spark, SF_DIR)
    table = "pages" if "page_id" in COLUMNS[name] else "documents"
    assert set(COLUMNS[name].split()) <= set(told.columns)
    assert told.count() == spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()


@pytest.mark.parametrize("name", ["op3_decontaminate", "op7_license_scan", "op8_quality_rules", "op11_chat_format"])
def test_native_queries_run_no_python(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_held_out_accuracy(spark):
    told = QUERIES["op9_language"](spark, SF_DIR).join(spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = told.where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)


def test_pipeline_equals_its_stages_by_hand(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    rules = quality.learn_from(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    left = {r["doc_id"] for r in quality.judge(docs, rules).where("kept").collect()}
    frame = lambda ids: spark.createDataFrame([tuple(rows[i]) for i in sorted(ids)], docs.schema)
    left = {r["doc_id"] for r in neardup.near_duplicates(frame(left), percent=corpus_pipeline.NEAR_PERCENT).where("kept").collect()}
    bench = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    left = {r["doc_id"] for r in decontaminate.contamination(frame(left), bench).where("not contaminated").collect()}
    copies = collections.Counter({r["doc_id"]: -(-r["taken"] // r["size"]) for r in mixing.mix(frame(left)).collect() if r["taken"]})
    told = corpus_pipeline.run(spark, SF_DIR)
    found = told.collect()
    assert told.columns == [*docs.columns, "shard", "slot"]
    assert collections.Counter(r["doc_id"] for r in found) == copies
    assert all(r["text"] == rows[r["doc_id"]]["text"] for r in found)
    slots = collections.defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def groups_of(texts, percent):
    """Groups of positions whose sets of five-word shingles are linked at `percent`, by comparing all pairs."""
    words = [re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in texts]
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in words]
    group = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 100 * len(x & y) >= percent * len(x | y):
                group = [group[j] if g == group[i] else g for g in group]
    return group


def test_near_duplicate_stage_links_from_four_fifths(spark):
    rng = random.Random(12)
    rows = []
    for _ in range(30):
        words = [f"w{rng.randrange(10**5)}" for _ in range(120)]
        # Some words of the end replaced: 0.72 to 0.92 of the shingles of both.
        for cut in (0, rng.randint(5, 18)):
            rows.append((len(rows), " ".join(words[:120 - cut] + [f"n{rng.randrange(10**5)}" for _ in range(cut)])))
    least = {percent: collections.Counter(groups_of([t for _, t in rows], percent)) for percent in (80, 85)}
    assert len(least[80]) < len(least[85]) < len(rows)
    group = groups_of([t for _, t in rows], 80)
    kept = {r["doc_id"] for r in corpus_pipeline.one_of_each(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), SF_DIR).collect()}
    assert kept == {group.index(g) for g in set(group)}
    for percent, most in ((80, 28), (85, 25)):
        size, bands = neardup.banding(percent)
        assert bands == most and (1 - (percent / 100) ** size) ** bands < 5e-7 and size * bands <= neardup.HASHES
