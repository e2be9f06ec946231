"""Chat formatting, exact clustering and ranked search against brute-force versions, with nulls, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from presslake.llm import chat, clustering, search

LOG = "conv_id bigint, seq bigint, kind string, turn bigint, role string, text string, at string, piece string"


def log_of(rows):
    return [(*r, "a", "p") for r in rows]


# ---- chat

def fold(events):
    """Final (role, text) of one conversation, event by event; seq is unique."""
    turns = {}
    for seq, kind, turn, role, text in sorted(events, key=lambda e: e[0]):
        if kind in ("message", "edit"):
            turns[turn] = [role or (turns.get(turn) or [None])[0], text or ""]
        elif kind == "regenerate":
            turns = {t: v for t, v in turns.items() if t < turn} | {turn: [role or (turns.get(turn) or [None])[0], None]}
        elif kind == "delta" and turn in turns:
            turns[turn] = [role or turns[turn][0], (turns[turn][1] or "") + (text or "")]
    return [(r or "", t) for _, (r, t) in sorted(turns.items()) if t is not None]


def random_log(rng, conv):
    """Messages first, then streamed deltas, edits and regenerations of turns that are there."""
    events, seq, there = [], 0, []
    for turn in range(rng.randint(1, 6)):
        seq += rng.randint(1, 3)
        events.append((seq, "message", turn, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["", "hi", "a\nb", "x </s> y", "[INST]", "\\", None])))
        there.append(turn)
        for _ in range(rng.randint(0, 4)):
            seq += 1
            at = rng.choice(there)
            kind = rng.choice(["delta", "delta", "edit", "regenerate"])
            events.append((seq, kind, at, None if kind == "delta" else rng.choice([None, "assistant"]), None if kind == "regenerate" else rng.choice(["+", "<s>", "\\n", "é🙂", ""])))
            if kind == "regenerate":
                there = [t for t in there if t <= at]
    return [(conv, *e) for e in events]


def test_folded_logs_equal_a_loop_over_events(spark):
    rng = random.Random(3)
    logs = [e for conv in range(60) for e in random_log(rng, conv)]
    by_conv = collections.defaultdict(list)
    for conv, *event in logs:
        by_conv[conv].append(tuple(event))
    rng.shuffle(logs)
    frame = spark.createDataFrame(log_of(logs), LOG).repartition(4)
    found = collections.defaultdict(list)
    for r in chat.messages(frame).orderBy("conv_id", "turn", "at").collect():
        found[r["conv_id"]].append((r["role"], r["text"]))
    wanted = {c: fold(e) for c, e in by_conv.items()}
    assert dict(found) == {c: v for c, v in wanted.items() if v}
    chats = chat.format_chats(frame)
    for r in chats.select("conv_id", "formatted", "loss_spans", chat.read_back(F.col("formatted")).alias("turns")).collect():
        told = [(t["role"], t["text"]) for t in r["turns"]]
        assert told == wanted[r["conv_id"]]
        masked = [re.sub(r"(?s)\\(.)", r"\1", r["formatted"][s["start"]:s["end"]]) for s in r["loss_spans"]]
        assert masked == [t for role, t in told if role == "assistant"]
    for r in chat.digests(chats).collect():
        told = wanted[r["conv_id"]]
        loss = "".join(t for role, t in told if role == "assistant")
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in told).encode()).hexdigest()
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(told), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_escaping_is_reversible_and_hides_control_strings(spark):
    rng = random.Random(8)
    bits = [*chat.CONTROLS, "<", "[", "/", "s>", "\\", "\n", " ", "INST]", "ü", "\\\\", "<<"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    told = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", chat.escape(F.col("t")).alias("e")).withColumn("back", chat.unescape(F.col("e"))).collect()
    assert all(r["back"] == r["t"] and not any(c in r["e"] for c in chat.CONTROLS) for r in told)
    roles = ["user", "assistant", "system", "", "to\nol", "<s>", "r\\", None]
    rows = [(i, j, "message", j, rng.choice(roles), rng.choice(texts)) for i in range(80) for j in range(3)]
    chats = chat.format_chats(spark.createDataFrame(log_of(rows), LOG)).select("conv_id", chat.read_back(F.col("formatted")).alias("turns")).collect()
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chats} == {
        i: [(r or "", t) for c, _, _, _, r, t in rows if c == i] for i in range(80)}


def test_nulls_ties_repeats_and_long_texts_of_chats(spark):
    long = "word </s> " * 60_000
    rows = [
        (1, 5, "message", 0, "user", "b"), (1, 5, "message", 0, "user", "a"), (1, 5, "message", 0, "user", "a"), (1, 6, "delta", 0, None, "+"),
        (2, None, None, None, None, None), (2, 1, "message", 1, "assistant", long), (None, 1, "message", 1, "user", "lost"), (None, 0, "message", 0, "user", "and found"),
        (3, 1, "other", 0, "user", "x"), (4, 1, "delta", 0, "user", "one"), (4, 2, "delta", 0, None, "two"), (5, 1, "regenerate", 0, "user", None),
    ]
    found = collections.defaultdict(list)
    for r in chat.messages(spark.createDataFrame(log_of(rows), LOG)).orderBy("conv_id", F.col("turn").asc_nulls_first(), "at").collect():
        found[r["conv_id"]].append((r["role"], r["text"]))
    assert dict(found) == {1: [("user", "a"), ("user", "a"), ("user", "b+")], 2: [("", ""), ("assistant", long)],
                           None: [("user", "and found"), ("user", "lost")], 4: [("user", "onetwo")]}
    chats = chat.format_chats(spark.createDataFrame(log_of(rows), LOG))
    told = {r["conv_id"]: r for r in chat.digests(chats).collect()}
    assert told[2]["loss_chars"] == len(long) and told[2]["loss_sha256"] == hashlib.sha256(long.encode()).hexdigest()
    assert chat.digests(chat.format_chats(spark.createDataFrame([], LOG))).count() == 0


def test_a_log_moves_once(spark):
    plan = chat.digests(chat.format_chats(spark.createDataFrame(log_of([(1, 1, "message", 0, "user", "x")]), LOG)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


# ---- clustering

def by_hand(rows, clusters=16, rounds=3):
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda i: (i is None, "" if i is None else hashlib.sha256(f"1:{i}".encode()).hexdigest())
    pack = lambda q: np.array(q, np.int32).tobytes()
    centroids = [q for _, q in sorted(kept, key=lambda r: (key(r[0]), pack(r[1])))[:clusters]]
    dist = lambda q, c: sum((a - b) ** 2 for a, b in zip(q, c))
    for t in range(rounds + 1):
        best = [min((dist(q, c), j) for j, c in enumerate(centroids)) for _, q in kept]
        if t < rounds:
            for j in range(len(centroids)):
                own = [q for (_, q), (_, b) in zip(kept, best) if b == j]
                if own:
                    centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    inertia = collections.Counter()
    for d, j in best:
        inertia[j] += d
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return collections.Counter((i, j, d, inertia[j], sum(inertia.values()), name[j]) for (i, _), (d, j) in zip(kept, best))


VECTORS = "vec_id bigint, embedding array<float>, cluster string, point string"


def vectors(n=150):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 2, (7, 64))
    rows = [(i, (centres[i % 7] + rng.normal(0, 0.4, 64)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)] + [rows[5], rows[5], (None, rows[6][1]), (None, rows[7][1])]
    bad = rows[0][1][:63]
    return rows + [(2000, None), (2001, bad), (2002, bad + [None]), (2003, bad + [float("nan")]), (2004, bad + [float("inf")]), (2005, []), (2006, [0.0] * 64), (2007, [0.0] * 64)]


@pytest.mark.parametrize("rows", [vectors(), vectors(150)[150:160], [(1, [0.5] * 64)], []])
def test_clusters_equal_plain_rounds(spark, rows):
    frame = spark.createDataFrame([(*r, "c", "p") for r in rows], VECTORS).repartition(3)
    found = clustering.cluster(frame)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert collections.Counter(tuple(r) for r in found.collect()) == by_hand(rows)


def test_bounds_use_the_whole_way_and_save_distances():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(-20, 20, (200, 64)) + 200 * rng.integers(-3, 3, (1, 64)) for _ in range(8)]).astype(np.int32)
    history = [points[::200].astype(np.int64)]
    measured, when, cluster = np.zeros((len(points), 8), np.int64), np.full((len(points), 8), -1, np.int8), np.full(len(points), -1)
    works = []
    for t in range(6):
        measured, when, cluster, work = clustering.reassign(points, measured, when, cluster, np.stack(history))
        plain = np.stack([clustering.squared(points, c) for c in history[-1]], axis=1)
        assert (plain.argmin(axis=1) == cluster).all() and (measured[when == t] == plain[when == t]).all()
        works.append(work)
        # Centroids go out and come back: the total way stays short while the sum of the ways grows.
        history.append(history[0] + (30 if t % 2 == 0 else 0))
    assert works[0] == points.shape[0] * 8 and all(w < points.shape[0] * 2 for w in works[1:])


def test_values_that_would_not_fit_are_an_error(spark):
    with pytest.raises(Exception, match="would not fit"):
        clustering.cluster(spark.createDataFrame([(1, [1e30] * 64, "c", "p")], VECTORS)).collect()


# ---- search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, best):
    held = [(i, collections.Counter(words(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, total = len(held), sum(x for *_, x in held)
    df = collections.Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in {(i, t) for i, t in items}:
        told = []
        for i, c, size in held:
            m = 50 + 50 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in set(words(text)) if c[w])
            if score > 0:
                told.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(told)[:best])]
    return collections.Counter(out)


def texts():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdé1") for _ in range(rng.randint(1, 3))) for _ in range(120)]
    draw = lambda n: " ".join(vocabulary[min(int(rng.expovariate(0.06)), 119)] for _ in range(n))
    docs = [(i, draw(rng.randint(1, 60))) for i in range(300)]
    docs += [(300 + i, docs[4][1]) for i in range(30)] + [docs[9], docs[9], (None, docs[11][1]), (None, None), (400, ""), (401, "!!! ..."), (402, "A a Ä É é"), (403, "ab1 " * 40_000)]
    items = [(i, draw(rng.randint(1, 25))) for i in range(20)] + [(20, docs[4][1]), (20, docs[4][1]), (21, None), (22, "  "), (23, "nowhere"), (None, "a b c"), (24, "A"), (24, "b")]
    return docs, items


DOCS, ITEMS = "doc_id bigint, text string, score string, number string, n string", "item_id bigint, text string, rank string, terms string"


@pytest.mark.parametrize("settings", [{}, {"block_docs": 37, "best": 5}, {"block_postings": 200, "query_terms": 60, "best": 9}])
def test_search_equals_scoring_every_document(spark, settings):
    docs, items = texts()
    told = search.search(spark.createDataFrame([(*d, "s", "k", "n") for d in docs], DOCS).repartition(5), spark.createDataFrame([(*i, "r", "t") for i in items], ITEMS), **settings)
    assert told.columns == ["item_id", "rank", "doc_id", "score"]
    assert collections.Counter(tuple(r) for r in told.collect()) == ranked(docs, items, settings.get("best", 50))


def test_search_in_empty_tables(spark):
    docs, items = texts()
    some, asked = spark.createDataFrame([(*d, "s", "k", "n") for d in docs[:3]], DOCS), spark.createDataFrame([(*i, "r", "t") for i in items], ITEMS)
    for a, b in ((some.limit(0), asked), (some, asked.limit(0)), (spark.createDataFrame([(1, None, "s", "k", "n")], DOCS), asked)):
        assert search.search(a, b).count() == 0


def test_accumulators_stop_once_the_rest_cannot_win():
    docs = np.concatenate([np.arange(10), np.arange(1000)]).astype(np.int32)
    terms = np.repeat([0, 1], [10, 1000]).astype(np.int32)
    values = np.full(1010, 500_000, np.int64)
    for weights, made in (((5000, 10), 10), ((10, 5000), 1000)):
        query = search.Query(0, np.array([0, 1], np.int32), np.array(weights, np.int64))
        (_, found, scores, accumulators), = search.block_best(1000, docs, terms, values, [query], np.arange(1000), 10)
        assert accumulators == made and found.tolist() == list(range(10)) and set(scores.tolist()) == {sum(weights) * 500_000}
