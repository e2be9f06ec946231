"""Quality rules: statistics of whole texts and a decision list that is learned from labels and runs as SQL expressions."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presslake.llm.common import SPACED_WORD, let, words_of

#: Labelled rows used to learn at most, those with the smallest hash of their id.
SAMPLE = 20_000
WINDOW = 5
SYMBOLS = "#*$%&|<>"


def _repeated_words(words: Column, size: int = WINDOW) -> Column:
    """Words inside windows of `size` words that occur twice or more; linear work after one sort of the window hashes."""
    n = F.size(words)

    def covered(windows: Column) -> Column:
        def spans(ordered: Column) -> Column:
            def repeated(x: Column, i: Column) -> Column:
                same = [F.coalesce(F.get(ordered, i + step)["h"] == x["h"], F.lit(False)) for step in (-1, 1)]
                return same[0] | same[1]

            places = F.sort_array(F.transform(F.filter(ordered, repeated), lambda x: x["i"]))
            gaps = lambda p: F.transform(p, lambda x, i: F.least(F.lit(size), F.coalesce(F.get(p, i + 1) - x, F.lit(size))))
            return F.aggregate(let(places, gaps), F.lit(0).cast("long"), lambda total, gap: total + gap)

        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        # Most texts repeat no window, which a hash set tells without sorting.
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(ordered, spans))

    def windows(hashes: Column) -> Column:
        starts = F.slice(hashes, F.lit(1), n - size + 1)
        return F.transform(starts, lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, size)]))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(n <= size, F.lit(0).cast("long")).otherwise(let(let(hashed, windows), covered))


def statistics(docs: DataFrame) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_marks, base_failed.

    Everything is counted over the whole text with built-in expressions. Null and empty texts have no words, so all counts
    are 0 and base_failed is true. Columns of these names in `docs` are replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(SPACED_WORD))
    # One pass keeps the few characters that are counted; the counts then read short strings.
    marked = F.regexp_replace(text, f"[^{SYMBOLS}!?A-Z]+", "")
    counted = let(words_of(F.col("text"), SPACED_WORD), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _repeated_words(w).alias("n_repeat_words")))
    kept = let(marked, lambda m: F.struct(
        F.length(F.regexp_replace(m, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(m, "[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace(m, "[^!?]+", "")).cast("long").alias("n_marks")))
    repeated = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    own = ("n_words", "word_chars", "n_repeat_words", "n_symbols", "n_upper", "n_marks", "n_dup_lines", "base_failed")
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in own],
                       counted.alias("_counted"), kept.alias("_kept"), repeated.alias("n_dup_lines"))
    rows = rows.select("*", "_counted.*", "_kept.*").drop("_counted", "_kept")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def features() -> dict[str, Column]:
    """What rules may test: ratios of the statistics, defined (0) for texts without words."""
    per_word = lambda c: F.when(F.col("n_words") > 0, F.col(c) / F.col("n_words")).otherwise(F.lit(0.0))
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": per_word("word_chars"),
        "symbols_per_word": per_word("n_symbols"),
        "marks_per_word": per_word("n_marks"),
        "repeated_share": per_word("n_repeat_words"),
        "dup_lines_per_word": per_word("n_dup_lines"),
        "upper_share": F.when(F.col("word_chars") > 0, F.col("n_upper") / F.col("word_chars")).otherwise(F.lit(0.0)),
    }


class Condition(NamedTuple):
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold


Rule = list[Condition]


def learn(rows: list[dict], labels: list[bool], least_precision: float = 0.9, least_cover: int = 3, most_rules: int = 20,
          cuts: int = 32) -> list[Rule]:
    """Rules that find the rows labelled true, by sequential covering.

    Two of three rows grow a rule: conditions at quantiles of the features are added by FOIL gain while they raise the
    precision. The third prunes it: last conditions go while (p - n) / (p + n) does not fall. A rule stays
    if it covers `least_cover` rows with `least_precision` over both; its rows are then taken away. Each row must be
    a dict of numbers. Same rows in the same order, same rules.
    """
    live = list(range(len(rows)))
    rules: list[Rule] = []
    names = list(rows[0]) if rows else []

    def counts(rule: Rule, among: list[int]) -> tuple[int, int]:
        hit = [i for i in among if all(c.holds(rows[i]) for c in rule)]
        good = sum(labels[i] for i in hit)
        return good, len(hit) - good

    def grow(among: list[int]) -> Rule:
        rule: Rule = []
        while True:
            p0 = sum(labels[i] for i in among)
            n0 = len(among) - p0
            if not p0 or not n0:
                return rule
            best, gain = None, 1e-9
            for name in names:
                pairs = sorted((rows[i][name], labels[i]) for i in among)
                total, seen = len(pairs), 0
                marks = {total * k // cuts for k in range(1, cuts)} | {sum(not y for _, y in pairs)}
                for k in range(total - 1):
                    seen += pairs[k][1]
                    if pairs[k][0] == pairs[k + 1][0] or not (k + 1 in marks or pairs[k][1] != pairs[k + 1][1]):
                        continue
                    cut = (pairs[k][0] + pairs[k + 1][0]) / 2
                    for above, p, n in ((False, seen, k + 1 - seen), (True, p0 - seen, n0 - (k + 1 - seen))):
                        if p and (value := p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))) > gain:
                            best, gain = Condition(name, above, cut), value
            if best is None or len(rule) == 4:
                return rule
            rule = [*rule, best]
            among = [i for i in among if best.holds(rows[i])]

    while len(rules) < most_rules:
        first, second = [i for i in live if i % 3], [i for i in live if i % 3 == 0]
        rule = grow(first)
        if not rule:
            break
        worth = lambda r: (lambda p, n: (p - n) / (p + n) if p + n else -1.0)(*counts(r, second))
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        p, n = counts(rule, live)
        if p < least_cover or p < least_precision * (p + n):
            break
        rules.append(rule)
        live = [i for i in live if not all(c.holds(rows[i]) for c in rule)]
    return rules


def rule_column(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 0, or null: one ordered conditional expression."""
    found = features()
    column = F.lit(None).cast("int")
    for k in reversed(range(len(rules))):
        tests = [found[c.feature] > F.lit(c.threshold) if c.above else found[c.feature] <= F.lit(c.threshold) for c in rules[k]]
        whole = tests[0]
        for test in tests[1:]:
            whole = whole & test
        column = F.when(whole, F.lit(k)).otherwise(column)
    return column


def learn_from(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **settings) -> list[Rule]:
    """Rules for documents labelled `quality` 0, learned from the statistics of at most `sample` labelled documents.

    The sample is the rows of `labels` with the smallest hashes of their ids, so it is the same at each run and its size does
    not grow with the input. Labels without id or quality are not used; an id labelled twice counts by its lowest
    label, and of rows that share a labelled id the one with the least statistics is learned from. Without labels of both kinds
    there are no rules.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.select("doc_id", (F.col("quality") == 0).alias("_bad")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # `sample` ids at most, so the copy that goes to every task is bounded.
    told = statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    columns = features()
    names = list(columns)
    # One row for each labelled id, the least where an id is repeated: `sample` rows at most, the same at each run.
    each = told.select("doc_id", F.struct("_bad", *[c.alias(name) for name, c in columns.items()]).alias("found"))
    rows = [r["found"] for r in each.groupBy("doc_id").agg(F.min("found").alias("found")).orderBy("doc_id").collect()]
    return learn([{name: r[name] for name in names} for r in rows], [r["_bad"] for r in rows], **settings)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """`docs` with the statistics, `rule` (number of the learned rule that rejects it, or null) and `kept`.

    A document is kept if base_failed is false and no learned rule holds. Null and empty texts are rejected by the base.
    """
    told = statistics(docs).drop("rule", "kept").withColumn("rule", rule_column(rules))
    return told.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of `docs` that `judge` keeps, with the columns of `docs`."""
    names = docs.columns
    packed = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    kept = judge(packed, rules).where("kept")
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in names])
