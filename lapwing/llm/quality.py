"""Quality rules: text statistics, and an ordered list of threshold rules learned from labelled ones by sequential covering.

DataFrame operations only. What reaches the driver are counts by feature and bin, bounded by the number of
features and thresholds; the labelled rows stay in Spark, however many there are.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.llm.common import WORD, saved, table, text_of, with_ids

WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Significant digits of the values of which thresholds are percentiles.
DIGITS = 3
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the rules may test, each a number that is 0 where its base is empty.
FEATURES = ("symbol_rate", "capital_rate", "mark_rate", "dup_line_rate", "repeat_rate", "mean_word_chars", "distinct_rate", "n_words")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once, however often it is named inside."""
    return F.get(F.transform(F.array(value), use), 0)


def _repeated(words: Column) -> Column:
    """How many words lie in a window of WINDOW words that occurs twice or more."""
    count = F.size(words) - (WINDOW - 1)
    places = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(places, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        flagged = _let(ordered, lambda o: F.filter(o, lambda x, j: (x.h == F.get(o, j - 1).h) | (x.h == F.get(o, j + 1).h)))
        at = F.sort_array(F.transform(flagged, lambda x: x.p))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(at, start, lambda a, p: F.struct(p.alias("last"), (a.n + F.least(F.lit(WINDOW), p - a.last)).alias("n")), lambda a: a.n)

    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def _held(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def text_statistics(text: Column) -> Column:
    """A struct of COUNTS and FEATURES of a text; null is the empty text, all of whose numbers are 0."""

    def of(t: Column, words: Column, lines: Column) -> Column:
        n = F.size(words).cast("long")
        chars = F.length(F.array_join(words, "")).cast("long")
        symbols, dup = _held(t, "#*$%&|<>"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")
        distinct = F.size(F.array_distinct(words))
        return _let(
            _repeated(words).cast("long"),
            lambda repeat: F.struct(
                n.alias("n_words"), chars.alias("word_chars"), symbols.alias("n_symbols"), dup.alias("n_dup_lines"), repeat.alias("n_repeat_words"),
                _rate(symbols, chars).alias("symbol_rate"), _rate(_held(t, _CAPITALS), chars).alias("capital_rate"), _rate(_held(t, "!?"), chars).alias("mark_rate"),
                _rate(dup, F.size(lines)).alias("dup_line_rate"), _rate(repeat, n).alias("repeat_rate"), _rate(chars, n).alias("mean_word_chars"), _rate(distinct, n).alias("distinct_rate"),
            ),
        )

    lines = lambda t: F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    return _let(text, lambda t: _let(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), lambda w: _let(lines(t), lambda x: of(t, w, x))))


def _significant(x: Column) -> Column:
    """x to DIGITS significant digits: at most 900 values a decade, so that exact percentiles, alike in every run, count few values."""
    unit = F.pow(F.lit(10.0), F.floor(F.log10(x)) - (DIGITS - 1))
    return F.when(x > 0, F.round(x / unit) * unit).otherwise(F.lit(0.0))


def base_failed(of: Column) -> Column:
    return (of.n_words < MIN_WORDS) | (100 * of.n_repeat_words > MAX_REPEAT_PERCENT * of.n_words)


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self, of: Column) -> Column:
        value = of[self.feature].cast("double")
        return value >= F.lit(self.threshold) if self.at_least else value < F.lit(self.threshold)


def _all(conditions: list[Condition], of: Column) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column(of)
    return out


def _gain(p0: int, n0: int, p1: int, n1: int) -> float:
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))) if p1 else 0.0


def learn_rules(labelled: DataFrame, bins: int = 32, depth: int = 3, max_rules: int = 8, min_precision: float = 0.95, min_rows: int = 8) -> list[list[Condition]]:
    """Ordered rules that mark poor rows of labelled (of: text_statistics, poor: boolean, grow: boolean).

    One rule at a time: grow adds the condition of most gain on the growing rows until no ordinary row
    is left or depth is reached; prune cuts final conditions while (p - n) / (p + n) on the other rows doesn't
    fall. A rule is kept if at least min_precision of the pruning rows it marks, and min_rows of them, are poor; then
    the rows it marks are taken away and the next is grown. Without rows of both kinds there are no rules.
    """
    ranks = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    thresholds = labelled.agg(*[F.array_sort(F.array_distinct(F.percentile(_significant(F.col("of")[f].cast("double")), ranks))).alias(f) for f in FEATURES]).first()
    cuts = {f: list(thresholds[f] or []) for f in FEATURES}
    place = lambda f: F.size(F.filter(F.array(*[F.lit(float(x)) for x in cuts[f]]), lambda x: x <= F.col("of")[f].cast("double")))
    rows = saved(labelled.select("of", "poor", "grow", F.array(*[F.struct(F.lit(k).alias("feature"), place(f).alias("bin")) for k, f in enumerate(FEATURES)]).alias("bins")))
    rules: list[list[Condition]] = []
    of = F.col("of")
    while len(rules) < max_rules:
        left = rows
        for rule in rules:
            left = left.where(~_all(rule, of))
        grown: list[Condition] = []
        while len(grown) < depth:
            counts: dict[tuple[int, int], list[int]] = {}
            now = left.where("grow").where(_all(grown, of)).select("poor", F.explode("bins").alias("b"))
            for r in now.groupBy("b.feature", "b.bin", "poor").count().collect():  # features x bins x 2 at most
                counts.setdefault((r.feature, r.bin), [0, 0])[0 if r.poor else 1] += r["count"]
            p0, n0 = (sum(v[k] for (f, _), v in counts.items() if f == 0) for k in (0, 1))
            if not p0 or not n0:
                break
            best = (0.0, None)
            for f, name in enumerate(FEATURES):
                p, n = 0, 0
                for b in range(len(cuts[name])):
                    x = counts.get((f, b), [0, 0])
                    p, n = p + x[0], n + x[1]
                    for at_least, p1, n1 in ((False, p, n), (True, p0 - p, n0 - n)):
                        if (g := _gain(p0, n0, p1, n1)) > best[0] + 1e-9:
                            best = (g, Condition(name, at_least, float(cuts[name][b])))
            if best[1] is None:
                break
            grown.append(best[1])
        if not grown:
            break
        kept = left.where("not grow").agg(*[F.count_if(_all(grown[: k + 1], of) & (F.col("poor") == x)).alias(f"c{k}_{int(x)}") for k in range(len(grown)) for x in (True, False)]).first()
        worth = lambda k: (kept[f"c{k}_1"] - kept[f"c{k}_0"]) / max(1, kept[f"c{k}_1"] + kept[f"c{k}_0"])
        k = max(range(len(grown)), key=lambda k: (round(worth(k), 9), -k))
        p, n = kept[f"c{k}_1"], kept[f"c{k}_0"]
        if p < min_rows or p < min_precision * (p + n):
            break
        rules.append(grown[: k + 1])
    return rules


def verdict(rules: list[list[Condition]], of: Column) -> Column:
    """The number of the first rule that marks a row, from 1, or 0: one conditional expression in the rules' order."""
    if not rules:
        return F.lit(0)
    out = F.when(_all(rules[0], of), F.lit(1))
    for k, rule in enumerate(rules[1:], 2):
        out = out.when(_all(rule, of), F.lit(k))
    return out.otherwise(F.lit(0))


def _labelled(statistics: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics that have a label and pass the base rules; a doc_id's lowest label counts. Half grow rules, half prune them."""
    poor = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") == 0).alias("poor"))
    grow = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return statistics.join(poor, "doc_id").where(~base_failed(F.col("of"))).select("of", "poor", grow.alias("grow"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, of (text_statistics), base_failed, rule (0 or the number of the rule that marks it), kept.

    Null and empty texts have no words and fail the base rules. Rows with a null doc_id have no label but are judged
    like others, and so are repeated rows, each on its own. Empty labels: the base rules alone.
    """
    statistics = saved(docs.select("doc_id", text_statistics(text_of()).alias("of")))
    rules = learn_rules(_labelled(statistics, labels))
    return _judged(statistics, rules)


def _judged(statistics: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    failed, rule = base_failed(F.col("of")), verdict(rules, F.col("of"))
    return statistics.withColumns({"base_failed": failed, "rule": rule, "kept": ~failed & (rule == 0)})


def drop_poor(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the base rules and the rules learned from its labelled rows keep; columns as in docs.

    Rules are learned from the labelled documents and applied row by row as texts are read, without a join.
    """
    ids = saved(labels.where("doc_id is not null and quality is not null").select("doc_id").distinct())
    sample = with_ids(docs.select("doc_id", "text"), ids).select("doc_id", text_statistics(text_of()).alias("of"))
    rules = learn_rules(_labelled(saved(sample), labels))
    return docs.where(_let(text_statistics(text_of()), lambda of: ~base_failed(of) & (verdict(rules, of) == 0)))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", *[F.col("of")[c].alias(c) for c in COUNTS], "base_failed", "kept", "rule")
