"""Quality rules: learned decision lists over text statistics, only DataFrame operations.

Sequential covering: a rule "reject if a and b and ..." is grown, threshold by threshold, on two
thirds of the labelled rows by gain over its present precision, pruned on the other third, kept if
it is precise enough there, and its rows are taken away before the next. The list becomes one
ordered conditional expression. Labelled statistics are sums by Spark over candidate thresholds;
the driver sees only those sums, some hundred rows.

Defined results: a null or empty text has no words, zero in all statistics and base_failed true;
a text of any length is counted whole; repeated rows and null keys are kept; labels that are null,
unknown or of another table are left out; several labels of a row count each; of thresholds with one
gain the last by name, way and value is taken; a text at a threshold meets it; without labels of both
kinds the list is empty and keeps everything; an empty table gives no rows; columns beyond those named
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, words

#: Characters that count as symbols, fixed by the contract.
SYMBOLS = "#*$%&|<>"
#: What rules may test: name and expression over the statistics.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "words_a_line": "n_words / greatest(n_lines, 1)",
    "punctuation_share": "n_stops / greatest(n_words, 1)",
}
Condition = tuple[str, str, float]


def _repeated(w: Column) -> Column:
    """Words that lie in a window of three that the text has twice or more. In order of n log n.

    Windows get 64-bit hashes, which are sorted: first as plain numbers, to find whether any comes
    twice; only then with their places, to mark the words.
    """
    hashes = F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    )
    placed = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    starts = lambda h: let(placed(h), lambda s: F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False))), lambda x: x["i"])))
    covered = lambda at: F.aggregate(at, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(i - s["last"], F.lit(3))).alias("n")), lambda s: s["n"])
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(starts(h))))


def statistics(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stops), all long."""
    bare = stops = F.col("t")
    for c in SYMBOLS:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    for c in ".,;:!?":
        stops = F.replace(stops, F.lit(c), F.lit(""))
    t = F.coalesce(F.col(text), F.lit(""))
    rows = texts.select(F.col(key), t.alias("t"), words(F.col(text)).alias("w"), F.filter(F.split(t, "\n"), lambda line: F.regexp_like(line, F.lit(r"[^\x20\x09-\x0D]"))).alias("lines"))
    n = {
        "n_words": F.size("w"),
        "word_chars": F.aggregate("w", F.lit(0), lambda s, x: s + F.length(x)),
        "n_symbols": F.length("t") - F.length(bare),
        "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": let(F.col("w"), _repeated),
        "n_stops": F.length("t") - F.length(stops),
    }
    return rows.select(key, *[c.cast("long").alias(name) for name, c in n.items()])


def base_failed() -> Column:
    """Fixed by the contract."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def holds(rule: Sequence[Condition]) -> Column:
    """The conjunction of a rule's thresholds."""
    out = F.lit(True)
    for name, way, at in rule:
        value = F.expr(FEATURES[name])
        out = out & ((value >= at) if way == ">=" else (value <= at))
    return out


def verdict(rules: Sequence[Sequence[Condition]]) -> Column:
    """true: kept. The rules in order, each rejecting what it covers; what none covers is kept."""
    out = F.lit(True)
    for rule in reversed(rules):
        out = F.when(holds(rule), F.lit(False)).otherwise(out)
    return out


def _sums(rows: DataFrame, tests: Sequence[Condition]) -> list[tuple[int, int]]:
    """For each test, how many bad and good rows meet it: one aggregation over all rows."""
    bad = F.col("bad")
    aggs = []
    for k, test in enumerate(tests):
        hit = holds([test])
        aggs += [F.count_if(hit & bad).alias(f"b{k}"), F.count_if(hit & ~bad).alias(f"g{k}")]
    got = rows.agg(*aggs).first()
    return [(got[2 * k], got[2 * k + 1]) for k in range(len(tests))]


def learn(rows: DataFrame, max_rules: int = 6, max_conditions: int = 3, cuts: int = 12, least_precision: float = 0.9, least_rows: int = 10) -> list[list[Condition]]:
    """A decision list from rows (statistics and bad boolean), all of which are used.

    Candidate thresholds are quantiles of each feature over the bad rows. least_precision and
    least_rows hold for a rule on the rows that prune it.
    """
    import math

    at = [i / cuts for i in range(cuts + 1)]
    names = list(FEATURES)
    rows = materialize(rows.where("bad is not null").select("*", (F.pmod(F.xxhash64("fold"), F.lit(3)) == 0).alias("held")), "labelled")
    got = rows.where("bad").agg(*[F.percentile_approx(F.expr(FEATURES[n]), at, 1000).alias(n) for n in names]).first()
    tests = [(n, way, float(v)) for n in names for v in sorted(set(got[n] or [])) for way in ("<=", ">=")]
    rules: list[list[Condition]] = []
    while tests and len(rules) < max_rules:
        left = rows.where(verdict(rules))
        grow, prune = left.where("not held"), left.where("held")
        n = grow.agg(F.count_if("bad"), F.count_if(~F.col("bad"))).first()
        bad, good = n[0], n[1]
        if bad < least_rows:
            break
        rule: list[Condition] = []
        while len(rule) < max_conditions and good:
            base = math.log2(bad / (bad + good))
            scored = [(b * (math.log2(b / (b + g)) - base) if b >= least_rows else 0.0, b, g, t) for (b, g), t in zip(_sums(grow.where(holds(rule)), tests), tests, strict=True)]
            gain, b, g, test = max(scored, key=lambda s: (s[0], s[3]))
            if gain <= 0:
                break
            rule, bad, good = [*rule, test], b, g
        if not rule:
            break
        ends = [rule[: k + 1] for k in range(len(rule))]
        hits = [(F.count_if(holds(r) & F.col("bad")), F.count_if(holds(r) & ~F.col("bad"))) for r in ends]
        seen = prune.agg(*[c.alias(f"c{k}") for k, c in enumerate(x for pair in hits for x in pair)]).first()
        worth = [(seen[2 * k] / max(1, seen[2 * k] + seen[2 * k + 1]), seen[2 * k], -k) for k in range(len(ends))]
        good_ends = [k for k, w in enumerate(worth) if w[0] >= least_precision and w[1] >= least_rows / 2]
        if not good_ends:
            break
        rules.append(ends[max(good_ends, key=lambda k: (worth[k][1] * (worth[k][0] - 0.5), -k))])
    return rules


def apply_rules(texts: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", **settings: object) -> tuple[DataFrame, list[list[Condition]]]:
    """(rows, rules): the statistics with base_failed and kept, and the list that was learned from labels (0: bad)."""
    stats = materialize(statistics(texts, key, text), "statistics", wide=True)
    marks = labels.where(F.col(label).isin(0, 1)).select(F.col(key), (F.col(label) == 0).alias("bad"))
    rules = learn(stats.where(~base_failed()).join(marks, key).withColumn("fold", F.col(key)), **settings)
    return stats.select("*", base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept")), rules
