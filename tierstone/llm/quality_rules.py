"""Quality rules as a learned decision list.

Statistics of whole texts are computed in the row. Sequential covering learns from those of labelled documents: a rule, a
conjunction of thresholds, grows by FOIL's gain on two thirds of them and is pruned on the rest; what it covers is set apart
and the next rule is grown. The list becomes one ordered conditional expression. The driver sees counts by feature and bin
only, whatever the number of labelled rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierstone.llm.common import SPACES, Scratch, own_columns, split_words, table

#: Thresholds tried a feature, conditions a rule, rules a list.
BINS, CONDITIONS, RULES = 32, 3, 12
#: What a rule needs on the pruning rows: covered rejects, and their share of all it covers.
COVER, PRECISION = 5, 0.95
REPEATED = 5
FEATURES = ("symbol_rate", "mark_rate", "upper_rate", "repeat_rate", "dup_line_rate", "mean_word", "distinct_rate", "n_words")


def _let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _repeat_words(v: str) -> str:
    """SQL: words of array v in REPEATED-word windows that occur twice or more. Windows are hashed and sorted; those that share a hash are sorted again by their words, so a clash of hashes does nothing. Texts without a repeated hash, the most, skip both sorts."""
    n = REPEATED
    alike = "filter(sequence(0, size({0}) - 1), k -> (k > 0 AND get({0}, k).{1} = get({0}, k - 1).{1}) OR (k < size({0}) - 1 AND get({0}, k).{1} = get({0}, k + 1).{1}))"
    covered = f"aggregate(array_sort(transform({alike.format('t', 'g')}, k -> get(t, k).i)), struct(0 AS upto, 0 AS n), (a, i) -> struct(i + {n} AS upto, a.n + i + {n} - greatest(a.upto, i) AS n), a -> a.n)"
    second = _let(f"sort_array(transform({alike.format('s', 'h')}, k -> struct(array_join(slice({v}, get(s, k).i + 1, {n}), ' ') AS g, get(s, k).i AS i)))", "t", f"if(size(t) = 0, 0, {covered})")
    first = _let("sort_array(transform(h, (x, i) -> struct(x AS h, i AS i)))", "s", second)
    return f"if(size({v}) < {n}, 0, {_let(f'transform(sequence(1, size({v}) - {n - 1}), i -> xxhash64(slice({v}, i, {n})))', 'h', f'if(size(array_distinct(h)) = size(h), 0, {first})')})"


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_marks, n_upper, n_lines, n_distinct (long) for each row of docs, of its whole text. A null text counts as an empty one: all are 0."""
    base = own_columns(docs, {"doc_id": id_col, "text": text_col} | {f"keep_{c}": c for c in keep})
    base = base.withColumn("text", F.coalesce("text", F.lit("")))
    without = lambda pattern: F.length("text") - F.length(F.regexp_replace("text", pattern, ""))
    of_words = F.expr(
        "element_at(transform(array(w), v -> struct(size(v) AS n_words, aggregate(v, 0L, (a, x) -> a + length(x)) AS word_chars,"
        f" size(array_distinct(v)) AS n_distinct, {_repeat_words('v')} AS n_repeat_words)), 1)"
    )
    of_lines = F.expr("element_at(transform(array(filter(split(text, '\\n'), x -> x RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')), l -> struct(size(l) AS n_lines, size(l) - size(array_distinct(l)) AS n_dup_lines)), 1)")
    rows = base.withColumn("w", split_words(F.col("text"), SPACES)).select(
        "doc_id", *[f"keep_{c}" for c in keep], of_words.alias("s"), of_lines.alias("l"), without(r"[#*$%&|<>]").alias("n_symbols"), without("[!?]").alias("n_marks"), without(r"\p{Lu}").alias("n_upper")
    )
    long = lambda c, name: F.col(c).cast("long").alias(name)
    return rows.select(
        "doc_id",
        *[long(f"s.{c}", c) for c in ("n_words", "word_chars", "n_repeat_words", "n_distinct")],
        *[long(f"l.{c}", c) for c in ("n_lines", "n_dup_lines")],
        *[long(c, c) for c in ("n_symbols", "n_marks", "n_upper")],
        *[F.col(f"keep_{c}").alias(c) for c in keep],
    )


def features() -> dict[str, Column]:
    """By the columns of text_statistics. Rates of nothing are 0."""
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return {
        "symbol_rate": rate("n_symbols", "n_words"),
        "mark_rate": rate("n_marks", "n_words"),
        "upper_rate": rate("n_upper", "word_chars"),
        "repeat_rate": rate("n_repeat_words", "n_words"),
        "dup_line_rate": rate("n_dup_lines", "n_lines"),
        "mean_word": rate("word_chars", "n_words"),
        "distinct_rate": rate("n_distinct", "n_words"),
        "n_words": F.col("n_words").cast("double"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # feature >= threshold, else feature < threshold
    threshold: float
    bin: int

    def column(self, of: dict[str, Column]) -> Column:
        x = of[self.feature]
        return x >= self.threshold if self.above else x < self.threshold

    def on_bins(self) -> Column:
        return F.col(f"b_{self.feature}") >= self.bin if self.above else F.col(f"b_{self.feature}") < self.bin

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Rules in order; the first that holds rejects."""

    rules: list[list[Condition]] = field(default_factory=list)

    def column(self) -> Column:
        """The number, from 0, of the first rule that holds; null if none does."""
        of, out = features(), None
        for i, rule in enumerate(self.rules):
            held = F.lit(True)
            for c in rule:
                held = held & c.column(of)
            out = F.when(held, F.lit(i)) if out is None else out.when(held, F.lit(i))
        return F.lit(None).cast("int") if out is None else out.otherwise(F.lit(None))

    def __str__(self) -> str:
        return "\n".join(f"{'else ' if i else ''}if {' and '.join(map(str, r))}: reject" for i, r in enumerate(self.rules))


def _all(conditions: list[Condition]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.on_bins()
    return out


def learn(labelled: DataFrame, reject_col: str = "reject", scratch: Scratch | None = None) -> DecisionList:
    """A list from the columns of text_statistics and a boolean reject_col. Rows without a label are left out; no rows, or no rejects, give an empty list."""
    scratch = scratch or Scratch(labelled.sparkSession, "rules")
    of = features()
    rows = labelled.where(F.col(reject_col).isNotNull()).select(F.col(reject_col).alias("y"), (F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(3)) == 0).alias("prune"), *[of[f].alias(f) for f in FEATURES])
    rows = scratch.save(rows, "labelled")
    rejects = rows.where("y")
    probs = [i / BINS for i in range(1, BINS)]
    cuts = [sorted({*a, *b}) for a, b in zip(rows.approxQuantile(list(FEATURES), probs, 0.002) or [[]] * len(FEATURES), rejects.approxQuantile(list(FEATURES), probs, 0.002) or [[]] * len(FEATURES), strict=True)]
    if not any(cuts):
        return DecisionList()
    cuts = {f: c for f, c in zip(FEATURES, cuts, strict=True) if c}
    bins = [F.expr(f"size(filter(array({','.join(f'{t!r}D' for t in c)}), t -> t <= {f}))").alias(f"b_{f}") for f, c in cuts.items()]
    table_ = scratch.save(rows.select("y", "prune", *bins).groupBy("y", "prune", *[f"b_{f}" for f in cuts]).agg(F.count("*").alias("n")), "binned")
    out, left = DecisionList(), F.lit(True)
    while len(out.rules) < RULES:
        rule = _grow(table_, cuts, left)
        rule = _prune(table_, rule, left)
        if not rule:
            break
        out.rules.append(rule)
        left = left & ~_all(rule)
    scratch.drop(rows, table_)
    return out


def _grow(binned: DataFrame, cuts: dict[str, list[float]], left: Column) -> list[Condition]:
    rule: list[Condition] = []
    while len(rule) < CONDITIONS:
        inside = binned.where(left & ~F.col("prune") & _all(rule))
        pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"b_{f}").alias("b")) for f in cuts])).alias("x")
        counts = inside.select("y", "n", pairs).groupBy("x.f", "x.b").agg(F.sum(F.when(F.col("y"), F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("y"), 0).otherwise(F.col("n"))).alias("n")).collect()
        first = next(iter(cuts))
        p_all, n_all = (sum(r[k] for r in counts if r["f"] == first) for k in ("p", "n"))
        if not p_all or not n_all:
            break
        best: tuple[float, Condition | None] = (0.0, None)
        for f, at in cuts.items():
            by = {r["b"]: (r["p"], r["n"]) for r in counts if r["f"] == f}
            p = n = 0
            for b in range(1, len(at) + 1):  # below threshold b: bins 0 to b - 1
                p, n = p + by.get(b - 1, (0, 0))[0], n + by.get(b - 1, (0, 0))[1]
                for above, pp, nn in ((False, p, n), (True, p_all - p, n_all - n)):
                    if pp:
                        gain = pp * (math.log2(pp / (pp + nn)) - math.log2(p_all / (p_all + n_all)))
                        if gain > best[0] + 1e-9:
                            best = (gain, Condition(f, above, at[b - 1], b))
        if best[1] is None:
            break
        rule.append(best[1])
    return rule


def _prune(binned: DataFrame, rule: list[Condition], left: Column) -> list[Condition]:
    """The beginning of the rule that is best on the pruning rows, or nothing."""
    if not rule:
        return []
    held = [(F.sum(F.when(_all(rule[:i]) & F.col("y"), F.col("n"))), F.sum(F.when(_all(rule[:i]) & ~F.col("y"), F.col("n")))) for i in range(1, len(rule) + 1)]
    got = binned.where(left & F.col("prune")).agg(*[c.alias(f"c{i}") for i, c in enumerate(x for pair in held for x in pair)]).first()
    best, least = [], -1.0
    for i in range(len(rule)):
        p, n = got[2 * i] or 0, got[2 * i + 1] or 0
        if p >= COVER and p / (p + n) >= PRECISION and (p - n) / (p + n) > least:
            best, least = rule[: i + 1], (p - n) / (p + n)
    return best


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality") -> tuple[DataFrame, DecisionList]:
    """Statistics, base_failed, rule (number of the first rule that holds, or null) and kept for each row of docs; and the list.

    A label of 0 is a reject, any other a keep; documents with no label or contradicting ones (kept if any says so) take part
    once. The list is learned from documents that pass the base, for others need no rule.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    stats = scratch.save(text_statistics(docs, id_col, text_col), "statistics")
    marks = own_columns(labels, {"doc_id": label_id_col, "label": label_col}).where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg((F.max("label") <= 0).alias("reject"))
    learned = learn(stats.where(~base_failed()).join(marks, "doc_id"), "reject", scratch)
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", learned.column())
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()), learned


def op5_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
