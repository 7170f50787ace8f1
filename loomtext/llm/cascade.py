"""Quality rules as a short-circuit cascade.

Each rule is a native expression that says whether a text passes.  On a random
sample every rule's cost (the time that the executors take to evaluate it) and
rejection rate are measured; rules then run in order of rejection per cost.  ``CASE WHEN`` stops at the first rule that rejects, so most bad
texts never meet the costly rules.  The order has no influence on which texts
are rejected, only on how much work that takes.

A null or blank text is rejected.  Rows that repeat a text get the same answer.
No row meets a length limit; the whole text is judged.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts on which cost and selectivity are measured, as expected of the sample, and evaluations of each rule.
SAMPLE_ROWS = 500
ROUNDS = 5


@dataclass(frozen=True)
class Rule:
    """A named SQL expression over ``text`` or ``words`` that is true of texts that pass, for Spark and for DuckDB."""

    name: str
    passes: str
    sql: str


#: Each rule in Spark's and DuckDB's spelling; words are the pieces between blanks and line ends.
RULES: tuple[Rule, ...] = (
    Rule("has_letters", "text RLIKE '\\\\p{L}'", "regexp_matches(text, '\\p{L}')"),
    Rule("few_symbols", "length(text) - length(translate(text, '#$%&*+<=>@[]^_{}~', '')) <= 0.1 * length(text)", "length(text) - length(translate(text, '#$%&*+<=>@[]^_{}~', '')) <= 0.1 * length(text)"),
    Rule("few_exclamations", "length(text) - length(replace(text, '!', '')) <= 0.04 * length(text)", "length(text) - length(replace(text, '!', '')) <= 0.04 * length(text)"),
    Rule("not_a_table", "length(text) - length(replace(text, '|', '')) <= 0.04 * length(text)", "length(text) - length(replace(text, '|', '')) <= 0.04 * length(text)"),
    Rule(
        "not_shouting",
        "length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) <= 0.5 * length(text)",
        "length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) <= 0.5 * length(text)",
    ),
    Rule("word_length", "length(text) <= 25 * (1 + length(text) - length(replace(text, ' ', '')))", "length(text) <= 25 * (1 + length(text) - length(replace(text, ' ', '')))"),
    Rule(
        "varied_lines",
        "size(split(text, '\\\\n')) < 5 OR size(array_distinct(split(text, '\\\\n'))) >= 0.5 * size(split(text, '\\\\n'))",
        "len(string_split(text, chr(10))) < 5 OR len(list_distinct(string_split(text, chr(10)))) >= 0.5 * len(string_split(text, chr(10)))",
    ),
    Rule("varied_words", "size(words) < 20 OR size(array_distinct(words)) >= least(0.2 * size(words), 60)", "len(words) < 20 OR len(list_distinct(words)) >= least(0.2 * len(words), 60)"),
    Rule(
        "no_word_runs",
        "size(words) < 20 OR size(filter(words, (w, i) -> i > 0 AND w = words[i - 1])) <= 0.2 * size(words)",
        "len(words) < 20 OR len(list_filter(list_zip(words[1:-2], words[2:]), lambda x: x[1] = x[2])) <= 0.2 * len(words)",
    ),
)


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, nanoseconds a text, share rejected) on a seeded sample of all rows, by rejection per cost, highest first.

    One job: each task reads the clock before and after each rule, and of
    ``ROUNDS`` evaluations of a rule on a text the fastest counts, so that
    neither start-up nor compilation does.
    """
    texts = docs.select(F.col(text_col).alias("text")).where(F.col(text_col).isNotNull())
    n = texts.count()
    sample = texts if n <= sample_rows else texts.sample(sample_rows / n, seed=7)
    clock = F.expr("cast(reflect('java.lang.System', 'nanoTime') AS long)")
    # a rule in a branch of its own is evaluated where it stands; the last branch does nothing and gives the clock's own time
    fails = [~F.coalesce(F.expr(_named(r.passes, "text")), F.lit(False)) for r in rules] + [F.lit(False)]
    timed = F.when(F.lit(False), F.array(F.lit(0).cast("long")))
    for i, expr in enumerate(fails):
        timed = timed.when(F.col("i") == i, F.array(clock, expr.cast("long"), clock))
    each = sample.withColumn("id", F.monotonically_increasing_id()).withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(ROUNDS)))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(rules))))).select("i", "id", timed.alias("t"))
    best = each.groupBy("i", "id").agg(F.min(F.col("t")[2] - F.col("t")[0]).alias("ns"), F.max(F.col("t")[1]).alias("bad"))
    seen = {r["i"]: (r["ns"], r["bad"]) for r in best.groupBy("i").agg(F.avg("ns").alias("ns"), F.avg("bad").alias("bad")).collect()}
    idle = seen.get(len(rules), (0.0, 0.0))[0]
    out = [(rule, max(seen.get(i, (idle, 0.0))[0] - idle, 1.0), seen.get(i, (0.0, 0.0))[1]) for i, rule in enumerate(rules)]
    return sorted(out, key=lambda x: (-x[2] / x[1], x[0].name))


def _of_words(rule: Rule) -> bool:
    return bool(re.search(r"\bwords\b", rule.passes))


def _words(text: str) -> str:
    return f"filter(split({text}, '[ \\n]'), w -> w != '')"


def _named(expr: str, text: str) -> str:
    """The rule over the column ``text``; a rule over words binds them once, in a lambda's argument."""
    own = re.sub(r"\btext\b", lambda _: text, expr)
    return f"transform(array({_words(text)}), words -> {own})[0]" if re.search(r"\bwords\b", expr) else own


def failing(order: list[Rule], text_col: str = "text") -> Column:
    """The first rule in the order that rejects the text, null where all pass.

    The text is cut to words at the first rule that needs them, once for it and
    all that follow.
    """
    name = f"`{text_col}`"
    text = F.col(text_col)

    def cases(rules: list[Rule]) -> str:
        return " ".join(f"WHEN NOT coalesce({re.sub(r'\btext\b', lambda _: name, r.passes)}, false) THEN '{r.name}'" for r in rules)

    at = next((i for i, r in enumerate(order) if _of_words(r)), len(order))
    blank = text.isNull() | (F.trim(F.translate(text, "\n\t\r", "   ")) == "")
    first, rest = cases(order[:at]), cases(order[at:])
    later = f"transform(array({_words(name)}), words -> CASE {rest} END)[0]" if rest else "CAST(NULL AS string)"
    return F.when(blank, F.lit("blank")).otherwise(F.expr(f"CASE {first} ELSE {later} END" if first else later))


def judge(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, flag: str = "keep") -> DataFrame:
    """The rows with a boolean column: whether all rules pass."""
    order = [r for r, _, _ in measure(docs, rules, text_col, sample_rows)]
    return docs.withColumn(flag, failing(order, text_col).isNull())


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Only the rows whose text passes all rules, with the columns they had."""
    order = [r for r, _, _ in measure(docs, rules, text_col, sample_rows)]
    return docs.where(failing(order, text_col).isNull())


def passes_sql() -> str:
    """All rules as one DuckDB condition over ``text`` and ``words``."""
    return " AND ".join(f"coalesce(({r.sql}), false)" for r in RULES)


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, text, list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda w: w <> '') AS words FROM documents)
SELECT doc_id, text IS NOT NULL AND trim(translate(text, chr(10) || chr(9) || chr(13), '   ')) <> '' AND {passes_sql()} AS keep FROM d
"""
