"""Quality rules: a table of thresholds compiled into one projection.

A rule is (name, metric, least, most); a document passes if every metric lies within its bounds, both
inclusive, None for open. Metrics are SQL expressions over the measures of ``measures()``, so that a
rule set is data: ``verdict()`` compiles any such table into one boolean column, and no row leaves the
projection. There is no shuffle and no user function.

Defined cases: a NULL text counts as no words and fails (n_words < 50). Empty tables give empty results.
Very long texts cost n log n in their own words at most, and only if a window repeats.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from catalog_lake.llm.common import SPACES, words

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with is in it for was are on as by at from an or not this "
    "der die das und ist nicht mit den von zu ein eine auf dem des im sich "
    "le la les de des et est un une que pour dans en pas qui sur du "
    "el los las y es una con por para del se al lo como que"
).split()

#: Rules: name, metric, least, most. Ratios are per word or per line.
RULES: tuple[tuple[str, str, float | None, float | None], ...] = (
    ("words", "n_words", 50, 100_000),
    ("mean_word_length", "word_chars / n_words", 3, 10),
    ("symbols_per_word", "n_symbols / n_words", None, 0.1),
    ("stop_words", "n_stop_words / n_words", 0.02, None),
    ("bullet_lines", "n_bullet_lines / n_lines", None, 0.9),
    ("ellipsis_lines", "n_ellipsis_lines / n_lines", None, 0.3),
    ("duplicate_lines", "n_dup_lines / n_lines", None, 0.5),
    ("repeated_words", "n_repeat_words / n_words", None, 0.5),
)

WORK = ("__text", "__words", "__lines", "__windows", "__ranked", "__repeated")

#: Places (from 0) of the 3-word windows found at least twice: sort (hash, place) pairs, keep those with an equal neighbour.
REPEATED = """sort_array(transform(filter(
    transform(__ranked, (s, k) -> named_struct('i', s.i, 'twice', coalesce(s.h = get(__ranked, k - 1).h, false) or coalesce(s.h = get(__ranked, k + 1).h, false))),
    s -> s.twice), s -> s.i))"""
#: Words under at least one of these windows; the places ascend.
COVERED = "aggregate(__repeated, named_struct('n', 0L, 'next', 0), (a, i) -> named_struct('n', a.n + least(3, i + 3 - a.next), 'next', i + 3), a -> a.n)"


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` plus the counts that rules refer to; columns of the same names in ``df`` are replaced.

    n_repeat_words compares windows by 64-bit hashes within one text; everything else is exact.
    """
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    hashes = F.expr("transform(sequence(1, n_words - 2), i -> xxhash64(element_at(__words, int(i)), element_at(__words, int(i) + 1), element_at(__words, int(i) + 2)))")
    return (
        df.withColumn("__text", F.coalesce(F.col(f"`{text}`"), F.lit("")))
        .withColumns({"__words": words(F.col("__text")), "__lines": F.filter(F.split("__text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")})
        .withColumn("n_words", F.size("__words").cast("bigint"))
        .withColumn("__windows", F.when(F.col("n_words") >= 3, hashes).otherwise(F.array().cast("array<bigint>")))
        .withColumn("__ranked", F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), F.expr("sort_array(transform(__windows, (h, i) -> named_struct('h', h, 'i', i)))")))
        .withColumn("__repeated", F.when(F.col("__ranked").isNotNull(), F.expr(REPEATED)))
        .withColumns(
            {
                "word_chars": F.length(F.translate("__text", SPACES, "")).cast("bigint"),
                "n_symbols": (F.length("__text") - F.length(F.translate("__text", "#*$%&|<>", ""))).cast("bigint"),
                "n_lines": F.size("__lines").cast("bigint"),
                "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
                "n_bullet_lines": F.size(F.filter("__lines", lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•"))).cast("bigint"),
                "n_ellipsis_lines": F.size(F.filter("__lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).cast("bigint"),
                "n_stop_words": F.expr(f"size(filter(__words, w -> lower(w) in ({stop})))").cast("bigint"),
                "n_repeat_words": F.coalesce(F.expr(COVERED), F.lit(0)).cast("bigint"),
            }
        )
        .drop(*WORK)
    )


def base_failed() -> Column:
    """The rule that holds whatever the table says: too few words, or over half under repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict(rules: Sequence[tuple[str, str, float | None, float | None]] = RULES) -> Column:
    """True where every rule's metric lies within its bounds; a metric that divides by zero fails."""
    passed = F.lit(True)
    for _, metric, least, most in rules:
        value = F.expr(re.sub(r"(\w+) / (\w+)", r"(\1 / nullif(\2, 0))", metric))
        if least is not None:
            passed = passed & F.coalesce(value >= F.lit(least), F.lit(False))
        if most is not None:
            passed = passed & F.coalesce(value <= F.lit(most), F.lit(False))
    return passed


def oracle_rule(rule: tuple[str, str, float | None, float | None]) -> str:
    """A rule's name where it fails, as DuckDB SQL."""
    name, metric, least, most = rule
    value = re.sub(r"(\w+) / (\w+)", r"(\1 / nullif(\2, 0))", metric)
    tests = [f"{value} >= {least}"] * (least is not None) + [f"{value} <= {most}"] * (most is not None)
    return f"case when coalesce({' and '.join(tests)}, false) then null else '{name}' end"


def failed_rules(rules: Sequence[tuple[str, str, float | None, float | None]] = RULES) -> Column:
    """Names of the rules that a document fails, comma-joined."""
    return F.concat_ws(",", *(F.when(~verdict([rule]), F.lit(rule[0])) for rule in rules))


def quality_report(df: DataFrame, text: str = "text", rules: Sequence[tuple[str, str, float | None, float | None]] = RULES) -> DataFrame:
    """``df`` with measures, base_failed, kept and failed (names of failed rules)."""
    return measures(df, text).withColumn("base_failed", base_failed()).withColumns({"kept": ~F.col("base_failed") & verdict(rules), "failed": failed_rules(rules)})


def filter_quality(df: DataFrame, text: str = "text", rules: Sequence[tuple[str, str, float | None, float | None]] = RULES) -> DataFrame:
    """The rows of ``df`` that are kept, with the columns of ``df`` only.

    The verdict stays above its projections: pushed through them, the optimizer would write every measure
    out again at each of its uses. A row number in the condition holds it there.
    """
    carried = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__row"), F.col(f"`{text}`").alias("__value"))
    report = quality_report(carried, "__value", rules).withColumn("__number", F.monotonically_increasing_id())
    return report.filter("kept and __number >= 0").select("__row.*")


#: DuckDB SQL for the query over documents.
ORACLE = f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from d),
g as (select doc_id, i, w[i:i + 2] as g from w, range(1, len(w) - 1) as r(i)),
h as (select doc_id, i from g qualify count(*) over (partition by doc_id, g) >= 2),
c as (select doc_id, count(distinct i + k) as n from h, range(0, 3) as r(k) group by doc_id),
m as (select w.doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
  len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words,
  len(list_filter(lines, lambda x: left(ltrim(x, ' '), 1) in ('-', '*', '•'))) as n_bullet_lines,
  len(list_filter(lines, lambda x: suffix(rtrim(x, ' '), '...') or suffix(rtrim(x, ' '), '…'))) as n_ellipsis_lines,
  len(list_filter(w, lambda x: lower(x) in ({", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))}))) as n_stop_words
  from w left join c on w.doc_id = c.doc_id),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, concat_ws(',', {", ".join(oracle_rule(r) for r in RULES)}) as failed from m)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
  cast(n_repeat_words as bigint) as n_repeat_words, base_failed, not base_failed and failed = '' as kept, failed from f"""
