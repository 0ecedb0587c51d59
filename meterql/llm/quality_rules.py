r"""Rule bitmask ledger: every quality rule is evaluated once per document.

The ledger holds, for each document, the measurements and one long whose bit
`i` is set where rule `i` fails. Policies are masks over those bits and have
versions, so a policy change or an ablation reads the ledger, never the texts.

Everything is DataFrame expressions: whole texts, no shuffle, no Python.

Words are `[^\x20\x09-\x0D]+`. Defined edge cases: a null or empty text has no
words, measures zero everywhere and fails `too_few_words` alone; repeated rows
are measured row by row; other columns of the input are never read, so their
names cannot clash; an empty table gives an empty ledger.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterql.llm.common import SPACE_CLASS

WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_adjacent")


@dataclass(frozen=True)
class Rule:
    """`fails` is SQL over MEASURES that both Spark and other engines read alike."""

    bit: int
    name: str
    fails: str


#: Integer arithmetic only, so no engine rounds differently. Bits are never reused.
RULES = (
    Rule(0, "too_few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbol_ratio", "10 * n_symbols > 3 * n_words"),
    Rule(3, "duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "long_words", "word_chars > 15 * n_words"),
    Rule(5, "short_words", "2 * word_chars < 5 * n_words"),
    Rule(6, "shouting", "100 * n_upper > 40 * word_chars"),
    Rule(7, "stuttering", "100 * n_adjacent > 30 * n_words"),
)
BITS = {r.name: 1 << r.bit for r in RULES}
BASE_MASK = BITS["too_few_words"] | BITS["repeated_windows"]
#: Versioned policies: a document is rejected if any bit of the mask is set. v1 keeps documents that merely repeat some
#: lines or have unusual word lengths, which good documents do too; v2 applies every rule.
POLICIES = {
    "base": BASE_MASK,
    "v1": BASE_MASK | BITS["symbol_ratio"] | BITS["shouting"] | BITS["stuttering"],
    "v2": sum(BITS.values()),
}
DEFAULT_POLICY = "v1"


def _measured(df: DataFrame, text: str) -> DataFrame:
    """df with MEASURES as `__q_<name>` and the failure bits as `__q_bits`; df has no such names of its own."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    out = df.withColumn("__q_text", body)
    out = out.withColumn("__q_words", F.expr(rf"filter(split(__q_text, r'{SPACE_CLASS}+'), w -> w != '')"))
    out = out.withColumn("__q_lines", F.expr(rf"filter(split(__q_text, '\n'), l -> l rlike r'[^\x20\x09-\x0D]')"))
    out = out.withColumn("__q_keys", F.expr(
        f"if(size(__q_words) < {WINDOW}, array(cast(null as bigint)), "
        f"transform(sequence(1, greatest(1, size(__q_words) - {WINDOW - 1})), i -> xxhash64(slice(__q_words, i, {WINDOW}))))"))
    # Only texts in which some window comes twice are sorted: equal windows stand side by side then.
    out = out.withColumn("__q_sorted", F.expr(
        "if(size(array_distinct(__q_keys)) = size(__q_keys), array(), "
        "sort_array(transform(__q_keys, (k, i) -> named_struct('k', k, 'i', i))))"))
    out = out.withColumn("__q_at", F.expr(
        "sort_array(transform(filter(__q_sorted, (x, j) -> coalesce(get(__q_sorted, j - 1).k = x.k, false) "
        "or coalesce(get(__q_sorted, j + 1).k = x.k, false)), x -> x.i))"))
    measures = {
        "n_words": "size(__q_words)",
        "word_chars": "char_length(array_join(__q_words, ''))",
        "n_symbols": "regexp_count(__q_text, '[#*$%&|<>]')",
        "n_dup_lines": "size(__q_lines) - size(array_distinct(__q_lines))",
        "n_repeat_words": f"aggregate(__q_at, named_struct('n', 0, 'e', 0), (a, p) -> named_struct("
                          f"'n', a.n + p + {WINDOW} - greatest(a.e, p), 'e', p + {WINDOW}), a -> a.n)",
        "n_lines": "size(__q_lines)",
        "n_upper": "regexp_count(__q_text, '[A-Z]')",
        "n_adjacent": "size(filter(__q_words, (w, i) -> coalesce(w = get(__q_words, i - 1), false)))",
    }
    # Plain columns, not one struct: fields of a struct would be inlined and computed again by each rule.
    out = out.select(*[F.col(f"`{c}`") for c in df.columns], *[F.expr(f"cast({v} as bigint)").alias(f"__q_{k}") for k, v in measures.items()])
    # The row number adds nothing; it keeps filters on the bits above this projection. Below it they would
    # have to repeat every measurement's expression, each inside the next.
    return out.withColumn("__q_bits", _bits().bitwiseOR(F.monotonically_increasing_id().bitwiseAND(F.lit(0))))


def _bits() -> Column:
    """The failure bits, each rule read once from the measurements."""
    names = re.compile(rf"\b({'|'.join(MEASURES)})\b")
    return F.expr(" | ".join(f"if({names.sub(r'__q_\1', r.fails)}, {1 << r.bit}L, 0L)" for r in RULES))


def ledger(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, MEASURES (long) and failed_bits (long)."""
    out = _measured(df.select(F.col(key).alias("__q_key"), F.col(text).alias("__q_in")), "__q_in")
    return out.select(F.col("__q_key").alias(key), *[F.col(f"__q_{m}").alias(m) for m in MEASURES], F.col("__q_bits").alias("failed_bits"))


def judge(entries: DataFrame, policy: str | int = DEFAULT_POLICY) -> DataFrame:
    """A ledger with base_failed and kept under a policy (a version's name, or a mask)."""
    mask = POLICIES[policy] if isinstance(policy, str) else int(policy)
    bits = F.col("failed_bits")
    return entries.withColumn("base_failed", bits.bitwiseAND(F.lit(BASE_MASK)) != 0).withColumn(
        "kept", bits.bitwiseAND(F.lit(BASE_MASK | mask)) == 0)


def ablation(entries: DataFrame, policy: str | int = DEFAULT_POLICY) -> DataFrame:
    """Per rule of a policy: failed documents, those no other rule rejects, and what stays without it.

    The ledger is first summed by its distinct bit patterns (at most 2 to the
    number of rules), so the rest works on that many rows at any input size.
    """
    mask = POLICIES[policy] if isinstance(policy, str) else int(policy)
    patterns = entries.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    used = [r for r in RULES if mask >> r.bit & 1]
    rules = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in used])).alias("r")
    hit, others = F.col("failed_bits").bitwiseAND(F.col("bit")) != 0, F.col("failed_bits").bitwiseAND(F.lit(mask)).bitwiseAND(F.bitwise_not("bit"))
    joined = patterns.select("failed_bits", "n", rules).select("failed_bits", "n", "r.rule", "r.bit")
    return joined.groupBy("rule", "bit").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(hit & (others == 0), F.col("n")).otherwise(0)).alias("n_only_this"),
        F.sum(F.when(others == 0, F.col("n")).otherwise(0)).alias("n_kept_without"))


def keep_good(docs: DataFrame, policy: str | int = DEFAULT_POLICY, text: str = "text") -> DataFrame:
    """The rows that a policy keeps, with the input's columns only, whatever their names."""
    mask = BASE_MASK | (POLICIES[policy] if isinstance(policy, str) else int(policy))
    # The caller's columns stand in a struct meanwhile, so that none can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("__q_in"))
    kept = _measured(rows, "__q_in").where(F.col("__q_bits").bitwiseAND(F.lit(mask)) == 0)
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


_SQL_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def ledger_sql(policy: str = DEFAULT_POLICY, source: str = "documents") -> str:
    """The judged ledger in DuckDB's SQL, without any hash: windows are compared as texts."""
    bits = " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_SQL_WORDS} AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l
           FROM {source}),
win AS (SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
rep AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, s) > 1),
adj AS (SELECT r, count(*) AS n FROM (SELECT r, x, lag(x) OVER (PARTITION BY r ORDER BY i) AS before FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d)) WHERE x = before GROUP BY r),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS p FROM rep) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
             CAST(len(regexp_extract_all(t, '[A-Z]')) AS BIGINT) AS n_upper,
             CAST(coalesce(adj.n, 0) AS BIGINT) AS n_adjacent
      FROM d LEFT JOIN cov USING (r) LEFT JOIN adj USING (r)),
b AS (SELECT *, CAST({bits} AS BIGINT) AS failed_bits FROM m)
SELECT *, (failed_bits & {BASE_MASK}) <> 0 AS base_failed, (failed_bits & {BASE_MASK | POLICIES[policy]}) = 0 AS kept FROM b"""


def ablation_sql(policy: str = DEFAULT_POLICY, source: str = "documents") -> str:
    """The ablation in DuckDB's SQL, document by document."""
    mask = POLICIES[policy]
    rules = ", ".join(f"('{r.name}', CAST({1 << r.bit} AS BIGINT))" for r in RULES if mask >> r.bit & 1)
    hit, others = "(failed_bits & bit) <> 0", f"(failed_bits & {mask} & ~bit) = 0"
    count = "CAST(COUNT(CASE WHEN {} THEN 1 END) AS BIGINT) AS {}"
    return f"""WITH judged AS ({ledger_sql(policy, source)})
SELECT rule, bit, {count.format(f'({hit})', 'n_failed')}, {count.format(f'({hit}) AND ({others})', 'n_only_this')}, {count.format(f'({others})', 'n_kept_without')}
FROM judged, (VALUES {rules}) AS r(rule, bit) GROUP BY rule, bit"""
