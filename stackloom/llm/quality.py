"""Quality rules with a bitmask ledger.

``measure`` looks at every whole text once and writes a ledger: the
measurements, and one bit for each rule that the text fails. A policy is a
versioned set of rules; applying one, or finding what each of its rules costs,
needs only the ledger's bits.

Null and empty texts have no words and fail the rules that ask for some.
Repeated rows are measured each on its own; an empty table gives an empty
ledger.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import check_names

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = str.maketrans("", "", "#*$%&|<>")
#: str.split() parts at these too, the definition of a word does not
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_marked_words", "n_bare_words", "n_letter_words", "max_word_chars", "n_bullet_lines", "n_ellipsis_lines")


@dataclass(frozen=True)
class Rule:
    """A row fails where the condition on the measurements is true. The place
    of a rule in RULES is its bit and never changes; new rules are appended."""

    name: str
    fails: str


RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("duplicate_lines", "n_dup_lines > 1 AND 10 * n_dup_lines > 3 * n_lines"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("upper_case", "100 * n_upper_words > 30 * n_words"),
    Rule("marked_words", "100 * n_marked_words > 30 * n_words"),
    Rule("bare_marks", "100 * n_bare_words > 20 * n_words"),
    Rule("no_letters", "100 * n_letter_words < 50 * n_words"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 25 * n_words"),
    Rule("long_word", "max_word_chars > 1000"),
    Rule("bullets", "100 * n_bullet_lines > 90 * n_lines"),
    Rule("ellipses", "100 * n_ellipsis_lines > 30 * n_lines"),
    Rule("empty", "n_words = 0"),
)
BITS = {rule.name: 1 << i for i, rule in enumerate(RULES)}

#: A version, once used, keeps its rules.
POLICIES = {
    "base-1": ("few_words", "repeated_words"),
    "strict-1": ("few_words", "repeated_words", "duplicate_lines", "symbols", "upper_case", "marked_words", "bare_marks", "no_letters", "word_length", "long_word", "bullets", "ellipses", "empty"),
}
BASE, DEFAULT = "base-1", "strict-1"


#: DuckDB SQL of the ledger of documents, with kept and base_failed, as the table ledger.
_LEDGER_SQL = r"""texts AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
    count(*) FILTER (bare[1] IN ('-', '*', '•', '‣')) AS n_bullet_lines, count(*) FILTER (bare LIKE '%...' OR bare LIKE '%…') AS n_ellipsis_lines
  FROM (SELECT doc_id, line, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM texts)) WHERE bare <> '' GROUP BY doc_id),
single AS (SELECT doc_id, w, rtrim(w, '!#*$%&|<>') AS core, regexp_matches(w, '\p{L}') AS lettered FROM (SELECT doc_id, unnest(words) AS w FROM texts)),
word_sums AS (SELECT doc_id, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars, max(length(w)) AS max_word_chars,
    count(*) FILTER (length(core) > 1 AND regexp_matches(core, '\p{Lu}') AND NOT regexp_matches(core, '[\p{Ll}\p{Lt}]')) AS n_upper_words,
    count(*) FILTER (lettered AND core <> w) AS n_marked_words, count(*) FILTER (core = '') AS n_bare_words, count(*) FILTER (lettered) AS n_letter_words FROM single GROUP BY doc_id),
windows AS (SELECT doc_id, i, words[i : i + 2] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM texts)),
repeats AS (SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1) GROUP BY doc_id),
measures AS (SELECT texts.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_upper_words, 0) AS n_upper_words, coalesce(n_marked_words, 0) AS n_marked_words,
    coalesce(n_bare_words, 0) AS n_bare_words, coalesce(n_letter_words, 0) AS n_letter_words, coalesce(max_word_chars, 0) AS max_word_chars, coalesce(n_bullet_lines, 0) AS n_bullet_lines, coalesce(n_ellipsis_lines, 0) AS n_ellipsis_lines
  FROM texts LEFT JOIN lines USING (doc_id) LEFT JOIN word_sums USING (doc_id) LEFT JOIN repeats USING (doc_id)),
"""


def ledger_sql() -> str:
    """CTEs up to one named ledger: doc_id, MEASURES, failed_bits, base_failed, kept."""
    bits = " + ".join(f"(CASE WHEN {r.fails} THEN {BITS[r.name]} ELSE 0 END)" for r in RULES)
    flags = f"failed_bits & {policy_mask(BASE)} <> 0 AS base_failed, failed_bits & {policy_mask(DEFAULT)} = 0 AS kept"
    return f"WITH {_LEDGER_SQL} ledger AS (SELECT *, {flags} FROM (SELECT *, ({bits})::BIGINT AS failed_bits FROM measures))\n"


def ablations_sql(policy: str = DEFAULT) -> str:
    """DuckDB SQL of ablations() over documents."""
    mask = policy_mask(policy)
    rows = "\nUNION ALL ".join(
        f"SELECT '{policy}' AS policy, '{name}' AS rule, count(*) FILTER (failed_bits & {BITS[name]} <> 0) AS n_failed, count(*) FILTER (failed_bits & {mask} = {BITS[name]}) AS n_only, count(*) FILTER (failed_bits & {mask} <> 0) AS n_rejected FROM ledger" for name in POLICIES[policy]
    )
    return ledger_sql() + rows


def policy_mask(policy: str) -> int:
    return sum(BITS[name] for name in POLICIES[policy])


def measure_text(text: str | None) -> tuple[int, ...]:
    """The MEASURES of one text."""
    text = text or ""
    odd = _OTHER_SPACE.search(text) is not None
    split = _WORD.findall if odd else str.split
    words = split(text)
    n = len(words)
    lines = text.split("\n")
    seen: set[str] = set()
    dup = full = bullets = ellipses = 0
    for line in lines:
        bare = line.strip(" \t\n\v\f\r")
        if not bare:
            continue
        full += 1
        if line in seen:
            dup += 1
        else:
            seen.add(line)
        bullets += bare[0] in "-*•‣"
        ellipses += bare.endswith(("...", "…"))
    repeat = 0
    if n >= 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(once := set(windows)) < len(windows):
            count = dict.fromkeys(once, 0)
            for w in windows:
                count[w] += 1
            end = 0  # words before it are counted
            for i, w in enumerate(windows):
                if count[w] > 1:
                    repeat += i + 3 - max(i, end)
                    end = i + 3
    upper = marked = bare_words = letters = longest = 0
    distinct = dict.fromkeys(words, 0)
    for w in words:
        distinct[w] += 1
    for w, k in distinct.items():
        longest = max(longest, len(w))
        if w.isalpha():
            letters += k
            upper += k * (len(w) > 1 and w.isupper())
            continue
        core = w.rstrip("!#*$%&|<>")
        some = any(map(str.isalpha, w))
        letters += k * some
        upper += k * (len(core) > 1 and core.isupper())
        marked += k * (len(core) < len(w) and some)
        bare_words += k * (not core)
    return (n, sum(map(len, words)), len(text) - len(text.translate(_SYMBOLS)), dup, repeat, full, upper, marked, bare_words, letters, longest, bullets, ellipses)


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """The ledger: (id, MEASURES long, failed_bits long). With keep, all columns
    of df stand in place of the id, so that a policy can filter rows as they
    come by, without a join; columns named as the ledger's are refused."""
    kept = df.columns if keep else [id_col]
    for c in kept:
        check_names(c, (*MEASURES, "failed_bits"))
    rows = df if keep else df.select(F.col(id_col), F.col(text_col).alias("__text"))
    at = kept.index(text_col) if keep else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                got = list(zip(*map(measure_text, part.column(at).to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *(pa.array(c, pa.int64()) for c in got)], [*kept, *MEASURES])

    schema = T.StructType([*df.select(*kept).schema.fields, *(T.StructField(c, T.LongType()) for c in MEASURES)])
    bits = sum((F.when(F.expr(r.fails), F.lit(BITS[r.name])).otherwise(F.lit(0)).cast("long") for r in RULES), F.lit(0).cast("long"))
    return rows.mapInArrow(run, schema).withColumn("failed_bits", bits)


def failed(policy: str = DEFAULT) -> Column:
    """True where a ledger row fails a rule of the policy."""
    return F.col("failed_bits").bitwiseAND(F.lit(policy_mask(policy)).cast("long")) != 0


def apply_policy(ledger: DataFrame, policy: str = DEFAULT) -> DataFrame:
    """Adds kept boolean to the ledger."""
    return ledger.withColumn("kept", ~failed(policy))


def ablations(ledger: DataFrame, policy: str = DEFAULT) -> DataFrame:
    """For each rule of a policy, from one pass over the ledger's bits: rows
    that fail it, rows that fail it alone (kept again if it were dropped), and
    rows that the policy rejects. (policy, rule, n_failed, n_only, n_rejected)"""
    mask = policy_mask(policy)
    bits = F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long"))
    per = ledger.groupBy(bits.alias("bits")).agg(F.count("*").alias("n"))  # a row for each combination
    names = POLICIES[policy]
    one = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    rows = [F.struct(F.lit(name).alias("rule"), one(F.col("bits").bitwiseAND(F.lit(BITS[name]).cast("long")) != 0).alias("n_failed"), one(F.col("bits") == BITS[name]).alias("n_only")) for name in names]
    total = per.agg(F.array(*rows).alias("rules"), one(F.col("bits") != 0).alias("n_rejected"))
    return total.select(F.lit(policy).alias("policy"), F.inline("rules"), "n_rejected")
