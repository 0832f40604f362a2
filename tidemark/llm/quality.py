"""Quality rules as a bitmask ledger.

Every rule is evaluated once for a text. The ledger keeps one bit for each failed rule beside the
measurements, so that policies (masks over the rules, by version) and ablations are bit operations
over the ledger and never read the texts again.

Defined results: null and empty texts have no words and fail ``few_words``; repeated rows and ties
are judged one by one, each on its own; an empty table gives an empty ledger; other columns are kept,
and a column that has the ledger's name is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules in the order of their bits, new ones last: SQL over the measurements that is true when the rule fails.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbol_heavy": "n_symbols > n_words",
    "repeated_lines": "n_lines >= 4 AND 2 * n_dup_lines > n_lines",
    "word_length": "word_chars > 24 * n_words",
    "bullet_lines": "n_lines >= 4 AND 10 * n_bullet_lines > 9 * n_lines",
    "ellipsis_lines": "n_lines >= 4 AND 10 * n_ellipsis_lines > 3 * n_lines",
    "few_letters": "n_words > 0 AND 10 * n_letter_words < 4 * n_words",
    "top_pair": "n_words > 1 AND 10 * n_top_pair > 2 * n_words",
    "long_repeats": "100 * n_repeat_5 > 40 * n_words",
    "no_stop_words": "n_words >= 50 AND n_stop_words < 2",
}
#: A policy names the rules that reject; versions are only ever added.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbol_heavy", "repeated_lines", "word_length"),
    "v2": ("few_words", "repeated_words", "symbol_heavy", "repeated_lines", "word_length", "bullet_lines", "ellipsis_lines", "few_letters", "top_pair", "long_repeats"),
    "english": ("few_words", "repeated_words", "no_stop_words"),
}
FIELDS = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
    "n_bullet_lines", "n_ellipsis_lines", "n_letter_words", "n_top_pair", "n_repeat_5", "n_stop_words",
)
MEASURES = ", ".join(f"{x} long" for x in FIELDS)
#: English words that any longer prose has, and marks that open a list's line.
STOP_WORDS = frozenset(b"the be to of and that have with".split())
BULLETS = ("-", "*", "\u2022", "\u2023")
#: End of fixed values.
_LETTER = re.compile(rb"[A-Za-z\x80-\xff]").search
SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that stand in a window of ``width`` words found twice or more."""
    windows = list(zip(*(words[i:] for i in range(width))))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    total, covered = 0, 0  # covered: the first position that no repeated window has reached
    for at, window in enumerate(windows):
        if counts[window] > 1:
            total += at + width - max(at, covered)
            covered = at + width
    return total


def measure(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = text.encode().split()  # bytes split at exactly the six ASCII spaces
    lines = [y for x in text.split("\n") if (y := x.strip(SPACES))]
    whole = [x for x in text.split("\n") if x.strip(SPACES)]
    threes = repeated_words(words)
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(whole),
        len(whole) - len(set(whole)),
        threes,
        sum(x.startswith(BULLETS) for x in lines),
        sum(x.endswith(("...", "\u2026")) for x in lines),
        sum(_LETTER(w) is not None for w in words),
        max(Counter(zip(words, words[1:])).values(), default=0),
        repeated_words(words, 5) if threes else 0,  # a repeated window of five holds repeated ones of three
        sum(map(STOP_WORDS.__contains__, text.lower().encode().split())),
    )


def measured(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(x) for x in texts], columns=list(FIELDS))


def mask(names) -> int:
    order = list(RULES)
    return sum(1 << order.index(name) for name in set(names))


def ledger(docs: DataFrame, text: str = "text", name: str = "ledger") -> DataFrame:
    """``docs`` with a struct of the measurements and ``failed``, a bit for each failed rule."""
    raw = docs.withColumn(name, F.pandas_udf(measured, MEASURES)(F.col(text)))
    bits = F.lit(0)
    for i, rule in enumerate(RULES.values()):
        for m in FIELDS:  # the measurements live in the struct
            rule = _within(rule, m, name)
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)))
    return raw.withColumn(name, F.col(name).withField("failed", bits))


def _within(rule: str, field: str, name: str) -> str:
    return " ".join(f"`{name}`.{x}" if x == field else x for x in rule.split(" "))


def fails(policy: str, name: str = "ledger", policies: Mapping = POLICIES) -> Column:
    """True where a rule of the policy failed."""
    return F.col(f"{name}.failed").bitwiseAND(F.lit(mask(policies[policy]))) != 0


def ablation(judged: DataFrame, policy: str, name: str = "ledger", policies: Mapping = POLICIES) -> DataFrame:
    """For each rule of a policy: the rows that fail it, and those that it alone rejects.

    One pass of bitwise counts over the ledger; (rule, n_failed, n_only) comes back, a row for each rule.
    """
    chosen, whole = list(policies[policy]), mask(policies[policy])
    failed = F.col(f"{name}.failed").bitwiseAND(F.lit(whole))
    sums = judged.agg(
        *(F.count_if(failed.bitwiseAND(F.lit(mask([r]))) != 0).alias(f"f{i}") for i, r in enumerate(chosen)),
        *(F.count_if(failed == mask([r])).alias(f"o{i}") for i, r in enumerate(chosen)),
    )
    rows = F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f"f{i}").alias("n_failed"), F.col(f"o{i}").alias("n_only")) for i, r in enumerate(chosen)))
    return sums.select(F.inline(rows))
