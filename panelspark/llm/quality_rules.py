"""Quality rules: a table of thresholds compiled into one Spark projection.

Every count is taken inside its row with built-in functions: no user function, no
shuffle, whole texts. ``RULES`` is the threshold table; each line compares a count
with a share of another count in whole numbers, so no rounding decides a verdict.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 5

# Frequent words of running text in four languages.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "on",
    "be", "at", "by", "this", "are", "from", "or", "not",
    "der", "die", "und", "den", "von", "zu", "das", "sich", "mit", "auf", "für", "ist",
    "im", "dem", "nicht", "ein", "eine", "als", "auch", "des",
    "de", "la", "le", "et", "les", "en", "un", "du", "une", "que", "est", "pour", "qui",
    "dans", "par", "sur", "au", "pas", "avec",
    "el", "y", "los", "del", "se", "las", "por", "con", "para", "su", "al", "lo", "no", "es",
)


@dataclass(frozen=True)
class Rule:
    """Holds when ``count`` is at most / at least ``percent`` of ``of``."""

    name: str
    count: str
    of: str
    at_most: int | None = None
    at_least: int | None = None

    def holds(self) -> Column:
        left, right = 100 * F.col(self.count), F.col(self.of)
        verdict = F.lit(True)
        if self.at_most is not None:
            verdict = verdict & (left <= self.at_most * right)
        if self.at_least is not None:
            verdict = verdict & (left >= self.at_least * right)
        return verdict


RULES = (
    Rule("mean_word_length", "word_chars", "n_words", at_least=250, at_most=1000),
    Rule("symbol_share", "n_symbols", "word_chars", at_most=5),
    Rule("capital_share", "n_capitals", "word_chars", at_most=30),
    Rule("stop_word_share", "n_stop_words", "n_words", at_least=5),
    Rule("duplicate_line_share", "n_dup_lines", "n_lines", at_most=30),
)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE, -1), lambda w: w != "")


def _repeated(windows: Column) -> Column:
    """Words covered by windows that occur twice or more, from the windows' hashes."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return pairs


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words`` and the counts the rules read.

    A null or empty text has zero of everything. Columns of the same names are
    replaced. Windows are compared by a 64-bit hash within one text.
    """
    n, w, h, p, s, ls = (f"__{x}" for x in ("text", "words", "windows", "pairs", "starts", "lines"))
    out = docs.withColumn(n, F.coalesce(F.col(text_col), F.lit("")))
    out = out.withColumns({w: _words(F.col(n)), ls: F.filter(F.split(F.col(n), "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))})
    codes = F.transform(F.col(w), lambda x: F.xxhash64(x))
    out = out.withColumn(h, codes)
    out = out.withColumn(
        h,
        F.when(
            F.size(w) >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.size(w) - WINDOW),
                lambda i: F.xxhash64(*[F.get(F.col(h), i + k) for k in range(WINDOW)]),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    # Only texts with a repeated window sort theirs.
    out = out.withColumn(
        p, F.when(F.size(F.array_distinct(F.col(h))) < F.size(h), _repeated(F.col(h)))
    )
    out = out.withColumn(
        s,
        F.sort_array(
            F.transform(
                F.filter(
                    F.col(p),
                    lambda x, i: (F.get(F.col(p), i - 1)["h"] == x["h"]) | (F.get(F.col(p), i + 1)["h"] == x["h"]),
                ),
                lambda x: x["i"],
            )
        ),
    )
    covered = F.aggregate(
        F.transform(
            F.col(s), lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col(s), i + 1), x + WINDOW) - x)
        ),
        F.lit(0),
        lambda a, x: a + x,
    )
    bare = F.translate(F.col(n), " \t\n\x0b\f\r", "")
    stop = F.filter(F.col(w), lambda x: F.lower(F.translate(x, ".,", "")).isin(*STOP_WORDS))
    out = out.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(bare).cast("long"),
            "n_symbols": (F.length(n) - F.length(F.translate(F.col(n), SYMBOLS, ""))).cast("long"),
            "n_capitals": (F.length(n) - F.length(F.translate(F.col(n), CAPITALS, ""))).cast("long"),
            "n_stop_words": F.size(stop).cast("long"),
            "n_lines": F.size(ls).cast("long"),
            "n_dup_lines": (F.size(ls) - F.size(F.array_distinct(F.col(ls)))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        }
    )
    return out.drop(n, w, h, p, s, ls)


def judge(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``measure`` plus ``base_failed``, ``failed`` (names of broken rules) and ``kept``.

    ``base_failed``: fewer than ten words, or more than a fifth of them in repeated
    five-word windows.
    """
    out = measure(docs, text_col)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    broken = F.array_compact(F.array(*[F.when(~r.holds(), F.lit(r.name)) for r in rules]))
    return out.withColumns({"base_failed": base, "failed": broken}).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed") == 0)
    )


def oracle() -> str:
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    holds = " AND ".join(
        c
        for r in RULES
        for c in (
            [f"100 * {r.count} <= {r.at_most} * {r.of}"] if r.at_most is not None else []
        )
        + ([f"100 * {r.count} >= {r.at_least} * {r.of}"] if r.at_least is not None else [])
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
      FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS k
       FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5) x),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
cover AS (SELECT doc_id, count(DISTINCT i + j) AS n
          FROM twice, (SELECT unnest(range(0, 5)) AS j) o GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
             CAST(len(list_filter(ws, lambda x: lower(regexp_replace(x, '[.,]', '', 'g')) IN ({stops}))) AS BIGINT) AS n_stop_words,
             CAST(len(ls) AS BIGINT) AS n_lines,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN cover c ON w.doc_id = c.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {holds} AS kept
FROM b"""
