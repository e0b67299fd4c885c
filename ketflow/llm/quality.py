"""Quality rules (operator 10): a threshold table compiled into one projection.

Every metric is a DataFrame expression over the words and lines of one row, and
every rule is a row ``(metric, low, high)`` of a table.  ``compile_rules`` folds
the table into a single boolean column, so the whole verdict is one Spark
projection without user functions, shuffles or joins: its cost is linear in the
text and each row is judged on its own, whatever the skew of the keys.

Edge cases: a null or blank text has no words, all counts 0, ``base_failed`` true
and ``kept`` false.  Repeated rows are judged alike, once each.  Extra columns of
the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ketflow.llm.common import SPACE_CHARS, split_words

SYMBOLS = "#*$%&|<>"

#: Frequent function words of the languages served (lower case).
STOP_WORDS = (
    "the of and to in is that for it was on with as be by at this are from or an have not they which "
    "der die das und in zu den ist von mit sich des auf für im dem nicht ein eine als auch "
    "le la les de et des un une en que qui dans pour par sur pas au avec est du "
    "el la los las y que un una por con para del se no es al lo su como más"
).split()
STOP_WORDS = tuple(dict.fromkeys(STOP_WORDS))

#: The declarative rule table: metric, least value, greatest value (None: open).
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("mean_word_chars", 2.0, 12.0),
    ("symbol_word_ratio", None, 0.1),
    ("letter_word_ratio", 0.7, None),
    ("stop_word_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.5),
    ("bullet_line_ratio", None, 0.9),
    ("ellipsis_line_ratio", None, 0.3),
)

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _let(value: Column, body) -> Column:
    """Bind ``value`` once for ``body``: a one-element transform evaluates it a single time per row."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Number of words lying in a 3-word window that occurs twice or more in the array.

    The windows are sorted with their positions inside the row; equal neighbours are
    the repeated ones (n log n, no pairs), and the union of their spans is counted.
    """
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")),
    )

    def spans(s: Column) -> Column:
        twin = F.filter(
            s,
            lambda x, k: (F.get(s, k + 1)["w"].eqNullSafe(x["w"])) | (F.get(s, k - 1)["w"].eqNullSafe(x["w"])),
        )
        covered = F.flatten(F.transform(twin, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
        return F.size(F.array_distinct(covered))

    return F.when(F.size(words) >= 4, _let(F.array_sort(windows), spans)).otherwise(F.lit(0))


def _metrics() -> dict[str, Column]:
    """Columns of the rule metrics over ``words``, ``lines`` and ``raw`` (see ``score``)."""
    n, lines = F.col("n_words"), F.size("lines")
    words = F.col("words")

    def share(count: Column, total: Column) -> Column:
        return F.when(total > 0, count / total).otherwise(F.lit(0.0))

    def strip(w: Column) -> Column:
        return F.rtrim(F.lower(w), F.lit(".,;:!?"))

    return {
        "mean_word_chars": share(F.col("word_chars"), n),
        "symbol_word_ratio": share(F.col("n_symbols"), n),
        "letter_word_ratio": share(F.size(F.filter(words, lambda w: w.rlike(r"\p{L}"))), n),
        "stop_word_ratio": share(F.size(F.filter(words, lambda w: strip(w).isin(*STOP_WORDS))), n),
        "dup_line_ratio": share(F.col("n_dup_lines"), lines),
        "bullet_line_ratio": share(F.size(F.filter("lines", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))), lines),
        "ellipsis_line_ratio": share(F.size(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))), lines),
    }


def compile_rules(rules=RULES) -> Column:
    """One boolean column: every row of the table holds.  Unknown metrics raise ``KeyError``."""
    metrics = _metrics()
    verdict = F.lit(True)
    for name, low, high in rules:
        if low is not None:
            verdict = verdict & (metrics[name] >= F.lit(float(low)))
        if high is not None:
            verdict = verdict & (metrics[name] <= F.lit(float(high)))
    return verdict


def score(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts and verdict of every row of ``docs``: one projection, any number of rows.

    Returns the id, ``n_words word_chars n_symbols n_dup_lines n_repeat_words`` (long),
    ``base_failed`` and ``kept``.
    """
    raw = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col), raw.alias("raw"), split_words(F.col(text_col)).alias("words"), F.filter(F.split(raw, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    counted = base.select(
        id_col,
        "words",
        "lines",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.translate("raw", SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.char_length("raw") - F.char_length(F.translate("raw", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.select(
        id_col,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & compile_rules(rules)).alias("kept"),
    )


def oracle(rules=RULES) -> str:
    """The same result in DuckDB SQL, by grouping unnested windows instead of sorting arrays."""
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    metric = {
        "mean_word_chars": "word_chars / n_words",
        "symbol_word_ratio": "n_symbols / n_words",
        "letter_word_ratio": "len(list_filter(words, lambda w: regexp_matches(w, '\\p{L}'))) / n_words",
        "stop_word_ratio": f"len(list_filter(words, lambda w: rtrim(lower(w), '.,;:!?') IN ({stops}))) / n_words",
        "dup_line_ratio": "n_dup_lines / n_lines",
        "bullet_line_ratio": "len(list_filter(lines, lambda x: regexp_matches(x, '^[\\x20\\x09-\\x0D]*[-*•]'))) / n_lines",
        "ellipsis_line_ratio": "len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))) / n_lines",
    }
    terms = []
    for name, low, high in rules:
        if low is not None:
            terms.append(f"coalesce({metric[name]}, 0) >= {low}")
        if high is not None:
            terms.append(f"coalesce({metric[name]}, 0) <= {high}")
    return f"""
    WITH d AS (
      SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS raw,
             list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
      FROM documents),
    win AS (
      SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
      FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM d)),
    rep AS (SELECT rid, unnest([i, i + 1, i + 2]) AS p
            FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS c FROM win) WHERE c >= 2),
    r AS (SELECT rid, count(DISTINCT p) AS n FROM rep GROUP BY rid),
    m AS (
      SELECT d.doc_id, words, lines, len(words)::BIGINT AS n_words, len(lines) AS n_lines,
             coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(raw, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(r.n, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN r USING (rid)),
    f AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           (NOT base_failed AND {' AND '.join(terms)}) AS kept
    FROM f"""
