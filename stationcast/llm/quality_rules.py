"""Quality rules as a bitmask ledger.

``ledger`` measures every text once and stores the measurements and one failure bit per rule. Policies are versioned
masks over these bits: ``apply_policy`` accepts a text when no bit of the mask is set, and ``ablations`` compares
policies by bit operations on the counted masks alone, without another look at the texts.

Everything is DataFrame functions. Window and line equality inside one text go by 64-bit hashes and by the line
itself. Null and empty texts have no words and measure 0; rows with repeated or null ids are measured each for itself;
other columns are kept unless they bear the name of a ledger column, which they then lose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationcast.llm.common import table
from stationcast.llm.text import WHITE

#: Rule names; a rule's bit is its place in this list.
RULES = ("too_few_words", "repeated_windows", "symbol_heavy", "duplicate_lines", "word_length")
BASE = ("too_few_words", "repeated_windows")
POLICIES = {1: BASE, 2: (*BASE, "symbol_heavy", "duplicate_lines", "word_length")}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: Words in a window; the window hashes below are built by doubling up to 8.
WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: A symbol for every second word, half of all lines repeated, or words of under 2 or over 20 characters on average.
SYMBOLS_PER_100_WORDS, DUPLICATES_PER_100_LINES, SHORTEST_WORD, LONGEST_WORD = 50, 50, 2, 20


def mask_of(rules: tuple[str, ...]) -> int:
    return sum(1 << RULES.index(r) for r in rules)


def _with_later(hashes: str, reach: int) -> Column:
    return F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + reach)))


def _measures(df: DataFrame, text: str) -> DataFrame:
    """Step by step, so that no array is built twice."""
    kept = [c for c in df.columns if c not in MEASURES and not c.startswith("_q_")]
    df = df.select(*(F.col(f"`{c}`") for c in kept), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_q_text"))
    df = df.select(
        *(F.col(f"`{c}`") for c in kept),
        F.filter(F.split("_q_text", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("_q_words"),
        F.filter(F.split("_q_text", "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "").alias("_q_lines"),
        (F.length("_q_text") - F.length(F.regexp_replace("_q_text", f"[{SYMBOLS}]+", ""))).cast("long").alias("n_symbols"))
    df = df.select(
        *(F.col(f"`{c}`") for c in kept), "n_symbols",
        F.length(F.array_join("_q_words", "")).cast("long").alias("word_chars"),
        F.size("_q_words").cast("long").alias("n_words"), F.size("_q_lines").cast("long").alias("n_lines"),
        (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_q_words", lambda w: F.xxhash64(w)).alias("_q_hashes"))
    # Hashes of 2, 4 and 8 words, each out of two of the former; slice() per window would copy the whole array.
    for reach in (1, 2, 4):
        df = df.withColumn("_q_hashes", _with_later("_q_hashes", reach))
    windows = F.slice("_q_hashes", 1, F.greatest(F.col("n_words") - (WINDOW - 1), F.lit(0)).cast("int"))
    df = df.withColumn("_q_windows", windows).drop("_q_hashes")
    # Only texts in which a window occurs again are sorted: (hash, place), equal hashes side by side.
    again = F.size(F.array_distinct("_q_windows")) < F.size("_q_windows")
    df = df.withColumn("_q_sorted", F.when(again, F.sort_array(F.transform(
        "_q_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_q_windows")

    def repeated(x: Column, k: Column) -> Column:
        before = F.get("_q_sorted", k - 1)["h"] == x["h"]
        after = F.get("_q_sorted", k + 1)["h"] == x["h"]
        return F.when(F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False)), x["i"])
    df = df.withColumn("_q_places", F.sort_array(F.filter(F.transform("_q_sorted", repeated), F.isnotnull))
                       ).drop("_q_sorted")
    # The union of windows: each adds as many words as lie before the next one begins, the last all of its own.
    covered = F.aggregate(
        F.transform("_q_places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(
            F.get("_q_places", k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_q_places")


def _failures() -> dict[str, Column]:
    words, chars = F.col("n_words"), F.col("word_chars")
    return {
        "too_few_words": words < 20,
        "repeated_windows": 100 * F.col("n_repeat_words") > 30 * words,
        "symbol_heavy": 100 * F.col("n_symbols") > SYMBOLS_PER_100_WORDS * words,
        "duplicate_lines": 100 * F.col("n_dup_lines") > DUPLICATES_PER_100_LINES * F.col("n_lines"),
        "word_length": (chars < SHORTEST_WORD * words) | (chars > LONGEST_WORD * words),
    }


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows with their measurements and ``failures``, a long with one bit per failed rule."""
    measured = _measures(df, text)
    bits = F.lit(0).cast("long")
    for rule, fails in _failures().items():
        bits = bits.bitwiseOR(F.when(fails, F.lit(1 << RULES.index(rule))).otherwise(F.lit(0)).cast("long"))
    return measured.drop("failures").withColumn("failures", bits)


def apply_policy(entries: DataFrame, version: int) -> Column:
    """Accepts a ledger row when none of the policy's rules failed."""
    return F.col("failures").bitwiseAND(F.lit(mask_of(POLICIES[version])).cast("long")) == 0


def accepted(entries: DataFrame, version: int) -> DataFrame:
    """The ledger rows that a policy accepts.

    The row number keeps the optimizer from moving the condition below the measuring steps, where every step's
    expression would be written out again inside the next.
    """
    row = "_q_row"
    return (entries.withColumn(row, F.monotonically_increasing_id())
            .where(apply_policy(entries, version) & (F.col(row) >= 0)).drop(row))


def ablations(entries: DataFrame, version: int) -> DataFrame:
    """Per rule of a policy: how many rows fail it, fail nothing else, and would be kept without it.

    Rows are first counted per distinct mask (at most 2^rules of them), so the texts are not read again.
    """
    policy = mask_of(POLICIES[version])
    masks = (entries.select(F.col("failures").bitwiseAND(F.lit(policy).cast("long")).alias("mask"))
             .groupBy("mask").agg(F.count("*").alias("rows")))
    bits = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("long").alias("bit"))
                     for r in POLICIES[version]))
    at = masks.select("mask", "rows", F.inline(bits))
    has = F.col("mask").bitwiseAND(F.col("bit")) != 0
    only = F.col("mask") == F.col("bit")
    return at.groupBy("rule").agg(
        F.sum(F.when(has, F.col("rows")).otherwise(0)).alias("failed"),
        F.sum(F.when(only, F.col("rows")).otherwise(0)).alias("failed_only_this"),
        F.sum(F.when((F.col("mask") == 0) | only, F.col("rows")).otherwise(0)).alias("kept_without_it"),
        F.bit_or("mask").alias("masks_seen"))


def op5(spark: SparkSession, sf_dir: str, version: int = 2) -> DataFrame:
    entries = ledger(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.col("failures").bitwiseAND(F.lit(mask_of(BASE)).cast("long")) != 0
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                          base.alias("base_failed"), apply_policy(entries, version).alias("kept"), "failures")


OP5_SQL = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)),
                lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
numbered AS (SELECT *, row_number() OVER () AS row_id FROM w),
windows AS (SELECT row_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS win
  FROM (SELECT row_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM numbered
        WHERE len(words) >= {WINDOW})),
counted AS (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, win) AS n FROM windows),
places AS (SELECT row_id, i, lead(i) OVER (PARTITION BY row_id ORDER BY i) AS next FROM counted WHERE n > 1),
covered AS (SELECT row_id, sum(least({WINDOW}, coalesce(next - i, {WINDOW}))) AS n FROM places GROUP BY row_id),
measured AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM numbered LEFT JOIN covered USING (row_id)),
failing AS (SELECT *, CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT
    + 4 * (100 * n_symbols > {SYMBOLS_PER_100_WORDS} * n_words)::INT
    + 8 * (100 * n_dup_lines > {DUPLICATES_PER_100_LINES} * n_lines)::INT
    + 16 * (word_chars < {SHORTEST_WORD} * n_words OR word_chars > {LONGEST_WORD} * n_words)::INT AS BIGINT)
    AS failures FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures % 4 <> 0 AS base_failed,
  failures = 0 AS kept, failures FROM failing"""
