"""Quality rules as a bitmask ledger, with DataFrame functions only.

``ledger`` measures every document once and stores which rules it fails as bits of one long.
``apply_policy`` then keeps documents by a versioned policy, a mask over these bits, and ``ablation``
tells from the same bits what each rule alone decides. Changing a policy reads the ledger, not the texts.

Defined results: a null text is an empty one (no words, so it fails ``few_words``); a null id is passed
through; repeated rows are judged each by itself, and nothing is ranked, so there are no ties; very long texts are measured whole, in one row's
arrays; an empty table gives an empty ledger; only the id and text columns are read, so further columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import WORD, table, text_of, words_of

#: Rules in order of their bits. Each is (name, failing condition over the measurements).
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 25 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("capitals", "100 * n_capitals > 40 * word_chars"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
]
BASE = ("few_words", "repeated_windows")
#: Policies by version: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE,
    "v2": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "capitals", "word_length"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


def mask_of(rules: tuple[str, ...]) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(rule) for rule in rules)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every measurement of every document in one narrow pass.

    Windows of three words are compared by hash first; only texts in which a hash repeats sort the windows
    themselves, so a collision can't change a count.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("t"))
    d = d.select("doc_id", "t", words_of(F.col("t")).alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    w = F.col("w")
    d = d.select(
        "doc_id",
        "w",
        F.size("w").alias("n"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))).alias("hashes"),
    )
    repeats = F.size("hashes") > F.size(F.array_distinct("hashes"))
    windows = F.transform(F.sequence(F.lit(0), F.col("n") - 3), lambda i: F.struct(F.concat_ws(" ", w[i], w[i + 1], w[i + 2]).alias("k"), i.alias("i")))
    rest = ["doc_id", "n", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines"]
    d = d.select(*rest, F.when(repeats, F.sort_array(windows)).alias("s"))
    s, k = F.col("s"), lambda i: F.col("s")[i]["k"]
    twice = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: ((i > 0) & (k(F.greatest(i - 1, F.lit(0))) == k(i))) | ((i < F.size(s) - 1) & (k(F.least(i + 1, F.size(s) - 1)) == k(i))))
    d = d.select(*rest, "s", F.when(s.isNotNull(), twice).alias("at"))
    d = d.select(*rest, F.sort_array(F.transform("at", lambda i: s[i]["i"])).alias("p"))
    p = F.col("p")
    covered = F.when(F.size("p") > 1, F.aggregate(F.sequence(F.lit(1), F.size("p") - 1), F.lit(3), lambda a, i: a + F.least(F.lit(3), p[i] - p[i - 1]))).otherwise(0)
    return d.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        *rest[2:],
        F.when(p.isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, the measurements and ``fail_bits``: bit k is set where rule k fails."""
    bits: Column = F.lit(0).cast("long")
    for bit, (_, condition) in enumerate(rules or RULES):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, id_col, text_col).select("doc_id", *MEASURES, bits.alias("fail_bits"))


def apply_policy(rows: DataFrame, version: str = "v2") -> DataFrame:
    """The ledger's rows with base_failed and the policy's verdict."""
    base, own = mask_of(BASE), mask_of(POLICIES[version])
    failed = lambda mask: F.col("fail_bits").bitwiseAND(F.lit(mask)) != 0
    return rows.withColumns({"base_failed": failed(base), "kept": ~failed(base | own)})


def ablation(rows: DataFrame, version: str = "v2") -> DataFrame:
    """Per rule of a policy: documents it rejects, and documents that only it rejects.

    Documents are first counted by their failure bits (at most 2**rules groups), so nothing large is moved.
    """
    own = mask_of(POLICIES[version])
    groups = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(own)).alias("bits")).agg(F.count("*").alias("n"))
    names = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << bit).cast("long").alias("bit")) for bit, (name, _) in enumerate(RULES) if own >> bit & 1])
    each = groups.select("bits", "n", F.explode(names).alias("r"))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_rejected"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
    )


ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c >= 2
), rep AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(regexp_extract_all(t, '\p{Lu}')) AS BIGINT) AS n_capitals,
    CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN lines ON w.doc_id = lines.doc_id LEFT JOIN rep ON w.doc_id = rep.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 25 * n_words OR 100 * n_dup_lines > 30 * n_lines
    OR 100 * n_capitals > 40 * word_chars OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM m
"""


ABLATION_ORACLE = f"""
WITH v AS ({ORACLE.replace("SELECT doc_id, n_words, word_chars", "SELECT doc_id, n_lines, n_capitals, n_words, word_chars")}),
f AS (SELECT unnest([{", ".join(f"CASE WHEN {condition} THEN '{name}' END" for name, condition in RULES)}]) AS rule,
  {" + ".join(f"({condition})::INT" for _, condition in RULES)} AS fails FROM v)
SELECT rule, count(*) AS n_rejected, count(*) FILTER (fails = 1) AS n_only_this FROM f WHERE rule IS NOT NULL GROUP BY rule
UNION ALL SELECT r, 0, 0 FROM (SELECT unnest({[name for name, _ in RULES]!r}) AS r) WHERE r NOT IN (SELECT rule FROM f WHERE rule IS NOT NULL) AND EXISTS (FROM v)
"""


def query(spark, sf_dir: str) -> DataFrame:
    return apply_policy(ledger(table(spark, sf_dir, "documents"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def ablation_query(spark, sf_dir: str) -> DataFrame:
    """What each rule of the current policy rejects, alone and with others, from the ledger's bits."""
    return ablation(ledger(table(spark, sf_dir, "documents")))
