"""Secret scan by a trigram inverted index, with DataFrame functions only.

From every rule's regular expression a Boolean query over trigrams is derived: a list of alternatives, each a set
of trigrams that a matching text must contain in lower case. Postings (trigram, document) are built for the
trigrams that the queries mention, the alternatives' postings are intersected by one aggregation, and only the
documents that are left are verified with the rule's expression. A rule without mandatory trigrams (``hex``)
scans every text.

Defined results: a null text is an empty one and has no spans; a null id is joined null-safely and passed
through; repeated rows are scanned each by itself (rows of one id share their candidate rules, which verification
settles); very long texts are scanned whole; offsets count code points, ends exclusive; an empty table gives no rows;
carried columns keep their names, but for an own ``spans``, which the result replaces.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import table, text_of

#: Query strings are spelled out up to so many variants before a segment ends.
MAX_VARIANTS = 64


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` code points, else the match is dropped."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


#: Fixed values. Within access and hex the minimum length is part of the expression: their matches are whole runs
#: of one class, so that dropping short runs afterwards finds the same spans.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE_RULES = (
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{20,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("login", r"://[A-Za-z0-9._-]{1,64}:[A-Za-z0-9._-]{3,64}@"),
)
RULES = BASE_RULES + MORE_RULES


def _variants(node) -> list[str] | None:
    """All strings of one parsed element in lower case, or None if they are too many or unbounded."""
    op, arg = node
    if op is sre.LITERAL:
        return [chr(arg).lower()]
    if op is sre.IN:
        out: list[str] = []
        for kind, x in arg:
            if kind is sre.LITERAL:
                out.append(chr(x).lower())
            elif kind is sre.RANGE and x[1] - x[0] < 8:
                out += [chr(c).lower() for c in range(x[0], x[1] + 1)]
            else:
                return None
        return sorted(set(out)) if len(set(out)) <= 8 else None
    if op is sre.SUBPATTERN:
        return _spelled(arg[3])
    if op is sre.BRANCH:
        parts = [_spelled(x) for x in arg[1]]
        return None if None in parts else sorted({s for p in parts for s in p})
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] == 0 and arg[1] == 1:
        inner = _spelled(arg[2])
        return None if inner is None else sorted({"", *inner})
    return None


def _spelled(sequence) -> list[str] | None:
    out = [""]
    for node in sequence:
        more = _variants(node)
        if more is None or len(out) * len(more) > MAX_VARIANTS:
            return None
        out = [a + b for a in out for b in more]
    return out


def _smallest(alternatives: set[frozenset]) -> set[frozenset]:
    return {a for a in alternatives if not any(b < a for b in alternatives)}


def trigram_query(regex: str) -> list[frozenset[str]] | None:
    """Alternatives, each a set of mandatory lower-case trigrams; None if some match may have none.

    The expression is read as a sequence; stretches that can be spelled out give one alternative a variant, and
    the stretches are combined by AND.
    """
    query: set[frozenset] = {frozenset()}

    def close(stretch: list[str]) -> None:
        nonlocal query
        grams = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in stretch]
        if all(grams):
            both = _smallest({a | b for a in query for b in grams})
            query = both if len(both) <= MAX_VARIANTS else query

    stretch = [""]
    for node in sre_parser.parse(regex):
        if node[0] is sre.SUBPATTERN and len(node[1][3]) == 1:
            node = node[1][3][0]
        more = _variants(node)
        if more is not None and len(stretch) * len(more) <= MAX_VARIANTS:
            stretch = [a + b for a in stretch for b in more]
            continue
        close(stretch)
        stretch = [""]
        if more is not None:
            stretch = more
        elif node[0] is sre.MAX_REPEAT and node[1][0] >= 1:  # what repeats occurs once at least
            once = _spelled(node[1][2])
            close(once or [""])
    close(stretch)
    return sorted(query, key=sorted) if frozenset() not in query else None


def postings(docs: DataFrame, vocabulary: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(trigram, doc_id) for the vocabulary, which the rules bound."""
    low = docs.select(F.col(id_col).alias("doc_id"), F.lower(text_of(text_col)).alias("low"))
    grams = F.array(*[F.lit(g) for g in vocabulary])
    return low.select("doc_id", F.explode(F.filter(grams, lambda g: F.contains("low", g))).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``rules_left``: bit k is set where the trigrams of rule k allow a match."""
    queries = {k: q for k, rule in enumerate(rules) if (q := trigram_query(rule.regex)) is not None}
    # bounded by the rules; a repeated row sets a bit that is set already
    terms = [(g, k, n, 1 << i, (1 << len(alternative)) - 1) for k, q in queries.items() for n, alternative in enumerate(q) for i, g in enumerate(sorted(alternative))]
    if not terms:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit(0).cast("long").alias("rules_left")).limit(0)
    index = postings(docs, sorted({t[0] for t in terms}), id_col, text_col)
    asked = index.sparkSession.createDataFrame(terms, "trigram string, rule int, alternative int, bit long, all_bits long")
    hits = index.join(F.broadcast(asked), "trigram").groupBy("doc_id", "rule", "alternative").agg(F.bit_or("bit").alias("got"), F.first("all_bits").alias("all_bits"))
    left = hits.filter("got = all_bits").select("doc_id", "rule").distinct()
    return left.groupBy("doc_id").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules_left"))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, ord, end, kind>> of one rule: the text between matches gives the offsets."""
    empty = "array<struct<start:int,ord:int,end:int,kind:string>>"
    parts = F.arrays_zip(
        F.split(text, rule.regex, -1).alias("a"),
        F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0)).alias("b"),
        F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)).alias("c"),
    )

    def step(acc: Column, z: Column) -> Column:
        start = acc["pos"] + F.char_length(z["a"])
        end = start + F.char_length(z["b"])
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        out = F.when(F.char_length(z["c"]) >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.when(z["b"].isNull(), acc).otherwise(F.struct(end.alias("pos"), out.alias("out")))

    first = F.struct(F.lit(0).alias("pos"), F.array().cast(empty).alias("out"))
    return F.aggregate(parts, first, step, lambda acc: acc["out"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with ``spans``: array<struct<start, ord, end, kind>> by start, then rule."""
    left = candidates(docs, rules, id_col, text_col)
    carried = docs.select(F.struct(*[c for c in docs.columns if c != "spans"]).alias("row"))
    d = carried.join(left, carried["row"][id_col].eqNullSafe(left["doc_id"]), "left").select("row", "rules_left")
    text, found = F.coalesce(F.col("row")[text_col], F.lit("")), []
    for k, rule in enumerate(rules):
        if trigram_query(rule.regex) is None:
            due = text.rlike(rule.regex)
        else:
            due = F.coalesce(F.col("rules_left"), F.lit(0)).bitwiseAND(F.lit(1 << k)) != 0
        found.append(F.when(due, _spans(text, rule, k)).otherwise(F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>")))
    return d.select("row.*", F.sort_array(F.concat(*found)).alias("spans"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span of a secret replaced by its kind in brackets; other texts stay as they are."""
    found = scan(docs, rules, id_col, text_col)
    text = text_of(text_col)

    def step(acc: Column, s: Column) -> Column:
        from_, mark = F.greatest(acc["pos"], s["start"]), F.concat(F.lit("["), s["kind"], F.lit("]"))
        gap = F.substring(text, acc["pos"] + 1, from_ - acc["pos"])
        new = F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.concat(acc["out"], gap, F.when(s["start"] >= acc["pos"], mark).otherwise(F.lit(""))).alias("out"))
        return new

    clean = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")),
        step,
        lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.lit(2**31 - 1))),
    )
    return found.withColumn(text_col, F.when(F.size("spans") > 0, clean).otherwise(F.col(text_col)))


def query(spark, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["ord"] < len(BASE_RULES))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


def _oracle() -> str:
    """The same spans in DuckDB SQL, from the same rules but without trigrams."""
    kinds = []
    for k, r in enumerate(RULES):
        re = r.regex.replace("'", "''")
        kinds.append(f"""
  SELECT doc_id, {k} AS ord, '{r.kind}' AS kind, pre[i] + coalesce(list_sum(len0[1:i - 1]), 0) AS s, len0[i] AS n FROM (
    SELECT doc_id, len0, leng, [list_sum(lena[1:j]) for j in range(1, len(lena) + 1)] AS pre, unnest(range(1, len(len0) + 1)) AS i FROM (
      SELECT doc_id, [length(x) for x in string_split_regex(t, '{re}')] AS lena, [length(x) for x in regexp_extract_all(t, '{re}')] AS len0,
        [length(x) for x in regexp_extract_all(t, '{re}', {r.group})] AS leng FROM d WHERE regexp_matches(t, '{re}')))
  WHERE leng[i] >= {r.least}""")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({' UNION ALL '.join(kinds)}),
told AS (SELECT doc_id, ord, kind, s, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT) AS w FROM found),
per AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  coalesce(string_agg(w, ',' ORDER BY s, ord) FILTER (ord < {len(BASE_RULES)}), '') AS base, string_agg(w, ',' ORDER BY s, ord) AS spans FROM told GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per ON d.doc_id = per.doc_id
"""


ORACLE = _oracle()
