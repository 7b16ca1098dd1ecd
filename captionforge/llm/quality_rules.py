"""Line-first quality rules, in DataFrame functions only: one projection over the scan, no exchange.

Each line of a text is held against the rules of `line_fails`; lines that fail go, and a document that loses more than half of
its words with them is rejected. The base verdict (too few words, too many repeated ones) is taken on the whole text before.
Repeated words are found by sorting the hashes of a text's 5-word windows, so the cost is n log n in a text's words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, let, lower_ascii, table, words

WINDOW = 5
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›•·"
#: Phrases of footers, notices and menus in English, German, French and Spanish.
BOILERPLATE = (
    "(all rights reserved|terms of (use|service)|privacy policy|cookie|click here|subscribe (now|to)|sign (in|up)|log ?in|skip to|enable javascript|share (this|on)|powered by"
    "|alle rechte vorbehalten|datenschutz|impressum|nutzungsbedingungen|hier klicken|jetzt (abonnieren|anmelden)|weiterlesen"
    "|tous droits réservés|mentions légales|politique de confidentialité|conditions d.utilisation|cliquez ici|se connecter|lire la suite"
    "|todos los derechos reservados|aviso legal|política de privacidad|términos (de|y) |haga clic|iniciar sesión|leer más)"
)
#: A document may lose at most this percentage of its words.
MOST_LOST = 50


def count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def line_fails(line: Column, w: Column) -> Column:
    """Whether a line with the words w fails a rule."""
    n = F.size(w)
    navigation = (count_of(line, SEPARATORS) >= 3) & (count_of(line, SEPARATORS) * 5 >= n)
    symbols = (count_of(line, SYMBOLS) >= 3) & (count_of(line, SYMBOLS) * 10 > F.length(line))
    shouting = (count_of(line, "!") >= 3) & (count_of(line, "!") * 5 >= n)
    repeats = (n >= 10) & (F.size(F.array_distinct(w)) * 10 < n * 3)
    unpunctuated = (n >= 8) & ~line.rlike("[.!?…。！？:;]")
    boilerplate = (n <= 12) & lower_ascii(line).rlike(BOILERPLATE)
    return navigation | symbols | shouting | repeats | unpunctuated | boilerplate


def repeated_words(w: Column) -> Column:
    """Words in windows of five that are found twice or more among the words w, the first find included."""
    hashes = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    windows = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
    by_hash = lambda g: F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    same = lambda s, x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
    found = lambda s: F.sort_array(F.transform(F.filter(s, lambda x, j: same(s, x, j - 1) | same(s, x, j + 1)), lambda x: x["i"]))
    covered = lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    counted = let(hashes(w), lambda h: let(windows(h), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(let(by_hash(g), lambda s: let(found(s), covered)))))
    return F.when(F.size(w) < WINDOW, 0).otherwise(counted)


def judged(text: Column) -> Column:
    """A struct of the base counts, the words lost with failing lines, and the lines that stay."""
    filled = lambda lines: F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    verdict = lambda x: let(words(x), lambda w: F.struct(x.alias("x"), F.when(line_fails(x, w), F.size(w)).otherwise(0).alias("lost")))
    lines = let(
        F.transform(F.split(text, "\n"), verdict),
        lambda v: F.struct(
            F.aggregate(v, F.lit(0), lambda a, x: a + x["lost"]).alias("lost"),
            F.array_join(F.transform(F.filter(v, lambda x: x["lost"] == 0), lambda x: x["x"]), "\n").alias("clean"),
        ),
    )
    counts = let(words(text), lambda w: F.struct(F.size(w).alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    dup = let(filled(F.split(text, "\n")), lambda f: F.size(f) - F.size(F.array_distinct(f)))
    chars = F.length(F.regexp_replace(text, SPACE, ""))
    return F.struct(counts.alias("counts"), lines.alias("lines"), chars.alias("chars"), count_of(text, SYMBOLS).alias("symbols"), dup.alias("dup"))


def base_failed(q: Column) -> Column:
    return (q["counts"]["n_words"] < 10) | (q["counts"]["n_repeat_words"] * 100 > q["counts"]["n_words"] * 20)


def passes(q: Column, most_lost: int) -> Column:
    return ~base_failed(q) & (q["lines"]["lost"] * 100 <= q["counts"]["n_words"] * most_lost)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_lost: int = MOST_LOST) -> DataFrame:
    """doc_id, the base counts, base_failed, lost_words and kept for each row of docs.

    A null or empty text has no words, so it fails the base. Rows are judged one by one: ties, repeated rows and null ids
    need no rule, and an empty table gives none. Other columns are ignored.
    """
    q = F.col("q")
    out = docs.select(F.col(id_col).alias("doc_id"), judged(F.coalesce(F.col(text_col), F.lit(""))).alias("q"))
    counts = {"n_words": q["counts"]["n_words"], "word_chars": q["chars"], "n_symbols": q["symbols"], "n_dup_lines": q["dup"], "n_repeat_words": q["counts"]["n_repeat_words"]}
    return out.select("doc_id", *[c.cast("long").alias(n) for n, c in counts.items()], base_failed(q).alias("base_failed"), q["lines"]["lost"].cast("long").alias("lost_words"), passes(q, most_lost).alias("kept"))


def keep_quality(docs: DataFrame, text_col: str = "text", most_lost: int = MOST_LOST) -> DataFrame:
    """The rows of docs that pass, without their failing lines; n_chars, if there, is counted anew where lines went.

    Rows are judged one by one, so ties, repeated rows and null ids need no rule; null and empty texts fail the base and go. Columns
    of any name pass through; no rows give none.
    """
    row, q = F.col("row"), F.col("q")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), judged(F.coalesce(F.col(text_col), F.lit(""))).alias("q"))
    cleaned, clean = q["lines"]["lost"] > 0, q["lines"]["clean"]
    columns = {text_col: F.when(cleaned, clean).otherwise(row[text_col])}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(cleaned, F.length(clean).cast(docs.schema["n_chars"].dataType)).otherwise(row["n_chars"])
    return whole.filter(passes(q, most_lost)).select(*[columns.get(c, row[c]).alias(c) for c in docs.columns])


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
p AS (SELECT r, unnest(w) AS x, unnest(range(len(w))) AS i FROM w),
g AS (SELECT r, i, concat_ws(chr(1), x, lead(x, 1) OVER s, lead(x, 2) OVER s, lead(x, 3) OVER s, lead(x, 4) OVER s) AS v,
  lead(x, 4) OVER s AS e FROM p WINDOW s AS (PARTITION BY r ORDER BY i)),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, v) AS n FROM g WHERE e IS NOT NULL),
k AS (SELECT r, sum(least(5, coalesce(z - i, 5))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS z FROM h WHERE n > 1) GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d),
m AS (SELECT r, x, list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '') AS w,
  length(x) - length(regexp_replace(x, '[|»›•·]', '', 'g')) AS sep, length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS sym,
  length(x) - length(replace(x, '!', '')) AS bang FROM l),
f AS (SELECT r, x, len(w) AS n,
  (sep >= 3 AND sep * 5 >= len(w)) OR (sym >= 3 AND sym * 10 > length(x)) OR (bang >= 3 AND bang * 5 >= len(w))
  OR (len(w) >= 10 AND len(list_distinct(w)) * 10 < len(w) * 3) OR (len(w) >= 8 AND NOT regexp_matches(x, '[.!?…。！？:;]'))
  OR (len(w) <= 12 AND regexp_matches(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{BOILERPLATE}')) AS bad FROM m),
a AS (SELECT r, coalesce(sum(n) FILTER (bad), 0) AS lost, count(*) FILTER (n > 0) - count(DISTINCT x) FILTER (n > 0) AS dup FROM f GROUP BY r),
q AS (SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(a.dup AS BIGINT) AS n_dup_lines,
  CAST(coalesce(k.n, 0) AS BIGINT) AS n_repeat_words, CAST(a.lost AS BIGINT) AS lost_words
  FROM w JOIN a ON a.r = w.r LEFT JOIN k ON k.r = w.r)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost_words * 100 <= n_words * {MOST_LOST} AS kept FROM q
"""
