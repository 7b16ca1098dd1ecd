"""Text scoring and cleaning as column expressions: they stay in the JVM, and a text is read where it lies.

Lengths are in code points. Null is taken for empty. White space is Unicode's, as trimming and blank tests have it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranges that count as CJK: ideographs, kana, hangul. (Fixed values.)
CJK = r"\u4e00-\u9fff\u3040-\u30ff\uac00-\ud7af"
ARABIC = r"\u0600-\u06ff"
#: What recognisers mistake for a letter, and the letter. (Fixed values.)
CONFUSED, MEANT = "01|!$@", "oiiisa"


def col(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def filled(text: Column | str) -> Column:
    return F.coalesce(col(text), F.lit(""))


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column | str) -> Column:
    return ~filled(text).rlike(r"(?U)\S")


def count_in(text: Column, chars: str) -> Column:
    """How many of the text's characters are in the class of a regular expression."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]", ""))


def alnum_count(text: Column | str) -> Column:
    return count_in(filled(text), r"\p{L}\p{Nd}")


def special_count(text: Column | str) -> Column:
    """Characters that are neither letters nor digits nor white space."""
    return F.length(F.regexp_replace(filled(text), r"(?U)[\p{L}\p{Nd}\s]", ""))


def cjk_count(text: Column | str) -> Column:
    return count_in(filled(text), CJK)


def has_cjk(text: Column | str) -> Column:
    return filled(text).rlike(f"[{CJK}]")


def distinct_chars(text: Column) -> Column:
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(F.size(F.array_distinct(F.split(text, ""))))


def one_char_repeated(text: Column) -> Column:
    """Whether a text of more than two characters is one of them, over and over."""
    return text.rlike(r"(?s)^(.)\1{2,}\z")


def alnum_ratio(text: Column | str) -> Column:
    t = filled(text)
    return F.when(F.length(t) == 0, F.lit(0.0)).otherwise(alnum_count(t) / F.length(t))


def score_text(text: Column | str) -> Column:
    """Length, letters and digits twice, CJK three times, specials minus twice."""
    t = filled(text)
    return (F.length(t) + alnum_count(t) * 2 + cjk_count(t) * 3 - special_count(t) * 2).cast("int")


def adaptive_threshold(fps: Column | int, base: float = 0.60) -> Column:
    """The similarity that continues a span at so many frames per second."""
    f = F.lit(fps) if isinstance(fps, int) else fps
    return F.lit(base) + F.when(f <= 2, 0.03).when(f == 3, -0.02).when(f == 4, -0.05).when(f == 5, -0.08).otherwise(-0.10)


def clean_text(text: Column | str) -> Column:
    """Without white space and strokes at either end; any white space inside is one space."""
    edged = F.regexp_replace(filled(text), r"(?U)^[\s\-_=+|]+|[\s\-_=+|]+$", "")
    return F.regexp_replace(edged, r"(?U)\s+", " ")


def normalize_for_comparison(text: Column | str) -> Column:
    """Lower case, confused characters as letters, words only, single spaces."""
    t = F.translate(trimmed(F.lower(filled(text))), CONFUSED, MEANT)
    kept = F.regexp_replace(t, rf"(?U)[^\w\s{CJK}{ARABIC}]", "")
    return trimmed(F.regexp_replace(kept, r"(?U)\s+", " "))


def is_better_text(new: Column | str, current: Column | str) -> Column:
    """Whether a reading is to take the place of the one held."""
    n, c = filled(new), filled(current)
    close = F.abs(F.length(n) - F.length(c)) <= 2
    better = (F.length(n) > F.length(c) + 3) | (alnum_ratio(n) > alnum_ratio(c) + 0.05) | (close & (special_count(n) < special_count(c)))
    return F.when(F.length(c) == 0, F.lit(True)).when(F.length(n) == 0, F.lit(False)).otherwise(better)


def similarity_of_normalized(a: Column, b: Column) -> Column:
    """Similarity of texts that are normalised already: by edits, by containment and by common words, the best of them."""
    longest = F.greatest(F.length(a), F.length(b))
    edits = F.lit(1.0) - F.levenshtein(a, b) / longest
    contained = F.when(F.contains(a, b) | F.contains(b, a), F.least(F.length(a), F.length(b)) / longest).otherwise(F.lit(0.0))
    wa, wb = F.split(a, " "), F.split(b, " ")
    several = (F.length(a) > 5) & (F.length(b) > 5) & (F.size(wa) > 1) & (F.size(wb) > 1)
    common = F.when(several, F.size(F.array_intersect(wa, wb)) / F.greatest(F.size(wa), F.size(wb))).otherwise(F.lit(0.0))
    best = F.greatest(edits, contained, common, F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(F.least(best, F.lit(1.0)))


def similarity(first: Column | str, second: Column | str, first_norm: Column | str | None = None, second_norm: Column | str | None = None) -> Column:
    """0 to 1; 0 where either is empty, 1 where they are the same but for case, marks and confused characters.

    Texts that are compared more than once can bring their normalised forms along.
    """
    a, b = filled(first), filled(second)
    na, nb = (normalize_for_comparison(t) if n is None else col(n) for t, n in ((a, first_norm), (b, second_norm)))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(let(F.struct(na.alias("a"), nb.alias("b")), lambda n: similarity_of_normalized(n["a"], n["b"])))


def lines_of(text: Column | str) -> Column:
    """The lines that aren't blank, trimmed."""
    return F.filter(F.transform(F.split(filled(text), "\n"), trimmed), lambda x: x != "")


def clean_ocr_text(text: Column | str) -> Column:
    """Bars go, underscores are spaces, marks that stand alone go, and so do blank lines and spaces too many."""
    t = F.translate(filled(text), "_|", " ")
    t = F.regexp_replace(t, rf"(?U)(?<=\s|^)[^\w\s{CJK}](?=\s|$)", "")
    return F.array_join(lines_of(F.regexp_replace(t, "  +", " ")), "\n")


def trim_ocr_text(text: Column | str) -> Column:
    return F.array_join(lines_of(text), "\n")


def remove_ocr_noise(text: Column | str) -> Column:
    """Bars and underscores go, runs of spaces are one."""
    t = F.regexp_replace(F.regexp_replace(filled(text), r"[|_]", ""), "  +", " ")
    return F.when(is_blank(text), F.lit("")).otherwise(trimmed(t))


def remove_duplicate_lines(text: Column | str) -> Column:
    """Each line once, where it comes first; lines trimmed, blank ones gone."""
    return F.array_join(F.array_distinct(lines_of(text)), "\n")


def normalize_ocr(text: Column | str) -> Column:
    """Trimmed lines that aren't blank; plain quotes and dots; no control characters; no bars at either end."""
    lines = F.filter(F.transform(F.split(filled(text), r"[\r\n]"), trimmed), lambda x: x != "")
    t = F.array_join(lines, "\n")
    t = F.replace(F.translate(t, "“”‘’", "\"\"''"), F.lit("…"), F.lit("..."))
    t = F.regexp_replace(t, r"[\p{Cc}&&[^\n]]", "")
    return trimmed(F.regexp_replace(F.regexp_replace(t, r"(?U)^\|+\s*", ""), r"(?U)\s*\|+\z", ""))


def without_spaces(text: Column) -> Column:
    return F.translate(text, " \n", "")


def quality_of(text: Column | str) -> Column:
    """0 to 1: how much like text a reading is, by its characters."""
    t = filled(text)

    def scored(c: Column) -> Column:
        cjk, n, kinds = cjk_count(c), F.length(c), distinct_chars(c)
        body = F.when(cjk > 0, F.lit(0.2) + F.least(F.lit(0.15), cjk * 0.03)).otherwise((alnum_ratio(c) - 0.5) * 0.3)
        long_enough = F.when((n >= 2) & (n <= 200), 0.1).when((n == 1) & (cjk > 0), 0.05).otherwise(0.0)
        marks = distinct_chars(F.regexp_replace(c, r"(?U)[\p{L}\p{Nd}\s]", ""))
        noisy = F.when(marks > 6, -0.12).when(marks > 3, -0.05).otherwise(0.0)
        dull = F.when(n <= 3, 0.0).when(kinds <= 1, -0.35).when((kinds <= 2) & (cjk == 0), -0.20).when((kinds / n < 0.15) & (cjk == 0), -0.10).otherwise(0.0)
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(0.5) + body + long_enough + noisy + dull))

    return F.when(is_blank(t), F.lit(0.0)).otherwise(let(without_spaces(t), scored))


def confidence_with_quality(text: Column | str, confidence: Column | str) -> Column:
    """A line's confidence, 0 to 100, lowered for short, odd and repetitive texts."""
    t, conf = filled(text), col(confidence)
    letters = alnum_count(t)
    ratio = letters / F.length(without_spaces(t))
    factor = F.when(F.length(t) < 2, 0.5).when(F.length(t) < 4, 0.7).otherwise(1.0) * F.when(ratio < 0.3, 0.4).when(ratio < 0.5, 0.7).otherwise(1.0)
    factor = factor * F.when((distinct_chars(t) <= 2) & (F.length(t) > 3), 0.3).otherwise(1.0)
    kept = F.least(F.lit(100.0), F.greatest(F.lit(0.0), conf * factor))
    return F.when(is_blank(t), F.lit(0.0)).when(letters == 0, F.lit(5.0)).otherwise(kept)


def word_confidence(text: Column | str, width: Column | str, height: Column | str) -> Column:
    """The confidence of a word, 0 to 100, by its length, characters and box."""
    t, w, h = filled(text), col(width), col(height)
    add = lambda test, v: F.when(test, F.lit(float(v))).otherwise(F.lit(0.0))
    aspect = w / F.greatest(F.lit(1.0), h)

    def scored(m: Column) -> Column:
        n, alnum = m["n"], m["alnum"]
        total = F.lit(85.0) + add(n >= 3, 5) + add(n >= 5, 3)
        total = total + F.when(n == 1, F.when(alnum == 1, -5.0).otherwise(-25.0)).otherwise(0.0)
        total = total + add((n > 1) & (alnum * 2 < n), -15) + add(m["cjk"], 5) + add((w < 8) | (h < 8), -20) + add((aspect >= 0.2) & (aspect <= 15), 3)
        return F.least(F.lit(100.0), F.greatest(F.lit(0.0), total))

    # words of Latin letters and digits only, which are most, need no class counts
    plain = t.rlike("^[A-Za-z0-9]+$")
    alnum = F.when(plain, F.length(t)).otherwise(alnum_count(t))
    return let(F.struct(F.length(t).alias("n"), alnum.alias("alnum"), (~plain & has_cjk(t)).alias("cjk")), scored)
