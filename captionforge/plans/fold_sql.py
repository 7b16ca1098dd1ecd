"""DuckDB SQL for the folds: recursive queries that go from a video's row to the next with what has been made so far."""

from __future__ import annotations

from .carriers import FRAMES_SQL, SUBS_SQL

ALNUM = r"(length({0}) - length(regexp_replace({0}, '[\p{{L}}\p{{Nd}}]', '', 'g')))"
SPECIAL = r"length(regexp_replace({0}, '[\p{{L}}\p{{Nd}}\s]', '', 'g'))"
CJK = r"\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}"
#: Characters of the carriers' texts beyond ASCII, and stand-ins of one byte each: DuckDB's distance counts bytes.
WIDE, NARROW = "修仙宗门你好", "ABCDEF"
TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
CUE = ("idx", "start_ms", "end_ms", "text")
MEASURES = ("nt", "l", "ra", "sp")
BETTER = "CASE WHEN l = 0 OR c_l = 0 THEN l = 0 ELSE c_l > l + 3 OR c_ra > ra + 0.05::DOUBLE OR (abs(c_l - l) <= 2 AND c_sp < sp) END"


def ratio(t: str) -> str:
    return f"CASE WHEN length({t}) = 0 THEN 0.0::DOUBLE ELSE {ALNUM.format(t)}::DOUBLE / length({t}) END"


def kinds(t: str) -> str:
    return f"CASE WHEN length({t}) = 0 THEN 0 ELSE len(list_distinct(string_split({t}, ''))) END"


def norm(t: str) -> str:
    kept = f"regexp_replace(translate({TRIM.format(f'lower({t})')}, '01|!$@', 'oiiisa'), '[^\\w\\s{WIDE}]', '', 'g')"
    return TRIM.format(f"regexp_replace(translate({kept}, '{WIDE}', '{NARROW}'), '\\s+', ' ', 'g')")


def measures(t: str = "text") -> str:
    return f"{norm(t)} AS nt, length({t}) AS l, {ratio(t)} AS ra, {SPECIAL.format(t)} AS sp"


def alike(a: str, b: str, x: str = "text", y: str = "c_text") -> str:
    """Similarity of the texts x and y, by their normalised forms a and b."""
    words = lambda t: f"string_split({t}, ' ')"
    longest = f"greatest(length({a}), length({b}))"
    common = f"CASE WHEN least(length({a}), length({b})) > 5 AND len({words(a)}) > 1 AND len({words(b)}) > 1 THEN len(list_intersect(list_distinct({words(a)}), list_distinct({words(b)})))::DOUBLE / greatest(len({words(a)}), len({words(b)})) ELSE 0.0 END"
    contained = f"CASE WHEN contains({a}, {b}) OR contains({b}, {a}) THEN least(length({a}), length({b}))::DOUBLE / {longest} ELSE 0.0 END"
    return f"CASE WHEN {x} = '' OR {y} = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE greatest(1.0::DOUBLE - levenshtein({a}, {b})::DOUBLE / {longest}, {contained}, {common}, 0.0) END::DOUBLE"


def merging(name: str, source: str, joins: str, end: str, text: str, order: str = "start_ms, idx") -> str:
    """CTEs that end in `name`: cues of source in order, one that joins the last of those kept so far becomes a part of it.

    Of the last cue the columns go by their names, of the one that comes with c_ before.
    """
    every = (*CUE, *MEASURES)
    carried = {"idx": "idx", "start_ms": "start_ms", "end_ms": end, "text": text} | {m: f"CASE WHEN better THEN c_{m} ELSE {m} END" for m in MEASURES}
    step = ", ".join(f"CASE WHEN j THEN {carried[c]} ELSE c_{c} END AS {c}" for c in every)
    both = ", ".join(f"r.{c}, s.{c} AS c_{c}" for c in every)
    return f"""{name}_s AS (SELECT video_id, idx, start_ms, CAST(end_ms AS BIGINT) AS end_ms, text, {measures()}, row_number() OVER (PARTITION BY video_id ORDER BY {order}) AS k FROM {source}),
    {name}_r AS (SELECT video_id, k, CAST(1 AS BIGINT) AS seg, {', '.join(every)} FROM {name}_s WHERE k = 1 UNION ALL
      SELECT video_id, k, CASE WHEN j THEN seg ELSE seg + 1 END, {step} FROM (SELECT *, {joins} AS j, {BETTER} AS better FROM (
        SELECT s.video_id, s.k, r.seg, {both} FROM {name}_r r JOIN {name}_s s ON s.video_id = r.video_id AND s.k = r.k + 1))),
    {name} AS (SELECT video_id, {', '.join(f'arg_max({c}, k) AS {c}' for c in CUE)} FROM {name}_r GROUP BY video_id, seg)"""


def similar(name: str, source: str, least: float, low: str, high: int, furthest: bool) -> str:
    gap = "c_start_ms - end_ms"
    end = "greatest(end_ms, c_end_ms)" if furthest else "c_end_ms"
    return merging(name, source, f"{low} {gap} < {high} AND {alike('nt', 'c_nt')} >= {least}::DOUBLE", end, "CASE WHEN better THEN c_text ELSE text END")


def near_duplicates(name: str, source: str) -> str:
    return similar(name, source, 0.75, "", 1500, True)


def gapped(name: str, source: str) -> str:
    return similar(name, source, 0.85, "c_start_ms >= end_ms AND", 2000, False)


def adjacent(name: str, source: str) -> str:
    return similar(name, source, 0.92, "c_start_ms - end_ms >= -500 AND", 3000, True)


def continuations(name: str, source: str) -> str:
    return merging(name, source, "c_start_ms - end_ms < 1500 AND (text LIKE '%..' OR text LIKE '%-')", "c_end_ms", "rtrim(text, '.- ') || ' ' || c_text")


def merge_short(name: str, source: str) -> str:
    return merging(name, source, "end_ms - start_ms < 150 AND c_start_ms - end_ms < 500", "c_end_ms", "regexp_replace(text, '\\n$', '') || chr(10) || c_text", "idx")


RUNS = f"""{FRAMES_SQL}, run_c AS (SELECT video_id, ts_ms, CASE WHEN length(text) >= 2 THEN text ELSE '' END AS text FROM frames),
run_d AS (SELECT *, CASE WHEN lag(text) OVER o IS NULL OR lag(text) OVER o <> text OR ts_ms - lag(ts_ms) OVER o > 1000 THEN 1 ELSE 0 END AS b FROM run_c WINDOW o AS (PARTITION BY video_id ORDER BY ts_ms)),
run_e AS (SELECT *, sum(b) OVER (PARTITION BY video_id ORDER BY ts_ms) AS k FROM run_d),
runs AS (SELECT video_id, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, count(*) AS n, first(text) AS text FROM run_e GROUP BY video_id, k)"""


def closed(floor: str) -> str:
    brief = "(last - start < 100 OR length(best) < 2)"
    return f"CASE WHEN {brief} THEN greatest(last + 250, start + {floor}) ELSE last + 125 END"


def raw_spans(name: str = "spans") -> str:
    """CTEs from runs to spans: what is open goes from run to run, and a span that a run ends stands in that run's row."""
    brief = "(last - start < 100 OR length(best) < 2)"
    hold, new = ("h", "b"), ", ".join(f"CAST({c} AS {t}) AS {a}" for c, t, a in (("NULL", "BIGINT", "out_start"), ("NULL", "BIGINT", "out_end"), ("NULL", "VARCHAR", "out_text")))
    first = "CASE WHEN text = '' THEN NULL ELSE {0} END"
    opened = ", ".join(f"{first.format(c)} AS {a}" for c, a in [("text", "held"), ("text", "best")])
    measured = ", ".join(f"{first.format(c)} AS {p}{c}" for p in hold for c in MEASURES)
    carry = lambda p, keep, take: ", ".join(f"CASE WHEN ends AND u_text = '' THEN NULL WHEN u_text = '' THEN {p}{c} WHEN joins AND NOT {take} THEN {p}{c} ELSE c_{c} END AS {p}{c}" for c in MEASURES)
    state = lambda col, take: f"CASE WHEN ends AND u_text = '' THEN NULL WHEN u_text = '' THEN {col} WHEN joins AND NOT {take} THEN {col} ELSE u_text END AS {col}"
    score = lambda t: f"length({t}) + 2 * {ALNUM.format(t)} + 3 * (length({t}) - length(regexp_replace({t}, '[{CJK}]', '', 'g'))) - 2 * {SPECIAL.format(t)}"
    emits = f"ends AND NOT ({brief} AND length(best) < 3)"
    better = "CASE WHEN hl = 0 OR c_l = 0 THEN hl = 0 ELSE c_l > hl + 3 OR c_ra > hra + 0.05::DOUBLE OR (abs(c_l - hl) <= 2 AND c_sp < hsp) END"
    near = f"greatest({alike('hnt', 'c_nt', 'held', 'u_text')}, {alike('bnt', 'c_nt', 'best', 'u_text')}) >= 0.55::DOUBLE"
    return f"""{RUNS}, {name}_u AS (SELECT *, {measures()}, row_number() OVER (PARTITION BY video_id ORDER BY first_ms) AS k FROM runs),
    {name}_r AS (SELECT video_id, k, {opened}, {measured}, CAST(first_ms AS BIGINT) AS start, CAST(last_ms AS BIGINT) AS last, CAST(CASE WHEN text = '' THEN n ELSE 0 END AS BIGINT) AS empty, {new} FROM {name}_u WHERE k = 1 UNION ALL
      SELECT video_id, k, {state('held', 'better')}, {state('best', 'scores')}, {carry('h', 'held', 'better')}, {carry('b', 'best', 'scores')},
        CASE WHEN u_text = '' OR joins THEN start ELSE u_first END, CASE WHEN u_text = '' THEN last ELSE u_last END, CASE WHEN u_text = '' THEN empty + u_n ELSE 0 END,
        CASE WHEN {emits} THEN start END, CASE WHEN {emits} THEN CASE WHEN u_text = '' THEN {closed('0')} ELSE {closed('500')} END END, CASE WHEN {emits} THEN best END
      FROM (SELECT *, held IS NOT NULL AND ((u_text = '' AND empty + u_n >= 4) OR (u_text <> '' AND NOT joins)) AS ends FROM (
        SELECT *, coalesce(held IS NOT NULL AND u_text <> '' AND {near} AND u_first - last <= 1000, false) AS joins, coalesce({better}, true) AS better, coalesce({score('u_text')} > {score('best')}, true) AS scores FROM (
          SELECT u.video_id, u.k, r.* EXCLUDE (video_id, k), u.text AS u_text, u.first_ms AS u_first, u.last_ms AS u_last, u.n AS u_n, {', '.join(f'u.{c} AS c_{c}' for c in MEASURES)} FROM {name}_r r JOIN {name}_u u ON u.video_id = r.video_id AND u.k = r.k + 1)))),
    {name}_o AS (SELECT video_id, k, out_start AS start_ms, out_end AS end_ms, out_text AS text FROM {name}_r WHERE out_text IS NOT NULL UNION ALL
      SELECT video_id, k + 1, start, {closed('500')}, best FROM (SELECT *, max(k) OVER (PARTITION BY video_id) AS m FROM {name}_r) WHERE k = m AND held IS NOT NULL AND NOT ({brief} AND length(best) < 2)),
    {name} AS (SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY k) AS INTEGER) AS idx, CAST(start_ms AS BIGINT) AS start_ms, CAST(end_ms AS BIGINT) AS end_ms, text FROM {name}_o)"""


HAS_CJK = f"regexp_matches(text, '[{CJK}]')"
ONE_CHAR = "(length({0}) > 2 AND len(list_distinct(string_split({0}, ''))) <= 1)"
NO_NOISE = f"length(text) >= 2 AND {ratio('text')} >= CASE WHEN {HAS_CJK} THEN 0.15 ELSE 0.20 END AND NOT (end_ms - start_ms < 80 AND length(text) < 3) AND NOT {ONE_CHAR.format("replace(text, ' ', '')")}"
FULL = f"({ALNUM.format('text')} >= CASE WHEN {HAS_CJK} THEN 1 ELSE 2 END AND NOT {ONE_CHAR.format("replace(replace(text, ' ', ''), chr(10), '')")})"
VALID = f"regexp_matches(text, '\\S') AND end_ms - start_ms >= 80 AND CASE WHEN length({TRIM.format('text')}) < 2 THEN regexp_matches({TRIM.format('text')}, '^[{CJK}]$') ELSE {FULL} END"
LINED = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {TRIM.format('x')}), lambda x: x <> '')"
LONE = r"regexp_matches(y, '^[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\s]$')"
_KEPT = f"array_to_string(list_filter(string_split(x, ' '), lambda y: y <> '' AND NOT {LONE}), ' ')"
CLEAN_OCR = f"coalesce(array_to_string(list_filter(list_transform(string_split(translate(text, '_|', ' '), chr(10)), lambda x: {TRIM.format(_KEPT)}), lambda x: x <> ''), chr(10)), '')"
DEDUP = f"coalesce(array_to_string(list_filter({LINED}, lambda x, i: list_position({LINED}, x) = i), chr(10)), '')"
FLOOR = "greatest(end_ms, start_ms + 250)"
CUT = f"CASE WHEN ({FLOOR} + n) // 2 - start_ms >= 250 THEN ({FLOOR} + n) // 2 - 10 ELSE n - 10 END"
TIMELINE = f"CASE WHEN {FLOOR} > n THEN CASE WHEN {CUT} <= start_ms THEN start_ms + 250 ELSE {CUT} END ELSE {FLOOR} END"
FIX = "CASE WHEN end_ms > n THEN CASE WHEN n - 30 <= start_ms THEN start_ms + 100 ELSE n - 30 END ELSE end_ms END"
ORDER = "(PARTITION BY video_id ORDER BY start_ms, idx)"


def fix_timeline(name: str, source: str) -> str:
    return f"{name} AS (SELECT video_id, CAST(row_number() OVER {ORDER} AS INTEGER) AS idx, start_ms, CAST({TIMELINE} AS BIGINT) AS end_ms, text FROM (SELECT *, lead(start_ms) OVER {ORDER} AS n FROM {source}))"


def split_long(name: str, source: str) -> str:
    return f"""{name}_l AS (SELECT *, {LINED} AS l, len({LINED}) AS n FROM {source}),
    {name}_p AS (SELECT *, unnest(CASE WHEN n > 2 THEN range(0, n, 2) ELSE [-1] END) AS p FROM {name}_l),
    {name} AS (SELECT video_id, idx, CAST(CASE WHEN p >= 0 THEN start_ms + p * ((end_ms - start_ms) // n) ELSE start_ms END AS BIGINT) AS start_ms,
      CAST(CASE WHEN p >= 0 THEN least(start_ms + least(p + 2, n) * ((end_ms - start_ms) // n), end_ms) ELSE end_ms END AS BIGINT) AS end_ms,
      CASE WHEN p >= 0 THEN array_to_string(l[p + 1 : p + 2], chr(10)) ELSE text END AS text FROM {name}_p)"""


def clean(name: str, source: str) -> str:
    by_list = "(PARTITION BY video_id ORDER BY idx)"
    over = "CASE WHEN end_ms > n THEN CASE WHEN n - 30 - start_ms < 100 THEN start_ms + 100 ELSE n - 30 END ELSE end_ms END"
    return f"""{name}_a AS (SELECT video_id, idx, start_ms, end_ms, {CLEAN_OCR} AS text FROM {source}), {name}_b AS (SELECT video_id, idx, start_ms, end_ms, {DEDUP} AS text FROM {name}_a),
    {merge_short(f'{name}_m', f'{name}_b')}, {split_long(f'{name}_x', f'{name}_m')},
    {name}_n AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY idx, start_ms) AS idx, start_ms, end_ms, text FROM {name}_x),
    {name}_v AS (SELECT *, lead(start_ms) OVER {by_list} AS n FROM {name}_n WHERE {VALID}),
    {name} AS (SELECT video_id, CAST(row_number() OVER {by_list} AS INTEGER) AS idx, start_ms, CAST({over} AS BIGINT) AS end_ms, text FROM {name}_v)"""


def auto_fix(name: str, source: str) -> str:
    return f"""{name}_s AS (SELECT video_id, idx, start_ms, least(greatest(end_ms, start_ms + 300), start_ms + 10000) AS end_ms, text, lead(start_ms) OVER {ORDER} AS n FROM {source}),
    {name}_t AS (SELECT * REPLACE ({FIX} AS end_ms) FROM {name}_s),
    {name} AS (SELECT video_id, idx, start_ms, CAST(CASE WHEN n - end_ms > 2000 THEN least(end_ms + 3000, n - 50) ELSE end_ms END AS BIGINT) AS end_ms, text FROM {name}_t)"""


def time_statistics(source: str) -> str:
    return f"SELECT video_id, count(*) AS total, CAST(trunc(avg(end_ms - start_ms)) AS BIGINT) AS avg_duration, min(end_ms - start_ms) AS min_duration, max(end_ms - start_ms) AS max_duration, CAST(coalesce(trunc(avg(g)), 0) AS BIGINT) AS avg_gap, coalesce(min(g), 0) AS min_gap, coalesce(max(g), 0) AS max_gap, count(*) FILTER (g < 0) AS overlaps FROM (SELECT *, lead(start_ms) OVER {ORDER} - end_ms AS g FROM {source}) GROUP BY video_id"


def detect(name: str) -> str:
    return f"{raw_spans('spans')}, {near_duplicates('m1', 'spans')}, {continuations('m2', 'm1')}, {gapped('m3', 'm2')}, {adjacent('m4', 'm3')}, m5 AS (SELECT * FROM m4 WHERE {NO_NOISE}), {fix_timeline(name, 'm5')}"


def queries() -> dict[str, str]:
    over_subs = lambda make: f"WITH RECURSIVE {SUBS_SQL}, {make('out_', 'subs')} SELECT * FROM out_"
    out = {name: over_subs(make) for name, make in (("merge_short", merge_short), ("merge_near_duplicates", near_duplicates), ("merge_continuations", continuations), ("merge_gapped", gapped), ("merge_adjacent", adjacent), ("clean_subtitles", clean))}
    return out | {
        "raw_spans": f"WITH RECURSIVE {raw_spans('spans')} SELECT * FROM spans",
        "detect_subtitles": f"WITH RECURSIVE {detect('out_')} SELECT * FROM out_",
        "detect_clean_fix": f"WITH RECURSIVE {detect('found')}, {clean('neat', 'found')}, {auto_fix('fixed', 'neat')} {time_statistics('fixed')}",
    }
