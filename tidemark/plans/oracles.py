"""The queries' SQL for DuckDB, put together from named common table expressions."""

from __future__ import annotations

from tidemark.config import DEFAULTS
from tidemark.functions import parse

_C: dict[str, tuple[tuple[str, ...], str]] = {}


def _cte(name: str, needs: str, sql: str) -> None:
    _C[name] = tuple(needs.split()), sql


def _sql(final: str, needs: str, **instead: str) -> str:
    """final after all expressions that it needs, in their order; some of them may be given instead."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for n in _C[name][0]:
                add(n)
            order.append(name)

    for n in needs.split():
        add(n)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({instead.get(n, _C[n][1])})" for n in order) + "\n" + final


# --- text ---


def _flat(raw: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({raw}, '[\n\r]+', ' ', 'g'), ' +', ' ', 'g'))"


def _n(flat: str, pattern: str, group: int) -> str:
    return f"try_cast(regexp_extract({flat}, '{pattern}', {group}) AS INT)"


def _year(y: str, pivot: int) -> str:
    return f"CASE WHEN {y} < 100 THEN {y} + CASE WHEN {y} >= {pivot} THEN 1900 ELSE 2000 END ELSE {y} END"


def _parsed(source: str, raw: str, keep: str) -> str:
    """keep, cam_ts and minute of a source's raw text."""
    months = "[" + ", ".join(f"'{m}'" for m in parse.MONTHS) + "]"
    return f"""SELECT {keep}, CASE WHEN dated AND y BETWEEN {DEFAULTS.first_year} AND {DEFAULTS.last_year} THEN try(make_timestamp(y, mo, d, CASE WHEN timed THEN h ELSE 0 END, CASE WHEN timed THEN mi ELSE 0 END, 0)) END AS cam_ts,
  CASE WHEN NOT dated AND timed AND h BETWEEN 0 AND 23 AND mi BETWEEN 0 AND 59 THEN h * 60 + mi END AS minute
FROM (SELECT *, ({_year("y0", DEFAULTS.pivot)}) AS y, num OR word AS dated, mer <> '' AS timed, CASE WHEN mer = 'PM' AND h0 <> 12 THEN h0 + 12 WHEN mer = 'AM' AND h0 = 12 THEN 0 ELSE h0 END AS h FROM (
SELECT *, regexp_matches(f, '{parse.DATE}') AS num, regexp_matches(f, '{parse.WORD_DATE}') AS word,
  CASE WHEN regexp_matches(f, '{parse.DATE}') THEN {_n("f", parse.DATE, 1)} ELSE list_position({months}, upper(regexp_extract(f, '{parse.WORD_DATE}', 1))) END AS mo,
  CASE WHEN regexp_matches(f, '{parse.DATE}') THEN {_n("f", parse.DATE, 2)} ELSE {_n("f", parse.WORD_DATE, 2)} END AS d,
  CASE WHEN regexp_matches(f, '{parse.DATE}') THEN {_n("f", parse.DATE, 3)} ELSE {_n("f", parse.WORD_DATE, 3)} END AS y0,
  {_n("f", parse.TIME, 1)} AS h0, {_n("f", parse.TIME, 2)} AS mi, upper(regexp_extract(f, '{parse.TIME}', 3)) AS mer
FROM (SELECT *, {_flat(raw)} AS f FROM {source})))"""


def _eval_date(raw: str) -> str:
    y = _n(raw, parse.EVAL_DATE, 3)
    return f"try(make_timestamp({_year(y, DEFAULTS.eval_pivot)}, {_n(raw, parse.EVAL_DATE, 1)}, {_n(raw, parse.EVAL_DATE, 2)}, 0, 0, 0))"


def _secs(a: str, b: str) -> str:
    return f"date_diff('second', {a}, {b})"


# --- the driver's tables as clock streams ---

_cte("ev", "", "SELECT CAST(user_id // 30 AS VARCHAR) AS tape_id, event_type, ts, row_number() OVER (PARTITION BY user_id // 30 ORDER BY ts, event_id) AS rn FROM events")
_cte("ev1", "ev", "SELECT *, year(ts) - 34 AS y, month(ts) AS mo, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, CASE WHEN rn % 53 = 0 THEN 'hour' WHEN rn % 97 = 0 THEN 'island' WHEN rn % 89 IN (0, 1) THEN 'digit' WHEN rn % 83 IN (0, 1) THEN 'month' WHEN rn % 79 IN (0, 1) THEN 'year' ELSE '' END AS rule FROM ev")
_cte("ev2", "ev1", "SELECT tape_id, rn, event_type, mi, CASE rule WHEN 'hour' THEN (h + 11) % 24 ELSE h END AS h, CASE rule WHEN 'island' THEN y + 9 WHEN 'year' THEN y + 1 ELSE y END AS y, CASE WHEN rule = 'digit' AND d >= 10 THEN d % 10 ELSE d END AS d, CASE WHEN rule = 'month' AND mo = 1 THEN 5 ELSE mo END AS mo FROM ev1")
_cte("smp0", "ev2", "SELECT tape_id, rn, CAST(rn * 10.0 AS DOUBLE) AS video_t, event_type, CASE WHEN event_type <> 'error' THEN (CASE WHEN h % 12 = 0 THEN 12 ELSE h % 12 END) || ':' || lpad(CAST(mi AS VARCHAR), 2, '0') || CASE WHEN h >= 12 THEN ' PM' ELSE ' AM' END || CASE WHEN event_type = 'signup' THEN '' ELSE ' ' || mo || '/ ' || d || '/' || lpad(CAST(y - 1900 AS VARCHAR), 2, '0') END END AS raw FROM ev2")
_cte("smp", "smp0", "SELECT * FROM smp0")
_cte("tapes", "ev", "SELECT tape_id, CAST(max(rn) * 10.0 + 10.0 AS DOUBLE) AS duration_s, CAST(CAST(tape_id AS INT) * 40 + 160 AS INT) AS width, CAST(CAST(tape_id AS INT) * 30 + 40 AS INT) AS height FROM ev GROUP BY tape_id")
_cte("vis", "ev", "SELECT tape_id, CAST(rn * 10.0 - CASE WHEN event_type = 'click' THEN 2.5 ELSE 4.25 END AS DOUBLE) AS t, CASE WHEN event_type = 'click' THEN 'scene' ELSE 'black' END AS kind FROM ev WHERE event_type IN ('click', 'purchase')")
_cte("pk", "ev", "SELECT tape_id, CAST(rn * 10.0 - 4.5 AS DOUBLE) AS pts, CASE WHEN rn % 3 = 0 THEN 'K_' ELSE '__' END AS flags FROM ev WHERE rn % 31 <> 0")
_FRAMES = """SELECT tape_id, i AS frame_idx, CASE WHEN i % 7 = 0 OR ({first} AND rn % 5 = 0) THEN '' WHEN i % 11 = 0 AND raw IS NOT NULL THEN '9:07 PM 1/ ' || (1 + i % 3) || '/90' ELSE coalesce(raw, '') END AS raw
FROM (SELECT *, CAST((rn - 1) * 3 + k AS INT) AS i FROM smp, unnest([0, 1, 2]) AS g(k)) WHERE {first} OR NOT (CAST(tape_id AS INT) % 4 = 3 AND i = 0)"""
_cte("fr1", "smp", _FRAMES.format(first="true"))
_cte("fr2", "smp", _FRAMES.format(first="false"))
_cte("rd0", "smp0", "SELECT tape_id, CAST(rn * 10 + k AS INT) AS t, CASE WHEN (rn * 10 + k) % 10 >= 6 THEN '' WHEN (rn * 10 + k) % 13 = 0 THEN coalesce(regexp_replace(regexp_replace(raw, '[AP]M ', '#', 'g'), '/ ', '//', 'g'), '') ELSE coalesce(raw, '') END AS raw FROM smp0, unnest(range(10)) AS g(k)")
_cte("rd", "rd0", "SELECT * FROM rd0")

# --- samples ---

_cte("par", "smp", _parsed("smp", "raw", "tape_id, rn, video_t, raw"))
_cte("fill1", "par", "SELECT *, cam_ts IS NOT NULL AS dated, cam_ts IS NULL AND minute IS NOT NULL AS timed, CASE WHEN cam_ts IS NOT NULL THEN hour(cam_ts) * 60 + minute(cam_ts) ELSE minute END AS od FROM par")
_cte("fill2", "fill1", f"SELECT *, CAST(coalesce(timed AND od < lag(od IGNORE NULLS) OVER w - {DEFAULTS.wrap_minutes}, false) AS INT) AS wrap, count(CASE WHEN dated THEN 1 END) OVER (w ROWS UNBOUNDED PRECEDING) AS seg, first_value(cam_ts IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fst FROM fill1 WINDOW w AS (PARTITION BY tape_id ORDER BY video_t)")
_cte("fill3", "fill2", "SELECT *, coalesce(max(cam_ts) OVER (PARTITION BY tape_id, seg), fst) AS anchor, sum(wrap) OVER (PARTITION BY tape_id, seg ORDER BY video_t ROWS UNBOUNDED PRECEDING) AS wraps FROM fill2")
_cte("s0", "fill3", "SELECT tape_id, video_t, CASE WHEN timed THEN CAST(CAST(anchor AS DATE) + CAST(wraps AS INT) AS TIMESTAMP) + to_minutes(minute) ELSE cam_ts END AS cam_ts FROM fill3")

# --- cleaning ---


def _runs(source: str) -> str:
    """Dated rows of a source with the number of their run of one date."""
    return f"SELECT *, sum(CASE WHEN pd IS NOT NULL AND d <> pd THEN 1 ELSE 0 END) OVER (PARTITION BY tape_id ORDER BY video_t ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CAST(cam_ts AS DATE) AS d, lag(CAST(cam_ts AS DATE)) OVER (PARTITION BY tape_id ORDER BY video_t) AS pd FROM {source} WHERE cam_ts IS NOT NULL)"


def _drop_runs(name: str, source: str, rule: str) -> None:
    _cte(f"{name}_r", source, _runs(source))
    _cte(f"{name}_g", f"{name}_r", f"SELECT tape_id, run, min(d) AS d FROM {name}_r GROUP BY tape_id, run")
    _cte(f"{name}_x", f"{name}_g", f"SELECT tape_id, run FROM (SELECT *, lag(d) OVER w AS l, lead(d) OVER w AS r FROM {name}_g WINDOW w AS (PARTITION BY tape_id ORDER BY run)) WHERE l = r AND {rule}")
    _cte(name, f"{name}_r {name}_x", f"SELECT tape_id, video_t, cam_ts FROM {source} s WHERE NOT EXISTS (SELECT 1 FROM {name}_r a JOIN {name}_x b USING (tape_id, run) WHERE a.tape_id = s.tape_id AND a.video_t = s.video_t)")


_cte("s1_n", "s0", "SELECT *, lag(d) OVER w AS p, lead(d) OVER w AS n FROM (SELECT tape_id, video_t, CAST(cam_ts AS DATE) AS d FROM s0 WHERE cam_ts IS NOT NULL) WINDOW w AS (PARTITION BY tape_id ORDER BY video_t)")
_cte("s1", "s0 s1_n", "SELECT * FROM s0 WHERE (tape_id, video_t) NOT IN (SELECT (tape_id, video_t) FROM s1_n WHERE d <> p AND d <> n)")
_cte("y_r", "s1", _runs("s1"))
_cte("y_g", "y_r", "SELECT tape_id, run AS i, min(d) AS d FROM y_r GROUP BY tape_id, run")
_cte("y_m", "y_g", "SELECT *, sum(CASE WHEN pm IS NOT NULL AND month(d) <> pm THEN 1 ELSE 0 END) OVER (PARTITION BY tape_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS ms FROM (SELECT *, lag(month(d)) OVER (PARTITION BY tape_id ORDER BY i) AS pm FROM y_g)")
_cte("y_x", "y_m", "SELECT tape_id, i, coalesce(lead(i) OVER (PARTITION BY tape_id, ms, year(d) ORDER BY i), i + 1) AS nx, count(*) OVER (PARTITION BY tape_id) AS n FROM y_m")
_cte("y_w", "y_x", "SELECT tape_id, i, nx FROM y_x WHERE i = 0 AND n >= 3 UNION ALL SELECT x.tape_id, x.i, x.nx FROM y_w JOIN y_x x ON x.tape_id = y_w.tape_id AND x.i = y_w.nx")
_cte("s2", "s1 y_r y_w", "SELECT tape_id, video_t, cam_ts FROM s1 s WHERE NOT EXISTS (SELECT 1 FROM y_r a JOIN y_w b ON a.tape_id = b.tape_id AND a.run > b.i AND a.run < b.nx WHERE a.tape_id = s.tape_id AND a.video_t = s.video_t)")
_drop_runs("s3", "s2", "year(d) = year(l) AND month(d) = month(l) AND day(l) >= 10 AND day(d) IN (day(l) % 10, day(l) // 10)")
_drop_runs("s4", "s3", "day(d) = day(l) AND year(d) = year(l) AND (least(month(d), month(l)), greatest(month(d), month(l))) IN ((1, 5), (8, 9))")
_cte("o_n", "s4", "SELECT *, row_number() OVER (PARTITION BY tape_id ORDER BY video_t) AS k, count(*) OVER (PARTITION BY tape_id) AS n FROM s4 WHERE cam_ts IS NOT NULL")
_AGREE = f"abs({_secs('a.cam_ts', 'b.cam_ts')} - (b.video_t - a.video_t)) < {DEFAULTS.most_drift}"
_REACH = DEFAULTS.most_run + 1
_cte("o_near", "o_n", f"SELECT DISTINCT x.tape_id, x.k FROM o_n x JOIN o_n y ON x.tape_id = y.tape_id AND y.k BETWEEN x.k - {_REACH} AND x.k + {_REACH} AND y.k <> x.k WHERE CASE WHEN y.k < x.k THEN {_AGREE.replace('a.', 'y.').replace('b.', 'x.')} ELSE {_AGREE.replace('a.', 'x.').replace('b.', 'y.')} END")
_cte("o_bridge", "o_n", f"SELECT DISTINCT x.tape_id, x.k FROM o_n x JOIN o_n a ON a.tape_id = x.tape_id AND a.k BETWEEN x.k - {_REACH} AND x.k - 1 JOIN o_n b ON b.tape_id = x.tape_id AND b.k BETWEEN x.k + 1 AND x.k + {_REACH} WHERE {_AGREE}")
_cte("flt", "o_n o_near o_bridge", "SELECT tape_id, video_t, cam_ts FROM o_n WHERE k = 1 OR k = n OR (tape_id, k) IN (SELECT (tape_id, k) FROM o_near) OR (tape_id, k) NOT IN (SELECT (tape_id, k) FROM o_bridge)")

# --- segments ---

_cte("b0", "flt", "SELECT *, lag(video_t) OVER w AS prev_t, lag(cam_ts) OVER w AS prev_dt FROM flt WINDOW w AS (PARTITION BY tape_id ORDER BY video_t)")
_cte("b1", "b0", f"SELECT *, {_secs('prev_dt', 'cam_ts')} AS jump FROM b0 WHERE prev_t IS NOT NULL")
_cte("bnd", "b1", f"SELECT tape_id, row_number() OVER (PARTITION BY tape_id ORDER BY video_t) AS boundary_id, video_t, CASE WHEN jump > video_t - prev_t + {DEFAULTS.large_gap} OR jump < {DEFAULTS.backward} THEN 'large_gap' ELSE 'gap' END AS type, prev_dt AS cam_before, cam_ts AS cam_after, jump AS cam_jump_s, prev_t, prev_dt FROM b1 WHERE jump > video_t - prev_t + {DEFAULTS.least_gap} OR jump < {DEFAULTS.backward}")
for _mode, _rule in (("scene", "true"), ("session", "type = 'large_gap'"), ("daily", "CAST(cam_before AS DATE) <> CAST(cam_after AS DATE)")):
    _cte(f"cut_{_mode}", "tapes bnd", f"SELECT tape_id, 0.0::DOUBLE AS cut_t, NULL::BIGINT AS boundary_id FROM tapes UNION ALL SELECT tape_id, video_t, boundary_id FROM bnd WHERE {_rule}")


def _merged(name: str, cuts: str, least: float) -> None:
    """Sorted cuts: the first, then ever the next that stands far enough."""
    _cte(f"{name}_n", cuts, f"SELECT a.tape_id, a.cut_t, a.boundary_id, min(b.cut_t) AS nx FROM {cuts} a LEFT JOIN {cuts} b ON a.tape_id = b.tape_id AND b.cut_t - a.cut_t >= {least} GROUP BY ALL")
    _cte(name, f"{name}_n", f"SELECT * FROM {name}_n WHERE cut_t = 0 UNION ALL SELECT n.* FROM {name} m JOIN {name}_n n ON n.tape_id = m.tape_id AND n.cut_t = m.nx")


_cte("conf0", "flt", "SELECT *, lag(video_t) OVER w AS tp, lag(cam_ts) OVER w AS cp, lead(video_t) OVER w AS tn, lead(cam_ts) OVER w AS cn FROM flt WINDOW w AS (PARTITION BY tape_id ORDER BY video_t)")


def _jumped(ta: str, ca: str, tb: str, cb: str) -> str:
    return f"({_secs(ca, cb)} > {tb} - {ta} + {DEFAULTS.least_gap} OR {_secs(ca, cb)} < {DEFAULTS.backward})"


_cte("conf", "conf0", f"SELECT tape_id, video_t, cam_ts, CASE WHEN tn IS NULL OR NOT {_jumped('video_t', 'cam_ts', 'tn', 'cn')} THEN true WHEN tp IS NULL THEN {_secs('cam_ts', 'cn')} >= {DEFAULTS.backward} ELSE NOT ({_jumped('tp', 'cp', 'video_t', 'cam_ts')} AND NOT {_jumped('tp', 'cp', 'tn', 'cn')}) END AS confirmed FROM conf0")


def _clips(name: str, cuts: str, mode: str) -> None:
    form = "%Y-%m-%d" if mode == "daily" else "%Y-%m-%d_%H%M"
    _cte(f"{name}_b", f"{cuts} tapes", f"SELECT c.tape_id, row_number() OVER w AS clip_no, cut_t AS start_t, lead(cut_t) OVER w AS exact_end, boundary_id, duration_s FROM {cuts} c JOIN tapes USING (tape_id) WINDOW w AS (PARTITION BY c.tape_id ORDER BY cut_t)")
    _cte(f"{name}_l", f"{name}_b conf bnd", f"SELECT c.tape_id, c.clip_no, arg_min(f.cam_ts, f.video_t) FILTER (confirmed AND (b.cam_before IS NULL OR CAST(f.cam_ts AS DATE) <> CAST(b.cam_before AS DATE))) AS sure, arg_min(f.cam_ts, f.video_t) AS other FROM {name}_b c JOIN conf f ON f.tape_id = c.tape_id AND f.video_t >= c.start_t LEFT JOIN bnd b ON b.tape_id = c.tape_id AND b.boundary_id = c.boundary_id GROUP BY ALL")
    label = f"coalesce(strftime(coalesce(sure, other), '{form}'), CASE WHEN length(CAST(CAST(floor(start_t) AS BIGINT) AS VARCHAR)) < 5 THEN lpad(CAST(CAST(floor(start_t) AS BIGINT) AS VARCHAR), 5, '0') ELSE CAST(CAST(floor(start_t) AS BIGINT) AS VARCHAR) END || 's')"
    _cte(name, f"{name}_b {name}_l", f"SELECT tape_id, CAST(clip_no AS INT) AS clip_no, start_t, coalesce(exact_end, duration_s) AS end_t, CASE WHEN clip_no > 1 THEN start_t END AS exact_start, exact_end, boundary_id, {label} AS label FROM {name}_b LEFT JOIN {name}_l USING (tape_id, clip_no)")


_merged("m_scene", "cut_scene", DEFAULTS.min_clip)
_merged("m_session", "cut_session", DEFAULTS.min_clip)
_merged("m_daily", "cut_daily", DEFAULTS.artifact_clip)
for _mode in ("scene", "session", "daily"):
    _clips(f"clips_{_mode}", f"m_{_mode}", _mode)
_clips("clips_raw", "cut_session", "daily")
_NAMED = "SELECT *, format('{{}}_clip{{:02d}}_{{}}.mp4', tape_id, clip_no, label) AS file_name FROM {0}"

# --- vote ---


def _vote(name: str, frames: str) -> None:
    _cte(f"{name}_p", frames, _parsed(f"(SELECT *, frame_idx // 3 AS bucket FROM {frames})", "raw", "tape_id, bucket, frame_idx, raw"))
    _cte(f"{name}_g", f"{name}_p", f"SELECT tape_id, bucket, cam_ts, count(*) AS n, min(frame_idx) AS fst, arg_min(raw, frame_idx) AS raw FROM {name}_p WHERE cam_ts IS NOT NULL GROUP BY ALL")
    _cte(f"{name}_b", f"{name}_g", f"SELECT * FROM {name}_g QUALIFY row_number() OVER (PARTITION BY tape_id, bucket ORDER BY n DESC, fst) = 1")
    _cte(name, f"{name}_p {name}_b", f"SELECT p.tape_id, CAST(p.bucket AS INT) AS bucket, CAST(max(p.frame_idx) * {DEFAULTS.interval} / {DEFAULTS.frames_per_sample} AS DOUBLE) AS video_t, any_value(b.cam_ts) AS cam_ts, coalesce(any_value(b.raw), arg_min(p.raw, p.frame_idx) FILTER (p.cam_ts IS NULL AND p.minute IS NOT NULL)) AS raw, count(*) AS n_frames FROM {name}_p p LEFT JOIN {name}_b b ON b.tape_id = p.tape_id AND b.bucket = p.bucket GROUP BY p.tape_id, p.bucket")


_vote("v1", "fr1")
_vote("v2", "fr2")

# --- garbled text ---

_cte("grb", "par", "SELECT tape_id, video_t, CASE CAST(video_t / 10 AS INT) % 3 WHEN 0 THEN regexp_replace(raw, '/ ', '//', 'g') WHEN 1 THEN regexp_replace(raw, '/', '4/', 'g') ELSE regexp_replace(raw, '\\d+/ ', '', 'g') END AS garbled, lag(cam_ts, 5) OVER w AS old_ts, lead(cam_ts, 5) OVER w AS new_ts FROM par WHERE cam_ts IS NOT NULL WINDOW w AS (PARTITION BY tape_id ORDER BY video_t)".replace("\\\\", "\\"))


def _lenient(text: str, pattern: str, most: int) -> str:
    """Digits before what a lookaround tests; here the tested character is taken, where needed from a doubled slash."""
    found = f"regexp_extract_all({text}, '{pattern}', 1)"
    return f"list_distinct(list_filter(list_transform({found}, lambda s: CASE WHEN CAST(s AS INT) > {most} THEN CAST(right(s, 1) AS INT) ELSE CAST(s AS INT) END), lambda n: n BETWEEN 1 AND {most}))"


def _days(raw: str) -> str:
    return _lenient(raw, r"(\d{1,2})\s*[/.\s\-]\s*[789]\d(?:\D|$)", 31)


def _months(raw: str) -> str:
    return _lenient(f"replace({raw}, '/', '//')", r"(?:^|\D)(\d{1,2})\s*/", 12)


def _class(raw: str, old: str, new: str) -> str:
    hit = lambda of: f"((list_contains({_days(raw)}, day({of})) AND day({old}) <> day({new})) OR (list_contains({_months(raw)}, month({of})) AND month({old}) <> month({new})))"
    return f"CASE WHEN {hit(new)} AND NOT {hit(old)} THEN 'new' WHEN {hit(old)} AND NOT {hit(new)} THEN 'old' ELSE 'noise' END"


# --- refinement ---

_cte("win", "bnd", f"SELECT *, CAST(floor(prev_t) AS INT) + 1 AS lo, CAST(floor(video_t) AS INT) + {DEFAULTS.interval} - 1 AS hi, video_t - prev_t AS span FROM bnd WHERE type = 'large_gap'")
_cte("rdp", "rd", _parsed("rd", "raw", "tape_id, t, raw"))
_cte("rdm", "rd", _parsed("rd", "raw", "tape_id, t, raw"))
_cte("dense", "win rdp", "SELECT w.*, q.t, coalesce(r.raw, '') AS raw, r.cam_ts FROM (SELECT *, CAST(unnest(range(lo, hi + 1)) AS INT) AS t FROM win) q JOIN win w USING (tape_id, boundary_id) LEFT JOIN rdp r ON r.tape_id = q.tape_id AND r.t = q.t")
_cte("side", "dense", f"SELECT *, CASE WHEN cam_ts IS NOT NULL THEN CASE WHEN ({_secs('prev_dt', 'cam_ts')} > t - prev_t + {DEFAULTS.large_gap} OR {_secs('prev_dt', 'cam_ts')} < {DEFAULTS.backward}) AND coalesce(CAST(cam_ts AS DATE) = CAST(cam_after AS DATE), true) THEN 'new' ELSE 'old' END END AS side FROM dense")


def _transition(name: str, own: str) -> None:
    _cte(f"{name}_o", own, f"SELECT tape_id, boundary_id, coalesce(CAST(max(t) FILTER (side = 'old') AS DOUBLE), any_value(prev_t)) AS last_old, count(side) > 0 AS any_ocr FROM {own} GROUP BY ALL")
    _cte(f"{name}_n", f"{own} {name}_o", f"SELECT tape_id, boundary_id, CAST(min(t) AS DOUBLE) AS first_new, arg_min(cam_ts, t) AS new_dt FROM {own} JOIN {name}_o USING (tape_id, boundary_id) WHERE side = 'new' AND t > last_old GROUP BY ALL")
    _cte(name, f"{name}_o {name}_n", f"SELECT * FROM {name}_o LEFT JOIN {name}_n USING (tape_id, boundary_id)")


_transition("tr", "side")
# A dead zone's own readings: the coarse ones, and the dense ones that they ask for.
_cte("sideL", "side", "SELECT *, greatest(2, (hi - lo + 1) // 50) AS st FROM side WHERE span >= 120")
_cte("coarse", "sideL", "SELECT * FROM sideL WHERE (t - lo) % st = 0")
_transition("trC", "coarse")
_cte("spanL", "coarse trC", "SELECT tape_id, boundary_id, any_ocr, first_new, last_old, max(t) AS lastc FROM coarse JOIN trC USING (tape_id, boundary_id) GROUP BY ALL")
_cte("ownL", "sideL spanL", "SELECT s.* EXCLUDE (st) FROM sideL s JOIN spanL c USING (tape_id, boundary_id) WHERE (t - lo) % st = 0 OR CASE WHEN c.first_new IS NOT NULL THEN t BETWEEN floor(c.last_old) AND c.first_new WHEN c.any_ocr THEN t > lastc ELSE false END")
_cte("ownS", "side", "SELECT * FROM side WHERE span < 120")
_cte("own", "ownL ownS", "SELECT * FROM ownL UNION ALL BY NAME SELECT * FROM ownS")
_transition("trO", "own")
_cte("cand", "own trO", f"SELECT tape_id, boundary_id, CAST(min(t) AS DOUBLE) AS garbled FROM own JOIN trO USING (tape_id, boundary_id) WHERE span < 120 AND first_new IS NULL AND t > last_old AND raw <> '' AND ({_class('raw', 'prev_dt', 'cam_after')}) = 'new' GROUP BY ALL")
_cte("up", "win trO cand", "SELECT *, coalesce(first_new, garbled) AS upper, CASE WHEN first_new IS NOT NULL THEN new_dt ELSE cam_after END AS upper_dt FROM win JOIN trO USING (tape_id, boundary_id) LEFT JOIN cand USING (tape_id, boundary_id)")
_cte("cls", "own up", f"SELECT tape_id, boundary_id, t, {_class('own.raw', 'up.prev_dt', 'up.upper_dt')} AS c FROM own JOIN up USING (tape_id, boundary_id) WHERE t > last_old AND t < upper")
_cte("lg", "cls", "SELECT tape_id, boundary_id, max(t) FILTER (c = 'old') AS lg FROM cls GROUP BY ALL")
_cte("gn", "cls lg", "SELECT tape_id, boundary_id, any_value(lg) AS last_garble, CAST(min(t) FILTER (c = 'new' AND (lg IS NULL OR t > lg)) AS DOUBLE) AS garble_new FROM cls JOIN lg USING (tape_id, boundary_id) GROUP BY ALL")
_cte("anc", "up vis", "SELECT tape_id, boundary_id, max(v.t) FILTER (v.t > last_old AND v.t < upper) AS inside, max(v.t) FILTER (v.t >= prev_t AND v.t < video_t) AS before FROM up JOIN vis v USING (tape_id) GROUP BY ALL")
_cte("fin", "up gn anc", """SELECT *, CASE WHEN upper_dt IS NULL OR CAST(upper_dt AS DATE) = CAST(prev_dt AS DATE) THEN greatest(last_old + 1, upper - 1) WHEN garble_new IS NOT NULL THEN garble_new WHEN last_garble IS NOT NULL THEN greatest(last_old + 1, upper - 1) WHEN span < 120 AND inside IS NOT NULL THEN inside ELSE last_old + 1 END AS place,
  CASE WHEN first_new IS NOT NULL THEN 1 WHEN span >= 120 THEN CASE WHEN any_ocr THEN 3 ELSE 6 END WHEN any_ocr AND coalesce(CAST(prev_dt AS DATE) <> CAST(cam_after AS DATE), false) THEN 2 WHEN any_ocr THEN 3 WHEN before IS NOT NULL THEN 4 ELSE 5 END AS way
FROM up LEFT JOIN gn USING (tape_id, boundary_id) LEFT JOIN anc USING (tape_id, boundary_id)""")

# --- evaluator ---

_cte("ed0", "smp", f"SELECT tape_id, video_t, {_eval_date('raw')} AS dt, lead(video_t) OVER (PARTITION BY tape_id ORDER BY video_t) AS nt FROM smp")
_cte("ed", "ed0", "SELECT *, lag(video_t) OVER w AS prev_t, lag(dt) OVER w AS old_dt, lag(nt) OVER w AS none_start FROM ed0 WHERE dt IS NOT NULL WINDOW w AS (PARTITION BY tape_id ORDER BY video_t)")
_cte("zone", "ed", f"SELECT tape_id, CAST(row_number() OVER (PARTITION BY tape_id ORDER BY video_t) AS INT) AS boundary_idx, video_t AS coarse_t, prev_t, none_start, video_t - none_start AS none_span_s, old_dt, dt AS new_dt FROM ed WHERE none_start < video_t AND CAST(old_dt AS DATE) <> CAST(dt AS DATE) AND video_t - none_start < {DEFAULTS.dead_zone}")
_cte("ecl", "clips_daily", f"SELECT tape_id, clip_no, file_name AS name, end_t - start_t AS duration_s, coalesce(sum(end_t - start_t) OVER (PARTITION BY tape_id ORDER BY clip_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS start_t FROM ({_NAMED.format('clips_daily')})")
_cte("erd", "zone rd", f"SELECT tape_id, c + c % 3 AS coarse, t, {_eval_date('raw')} AS dt FROM (SELECT tape_id, CAST(coarse_t AS INT) AS c, CAST(unnest(range(CAST(coarse_t AS INT) - 10, CAST(coarse_t AS INT) + 6)) AS INT) AS t FROM zone) JOIN rd USING (tape_id, t)")
_cte("ekey", "zone erd", f"SELECT z.tape_id, z.coarse_t, arg_min(g.coarse, (abs(g.coarse - z.coarse_t), g.coarse)) AS coarse FROM zone z JOIN (SELECT DISTINCT tape_id, coarse FROM erd) g ON g.tape_id = z.tape_id AND abs(g.coarse - z.coarse_t) <= {DEFAULTS.eval_group_distance} GROUP BY ALL")
_cte("etrue", "zone ekey erd", "SELECT tape_id, coarse_t, CAST(min(r.t) AS DOUBLE) AS true_change FROM zone z JOIN ekey USING (tape_id, coarse_t) JOIN erd r USING (tape_id, coarse) WHERE CAST(r.dt AS DATE) <> CAST(z.old_dt AS DATE) GROUP BY ALL")
_cte("ecut", "zone ecl", f"SELECT z.tape_id, z.coarse_t, arg_min(c.start_t, (abs(c.start_t - z.coarse_t), c.clip_no)) AS pipeline_cut FROM zone z JOIN ecl c ON c.tape_id = z.tape_id AND contains(c.name, strftime(z.new_dt, '%Y-%m-%d')) AND abs(c.start_t - z.coarse_t) < {DEFAULTS.eval_cut_distance} GROUP BY ALL")
_cte("eres", "zone etrue ecut", "SELECT tape_id, boundary_idx, coarse_t, none_span_s, old_dt, new_dt, true_change, pipeline_cut, abs(pipeline_cut - true_change) AS placement_error_s, abs(coarse_t - true_change) AS coarse_error_s FROM zone JOIN etrue USING (tape_id, coarse_t) LEFT JOIN ecut USING (tape_id, coarse_t)")

# --- bisection: a zone's state, halved until it is narrow, then its seconds in order ---

_cte("lab", "rd", f"SELECT tape_id, t, coalesce(CAST(CAST({_eval_date('raw')} AS DATE) AS VARCHAR), CASE WHEN raw = '' THEN 'NONE' ELSE 'NOISE' END) AS label FROM rd")
_NEW = "coalesce(label NOT IN ('NOISE', 'NONE') AND label <> old, false)"
_cte("bis", "zone lab", f"""SELECT tape_id, coarse_t, greatest(0.0, coarse_t - 60)::DOUBLE AS lo, (coarse_t + 5)::DOUBLE AS hi, CAST(CAST(old_dt AS DATE) AS VARCHAR) AS old, 0::BIGINT AS calls FROM zone UNION ALL
SELECT b.tape_id, coarse_t, CASE WHEN {_NEW} THEN lo ELSE (lo + hi) / 2 END, CASE WHEN {_NEW} THEN (lo + hi) / 2 ELSE hi END, old, calls + CASE WHEN label IS NULL THEN 0 ELSE 1 END FROM bis b LEFT JOIN lab l ON l.tape_id = b.tape_id AND l.t = floor((lo + hi) / 2) WHERE hi - lo > 2""")
_cte("sweep", "bis lab", f"SELECT q.*, label, {_NEW} AS is_new FROM (SELECT *, lo + unnest(range(CAST(floor(hi - lo) AS BIGINT) + 2)) AS t FROM bis WHERE hi - lo <= 2) q LEFT JOIN lab l ON l.tape_id = q.tape_id AND l.t = floor(q.t) WHERE q.t <= hi")
_cte("change", "sweep", "SELECT tape_id, coarse_t, min(t) FILTER (is_new) AS first_new FROM sweep GROUP BY ALL")

# --- clock models ---

_EPOCH = "date_diff('second', TIMESTAMP '1970-01-01', {0})"
_cte("sgm", "flt bnd", "SELECT f.tape_id, f.video_t, f.cam_ts, coalesce(max(b.boundary_id), 0)::BIGINT AS segment FROM flt f LEFT JOIN bnd b ON b.tape_id = f.tape_id AND b.type = 'large_gap' AND b.video_t <= f.video_t GROUP BY ALL")
_cte("sg1", "sgm", f"SELECT tape_id, segment, min(video_t) AS t0, arg_min({_EPOCH.format('cam_ts')}, video_t) AS c0 FROM sgm GROUP BY ALL")
_cte("sg2", "sgm sg1", f"SELECT tape_id, segment, t0, c0, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM (SELECT *, video_t - t0 AS x, CAST({_EPOCH.format('cam_ts')} - c0 AS DOUBLE) AS y FROM sgm JOIN sg1 USING (tape_id, segment)) GROUP BY ALL")
_cte("sg3", "sg2", "SELECT *, CASE WHEN n >= 5 AND n * sxx - sx * sx > 0 THEN (n * sxy - sx * sy) / (n * sxx - sx * sx) END AS slope FROM sg2")
_cte("mdl", "sg3", "SELECT tape_id, segment, n, t0, c0, slope, (sy - slope * sx) / n AS intercept FROM sg3")
_cte("gap", "smp sgm", "SELECT s.tape_id, s.video_t, max(b.video_t) AS ba, arg_max(b.segment, b.video_t) AS bs, (SELECT min(a.video_t) FROM sgm a WHERE a.tape_id = s.tape_id AND a.video_t > s.video_t) AS aa, (SELECT arg_min(a.segment, a.video_t) FROM sgm a WHERE a.tape_id = s.tape_id AND a.video_t > s.video_t) AS sa FROM smp s JOIN sgm b ON b.tape_id = s.tape_id AND b.video_t < s.video_t WHERE (s.tape_id, s.video_t) NOT IN (SELECT (tape_id, video_t) FROM sgm) GROUP BY ALL")

# --- streams: the rules that look ahead by a bounded number of readings ---

for _part in ("o_n", "o_near", "o_bridge", "flt", "b0", "b1", "bnd"):
    _needs, _text = _C[_part]
    for _other in ("o_bridge", "o_near", "o_n", "flt", "bnd", "b0", "b1"):
        _text = _text.replace(f"FROM {_other} ", f"FROM st_{_other} ").replace(f"FROM {_other})", f"FROM st_{_other})").replace(f"JOIN {_other} ", f"JOIN st_{_other} ")
    _cte(f"st_{_part}", " ".join("s1" if x == "s4" else f"st_{x}" for x in _needs), _text.replace("FROM s4 ", "FROM s1 "))

# --- key frames ---

_KEYS = "SELECT c.tape_id, c.cut_t, {agg}(p.pts) AS k FROM {cuts} c LEFT JOIN pk p ON p.tape_id = c.tape_id AND p.flags LIKE '%K%' AND p.pts {test} GROUP BY ALL"
_cte("kb", "cut_session pk", _KEYS.format(agg="max", cuts="cut_session", test=f"BETWEEN c.cut_t - {DEFAULTS.look_back} AND c.cut_t"))
_cte("ka", "cut_session pk", _KEYS.format(agg="min", cuts="cut_session", test=f"BETWEEN c.cut_t AND c.cut_t + {DEFAULTS.look_ahead}"))
_cte("seg", "clips_raw kb ka", f"""SELECT c.*, coalesce(a.k, exact_start) AS ka, CASE WHEN exact_end IS NOT NULL THEN greatest(b.k, 0.0, exact_end - {DEFAULTS.look_back}) END AS kb, clip_no % 5 <> 0 AS lead_video
FROM clips_raw c LEFT JOIN ka a ON a.tape_id = c.tape_id AND a.cut_t = c.exact_start LEFT JOIN kb b ON b.tape_id = c.tape_id AND b.cut_t = c.exact_end""")
_cte("seg3", "seg", f"""SELECT tape_id, clip_no, 0 AS seg_no, 'lead' AS seg_kind, exact_start AS seg_start, ka AS seg_end, 'encode' AS action FROM seg WHERE ka - exact_start >= {DEFAULTS.least_segment} AND lead_video
UNION ALL SELECT tape_id, clip_no, 1, 'body', coalesce(ka, start_t), coalesce(kb, end_t), 'copy' FROM seg WHERE coalesce(kb, end_t) > coalesce(ka, start_t)
UNION ALL SELECT tape_id, clip_no, 2, 'trail', kb, exact_end, 'encode' FROM seg WHERE exact_end - kb >= {DEFAULTS.least_segment}""")
_cte("snp", "bnd vis", f"""SELECT b.tape_id, b.boundary_id, b.video_t AS cut_t, b.prev_t, max(v.t) FILTER (v.t <= b.video_t) AS be, min(v.t) FILTER (v.t > b.video_t) AS af FROM bnd b LEFT JOIN (SELECT tape_id, CASE WHEN kind = 'black' THEN t + 4.0 ELSE t END AS t FROM vis) v ON v.tape_id = b.tape_id GROUP BY ALL""")
_LOW = "greatest(greatest(0.0, cut_t - 20), cut_t - {0}, prev_t)"
_cte("snp2", "snp", f"SELECT *, CASE WHEN be >= {_LOW.format(3.0)} AND af <= cut_t + 2.0 AND af - be <= 6.0 THEN af WHEN be >= {_LOW.format(0.5)} THEN be END AS dest FROM snp")

_REFINED = "SELECT tape_id, boundary_id, CASE way WHEN 1 THEN place WHEN 2 THEN CASE WHEN upper IS NOT NULL THEN place ELSE last_old + 1 END WHEN 4 THEN before ELSE video_t END AS cut_t, CASE way WHEN 1 THEN 'ocr' WHEN 2 THEN 'ocr' WHEN 4 THEN 'visual' ELSE 'coarse' END AS method, CASE way WHEN 1 THEN '' WHEN 2 THEN 'garbled-boundary' WHEN 3 THEN 'all-old-in-window' WHEN 4 THEN '' WHEN 5 THEN 'SDZ ' || CAST(span AS INT) || 's no-anchor' ELSE 'LDZ ' || CAST(span AS INT) || 's' END AS detail FROM fin"

SQL: dict[str, str] = {
    "src_tapes": _sql("SELECT * FROM tapes", "tapes"),
    "src_samples": _sql("SELECT tape_id, video_t, raw FROM smp", "smp"),
    "src_sample_cache": _sql("SELECT tape_id, video_t, raw FROM smp", "smp"),
    "src_ocr_program": _sql("SELECT tape_id, frame_idx, raw FROM fr1", "fr1"),
    "store_samples": _sql("SELECT tape_id, video_t, raw FROM smp", "smp"),
    "sink_clips": _sql("SELECT tape_id, clip_no, start_t, label FROM clips_daily", "clips_daily"),
    "src_visual_cache": _sql("SELECT * FROM vis", "vis"),
    "visual_log": _sql("SELECT * FROM vis", "vis"),
    "src_packets": _sql("SELECT * FROM pk", "pk"),
    "src_ocr_wire": _sql("SELECT tape_id, format('/t/frame_{:06d}.bmp', frame_idx) AS path, raw || CASE WHEN frame_idx % 19 = 0 THEN chr(9) || 'x' ELSE '' END AS raw FROM fr1 WHERE frame_idx % 17 <> 0", "fr1"),
    "src_clip_files": "SELECT o_orderkey, '/c/' || n AS path, n AS name, CAST(o_orderkey % 100 AS INT) AS clip_no FROM (SELECT o_orderkey, 'a_clip' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') || '_' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || '.mp4' AS n FROM orders WHERE o_orderkey % 5 <> 0)",
    "fn_parse_timestamp": "",
    "fn_parse_time_only": _sql("SELECT tape_id, video_t, CAST(minute AS INT) AS minute FROM par", "par"),
    "fn_parse_date_text": _sql("SELECT tape_id, video_t, dt FROM ed0", "ed0"),
    "fn_frame_index": _sql("SELECT tape_id, format('/t/frame_{:06d}.bmp', frame_idx) AS path, frame_idx, CAST(frame_idx // 3 AS INT) AS bucket FROM fr1", "fr1"),
    "fn_lenient_digits": _sql(f"SELECT tape_id, video_t, garbled, array_to_string(list_sort({_days('garbled')}), ',') AS days, array_to_string(list_sort({_months('garbled')}), ',') AS months FROM grb WHERE old_ts IS NOT NULL AND new_ts IS NOT NULL", "grb"),
    "fn_gap_date_class": _sql(f"SELECT tape_id, video_t, {_class('garbled', 'old_ts', 'new_ts')} AS cls FROM grb WHERE old_ts IS NOT NULL AND new_ts IS NOT NULL", "grb"),
    "fn_drift_jumped": _sql(f"SELECT tape_id, video_t, abs({_secs('pc', 'cam_ts')} - (video_t - pt)) AS drift, {_jumped('pt', 'pc', 'video_t', 'cam_ts')} AS jumped, (least(month(pc), month(cam_ts)), greatest(month(pc), month(cam_ts))) IN ((1, 5), (8, 9)) AS confusable FROM (SELECT *, lag(video_t) OVER w AS pt, lag(cam_ts) OVER w AS pc FROM par WHERE cam_ts IS NOT NULL WINDOW w AS (PARTITION BY tape_id ORDER BY video_t)) WHERE pt IS NOT NULL", "par"),
    "fn_bottom_band": _sql("SELECT tape_id, w || ':' || h || ':' || greatest(0, least(CAST(round_even(width * 40 / 640, 0) AS INT), width - w)) || ':' || (height - h) AS crop FROM (SELECT *, greatest(100, CAST(round_even(width * 560 / 640, 0) AS INT)) AS w, greatest(60, CAST(round_even(height * 130 / 480, 0) AS INT)) AS h FROM tapes)", "tapes"),
    "vote_buckets": _sql("SELECT * FROM v1", "v1"),
    "vote_two_phase": _sql("SELECT a.tape_id, a.bucket, a.video_t, CASE WHEN a.raw IS NULL AND n1 = n2 THEN b.cam_ts ELSE a.cam_ts END AS cam_ts, CASE WHEN a.raw IS NULL AND n1 = n2 THEN b.raw ELSE a.raw END AS raw, a.raw IS NOT NULL AS solved_first FROM v1 a LEFT JOIN v2 b USING (tape_id, bucket) JOIN (SELECT tape_id, sum(n_frames) AS n1 FROM v1 GROUP BY 1) USING (tape_id) LEFT JOIN (SELECT tape_id, sum(n_frames) AS n2 FROM v2 GROUP BY 1) USING (tape_id)", "v1 v2"),
    "fill_time_only": _sql("SELECT * FROM s0", "s0"),
    "sample_counts": _sql("SELECT tape_id, count(*) AS n, count(cam_ts) AS n_dated, CAST(arg_min(cam_ts, video_t) FILTER (cam_ts IS NOT NULL) AS DATE) AS first_date, CAST(arg_max(cam_ts, video_t) FILTER (cam_ts IS NOT NULL) AS DATE) AS last_date FROM s0 GROUP BY tape_id", "s0"),
    "calibration": _sql("SELECT tape_id, count(*) AS n, count(*) FILTER (cam_ts IS NOT NULL OR minute IS NOT NULL) AS hits, count(*) FILTER (cam_ts IS NOT NULL OR minute IS NOT NULL) / greatest(1, count(*)) AS share FROM par WHERE raw IS NOT NULL GROUP BY tape_id", "par"),
    "calibrate": _sql(
        f"""SELECT t.tape_id, CASE WHEN probed THEN crop ELSE '560:130:40:350' END AS crop, CASE WHEN probed THEN coalesce(n, 0) END AS n, CASE WHEN probed THEN coalesce(hits, 0) END AS hits, CASE WHEN probed THEN coalesce(hits / greatest(1, n), 0.0) END AS share, probed
FROM (SELECT *, CAST(tape_id AS INT) % 7 > 1 AS probed, w || ':' || h || ':' || greatest(0, least(CAST(round_even(width * 40 / 640, 0) AS INT), width - w)) || ':' || (height - h) AS crop FROM (SELECT *, greatest(100, CAST(round_even(width * 560 / 640, 0) AS INT)) AS w, greatest(60, CAST(round_even(height * 130 / 480, 0) AS INT)) AS h FROM tapes)) t
LEFT JOIN (SELECT q.tape_id, count(*) AS n, count(*) FILTER (cam_ts IS NOT NULL OR minute IS NOT NULL) AS hits FROM (SELECT tape_id, duration_s / 21 * unnest(range(1, 21)) AS t FROM tapes) q JOIN rdm r ON r.tape_id = q.tape_id AND r.t = floor(q.t) GROUP BY 1) y ON y.tape_id = t.tape_id""",
        "tapes rdm",
    ),
    "calibration_times": _sql("SELECT tape_id, CAST(k AS INT) AS k, duration_s / 21 * k AS t FROM tapes, unnest(range(1, 21)) AS g(k)", "tapes"),
    "drop_date_islands": _sql("SELECT * FROM s1", "s1"),
    "drop_year_runs": _sql("SELECT * FROM s2", "s2"),
    "drop_digit_runs": _sql("SELECT * FROM s3", "s3"),
    "drop_month_runs": _sql("SELECT * FROM s4", "s4"),
    "drop_outliers": _sql("SELECT * FROM flt", "flt"),
    "boundaries": _sql("SELECT * FROM bnd", "bnd"),
    "fuse_boundaries": _sql(f"SELECT tape_id, boundary_id, video_t FROM bnd b WHERE EXISTS (SELECT 1 FROM vis v WHERE v.tape_id = b.tape_id AND v.t BETWEEN b.prev_t - {DEFAULTS.fuse_window} AND b.video_t + {DEFAULTS.fuse_window})", "bnd vis"),
    **{f"group_{m}": _sql(f"SELECT * FROM cut_{m}", f"cut_{m}") for m in ("scene", "session", "daily")},
    "merge_short": _sql("SELECT tape_id, cut_t, boundary_id FROM m_scene", "m_scene"),
    "suppress_orphans": _sql(
        f"""SELECT tape_id, cut_t FROM (SELECT *, row_number() OVER (PARTITION BY tape_id, chain ORDER BY cut_t) AS k, count(*) OVER (PARTITION BY tape_id, chain) AS n FROM (
SELECT *, sum(CASE WHEN link THEN 0 ELSE 1 END) OVER (PARTITION BY tape_id ORDER BY cut_t ROWS UNBOUNDED PRECEDING) AS chain FROM (
SELECT *, coalesce(g AND lag(g) OVER w AND cut_t - lag(cut_t) OVER w < {DEFAULTS.orphan_gap}, false) AS link FROM (SELECT *, CAST(cut_t / 10 AS INT) % 3 <> 0 AS g FROM cut_scene) WINDOW w AS (PARTITION BY tape_id ORDER BY cut_t)))) WHERE k > 2 * (n // 2)""",
        "cut_scene",
    ),
    "reading_confirmed": _sql("SELECT tape_id, video_t, confirmed FROM conf", "conf"),
    **{f"clips_{m}": _sql(_NAMED.format(f"clips_{m}"), f"clips_{m}") for m in ("scene", "session", "daily")},
    "clips_tiled": _sql(_NAMED.format("clips_daily"), "clips_daily"),
    "merge_short_walk": _sql("SELECT tape_id, cut_t, boundary_id FROM m_scene", "m_scene"),
    "same_date_neighbours": _sql("SELECT tape_id, clip_no, label, previous_s, duration_s FROM (SELECT *, end_t - start_t AS duration_s, lag(end_t - start_t) OVER w AS previous_s, lag(label) OVER w AS p FROM clips_raw WINDOW w AS (PARTITION BY tape_id ORDER BY clip_no)) WHERE p = label", "clips_raw"),
    "transitions": _sql("SELECT tape_id, boundary_id, any_ocr, last_old, first_new, new_dt FROM tr", "tr"),
    "refine_session": _sql(_REFINED, "fin"),
    "refine_long": _sql(_REFINED, "fin", smp="SELECT * EXCLUDE (raw), CASE WHEN rn % 211 NOT BETWEEN 60 AND 85 THEN raw END AS raw FROM smp0", rd="SELECT tape_id, t, CASE WHEN t // 2110 % 3 = 0 THEN '' ELSE raw END AS raw FROM rd0"),
    "scene_snap": _sql("SELECT tape_id, boundary_id, cut_t, prev_t, coalesce(dest, cut_t) AS snapped_t, dest - cut_t AS snap_offset FROM snp2", "snp2"),
    "keyframe_before": _sql(f"SELECT tape_id, cut_t, greatest(k, 0.0, cut_t - {DEFAULTS.look_back}) AS key_t FROM kb", "kb"),
    "keyframe_after": _sql("SELECT tape_id, cut_t, coalesce(k, cut_t) AS key_t FROM ka", "ka"),
    "clip_segments": _sql("SELECT * FROM seg3 UNION ALL SELECT tape_id, clip_no, 1, 'whole', start_t, end_t, 'copy' FROM seg WHERE (tape_id, clip_no) NOT IN (SELECT (tape_id, clip_no) FROM seg3)", "seg3"),
    "dead_zones": _sql("SELECT * EXCLUDE (boundary_idx) FROM zone", "zone"),
    "clip_start_times": _sql("SELECT * FROM ecl", "ecl"),
    "eval_results": _sql("SELECT * FROM eres", "eres"),
    "find_true_change": _sql("SELECT tape_id, coarse_t, coalesce(first_new, hi) AS true_change, CAST(b.calls + (SELECT count(label) FROM sweep s WHERE s.tape_id = b.tape_id AND s.coarse_t = b.coarse_t AND s.t <= coalesce(first_new, s.t)) AS BIGINT) AS calls FROM bis b JOIN change USING (tape_id, coarse_t) WHERE hi - lo <= 2", "change"),
    "segment_models": _sql("SELECT * FROM mdl", "mdl"),
    "model_outliers": _sql(f"SELECT s.tape_id, s.segment, s.video_t, s.cam_ts FROM sgm s JOIN mdl m USING (tape_id, segment) WHERE coalesce(abs({_EPOCH.format('cam_ts')} - (c0 + slope * (video_t - t0) + intercept)) <= 300, true)", "mdl"),
    "model_predictions": _sql("SELECT g.tape_id, video_t, bs AS segment, TIMESTAMP '1970-01-01' + to_seconds(CAST(floor(c0 + slope * (video_t - t0) + intercept) AS BIGINT)) AS cam_ts, 'model' AS source FROM gap g JOIN mdl m ON m.tape_id = g.tape_id AND m.segment = g.bs WHERE bs = sa AND aa - ba <= 120 AND slope IS NOT NULL", "gap mdl"),
    "stream_boundaries": _sql("SELECT tape_id, boundary_id, video_t, type, cam_before, cam_after, cam_jump_s, prev_t FROM st_bnd", "st_bnd"),
    "sink_eval_json": _sql(
        "SELECT tape_id, count(*) AS listed, min(boundary_idx) AS first_idx, max(coarse_t) AS last_t, count(*) AS count, median(placement_error_s) AS pipeline_median_error_s, median(coarse_error_s) AS coarse_median_error_s FROM eres GROUP BY tape_id", "eres"
    ),
    "visual_cache_mismatch": _sql("SELECT DISTINCT tape_id, CASE WHEN CAST(tape_id AS INT) % 2 = 1 THEN 'cache_format,scene_threshold' ELSE '' END AS reasons FROM vis", "vis"),
    "src_readings_map": _sql(f"SELECT tape_id, CAST(t // 100 * 100 AS INT) AS coarse, t, {_eval_date('raw')} AS dt FROM rd WHERE raw <> ''", "rd"),
    "eval_summary": _sql("SELECT count(*) AS n, median(placement_error_s) AS median_placement_error_s, max(placement_error_s) AS max_placement_error_s, avg(placement_error_s) AS mean_placement_error_s, median(coarse_error_s) AS median_coarse_error_s, max(coarse_error_s) AS max_coarse_error_s, avg(coarse_error_s) AS mean_coarse_error_s FROM eres", "eres"),
}


def _forms() -> str:
    """Three forms of each reading, parsed each."""
    word = r"regexp_replace(raw, 'M 1/ (\d+)/(\d+)', 'M Jan. \1  \2')"
    odd = r"regexp_replace(regexp_replace(raw, ' ', ' ' || chr(10) || ' ', 'g'), ':(\d\d) ?', ':\1:59 ')"
    parts = [_parsed(f"(SELECT tape_id, video_t, {x} AS raw FROM smp WHERE raw IS NOT NULL)", "raw", "tape_id, video_t") for x in ("raw", word, odd)]
    return _sql(f"SELECT tape_id, video_t, a.cam_ts AS plain, b.cam_ts AS word, c.cam_ts AS odd FROM ({parts[0]}) a JOIN ({parts[1]}) b USING (tape_id, video_t) JOIN ({parts[2]}) c USING (tape_id, video_t)", "smp")


SQL["fn_parse_timestamp"] = _forms()
