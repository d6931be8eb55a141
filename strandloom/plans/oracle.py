"""SQL of the catalog's queries for an independent engine: a library of common table expressions, resolved by name."""

from __future__ import annotations

import re

#: The survivor fold: of each strand and window the haplotypes alive, and whether a run begins there. (Recursive.)
FOLD_STATE = """SELECT sample_idx, win, m1, m2, 1, 1 FROM fold_candidates WHERE win = 1 UNION ALL
 SELECT sample_idx, win, CASE WHEN len(i1) = 0 THEN c1 ELSE i1 END, CASE WHEN len(i2) = 0 THEN c2 ELSE i2 END, CASE WHEN len(i1) = 0 THEN 1 ELSE 0 END, CASE WHEN len(i2) = 0 THEN 1 ELSE 0 END FROM (
  SELECT *, list_intersect(s1, c1) AS i1, list_intersect(s2, c2) AS i2 FROM (
   SELECT r.sample_idx, c.win, s1, s2, CASE WHEN crossed THEN m2 ELSE m1 END AS c1, CASE WHEN crossed THEN m1 ELSE m2 END AS c2 FROM fold_state r JOIN
    (SELECT *, sample_idx AS sid FROM fold_candidates) c ON c.sid = r.sample_idx AND c.win = r.win + 1, LATERAL (SELECT len(list_intersect(s1, m1)) + len(list_intersect(s2, m2)) < len(list_intersect(s1, m2)) + len(list_intersect(s2, m1)) AS crossed)))"""
FOLDED = """SELECT sample_idx, win, last_value(list_min(s1)) OVER (PARTITION BY sample_idx, g1 ORDER BY win ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS hap1, last_value(list_min(s2)) OVER (PARTITION BY sample_idx, g2 ORDER BY win ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS hap2
 FROM (SELECT *, sum(cut1) OVER o AS g1, sum(cut2) OVER o AS g2 FROM fold_state WINDOW o AS (PARTITION BY sample_idx ORDER BY win))"""

#: Break points between neighbouring windows. Joins are written one by one, each with few rows on its left side, for a planner may misjudge the recursive labels.
POINTS = """SELECT sample_idx, win AS "window", CASE WHEN i = k THEN -1 ELSE b1 END AS b1, CASE WHEN j = l THEN -1 ELSE b2 END AS b2 FROM (
 WITH pt0 AS MATERIALIZED (SELECT n.sample_idx, n.win, p.hap1 AS i, p.hap2 AS j, n.hap1 AS k, n.hap2 AS l FROM {labels} n JOIN {before} p ON p.sample_idx = n.sample_idx AND p.win = n.win - 1),
 pt1 AS MATERIALIZED (SELECT q.*, x.variant_idx, x.gt, row_number() OVER (PARTITION BY q.sample_idx, q.win ORDER BY x.variant_idx) AS n FROM pt0 q JOIN wx x ON x.sample_idx = q.sample_idx AND (x.win = q.win - 1 OR x.win = q.win)),
 pt2 AS MATERIALIZED (SELECT q.*, h.allele AS ai FROM pt1 q JOIN hap h ON h.hap_idx = q.i AND h.variant_idx = q.variant_idx),
 pt3 AS MATERIALIZED (SELECT q.*, h.allele AS aj FROM pt2 q JOIN hap h ON h.hap_idx = q.j AND h.variant_idx = q.variant_idx),
 pt4 AS MATERIALIZED (SELECT q.*, h.allele AS ak FROM pt3 q JOIN hap h ON h.hap_idx = q.k AND h.variant_idx = q.variant_idx),
 pt5 AS MATERIALIZED (SELECT q.*, h.allele AS al FROM pt4 q JOIN hap h ON h.hap_idx = q.l AND h.variant_idx = q.variant_idx)
 SELECT *, row_number() OVER (PARTITION BY sample_idx, win ORDER BY err, b1, b2) AS rn FROM (
  SELECT sample_idx, win, i, j, k, l, b1, b2, sum(CASE WHEN gt IS NULL THEN 0 ELSE pow(gt - CASE WHEN n <= b1 THEN ai ELSE ak END - CASE WHEN n <= b2 THEN aj ELSE al END, 2) END) AS err
  FROM pt5 s, range(0, 13) u(b1), range(0, 13) v(b2) GROUP BY ALL)) WHERE rn = 1"""

#: Ranges that bisection may reach, and which of them it ends with.
TREE = "(WITH RECURSIVE r(lo, hi) AS (SELECT 1, 48 UNION ALL SELECT CASE WHEN s = 0 THEN lo ELSE ((lo + hi) >> 1) + 1 END, CASE WHEN s = 0 THEN (lo + hi) >> 1 ELSE hi END FROM r, (VALUES (0), (1)) t(s) WHERE lo < hi) SELECT * FROM r)"
RANGES = """SELECT lo AS x_start, hi AS x_end, n AS n_unique FROM (
 SELECT a.*, (a.n <= {d} OR a.lo = a.hi OR ((a.lo + a.hi) >> 1) - a.lo + 1 <= {minwidth}) AS ok, max(CASE WHEN b.lo IS NOT NULL AND (b.n <= {d} OR ((b.lo + b.hi) >> 1) - b.lo + 1 <= {minwidth}) THEN 1 ELSE 0 END) AS cut FROM
 (SELECT lo, hi, count(DISTINCT bits) AS n FROM (SELECT lo, hi, hap_idx, string_agg(allele, '' ORDER BY variant_idx) AS bits FROM hap JOIN typed USING (variant_idx) JOIN {tree} AS tr ON x_idx BETWEEN lo AND hi GROUP BY 1, 2, 3) GROUP BY 1, 2) a
 LEFT JOIN (SELECT lo, hi, count(DISTINCT bits) AS n FROM (SELECT lo, hi, hap_idx, string_agg(allele, '' ORDER BY variant_idx) AS bits FROM hap JOIN typed USING (variant_idx) JOIN {tree} AS tr ON x_idx BETWEEN lo AND hi GROUP BY 1, 2, 3) GROUP BY 1, 2) b
 ON b.lo <= a.lo AND b.hi >= a.hi AND (b.lo <> a.lo OR b.hi <> a.hi) GROUP BY a.lo, a.hi, a.n) WHERE ok AND cut = 0"""


def unique_windows(d: int, minwidth: int = 0) -> str:
    return RANGES.format(d=d, minwidth=minwidth, tree=TREE)


BISECTION = unique_windows(100)
#: The windows of bisection, in the place of the fixed ones.
BY_BISECTION = f"SELECT row_number() OVER (ORDER BY q.x_start) AS win, q.x_start, q.x_end, CASE WHEN q.x_start = 1 THEN 1 ELSE t.variant_idx END AS h_start, coalesce(lead(t.variant_idx) OVER (ORDER BY q.x_start) - 1, 64) AS h_end FROM ({BISECTION}) q JOIN typed t ON t.x_idx = q.x_start"

UNTYPED = "SELECT v.variant_idx, CASE WHEN t.variant_idx IS NOT NULL THEN t.score ELSE (coalesce(a, b) + coalesce(b, a)) / 2 END AS score, t.variant_idx IS NOT NULL AS typed FROM variants v LEFT JOIN tscore t ON t.variant_idx = v.variant_idx, LATERAL (SELECT arg_max(score, variant_idx) AS a FROM tscore WHERE variant_idx <= v.variant_idx AND score IS NOT NULL), LATERAL (SELECT arg_min(score, variant_idx) AS b FROM tscore WHERE variant_idx >= v.variant_idx AND score IS NOT NULL)"

#: Of each strand and window its label, the one before, the break point between them and both windows' ranges.
STEPS = """SELECT f.sample_idx, f.win, s.strand, CASE WHEN s.strand = 1 THEN f.hap1 ELSE f.hap2 END AS now, CASE WHEN s.strand = 1 THEN e.hap1 ELSE e.hap2 END AS was,
 CASE WHEN s.strand = 1 THEN p.b1 ELSE p.b2 END AS b, w.x_start, w.x_end, pw.x_start AS px FROM phased_labels f JOIN win w ON w.win = f.win JOIN (VALUES (1), (2)) s(strand) ON true
 LEFT JOIN phased_labels e ON e.sample_idx = f.sample_idx AND e.win = f.win - 1 LEFT JOIN win pw ON pw.win = f.win - 1 LEFT JOIN phased_points p ON p.sample_idx = f.sample_idx AND p."window" = f.win"""
#: A pushed segment goes again if the next one doesn't begin behind it.
PUSHED = """SELECT sample_idx, strand, row_number() OVER (PARTITION BY sample_idx, strand ORDER BY ord) AS seg_no, start, win, hap_label FROM (
 SELECT *, lead(start) OVER (PARTITION BY sample_idx, strand ORDER BY ord) AS follows FROM ({pushes})) WHERE follows IS NULL OR follows > start"""
BY_LABEL = "SELECT sample_idx, strand, win AS ord, win, CASE WHEN win = 1 THEN 1 ELSE px + b END AS start, now AS hap_label FROM strand_steps WHERE win = 1 OR (b > -1 AND b < x_end - px + 1)"
BY_WINDOW = """SELECT sample_idx, strand, 2 * win AS ord, CASE WHEN win > 1 AND b >= 0 AND b <> x_end - px + 1 AND px + b < x_start THEN win - 1 ELSE win END AS win,
  CASE WHEN win = 1 THEN 1 WHEN b < 0 OR b = x_end - px + 1 OR px + b >= x_start THEN x_start ELSE px + b END AS start,
  CASE WHEN win = 1 OR b < 0 THEN now WHEN b = x_end - px + 1 OR px + b >= x_start THEN was ELSE now END AS hap_label FROM strand_steps
 UNION ALL SELECT sample_idx, strand, 2 * win + 1 AS ord, win, greatest(px + b, x_start) AS start, now AS hap_label FROM strand_steps WHERE win > 1 AND b >= 0 AND b <> x_end - px + 1"""


def path_sql(windows: int) -> str:
    """The least-error path through the first 1000 pairs of each window, written out window by window: backward costs, then the choices from the first window on."""
    cost = "pow(least(CAST(p.h1 <> q.h1 AS INT) + CAST(p.h2 <> q.h2 AS INT), CAST(p.h1 <> q.h2 AS INT) + CAST(p.h2 <> q.h1 AS INT)), 2)"
    parts = [f"cost{windows} AS MATERIALIZED (SELECT sample_idx, pair_no, h1, h2, 0.0 AS least, 0 AS nxt FROM redundant WHERE win = {windows})"]
    for w in range(windows - 1, 0, -1):
        parts.append(f"cost{w} AS MATERIALIZED (SELECT sample_idx, pair_no, h1, h2, m.e AS least, m.n AS nxt FROM (SELECT p.sample_idx, p.pair_no, p.h1, p.h2, min({{'e': {cost} + q.least, 'n': q.pair_no}}) AS m FROM redundant p JOIN cost{w + 1} q ON q.sample_idx = p.sample_idx WHERE p.win = {w} GROUP BY ALL))")
    parts.append("path1 AS (SELECT sample_idx, h1, h2, nxt, least AS best_err FROM cost1 QUALIFY row_number() OVER (PARTITION BY sample_idx ORDER BY least, pair_no) = 1)")
    for w in range(2, windows + 1):
        parts.append(f"path{w} AS (SELECT c.sample_idx, c.h1, c.h2, c.nxt, p.best_err FROM path{w - 1} p JOIN cost{w} c ON c.sample_idx = p.sample_idx AND c.pair_no = p.nxt)")
    chosen = " UNION ALL ".join(f'SELECT sample_idx, {w} AS "window", h1 AS hap1, h2 AS hap2, best_err FROM path{w}' for w in range(1, windows + 1))
    return f"SELECT * FROM (WITH {', '.join(parts)} {chosen}) d"


CTE = {
    "hap": "SELECT CAST(vec_id + 1 AS BIGINT) AS hap_idx, s AS variant_idx, CASE WHEN embedding[s] > 0 THEN 1 ELSE 0 END AS allele FROM embeddings, range(1, 65) t(s)",
    "pop": "SELECT CAST(vec_id // 2 + 1 AS BIGINT) AS ref_sample, 'P' || label AS population FROM embeddings WHERE vec_id % 2 = 0",
    "variants": "SELECT i AS variant_idx, '1' AS chrom, 1000 + 10 * i AS pos, 'rs' || i AS id, (['A','C','G','T'])[i % 4 + 1] AS ref, (['C','G','T','A'])[i % 4 + 1] AS alt FROM range(1, 65) t(i)",
    "typed": "SELECT variant_idx, pos, chrom, ref, variant_idx - variant_idx // 4 AS x_idx FROM variants WHERE variant_idx % 4 <> 0",
    "win": "SELECT w AS win, (w - 1) * 6 + 1 AS x_start, w * 6 AS x_end, (w - 1) * 8 + 1 AS h_start, w * 8 AS h_end FROM range(1, 9) t(w)",
    "truth": "SELECT t AS sample_idx, s AS strand, v AS variant_idx, h.allele FROM (SELECT unnest(range(1, greatest(10, (max(vec_id) + 1) // 50) + 1)) AS t FROM embeddings) a, range(1, 3) b(s), range(1, 65) c(v), (SELECT max(vec_id) + 1 - 20 AS n FROM embeddings) m, hap h WHERE h.variant_idx = v AND h.hap_idx = (t * 37 + s * 101 + ((v - 1) // 16) * 53) % m.n + 21",
    "dos": "SELECT sample_idx, variant_idx, sum(allele) AS g FROM truth GROUP BY 1, 2",
    "geno": "SELECT sample_idx, variant_idx, CASE WHEN (sample_idx * 13 + variant_idx * 7) % 11 = 0 THEN NULL ELSE g END AS gt FROM dos WHERE variant_idx % 4 <> 0",
    "freq": "SELECT variant_idx, avg(allele) AS alt_freq FROM hap GROUP BY 1",
    "keys_all": "SELECT win, hap_idx, string_agg(allele, '' ORDER BY variant_idx) AS bits FROM hap JOIN win ON variant_idx BETWEEN h_start AND h_end GROUP BY 1, 2",
    "keys_typed": "SELECT win, hap_idx, string_agg(allele, '' ORDER BY variant_idx) AS bits FROM hap JOIN win ON variant_idx BETWEEN h_start AND h_end WHERE variant_idx % 4 <> 0 GROUP BY 1, 2",
    "uni_all": "SELECT *, dense_rank() OVER (PARTITION BY win ORDER BY rep) AS unique_idx FROM (SELECT *, min(hap_idx) OVER (PARTITION BY win, bits) AS rep FROM keys_all)",
    "uni_typed": "SELECT *, dense_rank() OVER (PARTITION BY win ORDER BY rep) AS unique_idx FROM (SELECT *, min(hap_idx) OVER (PARTITION BY win, bits) AS rep FROM keys_typed)",
    "fill": "SELECT *, coalesce(gt, avg(gt) OVER (PARTITION BY variant_idx), 0) AS x FROM geno",
    "wx": "SELECT sample_idx, win, variant_idx, x, gt FROM fill JOIN win ON variant_idx BETWEEN h_start AND h_end",
    "reps": "SELECT win, unique_idx AS u, rep, bits FROM uni_typed WHERE hap_idx = rep",
    "weight": "SELECT variant_idx, CASE WHEN least(alt_freq, 0.85) < 0.15 THEN 1.98 ELSE 1 / sqrt(2 * least(alt_freq, 0.85) * (1 - least(alt_freq, 0.85))) END AS weight FROM freq",
    "arep": "SELECT r.win, r.u, r.rep, v.variant_idx, CAST(substr(r.bits, CAST(v.n AS INT), 1) AS INT) AS a FROM reps r JOIN (SELECT t.variant_idx, w.win, row_number() OVER (PARTITION BY w.win ORDER BY t.variant_idx) AS n FROM typed t JOIN win w ON t.variant_idx BETWEEN h_start AND h_end) v ON v.win = r.win",
    "xn": "SELECT x.sample_idx, x.win, r.u, sum(2 * x.x * r.a) AS n FROM wx x JOIN arep r USING (win, variant_idx) GROUP BY 1, 2, 3",
    "xx": "SELECT sample_idx, win, sum(x * x) AS xx FROM wx GROUP BY 1, 2",
    "gram": "SELECT p.win, p.u AS j, q.u AS k, sum((p.a + q.a) * (p.a + q.a)) AS m FROM arep p JOIN arep q USING (win, variant_idx) GROUP BY 1, 2, 3",
    "cost": "SELECT a.sample_idx, a.win, g.j, g.k, round(g.m - a.n - b.n + xx.xx, 6) AS score FROM gram g JOIN xn a ON a.win = g.win AND a.u = g.j JOIN xn b ON b.win = g.win AND b.u = g.k AND b.sample_idx = a.sample_idx JOIN xx ON xx.sample_idx = a.sample_idx AND xx.win = a.win",
    "first_pair": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_idx, win ORDER BY score, k, j) AS rn FROM cost WHERE j <= k) WHERE rn = 1",
    "best": "SELECT f.sample_idx, f.win, a.rep AS hap1, b.rep AS hap2, f.score FROM first_pair f JOIN reps a ON a.win = f.win AND a.u = f.j JOIN reps b ON b.win = f.win AND b.u = f.k",
    "mem": "SELECT win, rep, list(hap_idx ORDER BY hap_idx) AS members, count(*) AS n_members FROM uni_typed GROUP BY 1, 2",
    "alleles": "SELECT s.sample_idx, s.strand, h.variant_idx, h.allele FROM seg s JOIN hap h ON h.hap_idx = s.hap_label AND h.variant_idx BETWEEN s.start AND s.\"end\"",
    "imp": "SELECT sample_idx, variant_idx, sum(allele) AS g FROM alleles GROUP BY 1, 2",
    "tscore": "SELECT variant_idx, 1 - 0.25 * avg((gt - g) * (gt - g)) AS score FROM geno JOIN imp USING (sample_idx, variant_idx) GROUP BY 1",
    "runs0": "SELECT user_id, event_type, row_number() OVER o AS n, lag(event_type) OVER o AS was FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "runs1": "SELECT *, sum(CASE WHEN was = event_type THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY n) AS seg_no FROM runs0",
    "eseg": "SELECT user_id, seg_no, min(n) AS start, max(n) AS \"end\", min(event_type) AS label FROM runs1 GROUP BY 1, 2",
    "seg": "SELECT *, coalesce(lead(start) OVER (PARTITION BY sample_idx, strand ORDER BY seg_no) - 1, 64) AS \"end\" FROM (SELECT m.sample_idx, m.strand, m.seg_no, CASE WHEN m.seg_no = 1 THEN 1 ELSE t.variant_idx END AS start, m.hap_label FROM mosaic_l m JOIN typed t ON t.x_idx = m.start)",
    "fold_candidates": "SELECT b.sample_idx, b.win, p.members AS m1, q.members AS m2 FROM best b JOIN mem p ON p.win = b.win AND p.rep = b.hap1 JOIN mem q ON q.win = b.win AND q.rep = b.hap2",
    "fold_state": FOLD_STATE,
    "phased_labels": FOLDED,
    "phased_points": POINTS.format(labels="phased_labels", before="phased_labels"),
    "strand_steps": STEPS,
    "mosaic_l": PUSHED.format(pushes=BY_LABEL),
    "mosaic_w": PUSHED.format(pushes=BY_WINDOW),
    "redundant": "SELECT * FROM (SELECT b.sample_idx, b.win, row_number() OVER (PARTITION BY b.sample_idx, b.win ORDER BY h1, h2) AS pair_no, h1, h2 FROM best b, uni_typed p, uni_typed q, LATERAL (SELECT p.hap_idx AS h1, q.hap_idx AS h2) WHERE p.win = b.win AND p.rep = b.hap1 AND q.win = b.win AND q.rep = b.hap2) WHERE pair_no <= 1000",
}
#: Expressions that read themselves, with their columns.
RECURSIVE = {"fold_state": "(sample_idx, win, s1, s2, cut1, cut2)"}
KINDS = {"i": "CAST({0} AS BIGINT)", "f": "round(CAST({0} AS DOUBLE), 6)", "s": "CAST({0} AS VARCHAR)", "b": "CAST({0} AS BOOLEAN)"}


def sql(body: str, columns: str, **instead: str) -> str:
    """body with the expressions it names, its columns cast: "name:kind ..." of kinds i (integer), f (rounded double), s, b. instead: expressions that replace the library's."""
    ordered: list[str] = []
    entered: set[str] = set()
    library = CTE | instead

    def put(text: str) -> None:
        for name in library:
            if name not in entered and re.search(rf"(?<![\w.]){name}(?![\w(])", text):
                entered.add(name)
                put(library[name])
                ordered.append(name)

    put(body)
    with_ = ", ".join(f"{name}{RECURSIVE[name]} AS ({library[name]})" if name in RECURSIVE else f"{name} AS MATERIALIZED ({library[name]})" for name in ordered)
    pairs = [c.split(":") for c in columns.split()]
    out = ", ".join(f'{KINDS[kind].format(chr(34) + name + chr(34))} AS "{name}"' for name, kind in pairs)
    return (f"WITH RECURSIVE {with_} " if with_ else "") + f"SELECT {out} FROM ({body}) AS q"
