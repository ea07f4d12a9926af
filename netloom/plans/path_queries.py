"""Queries over single paths and their groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom import testbed as T
from netloom.functions import similarity as S
from netloom.operators import grouping as Gr
from netloom.operators import paths as P
from netloom.operators import routing as R


def path_steps(spark, sf):
    return P.coded(T.steps(spark, sf)).select("path_id", "seq", "dx", "dy", "dz", F.round("len", 6).alias("len"), "code")


def _features(spark, sf):
    return P.features(T.steps(spark, sf), T.paths(spark, sf))


def path_features(spark, sf):
    f = _features(spark, sf)
    return f.select(
        "path_id", "utility", "size", P.dashed(F.col("arrow")).alias("arrow"), F.size("steps").cast("long").alias("n_steps"), F.round("length", 6).alias("total_length"),
        *(f"{c}_{n}" for c in "xyz" for n in ("min", "max")), *(F.col("range")[c].alias(f"{c}_range") for c in "xyz"), F.round("xy_spread", 6).alias("xy_spread"),
    )


def path_positions(spark, sf):
    return P.points(T.steps(spark, sf), T.paths(spark, sf))


def _runs(spark, sf):
    s = T.steps(spark, sf)
    return P.horizontal_runs(P.points(s, T.paths(spark, sf)), s)


def h_segments(spark, sf):
    return _runs(spark, sf)


def direction_runs(spark, sf):
    return P.collapsed(T.table(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type")


def pattern_freq(spark, sf):
    f = _features(spark, sf).groupBy(P.dashed(F.col("arrow")).alias("pattern")).agg(F.count("*").alias("n"))
    return f.select("pattern", "n")


def levels_traversed(spark, sf):
    pts = P.level_of(P.points(T.steps(spark, sf), T.paths(spark, sf)), T.levels(spark, sf), "z", "r_regionkey")
    out = P.collapsed(pts, "path_id", ["seq"], "level")
    return out.select("path_id", F.col("pattern").alias("levels"), (F.size(F.split("pattern", "-")) - 1).cast("long").alias("level_changes"))


def elevation_bop(spark, sf):
    rows = P.level_of(T.paths(spark, sf), T.levels(spark, sf), "sz", "r_regionkey", "N/A")
    return rows.select("path_id", "level", F.coalesce(F.col("sz") - F.col("z_min"), F.lit(0.0)).alias("bop"))


def pattern_similarity(spark, sf):
    p = Gr.pairs(_features(spark, sf), ["equipment"], lambda a, b: S.pattern(a["arrow"], b["arrow"]))
    return p.select("a", "b", "similarity")


def composite_similarity(spark, sf):
    return Gr.pairs(_features(spark, sf), ["equipment"]).select("a", "b", "similarity")


def composite_similarity_v1(spark, sf):
    return Gr.pairs(_features(spark, sf), ["equipment"], S.composite_v1).select("a", "b", "similarity")


def path_groups(spark, sf):
    found, _ = Gr.groups(_features(spark, sf), ["equipment"])
    return found.select("group_id", "equipment", "component", "path_count", "avg_similarity", "max_start_xy_dist")


def common_z_levels(spark, sf):
    runs = _runs(spark, sf).join(T.paths(spark, sf).select("path_id", "equipment"), "path_id")
    return Gr.common_levels(runs, "equipment")


def group_zones(spark, sf):
    s, p = T.steps(spark, sf), T.paths(spark, sf)
    points = P.points(s, p).join(p.select("path_id", "equipment"), "path_id")
    return Gr.zones(points, Gr.trunks(common_z_levels(spark, sf), "equipment"), "equipment")


def path_groups_v1(spark, sf):
    return Gr.groups_v1(_features(spark, sf), ["equipment"])


def common_z_levels_v1(spark, sf):
    runs = _runs(spark, sf).join(T.paths(spark, sf).select("path_id", "equipment"), "path_id")
    return Gr.common_levels_v1(runs, "equipment")


def group_zones_v1(spark, sf):
    s, p = T.steps(spark, sf), T.paths(spark, sf)
    points = P.points(s, p).join(p.select("path_id", "equipment"), "path_id")
    return Gr.zones_v1(points, Gr.trunks(common_z_levels_v1(spark, sf), "equipment"), "equipment")


def enriched_paths(spark, sf):
    """Patterns, lengths and numbers of directions of each path, angles at the tolerance included."""
    e = R.enrich(T.steps(spark, sf).where("dx * dx + dy * dy + dz * dz >= 1e-6"))
    return e.select("path_id", "direction_raw", "direction_pattern", "total_length", "n_r", "n_h", "n_d")


def tolerance_groups(spark, sf):
    """Suppliers' balances in groups of 2 * 100 from each group's first value, by nation."""
    rows = T.table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.collect_list(F.struct(F.col("s_acctbal").alias("v"), F.col("s_suppkey").alias("id"))).alias("v"))
    out = rows.select("s_nationkey", F.explode(P.anchored_groups(F.col("v"), 200.0)).alias("g"))
    return out.select("s_nationkey", F.col("g.value.id").alias("s_suppkey"), F.col("g.group").alias("group_no"))


def equipment_stats(spark, sf):
    f = _features(spark, sf)
    return f.groupBy("equipment").agg(F.count("*").alias("path_count"), F.round(F.avg(F.size("steps")), 6).alias("mean_steps"))


def utility_stats(spark, sf):
    f = _features(spark, sf)
    return f.groupBy("utility").agg(F.count("*").alias("path_count"), F.round(F.avg("length") / 1000, 6).alias("mean_length_m"))


def direction_ratio(spark, sf):
    c = P.coded(T.steps(spark, sf)).join(T.paths(spark, sf).select("path_id", "utility"), "path_id").where("code is not null")
    return c.groupBy("utility").agg(*(F.round(F.count_if(F.col("code") == k) * 100.0 / F.count("*"), 6).alias(f"pct_{k.lower()}") for k in "RHD"))


def length_hist(spark, sf):
    """Ten bins of equal width between the least and the largest length; the last is closed."""
    f = P.coded(T.steps(spark, sf)).groupBy("path_id").agg(F.round(F.sum("len"), 6).alias("length"))
    f = f.join(T.paths(spark, sf).select("path_id"), "path_id", "left_semi")
    span = f.agg(F.min("length").alias("low"), F.max("length").alias("high"))
    at = F.least(F.floor((F.col("length") - F.col("low")) * 10 / F.greatest(F.col("high") - F.col("low"), F.lit(1e-9))), F.lit(9))
    return f.join(F.broadcast(span)).groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("n"))  # span is one row


def path_summary_stats(spark, sf):
    f = _features(spark, sf)
    return f.agg(
        F.count("*").alias("paths"), F.countDistinct("equipment").alias("equipment"), F.countDistinct("arrow").alias("patterns"),
        *(g("length").alias(f"{n}_length") for n, g in (("min", lambda c: F.round(F.min(c), 6)), ("mean", lambda c: F.round(F.avg(c), 4)), ("max", lambda c: F.round(F.max(c), 6)))),
        F.min(F.size("steps")).cast("long").alias("min_steps"), F.max(F.size("steps")).cast("long").alias("max_steps"),
    )


FEAT_SQL = """
feat AS MATERIALIZED (SELECT p.path_id, p.equipment, p.utility, p.size, p.sx, p.sy, p.sz, s.arrow, s.n, s.length, b.* EXCLUDE (path_id)
  FROM path p JOIN (SELECT path_id, string_agg(code, '' ORDER BY seq) AS arrow, count(*) AS n, sum(len) AS length FROM coded GROUP BY path_id) s ON p.path_id = s.path_id
  JOIN (SELECT path_id, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, min(z) AS z_min, max(z) AS z_max,
        max(x) - min(x) AS rx, max(y) - min(y) AS ry, max(z) - min(z) AS rz FROM pt GROUP BY path_id) b ON b.path_id = p.path_id)
"""
PAIR_SQL = """
pr AS MATERIALIZED (SELECT a.path_id AS a, b.path_id AS b, a.equipment, a.arrow AS aa, b.arrow AS ba, a.n AS an, b.n AS bn, a.length AS al, b.length AS bl,
  a.rx AS arx, b.rx AS brx, a.ry AS ary, b.ry AS bry, a.rz AS arz, b.rz AS brz, sqrt((a.sx-b.sx)*(a.sx-b.sx)+(a.sy-b.sy)*(a.sy-b.sy)) AS far
  FROM feat a JOIN feat b ON a.equipment = b.equipment AND a.path_id < b.path_id),
ps AS MATERIALIZED (SELECT pr.a, pr.b, s.seq, s.dx, s.dy, s.dz, s.len FROM pr JOIN coded s ON s.path_id = pr.a),
vs AS MATERIALIZED (SELECT s.a, s.b, avg(greatest(0, least(1, (s.dx*t.dx+s.dy*t.dy+s.dz*t.dz)/(s.len*t.len)))) AS v, avg((s.dx*t.dx+s.dy*t.dy+s.dz*t.dz)/(s.len*t.len)) AS v1
  FROM ps s JOIN coded t ON t.path_id = s.b AND t.seq = s.seq GROUP BY s.a, s.b),
sm AS (SELECT pr.*, vs.v, vs.v1, 1 - levenshtein(aa, ba) / greatest(length(aa), length(ba))::DOUBLE AS arrow_sim,
  (greatest(0, 1-abs(arx-brx)/greatest(arx,brx,1)) + greatest(0, 1-abs(ary-bry)/greatest(ary,bry,1)) + greatest(0, 1-abs(arz-brz)/greatest(arz,brz,1)))/3 AS range_sim,
  greatest(0, 1-abs(al-bl)/greatest(al,bl,1)) AS length_sim FROM pr JOIN vs ON pr.a = vs.a AND pr.b = vs.b),
sim AS (SELECT *, round(greatest(0, least(1, .25*arrow_sim + .25*v*least(an,bn)/greatest(an,bn) + .15*range_sim + .15*length_sim + .2)), 6) AS similarity FROM sm)
"""
W = "WITH RECURSIVE " + T.STEP_SQL
RUN_SQL = """
fl AS (SELECT pt.*, coalesce(c.code = 'H', false) AS flat FROM pt LEFT JOIN coded c ON c.path_id = pt.path_id AND c.seq = pt.seq),
isl AS (SELECT *, sum(CASE WHEN flat THEN 0 ELSE 1 END) OVER (PARTITION BY path_id ORDER BY seq) AS island FROM fl),
run0 AS (SELECT path_id, island, avg(z) AS mz, avg(x) AS mx, avg(y) AS my, count(*) AS node_count FROM isl GROUP BY path_id, island HAVING count(*) FILTER (WHERE flat) > 0),
run AS (SELECT path_id, CAST(row_number() OVER (PARTITION BY path_id ORDER BY island) AS INT) AS run_no, round(mz, 3) AS mean_z, round(mx, 3) AS mean_x, round(my, 3) AS mean_y, node_count FROM run0)
"""
ZLEVEL_SQL = """
zs AS (SELECT p.equipment, r.*, row_number() OVER (PARTITION BY p.equipment ORDER BY mean_z, r.path_id, run_no) AS i FROM run r JOIN path p ON p.path_id = r.path_id),
fold AS (SELECT equipment, i, mean_z AS total, 1 AS n, 0 AS c FROM zs WHERE i = 1
  UNION ALL SELECT z.equipment, z.i, CASE WHEN abs(z.mean_z - f.total / f.n) <= 200 THEN f.total + z.mean_z ELSE z.mean_z END,
    CASE WHEN abs(z.mean_z - f.total / f.n) <= 200 THEN f.n + 1 ELSE 1 END, CASE WHEN abs(z.mean_z - f.total / f.n) <= 200 THEN f.c ELSE f.c + 1 END
  FROM fold f JOIN zs z ON z.equipment = f.equipment AND z.i = f.i + 1),
zc AS (SELECT zs.*, fold.c FROM zs JOIN fold ON zs.equipment = fold.equipment AND zs.i = fold.i),
zl AS (SELECT equipment, c, round(avg(mean_z), 3) AS mean_z, count(DISTINCT path_id) AS path_count FROM zc GROUP BY equipment, c HAVING count(DISTINCT path_id) >= 2),
zd AS (SELECT a.equipment, a.c, round(max(sqrt((a.mean_x-b.mean_x)*(a.mean_x-b.mean_x)+(a.mean_y-b.mean_y)*(a.mean_y-b.mean_y))), 3) AS xy_spread
  FROM zc a JOIN zc b ON a.equipment = b.equipment AND a.c = b.c GROUP BY a.equipment, a.c),
level AS (SELECT zl.equipment, mean_z, path_count, xy_spread, CAST(row_number() OVER (PARTITION BY zl.equipment ORDER BY zl.c) AS INT) AS level_no FROM zl JOIN zd ON zl.equipment = zd.equipment AND zl.c = zd.c)
"""
ZLEVEL1_SQL = """
zs AS (SELECT p.equipment, r.*, row_number() OVER (PARTITION BY p.equipment ORDER BY mean_z, r.path_id, run_no) AS i FROM run r JOIN path p ON p.path_id = r.path_id),
fold AS (SELECT equipment, i, mean_z AS anchor, 0 AS c FROM zs WHERE i = 1
  UNION ALL SELECT z.equipment, z.i, CASE WHEN z.mean_z - f.anchor <= 200 THEN f.anchor ELSE z.mean_z END, CASE WHEN z.mean_z - f.anchor <= 200 THEN f.c ELSE f.c + 1 END
  FROM fold f JOIN zs z ON z.equipment = f.equipment AND z.i = f.i + 1),
zc AS (SELECT zs.*, fold.c FROM zs JOIN fold ON zs.equipment = fold.equipment AND zs.i = fold.i),
zl AS (SELECT equipment, c, round(avg(mean_z), 1) AS mean_z, count(DISTINCT path_id) AS path_count FROM zc GROUP BY equipment, c HAVING count(DISTINCT path_id) >= 2),
zd AS (SELECT a.equipment, a.c, round(max(sqrt((a.mean_x-b.mean_x)*(a.mean_x-b.mean_x)+(a.mean_y-b.mean_y)*(a.mean_y-b.mean_y))), 1) AS xy_spread
  FROM zc a JOIN zc b ON a.equipment = b.equipment AND a.c = b.c GROUP BY a.equipment, a.c),
level AS (SELECT zl.equipment, mean_z, path_count, xy_spread, CAST(row_number() OVER (PARTITION BY zl.equipment ORDER BY zl.c) AS INT) AS level_no FROM zl JOIN zd ON zl.equipment = zd.equipment AND zl.c = zd.c)
"""

QUERIES = {
    f.__name__: f
    for f in (
        path_steps, path_features, path_positions, h_segments, direction_runs, pattern_freq, levels_traversed, elevation_bop, pattern_similarity, composite_similarity,
        composite_similarity_v1, path_groups, common_z_levels, group_zones, path_groups_v1, common_z_levels_v1, group_zones_v1, enriched_paths, tolerance_groups, equipment_stats, utility_stats, direction_ratio, length_hist, path_summary_stats,
    )
}

ORACLE_SQL = {
    "path_steps": f"{W} SELECT path_id, CAST(seq AS INT) AS seq, dx, dy, dz, round(len, 6) AS len, code FROM coded",
    "path_features": f"""{W}, {FEAT_SQL},
      d AS (SELECT a.path_id, max(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))) AS s FROM pt a JOIN pt b ON a.path_id = b.path_id GROUP BY a.path_id)
      SELECT f.path_id, utility, size, regexp_replace(arrow, '(.)', '-\\1', 'g')[2:] AS arrow, n AS n_steps, round(length, 6) AS total_length,
      x_min, x_max, y_min, y_max, z_min, z_max, rx AS x_range, ry AS y_range, rz AS z_range, round(d.s, 6) AS xy_spread FROM feat f JOIN d ON d.path_id = f.path_id""",
    "path_positions": f"{W} SELECT path_id, CAST(seq AS INT) AS seq, x, y, z FROM pt",
    "h_segments": f"{W}, {RUN_SQL} SELECT * FROM run",
    "direction_runs": """WITH e AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
      SELECT user_id, string_agg(event_type, '-' ORDER BY ts, event_id) AS pattern FROM e WHERE before IS NULL OR before <> event_type GROUP BY user_id""",
    "pattern_freq": f"{W}, {FEAT_SQL} SELECT regexp_replace(arrow, '(.)', '-\\1', 'g')[2:] AS pattern, count(*) AS n FROM feat GROUP BY 1",
    "levels_traversed": f"""{W}, {T.LEVEL_SQL},
      pl AS (SELECT pt.*, coalesce((SELECT arg_min(level, r_regionkey) FROM lev WHERE z BETWEEN z_min AND z_max), 'UNKNOWN') AS level FROM pt),
      ch AS (SELECT *, lag(level) OVER (PARTITION BY path_id ORDER BY seq) AS before FROM pl)
      SELECT path_id, string_agg(level, '-' ORDER BY seq) AS levels, count(*) - 1 AS level_changes FROM ch WHERE before IS NULL OR before <> level GROUP BY path_id""",
    "elevation_bop": f"""{W}, {T.LEVEL_SQL} SELECT path_id, coalesce((SELECT arg_min(level, r_regionkey) FROM lev WHERE sz BETWEEN z_min AND z_max), 'N/A') AS level,
      coalesce(sz - (SELECT arg_min(z_min, r_regionkey) FROM lev WHERE sz BETWEEN z_min AND z_max), 0) AS bop FROM path""",
    "pattern_similarity": f"{W}, {FEAT_SQL}, {PAIR_SQL} SELECT a, b, round(1 - levenshtein(aa, ba) / greatest(length(aa), length(ba))::DOUBLE, 6) AS similarity FROM pr",
    "composite_similarity": f"{W}, {FEAT_SQL}, {PAIR_SQL} SELECT a, b, similarity FROM sim",
    "composite_similarity_v1": f"{W}, {FEAT_SQL}, {PAIR_SQL} SELECT a, b, round(greatest(0, least(1, .3*arrow_sim + .3*v1 + .2*range_sim + .2*length_sim)), 6) AS similarity FROM sm",
    "path_groups": f"""{W}, {FEAT_SQL}, {PAIR_SQL},
      lk AS (SELECT a, b FROM sim WHERE similarity >= .7 UNION ALL SELECT b, a FROM sim WHERE similarity >= .7),
      reach AS (SELECT DISTINCT a AS v, a AS r FROM lk UNION SELECT reach.v, lk.b FROM reach JOIN lk ON lk.a = reach.r),
      comp AS (SELECT v, min(r) AS component FROM reach GROUP BY v),
      st AS (SELECT s.equipment, x.component, CAST((2 * sum(CAST(round(similarity * 1000000) AS BIGINT)) + 100 * count(*)) // (200 * count(*)) AS BIGINT) / 10000::DOUBLE AS avg_similarity, round(max(far), 3) AS max_start_xy_dist
        FROM sim s JOIN comp x ON x.v = s.a JOIN comp y ON y.v = s.b AND y.component = x.component GROUP BY 1, 2),
      n AS (SELECT component, count(*) AS path_count FROM comp GROUP BY 1)
      SELECT row_number() OVER (ORDER BY path_count DESC, avg_similarity DESC, equipment, st.component) AS group_id, equipment, st.component, path_count, avg_similarity, max_start_xy_dist
      FROM st JOIN n ON n.component = st.component WHERE path_count >= 2 AND max_start_xy_dist <= 5000""",
    "common_z_levels": f"{W}, {RUN_SQL}, {ZLEVEL_SQL} SELECT * FROM level",
    "group_zones": f"""{W}, {RUN_SQL}, {ZLEVEL_SQL},
      tk AS (SELECT equipment, mean_z AS trunk_z, xy_spread > 1500 AS is_trunk_estimated FROM level
        QUALIFY row_number() OVER (PARTITION BY equipment ORDER BY xy_spread <= 1500 DESC, CASE WHEN xy_spread <= 1500 THEN path_count END DESC NULLS LAST, xy_spread, level_no) = 1),
      zp AS (SELECT p.equipment, pt.*, tk.trunk_z, tk.is_trunk_estimated, min(CASE WHEN abs(z - trunk_z) <= 400 THEN seq END) OVER (PARTITION BY pt.path_id) AS f,
        max(CASE WHEN abs(z - trunk_z) <= 400 THEN seq END) OVER (PARTITION BY pt.path_id) AS l FROM pt JOIN path p ON p.path_id = pt.path_id JOIN tk ON tk.equipment = p.equipment)
      SELECT equipment, CASE WHEN f IS NULL THEN CASE WHEN z < trunk_z THEN 'fan_in' ELSE 'fan_out' END WHEN seq < f THEN 'fan_in' WHEN seq > l THEN 'fan_out' ELSE 'trunk' END AS zone,
        trunk_z, is_trunk_estimated, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, min(z) AS z_min, max(z) AS z_max, count(*) AS node_count FROM zp GROUP BY ALL""",
    "path_groups_v1": f"""{W}, {FEAT_SQL}, {PAIR_SQL},
      s1 AS MATERIALIZED (SELECT a, b, equipment, far, round(greatest(0, least(1, .3*arrow_sim + .3*v1 + .2*range_sim + .2*length_sim)), 6) AS similarity FROM sm),
      lk AS (SELECT a, b FROM s1 WHERE similarity >= .7 UNION ALL SELECT b, a FROM s1 WHERE similarity >= .7),
      reach AS (SELECT DISTINCT a AS v, a AS r FROM lk UNION SELECT reach.v, lk.b FROM reach JOIN lk ON lk.a = reach.r),
      comp AS (SELECT v, min(r) AS component FROM reach GROUP BY v), n AS (SELECT component, count(*) AS path_count FROM comp GROUP BY 1),
      st AS (SELECT s.equipment, x.component, CAST((2 * sum(CAST(round(similarity * 1000000) AS BIGINT)) + 100 * count(*)) // (200 * count(*)) AS BIGINT) / 10000::DOUBLE AS avg_similarity,
        round(max(far), 1) AS max_start_xy_dist, round(avg(far), 1) AS spacing FROM s1 s JOIN comp x ON x.v = s.a JOIN comp y ON y.v = s.b AND y.component = x.component GROUP BY 1, 2)
      SELECT equipment, st.component, path_count, avg_similarity, max_start_xy_dist, spacing FROM st JOIN n ON n.component = st.component WHERE path_count >= 2 AND max_start_xy_dist <= 5000""",
    "common_z_levels_v1": f"{W}, {RUN_SQL}, {ZLEVEL1_SQL} SELECT * FROM level",
    "group_zones_v1": f"""{W}, {RUN_SQL}, {ZLEVEL1_SQL},
      tk AS (SELECT equipment, mean_z AS trunk_z, xy_spread > 1500 AS is_trunk_estimated FROM level
        QUALIFY row_number() OVER (PARTITION BY equipment ORDER BY xy_spread <= 1500 DESC, CASE WHEN xy_spread <= 1500 THEN path_count END DESC NULLS LAST, xy_spread, level_no) = 1)
      SELECT p.equipment, CASE WHEN abs(z - trunk_z) <= 400 THEN 'trunk' WHEN z < trunk_z THEN 'fan_in' ELSE 'fan_out' END AS zone, trunk_z, is_trunk_estimated,
        min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, min(z) AS z_min, max(z) AS z_max, count(*) AS node_count
      FROM pt JOIN path p ON p.path_id = pt.path_id JOIN tk ON tk.equipment = p.equipment GROUP BY ALL""",
    "enriched_paths": f"""{W}, e AS (SELECT path_id, seq, len, CASE WHEN a >= 85 THEN 'R' WHEN a <= 5 THEN 'H' ELSE 'D' END AS c FROM
        (SELECT *, CASE WHEN sqrt(dx*dx + dy*dy) <= 1e-6 THEN 90 ELSE degrees(atan2(abs(dz), sqrt(dx*dx + dy*dy))) END AS a FROM coded WHERE len >= 1e-3)),
      b AS (SELECT *, lag(c) OVER (PARTITION BY path_id ORDER BY seq) AS before FROM e)
      SELECT path_id, string_agg(c, '-' ORDER BY seq) AS direction_raw, string_agg(c, '-' ORDER BY seq) FILTER (WHERE before IS NULL OR before <> c) AS direction_pattern, round(sum(len), 2) AS total_length,
        count(*) FILTER (WHERE c = 'R') AS n_r, count(*) FILTER (WHERE c = 'H') AS n_h, count(*) FILTER (WHERE c = 'D') AS n_d FROM b GROUP BY 1""",
    "tolerance_groups": """WITH RECURSIVE s AS (SELECT s_nationkey, s_suppkey, s_acctbal AS v, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS i FROM supplier),
      f AS (SELECT s_nationkey, s_suppkey, i, v AS anchor, 0 AS g FROM s WHERE i = 1
        UNION ALL SELECT s.s_nationkey, s.s_suppkey, s.i, CASE WHEN abs(s.v - f.anchor) > 200 THEN s.v ELSE f.anchor END, CASE WHEN abs(s.v - f.anchor) > 200 THEN f.g + 1 ELSE f.g END
        FROM f JOIN s ON s.s_nationkey = f.s_nationkey AND s.i = f.i + 1)
      SELECT s_nationkey, s_suppkey, g AS group_no FROM f""",
    "equipment_stats": f"{W}, {FEAT_SQL} SELECT equipment, count(*) AS path_count, round(avg(n), 6) AS mean_steps FROM feat GROUP BY 1",
    "utility_stats": f"{W}, {FEAT_SQL} SELECT utility, count(*) AS path_count, round(avg(length) / 1000, 6) AS mean_length_m FROM feat GROUP BY 1",
    "direction_ratio": f"""{W} SELECT utility, {', '.join(f"round(count(*) FILTER (WHERE code = '{k}') * 100.0::DOUBLE / count(*), 6) AS pct_{k.lower()}" for k in 'RHD')}
      FROM coded c JOIN path p ON p.path_id = c.path_id WHERE code IS NOT NULL GROUP BY 1""",
    "length_hist": f"""{W}, l AS (SELECT path_id, round(sum(len), 6) AS length FROM coded WHERE path_id IN (SELECT path_id FROM path) GROUP BY 1), s AS (SELECT min(length) AS lo, max(length) AS hi FROM l)
      SELECT CAST(least(floor((length - lo) * 10 / greatest(hi - lo, 1e-9)), 9) AS BIGINT) AS bin, count(*) AS n FROM l, s GROUP BY 1""",
    "path_summary_stats": f"""{W}, {FEAT_SQL} SELECT count(*) AS paths, count(DISTINCT equipment) AS equipment, count(DISTINCT arrow) AS patterns, round(min(length), 6) AS min_length,
      round(avg(length), 4) AS mean_length, round(max(length), 6) AS max_length, min(n) AS min_steps, max(n) AS max_steps FROM feat""",
}
