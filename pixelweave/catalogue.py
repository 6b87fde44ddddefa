"""The engine's queries over the driver's tables, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.functions import half_up, probability_colour, tier_colour, tier_style
from pixelweave.operators import evaluation, matching, morphology, planning, rasters, scoring
from pixelweave.plans import fixtures as fx
from pixelweave.scratch import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


PART = "WITH RECURSIVE " + fx.part_sql("duck")
MOVIE = "WITH " + fx.movie_sql("duck")


def _side(spark, sf, view: str, side: str, *columns: str) -> DataFrame:
    return fx.part_view(spark, sf, view).where(F.col("pass") == side).select(*(columns or ("fov", "y", "x", "label")))


def _masks(spark, sf, kind: str = "h") -> tuple[DataFrame, DataFrame]:
    """Both masks; written once, as every operator after them reads them more than once."""
    made = rasters.rasterize(fx.strip_pixels(spark, sf), ("pass", "fov")) if kind == "h" else fx.part_view(spark, sf, f"{kind}_mask", "pass", "fov", "y", "x", "label")
    both = materialize(made, f"{kind}-masks")
    return tuple(both.where(F.col("pass") == side).drop("pass") for side in ("anatomy", "activity"))


def _cells(spark, sf, side: str, kind: str = "h") -> DataFrame:
    return _side(spark, sf, f"{kind}_cell", side, "fov", "label", "flag", "prob")


def _logits(pixels: DataFrame) -> DataFrame:
    """The score raster at the given pixels; it is a formula, so nothing is joined."""
    return pixels.select("fov", "y", "x").distinct().withColumn("v", F.expr(fx.logit()))


def _logit_grid(spark, sf) -> DataFrame:
    return fx.frame_grid(fx.part_view(spark, sf, "base", "fov").distinct().repartition(fx.field_tasks(spark, sf), "fov")).withColumn("v", F.expr(fx.logit()))


# ---- rasters -----------------------------------------------------------------


@_query(f"{PART} SELECT pass, fov, y, x, label FROM f1_mask")
def rasterize_lastwins(spark, sf):
    return rasters.rasterize(fx.part_view(spark, sf, "f1_px", "pass", "fov", "y", "x", "label"), ("pass", "fov")).select("pass", "fov", "y", "x", "label")


@_query(f"""{PART}, kept AS (SELECT fov, label, CAST(row_number() OVER (PARTITION BY fov ORDER BY label) AS INT) fresh, count(*) OVER (PARTITION BY fov) n_kept
        FROM f1_cell WHERE pass='activity' AND flag>=1 AND prob>=0.5)
 SELECT fov, y, x, max(fresh) AS label, max(n_kept) AS n_kept FROM f1_px JOIN kept USING (fov, label) WHERE pass='activity' GROUP BY fov, y, x""")
def rasterize_filtered(spark, sf):
    return rasters.rasterize_filtered(_side(spark, sf, "f1_px", "activity"), _cells(spark, sf, "activity", "f1"))


@_query(f"""{PART} SELECT fov, y - 23 AS y, x + 20 AS x, label FROM f1_mask WHERE pass='anatomy' AND y - 23 BETWEEN 0 AND 208 AND x + 20 BETWEEN 0 AND 295""")
def align_center(spark, sf):
    mask, _ = _masks(spark, sf, "f1")
    return rasters.align_center(mask, (F.lit(256), F.lit(256)), (F.lit(209), F.lit(296)))


AREAS = "SELECT pass, fov, label, count(*) AS area_px, CAST(floor(avg(y)) AS INT) AS centroid_y, CAST(floor(avg(x)) AS INT) AS centroid_x FROM {m}_mask GROUP BY pass, fov, label"


@_query(f"{PART} {AREAS.format(m='f1')}")
def roi_area_centroid(spark, sf):
    return rasters.areas(fx.part_view(spark, sf, "f1_mask"), ("pass", "fov", "label"))


@_query(f"{PART} SELECT fov, count(DISTINCT label) AS n_labels, max(label) AS max_label FROM f1_mask WHERE pass='anatomy' GROUP BY fov")
def label_summary(spark, sf):
    return rasters.label_summary(_masks(spark, sf, "f1")[0])


GRID = f"grid AS (SELECT fov, CAST(y AS INT) y, CAST(x AS INT) x FROM (SELECT DISTINCT fov FROM base) CROSS JOIN (SELECT unnest(generate_series(0,255)) y) CROSS JOIN (SELECT unnest(generate_series(0,255)) x)), raw AS (SELECT fov, y, x, {fx.logit()} v FROM grid)"
SIGMOID = "prob AS (SELECT fov, y, x, CASE WHEN low<0 OR high>1 THEN 1.0::DOUBLE/(1.0::DOUBLE+exp(-v)) ELSE v END v FROM raw JOIN (SELECT fov, min(v) low, max(v) high FROM raw GROUP BY fov) USING (fov))"


@_query(f"{PART}, {GRID}, {SIGMOID} SELECT fov, y, x, round(v, 6) AS v FROM prob")
def cellprob_sigmoid(spark, sf):
    return rasters.probability(_logit_grid(spark, sf)).withColumn("v", F.round("v", 6))


@_query(f"{PART}, {GRID} SELECT fov, min(v) AS v_min, max(v) AS v_max, count(*) FILTER (WHERE v > 0.5) AS n_above FROM raw GROUP BY fov")
def raster_range(spark, sf):
    return rasters.raster_range(_logit_grid(spark, sf))


@_query(f"{PART}, {GRID} SELECT fov, y, x, v AS c0, CASE WHEN fov%3=0 THEN 0.0::DOUBLE ELSE CAST((y+x)%7 AS DOUBLE) END AS c1 FROM raw")
def two_channel_stack(spark, sf):
    mean = _logit_grid(spark, sf)
    vcorr = mean.where("fov % 3 <> 0").select("fov", "y", "x", ((F.col("y") + F.col("x")) % 7).cast("double").alias("v"))
    return rasters.two_channels(mean, vcorr)


@_query(f"{PART}, {GRID} SELECT fov, y, x, v AS c0, CAST((y+x)%7 AS DOUBLE) AS c1 FROM raw WHERE fov%3<>0")
def two_channel_training(spark, sf):
    mean = _logit_grid(spark, sf)
    vcorr = mean.where("fov % 3 <> 0").select("fov", "y", "x", ((F.col("y") + F.col("x")) % 7).cast("double").alias("v"))
    return rasters.two_channels(mean, vcorr, require_both=True)


@_query(f"{MOVIE} SELECT fov, y, x, round(avg(v), 5) AS mean_v, round(max(v), 5) AS max_v FROM movie GROUP BY fov, y, x")
def mean_max_projection(spark, sf):
    return rasters.projections(fx.movie(spark, sf)).select("fov", "y", "x", F.round("mean_v", 5).alias("mean_v"), F.round("max_v", 5).alias("max_v"))


MOVIE_MASK = "CASE WHEN (y+x)%7=0 THEN 0 ELSE 1 + (y // 4)*2 + (x // 4) END"


@_query(f"{MOVIE} SELECT fov, t, CAST({MOVIE_MASK} AS INT) AS label, round(avg(v), 5) AS mean_f FROM movie WHERE {MOVIE_MASK} > 0 GROUP BY ALL")
def roi_traces(spark, sf):
    values = fx.movie(spark, sf)
    mask = spark.sql("SELECT CAST(y AS INT) y, CAST(x AS INT) x, CAST(1 + (y div 4)*2 + (x div 4) AS INT) label FROM (SELECT explode(sequence(0,7)) y) CROSS JOIN (SELECT explode(sequence(0,7)) x) WHERE (y+x)%7 <> 0")
    fields = values.select("fov").distinct()
    return rasters.traces(values, fields.crossJoin(F.broadcast(mask))).withColumn("mean_f", F.round("mean_f", 5))


def _stretch(rule: str, low: float, high: float):
    return lambda spark, sf: rasters.stretch(rasters.projections(fx.movie(spark, sf)).select("fov", "y", "x", F.round("mean_v", 6).alias("v")), low, high, rule)


_PROJ = f"{MOVIE}, proj AS (SELECT fov, y, x, round(avg(v), 6) v FROM movie GROUP BY fov, y, x), ends AS (SELECT fov, quantile_cont(v, @lo) lo, quantile_cont(v, @hi) hi FROM proj GROUP BY fov)"
for _name, _rule, _lo, _hi, _sql in (
    ("stretch_unit", "unit", 0.01, 0.99, "round(greatest(0.0, least(1.0, (v-lo)/greatest(hi-lo, 1e-6::DOUBLE))), 5)"),
    ("stretch_coarse", "coarse", 0.01, 0.99, "round(greatest(0.0, least(1.0, (v-lo)/greatest(hi-lo, 1.0::DOUBLE))), 5)"),
    ("stretch_uint16", "uint16", 0.005, 0.995, "CAST(trunc(greatest(0.0, least(1.0, (v-lo)/(hi-lo+1e-8::DOUBLE)))*65535) AS INT)"),
):

    def _make(name=_name, rule=_rule, lo=_lo, hi=_hi):
        def run(spark, sf):
            out = _stretch(rule, lo, hi)(spark, sf)
            return out if rule == "uint16" else out.withColumn("v", F.round("v", 5))

        run.__name__ = name
        return run

    _query(_PROJ.replace("@lo", str(_lo)).replace("@hi", str(_hi)) + f" SELECT fov, y, x, {_sql} AS v FROM proj JOIN ends USING (fov)")(_make())


@_query("""WITH v AS (SELECT n_nationkey roi, n_regionkey fov FROM nation),
 box AS (SELECT CAST(fov AS INT) fov, CAST(roi AS INT) roi, (roi*7)%40 y0, (roi*7)%40+6+roi%5 y1, (roi*11)%40 x0, (roi*11)%40+5+roi%7 x1 FROM v),
 px AS (SELECT fov, roi, CAST(y AS INT) y, CAST(x AS INT) x FROM box, (SELECT unnest(generate_series(0,47)) y), (SELECT unnest(generate_series(0,47)) x)
        WHERE y >= y0 AND y < y1 AND x >= x0 AND x < x1)
 SELECT fov, y, x, max(roi) AS label FROM px GROUP BY fov, y, x""")
def polygon_fill(spark, sf):
    n = fx.table(spark, sf, "nation").selectExpr("CAST(n_regionkey AS INT) fov", "CAST(n_nationkey AS INT) roi", "n_nationkey k")
    box = n.selectExpr("fov", "roi", "CAST((k*7)%40 AS DOUBLE) y0", "CAST((k*7)%40+6+k%5 AS DOUBLE) y1", "CAST((k*11)%40 AS DOUBLE) x0", "CAST((k*11)%40+5+k%7 AS DOUBLE) x1")
    ring = box.selectExpr("fov", "roi", "posexplode(array(named_struct('y',y0,'x',x0), named_struct('y',y0,'x',x1), named_struct('y',y1,'x',x1), named_struct('y',y1,'x',x0))) AS (seq, p)")
    return rasters.fill_polygons(ring.select("fov", "roi", "seq", "p.y", "p.x"), 48, 48)


# ---- matching ----------------------------------------------------------------

_EDGES = """ea AS (SELECT fov, label la, count(*) na FROM {a} GROUP BY fov, label), eb AS (SELECT fov, label lb, count(*) nb FROM {b} GROUP BY fov, label),
 edges AS (SELECT fov, la, lb, inter, na, nb, inter::DOUBLE/(na+nb-inter) iou FROM
   (SELECT a.fov, a.label la, b.label lb, count(*) inter FROM {a} a JOIN {b} b ON a.fov=b.fov AND a.y=b.y AND a.x=b.x GROUP BY a.fov, a.label, b.label) JOIN ea USING (fov, la) JOIN eb USING (fov, lb))"""


def _edges_sql(kind: str) -> str:
    return f"am AS (SELECT fov, y, x, label FROM {kind}_mask WHERE pass='anatomy'), bm AS (SELECT fov, y, x, label FROM {kind}_mask WHERE pass='activity'), " + _EDGES.format(a="am", b="bm")


@_query(f"{PART}, {_edges_sql('f1')} SELECT fov, la, lb, inter, na, nb, round(iou, 4) AS iou FROM edges")
def iou_edges(spark, sf):
    return matching.iou_edges(*_masks(spark, sf, "f1")).withColumn("iou", F.round("iou", 4))


@_query(f"{PART}, {_edges_sql('h')} SELECT fov, la, lb, inter, na, nb, round(iou, 4) AS iou FROM edges")
def iou_edges_strips(spark, sf):
    return matching.iou_edges(*_masks(spark, sf)).withColumn("iou", F.round("iou", 4))


@_query(f"{PART}, {_edges_sql('h')} SELECT fov, la, lb, round(iou, 4) AS iou FROM edges WHERE iou > {matching.CERTAIN!r}::DOUBLE")
def certain_matches(spark, sf):
    return matching.certain_pairs(matching.iou_edges(*_masks(spark, sf))).select("fov", "la", "lb", F.round("iou", 4).alias("iou"))


#: Optimal pairs in SQL: fix certain pairs, close the rest under reachability, enumerate
#: the partial matchings of every component and take the largest total.
_PAIRS = f"""{_edges_sql('h')},
 sure AS MATERIALIZED (SELECT * FROM edges WHERE iou > {matching.CERTAIN!r}::DOUBLE),
 rest AS MATERIALIZED (SELECT fov, la, lb, iou FROM edges e WHERE NOT EXISTS (SELECT 1 FROM sure s WHERE s.fov=e.fov AND s.la=e.la) AND NOT EXISTS (SELECT 1 FROM sure s WHERE s.fov=e.fov AND s.lb=e.lb)),
 hop AS MATERIALIZED (SELECT DISTINCT p.fov, p.la a, q.la b FROM rest p JOIN rest q ON p.fov=q.fov AND p.lb=q.lb),
 reach(fov, a, b) AS (SELECT fov, a, b FROM hop UNION SELECT r.fov, r.a, h.b FROM reach r JOIN hop h ON r.fov=h.fov AND r.b=h.a),
 comp AS MATERIALIZED (SELECT fov, a la, min(b) c FROM reach GROUP BY fov, a),
 item AS MATERIALIZED (SELECT r.*, c, row_number() OVER (PARTITION BY r.fov, c ORDER BY la, lb) i FROM rest r JOIN comp USING (fov, la)),
 grow(fov, c, i, las, lbs, total) AS (SELECT DISTINCT fov, c, 0::BIGINT, []::INT[], []::INT[], 0.0::DOUBLE FROM item
   UNION ALL SELECT g.fov, g.c, e.i, list_append(g.las, e.la), list_append(g.lbs, e.lb), g.total+e.iou FROM grow g JOIN item e ON g.fov=e.fov AND g.c=e.c AND e.i>g.i
     AND NOT list_contains(g.las, e.la) AND NOT list_contains(g.lbs, e.lb)),
 top AS (SELECT fov, c, arg_max(las, total) las, arg_max(lbs, total) lbs FROM grow GROUP BY fov, c),
 pick AS (SELECT fov, unnest(las) la, unnest(lbs) lb FROM top),
 pairs AS MATERIALIZED (SELECT fov, la, lb, iou FROM (SELECT fov, la, lb, iou FROM sure UNION ALL SELECT fov, la, lb, iou FROM pick JOIN rest USING (fov, la, lb)) WHERE iou >= 0.3::DOUBLE)"""

_RECORDS = """ar AS (SELECT fov, label, count(*) n, CAST(floor(avg(y)) AS INT) cy, CAST(floor(avg(x)) AS INT) cx FROM am GROUP BY fov, label),
 br AS (SELECT fov, label, count(*) n, CAST(floor(avg(y)) AS INT) cy, CAST(floor(avg(x)) AS INT) cx FROM bm GROUP BY fov, label),
 every AS (SELECT p.fov, 'GOLD' tier, 1 k, iou, la, lb, cy, cx, n FROM pairs p JOIN ar ON ar.fov=p.fov AND ar.label=la
   UNION ALL SELECT fov, 'SILVER', 2, 0, label, -1, cy, cx, n FROM ar WHERE (fov, label) NOT IN (SELECT (fov, la) FROM pairs)
   UNION ALL SELECT fov, 'BRONZE', 3, 0, -1, label, cy, cx, n FROM br WHERE (fov, label) NOT IN (SELECT (fov, lb) FROM pairs)),
 records AS MATERIALIZED (SELECT fov, CAST(row_number() OVER (PARTITION BY fov ORDER BY k, CASE WHEN k=3 THEN lb ELSE la END) AS INT) roi_id, tier, iou, la, lb, cy, cx, n FROM every)"""

_UNION = """painted AS MATERIALIZED (SELECT fov, y, x, max(roi_id) label FROM (SELECT am.fov, y, x, roi_id FROM am JOIN records r ON r.fov=am.fov AND r.la=am.label
   UNION ALL SELECT bm.fov, y, x, roi_id FROM bm JOIN records r ON r.fov=bm.fov AND r.lb=bm.label AND r.tier='BRONZE') GROUP BY fov, y, x)"""

#: ``half_up`` to five places: the value does not hang on the order of a mean's sum.
HALF_UP = "floor(({})*100000.0::DOUBLE + 0.500001::DOUBLE)/100000.0::DOUBLE"

_SCORED = f"""{GRID}, {SIGMOID}, means AS MATERIALIZED (SELECT p.fov, label roi_id, avg(v) m FROM painted p JOIN prob USING (fov, y, x) GROUP BY p.fov, label),
 scored AS (SELECT r.fov, r.roi_id, tier, round(iou, 4) iou_score, coalesce(cb.flag, -1) activity_iscell, coalesce(round(cb.prob, 4), -1.0::DOUBLE) activity_s2p_prob,
   coalesce(round(ca.prob, 4), -1.0::DOUBLE) anatomy_s2p_prob, {HALF_UP.format('coalesce(m, 0.0::DOUBLE)')} cellpose_mean_prob
   FROM records r LEFT JOIN means m ON m.fov=r.fov AND m.roi_id=r.roi_id LEFT JOIN h_cell cb ON cb.pass='activity' AND cb.fov=r.fov AND cb.label=r.lb LEFT JOIN h_cell ca ON ca.pass='anatomy' AND ca.fov=r.fov AND ca.label=r.la)"""

_TO_PAIRS = f"{PART}, {_PAIRS}"
_TO_RECORDS = f"{_TO_PAIRS}, {_RECORDS}"
_TO_SCORED = f"{_TO_RECORDS}, {_UNION}, {_SCORED}"


@_query(f"{_TO_PAIRS} SELECT fov, la, lb, round(iou, 4) AS iou FROM pairs")
def optimal_gold_pairs(spark, sf):
    return matching.optimal_pairs(matching.iou_edges(*_masks(spark, sf))).withColumn("iou", F.round("iou", 4))


def _records(spark, sf, masks: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    return matching.tier_records(*(masks or _masks(spark, sf)), iscell=_cells(spark, sf, "activity"))


@_query(f"""{_TO_RECORDS} SELECT r.fov, roi_id, tier, round(iou, 4) AS iou_score, la AS cellpose_label, lb AS s2p_label, cy AS centroid_y, cx AS centroid_x, n AS area_px,
 coalesce(round(c.prob, 4), -1.0::DOUBLE) AS s2p_iscell_prob FROM records r LEFT JOIN h_cell c ON c.pass='activity' AND c.fov=r.fov AND c.label=r.lb""")
def tier_records(spark, sf):
    return _records(spark, sf)


@_query(f"""{_TO_RECORDS}, chosen AS (SELECT *, CAST(row_number() OVER (PARTITION BY fov ORDER BY roi_id) AS INT) fresh FROM records WHERE tier IN ('GOLD','SILVER'))
 SELECT am.fov, y, x, max(fresh) AS label FROM am JOIN chosen c ON c.fov=am.fov AND c.la=am.label GROUP BY am.fov, y, x""")
def consensus_mask_default(spark, sf):
    a, b = _masks(spark, sf)
    return matching.consensus_mask(a, b, _records(spark, sf, (a, b)))


@_query(f"{_TO_RECORDS}, {_UNION} SELECT fov, y, x, label FROM painted")
def union_mask(spark, sf):
    a, b = _masks(spark, sf)
    return matching.consensus_mask(a, b, _records(spark, sf, (a, b)), scoring.TIERS)


@_query(f"{_TO_RECORDS}, {_UNION} SELECT p.fov, y, x, label, tier FROM painted p JOIN records r ON r.fov=p.fov AND r.roi_id=p.label")
def tier_layer_pixels(spark, sf):
    a, b = _masks(spark, sf)
    records = _records(spark, sf, (a, b))
    return matching.tier_pixels(matching.consensus_mask(a, b, records, scoring.TIERS), records)


def _scored(spark, sf) -> DataFrame:
    a, b = _masks(spark, sf)
    raster = rasters.probability(_logit_grid(spark, sf))
    return scoring.scored_rois(a, b, raster, _cells(spark, sf, "anatomy"), _cells(spark, sf, "activity"))


@_query(f"{_TO_SCORED} SELECT * FROM scored")
def scored_rois(spark, sf):
    return _scored(spark, sf)


@_query(f"{_TO_RECORDS}, {_UNION}, {_SCORED} SELECT p.fov, y, x, label AS roi_id, {HALF_UP.format('m')} AS mean_prob FROM painted p JOIN means m ON m.fov=p.fov AND m.roi_id=p.label")
def probability_raster(spark, sf):
    a, b = _masks(spark, sf)
    mask = matching.consensus_mask(a, b, _records(spark, sf, (a, b)), scoring.TIERS)
    means = scoring.mean_probability(mask, rasters.probability(_logit_grid(spark, sf)))
    return scoring.probability_raster(mask, means).withColumn("mean_prob", half_up(F.col("mean_prob"), 5))


@_query(f"{_TO_RECORDS} SELECT fov, count(*) FILTER (WHERE tier='GOLD') AS n_gold, count(*) FILTER (WHERE tier='SILVER') AS n_silver, count(*) FILTER (WHERE tier='BRONZE') AS n_bronze, count(*) AS n_rois FROM records GROUP BY fov")
def tier_counts_fov(spark, sf):
    return scoring.tier_counts(_records(spark, sf))


@_query(f"{_TO_RECORDS} SELECT tier, count(*) AS n_rois FROM records GROUP BY tier")
def tier_counts_total(spark, sf):
    return scoring.tier_totals(_records(spark, sf))


@_query(f"{_TO_RECORDS} SELECT count(DISTINCT fov) AS n_fovs, count(*) AS n_rois, count(*) FILTER (WHERE tier='GOLD') AS n_gold FROM records")
def summary_metrics(spark, sf):
    return scoring.summary(_records(spark, sf))


@_query(f"{_TO_SCORED} SELECT * FROM scored WHERE tier IN ('GOLD','SILVER') AND cellpose_mean_prob > 0.5")
def high_confidence(spark, sf):
    return scoring.high_confidence(_scored(spark, sf))


@_query(f"{_TO_SCORED} SELECT * FROM scored WHERE tier IN ('GOLD','BRONZE') AND NOT cellpose_mean_prob < 0.45::DOUBLE")
def viewer_filter(spark, sf):
    return scoring.viewer_filter(_scored(spark, sf), ("GOLD", "BRONZE"), 0.45)


@_query(f"{_TO_SCORED} SELECT tier, count(*) FILTER (WHERE NOT cellpose_mean_prob < 0.45::DOUBLE) AS n_shown, count(*) AS n_total FROM scored GROUP BY tier")
def shown_of_total(spark, sf):
    return scoring.shown_of_total(_scored(spark, sf), 0.45)


@_query(f"{_TO_SCORED} SELECT * FROM scored ORDER BY fov, roi_id LIMIT 20")
def preview(spark, sf):
    return scoring.preview(_scored(spark, sf))


@_query(f"{PART}, {_edges_sql('h')} SELECT least(CAST(floor(iou*20) AS INT), 19) AS bin, count(*) AS n, round((SELECT quantile_cont(iou, 0.5) FROM edges), 6) AS median_iou FROM edges GROUP BY 1")
def iou_histogram(spark, sf):
    return scoring.iou_histogram(matching.iou_edges(*_masks(spark, sf))).withColumn("median_iou", F.round("median_iou", 6))


_MANUAL = "manual AS (SELECT fov, y, x, max(label) label FROM h_px WHERE pass='anatomy' AND k%3<>0 GROUP BY fov, y, x)"


def _manual(spark, sf) -> DataFrame:
    px = fx.part_view(spark, sf, "h_px").where("pass = 'anatomy' AND k % 3 <> 0").select("fov", "y", "x", "label")
    return rasters.rasterize(px)


_UNCOVERED = f"{_MANUAL}, act AS (SELECT fov, y, x, label FROM h_mask WHERE pass='activity'), {_EDGES.format(a='act', b='manual')}, best AS (SELECT fov, la, max(iou) m FROM edges GROUP BY fov, la), unc AS (SELECT DISTINCT a.fov, a.label FROM act a LEFT JOIN best ON best.fov=a.fov AND best.la=a.label WHERE coalesce(m, 0) < 0.1::DOUBLE)"


@_query(f"{PART}, {_UNCOVERED} SELECT fov, label FROM unc")
def uncovered_left(spark, sf):
    return matching.uncovered(_masks(spark, sf)[1], _manual(spark, sf))


_MERGED = f"""{_UNCOVERED}, extra AS (SELECT act.* FROM act JOIN unc USING (fov, label)),
 touch AS (SELECT DISTINCT e.fov, e.label FROM extra e JOIN manual m ON m.fov=e.fov AND m.y=e.y AND m.x=e.x),
 fresh AS (SELECT e.* FROM extra e ANTI JOIN touch t ON t.fov=e.fov AND t.label=e.label),
 num AS (SELECT fov, label, row_number() OVER (PARTITION BY fov ORDER BY label) k FROM (SELECT DISTINCT fov, label FROM fresh)),
 merged AS (SELECT fov, y, x, CAST(label AS INT) label FROM manual UNION ALL SELECT f.fov, y, x, CAST(coalesce(t.top, 0)+k AS INT) FROM fresh f JOIN num n ON n.fov=f.fov AND n.label=f.label LEFT JOIN (SELECT fov, max(label) top FROM manual GROUP BY fov) t ON t.fov=f.fov)"""


def _merged(spark, sf) -> tuple[DataFrame, DataFrame]:
    manual, act = _manual(spark, sf), _masks(spark, sf)[1]
    extra = act.join(matching.uncovered(act, manual).hint("shuffle_hash"), ["fov", "label"], "left_semi").select("fov", "y", "x", "label")
    return manual, matching.merge_masks(manual, extra)


_GOLD = f"""{_TO_RECORDS}, {_MANUAL}, chosen AS (SELECT *, CAST(row_number() OVER (PARTITION BY fov ORDER BY roi_id) AS INT) fresh FROM records WHERE tier IN ('GOLD','SILVER')),
 cons AS (SELECT am.fov, y, x, max(fresh) AS label FROM am JOIN chosen c ON c.fov=am.fov AND c.la=am.label GROUP BY am.fov, y, x),
 own AS (SELECT cons.* FROM cons JOIN records r ON r.fov=cons.fov AND r.roi_id=cons.label AND r.tier='GOLD' AND r.la > 0),
 oa AS (SELECT fov, label, count(*) n FROM own GROUP BY fov, label), ob AS (SELECT fov, label, count(*) n FROM manual GROUP BY fov, label),
 best AS (SELECT p.fov, l, max(i::DOUBLE/(oa.n+ob.n-i)) m FROM (SELECT o.fov, o.label l, m.label k, count(*) i FROM own o JOIN manual m ON m.fov=o.fov AND m.y=o.y AND m.x=o.x GROUP BY ALL) p
   JOIN oa ON oa.fov=p.fov AND oa.label=l JOIN ob ON ob.fov=p.fov AND ob.label=k GROUP BY p.fov, l)"""


@_query(f"{_GOLD} SELECT oa.fov, oa.label FROM oa LEFT JOIN best ON best.fov=oa.fov AND best.l=oa.label WHERE coalesce(m, 0) < 0.1::DOUBLE")
def uncovered_gold(spark, sf):
    a, b = _masks(spark, sf)
    records = _records(spark, sf, (a, b))
    return matching.uncovered_gold(matching.consensus_mask(a, b, records), records, _manual(spark, sf))


@_query(f"{PART}, {_MERGED} SELECT fov, y, x, label FROM merged")
def merge_masks(spark, sf):
    return _merged(spark, sf)[1]


@_query(f"""{PART}, {_MERGED}, c AS (SELECT fov, count(DISTINCT label) n1 FROM merged GROUP BY fov), d AS (SELECT fov, count(DISTINCT label) n0 FROM manual GROUP BY fov)
 SELECT count(*) AS n_fovs, count(*) FILTER (WHERE n1 > coalesce(n0,0)) AS n_changed, CAST(sum(n1 - coalesce(n0,0)) AS BIGINT) AS n_added FROM c LEFT JOIN d USING (fov)""")
def merge_totals(spark, sf):
    return matching.merge_totals(*_merged(spark, sf))


_PRECISION = f"""{_MANUAL}, am AS (SELECT fov, y, x, label FROM h_mask WHERE pass='activity'), {_EDGES.format(a='am', b='manual')},
 sides AS (SELECT * FROM (SELECT fov, count(DISTINCT label) np FROM am GROUP BY fov) FULL JOIN (SELECT fov, count(DISTINCT label) nt FROM manual GROUP BY fov) USING (fov)),
 ap AS (SELECT s.fov, t.threshold, coalesce(tp,0) tp, coalesce(np,0) np, coalesce(nt,0) nt, round(coalesce(tp,0)::DOUBLE/greatest(coalesce(np,0)+coalesce(nt,0)-coalesce(tp,0), 1), 4) ap
   FROM sides s CROSS JOIN (SELECT unnest([0.6, 0.75, 0.9])::DOUBLE threshold) t LEFT JOIN (SELECT fov, th, count(*) tp FROM edges, (SELECT unnest([0.6, 0.75, 0.9])::DOUBLE th) WHERE iou >= th GROUP BY fov, th) e ON e.fov=s.fov AND e.th=t.threshold)"""


@_query(f"{PART}, {_PRECISION} SELECT fov, threshold, tp, np, nt, ap FROM ap")
def average_precision(spark, sf):
    return matching.precision(_masks(spark, sf)[1], _manual(spark, sf))


@_query(f"{PART}, {_PRECISION} SELECT threshold, round(avg(ap), 4) AS mean_ap, count(ap) AS n_fovs FROM ap GROUP BY threshold")
def mean_average_precision(spark, sf):
    return matching.mean_precision(matching.precision(_masks(spark, sf)[1], _manual(spark, sf)))


#: Most matches among pairs over a threshold: all matchings of every component.
_MOST = f"""{_MANUAL}, am AS (SELECT fov, y, x, label FROM h_mask WHERE pass='activity'), {_EDGES.format(a='am', b='manual')},
 over AS MATERIALIZED (SELECT th, fov, la, lb FROM edges, (SELECT unnest([0.3, 0.5])::DOUBLE th) WHERE iou >= th),
 hop AS MATERIALIZED (SELECT DISTINCT p.th, p.fov, p.la a, q.la b FROM over p JOIN over q ON p.th=q.th AND p.fov=q.fov AND p.lb=q.lb),
 reach(th, fov, a, b) AS (SELECT th, fov, a, b FROM hop UNION SELECT r.th, r.fov, r.a, h.b FROM reach r JOIN hop h ON r.th=h.th AND r.fov=h.fov AND r.b=h.a),
 comp AS MATERIALIZED (SELECT th, fov, a la, min(b) c FROM reach GROUP BY th, fov, a),
 item AS MATERIALIZED (SELECT o.*, c, row_number() OVER (PARTITION BY o.th, o.fov, c ORDER BY la, lb) i FROM over o JOIN comp USING (th, fov, la)),
 grow(th, fov, c, i, las, lbs) AS (SELECT DISTINCT th, fov, c, 0::BIGINT, []::INT[], []::INT[] FROM item
   UNION ALL SELECT g.th, g.fov, g.c, e.i, list_append(g.las, e.la), list_append(g.lbs, e.lb) FROM grow g JOIN item e ON g.th=e.th AND g.fov=e.fov AND g.c=e.c AND e.i>g.i
     AND NOT list_contains(g.las, e.la) AND NOT list_contains(g.lbs, e.lb)),
 hits AS (SELECT th, fov, CAST(sum(n) AS BIGINT) tp FROM (SELECT th, fov, c, max(len(las)) n FROM grow GROUP BY th, fov, c) GROUP BY th, fov),
 sides AS (SELECT * FROM (SELECT fov, count(DISTINCT label) np FROM am GROUP BY fov) FULL JOIN (SELECT fov, count(DISTINCT label) nt FROM manual GROUP BY fov) USING (fov))"""


@_query(f"""{PART}, {_MOST} SELECT s.fov, t.th AS threshold, coalesce(tp,0) AS tp, coalesce(np,0) AS np, coalesce(nt,0) AS nt, round(coalesce(tp,0)::DOUBLE/greatest(coalesce(np,0)+coalesce(nt,0)-coalesce(tp,0), 1), 4) AS ap
 FROM sides s CROSS JOIN (SELECT unnest([0.3, 0.5])::DOUBLE th) t LEFT JOIN hits h ON h.fov=s.fov AND h.th=t.th""")
def average_precision_half(spark, sf):
    return matching.precision(_masks(spark, sf)[1], _manual(spark, sf), (0.3, 0.5))


@_query(f"{PART}, {GRID}, {SIGMOID} SELECT p.fov, label AS roi_id, round(avg(v), 5) AS cellpose_mean_prob FROM f1_px p JOIN prob USING (fov, y, x) WHERE pass='activity' GROUP BY p.fov, label")
def score_raw_footprint(spark, sf):
    return scoring.score_footprints(_side(spark, sf, "f1_px", "activity"), rasters.probability(_logit_grid(spark, sf)))


@_query(f"{PART}, {GRID}, {SIGMOID}, s AS (SELECT p.fov, label, round(avg(v), 5) m FROM f1_px p JOIN prob USING (fov, y, x) WHERE pass='activity' GROUP BY p.fov, label) SELECT p.fov, y, x, arg_max(m, p.label) AS v, max(p.label) AS roi_id FROM f1_px p JOIN s ON s.fov=p.fov AND s.label=p.label WHERE pass='activity' GROUP BY p.fov, y, x")
def footprint_raster(spark, sf):
    px = _side(spark, sf, "f1_px", "activity")
    return scoring.footprint_raster(px, scoring.score_footprints(px, rasters.probability(_logit_grid(spark, sf))))


@_query(f"{_TO_SCORED}, n AS (SELECT fov, max(roi_id)-5 n FROM scored GROUP BY fov), l AS (SELECT fov, CAST(unnest(generate_series(0, n)) AS INT) roi_id FROM n) SELECT l.fov, l.roi_id, coalesce(cellpose_mean_prob, 0.0::DOUBLE) AS prob FROM l LEFT JOIN scored s ON s.fov=l.fov AND s.roi_id=l.roi_id")
def dense_scores(spark, sf):
    scored = _scored(spark, sf)
    return scoring.dense_scores(scored, scored.groupBy("fov").agg((F.max("roi_id") - 5).alias("n")))


# ---- morphology --------------------------------------------------------------

_M = "m AS (SELECT fov, y, x, label FROM f1_mask WHERE pass='anatomy')"


def _cells_sql(radius: int, centre: bool = True) -> str:
    cells = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if abs(dy) + abs(dx) <= radius and (centre or dy or dx)]
    return "(VALUES " + ",".join(f"({a},{b})" for a, b in cells) + ") o(dy, dx)"


@_query(f"""{PART}, {_M} SELECT DISTINCT fov, label, y+dy AS y, x+dx AS x FROM m CROSS JOIN {_cells_sql(1, False)} WHERE y+dy BETWEEN 0 AND 255 AND x+dx BETWEEN 0 AND 255
 AND (fov, label, y+dy, x+dx) NOT IN (SELECT (fov, label, y, x) FROM m)""")
def contour(spark, sf):
    return morphology.contour(_masks(spark, sf, "f1")[0], fx.FRAME, fx.FRAME)


_DILATED = f"dil AS (SELECT DISTINCT fov, y+dy y, x+dx x FROM m CROSS JOIN {_cells_sql(5)} WHERE y+dy BETWEEN 0 AND 255 AND x+dx BETWEEN 0 AND 255)"
_ERODED = f"core AS (SELECT m.* FROM m JOIN (SELECT fov, y+dy y, x+dx x FROM m CROSS JOIN {_cells_sql(2)} GROUP BY ALL HAVING count(*)=13) e USING (fov, y, x))"


@_query(f"{PART}, {_M}, {_DILATED} SELECT fov, y, x FROM dil")
def dilate5(spark, sf):
    return morphology.dilate(_masks(spark, sf, "f1")[0], 5, fx.FRAME, fx.FRAME)


@_query(f"{PART}, {_M}, {_ERODED} SELECT fov, y, x, label FROM core")
def erode2(spark, sf):
    return morphology.erode(_masks(spark, sf, "f1")[0], 2, fx.FRAME, fx.FRAME)


@_query(f"""{PART}, {_M}, {_DILATED}, {_ERODED}, {GRID},
 pts AS (SELECT fov, CAST(floor(avg(y)) AS INT) y, CAST(floor(avg(x)) AS INT) x, label FROM m WHERE (fov, label) NOT IN (SELECT (fov, label) FROM core) GROUP BY fov, label),
 far AS (SELECT g.fov, g.y, g.x, t.label FROM grid g JOIN (SELECT fov, max(label)+1 label FROM m GROUP BY fov) t USING (fov) ANTI JOIN dil d ON d.fov=g.fov AND d.y=g.y AND d.x=g.x),
 every AS (SELECT fov, y, x, label, 1 r FROM core UNION ALL SELECT fov, y, x, label, 2 FROM pts UNION ALL SELECT fov, y, x, label, 0 FROM far)
 SELECT fov, y, x, CAST(max(r*100000+label) % 100000 AS INT) AS label FROM every GROUP BY fov, y, x""")
def markers(spark, sf):
    return morphology.markers(_masks(spark, sf, "f1")[0], fx.FRAME, fx.FRAME)


_CLAMP = "greatest(0, least(7, y+dy))", "greatest(0, least(7, x+dx))"
_SY = "(VALUES " + ",".join(f"({a},{b},{wa * wb}::DOUBLE)" for a, wa in ((-1, -0.5), (1, 0.5)) for b, wb in ((-1, 0.25), (0, 0.5), (1, 0.25))) + ") k(dy, dx, w)"
_SX = "(VALUES " + ",".join(f"({b},{a},{wa * wb}::DOUBLE)" for a, wa in ((-1, -0.5), (1, 0.5)) for b, wb in ((-1, 0.25), (0, 0.5), (1, 0.25))) + ") k(dy, dx, w)"


def _sobel_side(kernel: str) -> str:
    return f"(SELECT o.fov, o.y, o.x, sum(w*p.v) g FROM (SELECT fov, y, x, {_CLAMP[0]} ny, {_CLAMP[1]} nx, w FROM proj CROSS JOIN {kernel}) o JOIN proj p ON p.fov=o.fov AND p.y=ny AND p.x=nx GROUP BY o.fov, o.y, o.x)"


@_query(f"{MOVIE}, proj AS (SELECT fov, y, x, round(avg(v), 6) v FROM movie GROUP BY fov, y, x) SELECT a.fov, a.y, a.x, round(sqrt((a.g*a.g+b.g*b.g)/2), 5) AS v FROM {_sobel_side(_SY)} a JOIN {_sobel_side(_SX)} b USING (fov, y, x)")
def sobel(spark, sf):
    mean = rasters.projections(fx.movie(spark, sf)).select("fov", "y", "x", F.round("mean_v", 6).alias("v"))
    return morphology.sobel(mean, 8, 8).withColumn("v", F.round("v", 5))


_GAUSS = "taps AS (SELECT d, exp(-0.5::DOUBLE*d*d) / sum(exp(-0.5::DOUBLE*d*d)) OVER () w FROM (SELECT unnest(generate_series(-4, 4)) d))"


@_query(f"""{MOVIE}, proj AS (SELECT fov, y, x, round(avg(v), 6) v FROM movie GROUP BY fov, y, x), {_GAUSS},
 down AS (SELECT o.fov, o.y, o.x, sum(w*p.v) v FROM (SELECT fov, y, x, w, greatest(0, least(7, y+d)) ny FROM proj CROSS JOIN taps) o JOIN proj p ON p.fov=o.fov AND p.y=ny AND p.x=o.x GROUP BY o.fov, o.y, o.x)
 SELECT o.fov, o.y, o.x, round(sum(w*p.v), 5) AS v FROM (SELECT fov, y, x, w, greatest(0, least(7, x+d)) nx FROM down CROSS JOIN taps) o JOIN down p ON p.fov=o.fov AND p.y=o.y AND p.x=nx GROUP BY o.fov, o.y, o.x""")
def gaussian(spark, sf):
    mean = rasters.projections(fx.movie(spark, sf)).select("fov", "y", "x", F.round("mean_v", 6).alias("v"))
    return morphology.gaussian(mean, 8, 8).withColumn("v", F.round("v", 5))


@_query()
def watershed(spark, sf):
    mask = _masks(spark, sf, "f1")[0]
    return morphology.watershed(_logit_grid(spark, sf), morphology.markers(mask, fx.FRAME, fx.FRAME), fx.FRAME, fx.FRAME)


@_query()
def refined_outlines(spark, sf):
    a, b = _masks(spark, sf)
    records = _records(spark, sf, (a, b))
    mask = matching.consensus_mask(a, b, records, scoring.TIERS)
    return morphology.refined_outlines(_logit_grid(spark, sf), mask, records, fx.FRAME, fx.FRAME, ("GOLD", "SILVER"))


# ---- planning ----------------------------------------------------------------

_FILES = """files AS (SELECT p_partkey // 3 dir, 'tif' kind, 'FOV' || p_partkey || '_mc.tif' name FROM part WHERE p_partkey%7<>0 UNION ALL
 SELECT p_partkey // 3, 'zip', CASE p_partkey%4 WHEN 0 THEN 'FOV' || p_partkey || '_RoiSet.zip' WHEN 1 THEN 'RoiSet.zip' ELSE 'other' || p_partkey || 'RoiSet.zip' END FROM part WHERE p_partkey%4<>3)"""


def _files(spark, sf) -> DataFrame:
    part = fx.table(spark, sf, "part")
    tif = part.where("p_partkey % 7 <> 0").selectExpr("p_partkey div 3 AS dir", "'tif' AS kind", "concat('FOV', p_partkey, '_mc.tif') AS name")
    archive = part.where("p_partkey % 4 <> 3").selectExpr(
        "p_partkey div 3 AS dir", "'zip' AS kind", "CASE p_partkey % 4 WHEN 0 THEN concat('FOV', p_partkey, '_RoiSet.zip') WHEN 1 THEN 'RoiSet.zip' ELSE concat('other', p_partkey, 'RoiSet.zip') END AS name"
    )
    return tif.unionByName(archive)


_PAIRED = f"""{_FILES}, tif AS (SELECT dir, name tif, replace(name, '_mc.tif', '') base FROM files WHERE kind='tif'), zip AS (SELECT dir, name zip, regexp_replace(name, '_?RoiSet\\.zip$', '') base FROM files WHERE kind='zip'),
 a AS (SELECT dir, max(tif) tif, max(zip) zip FROM tif JOIN zip USING (dir, base) WHERE base<>'' GROUP BY dir, base),
 tl AS (SELECT dir, max(tif) tif, count(*) n FROM tif WHERE (dir, tif) NOT IN (SELECT (dir, tif) FROM a) GROUP BY dir HAVING count(*)=1),
 b AS (SELECT dir, tif, zip FROM tl JOIN (SELECT dir, max(zip) zip FROM zip WHERE base='' GROUP BY dir HAVING count(*)=1) USING (dir)),
 c AS (SELECT dir, tif, zip FROM tl JOIN (SELECT dir, max(zip) zip FROM zip WHERE (dir, zip) NOT IN (SELECT (dir, zip) FROM a) GROUP BY dir HAVING count(*)=1) USING (dir) WHERE dir NOT IN (SELECT dir FROM b)),
 paired AS (SELECT dir, tif, zip, 'A' strategy FROM a UNION ALL SELECT *, 'B' FROM b UNION ALL SELECT *, 'C' FROM c)"""


@_query(f"WITH {_PAIRED} SELECT * FROM paired")
def pair_files(spark, sf):
    return planning.pair_files(_files(spark, sf))


@_query(f"WITH {_PAIRED} SELECT strategy, count(*) AS n FROM paired GROUP BY strategy")
def pairing_report(spark, sf):
    return planning.pairing_report(planning.pair_files(_files(spark, sf)))


@_query(f"WITH {_FILES} SELECT kind, name, count(*) AS n, array_to_string(list_sort(list(dir)), ',') AS dirs FROM files GROUP BY kind, name HAVING count(*) > 1")
def collisions(spark, sf):
    return planning.collisions(_files(spark, sf)).withColumn("dirs", F.array_join(F.col("dirs").cast("array<string>"), ","))


@_query("SELECT DISTINCT 'FOV' || (p_partkey // 10) AS fov, true AS found FROM part WHERE regexp_full_match('FOV' || (p_partkey // 10), 'FOV1.*') OR p_partkey // 10 = 7 UNION ALL SELECT 'FOVx', false")
def resolve_fovs(spark, sf):
    names = fx.table(spark, sf, "part").selectExpr("concat('FOV', p_partkey div 10) AS fov")
    return planning.resolve_fields(names, "FOV1*, FOV7,FOVx")


@_query("""WITH m AS (SELECT p_partkey name, 256 h, 256 w, CASE WHEN p_size%10=0 THEN 0 ELSE p_size END n FROM part), i AS (SELECT p_partkey name, CASE WHEN p_size%7=0 THEN 128 ELSE 256 END h, 256 w FROM part WHERE p_partkey%9<>0)
 SELECT m.name, CASE WHEN i.h IS NULL THEN 'no image' WHEN m.h<>i.h OR m.w<>i.w THEN 'shape' WHEN n=0 THEN 'empty' END AS issue, (i.h IS NOT NULL AND n > 0) AS is_pair FROM m LEFT JOIN i USING (name)""")
def validate_dataset(spark, sf):
    part = fx.table(spark, sf, "part")
    masks = part.selectExpr("p_partkey AS name", "256 AS h", "256 AS w", "CASE WHEN p_size % 10 = 0 THEN 0 ELSE p_size END AS n_labels")
    images = part.where("p_partkey % 9 <> 0").selectExpr("p_partkey AS name", "CASE WHEN p_size % 7 = 0 THEN 128 ELSE 256 END AS h", "256 AS w")
    return planning.validate_dataset(masks, images)


@_query("""WITH a AS (SELECT p_partkey fov, 256 ly, 256 lx FROM part WHERE p_partkey%3<>0), b AS (SELECT p_partkey fov, CASE WHEN p_size%5=0 THEN 255 ELSE 256 END ly, 256 lx FROM part WHERE p_partkey%4<>0)
 SELECT fov, ly, lx FROM a JOIN b USING (fov, ly, lx) WHERE fov%5<>0""")
def complete_fields(spark, sf):
    part = fx.table(spark, sf, "part")
    a = part.where("p_partkey % 3 <> 0").selectExpr("p_partkey AS fov", "256 AS ly", "256 AS lx")
    b = part.where("p_partkey % 4 <> 0").selectExpr("p_partkey AS fov", "CASE WHEN p_size % 5 = 0 THEN 255 ELSE 256 END AS ly", "256 AS lx")
    return planning.complete_fields(a, b, part.where("p_partkey % 5 <> 0").selectExpr("p_partkey AS fov", "'mean' AS kind"))


@_query("""WITH r AS (SELECT p_partkey fov, unnest(CASE WHEN p_partkey%3=0 THEN ['_mc_mean'] WHEN p_partkey%3=1 THEN ['_mean','_mc_mean'] ELSE ['_other'] END) suffix FROM part)
 SELECT fov, CASE WHEN bool_or(suffix='_mean') THEN '_mean' ELSE '_mc_mean' END AS suffix FROM r WHERE suffix<>'_other' GROUP BY fov""")
def raster_candidates(spark, sf):
    part = fx.table(spark, sf, "part")
    r = part.selectExpr("p_partkey AS fov", "explode(CASE WHEN p_partkey%3=0 THEN array('_mc_mean') WHEN p_partkey%3=1 THEN array('_mean','_mc_mean') ELSE array('_other') END) AS suffix")
    return planning.first_candidate(r, ("_mean", "_mc_mean"))


@_query("""WITH s AS (SELECT 'FOV' || p_partkey || '_mc.tif' path FROM part WHERE p_partkey%2=0), m AS (SELECT 'FOV' || p_partkey stem FROM part)
 SELECT stem, min(path) AS path FROM m LEFT JOIN s ON starts_with(path, stem) GROUP BY stem""")
def prefix_match_all(spark, sf):
    part = fx.table(spark, sf, "part")
    return planning.prefix_match(part.selectExpr("concat('FOV', p_partkey) AS stem"), part.where("p_partkey % 2 = 0").selectExpr("concat('FOV', p_partkey, '_mc.tif') AS path"))


@_query("WITH o AS (SELECT p_partkey k, (p_partkey*2654435761) % 4294967296 h FROM part) SELECT k, row_number() OVER (ORDER BY h, k) <= greatest(1, CAST(floor((SELECT count(*) FROM part)*0.15) AS BIGINT)) AS is_val FROM o")
def train_val_split(spark, sf):
    return planning.train_val_split(fx.table(spark, sf, "part").selectExpr("p_partkey AS k"))


@_query("WITH l AS (SELECT n_nationkey epoch, CASE WHEN n_nationkey%5=0 THEN 0.0::DOUBLE ELSE abs(n_nationkey-13)/10.0::DOUBLE + 0.1::DOUBLE END loss FROM nation) SELECT epoch, loss FROM l WHERE loss>0 ORDER BY loss, epoch LIMIT 1")
def best_checkpoint(spark, sf):
    losses = fx.table(spark, sf, "nation").selectExpr("n_nationkey AS epoch", "CASE WHEN n_nationkey % 5 = 0 THEN 0D ELSE abs(n_nationkey-13)/10D + 0.1D END AS loss")
    return planning.best_checkpoint(losses)


@_query("SELECT p_partkey AS fov FROM part WHERE p_partkey%4<>0")
def resume_pending(spark, sf):
    part = fx.table(spark, sf, "part")
    return planning.resume_pending(part.selectExpr("p_partkey AS fov"), part.where("p_partkey % 4 = 0").selectExpr("p_partkey AS fov"))


@_query("SELECT DISTINCT replace(replace('FOV' || p_partkey || CASE WHEN p_partkey%2=0 THEN '_mc' ELSE '_mc_x_mc' END, '_mc', ''), '_masks', '') AS fov FROM part")
def stem_names(spark, sf):
    from pixelweave.functions import stem

    return fx.table(spark, sf, "part").selectExpr("concat('FOV', p_partkey, CASE WHEN p_partkey%2=0 THEN '_mc' ELSE '_mc_x_mc' END) AS n").select(stem(F.col("n")).alias("fov")).distinct()


# ---- evaluation variants, corrections, projections, decay ----------------------

_VARIANTS = f"""{_TO_RECORDS}, {_UNION}, {_MANUAL}, chosen AS (SELECT *, CAST(row_number() OVER (PARTITION BY fov ORDER BY roi_id) AS INT) fresh FROM records WHERE tier IN ('GOLD','SILVER')),
 cons AS (SELECT am.fov, y, x, max(fresh) AS label FROM am JOIN chosen c ON c.fov=am.fov AND c.la=am.label GROUP BY am.fov, y, x),
 gold AS (SELECT cons.fov, y, x, CAST(k AS INT) AS label FROM cons JOIN (SELECT fov, roi_id, row_number() OVER (PARTITION BY fov ORDER BY roi_id) k FROM records WHERE tier='GOLD') g ON g.fov=cons.fov AND g.roi_id=cons.label)"""


@_query(f"{_VARIANTS} SELECT fov, y, x, label FROM gold")
def gold_only_mask(spark, sf):
    a, b = _masks(spark, sf)
    records = _records(spark, sf, (a, b))
    return evaluation.gold_only(matching.consensus_mask(a, b, records), records)


_VARIANT_AP = f"""{_VARIANTS}, vm AS (SELECT 'consensus' variant, * FROM cons UNION ALL SELECT 'gold_only', * FROM gold UNION ALL SELECT 'all_tiers', * FROM painted UNION ALL SELECT 'cellpose_only', fov, y, x, label FROM am),
 names AS (SELECT unnest(['consensus','gold_only','all_tiers','cellpose_only']) variant),
 own AS (SELECT variant, fov FROM names CROSS JOIN (SELECT DISTINCT fov FROM manual) WHERE NOT (variant='cellpose_only' AND fov%3=1) AND NOT (variant='all_tiers' AND fov%4=2)),
 p AS (SELECT variant, fov, label, count(*) n FROM vm GROUP BY ALL), q AS (SELECT fov, label, count(*) n FROM manual GROUP BY ALL),
 e AS (SELECT i.variant, i.fov, i.c::DOUBLE/(p.n+q.n-i.c) iou FROM (SELECT v.variant, v.fov, v.label lp, m.label lq, count(*) c FROM vm v JOIN manual m ON m.fov=v.fov AND m.y=v.y AND m.x=v.x GROUP BY ALL) i
   JOIN p ON p.variant=i.variant AND p.fov=i.fov AND p.label=lp JOIN q ON q.fov=i.fov AND q.label=lq),
 th AS (SELECT unnest([0.6, 0.75])::DOUBLE threshold),
 ap AS (SELECT own.variant, own.fov, threshold, round(tp::DOUBLE/greatest(np+nt-tp, 1), 4) ap FROM (SELECT own.*, threshold, (SELECT count(*) FROM e WHERE e.variant=own.variant AND e.fov=own.fov AND iou>=threshold) tp,
   (SELECT count(*) FROM p WHERE p.variant=own.variant AND p.fov=own.fov) np, (SELECT count(*) FROM q WHERE q.fov=own.fov) nt FROM own CROSS JOIN th) own
   UNION ALL SELECT 'cellpose_only', fov, threshold, -1.0::DOUBLE FROM (SELECT DISTINCT fov FROM manual) CROSS JOIN th WHERE fov%3=1)"""


def _variant_scores(spark, sf) -> DataFrame:
    """Both masks and the truth meet in one overlay; no variant's pixels are made."""
    sides = {"la": "pass = 'anatomy'", "lb": "pass = 'activity'", "lt": "pass = 'anatomy' AND k % 3 <> 0"}
    pixels = fx.strip_pixels(spark, sf).select("fov", "y", "x", *[F.when(F.expr(own), F.col("label")).alias(side) for side, own in sides.items()])
    counts = materialize(matching.overlay(pixels, *sides), "overlay")
    rows = materialize(evaluation.variant_counts(counts, matching.counted_records(counts)), "variant-counts")
    fields = rows.where("lb IS NOT NULL").select("fov").distinct()
    present = fields.select("fov", F.explode(F.array(*map(F.lit, evaluation.VARIANTS))).alias("variant")).where("NOT (variant = 'cellpose_only' AND fov % 3 = 1)")
    return evaluation.counted_variants(rows, present.withColumn("same_shape", F.expr("NOT (variant = 'all_tiers' AND fov % 4 = 2)")), (0.6, 0.75))


@_query(f"{_VARIANT_AP} SELECT variant, fov, threshold, ap FROM ap")
def variant_precision(spark, sf):
    return _variant_scores(spark, sf)


@_query(f"{_VARIANT_AP} SELECT variant, threshold, round(avg(ap) FILTER (WHERE ap >= 0), 4) AS mean_ap, count(*) FILTER (WHERE ap >= 0) AS n_fovs FROM ap GROUP BY variant, threshold")
def variant_means(spark, sf):
    return evaluation.variant_means(_variant_scores(spark, sf))


_IMAGES = "images AS (SELECT 'F' || (vec_id // 2) fov, CASE vec_id%5 WHEN 0 THEN 'mean' WHEN 1 THEN 'vcorr' WHEN 2 THEN 'vcorr' ELSE 'other' END kind, embedding data FROM embeddings)"


def _images(spark, sf) -> DataFrame:
    return fx.table(spark, sf, "embeddings").selectExpr("concat('F', vec_id div 2) AS fov", "CASE vec_id%5 WHEN 0 THEN 'mean' WHEN 1 THEN 'vcorr' WHEN 2 THEN 'vcorr' ELSE 'other' END AS kind", "8 AS h", "8 AS w", "embedding AS data")


@_query(f"WITH {_IMAGES} SELECT fov, fov || '_mc_vcorr' AS name, list_min(data)::DOUBLE AS v_min, list_max(data)::DOUBLE AS v_max FROM images WHERE kind='vcorr'")
def correlation_ranges(spark, sf):
    return evaluation.correlation_files(_images(spark, sf)).select("fov", "name", F.col("v_min").cast("double").alias("v_min"), F.col("v_max").cast("double").alias("v_max"))


@_query(f"WITH {_IMAGES} SELECT fov, kind, fov || '_' || kind AS name, list_sum(data[1:1])::DOUBLE AS first_v FROM images WHERE kind IN ('mean','vcorr')")
def projection_names(spark, sf):
    files, _ = evaluation.projection_files(_images(spark, sf))
    return files.select("fov", "kind", "name", F.col("data")[0].cast("double").alias("first_v"))


@_query(f"WITH {_IMAGES} SELECT count(DISTINCT fov) AS n_fovs FROM images WHERE kind IN ('mean','vcorr')")
def projection_count(spark, sf):
    return evaluation.projection_files(_images(spark, sf))[1]


@_query(f"""{PART}, a AS (SELECT CAST(fov AS VARCHAR) fov, y, x, label FROM f1_mask WHERE pass='anatomy'), b AS (SELECT fov f, CAST(fov AS VARCHAR) fov, y, x, label FROM f1_mask WHERE pass='activity')
 SELECT fov, y, x, label FROM a WHERE fov NOT IN (SELECT fov FROM b WHERE f%2=0) UNION ALL SELECT fov, y, x, CASE WHEN f%4=0 THEN label+100 ELSE label END FROM b WHERE f%2=0""")
def corrected_masks(spark, sf):
    a, b = _masks(spark, sf, "f1")
    first = b.where("fov % 2 = 0").selectExpr("concat(fov, '_mean_seg') AS name", "1 AS landed", "y", "x", "label")
    again = b.where("fov % 4 = 0").selectExpr("concat(fov, '_seg') AS name", "2 AS landed", "y", "x", "label + 100 AS label")
    empty = b.selectExpr("concat(fov, '_seg') AS name", "3 AS landed", "y", "x", "0 AS label")
    return evaluation.correct_masks(a.selectExpr("CAST(fov AS STRING) AS fov", "y", "x", "label"), first.unionByName(again).unionByName(empty))


_TRACES = "tr AS (SELECT CAST(n_regionkey AS INT) fov, CAST(n_nationkey AS INT) label, CAST(t AS INT) t, CAST(abs((t + n_nationkey*5) % (20 + n_nationkey%7) - 10) AS DOUBLE) f, CAST(t%3 AS DOUBLE) fneu FROM nation CROSS JOIN (SELECT unnest(generate_series(0, 119)) t))"
_LAGS = ", ".join(f"lead(v, {k}) OVER (PARTITION BY fov, label ORDER BY t) v{k}" for k in range(1, 11))
_TAU = f"""{_TRACES}, c AS (SELECT fov, label, t, v - avg(v) OVER (PARTITION BY fov, label) v FROM (SELECT fov, label, t, f - 0.7::DOUBLE*fneu v FROM tr)), w AS (SELECT fov, label, v, {_LAGS} FROM c),
 s AS (SELECT fov, label, k, r FROM (SELECT fov, label, unnest([{', '.join(str(k) for k in range(1, 11))}]) k, unnest([{', '.join(f'sum(v*v{k})/sum(v*v)' for k in range(1, 11))}]) r FROM w GROUP BY fov, label)),
 lead AS (SELECT * FROM s WHERE k < coalesce((SELECT min(k) FROM s z WHERE z.fov=s.fov AND z.label=s.label AND z.r <= 0), 99)),
 tau AS (SELECT fov, label, CASE WHEN sum(k*ln(r)) < 0 THEN round(-sum(k*k)/(sum(k*ln(r))*10.0::DOUBLE), 6) END tau FROM lead GROUP BY fov, label)"""


@_query(f"WITH {_TAU} SELECT n.fov, n.label, tau FROM (SELECT DISTINCT fov, label FROM tr) n LEFT JOIN tau USING (fov, label)")
def decay_times(spark, sf):
    nation = fx.table(spark, sf, "nation").selectExpr("CAST(n_regionkey AS INT) AS fov", "CAST(n_nationkey AS INT) AS label", "explode(sequence(0, 119)) AS t")
    traces = nation.selectExpr("fov", "label", "t", "CAST(abs((t + label*5) % (20 + label%7) - 10) AS DOUBLE) AS f", "CAST(t%3 AS DOUBLE) AS fneu")
    return evaluation.decay_times(traces, 10.0).withColumn("tau", F.round("tau", 6))


@_query(f"""{PART}, c AS (SELECT fov, label, prob p FROM f1_cell WHERE pass='activity')
 SELECT fov, label, round(CASE WHEN p<0.5::DOUBLE THEN 0.843+(1.0-0.843)*2*p ELSE 1.0+(0.102-1.0)*(2*p-1) END, 6) AS r, round(CASE WHEN p<0.5::DOUBLE THEN 0.188+(1.0-0.188)*2*p ELSE 1.0+(0.596-1.0)*(2*p-1) END, 6) AS g,
  round(CASE WHEN p<0.5::DOUBLE THEN 0.153+(0.749-0.153)*2*p ELSE 0.749+(0.314-0.749)*(2*p-1) END, 6) AS b FROM c""")
def probability_colours(spark, sf):
    rgba = probability_colour(F.col("label"), F.col("prob"))
    return _cells(spark, sf, "activity", "f1").select("fov", "label", rgba.alias("c")).select("fov", "label", *[F.round(F.col("c")[k], 6).alias(n) for k, n in enumerate("rgb")])


@_query(f"{_TO_RECORDS} SELECT fov, roi_id, CASE tier WHEN 'GOLD' THEN 0.843::DOUBLE WHEN 'SILVER' THEN 0.749::DOUBLE ELSE 0.388::DOUBLE END AS green FROM records")
def outline_colours(spark, sf):
    return _records(spark, sf).select("fov", "roi_id", tier_colour(F.col("tier"))[1].alias("green"))


# ---- listings, styles, status --------------------------------------------------


@_query("""WITH m AS (SELECT p_partkey fov FROM part), i AS (SELECT p_partkey fov, unnest(CASE WHEN p_partkey%3=0 THEN ['mean'] WHEN p_partkey%3=1 THEN ['mean','max'] ELSE [] END) proj FROM part)
 SELECT m.fov, p.proj, i.proj IS NOT NULL AS present FROM m CROSS JOIN (SELECT unnest(['mean','max']) proj) p LEFT JOIN i ON i.fov=m.fov AND i.proj=p.proj""")
def image_mask_pairs(spark, sf):
    part = fx.table(spark, sf, "part")
    images = part.selectExpr("p_partkey AS fov", "explode(CASE WHEN p_partkey%3=0 THEN array('mean') WHEN p_partkey%3=1 THEN array('mean','max') ELSE array() END) AS proj")
    return planning.image_mask_pairs(part.selectExpr("p_partkey AS fov"), images)


@_query("SELECT CASE WHEN p_size%9=0 THEN 'failed' WHEN p_size%4=0 THEN 'skipped' ELSE 'done' END AS status, count(*) AS n FROM part GROUP BY 1")
def batch_status(spark, sf):
    return planning.batch_status(fx.table(spark, sf, "part").selectExpr("CASE WHEN p_size%9=0 THEN 'failed' WHEN p_size%4=0 THEN 'skipped' ELSE 'done' END AS status"))


@_query("SELECT n_nationkey AS k, CASE n_nationkey%4 WHEN 0 THEN '#FFD700' WHEN 1 THEN '#C0C0C0' WHEN 2 THEN '#CD7F32' END AS colour, CASE n_nationkey%4 WHEN 0 THEN 0.7::DOUBLE WHEN 1 THEN 0.6::DOUBLE WHEN 2 THEN 0.5::DOUBLE END AS opacity, CASE WHEN n_nationkey%4 < 3 THEN n_nationkey%4 < 2 END AS visible FROM nation")
def tier_styles(spark, sf):
    tiers = fx.table(spark, sf, "nation").selectExpr("n_nationkey AS k", "element_at(array('gold', 'Silver', 'BRONZE', 'lead'), CAST(n_nationkey % 4 + 1 AS INT)) AS tier")
    return tiers.select("k", tier_style(F.col("tier")).alias("s")).select("k", "s.colour", "s.opacity", "s.visible")


@_query(f"""WITH {_PAIRED}, named AS (SELECT CASE WHEN dir%2=0 THEN '/in/' ELSE '/other/' END || dir d, tif, zip FROM paired), each AS (SELECT d, unnest([tif, zip]) n FROM named)
 SELECT d || '/' || n AS source, '/to/' || n AS target FROM each WHERE starts_with(d, '/in')""")
def move_plan(spark, sf):
    pairs = planning.pair_files(_files(spark, sf)).withColumn("dir", F.expr("concat(CASE WHEN dir%2=0 THEN '/in/' ELSE '/other/' END, dir)"))
    return planning.move_plan(pairs, "/in", "/to")


_PATHS = "'/data/' || CASE WHEN p_partkey%11=0 THEN '.x' ELSE 'animal' || p_partkey%5 END || '/session' || p_partkey%7 || CASE p_partkey%4 WHEN 1 THEN '/PRE Files' WHEN 2 THEN '/POST' ELSE '' END || CASE p_partkey%3 WHEN 0 THEN '/a' || p_partkey || '_mc.tif' WHEN 1 THEN '/b' || p_partkey || '_RoiSet.zip' ELSE '/c' || p_partkey || '.tif' END"


@_query(f"SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, CASE WHEN ends_with(path, '_mc.tif') THEN 'tif' ELSE 'zip' END AS kind, regexp_extract(path, '[^/]*$') AS name FROM (SELECT {_PATHS} path, p_partkey k FROM part) WHERE k%3<>2 AND k%4<>2 AND k%11<>0")
def session_files(spark, sf):
    return planning.session_files(fx.table(spark, sf, "part").selectExpr(f"{_PATHS} AS path"), "/data")
