"""The queries of the general problems over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import plain_kind
from ..operators.current import current_rows
from ..operators.features import EntityFeatures, entity_features
from ..operators.nearby import cover_discs, cover_polygons, discs, edge_share, match_cover, polygons
from ..operators.rejects import load_incidents
from ..operators.rolling import rolling_totals
from ..sources.tables import table

YEARS = list(range(2006, 2019))
NEWEST = ["loaded_at", "crime_id"]
RADIUS_M = 50.0


def _features(spark: SparkSession, sf_dir: str) -> EntityFeatures:
    rows = current_rows(table(spark, sf_dir, "clean_crime"), "dc_key", NEWEST, ["ngbh", "crimetype", "year"])
    kinds = [r[0] for r in table(spark, sf_dir, "crime_code").select(plain_kind(F.col("crimetype"))).distinct().orderBy(F.lit(1)).collect() if r[0]]  # fixed: the 26 known kinds
    return entity_features(rows.withColumn("crimetype", plain_kind(F.col("crimetype"))), "ngbh", "crimetype", "year", sorted(kinds), YEARS)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of tract and kind with at least 3 current rows of which the last is of 2015 or earlier."""
    rows = _features(spark, sf_dir).unpivoted()
    return rows.where((F.col("total") >= 3) & (F.col("latest") <= 2015)).select("ngbh", F.col("kind").alias("crimetype"))


def p2_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide table: one row per tract."""
    wide = _features(spark, sf_dir).wide
    return wide.select([F.col(f"`{c}`").alias(c.replace("|", "_").replace(" ", "_")) for c in wide.columns])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that cannot be loaded."""
    return load_incidents(table(spark, sf_dir, "incident_raw"), table(spark, sf_dir, "crime_code"))[1].select("raw_id")


def p3_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected lines with their reasons."""
    return load_incidents(table(spark, sf_dir, "incident_raw"), table(spark, sf_dir, "crime_code"))[1].select("raw_id", F.array_join("errors", "; ").alias("errors"))


def p3_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loaded records with typed columns."""
    return load_incidents(table(spark, sf_dir, "incident_raw"), table(spark, sf_dir, "crime_code"))[0]


def _kinds(spark: SparkSession, sf_dir: str, make) -> DataFrame:
    """make of tracts and of sites, with their kind."""
    tracts, sites = make(polygons, cover_polygons, (table(spark, sf_dir, "tract"), "region_id", "ring")), make(discs, cover_discs, (table(spark, sf_dir, "site"), "site_id", "site_x", "site_y", RADIUS_M))
    return tracts.withColumn("kind", F.lit("tract")).unionByName(sites.withColumn("kind", F.lit("site")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites within 50 m of each row's point, and the tract that holds it where ngbh says otherwise."""
    points = table(spark, sf_dir, "clean_crime").select("crime_id", "ngbh", "point_x", "point_y")
    cover, shapes = _kinds(spark, sf_dir, lambda exact, cover, of: cover(*of)), _kinds(spark, sf_dir, lambda exact, cover, of: exact(*of))
    held = match_cover(points, "point_x", "point_y", cover, shapes, ("kind",))
    listed = (F.col("kind") == "site") | F.col("ngbh").isNull() | (F.col("ngbh") != F.col("shape_id"))
    return held.where(listed).select("crime_id", "kind", F.col("shape_id").cast("int").alias("other_id"))


def p4_region_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the tract that contains their point."""
    points, tracts = table(spark, sf_dir, "clean_crime").select("point_x", "point_y"), table(spark, sf_dir, "tract")
    held = match_cover(points, "point_x", "point_y", cover_polygons(tracts, "region_id", "ring"), polygons(tracts, "region_id", "ring"))
    return held.groupBy(F.col("shape_id").cast("int").alias("region_id")).agg(F.count(F.lit(1)).alias("n"))


def p4_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the covers, and the share of their area that takes the exact test, by kind."""
    share = edge_share(_kinds(spark, sf_dir, lambda exact, cover, of: cover(*of)), ["kind"])
    return share.select("kind", "cells", F.round("edge_share", 6).alias("edge_share"))


def _rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = current_rows(table(spark, sf_dir, "clean_crime"), "dc_key", NEWEST, ["ngbh", "date"])
    return rolling_totals(rows, "ngbh", "date", "2006-01-01", "2018-12-31")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of a sudden rise."""
    rise = (F.col("t7") >= 8) & (10 * F.col("t7") > 7 * F.col("t30")) & (F.col("day") >= F.lit("2006-01-31").cast("date"))
    return _rolling(spark, sf_dir).where(rise).select("ngbh", F.date_format("day", "yyyy-MM-dd").alias("day"))


def p5_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing totals and daily averages of each tract and day."""
    return _rolling(spark, sf_dir).select("ngbh", F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("t7").cast("bigint").alias("t7"), F.col("t30").cast("bigint").alias("t30"), F.round("avg7", 6).alias("avg7"), F.round("avg30", 6).alias("avg30"))


QUERIES = {q.__name__: q for q in (p2_found, p2_features, p3_found, p3_reasons, p3_loaded, p4_found, p4_region_counts, p4_cover, p5_found, p5_rolling)}

_CURRENT = "current_row AS (SELECT * FROM clean_crime QUALIFY row_number() OVER (PARTITION BY dc_key ORDER BY loaded_at DESC NULLS LAST, crime_id DESC) = 1)"
_SIDES = "side AS (SELECT region_id, ring[i].x AS x1, ring[i].y AS y1, ring[i % len(ring) + 1].x AS x2, ring[i % len(ring) + 1].y AS y2 FROM (SELECT region_id, ring, unnest(range(1, len(ring) + 1)) AS i FROM tract))"
_BOXES = "box AS (SELECT region_id, min(x1) AS bx1, max(x1) AS bx2, min(y1) AS by1, max(y1) AS by2 FROM side GROUP BY region_id)"
_POINTS = "pt AS (SELECT crime_id, ngbh, point_x AS x, point_y AS y FROM clean_crime WHERE point_x IS NOT NULL AND point_y IS NOT NULL AND NOT isnan(point_x) AND NOT isnan(point_y))"
_WITHIN = "within_tract AS (SELECT pt.crime_id, any_value(pt.ngbh) AS ngbh, s.region_id FROM pt JOIN box b ON x BETWEEN bx1 AND bx2 AND y BETWEEN by1 AND by2 JOIN side s ON s.region_id = b.region_id AND (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY pt.crime_id, s.region_id HAVING count(*) % 2 = 1)"
_DAYS = f"{_CURRENT}, daily AS (SELECT ngbh, date AS day, count(*) AS n FROM current_row WHERE ngbh IS NOT NULL AND date BETWEEN DATE '2006-01-01' AND DATE '2018-12-31' GROUP BY ALL), filled AS (SELECT c.ngbh, c.day, coalesce(d.n, 0) AS n FROM (SELECT ngbh, unnest(generate_series(DATE '2006-01-01', DATE '2018-12-31', INTERVAL 1 DAY))::DATE AS day FROM (SELECT DISTINCT ngbh FROM daily)) c LEFT JOIN daily d ON d.ngbh = c.ngbh AND d.day = c.day), rolled AS (SELECT ngbh, day, sum(n) OVER (PARTITION BY ngbh ORDER BY day ROWS 6 PRECEDING) AS t7, sum(n) OVER (PARTITION BY ngbh ORDER BY day ROWS 29 PRECEDING) AS t30 FROM filled)"
_FIELD = '(?:[^",]*|"(?:[^"]|"")*")'
_NUM = "-?[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?"

def _line_sql() -> str:
    pattern = "^(" + "),(".join([_FIELD] * 9) + ")$"
    names = ", ".join(f"'f{i}'" for i in range(1, 10))
    held = lambda f: f"CASE WHEN {f} LIKE '\"%' THEN replace({f}[2:-2], '\"\"', '\"') ELSE {f} END"
    number = lambda v, m: f"({v} = '' OR (regexp_full_match(trim({v}), '{_NUM}') AND abs(try_cast(trim({v}) AS DOUBLE)) <= {m}))"
    fields = ", ".join(f"{held(f'f.f{i}')} AS h{i}" for i in range(1, 10))
    return (
        "bare AS (SELECT raw_id, CASE WHEN line LIKE '%' || chr(13) THEN line[:-2] ELSE line END AS line FROM incident_raw), "
        f"cut AS (SELECT raw_id, line, regexp_full_match(line, '{pattern[1:-1]}', 's') AS good, regexp_full_match(line, '{_FIELD}(,{_FIELD})*', 's') AS sound, regexp_extract(line, '{pattern}', [{names}], 's') AS f FROM bare), "
        f"held AS (SELECT raw_id, line, good, sound, {fields} FROM cut), "
        f"judged AS (SELECT *, coalesce(trim(h6) IN (SELECT ucr_general::VARCHAR FROM crime_code), false) AS ok6, {number('h8', 180)} AS ok8, {number('h9', 90)} AS ok9 FROM held), "
        "split AS (SELECT *, coalesce(good AND ok6 AND ok8 AND ok9, false) AS ok FROM judged)"
    )


_REASON = "CASE WHEN line IS NULL THEN 'null line' WHEN NOT sound THEN 'broken quoting' WHEN NOT good THEN 'wrong number of fields' ELSE concat_ws('; ', CASE WHEN NOT ok6 THEN 'ucr_general is not a known code' END, CASE WHEN NOT ok8 THEN 'point_x is not a number up to 180' END, CASE WHEN NOT ok9 THEN 'point_y is not a number up to 90' END) END"
#: The 26 known kinds of crime_code, which name the columns of the wide table.
KINDS = (
    "homicide", "sexual assault", "robbery", "aggravated assault", "break in", "theft", "vehicle theft", "minor assault", "fire setting",
    "forged papers", "swindle", "breach of trust", "handling", "damage", "weapon offence", "soliciting", "indecency", "drug offence", "gaming",
    "neglect", "drunk driving", "liquor rules", "public drunkenness", "disorder", "loitering", "all other",
)


def _features_sql() -> str:
    column = lambda *parts: "_".join(map(str, parts)).replace(" ", "_")
    cells = [f"count(*) FILTER (k = '{k}' AND year = {y}) AS {column('n', k, y)}" for k in KINDS for y in YEARS]
    cells += [f"count(*) FILTER (k = '{k}') AS {column('total', k)}, max(year) FILTER (k = '{k}')::BIGINT AS {column('latest', k)}" for k in KINDS]
    return f"WITH {_CURRENT} SELECT ngbh, {', '.join(cells)}, count(*) AS total, max(year)::BIGINT AS latest FROM (SELECT *, lower(trim(crimetype)) AS k FROM current_row) WHERE ngbh IS NOT NULL AND k IS NOT NULL AND year BETWEEN 2006 AND 2018 GROUP BY ngbh"


SQL = {
    "p2_found": f"WITH {_CURRENT} SELECT ngbh, lower(trim(crimetype)) AS crimetype FROM current_row WHERE ngbh IS NOT NULL AND crimetype IS NOT NULL AND year BETWEEN 2006 AND 2018 GROUP BY 1, 2 HAVING count(*) >= 3 AND max(year) <= 2015",
    "p2_features": _features_sql(),
    "p3_found": f"WITH {_line_sql()} SELECT raw_id FROM split WHERE NOT ok",
    "p3_reasons": f"WITH {_line_sql()} SELECT raw_id, {_REASON} AS errors FROM split WHERE NOT ok",
    "p3_loaded": f"WITH {_line_sql()} SELECT raw_id, try_cast(trim(h1) AS BIGINT) AS dc_key, h2 AS dc_dist, h3 AS psa, h4 AS dispatch_date, h5 AS dispatch_time, trim(h6)::INT AS ucr_general, h7 AS text_general_code, try_cast(trim(h8) AS DOUBLE) AS point_x, try_cast(trim(h9) AS DOUBLE) AS point_y FROM split WHERE ok",
    "p4_found": f"WITH {_POINTS}, {_SIDES}, {_BOXES}, {_WITHIN} SELECT crime_id, 'tract' AS kind, region_id AS other_id FROM within_tract WHERE ngbh IS NULL OR ngbh <> region_id UNION ALL SELECT crime_id, 'site' AS kind, site_id AS other_id FROM pt JOIN site ON x BETWEEN site_x - 0.001 AND site_x + 0.001 AND y BETWEEN site_y - 0.001 AND site_y + 0.001 WHERE 2 * 6371008.8 * asin(sqrt(pow(sin(radians(site_y - y) / 2), 2) + cos(radians(y)) * cos(radians(site_y)) * pow(sin(radians(site_x - x) / 2), 2))) <= 50",
    "p4_region_counts": f"WITH {_POINTS}, {_SIDES}, {_BOXES}, {_WITHIN} SELECT region_id, count(*) AS n FROM within_tract GROUP BY 1",
    "p5_found": f"WITH {_DAYS} SELECT ngbh, strftime(day, '%Y-%m-%d') AS day FROM rolled WHERE day >= DATE '2006-01-31' AND t7 >= 8 AND 10 * t7 > 7 * t30",
    "p5_rolling": f"WITH {_DAYS} SELECT ngbh, strftime(day, '%Y-%m-%d') AS day, t7::BIGINT AS t7, t30::BIGINT AS t30, round(t7 / 7.0, 6) AS avg7, round(t30 / 30.0, 6) AS avg30 FROM rolled",
}
