"""Source tables: one row for each item and asset, made from STAC items."""

from __future__ import annotations

import json
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import StacError

COLUMNS = ("item_id", "asset", "location", "datetime", "cloud_cover", "xmin", "ymin", "xmax", "ymax")
_ITEM = "id string, bbox array<double>, collection string, properties map<string, string>, assets map<string, struct<href: string>>"


def _schema():
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(_ITEM)


def items_from_json(spark: SparkSession, path: str | Path | list) -> DataFrame:
    """Items of a feature collection (a local file, or a list of features)."""
    features = path if isinstance(path, list) else json.loads(Path(path).read_text(encoding="utf-8"))["features"]
    rows = [(f["id"], [float(v) for v in f["bbox"]], f.get("collection"), {k: None if v is None else str(v) for k, v in f.get("properties", {}).items()}, {k: (a["href"],) for k, a in f["assets"].items()}) for f in features]
    return spark.createDataFrame(rows, _schema())


def stac_query(bbox, stac_source: str, collection: str, start_date: str, end_date: str, limit: int = 999) -> list[dict]:
    """Features of a STAC API search, all pages; GET first, then POST."""
    import urllib.error
    import urllib.parse
    import urllib.request

    asked = {"collections": [collection], "bbox": list(bbox), "datetime": f"{start_date}T00:00:00Z/{end_date}T23:59:59Z", "limit": limit}
    base = stac_source.rstrip("/") + "/search"
    query = urllib.parse.urlencode({"collections": collection, "bbox": ",".join(map(str, bbox)), "datetime": asked["datetime"], "limit": limit})

    def fetch(url: str, body: dict | None = None) -> dict:
        request = urllib.request.Request(url, data=None if body is None else json.dumps(body).encode(), headers={"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=60) as r:
            return json.load(r)

    try:
        page = fetch(f"{base}?{query}")
    except urllib.error.URLError:
        page = fetch(base, asked)
    features = list(page["features"])
    while link := next((x for x in page.get("links", []) if x.get("rel") == "next"), None):
        page = fetch(link["href"], {**asked, **link.get("body", {})} if link.get("method", "GET").upper() == "POST" else None)
        features += page["features"]
    return features


def sas_expiry(c: Column) -> Column:
    """Expiry of a signed address, from its ``se`` parameter."""
    raw = F.regexp_extract(c, r"[?&]se=([^&]+)", 1)
    return F.try_to_timestamp(F.when(raw != "", F.regexp_replace(raw, "%3A", ":")))


def sign(sources: DataFrame, token: str) -> DataFrame:
    """Locations with a token appended."""
    glue = F.when(F.contains("location", F.lit("?")), F.lit("&")).otherwise(F.lit("?"))
    return sources.withColumn("location", F.concat("location", glue, F.lit(token.lstrip("?&"))))


def stac_sources(items: DataFrame, assets: list[str] | None = None) -> DataFrame:
    """Item and asset rows, sorted; web addresses get the prefix of the virtual file system."""
    rows = items.select(F.col("id").alias("item_id"), F.explode(F.map_entries("assets")).alias("a"), F.col("properties").alias("p"), "bbox")
    href = F.col("a.value.href")
    out = rows.select(
        "item_id",
        F.col("a.key").alias("asset"),
        F.when(href.rlike("^https?://"), F.concat(F.lit("/vsicurl/"), href)).otherwise(href).alias("location"),
        F.col("p")["datetime"].alias("datetime"),
        F.try_element_at("p", F.lit("eo:cloud_cover")).cast("double").alias("cloud_cover"),
        *[F.col("bbox")[i].alias(n) for i, n in enumerate(("xmin", "ymin", "xmax", "ymax"))],
    )
    return (out if assets is None else out.where(F.col("asset").isin(assets))).orderBy("datetime", "item_id", "asset")


def filter_cloud(s: DataFrame, max_cover: float) -> DataFrame:
    """Strictly below; unknown cover stays."""
    return s.where(F.col("cloud_cover").isNull() | (F.col("cloud_cover") < max_cover))


def filter_coverage(s: DataFrame, bbox: tuple[float, float, float, float], least: float = 0.5) -> DataFrame:
    """Footprints that cover at least a share of the box."""
    side = lambda lo, hi, a, b: F.greatest(F.lit(0.0), F.least(F.col(hi), F.lit(float(b))) - F.greatest(F.col(lo), F.lit(float(a))))
    area = (bbox[2] - bbox[0]) * (bbox[3] - bbox[1])
    return s.where(side("xmin", "xmax", bbox[0], bbox[2]) * side("ymin", "ymax", bbox[1], bbox[3]) / area >= least)


def filter_orbit(items: DataFrame, states: list[str]) -> DataFrame:
    """Items whose orbit state is one of ``states``."""
    if "properties" in items.columns:
        return items.where(F.try_element_at("properties", F.lit("sat:orbit_state")).isin(states))
    if "orbit_state" not in items.columns:
        raise StacError("orbit states are known for items only")
    return items.where(F.col("orbit_state").isin(states))


def filter_assets(s: DataFrame, assets: list[str]) -> DataFrame:
    return s.where(F.col("asset").isin(assets))


def drop_duplicates(s: DataFrame) -> DataFrame:
    """One row for each footprint (to 4 digits), time and asset: that of the smallest item."""
    key = [F.bround(c, 4) for c in ("xmin", "ymin", "xmax", "ymax")] + [F.col("datetime"), F.col("asset")]
    return s.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy("item_id", "location"))).where("_n = 1").drop("_n")


def rename_assets(s: DataFrame, mapping: dict[str, str], drop_unmapped: bool = True) -> DataFrame:
    """Assets by new names; the mapping also selects."""
    names = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    new = F.try_element_at(names, F.col("asset"))
    kept = s.where(new.isNotNull()) if drop_unmapped else s
    return kept.withColumn("asset", F.coalesce(new, F.col("asset")))


def merge(*tables: DataFrame) -> DataFrame:
    """All rows of tables of the same columns, sorted again."""
    if any(set(t.columns) != set(tables[0].columns) for t in tables):
        raise StacError("the tables have different columns")
    return reduce(lambda a, b: a.unionByName(b), tables).orderBy("datetime", "item_id", "asset")


def parse_datetime(c: Column) -> Column:
    """Time of an RFC 3339 text; missing if it is none."""
    shape = r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d+)?)?([Zz]|[+-]\d\d:?\d\d)?)?$"
    fixed = F.regexp_replace(F.regexp_replace(c, "[zZ]$", "+00:00"), r"([+-]\d\d)(\d\d)$", "$1:$2")
    return F.when(c.rlike(shape), F.try_to_timestamp(F.when(F.length(c) == 10, F.concat(c, F.lit("T00:00:00+00:00"))).otherwise(fixed)))


def time_slices(s: DataFrame, granularity: str = "day", lon: float | None = None) -> DataFrame:
    """A ``slice`` label: ``day``, ``month``, ``exact``, or ``solar_day`` (UTC moved by 240 seconds a degree of longitude).

    The default longitude is the circular mean of the footprints' centres, an aggregate of one row.
    """
    at = parse_datetime(F.col("datetime"))
    if granularity == "exact":
        return s.withColumn("slice", F.col("datetime"))
    if granularity in ("day", "month"):
        return s.withColumn("slice", F.date_format(at, "yyyy-MM-dd" if granularity == "day" else "yyyy-MM"))
    if granularity != "solar_day":
        raise StacError(f"unknown granularity {granularity!r}")
    if lon is None:
        mid = F.radians((F.col("xmin") + F.col("xmax")) / 2)
        mean = s.agg(F.degrees(F.atan2(F.avg(F.sin(mid)), F.avg(F.cos(mid)))).alias("_lon"))
        s, degrees = s.join(F.broadcast(mean), how="cross"), F.col("_lon")
    else:
        degrees = F.lit(float(lon))
    local = F.timestamp_seconds(F.unix_timestamp(at) + F.bround(degrees * 240, 0).cast("long"))
    return s.withColumn("slice", F.date_format(local, "yyyy-MM-dd")).drop("_lon")


def gti_index(s: DataFrame, asset: str, path: str, sort_field: str = "datetime") -> DataFrame:
    """An asset's tile index as a Parquet table by slice, with the order in which overlapping tiles win."""
    own = s.where(F.col("asset") == asset).withColumn("priority", F.row_number().over(W.partitionBy("slice").orderBy(sort_field, "location")))
    own.write.mode("errorifexists").partitionBy("slice").parquet(path)
    return s.sparkSession.read.parquet(path)


def gti_open(index: DataFrame, slice_: str | None = None, sort_asc: bool = True) -> DataFrame:
    """The tiles of a slice, in order."""
    rows = index if slice_ is None else index.where(F.col("slice").cast("string") == slice_)
    return rows.orderBy(F.col("priority").asc() if sort_asc else F.col("priority").desc())
