"""Columns over names, lists in strings, and footprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DETECTION = r"^(.*):(\d+)$"


def clean_filter(name: Column, last: bool = False) -> Column:
    """The filter of a ``;`` list without CLEAR elements: the first, or the last; the trimmed text itself where nothing is left."""
    kept = F.filter(F.transform(F.split(name, ";"), lambda x: F.trim(x)), lambda x: ~F.upper(x).startswith("CLEAR") & (x != ""))
    return F.coalesce(F.try_element_at(kept, F.lit(-1 if last else 1)), F.trim(name))


#: Filter names in calibration files that differ from the archive's (fixed values).
ALIASES = {"F850L": "F850LP"}


def archive_filter(name: Column) -> Column:
    """The archive's name of a filter named as in calibration files."""
    out = name
    for short, full in ALIASES.items():
        out = F.when(name == short, full).otherwise(out)
    return out


def header_filter(one: Column, first: Column, second: Column) -> Column:
    """FILTER, else the one of FILTER1 and FILTER2 that isn't CLEAR."""
    clear = lambda c: F.upper(c).startswith("CLEAR")
    return F.coalesce(one, F.when(~clear(first), first), F.when(~clear(second), second))


def detections(text: Column, separators: str = "[;,]") -> Column:
    """``sub:index`` items as array of (sub_name, catalog_index); what doesn't parse is left out."""
    items = F.filter(F.transform(F.split(text, separators), lambda x: F.trim(x)), lambda x: x.rlike(DETECTION))
    return F.transform(items, lambda x: F.struct(F.regexp_extract(x, DETECTION, 1).alias("sub_name"), F.regexp_extract(x, DETECTION, 2).cast("long").alias("catalog_index")))


def names(text: Column) -> Column:
    """Distinct non-empty names of a list with commas or semicolons."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[;,]"), lambda x: F.trim(x)), lambda x: x != ""))


def chi2_map(text: Column) -> Column:
    """``sub:value`` items as a map; of repeated names the last counts."""
    items = F.filter(F.split(text, ","), lambda x: x.contains(":"))
    pairs = F.transform(items, lambda x: F.struct(F.regexp_extract(x, r"^(.*):([^:]*)$", 1).alias("k"), F.regexp_extract(x, r"^(.*):([^:]*)$", 2).cast("double").alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]))


def base_image(sub_name: Column) -> Column:
    return F.regexp_replace(sub_name, "_(hi|lo)$", "")


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9_.-]", "_")


def polygon(region: Column) -> Column:
    """``POLYGON [frame] r d r d ...`` as array of (ra, dec)."""
    v = F.transform(F.filter(F.split(F.trim(region), r"\s+"), lambda x: x.rlike(r"^[-+0-9.]")), lambda x: x.cast("double"))
    return F.transform(F.sequence(F.lit(0), (F.size(v) / 2).cast("int") - 1), lambda i: F.struct(F.get(v, i * 2).alias("ra"), F.get(v, i * 2 + 1).alias("dec")))


def bounding_box(points: Column) -> Column:
    ra, dec = F.transform(points, lambda p: p["ra"]), F.transform(points, lambda p: p["dec"])
    return F.struct(F.array_min(ra).alias("ra_min"), F.array_max(ra).alias("ra_max"), F.array_min(dec).alias("dec_min"), F.array_max(dec).alias("dec_max"))


def box_query(table: str, columns: list[str], ra: float, dec: float, width: float, height: float, low: float | None = None, high: float | None = None) -> str:
    """The text of a catalogue query over a box and a slice of magnitudes."""
    cut = "" if low is None else f" AND phot_g_mean_mag >= {low:g} AND phot_g_mean_mag < {high:g}"
    return f"SELECT {', '.join(columns)} FROM {table} WHERE 1 = CONTAINS(POINT('ICRS', ra, dec), BOX('ICRS', {ra:.8f}, {dec:.8f}, {width:.8f}, {height:.8f})){cut}"


def region_line(ra: Column, dec: Column, radius: float = 0.5) -> Column:
    """A circle of a region file."""
    return F.format_string(f"fk5;circle(%.7f,%.7f,{radius:g}\")", ra, dec)


def cache_name(field, ra, dec, width, height, low, high=None) -> Column:
    """The stem of a field's cached catalogue: position, box and magnitude range. All arguments are columns; a null ``high`` is left out."""
    head = F.format_string("%s_ra%.4f_dec%+.4f_w%.4f_h%.4f_G%.1f", field, ra, dec, width, height, low)
    return F.concat(head, F.lit("") if high is None else F.when(high.isNotNull(), F.format_string("_%.1f", high)).otherwise(""), F.lit("_gaia"))
