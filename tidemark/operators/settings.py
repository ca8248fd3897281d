"""Settings and small helpers at the API's edge: parsing, request cleaning, tags of hits, progress."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import slugify

from .site import DEFAULT_EXCLUDED, EXTENSIONS

MODES = ("public_only", "with_protected", "whitelist", "blacklist")


@dataclass(frozen=True)
class Settings:
    locales: tuple[str, ...] = ("de",)
    mode: str = "public_only"
    strictness: str = "balanced"
    excluded: tuple[str, ...] = DEFAULT_EXCLUDED
    overrides: dict[str, str] = field(default_factory=dict)


def csv(text: str | None) -> list[str]:
    return [x.strip() for x in (text or "").split(",") if x.strip()]


def lines(text: str | None) -> list[str]:
    """Non-empty lines that are no # comments."""
    return [x.strip() for x in (text or "").splitlines() if x.strip() and not x.strip().startswith("#")]


def overrides(text: str | None, enabled: tuple[str, ...]) -> dict[str, str]:
    try:
        found = json.loads(text or "{}")
    except ValueError:
        return {}
    return {str(k): v.lower() for k, v in found.items() if isinstance(v, str) and v.lower() in enabled} if isinstance(found, dict) else {}


def settings(row: dict) -> Settings:
    locales = tuple(csv(row.get("locales"))) or ("de",)
    mode = row.get("mode") if row.get("mode") in MODES else "public_only"
    strictness = row.get("strictness") if row.get("strictness") in ("strict", "balanced", "tolerant") else "balanced"
    return Settings(locales, mode, strictness, tuple(lines(row.get("excluded"))) or DEFAULT_EXCLUDED, overrides(row.get("overrides"), locales))


def folder_globs(path: str) -> list[str]:
    """A folder picked for exclusion: itself and all below it."""
    path = path.strip("/")
    return [path, f"{path}/**"]


def request_locale(value: str | None, default: str = "de") -> str:
    return re.sub("[^a-z]", "", value or "") or default


def locale_column(value, default: str = "de"):
    """request_locale() on a column."""
    return F.coalesce(F.nullif(F.regexp_replace(F.coalesce(value, F.lit("")), "[^a-z]", ""), F.lit("")), F.lit(default))


def request_tags(values: list[str]) -> list[str]:
    return [t for t in (re.sub("[^a-z0-9-]", "", v.lower())[:64] for v in values) if t]


def member_groups(value) -> list[int]:
    """Positive group ids of a list, or of a serialised list of ints."""
    if isinstance(value, str):
        value = re.findall(r'(?:i:\d+|s:\d+:"\d+");(?:i:(\d+);|s:\d+:"(\d+)";)', value)
        value = [a or b for a, b in value]
    return sorted({int(g) for g in value or [] if str(g).lstrip("-").isdigit() and int(g) > 0})


def resolve_hit_tags(hits: DataFrame, tags: DataFrame) -> DataFrame:
    """id, tags (slug, label) of hits (id, tags): extensions go, a slug wins over a label, unknown ones stay as they are."""
    each = hits.select("id", F.posexplode("tags").alias("at", "raw")).where(~F.lower("raw").isin(*EXTENSIONS))
    by_slug = tags.select(F.col("slug").alias("raw"), F.col("slug").alias("s1"), F.col("label").alias("l1"))
    by_label = tags.groupBy(F.lower("label").alias("low")).agg(F.min_by("slug", "slug").alias("s2"), F.min_by("label", "slug").alias("l2"))
    found = each.join(by_slug, "raw", "left").join(by_label, F.lower("raw") == F.col("low"), "left")
    found = found.select("id", "at", F.coalesce("s1", "s2", slugify(F.col("raw"))).alias("slug"), F.coalesce("l1", "l2", "raw").alias("label"))
    first = found.groupBy("id", "slug").agg(F.min("at").alias("at"), F.min_by("label", "at").alias("label"))
    return first.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "slug", "label"))), lambda x: F.struct(x["slug"].alias("slug"), x["label"].alias("label"))).alias("tags"))


def csv_column(text):
    """csv() on a column."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def lines_column(text):
    """lines() on a column."""
    every = F.transform(F.split(F.coalesce(text, F.lit("")), "\r\n|\r|\n"), lambda x: F.trim(x))
    return F.filter(every, lambda x: (x != "") & ~x.startswith("#"))


def overrides_column(text, enabled: list[str]):
    """overrides() on a column: a map of paths to enabled locales; what is no JSON object gives none."""
    found = F.from_json(text, "map<string,string>")
    lowered = F.transform_values(found, lambda k, v: F.lower(v))
    return F.coalesce(F.map_filter(lowered, lambda k, v: v.isin(enabled)), F.create_map().cast("map<string,string>"))


def globs_column(path):
    """folder_globs() on a column."""
    bare = F.btrim(path, F.lit("/"))
    return F.array(bare, F.concat(bare, F.lit("/**")))


def settings_table(rows: DataFrame) -> DataFrame:
    """Settings of many sites (id, locales, mode, strictness, excluded): what is missing or unknown has its default."""
    locales, excluded = csv_column(F.col("locales")), lines_column(F.col("excluded"))
    return rows.select(
        "id", F.when(F.size(locales) > 0, locales).otherwise(F.array(F.lit("de"))).alias("locales"), F.when(F.col("mode").isin(*MODES), F.col("mode")).otherwise("public_only").alias("mode"),
        F.when(F.col("strictness").isin("strict", "balanced", "tolerant"), F.col("strictness")).otherwise("balanced").alias("strictness"), F.when(F.size(excluded) > 0, excluded).otherwise(F.array(*map(F.lit, DEFAULT_EXCLUDED))).alias("excluded"),
    )


def point(rows: DataFrame, key: str, name: str):
    """One setting of one site, or None."""
    found = rows.where(F.col("id") == key).select(name).first()
    return found[0] if found else None


def eta_column(done, total, seconds):
    """Pace and time left, as a run shows them; empty before half a second, the first item, or at a crawl."""
    pace = done / seconds
    left = F.ceil(F.greatest(total - done, F.lit(0)) / pace).cast("int")
    shown = F.when(left < 60, F.format_string("%.1f/s · ETA %ds", pace, left)).when(left < 3600, F.format_string("%.1f/s · ETA %dm %ds", pace, F.floor(left / 60).cast("int"), left % 60))
    shown = shown.otherwise(F.format_string("%.1f/s · ETA %dh %dm", pace, F.floor(left / 3600).cast("int"), F.floor(left % 3600 / 60).cast("int")))
    return F.when((seconds < 0.5) | (done <= 0) | (pace < 0.01), "").otherwise(shown)


def eta(done: int, total: int, seconds: float) -> str:
    """Time left at the pace so far."""
    if done <= 0 or total <= done:
        return "0 s" if total <= done else "?"
    left = round(seconds / done * (total - done))
    return f"{left} s" if left < 60 else f"{left // 60} min {left % 60} s" if left < 3600 else f"{left // 3600} h {left % 3600 // 60} min"
