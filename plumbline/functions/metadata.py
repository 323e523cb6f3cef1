"""Values of a run's or a chunk's metadata: a map of text whose nested values are JSON text, read by dotted paths in any case of letters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys that date a source, the strongest first.
DATE_KEYS = ("effective_date", "valid_from", "as_of", "published_at", "updated_at", "date", "valid_until")
NOTHING = ("", "[]", "{}", "null", "false", "none")


def value(metadata: Column, *paths: str) -> Column:
    """The first value that is there under one of the paths; ``a.b`` is the key b of the JSON object under a."""

    def at(path: str) -> Column:
        key, _, rest = path.partition(".")
        whole = F.get(F.filter(F.map_entries(metadata), lambda e: F.lower(e["key"]) == path.lower()), 0)["value"]
        if not rest:
            return whole
        own = F.get(F.filter(F.map_entries(metadata), lambda e: F.lower(e["key"]) == key.lower()), 0)["value"]
        return F.coalesce(whole, F.get_json_object(own, f"$.{rest}"))

    return F.coalesce(*map(at, paths))


def normalised(metadata: Column, fields: dict[str, tuple[str, ...]], changes: dict | None = None) -> Column:
    """The metadata under common names: each field from the first of its paths, changed by a column function if one is given; unmapped keys stay."""
    known = [p.lower() for paths in fields.values() for p in paths]
    own = F.array(*(F.struct(F.lit(name).alias("key"), (changes or {}).get(name, lambda c: c)(value(metadata, *paths)).cast("string").alias("value")) for name, paths in fields.items()))
    rest = F.filter(F.map_entries(metadata), lambda e: ~F.lower(e["key"]).isin(*known, *fields))
    return F.map_from_entries(F.concat(F.filter(own, lambda e: e["value"].isNotNull()), rest))


def ids(metadata: Column, *paths: str) -> Column:
    """Document ids under the paths: a JSON list or a single id, in order, without repeats."""
    one = lambda p: value(metadata, p)
    none = F.array().cast("array<string>")

    def of(p: str) -> Column:
        v = one(p)
        return F.when(v.isNull() | F.lower(F.trim(v)).isin(*NOTHING), none).when(F.startswith(F.ltrim(v), F.lit("[")), F.coalesce(F.from_json(v, "array<string>"), none)).otherwise(F.array(v))

    return F.array_distinct(F.concat(*map(of, paths)))


def date_prefix(text: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD at the beginning; missing parts are the first; null if invalid."""
    y, m, d = (F.regexp_extract(text, r"^(\d{4})(?:-(\d{2})(?:-(\d{2}))?)?", i) for i in (1, 2, 3))
    part = lambda x: F.when(x == "", F.lit("01")).otherwise(x)
    return F.when(y != "", F.try_to_date(F.concat_ws("-", y, part(m), part(d)), "yyyy-MM-dd"))


def dated(metadata: Column, keys=DATE_KEYS) -> Column:
    """(date, key) of the first key whose value is a date; null without one."""
    each = F.array(*(F.struct(date_prefix(value(metadata, k)).alias("date"), F.lit(k).alias("key")) for k in keys))
    return F.get(F.filter(each, lambda x: x["date"].isNotNull()), 0)


def date_of(metadata: Column, *keys: str) -> Column:
    return F.coalesce(*(date_prefix(value(metadata, k)) for k in keys))
