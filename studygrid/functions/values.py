"""Normalising values, as Column -> Column expressions. Null in, null out, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The tokens that stand for a missing value in analysis, case-sensitive.
ANALYSIS_NA = ("NA", "na", "N/A", "n/a", "NaN", "nan", "", "None", "null")

#: Countries and their continents.
CONTINENTS = {
    "USA": "North America",
    "Canada": "North America",
    "UK": "Europe",
    "Germany": "Europe",
    "Netherlands": "Europe",
    "Spain": "Europe",
    "Italy": "Europe",
    "Switzerland": "Europe",
    "France": "Europe",
    "Denmark": "Europe",
    "Belgium": "Europe",
    "Norway": "Europe",
    "Greece": "Europe",
    "Poland": "Europe",
    "Sweden": "Europe",
    "Japan": "Asia",
    "South Korea": "Asia",
    "Korea": "Asia",
    "Taiwan": "Asia",
    "Thailand": "Asia",
    "China": "Asia",
    "India": "Asia",
    "Australia": "Oceania",
    "New Zealand": "Oceania",
    "Brazil": "South America",
    "Mexico": "South America",
    "Chile": "South America",
    "South Africa": "Africa",
    "Egypt": "Africa",
}


def is_na(text: Column) -> Column:
    """Missing for analysis: null, or one of the tokens after trimming."""
    return text.isNull() | F.trim(text).isin(*ANALYSIS_NA)


def is_na_list(items: Column) -> Column:
    """Missing for analysis: null, empty, or a single missing item."""
    return items.isNull() | (F.size(items) == 0) | ((F.size(items) == 1) & is_na(F.try_element_at(items, F.lit(1))))


def is_missing(text: Column) -> Column:
    """Missing for validation: null or exactly NA."""
    return text.isNull() | (text == "NA")


def basic_string(text: Column) -> Column:
    """Trimmed, with runs of white space as one space; empty becomes null. Compose accents beforehand."""
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def numeric(text: Column) -> Column:
    """The number that a text starts with, decimal comma allowed, to two decimals."""
    found = F.regexp_extract(F.replace(text, F.lit(","), F.lit(".")), r"^\s*([-+]?\d+(?:\.\d+)?)", 1)
    return F.round(F.nullif(found, F.lit("")).try_cast("double"), 2)


def decimal_comma(text: Column) -> Column:
    return F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double")


def boolean(text: Column) -> Column:
    s = F.lower(F.trim(text))
    return F.when(s.isin("true", "yes", "1"), F.lit(True)).when(s.isin("false", "no", "0"), F.lit(False))


def free_text(text: Column) -> Column:
    """Lower case, without punctuation and space at the end; empty becomes null."""
    return F.nullif(F.regexp_replace(F.lower(basic_string(text)), r"[.,;:!?\s]+$", ""), F.lit(""))


def _pair(item: Column) -> Column:
    colon = F.instr(item, ":")
    key = F.when(colon > 0, F.substring(item, F.lit(1), colon - 1)).otherwise(item)
    value = F.when(colon > 0, F.substring(item, colon + 1, F.length(item))).otherwise(F.lit(""))
    return F.struct(F.trim(key).alias("key"), F.trim(value).alias("value"))


def pairs_of_list(items: Column) -> Column:
    """``["k: v", ...]`` -> array of (key, value), in order, repeats kept; missing items left out; none becomes null."""
    found = F.transform(F.filter(items, lambda x: ~is_na(x)), _pair)
    return F.when(F.size(found) > 0, found)


def pairs_of_string(text: Column) -> Column:
    """``"k: v~k: v"`` -> array of (key, value); blank items left out; none becomes null."""
    found = F.transform(F.filter(F.split(text, "~"), lambda x: F.trim(x) != ""), _pair)
    return F.when(F.size(found) > 0, found)


def joined(items: Column) -> Column:
    """A list as one ``~``-separated text, null as empty text."""
    return F.coalesce(F.array_join(items, "~"), F.lit(""))


def label_count_percent(text: Column) -> Column:
    """``Label: N (P%)`` -> (label, n, pct), either number alone allowed; null without a colon."""
    colon = F.instr(text, ":")
    tail = F.trim(F.substring(text, colon + 1, F.length(text)))
    both, pct, n = r"^(\d+)\s*\((\d+\.?\d*)\s*%\)\s*$", r"^(\d+\.?\d*)\s*%\s*$", r"^(\d+)\s*$"
    count = F.when(tail.rlike(both), F.regexp_extract(tail, both, 1)).when(tail.rlike(n), F.regexp_extract(tail, n, 1))
    share = F.when(tail.rlike(both), F.regexp_extract(tail, both, 2)).when(tail.rlike(pct), F.regexp_extract(tail, pct, 1))
    return F.when(colon > 0, F.struct(F.trim(F.substring(text, F.lit(1), colon - 1)).alias("label"), count.try_cast("int").alias("n"), share.try_cast("double").alias("pct")))


def nearest_multiple(value: Column, bases: tuple[int, ...] = (7, 30, 365)) -> Column:
    """The nearest multiple of any base; ties go to the earlier candidate."""
    candidates = [c for b in bases for c in (F.floor(value / b) * b, (F.floor(value / b) + 1) * b)]
    ranked = [F.struct(F.abs(value - c).alias("gap"), F.lit(i).alias("i"), c.alias("c")) for i, c in enumerate(candidates)]
    return F.array_min(F.array(*ranked))["c"]


def bucket(value: Column, edges: list[float], labels: list[str], include_lowest: bool = False) -> Column:
    """Right-closed ranges (lo, hi] with labels; outside of all is null."""
    out = None
    for i, label in enumerate(labels):
        low = (value >= edges[i]) if include_lowest and i == 0 else (value > edges[i])
        test = low & (value <= edges[i + 1])
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def continent(country: Column, mapping: dict[str, str] | None = None) -> Column:
    """Continent of a country or list of countries: one, Multi-continent, Other if any is not known, Unknown for null."""
    known = mapping or CONTINENTS
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    order = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in known.items()])

    def resolve(part: Column) -> Column:
        within = F.filter(order, lambda e: F.contains(part, e["k"]))
        return F.coalesce(F.try_element_at(table, part), F.try_element_at(within, F.lit(1))["v"])

    bare = F.regexp_replace(country, r"^Europe\s*\((.*)\)\s*$", "$1")
    parts = F.filter(F.transform(F.split(bare, r",| and "), lambda x: F.trim(x)), lambda x: x != "")
    found = F.transform(parts, resolve)
    distinct = F.array_distinct(found)
    listed = F.when((F.size(found) == 0) | F.exists(found, lambda x: x.isNull()), "Other").when(F.size(distinct) == 1, F.try_element_at(distinct, F.lit(1))).otherwise("Multi-continent")
    return F.when(country.isNull(), "Unknown").otherwise(F.coalesce(F.try_element_at(table, country), listed))


def first_match(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The value of the first regular expression of ``rules`` found in ``text``."""
    out = F
    for pattern, value in rules:
        out = out.when(F.lower(F.coalesce(text, F.lit(""))).rlike(pattern), value)
    return out.otherwise(default) if rules else F.lit(default)
