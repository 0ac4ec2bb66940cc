"""Numeric, hash and vector columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry.functions import text as T

FNV_START, FNV_PRIME, WORD32 = 2166136261, 16777619, 4294967295


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over code points, as a long."""
    points = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    start = F.lit(FNV_START).cast("long")
    return F.aggregate(points, start, lambda h, c: (h.bitwiseXOR(c) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(WORD32)))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)


def cosine(a: Column, b: Column) -> Column:
    """Over the shorter length; 0 where a norm is 0."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm == 0, 0.0).otherwise(dot(x, y) / norm)


def fold_vector(vec: Column, width: int) -> Column:
    """Component i added to i modulo width, then scaled to length 1."""
    folded = F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda i: F.aggregate(
            F.filter(F.transform(vec, lambda x, j: F.when(j % width == i, x.cast("double"))), lambda x: x.isNotNull()),
            F.lit(0.0), lambda s, x: s + x,
        ),
    )
    norm = F.sqrt(dot(folded, folded))
    return F.when(norm == 0, folded).otherwise(F.transform(folded, lambda x: x / norm))


# Unit -> (family, factor to the family's unit).
UNITS = {
    "mm2": ("area_m2", 1e-6), "cm2": ("area_m2", 1e-4), "m2": ("area_m2", 1.0), "sqm": ("area_m2", 1.0),
    "mm3": ("volume_m3", 1e-9), "cm3": ("volume_m3", 1e-6), "m3": ("volume_m3", 1.0), "cbm": ("volume_m3", 1.0),
    "cfm": ("flow_cfm", 1.0), "ach": ("air_changes", 1.0),
    "mm": ("length_m", 1e-3), "cm": ("length_m", 1e-2), "m": ("length_m", 1.0), "km": ("length_m", 1000.0),
    "in": ("length_m", 0.0254), "ft": ("length_m", 0.3048),
    "s": ("time_s", 1.0), "sec": ("time_s", 1.0), "second": ("time_s", 1.0), "seconds": ("time_s", 1.0),
    "min": ("time_s", 60.0), "minute": ("time_s", 60.0), "minutes": ("time_s", 60.0),
    "h": ("time_s", 3600.0), "hour": ("time_s", 3600.0), "hours": ("time_s", 3600.0),
    "kg": ("mass_kg", 1.0), "g": ("mass_kg", 1e-3), "lb": ("mass_kg", 0.453592),
    "%": ("percent", 1.0), "percent": ("percent", 1.0), "lux": ("illuminance_lx", 1.0), "lx": ("illuminance_lx", 1.0),
    "kpa": ("pressure_pa", 1000.0), "pa": ("pressure_pa", 1.0), "bar": ("pressure_pa", 100000.0),
    "person": ("people", 1.0), "persons": ("people", 1.0), "occupant": ("people", 1.0), "occupants": ("people", 1.0),
}


def unit_family(unit: Column) -> Column:
    table = F.create_map(*[F.lit(x) for u, (family, _) in UNITS.items() for x in (u, family)])
    return F.coalesce(F.try_element_at(table, unit), unit)


def to_family_unit(value: Column, unit: Column) -> Column:
    table = F.create_map(*[F.lit(x) for u, (_, factor) in UNITS.items() for x in (u, factor)])
    return value * F.coalesce(F.try_element_at(table, unit), F.lit(1.0))


AT_MOST = T.words(
    r"at most|not more than|no more than|maximum|not exceeding|(?:shall|must|may)\s+not\s+exceed|less than or equal|up to"
)
AT_LEAST = T.words(r"at least|not less than|no less than|minimum|greater than or equal|no lower than")


def satisfies(obligation: Column, required: Column, actual: Column) -> Column:
    """Maximum wording first, then minimum, else equal within a thousandth."""
    close = F.greatest(F.lit(1e-9), F.abs(required) * 0.001)
    return (
        F.when(obligation.rlike(AT_MOST), actual <= required + 1e-9)
        .when(obligation.rlike(AT_LEAST), actual >= required - 1e-9)
        .otherwise(F.abs(actual - required) <= close)
    )


def display_quantity(unit: Column, value: Column) -> Column:
    def fixed(v: Column, n: int) -> Column:
        return F.format_string(f"%.{n}f", v)

    def trimmed(v: Column, n: int) -> Column:
        return F.regexp_replace(fixed(v, n), r"\.?0+$", "")

    plain = F.regexp_replace(value.cast("string"), r"\.0$", "")
    return (
        F.when((unit == "length_m") & (value < 1), F.concat(fixed(value * 1000, 0), F.lit(" mm")))
        .when(unit == "length_m", F.concat(trimmed(value, 2), F.lit(" m")))
        .when((unit == "time_s") & (value >= 60), F.concat(fixed(value / 60, 0), F.lit(" min")))
        .when(unit == "time_s", F.concat(fixed(value, 0), F.lit(" s")))
        .when(unit == "mass_kg", F.concat(trimmed(value, 2), F.lit(" kg")))
        .when(unit == "percent", F.concat(fixed(value, 0), F.lit("%")))
        .when(unit == "illuminance_lx", F.concat(fixed(value, 0), F.lit(" lux")))
        .when(unit == "pressure_pa", F.concat(fixed(value / 1000, 1), F.lit(" kPa")))
        .when(unit == "people", F.concat(fixed(value, 0), F.lit(" persons")))
        .when(unit == "area_m2", F.concat(trimmed(value, 2), F.lit(" m2")))
        .when(unit == "volume_m3", F.concat(trimmed(value, 2), F.lit(" m3")))
        .when(unit == "flow_cfm", F.concat(fixed(value, 0), F.lit(" CFM")))
        .when(unit == "air_changes", F.concat(trimmed(value, 1), F.lit(" ACH")))
        .otherwise(F.concat(plain, F.lit(" "), unit))
    )


def clamp(x: Column) -> Column:
    """x within 0..1, null for null; greatest and least alone would skip a null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def recency(date: Column, as_of: Column, years: int) -> Column:
    """1 now, falling to 0 over so many years; 0.5 if the date is unknown."""
    age = (F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(date.cast("timestamp"))) / (365 * 86400.0)
    return F.coalesce(clamp(1 - age / years), F.lit(0.5))


def length_fit(chars: Column, ideal: int = 700) -> Column:
    return F.when(chars <= 0, 0.0).when(chars <= ideal, chars / ideal).otherwise(ideal / chars)


def proximity(content: Column, query: Column) -> Column:
    """How densely the query's words stand between the first and the last of them in content."""
    places = F.filter(F.transform(content, lambda t, i: F.when(F.array_contains(query, t), i)), lambda i: i.isNotNull())
    span = F.array_max(places) - F.array_min(places) + 1
    return F.when(F.size(places) == 0, 0.0).when(F.size(places) == 1, 0.5).otherwise(clamp(F.size(places) / span))


def retry_delay(attempt: Column) -> Column:
    """Seconds before the next attempt, without jitter."""
    return F.least(F.lit(600.0), F.pow(F.lit(2.0), attempt) * 5)


QUANTITY = (
    r"(\d+(?:[.,]\d+)?)\s*(mm2|cm2|m2|sqm|mm3|cm3|m3|cbm|mm|cm|m|km|in|ft|kg|g|lb|s|sec|seconds?|min|minutes?|h|hours?|%"
    r"|percent|lux|lx|kpa|pa|bar|db|cfm|ach|persons?|occupants?)\s*([²³]?)(?![a-z0-9])"
)


PATTERN = f"(?i){QUANTITY}"


def figure_of(raw: Column) -> list[Column]:
    """unit and value of a quantity as it is written, in its family's unit."""
    mark = F.translate(F.regexp_extract(raw, PATTERN, 3), "²³", "23")
    unit = F.lower(F.concat(F.regexp_extract(raw, PATTERN, 2), mark))
    value = F.replace(F.regexp_extract(raw, PATTERN, 1), F.lit(","), F.lit(".")).cast("double")
    return [unit_family(unit).alias("unit"), to_family_unit(value, unit).alias("value")]


def figures(text: Column) -> Column:
    """Array of (unit, value): measurements() without the words."""
    return F.transform(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), lambda r: F.struct(*figure_of(r)))


def measurements(text: Column, around: int = 70) -> Column:
    """Array of (unit, value, raw, context): each quantity in its family's unit, and the words about it.

    What all quantities of a text share is bound once: a lambda would compute it again for each of them.
    """

    def of(text: Column, raw: Column, gaps: Column) -> Column:
        def one(r: Column, i: Column) -> Column:
            # the text between the matches gives the place of each
            own = F.aggregate(F.slice(raw, F.lit(1), i), F.lit(0), lambda s, x: s + F.length(x))
            before = F.aggregate(F.slice(gaps, F.lit(1), i + 1), own, lambda s, x: s + F.length(x))

            def context(before: Column) -> Column:
                low = F.greatest(before - around, F.lit(0))
                window = F.substring(text, low + 1, before - low + F.length(r) + around)
                return F.filter(F.array_distinct(T.stems(window)), lambda t: F.length(t) >= 3)

            return F.struct(*figure_of(r), T.normal_space(r).alias("raw"), T.let(before, context).alias("context"))

        return F.transform(raw, one)

    whole = T.let(text, lambda x: T.let(F.regexp_extract_all(x, F.lit(PATTERN), F.lit(0)), lambda raw: T.let(F.split(x, PATTERN), lambda gaps: of(x, raw, gaps))))
    return whole


def quantities(found: Column) -> Column:
    """Map unit -> first value of measurements() or figures()."""

    def firsts(found: Column, units: Column) -> Column:
        return F.map_from_arrays(
            units, F.transform(units, lambda u: F.get(F.filter(found, lambda m: m["unit"] == u), F.lit(0))["value"])
        )

    return T.let(found, lambda x: T.let(F.array_distinct(x["unit"]), lambda units: firsts(x, units)))
