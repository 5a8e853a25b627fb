"""Label standardisation: states, vehicle classes, fuels, monthly category columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from uptake.functions.text import contains_any, squeeze, strip, title_case

# Spellings of state names (lower case) and the name they stand for.
STATE_NAMES = {
    "andaman and nicobar island": "Andaman And Nicobar Islands",
    "andaman and nicobar islands": "Andaman And Nicobar Islands",
    "dadra and nagar haveli and daman and diu": "Dadra And Nagar Haveli And Daman And Diu",
    "jammu and kashmir": "Jammu And Kashmir",
    "nct of delhi": "Delhi",
    "ut of dnh and dd": "Dadra And Nagar Haveli And Daman And Diu",
}

ALL_VEHICLES = "All Vehicles"

# Wheel category rules, first match wins: label, whole texts, fragments, and the
# fragments that only the default variant knows.
WHEEL_RULES = (
    (ALL_VEHICLES, (), ("all vehicle",), ()),
    ("2W", ("2w",), ("two wheeler",), ()),
    ("3W Passenger", (), ("3w passenger",), ("three wheeler (passenger",)),
    ("3W Goods", (), ("3w goods",), ("three wheeler (goods",)),
    ("Cars", (), ("car", "cab"), ()),
    ("Buses", (), ("bus",), ()),
    ("Goods Vehicles", (), ("lgv", "mgv", "hgv", "tonnes"), ()),
    ("Others", (), ("other",), ()),
)

# Monthly category rules: fragments, then the label of each style.
MONTHLY_RULES = (
    (("2w", "2 w", "two"), {"plain": "2W", "prefixed": "Electric 2W"}),
    (("3w", "3 w", "three"), {"plain": "3W", "prefixed": "Electric 3W"}),
    (("4w", "4 w", "car"), {"plain": "Cars", "prefixed": "Electric Cars"}),
    (("goods",), {"plain": "Goods Vehicles", "prefixed": "Electric Goods"}),
    (("bus",), {"plain": "Buses", "prefixed": "Electric Bus"}),
)

# Fuel labels (lower case) that mean battery electric.
EV_FUELS = ("electric", "electric (bov)", "electric bov", "electric(bov)", "ev")
EV_FUELS_COMPACT = ("electric", "electric(bov)", "electricbov", "ev")


def state_name(text: Column, style: str = "spaced") -> Column:
    """Canonical state name.

    ``spaced``: ``A&B`` reads as ``A and B``. ``joined``: as ``AandB``. Known spellings map to one
    name, everything else is title-cased. NULL stays NULL.
    """
    if style not in ("spaced", "joined"):
        raise ValueError(f"unknown state name style: {style}")
    amp = " and " if style == "spaced" else "and"
    tidy = squeeze(F.replace(text, F.lit("&"), F.lit(amp)))
    known = F.create_map(*[F.lit(part) for pair in STATE_NAMES.items() for part in pair])
    return F.coalesce(F.try_element_at(known, F.lower(tidy)), title_case(tidy))


def wheel_category(text: Column, aliases: bool = True) -> Column:
    """Vehicle class label. ``aliases`` adds the long three wheeler spellings."""
    tidy = strip(text)
    low = F.lower(tidy)
    label = F.when(low.isNull(), F.lit(None).cast("string"))
    for name, whole, fragments, extra in WHEEL_RULES:
        hit = contains_any(low, fragments + (extra if aliases else ()))
        if whole:
            hit = hit | low.isin(*whole)
        label = label.when(hit, F.lit(name))
    return label.otherwise(title_case(tidy))


def monthly_category(text: Column, style: str = "plain") -> Column:
    """Category label of a monthly column name; ``prefixed`` keeps the word Electric in it."""
    if style not in ("plain", "prefixed"):
        raise ValueError(f"unknown category style: {style}")
    spaced = strip(F.replace(text, F.lit("_"), F.lit(" ")))
    low = strip(F.replace(F.lower(spaced), F.lit("electric"), F.lit("")))
    label = F.when(low.isNull(), F.lit(None).cast("string"))
    for fragments, names in MONTHLY_RULES:
        label = label.when(contains_any(low, fragments), F.lit(names[style]))
    return label.otherwise(title_case(spaced))


def fuel_label(text: Column, style: str = "title") -> Column:
    """Fuel text in one of four styles.

    ``title``: squeezed and title-cased. ``compact``: lower case without spaces. ``trimmed``: only
    the ends cleaned. ``raw``: as it is.
    """
    if style == "title":
        return title_case(squeeze(text))
    if style == "compact":
        return F.replace(F.lower(strip(text)), F.lit(" "), F.lit(""))
    if style == "trimmed":
        return strip(text)
    if style == "raw":
        return text
    raise ValueError(f"unknown fuel style: {style}")


def is_ev_fuel(text: Column, match: str = "squeezed") -> Column:
    """True for battery electric fuel labels; hybrids and NULL are false.

    ``squeezed`` ignores repeated white space, ``compact`` ignores every space, ``exact`` only the
    ends. A hybrid label is never in the list, so no separate test is needed.
    """
    if match == "squeezed":
        return F.coalesce(F.lower(squeeze(text)).isin(*EV_FUELS), F.lit(False))
    if match == "compact":
        return F.coalesce(fuel_label(text, "compact").isin(*EV_FUELS_COMPACT), F.lit(False))
    if match == "exact":
        return F.coalesce(F.lower(strip(text)).isin(*EV_FUELS), F.lit(False))
    raise ValueError(f"unknown fuel match: {match}")
