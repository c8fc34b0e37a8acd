"""Search predicates as boolean columns; an empty argument means no restriction."""

from pyspark.sql import Column, functions as F

from ..lexicons import ANY_BAND, BAND_ALIASES, EXPERIENCE_BANDS
from .text import all_true, contains_any, like_literal, text

INTERN_TITLE = "(?i)인턴|intern"


def band_of(label, aliases=BAND_ALIASES) -> Column:
    """Labels as shown to people, mapped to band names; unknown labels stay."""
    c = F.col(label) if isinstance(label, str) else label
    out = c
    for shown, name in aliases.items():
        out = F.when(c == shown, name).otherwise(out)
    return out


def in_band(band: str, experience="experience", bands=EXPERIENCE_BANDS) -> Column:
    """Experience band test. Without a parsed minimum the text decides.

    An open maximum counts as equal to the minimum here, unlike in `max_years`.
    """
    band = BAND_ALIASES.get(band, band)
    if band == ANY_BAND or band not in bands:
        return F.lit(True)
    low, high, words = bands[band]
    floor = F.col("min_exp")
    ceiling = F.coalesce(F.col("max_exp"), floor)
    by_number = (floor == -1) | ((floor <= high) & (ceiling >= low))
    by_text = contains_any(experience, words) if experience else F.lit(False)
    return F.when(floor.isNotNull(), by_number).otherwise(by_text)


def is_intern_title(title="title") -> Column:
    return text(title).rlike(INTERN_TITLE)


def is_intern(title="title", keyword="keyword", experience="experience") -> Column:
    legs = [is_intern_title(title), text(keyword).contains("인턴")]
    if experience:
        legs.append(text(experience).contains("인턴"))
    out = legs[0]
    for leg in legs[1:]:
        out = out | leg
    return out


def has_tech(techs, column="tech_stack") -> Column:
    wanted = F.array(*[F.lit(t.lower()) for t in techs])
    have = F.transform(F.coalesce(F.col(column), F.array().cast("array<string>")), F.lower)
    return F.arrays_overlap(have, wanted)


def keyword_in(keyword: str, column="_search_text", regex=False) -> Column:
    low = F.lower(text(column))
    return low.rlike(keyword.lower()) if regex else low.contains(keyword.lower())


def combined(
    keyword="",
    sources=None,
    locations=None,
    experience=ANY_BAND,
    tech_stack=None,
    intern_only=False,
    regex=False,
    experience_text="experience",
) -> Column:
    """AND of all given restrictions; intern_only turns the experience band off."""
    parts = []
    if sources:
        parts.append(F.col("source").isin(*sources))
    if keyword:
        parts.append(keyword_in(keyword, regex=regex))
    if locations:
        parts.append(contains_any("location", locations))
    if intern_only:
        parts.append(is_intern(experience=experience_text))
    elif experience != ANY_BAND:
        parts.append(in_band(experience, experience_text))
    if tech_stack:
        parts.append(has_tech(tech_stack))
    return all_true(parts)


def at_least_open(max_years: int) -> Column:
    """Stored-table form: the posting asks for at most so many years, or states none."""
    return F.col("min_exp").isNull() | (F.col("min_exp") <= max_years)


def at_most_open(years: int) -> Column:
    """Stored-table form: an open maximum counts as unbounded."""
    return F.col("max_exp").isNull() | (F.col("max_exp") >= years)


def table_filter(sources=None, location=None, min_exp=None, max_exp=None, keyword=None) -> Column:
    parts = []
    if sources:
        parts.append(F.col("source").isin(*sources))
    if location:
        parts.append(like_literal("location", location))
    if min_exp is not None:
        parts.append(at_least_open(min_exp))
    if max_exp is not None:
        parts.append(at_most_open(max_exp))
    if keyword:
        parts.append(
            like_literal("title", keyword)
            | like_literal("description", keyword)
            | like_literal("company", keyword)
        )
    return all_true(parts)
