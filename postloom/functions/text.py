"""Text expressions used all over: every function takes and returns a Column."""

from functools import reduce

from pyspark.sql import Column, functions as F

from ..lexicons import IT_TITLE_TERMS, NON_IT_TITLE_TERMS, TECH_KEYWORDS

SPACE = r"(?U)\s+"
# what (?U)\s matches
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, also where lambdas in `use` refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c) -> Column:
    """Trim every Unicode whitespace character, not only the ASCII space."""
    return F.btrim(col(c), F.lit(SPACES))


def text(c) -> Column:
    return F.coalesce(col(c), F.lit(""))


def clean(c) -> Column:
    """Trimmed text; null and the word nan in any case become blank."""
    trimmed = strip(text(c))
    return F.when(F.lower(trimmed) == "nan", "").otherwise(trimmed)


def or_default(c, default) -> Column:
    """The value unless it is null or empty."""
    default = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(col(c), F.lit("")), default)


def is_blank(c) -> Column:
    return strip(text(c)) == ""


def _holds(t: Column, terms) -> Column:
    """Plain searches: each goes through the bytes of a text at once, a pattern tries all its terms at every character."""
    return reduce(lambda a, b: a | b, [F.contains(t, F.lit(term)) for term in terms])


def contains_any(c, terms) -> Column:
    return let(text(c), lambda t: _holds(t, terms)) if terms else F.lit(False)


def is_it_title(title, white=IT_TITLE_TERMS, black=NON_IT_TITLE_TERMS) -> Column:
    # an empty list stands for the empty text, which every title holds
    return let(F.lower(text(title)), lambda t: ~_holds(t, black or [""]) & _holds(t, white or [""]))


def posting_uid(company="company", title="title", url="url") -> Column:
    """Never null, and known as such: rows dealt out by it stay in place where a null would be made blank."""
    parts = [strip(text(c)) for c in (company, title, url)]
    return text(F.sha2(F.concat_ws("|", *parts), 256))


def normalise(c) -> Column:
    """Lower-case words: signs other than + # . - become spaces, runs of spaces become one."""
    kept = F.regexp_replace(text(c), r"(?U)[^\p{L}\p{N}_\s+#.\-]", " ")
    return F.lower(strip(F.regexp_replace(kept, SPACE, " ")))


def search_text(*columns) -> Column:
    columns = columns or ("title", "company", "keyword", "experience")
    return normalise(F.concat_ws(" ", *[text(c) for c in columns]))


def words(c) -> Column:
    return F.filter(F.split(text(c), SPACE), lambda w: w != "")


def token_sorted(c) -> Column:
    return F.array_join(F.array_sort(words(c)), " ")


def years(c) -> tuple[Column, Column]:
    """(min, max) years of experience; the first rule that matches decides.

    0 stands for entry level, -1 for any, null for unstated.
    """
    t = text(c)
    span = r"(?U)([0-9]+)\s*[~\-]\s*([0-9]+)\s*년"
    least = r"(?U)([0-9]+)\s*년\s*(?:이상|↑)"
    exact = r"(?U)경력\s*([0-9]+)\s*년"
    rules = (
        (span, lambda g: (g(1), g(2))),
        (least, lambda g: (g(1), F.lit(None))),
        (exact, lambda g: (g(1), g(1))),
        ("신입", lambda g: (F.lit(0), F.lit(0))),
        ("무관", lambda g: (F.lit(-1), F.lit(-1))),
    )
    low = high = F.lit(None).cast("int")
    for pattern, pick in reversed(rules):
        hit = t.rlike(pattern)
        a, b = pick(lambda i, p=pattern: F.regexp_extract(t, p, i).try_cast("int"))
        low = F.when(hit, a.cast("int")).otherwise(low)
        high = F.when(hit, b.cast("int")).otherwise(high)
    return low, high


def experience_source(experience="experience", title="title") -> Column:
    return F.when(is_blank(experience), text(title)).otherwise(text(experience))


def tech_stack(c, keywords=TECH_KEYWORDS) -> Column:
    """Keywords found with no ASCII letter on either side, in keyword order.

    The plain substring test runs first, so that a pattern is only tried where it can match.
    """
    t = text(c)
    low = F.translate(F.lower(t), "ſ", "s")

    def found(v, k: str) -> Column:
        # a literal pattern is compiled once
        pattern = rf"(?iu)(?<![a-zA-Z])\Q{k}\E(?![a-zA-Z])"
        return F.when(F.contains(v["low"], F.lit(k.lower())) & F.rlike(v["text"], F.lit(pattern)), F.lit(k))

    return let(F.struct(t.alias("text"), low.alias("low")), lambda v: F.array_compact(F.array(*[found(v, k) for k in keywords])))


def absolute_url(href, host: str) -> Column:
    h = text(href)
    return F.when(h.startswith("/"), F.concat(F.lit(host), h)).otherwise(h)


def like_literal(c, needle: str) -> Column:
    """Case-insensitive containment with % and _ taken literally."""
    escaped = needle.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")
    return col(c).ilike(f"%{escaped}%")


def all_true(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
