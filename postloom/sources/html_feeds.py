"""Landed pages of the job sites as raw postings.

Input: one page per row, columns `url` and `html`; `label` is the search the page came from. Each
function turns pages into cards and cards into rows of the raw schema. Rules are column
expressions over the page's nodes.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.html import (
    SELECTED, attr_of, below, cards, first, holders, is_el, once, raw_length, segments, select, text_of, texts_of, with_nodes,
)
from ..functions.text import absolute_url, contains_any, is_it_title, let, or_default, strip, text
from ..lexicons import (
    ALWAYS_OPEN, CARD_DATE_PATTERN, CARD_EXPERIENCE_PATTERN, DEV_LABEL, LINK_EXPERIENCE_PATTERN, NAVER_TERMS,
    REGION_PATTERN, TOSS_TERMS,
)
from .json_feeds import raw_posting

AROUND = {"sub": SELECTED, "around": SELECTED}
LINKS = {"sub": SELECTED, "around": ("tag", "attrs"), "within": ("tag", "attrs")}


def found(nodes: Column, *path, **last) -> Column:
    """Text of the first node on the path, blank if there is none."""
    return text(text_of(nodes, first(select(nodes, *path, **last))))


def href_of(node: Column) -> Column:
    return text(attr_of(node, "href"))  # blank if there is no node; one that is named twice would be looked for twice


def first_match(parts: Column, pattern: str, shorter_than: int | None = None) -> Column:
    def test(p):
        return p.rlike(pattern) & (F.length(p) < shorter_than) if shorter_than else p.rlike(pattern)

    return text(first(F.filter(parts, test)))


def saramin(pages: DataFrame) -> DataFrame:
    """`label` is the category, `intern` marks the intern listing."""
    sub = F.col("sub")
    link = first(select(sub, {"tag": "div", "cls": "job_tit"}, {"tag": "a", "cls": "str_tit"}))
    sectors = select(
        sub, {"tag": "div", "cls": "job_meta"}, {"tag": "span", "cls": "job_sector"}, {"tag": "span"}
    )
    rows = once(
        cards(pages, {"tag": "div", "cls": "list_item"}, fields={"sub": SELECTED}),
        t=text(text_of(sub, link)), href=href_of(link), s=texts_of(sub, F.slice(sectors, 1, 3)),
    ).where(is_it_title("t"))
    base = F.when(F.size("s") > 0, F.array_join("s", ", ")).otherwise(F.concat(F.lit("cat_"), F.col("label")))
    return raw_posting(
        rows, "사람인",
        title=F.col("t"),
        company=found(sub, {"tag": "div", "cls": "company_nm"}, {"tag": "a", "cls": "str_tit"}),
        location=found(sub, tag="p", cls="work_place"),
        experience=found(sub, tag="p", cls="career"),
        deadline=found(sub, tag="span", cls="date"),
        url=absolute_url("href", "https://www.saramin.co.kr"),
        keyword=F.when(F.col("intern"), F.concat(base, F.lit(" (인턴)"))).otherwise(base),
    )


def linkedin(pages: DataFrame) -> DataFrame:
    """The date found is the day of posting; it is kept as deadline, as the feed always did."""
    sub = F.col("sub")
    rows = once(
        cards(pages, {"tag": "li"}, fields={"sub": SELECTED}), t=found(sub, tag="h3", cls="base-search-card__title")
    ).where(is_it_title("t"))
    return raw_posting(
        rows, "링크드인",
        title=F.col("t"),
        company=found(sub, {"tag": "h4", "cls": "base-search-card__subtitle"}, {"tag": "a"}),
        location=found(sub, tag="span", cls="job-search-card__location"),
        deadline=attr_of(first(select(sub, tag="time")), "datetime"),
        url=F.substring_index(href_of(first(select(sub, tag="a", cls="base-card__full-link"))), "?", 1),
        keyword=F.col("label"),
    )


def naver(pages: DataFrame, terms=NAVER_TERMS) -> DataFrame:
    sub = F.col("sub")
    info = [{"tag": "dl", "cls": "card_info"}, {"tag": "dd", "cls": "info_text"}]
    rows = once(
        cards(pages, {"tag": "li", "cls": "card_item"}, fields={"sub": SELECTED}),
        t=found(sub, tag="h4", cls="card_title"),
        about=F.lower(F.array_join(texts_of(sub, select(sub, *info)), " ")),
        dl=below(sub, first(select(sub, tag="dl", cls="card_info"))),
        onclick=text(attr_of(first(select(sub, tag="a", cls="card_link")), "onclick")),
    )
    rows = rows.where((F.col("t") != "") & (contains_any(F.lower("t"), terms) | contains_any("about", terms)))
    dl = F.coalesce("dl", F.array().cast(rows.schema["sub"].dataType))
    rows = rows.select(
        "*", texts_of(dl, select(dl, tag="dt")).alias("names"), texts_of(dl, select(dl, tag="dd", cls="info_text")).alias("values")
    )
    pairs = F.slice(F.arrays_zip("names", "values"), F.lit(1), F.least(F.size("names"), F.size("values")))

    def entry(name):
        return text(F.try_element_at(F.filter(pairs, lambda p: p["names"] == name), F.lit(-1))["values"])

    number = F.regexp_extract("onclick", r"show\('([0-9]+)'\)", 1)
    return raw_posting(
        rows, "네이버",
        title=F.col("t"), company=F.lit("네이버"), location=F.lit("성남"),
        experience=entry("모집 경력"),
        deadline=F.substring_index(entry("모집 기간"), "~", -1),
        url=F.when(number == "", "").otherwise(F.concat(F.lit("https://recruit.navercorp.com/rcrt/view.do?annoId="), number)),
        keyword=or_default(strip(F.concat_ws(" ", entry("모집 부서"), entry("모집 분야"))), DEV_LABEL),
    )


def jobkorea(pages: DataFrame) -> DataFrame:
    """All links to one posting belong together: the first with text is the title, the second the company."""
    mark = "/Recruit/GI_Read/"

    def is_card(n):
        names = F.array_join(n["classes"], " ")
        return names.contains("rounded-2xl") & (names.contains("shadow") | names.contains("p-7"))

    def card_parts(nodes, link):
        card = first(F.filter(holders(nodes, link, 8), is_card))
        return F.coalesce(segments(below(nodes, card)), F.array().cast("array<string>"))

    def posting(nodes, own):
        return F.struct(
            first(own)["number"].alias("number"),
            first(own)["text"].alias("t"),
            text(F.get(own, F.lit(1))["text"]).alias("c"),
            card_parts(nodes, first(own)).alias("parts"),
        )

    def postings(nodes):
        links = F.transform(
            select(nodes, tag="a", href=mark),
            lambda a: F.struct(
                a["pos"].alias("pos"), a["last"].alias("last"),
                F.regexp_extract(attr_of(a, "href"), mark + "([0-9]+)", 1).alias("number"), text_of(nodes, a).alias("text"),
            ),
        )
        speaking = F.filter(links, lambda l: (l["number"] != "") & (l["text"] != ""))
        groups = let(
            speaking,
            lambda ls: F.transform(
                F.array_distinct(F.transform(ls, lambda l: l["number"])),
                lambda number: F.filter(ls, lambda l: l["number"] == number),
            ),
        )
        return F.transform(groups, lambda own: posting(nodes, own))

    page = with_nodes(pages)
    rows = page.select(*[c for c in page.columns if c != "nodes"], F.explode(postings(F.col("nodes"))).alias("p"))
    rows = rows.where((F.length("p.t") >= 3) & is_it_title(F.col("p.t")))
    parts = F.col("p.parts")
    return raw_posting(
        rows, "잡코리아",
        title=F.col("p.t"), company=F.col("p.c"),
        location=first_match(parts, REGION_PATTERN, 25),
        experience=first_match(parts, CARD_EXPERIENCE_PATTERN, 20),
        deadline=F.replace(first_match(parts, CARD_DATE_PATTERN), F.lit("마감"), F.lit("")),
        url=F.concat(F.lit("https://www.jobkorea.co.kr/Recruit/GI_Read/"), F.col("p.number")),
        keyword=F.col("label"),
    )


def jobplanet(pages: DataFrame) -> DataFrame:
    links = cards(pages, {"tag": "a", "href": "posting_ids"}, fields={"card": ("attrs",), "sub": ("tag", "text")})
    rows = once(links, parts=segments(F.col("sub")))
    rows = rows.where(F.size("parts") > 0)
    alone = F.size("parts") == 1
    title = F.when(alone, F.get("parts", F.lit(0))).otherwise(F.get("parts", F.lit(1)))
    rest = F.slice(F.col("parts"), F.lit(3), F.size("parts"))
    href = href_of(F.col("card"))
    return raw_posting(
        rows.where(is_it_title(title)), "잡플래닛",
        title=title, company=F.when(alone, "").otherwise(F.get("parts", F.lit(0))),
        location=first_match(rest, REGION_PATTERN, 20),
        experience=first_match(rest, LINK_EXPERIENCE_PATTERN, 20),
        deadline=F.lit(ALWAYS_OPEN),
        url=F.when(href.startswith("http"), href).otherwise(F.concat(F.lit("https://www.jobplanet.co.kr"), href)),
        keyword=F.col("label"),
    )


def holder(tag: str) -> Column:
    """The nearest holder of a card with this tag."""
    return first(F.filter("around", lambda n: n["tag"] == tag))


def kakao(pages: DataFrame) -> DataFrame:
    """The card's own list item's job link counts, or else the link around the card."""
    inside = first(F.filter("within", lambda n: is_el(n, tag="a", href="/jobs/")))
    rows = cards(pages, {"tag": "div", "cls": "area_info"}, item="li", fields=LINKS).withColumn("href", href_of(F.coalesce(inside, holder("a"))))
    sub = F.col("sub")
    rows = once(rows, t=found(sub, tag="h3 h4", cls="tit_jobs")).where("t <> ''")
    facts = texts_of(sub, select(sub, {"tag": "dl", "cls": "list_info"}, {"tag": "dd"}))
    firm = texts_of(sub, select(sub, {"tag": "dl", "cls": "item_subinfo"}, {"tag": "dd"}))
    return raw_posting(
        rows, "카카오",
        title=F.col("t"), company=F.coalesce(first(firm), F.lit("카카오")),
        location=F.coalesce(F.get(facts, F.lit(1)), F.lit("판교")),
        deadline=F.coalesce(first(facts), F.lit(ALWAYS_OPEN)),
        url=or_default(absolute_url("href", "https://careers.kakao.com"), F.col("url")),
        keyword=F.col("label"),
    )


def toss(pages: DataFrame, terms=TOSS_TERMS, card_class="css-1lnizc9") -> DataFrame:
    own = first(F.filter("sub", lambda n: is_el(n, tag="a", attr="href")))
    rows = cards(pages, {"tag": "li", "cls": card_class}, fields=AROUND).withColumn("href", href_of(F.coalesce(holder("a"), own)))
    sub = F.col("sub")
    rows = once(
        rows,
        t=found(sub, tag="p", attr="data-desktop-list-item-title"),
        spans=F.array_join(texts_of(sub, select(sub, tag="span")), " "),
        parts=segments(sub),
    ).where("t <> ''")
    rows = rows.where(contains_any(F.lower(F.concat_ws(" ", "t", "spans")), terms))
    inner = F.slice(F.col("parts"), F.lit(2), F.greatest(F.size("parts") - 2, F.lit(0)))
    topic = F.substring(F.array_join(F.filter(inner, lambda p: p != F.col("t")), " · "), 1, 50)
    return raw_posting(
        rows, "토스",
        title=F.col("t"), company=F.coalesce(F.try_element_at("parts", F.lit(-1)), F.lit("토스")),
        location=F.lit("서울"), deadline=F.lit(ALWAYS_OPEN),
        url=or_default(absolute_url("href", "https://toss.im"), F.col("url")),
        keyword=or_default(topic, DEV_LABEL),
    )


def rallit(pages: DataFrame) -> DataFrame:
    own = first(F.filter("sub", lambda n: is_el(n, tag="a", href="/positions/")))
    rows = cards(pages, {"tag": "article"}, fields=AROUND).withColumn("href", href_of(F.coalesce(own, holder("a"))))
    sub = F.col("sub")
    heading = first(select(sub, tag="h2 h3 h4"))
    # the longest paragraph, the earlier one among equals
    by_length = F.array_sort(
        F.transform(
            select(sub, tag="p"),
            lambda p: F.struct((-raw_length(sub, p)).alias("n"), p["pos"].alias("pos"), text_of(sub, p).alias("t")),
        )
    )
    longest = F.substring(first(by_length)["t"], 1, 80)
    title = text(F.when(heading.isNotNull(), text_of(sub, heading)).otherwise(longest))
    rows = once(rows, t=title, names=texts_of(sub, select(sub, tag="span p"))).where(F.length("t") >= 3)
    firm = first(F.filter("names", lambda n: (n != F.col("t")) & (F.length(n) > 1) & (F.length(n) < 40)))
    return raw_posting(
        rows, "랠릿",
        title=F.col("t"), company=firm, deadline=F.lit(ALWAYS_OPEN),
        url=absolute_url("href", "https://www.rallit.com"), keyword=F.col("label"),
    )
