import json
import random

import pyarrow as pa
from pyspark.sql import functions as F

from postloom.functions import html as pages_of
from postloom.sources import feeds, html_feeds, json_feeds


def landed(spark, *payloads, label="개발"):
    rows = [(p if isinstance(p, str) else json.dumps(p, ensure_ascii=False), label) for p in payloads]
    return spark.createDataFrame(rows, "payload string, label string")


def page(spark, html, label="개발", url="https://list/page"):
    return spark.createDataFrame([(url, html, label, False)], "url string, html string, label string, intern boolean")


def rows(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def test_wanted(spark):
    reply = {"data": [
        {"id": 7, "position": " 백엔드 ", "company": {"name": "A"}, "address": {"location": "서울"}, "experience_level": {"display": "신입"}, "due_time": ""},
        {"id": None, "position": "프론트", "company": None, "due_time": "2026-01-01"},
        {"id": 9, "position": ""},
    ]}
    got = rows(json_feeds.wanted(landed(spark, reply, "broken {")), "title", "company", "location", "experience", "deadline", "url", "source", "keyword")
    assert got == [
        ("백엔드", "A", "서울", "신입", "상시채용", "https://www.wanted.co.kr/wd/7", "원티드", "개발"),
        ("프론트", "", "", "", "2026-01-01", "", "원티드", "개발"),
    ]
    assert json_feeds.unreadable(landed(spark, reply, "broken {")).count() == 1


def test_jumpit(spark):
    job = lambda **k: {"id": 1, "title": "t", "companyName": "c"} | k
    reply = {"result": {"positions": [
        job(locations=["서울", "판교"], minCareer=1, maxCareer=3, closeDate="2026"), job(minCareer=0, maxCareer=0), job(minCareer=5), job(), job(title=""),
    ]}}
    got = rows(json_feeds.jumpit(landed(spark, reply)), "location", "experience", "deadline")
    assert got == [("서울, 판교", "1~3년", "2026"), ("", "신입", "상시채용"), ("", "5년 이상", "상시채용"), ("", "신입", "상시채용")]


def test_saramin_api(spark):
    reply = {"jobs": {"job": [
        {"url": "u", "expiration-date": "2026", "position": {"title": "t", "location": {"name": "l"}, "experience-level": {"name": "e"}}, "company": {"detail": {"name": "c"}}},
        {"url": "v"},
    ]}}
    got = rows(json_feeds.saramin(landed(spark, reply, label="SOC")), "title", "company", "location", "experience", "deadline", "url", "keyword")
    assert got == [("t", "c", "l", "e", "2026", "u", "SOC"), ("", "", "", "", "", "v", "SOC")]


def test_coupang(spark):
    reply = {"jobs": [
        {"id": 1, "title": "Backend", "absolute_url": "http://x", "departments": [{"name": "Eng"}], "offices": [{"name": "Seoul"}]},
        {"id": 2, "title": "Manager", "departments": [{"name": "Data"}], "offices": []},
        {"id": 3, "title": "Cook", "departments": []},
        {"id": 4, "title": "SRE", "departments": []},
    ]}
    got = rows(json_feeds.coupang(landed(spark, reply)), "title", "location", "url", "keyword", "company")
    assert got == [
        ("Backend", "Seoul", "http://x", "Eng", "쿠팡"),
        ("Manager", "", "https://www.coupang.jobs/jobs/2", "Data", "쿠팡"),
        ("SRE", "", "https://www.coupang.jobs/jobs/4", "개발·기술", "쿠팡"),
    ]


def test_saramin_cards(spark):
    html = """<div class="list_item big"><div class="job_tit"><a class="str_tit" href="/v?id=1">웹 <b>개발</b></a></div>
      <div class="company_nm"><a class="str_tit">A &amp; B</a></div><p class="work_place">서울<p class="career">신입
      <div class="job_meta"><span class="job_sector"><span>a</span><span>b</span><span>c</span><span>d</span></span></div><span class="date">~05/30</span></div>
      <div class="list_item"><div class="job_tit"><a class="str_tit" href="http://o">시설보안 개발</a></div></div>
      <div class="list_item"><div class="job_tit"><a class="str_tit">서버</a></div></div>"""
    pages = page(spark, html, "84")
    got = rows(html_feeds.saramin(pages), "title", "company", "location", "experience", "deadline", "url", "keyword")
    assert got == [
        ("웹개발", "A & B", "서울", "신입", "~05/30", "https://www.saramin.co.kr/v?id=1", "a, b, c"),
        ("서버", "", "", "", "", "", "cat_84"),
    ]
    intern = pages.selectExpr("url", "html", "label", "true AS intern")
    assert rows(html_feeds.saramin(intern), "keyword") == [("a, b, c (인턴)",), ("cat_84 (인턴)",)]


def test_linkedin(spark):
    html = """<ul><li><h3 class="base-search-card__title"> Data Engineer </h3><h4 class="base-search-card__subtitle"><a>X</a></h4>
      <span class="job-search-card__location">Seoul</span><time datetime="2026-05-01">1 day</time><a class="base-card__full-link" href="http://l/1?a=b">.</a>
      <li><h3 class="base-search-card__title">Cook</h3></ul>"""
    got = rows(html_feeds.linkedin(page(spark, html)), "title", "company", "location", "deadline", "url")
    assert got == [("Data Engineer", "X", "Seoul", "2026-05-01", "http://l/1")]


def test_naver(spark):
    card = lambda title, dl, click="": f"<li class='card_item'><a class='card_link' onclick=\"{click}\"><h4 class='card_title'>{title}</h4></a><dl class='card_info'>{dl}</dl></li>"
    dd = lambda k, v: f"<dt>{k}</dt><dd class='info_text'>{v}</dd>"
    html = (
        card("Backend", dd("모집 부서", "Search") + dd("모집 분야", "Tech") + dd("모집 경력", "신입") + dd("모집 기간", "2026.01.01 ~ 2026.02.01"), "show('42')")
        + card("운영", dd("모집 분야", "보안"), "go('1')") + card("운영", dd("모집 부서", "Law")) + card("AI", dd("모집 기간", "채용시"))
    )
    got = rows(html_feeds.naver(page(spark, html)), "title", "experience", "deadline", "url", "keyword")
    assert got == [
        ("Backend", "신입", "2026.02.01", "https://recruit.navercorp.com/rcrt/view.do?annoId=42", "Search Tech"),
        ("운영", "", "", "", "보안"), ("AI", "", "채용시", "", "개발·기술"),
    ]


def test_jobkorea(spark):
    html = """<div class="rounded-2xl p-7"><div><a href="/Recruit/GI_Read/11"></a><a href="/Recruit/GI_Read/11?a">서버 개발</a><a href="/Recruit/GI_Read/11">회사</a></div>
      <span>이 문구는 서울 이라는 말이 들어 있지만 너무 길다</span><span>서울 강남구</span><span>경력 3년</span><em>05/30 마감</em></div>
      <section><a href="/Recruit/GI_Read/12">앱 개발</a></section><a href="/Recruit/GI_Read/13">웹</a><a href="/other">x</a>"""
    got = rows(html_feeds.jobkorea(page(spark, html)), "title", "company", "location", "experience", "deadline", "url")
    host = "https://www.jobkorea.co.kr/Recruit/GI_Read/"
    assert got == [("서버 개발", "회사", "서울 강남구", "경력 3년", "05/30", host + "11"), ("앱 개발", "", "", "", "", host + "12")]


def test_jobplanet(spark):
    html = """<a href="/job?posting_ids=1"><b>회사</b><i>웹 개발</i><i>3년 이상|서울</i></a><a href="http://z?posting_ids=2">앱 개발</a>
      <a href="?posting_ids=3"> </a><a href="/job?posting_ids=4"><b>웹 회사</b><i>요리사</i></a>"""
    got = rows(html_feeds.jobplanet(page(spark, html)), "title", "company", "location", "experience", "url")
    assert got == [("웹 개발", "회사", "서울", "3년 이상", "https://www.jobplanet.co.kr/job?posting_ids=1"), ("앱 개발", "", "", "", "http://z?posting_ids=2")]


def test_kakao(spark):
    html = """<ul><li><div class="area_info"><h3 class="tit_jobs">A</h3><dl class="item_subinfo"><dd>뱅크</dd></dl><dl class="list_info"><dd>2026</dd><dd>제주</dd></dl></div><a href="/jobs/1">go</a></li></ul>
      <a href="/x/2"><div class="area_info"><h4 class="tit_jobs">B</h4></div></a><div class="area_info"><h4 class="tit_jobs">C</h4></div><div class="area_info"></div>"""
    got = rows(html_feeds.kakao(page(spark, html)), "title", "company", "location", "deadline", "url")
    assert got == [
        ("A", "뱅크", "제주", "2026", "https://careers.kakao.com/jobs/1"),
        ("B", "카카오", "판교", "상시채용", "https://careers.kakao.com/x/2"), ("C", "카카오", "판교", "상시채용", "https://list/page"),
    ]


def test_toss(spark):
    li = lambda title, more: f'<li class="css-1lnizc9"><p data-desktop-list-item-title>{title}</p>{more}</li>'
    html = (
        '<a href="/career/1">' + li("Server Developer", "<span>정규직</span><span>" + "가" * 60 + "</span><em>뱅크</em>") + "</a>"
        + li("Designer", "<span>데이터</span><a href='http://q'>증권</a>") + li("Cook", "<span>x</span>")
    )
    got = rows(html_feeds.toss(page(spark, html)), "title", "company", "url", "keyword")
    assert got == [
        ("Server Developer", "뱅크", "https://toss.im/career/1", ("정규직 · " + "가" * 60)[:50]), ("Designer", "증권", "http://q", "데이터"),
    ]


def test_rallit(spark):
    html = (
        "<article><a href='/positions/1'><h3>백엔드</h3></a><span>백엔드</span><p>회사</p></article>"
        "<a href='/p/2'><article><p>short</p><p>" + "길" * 90 + "</p></article></a><article><h2>ab</h2></article><article></article>"
        "<article><h2></h2><p>long enough</p></article>"
    )
    got = rows(html_feeds.rallit(page(spark, html)), "title", "company", "url")
    assert got == [("백엔드", "회사", "https://www.rallit.com/positions/1"), ("길" * 80, "short", "https://www.rallit.com/p/2")]


def test_scripts_and_comments_are_no_text(spark):
    html = "<article><h2>a<!-- x -->b<script>no()</script> c</h2></article>"
    assert rows(html_feeds.rallit(page(spark, html)), "title") == [("abc",)]


def test_union_and_selection(spark, raw):
    one, two = raw({"source": "원티드"}), raw({"source": "토스"}).drop("ingest_seq")
    every = feeds.union_feeds(one, two)
    assert every.count() == 2
    assert feeds.only_sites(every, ["토스"]).count() == 1 and feeds.only_sites(every).count() == 2


def test_reads_and_rejects_are_all_that_landed(spark):
    good = '{"id": "1", "position": "Dev"}'
    rows = [
        (0, '{"data": [%s, null, {"id": "2"}, {"id": "3", "position": "  "}, {"position": "Ops", "company": null}]}' % good),
        (1, '{"data": [' + good), (2, "[]"), (3, '{"data": "none"}'), (4, '{"data": null}'), (5, None), (6, ""), (7, '{"data": []}'), (8, '{"data": [7, %s]}' % good),
    ]
    landed = spark.createDataFrame(rows, "page int, payload string").withColumn("label", F.lit("x"))
    got = {(r.page, r.nth): r.reason for r in json_feeds.rejects(landed, "wanted").collect()}
    assert got == {
        (0, 1): "null record", (0, 2): "no title", (1, None): "not json", (2, None): "wrong shape", (3, None): "wrong shape",
        (4, None): "wrong shape", (5, None): "not json", (6, None): "not json", (8, 0): "wrong record",
    }
    read = json_feeds.wanted(landed)
    assert sorted(r.title for r in read.collect()) == ["", "Dev", "Dev", "Ops"]  # a title of blanks is read, as blank
    # five records of page 0 and two of page 8
    assert read.count() + sum(nth is not None for _, nth in got) == 7
    for feed in json_feeds.SHAPES:
        assert json_feeds.rejects(landed.where("page = 1"), feed).count() == 1
        assert json_feeds.rejects(landed.limit(0), feed).count() == 0


def random_page(rng, tags=120):
    out = []
    for _ in range(tags):
        tag, cls = rng.choice("div ul li a span p br dl dt dd".split()), rng.choice(["", "x", "x y", "card"])
        out.append(rng.choice([f'<{tag} class="{cls}" href="/jobs/{rng.randint(1, 9)}">', f"</{tag}>", f"<{tag}>", "word &amp; more", "<!-- no -->"]))
    return "".join(out)


def test_cards_from_the_parser_equal_those_from_whole_pages(spark):
    """Cards, holders and the nearest item against their definitions over all nodes of a page."""
    rng = random.Random(11)
    pages = spark.createDataFrame([(i, random_page(rng)) for i in range(150)] + [(998, ""), (999, None)], "page int, html string").coalesce(2)
    path = [{"tag": "div li", "cls": "x"}, {"tag": "a", "href": "/jobs/"}]
    whole = {r.page: [n.asDict() for n in r.nodes] for r in pages_of.with_nodes(pages).collect()}
    assert sorted(whole) == [*range(150), 998, 999] and whole[998] == whole[999] == []
    want = []
    for page_no, nodes in whole.items():
        outer = [n for n in nodes if n["tag"] in ("div", "li") and "x" in n["classes"]]
        for n in nodes:
            if n["tag"] == "a" and "/jobs/" in n["attrs"].get("href", "") and any(o["pos"] < n["pos"] <= o["last"] for o in outer):
                around = [o for o in reversed(nodes) if o["pos"] < n["pos"] <= o["last"]]
                item = next((o for o in around if o["tag"] == "li"), None)
                within = [m["pos"] for m in nodes if item and item["pos"] < m["pos"] <= item["last"]]
                want.append((page_no, n["pos"], [m["pos"] for m in nodes if n["pos"] < m["pos"] <= n["last"]], [o["pos"] for o in around], within))
    for most in (5, 20_000):  # many small batches, and one
        saved, pages_of.BATCH_NODES = pages_of.BATCH_NODES, most
        try:
            got = pages_of.cards(pages, *path, item="li").selectExpr(
                "page", "card.pos AS pos", "transform(sub, n -> n.pos) AS sub", "transform(around, n -> n.pos) AS around", "transform(within, n -> n.pos) AS within"
            ).collect()
        finally:
            pages_of.BATCH_NODES = saved
        assert sorted(map(tuple, got)) == sorted(want) and len(want) > 50
    rows = pages_of.with_nodes(pages).select("page", F.explode(F.transform(pages_of.select(F.col("nodes"), *path), lambda n: F.struct(n["pos"].alias("pos"), F.transform(pages_of.holders(F.col("nodes"), n, 3), lambda h: h["pos"]).alias("h")))).alias("c"))
    assert sorted((r.page, r.c.pos, r.c.h) for r in rows.collect()) == sorted((w[0], w[1], w[3][:3]) for w in want)


def test_pages_leave_the_parser_in_bounded_batches():
    """One batch of 300 pages: each batch handed on holds a bound of nodes and one page's more, and none is lost."""
    card = '<div class="list_item"><a href="/x">title</a><p>' + "text " * 20 + "</p></div><p>" + "around " * 10 + "</p>"
    page_text = card * (20_000 // len(card))
    per_page = len(pages_of._parse(page_text))
    given = pa.record_batch({"id": list(range(300)), "html": [page_text] * 300})
    seen, sizes = [], []
    for out in pages_of._parse_batches(iter([given]), "html", ["id"], ["nodes"], lambda nodes: [(nodes,)]):
        seen += out.column("id").to_pylist()
        sizes.append(len(out.column("nodes").flatten()))
    assert seen == list(range(300)) and sum(sizes) == 300 * per_page
    assert max(sizes) < pages_of.BATCH_NODES + per_page and len(sizes) > 5


def test_plain_pages_are_read_as_the_full_parser_reads_them():
    rng = random.Random(11)
    marks = [
        "<div>", '<div class="a b">', "</div>", "<p>", "</p>", "<li>", "</LI>", "<ul>", "</ul>", "<dd>", "<dt>", "<dl>", "</dl>", "<BR>", "<br/>", "<p/>",
        '<a href="/x?a=1&amp;b=2" class="">', "</a>", "<a href='q\"r>' title>", '<img src="i>.png" />', "text", " a &lt; b ", "&amp", "&", "<!-- note -->",
        "<!doctype html>", "<script>x && y</script>", "<style>", "</style>", "<template>", "</template>", "\n", '<a X="1" x="2\n3">', '<b a="&#x41;" b>',
    ]
    odd = ["<", "<a b=c>", "<a  =x>", "<!--->", "<!-- a -- b -->", "</a b>", "<script>if (a<b)</script>", "</ a>", "<?pi?>", '<a b="c"d="e">', "<a\tb>", "<x", "</>", '<a b="']
    quick, known = 0, {}
    for i in range(3000):
        page = "".join(rng.choices(marks + odd if i % 3 == 0 else marks, k=rng.randrange(12)))
        got = pages_of._plain(page, known)
        want = pages_of._flat(page)
        quick += got is not None
        assert got is None or [[*n[:4], list(n[4]), *n[5:]] for n in got] == [[*n[:4], list(n[4]), *n[5:]] for n in want], page
    assert quick > 1500


def test_only_what_a_feed_asks_for_leaves_the_parser(spark):
    """Columns and fields that are not asked for are not moved; those that are hold what the whole ones hold."""
    rng = random.Random(5)
    pages = spark.createDataFrame([(i, random_page(rng)) for i in range(60)] + [(61, None)], "page int, html string").coalesce(2)
    path = [{"tag": "div li", "cls": "x"}, {"attr": "href"}]
    whole = pages_of.cards(pages, *path, item="li")
    asked = {"card": ("attrs",), "sub": ("text", "tag"), "within": ("last", "classes", "pos")}
    some = pages_of.cards(pages, *path, item="li", fields=asked)
    assert some.columns == ["page", "card", "sub", "within"] and some.schema["card"].dataType.names == ["attrs"]
    assert some.schema["sub"].dataType.elementType.names == ["tag", "text"]
    shown = ["page", "card.attrs", "sub.tag", "sub.text", "within.pos", "within.last", "within.classes"]
    want = sorted(map(str, whole.select(*shown).collect()))
    assert sorted(map(str, some.select(*shown).collect())) == want and len(want) > 50
    # as the feed of links asks for them
    moved = html_feeds.jobplanet(page(spark, "<a href='/job?posting_ids=1'><i>개발</i></a>"))._jdf.queryExecution().analyzed().toString()
    assert "parent" not in moved and "around" not in moved


def test_nodes_of_a_page_are_held_in_columns():
    """No object of its own for a node: what the garbage collector goes through does not grow with the page."""
    for parse in (pages_of._flat, lambda p: pages_of._plain(p, {})):
        nodes = parse("<p>a</p>" * 1000)
        assert len(nodes) == 2000 and nodes[1999] == [2000, 2000, 1999, "#text", (), {}, "a"]
        assert not isinstance(nodes, list) and [len(c) for c in vars(nodes).values()] == [2000] * 5


def test_segments_of_odd_texts(spark):
    html = "<a href='/x?posting_ids=1'>\u3000|<b> a | b||</b>\xa0<i>|</i> 개발 |c\u2003</a>"
    got = pages_of.cards(page(spark, html), {"tag": "a"}).select(pages_of.segments(F.col("sub")).alias("s")).head().s
    assert got == ["a", "b", "개발", "c"]
