"""The registered queries. Each reads whole tables under `sf_dir`."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import codecs, filters
from ..functions.text import is_it_title, normalise, posting_uid, tech_stack, years, experience_source
from ..lexicons import SITES
from ..operators import dedup, expand, fuzzy, quality, refine, search, stats, upsert
from ..schema import RAW_COLUMNS, conform, to_display
from ..session import spread, work_path
from ..sources import feeds, files, html_feeds, json_feeds
from ..sources.store import PostingStore
from ..streaming import ingest as streaming
from .fixtures import (
    document_postings, fill, html_pages, json_pages, part_postings, postings, postings_from_orders, table,
)

QUERIES = {}
TERMS = 20_000  # the vocabulary size that the search queries ask for


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def enriched(spark, sf):
    return postings(spark, sf).transform(dedup.with_uid).transform(refine.enrich)


def flat(df: DataFrame) -> DataFrame:
    """Technology arrays as one text, so that results compare by value."""
    return df.withColumn("tech_stack", F.array_join("tech_stack", "|"))


# ---------------------------------------------------------------- cleaning and enrichment


@query
def raw_postings(spark, sf):
    return conform(postings(spark, sf).withColumn("extra", F.lit("dropped")))


@query
def csv_round_trip(spark, sf):
    folder = work_path(spark, "csv")
    files.save_csv(postings(spark, sf), folder, "listing_1.csv")
    files.save_csv(postings(spark, sf).where("company <> ''"), folder, "listing_2.csv")
    return files.newest_csv(spark, folder, "listing_*.csv").fillna("")


@query
def legacy_clean(spark, sf):
    p = postings(spark, sf)
    dirty = [
        F.when(F.col(c) == "", F.when(F.col("ingest_seq") % 2 == 0, "NaN")).otherwise(F.concat(F.lit(" "), c, F.lit(" "))).alias(c)
        for c in RAW_COLUMNS
    ]
    return refine.clean_columns(p.select("ingest_seq", *dirty))


@query
def it_title_filter(spark, sf):
    return postings(spark, sf).where(is_it_title("title")).select("ingest_seq", "title")


@query
def posting_uids(spark, sf):
    return postings(spark, sf).select("ingest_seq", posting_uid().alias("uid"))


@query
def experience_parse(spark, sf):
    low, high = years(experience_source())
    return postings(spark, sf).select("ingest_seq", low.alias("min_exp"), high.alias("max_exp"))


@query
def tech_extract(spark, sf):
    found = tech_stack(F.concat_ws(" ", "title", "keyword"))
    return postings(spark, sf).select("ingest_seq", F.array_join(found, "|").alias("tech_stack"))


@query
def tech_codecs(spark, sf):
    p = enriched(spark, sf)
    return p.select(
        "ingest_seq",
        F.array_join(codecs.decode_json(codecs.encode_json("tech_stack")), "|").alias("from_json_text"),
        F.array_join(codecs.decode_literal(codecs.encode_literal("tech_stack")), "|").alias("from_list_text"),
        F.size(codecs.decode_json("title")).alias("bad_json"),
        F.size(codecs.decode_literal("title")).alias("bad_list"),
    )


@query
def normalise_texts(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.sha2(normalise("text"), 256).alias("normal_sha"), F.length(normalise("text")).alias("normal_len"))


@query
def refine_postings(spark, sf):
    return flat(enriched(spark, sf)).select("ingest_seq", "uid", "min_exp", "max_exp", "tech_stack", "_search_text")


@query
def table_records(spark, sf):
    records = refine.to_records(enriched(spark, sf), F.lit("2026-05-12 14:27:55").cast("timestamp"))
    stamps = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("posted_date", "updated_at")}
    return records.withColumns(stamps).withColumn("tech_stack", codecs.encode_json("tech_stack"))


@query
def display_listing(spark, sf):
    return to_display(flat(enriched(spark, sf)))


# ---------------------------------------------------------------- duplicates


@query
def uid_dedup(spark, sf):
    return dedup.dedup_uid(dedup.with_uid(postings(spark, sf))).select("ingest_seq", "uid")


@query
def rule_dedup(spark, sf):
    return dedup.dedup_rules(postings(spark, sf))


@query
def similar_pairs(spark, sf):
    return fuzzy.similar_pairs(part_postings(spark, sf)).withColumn("score", F.round("score", 6))


@query
def fuzzy_dedup(spark, sf):
    rows = part_postings(spark, sf).transform(dedup.with_uid)
    return fuzzy.fuzzy_dedup(rows).select("uid", "title", "company", "deadline")


@query
def fuzzy_dedup_postings(spark, sf):
    return fuzzy.fuzzy_dedup(dedup.with_uid(postings(spark, sf))).select("ingest_seq", "uid", "title", "company")


@query
def fuzzy_dedup_documents(spark, sf):
    return fuzzy.fuzzy_dedup(document_postings(spark, sf)).select("uid", "company", "deadline")


@query
def refine_chain(spark, sf):
    return flat(refine.refine(dedup.dedup_rules(postings(spark, sf)))).select(
        "uid", "title", "company", "min_exp", "max_exp", "tech_stack", "_search_text"
    )


# ---------------------------------------------------------------- statistics


@query
def snapshot_stats(spark, sf):
    return stats.snapshot(postings(spark, sf))


@query
def dedup_effect(spark, sf):
    raw = postings(spark, sf)
    return stats.dedup_effect(raw, refine.enrich(dedup.dedup_uid(dedup.with_uid(raw))))


@query
def run_report(spark, sf):
    raw = postings(spark, sf)
    kept = dedup.dedup_rules(raw)
    report = stats.pipeline_report(raw, kept, "orders", F.lit("2026-05-12 14:27:55").cast("timestamp"))
    path = work_path(spark, "stats")
    files.save_stats(report, path)
    schema = report.schema
    kv = F.array_sort(F.transform(F.map_entries("by_source"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return spark.read.schema(schema).json(path).withColumn("by_source", F.array_join(kv, ","))


@query
def source_summary(spark, sf):
    return stats.by_source(postings(spark, sf))


@query
def row_count(spark, sf):
    return stats.row_count(postings(spark, sf))


@query
def source_names(spark, sf):
    return stats.source_names(postings(spark, sf))


@query
def table_summary(spark, sf):
    return stats.table_summary(postings(spark, sf))


@query
def source_rollup(spark, sf):
    return stats.source_rollup(postings(spark, sf))


@query
def top_locations(spark, sf):
    return stats.top_locations(postings(spark, sf))


@query
def top_keywords(spark, sf):
    return stats.top_keywords(postings(spark, sf))


@query
def iso_deadlines(spark, sf):
    return stats.iso_deadline_count(postings(spark, sf))


@query
def top_tech(spark, sf):
    return stats.top_tech(enriched(spark, sf))


@query
def tech_options(spark, sf):
    return stats.top_tech(enriched(spark, sf), 30)


@query
def experience_distribution(spark, sf):
    return stats.experience_distribution(enriched(spark, sf))


@query
def location_tokens(spark, sf):
    return stats.location_tokens(postings(spark, sf))


@query
def facet_board(spark, sf):
    return stats.facet_board(enriched(spark, sf))


@query
def direct_sources(spark, sf):
    return stats.direct_sources(postings(spark, sf))


@query
def headline_metrics(spark, sf):
    return stats.headline(postings(spark, sf))


@query
def browse_by_deadline(spark, sf):
    return stats.browse(dedup.with_uid(postings(spark, sf))).select("deadline", "uid", "ingest_seq")


@query
def card_badges(spark, sf):
    cards = stats.badges(enriched(spark, sf))
    raw_score = F.col("ingest_seq") % 150 * 1.0
    return cards.select("ingest_seq", F.array_join("badges", "|").alias("badges"), stats.score_bar(raw_score).alias("bar"))


@query
def feed_quality(spark, sf):
    feed = postings(spark, sf).withColumn(
        "feed", F.when(F.col("source") == "토스", "카카오").otherwise(F.col("source"))
    ).withColumn(
        "fields",
        F.when(F.col("source") == "쿠팡", F.array(*[F.lit(c) for c in RAW_COLUMNS if c != "url"] + [F.lit("salary")]))
        .otherwise(F.array(*[F.lit(c) for c in RAW_COLUMNS])),
    )
    # every source name there is, with one more that delivers nothing
    expected = table(spark, sf, "orders").select(F.explode(F.array(*[F.lit(s) for s in (*SITES, "미수집")])).alias("feed")).distinct()
    return quality.feed_quality(feed, expected, "fields")


# ---------------------------------------------------------------- stored table


def _table_and_batch(spark, sf):
    orders = table(spark, sf, "orders")

    def records(df, day):
        rows = refine.enrich(dedup.dedup_uid(dedup.with_uid(df)))
        return refine.to_records(rows, F.lit(day).cast("timestamp"))

    old = records(postings_from_orders(orders.where("o_orderstatus = 'F'")), "2026-05-01 00:00:00")
    late = postings(spark, sf).withColumn(
        "deadline",
        F.when(F.length("location") == 0, "").when(F.length("keyword") > 2, "상시채용").otherwise(F.col("deadline")),
    )
    return old, records(late, "2026-05-02 00:00:00")


def _stored_columns(df):
    stamps = {c: F.date_format(c, "yyyy-MM-dd") for c in ("posted_date", "updated_at")}
    return flat(df.withColumns(stamps))


@query
def upsert_merge(spark, sf):
    return _stored_columns(upsert.merge(*_table_and_batch(spark, sf)))


@query
def upsert_counts(spark, sf):
    return upsert.counts(*_table_and_batch(spark, sf))


@query
def store_upsert(spark, sf):
    """The same two batches through the table on disk, then read back."""
    old, new = _table_and_batch(spark, sf)
    store = PostingStore(spark, work_path(spark, "store"))
    store.upsert(old, 0)
    store.upsert(new, 1)
    store.upsert(new, 1)
    return _stored_columns(store.read())


@query
def table_query(spark, sf):
    records = refine.to_records(enriched(spark, sf), F.lit("2026-05-12").cast("timestamp"))
    hit = filters.table_filter(sources=["원티드", "점핏", "토스"], location="서울", min_exp=5, max_exp=3, keyword="engineer")
    return records.where(hit).select("uid", "title", "company", "link", "location", "source", "min_exp", "max_exp")


@query
def newest_postings(spark, sf):
    """Newest first, with the limit a caller asks for."""
    rows = enriched(spark, sf).withColumn("posted_date", F.col("deadline"))
    return stats.newest(rows, 500).select("posted_date", "uid")


# ---------------------------------------------------------------- filters


@query
def filter_search(spark, sf):
    rows = enriched(spark, sf)
    rows = rows.withColumn("_search_text", search.search_document(rows))
    hit = filters.combined(
        keyword="개발", sources=["사람인", "점핏", "네이버", "쿠팡"], locations=["서울", "판교", "원격"],
        experience="1~3년", tech_stack=["python", "React", "AWS"],
    )
    return flat(rows.where(hit)).select("ingest_seq", "title", "source", "location", "tech_stack")


@query
def keyword_regex(spark, sf):
    rows = enriched(spark, sf)
    rows = rows.withColumn("_search_text", search.search_document(rows))
    return rows.where(filters.combined(keyword="dev.*(서울|판교)", regex=True)).select("ingest_seq", "title", "location")


@query
def experience_bands(spark, sf):
    bands = ["전체", "신입 (경력무관 포함)", "1~3년", "3~5년", "5년 이상", "모름"]
    rows = enriched(spark, sf)
    return rows.select("ingest_seq", *[filters.in_band(b).cast("int").alias(f"band_{i}") for i, b in enumerate(bands)])


@query
def intern_filter(spark, sf):
    hit = filters.combined(experience="3~5년", intern_only=True)
    return enriched(spark, sf).where(hit).select("ingest_seq", "title", "keyword", "experience")


@query
def tech_overlap(spark, sf):
    return flat(enriched(spark, sf).where(filters.has_tech(["go", "JAVA", "kubernetes"]))).select("ingest_seq", "tech_stack")


@query
def site_selection(spark, sf):
    return feeds.only_sites(postings(spark, sf), ["원티드", "카카오"]).select("ingest_seq", "source")


# ---------------------------------------------------------------- ranked search


def _search_rows(spark, sf):
    rows = enriched(spark, sf)
    return rows.withColumn("_search_text", search.search_document(rows))


def _documents(spark, sf):
    return spread(table(spark, sf, "documents").select(F.col("doc_id").alias("uid"), F.col("text").alias("_search_text")))


@query
def search_documents(spark, sf):
    return _search_rows(spark, sf).select("ingest_seq", "_search_text")


@query
def tfidf_vocabulary(spark, sf):
    docs = _documents(spark, sf)
    vocab = search.vocabulary(search.term_counts(docs, totals=True), docs, TERMS)
    return vocab.select("term", "cnt", "df", F.round("idf", 6).alias("idf"))


@query
def tfidf_weights(spark, sf):
    index = search.TextIndex.fit(_documents(spark, sf), size=TERMS).index
    return index.select("uid", "term", F.round("w", 6).alias("w"))


def _scored(df):
    return df.withColumn("dot", F.round("dot", 6))


@query
def tfidf_search(spark, sf):
    index = search.TextIndex.fit(_search_rows(spark, sf), "ingest_seq", size=TERMS)
    return _scored(index.search("서울 백엔드 개발자 python 신입", top_k=100))


@query
def tfidf_search_filtered(spark, sf):
    rows = _search_rows(spark, sf)
    where = filters.combined(sources=["사람인", "링크드인", "토스"], locations=["서울"], experience="신입")
    hits = search.expanded_search(rows, "클라우드 보안 엔지니어", where, id_column="ingest_seq", size=TERMS)
    return _scored(hits).select("ingest_seq", "dot", "score")


@query
def stored_search(spark, sf):
    """Postings written to the table, read back, and searched."""
    store = PostingStore(spark, work_path(spark, "search-store"))
    store.upsert(refine.to_records(enriched(spark, sf), F.lit("2026-05-12 00:00:00").cast("timestamp")), 0)
    hits = search.expanded_search(refine.from_records(store.read()), "클라우드 보안 엔지니어", F.col("source") == "토스")
    return _scored(hits).select("uid", "title", "dot", "score", "search_query")


@query
def vector_batch_topk(spark, sf):
    vectors = table(spark, sf, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return _scored(search.vector_batch_topk(vectors, asked, 5)).select("query_id", "vec_id", "rank", "dot")


@query
def semantic_search(spark, sf):
    hits = search.semantic_search(_search_rows(spark, sf), "데이터 분석 aws", top_k=40, id_column="ingest_seq", size=TERMS)
    return hits.select("ingest_seq", "title", "company", "score")


@query
def batch_search(spark, sf):
    questions = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    index = search.TextIndex.fit(_documents(spark, sf), size=TERMS)
    return _scored(index.batch_search(questions, top_k=10)).select("query_id", "uid", "rank", "score", "dot")


@query
def saved_index_search(spark, sf):
    """The index written once, then searched from disk."""
    docs = _documents(spark, sf)
    path = work_path(spark, "index")
    search.TextIndex.fit(docs, size=TERMS).save(path)
    questions = table(spark, sf, "conversations").where("role = 'user'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text"
    )
    index = search.TextIndex.load(docs, path)
    return _scored(index.batch_search(questions, top_k=5)).select("query_id", "uid", "rank", "score", "dot")


@query
def query_expand(spark, sf):
    asked = postings(spark, sf).select(F.col("title").alias("query")).distinct()
    return expand.expand_queries(asked)


def _replies(spark, sf):
    """Stored replies to titles: fenced, plain, incomplete and broken ones."""
    titles = postings(spark, sf).select(F.col("title").alias("query"), F.length("title").alias("n")).distinct()
    body = F.to_json(F.struct(F.concat(F.col("query"), F.lit(" engineer")).alias("search_query"), F.lit("요약").alias("summary")))
    reply = (
        F.when(F.col("n") % 4 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(F.col("n") % 4 == 1, body)
        .when(F.col("n") % 4 == 2, '{"search_query": "only"}')
        .otherwise("no json {")
    )
    first = titles.select("query", F.lit("first").alias("provider"), F.lit(1).alias("priority"), reply.alias("reply"))
    second = titles.where("n % 3 = 0").select("query", F.lit("second").alias("provider"), F.lit(2).alias("priority"), body.alias("reply"))
    return first.unionByName(second)


@query
def stored_expansion(spark, sf):
    asked = postings(spark, sf).select(F.col("title").alias("query")).distinct()
    return expand.expand_queries(asked, _replies(spark, sf))


@query
def vector_topk(spark, sf):
    vectors = table(spark, sf, "embeddings")
    query_vector = vectors.agg(F.min_by("embedding", "vec_id").alias("q")).scalar()
    vectors = vectors.withColumn("_q", query_vector)
    return _scored(search.vector_topk(vectors, F.col("_q"), 20, min_score=0.0))


@query
def embed_texts(spark, sf):
    cut = search.embed_text("text", 8_000)
    return table(spark, sf, "documents").select("doc_id", F.length(cut).alias("kept"), F.sha2(cut, 256).alias("sha"))


# ---------------------------------------------------------------- feeds


def _p(spark, sf):
    p = postings(spark, sf)
    return p, {c: F.col(c) for c in p.columns} | {"id": F.col("ingest_seq").cast("string")}


@query
def feed_wanted(spark, sf):
    p, c = _p(spark, sf)
    record = F.struct(
        c["ingest_seq"].alias("id"), c["title"].alias("position"),
        F.when(c["company"] != "", F.struct(c["company"].alias("name"))).alias("company"),
        F.struct(F.concat(F.lit(" "), c["location"], F.lit("\t")).alias("location")).alias("address"),
        F.struct(c["experience"].alias("display")).alias("experience_level"), c["deadline"].alias("due_time"),
    )
    return json_feeds.wanted(json_pages(p, record, lambda b: F.struct(b.alias("data"))))


@query
def feed_jumpit(spark, sf):
    p, c = _p(spark, sf)
    k = c["ingest_seq"]
    record = F.struct(
        k.alias("id"), c["title"].alias("title"), c["company"].alias("companyName"), F.split(c["location"], " ").alias("locations"),
        (k % 6).cast("int").alias("minCareer"), F.when(k % 4 == 0, (k % 6 + 3).cast("int")).alias("maxCareer"),
        c["deadline"].alias("closeDate"),
    )
    wrap = lambda b: F.struct(F.struct(b.alias("positions"), F.size(b).alias("totalCount")).alias("result"))
    return json_feeds.jumpit(json_pages(p, record, wrap))


@query
def feed_saramin_api(spark, sf):
    p, c = _p(spark, sf)
    record = F.struct(
        c["url"].alias("url"), c["deadline"].alias("expiration-date"),
        F.struct(
            c["title"].alias("title"), F.struct(c["location"].alias("name")).alias("location"),
            F.struct(c["experience"].alias("name")).alias("experience-level"),
        ).alias("position"),
        F.struct(F.struct(c["company"].alias("name")).alias("detail")).alias("company"),
    )
    return json_feeds.saramin(json_pages(p, record, lambda b: F.struct(F.struct(b.alias("job")).alias("jobs"))))


@query
def feed_coupang(spark, sf):
    p, c = _p(spark, sf)
    k = c["ingest_seq"]
    record = F.struct(
        k.alias("id"), c["title"].alias("title"), F.when(c["url"] != "", c["url"]).alias("absolute_url"),
        F.when(k % 3 != 0, F.array(F.struct(c["keyword"].alias("name")))).otherwise(F.array().cast("array<struct<name:string>>")).alias("departments"),
        F.array(F.struct(c["location"].alias("name"))).alias("offices"),
    )
    return json_feeds.coupang(json_pages(p, record, lambda b: F.struct(b.alias("jobs"))))


@query
def feed_saramin(spark, sf):
    p, c = _p(spark, sf)
    card = fill(
        '<div class="list_item x"><div class="job_tit"><a class="str_tit" href="/zf/{id}">{title}</a></div>'
        '<div class="company_nm"><a class="str_tit" href="/c"> {company} </a></div><p class="work_place">{location}</p>'
        '<p class="career">{experience}</p><div class="job_meta"><span class="job_sector"><span>{keyword}</span>'
        '<span>B</span><span>C</span><span>D</span></span></div><span class="date">{deadline}</span></div>', **c
    )
    pages = html_pages(p, card).withColumn("intern", F.col("page") % 2 == 1)
    return html_feeds.saramin(pages)


@query
def feed_linkedin(spark, sf):
    p, c = _p(spark, sf)
    card = fill(
        '<li><a class="base-card__full-link" href="https://kr.example.com/jobs/{id}?trk=1&amp;x=2"><span>open</span></a>'
        '<h3 class="base-search-card__title">\n {title} \n</h3><h4 class="base-search-card__subtitle"><a>{company}</a></h4>'
        '<span class="job-search-card__location">{location}</span><time datetime="{deadline}">yesterday</time>', **c
    )
    return html_feeds.linkedin(html_pages(p, card, "<ul>", "</ul>"))


@query
def feed_naver(spark, sf):
    p, c = _p(spark, sf)
    card = fill(
        "<li class=\"card_item\"><a class=\"card_link\" onclick=\"show('{id}')\" href=\"#n\"><h4 class=\"card_title\">{title}</h4>"
        '<dl class="card_info"><dt>모집 부서</dt><dd class="info_text">{keyword}</dd><dt>모집 경력</dt><dd class="info_text">{experience}</dd>'
        '<dt>모집 기간</dt><dd class="info_text">2026.01.01 ~ {deadline}</dd></dl></a></li>', **c
    )
    return html_feeds.naver(html_pages(p, card, "<ul>", "</ul>"))


@query
def feed_jobkorea(spark, sf):
    p, c = _p(spark, sf)
    card = fill(
        '<div class="a rounded-2xl shadow-sm"><div><a href="/Recruit/GI_Read/{id}?x=1"><img src="i.png"></a>'
        '<a href="/Recruit/GI_Read/{id}">{title}</a></div><div><a href="/Recruit/GI_Read/{id}">{company}</a></div>'
        '<span>{location}</span><span>{experience}</span><span>{deadline} 마감</span></div>', **c
    )
    return html_feeds.jobkorea(html_pages(p, card))


@query
def feed_jobplanet(spark, sf):
    p, c = _p(spark, sf)
    card = fill(
        '<a href="/job/search?posting_ids={id}"><b>{company}</b><p>{title}</p><i>{location}</i><i>{experience}</i></a>', **c
    )
    return html_feeds.jobplanet(html_pages(p, card))


@query
def feed_kakao(spark, sf):
    p, c = _p(spark, sf)
    card = fill(
        '<li><a href="/jobs/P-{id}?page=1"><div class="area_info"><h4 class="tit_jobs">{title}</h4>'
        '<dl class="list_info"><dt>d</dt><dd>{deadline}</dd><dt>l</dt><dd>{location}</dd></dl></div></a></li>', **c
    )
    return html_feeds.kakao(html_pages(p, card, "<ul>", "</ul>"))


@query
def feed_toss(spark, sf):
    p, c = _p(spark, sf)
    card = fill(
        '<a href="/career/job-detail?id={id}"><li class="css-1lnizc9"><p data-desktop-list-item-title="true">{title}</p>'
        '<span>{keyword}</span><span>정규직</span><em>비바</em></li></a>', **c
    )
    return html_feeds.toss(html_pages(p, card))


@query
def feed_rallit(spark, sf):
    p, c = _p(spark, sf)
    card = fill(
        '<article><a href="/positions/{id}/x"><h3>{title}</h3><p>{company}</p><span>{location}</span></a></article>', **c
    )
    return html_feeds.rallit(html_pages(p, card))


@query
def article_pages(spark, sf):
    """The article rules on the raw web pages of the test data."""
    pages = spread(table(spark, sf, "pages").select("url", "html", F.lit("백엔드").alias("label")))
    return html_feeds.rallit(pages)


@query
def feed_rejects(spark, sf):
    """Replies of one feed, every second page of them broken in some way: what is not read, and why."""
    p, c = _p(spark, sf)
    k = c["ingest_seq"]
    title = F.when(k % 7 == 0, "").otherwise(c["title"])
    record = F.when(k % 9 != 0, F.struct(k.alias("id"), title.alias("position")))
    pages = json_pages(p, record, lambda b: F.struct(b.alias("data")))
    kind = F.col("page") % 5
    broken = F.when(kind == 1, F.expr("left(payload, length(payload) - 3)")).when(kind == 2, '{"data": {"error": "busy"}}').when(kind == 3, '{"message": "none"}')
    return json_feeds.rejects(pages.withColumn("payload", F.coalesce(broken, "payload")), "wanted")


@query
def feed_union(spark, sf):
    every = feeds.union_feeds(feed_wanted(spark, sf), feed_jumpit(spark, sf), feed_coupang(spark, sf), feed_rallit(spark, sf))
    return stats.by_source(every)


# ---------------------------------------------------------------- streams


def _order_stream(spark, sf):
    schema = table(spark, sf, "orders").schema
    return postings_from_orders(streaming.landed_stream(spark, sf, schema, glob="orders.parquet"))


@query
def stream_dedup(spark, sf):
    rows = streaming.dedup_stream(_order_stream(spark, sf)).select("uid")
    out, state = work_path(spark, "stream-out"), work_path(spark, "stream-state")
    run = rows.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
    run.awaitTermination()
    return spark.read.schema("uid string").parquet(out)


@query
def stream_dedup_window(spark, sf):
    """The first event of each user and type in each hour, with state bounded by the watermark."""
    schema = table(spark, sf, "events").schema
    events = streaming.landed_stream(spark, sf, schema, glob="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out, state = work_path(spark, "window-out"), work_path(spark, "window-state")
    keys = ["user_id", "event_type"]
    streaming.write_updates(streaming.first_per_window(events, keys, "ts", "event_id"), out, state).awaitTermination()
    written = spark.read.schema("window_start timestamp, user_id long, event_type string, first long").parquet(out)
    latest = written.groupBy("window_start", *keys).agg(F.min("first").alias("first_event"))
    return latest.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query
def stream_ingest(spark, sf):
    store = PostingStore(spark, work_path(spark, "stream-store"))
    schema = table(spark, sf, "orders").schema
    landed = streaming.landed_stream(spark, sf, schema, glob="orders.parquet")
    now = F.lit("2026-05-12 00:00:00").cast("timestamp")
    run = streaming.ingest(postings_from_orders(landed), store, work_path(spark, "stream-state"), threshold=100, now=now)
    run.awaitTermination()
    return flat(store.read()).select("uid", "title", "company", "deadline", "min_exp", "max_exp", "tech_stack")


@query
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Refined postings of chosen sites within an experience band and with given technologies, best deadline first."""
    rows = enriched(spark, sf)
    hit = filters.combined(sources=["사람인", "원티드", "점핏", "네이버"], experience="3~5년", tech_stack=["Python", "Java", "AWS", "React"])
    return flat(stats.browse(rows.where(hit)).limit(50)).select("uid", "title", "company", "location", "deadline", "source", "min_exp", "max_exp", "tech_stack")
