"""SQL that gives the same results as the registered queries, for checking."""

from ..lexicons import (
    COUPANG_TERMS, EXPANSION_RULES, EXPERIENCE_BANDS, IT_TITLE_TERMS, NAVER_TERMS, NON_IT_TITLE_TERMS, SITES,
    TECH_KEYWORDS, TOSS_TERMS,
)
from .fixtures import CAREERS, KEYWORDS, PLACES, ROLES, TECHS

ORACLE = {}


def lit(s):
    return "'" + s.replace("'", "''") + "'"


def arr(values):
    return "[" + ", ".join(lit(v) for v in values) + "]"


def at(values, index):
    return f"{arr(values)}[CAST({index} AS INT) + 1]"


P = f"""p AS (
  SELECT o_orderkey AS ingest_seq,
    {at(ROLES, 'o_orderkey % 12')} || ' ' || {at(TECHS, 'o_orderkey % 7')} || ' ' || CAST(o_orderkey % 40 AS VARCHAR) AS title,
    CASE WHEN o_custkey % 10 = 0 THEN '' ELSE 'Company ' || CAST(o_custkey % 97 AS VARCHAR) END AS company,
    {at(PLACES, 'o_custkey % 9')} AS location,
    {at(CAREERS, '(o_orderkey + o_custkey) % 10')} AS experience,
    CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 5 = 0 THEN '상시채용'
         ELSE strftime(o_orderdate, '%Y-%m-%d') END AS deadline,
    CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'https://jobs.example.com/' || CAST(o_orderkey % 9000 AS VARCHAR) END AS url,
    {at(SITES, 'o_custkey % 11')} AS source,
    {at(KEYWORDS, 'o_orderkey % 6')} AS keyword, o_orderstatus
  FROM orders)"""
RAW = "ingest_seq, title, company, location, experience, deadline, url, source, keyword"


def has_any(c, terms):
    return "(" + " OR ".join(f"contains({c}, {lit(t)})" for t in terms) + ")"


def it_title(c):
    return f"(NOT {has_any(f'lower({c})', NON_IT_TITLE_TERMS)} AND {has_any(f'lower({c})', IT_TITLE_TERMS)})"


def re_quote(k):
    return "".join("\\" + ch if not ch.isalnum() and ch != " " else ch for ch in k)


def tech(c):
    cases = ", ".join(
        f"CASE WHEN regexp_matches({c}, '(^|[^a-zA-Z]){re_quote(k)}([^a-zA-Z]|$)', 'i') THEN {lit(k)} END" for k in TECH_KEYWORDS
    )
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


RANGE, LEAST, EXACT = r"(\d+)\s*[~\-]\s*(\d+)\s*년", r"(\d+)\s*년\s*(이상|↑)", r"경력\s*(\d+)\s*년"


def year(c, which):
    second = f"CAST(regexp_extract({c}, '{RANGE}', 2) AS INT)" if which == "max" else f"CAST(regexp_extract({c}, '{RANGE}', 1) AS INT)"
    least = "NULL" if which == "max" else f"CAST(regexp_extract({c}, '{LEAST}', 1) AS INT)"
    return f"""CASE WHEN regexp_matches({c}, '{RANGE}') THEN {second}
      WHEN regexp_matches({c}, '{LEAST}') THEN {least}
      WHEN regexp_matches({c}, '{EXACT}') THEN CAST(regexp_extract({c}, '{EXACT}', 1) AS INT)
      WHEN contains({c}, '신입') THEN 0 WHEN contains({c}, '무관') THEN -1 END"""


def norm(c):
    return rf"lower(trim(regexp_replace(regexp_replace({c}, '[^\p{{L}}\p{{N}}_\s+#.\-]', ' ', 'g'), '\s+', ' ', 'g')))"


UID = "sha256(trim(company) || '|' || trim(title) || '|' || trim(url))"
EXP = "CASE WHEN trim(experience) = '' THEN title ELSE experience END"
E = f"""e0 AS (SELECT *, {EXP} AS xt, title || ' ' || keyword AS tt FROM p),
e AS (SELECT * EXCLUDE (xt, tt), {UID} AS uid, {year('xt', 'min')} AS min_exp, {year('xt', 'max')} AS max_exp,
  {tech('tt')} AS techs, {norm("title || ' ' || company || ' ' || keyword || ' ' || experience")} AS _search_text FROM e0)"""
TS = "array_to_string(techs, '|') AS tech_stack"
WITH_P = f"WITH {P} "
WITH_E = f"WITH {P}, {E} "
DISPLAY = "title AS 공고제목, company AS 회사명, location AS 근무지, experience AS 경력, deadline AS 마감일, url AS 공고URL, source AS 출처, keyword AS 검색키워드"


def put(name, sql):
    ORACLE[name] = sql


# ---- cleaning and enrichment
put("raw_postings", WITH_P + f"SELECT {RAW} FROM p")
put("csv_round_trip", WITH_P + f"SELECT {RAW.replace('ingest_seq, ', '')} FROM p WHERE company <> ''")
put("legacy_clean", WITH_P + f"SELECT {RAW} FROM p")
put("it_title_filter", WITH_P + f"SELECT ingest_seq, title FROM p WHERE {it_title('title')}")
put("posting_uids", WITH_P + f"SELECT ingest_seq, {UID} AS uid FROM p")
put("experience_parse", WITH_E + "SELECT ingest_seq, min_exp, max_exp FROM e")
put("tech_extract", WITH_E + f"SELECT ingest_seq, {TS} FROM e")
put("tech_codecs", WITH_E + """SELECT ingest_seq, array_to_string(techs, '|') AS from_json_text,
  array_to_string(techs, '|') AS from_list_text, 0 AS bad_json, 0 AS bad_list FROM e""")
put("normalise_texts", f"SELECT doc_id, sha256({norm('text')}) AS normal_sha, length({norm('text')}) AS normal_len FROM documents")
put("refine_postings", WITH_E + f"SELECT ingest_seq, uid, min_exp, max_exp, {TS}, _search_text FROM e")
put("table_records", WITH_E + """SELECT uid, title, company, _search_text AS description, url AS link, location, source, keyword,
  deadline, min_exp, max_exp, CASE WHEN len(techs) = 0 THEN '[]' ELSE '["' || array_to_string(techs, '","') || '"]' END AS tech_stack,
  '2026-05-12 14:27:55' AS posted_date, '2026-05-12 14:27:55' AS updated_at FROM e""")
put("display_listing", WITH_E + f"SELECT ingest_seq, {DISPLAY}, min_exp, max_exp, {TS} FROM e")

# ---- duplicates
UID_DEDUP = "u AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY uid ORDER BY ingest_seq) = 1)"
RULES = """r1 AS (SELECT * FROM p WHERE trim(title) <> '' AND trim(company) <> ''
    QUALIFY row_number() OVER (PARTITION BY trim(title), trim(company) ORDER BY ingest_seq) = 1),
  r2a AS (SELECT ingest_seq, trim(url) AS u, FALSE AS own FROM r1 WHERE trim(url) <> ''
    UNION ALL SELECT ingest_seq, trim(url), TRUE FROM p WHERE trim(title) <> '' AND trim(company) = '' AND trim(url) <> ''),
  r2 AS (SELECT * FROM p WHERE ingest_seq IN (SELECT arg_min(ingest_seq, ingest_seq) FILTER (own) FROM r2a GROUP BY u
    HAVING min(ingest_seq) = min(ingest_seq) FILTER (own))),
  r3a AS (SELECT ingest_seq, trim(title) AS t, FALSE AS own FROM r2
    UNION ALL SELECT ingest_seq, trim(title), TRUE FROM p WHERE trim(title) <> '' AND trim(company) = '' AND trim(url) = ''),
  r3 AS (SELECT * FROM p WHERE ingest_seq IN (SELECT min(ingest_seq) FILTER (own) FROM r3a GROUP BY t
    HAVING min(ingest_seq) = min(ingest_seq) FILTER (own))),
  rules AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3)"""
put("uid_dedup", WITH_E + f", {UID_DEDUP} SELECT ingest_seq, uid FROM u")
put("rule_dedup", WITH_P + f", {RULES} SELECT {RAW} FROM rules")

TOKENS = r"array_to_string(list_sort(list_filter(string_split_regex(lower(trim(company)) || ' ' || lower(trim(title)), '\s+'), lambda w: w <> '')), ' ')"
PARTS = f"""parts AS (SELECT p_partkey AS ingest_seq, p_name AS title, p_brand AS company, '' AS url, p_type AS deadline FROM part),
  pu AS (SELECT *, {UID} AS uid, {TOKENS} AS k FROM parts
    QUALIFY row_number() OVER (PARTITION BY {UID} ORDER BY ingest_seq) = 1),
  heads AS (SELECT * FROM pu QUALIFY row_number() OVER (PARTITION BY k ORDER BY deadline DESC, uid) = 1),
  keys AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY deadline DESC, uid) AS rnk FROM heads),
  cand AS MATERIALIZED (SELECT x.k AS ka, y.k AS kb, x.rnk AS ra, y.rnk AS rb FROM keys x JOIN keys y ON x.k < y.k
    AND 11 * least(length(x.k), length(y.k)) >= 9 * greatest(length(x.k), length(y.k))
    AND levenshtein(x.k, y.k) * 10 <= length(x.k) + length(y.k)),
  dp AS (SELECT ka, kb, ra, rb, 0 AS i, list_transform(range(length(kb) + 1), lambda x: 0) AS cells FROM cand
    UNION ALL
    SELECT ka, kb, ra, rb, i + 1, list_transform(range(1, length(kb) + 2), lambda j: list_max(list_transform(range(1, j + 1),
      lambda m: CASE WHEN m > 1 AND substring(kb, m - 1, 1) = substring(ka, i + 1, 1) THEN cells[m - 1] + 1 ELSE cells[m] END)))
    FROM dp WHERE i < length(ka)),
  sim AS MATERIALIZED (SELECT ka, kb, ra, rb, 200.0 * list_max(cells) / (length(ka) + length(kb)) AS score FROM dp
    WHERE i = length(ka) AND 200 * list_max(cells) >= 90 * (length(ka) + length(kb)))"""
put("similar_pairs", f"WITH RECURSIVE {PARTS} SELECT ka AS key_a, kb AS key_b, round(score, 6) AS score FROM sim")
put("fuzzy_dedup", f"""WITH RECURSIVE {PARTS},
  before AS (SELECT greatest(ra, rb) AS rnk, list(least(ra, rb)) AS smaller FROM sim GROUP BY 1),
  steps AS MATERIALIZED (SELECT k.rnk, coalesce(b.smaller, []) AS smaller FROM keys k LEFT JOIN before b USING (rnk)),
  pass AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept
    UNION ALL
    SELECT s.rnk, CASE WHEN list_has_any(pass.kept, s.smaller) THEN pass.kept ELSE list_append(pass.kept, s.rnk) END
    FROM pass JOIN steps s ON s.rnk = pass.i + 1),
  winners AS (SELECT unnest(kept) AS rnk FROM (SELECT kept FROM pass ORDER BY i DESC LIMIT 1))
SELECT uid, title, company, deadline FROM keys WHERE rnk IN (SELECT rnk FROM winners)""")

# ---- statistics
INTERN = "regexp_matches(title, '인턴|intern', 'i')"
ISO = r"regexp_matches(deadline, '^\d{4}-\d{2}-\d{2}')"
put("snapshot_stats", WITH_P + f"""SELECT count(*) AS total_raw, count(*) FILTER ({INTERN}) AS intern_count,
  count(*) FILTER (trim(deadline) <> '') AS has_deadline, count(*) FILTER (trim(company) = '') AS no_company FROM p""")
put("dedup_effect", WITH_E + f""", {UID_DEDUP} SELECT count(*) AS total_after_dedup, count(min_exp) AS experience_parsed,
  count(*) FILTER (len(techs) > 0) AS tech_found, (SELECT count(*) FROM p) - count(*) AS removed_by_dedup FROM u""")
put("run_report", WITH_P + f""", {RULES} SELECT count(*) AS total_raw, count(*) FILTER ({INTERN}) AS intern_count,
  count(*) FILTER (trim(deadline) <> '') AS has_deadline, count(*) FILTER (trim(company) = '') AS no_company,
  '2026-05-12 14:27:55' AS generated_at, 'orders' AS source,
  (SELECT string_agg(source || '=' || CAST(n AS VARCHAR), ',' ORDER BY source || '=' || CAST(n AS VARCHAR))
    FROM (SELECT source, count(*) AS n FROM p GROUP BY 1)) AS by_source,
  (SELECT count(*) FROM rules) AS total_after_dedup, count(*) - (SELECT count(*) FROM rules) AS removed_by_dedup FROM p""")
put("source_summary", WITH_P + "SELECT source, count(*) AS cnt FROM p GROUP BY 1")
put("row_count", WITH_P + "SELECT count(*) AS cnt FROM p")
put("source_names", WITH_P + "SELECT DISTINCT source FROM p WHERE source <> ''")
put("table_summary", WITH_P + """SELECT count(*) AS total, count(*) FILTER (title ILIKE '%인턴%' OR title ILIKE '%intern%') AS intern_count,
  count(*) FILTER (deadline <> '') AS has_deadline FROM p""")
put("source_rollup", WITH_P + """, d AS (SELECT string_agg(s, ' · ' ORDER BY s) AS names FROM (SELECT DISTINCT source AS s FROM p
    WHERE source IN ('카카오', '네이버', '토스', '쿠팡')))
  SELECT CASE WHEN source IN ('카카오', '네이버', '토스', '쿠팡') THEN '개별 공고 (' || (SELECT names FROM d) || ')' ELSE source END AS source,
  count(*) AS cnt FROM p GROUP BY 1""")
TOP = "ORDER BY cnt DESC, {0} LIMIT {1}"
put("top_locations", WITH_P + "SELECT location, count(*) AS cnt FROM p GROUP BY 1 " + TOP.format("location", 10))
put("top_keywords", WITH_P + "SELECT keyword, count(*) AS cnt FROM p GROUP BY 1 " + TOP.format("keyword", 10))
put("iso_deadlines", WITH_P + f"SELECT count(*) FILTER ({ISO}) AS iso_deadline_count FROM p")
TECHS_SQL = "SELECT tech, count(*) AS cnt FROM (SELECT unnest(techs) AS tech FROM e) GROUP BY 1 "
put("top_tech", WITH_E + TECHS_SQL + TOP.format("tech", 15))
put("tech_options", WITH_E + TECHS_SQL + TOP.format("tech", 30))
put("experience_distribution", WITH_E + """SELECT min_exp, count(*) AS cnt,
  CASE WHEN min_exp >= 0 THEN CAST(min_exp AS VARCHAR) || '년' END AS label FROM e WHERE min_exp IS NOT NULL GROUP BY 1""")
put("location_tokens", WITH_P + r"""SELECT token, count(*) AS cnt FROM (SELECT unnest(string_split_regex(location, '[,\s]+')) AS token FROM p)
  WHERE token <> '' GROUP BY 1 """ + TOP.format("token", 20))
BOARD = {
    "location": ("SELECT location AS value FROM e", 10), "keyword": ("SELECT keyword FROM e", 10), "tech": ("SELECT unnest(techs) FROM e", 15),
    "token": (r"SELECT * FROM (SELECT unnest(string_split_regex(location, '[,\s]+')) AS v FROM e) WHERE v <> ''", 20),
    "source": ("SELECT source FROM e", None), "min_exp": ("SELECT CAST(min_exp AS VARCHAR) FROM e WHERE min_exp IS NOT NULL", None),
}
put("facet_board", WITH_E + " UNION ALL ".join(
    f"SELECT * FROM (SELECT {lit(f)} AS facet, value, count(*) AS cnt, row_number() OVER (ORDER BY count(*) DESC, value) AS rank "
    f"FROM ({q}) AS t(value) GROUP BY value)" + (f" WHERE rank <= {n}" if n else "") for f, (q, n) in BOARD.items()))
put("direct_sources", WITH_P + "SELECT source, count(*) AS cnt FROM p WHERE source IN ('카카오', '네이버', '토스', '쿠팡') GROUP BY 1")
put("headline_metrics", WITH_P + f"""SELECT count(*) AS total,
  count(DISTINCT CASE WHEN source IN ('카카오', '네이버', '토스', '쿠팡') THEN '개별 공고' ELSE source END) AS sources,
  count(*) FILTER ({ISO}) AS iso_deadline_count, count(DISTINCT location) AS locations FROM p""")
put("browse_by_deadline", WITH_E + "SELECT deadline, uid, ingest_seq FROM e")
put("card_badges", WITH_E + """SELECT ingest_seq, array_to_string(techs[1:5], '|') AS badges,
  least(CAST(ingest_seq % 150 AS DOUBLE), 100.0) AS bar FROM e""")
put("newest_postings", WITH_E + "SELECT deadline AS posted_date, uid FROM e ORDER BY deadline DESC, uid LIMIT 500")
SITE_ROWS = " UNION ALL ".join(f"SELECT {lit(s)} AS feed" for s in (*SITES, "미수집"))
put("feed_quality", WITH_P + f""", f AS (SELECT *, CASE WHEN source = '토스' THEN '카카오' ELSE source END AS feed FROM p),
  g AS (SELECT feed, count(*) AS n, count(*) FILTER (trim(title) = '') AS bt, count(*) FILTER (trim(url) = '') AS bu,
    count(*) FILTER (source <> feed) AS ws FROM f GROUP BY 1),
  h AS (SELECT s.feed, coalesce(n, 0) AS row_cnt, coalesce(bt, 0) AS blank_title, coalesce(bu, 0) AS blank_url,
    coalesce(ws, 0) AS wrong_source, CASE WHEN s.feed = '쿠팡' AND n > 0 THEN 'url' ELSE '' END AS missing,
    CASE WHEN s.feed = '쿠팡' AND n > 0 THEN 'salary' ELSE '' END AS unexpected FROM ({SITE_ROWS}) s LEFT JOIN g ON g.feed = s.feed)
  SELECT *, CASE WHEN row_cnt = 0 OR blank_title > 0 OR blank_url * 10 > row_cnt * 3 OR wrong_source > 0 OR missing <> ''
    OR unexpected <> '' THEN 'WARN' ELSE 'PASS' END AS verdict FROM h""")

# ---- stored table
LATE = "CASE WHEN length(location) = 0 THEN '' WHEN length(keyword) > 2 THEN '상시채용' ELSE deadline END"
MERGE = f""", o AS (SELECT * FROM e WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY uid ORDER BY ingest_seq) = 1),
  b AS (SELECT * REPLACE ({LATE} AS deadline) FROM e QUALIFY row_number() OVER (PARTITION BY uid ORDER BY ingest_seq) = 1),
  j AS (SELECT b.uid, o.uid IS NULL AS fresh, o.uid IS NOT NULL AND (o.deadline = '' OR o.deadline < b.deadline) AS moved,
    b.deadline AS new_deadline FROM b LEFT JOIN o ON o.uid = b.uid)"""
ROW = f"uid, title, company, _search_text AS description, url AS link, location, source, keyword, min_exp, max_exp, {TS}"
MERGED = WITH_E + MERGE + f"""
  SELECT {ROW}, deadline, '2026-05-02' AS posted_date, '2026-05-02' AS updated_at FROM b WHERE uid IN (SELECT uid FROM j WHERE fresh)
  UNION ALL SELECT {ROW}, CASE WHEN uid IN (SELECT uid FROM j WHERE moved) THEN (SELECT new_deadline FROM j WHERE j.uid = o.uid) ELSE deadline END,
    '2026-05-01', CASE WHEN uid IN (SELECT uid FROM j WHERE moved) THEN '2026-05-02' ELSE '2026-05-01' END FROM o"""
put("upsert_merge", MERGED)
put("store_upsert", MERGED)
put("upsert_counts", WITH_E + MERGE + """ SELECT count(*) FILTER (fresh) AS inserted, count(*) FILTER (moved) AS updated,
  count(*) FILTER (NOT fresh AND NOT moved) AS skipped FROM j""")
put("table_query", WITH_E + """SELECT uid, title, company, url AS link, location, source, min_exp, max_exp FROM e
  WHERE source IN ('원티드', '점핏', '토스') AND location ILIKE '%서울%' AND (min_exp IS NULL OR min_exp <= 5)
  AND (max_exp IS NULL OR max_exp >= 3) AND (title ILIKE '%engineer%' OR _search_text ILIKE '%engineer%' OR company ILIKE '%engineer%')""")

# ---- filters
DOC = "title || ' ' || company || ' ' || location || ' ' || experience || ' ' || keyword || ' ' || source || ' ' || array_to_string(techs, ' ')"


def band(name):
    low, high, words = EXPERIENCE_BANDS[name]
    return f"""CASE WHEN min_exp IS NOT NULL THEN min_exp = -1 OR (min_exp <= {high} AND coalesce(max_exp, min_exp) >= {low})
      ELSE {has_any('experience', words)} END"""


def tech_any(*names):
    return f"list_has_any(list_transform(techs, lambda t: lower(t)), {arr(names)})"


put("filter_search", WITH_E + f"""SELECT ingest_seq, title, source, location, {TS} FROM e WHERE contains(lower({DOC}), '개발')
  AND source IN ('사람인', '점핏', '네이버', '쿠팡') AND {has_any('location', ('서울', '판교', '원격'))} AND ({band('1~3년')})
  AND {tech_any('python', 'react', 'aws')}""")
put("keyword_regex", WITH_E + f"SELECT ingest_seq, title, location FROM e WHERE regexp_matches(lower({DOC}), 'dev.*(서울|판교)')")
put("experience_bands", WITH_E + "SELECT ingest_seq, 1 AS band_0, " + ", ".join(
    f"CAST(({band(b)}) AS INT) AS band_{i}" for i, b in enumerate(("신입", "1~3년", "3~5년", "5년 이상"), 1)) + ", 1 AS band_5 FROM e")
put("intern_filter", WITH_P + f"""SELECT ingest_seq, title, keyword, experience FROM p
  WHERE {INTERN} OR contains(keyword, '인턴') OR contains(experience, '인턴')""")
put("tech_overlap", WITH_E + f"SELECT ingest_seq, {TS} FROM e WHERE {tech_any('go', 'java', 'kubernetes')}")
put("site_selection", WITH_P + "SELECT ingest_seq, source FROM p WHERE source IN ('원티드', '카카오')")
put("flagship", WITH_E + f"""SELECT uid, title, company, location, deadline, source, min_exp, max_exp, {TS} FROM e
  WHERE source IN ('사람인', '원티드', '점핏', '네이버') AND ({band('3~5년')}) AND {tech_any('python', 'java', 'aws', 'react')}
  ORDER BY deadline DESC, uid LIMIT 50""")

# ---- ranked search
def grams(source, name):
    """source(id, text) -> name(id, term, tf)"""
    return rf"""{name}_w AS (SELECT id, ' ' || w || ' ' AS w FROM (SELECT id, unnest(string_split_regex(lower(text), '\s+')) AS w FROM {source}) WHERE w <> ''),
  {name}_n AS (SELECT id, w, unnest(range(2, least(4, length(w)) + 1)) AS n FROM {name}_w),
  {name}_g AS (SELECT id, substring(w, i, n) AS term FROM (SELECT id, w, n, unnest(range(1, length(w) - n + 2)) AS i FROM {name}_n)),
  {name} AS (SELECT id, term, count(*) AS tf FROM {name}_g GROUP BY 1, 2)"""


VOCAB = """vocab AS (SELECT *, ln((1.0 + (SELECT count(*) FROM docs)) / (1.0 + df)) + 1.0 AS idf FROM
  (SELECT term, sum(tf)::BIGINT AS cnt, count(*) AS df FROM tf GROUP BY 1 ORDER BY cnt DESC, term LIMIT 20000))"""


def weighed(counts, name):
    return f"""{name}_r AS (SELECT id, term, (1.0 + ln(tf)) * idf AS w FROM {counts} JOIN vocab USING (term)),
  {name} AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM {name}_r)"""


def corpus(docs):
    return f"docs AS ({docs}), {grams('docs', 'tf')}, {VOCAB}, {weighed('tf', 'ix')}"


def dots(questions):
    return f"""asked AS ({questions}), {grams('asked', 'qf')}, {weighed('qf', 'qx')},
  hits AS (SELECT qx.id AS query_id, ix.id AS id, sum(qx.w * ix.w) AS dot FROM ix JOIN qx USING (term) GROUP BY 1, 2)"""


SCORE = "round_even(100.0 * dot, 1) AS score"
TEXTS = "SELECT doc_id AS id, text FROM documents"
ROWS = f"SELECT ingest_seq AS id, {DOC} AS text FROM e"


def ask(text):
    return f"SELECT 0 AS id, {lit(text)} AS text"


put("search_documents", WITH_E + f"SELECT ingest_seq, {DOC} AS _search_text FROM e")
put("tfidf_vocabulary", f"WITH docs AS ({TEXTS}), {grams('docs', 'tf')}, {VOCAB} SELECT term, cnt, df, round(idf, 6) AS idf FROM vocab")
put("tfidf_weights", f"WITH {corpus(TEXTS)} SELECT id AS uid, term, round(w, 6) AS w FROM ix")
put("tfidf_search", WITH_E + f""", {corpus(ROWS)}, {dots(ask('서울 백엔드 개발자 python 신입'))}
  SELECT * FROM (SELECT id AS ingest_seq, round(dot, 6) AS dot, {SCORE} FROM hits ORDER BY round(hits.dot, 9) DESC, id LIMIT 100) WHERE score >= 1.0""")


def rule_text(q):
    fired = []
    for domain, words in EXPANSION_RULES:
        terms = [domain.lower()] + [w.lower() for w in words.split()[:3]]
        fired.append(f"CASE WHEN {has_any(f'lower({q})', terms)} THEN {lit(' ' + words)} ELSE '' END")
    return f"trim({q} || " + " || ".join(fired) + ")"


put("tfidf_search_filtered", WITH_E + f""", {corpus(ROWS)}, {dots(f"SELECT 0 AS id, {rule_text(lit('클라우드 보안 엔지니어'))} AS text")}
  SELECT * FROM (SELECT id AS ingest_seq, round(dot, 6) AS dot, {SCORE} FROM hits WHERE id IN (SELECT ingest_seq FROM e
    WHERE source IN ('사람인', '링크드인', '토스') AND contains(location, '서울') AND ({band('신입')}))) WHERE score >= 5.0""")
put("semantic_search", WITH_E + f""", {corpus(ROWS)}, {dots(ask('데이터 분석 aws'))}
  SELECT ingest_seq, title, company, score FROM (SELECT id, {SCORE} FROM hits ORDER BY round(hits.dot, 9) DESC, id LIMIT 40) h
  JOIN e ON e.ingest_seq = h.id WHERE score >= 1.0""")


def batch(questions, k):
    return f"""WITH {corpus(TEXTS)}, {dots(questions)}
  SELECT query_id, id AS uid, rank, score, round(dot, 6) AS dot FROM (SELECT *, {SCORE},
    row_number() OVER (PARTITION BY query_id ORDER BY round(dot, 9) DESC, id) AS rank FROM hits) WHERE rank <= {k} AND score >= 1.0"""


put("batch_search", batch("SELECT item_id AS id, text FROM benchmark", 10))
put("saved_index_search", batch("SELECT conv_id * 1000 + turn AS id, text FROM conversations WHERE role = 'user'", 5))
QUERY = "q AS (SELECT DISTINCT title AS query FROM p)"
SUMMARY = "left(query, 20) || '... 관련 포지션'"
put("query_expand", WITH_P + f", {QUERY} SELECT query, {rule_text('query')} AS search_query, {SUMMARY} AS summary, 'rules' AS provider FROM q")
put("stored_expansion", WITH_P + f""", {QUERY}, v AS (SELECT query, CASE WHEN length(query) % 4 IN (0, 1) THEN 'first'
    WHEN length(query) % 3 = 0 THEN 'second' ELSE 'rules' END AS provider FROM q)
  SELECT query, CASE WHEN provider = 'rules' THEN {rule_text('query')} ELSE query || ' engineer' END AS search_query,
    CASE WHEN provider = 'rules' THEN {SUMMARY} ELSE '요약' END AS summary, provider FROM v""")
put("vector_topk", """WITH q AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1),
  s AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(q AS DOUBLE[]) FROM q)) AS dot FROM embeddings),
  t AS (SELECT * FROM s ORDER BY round(dot, 9) DESC, vec_id LIMIT 20)
  SELECT vec_id, round(dot, 6) AS dot, round_even(100.0 * dot, 1) AS score FROM t WHERE round_even(100.0 * dot, 1) >= 0.0""")
put("vector_batch_topk", """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.e, v.e) AS dot FROM v q, v WHERE q.vec_id % 20 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dot, 9) DESC, vec_id) AS rank FROM s)
  SELECT query_id, vec_id, rank, round(dot, 6) AS dot FROM r WHERE rank <= 5""")
put("embed_texts", "SELECT doc_id, length(left(text, 8000)) AS kept, sha256(left(text, 8000)) AS sha FROM documents")

# ---- feeds
def feed(source, where="TRUE", **fields):
    cols = {c: "''" for c in ("company", "location", "experience", "deadline", "url", "keyword")} | fields
    cols = {"title": "trim(title)"} | cols
    return WITH_P + "SELECT " + ", ".join(f"{v} AS {c}" for c, v in cols.items()) + f", {lit(source)} AS source FROM p WHERE {where}"


K = "CAST(ingest_seq AS VARCHAR)"
OPEN = "coalesce(nullif(deadline, ''), '상시채용')"
IT = it_title("title")
SQUEEZED = r"trim(regexp_replace(title, '\s+', ' ', 'g'))"
WANTED = dict(company="company", location="location", experience="experience", deadline=OPEN,
              url=f"CASE WHEN ingest_seq = 0 THEN '' ELSE 'https://www.wanted.co.kr/wd/' || {K} END", keyword="'개발'")
put("feed_wanted", feed("원티드", **WANTED))
JUMPIT = dict(
    company="company", location="replace(location, ' ', ', ')", deadline=OPEN, keyword="'개발'",
    experience="""CASE WHEN ingest_seq % 4 = 0 THEN CAST(ingest_seq % 6 AS VARCHAR) || '~' || CAST(ingest_seq % 6 + 3 AS VARCHAR) || '년'
      WHEN ingest_seq % 6 = 0 THEN '신입' ELSE CAST(ingest_seq % 6 AS VARCHAR) || '년 이상' END""",
    url=f"CASE WHEN ingest_seq = 0 THEN '' ELSE 'https://jumpit.saramin.co.kr/position/' || {K} END")
put("feed_jumpit", feed("점핏", **JUMPIT))
put("feed_saramin_api", feed("사람인", company="company", location="location", experience="experience", deadline="deadline", url="url", keyword="'개발'"))
DEPT = "CASE WHEN ingest_seq % 3 <> 0 THEN keyword ELSE '' END"
COUPANG_IF = has_any(f"lower(title || ' ' || {DEPT})", COUPANG_TERMS)
COUPANG = dict(company="'쿠팡'", location="location", deadline="'상시채용'",
               url=f"CASE WHEN url <> '' THEN url ELSE 'https://www.coupang.jobs/jobs/' || {K} END",
               keyword=f"coalesce(nullif({DEPT}, ''), '개발·기술')")
put("feed_coupang", feed("쿠팡", COUPANG_IF, **COUPANG))
put("feed_saramin", feed("사람인", IT, company="company", location="location", experience="experience", deadline="deadline",
    url=f"'https://www.saramin.co.kr/zf/' || {K}",
    keyword="keyword || ', B, C' || CASE WHEN (ingest_seq // 20) % 2 = 1 THEN ' (인턴)' ELSE '' END"))
put("feed_linkedin", feed("링크드인", IT, company="company", location="location", deadline="deadline", url=f"'https://kr.example.com/jobs/' || {K}", keyword="'개발'"))
put("feed_naver", feed("네이버", has_any("lower(title || ' ' || keyword || ' ' || experience || ' ' || deadline)", NAVER_TERMS),
    company="'네이버'", location="'성남'", experience="experience", deadline="deadline",
    url=f"'https://recruit.navercorp.com/rcrt/view.do?annoId=' || {K}", keyword="keyword"))
REGION = "regexp_matches({0}, '서울|경기|인천|부산|대구|대전|광주|울산|세종|강원|충북|충남|전북|전남|경북|경남|제주')"
put("feed_jobkorea", feed("잡코리아", IT, company="company",
    location=f"CASE WHEN {REGION.format('location')} THEN location ELSE '' END",
    experience=r"CASE WHEN regexp_matches(experience, '경력\s*\d|신입|무관|년\s*이상|년↑') THEN experience ELSE '' END",
    deadline=rf"CASE WHEN {ISO} THEN deadline ELSE '' END", url=f"'https://www.jobkorea.co.kr/Recruit/GI_Read/' || {K}", keyword="'개발'"))
# with a blank company the segments shift: title, location or experience, ...
SEG = "list_filter([company, title, location, experience], lambda x: x <> '')"
put("feed_jobplanet", WITH_P + rf""", s AS (SELECT *, {SEG} AS segs FROM p), r AS (SELECT *, CASE WHEN len(segs) = 1 THEN segs[1] ELSE segs[2] END AS t,
    CASE WHEN len(segs) = 1 THEN '' ELSE segs[1] END AS c, segs[3:] AS rest FROM s)
  SELECT t AS title, c AS company, coalesce(list_filter(rest, lambda x: {REGION.format('x')} AND length(x) < 20)[1], '') AS location,
    coalesce(list_filter(rest, lambda x: regexp_matches(x, '\d+년|신입|무관') AND length(x) < 20)[1], '') AS experience, '상시채용' AS deadline,
    'https://www.jobplanet.co.kr/job/search?posting_ids=' || {K} AS url, '개발' AS keyword, '잡플래닛' AS source FROM r WHERE {it_title('t')}""")
put("feed_kakao", feed("카카오", company="'카카오'", location="location", deadline="deadline", url=f"'https://careers.kakao.com/jobs/P-' || {K} || '?page=1'", keyword="'개발'"))
put("feed_toss", feed("토스", has_any("lower(title || ' ' || keyword)", TOSS_TERMS), company="'비바'", location="'서울'", deadline="'상시채용'",
    url=f"'https://toss.im/career/job-detail?id=' || {K}", keyword="keyword || ' · 정규직'"))
FIRM = "coalesce(list_filter([company, location], lambda x: x <> title AND length(x) > 1 AND length(x) < 40)[1], '')"
RALLIT = dict(company=FIRM, deadline="'상시채용'", url=f"'https://www.rallit.com/positions/' || {K} || '/x'", keyword="'개발'")
put("feed_rallit", feed("랠릿", "length(trim(title)) >= 3", **RALLIT))
put("feed_rejects", WITH_P + """, r AS (SELECT ingest_seq, ingest_seq // 20 AS page,
    CAST(row_number() OVER (PARTITION BY ingest_seq // 20 ORDER BY ingest_seq) - 1 AS INT) AS nth FROM p)
  SELECT DISTINCT page, CAST(NULL AS INT) AS nth, CASE WHEN page % 5 = 1 THEN 'not json' ELSE 'wrong shape' END AS reason FROM r WHERE page % 5 IN (1, 2, 3)
  UNION ALL SELECT page, nth, CASE WHEN ingest_seq % 9 = 0 THEN 'null record' ELSE 'no title' END FROM r
  WHERE page % 5 IN (0, 4) AND (ingest_seq % 9 = 0 OR ingest_seq % 7 = 0)""")
put("feed_union", WITH_P + f"""SELECT source, count(*) AS cnt FROM (SELECT '원티드' AS source FROM p UNION ALL SELECT '점핏' FROM p
  UNION ALL SELECT '쿠팡' FROM p WHERE {COUPANG_IF} UNION ALL SELECT '랠릿' FROM p WHERE length(trim(title)) >= 3) GROUP BY 1""")

# ---- streams
put("stream_dedup", WITH_P + f"SELECT DISTINCT {UID} AS uid FROM p")
put("stream_dedup_window", """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, user_id, event_type,
  min(event_id) AS first_event FROM events GROUP BY 1, 2, 3""")
put("stream_ingest", WITH_P + f""", {RULES}, p2 AS (SELECT * FROM rules), {E.replace('FROM p)', 'FROM p2)')},
  {UID_DEDUP}, s AS (SELECT *, CASE WHEN trim(company) <> '' THEN {TOKENS} END AS k FROM u),
  f AS (SELECT * FROM s WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY deadline DESC, uid) = 1
    UNION ALL SELECT * FROM s WHERE k IS NULL)
  SELECT uid, title, company, deadline, min_exp, max_exp, {TS} FROM f""")
