"""The registered queries in SQL for DuckDB, over the same given tables.

The SQL states each rule from the data, on its own terms: page texts come from
regular expressions or from the rule a page was generated by, not from a parser.
"""

from __future__ import annotations

from pageloom.functions.text import STOP_WORDS

ORACLES: dict[str, str] = {}

WS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def words(x: str) -> str:
    return f"CAST(len(list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')) AS BIGINT)"


def part(x: str, n: int) -> str:
    return f"regexp_extract({x}, '{URL}', {n})"


def path(x: str) -> str:
    return f"regexp_replace({part(x, 3)}, ';[^/]*$', '')"


def parts(x: str) -> str:
    return f"list_filter(string_split({path(x)}, '/'), lambda s: s <> '')"


def normalize(x: str) -> str:
    u = f"lower({strip(x)})"
    joined = (
        f"({part(u, 1)} || '://' || {part(u, 2)} || {path(u)} || CASE WHEN {part(u, 4)} <> '' "
        f"THEN '?' || array_to_string(list_sort(string_split({part(u, 4)}, '&')), '&') ELSE '' END)"
    )
    return (
        f"CASE WHEN {joined} LIKE '%/' AND len({joined}) - len(replace({joined}, '/', '')) > 3 "
        f"THEN rtrim({joined}, '/') ELSE {joined} END"
    )


def stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def reading(x: str) -> str:
    return f"CAST(greatest(1, {x} // 200) AS BIGINT)"


def unescape(x: str) -> str:
    return f"regexp_replace(replace({x}, '&quot;', '\"'), '&amp;?', '&', 'g')"


def pieces(x: str) -> str:
    """Stripped text pieces between tags."""
    return (
        f"list_filter(list_transform(regexp_split_to_array({x}, '<[^>]*>'), "
        f"lambda s: {strip(unescape('s'))}), lambda s: s <> '')"
    )


RAW = """raw AS (
  SELECT *, CASE WHEN page_id % 20 = 0 THEN 404 WHEN page_id % 20 = 1 THEN 500 ELSE 200 END AS status_code,
    CASE WHEN page_id % 10 = 3 THEN 'application/pdf' ELSE 'text/html; charset=utf-8' END AS content_type,
    'job-' || (page_id % 5) AS job_id, CAST(page_id % 4 AS INTEGER) AS depth,
    CAST((page_id % 100) / 100.0 AS DOUBLE) AS response_time,
    TIMESTAMP '2024-01-01 00:00:00' + page_id * INTERVAL 1 MINUTE AS fetched_at
  FROM pages),
fetched AS (SELECT * FROM raw WHERE status_code < 400 AND content_type LIKE 'text/html%')"""

DOC_URL = "'https://' || source || '.example.com/' || lang || '/t' || (doc_id % 7) || '/' || doc_id"
HOST = "'https://' || source || '.example.com'"


def _keywords(docs: str, key: str, body: str) -> str:
    return f"""tok AS (
  SELECT {key} AS k, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM (
    SELECT {key}, regexp_split_to_array(lower({body}), '[^\\p{{L}}\\p{{N}}_]+') AS ws FROM {docs})),
kw AS (
  SELECT k, w, n, CAST(row_number() OVER (PARTITION BY k ORDER BY n DESC, i) - 1 AS INTEGER) AS rank
  FROM (SELECT k, w, count(*) AS n, min(i) AS i FROM tok
        WHERE regexp_full_match(w, '[a-z]{{2,}}') AND w NOT IN ({STOP}) GROUP BY k, w)
  QUALIFY rank < 20)"""


PAGES = f"""docs AS (
  SELECT d.*, {DOC_URL} AS url, quality FROM documents d LEFT JOIN labels USING (doc_id)),
page AS (
  SELECT *, sha256({normalize('url')}) AS _id, string_split(text, chr(10))[1] AS title,
    md5(text) AS content_hash, {words('text')} AS word_count,
    TIMESTAMP '2024-01-01 00:00:00' + (doc_id % 1000) * INTERVAL 1 MINUTE AS seen,
    CASE WHEN doc_id % 50 = 0 THEN '' ELSE lang END AS section,
    CASE WHEN doc_id % 11 = 0 THEN '' ELSE 't' || (doc_id % 7) END AS subsection,
    CAST(60 * coalesce(quality, 0) + n_chars % 40 AS DOUBLE) AS quality_score
  FROM docs)"""

NEXT = f"""upcoming AS (
  SELECT {DOC_URL} AS url, text || ' updated' AS body, doc_id FROM documents WHERE lang IN ('en', 'fr')
  UNION ALL SELECT {DOC_URL}, text, doc_id FROM documents WHERE lang = 'de'
  UNION ALL SELECT {DOC_URL} || '/new', text, doc_id FROM documents WHERE lang = 'en'),
later AS (
  SELECT url, md5(body) AS content_hash,
    TIMESTAMP '2024-01-01 00:00:00' + (doc_id % 1000 + 5000) * INTERVAL 1 MINUTE AS seen FROM upcoming)"""

# The pages after the next crawl was saved and its own pages were removed again.
LAST = PAGES.replace(
    "SELECT d.*,",
    "SELECT d.* REPLACE (CASE WHEN lang IN ('en', 'fr') THEN text || ' updated' ELSE text END AS text),",
)

EVENT_URL = "'https://Site' || (user_id % 10) || '.example.com/p/' || (event_id % 500) || '/?b=1&a=2'"
QUEUE = f"""queue AS (
  SELECT event_id AS seq, {EVENT_URL} AS url, {normalize(EVENT_URL)} AS normalized_url,
    CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'signup' THEN 'skipped'
      WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS status,
    CAST(event_id % 3 + 1 AS INTEGER) AS priority, ts AS discovered_at,
    CAST(event_id % 4 AS INTEGER) AS attempts, 'job-' || (user_id % 7) AS job_id,
    CAST(event_id % 6 AS INTEGER) AS depth,
    CASE WHEN value > 20 THEN ts + INTERVAL 10 DAY END AS next_retry
  FROM events)"""
EVENTS = f"""ev AS (
  SELECT 'job-' || (user_id % 7) AS job_id, {EVENT_URL} AS url, ts, event_id AS seq, props,
    CASE event_type WHEN 'view' THEN 'discovered' WHEN 'click' THEN 'processed' WHEN 'signup' THEN 'duplicate'
      WHEN 'purchase' THEN 'scraped' WHEN 'error' THEN 'failed' END AS kind,
    CAST(event_id % 4 AS INTEGER) AS attempt, CAST(floor(value * 1024) AS BIGINT) AS bytes FROM events)"""
JOBS = f"""{EVENTS},
stats AS (
  SELECT job_id, count(*) FILTER (kind = 'discovered') AS total_urls_discovered,
    count(*) FILTER (kind = 'processed') AS total_urls_processed,
    count(*) FILTER (kind = 'scraped') AS successfully_scraped,
    count(*) FILTER (kind = 'failed') AS failed_urls,
    count(*) FILTER (kind = 'duplicate') AS duplicate_urls,
    coalesce(sum(bytes) FILTER (kind = 'scraped'), 0) / 1048576.0 AS total_size_mb,
    min(ts) AS start_time, max(ts) AS last_time FROM ev GROUP BY job_id),
jobs AS (
  SELECT job_id AS _id, 'scrape_' || job_id AS job_name, start_time,
    CASE WHEN CAST(substr(job_id, 5) AS INTEGER) % 5 <> 0 THEN last_time END AS end_time,
    ['running', 'completed', 'failed', 'paused', 'cancelled'][CAST(substr(job_id, 5) AS INTEGER) % 5 + 1] AS status,
    * EXCLUDE (job_id, start_time) FROM stats)"""
JOB_ROW = f"_id, job_name, status, {stamp('start_time')} AS start_time, {stamp('end_time')} AS end_time, successfully_scraped"
STATE = f"""{QUEUE},
state AS (
  SELECT job_id, url, arg_max(status, row(discovered_at, seq)) AS status, max(discovered_at) AS updated_at,
    max(depth) AS depth FROM queue GROUP BY job_id, url)"""

# Scans, sources, sinks

ORACLES["scan_raw_pages"] = f"""WITH {RAW}
SELECT url, octet_length(encode(html)) AS bytes, status_code, content_type, 'e' || page_id AS etag,
  response_time, {stamp('fetched_at')} AS fetched_at, job_id, depth FROM raw"""

ORACLES["route_responses"] = f"""WITH {RAW}
SELECT url, status_code, content_type,
  CASE WHEN status_code >= 400 THEN 'error' WHEN content_type NOT LIKE '%text/html%' THEN 'skipped'
  ELSE 'page' END AS outcome FROM raw"""

ORACLES["upsert_pages"] = f"""WITH {PAGES}, {NEXT}
SELECT coalesce(p.url, l.url) AS url,
  CASE WHEN p.url IS NOT NULL AND l.url IS NOT NULL AND p.content_hash <> l.content_hash THEN 2 ELSE 1 END AS version,
  coalesce(l.content_hash, p.content_hash) AS content_hash,
  {stamp('coalesce(p.seen, l.seen)')} AS scraped_at,
  {stamp("CASE WHEN l.url IS NULL OR p.content_hash = l.content_hash THEN p.seen ELSE l.seen END")} AS last_updated
FROM page p FULL JOIN later l ON p.url = l.url"""

ORACLES["saved_pages"] = ORACLES["upsert_pages"]
ORACLES["saved_pages_before"] = f"""WITH {PAGES}
SELECT url, 1 AS version, content_hash, {stamp('seen')} AS scraped_at, {stamp('seen')} AS last_updated FROM page"""
ORACLES["saved_pages_last"] = f"""WITH {LAST}
SELECT url, CASE WHEN lang IN ('en', 'fr') THEN 2 ELSE 1 END AS version, content_hash, {stamp('seen')} AS scraped_at,
  {stamp("CASE WHEN lang IN ('en', 'fr') THEN seen + INTERVAL 5000 MINUTE ELSE seen END")} AS last_updated FROM page"""
ORACLES["stored_collections"] = """WITH n AS (
  SELECT (SELECT count(*) FROM documents) AS docs, (SELECT count(*) FROM documents WHERE lang = 'en') AS en,
    (SELECT count(DISTINCT user_id % 7) FROM events) AS jobs, (SELECT count(*) FROM events) AS queue)
SELECT version, unnest(['pages', 'scraping_jobs', 'url_queue']) AS collection,
  unnest([docs + CASE WHEN version = 2 THEN en ELSE 0 END, jobs, queue]) AS rows
FROM n, (SELECT unnest([1, 2, 3]) AS version)"""
ORACLES["stored_page"] = f"""WITH {LAST}, {_keywords('docs', 'doc_id', 'text')},
named AS (SELECT k, string_agg(w, '|' ORDER BY rank) AS keywords FROM kw GROUP BY k),
added AS (SELECT sha256({normalize("url || '/new'")}) AS _id, url || '/new' AS url, lang, doc_id, text AS body FROM page WHERE lang = 'en'),
first AS (SELECT * FROM (SELECT _id, doc_id, false AS is_new FROM page UNION ALL SELECT _id, doc_id, true FROM added)
  ORDER BY _id LIMIT 1),
old AS (SELECT doc_id, string_split(text, chr(10))[1] AS title, md5(text) AS hash, {words('text')} AS word_count FROM documents),
{_keywords('documents', 'doc_id', 'text').replace('tok AS', 'old_tok AS').replace('kw AS', 'old_kw AS').replace('FROM tok', 'FROM old_tok')},
old_named AS (SELECT k, string_agg(w, '|' ORDER BY rank) AS keywords FROM old_kw GROUP BY k)
SELECT first._id, page.url || CASE WHEN is_new THEN '/new' ELSE '' END AS url,
  CASE WHEN is_new THEN old.title ELSE page.title END AS title,
  CASE WHEN is_new THEN old.hash ELSE content_hash END AS content_hash,
  CASE WHEN is_new THEN old.word_count ELSE page.word_count END AS word_count,
  {reading('CASE WHEN is_new THEN old.word_count ELSE page.word_count END')} AS reading_time,
  {stamp("CASE WHEN is_new THEN seen + INTERVAL 5000 MINUTE ELSE seen END")} AS scraped_at,
  {stamp("CASE WHEN lang IN ('en', 'fr') THEN seen + INTERVAL 5000 MINUTE ELSE seen END")} AS last_updated,
  'job-' || (page.doc_id % 7) AS scraping_job_id, section, subsection, 'article' AS page_type,
  coalesce(CASE WHEN is_new THEN old_named.keywords ELSE named.keywords END, '') AS keywords, 'processed' AS status,
  CASE WHEN lang IN ('en', 'fr') AND NOT is_new THEN 2 ELSE 1 END AS version, quality_score
FROM first JOIN page USING (doc_id) JOIN old USING (doc_id)
LEFT JOIN named ON named.k = page.doc_id LEFT JOIN old_named ON old_named.k = page.doc_id"""

ORACLES["key_violations"] = f"""WITH {QUEUE}
SELECT normalized_url, job_id, count(*) AS rows FROM queue GROUP BY 1, 2 HAVING count(*) > 1"""

# Documents whose pages were fetched as html.
GOT = "doc_id % 20 > 1 AND doc_id % 10 <> 3"
ORACLES["validate_pages"] = f"""
SELECT {DOC_URL} AS url, array_to_string(list_filter([
  CASE WHEN lang = 'de' THEN 'metadata.response_time: required' END,
  CASE WHEN lang = 'fr' THEN 'quality_score: required' END,
  CASE WHEN lang = 'es' THEN 'navigation.page_type: unknown' END,
  'images.src: not an http url'], lambda v: v IS NOT NULL), '; ') AS violations
FROM documents WHERE {GOT}"""

ORACLES["validate_jobs"] = """
SELECT 'job-' || page_id AS _id, array_to_string(list_filter([
  CASE WHEN page_id % 13 = 0 THEN 'job_name: required' END,
  CASE WHEN page_id % 11 = 0 THEN 'configuration: required' END,
  CASE WHEN page_id % 7 = 0 THEN 'status: unknown' END], lambda v: v IS NOT NULL), '; ') AS violations
FROM pages WHERE page_id % 13 = 0 OR page_id % 11 = 0 OR page_id % 7 = 0"""

# URL functions

ORACLES["normalize_url"] = f"""WITH {QUEUE}, u AS (
  SELECT url FROM pages UNION ALL SELECT DISTINCT url FROM queue)
SELECT url, {normalize('url')} AS normalized FROM u"""

RICH_LINKS = f"""rich AS (SELECT *, {DOC_URL} AS url, {HOST} AS host FROM documents),
hrefs AS (
  SELECT *, unnest([host || '/', host || '/', host || '/' || lang, host || '/' || lang || '/next/' || doc_id,
      host || '/' || lang || '/t' || (doc_id % 7) || '/back?d=' || doc_id, url || '#top',
      'https://Other.example.org/' || doc_id || '.pdf', host || '/empty']) AS href,
    unnest(['Skip', 'Home', source, 'Next page', 'Go back', 'Top', 'Paper', '']) AS label,
    unnest([-1, 0, 1, 2, 3, 4, 5, -1]) AS pos FROM rich)"""

ORACLES["link_types"] = f"""WITH {RICH_LINKS}
SELECT url, href, CASE WHEN href LIKE 'https://Other%' THEN 'external' ELSE 'internal' END AS type FROM hrefs"""

ORACLES["url_sections"] = f"""
SELECT url, coalesce({parts('url')}[1], '') AS section, coalesce({parts('url')}[2], '') AS subsection FROM pages"""

ORACLES["url_page_type"] = f"""WITH u AS (
  SELECT doc_id, 'https://' || source || '/' || lang || '/' ||
    ['blog', 'docs', 'documentation', 'about', 'contact', 'x'][(len(source) * 3 + len(lang) + doc_id % 6) % 6 + 1]
    || '//p' AS url FROM documents
  UNION ALL SELECT doc_id, 'https://' || source || '?q=' || lang FROM documents),
p AS (SELECT *, {parts('url')} AS ps FROM u)
SELECT doc_id, url, CASE WHEN len(ps) = 0 THEN 'home' WHEN list_contains(ps, 'blog') THEN 'blog'
  WHEN list_has_any(ps, ['docs', 'documentation']) THEN 'documentation' WHEN list_contains(ps, 'about') THEN 'about'
  WHEN list_contains(ps, 'contact') THEN 'contact' ELSE 'article' END AS page_type FROM p"""

ORACLES["allowed_links"] = f"""WITH {RICH_LINKS}
SELECT url, href FROM hrefs WHERE source LIKE '%1' AND href NOT LIKE '%.pdf'"""

EXCLUDED = "regexp_matches({0}, '/t[a-h]') OR regexp_matches({0}, '[?&]utm_') OR regexp_matches({0}, 'ing$')"
ORACLES["excluded_urls"] = f"SELECT url, {EXCLUDED.format('url')} AS is_excluded FROM pages"


def robots(prefix: str) -> str:
    return f"""rule AS (
  SELECT {part('url', 2)} AS host, CASE WHEN page_id % 4 = 0 THEN 'loom' ELSE '*' END AS agent, page_id AS seq,
    page_id % 3 = 0 AS allow, {prefix} AS prefix FROM pages),
named AS (SELECT DISTINCT host FROM rule WHERE agent = 'loom'),
active AS (
  SELECT rule.* FROM rule LEFT JOIN named ON rule.host = named.host
  WHERE (named.host IS NULL) = (agent = '*'))"""


def rest(x: str) -> str:
    return f"regexp_replace({x}, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?(?://[^/?#]*)?', '')"


ORACLES["robots_filter"] = f"""WITH {robots(f"'/' || {parts('url')}[1] || '/'")},
hit AS (
  SELECT p.url, arg_min(a.allow, a.seq) AS allow FROM pages p JOIN active a
  ON a.host = {part('p.url', 2)} AND starts_with({rest('p.url')}, a.prefix) GROUP BY p.url)
SELECT p.url, coalesce(hit.allow, true) AS robots_ok FROM pages p LEFT JOIN hit ON p.url = hit.url"""

# Page extraction

PAGE_TEXT = f"""body AS (
  SELECT *, regexp_replace(html,
    '(?s)<script>.*?</script>|<style>.*?</style>|<nav>.*?</nav>|<footer>.*?</footer>|<!--.*?-->', '<>', 'g') AS kept
  FROM fetched),
clean AS (SELECT *, array_to_string({pieces('kept')}, ' ') AS clean_text FROM body),
chunk AS (
  SELECT url, generate_subscripts(ps, 1) AS i, ps FROM (
    SELECT url, string_split(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<p>') AS ps FROM fetched)),
para AS (
  SELECT url, i, array_to_string({pieces("CASE WHEN contains(ps[i], '</p>') THEN string_split(ps[i], '</p>')[1] ELSE array_to_string(ps[i:], '<p>') END")}, '') AS text
  FROM chunk WHERE i > 1),
paras AS (
  SELECT url, CAST(row_number() OVER (PARTITION BY url ORDER BY i) - 1 AS INTEGER) AS pos, text
  FROM para WHERE length(text) > 10)"""

TITLE = strip(unescape("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))
H1 = strip(unescape("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"))
LANG = "regexp_extract(html, '<html lang=\"([^\"]*)\"', 1)"

ORACLES["extract_pages"] = f"""WITH {RAW}, {PAGE_TEXT},
per_page AS (
  SELECT url, count(*) AS n, {words("string_agg(text, ' ' ORDER BY pos)")} AS w FROM paras GROUP BY url)
SELECT sha256({normalize('c.url')}) AS _id, c.url, {TITLE} AS title, md5(clean_text) AS content_hash,
  {words('clean_text')} AS word_count, {reading(words('clean_text'))} AS reading_time,
  CAST(coalesce(n, 0) AS INTEGER) AS paragraphs, 0 AS links, {LANG} AS html_lang,
  CAST(20 + CASE WHEN coalesce(n, 0) >= 3 THEN 15 ELSE 0 END
    + CASE WHEN coalesce(w, 0) >= 300 THEN 15 WHEN coalesce(w, 0) >= 100 THEN 10 ELSE 0 END + 5 AS DOUBLE) AS quality_score
FROM clean c LEFT JOIN per_page ON c.url = per_page.url"""
ORACLES["stream_ingest"] = ORACLES["extract_pages"]

ORACLES["page_titles"] = f"SELECT url, {TITLE} AS title FROM pages"

ORACLES["page_headings"] = f"""
SELECT url, 0 AS pos, 'h1' AS level, {H1} AS text, '' AS id, '' AS anchor FROM pages"""

ORACLES["page_paragraphs"] = f"""WITH fetched AS (SELECT * FROM pages), {PAGE_TEXT}
SELECT url, pos, md5(text) AS text_hash, CAST(length(text) AS INTEGER) AS chars FROM paras"""

RICH = f"""rich AS (
  SELECT *, {DOC_URL} AS url, {HOST} AS host, CAST(doc_id AS VARCHAR) AS doc,
    string_split(text, chr(10)) AS lines FROM documents)"""
LINE_CELLS = "flatten(list_transform(lines, lambda line, i: [CAST(i - 1 AS VARCHAR), CAST(length(line) AS VARCHAR)]))"
LINK_TEXTS = "['Next page', 'Go back', 'Top', 'Paper']"

ORACLES["extract_rich_pages"] = f"""WITH {RICH}, c AS (
  SELECT doc_id, array_to_string(list_filter(flatten([
    [source || ' ' || doc, 'Home', '/', lang, '/', source, source, lang, doc],
    list_transform(lines, lambda x: {strip('x')}), [{strip('text')}],
    ['Figure', doc, 'In ' || lang, 'Lines', 'line', 'chars'], {LINE_CELLS},
    ['one', lang, doc], {LINK_TEXTS}]), lambda s: s <> ''), ' ') AS clean FROM rich)
SELECT doc_id, md5(clean) AS content_hash, {words('clean')} AS word_count FROM c"""

ORACLES["page_code_blocks"] = f"""WITH {RICH}
SELECT url, 0 AS pos, '' AS language, md5(text) AS content_hash, '' AS file_name FROM rich
UNION ALL SELECT url, 1, lang, md5(text), source || '.txt' FROM rich"""

ORACLES["page_images"] = f"""WITH {RICH}
SELECT url, 0 AS pos, host || '/img/' || doc || '.png' AS src, source AS alt, 't' || doc AS title,
  'Figure' || doc AS caption, '' AS local_path FROM rich
UNION ALL SELECT url, 1, 'pic.gif', '', '', 'In ' || lang, '' FROM rich"""

ORACLES["page_links"] = f"""WITH {RICH_LINKS}
SELECT url, CAST(pos AS INTEGER) AS pos, href, label AS text, CASE WHEN label = 'Top' THEN 'Up' ELSE '' END AS title,
  CASE WHEN label = 'Paper' THEN 'external' ELSE 'internal' END AS type, 'pending' AS status FROM hrefs WHERE pos >= 0"""

ORACLES["page_tables"] = f"""WITH {RICH}, cell AS (
  SELECT url, 0 AS r, 0 AS c, 'line' AS text FROM rich UNION ALL SELECT url, 0, 1, 'chars' FROM rich
  UNION ALL SELECT url, i, 0, CAST(i - 1 AS VARCHAR) FROM (SELECT url, generate_subscripts(lines, 1) AS i FROM rich)
  UNION ALL SELECT url, i, 1, CAST(length(line) AS VARCHAR) FROM (
    SELECT url, generate_subscripts(lines, 1) AS i, unnest(lines) AS line FROM rich))
SELECT url, 0 AS table_pos, 'line|chars' AS headers, 'Lines' AS caption, CAST(r AS INTEGER) AS row_pos,
  CAST(c AS INTEGER) AS col_pos, text FROM cell"""

ORACLES["page_lists"] = f"""WITH {RICH}
SELECT url, 0 AS pos, 'ordered' AS type, 'one' || lang || '|' || lang || '|' || doc AS items FROM rich
UNION ALL SELECT url, 1, 'unordered', lang FROM rich"""

ORACLES["page_navigation"] = f"""WITH {RICH}
SELECT url, 'Home|' || lang || '|' || source AS breadcrumb, host || '/' || lang || '/next/' || doc AS next_page,
  host || '/' || lang || '/t' || (doc_id % 7) || '/back?d=' || doc AS prev_page, lang AS section,
  't' || (doc_id % 7) AS subsection, 'article' AS page_type, 0 AS menu_position FROM rich"""

ORACLES["page_seo"] = f"""WITH {RICH}
SELECT url, 'About ' || source AS meta_description, lang || '|' || source || '|' AS meta_keywords,
  source AS og_title, 'Text ' || doc AS og_description, '/og/' || doc || '.png' AS og_image,
  url AS canonical_url FROM rich"""

ORACLES["page_accessibility"] = f"""WITH {RICH}, t AS (
  SELECT url, array_to_string(flatten([
    [' ' || source || ' ' || doc || 'Home / ' || lang || ' /  ' || source || ' ' || source || lang || ' ' || doc],
    list_transform(lines, lambda x: x || chr(10)),
    [text || ' Figure ' || doc || ' In ' || lang || 'Lineslinechars'], {LINE_CELLS},
    ['one' || lang || doc || 'Next page Go back Top Paper ']]), '') AS raw FROM rich)
SELECT url, false AS has_alt_text, true AS has_headings, 'unknown' AS color_contrast,
  round(greatest(0.0, 100.0 - {words('raw')} / (len(raw) - len(replace(raw, '.', '')) + 1) * 2.0), 6) AS readability_score
FROM t"""

ORACLES["quality_score"] = f"""WITH {RICH}, t AS (
  SELECT url, list_append(list_filter(list_transform(lines, lambda x: {strip('x')}), lambda x: length(x) > 10),
    'Next pageGo backTopPaper') AS ps FROM rich)
SELECT url, CAST(20 + CASE WHEN len(ps) >= 3 THEN 15 ELSE 0 END + 10 + 2 + 10
  + CASE WHEN {words("array_to_string(ps, ' ')")} >= 300 THEN 15 WHEN {words("array_to_string(ps, ' ')")} >= 100 THEN 10 ELSE 0 END
  + 15 AS DOUBLE) AS quality_score FROM t"""

SITE = f"{part('url', 1)} || '://' || {part('url', 2)}"
ORACLES["discover_links"] = f"""WITH h AS (
  SELECT url, {SITE} || unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages
  WHERE {part('url', 2)} IN ('blog.tionsh.example.com', 'tionble.example.org', 'blog.ththan.example.net'))
SELECT DISTINCT url, href FROM h"""

# Derived columns

ORACLES["word_stats"] = f"""
SELECT doc_id, {words('text')} AS word_count, {reading(words('text'))} AS reading_time,
  md5(source || ' ' || text) AS searchable_hash FROM documents"""

ORACLES["content_hash"] = "SELECT doc_id, md5(text) AS content_hash FROM documents"

ORACLES["top_keywords"] = f"""WITH {_keywords('documents', 'doc_id', 'text')}
SELECT k AS doc_id, rank, w AS keyword FROM kw"""

ORACLES["readability"] = f"""
SELECT doc_id, CASE WHEN {words('text')} = 0 THEN 0.0 ELSE round(greatest(0.0,
  100.0 - {words('text')} / (len(text) - len(replace(text, '.', '')) + 1) * 2.0), 6) END AS readability_score
FROM documents"""

ORACLES["page_metadata"] = f"""WITH {RAW}
SELECT url, {stamp('fetched_at')} AS scraped_at, strftime(fetched_at, '%a, %d %b %Y %H:%M:%S GMT') AS last_modified,
  {stamp('fetched_at')} AS last_modified_at, 'e' || page_id AS etag, job_id AS scraping_job_id, depth AS page_depth,
  response_time, 200 AS status_code, CAST(octet_length(encode(html)) AS BIGINT) AS content_length,
  'en' AS language, 'utf-8' AS charset, 'processed' AS status, 1 AS version FROM fetched"""

# Frontier and link graph

ENQUEUE = f"""{RAW}, {robots("regexp_extract(html, '<a href=\"([^\"]*)\"', 1)")},
link AS (
  SELECT job_id, depth, page_id, url AS parent_url, href, min(pos) AS pos FROM (
    SELECT *, {SITE} || unnest(hs) AS href, generate_subscripts(hs, 1) - 1 AS pos FROM (
      SELECT *, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hs FROM raw)) GROUP BY ALL),
cand AS (
  SELECT job_id, href AS url, parent_url, depth, row_number() OVER (ORDER BY page_id, pos) AS seq,
    {normalize('href')} AS normalized_url FROM link),
known AS (SELECT DISTINCT job_id, normalized_url FROM cand WHERE depth = 3),
deeper AS (SELECT * REPLACE (depth + 1 AS depth) FROM cand WHERE depth < 3),
hit AS (
  SELECT u.url, arg_min(a.allow OR a.prefix = '', a.seq) AS allow FROM (SELECT DISTINCT url FROM deeper) u JOIN active a
  ON a.host = {part('u.url', 2)} AND starts_with({rest('u.url')}, a.prefix) GROUP BY u.url),
checked AS (
  SELECT d.*, coalesce(hit.allow, true) AS robots_ok, {EXCLUDED.format('d.url')} AS is_excluded,
    k.job_id IS NOT NULL AS is_known FROM deeper d LEFT JOIN hit ON d.url = hit.url
  LEFT JOIN known k ON k.job_id = d.job_id AND k.normalized_url = d.normalized_url),
decided AS (
  SELECT *, CASE WHEN is_known OR seq > first_ok THEN 'duplicate' WHEN NOT robots_ok THEN 'robots'
    WHEN is_excluded THEN 'excluded' ELSE 'queued' END AS outcome FROM (
    SELECT *, min(CASE WHEN robots_ok AND NOT is_excluded THEN seq END)
      OVER (PARTITION BY job_id, normalized_url) AS first_ok FROM checked))"""

ORACLES["enqueue_links"] = f"""WITH {ENQUEUE}
SELECT url, normalized_url, 'pending' AS status, 2 AS priority, '2024-02-01 00:00:00' AS discovered_at, job_id, depth,
  parent_url, 'manual' AS discovery_method FROM decided WHERE outcome = 'queued'"""
ORACLES["enqueue_outcomes"] = f"""WITH {ENQUEUE}
SELECT job_id, outcome, count(*) AS urls FROM decided GROUP BY 1, 2"""

ORACLES["seed_urls"] = f"""WITH {QUEUE}
SELECT job_id, arg_min(url, seq) AS url, normalized_url, 1 AS priority, 0 AS depth FROM queue GROUP BY job_id, normalized_url"""

CLOSURE = """WITH RECURSIVE n AS (SELECT count(*) AS n FROM documents),
edge AS (
  SELECT doc_id AS src, unnest([(7 * doc_id + 1) % n, (13 * doc_id + 5) % n]) AS dst FROM documents, n),
walk AS (
  SELECT unnest([0, 1]) AS node, 0 AS depth
  UNION SELECT dst, depth + 1 FROM walk JOIN edge ON src = node WHERE depth < {levels})
SELECT CAST(node AS BIGINT) AS node, min(depth) AS depth FROM walk GROUP BY node"""
# No shortest path has as many edges as there are nodes.
ORACLES["crawl_closure"] = CLOSURE.format(levels="(SELECT n FROM n)")
ORACLES["excluded_by_table"] = """WITH word AS (SELECT lower(regexp_extract(text, '^([A-Za-z]+)', 1)) AS w FROM documents),
pat AS (SELECT DISTINCT '[/.]' || substr(w, 1, 6) || '[a-z]*(?:[/.?]|$)' AS p FROM word WHERE w <> '')
SELECT url, EXISTS (SELECT 1 FROM pat WHERE regexp_matches(url, p)) AS is_excluded FROM pages"""
ORACLES["crawl_closure_continued"] = ORACLES["crawl_closure"]
ORACLES["crawl_closure_limited"] = CLOSURE.format(levels=10)

ORACLES["pending_batch"] = f"""WITH {QUEUE}
SELECT job_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY priority, discovered_at, normalized_url) AS INTEGER) AS rank,
  priority, {stamp('discovered_at')} AS discovered_at, normalized_url FROM queue
WHERE status = 'pending' AND (next_retry IS NULL OR next_retry <= TIMESTAMP '2024-02-01')
QUALIFY rank <= 16"""

ORACLES["url_status_latest"] = f"""WITH {STATE}
SELECT job_id, url, status, {stamp('updated_at')} AS updated_at FROM state"""

ORACLES["retry_schedule"] = f"""WITH {QUEUE}
SELECT seq, url, attempts + 1 AS attempts, CASE WHEN attempts + 1 < 3 THEN 'pending' ELSE 'failed' END AS status,
  CASE WHEN attempts + 1 < 3 THEN {stamp("TIMESTAMP '2024-02-01' + (attempts + 1) * INTERVAL 10 SECOND")} END AS next_retry
FROM queue WHERE status = 'failed'"""

ERRORS = f"""{EVENTS}, err AS (
  SELECT job_id, url, props AS error_message, ts, attempt + 1 AS retry_count FROM ev WHERE kind = 'failed')"""
ORACLES["error_log"] = f"""WITH {ERRORS}
SELECT job_id, url, 'processing_error' AS error_type, error_message, 0 AS status_code, {stamp('ts')} AS timestamp,
  retry_count FROM err"""

ORACLES["validate_links"] = f"""WITH {RICH_LINKS}
SELECT url, CAST(pos AS INTEGER) AS pos, href, CASE WHEN len(href) % 5 = 0 THEN 'pending' WHEN len(href) % 3 = 0 THEN 'broken'
  ELSE 'valid' END AS status FROM hrefs WHERE pos >= 0"""

ORACLES["validated_page_links"] = f"""WITH {RICH_LINKS}
SELECT url, string_agg(href || '|' || label || '|' || CASE WHEN label = 'Top' THEN 'Up' ELSE '' END || '|'
  || CASE WHEN label = 'Paper' THEN 'external' ELSE 'internal' END || '|'
  || CASE WHEN len(href) % 5 = 0 THEN 'pending' WHEN len(href) % 3 = 0 THEN 'broken' ELSE 'valid' END,
  chr(10) ORDER BY pos) AS links FROM hrefs WHERE pos >= 0 GROUP BY url"""

ORACLES["open_job"] = f"""
SELECT 'job-' || page_id AS _id, 'site_scrape_20240201_000000' AS job_name, 'full_crawl' AS job_type,
  '2024-02-01 00:00:00' AS start_time, 'running' AS status, url AS start_urls, {part('url', 2)} AS allowed_domains,
  10 AS max_depth, 3 AS retry_attempts, CAST(0 AS BIGINT) AS total_urls_discovered,
  CAST(0 AS DOUBLE) AS percentage_complete, 0 AS errors FROM pages"""

# Dedup and incremental update

ORACLES["dedup_content"] = f"""WITH {PAGES}
SELECT url, content_hash FROM page QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY seen, url) = 1"""

ORACLES["duplicate_groups"] = f"""WITH {PAGES}
SELECT content_hash, count(*) AS copies, arg_min(url, row(seen, url)) AS kept_url FROM page
GROUP BY content_hash HAVING count(*) > 1"""

ORACLES["changed_pages"] = f"""WITH {PAGES}, {NEXT}
SELECT l.url, l.content_hash FROM later l WHERE NOT EXISTS (
  SELECT 1 FROM page p WHERE p.url = l.url AND p.content_hash = l.content_hash)"""

# Queries

SUMMARY = f"""_id, url, title, section, subsection, word_count, {reading('word_count')} AS reading_time, quality_score,
  {stamp('seen')} AS scraped_at"""


def _hits(*terms: str, pages: str = PAGES, docs: str = "documents") -> str:
    """Pages with ``score``: occurrences of the terms in text, title and keywords."""
    wanted = ", ".join(f"'{t}'" for t in terms)

    def tf(x: str) -> str:
        return (
            f"len(list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}_]+'), "
            f"lambda w: w IN ({wanted})))"
        )

    return f"""{pages}, {_keywords(docs, 'doc_id', 'text')},
kw_hits AS (SELECT k, count(*) AS n FROM kw WHERE w IN ({wanted}) GROUP BY k),
scored AS (
  SELECT p.*, CAST({tf('text')} + {tf('title')} + coalesce(n, 0) AS INTEGER) AS score
  FROM page p LEFT JOIN kw_hits ON k = doc_id),
hits AS (SELECT * FROM scored WHERE score > 0)"""


ANY = _hits("thing", "thtion", "license")
ORACLES["search_pages"] = f"WITH {ANY} SELECT {SUMMARY}, score FROM hits ORDER BY score DESC, url LIMIT 100"
ORACLES["search_postings"] = ORACLES["search_pages"]
ORACLES["search_filtered"] = f"""WITH {_hits("thing")}
SELECT {SUMMARY}, score FROM hits WHERE section = 'en' AND quality_score >= 20
  AND (contains(lower(text), 'of the') OR contains(lower(title), 'of the'))
  AND NOT regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])license($|[^\\p{{L}}\\p{{N}}_])')
ORDER BY score DESC, url LIMIT 20 OFFSET 5"""
ORACLES["search_postings_last"] = f"""WITH {_hits("updated", pages=LAST, docs="docs")}
SELECT {SUMMARY}, score FROM hits WHERE quality_score >= 10
  AND (contains(lower(text), 'of the') OR contains(lower(title), 'of the'))
  AND NOT regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])license($|[^\\p{{L}}\\p{{N}}_])')
ORDER BY score DESC, url LIMIT 100"""
ORACLES["search_total"] = f"WITH {ANY} SELECT count(*) AS total_matches FROM hits"
ORACLES["search_response"] = f"""WITH {ANY}, top AS (
  SELECT * FROM hits WHERE section = 'en' ORDER BY score DESC, url LIMIT 10)
SELECT 'thing thtion license' AS query, count(*) AS total_results,
  string_agg(url, '|' ORDER BY score DESC, url) AS urls, 'en' AS section FROM top"""

ORACLES["postings"] = f"""WITH {_keywords('documents', 'doc_id', 'text')},
fields AS (
  SELECT doc_id, text AS body FROM documents
  UNION ALL SELECT doc_id, string_split(text, chr(10))[1] FROM documents),
all_tokens AS (
  SELECT doc_id, unnest(regexp_split_to_array(lower(body), '[^\\p{{L}}\\p{{N}}_]+')) AS w FROM fields
  UNION ALL SELECT k, w FROM kw)
SELECT w AS term, count(DISTINCT doc_id) AS pages, count(*) AS occurrences FROM all_tokens
WHERE w <> '' AND w NOT IN ({STOP}) GROUP BY w"""

ORACLES["filter_pages"] = f"""WITH {PAGES}
SELECT url, quality_score FROM page WHERE section = 'en' AND subsection = 't3' AND quality_score >= 50"""
ORACLES["list_pages"] = f"""WITH {PAGES}
SELECT {SUMMARY}, {stamp('seen')} AS last_updated FROM page WHERE section = 'en'
ORDER BY quality_score DESC, seen DESC, url LIMIT 100 OFFSET 20"""
ORACLES["list_pages_seek"] = f"""WITH {PAGES}
SELECT {SUMMARY}, {stamp('seen')} AS last_updated FROM page ORDER BY quality_score DESC, seen DESC, url LIMIT 60 OFFSET 120"""
ORACLES["search_pages_seek"] = f"WITH {ANY} SELECT {SUMMARY}, score FROM hits ORDER BY score DESC, url LIMIT 25 OFFSET 25"
ORACLES["page_by_id"] = f"""WITH {PAGES}
SELECT _id, url, content_hash, 1 AS version FROM page WHERE _id = (SELECT min(_id) FROM page)"""
ORACLES["page_summary"] = f"WITH {PAGES} SELECT {SUMMARY} FROM page"
ORACLES["page_detail"] = f"""WITH {RICH}, c AS (
  SELECT *, array_to_string(list_filter(flatten([
    [source || ' ' || doc, 'Home', '/', lang, '/', source, source, lang, doc],
    list_transform(lines, lambda x: {strip('x')}), [{strip('text')}],
    ['Figure', doc, 'In ' || lang, 'Lines', 'line', 'chars'], {LINE_CELLS},
    ['one', lang, doc], {LINK_TEXTS}]), lambda s: s <> ''), ' ') AS clean FROM rich WHERE {GOT}),
{_keywords('c', 'doc_id', 'clean')},
named AS (SELECT k, string_agg(w, '|' ORDER BY rank) AS keywords FROM kw GROUP BY k)
SELECT sha256({normalize('url')}) AS _id, url, source || ' ' || doc AS title, md5(clean) AS content_hash,
  {words('clean')} AS word_count, 2 AS headings,
  CAST(len(list_filter(lines, lambda x: length({strip('x')}) > 10)) + 1 AS INTEGER) AS paragraphs, 2 AS code_blocks,
  2 AS images, 6 AS links, 1 AS tables, 2 AS lists,
  {stamp("TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 1 MINUTE")} AS scraped_at,
  'job-' || (doc_id % 5) AS scraping_job_id, lang AS html_lang, 'Home|' || lang || '|' || source AS breadcrumb,
  host || '/' || lang || '/next/' || doc AS next_page, 'About ' || source AS meta_description, url AS canonical_url,
  coalesce(keywords, '') AS keywords, 'processed' AS status, 1 AS version, true AS has_headings
FROM c LEFT JOIN named ON k = doc_id"""

ORACLES["list_jobs"] = f"WITH {JOBS} SELECT {JOB_ROW} FROM jobs ORDER BY jobs.start_time DESC, _id LIMIT 5"
ORACLES["job_by_id"] = f"WITH {JOBS} SELECT {JOB_ROW} FROM jobs WHERE _id = 'job-3'"
ORACLES["job_errors"] = f"""WITH {ERRORS}
SELECT url, error_message, {stamp('ts')} AS timestamp, retry_count FROM err WHERE job_id = 'job-3'"""
ORACLES["latest_job"] = f"WITH {JOBS} SELECT {JOB_ROW} FROM jobs ORDER BY jobs.start_time DESC, _id LIMIT 1"

# Aggregations

ROOTED = "CASE WHEN section = '' THEN 'root' ELSE section END"
ORACLES["site_structure"] = f"""WITH {PAGES}
SELECT {ROOTED} AS section, subsection, count(*) AS page_count, round(avg(quality_score), 6) AS avg_quality
FROM page GROUP BY 1, 2"""
ORACLES["structure_pages"] = f"""WITH {PAGES}
SELECT {ROOTED} AS section, subsection, title, url, quality_score FROM page"""


def _rollup(table: str) -> str:
    return f"""
SELECT CASE WHEN grouping(subsection) = 1 THEN 'section' ELSE 'subsection' END AS level, section,
  coalesce(subsection, '') AS subsection, count(*) AS page_count, round(avg(quality_score), 6) AS avg_quality,
  CASE WHEN grouping(subsection) = 1 THEN count(DISTINCT nullif(sub, '')) ELSE 0 END AS subsections
FROM (SELECT {ROOTED} AS section, subsection, subsection AS sub, quality_score FROM {table})
GROUP BY GROUPING SETS ((section, subsection), (section))
HAVING grouping(subsection) = 1 OR subsection <> ''"""


ORACLES["section_rollup"] = f"WITH {PAGES} {_rollup('page')}"
ORACLES["kept_structure"] = ORACLES["site_structure"].replace(PAGES, LAST)
ORACLES["kept_rollup"] = ORACLES["section_rollup"].replace(PAGES, LAST)
ORACLES["site_rollup"] = f"""WITH crawled AS (
  SELECT coalesce({parts('url')}[1], '') AS section, coalesce({parts('url')}[2], '') AS subsection,
    CAST({words(TITLE)} AS DOUBLE) AS quality_score FROM pages) {_rollup('crawled')}"""

TOTALS = """count(*) AS total_pages, CAST(coalesce(sum(word_count), 0) AS BIGINT) AS total_words,
  round(coalesce(avg(quality_score), 0), 6) AS avg_quality_score"""
ORACLES["content_statistics"] = f"WITH {PAGES} SELECT {TOTALS} FROM page"
ORACLES["kept_statistics"] = ORACLES["content_statistics"].replace(PAGES, LAST)
ORACLES["structure_report"] = f"""WITH {PAGES}, r AS (
  SELECT {ROOTED} AS section, subsection, word_count, quality_score FROM page)
SELECT CASE WHEN grouping(section) = 1 THEN 'site' ELSE 'group' END AS level, coalesce(section, '') AS section,
  coalesce(subsection, '') AS subsection, count(*) AS page_count, CAST(sum(word_count) AS BIGINT) AS words,
  round(avg(quality_score), 6) AS avg_quality FROM r GROUP BY GROUPING SETS ((section, subsection), ())"""
ORACLES["statistics_report"] = f"""WITH {PAGES}, {JOBS}, t AS (SELECT {TOTALS} FROM page),
j AS (SELECT * FROM jobs ORDER BY start_time DESC, _id LIMIT 1)
SELECT total_pages, total_words, avg_quality_score, job_name, status, {stamp('start_time')} AS start_time, failed_urls
FROM t, j"""

ORACLES["job_statistics"] = f"""WITH {JOBS}
SELECT job_id, total_urls_discovered, total_urls_processed, successfully_scraped, failed_urls, duplicate_urls,
  round(total_size_mb, 6) AS total_size_mb FROM stats"""
ORACLES["stream_job_stats"] = ORACLES["job_statistics"]


def _progress(table: str) -> str:
    return f"""progress AS (
  SELECT job_id, max(depth) AS current_depth, count(*) FILTER (status = 'pending') AS urls_in_queue,
    count(*) FILTER (status = 'processing') AS urls_being_processed,
    100.0 * count(*) FILTER (status IN ('completed', 'skipped', 'failed')) / count(*) AS done,
    max(updated_at) AS updated_at FROM {table} GROUP BY job_id)"""


ORACLES["job_progress"] = f"""WITH {STATE}, {_progress('state')}
SELECT job_id, current_depth, urls_in_queue, urls_being_processed, round(done, 6) AS percentage_complete,
  CASE WHEN urls_in_queue + urls_being_processed = 0 THEN 'completed' ELSE 'running' END AS status,
  CASE WHEN urls_in_queue + urls_being_processed = 0 THEN {stamp('updated_at')} END AS end_time FROM progress"""
ORACLES["complete_jobs"] = f"""WITH {STATE}, {JOBS},
closed AS (SELECT * FROM state WHERE status NOT IN ('pending', 'processing') OR job_id > 'job-3'),
{_progress('closed')}
SELECT _id, CASE WHEN over THEN 'completed' ELSE status END AS status,
  {stamp('CASE WHEN over THEN updated_at ELSE end_time END')} AS end_time FROM (
  SELECT jobs.*, updated_at, coalesce(status = 'running' AND urls_in_queue + urls_being_processed = 0, false) AS over
  FROM jobs LEFT JOIN progress ON job_id = _id)"""

# Maintenance

EXPIRED = "status IN ('completed', 'failed') AND discovered_at < TIMESTAMP '2024-01-18'"
ORACLES["retention_queue"] = f"""WITH {QUEUE}
SELECT seq, status, {stamp('discovered_at')} AS discovered_at FROM queue WHERE NOT ({EXPIRED})"""
TORN = EXPIRED.replace("TIMESTAMP '2024-01-18'", "TIMESTAMP '2024-01-18 09:30:00'")
ORACLES["retention_queue_days"] = f"""WITH {QUEUE}
SELECT seq, status, {stamp('discovered_at')} AS discovered_at FROM queue WHERE NOT ({TORN})"""
ORACLES["retention_counts"] = f"""WITH {QUEUE}, {ERRORS}
SELECT 'url_queue_days' AS collection, count(*) FILTER ({TORN}) AS dropped, count(*) FILTER (NOT ({TORN})) AS kept FROM queue
UNION ALL SELECT 'job_error_days', count(*) FILTER (ts < TIMESTAMP '2024-01-18 09:30:00'),
  count(*) FILTER (ts >= TIMESTAMP '2024-01-18 09:30:00') FROM err"""
ORACLES["retention_errors"] = f"""WITH {ERRORS}
SELECT job_id, url, {stamp('ts')} AS timestamp, retry_count FROM err WHERE ts >= TIMESTAMP '2024-01-18'"""
ORACLES["pruned_job_errors"] = """
SELECT 'job-' || (event_id // 100) AS _id, coalesce(string_agg(CAST(event_id AS VARCHAR), '|' ORDER BY ts, event_id)
  FILTER (event_type = 'error' AND ts >= TIMESTAMP '2024-01-18'), '') AS errors FROM events GROUP BY event_id // 100"""
ORACLES["retention_report"] =f"""WITH {QUEUE}
SELECT count(*) FILTER ({EXPIRED}) AS deleted_queue_entries, '2024-01-18T00:00:00' AS cutoff_date FROM queue"""

# Streaming

ORACLES["stream_frontier_watermark"] = f"WITH {QUEUE} SELECT DISTINCT job_id, normalized_url FROM queue"
ORACLES["stream_frontier"] = f"""WITH {QUEUE}
SELECT job_id, normalized_url, arg_min(url, row(discovered_at, url)) AS url,
  {stamp('min(discovered_at)')} AS discovered_at FROM queue GROUP BY job_id, normalized_url"""
ORACLES["stream_versions"] = f"""WITH {RAW}
SELECT url, CASE WHEN page_id % 3 = 0 THEN 3 ELSE 1 END AS version, {stamp('fetched_at')} AS scraped_at,
  {stamp("CASE WHEN page_id % 3 = 0 THEN fetched_at + INTERVAL 200 DAY ELSE fetched_at END")} AS last_updated FROM fetched"""
