"""Table schemas and value domains."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, D, B, TS = (
    T.StringType(),
    T.LongType(),
    T.IntegerType(),
    T.DoubleType(),
    T.BooleanType(),
    T.TimestampType(),
)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


def _array(kind: T.DataType) -> T.ArrayType:
    return T.ArrayType(kind)


# The domains of the enumerated fields.
PAGE_TYPES = ("home", "article", "blog", "documentation", "about", "contact")
LINK_TYPES = ("internal", "external", "anchor")
JOB_STATUSES = ("running", "completed", "failed", "paused", "cancelled")
QUEUE_STATUSES = ("pending", "processing", "skipped", "completed", "failed")
EVENT_KINDS = ("discovered", "processed", "scraped", "failed", "duplicate")

RAW_PAGES = _struct(
    url=S,
    html=S,
    status_code=I,
    content_type=S,
    headers=T.MapType(S, S),
    response_time=D,
    fetched_at=TS,
    job_id=S,
    depth=I,
    parent_url=S,
)

HEADING = _struct(level=S, text=S, id=S, anchor=S)
CODE_BLOCK = _struct(language=S, content=S, file_name=S)
IMAGE = _struct(src=S, alt=S, title=S, caption=S, local_path=S)
LINK = _struct(href=S, text=S, title=S, type=S, status=S)
TABLE = _struct(headers=_array(S), rows=_array(_array(S)), caption=S)
LIST = _struct(type=S, items=_array(S))

STRUCTURED_DATA = _struct(
    headings=_array(HEADING),
    paragraphs=_array(S),
    code_blocks=_array(CODE_BLOCK),
    images=_array(IMAGE),
    links=_array(LINK),
    tables=_array(TABLE),
    lists=_array(LIST),
)

PAGES = T.StructType(
    [
        T.StructField("_id", S),
        T.StructField("url", S),
        T.StructField("title", S),
        T.StructField(
            "content",
            _struct(
                raw_html=S,
                clean_text=S,
                structured_data=STRUCTURED_DATA,
                content_hash=S,
                word_count=L,
                reading_time=L,
            ),
        ),
        T.StructField(
            "metadata",
            _struct(
                scraped_at=TS,
                last_updated=TS,
                last_modified=S,
                last_modified_at=TS,
                etag=S,
                scraping_job_id=S,
                page_depth=I,
                parent_url=S,
                response_time=D,
                status_code=I,
                content_length=L,
                language=S,
                html_lang=S,
                charset=S,
            ),
        ),
        T.StructField(
            "navigation",
            _struct(
                breadcrumb=_array(S),
                next_page=S,
                prev_page=S,
                section=S,
                subsection=S,
                page_type=S,
                menu_position=I,
            ),
        ),
        T.StructField(
            "seo",
            _struct(
                meta_description=S,
                meta_keywords=_array(S),
                og_title=S,
                og_description=S,
                og_image=S,
                canonical_url=S,
            ),
        ),
        T.StructField(
            "search_fields",
            _struct(searchable_text=S, keywords=_array(S), tags=_array(S), categories=_array(S)),
        ),
        T.StructField("status", S),
        T.StructField("version", I),
        T.StructField("quality_score", D),
        T.StructField(
            "accessibility",
            _struct(has_alt_text=B, has_headings=B, color_contrast=S, readability_score=D),
        ),
    ]
)

URL_QUEUE = _struct(
    url=S,
    normalized_url=S,
    status=S,
    priority=I,
    discovered_at=TS,
    first_seen_on=S,
    attempts=I,
    job_id=S,
    depth=I,
    parent_url=S,
    discovery_method=S,
    estimated_processing_time=L,
    next_retry=TS,
)

JOB_CONFIGURATION = _struct(
    start_urls=_array(S),
    allowed_domains=_array(S),
    max_depth=I,
    delay_between_requests=D,
    concurrent_requests=I,
    user_agent=S,
    respect_robots_txt=B,
    download_images=B,
    timeout=I,
    retry_attempts=I,
)
JOB_STATISTICS = _struct(
    total_urls_discovered=L,
    total_urls_processed=L,
    successfully_scraped=L,
    failed_urls=L,
    duplicate_urls=L,
    total_size_mb=D,
)
JOB_PROGRESS = _struct(
    current_depth=I, urls_in_queue=L, urls_being_processed=L, percentage_complete=D
)
JOB_ERROR = _struct(
    url=S, error_type=S, error_message=S, status_code=I, timestamp=TS, retry_count=I
)
SCRAPING_JOBS = _struct(
    _id=S,
    job_name=S,
    job_type=S,
    start_time=TS,
    end_time=TS,
    status=S,
    configuration=JOB_CONFIGURATION,
    statistics=JOB_STATISTICS,
    progress=JOB_PROGRESS,
    errors=_array(JOB_ERROR),
    notifications=_array(S),
)

CRAWL_EVENTS = _struct(
    job_id=S, url=S, kind=S, ts=TS, seq=L, attempt=I, bytes=L, depth=I, error_message=S
)
LINK_CHECKS = _struct(href=S, status_code=I)
ROBOTS_RULES = _struct(host=S, agent=S, seq=L, allow=B, path_prefix=S)
