"""A store of crawled pages for the registered queries, written once per session and input folder.

Three commits: the first crawl with its jobs and queue, the next crawl, and the removal of the pages that only
the next crawl had. Queries read it as of one of them, as a job reads tables that earlier jobs left behind.
No other session knows of it, so it goes when the driver ends.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pageloom.operators.saving import PageStore
from pageloom.plans import inputs
from pageloom.session import shared_dir
from pageloom.sources.files import Folder
from pageloom.sources.store import Store

FIRST, NEXT, LAST = 1, 2, 3
# Buckets of the pages, at least, and bytes of the documents' files that one holds, about.
BUCKETS, BUCKET_BYTES = 32, 16_000_000
_stores: dict[tuple[str, str], PageStore] = {}


def crawl_store(spark: SparkSession, sf: str) -> PageStore:
    at = (spark.sparkContext.applicationId, sf)
    if at not in _stores:
        buckets = max(BUCKETS, math.ceil(Folder(spark, sf).bytes("documents.parquet") / BUCKET_BYTES))
        pages = PageStore(Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"), buckets=buckets)
        jobs = inputs.scraping_jobs(spark, sf)
        queue = inputs.url_queue(spark, sf)
        pages.save(
            inputs.page_docs(spark, sf),
            {"scraping_jobs": (jobs, ("_id",)), "url_queue": (queue, ("job_id", "normalized_url"))},
        )
        pages.save(inputs.page_docs_next(spark, sf))
        pages.delete(pages.pages().where(F.endswith("url", F.lit("/new"))))
        pages.store.files.delete_at_exit()
        _stores[at] = pages
    return _stores[at]
