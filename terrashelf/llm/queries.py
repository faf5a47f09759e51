"""The registered queries of these operators and their SQL."""

from __future__ import annotations

import corpus_pipeline
from terrashelf.llm import (
    aligntokens, centroids, chat, decontaminate, exactdedup, minhash, mixing, quality, records, secretscan, simhash, urlfilter,
    warc,
)

MODULES = [
    urlfilter, exactdedup, warc, mixing, simhash, secretscan, decontaminate, records, quality, chat, aligntokens, centroids,
    minhash,
]

QUERIES = {"pipeline": corpus_pipeline.run} | {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
