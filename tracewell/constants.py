"""Fixed values of retrieval, scoring and verification."""

from __future__ import annotations

# Weights of the retrieval score.
RETRIEVE = {"semantic": 0.30, "front": 0.25, "text": 0.20, "ratio": 0.15, "keywords": 0.10}
# Weights of the content score; text and front page always count.
CONTENT = {"text": 0.35, "paragraphs": 0.25, "headings": 0.20, "tables": 0.10, "lists": 0.05, "headers_footers": 0.05, "front_page": 0.15}
# Weights of the overall score of a match that is not verified.
OVERALL = {"content": 0.50, "structure": 0.25, "semantic": 0.15, "headers_footers": 0.10}
# Characters that scorers read.
FUZZY_CHARS, ORDER_CHARS, OVERLAP_CHARS, RATIO_CHARS, SEMANTIC_CHARS = 25_000, 60_000, 8_000, 5_000, 4_000
PAGE_CHARS, PAGE_DOC_CHARS = 1_000, 1_500
# The index version, and the sizes of candidate pools.
INDEX_VERSION, TOP_K, MAX_CANDIDATES = 6, 20, 50
# File name endings, and the start of lock files' names.
EXTENSIONS, LOCK_PREFIX = (".docx", ".doc"), "~$"
