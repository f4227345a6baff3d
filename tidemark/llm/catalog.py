"""All queries of this subpackage. Importing an operator registers its query."""

from tidemark.llm import (chat_format, chat_repair, clustering, decontaminate, lm_score, packing, pii, secrets, simhash, token_counts, token_files, topk,  # noqa: F401
                          toxicity)
from tidemark.llm.registry import QUERIES, TWINS


def queries():
    return dict(QUERIES)


def twins():
    return dict(TWINS)
