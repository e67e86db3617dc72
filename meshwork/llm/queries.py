"""Queries of the training-data operators, and their SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, codes, content_sort, html, lattice, media, mixing, near_duplicates, oracles, packing, pii, prefix_trie, toxicity, vectors


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_packing": packing.op2_packing,
        "op3_mixing": mixing.op3_mixing,
        "op4_html": html.op4_html,
        "op5_chat": chat.op5_chat,
        "op6_ngram_jaccard": near_duplicates.op6_ngram_jaccard,
        "op7_media": media.op7_media,
        "op8_pii": pii.op8_pii,
        "op9_vectors": vectors.op9_vectors,
        "op10_lattice": lattice.op10_lattice,
        "op11_codes": codes.op11_codes,
        "op12_content_sort": content_sort.op12_content_sort,
        "op13_prefix_trie": prefix_trie.op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    """The other operators' results are learned, packed or stored; they are tested against brute force."""
    return {
        "op5_chat": oracles.CHAT,
        "op6_ngram_jaccard": oracles.NGRAM,
        "op9_vectors": oracles.VECTORS,
        "op11_codes": oracles.CODES,
        "op12_content_sort": oracles.COPIES,
        "op13_prefix_trie": oracles.TRIE,
    }
