"""Training-data operators. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def registered() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    """Each operator's query and, where SQL can express it, the equivalent SQL."""
    from loomwire.llm import anchor_codes, block_topk, bpe_prefix, chat_format, decontaminate, harmonic_packing, jump_sharding, license_digest, line_dedup, order_minhash, prefix_trie, rule_quality, url_templates

    modules = {
        "op1_chat_format": chat_format,
        "op2_line_dedup": line_dedup,
        "op3_harmonic_packing": harmonic_packing,
        "op4_jump_sharding": jump_sharding,
        "op5_decontaminate": decontaminate,
        "op6_block_topk": block_topk,
        "op7_order_minhash": order_minhash,
        "op8_url_templates": url_templates,
        "op9_rule_quality": rule_quality,
        "op10_license_digest": license_digest,
        "op11_anchor_codes": anchor_codes,
        "op12_prefix_trie": prefix_trie,
        "op13_bpe_prefix": bpe_prefix,
    }
    return {name: (m.query, m.ORACLE) for name, m in modules.items()}
