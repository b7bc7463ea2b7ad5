"""Queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from . import bpe, chat, fingerprints, host_rules, hpylm, mixing, pfp, repair, shards, simhash, token_files, weak_labels, whitening

QUERIES = {
    f.__name__: f
    for f in (
        bpe.op1_bpe,
        hpylm.op2_pitman_yor,
        shards.op3_byte_shards,
        host_rules.op4_host_rules,
        weak_labels.op5_weak_labels,
        fingerprints.op6_bottom_k,
        pfp.op7_prefix_free_parsing,
        token_files.op8_token_files,
        simhash.op9_simhash,
        mixing.op10_mix_sources,
        chat.op11_chat_format,
        repair.op12_conversation_repair,
        whitening.op13_whitening,
    )
}
ORACLES = {"op4_host_rules": host_rules.OP4_SQL, "op10_mix_sources": mixing.OP10_SQL, "op11_chat_format": chat.OP11_SQL, "op12_conversation_repair": repair.OP12_SQL}
