"""Queries of the training-data operators, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

from . import chat, fingerprint, lines, mixing, near_dedup, packing, quality, runs, secret_scan, suffix_dedup, topk, trie, warc
from .common import table

QUERIES = {
    "op1_suffix_dedup": lambda s, d: suffix_dedup.suffix_dedup_report(table(s, d, "documents")),
    "op2_fingerprint": lambda s, d: fingerprint.fingerprints(table(s, d, "documents")),
    "op3_packing": lambda s, d: packing.packing_report(table(s, d, "documents")),
    "op4_near_dedup": lambda s, d: near_dedup.near_components(table(s, d, "documents")),
    "op5_topk": topk.topk_report,
    "op6_chat": chat.chat_report,
    "op7_line_dedup": lambda s, d: lines.line_dedup_report(table(s, d, "documents")),
    "op8_quality": lambda s, d: quality.quality_report(table(s, d, "documents"), table(s, d, "labels")),
    "op9_secret_scan": lambda s, d: secret_scan.secret_report(table(s, d, "documents")),
    "op10_mixing": lambda s, d: mixing.mixing_report(table(s, d, "documents")),
    "op11_warc": warc.warc_report,
    "op12_trie": trie.trie_report,
    "op13_runs": lambda s, d: runs.runs_report(table(s, d, "documents")),
}

ORACLES = {"op5_topk": topk.SQL, "op6_chat": chat.SQL, "op7_line_dedup": lines.SQL, "op11_warc": warc.SQL, "op12_trie": trie.SQL}
