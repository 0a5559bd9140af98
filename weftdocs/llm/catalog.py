"""Queries of the numbered problems and their SQL, for the entry module."""

from __future__ import annotations

from weftdocs.llm import answers, leak, lookalike, mojibake, neighbours, pack, scanned, split

QUERIES = {
    "p1_found": split.p1_found,
    "p1_balanced": split.p1_balanced,
    "p2_found": answers.p2_found,
    "p3_found": neighbours.p3_found,
    "p4_found": lookalike.p4_found,
    "p4_classes": lookalike.p4_classes,
    "p4_unified": lookalike.p4_unified,
    "p5_found": scanned.p5_found,
    "p5_repaired": scanned.p5_repaired,
    "p6_found": pack.p6_found,
    "p6_fill": pack.p6_fill,
    "p7_found": leak.p7_found,
    "p7_passages": leak.p7_passages,
    "p8_found": mojibake.p8_found,
    "p8_restored": mojibake.p8_restored,
}

ORACLE = {"p1_found": split.P1_SQL, "p6_found": pack.P6_SQL}
