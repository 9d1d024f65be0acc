"""Queries of the operators in this subpackage, and SQL for those that SQL can express."""

from textmill.llm import answers, garbled, ideas, neighbours, packing, tokens, topn, truncation, truth

QUERIES = {
    "p1_found": truncation.p1_found,
    "p1_share": truncation.p1_share,
    "p2_found": topn.p2_found,
    "p3_found": neighbours.p3_found,
    "p3_recall": neighbours.p3_recall,
    "p4_found": truth.p4_found,
    "p4_agreement": truth.p4_agreement,
    "p4_raters": truth.p4_raters,
    "p5_found": ideas.p5_found,
    "p5_clusters": ideas.p5_clusters,
    "p6_found": answers.p6_found,
    "p6_defects": answers.p6_defects,
    "p7_ids": tokens.p7_ids,
    "p8_packed": packing.p8_packed,
    "p8_fill": packing.p8_fill,
    "p9_found": garbled.p9_found,
    "p9_restored": garbled.p9_restored,
}
ORACLES = {"p2_found": topn.P2_SQL}
