"""The queries of the training-data operators."""

from __future__ import annotations

from resiq.llm import batches, density, langid, mixing, packing, pairs, splits, subset


def queries() -> dict:
    return {
        "p1_found": density.p1_found,
        "p1_clusters": density.p1_clusters,
        "p3_found": batches.p3_found,
        "p3_batches": batches.p3_batches,
        "p4_found": pairs.p4_found,
        "p4_groups": pairs.p4_groups,
        "p5_subset": subset.p5_subset,
        "p5_report": subset.p5_report,
        "p6_found": splits.p6_found,
        "p6_report": splits.p6_report,
        "p7_containers": packing.p7_containers,
        "p7_fill": packing.p7_fill,
        "p8_mix": mixing.p8_mix,
        "p8_shares": mixing.p8_shares,
        "p9_found": langid.p9_found,
        "p9_segments": langid.p9_segments,
        "p9_labels": langid.p9_labels,
    }


#: Chains of neighbours from each condition point, in whole millionths.
P1 = """WITH RECURSIVE p AS (SELECT ord, round(charge_ph7_4 * 1000000)::BIGINT AS x, round(hydrophobicity_interfacescale_ph8 * 1000000)::BIGINT AS y FROM controllability_sequences
  WHERE charge_ph7_4 IS NOT NULL AND NOT isnan(charge_ph7_4) AND hydrophobicity_interfacescale_ph8 IS NOT NULL AND NOT isnan(hydrophobicity_interfacescale_ph8)),
 c AS (SELECT cluster, round(charge_ph7_4 * 1000000)::BIGINT AS x, round(hydrophobicity_interfacescale_ph8 * 1000000)::BIGINT AS y FROM selected_generation_conditions
  WHERE charge_ph7_4 IS NOT NULL AND NOT isnan(charge_ph7_4) AND hydrophobicity_interfacescale_ph8 IS NOT NULL AND NOT isnan(hydrophobicity_interfacescale_ph8)),
 u AS (SELECT DISTINCT x, y FROM (SELECT x, y FROM p UNION ALL SELECT x, y FROM c)),
 r AS (SELECT cluster, x, y FROM c UNION SELECT r.cluster, u.x, u.y FROM r JOIN u ON abs(u.x - r.x) <= 1500000 AND abs(u.y - r.y) <= 100000)
 SELECT p.ord, r.cluster FROM p JOIN r ON p.x = r.x AND p.y = r.y"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1}
