"""Queries of the training-data operators by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weft.llm import budget, mixing, oracle, overlap, pairs, sampling, splits, truncation

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "p1_found": pairs.p1_found,
        "p2_found": overlap.p2_found,
        "p2_pairs": overlap.p2_pairs,
        "p2_members": overlap.p2_members,
        "p2_links": overlap.p2_links,
        "p2_report": overlap.p2_report,
        "p4_found": splits.p4_found,
        "p4_assignment": splits.p4_assignment,
        "p4_report": splits.p4_report,
        "p5_found": sampling.p5_found,
        "p5_sample": sampling.p5_sample,
        "p5_gaps": sampling.p5_gaps,
        "p6_token_budget": budget.p6_token_budget,
        "p7_ids": budget.p7_ids,
        "p8_found": mixing.p8_found,
        "p8_mix": mixing.p8_mix,
        "p8_shares": mixing.p8_shares,
        "p8_filled": mixing.p8_filled,
        "p9_found": truncation.p9_found,
        "p9_report": truncation.p9_report,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
