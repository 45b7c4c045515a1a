"""Queries of this package for the driver, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assetlode.llm import op2_quotes
from assetlode.llm.op1_pii import op1_pii
from assetlode.llm.op3_partitions import op3_partitions
from assetlode.llm.op4_html import op4_html
from assetlode.llm.op5_minhash import op5_minhash
from assetlode.llm.op6_merges import op6_merges
from assetlode.llm.op7_records import op7_records
from assetlode.llm.op8_packing import op8_packing
from assetlode.llm.op9_quality import op9_quality
from assetlode.llm.op10_toxicity import op10_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_pii, op2_quotes.op2_quotes, op3_partitions, op4_html, op5_minhash, op6_merges, op7_records, op8_packing, op9_quality, op10_toxicity)
}

ORACLES: dict[str, str] = {"op2_quotes": op2_quotes.ORACLE}
