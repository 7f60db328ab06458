"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mapql.llm.decontaminate import OP1_SQL, op1_decontamination
from mapql.llm.exact import OP3_SQL, op3_exact_dedup
from mapql.llm.html import OP2_SQL, op2_html
from mapql.llm.lines import OP4_SQL, op4_line_dedup
from mapql.llm.mixing import OP9_SQL, op9_mixing
from mapql.llm.neardup import OP8_SQL, op8_near_dedup
from mapql.llm.quality import op7_quality
from mapql.llm.toxicity import op10_toxicity
from mapql.llm.urls import OP5_SQL, op5_url_filter
from mapql.llm.warc import OP6_SQL, op6_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_html": op2_html,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_warc": op6_warc,
    "op7_quality": op7_quality,
    "op8_near_dedup": op8_near_dedup,
    "op9_mixing": op9_mixing,
    "op10_toxicity": op10_toxicity,
}

ORACLES: dict[str, str] = {
    "op1_decontamination": OP1_SQL,
    "op2_html": OP2_SQL,
    "op3_exact_dedup": OP3_SQL,
    "op4_line_dedup": OP4_SQL,
    "op5_url_filter": OP5_SQL,
    "op6_warc": OP6_SQL,
    "op8_near_dedup": OP8_SQL,
    "op9_mixing": OP9_SQL,
}
