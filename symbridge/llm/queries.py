"""The registered queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from symbridge.llm import centroids, licenses, lines, near_duplicates, substrings, tool_calls, vector_codes, warc
from symbridge.llm.decontamination import op2_decontamination
from symbridge.llm.language_model import op5_language_model
from symbridge.llm.licenses import op7_license_scan
from symbridge.llm.near_duplicates import op10_near_duplicates
from symbridge.llm.packing import op9_packing
from symbridge.llm.pii import op6_personal_data
from symbridge.llm.quality import op8_quality_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_tool_calls": tool_calls.op1_tool_calls,
    "op2_decontamination": op2_decontamination,
    "op3_warc": warc.op3_warc,
    "op4_substring_dedup": substrings.op4_substring_dedup,
    "op5_language_model": op5_language_model,
    "op6_personal_data": op6_personal_data,
    "op7_license_scan": op7_license_scan,
    "op8_quality_rules": op8_quality_rules,
    "op9_packing": op9_packing,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_centroid_clustering": centroids.op11_centroid_clustering,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_line_dedup": lines.op13_line_dedup,
}
ORACLES: dict[str, str] = {
    "op1_tool_calls": tool_calls.ORACLE,
    "op3_warc": warc.ORACLE,
    "op4_substring_dedup": substrings.ORACLE,
    "op7_license_scan": licenses.ORACLE,
    "op10_near_duplicates": near_duplicates.ORACLE,
    "op11_centroid_clustering": centroids.ORACLE,
    "op12_vector_codes": vector_codes.ORACLE,
    "op13_line_dedup": lines.ORACLE,
}
