"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontam import OP2_SQL, op2_decontamination
from .fitpacking import op13_best_fit_packing
from .html import op1_html_extraction
from .licenses import op8_license_scan
from .linededup import OP6_SQL, op6_line_dedup
from .neardup import op10_near_duplicates
from .packing import op5_curve_packing
from .pii import op4_personal_data
from .quality import op7_quality_rules
from .records import op3_token_records
from .turnrepair import OP12_SQL, op12_turn_repair
from .vectorcodes import OP11_SQL, op11_vector_codes
from .wordpiece import op9_token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_html_extraction, op2_decontamination, op3_token_records, op4_personal_data, op5_curve_packing,
        op6_line_dedup, op7_quality_rules, op8_license_scan, op9_token_counts, op10_near_duplicates,
        op11_vector_codes, op12_turn_repair, op13_best_fit_packing,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2_SQL, "op6_line_dedup": OP6_SQL, "op11_vector_codes": OP11_SQL, "op12_turn_repair": OP12_SQL}
