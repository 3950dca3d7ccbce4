"""Queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import oracles
from .op10_suffix import op10_suffix
from .op1_wavelet import op1_wavelet
from .op2_substring import op2_substring
from .op3_packing import op3_packing
from .op4_language import op4_language
from .op5_quality import op5_quality
from .op6_matroska import op6_matroska
from .op7_sharding import op7_sharding
from .op8_templates import ORACLE_SQL as op8_sql
from .op8_templates import op8_templates
from .op9_bagminhash import op9_bagminhash

QUERIES = {
    "op1_wavelet": op1_wavelet,
    "op2_substring": op2_substring,
    "op3_packing": op3_packing,
    "op4_language": op4_language,
    "op5_quality": op5_quality,
    "op6_matroska": op6_matroska,
    "op7_sharding": op7_sharding,
    "op8_templates": op8_templates,
    "op9_bagminhash": op9_bagminhash,
    "op10_suffix": op10_suffix,
}

ORACLE_SQL: dict[str, str] = {
    "op2_substring": oracles.OP2,
    "op8_templates": op8_sql,
    "op9_bagminhash": oracles.OP9,
    "op10_suffix": oracles.OP10,
}
