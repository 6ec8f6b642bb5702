"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .binary import op8_token_binary
from .decontamination import ORACLE_OP1, op1_decontamination
from .language import op5_language
from .lexical import ORACLE_OP12, op12_lexical_search
from .licenses import op3_licenses
from .near_duplicates import ORACLE_OP2, op2_near_duplicates
from .nearest import op9_nearest
from .packing import op6_packing
from .pages import ORACLE_OP13, op13_html_text
from .passages import op7_passages
from .pii import op10_pii
from .toxicity import op4_toxicity
from .whitening import op11_whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_decontamination,
        op2_near_duplicates,
        op3_licenses,
        op4_toxicity,
        op5_language,
        op6_packing,
        op7_passages,
        op8_token_binary,
        op9_nearest,
        op10_pii,
        op11_whitening,
        op12_lexical_search,
        op13_html_text,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": ORACLE_OP1, "op2_near_duplicates": ORACLE_OP2, "op12_lexical_search": ORACLE_OP12, "op13_html_text": ORACLE_OP13}
