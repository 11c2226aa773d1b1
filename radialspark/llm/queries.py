"""The registered queries of this subpackage, and the DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import OP3_SQL, op3_chat
from .decontaminate import OP6_SQL, op6_decontaminate
from .fingerprint import op10_fingerprint
from .langid import op4_language
from .neardup import op2_neardup
from .packing import op5_packing
from .shard import op1_shard
from .substring import OP7_SQL, op7_substring
from .suffix import op9_suffix
from .toxicity import op8_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_shard": op1_shard,
    "op2_neardup": op2_neardup,
    "op3_chat": op3_chat,
    "op4_language": op4_language,
    "op5_packing": op5_packing,
    "op6_decontaminate": op6_decontaminate,
    "op7_substring": op7_substring,
    "op8_toxicity": op8_toxicity,
    "op9_suffix": op9_suffix,
    "op10_fingerprint": op10_fingerprint,
}

ORACLE: dict[str, str] = {
    "op3_chat": OP3_SQL,
    "op6_decontaminate": OP6_SQL,
    "op7_substring": OP7_SQL,
}
