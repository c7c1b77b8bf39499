"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quirelight.llm.chat import OP7_SQL, op7_chat
from quirelight.llm.langid import op13_language
from quirelight.llm.lm import op5_lm
from quirelight.llm.mixing import OP1_SQL, op1_mixing
from quirelight.llm.negatives import OP11_SQL, op11_negatives
from quirelight.llm.packing import op3_packing
from quirelight.llm.quality import op8_quality
from quirelight.llm.runs import op12_runs
from quirelight.llm.secrets import OP6_SQL, op6_secrets
from quirelight.llm.sharding import OP4_SQL, op4_sharding
from quirelight.llm.simhash import op2_simhash
from quirelight.llm.syncmers import op9_syncmers
from quirelight.llm.vectors import op10_vectors

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_mixing": op1_mixing,
        "op2_simhash": op2_simhash,
        "op3_packing": op3_packing,
        "op4_sharding": op4_sharding,
        "op5_lm": op5_lm,
        "op6_secrets": op6_secrets,
        "op7_chat": op7_chat,
        "op8_quality": op8_quality,
        "op9_syncmers": op9_syncmers,
        "op10_vectors": op10_vectors,
        "op11_negatives": op11_negatives,
        "op12_runs": op12_runs,
        "op13_language": op13_language,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1_SQL, "op4_sharding": OP4_SQL, "op6_secrets": OP6_SQL, "op7_chat": OP7_SQL, "op11_negatives": OP11_SQL}
