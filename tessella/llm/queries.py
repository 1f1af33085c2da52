"""The queries and SQL of this subpackage."""

from __future__ import annotations

from tessella.llm.decontamination import op10_decontamination
from tessella.llm.licenses import op4_licenses
from tessella.llm.neighbours import op6_neighbours
from tessella.llm.packing import op7_packing
from tessella.llm.quality import op3_quality
from tessella.llm.secrets import op8_secrets
from tessella.llm.simhash import op2_simhash
from tessella.llm.sql import ORACLE
from tessella.llm.substrings import op9_substrings
from tessella.llm.token_files import op1_token_files
from tessella.llm.toxicity import op5_toxicity

__all__ = ["ORACLE", "QUERIES"]

QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_simhash": op2_simhash,
    "op3_quality": op3_quality,
    "op4_licenses": op4_licenses,
    "op5_toxicity": op5_toxicity,
    "op6_neighbours": op6_neighbours,
    "op7_packing": op7_packing,
    "op8_secrets": op8_secrets,
    "op9_substrings": op9_substrings,
    "op10_decontamination": op10_decontamination,
}
