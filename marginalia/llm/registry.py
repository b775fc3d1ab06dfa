"""Queries of the training-data operators and the SQL that tells the same rows."""

from __future__ import annotations

from . import chat, decontamination, divergence, licenses, quality_rules, resampling, sharding
from .byte_bpe import op6_byte_bpe
from .chat import op12_chat_format
from .decontamination import op3_decontamination
from .divergence import op13_source_divergence
from .language_id import op7_language_id
from .licenses import op2_license_scan
from .pii import op4_pii
from .quality_classifier import op10_quality_classifier
from .quality_rules import op1_quality_rules
from .resampling import op11_resampling
from .sharding import op8_sharding
from .simhash import op9_simhash
from .substring_dedup import op5_substring_dedup

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_license_scan": op2_license_scan,
    "op3_decontamination": op3_decontamination,
    "op4_pii": op4_pii,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_language_id": op7_language_id,
    "op8_sharding": op8_sharding,
    "op9_simhash": op9_simhash,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_resampling": op11_resampling,
    "op12_chat_format": op12_chat_format,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE_SQL = {
    "op1_quality_rules": quality_rules.oracle(),
    "op2_license_scan": licenses.oracle(),
    "op3_decontamination": decontamination.oracle(),
    "op8_sharding": sharding.oracle(),
    "op11_resampling": resampling.oracle(),
    "op12_chat_format": chat.oracle(),
    "op13_source_divergence": divergence.oracle(),
}
