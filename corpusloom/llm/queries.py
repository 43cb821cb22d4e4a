"""The subpackage's queries, and SQL for those that SQL can express."""

from __future__ import annotations

from .byte_bpe import op3_byte_bpe
from .decontaminate import OP7_SQL, op7_decontaminate
from .language import op4_language_mixture
from .near_dups import op9_simhash
from .pages import op5_main_text
from .pii import op10_pii
from .quality_classifier import op6_weak_label_quality
from .quality_rules import op2_quality_rules
from .secrets import op1_secret_scan
from .toxicity import op8_toxicity

QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_quality_rules, op3_byte_bpe, op4_language_mixture, op5_main_text, op6_weak_label_quality, op7_decontaminate, op8_toxicity, op9_simhash, op10_pii)}

ORACLE_SQL = {"op7_decontaminate": OP7_SQL}
