"""One query for each operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from .codes import op2_codes
from .decontaminate import SQL as _SQL8
from .decontaminate import op8_decontaminate
from .jaccard import SQL as _SQL6
from .jaccard import op6_jaccard
from .language import op4_language
from .media import op10_media
from .packing import op9_packing
from .quality import op1_quality
from .secrets import op7_secrets
from .suffixes import op3_suffixes
from .toxicity import op5_toxicity

QUERIES = {f.__name__: f for f in (op1_quality, op2_codes, op3_suffixes, op4_language, op5_toxicity, op6_jaccard, op7_secrets, op8_decontaminate, op9_packing, op10_media)}
SQL: dict[str, str] = {"op6_jaccard": _SQL6, "op8_decontaminate": _SQL8}
