"""Queries of this package's operators, and SQL where SQL can express them."""

from __future__ import annotations

from .ann import op3_ann
from .bpe import op8_bpe
from .html import op7_html
from .infill import SQL as INFILL_SQL
from .infill import op13_infill
from .media import op9_media
from .minhash import SQL as MINHASH_SQL
from .minhash import op12_minhash
from .negatives import SQL as NEGATIVES_SQL
from .negatives import op11_negatives
from .packing import op1_packing
from .quality import op2_quality
from .secrets import SQL as SECRETS_SQL
from .secrets import op10_secrets
from .sharding import op5_sharding
from .simhash import op6_simhash
from .toxicity import op4_toxicity

QUERIES = {
    "op1_packing": op1_packing,
    "op2_quality": op2_quality,
    "op3_ann": op3_ann,
    "op4_toxicity": op4_toxicity,
    "op5_sharding": op5_sharding,
    "op6_simhash": op6_simhash,
    "op7_html": op7_html,
    "op8_bpe": op8_bpe,
    "op9_media": op9_media,
    "op10_secrets": op10_secrets,
    "op11_negatives": op11_negatives,
    "op12_minhash": op12_minhash,
    "op13_infill": op13_infill,
}

#: The others need hashes, tokenizers, models or images that SQL lacks.
ORACLE_SQL: dict[str, str] = {"op10_secrets": SECRETS_SQL, "op11_negatives": NEGATIVES_SQL, "op12_minhash": MINHASH_SQL, "op13_infill": INFILL_SQL}
