"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .bpe import op10_bpe
from .chat import OP8_SQL, op8_chat
from .line_dedup import OP1_SQL, op1_line_dedup
from .one_bit import OP3_SQL, op3_one_bit_search
from .orc_ids import op4_orc_ids
from .packing import op2_packing
from .phrases import OP13_SQL, op13_phrases
from .quality_rules import op9_quality_rules
from .secrets import op5_secrets
from .sharding import OP12_SQL, op12_histogram_shards
from .simhash import op6_simhash
from .subwords import op7_quality
from .tiered_index import OP11_SQL, op11_tiered_search

QUERIES = {
    f.__name__: f
    for f in (op1_line_dedup, op2_packing, op3_one_bit_search, op4_orc_ids, op5_secrets, op6_simhash, op7_quality, op8_chat, op9_quality_rules, op10_bpe, op11_tiered_search, op12_histogram_shards, op13_phrases)
}
ORACLES = {"op1_line_dedup": OP1_SQL, "op3_one_bit_search": OP3_SQL, "op8_chat": OP8_SQL, "op11_tiered_search": OP11_SQL, "op12_histogram_shards": OP12_SQL, "op13_phrases": OP13_SQL}
