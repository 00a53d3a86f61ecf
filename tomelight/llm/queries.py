"""The registered queries of this subpackage and their DuckDB SQL."""

from .conversations import ORACLE_OP11, op11_persistent_audit
from .embedding_dedup import ORACLE_OP10, op10_projection_dedup
from .exact_dedup import ORACLE_OP6, op6_exact_dedup
from .fill_in_middle import ORACLE_OP12, op12_line_middles
from .line_dedup import op9_line_winnowing
from .minhash_dedup import ORACLE_OP3, op3_minhash_dedup
from .mixing import op5_mixing
from .packing import op2_lexical_packing
from .sharding import op8_hash_ring
from .site_trees import op1_site_style_tree
from .token_files import op7_token_files
from .toxicity import op4_compression_toxicity
from .tree_bpe import op13_tree_bpe

QUERIES = {
    "op1_site_style_tree": op1_site_style_tree,
    "op2_lexical_packing": op2_lexical_packing,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_compression_toxicity": op4_compression_toxicity,
    "op5_mixing": op5_mixing,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_token_files": op7_token_files,
    "op8_hash_ring": op8_hash_ring,
    "op9_line_winnowing": op9_line_winnowing,
    "op10_projection_dedup": op10_projection_dedup,
    "op11_persistent_audit": op11_persistent_audit,
    "op12_line_middles": op12_line_middles,
    "op13_tree_bpe": op13_tree_bpe,
}
ORACLES = {
    "op3_minhash_dedup": ORACLE_OP3,
    "op6_exact_dedup": ORACLE_OP6,
    "op10_projection_dedup": ORACLE_OP10,
    "op11_persistent_audit": ORACLE_OP11,
    "op12_line_middles": ORACLE_OP12,
}
