"""The operators' queries by name, and SQL for those that it can express."""

from __future__ import annotations

from .chat import OP8_SQL, op8_chat
from .decontaminate import OP10_SQL, op10_decontaminate
from .filter_audit import OP13_SQL, op13_filter_audit
from .lattice_lm import op6_lattice_lm
from .line_dedup import OP1_SQL, op1_line_dedup
from .line_rules import OP9_SQL, op9_line_rules
from .mixing import op2_mix
from .packing import op11_packing
from .prefix_trie import OP12_SQL, op12_prefix_trie
from .quality import op5_quality
from .simhash import op3_simhash
from .site_tree import op7_site_tree
from .suffix_dedup import op4_suffix_dedup

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_mix": op2_mix,
    "op3_simhash": op3_simhash,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_quality": op5_quality,
    "op6_lattice_lm": op6_lattice_lm,
    "op7_site_tree": op7_site_tree,
    "op8_chat": op8_chat,
    "op9_line_rules": op9_line_rules,
    "op10_decontaminate": op10_decontaminate,
    "op11_packing": op11_packing,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES = {"op1_line_dedup": OP1_SQL, "op8_chat": OP8_SQL, "op9_line_rules": OP9_SQL, "op10_decontaminate": OP10_SQL, "op12_prefix_trie": OP12_SQL, "op13_filter_audit": OP13_SQL}
