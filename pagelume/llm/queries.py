"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from .bpe import op3_bpe
from .centroids import ORACLE as CENTROID_SQL
from .centroids import op13_centroids
from .chains import op7_chains
from .chat import ORACLE as CHAT_SQL
from .chat import op6_chat
from .collocations import ORACLE as COLLOCATION_SQL
from .collocations import op12_collocations
from .huffman import op11_huffman
from .jaccard_join import op1_jaccard
from .packing import op2_packing
from .quality import op8_quality
from .secrets import op5_secrets
from .spotsigs import op4_spotsigs
from .suffix_dedup import op9_suffix
from .warc import op10_warc

QUERIES = {
    "op1_jaccard": op1_jaccard,
    "op2_packing": op2_packing,
    "op3_bpe": op3_bpe,
    "op4_spotsigs": op4_spotsigs,
    "op5_secrets": op5_secrets,
    "op6_chat": op6_chat,
    "op7_chains": op7_chains,
    "op8_quality": op8_quality,
    "op9_suffix": op9_suffix,
    "op10_warc": op10_warc,
    "op11_huffman": op11_huffman,
    "op12_collocations": op12_collocations,
    "op13_centroids": op13_centroids,
}

ORACLES: dict[str, str] = {"op6_chat": CHAT_SQL, "op12_collocations": COLLOCATION_SQL, "op13_centroids": CENTROID_SQL}
