"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from weftgraph.llm.decontam import OP8_SQL, op8_decontam
from weftgraph.llm.htmlmain import op1_htmlmain
from weftgraph.llm.langid import op5_langid
from weftgraph.llm.lmscore import op6_lmscore
from weftgraph.llm.media import op2_media
from weftgraph.llm.mixing import OP7_SQL, op7_mixing
from weftgraph.llm.pii import op10_pii
from weftgraph.llm.secrets import op9_secrets
from weftgraph.llm.sharding import op3_sharding
from weftgraph.llm.simhash import op4_simhash

QUERIES = {
    "op1_htmlmain": op1_htmlmain,
    "op2_media": op2_media,
    "op3_sharding": op3_sharding,
    "op4_simhash": op4_simhash,
    "op5_langid": op5_langid,
    "op6_lmscore": op6_lmscore,
    "op7_mixing": op7_mixing,
    "op8_decontam": op8_decontam,
    "op9_secrets": op9_secrets,
    "op10_pii": op10_pii,
}
ORACLE = {"op7_mixing": OP7_SQL, "op8_decontam": OP8_SQL}
