"""The numbered operators' queries and the SQL that checks them."""

from __future__ import annotations

from arcwarden.llm.bpe import op11_bpe
from arcwarden.llm.chat import OP8_SQL, op8_chat
from arcwarden.llm.decontam import op3_decontam
from arcwarden.llm.divergence import OP12_SQL, op12_divergence
from arcwarden.llm.forest import op9_forest
from arcwarden.llm.htmltext import op4_htmltext
from arcwarden.llm.langid import op1_langid
from arcwarden.llm.linededup import OP10_SQL, op10_linededup
from arcwarden.llm.merkle import OP13_SQL, op13_merkle
from arcwarden.llm.minhash import OP7_SQL, op7_minhash
from arcwarden.llm.mixing import OP2_SQL, op2_mixing
from arcwarden.llm.quality import op5_quality
from arcwarden.llm.warc import OP6_SQL, op6_warc

QUERIES = {
    "op1_langid": op1_langid,
    "op2_mixing": op2_mixing,
    "op3_decontam": op3_decontam,
    "op4_htmltext": op4_htmltext,
    "op5_quality": op5_quality,
    "op6_warc": op6_warc,
    "op7_minhash": op7_minhash,
    "op8_chat": op8_chat,
    "op9_forest": op9_forest,
    "op10_linededup": op10_linededup,
    "op11_bpe": op11_bpe,
    "op12_divergence": op12_divergence,
    "op13_merkle": op13_merkle,
}

ORACLE_SQL = {
    "op2_mixing": OP2_SQL,
    "op6_warc": OP6_SQL,
    "op7_minhash": OP7_SQL,
    "op8_chat": OP8_SQL,
    "op10_linededup": OP10_SQL,
    "op12_divergence": OP12_SQL,
    "op13_merkle": OP13_SQL,
}
