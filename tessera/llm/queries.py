"""Queries of this subpackage by name, with SQL for those that SQL can express."""

from __future__ import annotations

from tessera.llm.alignment import op11_alignment
from tessera.llm.bpe import op6_bpe
from tessera.llm.decontaminate import OP8_SQL, op8_decontaminate
from tessera.llm.hmm import op13_hmm
from tessera.llm.license_scan import OP9_SQL, op9_license_scan
from tessera.llm.line_dedup import OP7_SQL, op7_line_dedup
from tessera.llm.ranked_search import OP12_SQL, op12_search
from tessera.llm.simhash import op2_simhash
from tessera.llm.substring_dedup import OP4_SQL, op4_substring_dedup
from tessera.llm.token_store import op3_token_store
from tessera.llm.toxicity import op10_toxicity
from tessera.llm.vptree import OP5_SQL, op5_vptree
from tessera.llm.warc_store import OP1_SQL, op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_simhash": op2_simhash,
    "op3_token_store": op3_token_store,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_vptree": op5_vptree,
    "op6_bpe": op6_bpe,
    "op7_line_dedup": op7_line_dedup,
    "op8_decontaminate": op8_decontaminate,
    "op9_license_scan": op9_license_scan,
    "op10_toxicity": op10_toxicity,
    "op11_alignment": op11_alignment,
    "op12_search": op12_search,
    "op13_hmm": op13_hmm,
}
ORACLE_SQL = {"op1_warc": OP1_SQL, "op4_substring_dedup": OP4_SQL, "op5_vptree": OP5_SQL, "op7_line_dedup": OP7_SQL, "op8_decontaminate": OP8_SQL, "op9_license_scan": OP9_SQL, "op12_search": OP12_SQL}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
