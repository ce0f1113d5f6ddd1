"""The registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from tablesmith.llm import secrets
from tablesmith.llm.ann import op10_ann
from tablesmith.llm.bpe import op9_bpe
from tablesmith.llm.classifier import op7_quality_classifier
from tablesmith.llm.langid import op2_language_id
from tablesmith.llm.mixing import op4_mixing
from tablesmith.llm.pieces import op12_pieces
from tablesmith.llm.pii import op6_pii
from tablesmith.llm.rules import op3_quality_rules
from tablesmith.llm.secrets import op1_secrets
from tablesmith.llm.simhash import op8_simhash
from tablesmith.llm.toxicity import op5_toxicity
from tablesmith.llm.turntrie import op13_prefix_trie
from tablesmith.llm.whitening import op11_whitening
from tablesmith.session import ship_package


def _shipped(query):
    def run(spark, sf_dir):
        ship_package(spark)
        return query(spark, sf_dir)
    return run


QUERIES = {query.__name__: _shipped(query) for query in (
    op1_secrets, op2_language_id, op3_quality_rules, op4_mixing, op5_toxicity, op6_pii, op7_quality_classifier,
    op8_simhash, op9_bpe, op10_ann, op11_whitening, op12_pieces, op13_prefix_trie)}

ORACLE: dict[str, str] = {"op1_secrets": secrets.ORACLE}
