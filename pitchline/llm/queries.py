"""Queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

from functools import wraps

from pitchline.llm.audit import OP11_SQL, op11_filter_audit
from pitchline.llm.bpe import op13_word_bpe
from pitchline.llm.common import prepare
from pitchline.llm.decontaminate import op4_edit_decontamination
from pitchline.llm.fim import OP12_SQL, op12_fill_in_middle
from pitchline.llm.langid import op1_language_id
from pitchline.llm.licenses import OP5_SQL, op5_license_rules
from pitchline.llm.mixing import OP10_SQL, op10_mix_sources
from pitchline.llm.passages import op6_collinear_passages
from pitchline.llm.sharding import op2_hilbert_shards
from pitchline.llm.simhash import op9_simhash_golay
from pitchline.llm.toxicity import op7_counterfactual_toxicity
from pitchline.llm.warc import OP8_SQL, op8_warc_roundtrip
from pitchline.llm.winnowing import OP3_SQL, op3_winnowing


def _prepared(fn):
    @wraps(fn)
    def query(spark, sf_dir):
        prepare(spark)
        return fn(spark, sf_dir)
    return query


QUERIES = {f.__name__: _prepared(f) for f in (
    op1_language_id, op2_hilbert_shards, op3_winnowing, op4_edit_decontamination, op5_license_rules,
    op6_collinear_passages, op7_counterfactual_toxicity, op8_warc_roundtrip, op9_simhash_golay, op10_mix_sources,
    op11_filter_audit, op12_fill_in_middle, op13_word_bpe)}
ORACLE = {"op3_winnowing": OP3_SQL, "op5_license_rules": OP5_SQL, "op8_warc_roundtrip": OP8_SQL, "op10_mix_sources": OP10_SQL,
          "op11_filter_audit": OP11_SQL, "op12_fill_in_middle": OP12_SQL}
