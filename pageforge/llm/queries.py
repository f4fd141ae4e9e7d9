"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pageforge.llm import bpe_trie, chunkstore, collisions, fillmiddle, htmltext, langid, licenses, ngramjoin, nndescent, oracles, packing, pii, tokencounts, whitening


def queries() -> dict[str, Callable]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_crf_pii": pii.query,
        "op2_chunk_store": chunkstore.query,
        "op3_license_rules": licenses.query,
        "op4_nn_descent": nndescent.query,
        "op5_ngram_join": ngramjoin.query,
        "op6_html_text": htmltext.query,
        "op7_config_packing": packing.query,
        "op8_string_kernel": langid.query,
        "op9_collision_counting": collisions.query,
        "op10_bpe_trie": bpe_trie.query,
        "op11_chan_whitening": whitening.query,
        "op12_pretoken_counts": tokencounts.query,
        "op13_fill_middle": fillmiddle.query,
    }


def oracle_sql() -> dict[str, str]:
    """Of the others, SQL has no tokenizer, no field, no classifier and no packing, or only a part of their columns."""
    pipeline = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {**oracles.ORACLES, **pipeline}
