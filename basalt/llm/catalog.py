"""Queries of the training-data operators and of the pipeline."""

from __future__ import annotations

from . import merkle, pipeline, sketches, trie
from .fingerprints import op5_fingerprints
from .html import op2_html
from .langid import op6_langid
from .merkle import op11_merkle
from .mixing import op3_mixing
from .neighbours import op10_neighbours
from .packing import op1_packing
from .pii import op8_pii
from .quality import op4_quality
from .simhash import op7_simhash
from .sketches import op13_minhash
from .toxicity import op9_toxicity
from .trie import op12_trie


def queries() -> dict:
    operators = (op1_packing, op2_html, op3_mixing, op4_quality, op5_fingerprints, op6_langid, op7_simhash, op8_pii, op9_toxicity, op10_neighbours, op11_merkle, op12_trie, op13_minhash)
    return {f.__name__: f for f in operators} | {"pipeline": pipeline.run}


def oracle_sql() -> dict[str, str]:
    own = {"op11_merkle": merkle.SQL, "op12_trie": trie.SQL, "op13_minhash": sketches.SQL}
    return own | ({"pipeline": pipeline.ORACLE_SQL} if pipeline.ORACLE_SQL else {})
