"""The queries of this subpackage and, where SQL can say it, the statements that check them."""

from __future__ import annotations

from .classifier import op4_classifier
from .collocations import ORACLE as COLLOCATIONS_SQL
from .collocations import op12_collocations
from .decontaminate import op8_decontamination
from .divergence import ORACLE as DIVERGENCE_SQL
from .divergence import op13_source_divergence
from .html import op6_html
from .katz import op10_katz
from .minhash import ORACLE as MINHASH_SQL
from .minhash import op11_minhash_dedup
from .ngram_join import checking_sql, op1_ngram_join
from .packing import op7_packing
from .pii import op5_pii
from .rules import op3_quality_rules
from .sharding import op2_sharding
from .warc import op9_warc

QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_sharding, op3_quality_rules, op4_classifier, op5_pii, op6_html, op7_packing, op8_decontamination, op9_warc, op10_katz,
                                  op11_minhash_dedup, op12_collocations, op13_source_divergence)}
ORACLES: dict[str, str] = {"op1_ngram_join": checking_sql(4, 85), "op11_minhash_dedup": MINHASH_SQL, "op12_collocations": COLLOCATIONS_SQL, "op13_source_divergence": DIVERGENCE_SQL}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
