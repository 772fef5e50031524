"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op10_byte_bpe
from .crossentropy import op9_cross_entropy
from .factors import op13_factorisation_machine
from .fim import op12_fill_in_middle
from .hilbert import op5_hilbert_neighbours
from .licenses import op2_license_scan
from .mixing import op1_mixing
from .quality import op3_quality_rules
from .sharding import OP8_SQL, op8_sharding
from .simhash import op6_simhash
from .toxicity import op7_toxicity
from .warc import OP4_SQL, op4_warc
from .whitening import op11_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_license_scan": op2_license_scan,
    "op3_quality_rules": op3_quality_rules,
    "op4_warc": op4_warc,
    "op5_hilbert_neighbours": op5_hilbert_neighbours,
    "op6_simhash": op6_simhash,
    "op7_toxicity": op7_toxicity,
    "op8_sharding": op8_sharding,
    "op9_cross_entropy": op9_cross_entropy,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_whitening": op11_whitening,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_factorisation_machine": op13_factorisation_machine,
}

SQL: dict[str, str] = {
    "op4_warc": OP4_SQL,
    "op8_sharding": OP8_SQL,
}
