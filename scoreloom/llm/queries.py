"""Registered queries of this folder; the package's entry file adds them when the folder is present."""

from __future__ import annotations

from .byte_cnn import op10_byte_cnn
from .jaccard_join import OP3_SQL, op3_jaccard_join
from .merkle import OP13_SQL, op13_merkle
from .mixing import OP7_SQL, op7_mixing
from .motion_jpeg import op5_motion_jpeg
from .periodic_runs import op12_periodic_runs
from .piece_bpe import op8_pieces
from .quality_rules import OP6_SQL, op6_quality_rules
from .secret_scan import op1_secret_scan
from .sstable import op4_sstable
from .token_spans import op9_token_spans
from .toxicity import op2_toxicity
from .url_filter import OP11_SQL, op11_url_filter

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_toxicity": op2_toxicity,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_sstable": op4_sstable,
    "op5_motion_jpeg": op5_motion_jpeg,
    "op6_quality_rules": op6_quality_rules,
    "op7_mixing": op7_mixing,
    "op8_pieces": op8_pieces,
    "op9_token_spans": op9_token_spans,
    "op10_byte_cnn": op10_byte_cnn,
    "op11_url_filter": op11_url_filter,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_merkle": op13_merkle,
}
#: SQL twins, where SQL can express the whole query.
ORACLE_SQL: dict = {
    "op3_jaccard_join": OP3_SQL,
    "op6_quality_rules": OP6_SQL,
    "op7_mixing": OP7_SQL,
    "op11_url_filter": OP11_SQL,
    "op13_merkle": OP13_SQL,
}
