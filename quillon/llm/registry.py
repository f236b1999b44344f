"""Queries of the training-data operators and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from .chat_format import op3_chat_format
from .html_extract import op1_html_extraction
from .media import op6_media_sniffing
from .mixing import op5_mixing
from .ngram_join import op10_ngram_join
from .oracles import ORACLES
from .packing import op4_best_fit_packing
from .quality_model import op7_quality_classifier
from .quality_rules import op9_quality_rules
from .toxicity import op2_toxicity
from .warc import op8_warc_fixity

QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_toxicity": op2_toxicity,
    "op3_chat_format": op3_chat_format,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_mixing": op5_mixing,
    "op6_media_sniffing": op6_media_sniffing,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_warc_fixity": op8_warc_fixity,
    "op9_quality_rules": op9_quality_rules,
    "op10_ngram_join": op10_ngram_join,
}

__all__ = ["ORACLES", "QUERIES"]
