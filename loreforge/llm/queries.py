"""Queries of the training-data operators, and SQL for those that it can express."""

from loreforge.llm.decontaminate import op2_decontamination
from loreforge.llm.fill_in_middle import OP13_SQL, op13_fill_in_middle
from loreforge.llm.html_wrapper import op6_html_wrapper
from loreforge.llm.license_scan import op7_license_scan
from loreforge.llm.mixing import OP12_SQL, op12_mixing
from loreforge.llm.ngram_join import op10_ngram_join
from loreforge.llm.packing import op5_packing
from loreforge.llm.quality import op1_quality
from loreforge.llm.sharding import op3_sharding
from loreforge.llm.suffix_dedup import op4_suffix_dedup
from loreforge.llm.turn_trie import OP11_SQL, op11_turn_trie
from loreforge.llm.url_filter import OP8_SQL, op8_url_filter
from loreforge.llm.warc_zip import OP9_SQL, op9_warc

QUERIES = {
    "op1_quality": op1_quality,
    "op2_decontamination": op2_decontamination,
    "op3_sharding": op3_sharding,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_packing": op5_packing,
    "op6_html_wrapper": op6_html_wrapper,
    "op7_license_scan": op7_license_scan,
    "op8_url_filter": op8_url_filter,
    "op9_warc": op9_warc,
    "op10_ngram_join": op10_ngram_join,
    "op11_turn_trie": op11_turn_trie,
    "op12_mixing": op12_mixing,
    "op13_fill_in_middle": op13_fill_in_middle,
}
SQL = {
    "op8_url_filter": OP8_SQL,
    "op9_warc": OP9_SQL,
    "op11_turn_trie": OP11_SQL,
    "op12_mixing": OP12_SQL,
    "op13_fill_in_middle": OP13_SQL,
}
