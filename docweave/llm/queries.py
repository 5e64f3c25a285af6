"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from docweave.llm import chat, fertility, fim, jpeg, langid, mainhtml, minhash, mixing, packing, quality, simhash, trie, warc

QUERIES = {
    "op1_quality_classifier": quality.op1_quality,
    "op2_language_mixture": langid.op2_language,
    "op3_pfair_mixing": mixing.op3_mixing,
    "op4_tokenizer_fertility": fertility.op4_fertility,
    "op5_main_text": mainhtml.op5_html,
    "op6_reply_trees": chat.op6_chat,
    "op7_merkle_fixity": warc.op7_fixity,
    "op8_power_of_two_packing": packing.op8_pack,
    "op9_golay_simhash": simhash.op9_simhash,
    "op10_baseline_jpeg": jpeg.op10_jpeg,
    "op11_prefix_trie": trie.op11_trie,
    "op12_minhash_densified": minhash.op12_minhash,
    "op13_fill_in_middle": fim.op13_fim,
}

ORACLE_SQL: dict[str, str] = {
    "op7_merkle_fixity": warc.OP7_SQL,
    "op11_prefix_trie": trie.OP11_SQL,
    "op12_minhash_densified": minhash.OP12_SQL,
    "op13_fill_in_middle": fim.OP13_SQL,
}
