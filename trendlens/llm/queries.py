"""The queries of this package and their SQL counterparts."""

from trendlens.llm import bpe, chat, fingerprints, jaccard, language, lines, merkle, packing, resample, substrings, urls, vectors, warc

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_vectors": vectors.op2_vectors,
    "op3_chat": chat.op3_chat,
    "op4_jaccard": jaccard.op4_jaccard,
    "op5_language": language.op5_language,
    "op6_packing": packing.op6_packing,
    "op7_substrings": substrings.op7_substrings,
    "op8_urls": urls.op8_urls,
    "op9_warc": warc.op9_warc,
    "op10_fingerprints": fingerprints.op10_fingerprints,
    "op11_merkle": merkle.op11_merkle,
    "op12_lines": lines.op12_lines,
    "op13_resample": resample.op13_resample,
}
ORACLE = {name: sql for name, sql in {
    "op2_vectors": vectors.ORACLE_SQL,
    "op3_chat": chat.ORACLE_SQL,
    "op4_jaccard": jaccard.ORACLE_SQL,
    "op7_substrings": substrings.ORACLE_SQL,
    "op9_warc": warc.ORACLE_SQL,
    "op11_merkle": merkle.ORACLE_SQL,
    "op12_lines": lines.ORACLE_SQL,
    "op13_resample": resample.ORACLE_SQL,
}.items() if sql}
