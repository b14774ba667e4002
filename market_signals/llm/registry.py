"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from market_signals.llm import embeddings, imatch, language, lexical, licenses, merkle, mixing, pieces, quality, secrets, shingles, suffixes, toxicity

QUERIES = {
    "op1_suffixes": suffixes.op1_suffixes,
    "op2_imatch": imatch.op2_imatch,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_mixing": mixing.op4_mixing,
    "op5_embeddings": embeddings.op5_embeddings,
    "op6_partenum": shingles.op6_partenum,
    "op7_secrets": secrets.op7_secrets,
    "op8_language": language.op8_language,
    "op9_sentencepiece": pieces.op9_sentencepiece,
    "op10_quality": quality.op10_quality,
    "op11_merkle": merkle.op11_merkle,
    "op12_licenses": licenses.op12_licenses,
    "op13_lexical": lexical.op13_lexical,
}

#: Hashing finds nearly all pairs of vectors, and all of those at some distance from the threshold: its SQL is exact.
ORACLES = {
    "op4_mixing": mixing.SQL,
    "op5_embeddings": embeddings.SQL,
    "op6_partenum": shingles.SQL,
    "op11_merkle": merkle.SQL,
    "op12_licenses": licenses.SQL,
    "op13_lexical": lexical.SQL,
}
