"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from emberlog.llm import chat, codes, decontaminate, embeddings, hmm, jaccard, language, phrases, pieces, secrets, templates, twins, urls, warc

QUERIES = {
    "op1_chat": chat.op1_chat,
    "op2_embeddings": embeddings.op2_embeddings,
    "op3_url_filters": urls.op3_url_filters,
    "op4_jaccard": jaccard.op4_jaccard,
    "op5_secrets": secrets.op5_secrets,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_hmm": hmm.op7_hmm,
    "op8_language": language.op8_language,
    "op9_sentencepiece": pieces.op9_sentencepiece,
    "op10_warc": warc.op10_warc,
    "op11_extraction": templates.op11_extraction,
    "op12_phrases": phrases.op12_phrases,
    "op13_codes": codes.op13_codes,
}
ORACLES = {name: twins.SQL[name] for name in QUERIES if name in twins.SQL}
