"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from factloom.llm import chat, decontaminate, langid, linededup, media, mixing, quality, secrets, simhash, toxicity
from factloom.llm import oracles as oracle
from factloom.llm.common import table


def queries() -> dict:
    docs = lambda s, d: table(s, d, "documents")
    return {
        "op1_secret_scan": lambda s, d: secrets.secret_report(docs(s, d)),
        "op2_language_id": lambda s, d: langid.language_report(docs(s, d)),
        "op3_simhash": lambda s, d: simhash.near_duplicate_report(docs(s, d)),
        "op4_line_dedup": lambda s, d: linededup.line_report(docs(s, d)),
        "op5_toxicity": lambda s, d: toxicity.toxicity_report(docs(s, d), table(s, d, "labels")),
        "op6_mixing": lambda s, d: mixing.mix_report(docs(s, d)),
        "op7_chat_rotation": lambda s, d: chat.rotate(table(s, d, "conversations")),
        "op8_decontamination": lambda s, d: decontaminate.contamination_report(docs(s, d), table(s, d, "benchmark")),
        "op9_quality": lambda s, d: quality.quality_report(docs(s, d), table(s, d, "labels")),
        "op10_media": lambda s, d: media.media_report(docs(s, d)),
    }


def oracles() -> dict[str, str]:
    return {"op4_line_dedup": oracle.LINE_DEDUP, "op6_mixing": oracle.MIXING, "op7_chat_rotation": oracle.CHAT, "op8_decontamination": oracle.DECONTAMINATION}
