"""The queries of this subpackage and, where SQL can express them, their SQL."""

from . import chat_format, exact_dedup, language_id, line_dedup, media, mixing, near_dedup, pii, quality, sentencepiece_codec

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_pii": pii.op2_pii,
    "op3_quality": quality.op3_quality,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_sentencepiece": sentencepiece_codec.op5_sentencepiece,
    "op6_mixing": mixing.op6_mixing,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_chat_format": chat_format.op8_chat_format,
    "op9_language_id": language_id.op9_language_id,
    "op10_media": media.op10_media,
}
ORACLE_SQL = {"op1_exact_dedup": exact_dedup.OP1_SQL, "op8_chat_format": chat_format.OP8_SQL}
