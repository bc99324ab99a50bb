"""Queries of this subpackage and their SQL."""

from . import class_lm, exact_dedup, hard_negatives, line_dedup, media, merkle, mixing, pieces, secret_scan, simhash, suffix_dedup, toxicity, warc


def queries() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_pieces": pieces.op2_pieces,
        "op3_simhash": simhash.op3_simhash,
        "op4_class_lm": class_lm.op4_class_lm,
        "op5_media": media.op5_media,
        "op6_secrets": secret_scan.op6_secrets,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
        "op9_mixing": mixing.op9_mixing,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_merkle": merkle.op11_merkle,
        "op12_hard_negatives": hard_negatives.op12_hard_negatives,
        "op13_warc": warc.op13_warc,
    }


def oracle_sql() -> dict:
    return {"op1_exact_dedup": exact_dedup.SQL, "op7_line_dedup": line_dedup.SQL, "op9_mixing": mixing.SQL, "op11_merkle": merkle.SQL, "op12_hard_negatives": hard_negatives.SQL, "op13_warc": warc.SQL}
