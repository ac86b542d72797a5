"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import alignment, bpe, chunkbpe, decontaminate, importance, langid, linededup, maxscore, pii, simhash, substrings, tokenfile, warc

QUERIES = {
    "op1_line_dedup": linededup.op1_line_dedup,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op10_language_id": langid.op10_language_id,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_maxscore": maxscore.op4_maxscore,
    "op5_warc": warc.op5_warc,
    "op6_substring_dedup": substrings.op6_substring_dedup,
    "op7_pii": pii.op7_pii,
    "op8_simhash": simhash.op8_simhash,
    "op9_token_files": tokenfile.op9_token_files,
    "op11_importance_resample": importance.op11_importance_resample,
    "op12_chunk_bpe": chunkbpe.op12_chunk_bpe,
    "op13_token_alignment": alignment.op13_token_alignment,
}

#: Only where DuckDB can express the whole query.
ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": linededup.OP1_SQL,
    "op3_decontaminate": decontaminate.OP3_SQL,
    "op4_maxscore": maxscore.OP4_SQL,
    "op5_warc": warc.OP5_SQL,
    "op6_substring_dedup": substrings.OP6_SQL,
    "op11_importance_resample": importance.OP11_SQL,
}
