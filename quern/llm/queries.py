"""The registered corpus queries."""

from quern.llm import cells, decontamination, html_text, kneser_ney, minhash, packing, quality, secrets, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.op1,
    "op2_embedding_near_dedup": cells.op2,
    "op3_minhash_near_dedup": minhash.op3,
    "op4_secret_scan": secrets.op4,
    "op5_html_extraction": html_text.op5,
    "op6_best_fit_packing": packing.op6,
    "op7_benchmark_decontamination": decontamination.op7,
    "op8_kneser_ney_scoring": kneser_ney.op8,
    "op9_warc": warc.op9,
    "op10_quality_classifier": quality.op10,
}
ORACLES: dict[str, str] = {
    "op2_embedding_near_dedup": cells.ORACLE_SQL,
    "op3_minhash_near_dedup": minhash.ORACLE_SQL,
    "op4_secret_scan": secrets.ORACLE_SQL,
    "op7_benchmark_decontamination": decontamination.ORACLE_SQL,
    "op9_warc": warc.ORACLE_SQL,
}
