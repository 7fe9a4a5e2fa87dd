"""The queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

from stratum.llm import decontaminate, fingerprint, jaccard, licenses, maxscore, negatives, packing, quality, substring, toxicity, warc, wavelet, whitening

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op10_decontamination": decontaminate.op10_decontamination,
    "op11_maxscore": maxscore.op11_maxscore,
    "op12_negatives": negatives.op12_negatives,
    "op13_whitening": whitening.op13_whitening,
    "op2_jaccard": jaccard.op2_jaccard,
    "op3_quality": quality.op3_quality,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_licenses": licenses.op5_licenses,
    "op6_substring": substring.op6_substring,
    "op7_wavelet": wavelet.op7_wavelet,
    "op8_packing": packing.op8_packing,
    "op9_fingerprint": fingerprint.op9_fingerprint,
}
SQL = {**warc.SQL, **licenses.SQL, **decontaminate.SQL, **jaccard.SQL, **substring.SQL, **maxscore.SQL, **negatives.SQL}
