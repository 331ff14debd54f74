"""The queries of this package, by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from wayline.llm import bpe, clustering, embeddings, language_id, language_model, licences, packing, pii, quality_classifier, quality_rules, simhash, token_files, whitening

QUERIES = {
    "op1_byte_level_bpe": bpe.op1,
    "op2_embedding_near_dedup": embeddings.op2,
    "op3_packing": packing.op3,
    "op4_simhash_near_dedup": simhash.op4,
    "op5_pii_pseudonyms": pii.op5,
    "op6_token_files": token_files.op6,
    "op7_licence_scan": licences.op7,
    "op8_quality_rules": quality_rules.op8,
    "op9_quality_classifier": quality_classifier.op9,
    "op10_language_model": language_model.op10,
    "op11_language_id": language_id.op11,
    "op12_centroid_clusters": clustering.op12,
    "op13_embedding_whitening": whitening.op13,
}
ORACLE_SQL: dict[str, str] = {"op7_licence_scan": licences.oracle(), "op8_quality_rules": quality_rules.oracle(), "op12_centroid_clusters": clustering.oracle()}
