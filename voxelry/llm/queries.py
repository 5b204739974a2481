"""The subpackage's queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from voxelry.llm import clustering, collocations, decontamination, extraction, language, licenses, neardup, neighbours, packing, pii, preferences, quality, sharding


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES = {
    "op1_license_scan": lambda s, d: licenses.licenses(table(s, d, "documents")),
    "op2_packing": lambda s, d: packing.pack(table(s, d, "documents")),
    "op3_preferences": lambda s, d: preferences.preference_pairs(table(s, d, "conversations")),
    "op4_sharding": lambda s, d: sharding.shard_documents(table(s, d, "documents")),
    "op5_language_id": lambda s, d: language.page_languages(table(s, d, "pages")),
    "op6_main_text": lambda s, d: extraction.main_text(table(s, d, "pages")),
    "op7_decontamination": lambda s, d: decontamination.find_items(table(s, d, "documents"), table(s, d, "benchmark")),
    "op8_quality_ledger": lambda s, d: quality.quality(table(s, d, "documents")),
    "op9_personal_data": lambda s, d: pii.personal_data(table(s, d, "documents")),
    "op10_near_duplicates": lambda s, d: neardup.near_duplicates(table(s, d, "documents"), width=2),
    "op11_nearest_vectors": lambda s, d: neighbours.nearest_vectors(table(s, d, "embeddings")),
    "op12_cluster_vectors": lambda s, d: clustering.cluster_vectors(table(s, d, "embeddings")),
    "op13_collocations": lambda s, d: collocations.collocations(table(s, d, "documents")),
}

ORACLE_SQL = {
    "op1_license_scan": licenses.ORACLE_SQL,
    "op3_preferences": preferences.ORACLE_SQL,
    "op4_sharding": sharding.ORACLE_SQL,
    "op8_quality_ledger": quality.ORACLE_SQL,
    "op11_nearest_vectors": neighbours.ORACLE_SQL,
    "op12_cluster_vectors": clustering.ORACLE_SQL,
    "op13_collocations": collocations.ORACLE_SQL,
}
