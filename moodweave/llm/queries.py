"""The corpus queries: one thin query per operator, each over its whole table, and their SQL."""

from __future__ import annotations

from . import ann, linededup, lloyd, mixing, packing, pii, quality_qda, quality_rules, sharding, simhash, tokencount, tokenlink, urlfilter
from .common import read


def queries() -> dict:
    docs = lambda f: lambda spark, sf_dir: f(read(spark, sf_dir, "documents"))
    return {
        "op1_sharding": docs(sharding.digest),
        "op2_nearest_neighbours": lambda spark, sf_dir: ann.digest(read(spark, sf_dir, "embeddings")),
        "op3_line_dedup": docs(linededup.digest),
        "op4_simhash": docs(simhash.digest),
        "op5_quality_classifier": lambda spark, sf_dir: quality_qda.digest(
            read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
        ),
        "op6_quality_rules": docs(quality_rules.digest),
        "op7_token_counts": docs(tokencount.digest),
        "op8_mixing": docs(mixing.digest),
        "op9_pii": docs(pii.digest),
        "op10_packing": docs(packing.digest),
        "op11_centroid_clustering": lambda spark, sf_dir: lloyd.digest(read(spark, sf_dir, "embeddings")),
        "op12_token_alignment": docs(tokenlink.digest),
        "op13_url_filters": lambda spark, sf_dir: urlfilter.digest(read(spark, sf_dir, "pages")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_quality_rules": quality_rules.SQL, "op8_mixing": mixing.SQL, "op11_centroid_clustering": lloyd.SQL, "op13_url_filters": urlfilter.SQL}
