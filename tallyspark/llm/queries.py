"""Registered queries of this package: each applies one operator to its whole table.

Operators that run Python ask the session for smaller batches; their queries write the result, leave
the session as they found it, and delete the tables made on the way.
"""

from __future__ import annotations

import functools

import corpus_pipeline
from tallyspark.llm import bpe, embeddings, langid, media, oracles, packing, paragraphs, secrets, simhash, toxicity, warc
from tallyspark.llm.common import materialize, settings_kept, table
from tallyspark.session import scratch_cleared


def written(query):
    @functools.wraps(query)
    def run(spark, sf_dir):
        with settings_kept(spark), scratch_cleared(spark) as keep:
            return keep(materialize(query(spark, sf_dir), query.__name__))

    return run


@written
def op1_toxicity(spark, sf_dir):
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_warc_archive(spark, sf_dir):
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op3_secret_scan(spark, sf_dir):
    return secrets.scan_documents(table(spark, sf_dir, "documents"))


@written
def op4_bpe_round_trip(spark, sf_dir):
    return bpe.encode_digests(table(spark, sf_dir, "documents"))


@written
def op5_language_id(spark, sf_dir):
    return langid.identify_documents(table(spark, sf_dir, "documents"))


@written
def op6_media_tiff(spark, sf_dir):
    return media.store_documents(table(spark, sf_dir, "documents"))


@written
def op7_mixture_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@written
def op8_simhash_near_dedup(spark, sf_dir):
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


@written
def op9_substring_dedup(spark, sf_dir):
    return paragraphs.dedup_documents(table(spark, sf_dir, "documents"))


@written
def op10_embedding_near_dedup(spark, sf_dir):
    return embeddings.cosine_components(table(spark, sf_dir, "embeddings"))


def pipeline(spark, sf_dir):
    with settings_kept(spark):
        return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {
        "op1_toxicity": op1_toxicity,
        "op2_warc_archive": op2_warc_archive,
        "op3_secret_scan": op3_secret_scan,
        "op4_bpe_round_trip": op4_bpe_round_trip,
        "op5_language_id": op5_language_id,
        "op6_media_tiff": op6_media_tiff,
        "op7_mixture_packing": op7_mixture_packing,
        "op8_simhash_near_dedup": op8_simhash_near_dedup,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_embedding_near_dedup": op10_embedding_near_dedup,
        "pipeline": pipeline,
    }


def oracle_sql():
    return dict(oracles.ORACLES)
