"""The registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    return pii.personal_data(table(spark, sf_dir, "documents"))


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffixes

    return suffixes.digest(table(spark, sf_dir, "documents"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import media

    return media.align(media.fingerprints(media.recordings_of(table(spark, sf_dir, "embeddings"))))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import minhash

    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("key")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import packing

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import pieces

    return pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lattice

    return lattice.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    return secrets.secrets(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_suffixes": op2_suffixes,
    "op3_media": op3_media,
    "op4_minhash": op4_minhash,
    "op5_packing": op5_packing,
    "op6_pieces": op6_pieces,
    "op7_lattice": op7_lattice,
    "op8_toxicity": op8_toxicity,
    "op9_secrets": op9_secrets,
    "op10_language": op10_language,
}
SQL: dict[str, str] = {}
