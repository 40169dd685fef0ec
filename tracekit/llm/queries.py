"""The registered queries of this subpackage: production parameters, whole tables."""

from __future__ import annotations

from . import feistel_pii, line_quality, main_text, merkle_proofs, minhash_hamming, nb_toxicity, piece_lattice, pivot_lists, ppm_language, reply_trees, secret_links, soft_mixing, token_alignment
from .common import table


#: For the registered query only: results must repeat. Real data needs a secret key.
DEMO_KEY = "tracekit-demo-key"


def op1_piece_lattice(spark, sf_dir):
    return piece_lattice.sampled_pieces(table(spark, sf_dir, "documents"))


def op2_secret_links(spark, sf_dir):
    return secret_links.scan_digest(table(spark, sf_dir, "documents"))


def op3_ppm_language(spark, sf_dir):
    return ppm_language.language_table(table(spark, sf_dir, "documents"))


def op4_feistel_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return feistel_pii.pseudonymise(docs, DEMO_KEY, count_col="n_replaced")


def op5_soft_mixing(spark, sf_dir):
    return soft_mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_main_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return main_text.main_text(pages, main_text.fit(pages))


def op7_minhash_hamming(spark, sf_dir):
    return minhash_hamming.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80).drop("text_key")


def op8_pivot_lists(spark, sf_dir):
    return pivot_lists.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_chat_format(spark, sf_dir):
    return reply_trees.chat_digest(spark, table(spark, sf_dir, "conversations"))


def op10_line_quality(spark, sf_dir):
    return line_quality.quality_rules(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark, sf_dir):
    return token_alignment.alignment(table(spark, sf_dir, "documents"))


def op12_merkle_proofs(spark, sf_dir):
    return merkle_proofs.manifest_digest(table(spark, sf_dir, "documents"))


def op13_nb_toxicity(spark, sf_dir):
    return nb_toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_ALL = (op1_piece_lattice, op2_secret_links, op3_ppm_language, op4_feistel_pii, op5_soft_mixing, op6_main_text, op7_minhash_hamming, op8_pivot_lists, op9_chat_format, op10_line_quality, op11_token_alignment, op12_merkle_proofs, op13_nb_toxicity)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {
    "op2_secret_links": secret_links.ORACLE,
    "op7_minhash_hamming": minhash_hamming.ORACLE,
    "op8_pivot_lists": pivot_lists.ORACLE,
    "op9_chat_format": reply_trees.ORACLE,
    "op10_line_quality": line_quality.ORACLE,
    "op12_merkle_proofs": merkle_proofs.ORACLE,
}
