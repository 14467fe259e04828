"""The queries of this subpackage: p1_ to p10_."""

from __future__ import annotations

from ..runtime import spread
from ..runtime import table as stored
from . import copies, encode, history, leaks, near, oracle, pieces, residue, scans, together, vectors


#: Tables that grow with the corpus and are long in work for their bytes.
LARGE = {"documents", "chunks", "vchunks", "staged_text"}


def table(spark, sf_dir: str, name: str):
    df = stored(spark, sf_dir, name)
    return spread(df) if name in LARGE else df


def queries() -> dict:
    return {
        "p1_found": lambda s, d: history.found(table(s, d, "documents"), table(s, d, "ingest_pending"), table(s, d, "staged_text")),
        "p2_found": lambda s, d: copies.copies(table(s, d, "chunks")),
        "p2_counts": lambda s, d: copies.counts(table(s, d, "chunks")),
        "p3_found": lambda s, d: scans.found(table(s, d, "chunks"), table(s, d, "documents")),
        "p3_text": lambda s, d: scans.repaired(table(s, d, "chunks"), table(s, d, "documents")),
        "p4_found": lambda s, d: together.notable(table(s, d, "doc_equipment")),
        "p4_scores": lambda s, d: together.scored(table(s, d, "doc_equipment")),
        "p5_found": lambda s, d: pieces.oversized(table(s, d, "chunks")),
        "p5_pieces": lambda s, d: pieces.pieces(table(s, d, "chunks")),
        "p6_found": lambda s, d: vectors.similar(table(s, d, "vchunks")),
        "p6_ten": lambda s, d: vectors.ten(table(s, d, "vchunks")),
        "p7_found": lambda s, d: near.found(table(s, d, "chunks")),
        "p7_groups": lambda s, d: near.groups(table(s, d, "chunks")),
        "p8_ids": lambda s, d: encode.ids(table(s, d, "documents")),
        "p9_found": lambda s, d: leaks.leaked(table(s, d, "documents"), table(s, d, "gold")),
        "p9_spans": lambda s, d: leaks.spans(table(s, d, "documents"), table(s, d, "gold")),
        "p10_found": lambda s, d: residue.found(table(s, d, "documents")),
        "p10_evidence": lambda s, d: residue.evidence(table(s, d, "documents")),
        "p10_corpus": lambda s, d: residue.kept(table(s, d, "documents")).select("doc_id", "lang", "n_chars"),
    }


def oracle_sql() -> dict:
    return {
        "p1_found": oracle.P1_FOUND,
        "p2_found": oracle.P2_FOUND,
        "p2_counts": oracle.P2_COUNTS,
        "p4_found": together.SQL_FOUND,
        "p4_scores": together.SQL_SCORED,
        "p5_found": "SELECT DISTINCT chunk_id FROM chunks WHERE length(text) > 1800",
        "p6_found": oracle.P6_FOUND,
        "p7_found": oracle.P7_FOUND,
        "p9_found": oracle.P9_FOUND,
    }
