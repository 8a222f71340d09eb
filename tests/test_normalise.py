"""Texts of all scripts against expected strings."""

from __future__ import annotations

from mnemoframe.plans import records as Q

TEXTS = [
    (1, " A \n\v b ", "a b"), (2, "Straße\tÄÖÜ", "straße äöü"), (3, "你好\u3000 世界", "你好 世界"), (4, "\u00a0ÑANDÚ\u2009É\u00a0", "ñandú é"), (5, None, None), (6, "", ""), (7, "😀 OK", "😀 ok"),
]


def test_every_document_is_normalised(spark, tmp_path):
    spark.createDataFrame([r[:2] for r in TEXTS], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.normalised, r.n_chars) for r in Q.normalise_text(spark, str(tmp_path)).collect()}
    assert got == {i: (want, None if text is None else len(text)) for i, text, want in TEXTS}
