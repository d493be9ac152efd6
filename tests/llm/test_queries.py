"""Every registered query of the subpackage over a small folder with odd rows in every table."""

import zlib

import pytest

from glossmeter.llm import registry

#: The columns that the result of a query begins with.
COLUMNS = {
    "op1": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op5": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op8": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op9": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op10": ["doc_id", "n_shingles", "component_id"],
    "op11": ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"],
    "op12": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op13": ["word", "form", "root", "n", "n_near", "form_n"],
}


@pytest.fixture(scope="module")
def folder(spark, corpus, odd, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    odd.unionByName(corpus.selectExpr("doc_id + 1000 AS doc_id", "text"), allowMissingColumns=True).write.parquet(f"{path}/documents.parquet")
    tables = {
        "labels": ([(1000 + i, i % 2, int(i % 5 == 0)) for i in range(20)] + [(5, None, 1), (None, 0, 0), (1000, 0, 1)], "doc_id long, quality int, toxic int"),
        "pages": ([(1, "http://a.b.example/fr/x", "<p>"), (2, None, None), (2, "no url", ""), (None, "https://c.example", "x"), (5, "http://a.b.example/fr/x", "")],
                  "page_id long, url string, html string"),
        "benchmark": ([(0, corpus.where("doc_id = 4").first()["text"]), (1, None), (None, "no id"), (2, "")], "item_id long, text string"),
        "conversations": ([(1, 0, "user", "Hi."), (1, 1, "assistant", "Ho."), (2, None, None, None), (None, 3, "system", "x"), (1, 1, "assistant", "Ho.")],
                          "conv_id long, turn long, role string, text string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, folder, name):
    out = registry.QUERIES[name](spark, folder)
    rows, wanted = out.collect(), COLUMNS.get(name.split("_")[0], [])
    assert out.columns[:len(wanted)] == wanted
    n = spark.read.parquet(f"{folder}/documents.parquet").count()
    if name.startswith(("op1_", "op2_", "op8_", "op9_", "op10_", "op12_")):
        assert len(rows) == n                              # one row a document, repeated and null ids too
    if name.startswith("op1_"):
        assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1) for r in rows)
    if name.startswith("op9_"):
        texts = {(r["doc_id"], zlib.crc32((r["text"] or "").encode()), len((r["text"] or "").encode()) + 8)
                 for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
        assert {(r["doc_id"], r["text_crc32"], r["size"]) for r in rows} == texts
        assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}
        for shard in {r["shard"] for r in rows}:
            assert 0 <= shard < 24 and sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    if name.startswith("op11_"):
        assert {r["conv_id"] for r in rows} == {1, 2, None} and len(rows) == 3
