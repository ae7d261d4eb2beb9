"""Every opN query over the whole small tables: rows, columns, and SQL where there is some."""

import zlib

import pytest

from courtside.llm.queries import ORACLE, QUERIES
from tests.conftest import SF_SMALL
from tests.oracle_compare import compare, duck_conn

COLUMNS = {
    "op1_line_dedup": ["doc_id", "n_lines", "n_kept", "kept_lines"],
    "op2_token_ids": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op3_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op4_simhash": ["doc_id", "fingerprint", "component_id"],
    "op5_repeated_substrings": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op6_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op7_decontamination": ["doc_id", "item_id", "item_words", "distance", "start_word", "end_word"],
    "op8_mixing": ["doc_id", "source", "lang", "topic", "weight", "probability", "sampled"],
    "op9_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op10_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op11_ranked_search": ["item_id", "rank", "doc_id", "score"],
    "op12_chat_formatting": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op13_tokenizer_alignment": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
}


def test_all_are_registered():
    assert set(QUERIES) == set(COLUMNS)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    if name in ("op2_token_ids", "op13_tokenizer_alignment"):
        pytest.importorskip("public_tokenizers")
    table = "pages" if name == "op9_warc" else "documents"
    total = spark.read.parquet(f"{SF_SMALL}/{table}.parquet").count()
    if name in ORACLE:
        assert compare(spark, duck_conn(SF_SMALL), name, SF_SMALL, QUERIES[name], ORACLE[name])["status"] == "ok"
        return
    found = QUERIES[name](spark, SF_SMALL)
    assert found.columns[:len(COLUMNS[name])] == COLUMNS[name]
    rows = found.collect()
    if name != "op7_decontamination":
        assert len(rows) == total and {r.doc_id for r in rows} == set(range(total))
    if name == "op6_sharding":
        text = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
        assert all((r.size, r.text_crc32) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id])) for r in rows)
