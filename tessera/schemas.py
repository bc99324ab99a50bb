"""Tables of the catalog, kept as segments of Parquet; see plans/store.py."""

from pyspark.sql import types as T


def _schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


DDL = {
    "content": "hash string, body binary, created_at timestamp",
    "documents": "id bigint, collection string, path string, title string, content_hash string, active boolean, indexed_at timestamp, updated_at timestamp",
    "chunks": "id bigint, content_hash string, doc_id bigint, seq int, text string, heading_path string, ordinal int, content_length int",
    "chunk_vectors": "chunk_id bigint, doc_id bigint, vector array<float>",
    "embeddings": "chunk_id bigint, doc_id bigint, provider string, model string, dimension int, embedded_at timestamp",
    "posting_blocks": "term string, block bigint, n int, max_tf int, min_dl int, chunk_ids array<bigint>, doc_ids array<bigint>, tfs array<int>, dls array<int>",
    "chunk_len": "chunk_id bigint, doc_id bigint, dl int",
    "term_stats": "term string, n_all bigint, n_active bigint",
    "tokens": "token string, term string",
    "index_runs": "id bigint, collection string, started_at timestamp, finished_at timestamp, files_scanned bigint, files_added bigint, files_updated bigint, files_removed bigint, error string",
    "llm_cache": "key string, model string, response string, created_at timestamp",
}
#: What a deletion names a row by.
KEYS = {"content": "hash", "documents": "id", "index_runs": "id", "llm_cache": "key"} | dict.fromkeys(("chunks", "chunk_vectors", "embeddings", "posting_blocks", "chunk_len"), "doc_id")
#: Order of rows in a segment, so that a reader skips what it does not look for.
SORTED = {"posting_blocks": ("term", "block"), "term_stats": ("term",), "chunks": ("doc_id", "seq"), "documents": ("id",)}
#: Tables that concurrent commits may both add to.
APPENDED = {"llm_cache", "tokens"}
#: Version of the tables' layout, kept in the manifest: 1 snapshots of whole tables, 2 segments, 3 postings in blocks with kept statistics.
VERSION = 3
RESULT = "doc_id bigint, chunk_id bigint, collection string, path string, title string, heading_path string, snippet string, score double, explain struct<bm25_score:double,bm25_rank:int,vector_distance:double,vector_rank:int,rrf_score:double,rerank_score:double>"


def schema(table: str) -> T.StructType:
    return _schema(DDL[table])
