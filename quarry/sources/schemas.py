"""The tables of the registry and of the chunks, and how they are opened before anything was written."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

#: Columns by table; JSON is kept as text.
SCHEMAS = {
    "departments": "id string, name string, description string, color string, created_at timestamp",
    "users": "id string, email string, name string, password_hash string, department_id string, role string, is_active boolean, created_at timestamp, last_login timestamp",
    "refresh_tokens": "token string, user_id string, expires_at timestamp, created_at timestamp",
    "documents": "id string, filename string, file_hash string, department_id string, uploaded_by string, universe_id string, visibility string, doc_type string, extracted_facts string, chunk_count int, status string, created_at timestamp",
    "universes": "id string, name string, description string, department_id string, created_by string, status string, created_at timestamp, updated_at timestamp",
    "conversations": "id string, universe_id string, user_id string, title string, created_at timestamp",
    "messages": "id long, conversation_id string, role string, content string, sources string, query_time_ms int, created_at timestamp",
    "audit_log": "id long, user_id string, action string, resource string, department_id string, metadata string, created_at timestamp",
    "document_access": "document_id string, user_id string, granted_by string, created_at timestamp",
    "chunks": "point_id string, vec_id string, vector array<float>, source string, section string, page string, original_id string, doc_id string, department string, visibility string, uploaded_by string, universe_id string, text string",
}


def opened(spark: SparkSession, store: str, name: str) -> DataFrame:
    """A table of a store with all columns of its schema: those that older files lack are null, a table never written is empty."""
    schema = SCHEMAS[name]
    try:
        return spark.read.schema(schema).parquet(f"{store}/{name}")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
