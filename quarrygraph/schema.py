"""Schemas as Spark DDL."""

NDJSON = (
    "type string, schema_version int, generator string, provenance_completeness string, id string, entity_type string, source_id string, signature string, description string, "
    "provenance string, content_hash string, kind string, src string, dst string, dst_raw string, candidates array<string>, resolution_qualifier string"
)
ENTITIES = "entity_name string, entity_type string, description string, source_id string, signature string, file_path string, provenance string, content_hash string, extras map<string,string>"
RELATIONS = "src_id string, tgt_id string, keywords string, description string, source_id string, weight double, resolution_qualifier string, dst_raw string, candidates array<string>, provenance string, ord bigint"
VECTORS = "entity_name string, source_id string, embedding array<float>"
META = "key string, value string"
COMMITS = "sha string, author string, ts bigint, message string, files array<struct<path: string, added: bigint, deleted: bigint>>"
CHANGED_FILES = "path string, change_type string, added array<struct<s: bigint, e: bigint>>, deleted array<struct<s: bigint, e: bigint>>"
SNAPSHOTS = "entity string, entity_type string, timestamp timestamp, metrics map<string,double>, workspace string"
REPORT = (
    "target_path string, timestamp string, summary struct<total_files: int, giant_files: int, giant_functions: int, test_smells: int, avg_maintainability: double>, "
    "giant_files array<struct<path: string, lines: int, severity: string>>, giant_functions array<struct<path: string, function_name: string, lines: int, complexity: int>>, "
    "test_smells array<struct<path: string, type: string, details: string, lines: int, line_number: int, metric_value: double>>, maintainability_scores array<struct<path: string, score: double>>, "
    "file_reports array<struct<file_path: string, issues array<struct<category: string, severity: string, metric_value: double>>>>"
).replace("issues array", "issues: array")
