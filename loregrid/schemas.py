"""Types, constants and schemas of the knowledge model."""

from __future__ import annotations

CHUNK = "id STRING, type STRING, content STRING, title STRING, module STRING, source_path STRING, tokens INT, meta_json STRING"
META = (
    "sdk_class STRING, method STRING, since_version STRING, deprecated_in STRING, required_config ARRAY<STRING>, code_example STRING, related_entity STRING, "
    "security_rule STRING, sdk STRING, version STRING, config_required STRING, source STRING, applicable_version STRING, related_ticket STRING, "
    "knowledge_source STRING, class_name STRING, return_type STRING, calls ARRAY<STRING>, api_type STRING, http_method STRING, url_path STRING"
)
CANDIDATE = "query_id STRING, leg STRING, leg_ord INT, rank INT, id STRING, type STRING, content STRING, score DOUBLE"

# Knowledge types, their boosts, display order and labels; feedback actions.
TYPES = ["term", "api", "document", "best_practice", "defect_history", "security_rule", "test_template", "spec"]
TYPE_BOOST = {"api": 1.0, "best_practice": 0.95, "defect_history": 0.90, "security_rule": 0.85, "term": 0.80, "spec": 0.95, "test_template": 0.75, "document": 0.90}
OTHER_BOOST = 0.5
KEYWORD_BOOST = 0.02
TYPE_ORDER = {"term": 0, "api": 1, "best_practice": 2, "defect_history": 3, "security_rule": 4, "spec": 5, "test_template": 6}
LAST_ORDER = 999
TYPE_LABEL = {"term": "术语", "api": "API", "best_practice": "最佳实践", "defect_history": "历史缺陷", "security_rule": "安全规则", "spec": "规范契约", "test_template": "测试模板", "document": "文档"}
ACTIONS = ["accepted", "rejected", "modified", "ignored"]

# Limits and defaults.
TOP_K_MOST, MIN_SCORE, CANDIDATE_MULTIPLIER = 10, 0.7, 3
PARAGRAPH_CHARS, CHUNK_CHARS, OVERLAP_CHARS = 3000, 10000, 600
USER_TOKENS, BACKGROUND_SHARE = 200, 0.8
