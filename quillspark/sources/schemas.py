"""Explicit schemas: nothing is inferred, and a column that a record type doesn't have is null.

Fixed values: the names of fields, record types and tags are those of stored ledgers.
"""

from __future__ import annotations

TASK = "id string, register string, len_class string, passage string, question string, expected_answer string, facts array<string>"

USAGE = "struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint,reasoning_tokens:bigint>"
GRADE = "struct<anchor_score:double,match_score:double,anchor_threshold:double,match_threshold:double>"
CHECK = "struct<facts_total:int,facts_matched:array<int>,parse_ok:boolean,parse_error:string,raw:string>"
LEVELS = f"map<string,struct<score:int,compressed_approx_tokens:bigint,savings_approx_tokens:bigint,transform_cost_tokens:bigint,quiz_usage:{USAGE}>>"
BRAKES = "array<struct<stopped_at:string,score:int,threshold:int>>"

#: One wide record for all types of a ledger; ``type`` tells which.
LEDGER = ", ".join(
    [
        "type string, run_id string, git_sha string, model string, slice_id string, source_run string, glm_model string",
        "task_id string, register string, len_class string, condition string, direction string, panel string, panel_model string",
        "q_index int, q_type string, question string, answer string, expected string, raw_answer string, anchored boolean, correct boolean",
        f"grade_v2 {GRADE}, cablese_answer string, lexical_sim_vs_plain_direct double, anchor_score double",
        f"approx_tokens bigint, usage_completion_tokens bigint, text string, usage {USAGE}, latency_ms double, text_chars bigint",
        "call string, raw string, verdict string, sampled_hit boolean, parse_error string, parse_ok boolean, facts_total int, facts_matched array<int>",
        "duplicate_of_kept_index int, overlap double, quota int, anchored_pool int, n int, status string, declared_type string, repaired_type string",
        "arm string, context_chars bigint, context_approx_tokens bigint, passage_approx_tokens bigint, approx_token_ratio double, transform_cost_tokens bigint",
        f"qa_correctness string, qa_prompt_tokens bigint, qa_completion_tokens bigint, fact_check {CHECK}, reason string, recovered boolean",
        "style string, mode string, state string, baseline_score int, threshold int, questions int, chosen_level string",
        f"tokens_saved_at_chosen bigint, pct_saved_at_chosen double, cipher_control boolean, levels {LEVELS}, brake_events {BRAKES}, labels array<string>, paragraphs int",
        "variant string, method string, quiz_score int, quiz_total int, quiz_accuracy double, bundle_approx_tokens bigint, per_turn_saving_approx_tokens bigint, break_even_turns bigint",
        "source string, verified boolean, domain string, prompt_kind string, temperature double, correctness string, attempt bigint",
    ]
)

FRAME = "session string, seq int, frame_text string"
CODEBOOK = "code string, expansion string, case_sensitive boolean"
RULES = "drop_articles array<string>, drop_copulas array<string>, copula_next_verb_stoplist array<string>, copula_next_verb_suffixes array<string>, derivations array<struct<word:string,derived:string>>"

#: Columns of each record type's view, beside the stamp.
STAMP = ("run_id", "git_sha", "model", "slice_id", "source_run")
VIEWS: dict[str, tuple[str, ...]] = {
    "quiz_item": ("task_id", "q_index", "q_type", "question", "answer", "source", "verified"),
    "quiz_answer": ("task_id", "register", "len_class", "q_index", "q_type", "question", "expected", "raw_answer", "anchored", "grade_v2", "correct"),
    "cond_answer": ("task_id", "register", "len_class", "condition", "direction", "panel", "panel_model", "q_index", "q_type", "question", "expected", "raw_answer", "anchored", "grade_v2", "correct", "cablese_answer", "lexical_sim_vs_plain_direct"),
    "record": ("condition", "task_id", "register", "len_class", "approx_tokens", "usage_completion_tokens", "text", "panel"),
    "model_call": ("call", "task_id", "q_index", "raw", "usage", "latency_ms", "correct", "expected", "condition", "panel", "verdict", "parse_error"),
    "judge": ("condition", "task_id", "q_index", "sampled_hit", "verdict", "raw"),
    "dedupe_drop": ("task_id", "q_type", "question", "answer", "duplicate_of_kept_index", "overlap"),
    "anchor_reject": ("task_id", "q_type", "question", "answer"),
    "unanchored_reject": ("task_id", "q_type", "question", "answer", "q_index", "anchor_score"),
    "passage_n": ("task_id", "quota", "anchored_pool", "n"),
    "panel_drop": ("panel", "status"),
    "type_repair": ("task_id", "declared_type", "repaired_type", "question"),
    "parse_error": ("call", "task_id", "parse_error", "raw"),
    "fact_check": ("call", "arm", "task_id", "register", "len_class", "facts_total", "facts_matched", "parse_ok", "parse_error", "raw", "usage", "latency_ms"),
    "unit_summary": ("arm", "task_id", "register", "len_class", "context_chars", "context_approx_tokens", "passage_approx_tokens", "approx_token_ratio", "transform_cost_tokens", "qa_correctness", "fact_check", "qa_prompt_tokens", "qa_completion_tokens"),
    "skipped_unit": ("task_id", "arm", "register", "len_class", "reason"),
    "b_unit": ("task_id", "style", "mode", "state", "register", "len_class", "passage_approx_tokens", "baseline_score", "threshold", "questions", "levels", "chosen_level", "tokens_saved_at_chosen", "pct_saved_at_chosen", "brake_events", "cipher_control"),
    "b_labels": ("labels", "paragraphs", "task_id", "style", "mode"),
    "variant_summary": ("variant", "method", "quiz_score", "quiz_total", "quiz_accuracy", "bundle_approx_tokens", "per_turn_saving_approx_tokens", "transform_cost_tokens", "break_even_turns"),
    "billing_record": ("task_id", "condition", "approx_tokens", "usage", "latency_ms", "text_chars"),
    "answer": ("condition", "task_id", "q_index", "question", "expected", "raw", "usage"),
    "run": ("task_id", "domain", "condition", "prompt_kind", "temperature", "answer", "latency_ms", "correctness"),
    "empty_content_retry": ("recovered",),
    "reasoning_param_dropped": (),
}
