"""Closed vocabularies. Every table here is a fixed value the results depend on."""

# Trace types.
TRACE_TYPES = (
    "planner_trace", "router_trace", "worker_trace", "coding_trace", "scientific_trace",
    "verification_trace", "critic_trace", "tool_trace", "failure_trace", "correction_trace",
    "promotion_trace", "benchmark_trace",
)

# Outcome labels.
OUTCOME_LABELS = (
    "accepted", "rejected", "failed_tests", "failed_verification", "hallucinated", "duplicated",
    "too_expensive", "too_slow", "rescued_by_stronger_model", "useful_negative_example",
    "good_training_candidate", "unsafe_or_policy_blocked", "inconclusive",
)

# Accepted spellings of outcome labels.
OUTCOME_ALIASES = {
    "success": "accepted",
    "passed": "accepted",
    "pass": "accepted",
    "ok": "accepted",
    "failure": "failed_verification",
    "failed": "failed_verification",
    "test_failed": "failed_tests",
    "tests_failed": "failed_tests",
    "duplicate": "duplicated",
    "expensive": "too_expensive",
    "slow": "too_slow",
    "unsafe": "unsafe_or_policy_blocked",
}

# Failure types.
FAILURE_TYPES = (
    "wrong_reasoning", "wrong_tool", "bad_router_assignment", "hallucinated_citation",
    "fabricated_data", "failed_code_tests", "bad_scientific_claim", "weak_evidence",
    "missed_dependency", "duplicated_work", "overused_frontier_model", "underused_local_model",
    "context_loss", "format_failure", "unsafe_output",
)

# Privacy mode to export status.
PRIVACY_STATUS = {
    "private-local-only": "local_only",
    "shared-anonymous-learning": "anonymous_learning",
    "public-benchmark-contribution": "public_benchmark",
}
DEFAULT_PRIVACY_MODE = "private-local-only"

# Substrings that decide the task bucket, first bucket wins.
TASK_BUCKETS = (
    ("documentation", ("doc", "literature", "readme", "guide")),
    ("coding", ("code", "test", "bug", "refactor")),
    ("scientific", ("science", "protocol", "bio", "verify")),
    ("routing", ("route",)),
)

# Test statuses.
FAILED_STATUSES = ("failed", "fail", "error")
PASSED_STATUSES = ("passed", "pass", "ok")

# Failure type implied by a label.
FAILURE_BY_LABEL = {
    "failed_tests": "failed_code_tests",
    "failed_verification": "weak_evidence",
    "hallucinated": "hallucinated_citation",
    "unsafe_or_policy_blocked": "unsafe_output",
    "too_expensive": "overused_frontier_model",
    "too_slow": "format_failure",
}

# Execution outcome enums.
RISKS = ("low", "medium", "high", "critical")
EFFORTS = ("none", "minimal", "low", "medium", "high", "xhigh")
EFFORT_LEVEL = {"none": 0.0, "minimal": 0.25, "low": 1.0, "medium": 2.0, "high": 3.0, "xhigh": 4.0}
ARMS = ("teacher", "classifier", "cheaper-candidate")
ASSIGNMENTS = ("randomized", "deterministic-shadow", "observational")
SERIOUS = ("serious", "high", "critical")
BOUNDARY_STATES = ("trusted", "conditional", "exploration-only", "unmapped")
VERIFICATION_LEVEL = {"none": 0, "standard": 1, "strong": 2, "independent": 3}

# Metrics where a smaller number is better.
LOWER_IS_BETTER = ("cost_per_verified_task", "latency_ms", "duplicate_rate", "hallucination_rate")

# Eligibility rules of the low-risk routing variant.
HIGH_RISK_TERMS = ("unsafe", "clinical", "diagnosis", "legal", "payment", "secret")
VARIANT_BLOCKING_LABELS = (
    "failed_tests", "failed_verification", "hallucinated", "unsafe_or_policy_blocked",
    "rescued_by_stronger_model",
)
VARIANT_TRACE_TYPES = (
    "router_trace", "coding_trace", "planner_trace", "verification_trace", "worker_trace",
)

# Feature names that would leak the target into a classifier.
TARGET_DERIVED_KEYS = (
    "chosen_option", "selected_option", "teacher_option", "classifier_option", "option_hash",
    "choice_id", "compact_label", "target_label", "fallback_model", "selected_model",
    "teacher_model",
)

# Keyword signals of a subtask.
SIGNALS = ("security", "migration", "research", "architecture", "incident", "verification")

# Confidence thresholds of the selective report.
SELECTIVE_THRESHOLDS = (0.5, 0.7, 0.8, 0.9, 0.95, 0.97)

# Rollout stage, epochs needed, largest share of traffic.
ROLLOUT_STAGES = (
    ("canary", 1, 0.05),
    ("limited", 3, 0.25),
    ("expanded", 6, 0.50),
    ("broad", 12, 1.0),
)

# Score weights by task keyword (quality, robustness, verifier agreement, cost,
# latency, failure rate); the first matching row wins.
SCORE_PROFILES = (
    (("medical", "safety", "clinical"), (0.42, 0.22, 0.20, 0.05, 0.03, 0.08)),
    (("code", "coding", "software"), (0.40, 0.24, 0.14, 0.06, 0.04, 0.12)),
    (("support", "chat", "fast", "realtime"), (0.30, 0.16, 0.10, 0.12, 0.22, 0.10)),
    ((), (0.34, 0.20, 0.16, 0.10, 0.06, 0.14)),
)
COST_CAP = 1.0
LATENCY_CAP_MS = 4000.0

# Reward weights.
REWARD_WEIGHTS = {
    "correctness": 0.35,
    "calibration": 0.2,
    "confidence_faithfulness": 0.2,
    "overconfidence_penalty": 0.15,
    "escalation_recall": 0.1,
}
PASS_WORDS = ("accepted", "pass", "passed", "correct", "success")

# Points per matched workflow trigger.
TRIGGER_WEIGHTS = {
    "task_types": 6.0,
    "repository_paths": 4.0,
    "languages": 3.0,
    "error_classes": 3.0,
    "required_tools": 2.0,
    "risk_levels": 2.0,
    "keywords": 1.0,
}

# Specialist names, and the training target each dataset type asks for.
PIPELINE_SPECIALISTS = (
    "ingestor", "deduper", "cleaner", "classifier", "difficulty-scorer", "quality-scorer",
    "trace-compressor", "early-failure-detector", "verifier", "critic", "error-taxonomist",
    "synthetic-generator", "mutation-evolver", "recipe-generator", "recipe-verifier",
    "curriculum-builder", "dataset-mixer", "benchmark-generator", "regression-tester",
    "promotion-gatekeeper",
)
ECOSYSTEM_SPECIALISTS = (
    "router", "planner", "worker", "manager", "coordinator", "inspector", "compressor",
    "duplicate-detector", "failure-classifier", "prompt-improver", "prompt-pack-generator",
    "local-model-trainer", "local-evaluator", "model-mix-optimizer", "scientific-method",
    "coding-agent", "tool-trace-analyzer", "correction-linker", "benchmark-task",
    "privacy-redactor", "report-builder", "integration-bridge",
)
SPECIALISTS = PIPELINE_SPECIALISTS + ECOSYSTEM_SPECIALISTS
BASE_DATASETS = (
    "router", "critic", "verifier", "planner", "prompt", "trace-compression",
    "duplicate-detection", "failure-classification", "scientific-method", "coding-agent",
    "benchmark-task", "local-router", "local-compressor", "local-duplicate-detector",
    "local-evaluator", "local-scientific-method", "local-coding-agent", "local-benchmark-task",
)
DATASET_TYPES = tuple(
    sorted({*BASE_DATASETS, *SPECIALISTS, *(f"local-{name}" for name in SPECIALISTS)})
)

# Fixed values: (how to match, text, target), tried from top to bottom.
DATASET_TARGETS = (
    ("whole", "critic", "critique_trace_quality"),
    ("whole", "verifier", "verify_claim_or_task"),
    ("suffix", "ingestor", "normalize_and_validate_trace"),
    ("suffix", "deduper", "detect_duplicate_trace"),
    ("suffix", "cleaner", "clean_trace_for_training"),
    ("suffix", "classifier", "classify_trace_outcome"),
    ("suffix", "difficulty-scorer", "score_task_difficulty"),
    ("suffix", "quality-scorer", "score_trace_quality"),
    ("suffix", "trace-compressor", "compress_trace"),
    ("suffix", "early-failure-detector", "detect_early_failure_signal"),
    ("suffix", "error-taxonomist", "taxonomy_label_error"),
    ("suffix", "synthetic-generator", "generate_synthetic_training_case"),
    ("suffix", "mutation-evolver", "mutate_case_for_improvement"),
    ("suffix", "recipe-generator", "generate_dataset_recipe"),
    ("suffix", "recipe-verifier", "verify_dataset_recipe"),
    ("suffix", "curriculum-builder", "build_training_curriculum"),
    ("suffix", "dataset-mixer", "mix_dataset_slices"),
    ("suffix", "benchmark-generator", "generate_benchmark_case"),
    ("suffix", "regression-tester", "test_candidate_for_regressions"),
    ("suffix", "promotion-gatekeeper", "apply_promotion_gate"),
    ("suffix", "router", "optimize_router_assignment"),
    ("suffix", "worker", "execute_worker_task"),
    ("suffix", "manager", "manage_agent_workflow"),
    ("suffix", "coordinator", "coordinate_prd_execution"),
    ("suffix", "inspector", "inspect_code_or_output"),
    ("suffix", "compressor", "compress_trace"),
    ("suffix", "duplicate-detector", "detect_duplicate_trace"),
    ("suffix", "prompt-improver", "improve_prompt"),
    ("suffix", "prompt-pack-generator", "generate_prompt_pack"),
    ("suffix", "local-model-trainer", "plan_local_adapter_training"),
    ("suffix", "model-mix-optimizer", "optimize_model_mix"),
    ("suffix", "tool-trace-analyzer", "analyze_tool_trace"),
    ("suffix", "correction-linker", "link_failure_to_correction"),
    ("suffix", "privacy-redactor", "redact_private_training_data"),
    ("suffix", "report-builder", "build_operator_report"),
    ("suffix", "integration-bridge", "shape_integration_payload"),
    ("whole", "planner", "decompose_task"),
    ("whole", "prompt", "improve_prompt"),
    ("whole", "trace-compression", "compress_trace"),
    ("whole", "duplicate-detection", "classify_duplicate"),
    ("whole", "failure-classification", "classify_failure"),
    ("whole", "scientific-method", "design_scientific_evaluation"),
    ("whole", "local-scientific-method", "design_scientific_evaluation"),
    ("whole", "coding-agent", "improve_coding_agent_workflow"),
    ("whole", "local-coding-agent", "improve_coding_agent_workflow"),
    ("whole", "benchmark-task", "generate_or_score_benchmark_task"),
    ("whole", "local-benchmark-task", "generate_or_score_benchmark_task"),
    ("whole", "local-evaluator", "evaluate_local_model_output"),
)


def dataset_target(dataset_type: str) -> str | None:
    """Target of a dataset type, or None for types without one."""
    for how, text, target in DATASET_TARGETS:
        if dataset_type == text or (how == "suffix" and dataset_type.endswith(text)):
            return target
    return None


BENCHMARK_TYPES = ("router", "prompt", "verifier", "critic", "compressor")
PROMPT_ROLES = ("manager", "worker", "critic", "verifier")
