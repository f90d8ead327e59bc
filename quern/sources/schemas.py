"""Schemas of the files and tables that the engine reads."""

from __future__ import annotations

MESSAGES = "array<struct<role: string, content: string>>"
CORPUS = "text string"
ITEM = "query string, choices array<string>, gold int, context string, context_options array<string>, continuation string"
#: Task tables by name: columns and the splits or subsets they come in.
TASKS = {
    "labelled_choice": ("question string, choices struct<text: array<string>, label: array<string>>, answerKey string", ("train", "validation", "test")),
    "indexed_choice": ("question string, choices array<string>, answer int, subject string", ("auxiliary_train", "all", "validation", "dev", "test")),
    "word_problem": ("question string, answer string", ("train", "test")),
    "program": ("prompt string, canonical_solution string, entry_point string, test string", ("test",)),
    "chat": (f"messages {MESSAGES}", ("train", "test")),
}
SWEEP = "flops_budget double, depth int, model_dim int, params_wte long, params_value_embeds long, params_lm_head long, params_transformer long, params_scalars long, params_total long, num_iterations long, tokens_trained long, val_bpb double, core_score double, train_time_sec double"
METRIC = "run string, step int, metric string, value double"
