"""Which conversation format a record has: four detectors that deliberately differ.

Each takes the array of a record's keys (and, where it matters, whether a key
holds a list) and returns a format name; apply it to every record, or to the
first record of a file and broadcast the one answer.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions import text as tx

# Key names looked at by the detectors, in order of preference.
QUESTION_KEYS = ["question", "query", "input", "prompt", "instruction"]
ANSWER_KEYS = ["answer", "response", "output", "completion", "reply"]
DIALOG_KEYS = ["dialog", "dialogue", "turns", "chat"]
FIELD_PAIRS = [
    ("question", "answer"), ("prompt", "completion"), ("prompt", "response"), ("query", "response"),
    ("human", "assistant"), ("user", "assistant"), ("input", "output"), ("context", "response"),
    ("question", "best_answer"),
]


def record_keys(line: Column) -> Column:
    """Keys of a JSON object; null when the line is malformed or no object."""
    return F.when(tx.valid_json(line), F.json_object_keys(line))


def has_all(keys: Column, *names: str) -> Column:
    condition = F.lit(True)
    for name in names:
        condition = condition & F.array_contains(keys, name)
    return condition


def has_any(keys: Column, *names: str) -> Column:
    return F.arrays_overlap(keys, F.array(*[F.lit(n) for n in names]))


def _choose(rules: list[tuple[Column, Column | str]], otherwise: str) -> Column:
    chain = None
    for condition, value in rules:
        value = F.lit(value) if isinstance(value, str) else value
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain.otherwise(F.lit(otherwise))


def detect_upload(keys: Column) -> Column:
    """Any of the tell-tale keys is enough."""
    return _choose(
        [
            (has_any(keys, "instruction", "output"), "alpaca"),
            (has_any(keys, "conversations"), "sharegpt"),
            (has_any(keys, "messages"), "openai"),
            (has_any(keys, "input", "output"), "input_output"),
            (has_any(keys, "question", "answer"), "qa"),
            (has_any(keys, "prompt", "completion"), "completion"),
            (has_any(keys, "text"), "text_only"),
        ],
        "unknown",
    )


def detect_listing(keys: Column) -> Column:
    """All keys of a format must be there."""
    return _choose(
        [
            (has_all(keys, "instruction", "output") | has_all(keys, "instruction", "response"), "alpaca"),
            (has_all(keys, "conversations"), "sharegpt"),
            (has_all(keys, "messages"), "openai"),
            (has_all(keys, "text"), "text"),
        ],
        "other",
    )


def qa_keys(keys: Column) -> Column:
    """First question/answer key pair present as ``struct<q, a>``, in the fixed order of preference."""
    pairs = F.array(
        *[
            F.struct(F.lit(q).alias("q"), F.lit(a).alias("a"))
            for q in QUESTION_KEYS
            for a in ANSWER_KEYS
        ]
    )
    found = F.filter(pairs, lambda p: F.array_contains(keys, p["q"]) & F.array_contains(keys, p["a"]))
    return F.get(found, F.lit(0))


def detect_sft(keys: Column, turns_are_list: Column, conversation_is_list: Column) -> Column:
    """The converter's detector, from turn lists down to any question/answer pair."""
    return _choose(
        [
            (has_any(keys, "conversations", "messages") & turns_are_list, "conversations"),
            (has_all(keys, "instruction", "output"), "alpaca"),
            (has_all(keys, "conversation") & conversation_is_list, "sharegpt"),
            (has_all(keys, "question", "response"), "openorca"),
            (has_all(keys, "prompt", "completion"), "prompt_completion"),
            (qa_keys(keys).isNotNull(), F.concat(F.lit("qa:"), qa_keys(keys)["q"], F.lit(","), qa_keys(keys)["a"])),
        ],
        "unknown",
    )


def field_pair(keys: Column) -> Column:
    """First known (question, answer) field pair present, as ``struct<q, a>``."""
    pairs = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(a).alias("a")) for q, a in FIELD_PAIRS])
    found = F.filter(pairs, lambda p: F.array_contains(keys, p["q"]) & F.array_contains(keys, p["a"]))
    return F.get(found, F.lit(0))


def detect_bulk(keys: Column, conversations_hold_objects: Column, messages_hold_objects: Column, dialog_is_list: Column) -> Column:
    """The importer's detector: standard formats are kept, others mapped."""
    return _choose(
        [
            (has_all(keys, "instruction", "output"), "alpaca"),
            (has_all(keys, "conversations") & conversations_hold_objects, "sharegpt"),
            (has_all(keys, "messages") & messages_hold_objects, "openai"),
            (has_any(keys, *DIALOG_KEYS) & dialog_is_list, "dialog"),
            (field_pair(keys).isNotNull(), "mapped"),
            (has_all(keys, "text") & (F.size(keys) <= 3), "text"),
        ],
        "unchanged",
    )
