"""Chat templates as column expressions over an array of turns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TEMPLATES = ["chatml", "llama", "simple"]

# Special tokens each template needs in the vocabulary, and the
# strings that end a generated answer.
TEMPLATE_TOKENS = {
    "chatml": ["<|im_start|>", "<|im_end|>"],
    "llama": ["[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "</s>"],
    "simple": [],
}
STOP_TOKENS = {
    "chatml": ["<|im_end|>", "<|im_start|>"],
    "llama": ["[INST]", "</s>"],
    "simple": ["### User:", "###"],
}
# Model families by keywords of the model name, and by markers of
# the template text, both in order of preference.
FAMILY_KEYWORDS = {
    "chatml": ["qwen", "phi-3", "phi-4", "phi3", "phi4", "yi-", "deepseek"],
    "llama3": ["llama-3", "llama3"],
    "zephyr": ["tinyllama", "tiny-llama", "zephyr", "stablelm", "openchat", "rocket"],
    "gemma": ["gemma"],
    "mistral": ["mistral", "mixtral"],
    "llama2": ["llama-2", "llama2", "codellama"],
    "vicuna": ["vicuna"],
}
FAMILY_MARKERS = [
    ("chatml", ["<|im_start|>"]),
    ("llama3", ["<|start_header_id|>"]),
    ("gemma", ["<start_of_turn>"]),
    ("zephyr", ["<|system|>", "<|user|>"]),
    ("llama2", ["<<SYS>>"]),
    ("mistral", ["[INST]"]),
]


def capitalize(c: Column) -> Column:
    """First character upper case, the rest lower case."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, F.lit(2), F.length(c))))


def header(role: Column, template: str) -> Column:
    if template == "chatml":
        return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"))
    if template == "llama":
        return F.when(role == "system", "<<SYS>>\n").when(role == "user", "[INST] ").otherwise("")
    if template == "simple":
        return F.concat(F.lit("### "), capitalize(role), F.lit(":\n"))
    raise ValueError(f"unknown chat template {template}")


def footer(role: Column, template: str) -> Column:
    if template == "chatml":
        return F.lit("<|im_end|>\n")
    if template == "llama":
        return (
            F.when(role == "system", "\n<</SYS>>\n\n").when(role == "user", " [/INST]\n").otherwise("\n")
        )
    if template == "simple":
        return F.lit("\n\n")
    raise ValueError(f"unknown chat template {template}")


def rendered_turns(conv: Column, template: str) -> Column:
    """``struct<head, body, assistant>`` per turn; ``body`` is the content with its footer."""
    return F.transform(
        conv,
        lambda t: F.struct(
            header(t["role"], template).alias("head"),
            F.concat(t["content"], footer(t["role"], template)).alias("body"),
            (t["role"] == "assistant").alias("assistant"),
        ),
    )


def render(conv: Column, template: str) -> Column:
    """The whole conversation as text."""
    return F.array_join(
        F.transform(
            conv,
            lambda t: F.concat(header(t["role"], template), t["content"], footer(t["role"], template)),
        ),
        "",
    )


def assistant_spans(conv: Column, template: str) -> Column:
    """Character ranges ``[start, end)`` of assistant content plus footer in the rendered text."""
    start = F.struct(
        F.lit(0).cast("bigint").alias("pos"),
        F.array().cast("array<struct<span_start:bigint,span_end:bigint>>").alias("spans"),
    )

    def step(acc: Column, part: Column) -> Column:
        begin = acc["pos"] + F.length(part["head"])
        end = begin + F.length(part["body"])
        span = F.array(F.struct(begin.cast("bigint").alias("span_start"), end.cast("bigint").alias("span_end")))
        return F.struct(
            end.cast("bigint").alias("pos"),
            F.when(part["assistant"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    return F.aggregate(rendered_turns(conv, template), start, step, lambda acc: acc["spans"])


def generation_prompt(conv: Column, template: str) -> Column:
    """History as the prompt of the next answer; in llama and simple any other role reads as assistant."""

    def one(t: Column) -> Column:
        if template == "chatml":
            return F.concat(F.lit("<|im_start|>"), t["role"], F.lit("\n"), t["content"], F.lit("<|im_end|>\n"))
        if template == "llama":
            asked = F.concat(F.lit("[INST] "), t["content"], F.lit(" [/INST]\n"))
            return F.when(t["role"] == "user", asked).otherwise(F.concat(t["content"], F.lit("</s>\n")))
        name = F.when(t["role"] == "user", "User").otherwise("Assistant")
        return F.concat(F.lit("### "), name, F.lit(":\n"), t["content"], F.lit("\n\n"))

    lead = {"chatml": "<|im_start|>assistant\n", "llama": "", "simple": "### Assistant:\n"}[template]
    return F.concat(F.array_join(F.transform(conv, one), ""), F.lit(lead))


def cut_at_stop(text: Column, stops: list[str]) -> Column:
    """Text up to the earliest stop string, unchanged when none occurs."""
    positions = [F.nullif(F.locate(s, text), F.lit(0)) for s in stops]
    first = positions[0] if len(positions) == 1 else F.least(*positions)
    return F.when(first.isNull(), text).otherwise(F.substring(text, F.lit(1), first - 1))


def family_of_name(name: Column) -> Column:
    """Template family by the first family with a keyword in the model name."""
    lowered = F.lower(name)
    chain = None
    for family, words in FAMILY_KEYWORDS.items():
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(lowered, F.lit(word))
        chain = F.when(hit, family) if chain is None else chain.when(hit, family)
    return chain


def family_of_template(template_text: Column) -> Column:
    """Template family by the markers in the text of a chat template."""
    chain = None
    for family, markers in FAMILY_MARKERS:
        hit = F.lit(False)
        for marker in markers:
            hit = hit | F.contains(template_text, F.lit(marker))
        chain = F.when(hit, family) if chain is None else chain.when(hit, family)
    both = F.contains(template_text, F.lit("USER:")) & F.contains(template_text, F.lit("ASSISTANT:"))
    return chain.when(both, "vicuna")
