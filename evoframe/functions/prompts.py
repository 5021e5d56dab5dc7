"""Prompts that ask a model for code, as Columns over a sample's fields.

A sample has query, function_signature, name and module, for the full information also signature, documentation, source_code,
old_source_code, from_version and to_version, and for retrieval the text of the documents that were found. Rust asks
differently for the standard library and for other crates.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .code import FAMILIES, _family, _text, chat, ended, stripped

# The wordings of the prompts. {x} is a field of the sample.
RUST = "You are an expert Rust programmer. Implement the following Rust function:"
PYTHON = "You are an expert Python programmer. Implement the following Python function."
CLOSING = "Respond with ONLY the {language} function implementation."
SIGNED = "1. Implement ONLY the {function} with the signature given above."
USED = "2. Your implementation MUST use the specified API: {name}"
UNTESTED = "Do not include tests or any extra comments."
COMPILED = f"3. Compile with Rust 1.84.0. {UNTESTED}"
FULL = ["- API Signature: {signature}", "- API Documentation: {documentation}"]
CHANGED = ["- API Changed From Version: {from_version}", "- API Changed To Version: {to_version}"]
NAMED = ["- API Name: {name}", "- API Module: {module}"]
MULTI_HOP = "Please provide a multi-hop explanation for the next question: "
KINDS = ("short", "full", "retrieval")


def _filled(template: str, **fields: Column) -> Column:
    """A template with the texts of the fields in it, null as empty."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[_text(fields[p]) if i % 2 else F.lit(p) for i, p in enumerate(parts) if p or i % 2])


def rust_lines(kind: str, std: bool) -> list[str]:
    """The lines of a Rust prompt. A line of "-" is a blank one that keeps its indent."""
    crate = [] if std else ["- Crate: {crate}" if kind == "full" else "- Crate Name: {crate}"]
    facts = [*FULL, "- API Source Code: {source_code}", *CHANGED] if kind == "full" else []
    title = "API Information: " if std and kind != "full" else "API Information:"
    blank = "-" if std == (kind == "full") else ""
    task = "Task:{query}" if std and kind == "full" else "Task: {query}"
    found = ["", "Retrieved Documentation:", "{documents}"] if kind == "retrieval" else []
    signed = "1. Implement ONLY the function with the given signature above." if std and kind == "full" else SIGNED.replace("{function}", "Rust function")
    last = {"short": [f"3. {UNTESTED}"], "full": [f"3. Compile with Rust {{to_version}}. {UNTESTED}"], "retrieval": ["3. Make sure your code is compatible with Rust version {to_version}", f"4. {UNTESTED}"]}[kind] if std else [COMPILED]
    after = "-" if std and kind == "full" else ""
    return [RUST, "", title, *crate, *NAMED, *facts, blank, task, "Function Signature:", "```rust", "{function_signature}", "```", *found, after, "Requirements:", signed, USED, *last, "", CLOSING.replace("{language}", "Rust")]


def python_lines(kind: str) -> list[str]:
    """The lines of a Python prompt."""
    facts = [*FULL, "- API Old Source Code: {old_source_code}", "- API New Source Code: {source_code}", *CHANGED] if kind == "full" else []
    found = ["Retrieved API Documentation (for reference):", "{documents}", ""] if kind == "retrieval" else []
    last = ["3. Must be compatible with Python version {to_version}.", f"4. {UNTESTED}"] if kind == "retrieval" else [f"3. {UNTESTED}"]
    return [PYTHON, "", "API Information:", *NAMED, *facts, "", "Task: {query}", "", "Function Signature:", "```python", "{function_signature}", "```", "", *found, "Requirements:", SIGNED.replace("{function}", "function"), USED, *last, "", CLOSING.replace("{language}", "Python")]


def rust_prompt(kind: str = "short", tuning: bool = False, **fields: Column) -> Column:
    """What a Rust model is asked: by `kind` with the API's name, all that is known of it, or the documents found for it.
    Prompts of evaluations are indented; with `tuning` they are as models are tuned on."""
    module = _text(fields["module"])
    given = fields | {"crate": F.substring_index(module, "::", 1)}
    if kind == "retrieval":
        given["to_version"] = F.coalesce(fields.get("to_version", F.lit(None)), F.lit("1.84.0"))

    def whole(std: bool) -> Column:
        lines = rust_lines(kind, std)
        if tuning:
            return _filled("\n".join("" if x == "-" else x.rstrip() for x in lines), **given)
        return _filled("\n" + "\n".join("    " if x == "-" else f"    {x}" if x else "" for x in lines) + "\n", **given)

    return F.when(module.rlike("^(std|core|alloc)::"), whole(True)).otherwise(whole(False))


def python_prompt(kind: str = "short", tuning: bool = False, strip: bool = False, **fields: Column) -> Column:
    """What a Python model is asked; with `tuning` without the last line's end, with `strip` the signature without space around."""
    if strip or tuning:
        fields = fields | {"function_signature": stripped(_text(fields["function_signature"]))}
    return _filled("\n".join(python_lines(kind)) + ("" if tuning else "\n"), **fields)


def train_pair(model: Column, prompt: Column, code: Column) -> Column:
    """struct<prompt, answer>: a prompt and the code in the chat template of the model's family, or with a line's end after
    the prompt for others."""
    known = _family(model, "llama") | _family(model, "qwen")
    return F.struct(F.when(known, chat(model, prompt)).otherwise(F.concat(prompt, F.lit("\n"))).alias("prompt"), ended(model, _text(code)).alias("answer"))


def answered(question: Column, answer: Column) -> Column:
    """A question and its answer in the first family's chat template."""
    return F.concat(chat(F.lit("llama-3"), question), answer, F.lit(FAMILIES["llama"][1]))


def explained(model: Column, question: Column) -> Column:
    """A question for an explanation in steps, in the model family's template; as it stands for others."""
    llama = F.concat(F.lit(f"<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n\n{MULTI_HOP}"), question, F.lit("<|eot_id|>"))
    qwen = F.concat(F.lit(f"<|im_start|>user\n {MULTI_HOP}"), question, F.lit("<|im_end|>\n<|im_start|>assistant\n"))
    return F.when(_family(model, "llama"), llama).when(_family(model, "qwen"), qwen).otherwise(question)


def plain_chat(question: Column) -> Column:
    """A question for models that know two speakers by name."""
    return F.concat(F.lit("USER: "), question, F.lit(" ASSISTANT:"))
