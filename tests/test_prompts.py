"""Prompts as models are asked, questions in their templates, and rates of results."""

import json

import pytest
from pyspark.sql import functions as F

from evoframe.functions import prompts
from evoframe.operators import rollup
from evoframe.sources import readers

SAMPLE = {"query": "Do it", "function_signature": " fn f() ", "name": "grow", "module": "std::m", "signature": "S", "documentation": "D", "source_code": "C", "old_source_code": None, "from_version": "1.1", "to_version": "1.2", "documents": "FOUND"}


def asked(spark, prompt, **changed):
    fields = {k: F.lit(v).cast("string") for k, v in (SAMPLE | changed).items()}
    return spark.range(1).select(prompt(fields).alias("p")).first().p


def test_rust(spark):
    ask = lambda kind, tuning=False, **changed: asked(spark, lambda f: prompts.rust_prompt(kind, tuning, **f), **changed)
    assert ask("short", True) == "You are an expert Rust programmer. Implement the following Rust function:\n\nAPI Information:\n- API Name: grow\n- API Module: std::m\n\nTask: Do it\nFunction Signature:\n```rust\n fn f() \n```\n\nRequirements:\n1. Implement ONLY the Rust function with the signature given above.\n2. Your implementation MUST use the specified API: grow\n3. Do not include tests or any extra comments.\n\nRespond with ONLY the Rust function implementation."
    crate = ask("short", module="tokio::io")
    assert crate == "\n    You are an expert Rust programmer. Implement the following Rust function:\n\n    API Information:\n    - Crate Name: tokio\n    - API Name: grow\n    - API Module: tokio::io\n    \n    Task: Do it\n    Function Signature:\n    ```rust\n     fn f() \n    ```\n\n    Requirements:\n    1. Implement ONLY the Rust function with the signature given above.\n    2. Your implementation MUST use the specified API: grow\n    3. Compile with Rust 1.84.0. Do not include tests or any extra comments.\n\n    Respond with ONLY the Rust function implementation.\n"
    full = ask("full")
    assert "    API Information:\n    - API Name: grow\n    - API Module: std::m\n    - API Signature: S\n    - API Documentation: D\n    - API Source Code: C\n    - API Changed From Version: 1.1\n    - API Changed To Version: 1.2\n    \n    Task:Do it\n" in full
    assert "    ```\n    \n    Requirements:\n    1. Implement ONLY the function with the given signature above.\n" in full and "    3. Compile with Rust 1.2. Do not" in full
    assert "    - Crate: a\n" in ask("full", module="a") and "1.2\n\n    Task: Do it\n" in ask("full", module="a::b") and "- Crate Name: \n" in ask("short", module=None)
    found = ask("retrieval", to_version=None)
    assert "    ```\n\n    Retrieved Documentation:\n    FOUND\n\n    Requirements:\n" in found and "    3. Make sure your code is compatible with Rust version 1.84.0\n    4. Do not" in found and "API Information: \n" in found


def test_python(spark):
    ask = lambda kind, tuning=False, strip=False, **changed: asked(spark, lambda f: prompts.python_prompt(kind, tuning, strip, **f), **changed)
    head = "You are an expert Python programmer. Implement the following Python function.\n\nAPI Information:\n- API Name: grow\n- API Module: std::m\n"
    tail = "Requirements:\n1. Implement ONLY the function with the signature given above.\n2. Your implementation MUST use the specified API: grow\n"
    end = "Do not include tests or any extra comments.\n\nRespond with ONLY the Python function implementation."
    assert ask("short") == f"{head}\nTask: Do it\n\nFunction Signature:\n```python\n fn f() \n```\n\n{tail}3. {end}\n"
    assert ask("short", True) == f"{head}\nTask: Do it\n\nFunction Signature:\n```python\nfn f()\n```\n\n{tail}3. {end}" and ask("short", strip=True) == ask("short", True) + "\n"
    assert ask("full") == f"{head}- API Signature: S\n- API Documentation: D\n- API Old Source Code: \n- API New Source Code: C\n- API Changed From Version: 1.1\n- API Changed To Version: 1.2\n\nTask: Do it\n\nFunction Signature:\n```python\n fn f() \n```\n\n{tail}3. {end}\n"
    assert ask("retrieval").endswith(f"```\n\nRetrieved API Documentation (for reference):\nFOUND\n\n{tail}3. Must be compatible with Python version 1.2.\n4. {end}\n")


def test_templates(spark, tmp_path):
    model, q = F.col("m"), F.lit("Q")
    rows = {r.m: r for r in spark.createDataFrame([("Llama-3-8B",), ("Qwen2.5",), ("other",)], "m string").select("m", prompts.train_pair(model, q, F.lit("C")).alias("t"), prompts.explained(model, q).alias("e")).collect()}
    assert tuple(rows["Qwen2.5"].t) == ("<|im_start|>user\nQ<|im_end|>\n<|im_start|>assistant\n", "C<|im_end|>") and tuple(rows["other"].t) == ("Q\n", "C") and rows["other"].e == "Q"
    assert tuple(rows["Llama-3-8B"].t) == ("<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n\nQ<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n", "C<|eot_id|>")
    assert rows["Llama-3-8B"].e == "<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n\nPlease provide a multi-hop explanation for the next question: Q<|eot_id|>"
    assert rows["Qwen2.5"].e == "<|im_start|>user\n Please provide a multi-hop explanation for the next question: Q<|im_end|>\n<|im_start|>assistant\n"
    one = spark.range(1).select(prompts.answered(q, F.lit("A")).alias("a"), prompts.plain_chat(q).alias("b")).first()
    assert one.a.endswith("assistant<|end_header_id|>\n\nA<|eot_id|>") and one.b == "USER: Q ASSISTANT:"
    (tmp_path / "q.json").write_text(json.dumps([{"id": i, "question": f"q{i}", "answer": "a", "para_question": "p", "sub_question": ["x", "y"]} for i in range(3)]))
    made = readers.questions(spark, str(tmp_path / "q.json"), "Qwen2.5-7B-Instruct", 2).orderBy("idx").collect()
    assert len(made) == 2 and made[1].question == "<|im_start|>user\nq1<|im_end|>\n<|im_start|>assistant\n" and made[0].answer == "a<|im_end|>" and made[0].sub_question[1].startswith("<|im_start|>user\ny")
    plain = readers.questions(spark, str(tmp_path / "q.json"), "Qwen").orderBy("idx").first()
    assert plain.question == "q0" and plain.answer == "a"


def test_rates(spark):
    rows = [(1, "passed", 2, 2), (3, "no_test", 9, 9), (4, "api_error", 0, 2), (9, "signature_error", None, 1), (20_050, "test_failed", 1, 3), (20_051, None, 1, 1)]
    df = spark.createDataFrame(rows, "o long, bucket string, cases_passed int, cases_total int")
    got = [tuple(r) for r in rollup.progress(df, "o", every=2).orderBy("done").collect()]
    assert got == [(2, 1, 1, 1.0, 1.0, 1.0), (4, 3, 1, pytest.approx(1 / 3), pytest.approx(1 / 3), 0.4), (6, 5, 1, 0.2, 0.6, pytest.approx(4 / 9))]
    results = spark.createDataFrame([(True, None, "3 passed, 1 failed", 0, 0), (False, "Incorrect function signature: x", None, None, None), (False, "API not used", "2 errors", 0, 0), (False, "late API not used", "", 0, 0)], "passed boolean, error string, test_output string, test_cases_passed int, test_cases_total int")
    r = rollup.baseline_summary(results).first()
    assert (r.total, r.passed, r.pass_rate, r.usage_accuracy, r.cases_passed, r.cases_total, r.coverage) == (4, 1, 0.25, 0.5, 3, 6, 0.5)
    assert r.pass_at_1 == 0.25 and r.pass_at_2 == 0.5 and r.pass_at_5 is None
    counted = rollup.baseline_summary(results.unionByName(spark.createDataFrame([(True, None, None, 1, 2)], results.schema))).first()
    assert (counted.cases_passed, counted.cases_total) == (1, 2)
    assert rollup.baseline_summary(results.limit(0)).first().pass_rate == 0.0
