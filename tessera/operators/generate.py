"""Question/answer generation: prompts as native expressions, the model call
as a plug-in run by ``mapInPandas``.

Generator protocol: ``factory() -> generator or None`` (None = no model
available: no QA rows), called once per task; ``generator.generate(prompts:
list[str], **options) -> list[str]``. Each (chunk, question) does two calls:
question from the question prompt, then answer from the answer prompt with
that question. At most ``batch_size`` prompts go into one call; a call that
fails is halved until the failing prompt stands alone, which keeps '' and records
the error. A null context is such a failure, not the job's."""
from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import QA_ID_FORMAT, SENTENCE_TERMINATORS
from tessera.session import ensure_on_executors

DEFAULT_QUESTIONS_PER_CHUNK = 3

# ---------------------------------------------------------------------------
# Prompt framing and the short (API) templates of the reference.
# ---------------------------------------------------------------------------
TEXT_MARKER = "\n\nText: "
QUESTION_MARKER = "\n\nQuestion: "
QUESTION_TEMPLATE_API = ("Generate a self-contained question in Arabic based on the following text. "
                         "Include all relevant details.")
ANSWER_TEMPLATE = ("Based on the following Arabic text, provide a comprehensive and detailed answer to the "
                   "given question in Arabic. \nThe answer should:\n1. Be thorough and well-structured\n"
                   "2. Include relevant details, examples, and explanations\n3. Be written in clear, natural "
                   "Arabic\n4. Provide a complete response that fully addresses the question\n5. Be "
                   "educational and informative\n6. Use proper Arabic grammar and style\n\nFocus on providing "
                   "a complete answer that would satisfy someone asking this question, even if they don't "
                   "have access to the original text.")
QUESTION_TEMPLATE_LOCAL = """Based on the following Arabic text, generate one self-contained question in Arabic that includes all necessary information to answer it without needing the original context. 

The question should:
1. Be completely self-contained - include all relevant details, names, dates, facts, or context needed to answer it
2. Be natural and conversational in Arabic
3. Cover various types: factual, analytical, comparative, causal, hypothetical, opinion-based, evaluative, etc.
4. Be specific enough that someone who hasn't read the original text could still answer it
5. Include any necessary background information or context within the question itself

Examples of good self-contained questions:
- "ما هي العاصمة السياسية والاقتصادية لمصر؟" (What is the political and economic capital of Egypt?)
- "كيف يؤثر تغير المناخ على الزراعة في منطقة الشرق الأوسط؟" (How does climate change affect agriculture in the Middle East?)
- "ما هي الفوائد الصحية للتمر على جسم الإنسان؟" (What are the health benefits of dates on the human body?)

The response should be only the question in Arabic — no explanations, translations, or additional commentary."""
# sampling options of the two kinds of model: question call, answer call
QUESTION_OPTIONS = {"max_new_tokens": 2048}
ANSWER_OPTIONS = {"max_new_tokens": 200, "temperature": 0.7, "top_p": 0.9, "do_sample": True}
API_MAX_TOKENS, API_CHOICES = 2048, 1


@dataclass(frozen=True)
class Preset:
    """Question template and call options for one kind of model."""

    question_template: str
    question_options: dict
    answer_options: dict


def local_preset(temperature: float = 0.7, top_p: float = 0.9, do_sample: bool = True) -> Preset:
    """A model run in the executors: the long question template; sampling
    options go with the answer call only."""
    return Preset(QUESTION_TEMPLATE_LOCAL, dict(QUESTION_OPTIONS),
                  ANSWER_OPTIONS | {"temperature": temperature, "top_p": top_p, "do_sample": do_sample})


def api_preset(model: str | None = None, temperature: float = 0.7, top_p: float = 0.9) -> Preset:
    """A model behind a chat API: the short question template, the same options
    for both calls."""
    options = {"max_tokens": API_MAX_TOKENS, "temperature": temperature, "top_p": top_p, "n": API_CHOICES}
    options |= {"model": model} if model else {}
    return Preset(QUESTION_TEMPLATE_API, options, dict(options))


DEFAULT_PROMPT_BATCH = 32


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def question_prompt(context, template: str = QUESTION_TEMPLATE_API) -> Column:
    return F.concat(F.lit(template + TEXT_MARKER), _c(context))


def answer_prompt(context, question, template: str = ANSWER_TEMPLATE) -> Column:
    return F.concat(F.lit(template + TEXT_MARKER), _c(context), F.lit(QUESTION_MARKER), _c(question))


def question_fanout(chunks: DataFrame, n: int = DEFAULT_QUESTIONS_PER_CHUNK) -> DataFrame:
    """``n`` rows per chunk with question_index 0..n-1 (n = 0: no rows)."""
    if n <= 0:
        return chunks.withColumn("question_index", F.lit(0)).filter(F.lit(False))
    return chunks.withColumn("question_index", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


QA_SCHEMA = ("id string, question string, answer string, context string, question_index int, "
             "chunk_index long, error string")


def _call(gen, prompts: list[str], options: dict) -> list[tuple[str, str | None]]:
    """(output, error) per prompt of one call; a failing call is halved."""
    if not prompts:
        return []
    try:
        out = list(gen.generate(prompts, **options))
        if len(out) != len(prompts):
            raise ValueError(f"{len(prompts)} prompts gave {len(out)} outputs")
        return [("" if o is None else str(o).strip(), None) for o in out]
    except Exception as e:  # noqa: BLE001 - kept with the prompt that causes it
        if len(prompts) == 1:
            return [("", repr(e))]
        half = len(prompts) // 2
        return _call(gen, prompts[:half], options) + _call(gen, prompts[half:], options)


def _call_some(gen, prompts: list[str | None], options: dict, batch_size: int) -> tuple[list[str], list[str | None]]:
    """All prompts, ``batch_size`` a call; a null prompt is not sent."""
    sent = [p for p in prompts if p is not None]
    got = iter([r for i in range(0, len(sent), batch_size) for r in _call(gen, sent[i:i + batch_size], options)])
    each = [next(got) if p is not None else ("", "no context") for p in prompts]
    return [o for o, _ in each], [e for _, e in each]


def generate_qa(chunks: DataFrame, generator_factory: Callable[[], object], text_col: str = "chunk",
                index_col: str = "real_index", n_questions: int = DEFAULT_QUESTIONS_PER_CHUNK,
                question_template: str = QUESTION_TEMPLATE_API, answer_template: str = ANSWER_TEMPLATE,
                question_options: dict | None = None, answer_options: dict | None = None,
                keep: list[str] | None = None, batch_size: int = DEFAULT_PROMPT_BATCH, wanted: str | None = None,
                with_context: bool = True) -> DataFrame:
    """QA rows (keep..., id, question, answer, context, question_index, chunk_index, error).
    ``wanted`` names a column with the question indexes to ask for each chunk (array of
    int) in place of all ``n_questions``; ``with_context=False`` leaves the context out of the rows, so that it
    does not travel back from Python for each question.

    Each context goes to Python once; the ``n_questions`` rows per chunk are made
    there. Non-deterministic model calls: materialise the result (write it)
    before using it twice, or each action calls the model again."""
    ensure_on_executors(chunks.sparkSession)
    qo = dict(QUESTION_OPTIONS if question_options is None else question_options)
    ao = dict(ANSWER_OPTIONS if answer_options is None else answer_options)
    keep = list(keep or [])
    indexes = F.col(wanted) if wanted else F.array(*(F.lit(i) for i in range(max(0, n_questions)))).cast("array<int>")
    src = chunks.select(*keep, F.col(index_col).cast("long").alias("chunk_index"), F.col(text_col).alias("context"), indexes.alias("question_indexes"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields if f.name in keep)
    schema = (schema + ", " if schema else "") + (QA_SCHEMA if with_context else QA_SCHEMA.replace("context string, ", ""))
    asking = wanted is not None or n_questions > 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gen = generator_factory() if asking else None
        for pdf in batches:
            if gen is None or len(pdf) == 0:
                continue
            each = [list(x) for x in pdf["question_indexes"]]
            rows = pdf.loc[pdf.index.repeat([len(x) for x in each])].reset_index(drop=True)
            index = [i for x in each for i in x]
            contexts = [c if isinstance(c, str) else None for c in rows["context"]]
            questions, qerr = _call_some(gen, [None if c is None else question_template + TEXT_MARKER + c for c in contexts], qo, batch_size)
            answers, aerr = _call_some(gen, [None if c is None else answer_template + TEXT_MARKER + c + QUESTION_MARKER + q
                                             for c, q in zip(contexts, questions, strict=True)], ao, batch_size)
            yield pd.DataFrame({
                **{k: rows[k] for k in keep},
                "id": [QA_ID_FORMAT % (ci, qi) for ci, qi in zip(rows["chunk_index"], index, strict=True)],
                "question": questions, "answer": answers, **({"context": contexts} if with_context else {}),
                "question_index": pd.array(index, dtype="int32"),
                "chunk_index": rows["chunk_index"].astype("int64"),
                "error": [q or a for q, a in zip(qerr, aerr, strict=True)]})

    return src.mapInPandas(run, schema)


qa_pairs = generate_qa  # the public name used in the survey's API sketch


def drop_failed(qa: DataFrame) -> DataFrame:
    """Optional clean-up the reference does not do: drop rows whose generation
    failed or produced an empty question or answer."""
    ok = (F.col("question") != "") & (F.col("answer") != "")
    if "error" in qa.columns:
        ok = ok & F.col("error").isNull()
    return qa.filter(ok)

_PIECES = re.compile("[^" + re.escape(SENTENCE_TERMINATORS) + "]+")


def first_sentence(text: str) -> str:
    """First non-blank piece between sentence terminators, stripped (scans
    only as far as needed)."""
    for m in _PIECES.finditer(text):
        piece = m.group(0).strip()
        if piece:
            return piece
    return ""


class FirstSentenceGenerator:
    """Model-free stand-in: a question prompt yields the context's first
    sentence plus '?', an answer prompt yields the first sentence."""

    def generate(self, prompts: list[str], **_options) -> list[str]:
        out = []
        for p in prompts:
            ctx = p.split(TEXT_MARKER, 1)[1] if TEXT_MARKER in p else p
            if QUESTION_MARKER in ctx:
                out.append(first_sentence(ctx.rsplit(QUESTION_MARKER, 1)[0]))
            else:
                out.append(first_sentence(ctx) + "?")
        return out
