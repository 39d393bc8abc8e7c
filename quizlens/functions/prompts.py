"""Prompt builders (G1-G3) as ``concat`` Column expressions.

Optional parts are decided in Python (flags), never with ``when``; a NULL
field prints as an empty string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --------------------------------------------------------------------------
# Prompt layouts and templates that must match the originals
# character for character (including indentation and trailing spaces).
# --------------------------------------------------------------------------

JUDGE_DELIMITER = "-----\n"
JUDGE_QUESTION = "Question:\n"
JUDGE_OPTIONS = "Options:\n"
JUDGE_OPTION_LABELS = ("a) ", "\nb) ", "\nc) ", "\nd) ")
JUDGE_CORRECT = "Correct option: "
JUDGE_CONTEXT_HEAD = "Context:\n-----\n"
JUDGE_CONTEXT_TAIL = "\n-----\n"

GENERATION_TEMPLATE_HEAD = (
    "\n"
    "    Based on the following educational content, generate a multiple-choice question with four answer \n"
    "    options where only one is correct. The question should assess understanding of the main ideas, \n"
    "    and the options should be clear, informative, and relevant. Ensure that the distractors (incorrect options) \n"
    "    follow a logical but incorrect interpretation, based on common misconceptions or misunderstandings of the topic.\n"
    "    Answer options must be as short as possible.\n"
    "\n"
    "    **Educational Content**\n"
    "    "
)
GENERATION_TEMPLATE_TAIL = "\n    "

EXAM_TEMPLATE_HEAD = "\n    Answer the following multiple-choice question:\n\n\n    Question: "
EXAM_TEMPLATE_OPTIONS = "\nOptions:\n"
EXAM_OPTION_LABELS = ("A. ", "\nB. ", "\nC. ", "\nD. ")
EXAM_TEMPLATE_TAIL = (
    "\n\n\n    Provide only the letter corresponding to the correct answer (A, B, C, or D).\n    "
)

CLEANING_USER_HEAD = "Medical text:\n-------------\n"
CLEANING_SYSTEM_PROMPT = """
You are an expert in text preprocessing for NLP applications. Your task is to clean up the following medical text while preserving all its essential information. Specifically:

1. **Remove or replace wiki-style links** (e.g., `[[Abnormal genital bleeding (outside known pregnancy) SD-112|genital bleeding]]` should become `"Abnormal genital bleeding (SD-112)"`).
2. **Ensure consistent section formatting**:
   - Convert section titles to a uniform format (e.g., `== Definitions ==`).
   - Remove excessive use of bold (`'''`) and italics (`''`) unless necessary.
3. **Remove or replace image references**:
   - If an image is mentioned (`[File:Higham score.png|vignette|Higham score]]`), replace it with a descriptive text (e.g., `"The Higham score is used to assess menorrhagia severity."`).
4. **Standardize lists and bullet points**:
   - Ensure bullet points follow a clear structure.
   - Remove any unnecessary symbols or broken formatting.
5. **Keep all medical terms and numerical values unchanged.**
6. **Ensure the final text is well-structured, readable, and suitable for NLP processing.**

Clean up the text provided to you.
"""

# --------------------------------------------------------------------------


def _text(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(""))


def judge_prompt(question_col: str = "question", option_a_col: str = "option_a",
                 option_b_col: str = "option_b", option_c_col: str = "option_c",
                 option_d_col: str = "option_d", correct_option_col: str = "correct_option",
                 include_options: bool = True, include_correct_option: bool = True,
                 context_col: str | None = None) -> Column:
    """G1: the judge's user prompt for one question row."""
    parts: list[Column] = []
    if context_col is not None:
        parts += [F.lit(JUDGE_CONTEXT_HEAD), _text(context_col), F.lit(JUDGE_CONTEXT_TAIL)]
    parts += [F.lit(JUDGE_DELIMITER), F.lit(JUDGE_QUESTION), _text(question_col), F.lit("\n")]
    if include_options:
        parts.append(F.lit(JUDGE_OPTIONS))
        for label, c in zip(JUDGE_OPTION_LABELS, (option_a_col, option_b_col, option_c_col, option_d_col)):
            parts += [F.lit(label), _text(c)]
        parts.append(F.lit("\n"))
    if include_correct_option:
        parts += [F.lit(JUDGE_CORRECT), _text(correct_option_col), F.lit("\n")]
    parts.append(F.lit(JUDGE_DELIMITER))
    return F.concat(*parts)


def generation_prompt(content_col: str = "content_gpt") -> Column:
    """The question-generation prompt around a sheet's text."""
    return F.concat(F.lit(GENERATION_TEMPLATE_HEAD), _text(content_col), F.lit(GENERATION_TEMPLATE_TAIL))


def exam_prompt(question_col: str = "question", opa: str = "opa", opb: str = "opb",
                opc: str = "opc", opd: str = "opd") -> Column:
    """The A-D exam prompt for one item."""
    parts = [F.lit(EXAM_TEMPLATE_HEAD), _text(question_col), F.lit(EXAM_TEMPLATE_OPTIONS)]
    for label, c in zip(EXAM_OPTION_LABELS, (opa, opb, opc, opd)):
        parts += [F.lit(label), _text(c)]
    parts.append(F.lit(EXAM_TEMPLATE_TAIL))
    return F.concat(*parts)


def cleaning_prompt(content_col: str = "content_cleaned") -> Column:
    """G5 user prompt: the sheet text under a fixed header."""
    return F.concat(F.lit(CLEANING_USER_HEAD), _text(content_col))
