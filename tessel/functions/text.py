"""Prompts, answers and keywords as column expressions. Boundaries are written with Unicode classes, which every engine reads alike."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
EDGE_L, EDGE_R = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"

# The default prompt, two canned prompts, words without visual meaning, the cue of dual-stream content.
PROMPT = "Select the best answer to the following multiple-choice question based on the video. Respond with only the letter (A, B, C or D) of the correct option.\n{question}\n{options}\nThe best answer is:"
CANNED = ("Answer the question using a single word or phrase.", "Answer with the option's letter from the given choices directly.")
NON_VISUAL = ("a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "it", "they", "he", "she", "we", "you", "i", "what", "where", "when", "why", "how", "who", "which", "and", "or", "but", "so", "if", "then", "question", "answer", "to", "for", "with", "by", "from", "at", "into", "onto", "upon")
CUE = ("The above low-resolution video provides temporal context. The following ", " high-resolution images show selected key frames:")


def strip(c: Column) -> Column:
    """Without white space at both ends, any Unicode white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def options_text(choices: Column) -> Column:
    """A. first, B. second, one a line; more than 26 are an error."""
    lines = F.transform(choices, lambda c, i: F.concat(F.substr(F.lit(LETTERS), i + 1, F.lit(1)), F.lit(". "), c))
    return F.when(F.size(choices) > 26, F.raise_error(F.lit("more than 26 options")).cast("string")).otherwise(F.array_join(lines, "\n"))


def build_prompt(question: Column, choices: Column, template: str = PROMPT) -> Column:
    """The template with its placeholders filled in; placeholders inside a question stay as they are."""
    parts: list[Column] = []
    for i, piece in enumerate(template.split("{question}")):
        parts += [question] * (i > 0)
        for j, rest in enumerate(piece.split("{options}")):
            parts += [options_text(choices)] * (j > 0) + [F.lit(rest)] * bool(rest)
    return F.concat(*parts)


def extract_choice(text: Column) -> Column:
    """The letter an answer chooses: the last [[x]] or {{x}}; else, of the stripped text in capitals, a leading letter that a sign or space follows (or alone),
    the letter after ANSWER, OPTION or CHOICE, or the first letter that stands alone; else null."""
    text = F.coalesce(text, F.lit(""))
    wraps = F.regexp_extract_all(text, F.lit(r"\[\[\s*([A-Za-z])\s*\]\]|\{\{\s*([A-Za-z])\s*\}\}"), F.lit(0))
    wrapped = F.upper(F.regexp_extract(F.try_element_at(wraps, F.lit(-1)), r"([A-Za-z])", 1))
    t = F.upper(strip(text))
    got = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    lone = F.when(F.char_length(t) == 1, got(r"^([A-Z])$"))
    lead = got(r"(?U)^\(?\s*([A-Z])\s*[\).:\-\s]")
    named = got(EDGE_L + r"(?:ANSWER|OPTION|CHOICE)[^\p{L}\p{N}_][^A-Z]{0,7}([A-Z])" + EDGE_R)
    alone = got(EDGE_L + r"([A-Z])" + EDGE_R)
    return F.coalesce(wrapped, lead, lone, named, alone)


def score_mcq(prediction: Column, gold: Column) -> Column:
    """Null without gold; else whether the extracted letter is gold's first; a blank gold equals an answer without a letter."""
    g = F.nullif(F.left(F.upper(strip(gold)), F.lit(1)), F.lit(""))
    return F.when(gold.isNull(), F.lit(None).cast("boolean")).otherwise(extract_choice(prediction).eqNullSafe(g))


def word_count(text: Column) -> Column:
    """Tokens by white space."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")).cast("long")


def split_thinking(text: Column, total: Column, enabled: Column, count: Callable[[Column], Column] = word_count) -> tuple[Column, Column, Column]:
    """(answer, decode tokens, thinking tokens): with thinking on and a close tag, the answer stands behind the first one; count gives a text's tokens, for example by a
    tokenizer in a pandas UDF."""
    tag = "</think>"
    at = F.instr(text, tag)
    on = enabled & (at > 0)
    answer = strip(F.substr(text, at + len(tag), F.char_length(text)))
    words = count(answer)
    return F.when(on, answer).otherwise(text), F.when(on, words).otherwise(total), F.when(on, F.greatest(F.lit(0).cast("long"), total - words)).otherwise(F.lit(0).cast("long"))


def prompt_body(prompt: Column, subtitles: Column) -> Column:
    return F.when(F.coalesce(subtitles, F.lit("")) != "", F.concat(subtitles, F.lit("\n\n"), prompt)).otherwise(prompt)


def strip_option(option: Column) -> Column:
    """Without a prefix such as A. or B)."""
    return F.regexp_replace(option, r"(?U)^\s*[A-Z][.)]\s*", "")


def keywords(text: Column) -> Column:
    """The words that name things, joined by spaces; the text without canned prompts if none is left."""
    text = F.coalesce(text, F.lit(""))
    for c in CANNED:
        text = F.replace(text, F.lit(c), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    kept = F.filter(words, lambda w: ~F.lower(w).isin(*NON_VISUAL))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(text)


def family(model: Column) -> Column:
    m = F.lower(model)
    return F.when(m.contains("2.5") | m.contains("2_5"), "qwen2_5_vl").when(m.contains("3.5") | m.contains("3_5"), "qwen3_5").otherwise("qwen3_vl")


def _one_decimal(v: float | None) -> str | None:
    return None if pd.isna(v) else f"{v:.1f}"


@F.pandas_udf(StringType())
def one_decimal(x: pd.Series) -> pd.Series:
    """%.1f of the binary value, half to even; the JVM's format rounds the decimal digits half up."""
    return x.map(_one_decimal)


@F.pandas_udf(ArrayType(StringType()))
def one_decimals(x: pd.Series) -> pd.Series:
    """one_decimal of each number of an array."""
    return x.map(lambda row: None if row is None else [_one_decimal(v) for v in row])


def lohi_content(query: Column, stamps: Column) -> Column:
    """Parts of a dual-stream message: the video, the cue, then a stamp and an image a key frame, then the question. stamps: formatted strings."""
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    cue = F.concat(F.lit(CUE[0]), F.size(stamps).cast("string"), F.lit(CUE[1]))
    frames = F.flatten(F.transform(stamps, lambda t: F.array(part("text", F.concat(F.lit("<"), t, F.lit(" seconds>"))), part("image", F.lit("")))))
    return F.concat(F.array(part("video", F.lit("")), part("text", cue)), frames, F.array(part("text", query)))


def parse_shard(spec: str) -> tuple[int, int]:
    """i/N with 0 <= i < N."""
    i, slash, n = spec.partition("/")
    if not (slash and i.isascii() and i.isdigit() and n.isascii() and n.isdigit()):
        raise ValueError(f"a shard is i/N, got {spec!r}")
    if not 0 <= int(i) < int(n):
        raise ValueError(f"a shard needs 0 <= i < N, got {spec!r}")
    return int(i), int(n)
