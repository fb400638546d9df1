"""Instruction-like language.

Patterns run on a folded text: lower case, with the three characters that fold to ASCII
letters (or must not) replaced first, so one plain regular expression serves every engine.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from umbra.functions.text import INLINE, SPACE

#: Dotted capital I folds to no letter; long s and the Kelvin sign fold to s and k.
FOLD_FROM, FOLD_TO = "İſK", "￼sk"


def gap(most: int) -> str:
    return f"{INLINE}{{0,{most}}}"


#: Patterns with anchors, one of which stands in every match; fixed values.
GENERAL = (
    (f"(?:ignore|disregard|forget){gap(40)}(?:instruction|prompt|direction)", ("instruction", "prompt", "direction")),
    (f"(?:ignore|disregard|forget){gap(50)}(?:requested|required|specified|desired){gap(30)}(?:output|response|answer)?{SPACE}*(?:format|style)", ("format", "style")),
    (f"(?:begin|start){gap(30)}(?:response|answer|output){gap(30)}(?:with|by)", ("response", "answer", "output")),
    (f"(?:do not|never){gap(30)}(?:mention|reveal|disclose){gap(30)}(?:instruction|prompt)", ("mention", "reveal", "disclose")),
    (f"(?:do not|never){gap(30)}(?:mention|reveal|disclose){gap(30)}(?:note|message|text)", ("mention", "reveal", "disclose")),
    (f"(?:include|insert|output|respond|answer){gap(50)}(?:word|phrase|token|exactly|必ず)", ("word", "phrase", "token", "exactly", "必ず")),
    ("(?:chatgpt|llm|language model|generative ai|生成ai|言語モデル)", ("chatgpt", "llm", "language model", "generative ai", "生成ai", "言語モデル")),
    (f"(?:以前|これまで|上記){gap(20)}(?:指示|命令){gap(20)}(?:無視|忘れ)", ("無視", "忘れ")),
    (f"(?:回答|出力|返答){gap(30)}(?:含め|挿入|記載|追加|書いて)", ("回答", "出力", "返答")),
    (f"(?:この|本){gap(15)}(?:指示|命令){gap(20)}(?:秘密|言及しない|開示しない)", ("指示", "命令")),
    (f"(?:含め|記載|挿入|追加|使用|用い|論じ|示し){gap(12)}(?:ること|てください|なさい|せよ|必須)", ("ること", "てください", "なさい", "せよ", "必須")),
)
STRONG = (
    (f"(?:ignore|disregard|forget){gap(50)}(?:instruction|prompt|direction|rubric)", ("instruction", "prompt", "direction", "rubric")),
    (f"(?:do not|never){gap(30)}(?:mention|reveal|disclose){gap(30)}(?:instruction|prompt|note|message|text)", ("mention", "reveal", "disclose")),
    GENERAL[6],
    GENERAL[7],
    GENERAL[9],
)


def folded(text: Column) -> Column:
    return F.lower(F.translate(text, FOLD_FROM, FOLD_TO))


def _any(text: Column, patterns: tuple) -> Column:
    """Anchors are plain searches; a pattern runs only where one of its anchors stands."""
    tests = (reduce(or_, (F.contains(text, F.lit(a)) for a in anchors)) & F.rlike(text, F.lit(p)) for p, anchors in patterns)
    return F.coalesce(reduce(or_, tests), F.lit(False))


def has_instruction(folded_text: Column) -> Column:
    """Whether a folded text holds instruction-like language; null counts as no."""
    return _any(folded_text, GENERAL)


def has_strong_instruction(folded_text: Column) -> Column:
    return _any(folded_text, STRONG)


def sql_test(text: str, patterns: tuple) -> str:
    """The same test as DuckDB SQL over a folded text."""
    return "(" + " OR ".join(f"regexp_matches({text}, '{p}')" for p, _ in patterns) + ")"


def sql_folded(text: str) -> str:
    return f"lower(translate({text}, '{FOLD_FROM}', '{FOLD_TO}'))"
