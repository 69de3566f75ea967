"""Parse and repair model texts that should hold a JSON plan.

Whole-document checks and bracket closing are native expressions. Only texts that
still fail reach one Arrow UDF; all others pass it as nulls.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_json(text: Column) -> Column:
    """Strict validity: the parser ignores what follows a document, the wrappers do not."""
    in_list = F.concat(F.lit("["), text, F.lit("]"))
    in_object = F.concat(F.lit('{"k":'), text, F.lit("}"))
    checks = [F.try_parse_json(t).isNotNull() for t in (text, in_list, in_object)]
    return F.coalesce(checks[0] & checks[1] & checks[2], F.lit(False))


def close_json(text: Column) -> Column:
    """Append the missing closing brackets, then the missing braces, by raw counts."""
    t = F.btrim(text, F.lit(" \t\r\n"))

    def lacking(opening: str, closing: str) -> Column:
        return F.greatest(
            F.regexp_count(t, F.lit(opening)) - F.regexp_count(t, F.lit(closing)), F.lit(0))

    return F.concat(t, F.repeat(F.lit("]"), lacking(r"\[", r"\]")),
                    F.repeat(F.lit("}"), lacking(r"\{", r"\}")))


def object_or_empty(text: Column) -> Column:
    """A JSON document that is not an object counts as an empty object."""
    return F.when(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), text).otherwise("{}")


def _load(text: str):
    try:
        return True, json.loads(text)
    except ValueError:
        return False, None


def balanced_block(text: str) -> str | None:
    """First ``{...}`` whose braces balance, ignoring braces inside strings."""
    start = text.find("{")
    if start < 0:
        return None
    depth = 0
    # one token per escape pair, quote or brace; everything else is irrelevant
    quoted = False
    for m in re.finditer(r'\\.|["{}]', text[start:], re.DOTALL):
        token = m.group()
        if token == '"':
            quoted = not quoted
        elif not quoted and token in "{}":
            depth += 1 if token == "{" else -1
            if depth == 0:
                return text[start : start + m.end()]
    return None


#: One JSON token: a string, a number or word, a sign. Possessive, so a broken string costs one look.
TOKEN = re.compile(
    r"""[ \t\r\n]*+(?:(?P<string>"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")"""
    r"""|(?P<scalar>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null|NaN|-?Infinity)"""
    r"""|(?P<sign>[\[\]{},:]))""")
#: What a token may do where the text stands: (state, token) -> next state. ``open`` and ``close`` change the stack.
MOVES = {
    **{(state, kind): "after" for state in ("value", "element") for kind in ("string", "scalar")},
    **{(state, sign): "open" for state in ("value", "element") for sign in "{["},
    ("member", "string"): "colon", ("name", "string"): "colon", ("colon", ":"): "value",
    ("member", "}"): "close", ("element", "]"): "close", ("after", "}"): "close", ("after", "]"): "close",
}


def last_complete(body: str) -> tuple[int, str]:
    """Where an object that breaks off can be cut so that ``]`` and then ``}`` close it: the last such place and what closes it.

    One pass with a stack. At a place where every value is complete the stack must be braces with brackets inside, and counting
    signs in the plain text, those in strings too, must give the same number of closing signs.
    """
    stack: list[str] = []
    buried = 0  # braces that opened inside a bracket: they would have to close first
    extra = {"[": 0, "{": 0}  # signs that only strings hold, opening ones less closing ones
    depth = {"[": 0, "{": 0}
    state, at, best = "value", 0, (0, "")
    while (token := TOKEN.match(body, at)):
        at, kind, word = token.end(), token.lastgroup, token[token.lastgroup]
        if kind == "string":
            for sign, other in ("[]", "{}"):
                extra[sign] += word.count(sign) - word.count(other)
        move = MOVES.get((state, word if kind == "sign" else kind))
        if state == "after" and word == ",":
            state = "name" if stack[-1] == "{" else "value"
            continue
        if move is None or (move == "close" and stack[-1] + word not in ("[]", "{}")):
            break
        if move == "open":
            buried += word == "{" and depth["["] > 0
            stack.append(word)
            depth[word] += 1
            move = "member" if word == "{" else "element"
        elif move == "close":
            depth[stack.pop()] -= 1
            buried -= word == "}" and depth["["] > 0
            move = "after"
        state = move
        complete = state in ("after", "member", "element")
        if complete and not buried and all(max(depth[x] + extra[x], 0) == depth[x] for x in "[{"):
            best = at, "]" * depth["["] + "}" * depth["{"]
        if not stack:
            break
    return best


def plan_fragment(text: str) -> dict:
    """The most of the object after ``"preprocessing_plan":`` that closing brackets make whole (empty if none)."""
    m = re.search(r'"preprocessing_plan"\s*:\s*(?=\{)', text)
    if not m:
        return {}
    body = text[m.end():]
    end, closing = last_complete(body)
    ok, value = _load(body[:end] + closing)
    return value if ok else {}


def salvage_text(text: str | None) -> tuple[str | None, str | None]:
    """Fragment repair, then the first balanced block; null in, null out."""
    if text is None:
        return None, None
    fragment = plan_fragment(text)
    if fragment:
        return "json_preprocessing_plan_block", json.dumps({"preprocessing_plan": fragment})
    block = balanced_block(text)
    ok, value = _load(block) if block else (False, None)
    if ok:
        return "json_regex_block", json.dumps(value if isinstance(value, dict) else {})
    return None, None


def salvage(text: Column) -> Column:
    """The repair as an Arrow UDF."""

    def batch(raw: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([salvage_text(t) for t in raw], columns=["status", "parsed"])

    return F.pandas_udf(batch, "struct<status:string,parsed:string>")(text)


def rescue_fields(text: Column) -> tuple[Column, Column]:
    """Target and task of a text that holds no usable JSON."""
    def grab(field: str) -> Column:
        return F.nullif(F.regexp_extract(text, rf'"{field}"\s*:\s*"([^"]+)"', 1), F.lit(""))

    return grab("target_column"), grab("task_type")


def parse_outputs(df: DataFrame, raw: str = "raw_output") -> DataFrame:
    """Adds ``parse_status`` and ``parsed`` (a JSON object text) to each raw output."""
    text = F.btrim(F.col(raw), F.lit(" \t\r\n"))
    df = df.withColumn("_text", text).withColumn("_closed", close_json(F.col(raw)))
    df = df.withColumn(
        "_native", F.when(F.col(raw).isNull() | (F.col(raw) == ""), "fallback_no_model_output")
        .when(is_json(F.col("_text")), "json_direct")
        .when(is_json(F.col("_closed")), "json_bracket_repair"))
    df = df.withColumn("_salvaged", salvage(F.when(F.col("_native").isNull(), F.col("_text"))))
    target, task = rescue_fields(F.col("_text"))
    rescued = target.isNotNull() | task.isNotNull()
    status = (
        F.when(F.col("_native").isNotNull(), F.col("_native"))
        .when(F.col("_salvaged.status").isNotNull(), F.col("_salvaged.status"))
        .when(rescued, "regex_critical_fields").otherwise("fallback_parse_failed")
    )
    parsed = (
        F.when(F.col("_native") == "json_direct", object_or_empty(F.col("_text")))
        .when(F.col("_native") == "json_bracket_repair", object_or_empty(F.col("_closed")))
        .when(F.col("_native").isNotNull(), "{}")
        .when(F.col("_salvaged.status").isNotNull(), F.col("_salvaged.parsed"))
        .when(rescued, F.to_json(F.struct(target.alias("target_column"), task.alias("task_type"))))
        .otherwise("{}")
    )
    return df.withColumn("parse_status", status).withColumn("parsed", parsed).drop(
        "_text", "_closed", "_native", "_salvaged")
