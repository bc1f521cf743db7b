"""The contract of answering pipelines: named problems, never counts; and a registry of pipelines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import bound

# The states a response may have, and its fields.
STATUS = ("supported_answer", "partial_answer", "needs_clarification", "insufficient_evidence", "missing_required_source", "conflicting_evidence", "access_restricted", "out_of_scope")
REQUIRED = ("answer", "sources", "ranked", "status")
OPTIONAL = {"confidence": "double", "model": "string", "route": "string", "rerank": "string", "n_context": "int", "n_retrieved": "int", "error": "string"}

_PIPELINES: dict[str, Callable] = {}


def register(name: str, pipeline: Callable) -> None:
    _PIPELINES[name] = pipeline


def pipeline(name: str) -> Callable:
    """The pipeline of a name; an unknown name is an error, there is no fallback."""
    if name not in _PIPELINES:
        raise KeyError(f"no pipeline {name!r}; known: {sorted(_PIPELINES)}")
    return _PIPELINES[name]


def normalised(responses: DataFrame) -> DataFrame:
    """Optional fields that are absent come as nulls; required ones are never made up."""
    return responses.withColumns({n: F.lit(None).cast(t) for n, t in OPTIONAL.items() if n not in responses.columns})


def _lacks(field: str) -> Callable[[Column], Column]:
    return lambda entry: entry[field].isNull()


def problems(responses: DataFrame, strict: bool = True) -> Column:
    """array<string> of what is wrong with a response; empty for one that keeps the contract and for one with an error (it is dropped, not scored)."""
    have, kinds = set(responses.columns), dict(responses.dtypes)
    checks = [F.when(F.lit(f not in have) if f not in have else F.col(f).isNull(), F.lit(f"missing required field: {f}")) for f in REQUIRED]
    if "status" in have:
        checks.append(F.when(F.col("status").isNotNull() & ~F.col("status").isin(*STATUS), F.lit("status is not permitted")))
    if "sources" in have:
        checks += [F.when(F.exists("sources", _lacks(f)), F.lit(f"every source needs {f}")) for f in ("doc", "clause") if f in kinds["sources"]]
    if "ranked" in have:
        checks.append(F.when(F.exists("ranked", _lacks("point_id")), F.lit("every ranked entry needs point_id")))
    if strict and {"ranked", "sources"} <= have:
        checks.append(F.when(F.size("ranked") < F.size("sources"), F.lit("ranked is shorter than sources")))
    if "confidence" in have:
        checks.append(F.when(~F.col("confidence").between(0, 1), F.lit("confidence is not in 0..1")))
    found = F.array_compact(F.array(*checks))
    return F.when(F.col("error").isNotNull() & (F.col("error") != ""), F.array().cast("array<string>")).otherwise(found) if "error" in have else found


def status_of(answer: Column, error: Column, refusal: str) -> Column:
    """null for an error, 'insufficient_evidence' for an answer that begins with the refusal, else 'supported_answer'."""
    return F.when(error.isNotNull() & (error != ""), None).when(F.ltrim(F.coalesce(answer, F.lit(""))).startswith(refusal), "insufficient_evidence").otherwise("supported_answer")


# Words that begin a qualifier, verbs a proposition has, and words a head must not end in.
PREPOSITIONS = "according after against at before by considering during for from in on per subject through to under unless using where with within".split()
VERBS = (
    "shall must is are was were may can should will includes include requires require provides provide uses use has have covers cover "
    "applies apply defines define states state consists contains specifies specify"
).split()
DANGLING = ["and", "or", "the", "a", "an", "of", *PREPOSITIONS]
HEAD_TOKENS, TAIL_TOKENS = 6, 3


def truncate_claim(text: Column) -> Column:
    """struct(head, tail): the claim before its last qualifier and the qualifier; null where no cut leaves a proposition.

    The cut stands before the last preposition that leaves six tokens with a verb, not ending in
    a word that dangles, and three tokens after it.
    """
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    return bound(tokens, lambda t: bound(F.transform(t, lambda x: F.lower(F.regexp_extract(x, r"[A-Za-z][A-Za-z0-9'-]*", 0))), lambda w: _cut(t, w)))


def _cut(tokens: Column, words: Column) -> Column:
    n = F.size(tokens)
    spots = F.when(n >= HEAD_TOKENS + TAIL_TOKENS, F.sequence(n - TAIL_TOKENS, F.lit(HEAD_TOKENS), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    head = lambda i: F.rtrim(F.regexp_replace(F.array_join(F.slice(tokens, 1, i), " "), r"[,;: ]+$", ""))

    def good(i: Column) -> Column:
        return (
            F.get(words, i).isin(*PREPOSITIONS) & F.arrays_overlap(F.slice(words, 1, i), F.array(*[F.lit(v) for v in VERBS]))
            & ~F.get(words, i - 1).isin(*DANGLING) & (F.size(F.split(head(i), " ")) >= HEAD_TOKENS)
        )

    at = F.get(F.filter(spots, good), F.lit(0))
    return F.when(at.isNotNull(), F.struct(head(at).alias("head"), F.array_join(F.slice(tokens, at + 1, n), " ").alias("tail")))
