"""Extension points: extractors, fact sources and completers run in Arrow batches on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from graphloom.operators.facts import query_fact, verify_fact

# texts -> (entity lines, triple lines) per text
Extractor = Callable[[list[str]], list[tuple[str, str]]]
# texts -> texts
Completer = Callable[[list[str]], list[str]]


def run_extractor(docs: DataFrame, extract: Extractor, text: str = "text", batch: int = 64) -> DataFrame:
    """Add ``entity_response``, ``triple_response`` and ``error`` from a batched extractor.

    A failing batch is tried again text by text, so one bad text costs only its
    own row: the row stays, with the failure in ``error``.
    """
    schema = T.StructType(list(docs.schema.fields)).add("entity_response", "string").add("triple_response", "string").add("error", "string")

    def one(t: str):
        try:
            entities, triples = extract([t])[0]
            return entities, triples, None
        except Exception as exc:
            return "", "", f"{type(exc).__name__}: {exc}"

    def answers(texts: list[str]):
        try:
            got = extract(texts)
            if len(got) != len(texts):
                raise ValueError("one answer per text expected")
            return [(e, t, None) for e, t in got]
        except Exception:
            return [one(t) for t in texts]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame[text].tolist()
            rows = [a for i in range(0, len(texts), batch) for a in answers(texts[i : i + batch])]
            out = frame.copy()
            for i, name in enumerate(("entity_response", "triple_response", "error")):
                out[name] = pd.Series([r[i] for r in rows], index=frame.index, dtype="object")
            yield out

    return docs.mapInPandas(run, schema)


def run_completer(docs: DataFrame, complete: Completer, text: str = "text", only: str | None = None) -> DataFrame:
    """Replace the text by what a batched completion function returns; off unless called.

    A failing batch is tried again text by text; a text that fails stays as it is.
    With ``only``, a boolean column, the function sees the rows where it is true.
    """

    def one(t: str) -> str:
        try:
            return complete([t])[0]
        except Exception:
            return t

    def answers(texts: list[str]) -> list[str]:
        try:
            got = list(complete(texts))
            if len(got) != len(texts):
                raise ValueError("one answer per text expected")
            return got
        except Exception:
            return [one(t) for t in texts]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame[text].astype("object").copy()
            asked = [True] * len(frame) if only is None else [v is True or v == True for v in frame[only]]  # noqa: E712
            texts[asked] = pd.Series(answers(texts[asked].tolist()), index=texts[asked].index, dtype="object")
            yield frame.assign(**{text: texts})

    return docs.mapInPandas(run, docs.schema)


class KnowledgeBase:
    """Facts as a DataFrame, with an optional batched function for the subjects it does not know.

    ``lookup`` gets a pandas frame with ``subject`` and ``relation`` and returns a
    series of objects (None: unknown).
    """

    def __init__(self, facts: DataFrame, lookup: Callable[[pd.DataFrame], pd.Series] | None = None):
        self.facts = facts
        self.lookup = lookup

    def query(self, df: DataFrame, subject: str, relation: str, out: str = "fact") -> DataFrame:
        answered = query_fact(df, self.facts, subject, relation, out)
        if self.lookup is None:
            return answered
        lookup = self.lookup

        @F.pandas_udf("string")
        def ask(subjects: pd.Series, relations: pd.Series) -> pd.Series:
            return lookup(pd.DataFrame({"subject": subjects, "relation": relations}))

        # every distinct miss is asked once
        misses = answered.filter(F.col(out).isNull()).select(F.col(subject).alias("_s"), F.col(relation).alias("_r")).distinct()
        extra = misses.withColumn("_x", ask("_s", "_r"))
        hit = (F.col(subject) == F.col("_s")) & (F.col(relation) == F.col("_r"))
        joined = answered.join(extra, hit, "left").withColumn(out, F.coalesce(out, "_x"))
        return joined.drop("_s", "_r", "_x")

    def verify(self, df: DataFrame, subject: str, predicate: str, obj: str, out: str = "check", located_in: str = "country") -> DataFrame:
        """``verify_fact`` against the facts and, for subjects they do not know, the look-up."""
        if self.lookup is None:
            return verify_fact(df, self.facts, subject, predicate, obj, out, located_in)
        subjects = df.select(F.col(subject).alias("subject"), F.lit(located_in).alias("relation")).distinct()
        known = self.query(subjects, "subject", "relation", "object").filter(F.col("object").isNotNull())
        return verify_fact(df, known, subject, predicate, obj, out, located_in)
